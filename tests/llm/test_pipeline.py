from pyspark.sql import functions as F

import corpus_pipeline
from sparkweave.llm import minhash_dedup
from tests.llm import brute
from tests.llm.test_tokens import check_packing

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before)
        gone = set(before) - set(after)
        if name == "quality":
            assert {i for i, r in labels.items() if r.quality == 0} <= gone
            assert not {i for i in gone if i in labels and labels[i].quality == 1}
        elif name == "toxicity":
            assert not {i for i in gone if i in labels and labels[i].toxic == 0}
        elif name == "near_duplicates":
            sets = {i: brute.words(r.text) for i, r in before.items()}
            assert gone and all(sets[i] for i in gone)
            assert {r.doc_id for r in minhash_dedup.near_duplicates(spark.createDataFrame(list(before.values()), docs.schema)).collect() if r.kept} == set(after)
        else:
            assert not gone and not any(brute.base_spans(r.text) for r in after.values())
            assert all(r.n_chars == len(r.text) for r in after.values())
        before = after
    rows = corpus_pipeline.pack(spark, docs, SF).collect()
    check_packing(docs, rows, 4096)


def test_representatives(spark):
    rows = [(3, "a b c d e f", "x"), (3, "a b c d e f", "x"), (1, "A b c d e f", "y"), (None, "n n n n n n", "z"), (None, "n n n n n n", "z"),
            (4, None, "w"), (5, "", "w"), (5, "", "w"), (6, "other words here", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    kept = minhash_dedup.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.row) for r in kept.select("doc_id", F.coalesce("row", F.lit("-")).alias("row")).collect()) == [
        (-1, "z"), (1, "y"), (4, "w"), (5, "w"), (5, "w"), (6, "-")]
    assert minhash_dedup.representatives(docs.limit(0)).count() == 0


def test_empty_and_odd_documents(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    odd = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "word " * 20_000, None, "s", 5)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert docs.count() >= 0


def test_columns_that_clash_are_kept(spark):
    """Names of work columns, names with dots and names that differ in case only
    go through all stages with their values."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    odd = {"__row": F.concat(F.lit("r"), F.col("doc_id").cast("string")), "__score": F.lit(7), "__predicted": F.lit(0), "__extra": F.lit("e"), "__s": F.col("doc_id"),
           "__clean": F.lit("c"), "row": F.lit("x"), "kind": F.lit(None).cast("string"), "digest": F.lit(1), "label": F.lit("l"), "size_class": F.lit("s"),
           "__matches": F.lit(5), "other_1": F.lit("o")}
    wide = docs.withColumns(odd).withColumnRenamed("lang", "a.b")
    wide = wide.toDF(*["TEXT" if c == "source" else c for c in wide.columns])
    plain = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, wide = stage(spark, plain, SF).cache(), stage(spark, wide, SF).cache()
        want = {r.doc_id: (r.text, r.source, r.lang) for r in plain.collect()}
        got = {r[0]: (r[wide.columns.index("text")], r[wide.columns.index("TEXT")], r[wide.columns.index("a.b")]) for r in wide.collect()}
        assert got == want, name
        at = {c: wide.columns.index(c) for c in odd}
        assert all(r[at["__row"]] == f"r{r[0]}" and r[at["__score"]] == 7 and r[at["__s"]] == r[0] and r[at["other_1"]] == "o" and r[at["row"]] == "x" for r in wide.collect())


def test_near_copies_without_ids_are_no_dearer(spark):
    """Texts are found by their own key: a null id on all rows joins nothing with everything."""
    base = [f"w{i}" for i in range(60)]
    rows = [(None if nulls else i, " ".join([*base, f"x{i}"])) for nulls in (False, True) for i in range(90)]
    for part, ids in ((rows[:90], True), (rows[90:], False)):
        df = spark.createDataFrame(part, "doc_id long, text string").repartition(4)
        out = minhash_dedup.near_duplicates(df, k=4)
        plan = out.collect()
        assert len(plan) == 90 and len({r.component_id for r in plan}) == 1
        sketched = minhash_dedup.sketch(df, 4)
        whole = df.select(F.col("doc_id").alias("i"), minhash_dedup._text_key().alias("k"))
        met = sketched.join(whole, (F.col("text_key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("i")))
        assert met.count() == 90


def test_only_what_the_result_reads_is_left(spark):
    from sparkweave import fs
    from sparkweave.llm import common
    from sparkweave.llm.components import components
    before = set(fs.list_names(spark, f"{common.fresh_path(spark, 'x').rsplit('/', 2)[0]}/components"))
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90)], "u long, v long")
    found = components(edges)
    assert {(r.node, r.component) for r in found.collect()} == {(i, 0) for i in range(1, 41)} | {(100, 90)}
    after = set(fs.list_names(spark, f"{common.fresh_path(spark, 'x').rsplit('/', 2)[0]}/components"))
    assert len(after - before) == 1 and found.written_at.rsplit("/", 1)[1] in after
    kept = []
    with common.scratch(spark, kept):
        gone = common.materialise(edges, "scratch-test")
        kept.append(common.materialise(edges, "scratch-test"))
    assert not fs.exists(spark, gone.written_at) and kept[0].count() == 41


def test_run_leaves_its_result_only(spark):
    from sparkweave import fs
    from sparkweave.llm import common
    root = common.fresh_path(spark, "x").rsplit("/", 2)[0]
    folders = lambda: {f"{kind}/{n}" for kind in fs.list_names(spark, root, dirs_only=True) for n in fs.list_names(spark, f"{root}/{kind}", dirs_only=True)}
    before = folders()
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and [x.split("/")[0] for x in folders() - before] == ["pipeline-packing"]
