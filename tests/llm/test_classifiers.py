import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkweave.llm import quality, toxicity
from sparkweave.llm.common import fold
from sparkweave.llm.labelled import labelled_sample
from tests.llm import brute

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def given_tables(spark):
    return tuple(spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "plain words"), (3, "word " * 40_000), (4, "\n\t "), (5, "!!! $$$ 😀")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("label", F.lit(9))


def evaluated(scored, labels, column):
    rows = scored.join(labels, "doc_id").select("__score", "__predicted", F.col(column).alias("y"), "doc_id").collect()
    return np.array([(r["__score"], r["__predicted"], r["y"]) for r in rows])


def test_quality_on_held_out_documents(given_tables):
    docs, labels = given_tables
    machine = quality.train(docs, labels, rows=fold("doc_id", 3) != 1)
    held = quality.with_scores(docs.filter(fold("doc_id", 3) == 1), machine)
    x = evaluated(held, labels, "quality")
    assert (x[:, 1] == x[:, 2]).mean() > 0.97 and ((x[:, 1] == 1) == (x[:, 0] >= 0.5)).all()


def test_toxicity_on_held_out_documents(given_tables):
    docs, labels = given_tables
    lexicon = toxicity.learn(docs, labels, rows=fold("doc_id", 5) != 0)
    x = evaluated(toxicity.with_scores(docs.filter(fold("doc_id", 5) == 0), lexicon), labels, "toxic")
    assert (x[:, 1] == x[:, 2]).mean() > 0.95
    assert not ((x[:, 1] == 1) & (x[:, 2] == 0)).any()


def test_machine_equals_all_pairs():
    rng = np.random.default_rng(0)
    m = quality.Machine(0.3, rng.normal(size=quality.HASHED + quality.STATISTICS), rng.normal(size=(quality.HASHED + quality.STATISTICS, quality.RANK)),
                        np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS))
    at, value = rng.choice(quality.HASHED, 12, replace=False), rng.normal(size=12) / 5
    z = m.bias + sum(m.weight[a] * v for a, v in zip(at, value))
    z += sum(m.vectors[at[i]] @ m.vectors[at[j]] * value[i] * value[j] for i in range(12) for j in range(i))
    assert m.score(at, value) == pytest.approx(1 / (1 + np.exp(-z)))


def test_odd_rows(spark, odd, given_tables):
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (2, 0, 0), (None, 1, 1), (7, None, 5)], "doc_id long, quality int, toxic int")
    for table in (odd, odd.limit(0)):
        for model, op in ((quality.train(odd, labels), quality), (quality.train(odd.limit(0), labels.limit(0)), quality),
                          (toxicity.learn(odd, labels), toxicity), (toxicity.learn(odd, labels.limit(0)), toxicity)):
            rows = op.with_scores(table, model).collect()
            assert len(rows) == table.count() and all(0 <= r["__score"] <= 1 and r.score == "x" for r in rows)
            assert all(r["__predicted"] == int(r["__score"] >= 0.5) for r in rows)
    empty = toxicity.Lexicon((("idiot", False, 4.0),))
    assert all(r["__predicted"] == 0 for r in toxicity.with_scores(odd, empty).collect())


def test_metadata(spark):
    docs = spark.createDataFrame([(i, "same text", "a" if i % 2 else "b") for i in range(60)], "doc_id long, text string, kind string")
    labels = docs.select("doc_id", (F.col("kind") == "a").cast("int").alias("quality"))
    machine = quality.train(docs, labels, metadata=("kind",))
    rows = quality.with_scores(docs, machine, metadata=("kind",)).collect()
    assert all(r["__predicted"] == int(r.kind == "a") for r in rows)


def test_folding_and_exceptions():
    lexicon = toxicity.Lexicon((("idiot", False, 4.0), ("veju", True, 5.0), ("scum", False, 3.0)), exceptions=("pond scum", "idiot-proof"))
    a = lexicon.automaton()
    found = lambda x: toxicity.matched(a, toxicity.folded(x))
    assert found("You 1D10T!") == (4.0, 1) and found("іdіоt") == (4.0, 1) and found("ｉｄｉｏｔ") == (4.0, 1) and found("id​iot") == (4.0, 1)
    assert found("idiots") == (0, 0) and found("vejuaire vejus aveju") == (10.0, 2)
    assert found("an idiot-proof pond scum test") == (0, 0) and found("pond scum and scum") == (3.0, 1)


def test_sample_is_bounded_and_leaves_labels_alone(spark, given_tables):
    docs, labels = given_tables
    rows = labelled_sample(docs, labels, "quality", 20, fold("doc_id", 3) != 1).collect()
    assert len(rows) == 40 and all(brute.fold(r.doc_id, 3) != 1 for r in rows)


def test_copies_of_a_long_toxic_document_leave_the_lexicon_whole(spark):
    """Copies of one document with more words than the lexicon would once look at."""
    own = " ".join(f"{a}{b}{c}quor" for a in "bcdfghjklmnpstvz" for b in "aeiouy" for c in ("rst", "mnt", "lks", "vrn", "zzt", "gld", "pph", "xio", "wun", "kee"))
    plain = ["the", "old", "house", "by", "a", "river", "stood", "quiet"]
    rows, labels = [], []
    for i in range(300):
        rows.append((i, f"{plain[i % 8]} {plain[i // 8 % 8]} {'grobnak' if i < 60 else plain[i % 5]} number{chr(97 + i % 26)} word{chr(97 + i // 26)}"))
        labels.append((i, 0, int(i < 60)))
    for i in range(300, 500):
        rows.append((i, own))
        labels.append((i, 0, 1))
    assert len(toxicity.terms(own)) > 4000
    lexicon = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    automaton = lexicon.automaton()
    assert toxicity.matched(automaton, "a grobnak here")[1] == 1
    assert not [t for t, _, _ in lexicon.entries if t in own]


def test_covering_equals_the_plain_choice():
    rng = np.random.default_rng(0)
    terms = [(f"t{i}", bool(i % 2)) for i in range(80)]
    covers = {t: set(rng.integers(0, 60, rng.integers(1, 30)).tolist()) for t in terms}
    counts = {t: (len(covers[t]), int(rng.integers(0, 3))) for t in terms}
    left, rest, want = set(range(60)) - {1, 2, 3}, dict(covers), []
    while rest and len(want) < 20:
        gain = {t: len(d & left) - 2 * counts[t][1] for t, d in rest.items()}
        best = max(rest, key=lambda t: (gain[t], len(t[0]), t))
        if gain[best] < 2:
            break
        want.append(best)
        left -= rest.pop(best)
    assert toxicity._covering(covers, counts, {1, 2, 3}, 2) == want


def test_labels_of_missing_documents_use_up_no_places(spark, given_tables):
    docs, labels = given_tables
    there = docs.join(labels, "doc_id").filter("quality = 1").select(docs["*"])
    n = there.join(labels.filter("toxic = 0"), "doc_id", "left_semi").select("doc_id").distinct().count()
    sample = labelled_sample(there, labels, "toxic", n, None).filter("label = 0")
    assert n and sample.count() == n


def test_toxicity_score_equals_brute_force(spark, given_tables):
    """Matches looked for term by term, at every place, without an automaton."""
    docs, labels = given_tables
    lexicon = toxicity.learn(docs, labels, rows=fold("doc_id", 5) != 0)

    def plain(text):
        x = toxicity.folded(text or "")
        letter = lambda i: 0 <= i < len(x) and x[i].isalpha()

        def places(term):
            at = x.find(term)
            while at >= 0:
                if not letter(at - 1):
                    yield at
                at = x.find(term, at + 1)

        spared = [(a, a + len(p)) for e in lexicon.exceptions for p in [toxicity.folded(e)] for a in places(p) if not letter(a + len(p))]
        hits = {}
        for term, stem, weight in lexicon.entries:
            for a in places(term):
                if (stem or not letter(a + len(term))) and not any(i <= a < j for i, j in spared):
                    hits[a] = max(weight, hits.get(a, 0.0))
        z = lexicon.curve[0] + float(np.dot(lexicon.curve[1:], toxicity.features(sum(hits.values()), x)))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), len(hits)

    toxic = labels.filter("toxic = 1").select("doc_id")
    rows = docs.join(toxic, "doc_id", "left_semi").union(docs.filter("doc_id % 9 = 0").select(*docs.columns))
    for r in toxicity.with_scores(rows, lexicon).collect():
        score, n = plain(r.text)
        assert r["__score"] == pytest.approx(score) and r["__matches"] == n


def test_words_of_any_length_are_terms():
    assert {("a", False), ("x" * 60, False), ("xxxx", True)} <= toxicity.terms("a " + "x" * 60)


def test_size_class_is_metadata(spark):
    rows = [(i, "same text", 10 if i % 2 else 5000) for i in range(60)] + [(90, "same text", None), (91, None, -5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    labels = docs.select("doc_id", (F.col("n_chars") < 100).cast("int").alias("quality"))
    size = {"size_class": quality.size_class()}
    machine = quality.train(docs.withColumns(size), labels, metadata=("size_class",))
    odd = docs.withColumnsRenamed({"doc_id": "doc_id"}).toDF("doc_id", "text", "n_chars").withColumn("__score", F.lit(3)).withColumn("SIZE_CLASS", F.lit("x"))
    kept = quality.accepted(odd, machine, size)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect() if r.doc_id < 60} == set(range(1, 60, 2))
    assert all(r["__score"] == 3 and r["SIZE_CLASS"] == "x" for r in kept.collect())


def test_held_out_is_never_null(spark):
    from sparkweave.llm.queries import _held_out
    rows = spark.createDataFrame([(None,), (1,), (2,)], "doc_id long").select("doc_id", _held_out(5, 0)).collect()
    assert {r.doc_id: r.held_out for r in rows} == {None: True, 1: brute.fold(1, 5) == 0, 2: brute.fold(2, 5) == 0}
