"""Registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm import (bpe, centroid_clustering, embedding_dedup, fingerprints, hpylm, minhash_dedup, packing, pii, quality,
                            spelling_variants, substring_dedup, token_counts, toxicity)
from sparkweave.llm.common import fold, table


def _held_out(k: int, remainder: int) -> Column:
    """Whether nothing is learned from a row; a null id has no labels."""
    return F.coalesce(fold("doc_id", k) == remainder, F.lit(True)).alias("held_out")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=4, threshold=80)


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    lexicon = toxicity.learn(docs, labels, rows=fold("doc_id", 5) != 0)
    return toxicity.with_scores(docs.select("doc_id", "text"), lexicon).select(
        "doc_id", _held_out(5, 0), F.col("__score").alias("score"),
        F.col("__predicted").alias("predicted"), F.col("__matches").alias("n_matches"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", limit=512)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text", quality.size_class().alias("size_class"))
    machine = quality.train(docs, labels, rows=fold("doc_id", 3) != 1, metadata=("size_class",))
    return quality.with_scores(docs, machine, ("size_class",)).select(
        "doc_id", _held_out(3, 1), F.col("__score").alias("score"), F.col("__predicted").alias("predicted"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.scores(table(spark, sf_dir, "documents"), fold("doc_id", 5) != 1)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_report(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), "word_bpe_49k.json", capacity=4096)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(table(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering.cluster(table(spark, sf_dir, "embeddings"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal_report(table(spark, sf_dir, "documents"), window=35)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_minhash_dedup, op2_bpe_round_trip, op3_toxicity, op4_token_counts, op5_quality, op6_embedding_dedup,
    op7_language_model, op8_pii, op9_fingerprints, op10_packing, op11_spelling_variants, op12_centroid_clustering,
    op13_substring_dedup)}

#: Smallest node reachable from each node over {links} (a, b), both ways.
_REACH = """
    edges as (select a, b from links union select b, a from links),
    reach as (select a, b from edges union select r.a, e.b from reach r join edges e on r.b = e.a),
    roots as (select a as id, least(a, min(b)) as root from reach group by a)"""

_OP1 = f"""
    with recursive cut as (
      select doc_id, list_filter(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w
      from documents),
    sets as (
      select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
        else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end as s
      from cut),
    each as (select doc_id, unnest(s) as x from sets),
    pairs as (select p.doc_id as a, q.doc_id as b, count(*) as n from each p join each q on p.x = q.x and p.doc_id < q.doc_id group by all),
    links as (
      select a, b from pairs join sets p on p.doc_id = a join sets q on q.doc_id = b
      where 100 * n >= 80 * (len(p.s) + len(q.s) - n)), {_REACH}
    select doc_id, len(s) as n_shingles, coalesce(root, doc_id) as component_id, coalesce(root, doc_id) = doc_id as kept
    from sets left join roots on id = doc_id"""

_OP6 = f"""
    with recursive v as (select vec_id, label, embedding::double[] as e from embeddings
      where label is not null and embedding is not null and list_dot_product(embedding, embedding) > 0),
    links as (select p.vec_id as a, q.vec_id as b from v p join v q on p.label = q.label and p.vec_id < q.vec_id
      where list_cosine_similarity(p.e, q.e) >= 0.98), {_REACH},
    degree as (select a as id, count(*) as n from edges group by a)
    select vec_id, coalesce(n, 0) as n_links, coalesce(root, vec_id) as component_id, coalesce(root, vec_id) = vec_id as kept
    from embeddings left join roots on roots.id = vec_id left join degree on degree.id = vec_id"""

#: crc32 by its polynomial, a table entry a byte; letters from U+00C0 on take two bytes of UTF-8.
_CRC_STEP = "case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end"
_OP11 = f"""
    with recursive crc_table as (
      select list(c order by i) as t from (
        select i, list_reduce(range(8), lambda c, b: {_CRC_STEP}, i::ubigint) as c from (select unnest(range(256))::ubigint as i))),
    runs as (
      select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[a-z\u00C0-\u00FF]+')) as run from documents),
    tallied as (select doc_id, run, count(*) as n from runs group by all),
    bytes as (
      select run, n, flatten(list_transform(string_split(concat(doc_id, ':', run), ''),
        lambda x: case when unicode(x) < 128 then [unicode(x)::ubigint] else [195::ubigint, (unicode(x) - 64)::ubigint] end)) as bytes
      from tallied),
    hashed as (
      select run, n, xor(list_reduce(bytes, lambda c, b: xor(t[(xor(c, b) & 255)::bigint + 1], c >> 8), 4294967295::ubigint), 4294967295::ubigint) as h
      from bytes, crc_table),
    cut as (
      select case when h % 199 = 0 then run[1:(h % length(run))::int] || run[(h % length(run))::int + 2:] else run end as word, n from hashed),
    words as (select word, sum(n)::bigint as n from cut where length(word) >= 6 group by word having sum(n) >= 5),
    without as (select word, n, i, word[1:i - 1] || word[i + 1:] as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
    near as (
      select p.word, p.n, q.word as other, q.n as other_n from without p join without q on p.rest = q.rest and p.i = q.i and p.word <> q.word
        and length(p.word) = length(q.word)
      union select p.word, p.n, q.word, q.n from words p join without q on p.word = q.rest
      union select q.word, q.n, p.word, p.n from words p join without q on p.word = q.rest),
    best as (
      select word, count(*) as n_near, max(other_n) as best_n, arg_min(other, (-other_n, other)) as best from near group by word),
    formed as (
      select word, case when best_n >= 5 * n then best end as form, n, coalesce(n_near, 0) as n_near, case when best_n >= 5 * n then best_n end as form_n
      from words left join best using (word)),
    paths as (
      select word, word as root, form as next from formed
      union all select p.word, p.next, f.form from paths p join formed f on f.word = p.next)
    select word, form, root, n, n_near, form_n from formed join (select word, root from paths where next is null) using (word)"""

_NEAREST = """
    a{i} as (
      select vec_id, row, v, arg_min(c, (d, c)) as c, min(d) as d
      from (select vec_id, row, v, c, list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from kept, c{i})
      group by all)"""
_MOVED = """
    c{j} as (
      select c, coalesce(n.m, o.m) as m from c{i} o left join (
        select c, list(x order by k) as m from (
          select c, k, floor(sum(x)::hugeint // count(*))::bigint - case when sum(x) < 0 and sum(x) % count(*) <> 0 then 1 else 0 end as x
          from (select c, unnest(v) as x, unnest(range(1, 65)) as k from a{i}) group by c, k) group by c) n using (c))"""
_ROUNDS = ",".join(_NEAREST.format(i=i) + "," + _MOVED.format(i=i, j=i + 1) for i in range(3)) + "," + _NEAREST.format(i=3)
_OP12 = f"""
    with whole as (
      select vec_id, row_number() over () as row, list_transform(embedding, lambda x: x::double) as e from embeddings where len(embedding) = 64),
    kept as (
      select vec_id, row, list_transform(e, lambda x: floor(64 * x)::bigint) as v from whole
      where len(list_filter(e, lambda x: x is null or not isfinite(x) or abs(64 * x) > 134217728)) = 0),
    c0 as (
      select row_number() over (order by sha256(concat('1:', vec_id)), v) - 1 as c, v as m from kept
      order by sha256(concat('1:', vec_id)), v limit 16), {_ROUNDS},
    inertias as (select c, sum(d)::bigint as i from a3 group by c)
    select vec_id, c::int as "cluster", d as distance, i as cluster_inertia, (select sum(d)::bigint from a3) as inertia,
      sha256(array_to_string(m, ',')) as centroid_sha256
    from a3 join c3 using (c) join inertias using (c)"""

_OP13 = """
    with cut as (
      select doc_id, row_number() over () as row, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w
      from documents),
    windows as (
      select row, s, array_to_string(w[s:s + 34], ' ') as x from (select row, w, unnest(range(1, len(w) - 33)) as s from cut where len(w) >= 35)),
    repeated as (select row, s from windows where x in (select x from windows group by x having count(*) > 1)),
    gone as (select distinct row, s + j as i from repeated, (select unnest(range(0, 35)) as j)),
    lost as (select row, count(*) as n, list(i) as places from gone group by row)
    select doc_id, len(w) as n_words, coalesce(n, 0) as n_removed,
      sha256(coalesce(array_to_string(case when n is null then w
        else list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: not list_contains(places, z[2])), lambda z: z[1]) end, ' '), '')) as kept_sha256
    from cut left join lost using (row)"""

#: The others rest on a tokenizer, a learned or sampled model, look-behind
#: patterns or rolling hashes, and are tested by brute force in tests/llm.
ORACLE: dict[str, str] = {name: " ".join(sql.split("\n")) for name, sql in {
    "op1_minhash_dedup": _OP1, "op6_embedding_dedup": _OP6, "op11_spelling_variants": _OP11,
    "op12_centroid_clustering": _OP12, "op13_substring_dedup": _OP13}.items()}
