import random

from sparkweave.operators.documents import search_terms
from sparkweave.operators.search_index import SearchIndex, grams, text_lists

TEXTS = ["The earthquake hit", "oil and OIL", "aaaa", "", None, "no match here", "Él oil\nfield", "x😀ab y", "percent % and _ sign", "İstanbul oil"]
TERMS = ["oil", "OIL", "earth", "aa", "a", "aaa", "absent", "él o", "😀ab", "% and _", "", "l\nf", "earthquake hit and more"]


def found(df):
    return sorted((r.id, r.term) for r in df.collect())


def test_same_rows_as_a_full_scan(spark, tmp):
    rows = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(TEXTS)], "id int, text string, term2 int")
    index = SearchIndex(spark, tmp, "id", buckets=7)
    assert index.search(rows, ["oil"]).count() == 0  # nothing is indexed yet
    index.add(rows.where("id < 4"))
    assert found(index.search(rows.where("id < 4"), TERMS)) == found(search_terms(rows.where("id < 4"), sorted({t.lower() for t in TERMS}), keep=["id", "term2"]))
    assert index.add(rows.where("id >= 4")) == 1  # more rows later: what is written stays
    again = SearchIndex(spark, tmp, "id", buckets=99)
    assert again.buckets == 7
    assert found(again.search(rows, TERMS)) == found(search_terms(rows, sorted({t.lower() for t in TERMS}), keep=["id", "term2"]))


def test_reads_few_files(spark, tmp):
    words = ["".join(chr(97 + (i * k) % 26) for k in range(3, 12)) for i in range(1, 200)]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "id int, text string")
    index = SearchIndex(spark, tmp, "id", buckets=64)
    index.add(rows)
    read, everything = index.files_read(words[5][2:8])
    assert 0 < read <= 4 * max(1, everything // 32) and everything >= 32
    assert index.files_read("zzzzqqq")[0] == 0 and index.files_read("ab")[0] == 0


def test_nulls_repeats_and_no_rows(spark, tmp):
    rows = spark.createDataFrame([(1, "some oil"), (1, "some oil"), (None, "oil too"), (2, None)], "id int, text string")
    index = SearchIndex(spark, tmp, "id")
    index.add(rows.limit(0))
    assert index.search(rows, ["oil"]).count() == 0  # nothing indexed yet
    index.add(rows)
    assert found(index.search(rows.where("id is not null"), ["oil"])) == [(1, "oil"), (1, "oil")]


def test_postings_are_lists_by_gram(spark, tmp):
    """What is dealt out and written has a row for each gram of some thousand texts, not for each gram of a text."""
    rows = spark.createDataFrame([(i, f"the same oil and text {i % 10}") for i in range(400)], "id int, text string").coalesce(1)
    index = SearchIndex(spark, tmp, "id", buckets=4)
    index.add(rows)
    written = spark.read.parquet(f"{tmp}/segment=0/postings").select("gram", "n", "ids").collect()
    pairs = {(i, f"the same oil and text {i % 10}"[k:k + 3]) for i in range(400) for k in range(21)}
    assert len(written) == len({g for _, g in pairs}) and sum(r.n for r in written) == len(pairs)
    assert {(i, r.gram) for r in written for i in r.ids} == pairs
    assert {(r.gram, r.n) for r in spark.read.parquet(f"{tmp}/segment=0/grams").collect()} == {(r.gram, r.n) for r in written}


def test_lists_of_any_characters():
    rng = random.Random(1)
    for most in (3, 200, 0x10FFFF):
        texts = ["".join(chr(c) for c in (rng.randrange(1, most) for _ in range(rng.choice([0, 1, 2, 3, 40]))) if not 0xD800 <= c < 0xE000) for _ in range(60)]
        got = []
        for names, n, place in text_lists(texts):
            ends = n.cumsum()
            got += [(g, int(i)) for g, a, b in zip(names, ends - n, ends) for i in place[a:b]]
        assert sorted(got) == sorted((g, i) for i, t in enumerate(texts) for g in grams(t))
    assert list(text_lists(["", "ab"])) == [] and list(text_lists([])) == []
