import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkweave.llm import fingerprints as fp
from tests.llm import brute


def plain_ends(data):
    """Boundaries by the definition, byte by byte."""
    ends, start = [], 0
    while start < len(data):
        end = min(start + fp.LARGEST, len(data))
        for p in range(start + fp.LEAST - 1, min(start + fp.LARGEST - 1, len(data) - 1)):
            h = sum(int(fp._GEAR[data[p - k]]) << k for k in range(min(32, p + 1))) % 2**32
            bits = fp.LAX_BITS if p >= start + fp.WANTED - 1 else fp.STRICT_BITS
            if h >> (32 - bits) == 0:
                end = p + 1
                break
        ends.append(end)
        start = end
    return ends


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=900))
def test_chunks(data):
    assert fp.chunk_ends(data) == plain_ends(data)


def check(docs, rows):
    order = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for (doc, text), (_, follows) in zip(order, order[1:] + order[:1]):
        changed = fp.edited(text, follows)
        a, b, c = fp.fingerprint(text), fp.fingerprint(changed), fp.fingerprint(follows)
        want.append((doc or -1, len(text), brute.sha(changed), fp.written(a), fp.written(b), fp.containment(a, b), fp.containment(a, c)))
    assert sorted((r.doc_id or -1, *r[1:]) for r in rows) == sorted(want)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("range", F.lit(1)).withColumn("copy", F.lit(1))
    rows = fp.edit_report(docs).collect()
    check(docs, rows)
    long = [r for r in rows if r.n_chars > 300]
    assert sum(r.near_edited > r.near_next for r in long) > 0.95 * len(long)


@pytest.mark.parametrize("n", [0, 1, 2, 40])
def test_edges(spark, n):
    rng = random.Random(n)
    special = [(None, "null id"), (7, None), (7, "seven"), (7, "seven"), (3, ""), (2, "é日😀" * 20_000), (None, "again")]
    rows = [(rng.randrange(10**6), "".join(rng.choices("ab c", k=rng.randrange(400)))) for _ in range(n)] + special * (n == 40)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(docs, fp.edit_report(docs).collect())


def test_shifted_text_keeps_its_chunks():
    rng = random.Random(3)
    text = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(800))
    assert fp.containment(fp.fingerprint(text), fp.fingerprint("some words before " + text)) > 0.9
    assert fp.containment(fp.fingerprint(text[2000:3000]), fp.fingerprint(text)) > 0.7
