import pytest
from pyspark.sql import functions as F

from sparkweave.llm import pii
from tests.llm import brute

HARD = [
    None, "", " ", "a@b.c@d.e x_y@f.g.h. a@b.c_d@e.f a@b", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.3.0004 1.2.3",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 4111  1111", "+1 (499) 555-6503%%% +12 +49 30 1234567 8)",
    "é日本 a.b+c@x-y.org 😀 10.0.0.1 😀 +442071838750", "9" * 60000, "a" * 60000, "1.2." * 20000, "x@y" + ".z" * 30000,
    "IBAN GB82 WEST 1234 5698 7654 32 and GB82WEST12345698765432 or GB00WEST12345698765432", "ssn 219-09-9999, 219-09-9999 id",
    "+1 2 3 4 5 6 7 8 9 0 1 1 1 1 1 1 1", "1" * 15 + " " + "0" * 14, "0 0 0 0 0 0 0 0 0 0 0 0 0 0",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(3, HARD[3]), (None, HARD[4])]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("kind", F.lit("x"))


def check(rows, texts):
    for r in rows:
        spans = brute.base_spans(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == brute.sha(joined), (r, joined[:300])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in brute.PII]
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))


def test_base_spans(docs):
    texts = {None: HARD[4]} | dict(enumerate(HARD))
    rows = pii.pii_report(docs).collect()
    assert len(rows) == len(HARD) + 2
    check(rows, texts)


def test_added_spans(docs):
    spans = {r.doc_id: r.spans for r in pii.pii_report(docs).collect()}
    assert [s.split(":")[0] for s in spans[12].split(",")].count("iban") == 2
    assert spans[13] == "ssn:4:15"  # the second has no word of its context near


def test_given_documents(spark):

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(pii.pii_report(docs).collect(), {r.doc_id: r.text for r in docs.collect()})


def test_redact(spark, docs):
    assert pii.pii_report(docs.limit(0)).count() == 0
    rows = [(1, "mail a@b.c now", 14), (2, None, 3), (3, "clean", 5), (4, "+1 499 555 6503, 10.0.0.1", 0)]
    out = pii.redact(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).orderBy("doc_id").collect()
    assert [tuple(r) for r in out] == [(1, "mail [EMAIL] now", 16), (2, None, 3), (3, "clean", 5), (4, "[PHONE], [IP]", 13)]
    assert pii.redact(docs).columns == docs.columns and pii.redact(docs).count() == docs.count()
