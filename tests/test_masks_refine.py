import pytest
from pyspark.sql import functions as F

from sparkweave.functions.masks import apply_mask, first2, last4, mask_names
from sparkweave.operators.refine import EtlSpec, eligible, refine, validate


def _one(spark, expr, value, ddl="v string"):
    return spark.createDataFrame([(value,)], ddl).select(expr(F.col("v")).alias("m")).first()["m"]


@pytest.mark.parametrize("value,expected", [
    ("Alice", "Al*****"), ("A", "A*****"), ("", "*****"), ("Élodie", "Él*****"), ("ça", "ça*****"), (None, None),
])
def test_first2(spark, value, expected):
    assert _one(spark, first2, value) == expected


def test_first2_non_strings_follow_spark_cast(spark):
    assert _one(spark, first2, True, "v boolean") == "tr*****"
    assert _one(spark, first2, 1234, "v int") == "12*****"


@pytest.mark.parametrize("value,expected", [
    ("4111111111111111", "************1111"), ("abcde", "*bcde"), ("abcd", "****"), ("abc", "***"),
    ("", ""), (None, None),
])
def test_last4(spark, value, expected):
    assert _one(spark, last4, value) == expected


def test_first2_never_leaks_tail(spark):
    vals = ["secret-value", "xy", "x", "ab*cd", "ünïcødé"]
    df = spark.createDataFrame([(v,) for v in vals], "v string").select("v", first2(F.col("v")).alias("m"))
    for r in df.collect():
        assert r["m"] == r["v"][:2] + "*****"


def test_registry(spark):
    assert {"first2", "last4", "redact", "hash", "null"} <= set(mask_names())
    with pytest.raises(ValueError):
        apply_mask("nope", F.col("x"))


def test_eligible_rules():
    cols = ["id", "name", "email", "ssn"]
    e = eligible(cols, key="id", remove=["ssn"])
    assert e["remove"] == ["name", "email", "ssn"]
    assert e["mask"] == ["name", "email"] and e["label"] == ["name", "email"]


@pytest.mark.parametrize("spec", [
    EtlSpec(key="missing"), EtlSpec(key="id", remove=("id",)), EtlSpec(remove=("nope",)),
    EtlSpec(remove=("name",), mask="name"), EtlSpec(key="id", label="id"),
])
def test_validate_rejects(spec):
    with pytest.raises(ValueError):
        validate(spec, ["id", "name", "email"])


def test_refine_order_label_sees_masked_value(spark):
    df = spark.createDataFrame([(1, "Alice", "a@x", "111")], "id int, name string, email string, ssn string")
    seen = []

    def labeler(c):
        seen.append(True)
        return F.concat(F.lit("label:"), c)

    out = refine(df, EtlSpec(key="id", remove=("ssn",), mask="name", label="name", labeler=labeler))
    assert out.columns == ["id", "name", "email", "category_type"]
    r = out.first()
    assert r["name"] == "Al*****" and r["category_type"] == "label:Al*****"


def test_refine_default_label(spark):
    df = spark.createDataFrame([(1, "x")], "id int, t string")
    assert refine(df, EtlSpec(label="t")).first()["category_type"] == "Not Implemented"


def test_refine_is_one_projection(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    out = refine(df, EtlSpec(key="c_custkey", remove=("c_acctbal",), mask="c_name", label="c_mktsegment"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert "c_acctbal" not in out._jdf.queryExecution().executedPlan().collectLeaves().head().toString()
