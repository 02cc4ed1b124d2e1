import pytest

from sparkweave.operators.governance import (empty_policy, get_masks, list_masks, masked_view, set_mask,
                                             tenant_scope)


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame([("1", "Ann Lee", "4111111111111111", "DE89370400440532013000")],
                                 "_id string, name string, creditcard string, iban string")


def test_masked_view(spark, docs):
    p = set_mask(empty_policy(spark), "users", "name", "first2", columns=docs.columns)
    p = set_mask(p, "users", "creditcard", "redact")
    p = set_mask(p, "users", "creditcard", "last4")           # replaces the older rule
    assert get_masks(p, "users").count() == 2
    pub = masked_view(docs, p, "users", "public").first()
    assert pub["name"] == "An*****" and pub["creditcard"] == "************1111" and pub["iban"].startswith("DE89")
    own = masked_view(docs, p, "users", "owner").first()
    assert own["name"] == "Ann Lee"
    assert list_masks(spark).count() >= 5


def test_policy_errors(spark, docs):
    with pytest.raises(ValueError):
        set_mask(empty_policy(spark), "users", "name", "nope")
    with pytest.raises(ValueError):
        set_mask(empty_policy(spark), "users", "ssn", "first2", columns=docs.columns)


def test_tenant_scope(spark):
    data = spark.createDataFrame([(1, "t1"), (2, "t1"), (3, "t2")], "id int, tenant string")
    grants = spark.createDataFrame([("user11", "t1", True, True), ("user12", "t1", True, False),
                                    ("user21", "t2", True, True)],
                                   "principal string, tenant string, can_read boolean, can_write boolean")
    assert sorted(r["id"] for r in tenant_scope(data, grants, "user12", "tenant").collect()) == [1, 2]
    assert tenant_scope(data, grants, "nobody", "tenant").count() == 0
    assert tenant_scope(data, grants, "user12", "tenant", access="can_write").count() == 0
