import pytest
from pyspark.sql import functions as F

from sparkweave.functions import nested


def one(spark, mask, value):
    return spark.createDataFrame([(value,)], "v string").select(nested.FORM_MASKS[mask](F.col("v"))).first()[0]


@pytest.mark.parametrize(("value", "form", "last4"), [
    ("4111 1111-1111 1234", "9999 9999-9999 9999", "9999 9999-9999 1234"), ("+44 (0)20 7946-0958", "+99 (9)99 9999-9999", "+99 (9)99 9999-0958"),
    ("078-05-1120", "999-99-9999", "999-99-1120"), ("GB82 WEST 1234 5698 7654 32", "XX99 XXXX 9999 9999 9999 99", "XX99 XXXX 9999 9999 9954 32"),
    ("Éxe X-y", "Xxx X-x", "Xxe X-y"), ("ab1", "xx9", "xx9"), ("a-b-c-d", "x-x-x-x", "x-x-x-x"), ("", "", ""), (None, None, None), ("...", "...", "...")])
def test_form_is_kept(spark, value, form, last4):
    assert one(spark, "form", value) == form and one(spark, "form_last4", value) == last4


SCHEMA = ("id int, person struct<name: string, cards: array<struct<no: string, kind: string>>>, tags array<string>, by map<string, struct<x: string, y: int>>,"
          " `a.b` struct<`c d`: string>, plain string")


def rows(spark):
    return spark.createDataFrame([
        (1, ("Ann", [("1234-5678", "v"), None, (None, "w")]), ["ab", None], {"k": ("secret", 1), "n": None}, ("q1",), "p"),
        (2, (None, []), [], {}, None, None), (3, None, None, None, (None,), "p")], SCHEMA)


def test_paths_through_structs_arrays_and_maps(spark):
    df = rows(spark)
    out = nested.mask_paths(df, {"person.cards[].no": "form", "person.name": "first2", "tags[]": "redact", "by{}.x": "form", "`a.b`.`c d`": "form"})
    assert out.schema.simpleString() == df.schema.simpleString()
    got = {r.id: r.asDict(recursive=True) for r in out.collect()}
    assert got[1]["person"] == {"name": "An*****", "cards": [{"no": "9999-9999", "kind": "v"}, None, {"no": None, "kind": "w"}]}
    assert got[1]["tags"] == ["**", None] and got[1]["by"] == {"k": {"x": "xxxxxx", "y": 1}, "n": None} and got[1]["a.b"] == {"c d": "x9"}
    assert got[2]["person"] == {"name": None, "cards": []} and got[2]["a.b"] is None and got[2]["by"] == {} and got[2]["tags"] == []
    assert got[3]["person"] is None and got[3]["by"] is None and got[3]["a.b"] == {"c d": None} and got[3]["plain"] == "p"


def test_no_explode_and_one_projection(spark):
    plan = nested.mask_paths(rows(spark), {"person.cards[].no": "form"})._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Project") <= 1 and "Exchange" not in plan


@pytest.mark.parametrize("rules", [{"nope": "form"}, {"person.nope": "form"}, {"person": "form"}, {"person.cards.no": "form"}, {"tags": "form"}, {"tags[].x": "form"},
                                   {"person.name": "nomask"}, {"person.cards[]": "form"}, {"by[]": "form"}, {"person.cards[].no": "form", "person.cards[].no.x": "form"}])
def test_rules_that_fit_nothing_are_errors(spark, rules):
    with pytest.raises(ValueError):
        nested.mask_paths(rows_of := rows(spark), rules).collect()
    assert rows_of is not None


def test_who_sees_what(spark):
    df = rows(spark)
    assert nested.masked_documents(df, {"person.name": "form"}, "owner").collect() == df.collect()
    assert nested.masked_documents(df, {"person.name": "form"}, "public").first().person.name == "Xxx"
    assert nested.mask_paths(df.limit(0), {"person.name": "form"}).count() == 0
