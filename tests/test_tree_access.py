import datetime as dt

import pytest

from sparkweave.operators import access
from sparkweave.operators.tree import folder_tree


def test_tree_equals_definition(spark):
    paths = ["a/b/c.txt", "a/b/d.txt", "/a//e.txt", "top.txt", "a/b/", "x/y/z/w/v.txt", "a.txt", None, "", "a/b/c.txt"]
    rows = [(p, None if p == "top.txt" else i + 1, dt.datetime(2024, 1, i + 1), i) for i, p in enumerate(paths)]
    got = {r.folder: tuple(r)[1:] for r in folder_tree(spark.createDataFrame(rows, "path string, length long, modified timestamp_ntz, depth int").repartition(3)).collect()}
    want = {}
    for p, n, at, _ in rows:
        if p is None:
            continue
        parts = [x for x in p.replace("//", "/").lstrip("/").split("/")]
        for k in range(len(parts)):
            w = want.setdefault("/".join(parts[:k]), [k, 0, 0, None, 0])
            w[1] += 1
            w[2] += n or 0
            w[3] = max(at, w[3]) if w[3] else at
            w[4] += k == len(parts) - 1
    assert got == {k: tuple(v) for k, v in want.items()}


def test_empty_tree(spark):
    out = folder_tree(spark.createDataFrame([], "path string, length long, modified timestamp_ntz"))
    assert out.columns == ["folder", "depth", "objects", "total_bytes", "newest", "direct_objects"] and out.count() == 0


@pytest.mark.parametrize(("rule", "order"), [
    ("u:a", ["u:a"]), ("u:a | g:b & !g:c", ["u:a", "g:b", "g:c", "!", "&", "|"]), ("(u:a|g:b)&p", ["u:a", "g:b", "|", "p", "&"]),
    ("!!u:a", ["u:a", "!", "!"]), ("!(u:a & u:b)", ["u:a", "u:b", "&", "!"]), (" u:a.b-c@d  ", ["u:a.b-c@d"]),
    ("", None), (None, None), ("u:a &", None), ("u:a u:b", None), ("(u:a", None), ("u:a)", None), ("& u:a", None), ("x:a", None), ("()", None), ("u:a ! u:b", None),
    ("u:a, u:b", None), ("pp", None)])
def test_postfix(rule, order):
    assert access.postfix(rule) == order


def holds(rule, subjects):
    text = rule.replace("&", " and ").replace("|", " or ").replace("!", " not ")
    for t in sorted(set(access._TOKEN.findall(rule)), key=len, reverse=True):
        if t[0] in "ug" and ":" in t:
            text = text.replace(t, str(t in subjects))
    return eval(text.replace("p", "True") if "p" in rule and ":" not in rule else text)


def test_rules_decide_as_logic_does(spark):
    members = [("u:ann", "g:x"), ("g:x", "g:y"), ("g:y", "g:z"), ("g:z", "g:x"), ("u:bob", "g:y"), ("u:cy", "g:w"), (None, "g:x"), ("u:dan", None), ("u:ann", "g:x")]
    closed = {"u:ann": {"u:ann", "g:x", "g:y", "g:z"}, "u:bob": {"u:bob", "g:x", "g:y", "g:z"}, "u:cy": {"u:cy", "g:w"}}
    rules = ["u:ann", "g:z", "g:w", "!g:w", "g:x & !u:ann", "u:cy | g:y & !u:bob", "!(u:ann | u:bob) & g:w", "(g:w | g:x) & (u:ann | !g:y)", "!!g:x", "g:nobody"]
    membership = spark.createDataFrame(members, "member string, grp string")
    asked = ["u:ann", "u:bob", "u:cy", "u:dan", "u:unknown"]
    subjects = {}
    for r in access.closed_membership(membership, asked).collect():
        subjects.setdefault(r.principal, set()).add(r.subject)
    assert subjects == closed
    table = spark.createDataFrame([(f"r{i}", "read", r) for i, r in enumerate(rules)] + [("all", "read", "p"), ("none", "read", ""), ("none", "read", "u:ann &"),
                                   ("r0", "read", "g:w"), (None, "read", "p"), ("r1", None, "p")], "resource string, access string, rule string")
    got = {(r.principal, r.resource) for r in access.allowed_resources(table, membership, asked).where("access = 'read'").collect()}
    want = {(p, f"r{i}") for p, s in closed.items() for i, r in enumerate(rules) if holds(r, s)}
    want |= {(p, "all") for p in closed} | {(p, None) for p in closed} | {("u:cy", "r0")}
    assert got == want
    assert {r.rule for r in access.broken_rules(table).collect()} == {"", "u:ann &"}


def test_scope_of_rows(spark):
    membership = spark.createDataFrame([("u:a", "g:t1"), ("u:b", "g:t2")], "member string, grp string")
    rules = spark.createDataFrame([("t1", "read", "g:t1"), ("t1", "write", "u:z"), ("t2", "read", "g:t2 | u:a")], "resource string, access string, rule string")
    df = spark.createDataFrame([(1, "t1", "p"), (2, "t2", "p"), (3, None, "p"), (1, "t1", "p")], "id int, tenant string, principal string")
    ids = lambda who, kind="read": sorted(r.id for r in access.acl_scope(df, rules, membership, who, "tenant", kind).collect())
    assert ids("u:a") == [1, 1, 2] and ids("u:b") == [2] and ids("u:nobody") == [] and ids("u:a", "write") == []
    assert access.acl_scope(df, access.empty_rules(spark), membership, "u:a", "tenant").count() == 0
    assert access.allowed_resources(rules, membership.limit(0), ["u:a"]).count() == 0
    assert access.allowed_resources(rules, membership, []).count() == 0
