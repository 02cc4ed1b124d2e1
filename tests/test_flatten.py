import json

from sparkweave.sources.responses import read_search_results, read_user_profiles


def _land(local_tmp, name, docs, one_per_file=False):
    path = f"{local_tmp}/{name}"
    import os
    os.makedirs(path)
    if one_per_file:
        for i, d in enumerate(docs):
            with open(f"{path}/r{i}.json", "w") as f:
                json.dump(d, f, indent=2)
    else:
        with open(f"{path}/part.json", "w") as f:
            for d in docs:
                f.write(json.dumps(d) + "\n")
    return path


def test_search_edge_cases(spark, local_tmp):
    resp = {"collection": {"items": [
        {"href": "a", "data": [{"title": "T", "description": "D", "keywords": ["k1", "k2"]}],
         "links": [{"href": "p1", "rel": "preview"}, {"href": "c", "rel": "canonical"}, {"href": "p2", "rel": "preview"}]},
        {"href": "b", "data": [{"title": "T2", "description": "D2"}], "links": []},
        {"href": "c", "data": [], "links": [{"href": "p", "rel": "preview"}]},
        {"href": "d", "data": [{"title": "T4", "description": "D4"}]},
    ]}}
    path = _land(local_tmp, "search", [resp, {"other": 1}], one_per_file=True)
    rows = {r["href"]: r for r in read_search_results(spark, path, one_per_file=True).collect()}
    assert set(rows) == {"a", "b", "c", "d"}
    assert rows["a"]["keywords"] == "k1, k2" and rows["a"]["preview"] == ["p1", "p2"]
    assert rows["b"]["keywords"] == "" and rows["b"]["preview"] == []
    assert rows["c"]["title"] is None and rows["c"]["preview"] == ["p"]   # empty data: this row only
    assert rows["d"]["preview"] == [] and rows["d"]["title"] == "T4"      # missing links
    assert "data" not in read_search_results(spark, path, one_per_file=True).columns


def test_users_flatten(spark, local_tmp):
    u = {"gender": "f", "name": {"title": "Ms", "first": "Ann", "last": "Lee"},
         "location": {"street": {"number": 12, "name": "Main St"}, "city": "X", "state": "S",
                      "country": "C", "postcode": 12345},
         "email": "a@x", "login": {"uuid": "u1", "username": "ann", "password": "pw"},
         "dob": {"date": "1990-01-01T00:00:00Z"}, "registered": {"date": "2020-01-01T00:00:00Z"},
         "phone": "1", "cell": "2", "picture": {"large": "L", "medium": "M", "thumbnail": "T"}, "nat": "GB"}
    u2 = dict(u, location={"street": {"number": None, "name": "Side"}, "postcode": "AB1"})
    path = _land(local_tmp, "users", [{"results": [u, u2]}, {"info": "no results"}])
    out = read_user_profiles(spark, path)
    assert len(out.columns) == 21 and out.columns[:4] == ["title", "first", "last", "street"]
    rows = out.collect()
    assert len(rows) == 2
    first = [r for r in rows if r["street"] is not None][0]
    assert first["street"] == "12 Main St" and first["postcode"] == "12345" and first["dob"].startswith("1990")
    second = [r for r in rows if r["street"] is None][0]
    assert second["postcode"] == "AB1"
