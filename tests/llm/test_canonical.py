import re
from collections import defaultdict

from pyspark.sql import functions as F

from stowage.llm import canonical


def brute_path(p):
    import unicodedata

    parts = ["".join(c for c in x.lower() if unicodedata.category(c)[0] in "LN") for x in re.split(r"[/\\]", p)]
    return "/".join(x for x in parts if x)


PATHS = ["/home/A b/c", r"\HOME\ab//C\.", "/home/a/b/c", "", "///", None, "'/home/a-b/c'\n", "/home/ab/c​", "C:\\x", "/c/x", "/home/ab/c" * 2000, "/٣/½/é"]


def test_paths(spark):
    df = spark.createDataFrame([(i, p, "x") for i, p in enumerate(PATHS)], "id long, path string, copies string")
    got = {r["id"]: r["c"] for r in df.select("id", canonical.canonical_path(F.col("path")).alias("c")).collect()}
    assert got == {i: None if p is None else brute_path(p) for i, p in enumerate(PATHS)}
    groups = defaultdict(list)
    for i, p in enumerate(PATHS):
        if p is not None:
            groups[brute_path(p)].append(i)
    want = {(g[0], i) for g in groups.values() for i in g[1:]}
    assert {tuple(r) for r in canonical.copies(df, "id", canonical.canonical_path(F.col("path"))).collect()} == want
    rows = canonical.collapse(df, "id", canonical.canonical_path(F.col("path"))).collect()
    assert {(r["id"], r["copies_"]) for r in rows} == {(g[0], len(g)) for g in groups.values()} and all(r["copies"] == "x" for r in rows)
    assert canonical.copies(df.where("id > 99"), "id", canonical.canonical_path(F.col("path"))).collect() == []


def test_objects(spark):
    same = ['{"title": "A  b", "path": "C:\\\\x\\\\y", "size": 5}', '{ "SIZE":"5",\n"path":"c:/x/y/","Title":"a-B" }']
    other = ['{"title": "A b", "path": "C:\\\\x\\\\y"}', '{"title": "A b", "path": "C:\\\\xy", "size": 5}', '{"title": "A b", "path": "C:\\\\x\\\\y", "size": null}', "{}", "no json", "", None]
    df = spark.createDataFrame(list(enumerate(same + other)), "id long, raw string")
    assert [tuple(r) for r in canonical.copies(df, "id", canonical.canonical_object(F.col("raw"))).collect()] == [(0, 1)]


def test_a_group_of_a_third(spark):
    rows = [(i, "/games/one") if i % 3 == 0 else (i, f"/games/{i // 2}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, path string")
    got = {tuple(r) for r in canonical.copies(df, "id", canonical.canonical_path(F.col("path")), tasks=8).collect()}
    groups = defaultdict(list)
    for i, p in rows:
        groups[p].append(i)
    assert got == {(g[0], i) for g in groups.values() for i in g[1:]}


def test_colliding_digests_are_split(spark, monkeypatch):
    monkeypatch.setattr(canonical, "hashed", lambda c: (F.lit(b"same"), F.xxhash64(c)))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "A"), (4, "b"), (5, "c")], "id long, path string")
    assert {tuple(r) for r in canonical.copies(df, "id", canonical.canonical_path(F.col("path"))).collect()} == {(1, 3), (2, 4)}


def test_nested_objects_in_another_order(spark):
    rows = ['{"a": {"x": 1, "y": [ {"p": 1, "q": 2} ]}}', '{"A": {"y": [{"q":2,"p":1}], "x": 1}}', '{"a": {"x": 2, "y": [{"p": 1, "q": 2}]}}', '{"a": "{not json"}']
    df = spark.createDataFrame(list(enumerate(rows)), "id long, raw string")
    assert [tuple(r) for r in canonical.copies(df, "id", canonical.canonical_object(F.col("raw"))).collect()] == [(0, 1)]
