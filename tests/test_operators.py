import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stowage.functions import costs, headers
from stowage.operators import chunks, discovery, inventory, paths, state


def test_changed_since_fixture(spark):
    cols = "rel string, size long, ino long, mtime_ns long, ctime_ns long, level_applied int"
    before = spark.createDataFrame([("a", 100_000, 42, 1, 2, 9), ("b", 200_000, 42, 1, 2, 9), ("c", 300_000, 42, 1, 2, 9), ("low", 300_000, 42, 1, 2, 3), ("tried", 300_000, 42, 1, 2, 0), ("tiny", 10, 42, 1, 2, 0)], cols)
    now = spark.createDataFrame([("a", 100_000, 42, 9, 2, 0), ("b", 250_000, 42, 1, 2, 0), ("c", 300_000, 42, 1, 2, 0), ("d", 400, 42, 1, 2, 0), ("low", 300_000, 42, 1, 2, 0), ("tried", 300_000, 42, 1, 2, 0), ("tiny", 10, 42, 1, 2, 0), (None, 1, 1, 1, 1, 1)], cols)
    got = {r["rel"]: r["why"] for r in inventory.changed_since(now, before, ["rel"]).collect()}
    assert got == {"a": "changed", "b": "changed", "d": "new", "tried": "behind", None: "new"}
    assert "low" in {r["rel"] for r in inventory.changed_since(now, before, ["rel"], level_floor=9).collect()}
    assert inventory.changed_since(now, before.where("size < 0"), ["rel"]).count() == now.count()


def test_cost_model(spark):
    sizes = [0, 1, 4095, 4096, 4097, 8192, 131071, 131072, 4294967295]
    df = spark.createDataFrame([(u, c) for u in sizes for c in (0, u // 2, max(u - 4096, 0), u)], "u long, c long")
    up = lambda n: (n + 4095) // 4096 * 4096
    for r in df.select("u", "c", costs.disk_cost(F.col("c"), F.col("u")).alias("n"), costs.disk_cost(F.col("c"), F.col("u"), True).alias("s")).collect():
        assert r["n"] == (up(r["u"]) if r["c"] + 4096 > r["u"] else up(r["c"])) and r["s"] == (up(r["u"]) if r["c"] + 4096 >= r["u"] else up(r["c"]))
        assert r["n"] % 4096 == 0 and r["n"] <= up(r["u"]) and r["s"] >= r["n"]


def test_saturating_sum(spark):
    df = spark.createDataFrame([(2**62,), (2**62,), (2**62,), (None,)], "v long")
    assert df.agg(costs.saturating_sum(F.col("v"))).first()[0] == 2**63 - 1
    assert df.where("v < 0").agg(costs.saturating_sum(F.col("v"))).first()[0] == 0


def test_ancestors_and_prefix_joins(spark):
    df = spark.createDataFrame([(1, "/a/b/c"), (2, "/a/bc"), (3, "/"), (4, "rel/x"), (5, None)], "k int, p string")
    got = {r["k"]: r["x"] for r in df.select("k", paths.ancestors(F.col("p")).alias("x")).collect()}
    assert got[1] == ["/", "/a", "/a/b", "/a/b/c"] and got[3] == ["/"] and got[4] == ["rel", "rel/x"]
    folders = spark.createDataFrame([("/a/b",), ("/",), ("/a",)], "f string")
    assert sorted((r["k"], r["f"]) for r in paths.under(df, "p", folders, "f").collect()) == [(1, "/"), (1, "/a"), (1, "/a/b"), (2, "/"), (2, "/a"), (3, "/")]
    assert sorted((r["k"], r["f"]) for r in paths.longest_under(df, "k", "p", folders, "f").collect()) == [(1, "/a/b"), (2, "/a"), (3, "/")]
    assert [tuple(r) for r in paths.containing(spark.createDataFrame([("x", "/a"), ("y", "/a/b"), ("z", "/ab")], "k string, p string"), "k", "p").collect()] == [("x", "y")]
    safe = spark.createDataFrame([("a/b",), ("../a",), ("/a",), ("a//b",), ("a" * 5000,)], "p string").select(paths.safe_relative(F.col("p"))).collect()
    assert [r[0] for r in safe] == [True, False, False, False, False]


def test_overlay(spark):
    base = spark.createDataFrame([("d/a", 1), ("d/b", 2), ("e", 3)], "path string, v int")
    upper = spark.createDataFrame([("d/b", 20), ("f/g", 4), ("e", None)], "path string, v int")
    white = spark.createDataFrame([("f",), ("d/a",)], "path string")
    assert sorted(map(tuple, paths.overlay(base, upper, white, "path", ["v"]).collect())) == [("d/b", 20, "upper"), ("e", None, "upper")]


def test_upsert_replace_retention(spark):
    base = spark.createDataFrame([("a", 5, "old"), ("b", 1, None), (None, 1, "n")], "id string, t int, v string")
    new = spark.createDataFrame([("a", 1, "new"), ("a", 2, "newer"), ("c", 1, "c"), ("c", 1, "c")], "id string, t int, v string")
    got = {r["id"]: r["v"] for r in state.upsert(base, new, ["id"], ["t"]).collect()}
    assert got == {"a": "newer", "b": None, "c": "c", None: "n"}
    assert sorted((r["id"], r["v"]) for r in state.replace_groups(base.where("id is not null"), new, ["id"]).collect() if r["v"]) == [("a", "new"), ("a", "newer"), ("c", "c"), ("c", "c")]
    ids = spark.range(10).toDF("id")
    assert sorted(r[0] for r in state.beyond_newest(ids, 4, "id").collect()) == list(range(6))
    assert state.beyond_newest(ids, 40, "id").count() == 0
    assert state.next_id(ids, "id").first()[0] == 10 and state.next_id(ids.where("id < 0"), "id").first()[0] == 1


def test_running_totals_are_sequential(spark):
    rng = random.Random(1)
    data = [(rng.choice("ab"), rng.randrange(1, 10**6), i) for i in range(400)] + [("a", 7, 1000 + i) for i in range(50)]
    df = spark.createDataFrame(data, "g string, size long, i int")
    got = state.running_totals(df, ["g"], [F.col("size").desc(), F.col("i").asc()], -F.floor(F.log2(F.col("size").cast("double"))), F.col("size"), "before").collect()
    total = {"a": 0, "b": 0}
    for r in sorted(got, key=lambda r: (r["g"], -r["size"], r["i"])):
        assert r["before"] == total[r["g"]]
        total[r["g"]] += r["size"]
    assert len(got) == len(data)


def test_merge_by_folder(spark):
    df = spark.createDataFrame([("f", "x", 1, "idle"), ("f", "y", 2, "busy"), ("f", "x", 3, "idle"), ("f", None, 4, "idle"), (None, "q", 5, "idle"), ("g", "z", 1, "idle")], "folder string, id string, o int, state string")
    got = {r["folder"]: (r["id"], r["also"], r["state"], r["reports"]) for r in discovery.merge_by_folder(df, "folder", "id", "o", "state").collect()}
    assert got == {"f": ("x", ["y"], "busy", 4), "g": ("z", [], "idle", 1)}


def test_selectors(spark):
    games = spark.createDataFrame([("steam:1", "Alpha"), ("gog:x", "Alpha Beta"), ("gog:Alpha", "Gamma")], "id string, title string")
    asked = spark.createDataFrame([("ALPHA",), ("beta",), ("STEAM:1",), ("",), (None,), ("Alpha",)], "s string")
    got = sorted(map(tuple, discovery.select_tiered(games, "id", "title", asked, "s").collect()))
    assert got == sorted([("ALPHA", "steam:1", 2), ("beta", "gog:x", 3), ("STEAM:1", "steam:1", 1), ("Alpha", "gog:Alpha", 1)])


def test_selecting_never_broadcasts_the_installs(spark):
    words = F.concat_ws(" ", F.lit("The Painted Lantern of"), F.md5(F.col("id").cast("string")))
    games = spark.range(6_000).select(F.concat(F.lit("steam:"), "id").alias("id"), words.alias("title"))
    asked = spark.createDataFrame([("7",), ("the painted lantern",), ("none such",)], "s string")
    limit = spark.conf.get("spark.sql.maxBroadcastTableSize")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "16m")
    try:
        got = discovery.select_tiered(games, "id", "title", asked, "s").groupBy("selector", "tier").count().collect()
    finally:
        spark.conf.set("spark.sql.maxBroadcastTableSize", limit)
    assert sorted(map(tuple, got)) == [("7", 1, 1), ("the painted lantern", 3, 6_000)]


def test_selecting_by_short_and_repeated_letters(spark):
    rows = [("a:1", "Eee eee"), ("a:2", "xe"), ("a:3", ""), ("a:4", None), (None, "e"), ("a:5", "\U0001f409\U0001f409 eel"), ("a:6", "no"), ("a:6", "no"), ("a:7", "lolol")]
    asked = ["E", "ee", "ee e", "\U0001f409", "\U0001f409 E", "a:6", "NO", "lol", "olo", "lolol!", " "]

    def tier(s, k, t):
        if k is not None and (k.lower() == s.lower() or k.split(":")[-1] == s):
            return 1
        return None if t is None else 2 if t.lower() == s.lower() else 3 if s.lower() in t.lower() else None

    want = {(s, k, tier(s, k, t)) for s in asked for k, t in rows if tier(s, k, t)}
    want = {(s, k, n) for s, k, n in want if n == min(m for z, _, m in want if z == s)}
    got = discovery.select_tiered(spark.createDataFrame(rows, "id string, title string"), "id", "title", spark.createDataFrame([(s,) for s in asked], "s string"), "s").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def naive_cuts(data, least, most, bits):
    cuts, start, total = [], 0, 0
    table = [int(x) for x in chunks.GEAR]
    for i, b in enumerate(data):
        total = ((total << 1) + table[b]) & (2**64 - 1)
        size = i + 1 - start
        if size == most or (size >= least and total & ((1 << bits) - 1) == 0):
            cuts.append(i + 1)
            start, total = i + 1, 0
    return cuts if not data or (cuts and cuts[-1] == len(data)) else [*cuts, len(data)]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.integers(8, 40), st.integers(1, 8))
def test_cut_points_are_the_byte_loop(data, least, bits):
    assert chunks.cut_points(data, least, 4 * least, bits) == naive_cuts(data, least, 4 * least, bits)


def test_chunks_survive_a_shift(spark):
    body = random.Random(2).randbytes(60_000)
    df = spark.createDataFrame([(1, body), (2, b"x" * 777 + body), (3, b""), (4, None)], "k int, c binary")
    rows = chunks.content_chunks(df, "k", "c", 256, 4096, 8).collect()
    assert {r["k"] for r in rows} == {1, 2}
    for key, data in ((1, body), (2, b"x" * 777 + body)):
        own = sorted((r for r in rows if r["k"] == key), key=lambda r: r["ord"])
        assert [r["start_at"] for r in own] == [sum(x["size"] for x in own[:i]) for i in range(len(own))] and sum(r["size"] for r in own) == len(data)
        assert all(r["hash"] == hashlib.sha256(data[r["start_at"] : r["start_at"] + r["size"]]).hexdigest() for r in own)
    shared = {r["hash"] for r in rows if r["k"] == 1} & {r["hash"] for r in rows if r["k"] == 2}
    assert len(shared) > 0.8 * sum(r["k"] == 1 for r in rows)


def test_folds_are_sequential(spark):
    rng = random.Random(9)
    data = [(g, f"{i:04}", rng.randrange(1, 400)) for g in ("a", "b", None) for i in range(300)]
    df = spark.createDataFrame(data, "g string, path string, size long").repartition(7)
    got = chunks.folded(df, ["g"], ["path"], "size", chunks.next_fit(1000), "frame").collect()
    for g in ("a", "b", None):
        frame, filled = 0, 0
        for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["path"]):
            if filled and filled + r["size"] > 1000:
                frame, filled = frame + 1, 0
            filled += r["size"]
            assert r["frame"] == frame
    spent = chunks.folded(df, ["g"], ["path"], "size", chunks.spending(5000, 300, 100), "take").collect()
    assert all(sum(r["take"] for r in spent if r["g"] == g) <= 5000 for g in ("a", "b", None)) and len(spent) == len(data)
    assert chunks.folded(df.where("size < 0"), ["g"], ["path"], "size", chunks.next_fit(10), "frame").count() == 0


def test_encoding(spark):
    df = spark.createDataFrame([(b"\0" * 100,), (b"ab" * 500,), (random.Random(1).randbytes(200),), (b"",), (None,)], "c binary")
    got = [tuple(r) for r in chunks.encoded_sizes(df, "c", (3, 9)).select("encoded.codec", "encoded.stored").collect()]
    assert got[0] == ("zero", 0) and got[1][0] == "zstd" and got[1][1] < 1000 and got[2] == ("raw", 200) and got[3] == got[4] == ("raw", 0)


def test_digest_depends_on_content_alone(spark):
    data = [("s", f"p{i}", f"t{i}") for i in range(50)]
    digest = lambda rows, n: chunks.corpus_digest(spark.createDataFrame(rows, "g string, p string, t string").repartition(n), ["g"], "p", F.col("t")).first()["digest"]
    assert digest(data, 1) == digest(data[::-1], 7) != digest(data[:-1] + [("s", "p49", "other")], 2)


def test_headers(spark):
    data = [b"DDS rest", b"PK\3\4" + bytes([0, 0, 0, 0, 0, 0]) + b"\0" * 16 + bytes([5, 0, 2, 0]), b"MZ", b"\x89PNG\r\n\x1a\n", b"\0\0\0\x18ftypmp42", b"x", b"", None]
    got = spark.createDataFrame([(x,) for x in data], "h binary").select(headers.family(F.col("h")).alias("f"), headers.archive_member(F.col("h")).alias("m"), headers.little(F.col("h"), 0, 2).alias("l")).collect()
    assert [r["f"] for r in got] == ["texture", "archive", "program", "encoded", "movie", "unknown", "unknown", "unknown"]
    assert got[1]["m"] == 37 and got[0]["m"] is None and got[2]["l"] == 0x5A4D and got[5]["l"] is None


def test_observed_changes(spark):
    df = spark.createDataFrame([("a", 1, "1", True), ("a", 2, "1", True), ("a", 3, "2", False), ("a", 4, "2", True), ("b", 1, None, True)], "k string, t int, build string, s boolean")
    got = sorted((r["k"], r["t"], r["changed"], r["ready"]) for r in discovery.observed_changes(df, "k", ["t"], "build", F.col("s")).collect())
    assert got == [("a", 1, False, True), ("a", 2, False, False), ("a", 3, True, False), ("a", 4, False, True), ("b", 1, False, True)]


def test_tree_diff_and_links(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("z", None)], "p string, v int")
    b = spark.createDataFrame([("y", 3), ("z", None), ("w", 1)], "p string, v int")
    assert sorted(map(tuple, inventory.tree_diff(a, b, ["p"], ["v"]).collect())) == [("w", "extra"), ("x", "missing"), ("y", "different")]
    f = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "ino int, p string")
    assert [tuple(r) for r in inventory.hard_links(f, ["ino"], "p").collect()] == [(1, "b", "a", 2)]


def test_store_checks(spark):
    df = spark.createDataFrame([("e", i, 10) for i in range(9000)] + [("f", 0, 3)], "entry string, ord long, size long")
    placed = chunks.chunk_offsets(df, "entry", "ord", "size")
    assert {(r["entry"], r["ord"], r["offset"]) for r in placed.collect()} == {("e", i, 10 * i) for i in range(9000)} | {("f", 0, 0)}
    assert chunks.gaps(placed, "entry", "ord", "offset", "size").count() == 0
    ranges = spark.createDataFrame([("e", 25, 12), ("f", 3, 9)], "entry string, from_byte long, length long")
    got = sorted(tuple(r) for r in chunks.read_ranges(placed.withColumnRenamed("offset", "start_at"), ranges, "entry").collect())
    assert got == [("e", 25, 2, 5, 5), ("e", 25, 3, 0, 7)]
    with pytest.raises(ValueError):
        chunks.cut_points(b"x" * 100, 4, 16, 8)
