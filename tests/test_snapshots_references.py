import datetime as dt
import random
from collections import defaultdict

from stowage.operators.references import orphan_references
from stowage.operators.snapshots import snapshot_changes

T = "snap int, game string, path binary, size long, ino long, arrived timestamp, extra string"


def at(s):
    return dt.datetime(2025, 1, 1) + dt.timedelta(seconds=s)


def brute(rows):
    held = defaultdict(dict)
    for snap, game, path, size, ino, arrived, _ in rows:
        if snap is None:
            continue
        old = held[snap].get((game, bytes(path)))
        if old is None or (arrived is not None and (old[1] is None or arrived > old[1])):
            held[snap][game, bytes(path)] = ((size, ino), arrived)
    out, order = set(), sorted(held)
    for a, b in zip(order, order[1:]):
        for k in held[a].keys() | held[b].keys():
            x, y = held[a].get(k), held[b].get(k)
            if x is None or y is None or x[0] != y[0]:
                out.add((b, *k, "added" if x is None else "removed" if y is None else "changed"))
    return out


def changes(df, n=12):
    return [(r[0], r[1], bytes(r[2]), r[3]) for r in snapshot_changes(df, "snap", ["game", "path"], ["size", "ino"], "arrived", n).collect()]


def test_changes_of_random_snapshots(spark):
    rng = random.Random(5)
    rows = []
    for snap in (1, 2, 4, 7, 8):
        for i in range(60):
            if rng.random() < 0.8:
                rows.append((snap, f"g{i % 3}", bytes([i, 255]), rng.choice([None, 5, 6]), rng.choice([5, 6]), at(len(rows)), "x"))
                if rng.random() < 0.3:
                    rows.append((snap, f"g{i % 3}", bytes([i, 255]), rng.choice([None, 5]), 6, at(len(rows)), "y"))
                if rng.random() < 0.2:
                    rows.append(rows[-1])
    df = spark.createDataFrame(rows, T).repartition(3)
    for at_once in (12, 3, 2):
        got = changes(df, at_once)
        assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_null_values_are_told_apart(spark):
    rows = [(1, "a", b"p", None, 5, at(0), ""), (2, "a", b"p", 5, None, at(1), ""), (3, "a", b"p", 5, None, at(1), ""), (None, "a", b"q", 1, 1, at(1), "")]
    assert changes(spark.createDataFrame(rows, T)) == [(2, "a", b"p", "changed")]


def test_missing_arrival_empty_and_single_snapshots(spark):
    rows = [(1, None, b"p", 1, 1, None, ""), (1, None, b"p", 2, 1, at(5), ""), (2, None, b"p", 2, 1, at(6), "")]
    df = spark.createDataFrame(rows, T)
    assert changes(df) == []
    assert changes(df.where("snap = 1")) == [] and changes(df.where("snap > 5")) == []


def test_references_against_times(spark):
    rng = random.Random(3)
    games = [(f"g{rng.randrange(12)}", a, None if rng.random() < 0.4 else a + rng.randrange(1, 9) * 40_000_000_000) for a in (rng.randrange(50) * 40_000_000_000 for _ in range(40))] + [("g1", None, None)]
    refs = [(rng.choice([f"g{i}" for i in range(14)] + [None]), rng.randrange(60) * 40_000_000_000) for _ in range(300)] + [("g2", None), ("none", None)]
    want = set()
    for g, t in refs:
        own = [x for x in games if x[0] == g]
        if g is None:
            continue
        if not own:
            want.add((g, t, "missing"))
        elif t is not None:
            came = [x for x in own if x[1] is not None and x[1] <= t]
            if not came:
                want.add((g, t, "late"))
            elif all(x[2] is not None and x[2] <= t for x in came):
                want.add((g, t, "deleted"))
    r, k = spark.createDataFrame(refs, "game string, t long"), spark.createDataFrame(games, "id string, a long, b long")
    got = [tuple(x) for x in orphan_references(r, [("game", "id")], k, at="t", since="a", until="b").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert orphan_references(r.where("t < 0"), [("game", "id")], k, at="t", since="a", until="b").collect() == []
    assert {x["reason"] for x in orphan_references(r, [("game", "id")], k.where("a < 0"), at="t", since="a", until="b").collect()} == {"missing"}


def test_partly_null_keys(spark):
    refs = spark.createDataFrame([(1, 1), (1, None), (3, None), (None, 9), (None, None), (2, 1), (2, 1)], "a int, b int")
    keys = spark.createDataFrame([(1, 1), (2, 2), (None, 9)], "a int, b int")
    on = [("a", "a"), ("b", "b")]
    found = lambda match: sorted((tuple(r[:2]) + (r["reason"],) for r in orphan_references(refs, on, keys, match).collect()), key=repr)
    assert found("simple") == [(2, 1, "missing")]
    assert found("partial") == sorted([(2, 1, "missing"), (3, None, "missing")], key=repr)
    assert found("full") == sorted([(2, 1, "missing"), (1, None, "partial"), (3, None, "partial"), (None, 9, "partial")], key=repr)


def test_a_key_that_half_of_all_references_have(spark):
    """No join or window partition of the references is by that key alone: they are spread over its days."""
    from stowage.operators.references import DAY, orphan_references

    n = 20_000
    refs = spark.range(n).selectExpr("if(id % 2 = 0, 'hot', concat('k', id)) AS k", f"id * {DAY // 20} AS at")
    keys = spark.createDataFrame([("hot", 500 * DAY, 700 * DAY), ("k1", 0, None)], "k string, since long, until long")
    got = orphan_references(refs, [("k", "k")], keys, at="at", since="since", until="until")
    rows = got.groupBy("k", "reason").count().where("k in ('hot', 'k1')").collect()
    at = [i * (DAY // 20) for i in range(0, n, 2)]
    assert {(r["k"], r["reason"]): r["count"] for r in rows} == {("hot", "late"): sum(t < 500 * DAY for t in at), ("hot", "deleted"): sum(t >= 700 * DAY for t in at)}
    assert got.where("reason = 'missing'").count() == n // 2 - 1
