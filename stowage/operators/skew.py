"""Joins and per-key results that stay even when a few keys hold most rows.

Fragment-replicate by estimated load. The loads of all keys are counted with map-side combining; only the keys
above an eighth of an even task's load come to the driver, so at most eight a task whatever the data's size. The light
keys stay where the hash of (key, 0) puts them. Heavy keys are cut into shards of half a task's load at most, the shards
are packed, largest first, onto the least loaded tasks, and each gets the salt whose hash of (key, salt) lies on its task.
So the plan stays an ordinary hash partitioning of (key, salt), which Spark reuses for joins and groups without another
exchange, and the matching side is copied only to the shards of its key.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowage.functions.names import fresh, quoted
from stowage.session import tasks_of

#: A key with less than this share of an even task's load keeps its place.
LIGHT = 8
#: Shards hold at most this share of an even task's load.
SHARD = 2


@dataclass
class LoadPlan:
    """Where the rows of each key go: `heavy` maps a key to its salts, all other keys have salt 0."""

    keys: list[str]
    tasks: int
    total: int
    heavy: dict[tuple, list[int]] = field(default_factory=dict)
    #: Rows that the plan gives each task.
    loads: list[float] = field(default_factory=list)
    key_types: list[T.DataType] = field(default_factory=list)


def hash_int(values: np.ndarray, seed: int) -> np.ndarray:
    """Spark's 32-bit Murmur3 of int columns, whose seed is the hash of the columns before."""

    def turn(x: np.ndarray, by: int) -> np.ndarray:
        return (x << np.uint32(by)) | (x >> np.uint32(32 - by))

    k = turn(values.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    h = turn(np.uint32(seed & 0xFFFFFFFF) ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h = h ^ np.uint32(4)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).astype(np.int32)


def salt_for(key_hash: int, task: int, tasks: int) -> int:
    """The least salt above 0 that puts a key of this hash on the task."""
    start, step = 1, 8 * tasks + 64
    while True:
        salts = np.arange(start, start + step, dtype=np.int64)
        hit = np.flatnonzero(np.mod(hash_int(salts, key_hash).astype(np.int64), tasks) == task)
        if len(hit):
            return int(salts[hit[0]])
        start += step


def pack(heavy: list[tuple[tuple, int, int]], light: list[float], total: int) -> tuple[dict[tuple, list[int]], list[float]]:
    """Salts of each heavy key (key, hash, load) and the load of each task; light: what the tasks hold already."""
    tasks = len(light)
    even = max(total / tasks, 1)
    pieces = []
    for number, (_, _, load) in enumerate(heavy):
        shards = max(1, math.ceil(load * SHARD / even)) if load > even / SHARD else 1
        pieces += [(load / shards, number)] * shards
    bins = [(load, task) for task, load in enumerate(light)]
    heapq.heapify(bins)
    salts: dict[tuple, list[int]] = {}
    known: dict[tuple[int, int], int] = {}
    for size, number in sorted(pieces, reverse=True):
        load, task = heapq.heappop(bins)
        key, key_hash, _ = heavy[number]
        if (number, task) not in known:
            known[number, task] = salt_for(key_hash, task, tasks)
        salts.setdefault(key, []).append(known[number, task])
        heapq.heappush(bins, (load + size, task))
    return salts, [load for load, _ in sorted(bins, key=lambda b: b[1])]


def plan_load(df: DataFrame, keys: list[str], tasks: int | None = None, load: str | None = None) -> LoadPlan:
    """Count the rows of each key and place them. With `load`, df already holds one row per key and its load there.

    Null is a key like any other; an empty table gives a plan without heavy keys.
    """
    tasks = tasks or tasks_of(df.sparkSession)
    columns = [F.col(quoted(k)) for k in keys]
    names = [f"k{i}" for i in range(len(keys))]
    renamed = [c.alias(n) for c, n in zip(columns, names)]
    if load is None:
        counts = df.select(*renamed).groupBy(*names).agg(F.count(F.lit(1)).alias("load"))
    else:
        counts = df.select(*renamed, F.col(quoted(load)).cast("long").alias("load"))
    types = [counts.schema[n].dataType for n in names]
    counts = counts.persist()
    try:
        total = counts.agg(F.sum("load")).first()[0] or 0
        plan = LoadPlan(keys, tasks, total, {}, [0.0] * tasks, types)
        if not total:
            return plan
        is_heavy = F.col("load") * (LIGHT * tasks) > total
        light = counts.where(~is_heavy).groupBy(F.pmod(F.hash(*names, F.lit(0)), F.lit(tasks)).alias("task")).agg(F.sum("load").alias("load"))
        resting = [0.0] * tasks
        for row in light.collect():  # at most one row a task
            resting[row["task"]] = float(row["load"])
        heavy = [(tuple(r[n] for n in names), r["h"], r["load"]) for r in counts.where(is_heavy).select(*names, F.hash(*names).alias("h"), "load").collect()]
    finally:
        counts.unpersist()
    heavy.sort(key=lambda x: (-x[2], x[1]))
    plan.heavy, plan.loads = pack(heavy, resting, total)
    return plan


def _heavy_table(plan: LoadPlan, like: DataFrame, names: list[str], salts: str) -> DataFrame:
    fields = [T.StructField(n, t) for n, t in zip(names, plan.key_types)]
    schema = T.StructType([*fields, T.StructField(salts, T.ArrayType(T.IntegerType()))])
    return like.sparkSession.createDataFrame([(*key, s) for key, s in plan.heavy.items()], schema)


def _salted(df: DataFrame, plan: LoadPlan, keys: list[str], salt: str, choose) -> DataFrame:
    if not plan.heavy:
        return df.withColumn(salt, F.lit(0))
    taken = [*df.columns, salt]
    names = []
    for i in range(len(keys)):
        names.append(fresh([*taken, *names], f"_heavy{i}"))
    salts = fresh([*taken, *names], "_salts")
    # at most LIGHT rows a task, so small whatever the data
    table = F.broadcast(_heavy_table(plan, df, names, salts))
    on = [F.col(quoted(k)).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
    joined = df.join(table, on, "left")
    return joined.withColumn(salt, choose(F.col(salts))).drop(*names, salts)


def spread(df: DataFrame, plan: LoadPlan, keys: list[str] | None = None, salt: str = "_salt", by: list[str] | None = None) -> DataFrame:
    """Each row with the salt of its shard. Rows of a heavy key go round its shards in the order of the scan.

    The turn comes from the row's place in its partition, so equal rows are spread too. Where the input comes from a stage
    that may order its rows otherwise when it is run again, name columns in `by`; their hash then decides.
    """
    turn = F.xxhash64(*[F.col(quoted(c)) for c in by]) if by else F.monotonically_increasing_id()

    def choose(salts: Column) -> Column:
        return F.when(salts.isNull(), F.lit(0)).otherwise(F.element_at(salts, (F.pmod(turn, F.greatest(F.size(salts), F.lit(1))) + 1).cast("int")))

    return _salted(df, plan, keys or plan.keys, salt, choose)


def replicate(df: DataFrame, plan: LoadPlan, keys: list[str] | None = None, salt: str = "_salt") -> DataFrame:
    """The matching side: each row of a heavy key once for each of its shards, all others once."""
    return _salted(df, plan, keys or plan.keys, salt, lambda salts: F.explode(F.when(salts.isNull(), F.array(F.lit(0))).otherwise(F.array_distinct(salts))))


def fragment_replicate_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], how: str = "inner", plan: LoadPlan | None = None, tasks: int | None = None, by: list[str] | None = None) -> DataFrame:
    """`left` joined to `right` on pairs of columns, with no task far above the others.

    how: inner, left, left_semi or left_anti. The result has the columns of both sides; right columns whose names the left
    has too come as `right_<name>`. Null keys match nothing (left rows with them stay for left and left_anti). Repeated
    rows on either side count as often as they occur. Either table may be empty.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"not a join of this operator: {how}")
    left_keys, right_keys = [a for a, _ in on], [b for _, b in on]
    plan = plan or plan_load(left, left_keys, tasks)
    salt = fresh([*left.columns, *right.columns], "_salt")
    many = spread(left, plan, left_keys, salt, by).repartition(plan.tasks, *[F.col(quoted(k)) for k in left_keys], F.col(salt))
    taken, renamed = [*left.columns, salt], []
    for name in right.columns:
        renamed.append(fresh([*taken, *renamed], f"right_{name}" if name.lower() in {t.lower() for t in taken} else name))
    to = dict(zip(right.columns, renamed))
    one = right.toDF(*renamed)
    for key in right_keys:
        one = one.where(F.col(quoted(to[key])).isNotNull())
    other = fresh([*taken, *renamed], "_right_salt")
    one = replicate(one, plan, [to[k] for k in right_keys], other).repartition(plan.tasks, *[F.col(quoted(to[k])) for k in right_keys], F.col(other))
    # estimates made before an explode or a checkpoint may be far too low, so no side is left to be broadcast by them
    one = one.hint("merge")
    condition = [F.col(quoted(a)) == F.col(quoted(to[b])) for a, b in on] + [F.col(salt) == F.col(other)]
    return many.join(one, condition, how).drop(salt, other)


#: How partial results of a function merge.
MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max, "bit_or": F.bit_or, "bool_or": F.bool_or, "bool_and": F.bool_and}
PARTIAL = MERGE | {"count": F.count}


def balanced_aggregate(df: DataFrame, keys: list[str], results: dict[str, tuple[str, str | None]], plan: LoadPlan | None = None, tasks: int | None = None) -> DataFrame:
    """One row per key with the named results, e.g. {"files": ("count", None), "bytes": ("sum", "size")}.

    The plan may be for some of the keys only, where the others depend on them.

    Rows are combined before the shuffle, meet by (key, shard), and the shards' results are merged by key. Null is a key of
    its own; nulls in a column are passed over as SQL does (count with None counts all rows). An empty table gives no rows.
    """
    plan = plan or plan_load(df, keys, tasks)
    needed = list(dict.fromkeys([*keys, *(c for _, c in results.values() if c is not None)]))
    slim = df.select(*[F.col(quoted(c)) for c in needed])
    salt = fresh([*needed, *results], "_salt")
    columns = [F.col(quoted(k)) for k in keys]
    partial = [PARTIAL[f](F.col(quoted(c)) if c is not None else F.lit(1)).alias(n) for n, (f, c) in results.items()]
    shards = spread(slim, plan, plan.keys if set(plan.keys) <= set(keys) else keys, salt).groupBy(*columns, F.col(salt)).agg(*partial)
    return shards.groupBy(*columns).agg(*[MERGE[f](F.col(quoted(n))).alias(n) for n, (f, _) in results.items()])


def task_loads(plan: LoadPlan) -> list[float]:
    """Planned rows of each task, to compare with total / tasks."""
    return list(plan.loads)
