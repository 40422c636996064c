"""What changed between full snapshots, in one aggregation shuffle.

Rows of all snapshots are united, each tagged by its snapshot, and grouped by key once. A group keeps for each snapshot
the hash of the row that holds (the one that came last); neighbouring snapshots are then compared within the group. The
map side combines, so redelivered rows of one file don't pile up in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions.names import fresh, quoted

#: 2^64 and 2^63, for a time and a hash in one DECIMAL(38): the aggregation's buffers then stay fixed in size.
SHIFT, HALF = "18446744073709551616", "9223372036854775808"
#: Time that a row without one counts as; before all others.
NEVER = -(2**52)


def row_hash(columns: list[Column]) -> Column:
    """64 bits of the values and of which of them are null. xxhash64 alone skips nulls, so (null, 5) would equal (5, null)."""
    mask = [c.isNull() for c in columns]
    return F.xxhash64(*mask, *columns)


def micros(column: Column) -> Column:
    return F.unix_micros(column.cast("timestamp"))


def snapshot_changes(df: DataFrame, snapshot: str, keys: list[str], values: list[str], arrived: str | None = None, at_once: int = 12) -> DataFrame:
    """Rows (snapshot, keys..., change_kind) for each key that differs from the snapshot delivered before.

    change_kind: added, removed or changed (some of `values` differs; null equals null only). If a snapshot has several
    rows for a key, the latest `arrived` holds (null counts as earliest); among equally late ones the greatest row hash, so the
    result doesn't depend on order. Rows without a snapshot are in none. Null keys are keys. The numbers of
    the snapshots, not their rows, come to the driver; `at_once` snapshots are compared in one aggregation, further ones in the
    next, with one in common. The first snapshot and an empty table give no rows.
    """
    numbers = sorted(r[0] for r in df.select(F.col(quoted(snapshot)).alias("s")).where("s is not null").distinct().collect())
    names = [f"k{i}" for i in range(len(keys))]
    time = micros(F.col(quoted(arrived))) if arrived else F.lit(0)
    packed = F.coalesce(time, F.lit(NEVER)).cast("decimal(18,0)") * F.lit(SHIFT).cast("decimal(20,0)")
    packed = packed.cast("decimal(38,0)") + (row_hash([F.col(quoted(v)) for v in values]).cast("decimal(20,0)") + F.lit(HALF).cast("decimal(20,0)"))
    slim = df.select(F.col(quoted(snapshot)).alias("s"), *[F.col(quoted(k)).alias(n) for k, n in zip(keys, names)], packed.cast("decimal(38,0)").alias("row"))
    out = fresh(keys, "change_kind")
    if len(numbers) < 2:
        nothing = slim.where(F.lit(False))
        return nothing.select(F.col("s").alias(snapshot), *[F.col(n).alias(k) for k, n in zip(keys, names)], F.lit("").alias(out))
    parts = []
    for start in range(0, len(numbers) - 1, at_once - 1):
        own = numbers[start : start + at_once]
        rows = slim.where(F.col("s").isin(own)) if len(own) < len(numbers) else slim.where("s is not null")
        held = rows.groupBy(*names).agg(*[F.max(F.when(F.col("s") == n, F.col("row"))).alias(f"v{i}") for i, n in enumerate(own)])
        pairs = []
        for i in range(1, len(own)):
            old, new = F.col(f"v{i - 1}"), F.col(f"v{i}")
            kind = F.when(old.isNull() & new.isNotNull(), "added").when(new.isNull() & old.isNotNull(), "removed").when(F.pmod(old, F.lit(SHIFT).cast("decimal(20,0)")) != F.pmod(new, F.lit(SHIFT).cast("decimal(20,0)")), "changed")
            pairs.append(F.struct(F.lit(own[i]).cast(df.schema[snapshot].dataType).alias("s"), kind.alias("kind")))
        parts.append(held.select(*names, F.explode(F.filter(F.array(*pairs), lambda p: p["kind"].isNotNull())).alias("p")))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionAll(part)
    return found.select(F.col("p.s").alias(snapshot), *[F.col(n).alias(k) for k, n in zip(keys, names)], F.col("p.kind").alias(out))
