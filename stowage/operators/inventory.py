"""File inventories: which files count, which changed, and what was done to them before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions.costs import saturating_sum
from stowage.functions.names import quoted

#: Files up to these sizes are left alone: one sector, or half a block in a store.
NATIVE_FLOOR, STORE_FLOOR = 4 * 1024, 64 * 1024
PRINT = ("size", "ino", "mtime_ns", "ctime_ns")


def action(size: Column, floor: int = NATIVE_FLOOR) -> Column:
    """compress, or skip_tiny for sizes up to the floor; a null size is tiny."""
    return F.when(F.coalesce(size, F.lit(0)) <= floor, "skip_tiny").otherwise("compress")


def latest_rows(df: DataFrame, keys: list[str], by: list[str], keep: list[str]) -> DataFrame:
    """One row per key, that with the greatest `by` (then the greatest `keep`, so ties don't depend on order).

    A grouped maximum with map-side combining, so many copies of a key don't meet in a window. Nulls in `by` come first; null
    keys are keys.
    """
    order = F.struct(*[F.col(quoted(c)) for c in [*by, *(k for k in keep if k not in by)]])
    held = df.groupBy(*[F.col(quoted(k)) for k in keys]).agg(F.max(order).alias("_held"))
    return held.select(*keys, *[F.col(f"_held.{quoted(c)}").alias(c) for c in keep])


def differs(left: list[Column], right: list[Column]) -> Column:
    """Whether fingerprints differ; null equals null only."""
    return ~F.struct(*left).eqNullSafe(F.struct(*right))


def changed_since(now: DataFrame, before: DataFrame, keys: list[str], level_floor: int = 1, floor: int = NATIVE_FLOOR, prints: tuple[str, ...] = PRINT, level: str = "level_applied") -> DataFrame:
    """Rows of `now` that need work, with `why`: new, changed, or behind.

    behind: unchanged, large enough to compress, and never compressed to `level_floor` or above (0: tried and left alone). A key in
    `before` must be unique. Null keys match nothing, so such rows are new.
    """
    old = before.select(*[F.col(quoted(c)).alias(f"old_{i}") for i, c in enumerate([*keys, *prints])], F.col(quoted(level)).alias("old_level"), F.lit(True).alias("old_there"))
    on = [F.col(quoted(k)) == F.col(f"old_{i}") for i, k in enumerate(keys)]
    joined = now.join(old, on, "left")
    mine, theirs = [F.col(quoted(p)) for p in prints], [F.col(f"old_{len(keys) + i}") for i in range(len(prints))]
    low = (action(F.col("size"), floor) == "compress") & ((F.coalesce("old_level", F.lit(0)) == 0) | (F.col("old_level") < level_floor))
    why = F.when(F.col("old_there").isNull(), "new").when(differs(mine, theirs), "changed").when(low, "behind")
    return joined.withColumn("why", why).where("why is not null").select(*[F.col(quoted(c)) for c in now.columns], "why")


def recorded_levels(now: DataFrame, before: DataFrame, keys: list[str], prints: tuple[str, ...] = PRINT, level: str = "level_applied") -> DataFrame:
    """Keys of files whose fingerprint is still the recorded one, with the recorded level."""
    old = before.select(*[F.col(quoted(c)).alias(f"old_{i}") for i, c in enumerate([*keys, *prints])], F.col(quoted(level)).alias("recorded_level"))
    on = [F.col(quoted(k)) == F.col(f"old_{i}") for i, k in enumerate(keys)] + [F.col(quoted(p)).eqNullSafe(F.col(f"old_{len(keys) + i}")) for i, p in enumerate(prints)]
    return now.join(old, on, "inner").select(*keys, "recorded_level")


def without_receipt(now: DataFrame, receipts: DataFrame, keys: list[str], level_floor: int = 1, prints: tuple[str, ...] = PRINT, level: str = "level_applied") -> DataFrame:
    """Files that no usable receipt covers: one of the same fingerprint at the floor or above."""
    usable = receipts.where(F.col(quoted(level)) >= level_floor)
    old = usable.select(*[F.col(quoted(c)).alias(f"old_{i}") for i, c in enumerate([*keys, *prints])])
    on = [F.col(quoted(k)) == F.col(f"old_{i}") for i, k in enumerate(keys)] + [F.col(quoted(p)).eqNullSafe(F.col(f"old_{len(keys) + i}")) for i, p in enumerate(prints)]
    return now.join(old, on, "left_anti")


def merged_outcome(now: DataFrame, before: DataFrame, confirmed: DataFrame, keys: list[str], prints: tuple[str, ...] = PRINT, level: str = "level_applied") -> DataFrame:
    """The level to record for each file: the confirmed one, else the earlier one if its fingerprint still matches, else 0."""
    kept = recorded_levels(now, before, keys, prints, level).select(*[F.col(k).alias(f"kept_{i}") for i, k in enumerate(keys)], "recorded_level")
    done = confirmed.select(*[F.col(quoted(k)).alias(f"done_{i}") for i, k in enumerate(keys)], F.col(quoted(level)).alias("confirmed_level"))
    joined = now.join(kept, [F.col(quoted(k)) == F.col(f"kept_{i}") for i, k in enumerate(keys)], "left")
    joined = joined.join(done, [F.col(quoted(k)) == F.col(f"done_{i}") for i, k in enumerate(keys)], "left")
    return joined.select(*keys, F.coalesce("confirmed_level", "recorded_level", F.lit(0)).alias("level"))


def footprint(files: DataFrame, group: list[str], path: str = "relpath", size: str = "size") -> DataFrame:
    """Files, bytes, the largest, and an allowance for metadata: 16 KiB and eight times the path's bytes each."""
    allowance = F.lit(16 * 1024).cast("long") + F.octet_length(F.col(quoted(path))).cast("long") * 8
    return files.groupBy(*group).agg(F.count(F.lit(1)).alias("files"), saturating_sum(F.col(quoted(size))).alias("bytes"), F.max(F.col(quoted(size))).alias("largest"), F.sum(allowance).alias("metadata_bytes"))


def allocation(files: DataFrame, group: list[str], identity: list[str], size: str = "size") -> DataFrame:
    """Logical and allocated bytes (blocks of 512), each identity (device and inode) once; its greatest size counts."""
    once = files.groupBy(*group, *identity).agg(F.max(F.col(quoted(size))).alias("size"))
    blocks = F.call_function("div", F.coalesce("size", F.lit(0).cast("long")) + 511, F.lit(512).cast("long")) * 512
    return once.groupBy(*group).agg(F.count(F.lit(1)).alias("files"), saturating_sum(F.col("size")).alias("logical_bytes"), saturating_sum(blocks).alias("allocated_bytes"))


def tree_diff(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Entries that keep two trees from being equal: missing (only left), extra (only right) or different."""
    a = left.select(*[F.col(quoted(k)).alias(f"k{i}") for i, k in enumerate(keys)], F.struct(*values).alias("a"))
    b = right.select(*[F.col(quoted(k)).alias(f"j{i}") for i, k in enumerate(keys)], F.struct(*values).alias("b"))
    joined = a.join(b, [F.col(f"k{i}") == F.col(f"j{i}") for i in range(len(keys))], "full_outer")
    what = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(~F.col("a").eqNullSafe(F.col("b")), "different")
    return joined.withColumn("what", what).where("what is not null").select(*[F.coalesce(f"k{i}", f"j{i}").alias(k) for i, k in enumerate(keys)], "what")


def hard_links(files: DataFrame, identity: list[str], path: str) -> DataFrame:
    """Further names of one inode with the first in path order as their target. Combined before the shuffle, then joined back."""
    first = files.groupBy(*identity).agg(F.min(F.col(quoted(path))).alias("target"), F.count(F.lit(1)).alias("links")).where("links > 1")
    named = first.select(*[F.col(quoted(c)).alias(f"i{n}") for n, c in enumerate(identity)], "target", "links")
    joined = files.join(named, [F.col(quoted(c)) == F.col(f"i{n}") for n, c in enumerate(identity)])
    return joined.where(F.col(quoted(path)) != F.col("target")).select(*identity, path, "target", "links")
