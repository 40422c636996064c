"""Tables of records that change: upserts, deletes, retention and the newest of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions.names import fresh, quoted


def upsert(base: DataFrame, updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Both tables with one row per key: updates win over base rows, and later ones (greatest `order`) over earlier.

    A grouped maximum, so nothing is sorted in a window and equal keys are combined before the shuffle. Further columns must agree.
    """
    columns = base.columns
    both = base.select(*columns).withColumn("_turn", F.lit(0)).unionByName(updates.select(*columns).withColumn("_turn", F.lit(1)))
    rest = [c for c in columns if c not in keys]
    row = F.struct("_turn", *[F.col(quoted(c)) for c in order], *[F.col(quoted(c)) for c in rest if c not in order])
    held = both.groupBy(*keys).agg(F.max(row).alias("_row"))
    return held.select(*[F.col(quoted(c)) if c in keys else F.col(f"_row.{quoted(c)}").alias(c) for c in columns])


def replace_groups(base: DataFrame, updates: DataFrame, group: list[str]) -> DataFrame:
    """`base` with all rows of the groups in `updates` replaced by those."""
    return base.join(updates.select(*group).distinct(), group, "left_anti").select(*base.columns).unionByName(updates.select(*base.columns))


def write_groups(updates: DataFrame, path: str, group: list[str]) -> None:
    """The same as a file sink: only the partitions of the groups in `updates` are overwritten."""
    updates.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*group).parquet(path)


def without(base: DataFrame, gone: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """Rows whose key is not in `gone`. Null keys stay."""
    other = gone.select(*[F.col(quoted(b)).alias(f"g{i}") for i, (_, b) in enumerate(keys)])
    return base.join(other, [F.col(quoted(a)) == F.col(f"g{i}") for i, (a, _) in enumerate(keys)], "left_anti")


def invalidate(records: DataFrame, where: Column, set_to: dict[str, Column]) -> DataFrame:
    """Records with some columns reset where a condition holds (not where it is null)."""
    return records.withColumns({c: F.when(where, v).otherwise(F.col(quoted(c))) for c, v in set_to.items()})


def newest(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first n rows in an order; a top-k, so each task keeps n rows at most."""
    return df.orderBy(*order).limit(n)


def latest_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest `order` of each key."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.struct(*[F.col(quoted(c)) for c in [*order, *rest]])
    held = df.groupBy(*[F.col(quoted(k)) for k in keys]).agg(F.max(row).alias("_row"))
    return held.select(*[F.col(quoted(c)) if c in keys else F.col(f"_row.{quoted(c)}").alias(c) for c in df.columns])


def beyond_newest(df: DataFrame, n: int, order: str) -> DataFrame:
    """Rows beyond the n newest, which retention removes. The n-th key is found by a top-k, not by ranking all rows.

    `order` must be unique; null orders are beyond.
    """
    top = df.select(F.col(quoted(order)).alias("_order")).where("_order is not null").orderBy(F.col("_order").desc()).limit(n).agg(F.min("_order").alias("least"), F.count("_order").alias("kept"))
    least, kept = top.first()
    if kept < n:
        return df.where(F.col(quoted(order)).isNull())
    return df.where(F.col(quoted(order)).isNull() | (F.col(quoted(order)) < F.lit(least)))


def next_id(df: DataFrame, key: str) -> DataFrame:
    return df.agg((F.coalesce(F.max(F.col(quoted(key))), F.lit(0)) + 1).alias("next_id"))


def publish_missing(objects: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Objects of `new` that aren't there yet, each once."""
    return new.dropDuplicates(keys).join(objects.select(*keys).distinct(), keys, "left_anti").select(*new.columns)


def really_changed(old: DataFrame, new: DataFrame, keys: list[str], volatile: list[str]) -> DataFrame:
    """Rows of `new` that differ from `old` in more than volatile columns, or aren't in it."""
    steady = [c for c in new.columns if c not in keys and c not in volatile]
    mark = F.sha2(F.to_json(F.struct(*[F.col(quoted(c)) for c in steady]), ), 256)
    before = old.select(*[F.col(quoted(k)).alias(f"k{i}") for i, k in enumerate(keys)], mark.alias("mark"))
    on = [F.col(quoted(k)) == F.col(f"k{i}") for i, k in enumerate(keys)] + [F.col("_mark") == F.col("mark")]
    return new.withColumn("_mark", mark).join(before, on, "left_anti").drop("_mark")


def running_totals(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, value: Column, name: str) -> DataFrame:
    """Each row with the sum of `value` over the rows before it in its key's order (0 for the first).

    A key may hold a third of all rows, so its rows never meet in one task: `bucket`, which must never fall along the order,
    cuts each key; the buckets' sums are carried over (as many rows as buckets), and only the rows within a bucket are sorted.
    """
    part, before, within = (fresh(df.columns, n) for n in ("_bucket", "_before", "_within"))
    cut = df.withColumn(part, bucket)
    sums = cut.groupBy(*keys, part).agg(F.sum(value).alias("_sum"))
    carried = sums.withColumn(before, F.coalesce(F.sum("_sum").over(Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))).select(*[F.col(quoted(k)).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(part).alias("_b"), before)
    joined = cut.join(carried, [F.col(quoted(k)).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col(part).eqNullSafe(F.col("_b"))]).drop("_b", *[f"_k{i}" for i in range(len(keys))])
    inner = F.sum(value).over(Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return joined.withColumn(within, F.coalesce(inner, F.lit(0).cast("long"))).withColumn(name, (F.col(before) + F.col(within)).cast("long")).drop(part, before, within)


def top_places(df: DataFrame, n: int, order: list[Column], columns: list[str]) -> DataFrame:
    """The first n rows in an order, with their `place` from 1. A top-k; only those n rows are numbered."""
    top = df.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    return top.select("place", *columns)


def numbered(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, name: str) -> DataFrame:
    """Each row's place from 1 within its key; `bucket` must not fall along the order (see running_totals)."""
    out = running_totals(df, keys, order, bucket, F.lit(1).cast("long"), name)
    return out.withColumn(name, F.col(quoted(name)) + 1)


def kept_if(new: DataFrame, old: DataFrame, keys: list[str], flags: DataFrame, group: str, flag: str) -> DataFrame:
    """New rows, and those old ones missing among them whose group has the flag. Null keys match nothing."""
    missing = old.join(new.select(*keys).distinct(), keys, "left_anti").join(flags.where(F.col(quoted(flag))).select(group), group, "left_semi")
    return new.withColumn("kept", F.lit(False)).unionByName(missing.select(*new.columns).withColumn("kept", F.lit(True)))


def stamps(df: DataFrame, group: list[str], path: str, values: list[str], most: int) -> DataFrame:
    """One digest per group over its first rows in path order; `partial:n:` before it if there are more than `most`.

    The rank is bounded, so each task keeps `most` rows of a group before the shuffle. Nulls count as the text `-`.
    """
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.col(quoted(path)).asc()))
    line = F.concat_ws(":", F.col(quoted(path)), *[F.coalesce(F.col(quoted(v)).cast("string"), F.lit("-")) for v in values])
    first = df.withColumn("_place", place).where(F.col("_place") <= most).select(*group, "_place", line.alias("_line"))
    digest = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", "_line"))), lambda x: x["_line"]), "\n"), 256)
    made = first.groupBy(*group).agg(digest.alias("_digest"))
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("files"))
    mark = F.when(F.col("files") > most, F.concat(F.lit("partial:"), F.lit(most).cast("string"), F.lit(":"), "_digest")).otherwise(F.col("_digest"))
    return counts.join(made, group).select(*group, "files", mark.alias("stamp"))


def appended(base: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """`new` rows with the ids that follow the greatest of `base`, in an order whose first column is a number and which is unique."""
    top = base.agg(F.coalesce(F.max(F.col(quoted(key))), F.lit(0)).alias("_top"))
    one = new.withColumn("_all", F.lit(0))
    placed = numbered(one, ["_all"], [F.col(quoted(c)).asc() for c in order], F.floor(F.col(quoted(order[0])) / 65536), "_place")
    # one row
    return placed.join(F.broadcast(top)).select((F.col("_top") + F.col("_place")).alias(key), *[F.col(quoted(c)) for c in new.columns if c not in order])


def migrated(df: DataFrame, added: dict[str, Column]) -> DataFrame:
    """A table of an older schema with the columns that a newer one added; those it has already stay."""
    return df.withColumns({c: v for c, v in added.items() if c.lower() not in {x.lower() for x in df.columns}})
