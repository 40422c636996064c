"""References to records that do not exist, with partly null composite keys and records that come and go."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions.names import quoted
from stowage.operators.snapshots import micros
from stowage.session import checkpointed

#: Later than any time in microseconds.
FOREVER = 2**62
DAY = 86_400_000_000


def orphan_references(refs: DataFrame, on: list[tuple[str, str]], keys: DataFrame, match: str = "simple", at: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Distinct references (columns and time of `refs`) that find no record, with `reason`.

    on: pairs (column of refs, column of keys). References are grouped by which of their columns are null, and each such group
    is anti-joined on the columns it has. match, as in SQL: simple (a reference with a null refers to nothing, so is no case),
    partial (its other columns must be found; all null is no case) or full (all null is no case, some null is one: `partial`).

    With `at` (time of a reference), `since` (a record came in) and `until` (it was deleted; null: never), microseconds or
    timestamps, a record counts only from `since` until just before `until`. reason is then missing (no record at all), late (all
    came in after that time) or deleted (each that had come in was deleted at or before it); a record without `since` never
    came in, so it makes a reference late, and a reference without a time can only be missing. Without times reason is always missing. Repeated references come
    once; nulls in other columns play no part; empty tables are fine on either side.
    """
    if match not in ("simple", "partial", "full"):
        raise ValueError(f"not a match rule: {match}")
    ref_names, names = [a for a, _ in on], [f"k{i}" for i in range(len(on))]
    slim = refs.select(*[F.col(quoted(a)).alias(n) for (a, _), n in zip(on, names)], (_micros(refs, at) if at else F.lit(None).cast("long")).alias("at")).distinct()
    have = keys.select(*[F.col(quoted(b)).alias(n) for (_, b), n in zip(on, names)], (_micros(keys, since) if since else F.lit(-FOREVER)).alias("since"), (F.coalesce(_micros(keys, until), F.lit(FOREVER)) if until else F.lit(FOREVER)).alias("until"))
    # distinct references are few beside the rows they come from, and are read once for each kind of reason
    slim = checkpointed(slim)
    parts = []
    for mask in product((False, True), repeat=len(on)):
        own = [n for n, null in zip(names, mask) if not null]
        if not own or (match == "simple" and any(mask)):
            continue
        group = slim.where(reduce(Column.__and__, [F.col(n).isNull() if null else F.col(n).isNotNull() for n, null in zip(names, mask)]))
        if match == "full" and any(mask):
            parts.append(group.withColumn("reason", F.lit("partial")))
            continue
        records = have.select(*own, "since", "until").where(reduce(Column.__and__, [F.col(n).isNotNull() for n in own]))
        known = records.select(*own).distinct()
        # each key once, so a key that most references have is one row here
        untimed = (group.where("at is null") if at else group).select(*names).distinct()
        parts.append(untimed.join(known, own, "left_anti").select(*names, F.lit(None).cast("long").alias("at"), F.lit("missing").alias("reason")))
        if at:
            parts.append(_not_at_the_time(group.where("at is not null"), records, known, own, names))
    if not parts:
        return slim.where(F.lit(False)).select(*[F.col(n).alias(a) for a, n in zip(ref_names, names)], "at", F.lit("").alias("reason"))
    found = reduce(DataFrame.unionByName, parts)
    return found.select(*[F.col(n).alias(a) for a, n in zip(ref_names, names)], "at", "reason")


def _micros(df: DataFrame, name: str) -> Column:
    column, kind = F.col(quoted(name)), df.schema[name].dataType.typeName()
    return micros(column) if kind.startswith("timestamp") or kind == "date" else column.cast("long")


def _not_at_the_time(refs: DataFrame, records: DataFrame, known: DataFrame, own: list[str], names: list[str]) -> DataFrame:
    """References that find no record at their time: missing, late or deleted.

    The greatest `until` of the records that came in by a reference's time decides. It is found without pairing references
    with records: per key and day first, carried over the days (as many rows as days), then within each day. Whether a key
    exists at all is looked up for its days and carried too. So a key with very many records and references is spread over its
    days.
    """
    records = records.where(F.col("since").isNotNull()).groupBy(*own, "since").agg(F.max("until").alias("until")).withColumn("day", F.floor(F.col("since") / DAY))
    refs = refs.withColumn("day", F.floor(F.col("at") / DAY))
    nothing, no = F.lit(None).cast("long"), F.lit(None).cast("boolean")
    days = records.groupBy(*own, "day").agg(F.max("until").alias("until")).unionByName(refs.select(*own, "day").distinct().withColumn("until", nothing))
    days = days.groupBy(*own, "day").agg(F.max("until").alias("until"))
    before = F.max("until").over(Window.partitionBy(*own).orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    carried = days.withColumn("until", before).join(known.withColumn("known", F.lit(True)), own, "left")
    rest = [n for n in names if n not in own]
    events = carried.select(*own, "day", F.lit(-FOREVER).alias("at"), F.lit(0).alias("ref"), "until", "known")
    events = events.unionByName(records.select(*own, "day", F.col("since").alias("at"), F.lit(0).alias("ref"), "until", no.alias("known")))
    events = events.unionByName(refs.select(*own, "day", "at", F.lit(1).alias("ref"), nothing.alias("until"), no.alias("known")))
    so_far = Window.partitionBy(*own, "day").orderBy("at", "ref").rowsBetween(Window.unboundedPreceding, 0)
    seen = events.withColumn("latest", F.max("until").over(so_far)).withColumn("exists", F.max("known").over(so_far)).where("ref = 1")
    bad = seen.where(F.col("latest").isNull() | (F.col("latest") <= F.col("at")))
    bad = bad.withColumn("reason", F.when(F.col("exists").isNull(), "missing").when(F.col("latest").isNull(), "late").otherwise("deleted"))
    for f in [refs.schema[n] for n in rest]:
        bad = bad.withColumn(f.name, F.lit(None).cast(f.dataType))
    return bad.select(*names, "at", "reason")
