"""Records that differ only in characters, case, white space, punctuation or the order of fields.

Everything runs in the JVM: a record is brought to one canonical string, hashed to 128 bits, and counted with map-side
combining. Besides the count a group keeps the least and greatest of a second, independent 64-bit hash; if they differ,
different records met in one 128-bit value and the group is split by that hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions.names import fresh, quoted
from stowage.operators.skew import LoadPlan, fragment_replicate_join, plan_load
from stowage.session import checkpointed

#: Parts components of a canonical path and fields of a canonical object; neither letter nor digit.
PART, FIELD = "/", "\x1e"


def canonical_path(path: Column) -> Column:
    """Letters and digits (categories L and N) of each component in lower case, in order; components without any vanish.

    Both slashes part components. Null stays null; a path without letters and digits gives an empty string.
    """
    kept = F.regexp_replace(F.lower(F.translate(path, "\\", PART)), rf"[^\p{{L}}\p{{N}}{PART}]+", "")
    return F.regexp_replace(F.regexp_replace(kept, f"{PART}+", PART), f"^{PART}|{PART}$", "")


def canonical_object(raw: Column) -> Column:
    """A JSON object's fields in the order of their names, names in lower case, values as canonical paths.

    Numbers count as text, a null value is none of the texts, nested values count by their JSON text with sorted names. A text that
    is no object counts by its canonical path behind a mark of its own; null stays null.
    """
    fields = F.map_entries(F.from_json(raw, "map<string,string>"))
    named = F.transform(fields, lambda e: F.struct(F.lower(e["key"]).alias("key"), F.coalesce(F.concat(F.lit("="), canonical_path(_sorted(e["value"]))), F.lit("")).alias("value")))
    # a name's length stands before it, so that no name can imitate a border
    lines = F.transform(F.array_sort(named), lambda e: F.concat(F.length(e["key"]), F.lit(":"), e["key"], e["value"]))
    return F.when(raw.isNull(), F.lit(None)).otherwise(F.coalesce(F.concat(F.lit("{"), F.array_join(lines, FIELD)), F.concat(F.lit("!"), canonical_path(raw))))


def _sorted(value: Column) -> Column:
    """A nested value with the names of its objects in order; others as they are."""
    return F.when(F.startswith(value, F.lit("{")) | F.startswith(value, F.lit("[")), F.coalesce(F.to_json(F.try_parse_json(value)), value)).otherwise(value)


def hashed(canonical: Column) -> tuple[Column, Column]:
    """128 bits that group, and 64 of another function that check."""
    return F.unhex(F.md5(canonical.cast("binary"))), F.xxhash64(canonical)


def slim(df: DataFrame, key: str, canonical: Column, *by: Column) -> DataFrame:
    """(by.., key, digest, check) of each record that has a canonical form."""
    digest, check = hashed(canonical)
    return df.select(*by, F.col(quoted(key)).alias("key"), digest.alias("digest"), check.alias("check")).where("digest is not null")


def _groups(rows: DataFrame, by: list[str]) -> DataFrame:
    groups = rows.groupBy(*by, "digest").agg(F.count(F.lit(1)).alias("copies"), F.min("key").alias("keep"), F.min("check").alias("low"), F.max("check").alias("high"))
    groups = checkpointed(groups)
    whole = groups.where("low = high").select(*by, "digest", F.lit(0).cast("long").alias("check"), "keep", "copies", F.lit(False).alias("collided"))
    met = groups.where("low != high").select(*[F.col(c).alias(f"met_{c}") for c in [*by, "digest"]])
    # none in practice; those that are get grouped again by both hashes, spread by their known counts
    if met.isEmpty():
        return whole
    plan = plan_load(groups.where("low != high"), [*by, "digest"], load="copies")
    split = fragment_replicate_join(rows, met, [(c, f"met_{c}") for c in [*by, "digest"]], "left_semi", plan).groupBy(*by, "digest", "check").agg(F.min("key").alias("keep"), F.count(F.lit(1)).alias("copies"))
    return whole.unionByName(split.select(*by, "digest", "check", "keep", "copies", F.lit(True).alias("collided")))


def copy_groups(df: DataFrame, key: str, canonical: Column) -> DataFrame:
    """One row per canonical record: digest, check (0 unless digests collided), keep (least key), copies, collided.

    Rows whose canonical form is null are in no group.
    """
    return groups_of(slim(df, key, canonical), [])


def groups_of(rows: DataFrame, by: list[str]) -> DataFrame:
    """The same for rows made by `slim`, within each value of `by`."""
    return _groups(rows, by)


def collapse(df: DataFrame, key: str, canonical: Column) -> DataFrame:
    """The first record (least key) of each group with `copies`; other columns as that record has them.

    `copies` gets underscores behind it if df has such a column. Null canonical forms are left out.
    """
    groups = copy_groups(df, key, canonical)
    keep, copies = fresh(df.columns, "_keep"), fresh(df.columns, "copies")
    return df.join(groups.select(F.col("keep").alias(keep), F.col("copies").alias(copies)), F.col(quoted(key)) == F.col(keep)).drop(keep)


def copies(df: DataFrame, key: str, canonical: Column, tasks: int | None = None) -> DataFrame:
    """(keep_id, copy_id) for each record that repeats another one, with the least key of its group as keep_id.

    A group may hold a third of all rows: only groups of two or more are joined back, and large ones are cut into
    shards by their known counts. Equal keys can't be told apart, so a repeated key gives no pair with itself.
    """
    return copies_of(slim(df, key, canonical), [], tasks)


def copies_of(rows: DataFrame, by: list[str], tasks: int | None = None) -> DataFrame:
    """The same for rows made by `slim`, within each value of `by`, so that several tables take one aggregation and one join."""
    # canonical forms are made once; what follows reads 32 bytes a record
    rows = checkpointed(rows)
    keys = [*by, "digest"]
    groups = _groups(rows, by).where("copies > 1").select(*[F.col(c).alias(f"group_{c}") for c in keys], "keep", F.col("check").alias("group_check"), "copies", "collided")
    plan: LoadPlan = plan_load(groups.groupBy(*[F.col(f"group_{c}").alias(c) for c in keys]).agg(F.sum("copies").alias("load")), keys, tasks, load="load")
    joined = fragment_replicate_join(rows, groups, [(c, f"group_{c}") for c in keys], "inner", plan)
    same = (~F.col("collided")) | (F.col("check") == F.col("group_check"))
    return joined.where(same & (F.col("keep") < F.col("key"))).select(*by, F.col("keep").alias("keep_id"), F.col("key").alias("copy_id"))
