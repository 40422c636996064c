"""Folders inside folders: prefix joins without nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions.names import quoted


def normal_path(path: Column, fold: bool = False) -> Column:
    """Slashes of one kind, repeated and last ones dropped; lower case where names fold. Null stays null."""
    clean = F.regexp_replace(F.translate(path, "\\", "/"), "/+", "/")
    clean = F.when(clean == "/", clean).otherwise(F.regexp_replace(clean, "/$", ""))
    return F.lower(clean) if fold else clean


def ancestors(path: Column, itself: bool = True) -> Column:
    """All folders above a normal path, from the top, and the path itself; the root is `/` for absolute paths."""
    parts = F.split(path, "/")
    depth = F.size(parts) if itself else F.size(parts) - 1
    made = F.transform(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    made = F.when(depth >= 1, F.transform(made, lambda p: F.when(p == "", "/").otherwise(p))).otherwise(F.array())
    return F.array_distinct(F.when(path == "/", F.array(F.lit("/")) if itself else F.array().cast("array<string>")).otherwise(made))


def depth(path: Column) -> Column:
    return F.size(F.filter(F.split(path, "/"), lambda p: p != ""))


def under(df: DataFrame, path: str, folders: DataFrame, folder: str, itself: bool = True) -> DataFrame:
    """Rows joined to every folder that contains their path, component by component (`/a/b` is not in `/a/bc`).

    Each path is spread over its ancestors, few per row, so this is an equi-join that Catalyst may broadcast or sort-merge.
    Columns of `folders` come as they are, so their names must not clash. Null paths and folders are nowhere.
    """
    spread = df.withColumn("_above", F.explode(ancestors(F.col(quoted(path)), itself)))
    return spread.join(folders, F.col("_above") == F.col(quoted(folder))).drop("_above")


def longest_under(df: DataFrame, key: str, path: str, folders: DataFrame, folder: str) -> DataFrame:
    """(key, path, folder) with the deepest folder that contains the path."""
    found = under(df.select(key, path), path, folders.select(folder).distinct(), folder)
    return found.groupBy(key, path).agg(F.max_by(folder, F.length(folder)).alias(folder))


def containing(df: DataFrame, key: str, path: str) -> DataFrame:
    """(outer, inner) keys of rows of which one folder lies strictly inside the other."""
    outer = df.select(F.col(quoted(key)).alias("outer_key"), F.col(quoted(path)).alias("outer_path"))
    inner = df.select(F.col(quoted(key)).alias("inner_key"), F.col(quoted(path)).alias("inner_path"))
    return under(inner, "inner_path", outer, "outer_path", itself=False).select("outer_key", "inner_key")


def safe_relative(path: Column) -> Column:
    """Whether a path is relative, plain, at most 4,096 bytes and 256 parts, and holds no NUL."""
    parts = F.split(path, "/")
    plain = F.forall(parts, lambda p: ~p.isin("", ".", ".."))
    return (F.octet_length(path) <= 4096) & (F.size(parts) <= 256) & plain & ~F.contains(path, F.lit("\0"))


def extension(path: Column) -> Column:
    """The last name's ending in lower case, empty if it has none."""
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"[^.]\.([^.]+)$", 1))


def overlay(base: DataFrame, upper: DataFrame, whiteouts: DataFrame, path: str, values: list[str]) -> DataFrame:
    """What a layered folder shows: upper entries over base ones, without those at or below a whiteout.

    A whiteout hides entries of both layers. The result has `layer`: upper or base.
    """
    a = base.select(F.col(quoted(path)).alias("_base"), F.struct(*values).alias("_a"))
    b = upper.select(F.col(quoted(path)).alias("_upper"), F.struct(*values).alias("_b"))
    both = a.join(b, F.col("_base") == F.col("_upper"), "full_outer").select(F.coalesce("_upper", "_base").alias(path), F.coalesce("_b", "_a").alias("_v"), F.when(F.col("_b").isNotNull(), "upper").otherwise("base").alias("layer"))
    out = whiteouts.select(F.col(quoted(path)).alias("_white")).distinct()
    hidden = both.select(path, F.explode(ancestors(F.col(quoted(path)))).alias("_above")).join(out, F.col("_above") == F.col("_white"), "left_semi").select(F.col(quoted(path)).alias("_hidden")).distinct()
    seen = both.join(hidden, F.col(quoted(path)) == F.col("_hidden"), "left_anti")
    return seen.select(path, *[F.col(f"_v.{quoted(v)}").alias(v) for v in values], "layer")


def hex_components(path_hex: Column) -> Column:
    """Components of a path of raw bytes in hex digits, so that their order is that of a walk."""
    spaced = F.regexp_replace(path_hex, "(..)", "$1 ")
    return F.split(spaced, "2F ")
