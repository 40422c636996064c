"""Queries p2, p3, p6, p7 and p8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm import canonical, leaks, linkage, sentences, tokens
from stowage.session import table


def p2_links(spark: SparkSession, d: str) -> DataFrame:
    """Records of the same game with the confidence of each link."""
    games = table(spark, d, "games").select("id", "title", "path")
    entries = table(spark, d, "lutris_games").select("id", "name", "directory")
    links = linkage.link_records(games, entries)
    return links.select(F.col("left_id").alias("game_id"), F.col("right_id").alias("lutris_id"), "confidence")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_links(spark, d).select("game_id", "lutris_id")


def _forms(spark: SparkSession, d: str):
    yield "games", table(spark, d, "games").select("rec_no", "path"), "rec_no", canonical.canonical_path(F.col("path"))
    yield "lutris_games", table(spark, d, "lutris_games").select("id", "directory"), "id", canonical.canonical_path(F.col("directory"))
    yield "raw_games", table(spark, d, "raw_games").select("raw_id", "raw"), "raw_id", canonical.canonical_object(F.col("raw"))


def _slim_forms(spark: SparkSession, d: str) -> DataFrame:
    parts = [canonical.slim(df, key, form, F.lit(name).alias("tbl")) for name, df, key, form in _forms(spark, d)]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.copies_of(_slim_forms(spark, d), ["tbl"])


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """One record of each group with its number of copies."""
    return canonical.groups_of(_slim_forms(spark, d), ["tbl"]).select("tbl", F.col("keep").alias("keep_id"), "copies")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_texts(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every text encoded and decoded again."""
    ids = p6_ids(spark, d)
    return ids.select("doc_id", F.size("ids").alias("n"), tokens.decoded(ids, F.col("ids")).alias("text")).select("doc_id", "text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "eval_items").select("item_id", "text"))


def p7_by_item(spark: SparkSession, d: str) -> DataFrame:
    """In how many documents each leaked item occurs."""
    return p7_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(table(spark, d, "documents").select("doc_id", "text", "kind"))


def p8_by_document(spark: SparkSession, d: str) -> DataFrame:
    """Number and greatest length of the units of each document that has any."""
    length = F.col("end_at") - F.col("start_at")
    return p8_found(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("units"), F.max(length).alias("longest"))


QUERIES = {f.__name__: f for f in (p2_found, p2_links, p3_found, p3_groups, p6_ids, p6_round_trip, p7_found, p7_by_item, p8_found, p8_by_document)}

_PATH = r"""array_to_string(list_filter(list_transform(string_split_regex({0}, '[/\\]'),
        lambda c: regexp_replace(lower(c), '[^\p{{L}}\p{{N}}]', '', 'g')), lambda c: c <> ''), '/')"""
_P3 = f"""forms AS (
  SELECT 'games' AS tbl, rec_no AS id, {_PATH.format('path')} AS form FROM games WHERE path IS NOT NULL
  UNION ALL SELECT 'lutris_games', id, {_PATH.format('directory')} FROM lutris_games WHERE directory IS NOT NULL
  UNION ALL SELECT 'raw_games', raw_id, string_agg(lower(key) || '=' || {_PATH.format("(json ->> ('$.\"' || key || '\"'))")}, chr(30) ORDER BY lower(key))
    FROM (SELECT raw_id, CAST(raw AS JSON) AS json, unnest(json_keys(CAST(raw AS JSON))) AS key FROM raw_games) GROUP BY raw_id)"""

SQL = {
    "p3_found": f"""WITH {_P3} SELECT tbl, keep_id, id AS copy_id
        FROM (SELECT tbl, id, min(id) OVER (PARTITION BY tbl, form) AS keep_id FROM forms) WHERE keep_id < id""",
    "p3_groups": f"WITH {_P3} SELECT tbl, min(id) AS keep_id, count(*) AS copies FROM forms GROUP BY tbl, form",
    "p6_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
