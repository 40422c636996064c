"""Queries p1, p4 and p5 over a storage tool's state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.operators.references import orphan_references
from stowage.operators.skew import balanced_aggregate, fragment_replicate_join, plan_load
from stowage.operators.snapshots import snapshot_changes
from stowage.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Games with at least 2 % of all file rows."""
    files = table(spark, d, "files").select("game_id")
    plan = plan_load(files, ["game_id"])
    loads = balanced_aggregate(files, ["game_id"], {"n": ("count", None)}, plan)
    return loads.where((F.col("n") * 50 >= F.lit(plan.total)) & F.col("game_id").isNotNull()).select("game_id")


def p1_game_profile(spark: SparkSession, d: str) -> DataFrame:
    """Every game's file rows, bytes and latest change, with the launcher of its newest record."""
    files = table(spark, d, "files").select("game_id", "size", "mtime_ns")
    games = table(spark, d, "games").groupBy("id").agg(F.max_by("launcher", "rec_no").alias("launcher"))
    plan = plan_load(files, ["game_id"])
    joined = fragment_replicate_join(files, games, [("game_id", "id")], "left", plan)
    # the launcher depends on the game, so as a key it keeps the aggregation's buffers fixed in size
    return balanced_aggregate(joined, ["game_id", "launcher"], {"file_rows": ("count", None), "bytes": ("sum", "size"), "largest": ("max", "size"), "newest_ns": ("max", "mtime_ns")}, plan)


def _references(spark: SparkSession, d: str) -> DataFrame:
    games = table(spark, d, "games").select("id", "loaded_at", "forgotten_at")
    files = table(spark, d, "files").select("game_id", F.unix_micros(F.col("snap_ts").cast("timestamp")).alias("at"))
    jobs = table(spark, d, "jobs").select("game_id", (F.col("created") * 1_000_000).alias("at"))
    parts = []
    for name, refs in (("files", files), ("jobs", jobs)):
        orphans = orphan_references(refs.where("game_id != ''"), [("game_id", "id")], games, "simple", "at", "loaded_at", "forgotten_at")
        parts.append(orphans.select(F.lit(name).alias("tbl"), F.date_format(F.timestamp_micros("at"), "yyyy-MM").alias("ref_month"), "game_id", "reason"))
    return parts[0].unionAll(parts[1])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _references(spark, d).distinct()


def p4_by_period(spark: SparkSession, d: str) -> DataFrame:
    """Orphaned ids by table, month and reason."""
    return p4_found(spark, d).groupBy("tbl", "ref_month", "reason").agg(F.count(F.lit(1)).alias("ids"))


def p4_composite(spark: SparkSession, d: str) -> DataFrame:
    """Games and kinds of the activity log that no job has, under each rule for keys that are partly null."""
    refs, jobs = table(spark, d, "activity").select("game_id", "kind"), table(spark, d, "jobs").select("game_id", "kind")
    on = [("game_id", "game_id"), ("kind", "kind")]
    parts = [orphan_references(refs, on, jobs, match).select(F.lit(match).alias("match"), "game_id", "kind", "reason") for match in ("simple", "partial", "full")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def _changes(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_changes(table(spark, d, "files"), "snap_no", ["game_id", "relpath"], ["size", "mtime_ns", "ino"], "loaded_at")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _changes(spark, d).select("snap_no", "game_id", F.hex("relpath").alias("relpath_hex"), "change_kind")


def p5_by_game(spark: SparkSession, d: str) -> DataFrame:
    """Changes of each game and snapshot by kind."""
    kinds = [F.count_if(F.col("change_kind") == k).alias(k) for k in ("added", "removed", "changed")]
    return _changes(spark, d).groupBy("snap_no", "game_id").agg(*kinds)


QUERIES = {f.__name__: f for f in (p1_found, p1_game_profile, p4_found, p4_by_period, p4_composite, p5_found, p5_by_game)}

_P4 = """refs AS (
  SELECT DISTINCT 'files' AS tbl, game_id, snap_ts AS ref_at FROM files WHERE game_id <> ''
  UNION ALL SELECT DISTINCT 'jobs', game_id, make_timestamp(created * 1000000) FROM jobs WHERE game_id <> ''),
seen AS (
  SELECT tbl, game_id, ref_at, count(g.id) AS n, count(CASE WHEN loaded_at <= ref_at THEN 1 END) AS came,
    count(CASE WHEN loaded_at <= ref_at AND (forgotten_at IS NULL OR forgotten_at > ref_at) THEN 1 END) AS there
  FROM refs LEFT JOIN games g ON g.id = refs.game_id GROUP BY ALL),
orphans AS (
  SELECT DISTINCT tbl, strftime(ref_at, '%Y-%m') AS ref_month, game_id,
    CASE WHEN n = 0 THEN 'missing' WHEN came = 0 THEN 'late' ELSE 'deleted' END AS reason
  FROM seen WHERE there = 0)"""

_P5 = """held AS (
  SELECT snap_no, game_id, relpath, size, mtime_ns, ino FROM files
  QUALIFY row_number() OVER (PARTITION BY snap_no, game_id, relpath ORDER BY loaded_at DESC) = 1),
order_of AS (SELECT snap_no, lead(snap_no) OVER (ORDER BY snap_no) AS next_no FROM (SELECT DISTINCT snap_no FROM files)),
old AS (SELECT h.*, next_no FROM held h JOIN order_of USING (snap_no) WHERE next_no IS NOT NULL),
new AS (SELECT h.* FROM held h WHERE snap_no > (SELECT min(snap_no) FROM files)),
changes AS (
  SELECT coalesce(n.snap_no, o.next_no) AS snap_no, coalesce(n.game_id, o.game_id) AS game_id,
    hex(coalesce(n.relpath, o.relpath)) AS relpath_hex,
    CASE WHEN o.snap_no IS NULL THEN 'added' WHEN n.snap_no IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
  FROM new n FULL JOIN old o ON o.next_no = n.snap_no AND o.game_id = n.game_id AND o.relpath = n.relpath
  WHERE o.snap_no IS NULL OR n.snap_no IS NULL OR o.size IS DISTINCT FROM n.size
    OR o.mtime_ns IS DISTINCT FROM n.mtime_ns OR o.ino IS DISTINCT FROM n.ino)"""

SQL = {
    "p1_found": "SELECT game_id FROM files WHERE game_id IS NOT NULL GROUP BY game_id HAVING count(*) * 50 >= (SELECT count(*) FROM files)",
    "p1_game_profile": """SELECT f.game_id, count(*) AS file_rows, CAST(sum(size) AS BIGINT) AS bytes, max(size) AS largest,
        max(mtime_ns) AS newest_ns, max(g.launcher) AS launcher
        FROM files f LEFT JOIN (SELECT id, arg_max(launcher, rec_no) AS launcher FROM games GROUP BY id) g ON g.id = f.game_id GROUP BY f.game_id""",
    "p4_found": f"WITH {_P4} SELECT * FROM orphans",
    "p4_by_period": f"WITH {_P4} SELECT tbl, ref_month, reason, count(*) AS ids FROM orphans GROUP BY ALL",
    "p4_composite": """WITH refs AS (SELECT DISTINCT game_id, kind FROM activity), whole AS (
          SELECT game_id, kind, 'missing' AS reason FROM refs r WHERE game_id IS NOT NULL AND kind IS NOT NULL AND NOT EXISTS (SELECT 1 FROM jobs j WHERE j.game_id = r.game_id AND j.kind = r.kind)),
        part AS (SELECT game_id, kind FROM refs WHERE (game_id IS NULL) <> (kind IS NULL))
        SELECT 'simple' AS match, * FROM whole UNION ALL SELECT 'full', * FROM whole UNION ALL SELECT 'full', game_id, kind, 'partial' FROM part UNION ALL SELECT 'partial', * FROM whole
        UNION ALL SELECT 'partial', game_id, kind, 'missing' FROM part r WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.game_id = r.game_id OR j.kind = r.kind)""",
    "p5_found": f"WITH {_P5} SELECT * FROM changes",
    "p5_by_game": f"""WITH {_P5} SELECT snap_no, game_id, count(CASE WHEN change_kind = 'added' THEN 1 END) AS added,
        count(CASE WHEN change_kind = 'removed' THEN 1 END) AS removed, count(CASE WHEN change_kind = 'changed' THEN 1 END) AS changed
        FROM changes GROUP BY ALL""",
}
