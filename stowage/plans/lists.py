"""Queries of other programs' lists and of job queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.operators import queues as Q
from stowage.plans import reference as R
from stowage.plans.reference import _jobs, discovered_entries
from stowage.session import table
from stowage.sources import lists as L
from stowage.sources import text as X
from stowage.streaming import jobs as SJ
from stowage.streaming import observer

JOB = "id long, game_id string, kind string, state string, user_paused boolean, files_total int, elapsed long"


def _quoted(column):
    return F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(column, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))


def installed_lists(spark, d):
    """Entries in the layouts that lists come in: an array under `installed`, an array, and an object by key."""
    e = discovered_entries(spark, d).where("path is not null")
    item = F.struct("title", F.col("path").alias("install_path"), F.when(F.col("raw_id") % 2 == 0, F.concat(F.lit("app"), F.col("raw_id").cast("string"))).alias("appName"), F.col("version"), F.col("size").alias("install_size"))
    one = F.to_json(item)
    text = F.when(F.col("raw_id") % 3 == 0, F.concat(F.lit('{"installed": ['), one, F.lit("]}"))).when(F.col("raw_id") % 3 == 1, F.concat(F.lit(" ["), one, F.lit("]"))).otherwise(F.concat(F.lit('{"key'), F.col("raw_id").cast("string"), F.lit('": '), one, F.lit("}")))
    return L.installed_entries(e.select("raw_id", text.alias("text")), "raw_id", "text").drop("ord")


def store_items(spark, d):
    """Items with fields missing, that are no application, or incomplete, by turns."""
    e, n = discovered_entries(spark, d), F.col("raw_id")
    item = F.struct(F.when(n % 7 != 0, F.concat(F.lit("app"), n.cast("string"))).alias("AppName"), F.when(n % 11 != 0, F.col("title")).alias("DisplayName"), F.col("path").alias("InstallLocation"), F.col("version").alias("AppVersionString"), F.when(n % 5 == 0, n % 2 == 0).alias("bIsApplication"), F.when(n % 3 == 0, True).alias("bIsIncompleteInstall"))
    return L.item_manifests(e.select("raw_id", F.to_json(item).alias("text")), "raw_id", "text")


def set_aside(spark, d):
    """Documents that may be read as JSON, are too large, or corrupt."""
    raw = F.when(F.col("raw_id") % 13 == 0, F.expr("left(raw, length(raw) - 2)")).otherwise(F.col("raw"))
    return table(spark, d, "raw_games").select("source", L.document_status(raw, 200).alias("status")).groupBy("source", "status").agg(F.count(F.lit(1)).alias("documents"))


def library_lists(spark, d):
    """Library lists in the nested and the flat form, with the root before them."""
    path = _quoted(F.trim("path"))
    nested = F.concat(F.lit('"LibraryFolders"\n{\n  "0"\n  {\n    "path"  '), path, F.lit('\n    "label" ""\n  }\n}\n'))
    flat = F.concat(F.lit('"libraryfolders" {\n // old form\n "TimeNextStatsReport" "1"\n "1" '), path, F.lit(' "2" "/srv/root/" }'))
    texts = table(spark, d, "games").where("path is not null").select("rec_no", F.when(F.col("rec_no") % 2 == 0, nested).otherwise(flat).alias("text"))
    return L.library_folders(X.key_values(texts, "rec_no", "text"), "rec_no", F.lit("/srv/root"))


def running_app(spark, d):
    """The first registry text that names a running app."""
    number = F.when(F.col("rec_no") % 50 == 49, F.col("rec_no") * 10).otherwise(0)
    text = F.concat(F.lit('"Registry" { "HKCU" { "Software" { "Valve" { "runningappid" "'), number.cast("string"), F.lit('" "Language" "english" } } } }'))
    return L.running_app(X.key_values(table(spark, d, "games").select("rec_no", text.alias("text")), "rec_no", "text"), "rec_no")


def manifest_chains(spark, d):
    """Values at the end of a chain of names, and found by name at any depth, as numbers."""
    texts = table(spark, d, "documents").where("kind = 'manifest' and text is not null").select("doc_id", "text")
    entries = X.key_values(texts, "doc_id", "text")
    size = L.value_at(entries, "doc_id", "AppState", "SizeOnDisk").select("doc_id", F.col("value").try_cast("bigint").alias("size"))
    build = L.value_by_name(entries, "doc_id", "BUILDID").select("doc_id", F.col("value").try_cast("bigint").alias("build"))
    return size.join(build, "doc_id", "full_outer").select("doc_id", "size", "build")


def _stored_jobs(spark: SparkSession, d: str) -> DataFrame:
    rows = _jobs(spark, d).groupBy("id").agg(F.max("game_id").alias("game_id"), F.max("kind").alias("kind"), F.max("state").alias("state"), F.max("started").alias("started"), F.max("finished").alias("finished"))
    state = F.when((F.col("state") == "cancelled") & (F.col("id") % 4 == 0), "paused").otherwise(F.col("state"))
    return rows.select("id", "game_id", "kind", state.alias("state"), (F.col("id") % 2 == 0).alias("user_paused"), (F.col("id") % 3).cast("int").alias("files_total"), F.coalesce(F.col("finished") - F.col("started"), F.lit(0).cast("long")).alias("elapsed"))


def queue_opened(spark, d):
    """The stored queue as it is opened; every 37th text is damaged."""
    rows = _stored_jobs(spark, d).select("id", F.to_json(F.struct("*")).alias("data"))
    rows = rows.withColumn("data", F.when(F.col("id") % 37 == 0, F.expr("left(data, length(data) - 3)")).otherwise(F.col("data")))
    started = ~(F.col("user_paused") & (F.col("files_total") == 0) & (F.col("elapsed") == 0))
    return Q.opened(rows, "id", "data", JOB, "state", started).select("place", "id", "game_id", "kind", "state")


def queue_shortened(spark, d):
    return Q.shortened(_stored_jobs(spark, d), "id", ["game_id", "kind"], "state").select("id", "game_id", "kind", "state")


def _events(spark: SparkSession, d: str) -> DataFrame:
    """What each job's worker told, made from how the job ended."""
    rows = _jobs(spark, d).groupBy("id").agg(F.max("kind").alias("kind"), F.max("state").alias("state"), F.max("error").alias("error"))
    event = lambda seq, name, test, message=None: F.when(test, F.struct(F.lit(seq).alias("seq"), F.lit(name).alias("event"), (F.lit(None).cast("string") if message is None else message).alias("message")))
    state, n, yes = F.col("state"), F.col("id"), F.col("state") != "queued"
    ended = [event(7, "done", state == "completed"), event(7, "done", state == "partial", F.lit("some files failed")), event(7, "done", state == "cancelled"), event(7, "failed", state == "failed", F.coalesce("error", F.lit("")))]
    all_ = F.array(event(0, "started", yes), event(1, "warning", yes & (n % 3 == 0), F.lit("a file is locked")), event(2, "paused", yes & (n % 5 == 0)), event(3, "cancel", state == "cancelled"), event(4, "paused", state == "cancelled"), event(5, "resumed", yes & (n % 5 == 0)), event(6, "cancel", state == "interrupted"), *ended)
    return rows.select(F.col("id").alias("job"), "kind", F.explode(F.filter(all_, lambda e: e.isNotNull())).alias("e")).select("job", "kind", "e.*")


def job_phases(spark, d):
    """Each job's phase by its worker's events."""
    found = Q.folded_events(_events(spark, d), "job", "seq", "event", "kind", "message")
    return found.select("job", "phase", F.col("events").cast("long").alias("events"), F.size("errors").cast("long").alias("warnings"))


def due_stream(spark, d):
    """Scans of the game records as a stream: which installs are due."""
    observer.use_state_store(spark)
    games = spark.readStream.schema(table(spark, d, "games").schema).parquet(f"{d}/games.parque[t]")
    at = F.col("loaded_at") < F.lit("2024-06-01").cast("timestamp_ntz")
    scans = games.select(F.col("id").alias("game"), F.when(at, F.lit(0).cast("long")).otherwise(F.col("rec_no")).alias("scan"), F.col("build_at_compress").alias("build"), F.col("forgotten_at").isNull().alias("idle"), (F.col("level") > 3).alias("enabled"), (F.col("launcher") == "manual").alias("tool"))
    return observer.finished(SJ.due_installs(scans.where("scan > 0")))


FUNCTIONS = [installed_lists, store_items, set_aside, library_lists, running_app, manifest_chains, queue_opened, queue_shortened, job_phases, due_stream]
QUERIES = {f.__name__: f for f in FUNCTIONS}

_E = f"({R.SQL['discovered_entries']})"
_ABS = "(starts_with(path, '/') OR regexp_matches(path, '^[A-Za-z]:[/\\\\]'))".replace("\\\\\\\\", "\\\\")
_ST = """(SELECT id, game_id, kind, CASE WHEN state = 'cancelled' AND id % 4 = 0 THEN 'paused' ELSE state END AS state, started0 FROM (
    SELECT id, max(game_id) AS game_id, max(kind) AS kind, max(state) AS state, NOT (id % 2 = 0 AND id % 3 = 0 AND coalesce(max(finished) - max(started), 0) = 0) AS started0 FROM jobs GROUP BY id))"""
_ACTIVE = "('queued', 'analyzing', 'running', 'pausing', 'paused', 'cancelling')"
SQL = {
    "installed_lists": f"""SELECT raw_id, CASE WHEN raw_id % 2 = 0 THEN 'app' || raw_id WHEN raw_id % 3 = 2 THEN 'key' || raw_id ELSE path END AS id, title, path, version AS build, size FROM {_E} WHERE path IS NOT NULL AND {_ABS}""",
    "store_items": f"""SELECT raw_id, CASE WHEN w IS NULL THEN 'app' || raw_id END AS id, CASE WHEN w IS NULL THEN title END AS title, CASE WHEN w IS NULL THEN path END AS path, CASE WHEN w IS NULL THEN version END AS build,
        CASE WHEN w IS NULL THEN CASE WHEN raw_id % 3 = 0 THEN 'busy' ELSE 'idle' END END AS state, w AS warning FROM (SELECT *, CASE WHEN raw_id % 7 = 0 THEN 'Missing AppName' WHEN raw_id % 11 = 0 OR title IS NULL THEN 'Missing DisplayName'
        WHEN path IS NULL THEN 'Missing InstallLocation' WHEN NOT {_ABS} THEN 'Relative path' END AS w FROM {_E}) WHERE NOT (raw_id % 5 = 0 AND raw_id % 2 <> 0)""",
    "set_aside": """SELECT source, CASE WHEN octet_length(encode(t)) > 200 THEN 'large' WHEN NOT json_valid(t) THEN 'corrupt' ELSE 'read' END AS status, count(*) AS documents
        FROM (SELECT source, CASE WHEN raw_id % 13 = 0 THEN left(raw, length(raw) - 2) ELSE raw END AS t FROM raw_games) GROUP BY ALL""",
    "library_lists": f"""SELECT rec_no, 0 AS place, '/srv/root' AS folder FROM games WHERE path IS NOT NULL UNION ALL
        SELECT rec_no, 1, {R._FOLDER.removeprefix('lower').format('path')} FROM games WHERE path IS NOT NULL""",
    "running_app": "SELECT rec_no, rec_no * 10 AS app FROM games WHERE rec_no % 50 = 49 ORDER BY rec_no LIMIT 1",
    "manifest_chains": f"""SELECT doc_id, TRY_CAST(sizeondisk AS BIGINT) AS size, TRY_CAST(buildid AS BIGINT) AS build FROM ({R.SQL['app_manifests']}) WHERE sizeondisk IS NOT NULL OR buildid IS NOT NULL""",
    "queue_opened": f"""SELECT CAST(row_number() OVER (ORDER BY id) AS INTEGER) AS place, id, game_id, kind, CASE WHEN state IN {_ACTIVE} AND state <> 'queued' AND NOT (state = 'paused' AND NOT started0) THEN 'interrupted' ELSE state END AS state
        FROM (SELECT * FROM {_ST} ORDER BY id DESC LIMIT 500) WHERE id % 37 <> 0""",
    "queue_shortened": f"""WITH s AS {_ST} SELECT id, game_id, kind, state FROM s WHERE state IN {_ACTIVE} QUALIFY row_number() OVER (PARTITION BY game_id, kind ORDER BY id) = 1
        UNION ALL SELECT id, game_id, kind, state FROM (SELECT * FROM s WHERE state NOT IN {_ACTIVE} ORDER BY state IN ('completed', 'cancelled'), id DESC LIMIT 1000)""",
    "job_phases": """SELECT id AS job, CASE state WHEN 'completed' THEN 'completed' WHEN 'partial' THEN 'partial' WHEN 'cancelled' THEN 'cancelled' WHEN 'interrupted' THEN 'cancelling' WHEN 'failed' THEN CASE WHEN contains(coalesce(error, ''), 'another pass holds the lock') THEN 'queued' ELSE 'failed' END
          ELSE CASE WHEN kind = 'analyze' THEN 'analyzing' ELSE 'running' END END AS phase,
        CAST(1 + (CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END) + (CASE WHEN id % 5 = 0 THEN 2 ELSE 0 END) + (CASE WHEN state = 'cancelled' THEN 2 WHEN state = 'interrupted' THEN 1 ELSE 0 END) + (CASE WHEN state IN ('completed', 'partial', 'cancelled', 'failed') THEN 1 ELSE 0 END) AS BIGINT) AS events,
        CAST(CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS warnings FROM (SELECT id, max(kind) AS kind, max(state) AS state, max(error) AS error FROM jobs GROUP BY id) WHERE state <> 'queued'""",
    "due_stream": """SELECT game, scan, enabled AND idle AND NOT tool AND (NOT seen OR (was_enabled AND (before IS DISTINCT FROM build OR NOT was_idle))) AS due FROM (
        SELECT id AS game, rec_no AS scan, build_at_compress AS build, forgotten_at IS NULL AS idle, level > 3 AS enabled, launcher = 'manual' AS tool, lag(rec_no) OVER w IS NOT NULL AS seen, lag(build_at_compress) OVER w AS before, lag(forgotten_at IS NULL) OVER w AS was_idle, lag(level > 3) OVER w AS was_enabled
        FROM games WHERE loaded_at >= TIMESTAMP '2024-06-01' WINDOW w AS (PARTITION BY id ORDER BY rec_no))""",
}
