"""Queries of decisions, orders, unions and totals over the storage tool's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.functions import decide, texts
from stowage.functions.costs import quotient, saturating_sum
from stowage.operators import discovery as D
from stowage.operators import paths as P
from stowage.operators import state as S
from stowage.plans import reference as R
from stowage.plans.reference import _folders, _games, _jobs, app_manifests
from stowage.session import table

LONG = "long"
HOME = "/home/player"


def _flags(spark: SparkSession, d: str) -> DataFrame:
    """Apps of the manifests with their flags; every seventh has bytes to transfer."""
    rows = app_manifests(spark, d).select("doc_id", F.col("appid").try_cast("bigint").alias("appid"), "name", F.col("stateflags").try_cast("int").alias("flags"), "installdir", F.col("sizeondisk").try_cast("bigint").alias("size"))
    return rows.where("flags is not null").withColumn("pending", F.when(F.col("doc_id") % 7 == 0, 95).otherwise(0).cast(LONG))


def app_states(spark, d):
    rows = _flags(spark, d).withColumn("s", decide.install_state(F.col("flags"), F.col("pending"), F.col("doc_id") % 11 == 0))
    return rows.select("doc_id", "flags", "s.state", "s.reason", decide.settled(F.col("flags"), F.col("pending")).alias("settled"))


def tool_filter(spark, d):
    """Titles of all lists that are no tools, with tools put among them."""
    titles = table(spark, d, "games").select(F.lit(0).cast(LONG).alias("app"), "title").unionAll(table(spark, d, "games").select(F.lit(0).cast(LONG), F.concat(F.lit("Proton "), F.col("rec_no").cast("string"))))
    titles = titles.unionAll(_flags(spark, d).select("appid", "name")).unionAll(spark.createDataFrame([(228980, "x"), (5, "Protonwar"), (6, "Proton Hotfix"), (7, "Steam Linux Runtime 3.0")], "app long, title string")).distinct()
    return titles.select("app", "title", decide.is_tool(F.col("app"), F.col("title")).alias("tool"))


def folder_refusals(spark, d):
    rows = table(spark, d, "games").select("rec_no", F.col("path")).unionAll(spark.createDataFrame([(-1, "/"), (-2, "/home"), (-3, "/home/someone"), (-4, "/games/../etc"), (-5, "rel/x"), (-6, HOME), (-7, "C:/"), (-8, "/homes/x"), (-9, None)], "rec_no long, path string"))
    return rows.select("rec_no", texts.refused_folder(P.normal_path(F.trim("path")), F.lit(HOME)).alias("why"))


def active_jobs(spark, d):
    """Active jobs of each game, all of them, and whether there is room for more."""
    rows = _jobs(spark, d).groupBy("game_id").agg(F.count_if(F.col("state").isin(*decide.ACTIVE)).alias("active"), F.count(F.lit(1)).alias("jobs"))
    return rows.withColumn("room", F.col("active") < 2)


def storage_tiers(spark, d):
    """Tier of each record by the file system that its backend stands for."""
    kind = F.when(F.col("backend") == "btrfs", "btrfs").when(F.col("backend") == "pack", "ext4").when(F.col("backend") == "wof", "ntfs").otherwise("zfs")
    return _games(spark, d).select("id", kind.alias("kind"), decide.storage_tier(kind, F.col("level") == 3).alias("tier"))


def preset_plan(spark, d):
    levels = decide.preset_levels(F.col("preset"), F.when(F.col("level") == 15, F.lit(15)))
    return _games(spark, d).withColumn("p", levels).select("id", "p.low", "p.high", (F.col("level") >= F.col("p.low")).alias("reached"))


def estimate_confidence(spark, d):
    """Confidence of an estimate that saw a part of each game's bytes and files."""
    rows = _games(spark, d).select("id", "install_bytes", quotient(F.col("install_bytes"), F.lit(64) + F.col("rec_no") % 4000).alias("sampled"), (F.col("rec_no") % 40).alias("inspected"), (F.col("rec_no") % 90).alias("considered"))
    return rows.select("id", decide.coverage(F.col("sampled"), F.col("install_bytes")).alias("bps"), decide.confidence(F.col("inspected"), F.col("considered"), F.col("sampled"), F.col("install_bytes")).alias("confidence"))


def space_needs(spark, d):
    """Needs of each volume against its free space, which is the sum of what was saved there: headroom, shortfall, and bounds."""
    rows = _games(spark, d).withColumn("volume", F.regexp_extract(P.normal_path(F.trim("path")), r"^(/[^/]*|[A-Za-z]:)", 1))
    sums = rows.groupBy("volume").agg(saturating_sum(F.col("install_bytes")).alias("need"), saturating_sum(F.col("est_saving")).alias("free"), F.max("install_bytes").alias("largest"))
    room = decide.headroom(F.col("need"))
    return sums.select("volume", "need", room.alias("headroom"), F.greatest(F.col("need") + room - F.col("free"), F.lit(0).cast(LONG)).alias("shortfall"), (F.col("need") + F.col("largest")).alias("native_need"), decide.store_bound(F.col("need"), F.lit(0).cast(LONG)).alias("store_need"))


def texts_of_totals(spark, d):
    rows = _games(spark, d).groupBy("launcher").agg(F.count(F.lit(1)).alias("n"), F.sum("install_bytes").alias("bytes"), (F.max("compressed_at") - F.min("compressed_at")).alias("seconds"))
    return rows.select("launcher", texts.counted(F.col("n"), "game", "games").alias("games"), texts.byte_size(F.col("bytes")).alias("size"), texts.duration(F.col("seconds") % 100_000).alias("span"))


def clean_messages(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2(texts.printable(F.col("text")), 256).alias("hash"))


def key_forms(spark, d):
    """Forms of the keys behind the launcher: places in lists, hex digests, manifests named by them."""
    keys = table(spark, d, "games").select("id", F.substring_index("id", ":", -1).alias("key")).distinct()
    hashed = F.sha2("id", 256)
    return keys.select("id", texts.index_like(F.col("key")).alias("place"), texts.is_hex(hashed, 64).alias("hash64"), texts.is_hex(F.substring(hashed, 1, 40), 64).alias("hash40"), texts.manifest_app(F.concat(F.lit("appmanifest_"), "key", F.lit(".ACF"))).alias("app"))


def retry_times(spark, d):
    """When each failed job is tried again: by the failures of its game so far."""
    failed = _jobs(spark, d).where("state = 'failed' and finished is not null and game_id is not null").groupBy("id", "game_id").agg(F.max("finished").alias("finished"))
    bucket = F.call_function("div", F.col("finished"), F.lit(86400).cast(LONG))
    tries = S.running_totals(failed, ["game_id"], [F.col("finished").asc(), F.col("id").asc()], bucket, F.lit(1).cast(LONG), "tries")
    return tries.select("id", "tries", (F.col("finished") + decide.backoff(F.col("tries"))).alias("next_at"))


def _ranked(spark, d):
    """Records by worth: to gain first, then unknown, then done, then unsupported."""
    saved = F.greatest(F.col("disk_before") - F.col("disk_after"), F.lit(0).cast(LONG))
    unsupported, done, gain = F.col("backend") == "wof", F.col("forgotten_at").isNull(), F.col("est_saving") > 0
    zero = F.lit(0).cast(LONG)
    rank = F.when(unsupported, zero).when(done, saved).when(gain, F.col("est_saving")).otherwise(F.coalesce("install_bytes", zero))
    return _games(spark, d).select("id", "title", "install_bytes", F.when(unsupported, 3).when(done, 2).when(gain, 0).otherwise(1).alias("grp"), rank.alias("rank"))


def worth_order(spark, d):
    """The 200 first by worth, size and name; the order itself is in `place`."""
    rows = _ranked(spark, d)
    orders = {"worth": [F.col("grp").asc(), F.col("rank").desc(), F.col("title").asc(), F.col("id").asc()], "size": [F.col("install_bytes").desc_nulls_last(), F.col("title").asc(), F.col("id").asc()], "name": [F.lower("title").asc(), F.col("title").asc(), F.col("id").asc()]}
    parts = [S.top_places(rows, 200, order, ["id"]).select(F.lit(name).alias("by"), "place", "id") for name, order in orders.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def worth_groups(spark, d):
    return _ranked(spark, d).groupBy("grp").agg(F.count(F.lit(1)).alias("games"), F.sum("rank").cast(LONG).alias("total"))


def newest_compressed(spark, d):
    return S.top_places(_games(spark, d), 100, [F.col("compressed_at").desc(), F.col("id").asc()], ["id"])


def forgotten_order(spark, d):
    rows = table(spark, d, "games").where("forgotten_at is not null").groupBy("id").agg(F.min("forgotten_at").alias("at"))
    return S.top_places(rows, 100, [F.col("at").asc(), F.col("id").asc()], ["id"])


def to_analyse(spark, d):
    """The largest games that are still there, unknown to any analysis and not refused; twenty of them."""
    known = _jobs(spark, d).where("kind = 'analyze'").select("game_id")
    rows = S.without(_games(spark, d).where("forgotten_at is null"), known, [("id", "game_id")]).where(texts.refused_folder(P.normal_path(F.trim("path")), F.lit(HOME)).isNull())
    return S.top_places(rows, 20, [F.col("install_bytes").desc(), F.col("id").asc()], ["id"])


def job_errors(spark, d):
    """The first twenty errors of each kind of job, in the order of their jobs."""
    rows = _jobs(spark, d).where("error is not null").select("kind", "id", "error")
    kinds = [r["kind"] for r in rows.select("kind").distinct().limit(1000).collect()]
    parts = [S.top_places(rows.where(F.col("kind").eqNullSafe(k)), 20, [F.col("id").asc(), F.col("error").asc()], ["kind", "id", "error"]) for k in sorted(kinds)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def deepest_first(spark, d):
    """Folders of games by depth, deepest first."""
    rows = _folders(spark, d).where("folder is not null").select("folder").distinct()
    return S.top_places(rows.withColumn("depth", P.depth(F.col("folder"))), 100, [F.col("depth").desc(), F.col("folder").asc()], ["folder"])


def walk_order(spark, d):
    """Files of the smallest games in walk order, by components and not by letters (`a/b` comes before `a-c`)."""
    small = table(spark, d, "games").groupBy("id").agg(F.min("install_bytes").alias("size"))
    small = small.orderBy("size", "id").limit(50).select(F.col("id").alias("game_id"))
    rows = table(spark, d, "files").join(small, "game_id").select("game_id", F.hex("relpath").alias("path_hex")).distinct()
    rows = rows.withColumn("parts", P.hex_components(F.col("path_hex")))
    return S.numbered(rows, ["game_id"], [F.col("parts").asc()], F.col("parts")[0], "place").select("game_id", "path_hex", "place")


def kept_from_bad_scan(spark, d):
    """Old entries of a source whose scan had warnings are kept beside the new ones; those of clean scans are gone."""
    rows = table(spark, d, "raw_games").select("source", "raw_id", "seen_at", F.lower(F.get_json_object("raw", "$.title")).alias("title")).where("title is not null")
    at = F.lit("2025-04-01").cast("timestamp_ntz")
    warned = rows.groupBy("source").agg((F.count(F.lit(1)) % 2 == 0).alias("warned"))
    new, old = rows.where(F.col("seen_at") >= at).select("source", "title").distinct(), rows.where(F.col("seen_at") < at).select("source", "title").distinct()
    return S.kept_if(new, old, ["source", "title"], warned, "source", "warned")


def rejected_if_stopped(spark, d):
    """Files that a pass rejected are remembered only if it stopped early: here, where the newest job of the game did not complete."""
    rejected = table(spark, d, "files").where("level_applied = 0").select("game_id", F.hex("relpath").alias("path_hex")).distinct()
    last = S.latest_per(_jobs(spark, d).where("game_id is not null").select("game_id", "id", "state"), ["game_id"], ["id"])
    stopped = last.where("state in ('interrupted', 'cancelled', 'failed')").select("game_id")
    return rejected.join(stopped, "game_id", "left_semi").groupBy("game_id").agg(F.count(F.lit(1)).alias("files"))


def record_lookup(spark, d):
    """What is known of each game: of its install if there is one, else its record, else its newest job."""
    jobs = S.latest_per(_jobs(spark, d).where("game_id != ''").select("game_id", "id", "state"), ["game_id"], ["id"])
    records = _games(spark, d)
    installs = records.where("forgotten_at is null").select("id", F.lit("install").alias("a"))
    ids = records.select("id").unionAll(jobs.select("game_id")).distinct()
    joined = ids.join(installs, "id", "left").join(records.select("id", F.lit("record").alias("b")), "id", "left").join(jobs.select(F.col("game_id").alias("id"), F.concat(F.lit("job:"), "state").alias("c")), "id", "left")
    return joined.select("id", F.coalesce("a", "b", "c").alias("known"))


def current_game(spark, d):
    """Jobs with the title of the game they are for, as it stands now."""
    games = _games(spark, d).where("forgotten_at is null").select(F.col("id").alias("game_id"), "title")
    return _jobs(spark, d).where("finished is null").select("id", "game_id").distinct().join(games, "game_id", "left").select("id", "game_id", "title")


def alias_inheritance(spark, d):
    """Ids of the same folder and launcher whose key ends in a place in a list take the folder's other ids as aliases."""
    rows = _folders(spark, d).where("folder is not null and id is not null").select("folder", "launcher", "id").distinct()
    place = F.substring_index("id", ":", -1).rlike("[0-9]{1,4}$")
    weak = rows.where(place)
    other = rows.select("folder", "launcher", F.col("id").alias("alias"))
    return weak.join(other, ["folder", "launcher"]).where("id != alias").groupBy("id").agg(F.count_distinct("alias").alias("aliases"))


def folder_users(spark, d):
    """Programs that use a game's folder: any of the paths they hold lies in it, also behind their own root."""
    held = table(spark, d, "lutris_games").where("directory is not null").select(F.col("id").alias("pid"), P.normal_path(F.trim("directory"), fold=True).alias("path"))
    both = held.unionAll(held.select("pid", F.regexp_replace("path", "^/(mnt|media)/[^/]+", "")).where("path like '/%'")).where("path != ''").distinct()
    folders = _folders(spark, d).where("folder like '/%'").select(F.regexp_extract("folder", "^(/[^/]+/[^/]+)", 1).alias("folder")).where("folder != ''").distinct()
    return P.under(both, "path", folders, "folder").select("pid", "folder").distinct()


def same_corpus(spark, d):
    """Passes of one game over the same number of files and bytes, which alone may be compared."""
    said = table(spark, d, "activity").select("id", "game_id", F.regexp_extract("message", r"over (\d+) files, ([\d.]+) MiB", 1).alias("files"), F.regexp_extract("message", r"over (\d+) files, ([\d.]+) MiB", 2).alias("mib")).where("files != ''")
    return said.groupBy("game_id", "files", "mib").agg(F.count_distinct("id").alias("passes")).where("passes > 1")


def shared_bytes(spark, d):
    """Bytes of objects with more than two names, by snapshot."""
    rows = table(spark, d, "files").where("size is not null").groupBy("snap_no", "ino", "size").agg(F.count_distinct("game_id", "relpath").alias("links"))
    return rows.groupBy("snap_no").agg(saturating_sum(F.when(F.col("links") > 2, F.col("size"))).alias("shared"), F.count_if(F.col("links") > 2).alias("objects"), F.count(F.lit(1)).alias("all_objects"))


def pass_levels(spark, d):
    """Least level that a pass reached in each game and snapshot (null if nothing was compressed), and bytes by reconciled size."""
    rows = table(spark, d, "files").groupBy("snap_no", "game_id").agg(F.min(F.when(F.col("level_applied") > 0, F.col("level_applied"))).alias("least"), saturating_sum(F.when(F.abs(F.col("size") - F.col("size") % 4096 * 2) > 4096, F.col("size") % 4096).otherwise(F.col("size"))).alias("reconciled"))
    return rows


def running_titles(spark, d):
    """For each kind the title of the first running job by id."""
    jobs = _jobs(spark, d).where("state = 'running' and game_id is not null").groupBy("kind").agg(F.min("id").alias("id"))
    first = _jobs(spark, d).join(jobs, ["kind", "id"]).select("kind", "id", "game_id").distinct()
    return first.join(_games(spark, d).select(F.col("id").alias("game_id"), "title"), "game_id", "left").select("kind", "id", "title")


def tree_stamps(spark, d):
    """A stamp of each game's first hundred files in path order; larger ones are marked as partial."""
    rows = table(spark, d, "files").where("size is not null").groupBy("game_id", F.hex("relpath").alias("path_hex")).agg(F.max("size").alias("size"), F.max("mtime_ns").alias("mtime_ns"))
    return S.stamps(rows, ["game_id"], "path_hex", ["size", "mtime_ns"], 100)


def update_layer(spark, d):
    """Bytes that an update left on top of each game's store, by games whose build changed."""
    return _games(spark, d).where("backend = 'pack'").groupBy("launcher").agg(saturating_sum(F.greatest(F.col("install_bytes") - F.col("disk_after"), F.lit(0).cast(LONG))).alias("bytes"), F.count(F.lit(1)).alias("games"))


def filtered_list(spark, d):
    """Games that a list shows: not excluded, with a word in the title, of a launcher and a drive."""
    rows = _folders(spark, d).where("folder is not null and forgotten_at is null")
    rows = rows.where(F.contains(F.lower("title"), F.lit("er")) & (F.col("launcher") != "manual") & (F.startswith("folder", F.lit("/home")) | F.startswith("folder", F.lit("d:"))))
    return rows.select("rec_no", "id", "title")


def appended_activity(spark, d):
    """Entries that are appended get the next ids, in the order of their own."""
    rows = table(spark, d, "activity").distinct()
    return S.appended(rows.where("kind = 'watch'").select("id", "ts", "kind"), rows.where("kind != 'watch'").select(F.col("id").alias("turn"), "ts", "kind"), "id", ["turn"])


def migrated_games(spark, d):
    """Records of an older schema brought to a newer one: missing columns come with their defaults."""
    old = table(spark, d, "games").where("rec_no % 2 = 0").select("rec_no", "id", "title")
    new = table(spark, d, "games").where("rec_no % 2 = 1").select("rec_no", "id", "title", "build_at_compress", "level")
    return S.migrated(old, {"build_at_compress": F.lit(None).cast("string"), "level": F.lit(0)}).unionByName(new)


def content_reports(spark, d):
    """Reports named by their content, each stored once however often it is saved."""
    rows = table(spark, d, "activity").select(F.lower("level").alias("level"), "kind", "message")
    body = F.concat_ws("|", "level", "kind", "message")
    return rows.select(F.sha2(body, 256).alias("name"), body.alias("body")).groupBy("name").agg(F.min("body").alias("body")).select("name", F.length("body").alias("size"))


def json_results(spark, d):
    """Records as JSON lines, read back to check that nothing is lost."""
    rows = table(spark, d, "games").select("rec_no", "id", "title", "path", "level")
    lines = rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"))
    return lines.select(F.from_json("line", "rec_no long, id string, title string, path string, level int").alias("r")).select("r.*")


def remembered_games(spark, d):
    """Installs of earlier times that are kept beside those seen since: no id or folder again, and the volume as it was or gone."""
    rows = _folders(spark, d).where("folder is not null and id is not null").withColumn("volume", F.regexp_extract("folder", r"^(/[^/]*|[a-z]:)", 1))
    at = F.lit("2024-06-01").cast("timestamp_ntz")
    ids = lambda df: df.groupBy("folder", "volume").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    fresh, before = ids(rows.where(F.col("loaded_at") >= at)), ids(rows.where(F.col("loaded_at") < at))
    online = before.where(F.length("folder") % 3 != 0).select("folder", F.when(F.length("folder") % 5 == 0, "elsewhere").otherwise(F.col("volume")).alias("volume"))
    kept = D.remembered_by_any_id(fresh, before, "folder", "ids", "volume", online)
    return kept.select("folder", F.array_join("ids", "|").alias("ids"), "remembered")


def maintenance_due(spark, d):
    """Which installs are due at each of their reports, with baselines that wait."""
    n = F.col("rec_no")
    scans = table(spark, d, "games").select("id", "rec_no", F.col("build_at_compress").alias("build"), (F.col("level") > 3).alias("enabled"), F.col("forgotten_at").isNull().alias("idle"), (n % 9 == 0).alias("paused"), (n % 11 != 0).alias("healthy"), F.col("backend").alias("drive"), (n > 60).alias("started"))
    return D.due_with_baselines(scans, "id", "rec_no")


def scan_batches(spark, d):
    """What each source's scan had found in all after each day's batch."""
    rows = table(spark, d, "raw_games").select("source", "seen_at", F.lower(F.get_json_object("raw", "$.path")).alias("path")).where("path is not null")
    first = rows.groupBy("source", "path").agg(F.min("seen_at").alias("seen_at")).withColumn("day", F.to_date("seen_at"))
    per = first.groupBy("source", "day").agg(F.count(F.lit(1)).alias("new"))
    total = S.running_totals(per, ["source"], [F.col("day").asc()], F.year("day"), F.col("new"), "before")
    return total.select("source", F.col("day").cast("string").alias("day"), "new", (F.col("before") + F.col("new")).alias("found"))


def latest_estimates(spark, d):
    """The newest estimate of each game, which replaces those before it."""
    rows = table(spark, d, "activity").where("kind = 'estimate' and game_id is not null").select("game_id", "ts", "id", "bytes_delta").distinct()
    return S.latest_per(rows, ["game_id"], ["ts", "id"])


def nested_defaults(spark, d):
    """Documents with parts missing, read with defaults for these."""
    n = F.col("rec_no")
    text = F.to_json(F.struct("id", F.when(n % 3 != 0, F.struct(F.when(n % 2 == 0, F.col("level")).alias("level"), "preset")).alias("options")))
    read = F.from_json(text, "id string, options struct<level:int,preset:string>, errors array<string>")
    rows = table(spark, d, "games").select("rec_no", read.alias("j"))
    return rows.select("rec_no", "j.id", F.coalesce("j.options.level", F.lit(9)).alias("level"), F.coalesce("j.options.preset", F.lit("balanced")).alias("preset"), F.size(F.coalesce("j.errors", F.array().cast("array<string>"))).alias("errors"))


FUNCTIONS = [
    remembered_games, maintenance_due, scan_batches, latest_estimates, nested_defaults,
    app_states, tool_filter, folder_refusals, active_jobs, storage_tiers, preset_plan, estimate_confidence, space_needs, texts_of_totals, clean_messages, key_forms, retry_times,
    worth_order, worth_groups, newest_compressed, forgotten_order, to_analyse, job_errors, deepest_first, walk_order, kept_from_bad_scan, rejected_if_stopped,
    record_lookup, current_game, alias_inheritance, folder_users, same_corpus, shared_bytes, pass_levels, running_titles, tree_stamps, update_layer, filtered_list,
    appended_activity, migrated_games, content_reports, json_results,
]
QUERIES = {f.__name__: f for f in FUNCTIONS}

_LAST = "(SELECT * FROM games QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, rec_no DESC) = 1)"
_JOBS = "(SELECT DISTINCT * FROM jobs)"
_FOLDERS = R._FOLDERS
_NORMAL = R._FOLDER.removeprefix("lower")
_REFUSED = f"""CASE WHEN p IS NULL OR NOT (starts_with(p, '/') OR regexp_matches(p, '^[A-Za-z]:')) THEN 'relative' WHEN list_contains(string_split(p, '/'), '..') THEN 'climbing'
    WHEN p = '/' OR regexp_matches(p, '^[A-Za-z]:/?$') THEN 'root' WHEN starts_with('{HOME}/', p || '/') THEN 'home' WHEN regexp_matches(p, '^(/home|/Users|[A-Za-z]:/Users)(/[^/]*)?$') THEN 'home' END"""
_SIZE = lambda n: f"CASE " + " ".join(f"WHEN {n} >= {1024**k} THEN CAST({n} * 10 // {1024**k} // 10 AS VARCHAR) || '.' || CAST({n} * 10 // {1024**k} % 10 AS VARCHAR) || ' {u}'" for k, u in ((4, 'TiB'), (3, 'GiB'), (2, 'MiB'), (1, 'KiB'))) + f" ELSE CAST({n} AS VARCHAR) || ' B' END"
_FLAG = """(SELECT doc_id, TRY_CAST(appid AS BIGINT) AS appid, name, TRY_CAST(stateflags AS INTEGER) AS flags, CASE WHEN doc_id % 7 = 0 THEN 95 ELSE 0 END AS pending FROM (""" + R.SQL["app_manifests"] + """) WHERE TRY_CAST(stateflags AS INTEGER) IS NOT NULL)"""
_WORK = "CASE " + " ".join(f"WHEN flags & {bit} <> 0 THEN '{name}'" for bit, name in decide.WORKING.items()) + " END"
_WORTH = f"""(SELECT id, title, install_bytes, CASE WHEN backend = 'wof' THEN 3 WHEN forgotten_at IS NULL THEN 2 WHEN est_saving > 0 THEN 0 ELSE 1 END AS grp,
    CAST(CASE WHEN backend = 'wof' THEN 0 WHEN forgotten_at IS NULL THEN greatest(disk_before - disk_after, 0) WHEN est_saving > 0 THEN est_saving ELSE coalesce(install_bytes, 0) END AS BIGINT) AS rank FROM {_LAST})"""


def _top(rows: str, n: int, order: str, columns: str = "id") -> str:
    return f"SELECT CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS place, {columns} FROM {rows} QUALIFY row_number() OVER (ORDER BY {order}) <= {n}"


SQL = {
    "remembered_games": f"""WITH r AS (SELECT folder, id, loaded_at, regexp_extract(folder, '^(/[^/]*|[a-z]:)', 1) AS volume FROM {_FOLDERS} WHERE folder IS NOT NULL),
        f AS (SELECT folder, list_sort(list(DISTINCT id)) AS ids FROM r WHERE loaded_at >= TIMESTAMP '2024-06-01' GROUP BY folder), b AS (SELECT folder, list_sort(list(DISTINCT id)) AS ids FROM r WHERE loaded_at < TIMESTAMP '2024-06-01' GROUP BY folder)
        SELECT folder, array_to_string(ids, '|') AS ids, false AS remembered FROM f UNION ALL SELECT folder, array_to_string(ids, '|'), true FROM b WHERE folder NOT IN (SELECT folder FROM f)
        AND NOT list_has_any(ids, (SELECT list(DISTINCT id) FROM r WHERE loaded_at >= TIMESTAMP '2024-06-01')) AND (length(folder) % 3 = 0 OR length(folder) % 5 <> 0)""",
    "maintenance_due": """WITH RECURSIVE h AS (SELECT id, rec_no, build_at_compress AS build, level > 3 AS enabled, forgotten_at IS NULL AS idle, rec_no % 9 = 0 AS paused, rec_no % 11 <> 0 AS healthy, backend AS drive, rec_no > 60 AS started,
          row_number() OVER (PARTITION BY id ORDER BY rec_no) AS r FROM games),
        s AS (SELECT DISTINCT id, CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS rec_no, false AS has, CAST(NULL AS VARCHAR) AS build, false AS enabled, CAST(NULL AS VARCHAR) AS drive, false AS due FROM games UNION ALL
          SELECT h.id, h.r, h.rec_no, CASE WHEN k.keep THEN s.has ELSE true END, CASE WHEN k.keep THEN s.build ELSE h.build END, CASE WHEN k.keep THEN s.enabled ELSE h.enabled END, CASE WHEN k.keep THEN s.drive ELSE h.drive END, k.due
          FROM s JOIN h ON h.id = s.id AND h.r = s.r + 1, LATERAL (SELECT CASE WHEN s.has AND s.drive IS DISTINCT FROM h.drive THEN false ELSE (s.has AND s.enabled AND s.build IS DISTINCT FROM h.build) OR (NOT s.has AND h.started) END AS wanted) w,
          LATERAL (SELECT NOT h.healthy OR w.wanted AS keep, h.healthy AND w.wanted AND h.enabled AND h.idle AND NOT h.paused AS due) k)
        SELECT id, rec_no, due FROM s WHERE r > 0""",
    "scan_batches": """SELECT source, CAST(day AS VARCHAR) AS day, n AS new, CAST(sum(n) OVER (PARTITION BY source ORDER BY day) AS BIGINT) AS found FROM (SELECT source, CAST(seen_at AS DATE) AS day, count(*) AS n FROM (
        SELECT source, lower(json_extract_string(raw, '$.path')) AS path, min(seen_at) AS seen_at FROM raw_games WHERE json_extract_string(raw, '$.path') IS NOT NULL GROUP BY ALL) GROUP BY ALL)""",
    "latest_estimates": "SELECT game_id, ts, id, bytes_delta FROM (SELECT DISTINCT game_id, ts, id, bytes_delta FROM activity WHERE kind = 'estimate' AND game_id IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY ts DESC, id DESC, bytes_delta DESC) = 1",
    "nested_defaults": "SELECT rec_no, id, CASE WHEN rec_no % 3 <> 0 AND rec_no % 2 = 0 THEN level ELSE 9 END AS level, CASE WHEN rec_no % 3 <> 0 THEN coalesce(preset, 'balanced') ELSE 'balanced' END AS preset, 0 AS errors FROM games",
    "app_states": f"""SELECT doc_id, flags, CASE WHEN running OR work IS NOT NULL OR pending > 0 THEN 'busy' WHEN flags & 160 <> 0 THEN 'broken' WHEN flags & 2 <> 0 THEN 'update pending' WHEN flags & 4 = 0 THEN 'broken' WHEN flags & 64 <> 0 THEN 'busy' ELSE 'idle' END AS state,
        CASE WHEN running THEN 'running' WHEN work IS NOT NULL THEN work WHEN pending > 0 THEN 'transfer' WHEN flags & 32 <> 0 THEN 'files missing' WHEN flags & 128 <> 0 THEN 'files corrupt' WHEN flags & 2 <> 0 THEN NULL WHEN flags & 4 = 0 THEN 'not installed' WHEN flags & 64 <> 0 THEN 'stale running' END AS reason,
        flags & 4 <> 0 AND work IS NULL AND pending <= 0 AS settled FROM (SELECT *, {_WORK} AS work, doc_id % 11 = 0 AS running FROM {_FLAG})""",
    "tool_filter": f"""SELECT app, title, coalesce(app IN {decide.TOOL_IDS}, false) OR coalesce(title IN {decide.TOOL_NAMES} OR regexp_matches(title, '^Proton [0-9]') OR regexp_matches(title, '^Steam Linux Runtime [0-9]'), false) AS tool FROM (
        SELECT CAST(0 AS BIGINT) AS app, title FROM games UNION SELECT 0, 'Proton ' || rec_no FROM games UNION SELECT appid, name FROM {_FLAG} UNION VALUES (228980, 'x'), (5, 'Protonwar'), (6, 'Proton Hotfix'), (7, 'Steam Linux Runtime 3.0'))""",
    "folder_refusals": f"""SELECT rec_no, {_REFUSED} AS why FROM (SELECT rec_no, {_NORMAL.format('path')} AS p FROM (SELECT rec_no, path FROM games
        UNION ALL VALUES (-1, '/'), (-2, '/home'), (-3, '/home/someone'), (-4, '/games/../etc'), (-5, 'rel/x'), (-6, '{HOME}'), (-7, 'C:/'), (-8, '/homes/x'), (-9, NULL)))""",
    "active_jobs": f"SELECT game_id, count(CASE WHEN state IN {decide.ACTIVE} THEN 1 END) AS active, count(*) AS jobs, count(CASE WHEN state IN {decide.ACTIVE} THEN 1 END) < 2 AS room FROM {_JOBS} GROUP BY 1",
    "storage_tiers": f"""SELECT id, kind, CASE WHEN level = 3 THEN 'unsupported' WHEN kind IN ('btrfs') THEN 'native' WHEN kind IN ('ext4', 'zfs') THEN 'pack' ELSE 'unsupported' END AS tier
        FROM (SELECT id, level, CASE backend WHEN 'btrfs' THEN 'btrfs' WHEN 'pack' THEN 'ext4' WHEN 'wof' THEN 'ntfs' ELSE 'zfs' END AS kind FROM {_LAST})""",
    "preset_plan": f"""SELECT id, low, high, level >= low AS reached FROM (SELECT id, level, CASE WHEN level = 15 THEN 15 ELSE CASE preset WHEN 'fast' THEN 3 WHEN 'balanced' THEN 9 WHEN 'max' THEN 9 END END AS low,
        CASE WHEN level = 15 THEN 15 ELSE CASE preset WHEN 'fast' THEN 3 WHEN 'balanced' THEN 9 WHEN 'max' THEN 15 END END AS high FROM {_LAST})""",
    "estimate_confidence": f"""SELECT id, CAST(sampled * 10000 // nullif(install_bytes, 0) AS BIGINT) AS bps, CASE WHEN inspected = 0 OR sampled < 4194304 OR coalesce(sampled * 10000 // nullif(install_bytes, 0), 0) < 5 THEN 'low'
        WHEN (considered > 0 AND inspected * 4 < considered) OR sampled * 10000 // nullif(install_bytes, 0) < 50 THEN 'medium' ELSE 'high' END AS confidence
        FROM (SELECT id, install_bytes, install_bytes // (64 + rec_no % 4000) AS sampled, rec_no % 40 AS inspected, rec_no % 90 AS considered FROM {_LAST})""",
    "space_needs": f"""SELECT volume, need, greatest(need // 20, 67108864) AS headroom, greatest(need + greatest(need // 20, 67108864) - free, 0) AS shortfall, need + largest AS native_need, need + need // 32 + 16777216 AS store_need FROM (
        SELECT regexp_extract({_NORMAL.format('path')}, '^(/[^/]*|[A-Za-z]:)', 1) AS volume, CAST(coalesce(sum(install_bytes), 0) AS BIGINT) AS need, CAST(coalesce(sum(est_saving), 0) AS BIGINT) AS free, max(install_bytes) AS largest FROM {_LAST} GROUP BY 1)""",
    "texts_of_totals": f"""SELECT launcher, n || CASE WHEN n = 1 THEN ' game' ELSE ' games' END AS games, {_SIZE('bytes')} AS size, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' END AS span
        FROM (SELECT launcher, count(*) AS n, CAST(sum(install_bytes) AS HUGEINT) AS bytes, (max(compressed_at) - min(compressed_at)) % 100000 AS s FROM {_LAST} GROUP BY 1)""",
    "clean_messages": r"SELECT doc_id, sha256(regexp_replace(text, '[\x00-\x1F\x7F]', ' ', 'g')) AS hash FROM documents WHERE text IS NOT NULL",
    "key_forms": r"""SELECT id, regexp_matches(key, '^[0-9]{1,4}$') AS place, true AS hash64, false AS hash40, CASE WHEN regexp_matches(key, '^[0-9]{1,10}$') AND CAST(key AS BIGINT) < 4294967296 THEN CAST(key AS BIGINT) END AS app
        FROM (SELECT DISTINCT id, regexp_replace(id, '^.*:', '') AS key FROM games)""",
    "retry_times": f"""SELECT id, tries, finished + least(CAST(pow(2, least(tries, 9)) AS BIGINT), 300) AS next_at FROM (SELECT id, finished, count(*) OVER (PARTITION BY game_id ORDER BY finished, id) - 1 AS tries
        FROM (SELECT id, game_id, max(finished) AS finished FROM {_JOBS} WHERE state = 'failed' AND finished IS NOT NULL AND game_id IS NOT NULL GROUP BY ALL))""",
    "worth_order": f"""SELECT 'worth' AS by, * FROM ({_top(_WORTH, 200, 'grp, rank DESC, title, id')}) UNION ALL SELECT 'size', * FROM ({_top(_WORTH, 200, 'install_bytes DESC NULLS LAST, title, id')})
        UNION ALL SELECT 'name', * FROM ({_top(_WORTH, 200, 'lower(title), title, id')})""",
    "worth_groups": f"SELECT grp, count(*) AS games, CAST(sum(rank) AS BIGINT) AS total FROM {_WORTH} GROUP BY 1",
    "newest_compressed": _top(_LAST, 100, "compressed_at DESC, id"),
    "forgotten_order": _top("(SELECT id, min(forgotten_at) AS gone FROM games WHERE forgotten_at IS NOT NULL GROUP BY 1)", 100, "gone, id"),
    "to_analyse": _top(f"(SELECT * FROM (SELECT *, {_NORMAL.format('path')} AS p FROM {_LAST}) l WHERE forgotten_at IS NULL AND NOT EXISTS (SELECT 1 FROM jobs j WHERE j.kind = 'analyze' AND j.game_id = l.id) AND {_REFUSED} IS NULL)", 20, "install_bytes DESC, id"),
    "job_errors": f"""SELECT CAST(row_number() OVER w AS INTEGER) AS place, kind, id, error FROM {_JOBS} WHERE error IS NOT NULL WINDOW w AS (PARTITION BY kind ORDER BY id, error) QUALIFY row_number() OVER w <= 20""",
    "deepest_first": _top(f"(SELECT DISTINCT folder, len(list_filter(string_split(folder, '/'), lambda c: c <> '')) AS depth FROM {_FOLDERS} WHERE folder IS NOT NULL)", 100, "depth DESC, folder", "folder"),
    "walk_order": r"""SELECT game_id, path_hex, row_number() OVER (PARTITION BY game_id ORDER BY list_transform(string_split(regexp_replace(path_hex, '(..)', '\1 ', 'g'), '2F '), lambda c: c)) AS place FROM (
        SELECT DISTINCT game_id, hex(relpath) AS path_hex FROM files WHERE game_id IN (SELECT id FROM (SELECT id, min(install_bytes) AS size FROM games GROUP BY 1 ORDER BY size NULLS FIRST, id LIMIT 50)))""",
    "kept_from_bad_scan": """WITH r AS (SELECT source, seen_at, lower(json_extract_string(raw, '$.title')) AS title FROM raw_games WHERE json_extract_string(raw, '$.title') IS NOT NULL),
        n AS (SELECT DISTINCT source, title FROM r WHERE seen_at >= TIMESTAMP '2025-04-01'), o AS (SELECT DISTINCT source, title FROM r WHERE seen_at < TIMESTAMP '2025-04-01'), w AS (SELECT source FROM r GROUP BY 1 HAVING count(*) % 2 = 0)
        SELECT *, false AS kept FROM n UNION ALL SELECT *, true FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.source = o.source AND n.title = o.title) AND source IN (SELECT source FROM w)""",
    "rejected_if_stopped": f"""SELECT game_id, count(*) AS files FROM (SELECT DISTINCT game_id, relpath FROM files WHERE level_applied = 0) WHERE game_id IN (
        SELECT game_id FROM (SELECT DISTINCT game_id, id, state FROM jobs WHERE game_id IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY id DESC, state DESC) = 1 AND state IN ('interrupted', 'cancelled', 'failed')) GROUP BY 1""",
    "record_lookup": f"""WITH j AS (SELECT game_id, state FROM (SELECT DISTINCT game_id, id, state FROM jobs WHERE game_id <> '') QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY id DESC, state DESC) = 1), g AS {_LAST}
        SELECT i.id, CASE WHEN g.id IS NOT NULL AND g.forgotten_at IS NULL THEN 'install' WHEN g.id IS NOT NULL THEN 'record' ELSE 'job:' || j.state END AS known
        FROM (SELECT id FROM g UNION SELECT game_id FROM j) i LEFT JOIN g ON g.id = i.id LEFT JOIN j ON j.game_id = i.id""",
    "current_game": f"SELECT j.id, j.game_id, title FROM (SELECT DISTINCT id, game_id FROM jobs WHERE finished IS NULL) j LEFT JOIN (SELECT * FROM {_LAST} WHERE forgotten_at IS NULL) g ON g.id = j.game_id",
    "alias_inheritance": f"""WITH r AS (SELECT DISTINCT folder, launcher, id FROM {_FOLDERS} WHERE folder IS NOT NULL)
        SELECT a.id, count(DISTINCT b.id) AS aliases FROM r a JOIN r b ON a.folder = b.folder AND a.launcher = b.launcher AND a.id <> b.id
        WHERE regexp_matches(a.id, '[0-9]{{1,4}}$') GROUP BY 1""",
    "folder_users": f"""WITH h AS (SELECT id AS pid, {R._FOLDER.format('directory')} AS path FROM lutris_games WHERE directory IS NOT NULL),
        p AS (SELECT * FROM h UNION SELECT pid, regexp_replace(path, '^/(mnt|media)/[^/]+', '') FROM h WHERE starts_with(path, '/')),
        f AS (SELECT DISTINCT regexp_extract(folder, '^(/[^/]+/[^/]+)', 1) AS folder FROM {_FOLDERS} WHERE starts_with(folder, '/'))
        SELECT DISTINCT pid, folder FROM p JOIN f ON f.folder <> '' AND p.path <> '' AND (p.path = f.folder OR starts_with(p.path, f.folder || '/'))""",
    "same_corpus": r"""SELECT game_id, files, mib, count(DISTINCT id) AS passes FROM (SELECT id, game_id, regexp_extract(message, 'over ([0-9]+) files, ([0-9.]+) MiB', 1) AS files, regexp_extract(message, 'over ([0-9]+) files, ([0-9.]+) MiB', 2) AS mib FROM activity)
        WHERE files <> '' GROUP BY ALL HAVING count(DISTINCT id) > 1""",
    "shared_bytes": """SELECT snap_no, CAST(coalesce(sum(CASE WHEN links > 2 THEN size END), 0) AS BIGINT) AS shared, count(CASE WHEN links > 2 THEN 1 END) AS objects, count(*) AS all_objects
        FROM (SELECT snap_no, ino, size, count(DISTINCT (game_id, relpath)) AS links FROM files WHERE size IS NOT NULL GROUP BY ALL) GROUP BY 1""",
    "pass_levels": """SELECT snap_no, game_id, min(CASE WHEN level_applied > 0 THEN level_applied END) AS least, CAST(coalesce(sum(CASE WHEN abs(size - size % 4096 * 2) > 4096 THEN size % 4096 ELSE size END), 0) AS BIGINT) AS reconciled FROM files GROUP BY ALL""",
    "running_titles": f"""SELECT kind, r.id, title FROM (SELECT DISTINCT kind, id, game_id FROM jobs WHERE (kind, id) IN (SELECT (kind, min(id)) FROM jobs WHERE state = 'running' AND game_id IS NOT NULL GROUP BY kind)) r LEFT JOIN {_LAST} g ON g.id = r.game_id""",
    "tree_stamps": """SELECT game_id, max(n) AS files, CASE WHEN max(n) > 100 THEN 'partial:100:' ELSE '' END || sha256(string_agg(path_hex || ':' || size || ':' || coalesce(CAST(mtime_ns AS VARCHAR), '-'), chr(10) ORDER BY path_hex)) AS stamp FROM (
        SELECT *, count(*) OVER (PARTITION BY game_id) AS n, row_number() OVER (PARTITION BY game_id ORDER BY path_hex) AS r FROM (SELECT game_id, hex(relpath) AS path_hex, max(size) AS size, max(mtime_ns) AS mtime_ns FROM files WHERE size IS NOT NULL GROUP BY ALL)) WHERE r <= 100 GROUP BY 1""",
    "update_layer": f"SELECT launcher, CAST(coalesce(sum(greatest(install_bytes - disk_after, 0)), 0) AS BIGINT) AS bytes, count(*) AS games FROM {_LAST} WHERE backend = 'pack' GROUP BY 1",
    "filtered_list": f"SELECT rec_no, id, title FROM {_FOLDERS} WHERE forgotten_at IS NULL AND contains(lower(title), 'er') AND launcher <> 'manual' AND (starts_with(folder, '/home') OR starts_with(folder, 'd:'))",
    "appended_activity": """WITH a AS (SELECT DISTINCT * FROM activity), t AS (SELECT max(id) AS top FROM a WHERE kind = 'watch')
        SELECT (SELECT top FROM t) + row_number() OVER (ORDER BY id) AS id, ts, kind FROM a WHERE kind <> 'watch'""",
    "migrated_games": "SELECT rec_no, id, title, CASE WHEN rec_no % 2 = 1 THEN build_at_compress END AS build_at_compress, CASE WHEN rec_no % 2 = 1 THEN level ELSE 0 END AS level FROM games",
    "content_reports": "SELECT DISTINCT sha256(body) AS name, CAST(length(body) AS INTEGER) AS size FROM (SELECT concat_ws('|', lower(level), kind, message) AS body FROM activity)",
    "json_results": "SELECT rec_no, id, title, path, level FROM games",
}
