"""Queries over the storage tool's tables, one or more for each operator of the core."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stowage.functions import costs, headers
from stowage.operators import chunks as C
from stowage.operators import discovery as D
from stowage.operators import inventory as I
from stowage.operators import paths as P
from stowage.operators import state as S
from stowage.session import table
from stowage.sources import text as X
from stowage.streaming import observer

KEYS = ["snap_no", "game_id", "relpath"]
VALUES = ["loaded_at", "size", "ino", "mtime_ns", "ctime_ns", "level_applied"]


class Snapshots:
    """The snapshots of files: all of them, each compared with the one delivered before it, or only the newest.

    Which numbers there are is read from the table, since numbers skip. The first snapshot has none before it and is compared
    with nothing. Null numbers are no snapshot.
    """

    def __init__(self, spark: SparkSession, d: str, newest: bool):
        files = table(spark, d, "files").select(*KEYS, *VALUES)
        numbers = sorted(r[0] for r in files.select("snap_no").where("snap_no is not null").distinct().collect())
        pairs = list(zip(numbers, numbers[1:]))
        if newest:
            numbers, pairs = numbers[-1:], pairs[-1:]
        earlier, self.compared = [a for a, _ in pairs], [b for _, b in pairs]
        #: Rows as delivered.
        self.rows = files.where(F.col("snap_no").isin(numbers))
        #: The row that holds for each file.
        self.now = self._held(self.rows)
        #: The same of the snapshots that have one before them, and of those before, under the number of the later one.
        self.later = self._held(files.where(F.col("snap_no").isin(self.compared)))
        number = F.try_element_at(F.create_map(*[F.lit(n) for pair in pairs for n in pair]), F.col("snap_no")) if pairs else F.col("snap_no")
        self.before = self._held(files.where(F.col("snap_no").isin(earlier)).withColumn("snap_no", number))

    @staticmethod
    def _held(files: DataFrame) -> DataFrame:
        return I.latest_rows(files, KEYS, ["loaded_at"], VALUES)


def by_snapshot(query):
    """A query of the newest snapshot, from one of `Snapshots` that tells them by snap_no; `each` runs it over all of them."""

    @wraps(query)
    def newest(spark, d):
        return query(Snapshots(spark, d, newest=True)).drop("snap_no")

    @wraps(query)
    def each(spark, d):
        return query(Snapshots(spark, d, newest=False))

    newest.each = each
    return newest


def _games(spark: SparkSession, d: str) -> DataFrame:
    return S.latest_per(table(spark, d, "games"), ["id"], ["loaded_at", "rec_no"])


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").distinct()


def _folders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "games").withColumn("folder", P.normal_path(F.trim("path"), fold=True))


# inventory

@by_snapshot
def inventory_floor(s):
    rows = s.now.withColumn("action", I.action(F.col("size"))).withColumn("store_action", I.action(F.col("size"), I.STORE_FLOOR))
    return rows.groupBy("snap_no", "action", "store_action").agg(F.count(F.lit(1)).alias("files"), costs.saturating_sum(F.col("size")).alias("bytes"))


@by_snapshot
def changed_since(s):
    return I.changed_since(s.later, s.before, KEYS).select("snap_no", "game_id", F.hex("relpath").alias("path_hex"), "size", "why")


@by_snapshot
def changed_since_floor(s):
    changed = I.changed_since(s.later, s.before, KEYS, level_floor=15, floor=I.STORE_FLOOR)
    return changed.groupBy("snap_no", "game_id", "why").agg(F.count(F.lit(1)).alias("files"), costs.saturating_sum(F.col("size")).alias("bytes"))


@by_snapshot
def recorded_levels(s):
    return I.recorded_levels(s.later, s.before, KEYS).select("snap_no", "game_id", F.hex("relpath").alias("path_hex"), "recorded_level")


@by_snapshot
def receipt_skip(s):
    return I.without_receipt(s.later, s.before, KEYS, 9).groupBy("snap_no", "game_id").agg(F.count(F.lit(1)).alias("files"))


@by_snapshot
def outcome_merge(s):
    now = s.later
    confirmed = now.where("level_applied > 0")
    return I.merged_outcome(now, s.before, confirmed, KEYS).groupBy("snap_no", "game_id", "level").agg(F.count(F.lit(1)).alias("files"))


@by_snapshot
def rejected_skip(s):
    """Files without those rejected before at the same length and time."""
    rejected = s.before.where(F.col("level_applied") == 0)
    on = [("snap_no", "snap_no"), ("game_id", "game_id"), ("relpath", "relpath"), ("size", "size"), ("mtime_ns", "mtime_ns")]
    return S.without(s.later, rejected, on).groupBy("snap_no", "game_id").agg(F.count(F.lit(1)).alias("files"))


@by_snapshot
def footprint(s):
    return I.footprint(s.now, ["snap_no", "game_id"])


@by_snapshot
def allocation(s):
    return I.allocation(s.rows.select("snap_no", "game_id", "ino", "size"), ["snap_no", "game_id"], ["ino"])


@by_snapshot
def tree_diff(s):
    found = I.tree_diff(s.before, s.later, KEYS, ["size", "mtime_ns"])
    return found.select("snap_no", "game_id", F.hex("relpath").alias("path_hex"), "what")


@by_snapshot
def hard_links(s):
    """Files of one length in a game, which stand for names of one inode; the first in path order is their target."""
    rows = s.now.where("size is not null").select("snap_no", "game_id", "size", F.hex("relpath").alias("path_hex"))
    return I.hard_links(rows, ["snap_no", "game_id", "size"], "path_hex")


# costs

@by_snapshot
def disk_cost_models(s):
    rows = s.now.where("size is not null").withColumn("packed", F.call_function("div", F.col("size") * (F.col("ino") % 11), F.lit(10).cast("long")))
    native, store = costs.disk_cost(F.col("packed"), F.col("size")), costs.disk_cost(F.col("packed"), F.col("size"), store=True)
    return rows.groupBy("snap_no", "game_id").agg(F.sum(native).alias("native_bytes"), F.sum(store).alias("store_bytes"), F.sum(costs.whole_sectors(F.col("size"))).alias("raw_bytes"))


@by_snapshot
def sample_offsets(s):
    rows = s.now.where("size > 262144").select(*KEYS, "size")
    rows = rows.withColumn("blocks", costs.blocks_of(F.col("size"), costs.NATIVE_BLOCK)).withColumn("samples", costs.samples_of(F.col("size")))
    each = rows.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("samples") - 1)))
    block = costs.sample_block(F.col("i"), F.col("samples"), F.col("blocks"))
    offset = costs.stratum_offset(F.col("i"), F.col("samples"), F.col("size"), F.lit(costs.NATIVE_BLOCK).cast("long"))
    return each.select("snap_no", "game_id", F.hex("relpath").alias("path_hex"), "i", block.alias("block"), offset.alias("offset"))


def carried_saving(spark, d):
    return _games(spark, d).select("id", costs.carried_saving(F.col("est_saving"), F.col("install_bytes"), F.col("disk_after"), F.col("disk_before") - F.col("disk_after")).alias("saving"))


def _budget(s):
    rows = s.now.where("size > 4096").select(*KEYS, "size").withColumn("charge", F.least("size", F.lit(65536).cast("long"))).withColumn("path_hex", F.hex("relpath"))
    bucket = -F.floor(F.log2(F.col("size").cast("double")) * 16)
    total = S.running_totals(rows, ["snap_no", "game_id"], [F.col("size").desc(), F.col("path_hex").asc()], bucket, F.col("charge"), "before")
    return total.select("snap_no", "game_id", "path_hex", "before", (F.col("before") < 1_000_000).alias("sampled"))


@by_snapshot
def budget_plan(s):
    """Largest files first, sampled while what was charged before stays below the budget."""
    return _budget(s)


@by_snapshot
def estimate_formula(s):
    """Sampled costs scaled up to the files that the budget left out; compressed sizes are made up, and no file counts as tried before."""
    rows = _budget(s).join(s.now.select(F.col("snap_no").alias("n"), F.col("game_id").alias("g"), F.hex("relpath").alias("h"), "size", "ino"), (F.col("n") == F.col("snap_no")) & (F.col("g") == F.col("game_id")) & (F.col("h") == F.col("path_hex")))
    packed = F.call_function("div", F.col("size") * (F.col("ino") % 11), F.lit(10).cast("long"))
    cost = costs.disk_cost(packed, F.col("size"))
    sums = rows.groupBy("snap_no", "game_id").agg(F.sum(F.when(F.col("sampled"), costs.whole_sectors(F.col("size")) - cost).otherwise(0)).alias("saving"), F.sum(F.when(F.col("sampled"), F.col("size")).otherwise(0)).alias("sampled_bytes"), F.sum(F.when(~F.col("sampled"), F.col("size")).otherwise(0)).alias("left_bytes"))
    scaled = F.coalesce(F.floor(F.col("saving").cast("decimal(18,0)") * F.col("left_bytes").cast("decimal(18,0)") / F.nullif(F.col("sampled_bytes").cast("decimal(18,0)"), F.lit(0).cast("decimal(18,0)"))).cast("long"), F.lit(0).cast("long"))
    return sums.select("snap_no", "game_id", "saving", "sampled_bytes", "left_bytes", scaled.alias("scaled_saving"))


# state

def upsert_games(spark, d):
    games = table(spark, d, "games").select("id", "loaded_at", "rec_no", "title", "level")
    at = F.lit("2024-06-01").cast("timestamp_ntz")
    return S.upsert(games.where(F.col("loaded_at") < at), games.where(F.col("loaded_at") >= at), ["id"], ["loaded_at", "rec_no"]).select("id", "rec_no", "title", "level")


def forget_games(spark, d):
    games = table(spark, d, "games").select("rec_no", "id")
    return S.without(games, table(spark, d, "games").where("forgotten_at is not null").select("id"), [("id", "id")])


@by_snapshot
def replace_fingerprints(s):
    """The earlier snapshot with the files of all games of one launcher replaced by the later one's."""
    columns = [*KEYS, "size", "level_applied"]
    base = S.replace_groups(s.before.select(*columns), s.later.where("game_id like 'steam:%'").select(*columns), ["snap_no", "game_id"])
    return base.groupBy("snap_no", "game_id").agg(F.count(F.lit(1)).alias("files"), costs.saturating_sum(F.col("size")).alias("bytes"))


def invalidate_by_path(spark, d):
    records = table(spark, d, "games").select("rec_no", "path", "level", "est_saving")
    bad = F.startswith(F.col("path"), F.lit("/mnt/"))
    return S.invalidate(records, bad, {"level": F.lit(0), "est_saving": F.lit(0).cast("long")}).select("rec_no", "level", "est_saving")


def exclude_games(spark, d):
    """Games of which none of the ids on the same folder was forgotten."""
    merged = D.merge_by_folder(_folders(spark, d).withColumn("state", F.lit("idle")), "folder", "id", "rec_no", "state")
    gone = table(spark, d, "games").where("forgotten_at is not null").select(F.col("id").alias("gone"))
    return D.without_any(merged, "folder", F.concat(F.array("id"), "also"), gone, "gone").select("folder", "id")


def recent_activity(spark, d):
    rows = table(spark, d, "activity").distinct()
    return S.newest(rows, 50, [F.col("ts").desc(), F.col("id").desc()]).select("ts", "id", "kind", "bytes_delta")


def job_retention(spark, d):
    ended = _jobs(spark, d).where("finished is not null").groupBy("id").agg(F.max("finished").alias("finished"))
    return S.beyond_newest(ended, 300, "id").select("id", "finished")


def latest_job(spark, d):
    jobs = _jobs(spark, d).where("game_id is not null").select("game_id", "id", "kind", "state")
    return S.latest_per(jobs, ["game_id"], ["id"])


def newest_jobs(spark, d):
    ids = _jobs(spark, d).groupBy("id").agg(F.max("created").alias("created"))
    return S.newest(ids, 500, [F.col("id").desc()])


def next_job_id(spark, d):
    return S.next_id(table(spark, d, "jobs"), "id")


@by_snapshot
def really_changed(s):
    columns = ["snap_no", "game_id", "relpath", "size", "level_applied", "ctime_ns"]
    found = S.really_changed(s.before.select(*columns), s.later.select(*columns), KEYS, ["ctime_ns"])
    return found.groupBy("snap_no", "game_id").agg(F.count(F.lit(1)).alias("files"))


@by_snapshot
def publish_missing(s):
    new = s.later.select("snap_no", "ino", "size")
    found = S.publish_missing(s.before.select("snap_no", "ino", "size"), new, ["snap_no", "ino", "size"])
    found = found.groupBy("snap_no").agg(F.count(F.lit(1)).alias("objects"), costs.saturating_sum(F.col("size")).alias("bytes"))
    zero = F.lit(0).cast("long")
    numbers = new.sparkSession.createDataFrame([(n,) for n in s.compared], "snap_no int")
    return numbers.join(found, "snap_no", "left").select("snap_no", F.coalesce("objects", zero).alias("objects"), F.coalesce("bytes", zero).alias("bytes"))


# discovery

def merge_sources(spark, d):
    rows = _folders(spark, d).withColumn("state", F.when(F.col("forgotten_at").isNotNull(), F.concat(F.lit("broken:"), F.col("rec_no").cast("string"))).otherwise("idle"))
    merged = D.merge_by_folder(rows, "folder", "id", "rec_no", "state")
    return merged.select("folder", "id", F.array_join("also", "|").alias("also"), "state", "reports")


def group_flags(spark, d):
    rows = _folders(spark, d)
    return D.group_flags(rows, "folder", "id", "level", "install_bytes", F.col("backend") == "wof", F.col("forgotten_at").isNull())


def selector_tiered(spark, d):
    words = ["steam:9001110", "STEAM:9001110", "9001110", "fipovolith orchard", "Orchard", "lantern", "", "nothing like it"]
    selectors = spark.createDataFrame([(w,) for w in words], "selector string")
    return D.select_tiered(table(spark, d, "games"), "id", "title", selectors, "selector")


def remembered_installs(spark, d):
    rows = _folders(spark, d).where("folder is not null").select("id", "folder", "loaded_at", "forgotten_at").distinct()
    at = F.lit("2024-06-01").cast("timestamp_ntz")
    fresh, before = rows.where(F.col("loaded_at") >= at), rows.where(F.col("loaded_at") < at)
    kept = D.kept_from_before(fresh.select("id", "folder").distinct(), before.where("forgotten_at is null").select("id", "folder").distinct(), "id", "folder")
    return kept.select("id", "folder", "remembered")


def volume_totals(spark, d):
    rows = _games(spark, d).withColumn("volume", F.regexp_extract(P.normal_path(F.trim("path")), r"^(/[^/]*|[A-Za-z]:)", 1))
    return D.totals_by_volume(rows, "volume", "install_bytes")


def observe_changes(spark, d):
    rows = table(spark, d, "games").select("rec_no", "id", "loaded_at", "build_at_compress", "forgotten_at")
    return D.observed_changes(rows, "id", ["loaded_at", "rec_no"], "build_at_compress", F.col("forgotten_at").isNull()).select("rec_no", "id", "seen", "before", "changed", "ready")


def id_parts(spark, d):
    """Launchers and keys of all ids anywhere, each once."""
    ids = table(spark, d, "games").select("id").unionAll(table(spark, d, "files").select("game_id")).unionAll(table(spark, d, "jobs").select("game_id")).where("id != ''").distinct()
    at = F.instr("id", ":")
    return ids.select("id", F.when(at > 0, F.substring_index("id", ":", 1)).alias("launcher"), F.when(at > 0, F.expr("substring(id, instr(id, ':') + 1)")).alias("key"))


def listed_installs(spark, d):
    """Entries of another program that are installed somewhere, titled by name, folder or id."""
    rows = table(spark, d, "lutris_games").where("installed = 1 and directory is not null")
    last = F.element_at(F.split(P.normal_path(F.trim("directory")), "/"), -1)
    return rows.select("id", F.coalesce("name", F.when(last != "", last), F.col("id").cast("string")).alias("title"), "directory")


def discovered_entries(spark, d):
    fields = X.json_fields(F.col("raw"), {"title": ["title", "name"], "path": ["path", "install_path"], "launcher": ["launcher"], "version": ["version"], "build": ["build", "buildid"], "size": ["size"]})
    rows = table(spark, d, "raw_games").select("raw_id", *[c.alias(n) for n, c in fields.items()])
    return rows.withColumn("size", F.col("size").try_cast("long"))


def app_manifests(spark, d):
    """Key-value manifests among the documents, read and laid out by app."""
    texts = table(spark, d, "documents").where("kind = 'manifest' and text is not null").select("doc_id", "text")
    return X.first_values(X.key_values(texts, "doc_id", "text"), "doc_id", "appstate", ["appid", "name", "stateflags", "installdir", "buildid", "sizeondisk"])


# paths

def prefix_location(spark, d):
    games = _folders(spark, d).where("folder is not null").select("rec_no", "folder")
    places = table(spark, d, "lutris_games").where("directory is not null").select(P.normal_path(F.trim("directory"), fold=True).alias("place"))
    places = places.select(F.regexp_extract("place", "^(/[^/]+/[^/]+)", 1).alias("place")).where("place != ''").distinct()
    return P.under(games, "folder", places, "place").select("rec_no", "place")


MOUNTS = ["/", "/home", "/mnt", "/mnt/games", "/home/deck", "/run/media/deck/card"]


def longest_mount(spark, d):
    games = _folders(spark, d).where("folder like '/%'").select("rec_no", "folder")
    mounts = spark.createDataFrame([(m,) for m in MOUNTS], "mount string")
    return P.longest_under(games, "rec_no", "folder", mounts, "mount").select("rec_no", "mount")


def swallowing_folders(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit("/"), "source").alias("folder"))
    tops = rows.select(F.substring_index("folder", "/", 2).alias("folder")).distinct().select(F.concat(F.lit("top:"), "folder").alias("k"), "folder")
    all_ = tops.unionByName(rows.select("folder").distinct().select(F.concat(F.lit("source:"), "folder").alias("k"), "folder"))
    return P.containing(all_, "k", "folder")


@by_snapshot
def file_types(s):
    """Files and bytes by ending and depth."""
    rows = s.now.withColumn("path", F.decode("relpath", "ISO-8859-1"))
    return rows.groupBy("snap_no", P.extension(F.col("path")).alias("extension"), P.depth(F.col("path")).cast("long").alias("depth")).agg(F.count(F.lit(1)).alias("files"), costs.saturating_sum(F.col("size")).alias("bytes"), F.count_if(P.safe_relative(F.col("path"))).alias("safe"))


@by_snapshot
def overlay_view(s):
    """The earlier snapshot under the later one's compressed files, without top folders that the later one has no more."""
    path = F.concat_ws("/", F.col("snap_no").cast("string"), "game_id", F.decode("relpath", "ISO-8859-1")).alias("path")
    base = s.before.select(path, "size")
    now = s.later.select(path, "size", "level_applied")
    top = F.substring_index("path", "/", 3).alias("path")
    white = base.select(top).distinct().join(now.select(top).distinct(), "path", "left_anti")
    seen = P.overlay(base, now.where("level_applied > 0"), white, "path", ["size"])
    number, game = F.substring_index("path", "/", 1).cast("int"), F.substring_index(F.substring_index("path", "/", 2), "/", -1)
    return seen.groupBy(number.alias("snap_no"), game.alias("game_id"), "layer").agg(F.count(F.lit(1)).alias("files"), costs.saturating_sum(F.col("size")).alias("bytes"))


# content

MADE_HEADS = {"dds": "44445320", "pak": "504B0304", "wem": "52494646", "bk2": "424B3200", "bin": "1F8B0800", "dll": "4D5A9000", "so": "7F454C46", "json": "7B0A2020", "txt": "EFBBBF23", "png": "89504E470D0A1A0A"}


@by_snapshot
def header_families(s):
    """Families and counters of files by their first bytes, which here are made up by ending."""
    ending = P.extension(F.decode("relpath", "ISO-8859-1"))
    made = F.create_map(*[F.lit(x) for pair in MADE_HEADS.items() for x in pair])
    rows = s.now.withColumn("head", F.unhex(F.coalesce(F.try_element_at(made, ending), F.lit("00000018667479706D703432"))))
    rows = rows.withColumn("family", headers.family(F.col("head")))
    return rows.groupBy("snap_no", "family").agg(F.count(F.lit(1)).alias("files"), F.count_if(headers.cheap(F.col("family"))).alias("cheap"), F.sum(headers.little(F.col("head"), 0, 4)).alias("marks"))


def dedupe_exact(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("hash"), F.octet_length("text").cast("long").alias("size"))
    return C.unique_chunks(rows, ["doc_id"]).select("hash", "size", "uses", F.col("chunk_id.doc_id").alias("first_doc"))


def single_documents(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("hash"), F.octet_length("text").cast("long").alias("size"))
    return C.single_copies(rows, ["hash", "size"], ["doc_id"]).select("doc_id", "size")


def store_summary(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select(F.sha2("text", 256).alias("hash"), F.octet_length("text").cast("long").alias("size"))
    packed = F.call_function("div", F.col("size") * 2, F.lit(3).cast("long"))
    rows = rows.withColumn("codec", F.when(F.col("size") < 64, "raw").otherwise("zstd")).withColumn("stored", F.when(F.col("size") < 64, F.col("size")).otherwise(packed))
    return C.store_summary(rows)


def _parts(spark, d, size: int = 256) -> DataFrame:
    rows = table(spark, d, "documents").where("text is not null and text != ''").select("doc_id", F.octet_length("text").cast("long").alias("bytes"))
    count = F.call_function("div", F.col("bytes") + (size - 1), F.lit(size).cast("long"))
    each = rows.withColumn("ord", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    return each.select("doc_id", "ord", F.least(F.lit(size).cast("long"), F.col("bytes") - F.col("ord") * size).alias("size"))


def chunk_offsets(spark, d):
    return C.chunk_offsets(_parts(spark, d), "doc_id", "ord", "size").select("doc_id", "ord", "offset")


def range_reads(spark, d):
    chunks = C.chunk_offsets(_parts(spark, d), "doc_id", "ord", "size").withColumnRenamed("offset", "start_at")
    ranges = table(spark, d, "documents").where("text is not null").select("doc_id", (F.col("doc_id") % 300).alias("from_byte"), F.lit(500).cast("long").alias("length"))
    return C.read_ranges(chunks, ranges, "doc_id")


def index_gaps(spark, d):
    """Chunks of an index with holes: every 50th chunk was shifted."""
    chunks = C.chunk_offsets(_parts(spark, d), "doc_id", "ord", "size").withColumn("start_at", F.col("offset") + F.when(F.col("ord") % 50 == 49, 1).otherwise(0))
    return C.gaps(chunks, "doc_id", "ord", "start_at", "size")


def pool_prune(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select("source", F.sha2("text", 256).alias("hash"), F.octet_length("text").cast("long").alias("size"))
    left = C.unused(rows.select("hash", "size").distinct(), rows.where("source not like 'board/%'"), ["hash", "size"])
    return left.agg(F.count(F.lit(1)).alias("objects"), costs.saturating_sum(F.col("size")).alias("bytes"))


def content_chunks(spark, d):
    return C.content_chunks(table(spark, d, "documents").where("text is not null").select("doc_id", F.encode("text", "UTF-8").alias("content")), "doc_id", "content", 256, 4096, 8)


def chunk_copies(spark, d):
    """Chunks that occur more than once among all documents."""
    return C.unique_chunks(content_chunks(spark, d), ["doc_id", "ord"]).where("uses > 1").select("hash", "size", "uses")


def encoded_documents(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return C.encoded_sizes(rows, "content", (3, 9)).select("doc_id", "encoded.codec", "encoded.stored", "encoded.level")


def encoded_documents_maximum(spark, d):
    """The same at all levels that a store of the largest saving tries."""
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return C.encoded_sizes(rows, "content", C.MOST_LEVELS).select("doc_id", "encoded.codec", "encoded.stored", "encoded.level")


def codec_benchmark(spark, d):
    """Bytes of all documents under each profile: native blocks at three levels, frames at three."""
    rows = table(spark, d, "documents").where("text is not null").select(F.encode("text", "UTF-8").alias("content"))
    each = rows.select(F.octet_length("content").cast("long").alias("bytes"), F.posexplode(C.profile_costs(F.col("content"))).alias("at", "stored"))
    sums = each.groupBy("at").agg(F.sum("bytes").alias("bytes"), F.sum("stored").alias("stored"))
    of = lambda k: F.element_at(F.array(*[F.lit(p[k]) for p in C.PROFILES]), F.col("at") + 1)
    return sums.select(of(0).alias("level"), of(1).alias("native"), "bytes", "stored")


def chunk_verification(spark, d):
    """Chunks of all documents as a store keeps them, decoded again; bad ones differ in length or hash."""
    texts = table(spark, d, "documents").where("text is not null").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    pieces = content_chunks(spark, d).join(texts, "doc_id").withColumn("content", F.substring("content", (F.col("start_at") + 1).cast("int"), F.col("size").cast("int")))
    kept = C.encoded_contents(pieces, "content").select("size", "hash", "encoded.codec", "encoded.payload")
    checked = kept.select("codec", "size", F.octet_length("payload").cast("long").alias("stored"), C.intact(F.col("codec"), F.col("payload"), F.col("size"), F.col("hash")).alias("good"))
    return checked.groupBy("codec").agg(F.count(F.lit(1)).alias("chunks"), F.sum("size").alias("bytes"), F.sum("stored").alias("stored"), F.count_if(~F.col("good")).alias("bad"))


def _stores(spark, d) -> DataFrame:
    """Documents as files: a store for the first part of each source, folders for the rest of it and for the kind, which is the ending too."""
    kind, source = F.coalesce("kind", F.lit("")), F.coalesce("source", F.lit(""))
    rows = table(spark, d, "documents").where("text is not null")
    return rows.select("doc_id", F.substring_index(source, "/", 1).alias("store"), F.concat(source, F.lit("/"), kind, F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 19, "0"), F.lit("."), kind).alias("path"), F.encode("text", "UTF-8").alias("content"))


def document_frames(spark, d):
    """Small documents of one copy in frames of 4 MiB, where these save enough against separate ones."""
    return C.small_file_groups(_stores(spark, d), "store", "path", "content", P.extension(F.col("path")))[0]


def store_index(spark, d):
    """The chunks of each store in the order of its index: frames first, then those of the other files in walk order, each once."""
    files = _stores(spark, d)
    frames, members = C.small_file_groups(files, "store", "path", "content", P.extension(F.col("path")))
    rest = files.join(members.select("store", "path"), ["store", "path"], "left_anti")
    placed = C.content_chunks(rest, "doc_id", "content").join(rest.select("doc_id", "store", F.split("path", "/").alias("parts")), "doc_id")
    first = placed.groupBy("store", "hash", "size").agg(F.min(F.struct("parts", "ord")).alias("first"))
    none = F.lit(None)
    rows = frames.select("store", F.lit(0).alias("turn"), "extension", "frame", none.cast("array<string>").alias("parts"), none.cast("int").alias("ord"), F.col("bytes").alias("size"))
    rows = rows.unionAll(first.select("store", F.lit(1), none.cast("string"), none.cast("long"), "first.parts", "first.ord", "size"))
    number = F.row_number().over(Window.partitionBy("store").orderBy("turn", "extension", "frame", "parts", "ord")) - 1
    return rows.select("store", number.alias("chunk_no"), "extension", "frame", F.array_join("parts", "/").alias("path"), "ord", "size")


def corpus_digest(spark, d):
    rows = table(spark, d, "documents").select("source", F.col("doc_id").cast("string").alias("path"), "text")
    return C.corpus_digest(rows, ["source"], "path", F.col("text"))


@by_snapshot
def small_file_frames(s):
    """Small files put into frames of 4 MiB by game and ending in path order. Files have no content here: copies and gain are document_frames' matter."""
    rows = s.now.where("size between 1 and 524287").withColumn("extension", P.extension(F.decode("relpath", "ISO-8859-1"))).select("snap_no", "game_id", "extension", "relpath", "size")
    framed = C.folded(rows, ["snap_no", "game_id", "extension"], ["relpath"], "size", C.next_fit(4 * 1024 * 1024), "frame")
    return framed.groupBy("snap_no", "game_id", "extension", "frame").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


@by_snapshot
def preview_budget(s):
    """What each file may be sampled by, largest first, from 32 MiB a game that are spent by what is read."""
    rows = s.now.where("size > 4096").select("snap_no", "game_id", "relpath", "size", (-F.col("size")).alias("turn"))
    taken = C.folded(rows, ["snap_no", "game_id"], ["turn", "relpath"], "size", C.spending(32 * 1024 * 1024, 2 * 1024 * 1024, 128 * 1024), "sampled")
    return taken.groupBy("snap_no", "game_id").agg(F.count_if(F.col("sampled") > 0).alias("files"), F.sum("sampled").alias("bytes"))


# totals

def observe_stream(spark, d):
    """The game records as a stream of reports: which installs are newly ready (the same rule as observe_changes)."""
    observer.use_state_store(spark)
    schema = table(spark, d, "games").schema
    games = spark.readStream.schema(schema).parquet(f"{d}/games.parque[t]")  # a pattern, so that one file and a folder of files both do
    reports = games.select(F.col("id").alias("key"), F.col("rec_no").alias("seq"), F.col("build_at_compress").alias("build"), F.col("forgotten_at").isNull().alias("settled"))
    return observer.finished(observer.ready_installs(reports)).select("key", "seq", "build", "seen", "ready")


def activity_totals(spark, d):
    rows = table(spark, d, "activity").distinct().withColumn("level", F.lower("level"))
    return rows.groupBy("level", "kind").agg(F.count(F.lit(1)).alias("entries"), F.sum("bytes_delta").alias("bytes"), F.max("ts").alias("latest"))


def job_progress(spark, d):
    """Each ended job with the number of jobs of its game that ended before it."""
    rows = _jobs(spark, d).where("finished is not null and game_id is not null").groupBy("id", "game_id").agg(F.max("finished").alias("finished"))
    bucket = F.call_function("div", F.col("finished"), F.lit(86400).cast("long"))
    return S.running_totals(rows, ["game_id"], [F.col("finished").asc(), F.col("id").asc()], bucket, F.lit(1).cast("long"), "done").select("id", "done")


def compressed_share(spark, d):
    """Bytes before and after by launcher, with the saving in hundredths of a percent."""
    rows = _games(spark, d).groupBy("launcher").agg(F.count(F.lit(1)).alias("games"), F.sum("disk_before").alias("before_bytes"), F.sum("disk_after").alias("after_bytes"))
    return rows.withColumn("saved_bps", F.floor((F.col("before_bytes") - F.col("after_bytes")).cast("decimal(25,0)") * 10000 / F.col("before_bytes").cast("decimal(25,0)")).cast("long"))


FUNCTIONS = [
    inventory_floor, changed_since, changed_since_floor, recorded_levels, receipt_skip, outcome_merge, rejected_skip, footprint, allocation, tree_diff, hard_links,
    disk_cost_models, sample_offsets, carried_saving, budget_plan, estimate_formula,
    upsert_games, forget_games, replace_fingerprints, invalidate_by_path, exclude_games, recent_activity, job_retention, latest_job, newest_jobs, next_job_id, really_changed, publish_missing,
    merge_sources, group_flags, selector_tiered, remembered_installs, volume_totals, observe_changes, id_parts, listed_installs, discovered_entries, app_manifests,
    prefix_location, longest_mount, swallowing_folders, file_types, overlay_view,
    header_families, dedupe_exact, single_documents, store_summary, chunk_offsets, range_reads, index_gaps, pool_prune, content_chunks, chunk_copies, encoded_documents, encoded_documents_maximum, codec_benchmark, chunk_verification, document_frames, store_index, corpus_digest, small_file_frames, preview_budget,
    observe_stream, activity_totals, job_progress, compressed_share,
]
QUERIES = {f.__name__: f for f in FUNCTIONS} | {f"{f.__name__}_by_snapshot": f.each for f in FUNCTIONS if hasattr(f, "each")}

# The two newest snapshots of the test tables, which the SQL names; the queries read them from the table.
NOW, BEFORE = 18, 16


def _h(snap: int) -> str:
    return f"""(SELECT game_id, relpath, loaded_at, size, ino, mtime_ns, ctime_ns, level_applied FROM files WHERE snap_no = {snap}
        QUALIFY row_number() OVER (PARTITION BY game_id, relpath ORDER BY loaded_at DESC NULLS LAST, size DESC NULLS LAST, ino DESC NULLS LAST, mtime_ns DESC NULLS LAST, ctime_ns DESC NULLS LAST, level_applied DESC NULLS LAST) = 1)"""


_ON = "o.game_id = n.game_id AND o.relpath = n.relpath"
_SAME = "o.size IS NOT DISTINCT FROM n.size AND o.ino IS NOT DISTINCT FROM n.ino AND o.mtime_ns IS NOT DISTINCT FROM n.mtime_ns AND o.ctime_ns IS NOT DISTINCT FROM n.ctime_ns"
_BIG = "CAST(coalesce(sum({0}), 0) AS BIGINT)"
_SECTORS = "(({0} + 4095) // 4096 * 4096)"
_FOLDER = r"""lower(CASE WHEN regexp_replace(replace(trim({0}, ' '), '\', '/'), '/+', '/', 'g') = '/' THEN '/'
    ELSE regexp_replace(regexp_replace(replace(trim({0}, ' '), '\', '/'), '/+', '/', 'g'), '/$', '') END)"""
_FOLDERS = f"(SELECT *, {_FOLDER.format('path')} AS folder FROM games)"


def _changed(level: int, floor: int) -> str:
    return f"""(SELECT n.*, CASE WHEN o.game_id IS NULL THEN 'new' WHEN NOT ({_SAME}) THEN 'changed'
        WHEN coalesce(n.size, 0) > {floor} AND (coalesce(o.level_applied, 0) = 0 OR o.level_applied < {level}) THEN 'behind' END AS why
        FROM {_h(NOW)} n LEFT JOIN {_h(BEFORE)} o ON {_ON})"""


_BUDGET = f"""(SELECT game_id, hex(relpath) AS path_hex, size, ino,
    CAST(coalesce(sum(least(size, 65536)) OVER (PARTITION BY game_id ORDER BY size DESC, hex(relpath) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
    FROM {_h(NOW)} WHERE size > 4096)"""
_COST = f"(CASE WHEN size * (ino % 11) // 10 + 4096 > size THEN {_SECTORS.format('size')} ELSE {_SECTORS.format('(size * (ino % 11) // 10)')} END)"
_STORE_COST = _COST.replace("+ 4096 >", "+ 4096 >=")
_LAST_GAME = "(SELECT * FROM games QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, rec_no DESC) = 1)"
_JOBS = "(SELECT DISTINCT * FROM jobs)"
_MERGED = f"""(SELECT folder, list(id ORDER BY o) AS ids FROM (SELECT folder, id, min(rec_no) AS o FROM {_FOLDERS} WHERE folder IS NOT NULL AND id IS NOT NULL GROUP BY ALL) GROUP BY folder)"""
_BYTES = "octet_length(encode(text))"
_PARTS = f"""(SELECT doc_id, ord, CAST(least(256, bytes - ord * 256) AS BIGINT) AS size, ord * 256 AS start_at FROM
    (SELECT doc_id, {_BYTES} AS bytes, unnest(range(0, ({_BYTES} + 255) // 256)) AS ord FROM documents WHERE text <> ''))"""
_TEXTS = f"(SELECT doc_id, source, sha256(text) AS hash, CAST({_BYTES} AS BIGINT) AS size FROM documents WHERE text IS NOT NULL)"
_TREE = "game_id || '/' || decode_path"
_LATIN = "array_to_string(list_transform(range(0, octet_length(relpath)), lambda i: chr(CAST(('0x' || substr(hex(relpath), 2 * i + 1, 2)) AS INTEGER))), '')"
_MOUNT_ROWS = ", ".join(f"('{m}')" for m in MOUNTS)

SQL = {
    "inventory_floor": f"""SELECT CASE WHEN coalesce(size, 0) <= 4096 THEN 'skip_tiny' ELSE 'compress' END AS action,
        CASE WHEN coalesce(size, 0) <= 65536 THEN 'skip_tiny' ELSE 'compress' END AS store_action, count(*) AS files, {_BIG.format('size')} AS bytes FROM {_h(NOW)} GROUP BY ALL""",
    "changed_since": f"SELECT game_id, hex(relpath) AS path_hex, size, why FROM {_changed(1, 4096)} WHERE why IS NOT NULL",
    "changed_since_floor": f"SELECT game_id, why, count(*) AS files, {_BIG.format('size')} AS bytes FROM {_changed(15, 65536)} WHERE why IS NOT NULL GROUP BY ALL",
    "recorded_levels": f"SELECT n.game_id, hex(n.relpath) AS path_hex, o.level_applied AS recorded_level FROM {_h(NOW)} n JOIN {_h(BEFORE)} o ON {_ON} AND {_SAME}",
    "receipt_skip": f"SELECT n.game_id, count(*) AS files FROM {_h(NOW)} n WHERE NOT EXISTS (SELECT 1 FROM {_h(BEFORE)} o WHERE {_ON} AND {_SAME} AND o.level_applied >= 9) GROUP BY 1",
    "outcome_merge": f"""SELECT n.game_id, coalesce(CASE WHEN n.level_applied > 0 THEN n.level_applied END, o.level_applied, 0) AS level, count(*) AS files
        FROM {_h(NOW)} n LEFT JOIN {_h(BEFORE)} o ON {_ON} AND {_SAME} GROUP BY ALL""",
    "rejected_skip": f"""SELECT n.game_id, count(*) AS files FROM {_h(NOW)} n WHERE NOT EXISTS (SELECT 1 FROM {_h(BEFORE)} o
        WHERE {_ON} AND o.size = n.size AND o.mtime_ns = n.mtime_ns AND o.level_applied = 0) GROUP BY 1""",
    "footprint": f"SELECT game_id, count(*) AS files, {_BIG.format('size')} AS bytes, max(size) AS largest, CAST(sum(16384 + 8 * octet_length(relpath)) AS BIGINT) AS metadata_bytes FROM {_h(NOW)} GROUP BY 1",
    "allocation": f"""SELECT game_id, count(*) AS files, {_BIG.format('size')} AS logical_bytes, {_BIG.format('(coalesce(size, 0) + 511) // 512 * 512')} AS allocated_bytes
        FROM (SELECT game_id, ino, max(size) AS size FROM files WHERE snap_no = {NOW} GROUP BY ALL) GROUP BY 1""",
    "tree_diff": f"""SELECT coalesce(o.game_id, n.game_id) AS game_id, hex(coalesce(o.relpath, n.relpath)) AS path_hex,
        CASE WHEN n.game_id IS NULL THEN 'missing' WHEN o.game_id IS NULL THEN 'extra' ELSE 'different' END AS what
        FROM {_h(BEFORE)} o FULL JOIN {_h(NOW)} n ON {_ON} WHERE n.game_id IS NULL OR o.game_id IS NULL OR o.size IS DISTINCT FROM n.size OR o.mtime_ns IS DISTINCT FROM n.mtime_ns""",
    "hard_links": f"""SELECT * FROM (SELECT game_id, size, hex(relpath) AS path_hex, min(hex(relpath)) OVER w AS target, count(*) OVER w AS links
        FROM {_h(NOW)} WHERE size IS NOT NULL WINDOW w AS (PARTITION BY game_id, size)) WHERE links > 1 AND path_hex <> target""",
    "disk_cost_models": f"""SELECT game_id, {_BIG.format(_COST)} AS native_bytes, {_BIG.format(_STORE_COST)} AS store_bytes, {_BIG.format(_SECTORS.format('size'))} AS raw_bytes
        FROM {_h(NOW)} WHERE size IS NOT NULL GROUP BY 1""",
    "sample_offsets": f"""SELECT game_id, path_hex, CAST(i AS BIGINT) AS i, CAST(CASE WHEN samples <= 1 THEN (blocks - 1) // 2 ELSE i * (blocks - 1) // greatest(samples - 1, 1) END AS BIGINT) AS block,
        CAST(least(i * (size // samples) + greatest(size // samples - 131072, 0) // 2, greatest(size - 131072, 0)) AS BIGINT) AS "offset"
        FROM (SELECT *, unnest(range(0, samples)) AS i FROM (SELECT *, least(blocks, 32) AS samples FROM
        (SELECT game_id, hex(relpath) AS path_hex, size, greatest(1, (size + 131071) // 131072) AS blocks FROM {_h(NOW)} WHERE size > 262144)))""",
    "carried_saving": f"""SELECT id, CAST(coalesce(CAST(est_saving AS HUGEINT) * greatest(install_bytes - disk_after, 0) // nullif(install_bytes, 0), 0) + disk_before - disk_after AS BIGINT) AS saving FROM {_LAST_GAME}""",
    "budget_plan": f"SELECT game_id, path_hex, before, before < 1000000 AS sampled FROM {_BUDGET}",
    "estimate_formula": f"""SELECT *, CAST(coalesce(CAST(saving AS HUGEINT) * left_bytes // nullif(sampled_bytes, 0), 0) AS BIGINT) AS scaled_saving FROM
        (SELECT game_id, {_BIG.format(f"CASE WHEN before < 1000000 THEN {_SECTORS.format('size')} - {_COST} ELSE 0 END")} AS saving,
        {_BIG.format('CASE WHEN before < 1000000 THEN size ELSE 0 END')} AS sampled_bytes, {_BIG.format('CASE WHEN before < 1000000 THEN 0 ELSE size END')} AS left_bytes FROM {_BUDGET} GROUP BY 1)""",
    "upsert_games": """SELECT id, rec_no, title, level FROM games QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at >= TIMESTAMP '2024-06-01' DESC, loaded_at DESC, rec_no DESC) = 1""",
    "forget_games": "SELECT rec_no, id FROM games WHERE id NOT IN (SELECT id FROM games WHERE forgotten_at IS NOT NULL)",
    "replace_fingerprints": f"""SELECT game_id, count(*) AS files, {_BIG.format('size')} AS bytes FROM (
        SELECT game_id, size FROM {_h(NOW)} WHERE game_id LIKE 'steam:%'
        UNION ALL SELECT game_id, size FROM {_h(BEFORE)} WHERE game_id NOT IN (SELECT game_id FROM files WHERE snap_no = {NOW} AND game_id LIKE 'steam:%')) GROUP BY 1""",
    "invalidate_by_path": """SELECT rec_no, CASE WHEN path LIKE '/mnt/%' THEN 0 ELSE level END AS level, CAST(CASE WHEN path LIKE '/mnt/%' THEN 0 ELSE est_saving END AS BIGINT) AS est_saving FROM games""",
    "exclude_games": f"SELECT folder, ids[1] AS id FROM {_MERGED} WHERE NOT list_has_any(ids, (SELECT list(DISTINCT id) FROM games WHERE forgotten_at IS NOT NULL))",
    "recent_activity": "SELECT ts, id, kind, bytes_delta FROM (SELECT DISTINCT * FROM activity) ORDER BY ts DESC, id DESC LIMIT 50",
    "job_retention": f"""SELECT id, finished FROM (SELECT id, max(finished) AS finished FROM {_JOBS} WHERE finished IS NOT NULL GROUP BY id) QUALIFY row_number() OVER (ORDER BY id DESC) > 300""",
    "latest_job": f"SELECT DISTINCT game_id, id, kind, state FROM {_JOBS} WHERE game_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY id DESC, kind DESC, state DESC) = 1",
    "newest_jobs": f"SELECT id, max(created) AS created FROM {_JOBS} GROUP BY id ORDER BY id DESC LIMIT 500",
    "next_job_id": "SELECT coalesce(max(id), 0) + 1 AS next_id FROM jobs",
    "really_changed": f"""SELECT n.game_id, count(*) AS files FROM {_h(NOW)} n WHERE NOT EXISTS (SELECT 1 FROM {_h(BEFORE)} o
        WHERE {_ON} AND o.size IS NOT DISTINCT FROM n.size AND o.level_applied IS NOT DISTINCT FROM n.level_applied) GROUP BY 1""",
    "publish_missing": f"""SELECT count(*) AS objects, {_BIG.format('size')} AS bytes FROM (SELECT DISTINCT ino, size FROM {_h(NOW)}) n
        WHERE NOT EXISTS (SELECT 1 FROM {_h(BEFORE)} o WHERE o.ino = n.ino AND o.size = n.size)""",
    "merge_sources": f"""SELECT m.folder, ids[1] AS id, array_to_string(ids[2:], '|') AS also, coalesce('broken:' || broken, 'idle') AS state, reports
        FROM {_MERGED} m JOIN (SELECT folder, count(*) AS reports, max(CASE WHEN forgotten_at IS NOT NULL THEN rec_no END) AS broken FROM {_FOLDERS} GROUP BY 1) s ON s.folder = m.folder""",
    "group_flags": f"""SELECT folder, min(id) AS id, bit_or(level) AS flags, max(install_bytes) AS size, bool_and(backend = 'wof') AS tool,
        bool_or(forgotten_at IS NULL) AS running, count(DISTINCT id) AS ids FROM {_FOLDERS} WHERE folder IS NOT NULL GROUP BY 1""",
    "selector_tiered": """SELECT selector, key, tier FROM (SELECT *, min(tier) OVER (PARTITION BY selector) AS best FROM (
        SELECT selector, id AS key, min(CASE WHEN lower(id) = lower(selector) OR regexp_replace(id, '^.*:', '') = selector THEN 1 WHEN lower(title) = lower(selector) THEN 2
          WHEN contains(lower(title), lower(selector)) THEN 3 END) AS tier
        FROM games, (VALUES ('steam:9001110'), ('STEAM:9001110'), ('9001110'), ('fipovolith orchard'), ('Orchard'), ('lantern'), ('nothing like it')) s(selector) GROUP BY ALL)
        WHERE tier IS NOT NULL) WHERE tier = best""",
    "remembered_installs": f"""WITH r AS (SELECT DISTINCT id, folder, loaded_at, forgotten_at FROM {_FOLDERS} WHERE folder IS NOT NULL),
        f AS (SELECT DISTINCT id, folder FROM r WHERE loaded_at >= TIMESTAMP '2024-06-01')
        SELECT id, folder, false AS remembered FROM f UNION ALL SELECT DISTINCT id, folder, true FROM r WHERE loaded_at < TIMESTAMP '2024-06-01' AND forgotten_at IS NULL
        AND folder NOT IN (SELECT folder FROM f) AND id NOT IN (SELECT id FROM f WHERE id IS NOT NULL)""",
    "volume_totals": f"""SELECT volume, count(*) AS installs, {_BIG.format('install_bytes')} AS bytes, CAST(greatest(coalesce(sum(install_bytes), 0) // 20, 67108864) AS BIGINT) AS headroom
        FROM (SELECT *, regexp_extract(regexp_replace(replace(trim(path, ' '), '\\', '/'), '/+', '/', 'g'), '^(/[^/]*|[A-Za-z]:)', 1) AS volume FROM {_LAST_GAME}) GROUP BY 1""".replace("'\\\\'", "'\\'"),
    "observe_changes": """SELECT rec_no, id, seen, before, seen AND before IS DISTINCT FROM build_at_compress AS changed,
        forgotten_at IS NULL AND (NOT seen OR NOT was_settled OR before IS DISTINCT FROM build_at_compress) AS ready FROM (
        SELECT *, lag(rec_no) OVER w IS NOT NULL AS seen, lag(build_at_compress) OVER w AS before, lag(forgotten_at IS NULL) OVER w AS was_settled
        FROM games WINDOW w AS (PARTITION BY id ORDER BY loaded_at, rec_no))""",
    "id_parts": """SELECT id, CASE WHEN contains(id, ':') THEN split_part(id, ':', 1) END AS launcher, CASE WHEN contains(id, ':') THEN substr(id, strpos(id, ':') + 1) END AS key
        FROM (SELECT id FROM games UNION SELECT game_id FROM files UNION SELECT game_id FROM jobs) WHERE id <> ''""",
    "listed_installs": f"""SELECT id, coalesce(name, nullif(regexp_extract({_FOLDER.format('directory').removeprefix('lower')}, '[^/]*$'), ''), CAST(id AS VARCHAR)) AS title, directory FROM lutris_games WHERE installed = 1 AND directory IS NOT NULL""",
    "discovered_entries": """SELECT raw_id, max(CASE WHEN k = 'title' THEN v END) AS title, max(CASE WHEN k = 'path' THEN v END) AS path, max(CASE WHEN k = 'launcher' THEN v END) AS launcher,
        max(CASE WHEN k = 'version' THEN v END) AS version, max(CASE WHEN k = 'build' THEN v END) AS build, max(TRY_CAST(CASE WHEN k = 'size' THEN v END AS BIGINT)) AS size
        FROM (SELECT raw_id, lower(key) AS k, j ->> ('$."' || key || '"') AS v FROM (SELECT raw_id, CAST(raw AS JSON) AS j, unnest(json_keys(CAST(raw AS JSON))) AS key FROM raw_games)) GROUP BY 1""",
    "app_manifests": "SELECT doc_id, " + ", ".join(f"""nullif(regexp_extract(text, '(?i)\\n\\s*"{n}"\\s+"([^"]*)"', 1), '') AS {n}""" for n in ("appid", "name", "stateflags", "installdir", "buildid", "sizeondisk")) + " FROM documents WHERE kind = 'manifest' AND text IS NOT NULL",
    "prefix_location": f"""SELECT rec_no, place FROM {_FOLDERS} g JOIN (SELECT DISTINCT regexp_extract({_FOLDER.format('directory')}, '^(/[^/]+/[^/]+)', 1) AS place FROM lutris_games WHERE directory IS NOT NULL) p
        ON place <> '' AND (g.folder = place OR starts_with(g.folder, place || '/'))""",
    "longest_mount": f"""SELECT rec_no, arg_max(mount, length(mount)) AS mount FROM {_FOLDERS} g JOIN (VALUES {_MOUNT_ROWS}) m(mount)
        ON folder LIKE '/%' AND (mount = '/' OR folder = mount OR starts_with(folder, mount || '/')) GROUP BY 1""",
    "swallowing_folders": """WITH s AS (SELECT DISTINCT '/' || source AS folder FROM documents), a AS (
        SELECT 'source:' || folder AS k, folder FROM s UNION SELECT 'top:/' || split_part(folder, '/', 2), '/' || split_part(folder, '/', 2) FROM s)
        SELECT o.k AS outer_key, i.k AS inner_key FROM a o JOIN a i ON starts_with(i.folder, o.folder || '/')""",
    "overlay_view": f"""WITH b AS (SELECT game_id || '/' || {_LATIN} AS path, size FROM {_h(BEFORE)}), n AS (SELECT game_id || '/' || {_LATIN} AS path, size, level_applied FROM {_h(NOW)}),
        u AS (SELECT path, size FROM n WHERE level_applied > 0),
        w AS (SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS white FROM b EXCEPT SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM n),
        m AS (SELECT coalesce(u.path, b.path) AS path, CASE WHEN u.path IS NULL THEN b.size ELSE u.size END AS size, CASE WHEN u.path IS NULL THEN 'base' ELSE 'upper' END AS layer FROM b FULL JOIN u ON u.path = b.path)
        SELECT split_part(path, '/', 1) AS game_id, layer, count(*) AS files, {_BIG.format('size')} AS bytes FROM m
        WHERE NOT EXISTS (SELECT 1 FROM w WHERE m.path = white OR starts_with(m.path, white || '/')) GROUP BY ALL""",
    "dedupe_exact": f"SELECT hash, size, count(*) AS uses, min(doc_id) AS first_doc FROM {_TEXTS} GROUP BY ALL",
    "single_documents": f"SELECT min(doc_id) AS doc_id, size FROM {_TEXTS} GROUP BY hash, size HAVING count(*) = 1",
    "store_summary": f"""SELECT count(*) AS unique_chunks, {_BIG.format('n')} AS uses, {_BIG.format('size * n')} AS logical_bytes, {_BIG.format('size')} AS unique_bytes,
        {_BIG.format('CASE WHEN size < 64 THEN size END')} AS raw_bytes, {_BIG.format('CASE WHEN size >= 64 THEN size * 2 // 3 END')} AS zstd_bytes, CAST(0 AS BIGINT) AS zero_bytes,
        {_BIG.format('size * n - size')} AS duplicate_bytes FROM (SELECT hash, size, count(*) AS n FROM {_TEXTS} GROUP BY ALL)""",
    "chunk_offsets": f'SELECT doc_id, CAST(ord AS BIGINT) AS ord, CAST(start_at AS BIGINT) AS "offset" FROM {_PARTS}',
    "range_reads": f"""SELECT doc_id, from_byte, CAST(ord AS BIGINT) AS ord, CAST(greatest(start_at, from_byte) - start_at AS BIGINT) AS skip, CAST(least(start_at + size, from_byte + 500) - greatest(start_at, from_byte) AS BIGINT) AS take
        FROM (SELECT *, doc_id % 300 AS from_byte FROM {_PARTS}) WHERE least(start_at + size, from_byte + 500) > greatest(start_at, from_byte)""",
    "index_gaps": f"""SELECT doc_id, CAST(ord AS BIGINT) AS ord, CAST(start_at AS BIGINT) AS start_at, CAST(expected AS BIGINT) AS expected FROM (SELECT doc_id, ord, start_at, coalesce(lag(start_at + size) OVER (PARTITION BY doc_id ORDER BY ord), 0) AS expected
        FROM (SELECT doc_id, ord, size, start_at + CASE WHEN ord % 50 = 49 THEN 1 ELSE 0 END AS start_at FROM {_PARTS})) WHERE expected <> start_at""",
    "pool_prune": f"""SELECT count(*) AS objects, {_BIG.format('size')} AS bytes FROM (SELECT DISTINCT hash, size FROM {_TEXTS}) t
        WHERE NOT EXISTS (SELECT 1 FROM {_TEXTS} u WHERE u.hash = t.hash AND u.size = t.size AND u.source NOT LIKE 'board/%')""",
    "corpus_digest": """WITH f AS (SELECT source, sha256(CAST(doc_id AS VARCHAR)) AS p, sha256(coalesce(text, '')) AS c FROM documents),
        a AS (SELECT source, substr(p, 1, 6) AS b, sha256(string_agg(p || ':' || c, chr(10) ORDER BY p || ':' || c)) AS d, count(*) AS n FROM f GROUP BY ALL),
        m AS (SELECT source, substr(b, 1, 3) AS b3, sha256(string_agg(b || ':' || d, chr(10) ORDER BY b || ':' || d)) AS d, sum(n) AS n FROM a GROUP BY ALL)
        SELECT source, CAST(sum(n) AS BIGINT) AS files, sha256(string_agg(b3 || ':' || d, chr(10) ORDER BY b3 || ':' || d)) AS digest FROM m GROUP BY 1""",
    "small_file_frames": f"""WITH RECURSIVE h AS (SELECT *, row_number() OVER (PARTITION BY game_id, e ORDER BY relpath) AS r FROM (
          SELECT game_id, relpath, size, lower(regexp_extract(regexp_extract({_LATIN}, '[^/]*$'), '[^.]\\.([^.]+)$', 1)) AS e FROM {_h(NOW)} WHERE size BETWEEN 1 AND 524287)),
        t AS (SELECT game_id, e, r, size, 0 AS frame, size AS filled FROM h WHERE r = 1 UNION ALL
          SELECT h.game_id, h.e, h.r, h.size, CASE WHEN t.filled + h.size > 4194304 THEN t.frame + 1 ELSE t.frame END, CASE WHEN t.filled + h.size > 4194304 THEN h.size ELSE t.filled + h.size END
          FROM t JOIN h ON h.game_id = t.game_id AND h.e = t.e AND h.r = t.r + 1)
        SELECT game_id, e AS extension, CAST(frame AS BIGINT) AS frame, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM t GROUP BY ALL""",
    "preview_budget": f"""WITH RECURSIVE h AS (SELECT game_id, size, row_number() OVER (PARTITION BY game_id ORDER BY size DESC, relpath) AS r FROM {_h(NOW)} WHERE size > 4096),
        s AS (SELECT game_id, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS take, CAST(33554432 AS BIGINT) AS rest FROM (SELECT DISTINCT game_id FROM h) UNION ALL
          SELECT h.game_id, h.r, k.take, s.rest - k.take FROM s JOIN h ON h.game_id = s.game_id AND h.r = s.r + 1,
          LATERAL (SELECT CAST(CASE WHEN s.rest <= 0 OR (s.rest < 131072 AND h.size > s.rest) THEN 0 ELSE least(h.size, 2097152, s.rest) END AS BIGINT) AS take) k)
        SELECT game_id, count(CASE WHEN take > 0 THEN 1 END) AS files, CAST(sum(take) AS BIGINT) AS bytes FROM s WHERE r > 0 GROUP BY 1""",
    "file_types": f"""SELECT lower(regexp_extract(regexp_extract(path, '[^/]*$'), '[^.]\\.([^.]+)$', 1)) AS extension, len(list_filter(string_split(path, '/'), lambda c: c <> '')) AS depth,
        count(*) AS files, {_BIG.format('size')} AS bytes, count(CASE WHEN length(path) <= 4096 AND len(list_filter(string_split(path, '/'), lambda c: c IN ('', '.', '..'))) = 0 THEN 1 END) AS safe
        FROM (SELECT {_LATIN} AS path, size FROM {_h(NOW)}) GROUP BY ALL""",
    "header_families": f"""SELECT CASE WHEN e IN ('dds') THEN 'texture' WHEN e = 'pak' THEN 'archive' WHEN e = 'wem' THEN 'audio' WHEN e = 'bin' THEN 'mixed' WHEN e IN ('dll', 'so') THEN 'program'
        WHEN e = 'png' THEN 'encoded' WHEN e IN ('bk2', 'json', 'txt') THEN 'unknown' ELSE 'movie' END AS family, count(*) AS files,
        count(CASE WHEN e IN ('dds', 'png') OR e NOT IN ('dds', 'pak', 'wem', 'bk2', 'bin', 'dll', 'so', 'json', 'txt', 'png') THEN 1 END) AS cheap,
        CAST(sum(CASE e {' '.join(f"WHEN '{k}' THEN {int.from_bytes(bytes.fromhex(v.ljust(8, '0'))[:4], 'little') if len(v) >= 8 else 'NULL'}" for k, v in MADE_HEADS.items())} ELSE 402653184 END) AS BIGINT) AS marks
        FROM (SELECT lower(regexp_extract(regexp_extract({_LATIN}, '[^/]*$'), '[^.]\\.([^.]+)$', 1)) AS e FROM {_h(NOW)}) GROUP BY 1""",
    "observe_stream": """SELECT key, seq, build, seen, settled AND (NOT seen OR NOT was_settled OR before IS DISTINCT FROM build) AS ready FROM (
        SELECT id AS key, rec_no AS seq, build_at_compress AS build, forgotten_at IS NULL AS settled, lag(rec_no) OVER w IS NOT NULL AS seen, lag(build_at_compress) OVER w AS before,
        lag(forgotten_at IS NULL) OVER w AS was_settled FROM games WINDOW w AS (PARTITION BY id ORDER BY rec_no))""",
    "activity_totals": """SELECT lower(level) AS level, kind, count(*) AS entries, CAST(sum(bytes_delta) AS BIGINT) AS bytes, max(ts) AS latest FROM (SELECT DISTINCT * FROM activity) GROUP BY 1, 2""",
    "job_progress": f"""SELECT id, count(*) OVER (PARTITION BY game_id ORDER BY finished, id) - 1 AS done FROM (SELECT id, game_id, max(finished) AS finished FROM {_JOBS} WHERE finished IS NOT NULL AND game_id IS NOT NULL GROUP BY ALL)""",
    "compressed_share": f"""SELECT launcher, count(*) AS games, CAST(sum(disk_before) AS BIGINT) AS before_bytes, CAST(sum(disk_after) AS BIGINT) AS after_bytes,
        CAST((sum(disk_before) - sum(disk_after)) * 10000 // sum(disk_before) AS BIGINT) AS saved_bps FROM {_LAST_GAME} GROUP BY 1""",
}

# All snapshots of the test tables, which the SQL of NAME_by_snapshot names in turn.
NUMBERS = (11, 12, 13, 15, 16, 18)


def _each_snapshot(sql: str) -> str:
    now, before = f"snap_no = {NOW}", f"snap_no = {BEFORE}"
    pairs = list(zip(NUMBERS, NUMBERS[1:])) if before in sql else [(0, n) for n in NUMBERS]
    open_ = sql.replace(now, "snap_no = :now").replace(before, "snap_no = :before")
    return " UNION ALL ".join(f"SELECT {n} AS snap_no, * FROM ({open_.replace(':now', str(n)).replace(':before', str(b))})" for b, n in pairs)


SQL |= {f"{name}_by_snapshot": _each_snapshot(sql) for name, sql in list(SQL.items()) if f"{name}_by_snapshot" in QUERIES}
