"""Installs found by several sources: grouping by folder, merging ids, and selecting by what a user typed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions.names import quoted
from stowage.session import checkpointed


def ordered_distinct(value: str, order: str) -> Column:
    """The distinct values of a group as an array, by first occurrence; nulls left out. Groups are one install's few ids."""
    pairs = F.array_sort(F.collect_set(F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).alias("v")))))
    return F.array_distinct(F.transform(pairs, lambda p: p["v"]))


def merge_by_folder(entries: DataFrame, folder: str, key: str, order: str, state: str, idle: str = "idle") -> DataFrame:
    """One install per folder: the first id, further ids in order, and the last state that isn't idle.

    Sources are told by `order`. First each (folder, id) is reduced to its first place, so a folder that is reported very
    often doesn't gather its rows. Rows without a folder are left out; null ids are no aliases.
    """
    rows = entries.where(F.col(quoted(folder)).isNotNull())
    ids = rows.where(F.col(quoted(key)).isNotNull()).groupBy(F.col(quoted(folder)).alias("folder"), F.col(quoted(key)).alias("v")).agg(F.min(F.col(quoted(order))).alias("o"))
    ids = ids.groupBy("folder").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "v"))), lambda p: p["v"]).alias("ids"))
    states = rows.groupBy(F.col(quoted(folder)).alias("folder")).agg(F.max(F.when(F.col(quoted(state)) != idle, F.struct(F.col(quoted(order)).alias("o"), F.col(quoted(state)).alias("s")))).alias("last"), F.count(F.lit(1)).alias("reports"))
    joined = states.join(ids, "folder", "left")
    return joined.select("folder", F.try_element_at("ids", F.lit(1)).alias("id"), F.expr("slice(ids, 2, greatest(size(ids) - 1, 0))").alias("also"), F.coalesce("last.s", F.lit(idle)).alias("state"), "reports")


def group_flags(entries: DataFrame, folder: str, key: str, flags: str, size: str, tool: Column, running: Column) -> DataFrame:
    """One row per folder: flags united, greatest size, whether all are tools and any runs, and the least id."""
    return entries.where(F.col(quoted(folder)).isNotNull()).groupBy(F.col(quoted(folder)).alias("folder")).agg(
        F.min(F.col(quoted(key))).alias("id"), F.bit_or(F.col(quoted(flags))).alias("flags"), F.max(F.col(quoted(size))).alias("size"), F.bool_and(tool).alias("tool"), F.bool_or(running).alias("running"), F.count_distinct(F.col(quoted(key))).alias("ids")
    )


def without_any(installs: DataFrame, key: str, ids: Column, excluded: DataFrame, excluded_key: str) -> DataFrame:
    """Installs none of whose ids is excluded."""
    hit = installs.select(F.col(quoted(key)).alias("_hit"), F.explode(ids).alias("_id")).join(excluded.select(F.col(quoted(excluded_key)).alias("_id")), "_id", "left_semi").select("_hit").distinct()
    return installs.join(hit, F.col(quoted(key)) == F.col("_hit"), "left_anti")


def select_tiered(installs: DataFrame, key: str, title: str, selectors: DataFrame, selector: str) -> DataFrame:
    """Installs that each selector picks: those with that id or key, else with that title, else with it in the title.

    Case does not matter, except for the key behind the colon. An empty or null selector picks nothing. Each tier is an equi-join,
    the last one on three letters (fewer of shorter selectors) that a title has if it holds the selector.
    """
    wanted = selectors.select(F.col(quoted(selector)).alias("selector")).where("selector is not null and selector != ''").distinct()
    own = installs.select(F.col(quoted(key)).alias("key"), F.col(quoted(title)).alias("title"))
    by_id = _same_token(own, F.lower("key"), wanted, F.lower("selector"))
    by_key = _same_token(own, F.substring_index("key", ":", -1), wanted, F.col("selector"))
    first = by_id.unionAll(by_key).select("selector", "key").distinct().withColumn("tier", F.lit(1))
    second = _same_token(own, F.lower("title"), wanted, F.lower("selector")).select("selector", "key").distinct().withColumn("tier", F.lit(2))
    # read three times, and as small as what is selected
    found = checkpointed(first.unionAll(second))
    best = found.groupBy("selector").agg(F.min("tier").alias("best"))
    kept = found.join(best, "selector").where("tier = best").select("selector", "key", "tier")
    # only selectors without a better tier are left, so these rows are all kept
    rest = wanted.join(found.select("selector").distinct(), "selector", "left_anti")
    # a letter's place is a row before its runs are, since built-ins on rows are compiled and lambdas on arrays are not
    titles = own.distinct().withColumn("title", F.lower("title")).where("title != ''")
    places = titles.withColumn("_at", F.explode(F.sequence(F.lit(1), F.length("title"))))
    near = _same_token(places, F.explode(F.array(*[F.substring(F.col("title"), F.col("_at"), F.lit(n)) for n in (1, 2, 3)])), rest, F.substring(F.lower("selector"), 1, 3))
    near = near.where(F.position(F.lower("selector"), "title") == F.col("_at"))
    return kept.unionAll(near.select("selector", "key").distinct().withColumn("tier", F.lit(3)))


#: Tokens are told apart by so many hash values when rows are left out before a shuffle; as many numbers are broadcast at most.
_SLOTS = 1 << 16


def _same_token(own: DataFrame, token: Column, wanted: DataFrame, other: Column) -> DataFrame:
    """Pairs of rows with equal tokens.

    Spark can't know how many tokens an explode makes or how many selectors there are, and would send the side with the smaller
    estimate to the driver. So only the hash values of the wanted tokens are broadcast; what shares one is merged by the token.
    """
    slot = F.pmod(F.xxhash64("_token"), F.lit(_SLOTS))
    right = wanted.withColumn("_token", other)
    left = own.withColumn("_token", token).withColumn("_slot", slot)
    left = left.join(F.broadcast(right.select(slot.alias("_slot")).distinct()), "_slot", "left_semi").drop("_slot")
    return left.hint("merge").join(right, "_token")


def kept_from_before(fresh: DataFrame, before: DataFrame, key: str, folder: str, keep: Column | None = None) -> DataFrame:
    """Fresh installs, and remembered ones of which neither id nor folder was seen again (and that `keep` keeps)."""
    old = before if keep is None else before.where(keep)
    old = old.join(fresh.select(F.col(quoted(folder)).alias("_f")).distinct(), F.col(quoted(folder)) == F.col("_f"), "left_anti")
    old = old.join(fresh.select(F.col(quoted(key)).alias("_k")).distinct(), F.col(quoted(key)) == F.col("_k"), "left_anti")
    return fresh.withColumn("remembered", F.lit(False)).unionByName(old.select(*fresh.columns).withColumn("remembered", F.lit(True)))


def totals_by_volume(rows: DataFrame, volume: str, size: str) -> DataFrame:
    """Bytes and rows of each volume (a null size counts 0), with headroom: a twentieth, but 64 MiB at least."""
    sums = rows.groupBy(F.col(quoted(volume)).alias("volume")).agg(F.count(F.lit(1)).alias("installs"), F.sum(F.coalesce(F.col(quoted(size)), F.lit(0).cast("long"))).alias("bytes"))
    return sums.withColumn("headroom", F.greatest(F.call_function("div", F.col("bytes"), F.lit(20).cast("long")), F.lit(64 * 1024 * 1024).cast("long")))


def observed_changes(reports: DataFrame, key: str, order: list[str], build: str, settled: Column | None = None) -> DataFrame:
    """Each report with the key's report before: `seen` (there is one), `before` (its build), `changed` (builds differ).

    With `settled`, `ready`: settled now and not seen, not settled before, or of another build. Keys are installs, whose
    reports are few; null equals null only.
    """
    settled = F.lit(True) if settled is None else settled
    own = reports.withColumn("_now", F.struct(F.col(quoted(build)).alias("build"), settled.alias("settled")))
    last = F.lag("_now").over(Window.partitionBy(quoted(key)).orderBy(*[F.col(quoted(c)) for c in order]))
    own = own.withColumn("_last", last)
    differs = F.col("_last").isNotNull() & ~F.col("_last.build").eqNullSafe(F.col("_now.build"))
    ready = F.col("_now.settled") & (F.col("_last").isNull() | ~F.col("_last.settled") | differs)
    return own.select(*[F.col(quoted(c)) for c in reports.columns], F.col("_last").isNotNull().alias("seen"), F.col("_last.build").alias("before"), differs.alias("changed"), ready.alias("ready"))


def remembered_by_any_id(fresh: DataFrame, before: DataFrame, folder: str, ids: str, volume: str, online: DataFrame) -> DataFrame:
    """Fresh installs, and remembered ones of which neither the folder nor any id was seen again, whose volume is offline or the same.

    `before` has the volume where the install was; `online` (folder, volume) says which volume a folder is on now, and has no row
    for folders that can't be reached. Null volumes differ from all others.
    """
    seen = fresh.select(F.explode(ids).alias("_id")).distinct()
    hit = before.select(F.col(quoted(folder)).alias("_hit"), F.explode(ids).alias("_id")).join(seen, "_id", "left_semi").select("_hit").distinct()
    old = before.join(hit, F.col(quoted(folder)) == F.col("_hit"), "left_anti").join(fresh.select(F.col(quoted(folder)).alias("_f")).distinct(), F.col(quoted(folder)) == F.col("_f"), "left_anti")
    now = online.select(F.col(quoted(folder)).alias("_on"), F.col(quoted(volume)).alias("_volume"))
    old = old.join(now, F.col(quoted(folder)) == F.col("_on"), "left").where(F.col("_on").isNull() | (F.col("_volume") == F.col(quoted(volume))))
    return fresh.withColumn("remembered", F.lit(False)).unionByName(old.select(*fresh.columns).withColumn("remembered", F.lit(True)))


def due_with_baselines(scans: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order, due) of each scan (columns build, enabled, idle, paused, healthy, drive, started) of each install, folded in order.

    An unhealthy scan tells nothing. Another drive sets a new baseline. An install is new if it has no baseline although its location
    was started before; changed if its baseline was enabled and the build differs (null equals null). New and changed ones keep
    their baseline until they were due and dealt with, all others get a new one. An install's scans are few.
    """
    cells = ["build", "enabled", "idle", "paused", "healthy", "drive", "started"]
    rows = scans.groupBy(F.col(quoted(key)).alias("_key")).agg(F.array_sort(F.collect_list(F.struct(F.col(quoted(order)).alias("at"), *cells))).alias("all"))
    none = F.lit(None)

    def step(state, s):
        has, healthy = state["has"], s["healthy"]
        moved = has & ~state["drive"].eqNullSafe(s["drive"])
        wanted = F.when(moved, F.lit(False)).otherwise((has & state["enabled"] & ~state["build"].eqNullSafe(s["build"])) | (~has & s["started"]))
        due = healthy & wanted & s["enabled"] & s["idle"] & ~s["paused"]
        keep = ~healthy | wanted
        pick = lambda old, new: F.when(keep, old).otherwise(new)
        return F.struct(
            pick(has, F.lit(True)).alias("has"), pick(state["build"], s["build"]).alias("build"), pick(state["enabled"], s["enabled"]).alias("enabled"), pick(state["drive"], s["drive"]).alias("drive"),
            F.concat(state["out"], F.array(F.struct(s["at"].alias("at"), due.alias("due")))).alias("out"),
        )

    kind = scans.schema[order].dataType.simpleString()
    start = F.struct(F.lit(False).alias("has"), none.cast("string").alias("build"), F.lit(False).alias("enabled"), none.cast("string").alias("drive"), F.array().cast(f"array<struct<at:{kind},due:boolean>>").alias("out"))
    folded = rows.select("_key", F.aggregate("all", start, step, lambda s: s["out"]).alias("out"))
    return folded.select(F.col("_key").alias(key), F.explode("out").alias("o")).select(key, F.col("o.at").alias(order), "o.due")
