"""What compression would save, from samples of the files' bytes.

One crossing to Python per file gives the lengths of the sampled pieces at each level; all arithmetic on them stays in
the JVM. A model says how large the pieces are and what a piece costs on disk.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions import costs
from stowage.functions.names import quoted
from stowage.operators.chunks import folded, small_file_groups, spending
from stowage.operators.state import running_totals

# What a file must save, what is read of each file and of an install, and levels.
WORTH = 4096
INSTALL_BUDGET = 512 * 1024 * 1024
PREVIEW_BUDGET, PREVIEW_CAP, PREVIEW_LEAST = 32 * 1024 * 1024, 2 * 1024 * 1024, 128 * 1024
LEVEL_SAMPLES, DEFAULT_MOUNT = 8, 3
LONG = "long"


@dataclass(frozen=True)
class UnitModel:
    """How content is cut and what a piece costs: native blocks, or a store's frames."""

    block: int = costs.NATIVE_BLOCK
    cap: int = costs.NATIVE_CAP
    store: bool = False

    def cost(self, packed: Column, raw: Column) -> Column:
        return costs.disk_cost(packed.cast(LONG), raw.cast(LONG), self.store)

    def blocks(self, size: Column) -> Column:
        return costs.blocks_of(size, self.block)

    def samples(self, size: Column, cheap: Column | None = None) -> Column:
        most = F.lit(costs.FULL_SAMPLES) if cheap is None else F.when(cheap, costs.CHEAP_SAMPLES).otherwise(costs.FULL_SAMPLES)
        return F.least(self.blocks(size), F.lit(max(1, -(-self.cap // self.block))).cast(LONG), most.cast(LONG))


NATIVE, STORE = UnitModel(), UnitModel(costs.STORE_BLOCK, costs.STORE_CAP, True)
PIECES = "array<struct<raw:bigint,packed:array<bigint>>>"
_PIECES = pa.list_(pa.struct([("raw", pa.int64()), ("packed", pa.list_(pa.int64()))]))


def piece_lengths(content: Column, offsets: Column, length: Column, levels: tuple[int, ...]) -> Column:
    """For each offset the length of the piece there and its compressed lengths at the levels; null content has no pieces."""

    def measure(contents: pa.Array, starts: pa.Array, sizes: pa.Array) -> pa.Array:
        import zstandard

        tools, out = [zstandard.ZstdCompressor(level=level) for level in levels], []
        for data, own, size in zip(contents.to_pylist(), starts.to_pylist(), sizes.to_pylist()):
            pieces = [data[a : a + size] for a in own or [] if a < len(data)] if data else []
            out.append([{"raw": len(p), "packed": [len(t.compress(p)) for t in tools]} for p in pieces if p])
        return pa.array(out, _PIECES)

    return F.arrow_udf(measure, PIECES)(content.cast("binary"), offsets, length.cast(LONG))


def total(pieces: Column, value) -> Column:
    return F.aggregate(pieces, F.lit(0).cast(LONG), lambda s, p: s + value(p).cast(LONG))


def _each(n: Column, value) -> Column:
    return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast(LONG), F.greatest(n, F.lit(1)).cast(LONG) - 1), value)).otherwise(F.array().cast("array<bigint>"))


def cost_now(model: UnitModel, mount: Column, measured: Column, p) -> Column:
    """What a piece takes now: as measured, else at the level that the mount compresses with, else raw. packed[1] is at the mount's level."""
    raw, packed = model.cost(p["raw"], p["raw"]), model.cost(p["packed"][1], p["raw"])
    part = F.least(F.greatest(measured.cast("double"), F.lit(0.0)), F.lit(1.0))
    blend = (part * packed + (1 - part) * raw).cast(LONG)
    return F.when(measured.isNotNull(), F.when(part <= 0, raw).otherwise(blend)).when(mount.isNotNull(), packed).otherwise(raw)


def scaled(value: Column, size: Column, sampled: Column) -> Column:
    """A sum over samples for the whole file, cut to whole bytes."""
    return (value.cast("double") * (size.cast("double") / F.nullif(sampled, F.lit(0).cast(LONG)).cast("double"))).cast(LONG)


def priced(now: Column, after: Column, size: Column, allocated: Column, fixed: Column) -> tuple[Column, Column]:
    """(now, after) of a file with holes, by its allocated share, and of one that can't be rewritten (`fixed`), which saves nothing."""
    share = allocated.cast("double") / F.nullif(size, F.lit(0).cast(LONG)).cast("double")
    sparse = F.coalesce(allocated < size, F.lit(False))
    less = F.least(now, allocated, (now.cast("double") * share).cast(LONG))
    saving = F.greatest(now - after, F.lit(0).cast(LONG))
    then = less - F.least((saving.cast("double") * share).cast(LONG), less)
    now_, after_ = F.when(sparse, less).otherwise(now), F.when(sparse, then).otherwise(after)
    return now_, F.when(F.coalesce(fixed, F.lit(False)), now_).otherwise(after_)


def file_estimates(files: DataFrame, content: str, model: UnitModel = NATIVE, level: int = 9, mount: int | None = None, measured: Column | None = None, allocated: Column | None = None, fixed: Column | None = None, cheap: Column | None = None) -> DataFrame:
    """`files` without the content, with size, sampled, disk_now and disk_after.

    measured: share of the file that is compressed already; allocated: bytes that it takes (holes); fixed: not rewritten. A file
    of which nothing is sampled (empty, null) keeps its size.
    """
    none = F.lit(None)
    data = F.col(quoted(content)).cast("binary")
    rows = files.withColumn("size", F.coalesce(F.octet_length(data), F.lit(0)).cast(LONG))
    n, blocks = model.samples(F.col("size"), cheap), model.blocks(F.col("size"))
    offsets = _each(n, lambda i: costs.sample_block(i, n, blocks) * model.block)
    rows = rows.withColumn("_pieces", piece_lengths(data, offsets, F.lit(model.block), (level, DEFAULT_MOUNT if mount is None else mount)))
    pieces = F.col("_pieces")
    at, part = F.lit(mount), (none.cast("double") if measured is None else measured)
    rows = rows.withColumn("sampled", total(pieces, lambda p: p["raw"])).withColumn("_now", total(pieces, lambda p: cost_now(model, at, part, p))).withColumn("_after", total(pieces, lambda p: model.cost(p["packed"][0], p["raw"])))
    now, after = priced(scaled(F.col("_now"), F.col("size"), F.col("sampled")), scaled(F.col("_after"), F.col("size"), F.col("sampled")), F.col("size"), none.cast(LONG) if allocated is None else allocated, F.lit(False) if fixed is None or model.store else fixed)
    unread = F.col("sampled") == 0
    return rows.withColumn("disk_now", F.when(unread, F.col("size")).otherwise(now)).withColumn("disk_after", F.when(unread, F.col("size")).otherwise(after)).drop("_pieces", "_now", "_after", content)


def paired_estimates(files: DataFrame, content: str, cap: Column, native: UnitModel = NATIVE, store: UnitModel = STORE, level: int = 9, most: int = 19, window: int = PREVIEW_LEAST) -> DataFrame:
    """`files` without the content, with size, sampled, disk_now, native_after and store_after, from bytes that both share.

    cap: bytes of each file that may be read. A file that fits is read whole, else windows are spread over it.
    """
    data = F.col(quoted(content)).cast("binary")
    rows = files.withColumn("size", F.coalesce(F.octet_length(data), F.lit(0)).cast(LONG)).withColumn("_cap", cap.cast(LONG))
    fits = F.col("size") <= F.col("_cap")
    wide = F.when(fits, F.greatest(F.col("size"), F.lit(1).cast(LONG))).otherwise(F.least(F.lit(window).cast(LONG), F.greatest(F.col("_cap"), F.lit(1).cast(LONG))))
    rows = rows.withColumn("_window", wide)
    n = F.when(fits, F.lit(1).cast(LONG)).otherwise(F.greatest(costs.quotient(F.col("_cap"), F.col("_window")), F.lit(1).cast(LONG)))
    starts = _each(n, lambda i: costs.stratum_offset(i, n, F.col("size"), F.col("_window")))
    whole = "array<struct<raw:bigint,packed:bigint,blocks:array<struct<raw:bigint,packed:array<bigint>>>>>"
    kind = pa.list_(pa.struct([("raw", pa.int64()), ("packed", pa.int64()), ("blocks", _PIECES)]))

    def measure(contents: pa.Array, offsets: pa.Array, sizes: pa.Array) -> pa.Array:
        import zstandard

        low, high, out = zstandard.ZstdCompressor(level=level), zstandard.ZstdCompressor(level=most), []
        for data, own, size in zip(contents.to_pylist(), offsets.to_pylist(), sizes.to_pylist()):
            windows = [data[a : a + size] for a in own or [] if a < len(data)] if data else []
            out.append([{"raw": len(w), "packed": len(high.compress(w)), "blocks": [{"raw": len(b), "packed": [len(low.compress(b))]} for b in (w[i : i + native.block] for i in range(0, len(w), native.block))]} for w in windows if w])
        return pa.array(out, kind)

    rows = rows.withColumn("_windows", F.arrow_udf(measure, whole)(data, starts, F.col("_window")))
    windows = F.col("_windows")
    inner = lambda value: total(windows, lambda w: total(w["blocks"], value))
    rows = rows.withColumn("sampled", total(windows, lambda w: w["raw"])).withColumn("_now", inner(lambda b: native.cost(b["raw"], b["raw"]))).withColumn("_native", inner(lambda b: native.cost(b["packed"][0], b["raw"]))).withColumn("_store", total(windows, lambda w: store.cost(w["packed"], w["raw"])))
    out = rows
    for name, own in (("disk_now", "_now"), ("native_after", "_native"), ("store_after", "_store")):
        out = out.withColumn(name, F.when(F.col("sampled") == 0, F.col("size")).otherwise(scaled(F.col(own), F.col("size"), F.col("sampled"))))
    return out.drop("_cap", "_window", "_windows", "_now", "_native", "_store", content)


def install_estimates(files: DataFrame, group: list[str], path: str, content: str, model: UnitModel = NATIVE, level: int = 9, recorded: Column | None = None, budget: int = INSTALL_BUDGET, cap: int = costs.NATIVE_CAP, floor: int = 4096) -> DataFrame:
    """One row per group: what a pass would save, largest files first within a budget, scaled up to the files it leaves out.

    recorded: level that a file was tried at before; at `level` or above it counts no saving and costs no budget. Only files above
    `floor` are candidates, and only those that save WORTH bytes at least count.
    """
    size = F.coalesce(F.octet_length(F.col(quoted(content)).cast("binary")), F.lit(0)).cast(LONG)
    tried = F.lit(False) if recorded is None else F.coalesce(recorded >= level, F.lit(False))
    rows = files.select(*group, F.col(quoted(path)).alias("path"), F.col(quoted(content)).alias("content"), size.alias("bytes"), tried.alias("tried")).where(F.col("bytes") > floor)
    charge = F.when(F.col("tried"), F.lit(0).cast(LONG)).otherwise(F.least("bytes", F.lit(cap).cast(LONG)))
    # the content is no part of the order, so it is left out of it
    placed = running_totals(rows.select(*group, "path", "bytes", "tried"), group, [F.col("bytes").desc(), F.col("path").asc()], -F.floor(F.log2(F.col("bytes").cast("double")) * 16), charge, "spent").select(*group, "path", "spent")
    rows = rows.join(placed, [*group, "path"])
    read = ~F.col("tried") & (F.col("spent") < budget)
    measured = file_estimates(rows.withColumn("_read", read).withColumn("content", F.when(read, F.col("content"))), "content", model, level)
    saved = F.when(F.col("_read"), F.greatest(F.col("disk_now") - F.col("disk_after"), F.lit(0).cast(LONG))).otherwise(0)
    worth = F.col("_read") & (F.col("disk_now") > 0) & (saved >= WORTH)
    left = ~F.col("_read") & ~F.col("tried")
    amount = lambda test, value: F.coalesce(F.sum(F.when(test, value)), F.lit(0).cast(LONG))
    sums = measured.groupBy(*group).agg(
        F.count(F.lit(1)).alias("files"), F.count_if(worth).alias("worth_files"), F.count_if(left).alias("unsampled_files"), amount(F.col("_read"), F.col("bytes")).alias("_seen"), amount(left, F.col("bytes")).alias("unsampled_bytes"),
        amount(worth, F.col("bytes")).alias("_bytes"), amount(worth, F.col("disk_now")).alias("_now"), amount(worth, F.col("disk_after")).alias("_after"), amount(F.lit(True), F.col("sampled")).alias("sampled"),
    )
    factor = F.coalesce(F.col("unsampled_bytes").cast("double") / F.nullif(F.col("_seen"), F.lit(0).cast(LONG)).cast("double"), F.lit(0.0))
    whole = [(F.col(own) + (F.col(own).cast("double") * factor).cast(LONG)).alias(name) for own, name in (("_bytes", "rewrite_bytes"), ("_now", "disk_now"), ("_after", "disk_after"))]
    return sums.select(*group, "files", "worth_files", "unsampled_files", "unsampled_bytes", "sampled", *whole)


def analysis_estimates(files: DataFrame, group: list[str], path: str, content: str, floor: int = 4096, budget: int = PREVIEW_BUDGET, most: int = 19) -> DataFrame:
    """One row per group: native and store side by side from a budget spent by what is read, largest first. A file counts if either saves enough."""
    rows = files.select(*group, F.col(quoted(path)).alias("path"), F.col(quoted(content)).cast("binary").alias("content"))
    slim = rows.select(*group, "path", F.octet_length("content").cast(LONG).alias("bytes")).where(F.col("bytes") > floor).withColumn("turn", -F.col("bytes"))
    taken = folded(slim, group, ["turn", "path"], "bytes", spending(budget, PREVIEW_CAP, PREVIEW_LEAST), "cap").where("cap > 0").select(*group, "path", "cap")
    measured = paired_estimates(rows.join(taken, [*group, "path"]), "content", F.col("cap"), most=most)
    enough = lambda after: (F.col("disk_now") > 0) & (F.col("disk_now") - F.col(after) >= WORTH)
    either = enough("native_after") | enough("store_after")
    part = lambda after: F.coalesce(F.sum(F.when(either, F.when(enough(after), F.col(after)).otherwise(F.col("disk_now")))), F.lit(0).cast(LONG)).alias(after)
    return measured.groupBy(*group).agg(F.count(F.lit(1)).alias("files"), F.count_if(either).alias("worth_files"), F.sum("sampled").alias("sampled"), F.coalesce(F.sum(F.when(either, F.col("disk_now"))), F.lit(0).cast(LONG)).alias("disk_now"), part("native_after"), part("store_after"))


def worth_the_level(low: Column, high: Column, sampled: Column) -> Column:
    return (sampled > 0) & (F.greatest(low - high, F.lit(0).cast(LONG)) >= WORTH)


def chosen_levels(files: DataFrame, content: str, low: int, high: int, model: UnitModel = NATIVE) -> DataFrame:
    """`files` without the content, with the level for each: the high one if eight blocks at most save a sector more by it."""
    data = F.col(quoted(content)).cast("binary")
    rows = files.withColumn("_size", F.coalesce(F.octet_length(data), F.lit(0)).cast(LONG))
    blocks = model.blocks(F.col("_size"))
    n = F.least(blocks, F.lit(LEVEL_SAMPLES).cast(LONG))
    rows = rows.withColumn("_pieces", piece_lengths(data, _each(n, lambda i: costs.sample_block(i, n, blocks) * model.block), F.lit(model.block), (low, high)))
    cost = lambda k: total(F.col("_pieces"), lambda p: model.cost(p["packed"][k], p["raw"]))
    better = worth_the_level(cost(0), cost(1), total(F.col("_pieces"), lambda p: p["raw"]))
    return rows.withColumn("level", F.when(better, high).otherwise(low) if low < high else F.lit(low)).drop("_pieces", "_size", content)


def small_file_sample(files: DataFrame, group: str, path: str, content: str, extension: Column, budget: int, level: int = 19) -> DataFrame:
    """What grouping the small files of each group would save beyond packing each alone, from a sample within a budget in path order: a file
    that would overstep it is passed over, later smaller ones are not."""
    rows = files.select(F.col(quoted(group)).alias("group"), F.col(quoted(path)).alias("path"), F.col(quoted(content)).cast("binary").alias("content"), extension.alias("extension"))
    slim = rows.select("group", "path", F.octet_length("content").cast(LONG).alias("bytes")).where("bytes between 1 and 524287")
    taken = folded(slim, ["group"], ["path"], "bytes", fitting(budget), "taken").where("taken > 0")
    chosen = rows.join(taken.select("group", "path"), ["group", "path"])
    frames, _ = small_file_groups(chosen, "group", "path", "content", F.col("extension"), (level,))
    saved = frames.groupBy(F.col("store").alias("group")).agg(F.sum("files").alias("grouped_files"), F.sum(F.col("separate_bytes") - F.col("grouped_bytes")).alias("saving"))
    sums = taken.groupBy("group").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))
    zero = F.lit(0).cast(LONG)
    return sums.join(saved, "group", "left").select("group", "files", "bytes", F.coalesce("grouped_files", zero).alias("grouped_files"), F.coalesce("saving", zero).alias("saving"))


def fitting(budget: int):
    """A fold that takes a file whole or not at all, and goes on behind one that doesn't fit."""
    from stowage.operators.chunks import Fold

    def step(left, size):
        return (left - size, size) if size <= left else (left, 0)

    return Fold(budget, step)


def proxy_costs(content: Column, block: int = 32 * 1024, level: int = 9) -> Column:
    """(stored, kept): bytes of content in blocks of 32 KiB behind a table of offsets (four bytes each, eight from 4 GiB on), and what is kept: that if it takes fewer clusters than raw."""

    def measure(contents: pa.Array) -> pa.Array:
        import zlib

        out = []
        for data in contents.to_pylist():
            size = len(data or b"")
            count = -(-size // block)
            table = max(count - 1, 0) * (4 if size < 1 << 32 else 8)
            out.append(table + sum(min(len(zlib.compress((data or b"")[i : i + block], level)), len((data or b"")[i : i + block])) for i in range(0, size, block)))
        return pa.array(out, pa.int64())

    stored = F.arrow_udf(measure, "bigint")(content.cast("binary"))
    return stored


def kept_cost(stored: Column, size: Column) -> Column:
    """Whole clusters of the stored form if these are fewer than of the raw form."""
    return F.least(costs.whole_sectors(stored), costs.whole_sectors(size))
