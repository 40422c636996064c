"""Content: chunks cut by content, copies, encodings, and stores made of them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowage.functions.costs import NATIVE_BLOCK, SECTOR, STORE_BLOCK
from stowage.functions.names import quoted
from stowage.operators.state import running_totals

# Fixed values of the store's format: chunk sizes, boundary bits and levels.
LEAST_CHUNK, MOST_CHUNK, MASK_BITS = 512 * 1024, 4 * 1024 * 1024, 21
LEVELS, MOST_LEVELS = (9,), (9, 15, 19, 22)
GROUP_GAIN = 4096


def gear() -> np.ndarray:
    """A 64-bit number per byte, mixed by splitmix64's public finaliser."""
    with np.errstate(over="ignore"):
        z = np.arange(256, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


GEAR = gear()


def cut_points(data: bytes, least: int = LEAST_CHUNK, most: int = MOST_CHUNK, bits: int = MASK_BITS) -> list[int]:
    """Ends of the chunks. A chunk ends at the first byte from `least` on where the low `bits` of the rolling sum are zero, or at `most`.

    The low bits depend on the last `bits` bytes only, so all candidates come from shifted additions at once; it takes
    least >= bits. Empty data has no chunk.
    """
    if least < bits:
        raise ValueError("the least chunk must be as long as the mask")
    size = len(data)
    if size <= least:
        return [size] if size else []
    values = GEAR[np.frombuffer(data, dtype=np.uint8)]
    total = values.copy()
    for k in range(1, min(bits, size)):
        total[k:] += values[:-k] << np.uint64(k)
    ends = np.flatnonzero((total & np.uint64((1 << bits) - 1)) == 0) + 1
    cuts, start = [], 0
    while start < size:
        k = int(np.searchsorted(ends, start + least))
        end = int(ends[k]) if k < len(ends) and ends[k] <= start + most else start + most
        cuts.append(min(end, size))
        start = cuts[-1]
    return cuts


def content_chunks(df: DataFrame, key: str, content: str, least: int = LEAST_CHUNK, most: int = MOST_CHUNK, bits: int = MASK_BITS) -> DataFrame:
    """(key, ord, start_at, size, hash) of every chunk; null or empty content has none. The bytes cross to Python once."""

    def cut(contents: pa.Array) -> pa.Array:
        return pa.array([None if c is None else cut_points(c, least, most, bits) for c in contents.to_pylist()], pa.list_(pa.int64()))

    ends = F.arrow_udf(cut, "array<bigint>")(F.col(quoted(content)).cast("binary"))
    rows = df.select(F.col(quoted(key)).alias("key"), F.col(quoted(content)).cast("binary").alias("content"), ends.alias("ends"))
    starts = F.transform(F.col("ends"), lambda e, i: F.struct(i.alias("ord"), F.when(i == 0, F.lit(0).cast("long")).otherwise(F.element_at("ends", i)).alias("start_at"), e.alias("end_at")))
    pieces = rows.select("key", "content", F.explode(starts).alias("c"))
    size = F.col("c.end_at") - F.col("c.start_at")
    return pieces.select(F.col("key").alias(key), F.col("c.ord").cast("int").alias("ord"), F.col("c.start_at").alias("start_at"), size.alias("size"), F.sha2(F.substring("content", (F.col("c.start_at") + 1).cast("int"), size.cast("int")), 256).alias("hash"))


def unique_chunks(chunks: DataFrame, order: list[str]) -> DataFrame:
    """Distinct (hash, size) with how often each occurs and its first place. Ids follow the first place, so no thread count shows.

    Numbering all distinct chunks would gather them in one task, so `chunk_id` is the first place itself.
    """
    first = F.min(F.struct(*[F.col(quoted(c)) for c in order]))
    return chunks.groupBy("hash", "size").agg(F.count(F.lit(1)).alias("uses"), first.alias("chunk_id"))


def single_copies(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows whose key occurs once."""
    counted = rows.groupBy(*[F.col(quoted(k)) for k in keys]).agg(F.count(F.lit(1)).alias("_n"), *[F.min(F.col(quoted(c))).alias(c) for c in columns])
    return counted.where("_n = 1").drop("_n")


def chunk_offsets(chunks: DataFrame, entry: str, order: str, size: str) -> DataFrame:
    """Where each chunk of an entry starts. Cut by thousands of places, so that a very long entry is spread."""
    bucket = F.floor(F.col(quoted(order)) / 4096)
    return running_totals(chunks, [entry], [F.col(quoted(order))], bucket, F.col(quoted(size)).cast("long"), "offset")


def read_ranges(chunks: DataFrame, ranges: DataFrame, entry: str, start: str = "start_at", size: str = "size") -> DataFrame:
    """For ranges (entry, from_byte, length): the parts of chunks to read, with the place inside each; beyond the end nothing."""
    joined = chunks.join(ranges, entry)
    first = F.greatest(F.col(quoted(start)), F.col("from_byte"))
    last = F.least(F.col(quoted(start)) + F.col(quoted(size)), F.col("from_byte") + F.col("length"))
    return joined.where(last > first).select(entry, "from_byte", "ord", (first - F.col(quoted(start))).alias("skip"), (last - first).alias("take"))


def store_summary(uses: DataFrame) -> DataFrame:
    """Totals of a store from its chunk uses (hash, size, stored, codec): logical, unique, stored by codec, and duplicate bytes."""
    unique = uses.groupBy("hash", "size").agg(F.count(F.lit(1)).alias("n"), F.min("stored").alias("stored"), F.min("codec").alias("codec"))
    by = [F.coalesce(F.sum(F.when(F.col("codec") == c, F.col("stored"))), F.lit(0).cast("long")).alias(f"{c}_bytes") for c in ("raw", "zstd", "zero")]
    total = unique.agg(F.count(F.lit(1)).alias("unique_chunks"), F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("uses"), F.coalesce(F.sum(F.col("size") * F.col("n")), F.lit(0).cast("long")).alias("logical_bytes"), F.coalesce(F.sum("size"), F.lit(0).cast("long")).alias("unique_bytes"), *by)
    return total.withColumn("duplicate_bytes", F.col("logical_bytes") - F.col("unique_bytes"))


def gaps(chunks: DataFrame, entry: str, order: str, start: str, size: str) -> DataFrame:
    """Chunks that don't begin where the one before ends."""
    end = F.lag(F.col(quoted(start)) + F.col(quoted(size)), 1, 0).over(Window.partitionBy(entry).orderBy(order))
    return chunks.withColumn("expected", end).where(F.col("expected") != F.col(quoted(start))).select(entry, order, F.col(quoted(start)), "expected")


def unused(objects: DataFrame, uses: DataFrame, keys: list[str]) -> DataFrame:
    """Objects that no store uses."""
    return objects.join(uses.select(*keys).distinct(), keys, "left_anti")


def encoded_sizes(df: DataFrame, content: str, levels: tuple[int, ...] = LEVELS, name: str = "encoded") -> DataFrame:
    """`df` with a struct (codec, stored, level): zero for zeros only, else the smallest level (the first wins a tie), else raw.

    One crossing to Python for all levels. Null and empty content is raw with 0 bytes.
    """
    kind = pa.struct([("codec", pa.string()), ("stored", pa.int64()), ("level", pa.int32())])

    def encode(contents: pa.Array) -> pa.Array:
        import zstandard

        tools = [(level, zstandard.ZstdCompressor(level=level)) for level in levels]
        return pa.array([encoding(c, tools) for c in contents.to_pylist()], kind)

    return df.withColumn(name, F.arrow_udf(encode, "struct<codec:string,stored:bigint,level:int>")(F.col(quoted(content)).cast("binary")))


def encoding(content: bytes | None, tools: list) -> dict:
    if not content:
        return {"codec": "raw", "stored": 0, "level": 0}
    if not content.strip(b"\0"):
        return {"codec": "zero", "stored": 0, "level": 0}
    stored, level = min(((len(tool.compress(content)), level) for level, tool in tools), key=lambda x: x[0])
    return {"codec": "zstd", "stored": stored, "level": level} if stored < len(content) else {"codec": "raw", "stored": len(content), "level": 0}


def encoded_contents(df: DataFrame, content: str, levels: tuple[int, ...] = LEVELS, name: str = "encoded") -> DataFrame:
    """`df` with a struct (codec, payload): the bytes that a store keeps for the content, by the rule of `encoded_sizes`."""
    kind = pa.struct([("codec", pa.string()), ("payload", pa.binary())])

    def encode(contents: pa.Array) -> pa.Array:
        import zstandard

        tools = {level: zstandard.ZstdCompressor(level=level) for level in levels}
        out = []
        for c in contents.to_pylist():
            got = encoding(c, list(tools.items()))
            out.append({"codec": got["codec"], "payload": tools[got["level"]].compress(c) if got["codec"] == "zstd" else b"" if got["codec"] == "zero" else c or b""})
        return pa.array(out, kind)

    return df.withColumn(name, F.arrow_udf(encode, "struct<codec:string,payload:binary>")(F.col(quoted(content)).cast("binary")))


def intact(codec: Column, payload: Column, size: Column, digest: Column) -> Column:
    """Whether a stored chunk decodes to bytes of the recorded length and SHA-256. Damaged, cut or unknown ones do not."""

    def decode(codecs: pa.Array, payloads: pa.Array, sizes: pa.Array) -> pa.Array:
        import zstandard

        tool, out = zstandard.ZstdDecompressor(), []
        for c, data, n in zip(codecs.to_pylist(), payloads.to_pylist(), sizes.to_pylist()):
            if c == "zstd":
                try:
                    data = tool.decompress(data)
                except zstandard.ZstdError:
                    data = None
            elif c == "zero":
                data = b"\0" * n
            elif c != "raw":
                data = None
            out.append(data)
        return pa.array(out, pa.binary())

    decoded = F.arrow_udf(decode, "binary")(codec, payload, size)
    return F.coalesce((F.octet_length(decoded) == size) & (F.sha2(decoded, 256) == digest), F.lit(False))


#: (level, native) of each profile of the benchmark.
PROFILES = ((3, True), (9, True), (15, True), (9, False), (15, False), (19, False))


def profile_costs(content: Column) -> Column:
    """Bytes that content costs under each of PROFILES: native in sectors of each block, else in frames no larger than raw.

    What doesn't decode to the same bytes again fails.
    """

    def cost(contents: pa.Array) -> pa.Array:
        import zstandard

        tools, back = [(zstandard.ZstdCompressor(level=level), native) for level, native in PROFILES], zstandard.ZstdDecompressor()
        return pa.array([[sum(unit_cost(c[i : i + step], tool, back, native) for i in range(0, len(c), step)) for tool, native in tools for step in [NATIVE_BLOCK if native else STORE_BLOCK]] for c in contents.to_pylist()], pa.list_(pa.int64()))

    return F.arrow_udf(cost, "array<bigint>")(F.coalesce(content.cast("binary"), F.lit(b"")))


def unit_cost(unit: bytes, tool, back, native: bool) -> int:
    packed = tool.compress(unit)
    if back.decompress(packed) != unit:
        raise ValueError("what was compressed doesn't decode to the same bytes")
    if not native:
        return min(len(packed), len(unit))
    kept = len(unit) if len(packed) + SECTOR > len(unit) else len(packed)
    return -(-kept // SECTOR) * SECTOR


@dataclass
class Fold:
    """A sequential rule over ordered rows of a group: `start` makes its state, `step(state, value)` gives (state, result)."""

    start: object
    step: object


def next_fit(most: int) -> Fold:
    """Frames of up to `most` bytes: a file that doesn't fit opens the next frame."""

    def step(state, size):
        frame, filled = state
        if filled and filled + size > most:
            frame, filled = frame + 1, 0
        return (frame, filled + size), frame

    return Fold((0, 0), step)


def spending(budget: int, cap: int, least: int) -> Fold:
    """Bytes each file may be sampled by, from a budget spent by what is read; a file larger than what is left of less than `least` gets none."""

    def step(left, size):
        if left <= 0 or (left < least and size > left):
            return left, 0
        take = min(size, cap, left)
        return left - take, take

    return Fold(budget, step)


def folded(df: DataFrame, group: list[str], order: list[str], value: str, rule: Fold, name: str, tasks: int | None = None) -> DataFrame:
    """Each row with the rule's result, in the order of its group.

    The rule needs the rows before, so a group is one task's; it is sorted by Spark, which spills, and streamed through in
    batches that carry the state over, so no group is ever held in memory.
    """
    columns = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])
    parted = df.repartition(*([tasks] if tasks else []), *[F.col(quoted(g)) for g in group]).sortWithinPartitions(*[F.col(quoted(c)) for c in [*group, *order]])
    start, step = rule.start, rule.step

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, start
        for batch in batches:
            keys = list(zip(*(batch.column(columns.index(g)).to_pylist() for g in group)))
            out = []
            for key, size in zip(keys, batch.column(columns.index(value)).to_pylist()):
                if key != at:
                    at, state = key, start
                state, got = step(state, size or 0)
                out.append(got)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], schema=batch.schema.append(pa.field(name, pa.int64())))

    return parted.mapInArrow(run, schema)


def worthwhile_groups(files: DataFrame, group: list[str], size: str, separate: Column, grouped: Column) -> DataFrame:
    """Frames of two files or more that save GROUP_GAIN bytes at least against separate files."""
    sums = files.groupBy(*group).agg(F.count(F.lit(1)).alias("files"), F.sum(F.col(quoted(size))).alias("bytes"), F.sum(separate).alias("separate_bytes"), grouped.alias("grouped_bytes"))
    return sums.where((F.col("files") >= 2) & (F.col("grouped_bytes") + GROUP_GAIN <= F.col("separate_bytes")))


def small_file_groups(files: DataFrame, store: str, path: str, content: str, extension: Column, levels: tuple[int, ...] = MOST_LEVELS) -> tuple[DataFrame, DataFrame]:
    """Frames of a store's small files that are worth it, and their members (store, extension, frame, path).

    Only files of 1 byte up to the least chunk whose content no other file of the store has; in path order by ending, next-fit
    into frames of the largest chunk. A frame of fewer than two files, or that saves less than GROUP_GAIN, is dropped.
    """
    sized = files.select(F.col(quoted(store)).alias("store"), F.col(quoted(path)).alias("path"), extension.alias("extension"), F.col(quoted(content)).cast("binary").alias("content"))
    sized = sized.withColumn("size", F.octet_length("content").cast("long")).where((F.col("size") >= 1) & (F.col("size") < LEAST_CHUNK))
    lone = single_copies(sized.withColumn("hash", F.sha2("content", 256)), ["store", "hash", "size"], ["extension", "path"])
    framed = folded(lone.select("store", "extension", "path", "size"), ["store", "extension"], ["path"], "size", next_fit(MOST_CHUNK), "frame")
    whole = framed.drop("extension", "size").join(sized, ["store", "path"])

    def encode(parts: pa.Array) -> pa.Array:
        import zstandard

        tools = [(level, zstandard.ZstdCompressor(level=level)) for level in levels]
        return pa.array([encoding(b"".join(p["content"] for p in frame), tools)["stored"] for frame in parts.to_pylist()], pa.int64())

    grouped = F.arrow_udf(encode, "bigint")(F.array_sort(F.collect_list(F.struct("path", "content"))))
    frames = worthwhile_groups(encoded_sizes(whole, "content", levels), ["store", "extension", "frame"], "size", F.col("encoded.stored"), grouped)
    return frames, framed.join(frames.select("store", "extension", "frame"), ["store", "extension", "frame"], "left_semi")


def corpus_digest(files: DataFrame, group: list[str], path: str, content: Column) -> DataFrame:
    """One digest per group over its files, however large the group.

    A tree of three levels: files are put into 16 million bins by the first six digits of their path's hash, each bin hashes its
    files in the order of these hashes, 4,096 bins at a time are hashed in order, and the group hashes those. So no task holds a
    group (ten billion files are some 600 a bin), and the result depends on nothing but paths and bytes.
    """
    name = F.sha2(F.col(quoted(path)).cast("binary"), 256)
    line = F.concat(name, F.lit(":"), F.sha2(F.coalesce(content.cast("binary"), F.lit(b"")), 256))
    rows = files.select(*group, F.substring(name, 1, 6).alias("_bin"), line.alias("_line"), F.lit(1).cast("long").alias("_n"))
    for digits in (6, 3, 0):
        lines = F.sha2(F.array_join(F.array_sort(F.collect_list("_line")), "\n"), 256)
        above = [F.substring("_bin", 1, digits).alias("_bin")] if digits else []
        rows = rows.groupBy(*group, *above).agg(lines.alias("_digest"), F.sum("_n").alias("_n"))
        if digits:
            rows = rows.select(*group, "_bin", F.concat("_bin", F.lit(":"), "_digest").alias("_line"), "_n")
    return rows.select(*group, F.col("_n").alias("files"), F.col("_digest").alias("digest"))
