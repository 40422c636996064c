"""Stores as two tables: entries, which chunks a file is made of, and objects, the chunks' bytes as they are kept.

Writing cuts files by content and keeps each distinct chunk once, in a store of its own or in a pool that several stores share.
Reading decodes a chunk only if its length and hash come out as recorded.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions.names import quoted
from stowage.operators import chunks as C
from stowage.operators.paths import safe_relative

LONG = "long"


def entries_of(files: DataFrame, path: str, content: str, least: int = C.LEAST_CHUNK, most: int = C.MOST_CHUNK, bits: int = C.MASK_BITS) -> DataFrame:
    """(path, size, ord, start_at, length, hash) of every chunk of every file; an empty file has one row without a chunk.

    Null contents are no files. Paths must be unique.
    """
    rows = files.select(F.col(quoted(path)).alias("path"), F.col(quoted(content)).cast("binary").alias("content")).where("content is not null")
    cut = C.content_chunks(rows, "path", "content", least, most, bits).withColumnRenamed("size", "length")
    sizes = rows.select("path", F.octet_length("content").cast(LONG).alias("size"))
    return sizes.join(cut, "path", "left").select("path", "size", "ord", "start_at", "length", "hash")


def objects_of(files: DataFrame, path: str, content: str, entries: DataFrame, levels: tuple[int, ...] = C.LEVELS, pool: DataFrame | None = None) -> DataFrame:
    """(hash, length, codec, payload) of each distinct chunk that the pool, if there is one, doesn't have yet.

    Each chunk is encoded where it is first, by path and place, so the result depends on nothing else.
    """
    wanted = entries.where("hash is not null").groupBy("hash", "length").agg(F.min(F.struct("path", "ord", "start_at")).alias("first"))
    if pool is not None:
        wanted = wanted.join(pool.select("hash", "length"), ["hash", "length"], "left_anti")
    rows = files.select(F.col(quoted(path)).alias("path"), F.col(quoted(content)).cast("binary").alias("content"))
    placed = wanted.select("hash", "length", F.col("first.path").alias("path"), F.col("first.start_at").alias("start_at")).join(rows, "path")
    piece = F.substring("content", (F.col("start_at") + 1).cast("int"), F.col("length").cast("int"))
    kept = C.encoded_contents(placed.select("hash", "length", piece.alias("piece")), "piece", levels)
    return kept.select("hash", "length", "encoded.codec", "encoded.payload")


def decoded(codec: Column, payload: Column, length: Column, digest: Column) -> Column:
    """The bytes of a kept chunk, null unless they have the recorded length and SHA-256."""

    def decode(codecs: pa.Array, payloads: pa.Array, sizes: pa.Array) -> pa.Array:
        import zstandard

        tool, out = zstandard.ZstdDecompressor(), []
        for c, data, n in zip(codecs.to_pylist(), payloads.to_pylist(), sizes.to_pylist()):
            try:
                out.append(tool.decompress(data) if c == "zstd" else b"\0" * n if c == "zero" else data if c == "raw" else None)
            except zstandard.ZstdError:
                out.append(None)
        return pa.array(out, pa.binary())

    data = F.arrow_udf(decode, "binary")(codec, payload, length)
    return F.when((F.octet_length(data) == length) & (F.sha2(data, 256) == digest), data)


def _joined(parts: Column) -> Column:
    """Bytes of pieces (ord, data) in order."""
    return F.unhex(F.array_join(F.transform(F.array_sort(parts), lambda p: F.hex(p["data"])), ""))


def restored(entries: DataFrame, objects: DataFrame) -> DataFrame:
    """(path, content, bad): every file put together again, and how many of its chunks are missing or damaged (content is null then)."""
    known = objects.select("hash", "length", "codec", "payload")
    parts = entries.join(known, ["hash", "length"], "left").withColumn("data", decoded(F.col("codec"), F.col("payload"), F.col("length"), F.col("hash")))
    bad = F.count_if(F.col("hash").isNotNull() & F.col("data").isNull())
    whole = parts.groupBy("path", "size").agg(bad.alias("bad"), F.collect_list(F.when(F.col("data").isNotNull(), F.struct("ord", "data"))).alias("parts"))
    content = F.when(F.col("size") == 0, F.lit(b"")).otherwise(_joined(F.col("parts")))
    return whole.select("path", F.when((F.col("bad") == 0) & (F.octet_length(content) == F.col("size")), content).alias("content"), "bad")


def range_bytes(entries: DataFrame, objects: DataFrame, ranges: DataFrame, most: int = C.MOST_CHUNK) -> DataFrame:
    """(path, from_byte, data) for ranges (path, from_byte, length): only the chunks they touch are decoded.

    A range is cut to `most` bytes and at the file's end; behind it data is empty. Null if a chunk that is touched is missing or damaged.
    """
    asked = ranges.select("path", "from_byte", F.least(F.col("length").cast(LONG), F.lit(most).cast(LONG)).alias("want")).distinct()
    rows = asked.join(entries.where("hash is not null"), "path")
    first, last = F.greatest("start_at", "from_byte"), F.least(F.col("start_at") + F.col("length"), F.col("from_byte") + F.col("want"))
    touched = rows.where(last > first).join(objects.select("hash", "length", "codec", "payload"), ["hash", "length"], "left")
    data = decoded(F.col("codec"), F.col("payload"), F.col("length"), F.col("hash"))
    pieces = touched.select("path", "from_byte", "want", "ord", F.substring(data, (first - F.col("start_at") + 1).cast("int"), (last - first).cast("int")).alias("data"))
    whole = pieces.groupBy("path", "from_byte", "want").agg(F.count_if(F.col("data").isNull()).alias("bad"), F.collect_list(F.when(F.col("data").isNotNull(), F.struct("ord", "data"))).alias("parts"))
    there = entries.select("path").distinct()
    out = asked.join(there, "path").join(whole, ["path", "from_byte", "want"], "left")
    return out.select("path", "from_byte", F.when(F.col("parts").isNull(), F.lit(b"")).when(F.col("bad") == 0, _joined(F.col("parts"))).alias("data"))


def problems(entries: DataFrame, objects: DataFrame, least: int = C.LEAST_CHUNK) -> DataFrame:
    """(path, problem) of what is wrong with a store: unsafe paths, gaps and overlaps, sizes that don't add up, short chunks before the last,
    too many pieces, chunks without an object, objects that nobody uses (path is then their hash), and codecs that can't be."""
    cut = entries.where("hash is not null")
    order = Window.partitionBy("path").orderBy("ord")
    end = F.lag(F.col("start_at") + F.col("length"), 1, 0).over(order)
    lined = cut.withColumn("_end", end).withColumn("_last", F.lead("ord").over(order).isNull())
    checks = [
        entries.where(~safe_relative(F.col("path"))).select("path", F.lit("path").alias("problem")),
        lined.where("start_at != _end").select("path", F.lit("gap")),
        lined.where((F.col("length") < least) & ~F.col("_last")).select("path", F.lit("short")),
        entries.groupBy("path", "size").agg(F.coalesce(F.sum("length"), F.lit(0).cast(LONG)).alias("sum"), F.count("hash").alias("n")).where((F.col("sum") != F.col("size")) | (F.col("n") > F.ceil(F.col("size") / least))).select("path", F.lit("size")),
        cut.join(objects.select("hash", "length"), ["hash", "length"], "left_anti").select("path", F.lit("missing")),
        objects.join(cut.select("hash", "length"), ["hash", "length"], "left_anti").select("hash", F.lit("unused")),
        objects.where(~_sound(F.col("codec"), F.octet_length("payload").cast(LONG), F.col("length"))).select("hash", F.lit("codec")),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionAll(c)
    return out.distinct()


def _sound(codec: Column, stored: Column, length: Column) -> Column:
    return F.when(codec == "raw", stored == length).when(codec == "zstd", (stored > 0) & (stored < length)).when(codec == "zero", stored == 0).otherwise(F.lit(False))
