"""Queries of estimates and stores over the bytes of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.operators import estimates as E
from stowage.operators import paths as P
from stowage.operators import stores as T
from stowage.session import checkpointed, table

#: Chunks that fit the documents' sizes: least, most, mask bits.
SIZES = (256, 4096, 8)


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files: their sources are installs."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", "source", "kind", F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 19, "0")).alias("path"), F.encode("text", "UTF-8").alias("content"))


def document_estimates(spark, d):
    return E.file_estimates(_files(spark, d).select("doc_id", "content"), "content", level=15, mount=3, measured=F.when(F.col("doc_id") % 3 == 0, 0.25))


def document_pairs(spark, d):
    return E.paired_estimates(_files(spark, d).select("doc_id", "content"), "content", F.lit(2 * 1024 * 1024))


def install_estimate(spark, d):
    """What a pass over each source would save."""
    return E.install_estimates(_files(spark, d), ["source"], "path", "content", recorded=F.when(F.col("doc_id") % 5 == 0, 9), budget=200_000)


def analysis_estimate(spark, d):
    return E.analysis_estimates(_files(spark, d), ["source"], "path", "content")


def document_levels(spark, d):
    return E.chosen_levels(_files(spark, d).select("doc_id", "content"), "content", 9, 15)


def small_file_estimate(spark, d):
    return E.small_file_sample(_files(spark, d), "source", "path", "content", F.col("kind"), 8 * 1024 * 1024)


def proxy_totals(spark, d):
    """Bytes of each source under the 32 KiB proxy, in whole clusters."""
    rows = _files(spark, d).select("source", F.octet_length("content").cast("long").alias("size"), E.proxy_costs(F.col("content")).alias("stored"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.sum(E.kept_cost(F.col("stored"), F.col("size"))).alias("kept_bytes"))


def _store(files: DataFrame, pool: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    entries = checkpointed(T.entries_of(files, "path", "content", *SIZES))
    return entries, T.objects_of(files, "path", "content", entries, pool=pool)


def _texts(restored: DataFrame) -> DataFrame:
    return restored.select(F.substring_index("path", "/", -1).cast("long").alias("doc_id"), F.decode("content", "UTF-8").alias("text"))


def restored_documents(spark, d):
    """All documents written to a store and read back."""
    return _texts(T.restored(*_store(_files(spark, d))))


def pooled_documents(spark, d):
    """Two stores that share a pool, the second of which adds only what the first has not; read back from it."""
    files = _files(spark, d)
    one, first = _store(files.where("doc_id % 2 = 0"))
    two, second = _store(files.where("doc_id % 2 != 0"), first)
    return _texts(T.restored(one.unionByName(two), first.unionByName(second)))


def store_opened(spark, d):
    """A store's files, bytes and problems."""
    entries, objects = _store(_files(spark, d))
    bad = T.problems(entries, objects, SIZES[0]).agg(F.count(F.lit(1)).alias("problems"))
    sizes = entries.select("path", "size").distinct().agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    # one row each
    return sizes.join(F.broadcast(bad))


def range_contents(spark, d):
    """Bytes of a range of each document, from the chunks it touches alone."""
    entries, objects = _store(_files(spark, d))
    ranges = entries.select("path").distinct().select("path", (F.substring_index("path", "/", -1).cast("long") % 700).alias("from_byte"), F.lit(900).alias("length"))
    found = T.range_bytes(entries, objects, ranges)
    return found.select(F.substring_index("path", "/", -1).cast("long").alias("doc_id"), "from_byte", F.hex("data").alias("data_hex"))


def probe_reads(spark, d):
    """Head, middle and tail of the first 256 files in path order, 64 bytes each."""
    entries, objects = _store(_files(spark, d))
    first = entries.select("path", "size").distinct().orderBy("path").limit(256)
    last = F.greatest(F.col("size") - 64, F.lit(0).cast("long"))
    places = F.explode(F.array_distinct(F.array(F.lit(0).cast("long"), F.call_function("div", last, F.lit(2).cast("long")), last)))
    ranges = first.select("path", places.alias("from_byte"), F.lit(64).alias("length"))
    return T.range_bytes(entries, objects, ranges).select(F.substring_index("path", "/", -1).cast("long").alias("doc_id"), "from_byte", F.hex("data").alias("data_hex"))


def compacted_documents(spark, d):
    """A layered folder made one store: every tenth document is changed above, every thirteenth is gone."""
    base = _files(spark, d).select("doc_id", "path", "content")
    upper = base.where("doc_id % 10 = 0").select("path", F.encode(F.concat(F.decode("content", "UTF-8"), F.lit(" again")), "UTF-8").alias("content"))
    seen = P.overlay(base, upper, base.where("doc_id % 13 = 0").select("path"), "path", ["content"])
    return _texts(T.restored(*_store(checkpointed(seen.select("path", "content")))))


FUNCTIONS = [document_estimates, document_pairs, install_estimate, analysis_estimate, document_levels, small_file_estimate, proxy_totals, restored_documents, pooled_documents, store_opened, range_contents, probe_reads, compacted_documents]
QUERIES = {f.__name__: f for f in FUNCTIONS}

_HEX = "hex(encode(text))"
SQL = {
    "restored_documents": "SELECT doc_id, text FROM documents WHERE text IS NOT NULL",
    "pooled_documents": "SELECT doc_id, text FROM documents WHERE text IS NOT NULL",
    "store_opened": "SELECT count(*) AS files, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS problems FROM documents WHERE text IS NOT NULL",
    "range_contents": f"SELECT doc_id, doc_id % 700 AS from_byte, substr({_HEX}, CAST(2 * (doc_id % 700) + 1 AS BIGINT), 1800) AS data_hex FROM documents WHERE text IS NOT NULL",
    "probe_reads": f"""SELECT doc_id, from_byte, substr({_HEX}, CAST(2 * from_byte + 1 AS BIGINT), 128) AS data_hex FROM (SELECT doc_id, text, CAST(unnest(list_distinct([0, greatest(octet_length(encode(text)) - 64, 0) // 2, greatest(octet_length(encode(text)) - 64, 0)])) AS BIGINT) AS from_byte
        FROM (SELECT * FROM documents WHERE text IS NOT NULL ORDER BY coalesce(source, 'none') || '/' || lpad(CAST(doc_id AS VARCHAR), 19, '0') LIMIT 256))""",
    "compacted_documents": "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN text || ' again' ELSE text END AS text FROM documents WHERE text IS NOT NULL AND doc_id % 13 <> 0",
}
