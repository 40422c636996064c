import random

from pyspark.sql import functions as F

from stowage.operators import stores as T

SIZES = (256, 4096, 8)


def build(spark):
    rng = random.Random(3)
    noise = rng.randbytes(50_000)
    files = [("a/noise", noise), ("a/shifted", rng.randbytes(777) + noise), ("b/zeros", bytes(20_000)), ("b/text", b"line of text\n" * 3000), ("c/empty", b""), ("c/null", None)]
    df = spark.createDataFrame(files, "path string, content binary")
    entries = T.entries_of(df, "path", "content", *SIZES)
    return dict(files), df, entries, T.objects_of(df, "path", "content", entries)


def test_round_trip_and_ranges(spark):
    files, df, entries, objects = build(spark)
    got = {r["path"]: bytes(r["content"]) for r in T.restored(entries, objects).collect()}
    assert got == {p: c for p, c in files.items() if c is not None}
    assert T.problems(entries, objects, 256).collect() == []
    assert objects.count() < entries.where("hash is not null").count() and "zero" in {r["codec"] for r in objects.collect()}
    asked = [("a/noise", 100, 9000), ("a/noise", 49_990, 100), ("a/noise", 60_000, 5), ("c/empty", 0, 5), ("none", 0, 5)]
    ranges = spark.createDataFrame(asked, "path string, from_byte long, length int")
    read = {(r["path"], r["from_byte"]): bytes(r["data"]) for r in T.range_bytes(entries, objects, ranges).collect()}
    assert read == {(p, a): files[p][a : a + n] for p, a, n in asked if p in files}


def test_damage_is_seen(spark):
    files, df, entries, objects = build(spark)
    first = entries.where("path = 'a/noise' and ord = 0").first()["hash"]
    hit = objects.withColumn("payload", F.when(F.col("hash") == first, F.concat(F.lit(b"?"), F.substring("payload", 2, 100_000))).otherwise(F.col("payload")))
    got = {r["path"]: (r["content"], r["bad"]) for r in T.restored(entries, hit).collect()}
    assert got["a/noise"] == (None, 1) and bytes(got["b/zeros"][0]) == files["b/zeros"]
    gone = objects.where(F.col("hash") != first)
    assert {tuple(r) for r in T.problems(entries, gone, 256).collect() if r["problem"] == "missing"} == {("a/noise", "missing")}
    unused = {r["problem"] for r in T.problems(entries.where("path != 'b/text'"), objects, 256).collect()}
    assert unused == {"unused"}
    assert {r["problem"] for r in T.problems(entries.where("path != 'b/text' or ord != 0"), objects, 256).collect()} >= {"gap", "size"}
    assert {r["problem"] for r in T.problems(entries.withColumn("path", F.concat(F.lit("../"), "path")), objects, 256).collect()} == {"path"}
    assert {r["problem"] for r in T.problems(entries, objects.withColumn("codec", F.lit("raw")), 256).collect()} == {"codec"}


def test_a_pool_gets_only_what_is_new(spark):
    files, df, entries, objects = build(spark)
    again = T.objects_of(df, "path", "content", entries, pool=objects)
    assert again.collect() == []
    part = objects.where("codec = 'zero'")
    assert T.objects_of(df, "path", "content", entries, pool=part).count() == objects.count() - part.count()
