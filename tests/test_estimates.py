import random

import zstandard
from pyspark.sql import functions as F

from stowage.operators import estimates as E


def up(n):
    return -(-n // 4096) * 4096


def cost(raw, packed, store=False):
    return up(raw) if (packed + 4096 >= raw if store else packed + 4096 > raw) else up(packed)


def size_at(data, level):
    return len(zstandard.ZstdCompressor(level=level).compress(data))


def test_file_estimates(spark):
    rng = random.Random(4)
    half = rng.randbytes(700_000) + b"text and text again " * 300_000
    data = [b"abcd" * 300_000, rng.randbytes(300_000), half, b"small", b"", None]
    df = spark.createDataFrame(list(enumerate(data)), "k int, c binary")
    got = {r["k"]: r for r in E.file_estimates(df, "c", level=9, mount=3).collect()}
    for k, c in enumerate(data):
        size = len(c or b"")
        blocks = max(1, -(-size // 131072))
        n = min(blocks, 32)
        at = [(blocks - 1) // 2 if n <= 1 else i * (blocks - 1) // (n - 1) for i in range(n)]
        pieces = [c[a * 131072 : (a + 1) * 131072] for a in at] if size else []
        sampled = sum(map(len, pieces))
        now, after = sum(cost(len(p), size_at(p, 3)) for p in pieces), sum(cost(len(p), size_at(p, 9)) for p in pieces)
        want = (size, sampled, int(now * (size / sampled)), int(after * (size / sampled))) if sampled else (size, 0, size, size)
        assert (got[k]["size"], got[k]["sampled"], got[k]["disk_now"], got[k]["disk_after"]) == want, k
    one = E.file_estimates(df.where("k = 0"), "c", measured=F.lit(0.5), allocated=F.lit(600_000).cast("long"), fixed=F.lit(True)).first()
    assert one["disk_now"] == one["disk_after"] <= 600_000


def test_paired_estimates_share_what_is_read(spark):
    rng = random.Random(6)
    data = [b"one line of text\n" * 40_000, rng.randbytes(400_000), b"x" * 3_000_000, b""]
    df = spark.createDataFrame(list(enumerate(data)), "k int, c binary")
    for cap in (2 * 1024 * 1024, 300_000):
        for r in E.paired_estimates(df, "c", F.lit(cap)).collect():
            c = data[r["k"]]
            size = len(c)
            window = max(size, 1) if size <= cap else min(131072, cap)
            n = 1 if size <= cap else max(1, cap // window)
            share = size // n
            pieces = [p for p in (c[o : o + window] for o in (min(i * share + max(share - window, 0) // 2, max(size - window, 0)) for i in range(n))) if p]
            sampled = sum(map(len, pieces))
            if not sampled:
                assert r["disk_now"] == r["native_after"] == r["store_after"] == size
                continue
            native = sum(cost(len(b), size_at(b, 9)) for p in pieces for b in (p[i : i + 131072] for i in range(0, len(p), 131072)))
            store = sum(cost(len(p), size_at(p, 19), True) for p in pieces)
            assert (r["sampled"], r["native_after"], r["store_after"]) == (sampled, int(native * (size / sampled)), int(store * (size / sampled)))


def test_equal_parts_scale_up_to_the_same_saving(spark):
    files = [("g", f"{i}", bytes([65]) * (1024 * 1024)) for i in range(6)]
    df = spark.createDataFrame(files, "g string, path string, c binary")
    whole = E.install_estimates(df, ["g"], "path", "c").first()
    part = E.install_estimates(df, ["g"], "path", "c", budget=2 * 1024 * 1024).first()
    assert part["unsampled_files"] == 4 and whole["unsampled_files"] == 0
    assert whole["disk_now"] - whole["disk_after"] == part["disk_now"] - part["disk_after"] > 0
    tried = E.install_estimates(df, ["g"], "path", "c", recorded=F.lit(9)).first()
    assert tried["disk_now"] == tried["disk_after"] == tried["sampled"] == 0 and tried["unsampled_files"] == 0


def test_levels(spark):
    cases = [(131072, 131072, 131072, False), (0, 0, 0, False), (1000, 990, 1000, False), (1048576, 1044480, 1048576, True), (8192, 12288, 131072, False)]
    df = spark.createDataFrame(cases, "low long, high long, sampled long, want boolean")
    assert all(r["want"] == r["got"] for r in df.withColumn("got", E.worth_the_level(F.col("low"), F.col("high"), F.col("sampled"))).collect())
    noise = spark.createDataFrame([(random.Random(42).randbytes(500_000),), (b"",), (None,)], "c binary")
    assert {r["level"] for r in E.chosen_levels(noise, "c", 9, 15).collect()} == {9}


def test_small_file_sample(spark):
    rng = random.Random(4)
    base = rng.randbytes(6000)
    files = [("s", f"a/{i:02}.txt", base + rng.randbytes(20)) for i in range(6)] + [("s", "a/00a.txt", bytes(30_000))]
    df = spark.createDataFrame(files, "s string, path string, c binary")
    got = E.small_file_sample(df, "s", "path", "c", F.lit("txt"), 20_000).first()
    assert (got["files"], got["bytes"], got["grouped_files"]) == (3, 3 * 6020, 3) and got["saving"] >= 4096
    assert E.analysis_estimates(df, ["s"], "path", "c").first()["files"] == 7
