import hashlib
import random

import zstandard
from pyspark.sql import functions as F

from stowage.operators import chunks, paths
from stowage.plans import reference as R

DIRECTORY = "/root/testdata/sf0.001"


def test_damaged_chunks_are_bad(spark):
    data = [b"ab" * 400, bytes(100), random.Random(2).randbytes(90), b"", None]
    rows = chunks.encoded_contents(spark.createDataFrame([(d,) for d in data], "c binary"), "c").select("c", "encoded.*").collect()
    assert [r["codec"] for r in rows] == ["zstd", "zero", "raw", "raw", "raw"]
    cases = [(r["codec"], bytes(r["payload"]), len(d or b""), hashlib.sha256(d or b"").hexdigest(), True) for d, r in zip(data, rows)]
    codec, payload, size, digest, _ = cases[0]
    other = zstandard.ZstdCompressor(level=9).compress(b"ba" * 400)
    cases += [(codec, payload[:-3], size, digest, False), (codec, b"", size, digest, False), (codec, other, size, digest, False), (codec, payload, size + 1, digest, False), ("lzx", payload, size, digest, False), ("zero", b"", 99, cases[1][3], False), ("raw", cases[2][1][:-1] + b"?", 90, cases[2][3], False)]
    df = spark.createDataFrame(cases, "codec string, payload binary, size long, digest string, want boolean")
    got = df.withColumn("got", chunks.intact(F.col("codec"), F.col("payload"), F.col("size"), F.col("digest"))).collect()
    assert all(r["got"] == r["want"] for r in got) and len(got) == len(cases)


def test_frames_need_gain_and_two_files(spark):
    rng = random.Random(4)
    base = rng.randbytes(6000)
    files = [("s", f"a/{i:02}.txt", base + rng.randbytes(20)) for i in range(4)]
    files += [("s", "a/copy1.txt", b"same" * 50), ("s", "b/copy2.txt", b"same" * 50), ("s", "a/empty.txt", b""), ("s", "a/large.txt", bytes(chunks.LEAST_CHUNK)), ("t", "a/copy3.txt", b"same" * 50)]
    files += [("s", "one.bin", base), *[("s", f"n{i}.raw", rng.randbytes(3000)) for i in range(3)]]
    df = spark.createDataFrame(files, "store string, path string, content binary")
    frames, members = chunks.small_file_groups(df, "store", "path", "content", paths.extension(F.col("path")))
    got = frames.collect()
    assert [(r["store"], r["extension"], r["frame"], r["files"], r["bytes"]) for r in got] == [("s", "txt", 0, 4, 4 * 6020)]
    assert got[0]["grouped_bytes"] + chunks.GROUP_GAIN <= got[0]["separate_bytes"]
    assert sorted(r["path"] for r in members.collect()) == [f"a/{i:02}.txt" for i in range(4)]


def test_profiles(spark):
    data = [b"abcd" * 100_000, random.Random(1).randbytes(5000), b"", None]
    got = [r[0] for r in spark.createDataFrame([(d,) for d in data], "c binary").select(chunks.profile_costs(F.col("c"))).collect()]
    want = []
    for level, native in chunks.PROFILES:
        step = 131072 if native else 4 << 20
        sizes = [(len(data[0][i : i + step]), len(zstandard.ZstdCompressor(level=level).compress(data[0][i : i + step]))) for i in range(0, 400_000, step)]
        want.append(sum(-(-(n if packed + 4096 > n else packed) // 4096) * 4096 if native else min(n, packed) for n, packed in sizes))
    assert got == [want, [8192] * 3 + [5000] * 3, [0] * 6, [0] * 6]
    rows = R.QUERIES["codec_benchmark"](spark, DIRECTORY).collect()
    assert sorted((r["level"], r["native"]) for r in rows) == sorted(chunks.PROFILES) and len({r["bytes"] for r in rows}) == 1


def test_stores_of_documents(spark):
    assert {r["bad"] for r in R.QUERIES["chunk_verification"](spark, DIRECTORY).collect()} == {0}
    index = R.QUERIES["store_index"](spark, "/root/testdata/sf0.01").collect()
    frames = R.QUERIES["document_frames"](spark, "/root/testdata/sf0.01").collect()
    assert frames and all(r["files"] >= 2 for r in frames)
    for store in {r["store"] for r in index}:
        rows = sorted((r for r in index if r["store"] == store), key=lambda r: r["chunk_no"])
        assert [r["chunk_no"] for r in rows] == list(range(len(rows)))
        n = sum(r["store"] == store for r in frames)
        assert [r["frame"] is not None for r in rows] == [True] * n + [False] * (len(rows) - n)
        walked = [(r["path"].split("/"), r["ord"]) for r in rows[n:]]
        assert walked == sorted(walked)
    tried = R.QUERIES["encoded_documents_maximum"](spark, DIRECTORY).collect()
    assert {r["level"] for r in tried} <= {0, *chunks.MOST_LEVELS} and any(r["level"] > 9 for r in tried)
