import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from stowage.sources import files, text
from stowage.streaming import observer


def test_key_values(spark):
    body = '﻿"AppState"\n{\n\t"appid" "1" // note\n\t"Name"\t"A \\"B\\" C:\\\\x"\n\tappid 2\n\t"sub" { "k" "v" [$WIN] }\n}'
    got = text.parse_key_values(body)
    assert got == [("", 0, "AppState", None), ("appstate", 1, "appid", "1"), ("appstate", 2, "Name", 'A "B" C:\\x'), ("appstate", 3, "appid", "2"), ("appstate", 4, "sub", None), ("appstate/sub", 5, "k", "v")]
    for bad in ('"a" {', '"a"', "}", '{ "a" "b" }', '"a" "b', "a {" * 200 + "}" * 200):
        with pytest.raises(text.KeyValueError):
            text.parse_key_values(bad)
    df = spark.createDataFrame([(1, body), (2, '"x'), (3, ""), (4, None)], "k int, t string")
    rows = text.key_values(df, "k", "t").collect()
    assert sum(r["k"] == 1 for r in rows) == 6 and [r["error"] is not None for r in rows if r["k"] == 2] == [True] and not any(r["k"] > 2 for r in rows)
    first = text.first_values(text.key_values(df, "k", "t"), "k", "appstate", ["appid", "name", "none"]).first()
    assert tuple(first) == (1, "1", 'A "B" C:\\x', None)


def test_json_fields(spark):
    df = spark.createDataFrame([('{"Title": "x", "install_path": "/a", "size": 5}',), ('{"NAME": "y", "title": null}',), ("no json",), (None,)], "r string")
    made = text.json_fields(F.col("r"), {"title": ["title", "name"], "path": ["path", "install_path"], "size": ["size"]})
    got = [tuple(r) for r in df.select(*[c.alias(n) for n, c in made.items()]).collect()]
    assert got == [("x", "/a", "5"), ("y", None, None), (None, None, None), (None, None, None)]


def test_mount_table(spark):
    lines = ["36 35 0:1 / / rw,relatime shared:1 - btrfs /dev/sda rw,compress=zstd:3", r"40 35 0:2 / /my\040disk ro - ext4 /dev/sdb ro", "broken line", "41 35 0:3 / /boot rw - vfat"]
    rows = text.mount_table(spark.createDataFrame([(x,) for x in lines], "l string"), "l").withColumn("c", text.compression_option(F.col("super_options"))).collect()
    assert [(r["mountpoint"], r["fstype"], r["options"]) for r in rows] == [("/", "btrfs", ["rw", "relatime"]), ("/my disk", "ext4", ["ro"])]
    assert tuple(rows[0]["c"]) == ("zstd", 3) and rows[1]["c"] is None


def test_file_tree(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "skip").mkdir()
    (tmp_path / "a/b/one").write_bytes(b"12345")
    (tmp_path / "top").write_bytes(b"1")
    (tmp_path / "skip/no").write_bytes(b"1")
    os.symlink(tmp_path / "a", tmp_path / "link")
    os.link(tmp_path / "top", tmp_path / "a/hard")
    rows = files.file_tree(spark, str(tmp_path), prune="skip").collect()
    assert sorted((bytes(r["relpath"]), r["size"]) for r in rows) == [(b"a/b/one", 5), (b"a/hard", 1), (b"top", 1)]
    assert len({r["ino"] for r in rows}) == 2
    missing = files.file_tree(spark, str(tmp_path / "none")).collect()
    assert len(missing) == 1 and missing[0]["warning"]


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as con:
        con.execute("create table games(id integer, name text)")
        con.executemany("insert into games values (?, ?)", [(1, None), (2, "Named")])
    got = files.sqlite_rows(spark, path, "select id, name from games", "id bigint, name string").collect()
    assert sorted(map(tuple, got)) == [(1, None), (2, "Named")]


def test_stream_is_the_batch_rule(spark, tmp_path):
    observer.use_state_store(spark)
    rows = [("a", 1, "1", True), ("a", 2, "1", True), ("b", 3, None, False), ("a", 4, "2", True), ("b", 5, None, True)]
    spark.createDataFrame(rows, "key string, seq long, build string, settled boolean").repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, seq long, build string, settled boolean").parquet(str(tmp_path / "in"))
    got = sorted((r["key"], r["seq"], r["ready"]) for r in observer.finished(observer.ready_installs(stream)).collect())
    assert got == [("a", 1, True), ("a", 2, False), ("a", 4, True), ("b", 3, False), ("b", 5, True)]
