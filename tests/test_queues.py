import time

import pytest
from pyspark.sql import functions as F

from stowage.operators import queues as Q
from stowage.sources import lists as L
from stowage.sources import text as X
from stowage.streaming import jobs as SJ
from stowage.streaming import observer

EVENTS = [
    (1, 0, "started", "compress", None), (1, 1, "paused", "compress", None), (1, 2, "resumed", "compress", None), (1, 3, "done", "compress", None), (1, 4, "paused", "compress", None),
    (2, 0, "started", "analyze", None), (2, 1, "cancel", "analyze", None), (2, 2, "resumed", "analyze", None), (2, 3, "done", "analyze", "x"),
    (3, 0, "started", "compress", None), (3, 1, "failed", "compress", f"oh: {Q.LOCK_BUSY}"), (4, 0, "failed", None, None), (5, 0, "started", "verify", None), (5, 1, "warning", "verify", "w"), (5, 2, "done", "verify", "some"),
]
WANT = {1: "completed", 2: "cancelled", 3: "queued", 4: "failed", 5: "partial"}
SCHEMA = "job long, seq long, event string, kind string, message string"


def test_events_fold_alike_in_batch_and_as_a_stream(spark, tmp_path):
    events = spark.createDataFrame(EVENTS, SCHEMA)
    got = {r["job"]: r["phase"] for r in Q.folded_events(events, "job", "seq", "event", "kind", "message").collect()}
    assert got == WANT
    observer.use_state_store(spark)
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    rows = observer.finished(SJ.phases(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))).collect()
    last = {}
    for r in sorted(rows, key=lambda r: r["seq"]):
        last[r["job"]] = r["phase"]
    assert last == WANT and len(rows) == len(EVENTS)
    assert Q.folded_events(events.where("job < 0"), "job", "seq", "event", "kind", "message").collect() == []


def test_a_failed_install_is_tried_again_by_timers(spark, tmp_path):
    observer.use_state_store(spark)
    schema = "game string, seq long, build string, succeeded boolean"
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("a", 1, "7", False), ("b", 2, "7", True), ("c", 3, None, False)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = SJ.retries(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), delays=(200, 400, 600))
    query = stream.writeStream.format("memory").queryName("tries").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 60
        while time.time() < until and spark.sql("select * from tries where what = 'last try'").count() < 2:
            time.sleep(0.5)
        rows = [tuple(r) for r in spark.sql("select * from tries").collect()]
    finally:
        query.stop()
    for game, build in (("a", "7"), ("c", None)):
        assert [r[2:] for r in rows if r[:2] == (game, build)] == [(0, "waits"), (1, "try"), (2, "try"), (3, "last try")]
    assert [r for r in rows if r[0] == "b"] == [("b", "7", 0, "done")]


def test_opening_a_queue(spark):
    schema = "id long, state string, began boolean"
    rows = [(1, '{"id": 1, "state": "queued", "began": false}'), (2, '{"id": 2, "state": "runn'), (3, '{"id": 3, "state": "running", "began": true}'), (4, '{"id": 4, "state": "paused", "began": false}'), (5, '{"id": 5, "state": "paused", "began": true}'), (6, None)]
    df = spark.createDataFrame(rows, "id long, data string")
    got = [tuple(r) for r in Q.opened(df, "id", "data", schema, "state", F.col("began")).select("place", "id", "state").orderBy("place").collect()]
    assert got == [(1, 1, "queued"), (2, 3, "interrupted"), (3, 4, "paused"), (4, 5, "interrupted")]
    assert [r["id"] for r in Q.opened(df, "id", "data", schema, "state", F.col("began"), 3).collect()] == [4, 5]


def test_the_oldest_done_jobs_go_first(spark):
    rows = [(1, "g", "completed"), (2, "g", "failed"), (3, "g", "cancelled"), (4, "h", "completed"), (5, "g", "queued"), (6, "g", "running"), (7, None, "queued"), (8, None, "paused")]
    df = spark.createDataFrame(rows, "id long, game string, state string")
    assert sorted(r["id"] for r in Q.shortened(df, "id", ["game"], "state", 2).collect()) == [2, 4, 5, 7]


def test_lists(spark):
    texts = [(1, '{"a": {"title": "A", "install_path": "/x/a", "version": 7}, "bad": {"install_path": "relative"}}'), (2, '{"installed": [{"appName": "111", "install_path": "/x/b", "buildId": "9"}, {"app_name": "222", "install_path": "C:\\\\\\\\y"}]}'.replace("\\\\\\\\", "\\\\")), (3, '[{"install_path": "/x/c/"}]'), (4, "no json"), (5, None), (6, "[]"), (7, "{}"), (8, "3")]
    df = spark.createDataFrame(texts, "k int, t string")
    got = sorted((r["k"], r["id"], r["title"], r["build"]) for r in L.installed_entries(df, "k", "t").collect())
    assert got == [(1, "a", "A", "7"), (2, "111", "b", "9"), (2, "222", "y", None), (3, "/x/c/", "c", None)]
    statuses = [r[0] for r in df.select(L.document_status(F.col("t"), 40)).collect()]
    assert statuses == ["large", "large", "read", "corrupt", "missing", "read", "read", "read"]


def test_libraries_and_running_apps(spark):
    texts = [(1, '"libraryfolders" { "0" { "path" "/a/" } "1" { "path" "/b" } "2" { "path" "/a" } }'), (2, '"libraryfolders" { "1" "/c" "junk" "/d" }'), (3, '"x" {')]
    entries = X.key_values(spark.createDataFrame(texts, "k int, t string"), "k", "t")
    got = sorted((r["k"], r["place"], r["folder"]) for r in L.library_folders(entries, "k", F.lit("/root/")).collect())
    assert got == [(1, 0, "/root"), (1, 1, "/a"), (1, 2, "/b"), (2, 0, "/root"), (2, 1, "/c"), (3, 0, "/root")]
    apps = X.key_values(spark.createDataFrame([(1, '"r" { "RunningAppID" "0" }'), (2, '"r" { "s" { "runningappid" "7" } }'), (3, '"r" { "RunningAppID" "9" }')], "k int, t string"), "k", "t")
    assert [tuple(r) for r in L.running_app(apps, "k").collect()] == [(2, 7)]


@pytest.mark.parametrize("flags, pending, running, want", [(4, 0, False, ("idle", None)), (0, 0, False, ("broken", "not installed")), (36, 0, False, ("broken", "files missing")), (68, 0, False, ("busy", "stale running")), (4, 95, False, ("busy", "transfer")), (4 + 1048576, 0, False, ("busy", "downloading")), (6, 0, False, ("update pending", None)), (132, 0, False, ("broken", "files corrupt")), (4, 0, True, ("busy", "running"))])
def test_install_states(spark, flags, pending, running, want):
    from stowage.functions import decide

    row = spark.range(1).select(decide.install_state(F.lit(flags), F.lit(pending), F.lit(running)).alias("s")).first()["s"]
    assert tuple(row) == want


def test_texts(spark):
    from stowage.functions import texts

    df = spark.createDataFrame([(r"my\040disk\134x\11y",), ("plain",), (None,)], "t string")
    assert [r[0] for r in df.select(texts.octal_undone(F.col("t"))).collect()] == [r"my disk\x\11y", "plain", None]
    typed = spark.createDataFrame([(' "~/My Games" ',), (r"/a/My\ Games",), ("~",), ("'/x'",)], "t string")
    assert [r[0] for r in typed.select(texts.typed_location(F.col("t"), F.lit("/home/p"))).collect()] == ["/home/p/My Games", "/a/My Games", "/home/p", "/x"]
