"""Session settings the engine relies on, and readers for its tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Tables without a zone hold UTC, so every query runs in it.
TIME_ZONE = "UTC"


def session(master: str | None = None, partitions: int | None = None, app: str = "stowage") -> SparkSession:
    """A session with the settings that matter for large inputs; what the cluster already set stays."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", TIME_ZONE)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def utc(spark: SparkSession) -> SparkSession:
    if spark.conf.get("spark.sql.session.timeZone") != TIME_ZONE:
        spark.conf.set("spark.sql.session.timeZone", TIME_ZONE)
    return spark


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table `name` of a directory; Catalyst prunes its columns and pushes its filters."""
    return utc(spark).read.parquet(f"{directory}/{name}.parquet")


def tasks_of(spark: SparkSession) -> int:
    """How many tasks a shuffle has."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def busy(df: DataFrame) -> DataFrame:
    """`df` in at least as many partitions as the cluster has cores, for work that is heavy per row.

    Only an input too small to fill the cores is shuffled; a large scan keeps its splits. Results are the same either way.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    # behind a join or an aggregation rows are in a shuffle's partitions already, and to ask for their number would run it
    if plan.children().size() or df._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only local sessions that name none get one of this machine, which is removed when the program ends."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if named:
        return named
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="stowage-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return _OWN[0]


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder, so that later reads need no lineage and survive lost executors."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
