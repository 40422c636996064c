"""Queues of jobs: opening what was stored, keeping them short, and folding workers' events into a job's phase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions.decide import ACTIVE
from stowage.functions.names import quoted

#: Jobs loaded, finished jobs kept, errors kept.
LOADED, HISTORY, ERRORS = 500, 1000, 20
#: Marks a failure that only waits for another worker.
LOCK_BUSY = "another pass holds the lock"


def opened(rows: DataFrame, key: str, data: str, schema: str, phase: str, started: Column, most: int = LOADED) -> DataFrame:
    """The newest `most` stored jobs, oldest first by `place`: texts that can't be read are passed over, and what was in flight is interrupted.

    started: whether a job (of `schema`) had begun; a paused one that had not stays paused.
    """
    newest = rows.select(F.col(quoted(key)).alias("_key"), F.from_json(F.col(quoted(data)), f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("j")).orderBy(F.col("_key").desc()).limit(most)
    read = newest.where(F.col("j._bad").isNull() & F.col(f"j.{phase}").isNotNull())
    own = read.select("_key", "j.*").drop("_bad")
    lost = F.col(phase).isin(*[p for p in ACTIVE if p != "queued"]) & ~((F.col(phase) == "paused") & ~started)
    from pyspark.sql import Window

    # at most `most` rows
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_key"))
    return own.withColumn(phase, F.when(lost, "interrupted").otherwise(F.col(phase))).withColumn("place", place).drop("_key")


def shortened(jobs: DataFrame, key: str, task: list[str], phase: str, history: int = HISTORY) -> DataFrame:
    """Active jobs, each task once (its oldest), and the finished ones that history keeps: the oldest completed or cancelled go first.

    A null part of a task is a value like any other.
    """
    active = jobs.where(F.col(phase).isin(*ACTIVE))
    first = active.groupBy(*task).agg(F.min(F.col(quoted(key))).alias("_first")).select("_first")
    kept = active.join(first, F.col(quoted(key)) == F.col("_first"), "left_semi")
    done = jobs.where(~F.col(phase).isin(*ACTIVE))
    expendable = F.col(phase).isin("completed", "cancelled")
    return kept.unionByName(done.orderBy(expendable.asc(), F.col(quoted(key)).desc()).limit(history))


def next_phase(phase: Column, event: Column, kind: Column, message: Column) -> Column:
    """The phase behind an event: pauses and resumes never undo a cancel, a taken lock puts a job back in the queue, and what has ended stays."""
    over = phase.isin("completed", "partial", "cancelled", "failed")
    working = F.when(kind == "analyze", "analyzing").otherwise("running")
    return (
        F.when(over, phase)
        .when(event == "started", F.when(phase == "cancelling", phase).otherwise(working))
        .when(event == "paused", F.when(phase == "cancelling", phase).otherwise("paused"))
        .when(event == "resumed", F.when(phase == "cancelling", phase).otherwise(working))
        .when(event == "cancel", "cancelling")
        .when(event == "done", F.when(phase == "cancelling", "cancelled").when(message.isNull() | (message == ""), "completed").otherwise("partial"))
        .when(event == "failed", F.when(F.contains(F.coalesce(message, F.lit("")), F.lit(LOCK_BUSY)), "queued").otherwise("failed"))
        .otherwise(phase)
    )


def folded_events(events: DataFrame, job: str, seq: str, event: str, kind: str, message: str) -> DataFrame:
    """(job, phase, events, errors): each job's events in order, folded; a job's events are few. errors: the first ERRORS warnings."""
    one = F.struct(F.col(quoted(seq)).alias("seq"), F.col(quoted(event)).alias("event"), F.col(quoted(kind)).alias("kind"), F.col(quoted(message)).alias("message"))
    rows = events.groupBy(F.col(quoted(job)).alias("job")).agg(F.array_sort(F.collect_list(one)).alias("all"))
    phase = F.aggregate("all", F.lit("queued"), lambda p, e: next_phase(p, e["event"], e["kind"], e["message"]))
    errors = F.slice(F.transform(F.filter("all", lambda e: e["event"] == "warning"), lambda e: e["message"]), 1, ERRORS)
    return rows.select("job", phase.alias("phase"), F.size("all").alias("events"), errors.alias("errors"))
