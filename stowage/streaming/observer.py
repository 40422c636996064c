"""Reports of installs as a stream: which of them are newly ready.

The same rule as discovery.observed_changes, kept as state per install: a report is ready if the install is settled now and was
not seen, not settled, or of another build before. State holds one row per install, in RocksDB.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stowage.session import shared_folder

READY = "key string, seq long, build string, seen boolean, ready boolean"


class Observer(StatefulProcessor):
    """Remembers each key's last build and whether it was settled."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "build string, settled boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        report = pd.concat(list(rows)).sort_values("seq", kind="stable")
        old = self.last.get() if self.last.exists() else None
        out = []
        for row in report.itertuples(index=False):
            build, settled = (None if pd.isna(row.build) else str(row.build)), bool(row.settled)
            ready = settled and (old is None or not old[1] or old[0] != build)
            out.append((key[0], int(row.seq), build, old is not None, ready))
            old = (build, settled)
        self.last.update(old)
        yield pd.DataFrame(out, columns=["key", "seq", "build", "seen", "ready"])

    def close(self) -> None:
        pass


def ready_installs(reports: DataFrame) -> DataFrame:
    """A stream of (key, seq, build, seen, ready) from a stream of (key, seq, build, settled).

    A batch's reports of one key are taken in the order of seq; a report that arrives in a later batch is later, whatever its seq.
    The session must use the RocksDB state store (use_state_store).
    """
    return reports.groupBy("key").transformWithStateInPandas(statefulProcessor=Observer(), outputStructType=READY, outputMode="Append", timeMode="None")


def use_state_store(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def finished(stream: DataFrame) -> DataFrame:
    """All that a stream gives for the input there is, through a file sink in the shared folder; a restart goes on from its checkpoint."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = stream.schema
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start(f"{folder}/out")
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/out")
