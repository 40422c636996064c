"""Workers' events as a stream, folded into each job's phase; the same rule as queues.folded_events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stowage.operators.queues import LOCK_BUSY

PHASES = "job long, seq long, phase string"
OVER = ("completed", "partial", "cancelled", "failed")


def next_phase(phase: str, event: str, kind: str | None, message: str | None) -> str:
    """The phase behind one event (queues.next_phase for a single value)."""
    working = "analyzing" if kind == "analyze" else "running"
    if phase in OVER:
        return phase
    if event in ("started", "resumed", "paused"):
        return phase if phase == "cancelling" else "paused" if event == "paused" else working
    if event == "cancel":
        return "cancelling"
    if event == "done":
        return "cancelled" if phase == "cancelling" else "partial" if message else "completed"
    if event == "failed":
        return "queued" if LOCK_BUSY in (message or "") else "failed"
    return phase


class Folding(StatefulProcessor):
    """Remembers each job's phase. Events of a batch are taken in the order of seq, one Arrow batch after the other if they come sorted."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.phase = handle.getValueState("phase", "phase string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        phase = self.phase.get()[0] if self.phase.exists() else "queued"
        out = []
        for e in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples(index=False):
            text = lambda v: None if pd.isna(v) else str(v)
            phase = next_phase(phase, str(e.event), text(e.kind), text(e.message))
            out.append((int(key[0]), int(e.seq), phase))
        self.phase.update((phase,))
        yield pd.DataFrame(out, columns=["job", "seq", "phase"])

    def close(self) -> None:
        pass


def phases(events: DataFrame) -> DataFrame:
    """A stream of (job, seq, phase) from one of (job, seq, event, kind, message); a job has few events a batch."""
    return events.groupBy("job").transformWithStateInPandas(statefulProcessor=Folding(), outputStructType=PHASES, outputMode="Append", timeMode="None")


class Due(StatefulProcessor):
    """Remembers each install's build, and whether it was idle and wanted: the first scan only sets that, later ones tell what is due."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "build string, idle boolean, enabled boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self.last.get() if self.last.exists() else None
        out = []
        for s in pd.concat(list(rows)).sort_values("scan", kind="stable").itertuples(index=False):
            build, idle, enabled = None if pd.isna(s.build) else str(s.build), bool(s.idle), bool(s.enabled)
            changed = old is None or (old[2] and (old[0] != build or not old[1]))
            out.append((key[0], int(s.scan), enabled and idle and not bool(s.tool) and int(s.scan) > 0 and changed))
            old = (build, idle, enabled)
        self.last.update(old)
        yield pd.DataFrame(out, columns=["game", "scan", "due"])

    def close(self) -> None:
        pass


def due_installs(scans: DataFrame) -> DataFrame:
    """A stream of (game, scan, due) from one of (game, scan, build, idle, enabled, tool); scan 0 is the baseline."""
    return scans.groupBy("game").transformWithStateInPandas(statefulProcessor=Due(), outputStructType="game string, scan long, due boolean", outputMode="Append", timeMode="None")


class Retrying(StatefulProcessor):
    """Tries an install again after each failure, at most as often as there are delays, then waits for its next report.

    Every report is tried at once unless its build failed before and waits; a timer in processing time gives the next try.
    """

    def __init__(self, delays: tuple[int, ...] = (10_000, 60_000, 300_000)):
        self.delays = delays

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "build string, tries int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for r in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples(index=False):
            build = None if pd.isna(r.build) else str(r.build)
            old = self.state.get() if self.state.exists() else None
            if bool(r.succeeded):
                if old is not None:
                    self.state.clear()
                out.append((key[0], build, 0, "done"))
            elif old is None or old[0] != build:
                self.state.update((build, 0))
                self._wait(timerValues, 0)
                out.append((key[0], build, 0, "waits"))
        yield pd.DataFrame(out, columns=["game", "build", "tries", "what"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        build, tries = self.state.get()
        tries += 1
        self.state.update((build, tries))
        if tries < len(self.delays):
            self._wait(timerValues, tries)
        yield pd.DataFrame([(key[0], build, tries, "try" if tries < len(self.delays) else "last try")], columns=["game", "build", "tries", "what"])

    def _wait(self, timerValues, tries: int) -> None:
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.delays[tries])

    def close(self) -> None:
        pass


def retries(failures: DataFrame, delays: tuple[int, ...] = (10_000, 60_000, 300_000)) -> DataFrame:
    """A stream of (game, build, tries, what) from one of (game, seq, build, succeeded), with tries that come by timers."""
    return failures.groupBy("game").transformWithStateInPandas(statefulProcessor=Retrying(delays), outputStructType="game string, build string, tries int, what string", outputMode="Append", timeMode="ProcessingTime")
