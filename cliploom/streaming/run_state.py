"""The state of runs out of their lines, on a stream and in batch.  R01 and R03 of the survey.

A run's lines tell how far it is: "[==..] 3/9 assets | elapsed 1m | eta 2m | name" moves the counters, lines that begin with
Discovered or Matched set it running.  The stream keeps one record and a ring of the last `RING` lines per run, however many
lines come; a run that is silent for `quiet` of event time is closed by a timer and its state removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Lines that are kept of a run.
RING = 200
#: Fixed form of a progress line.
PROGRESS = r"^\[[=.]+\]\s+([0-9]+)/([0-9]+)\s+assets\s+\|\s+elapsed\s+([^|]+)\s+\|\s+eta\s+([^|]+)\s+\|\s+(.+)$"
STARTED = ("Discovered ", "Matched ")
RECORD = "processed int, total int, elapsed string, eta string, current_asset string, status string, n_lines long"
STATE = f"{RECORD}, logs array<string>, closed boolean"


def run_states(lines: DataFrame, run: str = "run_id", order: str = "line_no", line: str = "line", ring: int = RING) -> DataFrame:
    """run, STATE columns (closed is false) of batches of lines, in the order of line numbers."""
    part = lambda i: F.regexp_extract(line, PROGRESS, i)
    told = F.col(line).rlike(PROGRESS)
    latest: list[Column] = [F.max_by(F.when(told, part(i)), F.when(told, F.col(order))) for i in range(1, 6)]
    names = ("processed", "total", "elapsed", "eta", "current_asset")
    read = [F.coalesce(v.try_cast("int"), F.lit(0)) if i < 2 else F.coalesce(F.trim(v), F.lit("")) for i, v in enumerate(latest)]
    running = F.bool_or(F.coalesce(F.col(line).startswith(STARTED[0]) | F.col(line).startswith(STARTED[1]), F.lit(False)))
    records = lines.groupBy(run).agg(*(v.alias(n) for n, v in zip(names, read, strict=True)), F.when(running, "running").otherwise("idle").alias("status"), F.count(F.lit(1)).alias("n_lines"))
    turn = F.row_number().over(Window.partitionBy(run).orderBy(F.desc(order)))
    kept = lines.withColumn("_turn", turn).where(F.col("_turn") <= ring).groupBy(run).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(line).alias("l")))), lambda x: x["l"]).alias("logs"))
    return records.join(kept, run).withColumn("closed", F.lit(False))


class RunStates(StatefulProcessor):
    """Per run: the record, the ring of lines, and a timer at `quiet_ms` after its last line."""

    def __init__(self, run: str, ring: int, quiet_ms: int) -> None:
        self.run, self.ring, self.quiet_ms = run, ring, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", RECORD)
        self.lines = handle.getListState("lines", "line string")

    def _row(self, key: tuple, record: tuple, logs: list[str], closed: bool) -> pd.DataFrame:
        names = [self.run, *(f.split()[0] for f in STATE.split(", "))]
        return pd.DataFrame([[key[0], *record, logs, closed]], columns=names)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        done, total, elapsed, eta, asset, status, n = tuple(self.record.get()) if self.record.exists() else (0, 0, "", "", "", "idle", 0)
        logs = [r[0] for r in self.lines.get()] if self.lines.exists() else []
        new = pd.concat(list(rows)).sort_values("line_no", kind="stable")
        for line in new["line"]:
            found = re.match(PROGRESS, line or "")
            if found:
                done, total, (elapsed, eta, asset) = int(found[1]), int(found[2]), (x.strip() for x in found.groups()[2:])
            elif (line or "").startswith(STARTED):
                status = "running"
        n += len(new)
        logs = [*logs, *new["line"]][-self.ring :]
        record = (done, total, elapsed, eta, asset, status, n)
        self.record.update(record)
        self.lines.put([(x,) for x in logs])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(new["ts"].max().timestamp() * 1000) + self.quiet_ms)
        yield self._row(key, record, logs, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        if self.record.exists():
            record, logs = tuple(self.record.get()), [r[0] for r in self.lines.get()]
            self.record.clear()
            self.lines.clear()
            yield self._row(key, record, logs, True)

    def close(self) -> None:
        pass


def streamed_run_states(lines: DataFrame, run: str = "run_id", ring: int = RING, quiet: float = 3600.0, late: str = "1 minute") -> DataFrame:
    """run, STATE columns out of a stream of lines (run, ts, line_no, line): a row whenever a run has new lines, and one when it is closed.

    The session's state store must be the one that keeps typed state (RocksDB).  Lines of a run come in the order of their
    batches; within one they are put in order.
    """
    kind = dict(lines.dtypes)[run]
    rows = lines.select(run, "ts", "line_no", "line").withWatermark("ts", late)
    return rows.groupBy(run).transformWithStateInPandas(RunStates(run, ring, int(quiet * 1000)), f"{run} {kind}, {STATE}", "update", "eventTime")
