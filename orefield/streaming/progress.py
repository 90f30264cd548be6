"""Progress of runs as a stream: stateful per run, into a table that a repeated batch leaves unchanged."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "run string, stage string, n_events long, last_ts timestamp, progress double, finished boolean"


def progress(events: DataFrame, stages: list[str]) -> DataFrame:
    """A stream of (run, stage, ts) -> the state of each run that a batch touches: furthest stage, events, progress in percent.

    Stages may come out of order and repeat; unknown and null ones count as events only. The state is three numbers a run.
    """
    place = {s: i for i, s in enumerate(stages, 1)}

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, n, last = state.get if state.exists else (0, 0, None)
        for pdf in frames:
            at = max([at, *(place.get(s, 0) for s in pdf["stage"])])
            n += len(pdf)
            ts = pdf["ts"].max()
            if not pd.isna(ts):
                ts = int(ts.value // 1000)
                last = ts if last is None else max(last, ts)
        state.update((at, n, last))
        yield pd.DataFrame(
            {
                "run": [key[0]], "stage": [stages[at - 1] if at else None], "n_events": [n], "last_ts": [None if last is None else pd.Timestamp(last * 1000)],
                "progress": [round(at / len(stages) * 100, 1)], "finished": [at == len(stages)],
            }
        )

    own = events.select("run", "stage", "ts")
    return own.groupBy("run").applyInPandasWithState(update, STATE, "at long, n long, last long", "update", GroupStateTimeout.NoTimeout)


def upsert_sink(updates: DataFrame, path: str, checkpoint: str):
    """A started query: each batch is a folder named by its number, overwritten if it is run again, so no batch counts twice."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return updates.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The sink's newest row of each run: that of its last batch."""
    rows = spark.read.schema(f"{STATE}, batch long").option("basePath", path).parquet(f"{path}/batch=*")
    names = [f.name for f in rows.schema if f.name not in ("run", "batch")]
    newest = rows.groupBy("run").agg(F.max_by(F.struct(*names), "batch").alias("own"))
    return newest.select("run", "own.*")
