"""Resumable ingestion jobs: state from a stream of stage events, and stages as Parquet tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from orefield.operators.ops import STAGES

STATE = "job_id string, stage string, progress double, failed boolean, done string"


def job_states(events: DataFrame) -> DataFrame:
    """A stream of (job_id, stage, ok boolean) -> the job's state after each batch: stages done, progress, failure.

    A stage that was done before is skipped when a job is run again; a failure clears with the next success.
    """

    def update(key, frames, state: GroupState):
        done, failed = (set(filter(None, state.get[0].split(","))), state.get[1]) if state.exists else (set(), False)
        for pdf in frames:
            for stage, ok in zip(pdf["stage"], pdf["ok"]):
                failed = not ok
                if ok and stage in STAGES:
                    done.add(stage)
        names = [s for s in STAGES if s in done]
        state.update((",".join(names), failed))
        at = STAGES.index(names[-1]) if names else 0
        yield pd.DataFrame([{"job_id": key[0], "stage": names[-1] if names else None, "progress": round(at / (len(STAGES) - 1) * 100, 1), "failed": failed, "done": ",".join(names)}])

    return events.groupBy("job_id").applyInPandasWithState(update, STATE, "done string, failed boolean", "update", GroupStateTimeout.NoTimeout)


def run_stages(spark: SparkSession, start: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]], folder: str) -> DataFrame:
    """Run stages in order, each written under ``folder``; a stage whose table is complete is read instead of run."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    df = start
    for name, stage in stages:
        path = f"{folder.rstrip('/')}/{name}"
        marker = path_of(f"{path}/_SUCCESS")
        if not marker.getFileSystem(conf).exists(marker):
            stage(df).write.mode("overwrite").parquet(path)
        df = spark.read.parquet(path)
    return df
