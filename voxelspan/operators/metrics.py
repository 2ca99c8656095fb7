"""What a run says of itself: rows by stage from the very run that makes them, time by name, progress while it lasts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

from voxelspan.operators.events import PROGRESS

COUNTS = "stage string, n_points bigint"


class Stages:
    """Counts the rows of a plan's stages while the plan runs: with Stages(spark) as seen.

    watch() marks a stage, run() runs a plan that holds the marked ones, counts() gives stage and n_points in the order of
    marking. Tasks count rows as they pass, so a task that is done over after a lost executor counts its rows twice, and a
    stage that adaptive execution cuts away counts none: where a task of what ran within the ``with`` failed, a stage was
    tried again, or a count is missing, the stages are counted by queries of their own.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.recounted = spark, False
        self._marked: list[tuple[DataFrame, Observation, dict[str, Column]]] = []
        self._group = f"stages-{uuid.uuid4().hex}"

    def watch(self, stage: str, df: DataFrame, **parts: Column) -> DataFrame:
        """df, to be used in its place; each of ``parts`` counts the rows of df that fulfil a condition, as a stage too."""
        seen, wanted = Observation(), {stage: F.count(F.lit(1))} | {name: F.count_if(c) for name, c in parts.items()}
        self._marked.append((df, seen, wanted))
        return df.observe(seen, *[c.alias(name) for name, c in wanted.items()])

    def __enter__(self) -> Stages:
        self._before = self.spark.sparkContext.getLocalProperty("spark.jobGroup.id")
        self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", self._group)
        return self

    def __exit__(self, *error) -> None:
        self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", self._before)

    def run(self, df: DataFrame) -> None:
        """Makes all rows of df, of no more columns than that takes."""
        df.agg(F.count(F.lit(1))).collect()

    def _undisturbed(self) -> bool:
        """Spark forgets stages that were skipped first, then those that ended first: while the first job's are there, what is missing never ran."""
        tracker = self.spark.sparkContext.statusTracker()
        jobs = [tracker.getJobInfo(j) for j in sorted(tracker.getJobIdsForGroup(self._group))]
        if not jobs or any(j is None or j.status != "SUCCEEDED" for j in jobs):
            return False
        stages = [[tracker.getStageInfo(s) for s in j.stageIds] for j in jobs]
        return None not in stages[0] and all(s is None or (s.currentAttemptId == 0 and s.numFailedTasks == 0) for of_job in stages for s in of_job)

    def counts(self) -> DataFrame:
        """stage and n_points, a row a stage; after run(), within the ``with`` or behind it."""
        found = [observed(seen) for _, seen, _ in self._marked]
        if self._undisturbed() and all(set(wanted) <= set(got) for got, (*_, wanted) in zip(found, self._marked)):
            return self.spark.createDataFrame([(name, got[name]) for got, (*_, wanted) in zip(found, self._marked) for name in wanted], COUNTS)
        self.recounted = True
        return counted(self._marked)


def observed(seen: Observation) -> dict[str, int]:
    """Empty for a stage that was cut away: it leaves a row without columns, which Python has no form for."""
    try:
        return seen.get
    except Py4JJavaError:
        return {}


def counted(marked: list) -> DataFrame:
    """The same by a query of its own for each marked stage."""
    parts = []
    for df, _, wanted in marked:
        row = df.agg(*[c.alias(name) for name, c in wanted.items()])
        parts.append(row.select(F.inline(F.array(*[F.struct(F.lit(name).alias("stage"), F.col(name).alias("n_points")) for name in wanted]))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def time_totals(samples: DataFrame, mode: str = "observed") -> DataFrame:
    """name, n_samples and total_ms of samples (name, seq, ms): time that passed under each name.

    Observed, a name's first sample (of the smallest seq, then the smallest ms) only opens its account and adds
    nothing; intended, every sample counts. A null ms adds nothing, a null name is a name; without samples no row.
    """
    first = F.min(F.struct("seq", "ms"))["ms"]
    total = F.coalesce(F.sum("ms"), F.lit(0))
    if mode == "observed":
        total = total - F.coalesce(first, F.lit(0))
    return samples.groupBy("name").agg(F.count(F.lit(1)).alias("n_samples"), total.alias("total_ms"))


class ProgressMessages(StreamingQueryListener):
    """Progress messages of the session's streams: each batch that is through is told to ``send``, as a dictionary.

    ``message`` is what they say; Rows is what the batch read, Counts what its observed stages counted. Add it by
    spark.streams.addListener(); it keeps nothing.
    """

    def __init__(self, send: Callable[[dict], None], message: str):
        self.send, self.message = send, message

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        counts = {stage: row.asDict() for stage, row in p.observedMetrics.items()}
        self.send({"Event": PROGRESS, "Message": self.message, "Batch": p.batchId, "Rows": p.numInputRows, "Counts": counts})

    def onQueryIdle(self, event: QueryIdleEvent) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        pass
