"""Uploads and clicks put together from parts, in batch and as streams."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def upload_state(parts: DataFrame) -> DataFrame:
    """n_parts and n_chunks (distinct) of each upload; triggered once as many parts came as it has, complete if none is missing."""
    out = parts.groupBy("uploader_id").agg(F.count("*").alias("n_parts"), F.count_distinct("chunk_number").alias("n_chunks"), F.max("total_chunks").alias("t"))
    return out.select("uploader_id", "n_parts", "n_chunks", (F.col("n_parts") >= F.col("t")).alias("triggered"), (F.col("n_chunks") == F.col("t")).alias("complete"))


def assemble(parts: DataFrame, separator: str = "") -> DataFrame:
    """uploader_id and content of complete uploads, parts in ascending order; of repeated parts the smallest content counts.

    The content of one upload is one row. Files too large for that stay in their parts: sources.las reads those as one.
    """
    once = parts.groupBy("uploader_id", "chunk_number").agg(F.min("content").alias("content"), F.max("total_chunks").alias("total_chunks"))
    sets = once.groupBy("uploader_id").agg(F.sort_array(F.collect_list(F.struct("chunk_number", "content"))).alias("p"), F.max("total_chunks").alias("t"))
    contents = F.transform("p", lambda s: s["content"])
    return sets.where(F.size("p") == F.col("t")).select("uploader_id", F.array_join(contents, separator).alias("content"))


def click_shapes(clicks: DataFrame, session: str, order: list[str], arity: int) -> DataFrame:
    """clicks with shape_no: every ``arity`` clicks of a session make a shape."""
    rank = F.row_number().over(Window.partitionBy(session).orderBy(*order))
    return clicks.withColumn("shape_no", F.floor((rank - 1) / F.lit(arity)))


def _keyed_state(df: DataFrame) -> None:
    """State by key and part needs the store that keeps it so."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class Upload(StatefulProcessor):
    """Parts of one upload: a map of their contents, and how many there are."""

    def __init__(self, expire_ms: int | None, whole: bool):
        self.expire_ms, self.whole = expire_ms, whole

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "number int", "content binary")
        self.seen = handle.getValueState("seen", "have int, timer bigint")

    def _forget(self) -> None:
        if self.seen.exists():
            timer = self.seen.get()[1]
            if timer:
                self.handle.deleteTimer(timer)
            self.seen.clear()
        self.parts.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        have, timer = self.seen.get() if self.seen.exists() else (0, 0)
        total = 0
        for row in rows:
            total = int(row["total_chunks"])
            at = (int(row["chunk_number"]),)
            if 0 <= at[0] < total and not self.parts.containsKey(at):
                self.parts.updateValue(at, (bytes(row["content"]),))
                have += 1
            if total and have >= total:
                held = (bytes(self.parts.getValue((k,))[0]) for k in range(total))
                if self.whole:
                    yield Row(uploader_id=key[0], n_parts=total, content=b"".join(held))
                else:
                    for k, content in enumerate(held):
                        yield Row(uploader_id=key[0], chunk_number=k, total_chunks=total, content=content)
                self.seen.update((have, timer))
                self._forget()
                have, timer = 0, 0
        if have:
            if self.expire_ms is not None:
                if timer:
                    self.handle.deleteTimer(timer)
                timer = timerValues.getCurrentProcessingTimeInMs() + self.expire_ms
                self.handle.registerTimer(timer)
            self.seen.update((have, timer))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo) -> Iterator[Row]:
        self.seen.update((0, 0))
        self._forget()
        yield from ()


def assemble_stream(parts: DataFrame, expire_ms: int | None = 3_600_000, whole: bool = True) -> DataFrame:
    """A stream of (uploader_id, chunk_number from 0, total_chunks, content) to one of complete uploads.

    State is a map with an entry a part: a part that comes in is one entry written, however large the upload. When all
    have come they are given out in order, as one row (``whole``) or a row a part, and their entries go. A part that
    comes again before that changes nothing, one with a number outside the upload doesn't count. One that comes after
    starts the upload anew, and an upload that no part came for in ``expire_ms`` is forgotten by a timer, so state is
    bounded by what is under way. Without ``expire_ms`` there are no timers, and a query ends when its input does.
    """
    _keyed_state(parts)
    schema = "uploader_id string, n_parts int, content binary" if whole else "uploader_id string, chunk_number int, total_chunks int, content binary"
    return parts.groupBy("uploader_id").transformWithState(Upload(expire_ms, whole), schema, "Append", "None" if expire_ms is None else "ProcessingTime")


class Shapes(StatefulProcessor):
    """Clicks of one session: those that make no shape yet, and how many shapes there were."""

    def __init__(self, arity: int, expire_ms: int | None):
        self.arity, self.expire_ms = arity, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "event_id bigint")
        self.made = handle.getValueState("made", "shapes bigint, timer bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        shapes, timer = self.made.get() if self.made.exists() else (0, 0)
        held = [r[0] for r in self.open.get()] if self.open.exists() else []
        held += sorted(int(r["event_id"]) for r in rows)
        while len(held) >= self.arity:
            yield Row(session=key[0], shape_no=shapes, clicks=held[: self.arity])
            held, shapes = held[self.arity :], shapes + 1
        self.open.clear()
        if held:
            self.open.put([(i,) for i in held])
        if self.expire_ms is not None:
            if timer:
                self.handle.deleteTimer(timer)
            timer = timerValues.getCurrentProcessingTimeInMs() + self.expire_ms
            self.handle.registerTimer(timer)
        self.made.update((shapes, timer))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo) -> Iterator[Row]:
        self.open.clear()
        self.made.clear()
        yield from ()


def click_stream(clicks: DataFrame, arity: int, expire_ms: int | None = 3_600_000) -> DataFrame:
    """A stream of (session bigint, event_id, rising) to one of shapes: session, shape_no and the ids of its clicks.

    State holds how many shapes a session has made and the clicks that don't make one yet, fewer than ``arity``; it goes
    when the session rests for ``expire_ms``.
    """
    _keyed_state(clicks)
    schema = "session bigint, shape_no bigint, clicks array<bigint>"
    return clicks.groupBy("session").transformWithState(Shapes(arity, expire_ms), schema, "Append", "None" if expire_ms is None else "ProcessingTime")


def session_points(events: DataFrame) -> DataFrame:
    """What a viewer has when a session is done: session, seq and payload of its chunks before that, to be read in their order.

    events: session, seq, event (points or done), payload. A row a chunk: no session's payloads meet in one row. Works on
    a batch and, with a watermark upstream, per micro-batch; sessions that are not done return nothing.
    """
    ended = events.groupBy("session").agg(F.min(F.when(F.col("event") == "done", F.col("seq"))).alias("end")).where("end is not null")
    return events.where("event = 'points'").join(ended, "session").where("seq < end").select("session", "seq", "payload")
