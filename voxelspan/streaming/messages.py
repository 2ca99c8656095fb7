"""Messages of points from uploads that are complete, and a sink that holds each message once.

The sink is a Spark data source. Tasks write drafts under hidden names; the commit of a batch renames them after the
batch and then writes its manifest. A batch that is committed again, after a restart, replaces what it had, so a batch's
messages are there once or, before its manifest is, not at all.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from voxelspan.functions import scalar
from voxelspan.operators.events import POINTS
from voxelspan.schema import CHUNK_POINTS, FIELDS, WINDOW_POINTS
from voxelspan.sources import las

SCHEMA = "uploader_id string, window_no bigint, chunk_no bigint, payload string"
_RAW = "uploader_id string, pos bigint, count bigint, sx double, sy double, sz double, hx double, hy double, hz double, ix int, iy int, iz int, intensity int, classification int, ir int, ig int, ib int"


def decoded(uploads: DataFrame, window: int = WINDOW_POINTS) -> DataFrame:
    """Points of uploads (uploader_id, content: a whole point file): uploader_id, pos, x, y, z, r, g, b, intensity, classification.

    Centred, as they are sent. A window of records is decoded at once. A content that is shorter than a header has no
    points.
    """
    fields = ["ix", "iy", "iz", "intensity", "classification", "ir", "ig", "ib"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for who, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_py() or b""
                if len(data) < las.HEADER_BYTES:
                    continue
                try:
                    h = las.parse_header(data)
                except struct.error:
                    continue
                there = min(h.count, max(0, len(data) - h.data_offset) // h.record_length if h.record_length else 0)
                rows = np.frombuffer(data, las.record_type(h.format_id, h.record_length), there, h.data_offset) if there else np.zeros(0)
                for a in range(0, there, window):
                    some, n = rows[a : a + window], min(window, there - a)
                    own = [pa.array(some[c].astype(np.int32)) if c in some.dtype.names else pa.array(np.zeros(n, np.int32)) for c in fields]
                    same = [pa.array(np.full(n, v)) for v in (there, *map(float, h.scale), *map(float, h.shift))]
                    yield pa.RecordBatch.from_arrays([pa.array([who] * n, pa.string()), pa.array(np.arange(a, a + n)), *same, *own], ["uploader_id", "pos", "count", "sx", "sy", "sz", "hx", "hy", "hz", *fields])

    raw = uploads.select("uploader_id", "content").mapInArrow(run, _RAW)
    colours = [scalar.resolved_colour(f"i{ch}", "classification", k).alias(ch) for k, ch in enumerate("rgb")]
    place = [(F.col(f"i{f}") * F.col(f"s{f}") + F.col(f"h{f}")).alias(a) for a, f in zip("xyz", "xzy")]
    return raw.select("uploader_id", "pos", "count", *place, *colours, F.col("intensity").cast("double").alias("intensity"), F.col("classification").cast("double").alias("classification"))


def point_messages(uploads: DataFrame, window: int = WINDOW_POINTS, size: int = CHUNK_POINTS) -> DataFrame:
    """uploader_id, window_no, chunk_no and payload of each message of complete uploads: points of a window, ``size`` a message.

    Built within a task, upload by upload, without a shuffle: the same rows from a stream and from a batch.
    """
    points = decoded(uploads, window)
    names = list(FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        key, total = None, 0
        out: list[tuple] = []

        def flush() -> None:
            nonlocal held
            if held:
                out.append((*key, json.dumps({"Event": POINTS, "Points": np.concatenate(held).ravel().tolist(), "TotalChunks": total})))
                held = []

        for batch in batches:
            who, pos, count = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            values = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names], 1)
            number, place = pos // window, pos % window // size
            new = np.flatnonzero((number[1:] != number[:-1]) | (place[1:] != place[:-1]) | (pos[1:] != pos[:-1] + 1)) + 1
            for a, b in zip([0, *new], [*new, len(pos)]):
                if a == b:
                    continue
                here = (who[a], int(number[a]), int(place[a]))
                if here != key:
                    flush()
                    key, n = here, int(count[a])
                    full, rest = divmod(n, window)
                    total = full * -(-window // size) + -(-rest // size)
                held.append(values[a:b])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)] if out else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64(), pa.string())], ["uploader_id", "window_no", "chunk_no", "payload"])
            out.clear()
        flush()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["uploader_id", "window_no", "chunk_no", "payload"])

    return points.mapInArrow(run, SCHEMA)


@dataclass
class Draft(WriterCommitMessage):
    path: str
    rows: int


class Sink(DataSourceStreamArrowWriter):
    def __init__(self, options: dict):
        self.folder, self.run_id = options["path"], uuid.uuid4().hex
        store, path = pafs.FileSystem.from_uri(self.folder)
        store.create_dir(path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Draft:
        draft, out = Draft("", 0), None  # without a path where there are no rows
        for batch in iterator:
            if not batch.num_rows:
                continue
            if out is None:
                store, path = pafs.FileSystem.from_uri(self.folder)
                draft = Draft(f"{path}/.{self.run_id}-{uuid.uuid4().hex}", 0)
                out = store.open_output_stream(draft.path)
            out.write("".join(f"{json.dumps(r)}\n" for r in batch.to_pylist()).encode())
            draft.rows += batch.num_rows
        if out is not None:
            out.close()
        return draft

    def _named(self, start: str) -> tuple[pafs.FileSystem, str, list[str]]:
        store, path = pafs.FileSystem.from_uri(self.folder)
        return store, path, [f.path for f in store.get_file_info(pafs.FileSelector(path)) if f.is_file and f.base_name.startswith(start)]

    def commit(self, messages: list[Draft | None], batchId: int) -> None:
        store, path, before = self._named(f"batch-{batchId:09d}")
        for f in sorted(before, key=lambda f: not f.endswith(".manifest")):  # the manifest first: without it there is no batch
            store.delete_file(f)
        found = sorted((m for m in messages if m is not None and m.path), key=lambda m: m.path)
        for i, m in enumerate(found):
            store.move(m.path, f"{path}/batch-{batchId:09d}-{i:05d}.json")
        self._drop(messages, batchId)
        draft = f"{path}/.{self.run_id}-manifest"
        with store.open_output_stream(draft) as out:
            out.write(json.dumps({"files": len(found), "rows": sum(m.rows for m in found)}).encode())
        store.move(draft, f"{path}/batch-{batchId:09d}.manifest")

    def _drop(self, messages: list, batchId: int) -> None:
        store, _, drafts = self._named(f".{self.run_id}-")
        for f in drafts:
            store.delete_file(f)

    def abort(self, messages: list[Draft | None], batchId: int) -> None:
        self._drop(messages, batchId)


class MessageSink(DataSource):
    """stream.writeStream.format("messages").option("path", uri).start(); read_messages() reads what is committed."""

    @classmethod
    def name(cls) -> str:
        return "messages"

    def streamWriter(self, schema: StructType, overwrite: bool) -> Sink:
        return Sink({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MessageSink)


def read_messages(spark: SparkSession, folder: str, schema: str = SCHEMA) -> DataFrame:
    """Messages of the batches that have a manifest."""
    store, path = pafs.FileSystem.from_uri(folder)
    there = [f.base_name for f in store.get_file_info(pafs.FileSelector(path, allow_not_found=True))]
    whole = {n.removesuffix(".manifest") for n in there if n.endswith(".manifest")}
    files = [f"{folder}/{n}" for n in sorted(there) if n.endswith(".json") and n.rpartition("-")[0] in whole]
    return spark.read.schema(schema).json(files) if files else spark.createDataFrame([], schema)
