"""Binary point files: a Spark data source that reads ranges of records, and a distributed writer.

A file may come in several parts, cut anywhere; they are read as one in the order of their names and numbers. Every partition is a
range of record numbers, so pos needs no shuffle. Records beyond the header's count and a cut-off last record are not
there.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThan, WriterCommitMessage
from pyspark.sql.types import StructType

from voxelspan.functions import scalar
from voxelspan.operators.sample import hashed_numbers
from voxelspan.schema import WINDOW_POINTS, Header
from voxelspan.sources.storage import shared_dir

SCHEMA = "pos bigint, ix int, iy int, iz int, intensity int, classification int, ir int, ig int, ib int"
#: Where a record of each format holds its colours; other formats have none.
COLOUR_AT = {2: 20, 3: 28}
#: Length of the shortest record of formats 0 to 3.
RECORD_LENGTH = {0: 20, 1: 28, 2: 26, 3: 34}
HEADER_BYTES = 227
#: The part that holds the header, and records of a part.
HEADER_NAME, PART_RECORDS = "part-000000.las", 1_000_000
#: Fixed value: the latest file version that the intended mode reads, ten times the major number plus the minor one.
LATEST_VERSION = 13


def parse_header(data: bytes) -> Header:
    offset, fmt, length, count = struct.unpack_from("<I4xBHI", data, 96)
    numbers = struct.unpack_from("<12d", data, 131)
    ends = numbers[6:]  # highest, lowest of each axis in turn
    return Header(count=count, scale=numbers[:3], offset=numbers[3:6], low=ends[1::2], high=ends[0::2], format_id=fmt, record_length=length, data_offset=offset)


def header_bytes(h: Header) -> bytes:
    out = bytearray(h.data_offset)
    out[:4] = b"LASF"
    out[24:26] = b"\x01\x02"
    struct.pack_into("<H", out, 94, HEADER_BYTES)
    struct.pack_into("<I4xBHI", out, 96, h.data_offset, h.format_id, h.record_length, h.count)
    ends = [v for pair in zip(h.high, h.low) for v in pair]
    struct.pack_into("<12d", out, 131, *h.scale, *h.offset, *ends)
    return bytes(out)


def record_type(fmt: int, length: int) -> np.dtype:
    names, kinds, at = ["ix", "iy", "iz", "intensity", "classification"], ["<i4", "<i4", "<i4", "<u2", "u1"], [0, 4, 8, 12, 15]
    if fmt in COLOUR_AT:
        names, kinds, at = names + ["ir", "ig", "ib"], kinds + ["<u2"] * 3, at + [COLOUR_AT[fmt] + 2 * k for k in range(3)]
    return np.dtype({"names": names, "formats": kinds, "offsets": at, "itemsize": length})


class Parts:
    """Files read as one: a file, those of a folder, or those of a folder that a pattern with * names. Numbers in names count as such."""

    def __init__(self, uri: str):
        self.store, path = pafs.FileSystem.from_uri(uri)
        folder, _, pattern = path.rpartition("/")
        if "*" not in pattern:
            folder, pattern = path, "*"
        info = self.store.get_file_info(folder)
        files = [info] if info.is_file else [f for f in self.store.get_file_info(pafs.FileSelector(folder)) if f.is_file and not f.base_name.startswith((".", "_")) and fnmatchcase(f.base_name, pattern)]
        numbered = lambda name: [(int(x), "") if x.isdigit() else (-1, x) for x in re.split(r"(\d+)", name)]
        self.files = sorted(((f.path, f.size) for f in files), key=lambda f: numbered(f[0]))
        self.size = sum(n for _, n in self.files)

    def read(self, offset: int, length: int) -> bytes:
        out = []
        for path, n in self.files:
            if offset < n and length > 0:
                with self.store.open_input_file(path) as f:
                    out.append(f.read_at(min(length, n - offset), offset))
                length -= len(out[-1])
            offset = max(0, offset - n)
        return b"".join(out)


@dataclass
class Records(InputPartition):
    start: int
    stop: int


class Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.names = options, schema.names
        self.low, self.high = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Ranges of pos choose partitions and records; the rest is Spark's."""
        for f in filters:
            if isinstance(f, EqualTo | GreaterThanOrEqual | LessThan) and f.attribute == ("pos",):
                if not isinstance(f, LessThan):
                    self.low = max(self.low, f.value)
                if not isinstance(f, GreaterThanOrEqual):
                    stop = f.value + isinstance(f, EqualTo)
                    self.high = stop if self.high is None else min(self.high, stop)
            else:
                yield f

    def _open(self) -> tuple[Parts, Header]:
        parts = Parts(self.options["path"])
        start = parts.read(0, HEADER_BYTES)
        h = parse_header(start)
        if self.options.get("mode", "observed") == "intended":
            if h.format_id not in RECORD_LENGTH:
                raise ValueError(f"point format {h.format_id} is not known")
            if start[24] * 10 + start[25] > LATEST_VERSION:
                raise ValueError(f"file version {start[24]}.{start[25]} is not known")
        return parts, h

    def partitions(self) -> list[InputPartition]:
        parts, h = self._open()
        there = max(0, parts.size - h.data_offset) // h.record_length if h.record_length else 0
        stop = min(h.count, there) if self.high is None else min(h.count, there, self.high)
        step = int(self.options.get("recordsperpartition", WINDOW_POINTS))
        return [Records(a, min(stop, a + step)) for a in range(self.low, stop, step)] or [Records(0, 0)]

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        n = partition.stop - partition.start
        if n <= 0:
            return
        parts, h = self._open()
        rows = np.frombuffer(parts.read(h.data_offset + partition.start * h.record_length, n * h.record_length), record_type(h.format_id, h.record_length))
        pos = np.arange(partition.start, partition.stop)
        if "samplefraction" in self.options:  # before any value is decoded
            kept = hashed_numbers(pos) <= int(float(self.options["samplefraction"]) * 1_000_000)
            rows, pos = rows[kept], pos[kept]
        value = lambda c: rows[c].astype(np.int32) if c in rows.dtype.names else np.zeros(len(pos), np.int32)
        columns = [pa.array(pos) if c == "pos" else pa.array(value(c)) for c in self.names]
        yield pa.RecordBatch.from_arrays(columns, self.names)


@dataclass
class Part(WriterCommitMessage):
    """A task's draft and the records in it."""

    path: str
    count: int
    low: int
    high: int


class Writer(DataSourceArrowWriter):
    """Tasks write drafts under hidden names; what the commit lists becomes parts, in the order of pos, the header last.

    A folder without a header is no file, so readers see all of a write or nothing of it. Drafts of tasks that failed,
    or ran twice, go with the commit or the abort; one of a task that outlives the abort stays hidden.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.head = bytes.fromhex(options["head"])
        h = parse_header(self.head)
        self.kind = record_type(h.format_id, h.record_length)
        store, path = pafs.FileSystem.from_uri(self.folder)
        if not overwrite and store.get_file_info(f"{path}/{HEADER_NAME}").is_file:
            raise ValueError(f"{self.folder} holds a point file; only mode overwrite replaces it")
        store.create_dir(path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        store, path = pafs.FileSystem.from_uri(self.folder)
        part, out = Part("", 0, 0, 0), None  # without a path where there are no rows
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if out is None:
                    part = Part(f"{path}/.{self.job}-{uuid.uuid4().hex}", 0, batch.column("pos")[0].as_py(), 0)
                    out = store.open_output_stream(part.path)
                rows = np.zeros(batch.num_rows, self.kind)
                for name in self.kind.names:
                    if name in batch.schema.names:
                        rows[name] = batch.column(name).to_numpy(zero_copy_only=False)
                out.write(rows.tobytes())
                part.count += batch.num_rows
                part.high = batch.column("pos")[-1].as_py()
            if out is not None:
                out.close()
        except BaseException:
            if out is not None:
                out.close()
                store.delete_file(part.path)
            raise
        return part

    def _files(self) -> tuple[pafs.FileSystem, str, list[pafs.FileInfo]]:
        store, path = pafs.FileSystem.from_uri(self.folder)
        return store, path, [f for f in store.get_file_info(pafs.FileSelector(path)) if f.is_file]

    def _drop_drafts(self) -> None:
        store, _, files = self._files()
        for f in files:
            if f.base_name.startswith(f".{self.job}-"):
                store.delete_file(f.path)

    def commit(self, messages: list[Part | None]) -> None:
        found = sorted((m for m in messages if m is not None and m.path), key=lambda m: m.low)
        if any(a.high >= b.low for a, b in zip(found, found[1:])):
            raise ValueError("parts overlap: records have to be in ranges of pos, sorted within each")
        store, path, files = self._files()
        if self.overwrite:
            for f in sorted(files, key=lambda f: f.base_name != HEADER_NAME):  # the header first
                if f.base_name.endswith(".las"):
                    store.delete_file(f.path)
        for i, part in enumerate(found, 1):
            store.move(part.path, f"{path}/part-{i:06d}.las")
        self._drop_drafts()
        whole = bytearray(self.head)
        struct.pack_into("<I", whole, 107, sum(p.count for p in found))
        draft = f"{path}/.{self.job}-head"
        with store.open_output_stream(draft) as out:
            out.write(bytes(whole))
        store.move(draft, f"{path}/{HEADER_NAME}")

    def abort(self, messages: list[Part | None]) -> None:
        self._drop_drafts()


class LasDataSource(DataSource):
    """spark.read.format("las").load(uri of a file or of a folder of parts), df.write.format("las").save(uri of a folder).

    Written are pos, which has to rise within each partition and from one to another, and the columns of the header's
    record format that are there; others are 0. Option head is the header in hex; its count is set. Mode append writes
    where there is no file yet, mode overwrite replaces one.

    Options: recordsPerPartition; mode (intended rejects versions and formats that are not known); sampleFraction keeps
    that share of the records, those that sample.subsample keeps in its mode "hash".
    """

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader({k.lower(): v for k, v in self.options.items()}, schema)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer({k.lower(): v for k, v in self.options.items()}, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LasDataSource)


def read_header(uri: str) -> Header:
    return parse_header(Parts(uri).read(0, HEADER_BYTES))


def read_points(spark: SparkSession, uri: str, mode: str = "observed", records_per_partition: int = WINDOW_POINTS, sample: float | None = None) -> DataFrame:
    """Points of a file, or a share of them. Observed, the header's offset is not added; intended, it is."""
    register(spark)
    h = read_header(uri)
    reader = spark.read.format("las").option("mode", mode).option("recordsPerPartition", str(records_per_partition))
    raw = (reader if sample is None else reader.option("sampleFraction", repr(float(sample)))).load(uri)
    ox, oy, oz = h.offset if mode == "intended" else (0.0, 0.0, 0.0)
    colours = [scalar.resolved_colour(f"i{ch}", "classification", k).alias(ch) for k, ch in enumerate("rgb")]
    return raw.select(
        "pos", scalar.scaled("ix", h.scale[0], ox).alias("x"), scalar.scaled("iz", h.scale[2], oz).alias("y"), scalar.scaled("iy", h.scale[1], oy).alias("z"),
        *colours, F.col("intensity").cast("double").alias("intensity"), F.col("classification").cast("double").alias("classification"),
    )


def file_records(points: DataFrame, h: Header, mode: str = "observed") -> DataFrame:
    """Stored values of points. Observed, centred points are held against the header's own bounds, the up axis takes the
    other's scale, and every class is 2; intended, points are in file coordinates and keep their class."""
    x, up, z = F.col("x"), F.col("y"), F.col("z")
    stored = lambda v, scale: (v / F.lit(float(scale))).cast("int")  # towards zero
    if mode == "observed":
        kept = points.where(~((x < h.low[0]) | (up < h.low[2]) | (z < h.low[1])))
        return kept.select("pos", stored(x, h.scale[0]).alias("ix"), stored(z, h.scale[2]).alias("iy"), stored(up, h.scale[1]).alias("iz"), F.col("intensity").cast("int").alias("intensity"), F.lit(2).alias("classification"))
    near = lambda v, k: F.round((v - F.lit(h.offset[k])) / F.lit(float(h.scale[k]))).cast("int")
    return points.select("pos", near(x, 0).alias("ix"), near(z, 1).alias("iy"), near(up, 2).alias("iz"), F.col("intensity").cast("int").alias("intensity"), F.col("classification").cast("int").alias("classification"))


def supported(major: Column, minor: Column, format_id: Column) -> Column:
    """Whether the intended mode reads a file of that version and point format."""
    return (major * 10 + minor <= LATEST_VERSION) & format_id.isin(*RECORD_LENGTH)


def write(records: DataFrame, h: Header, folder: str, parts: int = 0, head: bytes | None = None) -> str:
    """Writes records in the order of pos as a file of parts below folder: a header, then a part for each range of pos.

    ``head`` are the header's bytes where another file's are to be kept but for the count. Without ``parts`` there is
    one for each PART_RECORDS that the header counts, as a part is a task.
    """
    register(records.sparkSession)
    length = h.record_length or RECORD_LENGTH.get(h.format_id, 20)
    whole = head or header_bytes(Header(h.count, h.scale, h.offset, h.low, h.high, h.format_id, length, h.data_offset))
    parts = parts or max(4, -(-h.count // PART_RECORDS))
    names = [n for n in record_type(h.format_id, length).names if n in records.columns]
    ranges = records.select("pos", *[F.col(n).cast("int").alias(n) for n in names]).repartitionByRange(parts, "pos").sortWithinPartitions("pos")
    ranges.write.format("las").option("head", whole.hex()).mode("append").save(folder)
    return folder


def write_reduced(records: DataFrame, source: str, folder: str, parts: int = 0) -> str:
    """file_records() as a file with the source's header but for the count; bytes of a record that they don't give are 0."""
    there = Parts(source)
    h = parse_header(there.read(0, HEADER_BYTES))
    return write(records, h, folder, parts, there.read(0, h.data_offset))


def round_trip(records: DataFrame, h: Header) -> DataFrame:
    spark = records.sparkSession
    stored = records.select("pos", "ix", "iy", "iz", F.col("intensity").cast("int").alias("intensity"), F.col("classification").cast("int").alias("classification"), "ir", "ig", "ib")
    out = Header(h.count, h.scale, h.offset, h.low, h.high, 2, RECORD_LENGTH[2], HEADER_BYTES)
    folder = write(stored, out, f"{shared_dir(spark)}/cloud")
    register(spark)
    return spark.read.format("las").load(folder)
