"""WARC archives: a writer that records copies as revisits, and a Spark data source that reads archives.

Records are gzip members of their own (WARC 1.1) and carry the member's length in the extra field "sl", so a reader
passes over a payload without inflating it. The data source plans one partition for each run of files, takes
equality predicates on record headers, parses a record's headers first, and inflates the payload only of records that
pass, and only if payloads are asked for. Archives of other writers, compressed or not, are read too.
"""

from __future__ import annotations

import base64
import struct
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from voxelspan.llm.common import materialize, shared_dir

SCHEMA = "record_type string, record_id string, target_uri string, page_id bigint, refers_to bigint, payload_digest string, payload_bytes bigint, headers map<string,string>, payload binary"
PUSHED = {"record_type", "record_id", "target_uri", "page_id"}
#: Compressed bytes after which a task begins another file, and bytes of files that one partition reads.
FILE_BYTES = 64 << 20
PARTITION_BYTES = 32 << 20


def record_uri(page_id: int | None, digest: str, kind: str = "response") -> str:
    """The same for the same page and payload, so a task that is run again writes the same records."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{page_id}:{digest}')}>"


def _line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member; a revisit holds the HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + (payload or b"")
    kind = "revisit" if revisit else "response"
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_uri(page_id, digest, kind)}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_line(url)}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_uri(refers_to, digest)}"]
        if refers_to is not None:
            lines.append(f"X-Refers-To-Page-ID: {refers_to}")
    data = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    whole = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, whole, len(data))
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def mark_revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, payload, size, payload_digest, revisit, refers_to: which record each row of pages becomes.

    Of rows with equal payloads of at least ``least`` bytes that with the largest page_id is the response, the others
    revisit it; of several rows with that page_id the one whose url sorts first. A null html is an empty payload, a null
    page_id sorts below all others. Payloads are equal if their SHA-1, length and XXH64 are, so payloads made to share a
    SHA-1 stay apart.

    Only digests that stand more than once are joined, from a written table: where it is small it goes to the rows and
    no payload is shuffled; where it is large both sides are plain shuffles and a digest that a third of the pages share
    is cut up by adaptive execution.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("bigint"), "payload_digest": F.sha1("payload"), "_x": F.xxhash64("payload")})
    same = ["payload_digest", "size", "_x"]
    counts = rows.where(F.col("size") >= least).groupBy(*same, "page_id").agg(F.count("*").alias("n"))
    groups = counts.groupBy(*same).agg(F.max(F.struct("page_id", "n")).alias("top"), F.sum("n").alias("n")).where("n > 1")
    groups = materialize(groups.select(*same, F.col("top.page_id").alias("top"), F.col("top.n").alias("tops")))
    joined = rows.join(groups, same, "left")
    first = F.col("tops").isNotNull() & F.col("page_id").eqNullSafe(F.col("top"))
    revisit = F.col("tops").isNotNull() & ~first
    one = lambda again: [F.when(~again, F.col("payload")).alias("payload"), "size", "payload_digest", again.alias("revisit"), F.when(again, F.col("top")).alias("refers_to")]
    out = joined.select("page_id", "url", *one(revisit))
    if groups.where("tops > 1").isEmpty():
        return out
    # repeated rows of the response: aggregated, so that no payload travels more than once a task
    ties = joined.where(first & (F.col("tops") > 1))
    by = [*same, "top"]
    response = ties.groupBy(*by).agg(F.min(F.struct(F.col("url").isNotNull().alias("k"), "url")).alias("u"), F.first("payload").alias("payload"))
    left = ties.groupBy(*by, "url").agg(F.count("*").alias("n")).join(response.select(*same, "u"), same)
    left = left.withColumn("n", (F.col("n") - F.col("url").eqNullSafe(F.col("u.url")).cast("int")).cast("int")).where("n > 0")
    parts = [
        joined.where(~F.coalesce(first & (F.col("tops") > 1), F.lit(False))).select("page_id", "url", *one(revisit)),
        response.select(F.col("top").alias("page_id"), "u.url", *one(F.lit(False))),
        left.withColumn("payload", F.lit(None).cast("binary")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n")))).select(F.col("top").alias("page_id"), "url", *one(F.lit(True))),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def write(marked: DataFrame, folder: str) -> DataFrame:
    """Writes mark_revisits() as archives below folder and returns uri, records, bytes of each.

    A task names its files by its number and renames each when it is whole; a task that is run again replaces them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held, size, records, done = TaskContext.get().partitionId(), 0, [], 0, 0, []

        def flush() -> None:
            nonlocal number, held, size, records
            uri = f"{folder}/part-{task:06d}-{number:04d}.warc.gz"
            store, path = pafs.FileSystem.from_uri(uri)
            draft = f"{path}.{uuid.uuid4().hex}"
            with store.open_output_stream(draft) as out:
                for x in held:
                    out.write(x)
            store.move(draft, path)
            done.append((uri, records, size))
            number, held, size, records = number + 1, [], 0, 0

        for batch in batches:
            c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                page = c["page_id"][i].as_py()
                held.append(record(page, c["url"][i].as_py(), c["payload"][i].as_py(), c["size"][i].as_py(), c["payload_digest"][i].as_py(), c["refers_to"][i].as_py(), c["revisit"][i].as_py()))
                size, records = size + len(held[-1]), records + 1
                if size >= FILE_BYTES:
                    flush()
        if held:
            flush()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["uri", "records", "bytes"])

    return materialize(marked.mapInArrow(run, "uri string, records bigint, bytes bigint"))


@dataclass
class Files(InputPartition):
    uris: list[str]


class Member:
    """A record at a place of a file: its headers at once, its block on demand."""

    def __init__(self, file, at: int):
        self.file, self.at, self.end = file, at, None
        start = file.read_at(18, at)
        self.gzip = start[:2] == b"\x1f\x8b"
        self.data, self.inflate, self.read_to = b"", None, at
        if self.gzip:
            if len(start) >= 18 and start[3] & 4:
                extra = file.read_at(struct.unpack_from("<H", start, 10)[0], at + 12)
                while len(extra) >= 4:
                    name, n = struct.unpack_from("<2sH", extra)
                    if name == b"sl" and n == 8:
                        self.end = at + struct.unpack_from("<I", extra, 4)[0]
                        if self.end < at + 20:  # less than a member's own header and end take
                            raise ValueError("a member's length is too small")
                    extra = extra[4 + n :]
            self.inflate = zlib.decompressobj(31)

    def head(self) -> Member:
        """Reads the headers."""
        while (cut := self.data.find(b"\r\n\r\n")) < 0 and self._more():
            pass
        if cut < 0 and self.data.strip() or self.gzip and cut < 0:
            raise EOFError("a record ends before its headers do")
        lines = self.data[: max(cut, 0)].decode("utf-8", "replace").split("\r\n")
        self.headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        self.body, self.length = cut + 4, int(self.headers.get("content-length", 0) or 0)
        if self.length < 0:
            raise ValueError("a record's length is negative")
        if not self.gzip:
            self.end = self.at + self.body + self.length + 4
        return self

    def _more(self, size: int = 4096) -> bool:
        raw = self.file.read_at(size, self.read_to)
        self.read_to += len(raw)
        if not raw or self.inflate is not None and self.inflate.eof:
            return False
        self.data += self.inflate.decompress(raw) if self.gzip else raw
        return True

    def block(self, size: int | None = None) -> bytes:
        """The record's block, or as much of it as holds size bytes; a block that ends early is an error."""
        want = self.body + (self.length if size is None else min(size, self.length))
        parts, have = [self.data], len(self.data)
        while have < want:
            self.data = b""
            if not self._more(1 << 16 if size is None else 4096):
                break
            parts.append(self.data)
            have += len(self.data)
        self.data = b"".join(parts)
        if have < want:
            raise EOFError("a record ends before its length")
        return self.data[self.body : want]

    def next(self) -> int:
        """Where the next record starts; without a known length the rest is inflated to find out."""
        if self.end is None:
            while not self.inflate.eof and self._more(1 << 16):
                self.data = self.data[: self.body]
            if not self.inflate.eof:
                raise EOFError("a member is cut off")
            self.end = self.read_to - len(self.inflate.unused_data)
        if self.end - (0 if self.gzip else 4) > self.file.size():  # the line ends behind an uncompressed record may be missing
            raise EOFError("a record's length leads beyond the file")
        return self.end


class Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.equal = options, []
        self.names = schema.names

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in PUSHED:
                self.equal.append((f.attribute[0], {f.value} if isinstance(f, EqualTo) else set(f.value)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        store, path = pafs.FileSystem.from_uri(self.options["path"])
        info = store.get_file_info(path)
        files = [info] if info.is_file else store.get_file_info(pafs.FileSelector(path, recursive=True))
        scheme = self.options["path"].partition("://")[0]
        plan, room = [], 0
        for f in sorted((f for f in files if f.is_file and f.path.endswith((".warc", ".warc.gz"))), key=lambda f: f.path):
            if room < f.size or not plan:
                plan.append([])
                room = PARTITION_BYTES
            plan[-1].append(f"{scheme}://{f.path}")
            room -= f.size
        return [Files(x) for x in plan] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for uri in partition.uris:
            store, path = pafs.FileSystem.from_uri(uri)
            with store.open_input_file(path) as file:
                size, at = file.size(), 0
                while at < size:
                    member, row = None, None
                    try:
                        member = Member(file, at)
                        row = self.record(member.head())
                        after = member.next()
                    except (zlib.error, struct.error, EOFError, ValueError) as damage:
                        if self.options.get("damaged", "fail").lower() != "skip":
                            raise ValueError(f"{uri}, byte {at}: {damage}") from damage
                        after, row = (member and member.end) or size, None
                    if row is not None:
                        yield row
                    at = after if after > at else size  # every step goes on

    def record(self, member: Member) -> tuple | None:
        """A record's row, None if it doesn't pass the predicates."""
        payloads = self.options.get("payload", "true").lower() == "true"
        row = self.row(member.headers)
        if not member.headers or not all(row[k] in values for k, values in self.equal):
            return None
        http = member.headers.get("content-type", "").startswith("application/http")
        revisit = row["record_type"] == "revisit"
        block = member.block(None if payloads and not revisit else 2048) if http or payloads else b""
        head, _, body = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
        size_line = [x for x in head.lower().split(b"\r\n") if x.startswith(b"content-length:")]
        row["payload_bytes"] = int(size_line[0].split(b":")[1]) if size_line else max(0, member.length - (len(head) + 4 if http else 0))
        row["payload"] = body if payloads and not revisit else None
        return tuple(row[n] for n in self.names)

    @staticmethod
    def row(h: dict[str, str]) -> dict:
        number = lambda k: int(h[k]) if h.get(k, "").lstrip("-").isdigit() else None
        digest = h.get("warc-payload-digest", "").rpartition(":")[2]
        if len(digest) == 32:
            digest = base64.b32decode(digest).hex()
        return {"record_type": h.get("warc-type"), "record_id": h.get("warc-record-id"), "target_uri": h.get("warc-target-uri"), "page_id": number("x-page-id"), "refers_to": number("x-refers-to-page-id"), "payload_digest": digest or None, "payload_bytes": None, "headers": h, "payload": None}


class WarcDataSource(DataSource):
    """spark.read.format("warc").load(uri).

    Option payload=false leaves payloads out. A record that is damaged or cut off fails the read, naming file and place;
    with damaged=skip it is passed over, and so is the rest of its file where the record's length is not known.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def round_trip(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Writes a record for each row of pages and reads the archives back.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri for each row; length and digest
    of a response are those of the payload that was read, a revisit's are those its headers give.
    """
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc"
    store, path = pafs.FileSystem.from_uri(folder)
    store.create_dir(path)
    write(mark_revisits(pages, least), folder)
    register(spark)
    rows = spark.read.format("warc").load(folder)
    whole = F.col("record_type") == "response"
    return rows.select(
        "page_id", F.when(whole, F.octet_length("payload").cast("bigint")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(whole, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to", "target_uri",
    )


#: DuckDB SQL for round_trip() over pages.
ROUND_TRIP_SQL = """
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, url, octet_length(b) AS n, sha1(b) AS h FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS top, row_number() OVER (PARTITION BY h, n ORDER BY page_id DESC NULLS LAST, url NULLS FIRST) AS place FROM d),
r AS (SELECT *, n >= 1000 AND place > 1 AS again FROM m)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN again THEN top END AS refers_to, url AS target_uri FROM r
"""
