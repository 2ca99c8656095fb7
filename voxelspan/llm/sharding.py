"""Documents dealt to shards by longest-processing-time scheduling: groups that must stay together, largest first, each
to the shard that is least loaded.

The schedule is the one that a heap over the shards gives item by item. Groups of one size are scheduled together: of n
items of size s, shard j takes its m-th when the heap's least key is (load_j + m * s, j), so the order in which shards
are drawn merges one arithmetic progression a shard; between two shards joining in, it is a fixed cycle. The driver
sees the distinct sizes, one row each (fewer than sqrt(2 * bytes): some 14 million at 100 TB), a stretch at a time.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelspan.llm.common import discard, materialize, spread

#: Bytes that a document takes beside its text.
OVERHEAD = 16
#: Sizes that the driver schedules at once.
STRETCH = 200_000
#: Parts that the groups of one size are numbered in.
PARTS = 4096


class Schedule:
    """Shards' loads while groups are dealt, largest first."""

    def __init__(self, shards: int):
        self.heap = [(0, j) for j in range(shards)]

    def take(self, size: int, n: int) -> list[tuple[int, list[int]]]:
        """Deals n groups of one size: (first rank, cycle) pairs; the group of rank r goes to cycle[(r - first) % len(cycle)]."""
        if n < 2 * len(self.heap) or size <= 0:
            drawn = []
            for _ in range(n):
                load, j = self.heap[0]
                heapq.heapreplace(self.heap, (load + size, j))
                drawn.append(j)
            return [(0, drawn)] if n else []
        # at level t the shards with load // size <= t draw once each, by load % size
        entry = sorted((load // size, load % size, j) for load, j in self.heap)
        out, rank, active, k, level = [], 0, [], 0, entry[0][0]
        drawn = dict.fromkeys((j for _, _, j in entry), 0)
        while rank < n:
            while k < len(entry) and entry[k][0] == level:
                active.append(entry[k][1:])
                k += 1
            active.sort()
            cycle = [j for _, j in active]
            levels = entry[k][0] - level if k < len(entry) else -(-(n - rank) // len(cycle))
            here = min(n - rank, levels * len(cycle))
            out.append((rank, cycle))
            for i, j in enumerate(cycle):
                drawn[j] += here // len(cycle) + (i < here % len(cycle))
            rank, level = rank + here, level + levels
        self.heap = [(load + size * drawn[j], j) for load, j in self.heap]
        heapq.heapify(self.heap)
        return out


def _scheduled(sizes: DataFrame, shards: int) -> DataFrame:
    """group_bytes, first, cycle of each size's stretches, by a heap over the sizes in falling order."""
    spark, schedule = sizes.sparkSession, Schedule(shards)
    rows = iter(sizes.orderBy(F.col("group_bytes").desc()).toLocalIterator(prefetchPartitions=True))
    schema, out = "group_bytes bigint, first bigint, cycle array<int>", None

    def stretches() -> Iterator[list]:
        while part := list(islice(rows, STRETCH)):
            yield [(r["group_bytes"], first, cycle) for r in part for first, cycle in schedule.take(r["group_bytes"], r["n"])]

    for part in stretches():
        stored = materialize(spark.createDataFrame(part, schema))
        out = stored if out is None else out.unionByName(stored)
    return spark.createDataFrame([], schema) if out is None else out


def _ranked(df: DataFrame, group: str, part: Column, order: list[str], name: str) -> DataFrame:
    """df with the place of each row, from 0, in its group's (part, order): ranks within parts, and what stands before each."""
    df = df.withColumn("_part", part)
    counts = df.groupBy(group, "_part").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(group, "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    local = df.withColumn("_rank", F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order)) - 1)
    return local.join(starts, [group, "_part"]).withColumn(name, F.col("_before") + F.col("_rank")).drop("_part", "_before", "_rank")


def assign(docs: DataFrame, shards: int, carry: list[str] | None = None) -> DataFrame:
    """row (a struct of the columns in ``carry``: doc_id if it isn't given), size, text_crc32, shard (from 0) and slot of each row of docs.

    Rows of equal texts form a group, null and empty texts one; a group goes to one shard whole. Of groups of equal
    bytes that whose text's SHA-256 is smaller is dealt first, of equally loaded shards that of the smaller number is
    taken. size is the text's bytes in UTF-8 and 16 more. slot numbers a shard's rows without gaps from 0, by doc_id
    where that is carried (nulls first), else as they were read; repeated rows count each. Columns of any name may be
    carried.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in (carry or ["doc_id"])])
    rows = docs.select(row.alias("row"), (F.octet_length(text).cast("bigint") + OVERHEAD).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("_key"))
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()))
    groups = materialize(rows.groupBy("_key").agg(F.sum("size").alias("group_bytes")))
    plan = _scheduled(groups.groupBy("group_bytes").agg(F.count("*").alias("n")), shards)
    first_bits = F.conv(F.hex(F.substring("_key", 1, 2)), 16, 10).cast("int")  # parts in the order of the keys
    ranked = _ranked(groups, "group_bytes", F.floor(first_bits / (65536 // PARTS)), ["_key"], "_place")
    own = plan.groupBy("group_bytes").agg(F.sort_array(F.collect_list(F.struct("first", "cycle")), asc=False).alias("_plan"))  # at most a row a shard
    at = F.filter("_plan", lambda p: p["first"] <= F.col("_place"))[0]
    shard = F.get(at["cycle"], F.pmod(F.col("_place") - at["first"], F.size(at["cycle"]).cast("bigint")).cast("int"))
    dealt = materialize(ranked.join(own, "group_bytes").select("_key", shard.alias("shard")))
    discard(groups)
    placed = materialize(rows.join(dealt, "_key").drop("_key"))
    discard(rows)
    discard(dealt)
    ordered = materialize(placed.withColumn("_id", F.col("row.doc_id") if "doc_id" in (carry or ["doc_id"]) else F.lit(None)).repartitionByRange(spread(placed), "shard", "_id", "_row").withColumn("_range", F.spark_partition_id()))
    discard(placed)
    return _ranked(ordered, "shard", F.col("_range"), ["_id", "_row"], "slot").select("row", "size", "text_crc32", "shard", "slot")


def write(assigned: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    """The carried rows as Parquet below path/shard=N, in files of slots that follow one another."""
    file = F.floor(F.col("slot") / rows_per_file)
    assigned.repartition("shard", file).sortWithinPartitions("shard", "slot").select("row.*", F.col("shard").alias("shard"), F.col("slot").alias("slot")).write.partitionBy("shard").parquet(path)


def digest(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null: the law is that of bytes) of each row."""
    found = assign(docs, shards)
    return found.select(F.col("row.doc_id").cast("bigint").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


_CRC = "list_reduce(list_transform(string_split(regexp_replace(hex(encode(t)), '(..)', '\\1 ', 'g'), ' ')[:-2], lambda x: CAST('0x' || x AS BIGINT)), lambda c, x: xor(c >> 8, tb[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT))"
DIGEST_SQL = f"""WITH RECURSIVE
tab AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS tb),
d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, sha256(coalesce(text, '')) AS k, octet_length(encode(coalesce(text, ''))) + 16 AS size FROM documents),
g AS MATERIALIZED (SELECT k, CAST(sum(size) AS BIGINT) AS b, row_number() OVER (ORDER BY sum(size) DESC, k) AS i FROM d GROUP BY k),
w AS (SELECT CAST(0 AS BIGINT) AS i, list_transform(range(40), lambda x: CAST(0 AS BIGINT)) AS loads, CAST(0 AS BIGINT) AS shard
    UNION ALL SELECT g.i, list_transform(w.loads, lambda x, j: x + CASE WHEN j = list_position(w.loads, list_min(w.loads)) THEN g.b ELSE 0 END), list_position(w.loads, list_min(w.loads)) - 1 FROM w JOIN g ON g.i = w.i + 1)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(xor(4294967295, {_CRC}) AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(w.shard AS INT) AS shard,
row_number() OVER (PARTITION BY w.shard ORDER BY doc_id NULLS FIRST) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM d JOIN g USING (k) JOIN w USING (i), tab"""
