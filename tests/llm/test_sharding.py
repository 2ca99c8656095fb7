import hashlib
import heapq
import random
import zlib
from collections import Counter, defaultdict

from voxelspan.llm import sharding

SCHEMA = "doc_id bigint, text string, shard int, slot bigint, size string"


def one_by_one(sizes, shards):
    heap = [(0, j) for j in range(shards)]
    out = []
    for s in sizes:
        load, j = heap[0]
        heapq.heapreplace(heap, (load + s, j))
        out.append(j)
    return out, sorted(heap)


def test_sizes_together_as_one_by_one():
    rng = random.Random(2)
    for shards in (1, 2, 7, 40):
        for _ in range(40):
            counts = {rng.choice((0, 1, 2, 3, 16, 17, 100, 5000, 70_001)): rng.choice((1, 2, 5, 90, 700)) for _ in range(rng.randint(1, 7))}
            order = sorted(counts, reverse=True)
            schedule, got = sharding.Schedule(shards), []
            for s in order:
                plan = schedule.take(s, counts[s])
                for r in range(counts[s]):
                    first, cycle = max(p for p in plan if p[0] <= r)
                    got.append(cycle[(r - first) % len(cycle)])
            expected, loads = one_by_one([s for s in order for _ in range(counts[s])], shards)
            assert got == expected and sorted(schedule.heap) == loads


def brute(rows, shards):
    groups = defaultdict(int)
    for _, t, *_ in rows:
        groups[t or ""] += len((t or "").encode()) + 16
    order = sorted(groups, key=lambda t: (-groups[t], hashlib.sha256(t.encode()).hexdigest()))
    dealt = dict(zip(order, one_by_one([groups[t] for t in order], shards)[0]))
    return Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), dealt[t or ""]) for i, t, *_ in rows)


def test_groups_stay_together_and_slots_have_no_gaps(spark):
    rng = random.Random(5)
    texts = ["", None, "é" * 9, "copy of many " * 3, *["".join(rng.choice("abc ") for _ in range(rng.choice((3, 12, 12, 12, 60)))) for _ in range(500)], "long " * 50_000]
    rows = [(i, rng.choice(texts), 1, 2, "x") for i in range(700)] + [(10_000 + i, texts[3], None, None, None) for i in range(400)]
    rows += [(None, t, 0, 0, None) for t in texts[:60]] + [(5, "twice", 0, 0, None)] * 2
    found = sharding.digest(spark.createDataFrame(rows, SCHEMA), shards=6).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in found) == brute(rows, 6)
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert {(r["law"], r["grown_shard"]) for r in found} == {("bytes", None)}


def test_empty_table_and_written_shards(spark, tmp_path):
    assert sharding.digest(spark.createDataFrame([], SCHEMA), shards=3).count() == 0
    rows = [(i, f"text {i % 9}", 1, 2, "x") for i in range(60)]
    assigned = sharding.assign(spark.createDataFrame(rows, SCHEMA), 4, carry=["text", "doc_id"])
    sharding.write(assigned, f"file://{tmp_path}/out", rows_per_file=10)
    back = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert sorted((r["doc_id"], r["text"]) for r in back) == sorted((i, t) for i, t, *_ in rows)
    assert sorted((r["row"]["doc_id"], r["shard"], r["slot"]) for r in assigned.collect()) == sorted((r["doc_id"], r["shard"], r["slot"]) for r in back)
