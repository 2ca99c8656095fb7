"""Exact top-k inner products by pivot tables: bounds first, candidates in bound order, until no bound can win.

Every vector's distances to the pivots, and to the origin, are kept once. For a query all of them together give each
candidate a lower bound of its distance, the largest that they allow: they fix both vectors' places in the span of the
pivots and their heights above it (Connor et al., Inf. Syst. 2017), which no single pivot's triangle inequality does. A lower
bound of the distance is an upper bound of the inner product. Candidates are evaluated in order of falling bound, in
growing slices, until the k-th best score exceeds the next bound. Every query first meets one block of candidates; its
k-th score there is where all other blocks start from.

Vectors are dealt into blocks of bounded size; a pair of blocks is one row of the plan, so that neither side is ever
gathered whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelspan.llm.common import discard, materialize

#: Vectors in a block of candidates, in a block of queries, pivots, and rows the pivots are chosen from.
BLOCK, QUERIES, PIVOTS, SAMPLE = 4096, 512, 48, 2048
LONG = (-(1 << 63), (1 << 63) - 1)


def quantize(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, row and v, the components floor(scale * x) as doubles; row tells rows apart once the table is written.

    Vectors that are null, empty, or have null or non-finite components take no part, nor do rows without vec_id: a
    result could not name them. Repeated rows count each.
    """
    usable = (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    value = lambda x: x.cast("double") * scale
    v = F.transform("embedding", lambda x: F.when(F.abs(value(x)) < 2.0**52, F.floor(value(x)).cast("double")).otherwise(value(x)))  # beyond 2**52 all are whole
    some = vectors.select(F.col("vec_id").cast("bigint"), "embedding").where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull())
    return some.where(usable).select("vec_id", F.monotonically_increasing_id().alias("row"), v.alias("v"))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """At most n of the sample, each farthest from the span of those chosen before."""
    rest, chosen = np.array(sample, np.float64), []
    sizes = np.linalg.norm(rest, axis=1)
    least = 1e-3 * sizes.max(initial=0)
    while len(chosen) < min(n, len(sample)):
        i = int(sizes.argmax())
        if not least < sizes[i] < np.inf:
            break
        chosen.append(i)
        q = rest[i] / sizes[i]
        rest -= np.outer(rest @ q, q)
        sizes = np.linalg.norm(rest, axis=1)
    return sample[chosen]


def places(d: np.ndarray, norms: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Of each row its coordinates in the span of the pivots and its height above it, from its distances d and squared length."""
    if not len(pivots):
        return np.sqrt(norms)[:, None]
    r = np.linalg.qr(pivots.T, mode="r")
    products = (norms[:, None] + (pivots * pivots).sum(1) - d * d) / 2
    y = np.linalg.solve(r.T, products.T).T
    return np.concatenate([y, np.sqrt(np.maximum(norms - (y * y).sum(1), 0))[:, None]], 1)


def upper_bounds(of_query: np.ndarray, of_rows: np.ndarray, own: float, norms: np.ndarray) -> np.ndarray:
    """What a query's inner products can be at most; rounding never makes one too small."""
    away = of_rows - of_query
    upper = (norms + own - (away * away).sum(1)) / 2 + 1e-6 * (norms + own) + 1
    return np.where(np.isfinite(upper), upper, np.inf)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of a with the rows of b as whole numbers; beyond 64 bits the nearest end of the range."""
    if not len(b):
        return np.zeros(0, np.int64)
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, b.shape[1]) < 2.0**53:
        return (b @ a).astype(np.int64)
    whole = [int(x) for x in a]
    return np.array([min(max(sum(x * int(y) for x, y in zip(whole, row)), LONG[0]), LONG[1]) for row in b], np.int64)


def best(query: np.ndarray, own_row: int, upper: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, rows: np.ndarray | None = None, floor: float = -np.inf) -> tuple[list[tuple[int, int]], int]:
    """The k best (score, vec_id) among the candidates, and how many were evaluated; those surely below ``floor`` may be missing.

    rows (ids, if not given) tell the candidates apart; the query's own is none.
    """
    own = (ids if rows is None else rows) == own_row
    rest = np.flatnonzero(~own & (upper >= floor))
    found_ids, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
    done, step = 0, 64
    while len(rest):
        if step < len(rest):
            part = np.argpartition(-upper[rest], step - 1)
            take, rest = rest[part[:step]], rest[part[step:]]
        else:
            take, rest = rest, rest[:0]
        done += len(take)
        found = np.concatenate([found, exact_scores(query, vectors[take])])
        found_ids = np.concatenate([found_ids, ids[take]])
        keep = np.lexsort((found_ids, -found))[:k]
        found, found_ids = found[keep], found_ids[keep]
        if len(found) == k and len(rest):
            rest = rest[upper[rest] >= found[-1]]
        step *= 2
    return list(zip(found.tolist(), found_ids.tolist())), done


def search(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, counted: bool = False) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of all other rows for each row whose vec_id is divisible by every.

    Ties go to the smaller vec_id. A query's own row is no candidate; a row that repeats it is, and asks for itself: each
    row of one vec_id returns its own k. Vectors of another length than the query's are no candidates. ``counted`` adds
    evaluated, the candidates of the query that were not excluded by their bounds.
    """
    rows = materialize(quantize(vectors, scale).withColumn("dim", F.size("v")))
    dims = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # lengths, not vectors
    pivots = {}
    for dim in dims:
        sample = rows.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id", "v")).limit(SAMPLE).select("v").collect()
        pivots[dim] = choose_pivots(np.array([r["v"] for r in sample]).reshape(len(sample), dim), PIVOTS)
    table_schema = "dim int, b int, ids array<bigint>, rows array<bigint>, floors array<double>, v binary, d binary"

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one block to one row: ids, vectors and their distances to the pivots."""
        for whole in batches:
            for i in range(whole.num_rows):
                batch = whole.slice(i, 1)
                dim = batch.column("dim")[0].as_py()
                x = np.array(batch.column("v")[0].as_py(), np.float64).reshape(-1, dim)
                d = np.stack([np.linalg.norm(x - p, axis=1) for p in pivots[dim]], 1) if len(pivots[dim]) else np.zeros((len(x), 0))
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("dim", "b", "ids", "rows", "floors")), pa.array([x.tobytes()]), pa.array([d.tobytes()])], ["dim", "b", "ids", "rows", "floors", "v", "d"])

    def tables(some: DataFrame, size: int, sizes: dict[int, int]) -> DataFrame:
        count = F.lit(1)
        for dim, n in sizes.items():
            count = F.when(F.col("dim") == dim, F.lit(max(1, -(-n // size)))).otherwise(count)
        dealt = some.withColumn("b", F.pmod(F.xxhash64("row"), count).cast("int"))
        packed = dealt.groupBy("dim", "b").agg(F.collect_list(F.struct("vec_id", "row", "floor", "v")).alias("r"))  # some size rows each
        packed = packed.select("dim", "b", F.col("r.vec_id").alias("ids"), F.col("r.row").alias("rows"), F.col("r.floor").alias("floors"), F.flatten("r.v").alias("v"))
        return packed.mapInArrow(table, table_schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                ids, names, asking = (np.array(r[n], np.int64) for n in ("ids", "rows", "q_rows"))
                x, q = np.frombuffer(r["v"]).reshape(len(ids), -1), np.frombuffer(r["q_v"]).reshape(len(asking), -1)
                d, qd = np.frombuffer(r["d"]).reshape(len(ids), -1), np.frombuffer(r["q_d"]).reshape(len(asking), -1)
                norms, own = (x * x).sum(1), (q * q).sum(1)
                at, q_at = places(d, norms, pivots[r["dim"]]), places(qd, own, pivots[r["dim"]])
                out: list[tuple[int, int, int, int, int]] = []
                for j, row in enumerate(asking.tolist()):
                    upper = upper_bounds(q_at[j], at, own[j], norms)
                    found, done = best(q[j], row, upper, ids, x, k, names, r["q_floors"][j])
                    out += [(r["q_ids"][j], row, s, v, 0 if n else done) for n, (s, v) in enumerate(found)]
                    if not found and done:
                        raise AssertionError("evaluated candidates are found")
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["query_id", "row", "score", "vec_id", "evaluated"])

    def scored(queries: DataFrame, pairs_of) -> DataFrame:
        sent = queries.select("dim", F.col("b").alias("qb"), *[F.col(n).alias(f"q_{n}") for n in ("ids", "rows", "floors", "v", "d")])
        return pairs_of(sent).join(candidates, ["dim", "b"]).mapInArrow(score, "query_id bigint, row bigint, score bigint, vec_id bigint, evaluated bigint")

    none = F.lit(float("-inf"))
    candidates = materialize(tables(rows.withColumn("floor", none), BLOCK, dims))
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    query_sizes = {r["dim"]: r["n"] for r in asked.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    numbers = F.create_map(*[F.lit(v) for dim, n in dims.items() for v in (dim, max(1, -(-n // BLOCK)))]) if dims else F.create_map(F.lit(0), F.lit(1))
    one = lambda sent: sent.withColumn("b", F.pmod("qb", F.try_element_at(numbers, F.col("dim"))).cast("int"))
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    first = scored(tables(asked.withColumn("floor", none), QUERIES, query_sizes), one)
    floors = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("row", F.col("score").cast("double").alias("floor"))
    floors = materialize(floors)
    again = asked.join(floors, "row", "left").withColumn("floor", F.coalesce("floor", none))
    names = candidates.select("dim", "b")
    tops = scored(tables(again, QUERIES, query_sizes), lambda sent: sent.join(names, "dim"))
    if counted:
        tops = materialize(tops)
        discard(floors)
        counts = tops.groupBy("row").agg(F.sum("evaluated").alias("evaluated"))
        ranked = tops.drop("evaluated").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return ranked.join(counts, "row").select("query_id", "rank", "vec_id", "score", "evaluated")
    return tops.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: DuckDB SQL for search() over embeddings.
SEARCH_SQL = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.r <> c.r AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
