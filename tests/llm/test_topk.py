import numpy as np
import pytest

from voxelspan.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, every, k=5):
    good = [(n, i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for n, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, i, v in good:
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for m, j, w in good if m != n and len(v) == len(w))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [32, 4096])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERIES", 8)
    rng = np.random.default_rng(block)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(40)]  # ties
    rows += [(400, None), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (450, [float("nan")] * 6), (500, [float("inf")] * 6), (None, rows[0][1]), (550, [0.0] * 6), (560, []), (570, [])]
    rows += [rows[0], rows[100], rows[101], rows[0]]  # repeated rows count each, and ask each
    data = [(i, v, 0) for i, v in rows]
    got = topk.search(spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 AS dim", "'x' AS v"), every=10).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute(rows, 10)


def test_few_rows_and_none(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0], 0), (1, [1.0, -2.0], 0), (2, [3.0], 0)], SCHEMA)
    assert [tuple(r) for r in topk.search(frame).select("query_id", "rank", "vec_id", "score").collect()] == [(0, 1, 1, 65536 - 4 * 65536)]
    assert topk.search(spark.createDataFrame([], SCHEMA)).collect() == []
    assert topk.search(spark.createDataFrame([(0, [], 0), (50, None, 0)], SCHEMA)).collect() == []


def test_sql_on_repeated_rows(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist(), 0) for i in (0, 1, 1, 2, 3, 50, 50, 100)]
    frame = spark.createDataFrame([*rows, rows[0], rows[1], (4, [], 0), (0, None, 0), (7, [1.0], 0), (150, [2.0], 0), (None, [3.0], 0)], SCHEMA)
    frame.write.parquet(f"file://{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.execute(f"SELECT query_id, rank, vec_id, score FROM ({topk.SEARCH_SQL})").fetchall()
    got = topk.search(frame).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(want) == sorted(map(tuple, got)) and len(want) > 20


def test_bounds_hold_and_exclude(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 16))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None])
    pivots = topk.choose_pivots(x[:500], 12)
    d = np.stack([np.linalg.norm(x - p, axis=1) for p in pivots], 1)
    norms = (x * x).sum(1)
    at = topk.places(d, norms, pivots)
    for i in range(0, 3000, 300):
        assert (topk.upper_bounds(at[i], at, norms[i], norms) >= x @ x[i]).all()
    frame = spark.createDataFrame([(i, (v / 256).tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    got = topk.search(frame, counted=True).collect()
    assert max(r["evaluated"] for r in got) < 1500 and np.mean([r["evaluated"] for r in got]) < 600


def test_pivots_of_dependent_or_no_rows():
    same = np.array([[3.0, 4.0]] * 5)
    assert len(topk.choose_pivots(same, 4)) == 1 and len(topk.choose_pivots(same[:0], 4)) == 0 and len(topk.choose_pivots(same * 0, 4)) == 0


def test_bounds_stop_early():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(50, 4)) + 40, rng.normal(size=(5000, 4))]).round(3) * 256
    pivots = topk.choose_pivots(x, 8)
    d = np.stack([np.linalg.norm(x - p, axis=1) for p in pivots], 1)
    low = np.abs(d - d[0]).max(1)
    upper = ((x * x).sum(1) + (x[0] ** 2).sum() - low * low) / 2 + 1
    found, evaluated = topk.best(x[0].round(), 0, upper, np.arange(len(x)), x.round(), 5)
    assert evaluated < 500 and len(found) == 5


def test_scores_beyond_doubles_are_exact():
    a, b = np.array([2.0**40 + 1, 3.0]), np.array([[2.0**20 + 1, 5.0], [2.0**40, 0.0]])
    assert topk.exact_scores(a, b).tolist() == [(2**40 + 1) * (2**20 + 1) + 15, topk.LONG[1]]
