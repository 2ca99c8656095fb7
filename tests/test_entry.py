import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
NAMES = ["scale_axis_swap", "file_metadata", "class_hex", "octree_prefix_range", "cell_reduce", "lod_low", "chunk_progress", "cluster_mean", "measure_area", "part_order", "reduced_file_records", "pyramid_levels", "pick_rays", "nearest_many", "kmeans_kdtree", "kmeans_candidates", "lod_kept", "cell_means_intended", "stage_counts", "time_totals", "viewer_sevens", "viewer_seven_means"]


def test_queries_and_sql_without_the_corpus_operators(tmp_path):
    for name in ("__spark_entry__.py", "voxelspan"):
        (tmp_path / name).symlink_to(REPO / name) if name.endswith(".py") else None
    package = tmp_path / "voxelspan"
    package.mkdir()
    for p in (REPO / "voxelspan").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (package / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and len(q) > 45 and not any(k.startswith('op') for k in q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True, timeout=120)


@pytest.mark.parametrize("missing", ["ahocorasick", "tokenizers", "public_tokenizers"])
def test_a_missing_dependency_costs_only_the_corpus_operators(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 45 and (not any(k.startswith('op') for k in q) or {missing!r} == 'tokenizers')"
    subprocess.run([sys.executable, "-B", "-W", "ignore", "-c", code], cwd=REPO, check=True, timeout=120)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    folder = Path("/root/testdata/sf0.001")
    if not folder.is_dir():
        pytest.skip("no test tables")
    from voxelspan.plans import registry, spatial  # noqa: F401

    con = duckdb.connect()
    for t in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM read_parquet('{t}')")
    df = registry.QUERIES[name](spark, str(folder))
    names = sorted(df.columns)
    found = con.execute(f"SELECT {', '.join(names)} FROM ({registry.ORACLES[name]})").fetchall()
    assert sorted(map(repr, found)) == sorted(repr(tuple(r)) for r in df.select(*names).collect())
