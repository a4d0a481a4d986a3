"""The driver's contract, with and without the optional subpackage."""

import importlib
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
SMALL = Path("/root/testdata/sf0.001")


def test_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    if importlib.util.find_spec("quillspan.llm"):
        assert sum(n.startswith("op") for n in e.queries()) >= 10


def test_without_the_subpackage(tmp_path):
    import shutil

    shutil.copytree(ROOT / "quillspan", tmp_path / "quillspan", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and not any(n.startswith('op1') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


@pytest.mark.skipif(not SMALL.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["normalize_tokens", "chunk_overlap", "bm25_topk", "sparse_scan_topk", "dense_topk", "greedy_dedup", "stage_hits", "token_f1", "critique_parse_a", "critique_parse_b"])
def test_oracles(spark, name):
    import __spark_entry__ as e

    db = duckdb.connect()
    for p in SMALL.glob("*.parquet"):
        db.sql(f"create view {p.stem} as select * from '{p}'")
    got, want = e.queries()[name](spark, str(SMALL)), db.sql(e.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    a = sorted(map(str, (tuple(r[c] for c in sorted(got.columns)) for r in got.collect())))
    b = sorted(map(str, db.sql(f"select {', '.join(sorted(want.columns))} from want").fetchall()))
    assert a == b


@pytest.mark.skipif(not SMALL.exists(), reason="no test tables")
def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
