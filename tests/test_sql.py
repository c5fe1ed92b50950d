"""Every query that has SQL, against it; the contract of the entry module."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from searchloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    cols = sorted(df.columns)
    num = lambda x: None if x is None or x != x else f"{float(x):.9g}" if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x)
    return cols, sorted(tuple(str(num(x)) for x in r) for r in df[cols].astype(object).itertuples(index=False))


@pytest.fixture(scope="session")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_query(spark, sf_dir, con, name):
    assert rows(registry.QUERIES[name](spark, sf_dir).toPandas()) == rows(con.execute(registry.ORACLES[name]).df())


def test_flagship(spark, sf_dir):
    got = registry.flagship(spark, sf_dir).collect()
    assert len(got) == 15 and [r.score for r in got] == sorted((r.score for r in got), reverse=True)


def test_without_optional_parts(tmp_path):
    """The entry module imports where the training-data part is gone."""
    root = Path(registry.__file__).resolve().parents[2]
    (tmp_path / "searchloom").mkdir()
    for p in (root / "searchloom").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "searchloom" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").write_text((root / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
