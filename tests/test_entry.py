"""The driver's contract for the dialect's queries: rows as plain SQL has them, and no need of the optional part."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tessera import queries as core

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([round(r[i], 9) if isinstance(r[i], float) else str(r[i]) if columns[i] in ("ts", "l_shipdate") else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", core.oracles())
def test_query(spark, plain, name):
    df = core.run(spark, SF, name)
    found = plain.execute(core.oracles()[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in found.description], found.fetchall())


@pytest.mark.parametrize("others", [[], ["corpus_pipeline.py"]])
def test_without_the_optional_part(tmp_path, others):
    shutil.copytree(ROOT / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *(x for x in others if (ROOT / x).exists())]:
        shutil.copy(ROOT / name, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'revenue' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=100)


def test_nothing_else_imports_the_optional_part():
    for path in (ROOT / "tessera").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
