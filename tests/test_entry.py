from __future__ import annotations

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from flatspan import queries

ROOT = Path(__file__).resolve().parent.parent


def plain(rows):
    text = lambda v: "~" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(text, r)) for r in rows)


@pytest.fixture(scope="module")
def db(sf):
    db = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        db.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return db


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, sf, db, name):
    got = queries.QUERIES[name](spark, sf)
    want = db.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in got.columns)} FROM ({queries.SQL[name]})").fetchall()
    assert plain(tuple(r) for r in got.collect()) == plain(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_the_corpus_operators(tmp_path):
    for p in [*ROOT.glob("*.py"), *(ROOT / "flatspan").rglob("*.py")]:
        if "llm" not in p.parts and p.name != "corpus_pipeline.py":
            to = tmp_path / p.relative_to(ROOT)
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(p.read_text())
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert said.stdout.split()[-1:] == ["False"], said.stderr
