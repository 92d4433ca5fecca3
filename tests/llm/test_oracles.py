from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from flatspan.llm import registry


def plain(rows):
    return sorted((tuple("~" if v is None or (isinstance(v, float) and math.isnan(v)) else str(round(v, 9)) if isinstance(v, float) else str(v) for v in r) for r in rows))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, sf, name):
    db = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        db.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = registry.queries()[name](spark, sf)
    want = db.sql(f"SELECT {', '.join(got.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert plain(tuple(r) for r in got.collect()) == plain(want)


def test_registry():
    found = registry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in found) for k in range(1, 11)] == [1] * 10
