"""Every registered query of alarm triage against its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

from boundwright.jobs import batches, catalogue, declared, exported, expressions, guarded, investigated, paths, probed  # noqa: F401


def plain(row):
    out = []
    for x in row:
        if hasattr(x, "item"):
            x = x.item()
        if isinstance(x, float):
            x = None if math.isnan(x) else round(x, 6)
        out.append("NULL" if x is None else str(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x))
    return tuple(out)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, sf_dir, name):
    got = catalogue.QUERIES[name](spark, sf_dir)
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    sql = catalogue.ORACLE_SQL[name]
    if name in ("callgraph_components", "callgraph_shortest_path"):
        assert sql.startswith("WITH RECURSIVE ")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = want.fetchall()
    assert sorted(plain(r) for r in got.select(*names).collect()) == sorted(map(plain, rows))
    assert rows or name == "recall_floor"
