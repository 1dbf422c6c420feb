"""Every registered query against its SQL over the smallest tables, and over empty ones."""

import math
from pathlib import Path

import duckdb
import pytest

from codestrata.plans import catalog, catalog_sql, problems

DATA = Path("/root/testdata/sf0.001")
QUERIES = catalog.queries() | problems.queries()
SQL = catalog_sql.oracle_sql()


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    return f"{value:.6f}" if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in DATA.iterdir():
        c.sql(f"CREATE VIEW {f.name.split('.')[0]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.skipif(not DATA.exists(), reason="test tables are not there")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    got = QUERIES[name](spark, str(DATA))
    want = con.sql(SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    b = sorted(tuple(map(plain, r)) for r in want.select(*[f'"{c}"' for c in columns]).fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_over_empty_tables(spark, empty_folder, name):
    got = QUERIES[name](spark, empty_folder).collect()
    assert not [r for r in got if name not in ("graph_stats",)]


def test_extra_columns_with_clashing_names(spark, make, tmp_path):
    from tests.conftest import SCHEMAS

    rows = {"files": [{"file_id": 1, "path": "p/a.py", "name": "a.py", "project": "p", "functions": "x", "at": 1}],
            "functions": [{"snapshot_no": 1, "func_id": 1, "name": "commit", "file_id": 1, "qualified_name": "commit", "start_line": 1, "end_line": 2, "path": "z", "project": "z"}],
            "call_edges": [{"edge_id": 1, "caller_func_id": 1, "callee_name": "commit", "caller_line": 1, "path": "z", "line": 3}]}
    extra = {"files": "functions string, at int", "functions": "path string, project string", "call_edges": "path string, line int"}
    for name in SCHEMAS:
        make(name, rows.get(name, []), extra.get(name, "")).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("callers_of", "search_files", "structure_by_file", "change_impact", "callgraph_nodes", "sync_plan", "graph_stats"):
        QUERIES[name](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in QUERIES["callers_of"](spark, str(tmp_path)).collect()] == [("commit", "p/a.py", 1)]
