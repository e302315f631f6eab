"""Every geometry query runs at the smallest scale and, where it has SQL, gives DuckDB's rows."""

import ast
import math
from collections import Counter
from pathlib import Path

import pytest

from orbis.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows_of(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    cell = lambda v: "null" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.6g}" if isinstance(v, float) else str(v)
    return Counter(tuple(cell(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    found = catalogue.queries()[name](spark, SF)
    rows, sql = found.collect(), catalogue.oracle_sql().get(name)
    if not sql:
        assert found.columns
        return
    wanted = duck.sql(sql)
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows_of(rows, found.columns) == rows_of(wanted.fetchall(), wanted.columns)


def test_no_name_is_bound_twice():
    """A second binding of a module-wide name silently replaces the function that others call."""
    seen = Counter()
    for node in ast.parse(Path(catalogue.__file__).read_text()).body:
        if isinstance(node, ast.FunctionDef):
            seen[node.name] += 1
        elif isinstance(node, ast.Assign):
            seen.update(x.id for t in node.targets for x in ast.walk(t) if isinstance(x, ast.Name))
    assert [k for k, n in seen.items() if n > 1] == []
