"""Formulas over generated rows against the SQL that they equal."""

import math

import duckdb
import pytest

from tracelake import queries  # noqa: F401
from tracelake.plans.registry import FORMULA_SQL, FORMULAS, ORACLE_SQL, QUERIES


def test_formulas_are_no_queries():
    assert FORMULAS and not set(FORMULAS) & (set(QUERIES) | set(ORACLE_SQL))


@pytest.mark.parametrize("name", sorted(FORMULAS))
def test_formula_equals_its_sql(spark, small, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW nation AS SELECT * FROM '{small}/nation.parquet'")
    df = FORMULAS[name](spark, small)
    want = con.sql(FORMULA_SQL[name])
    order = [want.columns.index(c) for c in df.columns]
    got, want = sorted(map(tuple, df.collect()), key=str), sorted(([r[i] for i in order] for r in want.fetchall()), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-6) if isinstance(x, float) else x == y for x, y in zip(a, b))
