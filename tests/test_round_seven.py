"""Findings of round 4, fourth pass."""

import re

import duckdb

from knotwork.operators import product as P
from knotwork.plans import queries as catalogue

D = "/root/testdata/sf0.01"


def test_max_min_product_shuffles_no_place(spark, monkeypatch):
    """Many blocks give the rows of the SQL, and no place is shuffled on its way."""
    monkeypatch.setattr(P, "SHARE", 1 << 14, raising=False)
    df = catalogue.queries()["spgemm_maxmin"](spark, D)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "max(least(" in plan and not re.search(r"hashpartitioning\([^)]*\bi#", plan)
    assert re.search(r"shufflepartitionid|PassThrough", plan, re.I)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{D}/lineitem.parquet'")
    assert sorted(map(tuple, df.collect())) == sorted(c.execute(catalogue.oracle_sql()["spgemm_maxmin"]).fetchall())
