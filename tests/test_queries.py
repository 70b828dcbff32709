import glob
import math
import os

import duckdb
import pytest

import __spark_entry__  # registers all queries
from tracelake.plans.queries import ORACLE_SQL, QUERIES


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(name, spark, sf_dir):
    got = QUERIES[name](spark, sf_dir)
    names = sorted(got.columns)
    rows = sorted(repr([plain(r[c]) for c in names]) for r in got.collect())
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    cur = con.execute(ORACLE_SQL[name])
    have = [d[0] for d in cur.description]
    assert sorted(have) == names
    assert rows == sorted(repr([plain(r[have.index(c)]) for c in names]) for r in cur.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
