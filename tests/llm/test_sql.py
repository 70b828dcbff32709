import glob
import os

import duckdb
import pytest

import __spark_entry__


@pytest.mark.parametrize("name", ["op2_decontamination", "op8_chat", "op9_licences", "op10_jaccard"])
def test_same_as_sql(name, spark, sf_dir):
    got = __spark_entry__.queries()[name](spark, sf_dir)
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    cur = con.execute(__spark_entry__.oracle_sql()[name])
    have = [d[0] for d in cur.description]
    assert sorted(have) == sorted(got.columns)
    assert sorted(repr([r[c] for c in have]) for r in got.collect()) == sorted(repr(list(r)) for r in cur.fetchall())
