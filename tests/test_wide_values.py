"""The signal of the queries outgrows 32 bits from 46,341 samples a sensor on."""

import glob

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.functions import codec
from tracelake.operators import codec as codecs
from tracelake.plans import stand_in
from tracelake.plans.queries import ORACLE_SQL, QUERIES

#: The first sample, and epochs enough that 2^32 is the first value of one (sample 65536).
START, LENGTH = 46_080, 20_480


@pytest.fixture
def wide(spark, tmp_path, monkeypatch):
    """A dense signal of late samples only; its SQL counterpart is the same table."""
    rows = spark.range(START, START + LENGTH).select(F.col("id").alias("sample"), F.explode(F.array(*[F.lit(k) for k in range(5)])).alias("sensor"))
    rows = rows.withColumn("value", (F.col("sample") * 31 + F.col("sensor") * 7) % 997 - 400).select("sensor", "sample", "value")
    rows.write.parquet(f"{tmp_path}/late.parquet")
    late = spark.read.parquet(f"{tmp_path}/late.parquet")
    monkeypatch.setattr(stand_in, "dense", lambda *_: late)
    monkeypatch.setattr(stand_in, "every", lambda *_: late)
    monkeypatch.setattr(stand_in.smooth, "__defaults__", (stand_in.dense,))
    return str(tmp_path)


def expected(name, folder):
    con = duckdb.connect()
    files = glob.glob(f"{folder}/late.parquet/*.parquet")
    sql = ORACLE_SQL[name].replace(stand_in.DENSE_SQL, f"sparse as (select * from read_parquet({files})), dense as (select * from sparse)")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def same_as_sql(name, spark, folder):
    names, want = expected(name, folder)
    assert sorted(tuple(r) for r in QUERIES[name](spark, folder).select(*names).collect()) == sorted(want)


@pytest.mark.parametrize("name", ["restore_time", "restore_time2", "restore_chan", "restore_mixed"])
def test_restored_beyond_32_bits(name, spark, wide):
    same_as_sql(name, spark, wide)


@pytest.mark.parametrize("name", ["cost_per_n", "best_n", "best_method"])
def test_sizes_beyond_32_bits(name, spark, wide):
    same_as_sql(name, spark, wide)


def test_coded_beyond_32_bits(spark, wide):
    same_as_sql("codec_bytes", spark, wide)
    folded = F.col("value").bitwiseAND(F.lit((1 << 32) - 1))
    words = F.when(folded >= 1 << 31, folded - (1 << 32)).otherwise(folded).cast("int")
    x = stand_in.smooth(spark, wide).select("sensor", "sample", "epoch", words.alias("value"))
    got = QUERIES["codec_roundtrip"](spark, wide)
    assert got.exceptAll(x).count() == 0 and x.exceptAll(got).count() == 0


def test_folding_is_asked_for(spark):
    x = np.array([[(1 << 32) + 5, (1 << 32) + 7, 3]])
    df = spark.createDataFrame([(0, k, int(v)) for k, v in enumerate(x[0])], "sensor int, sample long, value long")
    with pytest.raises(Exception, match="values beyond"):
        codecs.encode_epochs(df, 4).collect()
    raw = bytes(codecs.encode_epochs(df, 4, fold=True).first()["data"])
    assert codec.decode_matrix(raw, 1, 3).tolist() == [[5, 7, 3]]
