"""Epochs go to Python a few at a time, and numbers as words, not as objects."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.operators import codec


def batches(spark, epochs):
    """Rows of each batch that a pandas UDF gets."""

    @F.pandas_udf("int")
    def rows(x):
        return x * 0 + len(x)

    return {r[0] for r in spark.range(0, epochs, 1, 1).select(rows(F.col("id"))).collect()}


def test_few_epochs_at_a_time(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, "10000")
    try:
        codec.encoded(F.col("rows"))
        assert max(batches(spark, 1000)) <= codec.BATCH_EPOCHS
        spark.conf.set(name, "10")  # smaller ones stay
        codec.decoded(F.col("data"), F.col("length"), 1)
        assert spark.conf.get(name) == "10"
    finally:
        spark.conf.set(name, old)


def test_unsigned_numbers_are_words_in_python(spark):
    values = [0, 1, (1 << 63) - 1, 1 << 63, (1 << 64) - 1, 12345]
    df = spark.createDataFrame([(0, k, v) for k, v in enumerate(map(str, values))], "sensor int, sample long, v string").select("sensor", "sample", F.col("v").cast("decimal(20,0)").alias("value"))
    coded = codec.encode_epochs(df, 4, layout="extended", kind="uint64")
    got = codec.decode_epochs(coded, 1, 4, "extended", "uint64")
    assert got.schema["value"].dataType.simpleString() == "decimal(20,0)"
    assert [int(r["value"]) for r in got.orderBy("sample").collect()] == values
    assert codec._matrix([np.array([-1, 2])], "u8").tolist() == [[(1 << 64) - 1, 2]]


@pytest.mark.parametrize("bad", ["-1", str(1 << 64), None])
def test_numbers_beyond_64_bits_are_errors(bad, spark):
    df = spark.createDataFrame([(0, 0, bad)], "sensor int, sample long, v string").select("sensor", "sample", F.col("v").cast("decimal(38,0)").alias("value"))
    with pytest.raises(Exception, match="values beyond"):
        codec.encode_epochs(df, 4, layout="extended", kind="uint64").collect()
