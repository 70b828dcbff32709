from pyspark.sql import functions as F

from tracelake.operators import signal
from tracelake.plans.queries import QUERIES


def test_every_order_is_a_range(spark, sf_dir):
    got = QUERIES["epoch_offsets_to_ranges"](spark, sf_dir).orderBy("epoch").collect()
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").orderBy("o_orderkey").collect()
    at = 10
    for r, o in zip(got, orders, strict=True):
        size = int(o["o_totalprice"] // 1) + 1
        assert (r["epoch"], r["fpos"], r["size"], r["valid"]) == (o["o_orderkey"], at, size, True)
        at += size


def test_buckets_are_one_sum(spark):
    rows = [(k * 3 - 5, (k * 7) % 11 + 1) for k in range(40)]
    df = spark.createDataFrame(rows, "epoch long, size long")
    total = sum(n for _, n in rows)
    for bucket in (1, 4, 1000):
        offsets = signal.running_offsets(df, "size", bucket).select("epoch", "offset")
        got = signal.offsets_to_ranges(offsets, total, bucket=bucket).orderBy("epoch").collect()
        assert [(r["epoch"], r["size"], r["valid"]) for r in got] == [(k, n, True) for k, n in rows]
        assert [r["fpos"] for r in got] == [sum(n for _, n in rows[:k]) for k in range(40)]


def test_units_give_both_results(spark, sf_dir):
    got = QUERIES["electrode_validate"](spark, sf_dir).groupBy("valid").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r["valid"] for r in got} == {True, False}


def test_single_sensors_keep_all_samples(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    for name in ("row_order_restore", "scale_write", "scale_read", "sign_extend", "rechunk", "delta_time", "delta_time2", "restore_time", "restore_time2"):
        assert QUERIES[name](spark, sf_dir).count() == events, name
