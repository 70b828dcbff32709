import time
from pathlib import Path

from pyspark.sql import functions as F

from tracelake.llm import secrets
from tracelake.llm.common import cut, release


def shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {str(p) for d in dirs for p in Path(d.getPath()).rglob("shuffle_*.data")}


def test_cut_leaves_no_shuffle_files(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = shuffle_files(spark), spark.conf.get(name)
    df = spark.range(20_000).groupBy((F.col("id") % 1000).alias("k")).count()
    done = cut(df)
    for _ in range(100):  # they go in the background
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(name) == was
    assert done.count() == 1000 and df.count() == 1000  # either can be read again


def test_release_removes_the_files(spark):
    gone, kept = cut(spark.range(100)), cut(spark.range(50))
    path = lambda df: Path(df._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:"))
    assert path(gone).is_dir()
    release(gone)
    assert not path(gone).exists() and path(kept).is_dir() and kept.count() == 50


def test_fit_holds_each_name_once(spark, monkeypatch):
    got = []
    monkeypatch.setattr(secrets.Crf, "fit", staticmethod(lambda chains: got.extend((list(rows), tags) for rows, tags in chains)))
    secrets.fit_crf(spark.createDataFrame([(k, f"some words and token = abcdef{k}23, more") for k in range(20)], "doc_id long, text string"))
    names = [f for rows, _ in got for r in rows for f in r]
    assert len(got) > 20 and len({id(f) for f in names}) == len(set(names)) < len(names)
