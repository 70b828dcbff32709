"""Recording as a stream: samples come in micro-batches, whole epochs are coded and kept.

Each batch is first staged under its own number, so a batch that is run again replaces itself; then
the epochs that are now whole are coded, and a line of the commit log tells how far the recording
goes.  A batch reads the batches that may still hold samples of open epochs, and none before them,
so its work doesn't grow with the recording; their staged samples are removed.
``finish`` codes the short last epoch and assembles the container; after a crash the same folder
goes on where the checkpoint says.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracelake import api
from tracelake.errors import DataError
from tracelake.operators.codec import encoded
from tracelake.operators.signal import epoch_matrices, with_epochs

EPOCHS = "epoch bigint, length bigint, data binary, batch bigint"
STAGED = "sensor int, sample bigint, value int, offset bigint, batch bigint, epoch bigint"


@dataclass(frozen=True)
class Commit:
    """``first``: epochs coded without a gap from the first on; ``since``: the oldest batch with
    samples of later ones."""

    batch: int = -1
    first: int = 0
    since: int = 0


class EpochStream:
    """``folder`` is shared by driver and executors; it holds staged samples, coded epochs and the
    commit log.  Only the last batch can run again, as streams do after a crash."""

    def __init__(self, spark: SparkSession, folder: str, sensors: int, epoch_length: int):
        self.spark, self.folder, self.sensors, self.epoch_length = spark, folder.rstrip("/"), sensors, epoch_length

    def start(self, samples: DataFrame, **trigger) -> StreamingQuery:
        """Ingest a streaming DataFrame (sensor, sample, value); ``trigger`` as for writeStream."""
        return samples.writeStream.foreachBatch(self.append).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()

    # Files

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _numbers(self, name: str, start: str) -> list[int]:
        """Numbers of the entries of a folder whose names are ``start`` and a number."""
        fs, path = self._path(name)
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n[len(start) :]) for n in names if n.startswith(start) and n[len(start) :].isdigit())

    def _read(self, name: str, schema: str, batches: list[int] | None = None) -> DataFrame:
        """A folder, or only some batches of it."""
        fs, path = self._path(name)
        paths = [f"{self.folder}/{name}"] if batches is None else [f"{self.folder}/{name}/batch={k}" for k in batches]
        if not paths or not fs.exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{name}").parquet(*paths)

    def _remove(self, name: str) -> None:
        fs, path = self._path(name)
        fs.delete(path, True)

    def _last_commit(self, before: int | None = None) -> Commit:
        numbers = [k for k in self._numbers("log", "") if before is None or k < before]
        if not numbers:
            return Commit()
        fs, path = self._path(f"log/{numbers[-1]}")
        stream = fs.open(path)
        try:
            return Commit(**json.loads(stream.readUTF()))
        finally:
            stream.close()

    def _commit(self, now: Commit) -> None:
        fs, unfinished = self._path(f"log/_{now.batch}")
        out = fs.create(unfinished, True)
        out.writeUTF(json.dumps(asdict(now)))
        out.close()
        self._remove(f"log/{now.batch}")
        if not fs.rename(unfinished, self._path(f"log/{now.batch}")[1]):
            raise OSError(f"batch {now.batch} can't be committed")

    # State

    def epochs(self) -> DataFrame:
        """Coded epochs so far, each once."""
        return self._read("epochs", EPOCHS).drop("batch")

    def staged(self) -> DataFrame:
        """Staged samples that are kept: all of open epochs, and some of coded ones."""
        return self._read("staged", STAGED)

    def _upto(self, first: int, coded: DataFrame) -> int:
        """Where the gapless run of coded epochs that begins at ``first`` ends."""
        after = coded.select((F.col("epoch") + 1).alias("epoch")).unionByName(self.spark.createDataFrame([(first,)], "epoch bigint"))
        return after.join(coded.select("epoch"), "epoch", "left_anti").agg(F.min("epoch")).first()[0]

    def _coded_since(self, told: Commit, batches: list[int]) -> DataFrame:
        return self._read("epochs", EPOCHS, batches).where(F.col("epoch") >= told.first).select("epoch")

    def committed(self) -> int:
        """Epochs that are coded without a gap from the first on."""
        told = self._last_commit()
        return self._upto(told.first, self._coded_since(told, [k for k in self._numbers("epochs", "batch=") if k >= told.since]))

    def _coded(self, samples: DataFrame) -> DataFrame:
        whole = samples.dropDuplicates(["sensor", "sample"]).drop("epoch", "offset", "batch")
        return epoch_matrices(whole, self.epoch_length).withColumn("data", encoded(F.col("rows"))).drop("rows")

    def append(self, batch: DataFrame, number: int) -> None:
        """Stage a batch and code the epochs it completes."""
        if self._last_commit().batch > number:
            raise DataError(f"batch {number} is not the last one")
        told = self._last_commit(before=number)
        typed = batch.select(F.col("sensor").cast("int"), F.col("sample").cast("long"), F.col("value").cast("int"))
        with_epochs(typed, self.epoch_length).write.mode("overwrite").partitionBy("epoch").parquet(f"{self.folder}/staged/batch={number}")
        staged = self._numbers("staged", "batch=")
        open_batches = [k for k in staged if told.since <= k <= number]
        earlier = [k for k in open_batches if k < number]
        samples = self._read("staged", STAGED, open_batches).where(F.col("epoch") >= told.first)
        waiting = samples.join(self._coded_since(told, earlier), "epoch", "left_anti")
        full = waiting.groupBy("epoch").agg(F.count_distinct("sensor", "sample").alias("n")).where(F.col("n") == self.sensors * self.epoch_length).select("epoch")
        self._coded(waiting.join(full, "epoch", "left_semi")).write.mode("overwrite").parquet(f"{self.folder}/epochs/batch={number}")
        first = self._upto(told.first, self._coded_since(told, open_batches))
        since = samples.where(F.col("epoch") >= first).agg(F.min("batch")).first()[0]
        self._commit(Commit(number, first, number + 1 if since is None else since))
        # What this batch didn't need isn't needed if it runs again
        for k in staged:
            if k < told.since:
                self._remove(f"staged/batch={k}")
        for k in self._numbers("log", ""):
            if k < told.batch:
                self._remove(f"log/{k}")

    def finish(self, path: str, series: api.TimeSeries, **more) -> None:
        """Code what is left as the short last epoch and write the recording."""
        done, first = self.epochs(), self.committed()
        rest = self.staged().where(F.col("epoch") >= first).join(done.select("epoch"), "epoch", "left_anti")
        left = [r["epoch"] for r in rest.select("epoch").distinct().limit(2).collect()]
        if len(left) > 1 or left and left[0] != first:
            raise DataError("samples are missing before the last epoch")
        api.write_epochs(done.unionByName(self._coded(rest)) if left else done, path, series, **more)
