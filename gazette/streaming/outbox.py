"""Micro-batches of observations and of the outbox, and snapshots of tables that change together.

The service's stream is scheduled re-observation and a durable outbox: no event-time windows. Each micro-batch reads the
last committed snapshot, applies the same functions as a batch job does and commits the next. A batch that is replayed
after a failure finds its number committed and does nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decisions, writes
from ..operators.outcomes import delivered


class Snapshots:
    """Tables that change together, below one folder of a shared file system.

    A commit writes every table to a new folder and then one row, with the folder, to the log. The tables are those of the
    log's last row, so that a commit is there as a whole or not at all. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def log(self) -> DataFrame | None:
        path = f"{self.folder}/log"
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        there = fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs_path)
        return self.spark.read.schema("batch bigint, version bigint, folder string").parquet(path) if there else None

    def last(self):
        log = self.log()
        return log.orderBy(F.desc("version")).first() if log is not None else None

    def committed(self, batch: int) -> bool:
        log = self.log()
        return log is not None and not log.filter(F.col("batch") == batch).isEmpty()

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.last()['folder']}/{name}")

    def commit(self, batch: int, tables: dict[str, DataFrame]) -> None:
        last = self.last()
        folder = f"{self.folder}/{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{folder}/{name}")
        row = [(batch, last["version"] + 1 if last else 0, folder)]
        self.spark.createDataFrame(row, "batch bigint, version bigint, folder string").coalesce(1).write.mode("append").parquet(f"{self.folder}/log")


def observe(snapshots: Snapshots, as_of: str):
    """For foreachBatch over observations (api_id, observed_hash, status): decide, and write the states of what was processed.

    Of several observations of one source in a batch the last by hash counts.
    """

    def run(batch: DataFrame, number: int) -> None:
        if snapshots.committed(number):
            return
        states = snapshots.table("states")
        seen = writes.latest(batch, ["api_id"], F.desc("observed_hash"), F.desc("status"))
        rows = states.drop("observed_hash").join(seen.select("api_id", "observed_hash", F.col("status").alias("result")), "api_id")
        todo = rows.withColumn("decision", decisions.observation(as_of)).filter("decision = 'process'")
        results = todo.select("api_id", F.col("result").alias("status"), "observed_hash")
        snapshots.commit(number, {"states": writes.processing_results(states, results, as_of)})

    return run


def deliver(snapshots: Snapshots, as_of: str):
    """For foreachBatch over delivery outcomes (delivery_id, sent, error): counts attempts and closes events."""

    def run(batch: DataFrame, number: int) -> None:
        if snapshots.committed(number):
            return
        outcomes = writes.latest(batch, ["delivery_id"], F.desc("sent"), F.col("error"))
        deliveries, outbox = delivered(snapshots.table("deliveries"), snapshots.table("outbox"), outcomes, as_of)
        snapshots.commit(number, {"deliveries": deliveries, "outbox": outbox})

    return run
