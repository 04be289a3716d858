"""Helpers to run streaming queries into tables of the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.session import SETTINGS, checkpoint_dir

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


@contextmanager
def checked_settings(spark: SparkSession, empty_batches: bool = False) -> Iterator[None]:
    """Settings a finite run needs; a query keeps those it was started with.
    State that expires asks for one more empty batch for ever, so a run over
    what is there only ends without them."""
    wanted = {_PROVIDER: SETTINGS[_PROVIDER], _EMPTY_BATCHES: str(empty_batches).lower()}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def job_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for the state and output of one run, inside the shared
    checkpoint folder of the cluster."""
    return f"{checkpoint_dir(spark)}/textguard-{name}-{uuid.uuid4().hex}"


def run_available(
    stream: DataFrame, name: str, folder: str | None = None, empty_batches: bool = False
) -> DataFrame:
    """Process everything that is there in append mode, exactly once, and read
    the result back as a table. ``empty_batches`` lets a last batch without rows
    bring out what the watermark has made final (not for state with timers)."""
    spark = stream.sparkSession
    folder = folder or job_folder(spark, name)
    with checked_settings(spark, empty_batches):
        query = (
            stream.writeStream.format("parquet")
            .option("path", f"{folder}/out")
            .option("checkpointLocation", f"{folder}/state")
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def run_updates(stream: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The same for an aggregation in update mode: every batch appends the
    groups it changed, the newest state of a group counts."""
    spark = stream.sparkSession
    folder = job_folder(spark, name)

    def write(batch: DataFrame, epoch: int) -> None:
        # one folder per epoch: a batch that is run again replaces its output
        batch.write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")

    with checked_settings(spark):
        query = (
            stream.writeStream.foreachBatch(write)
            .option("checkpointLocation", f"{folder}/state")
            .outputMode("update")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    rows = spark.read.parquet(f"{folder}/out")
    values = [c for c in rows.columns if c not in (*keys, "epoch")]
    newest = F.max_by(F.struct(*values), "epoch").alias("v")
    return rows.groupBy(*keys).agg(newest).select(*keys, "v.*")
