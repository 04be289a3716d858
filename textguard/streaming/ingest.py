"""Text files that arrive in a folder, into the document store as they come.

Ids go on from batch to batch without a count of the store: each micro-batch
has its own range, which starts where the one before ended and is written down
with the batch. A batch that is run again after a failure finds its range and
replaces its own output, so nothing is stored twice or under two ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard import rules, schemas
from textguard.operators.retrieval import assign_ids, embed_corpus
from textguard.streaming.jobs import checked_settings

#: One row for each batch: its first id and the first one after it.
RANGES = "epoch bigint, first_id bigint, next_id bigint"


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """The store as it is now: (doc_id, text, embedding, epoch)."""
    return spark.read.schema(schemas.STORE + ", epoch bigint").parquet(f"{folder}/store")


def _range(spark: SparkSession, folder: str, epoch: int, rows: int, first_id: int) -> int:
    """The first id of a batch, from the range that it or the one before it wrote down."""
    path = f"{folder}/ranges"
    known = {}
    if epoch > 0:
        # one short row a batch; only this one's and the last are read
        last = spark.read.schema(RANGES).parquet(path).where(F.col("epoch").isin(epoch, epoch - 1))
        known = {r["epoch"]: r for r in last.collect()}
    start = known[epoch - 1]["next_id"] if epoch - 1 in known else first_id
    mine = spark.createDataFrame([(epoch, start, start + rows)], RANGES).drop("epoch")
    mine.coalesce(1).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
    return start


def ingest_stream(files: DataFrame, folder: str, dim: int = rules.VECTOR_DIM, first_id: int = 0) -> DataFrame:
    """Everything of a stream of files(path, text) that is there into ``folder``, and
    the store after it. Files without a text are stored without a vector. The
    source has to bound a micro-batch (``maxFilesPerTrigger``); inside one, files
    are numbered by path in the order of its hash, as in one go."""
    spark = files.sparkSession

    def write(batch: DataFrame, epoch: int) -> None:
        # a file source lists each file once; its rows are read twice, not kept in memory
        start = _range(spark, folder, epoch, batch.count(), first_id)
        rows = assign_ids(batch.select("path", "text")).withColumn("doc_id", F.col("doc_id") + F.lit(start))
        embed_corpus(rows, dim).write.mode("overwrite").parquet(f"{folder}/store/epoch={epoch}")

    with checked_settings(spark):
        query = (
            files.writeStream.foreachBatch(write)
            .option("checkpointLocation", f"{folder}/state")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    return stored(spark, folder)
