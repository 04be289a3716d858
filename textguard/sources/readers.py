"""Readers. ``spark.read`` or ``spark.readStream`` is passed in as ``reader``,
so each of them works for tables and for streams."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard import rules, schemas
from textguard.functions.policy import split_list


def request_bodies(reader, path: str) -> DataFrame:
    """One raw JSON body per line: (body, payload). ``payload`` is null for a
    line that is not JSON; see :func:`textguard.operators.policy.quarantine`."""
    lines = reader.text(path).withColumnRenamed("value", "body")
    return lines.withColumn("payload", F.try_parse_json("body"))


def simple_prompts(reader, path: str, default_model: str = rules.DEFAULT_MODEL) -> DataFrame:
    """One ``{"prompt", "model"?}`` per line: (body, prompt, model). A line
    without a prompt has a null one."""
    parsed = reader.text(path).select(
        F.col("value").alias("body"), F.from_json("value", schemas.SIMPLE_PROMPT).alias("p")
    )
    model = F.coalesce("p.model", F.lit(default_model)).alias("model")
    return parsed.select("body", F.col("p.prompt").alias("prompt"), model)


def text_corpus(reader, folder: str) -> DataFrame:
    """Every ``*.txt`` directly in ``folder``, a whole file per row: (path, text)."""
    files = reader.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def lossy_text(chunk: Column) -> Column:
    """Bytes as text, invalid sequences replaced."""
    return F.make_valid_utf8(chunk.cast("string"))


def stream_chunks(reader, path: str) -> DataFrame:
    """Chunk log in Parquet, bytes decoded: (stream_id, seq, ts, chunk, transport_error)."""
    raw = reader.schema(schemas.CHUNKS).parquet(path)
    broken = F.coalesce("transport_error", F.lit(False))
    return raw.withColumn("chunk", lossy_text(F.col("chunk"))).withColumn("transport_error", broken)


def store(spark: SparkSession, path: str) -> DataFrame:
    """The document store, empty if there is none yet."""
    try:
        return spark.read.schema(schemas.STORE).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.STORE)


def setting_list(spark: SparkSession, text: str, column: str) -> DataFrame:
    """A comma-separated setting as a one-column table."""
    return spark.range(1).select(F.explode(split_list(F.lit(text))).alias(column))
