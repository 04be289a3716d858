"""Latency profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PERCENTILES = (0.50, 0.90, 0.95, 0.99)
SLA_US = 1000
BIN = 4096
#: Size of a quantile sketch: ranks are off by less than one in a hundred.
SKETCH_K = 800


def latency_percentiles(
    samples: DataFrame,
    dims: Sequence[str],
    value: str = "latency_us",
    percentiles: Sequence[float] = PERCENTILES,
) -> DataFrame:
    """Exact ``sorted[floor(n * p)]`` (0-based) of integer samples per group,
    with min, max and count. Null samples are not counted.

    Groups are never sorted as such. Equal values are counted first (map-side
    combined), values are then binned by ``BIN``: running counts over the bins
    find the bin that holds each rank, and only those bins are searched.
    """
    dims = list(dims)
    samples = samples.where(F.col(value).isNotNull())
    per_value = samples.groupBy(*dims, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    per_value = per_value.withColumn("_bin", F.expr(f"_v div {BIN}"))
    bins = per_value.groupBy(*dims, "_bin").agg(
        F.sum("_n").alias("_bn"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    over_bins = Window.partitionBy(*dims).orderBy("_bin")
    whole = Window.partitionBy(*dims)
    bins = (
        bins.withColumn("_upto", F.sum("_bn").over(over_bins))
        .withColumn("_total", F.sum("_bn").over(whole))
        .withColumn("_min", F.min("_lo").over(whole))
        .withColumn("_max", F.max("_hi").over(whole))
    )
    wanted = F.array(
        *[
            F.struct(F.lit(p).alias("p"), F.floor(F.col("_total") * F.lit(p)).alias("rank"))
            for p in percentiles
        ]
    )
    inside = (F.col("w.rank") >= F.col("_upto") - F.col("_bn")) & (F.col("w.rank") < F.col("_upto"))
    targets = (
        bins.select("*", F.explode(wanted).alias("w"))
        .where(inside)
        .select(
            *dims,
            "_bin",
            "_total",
            "_min",
            "_max",
            F.col("w.p").alias("_p"),
            (F.col("w.rank") - (F.col("_upto") - F.col("_bn"))).alias("_rank"),
        )
    )
    in_bin = Window.partitionBy(*dims, "_bin").orderBy("_v")
    ranked = per_value.withColumn("_vupto", F.sum("_n").over(in_bin))
    hit = (
        ranked.join(targets, [*dims, "_bin"])
        .where((F.col("_rank") < F.col("_vupto")) & (F.col("_rank") >= F.col("_vupto") - F.col("_n")))
    )
    values = [
        F.max(F.when(F.col("_p") == p, F.col("_v"))).alias(f"p{round(p * 100):d}_us") for p in percentiles
    ]
    return hit.groupBy(*dims).agg(
        F.max("_total").alias("total"),
        *values,
        F.max("_min").alias("min_us"),
        F.max("_max").alias("max_us"),
    )


def latency_sketches(
    samples: DataFrame, dims: Sequence[str], value: str = "latency_us", k: int = SKETCH_K
) -> DataFrame:
    """(dims, total, sketch): a mergeable quantile sketch of the integer samples of
    each group. Null samples are not counted; a group of up to ``k`` values is kept whole."""
    known = samples.where(F.col(value).isNotNull())
    return known.groupBy(*dims).agg(
        F.count("*").alias("total"), F.kll_sketch_agg_bigint(F.col(value).cast("bigint"), k).alias("sketch")
    )


def merged_sketches(sketches: DataFrame, dims: Sequence[str], k: int = SKETCH_K) -> DataFrame:
    """Sketches of parts, as those of hours, put together for ``dims``, as days:
    no sample is read again."""
    return sketches.groupBy(*dims).agg(
        F.sum("total").alias("total"), F.kll_merge_agg_bigint("sketch", k).alias("sketch")
    )


def sketched_percentiles(sketches: DataFrame, percentiles: Sequence[float] = PERCENTILES) -> DataFrame:
    """Percentiles from sketches in place of the samples, off by about 1.5 / k of all ranks."""
    values = [
        F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(p))).alias(f"p{round(p * 100):d}_us") for p in percentiles
    ]
    return sketches.select(*[c for c in sketches.columns if c != "sketch"], *values)


def with_throughput(profile: DataFrame, durations: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Add throughput (samples per second of ``duration_s``) and the SLA flag."""
    return (
        profile.join(durations, list(dims))
        .withColumn("throughput_rps", F.col("total") / F.col("duration_s"))
        .withColumn("meets_sla", F.col("p99_us") < SLA_US)
    )
