"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16


def join_hot_left(
    rows: DataFrame,
    ends: DataFrame,
    keys: Sequence[str],
    spread: Column,
    salts: int = SALTS,
    how: str = "left",
) -> DataFrame:
    """Join ``rows`` to ``ends`` (at most one row per key); left or left_semi.

    Rows of a key are spread over ``salts`` partitions by ``spread`` and the
    other side is repeated once per salt. Without a hint AQE still broadcasts
    that side when its measured size is below the broadcast threshold.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    repeated = ends.withColumn("_salt", copies)
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")
