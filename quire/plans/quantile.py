"""Exact medians per key without collecting a key's values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.plans.scan import ordered_scan, running_sum


def grouped_median(
    df: DataFrame, keys: Sequence[str], value: str, out: str = "median",
    block: Column | None = None,
) -> DataFrame:
    """Exact median of the non-null ``value`` per key.

    Equal values are counted first (map-side combine), then the counts are
    scanned in value order by blocks; no group is held in memory.
    """
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("__v"))
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    block = block if block is not None else F.floor(F.col("__v"))
    upto = ordered_scan(counts, keys, ["__v"], [block], [running_sum("__cum", "__n")])
    total = counts.groupBy(*keys).agg(F.sum("__n").alias("__t"))
    lo = F.floor((F.col("__t") + 1) / 2)
    hi = F.floor((F.col("__t") + 2) / 2)
    start = F.col("__cum") - F.col("__n")
    return (
        upto.join(total, list(keys))
        .groupBy(*keys)
        .agg(
            (
                (
                    F.max(F.when((start < lo) & (lo <= F.col("__cum")), F.col("__v")))
                    + F.max(F.when((start < hi) & (hi <= F.col("__cum")), F.col("__v")))
                )
                / 2
            ).alias(out)
        )
    )
