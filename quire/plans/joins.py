"""Lookups against dimension-like tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def rule_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A table made of constants; its size is fixed by the code, so it may be broadcast."""
    return F.broadcast(spark.createDataFrame(list(rows), schema))


def lookup_join(
    fact: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    how: str = "left",
    spread: Column | None = None,
    salts: int = 0,
) -> DataFrame:
    """Join ``fact`` to ``dim`` (unique on ``on``), keeping the fact side whole.

    Adaptive execution broadcasts ``dim`` when its measured bytes allow it and
    divides a hot key's partition otherwise.  Without adaptive execution give
    ``salts``: the fact side is then salted with a hash of ``spread`` (a
    per-row id) and each ``dim`` row repeated once per salt.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"lookup_join keeps the fact side whole; got how={how!r}")
    if not salts:
        return fact.join(dim, list(on), how)
    by = spread if spread is not None else F.struct(*fact.columns)
    left = fact.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    right = dim.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "__salt"], how).drop("__salt")
