"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a private one only in local mode, where it is unset in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="quire-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def work_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/quire-{tag}-{uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, and safe when executors are lost."""
    path = work_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """Null as empty, A-Z as a-z, everything else as it is."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node of its component.

    Labels fall to the smallest label of the neighbours and then to the label's
    own label; each pass is written to the shared folder.  Self loops are allowed.
    """
    both = written(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), tag
    )
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("component")), tag)
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        )
        low = labels.join(near, "node", "left").select(
            "node", F.col("component").alias("before"), F.least("component", F.coalesce("near", "component")).alias("low")
        )
        # component labels are nodes themselves, so one look-up follows the label of the label
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("root"))
        step = written(
            low.join(jump, "low", "left").select("node", "before", F.least("low", F.coalesce("root", "low")).alias("component")), tag
        )
        labels = step.select("node", "component")
        if step.where("component <> before").isEmpty():
            return labels


def text_batches(batches: Iterator, column: str) -> Iterator[tuple[object, list[str]]]:
    """Each pandas batch with the named text column as a list of strings, null as empty."""
    for batch in batches:
        yield batch, ["" if t is None else t for t in batch[column].tolist()]
