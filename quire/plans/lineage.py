"""Cutting lineage with reliable checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark) -> str:
    """The shared folder the cluster names; a private one only in local mode, where it may be unset."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(named)
        return named
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="run-quire-")
    sc.setCheckpointDir(made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from there.

    Used where several branches read one shuffled intermediate, or where a loop
    would grow the plan.  The data survives the loss of executors.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_laid(df: DataFrame) -> DataFrame:
    """As :func:`cut`, and what reads it knows by which columns its rows lie together, so that grouping by these moves nothing.

    For frames whose shuffles have a given number of partitions: the plan is made without adaptive execution, which
    would hide how the rows lie.
    """
    conf = df.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        # Under names of their own, as columns that carry the name of a view are not known again where the frame is read twice.
        kept = cut(df.select(*[F.col(f"`{c}`").alias(f"__kept_{c}") for c in df.columns]))
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)
    return kept.select(*[F.col(f"`__kept_{c}`").alias(c) for c in df.columns])
