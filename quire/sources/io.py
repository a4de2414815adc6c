"""Readers and writers for text lists, logs, JSON artefacts, tables and reports."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as t
from quire.operators.evals import upsert
from quire.plans import cut, last_seen, ordered_scan, rank_in, running_sum
from quire.sources import schemas

LOG_LINE = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}) \[([A-Z]+)\] ([^:]+): (.*)$"


def _numbered(lines: DataFrame) -> DataFrame:
    """Text lines with the path of their file and the line number there.

    A large file is read in several parts, which are ordered by where they start; inside a
    part lines keep the order in which it was read.
    """
    d = lines.select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__k"))
    d = cut(d)
    return ordered_scan(d, ["file"], ["__b", "__k"], ["__b", F.floor((F.col("__k") % (1 << 33)) / 65536)], [rank_in("line_no")]).drop("__k", "__b")


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """(url, line_no): non-blank lines that are no comments, order and repeats kept."""
    d = _numbered(spark.read.text(path)).withColumn("url", t.strip(F.col("value")))
    return d.filter((F.col("url") != "") & ~F.col("url").startswith("#")).select("url", "line_no")


def _days(start: str, end: str) -> tuple[str, str]:
    if dt.date.fromisoformat(start) > dt.date.fromisoformat(end):
        raise ValueError(f"from {start} is after to {end}")
    return start, end


def read_log_lines(spark: SparkSession, folder: str, start: str, end: str, today: str | None = None) -> DataFrame:
    """Every log line of the days in range with the record it belongs to.

    A day's lines are in ``app.log.<day>``, in ``app.log.<day>.<n>`` or in any files below ``day=<day>``; the current
    day's in ``app.log``.  Files are chosen by path before they are opened; a line that does not have
    the record layout continues the record before it in its file.
    """
    lo, hi = _days(start, end)
    today = today or dt.date.today().isoformat()

    def day(path):
        return F.when(path.rlike("/app\\.log$"), F.lit(today)).otherwise(F.regexp_extract(path, r"(?:/app\.log\.|/day=)(\d{4}-\d{2}-\d{2})(?:\.\d+$|/|$)", 1))

    d = _numbered(spark.read.text(folder).filter(day(F.col("_metadata.file_path")).between(lo, hi)))
    get = lambda i: F.regexp_extract("value", LOG_LINE, i)
    d = d.withColumn("is_record", F.col("value").rlike(LOG_LINE)).withColumn(
        "__h", F.when(F.col("is_record"), F.struct(get(1).alias("ts"), get(2).alias("level"), get(3).alias("logger"), get(4).alias("message"))))
    d = ordered_scan(d, ["file"], ["line_no"], [F.floor(F.col("line_no") / 65536)], [
        running_sum("record", F.col("is_record").cast("long")), last_seen("head", "__h")])
    return d.select(
        F.to_timestamp("head.ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), "head.level", "head.logger", "head.message",
        F.to_date(day(F.col("file"))).alias("file_date"), "file", "record", "line_no", "is_record", "value",
    )


def read_logs(spark: SparkSession, folder: str, start: str, end: str, today: str | None = None) -> DataFrame:
    """One row per record with the number of lines it spans."""
    lines = read_log_lines(spark, folder, start, end, today).filter("record > 0")
    return lines.groupBy("file", "file_date", "record", "ts", "level", "logger", "message").agg(F.count(F.lit(1)).alias("n_lines"))


def read_run_files(spark: SparkSession, folder: str, start: str, end: str, schema: str | None = None) -> DataFrame:
    """JSON files named ``...YYYYMMDD-HHMMSS.json`` of the days in range, with name and time."""
    lo, hi = _days(start, end)
    r = spark.read.option("multiLine", True)
    d = (r.schema(schema) if schema else r).json(folder)
    name = F.col("_metadata.file_name")
    stamp = F.regexp_extract(name, r"(\d{8}-\d{6})\.json$", 1)
    at = F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit("yyyyMMdd-HHmmss"))
    return d.select("*", name.alias("file_name"), at.alias("run_at")).filter(F.to_date("run_at").between(lo, hi))


def read_artefacts(spark: SparkSession, folders: Mapping[str, str], schema: str) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) of several folders of JSON files, tagged with their kind."""
    bad = "_corrupt"
    out = None
    for kind, folder in folders.items():
        d = (
            spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad)
            .schema(f"{schema}, {bad} string").json(folder)
            .select("*", F.lit(kind).alias("source_kind"), F.col("_metadata.file_name").alias("file_name"))
        )
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    out = cut(out)
    return out.filter(F.col(bad).isNull()).drop(bad), out.filter(F.col(bad).isNotNull()).select("source_kind", "file_name", bad)


def read_tables(spark: SparkSession, base: str, names: Sequence[str] = tuple(schemas.TABLES)) -> dict[str, DataFrame]:
    """The relational tables under ``base`` with their declared schemas."""
    return {n: spark.read.schema(schemas.TABLES[n]).parquet(f"{base}/{n}") for n in names}


def read_scores_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SCORES_CSV).option("header", True).csv(path)


def write_scores_csv(df: DataFrame, path: str) -> bool:
    """Scores in the fixed column order; nothing is written when there are no rows."""
    if df.isEmpty():
        return False
    df.select(*schemas.SCORE_COLUMNS).write.mode("overwrite").option("header", True).csv(path)
    return True


def write_report_json(df: DataFrame, path: str, version: str = schemas.REPORT_VERSION) -> None:
    """One versioned JSON document per row."""
    df.select(F.lit(version).alias("version"), "*").write.mode("overwrite").json(path)


def upsert_folder(spark: SparkSession, base: str, source: DataFrame, keys: Sequence[str], order: Sequence[str], version: int) -> DataFrame:
    """Merge ``source`` into the newest version before ``version`` and write it as that version.

    Old versions stay, so a repeated batch reads the same input and writes the
    same result.
    """
    prior = latest_version(spark, base, version - 1)
    merged = source if prior is None else upsert(prior, source, keys, order)
    merged.write.mode("overwrite").parquet(f"{base}/v={version:010d}")
    return spark.read.parquet(f"{base}/v={version:010d}")


def latest_version(spark: SparkSession, base: str, upto: int) -> DataFrame | None:
    """Newest table version at or below ``upto``."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    found = [int(s.getPath().getName()[2:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("v=")]
    done = [v for v in found if v <= upto and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{base}/v={v:010d}/_SUCCESS"))]
    return spark.read.parquet(f"{base}/v={max(done):010d}") if done else None


def earlier_batches(spark: SparkSession, base: str, before: int | None = None) -> DataFrame | None:
    """Rows of the whole batches under ``base`` (``batch=<n>`` folders), those before batch ``before`` only."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    done = [n for n in sorted(names) if n.startswith("batch=") and (before is None or int(n[6:]) < before) and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{base}/{n}/_SUCCESS"))]
    return spark.read.parquet(*[f"{base}/{n}" for n in done]) if done else None
