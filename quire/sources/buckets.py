"""Tables in hash buckets with versions: an upsert rewrites the buckets it touches and no others.

Under the folder of a table lie ``data/<write>/bucket=<b>/`` with the rows and ``manifest/v=<n>`` with one
small JSON file a version, which names the runs (folder, rows) of every bucket.  A version is a manifest: it
appears by one rename after its data is whole, and readers of an older version keep their files until
:func:`vacuum`.  A repeated write of version n starts again from the newest version before n, so
replays give the same table.

Nulls in the key are values like any other.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.plans import cut

BUCKETS = 64
BUCKET = "bucket"  # reserved; a table has no column of its own with this name


class _Files:
    """The few file operations that manifests need, on whatever file system holds the table."""

    def __init__(self, spark: SparkSession, base: str):
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.jvm = spark.sparkContext._jvm
        self.fs = self.path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        p = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def read(self, file: str) -> str:
        stream = self.fs.open(self.path(file))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, file: str, text: str) -> None:
        draft = self.path(f"{file}.{uuid4().hex}.draft")
        out = self.fs.create(draft, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self.delete(file)
        if not self.fs.rename(draft, self.path(file)):
            raise OSError(f"{file} could not be published")

    def delete(self, path: str) -> bool:
        return self.fs.delete(self.path(path), True)


def versions(spark: SparkSession, base: str) -> list[int]:
    """The versions that can be read, oldest first."""
    return [int(n[2:]) for n in _Files(spark, base).names(f"{base}/manifest") if n.startswith("v=") and n[2:].isdigit()]


def manifest(spark: SparkSession, base: str, upto: int | None = None) -> dict | None:
    """The newest manifest at or below ``upto``: version, schema, number of buckets, and the runs of every bucket that holds rows."""
    found = [v for v in versions(spark, base) if upto is None or v <= upto]
    return json.loads(_Files(spark, base).read(f"{base}/manifest/v={max(found):010d}")) if found else None


def bucket_of(keys: Sequence[str | Column], n: int) -> Column:
    """The bucket of a key; a null part counts as a value, since its hash is taken with the parts' nullness."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.pmod(F.xxhash64(*cols, *[c.isNull() for c in cols]), F.lit(n)).cast("int")


def _read(spark: SparkSession, base: str, held: dict, some: Sequence[int] | None = None) -> DataFrame:
    schema = StructType.fromJson(held["schema"])
    folders = [f"{base}/{f}" for b, runs in held["runs"].items() if some is None or int(b) in some for f, _ in runs]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_table(spark: SparkSession, base: str, upto: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame | None:
    """The newest version at or below ``upto``, or the named buckets of it; None where there is no version."""
    held = manifest(spark, base, upto)
    return None if held is None else _read(spark, base, held, None if buckets is None else set(buckets))


def _touched(rows: DataFrame) -> list[int]:
    """At most as many numbers as there are buckets."""
    return sorted(r[0] for r in rows.select(BUCKET).distinct().collect())


def read_near(spark: SparkSession, base: str, rows: DataFrame, keys: Sequence[str], upto: int | None = None) -> DataFrame | None:
    """The buckets of the newest version at or below ``upto`` that ``rows`` have keys of; None where there is no version."""
    held = manifest(spark, base, upto)
    return None if held is None else _read(spark, base, held, set(_touched(rows.select(bucket_of(keys, held["buckets"]).alias(BUCKET)))))


def _publish(spark: SparkSession, base: str, rows: DataFrame, held: dict | None, version: int, n: int, kept: dict[int, list] | None = None) -> dict:
    """Write ``rows`` (with their bucket) as one more run of their buckets, beside the runs that ``kept`` names, and publish ``version``."""
    write = f"data/v={version:010d}-{uuid4().hex}"
    rows.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{base}/{write}")
    files = _Files(spark, base)
    # Row counts come from the files' footers; at most one row a bucket.
    written = [name for name in files.names(f"{base}/{write}") if name.startswith("bucket=")]
    counts = {r[0]: r[1] for r in spark.read.parquet(f"{base}/{write}").groupBy(BUCKET).count().collect()} if written else {}
    fresh = {str(b): [*(kept or {}).get(b, []), [f"{write}/bucket={b}", c]] for b, c in counts.items()}
    schema = rows.drop(BUCKET).schema.jsonValue()
    new = {"version": version, "buckets": n, "schema": schema, "runs": (held["runs"] if held else {}) | fresh, "rewritten": sorted(counts)}
    files.publish(f"{base}/manifest/v={version:010d}", json.dumps(new))
    return new


def upsert_table(spark: SparkSession, base: str, source: DataFrame, keys: Sequence[str], order: Sequence[str], version: int,
                 buckets: int = BUCKETS) -> dict:
    """Merge ``source`` into the newest version before ``version`` and publish the result as that version; its manifest is returned.

    Per key the last source row by ``order`` replaces the table's row or adds to the table; ``source`` may repeat keys.
    Columns of ``order`` that the table lacks serve the choice only.  Only buckets that ``source`` has keys of are
    read and written.  The number of buckets is fixed by the first version.  An empty source publishes the table as it was.
    """
    held = manifest(spark, base, version - 1)
    n = held["buckets"] if held else buckets
    columns = [f["name"] for f in held["schema"]["fields"]] if held else source.columns
    types = StructType.fromJson(held["schema"]) if held else source.schema
    rest = [c for c in columns if c not in keys]
    last = source.groupBy(*keys).agg(F.max_by(F.struct(F.lit(0).alias("all"), *rest), F.struct(*order)).alias("r"))
    found = {c: (F.col(c) if c in keys else F.col(f"r.{c}")) for c in columns}
    same = {c for c in columns if source.schema[c].dataType.simpleString() == types[c].dataType.simpleString()}
    last = last.select(*[(v if c in same else v.cast(types[c].dataType)).alias(c) for c, v in found.items()])
    last = cut(last)  # read for its buckets and for the merge
    mark = lambda d, new: d.select(*keys, F.struct(F.lit(new).alias("new"), *rest).alias("r"))
    both = mark(last, 1)
    touched = _touched(last.select(bucket_of(keys, n).alias(BUCKET)))
    if held and touched:
        both = mark(_read(spark, base, held, set(touched)), 0).unionByName(both)
    merged = both.groupBy(*keys).agg(F.max_by("r", "r.new").alias("r")).select(*[c if c in keys else F.col(f"r.{c}").alias(c) for c in columns])
    return _publish(spark, base, merged.withColumn(BUCKET, bucket_of(keys, n)), held, version, n)


def vacuum(spark: SparkSession, base: str, keep: int = 2) -> list[str]:
    """Drop all versions but the newest ``keep`` and every data folder that none of them names; the dropped folders are returned."""
    if keep < 1:
        raise ValueError("at least one version must be kept")
    files, found = _Files(spark, base), versions(spark, base)
    kept = [json.loads(files.read(f"{base}/manifest/v={v:010d}")) for v in found[-keep:]]
    for v in found[:-keep]:
        files.delete(f"{base}/manifest/v={v:010d}")
    named = {f for m in kept for runs in m["runs"].values() for f, _ in runs}
    dropped = []
    for write in files.names(f"{base}/data"):
        parts = [f"data/{write}/{p}" for p in files.names(f"{base}/data/{write}") if p.startswith("bucket=")]
        gone = [p for p in parts if p not in named]
        if len(gone) == len(parts):
            gone = [f"data/{write}"]
        for p in gone:
            files.delete(f"{base}/{p}")
        dropped += gone
    return dropped


# ---- keys seen before -------------------------------------------------------------------------------------------

FILTER_BITS = 1 << 20  # of one filter; a bucket gets further filters as it fills
BITS_A_KEY, HASHES = 12, 6  # about one false hit in 300 while a filter fills


def _places(h: np.ndarray, bits: int) -> np.ndarray:
    """The ``HASHES`` bits of every key hash, by double hashing."""
    u = h.view(np.uint64)
    step = (u >> np.uint64(32)) | np.uint64(1)
    return ((u[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) % np.uint64(bits)).astype(np.int64)


def _maybe(filters: list[bytes], h: np.ndarray) -> np.ndarray:
    """Which hashes a bucket's filters may hold; never false for one that was added."""
    found = np.zeros(len(h), bool)
    for raw in filters:
        bits = np.frombuffer(raw, np.uint8)
        p = _places(h, 8 * len(bits))
        found |= ((bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1).all(1)
    return found


def _added(filters: list[bytes], n: int, h: np.ndarray, bits: int) -> tuple[list[bytes], int]:
    """The filters and their number of keys with more hashes in them."""
    room, out = bits // BITS_A_KEY, list(filters)
    while len(h):
        if n >= room * len(out):
            out.append(bytes(bits // 8))
        take, h = h[: room * len(out) - n], h[room * len(out) - n :]
        p = _places(take, bits).ravel()
        last = np.frombuffer(out[-1], np.uint8).copy()
        np.bitwise_or.at(last, p >> 3, (1 << (p & 7)).astype(np.uint8))
        out[-1], n = last.tobytes(), n + len(take)
    return out, n


class SeenKeys:
    """An index of keys that only grows: Bloom filters by bucket, and beside them the keys in runs.

    A look-up takes the filters of the buckets it asks for.  Only keys that may be there are then
    compared with the keys themselves, and only in the buckets that have such a key: a batch of new keys
    reads filters and hardly any key, however long the stream has run.  A batch adds one run to a bucket and takes runs up
    into it that are not larger than twice the new one, so a bucket has few runs and a key is rewritten a logarithmic number of times.
    """

    def __init__(self, spark: SparkSession, base: str, key: str, buckets: int = BUCKETS, bits: int = FILTER_BITS):
        self.spark, self.key, self.n, self.bits = spark, key, buckets, bits
        self.filters, self.keys = f"{base}/filters", f"{base}/keys"
        self.last_hits = self.last_buckets = 0  # of the latest look-up

    def _hashed(self, rows: DataFrame) -> DataFrame:
        return rows.select(self.key).withColumns({"h": F.xxhash64(self.key), BUCKET: bucket_of([self.key], self.n)})

    def unseen(self, rows: DataFrame, batch: int) -> DataFrame:
        """The rows whose key no batch before ``batch`` added; ``rows`` has one row for each key."""
        held = manifest(self.spark, self.filters, batch - 1)
        self.last_hits = self.last_buckets = 0
        if held is None:
            return rows
        probes = self._hashed(rows)
        known = _read(self.spark, self.filters, held, set(_touched(probes)))

        def hit(probe: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
            filters = list(of["filters"].iloc[0]) if len(of) else []
            return probe[_maybe(filters, probe["h"].to_numpy(np.int64))] if len(probe) else pd.DataFrame({BUCKET: [], "h": []})

        # One cell of a bucket's probes and its filters; keys are distinct, so no bucket is much fuller than another.
        hits = cut(probes.select(BUCKET, "h").groupBy(BUCKET).cogroup(known.groupBy("b")).applyInPandas(hit, f"{BUCKET} int, h long"))
        counts = {r[0]: r[1] for r in hits.groupBy(BUCKET).count().collect()}
        self.last_hits, self.last_buckets = sum(counts.values()), len(counts)
        if not counts:
            return rows
        keys = _read(self.spark, self.keys, manifest(self.spark, self.keys, batch - 1), set(counts)).select(F.col(self.key).alias("seen"))
        seen = keys.join(hits.select("h").distinct(), F.xxhash64("seen") == F.col("h"), "left_semi")
        return rows.join(seen, F.col(self.key).eqNullSafe(F.col("seen")), "left_anti")

    def add(self, rows: DataFrame, batch: int) -> None:
        """Add the keys of ``rows``, which were unseen, as those of ``batch``; a repeated batch replaces what it wrote."""
        keys = cut(self._hashed(rows))
        counts = {r[0]: r[1] for r in keys.groupBy(BUCKET).count().collect()}
        held = manifest(self.spark, self.keys, batch - 1)
        kept, taken = {}, []
        for b, size in counts.items():
            runs = list(held["runs"].get(str(b), [])) if held else []
            while runs and runs[-1][1] <= 2 * size:
                folder, more = runs.pop()
                taken.append(f"{self.keys}/{folder}")
                size += more
            kept[b] = runs
        run = keys.select(self.key, BUCKET)
        if taken:
            old = self.spark.read.schema(keys.select(self.key).schema).parquet(*taken)
            run = run.unionByName(old.withColumn(BUCKET, bucket_of([self.key], self.n)))
        _publish(self.spark, self.keys, run, held, batch, self.n, kept)

        schema, bits = "b int, filters array<binary>, n long", self.bits
        held = manifest(self.spark, self.filters, batch - 1)
        old = _read(self.spark, self.filters, held, set(counts)) if held else self.spark.createDataFrame([], schema)

        def grown(probe: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
            filters, n = (list(of["filters"].iloc[0]), int(of["n"].iloc[0])) if len(of) else ([], 0)
            b = probe[BUCKET].iloc[0] if len(probe) else of["b"].iloc[0]
            filters, n = _added(filters, n, probe["h"].to_numpy(np.int64), bits)
            return pd.DataFrame({"b": [int(b)], "filters": [filters], "n": [n]})

        new = keys.select(BUCKET, "h").groupBy(BUCKET).cogroup(old.groupBy("b")).applyInPandas(grown, schema)
        _publish(self.spark, self.filters, new.withColumn(BUCKET, F.col("b")), held, batch, self.n)
