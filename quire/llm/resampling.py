"""Importance resampling of documents towards a target distribution.

*Weights.* A document's features (runs of one and two words) fall into hash
buckets.  Bucket counts of all documents and of all target texts are grouped
sums; their log ratio is an array of one whole number a bucket, small enough to
go to every task, so a text is scored by gathering from that array.

*Draw.* Noise from a hash of the id is added to the weight (Gumbel noise, so the
highest scores are a sample without replacement).  The k-th best key is found by
distributed quickselect: some random keys of the interval still open are pivots, one pass
counts the keys below, at and above each, and the interval that holds
the k-th key is kept, until a pivot is that key.  Only rows up to it are then range-sorted and
ranked; no pass moves a row that is not drawn.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import written

BUCKETS, MIN_WORDS, SHARE, OF, SEED = 10_000, 20, 25, 100, "7"
PIVOTS = 16  # random keys that one pass counts against
REMEMBERED = 300_000  # words a worker remembers before it starts anew
LONGEST = 64  # bytes of a following word that the shift tables cover; longer ones are hashed as a whole

# Bytes that separate words: all ASCII but letters and digits.
_SPACED = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words in UTF-8, A-Z as a-z; none of a null text."""
    return text.encode().lower().translate(_SPACED).split() if text else []


def _shift_tables() -> np.ndarray:
    """[n, k, v]: what a CRC-32 with byte ``v`` at place ``k`` becomes when n zero bytes follow."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> np.uint32(1)) ^ np.uint32(0xEDB88320), step >> np.uint32(1))
    rows = [np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)]
    for _ in range(LONGEST + 1):
        rows.append((rows[-1] >> np.uint32(8)) ^ step[rows[-1] & 255])
    return np.stack(rows)


class FeatureHasher:
    """Buckets of a text's features; the CRC of a pair of words is put together from those of its words."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets = np.uint32(buckets)
        self.shift = _shift_tables()
        self.index: dict[bytes, int] = {}
        self._room(REMEMBERED)

    def _room(self, size: int) -> None:
        self.index.clear()
        self.alone, self.after, self.length = np.zeros(size, np.uint32), np.zeros(size, np.uint32), np.zeros(size, np.int64)

    def _learn(self, words: list[bytes]) -> None:
        new = set(words).difference(self.index)
        if len(self.index) + len(new) > len(self.alone):
            new = set(words)
            self._room(max(REMEMBERED, len(new)))
        at = len(self.index)
        for i, w in enumerate(new, at):
            self.index[w] = i
            self.alone[i], self.after[i], self.length[i] = zlib.crc32(w), zlib.crc32(b" " + w), len(w)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        """The bucket of every word, then of every pair of neighbours."""
        if not words:
            return np.zeros(0, np.int64)
        self._learn(words)
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        one, n = self.alone[at], self.length[at[1:]] + 1
        first, s = one[:-1], np.minimum(n, LONGEST)
        two = self.after[at[1:]]
        for k in range(4):
            two = two ^ self.shift[s, k, (first >> np.uint32(8 * k)) & np.uint32(255)]
        for i in np.flatnonzero(n > LONGEST):
            two[i] = zlib.crc32(words[i] + b" " + words[i + 1])
        return (np.concatenate([one, two]) % self.buckets).astype(np.int64)


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket: one array a task, summed by bucket."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total = FeatureHasher(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                total += np.bincount(hasher(words_of(t)), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    rows = texts.select(F.col(text).alias("t")).mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"]] = rows["n"]  # one row a bucket
    return out


def bucket_gains(docs: DataFrame, target: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Log ratio of each bucket in thousandths, rounded down; one is added to every count."""
    s, t = (bucket_counts(x, text, buckets).astype(float) for x in (docs, target))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths from the id; of a null id as of an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def score_documents(docs: DataFrame, gains: np.ndarray, doc_id: str = "doc_id", text: str = "text", seed: str = SEED, out: str = "resampling") -> DataFrame:
    """``docs`` with a struct ``out`` (n_words, n_features, weight, score), which replaces a column of that name.

    The weight is the mean gain of all features, rounded down; 0 for texts that are null or hold no word.
    """

    @F.pandas_udf("n_words long, n_features long, weight long")
    def weighed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hasher = FeatureHasher(len(gains))
        for texts in batches:
            rows = []
            for t in texts:
                words = words_of(t)
                at = hasher(words)
                rows.append((len(words), len(at), int(gains[at].sum()) // len(at) if len(at) else 0))
            yield pd.DataFrame(rows, columns=["n_words", "n_features", "weight"])

    keep = [c for c in docs.columns if c != out]
    w = F.col("__weighed")
    return docs.select("*", weighed(F.col(text)).alias("__weighed")).select(
        *keep, F.struct(w.n_words.alias("n_words"), w.n_features.alias("n_features"), w.weight.alias("weight"), (w.weight + noise(F.col(doc_id), seed)).alias("score")).alias(out)
    )


def kth_key(rows: DataFrame, key: list[str], k: int, pivots: int = PIVOTS) -> tuple | None:
    """The k-th smallest key (1-based) of ``rows``; keys are different from row to row, and no part is null.

    Every pass reads the rows between the nearest keys known so far and brings ``pivots`` keys and
    at most 2 * ``pivots`` + 1 counts to the driver; it leaves about one in ``pivots`` of the interval.
    """
    at = F.struct(*key)
    literal = lambda p: F.struct(*[F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(key, p, strict=True)])
    low = high = None
    before, turn = 0, 0
    while True:
        part = rows
        if low is not None:
            part = part.where((F.col(key[0]) >= low[0]) & (at > literal(low)))
        if high is not None:
            part = part.where((F.col(key[0]) <= high[0]) & (at < literal(high)))
        chosen = sorted(tuple(r) for r in part.select(*key).orderBy(F.xxhash64(F.lit(turn), *key), *key).limit(pivots).collect())
        if not chosen:
            return None
        place = sum((F.when(at > literal(p), 2).when(at == literal(p), 1).otherwise(0) for p in chosen), F.lit(0))
        counts = {r["place"]: r["n"] for r in part.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n")).collect()}
        edges = [low, *chosen, high]
        for i in range(2 * len(chosen) + 1):
            n = counts.get(i, 0)
            if before + n >= k:
                if i % 2:
                    return chosen[i // 2]
                low, high = edges[i // 2], edges[i // 2 + 1]
                break
            before += n
        else:
            return None
        turn += 1


_KEY = ["__low", "__none", "__id", "__tie"]


def draw(scored: DataFrame, share: int = SHARE, of: int = OF, min_words: int = MIN_WORDS, doc_id: str = "doc_id", scores: str = "resampling") -> DataFrame:
    """``scored`` with a column ``rank``: 1, 2, 3, ... for the rows drawn by falling score, null for the others.

    Of the N rows of at least ``min_words`` words, floor(share * N / of) are drawn; ties go to the smaller id,
    null ids last, and rows that agree in both are told apart in the order in which they were read.
    """
    keep = [c for c in scored.columns if c != "rank"]
    keyed = written(
        scored.select(
            *keep, (-F.col(f"{scores}.score")).alias("__low"), F.col(doc_id).isNull().alias("__none"), F.coalesce(doc_id, F.lit(0)).cast("long").alias("__id"),
            F.monotonically_increasing_id().alias("__tie"), (F.col(f"{scores}.n_words") >= min_words).alias("__fit"),
        ), "scored"
    )
    fit = keyed.where("__fit")
    k = share * fit.count() // of
    last = kth_key(fit, _KEY, k) if k else None
    none = F.lit(None).cast("long").alias("rank")
    if last is None:
        return keyed.select(*keep, none)
    upto = F.col("__fit") & (F.struct(*_KEY) <= F.struct(*[F.lit(v).cast(keyed.schema[c].dataType).alias(c) for c, v in zip(_KEY, last, strict=True)]))
    # Range sort of the winners; a rank is the row's place in its part and the rows of the parts before.
    ordered = keyed.where(upto).select(*keep, *_KEY).repartitionByRange(*_KEY).sortWithinPartitions(*_KEY)
    ordered = written(ordered.select(*keep, F.monotonically_increasing_id().alias("__row")), "drawn")
    part = F.shiftright("__row", 33)
    sizes = ordered.groupBy(part.alias("__part")).agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__n"))
    sizes = sizes.select("__part", "__first", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__base"))  # one row a part
    ranked = ordered.join(F.broadcast(sizes), part == F.col("__part")).select(*keep, (F.col("__row") - F.col("__first") + F.col("__base") + 1).alias("rank"))
    return ranked.unionByName(keyed.where(~upto).select(*keep, none))


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, of: int = OF, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text",
             buckets: int = BUCKETS, seed: str = SEED, out: str = "resampling") -> DataFrame:
    """``docs`` with ``out`` (n_words, n_features, weight, score) and ``rank``, drawn to resemble the texts of ``target``.

    Every row is returned; ``rank`` is null where it was not drawn.  Texts are whole, null ones hold no words and are never
    drawn while ``min_words`` is above 0.  Rows repeated are rows of their own with the same score.  An empty target or
    an empty table of documents gives equal gains or no rows.  Further columns stay; ``out`` and ``rank`` replace columns
    of those names, and no column may begin with two underscores.
    """
    gains = bucket_gains(docs, target, text, buckets)
    return draw(score_documents(docs, gains, doc_id, text, seed, out), share, of, min_words, doc_id, out)
