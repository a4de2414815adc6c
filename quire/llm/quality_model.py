"""A quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document.  How often
each combination of votes occurs in the whole corpus (a grouped count of at most
three to the power of their number) is all that expectation-maximisation needs
to estimate every labeller's accuracy and the posterior of each combination.
The posteriors then train a logistic scorer over hashed word shapes, which
scores every document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.quality_rules import BLANKS, CLASSES, SYMBOLS, histograms

BITS = 16
CACHE = 300_000
BAD, GOOD, NONE = 0, 1, 2
STOPS = tuple(x.encode() for x in ".!?…\"»”")
MARKS = tuple(bytes([b]) for b in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def _vote(x: float, good: bool, bad: bool) -> int:
    return BAD if bad else GOOD if good else NONE


def votes(text: str) -> tuple[int, ...]:
    """The labellers' votes on a text."""
    raw = text.encode()
    words = raw.split()
    counts = Counter(words)
    n = len(words)
    if not n:
        return (BAD,) * LABELLERS
    chars, common = histograms(raw, counts)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n_symbols, word_chars = sum(map(text.count, SYMBOLS)), len(text) - sum(map(text.count, BLANKS))
    symbols, repeat, dup = n_symbols / word_chars, sum(map(eq, words, islice(words, 1, None))) / n, 1 - len(set(lines)) / len(lines)
    mean, distinct, known = word_chars / n, len(counts) / n, 1 - common[-1]
    ended = sum(x.rstrip().endswith(STOPS) for x in lines) / len(lines)
    letters = chars[:3].sum() / max(chars[:CLASSES].sum() - chars[4], 1e-9)
    lone = sum(map(counts.__getitem__, MARKS)) / n
    return (
        _vote(symbols, symbols < 0.01, symbols > 0.05),
        _vote(repeat, repeat < 0.05, repeat > 0.2),
        _vote(dup, dup < 0.2, dup > 0.5),
        _vote(known, known > 0.12, known < 0.03) if n >= 40 else NONE,
        _vote(mean, 3 <= mean <= 9, mean < 2 or mean > 14),
        _vote(ended, ended > 0.6, ended < 0.1) if len(lines) >= 2 else NONE,
        _vote(letters, letters > 0.88, letters < 0.75),
        _vote(distinct, distinct > 0.35, distinct < 0.15) if n >= 50 else NONE,
        _vote(lone, lone < 0.03, lone > 0.15),
    )


LABELLERS = 9


def pattern(vs: tuple[int, ...]) -> int:
    """A combination of votes as one number."""
    return sum(v * 3**k for k, v in enumerate(vs))


def unpack(code: np.ndarray) -> np.ndarray:
    return np.stack([code // 3**k % 3 for k in range(LABELLERS)], axis=1)


@dataclass
class LabelModel:
    """Share of good documents, P(vote | class, a vote was given) of each labeller, and the posterior of being good by combination."""

    prior: float
    table: np.ndarray  # labeller, class, vote
    posterior: dict[int, float]


#: What is believed of a labeller beforehand, as P(vote | class), and its weight beside the data.
BELIEF, BELIEF_WEIGHT = np.array([[0.6, 0.4], [0.03, 0.97]]), 0.2


def fit_labels(counts: dict[int, int], rounds: int = 100) -> LabelModel:
    """Expectation-maximisation over the counted combinations; a labeller that gave no vote says nothing.

    Labellers are believed to be better than chance beforehand, so the classes cannot swap.
    """
    codes = np.array(sorted(counts), np.int64)
    n = np.array([counts[c] for c in codes.tolist()], float)
    vs = unpack(codes)
    hot = np.stack([vs == BAD, vs == GOOD], axis=2).astype(float)  # combination, labeller, vote
    bad = (vs == BAD).sum(1)
    q = np.select([bad == 0, bad == 1], [0.95, 0.3], 0.02)
    belief = BELIEF_WEIGHT * n.sum() * BELIEF
    for _ in range(rounds):
        prior = float(np.clip((n * q).sum() / max(n.sum(), 1), 0.01, 0.99))
        table = np.stack([(hot * (n * r)[:, None, None]).sum(0) + belief[c] for c, r in ((0, 1 - q), (1, q))], axis=1)
        table /= table.sum(2, keepdims=True)
        like = [np.log(x) + (hot * np.log(table[:, c, :])).sum((1, 2)) for c, x in ((0, 1 - prior), (1, prior))]
        new = 1 / (1 + np.exp(np.clip(like[0] - like[1], -50, 50)))
        done, q = np.abs(new - q).max(initial=0) < 1e-6, new
        if done:
            break
    return LabelModel(prior, table, dict(zip(codes.tolist(), q.tolist(), strict=True)))


LETTERS, ALL_CAPITALS = crc32(b"a") & ((1 << BITS) - 1), crc32(b"A") & ((1 << BITS) - 1)


def shape(word: str) -> int:
    """Hashed shape of a word: runs of letters and digits become one sign each."""
    if word.isalpha():
        return ALL_CAPITALS if word.isupper() and len(word) > 1 else LETTERS
    s = re.sub(r"[^\W\d_]+", lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "a", word)
    return crc32(re.sub(r"\d+", "0", s).encode()) & ((1 << BITS) - 1)


class Shapes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = shape(word)
        return value


AGAIN = 1  # the feature of a word that repeats the word before it


def hashed(text: str, shapes: Shapes) -> tuple[np.ndarray, int, int]:
    """Features of a text, one entry for each occurrence: shapes and pairs of shapes; words repeating the word before; words."""
    words = text.split()
    one = np.fromiter(map(shapes.__getitem__, words), np.int64, len(words))
    pair = (one[:-1] * 40503 + one[1:] + 7) & ((1 << BITS) - 1)
    return np.concatenate([one, pair]), sum(map(eq, words, islice(words, 1, None))), len(words)


@dataclass
class QualityModel:
    labels: LabelModel
    weights: np.ndarray
    bias: float


def fit_scorer(rows: list[tuple[float, np.ndarray, np.ndarray]], steps: int = 150, rate: float = 0.2, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic weights from (posterior, indexes, shares of the words) by Adam."""
    w, b = np.zeros(1 << BITS), 0.0
    rows = [r for r in rows if len(r[1])]
    if not rows:
        return w.astype(np.float32), 0.0
    y = np.array([r[0] for r in rows])
    ids, val = np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows])
    doc = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(doc, weights=w[ids] * val, minlength=len(rows)) + b
        e = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / len(y)
        g, gb = np.bincount(ids, weights=e[doc] * val, minlength=len(w)) + decay * w, e.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return w.astype(np.float32), float(b)


def train_quality(docs: DataFrame, text: str = "text", max_rows: int = 8000) -> QualityModel:
    """Label model from the votes on all documents, scorer from about ``max_rows`` of them, chosen by a hash of the text.

    Null counts as empty.  An empty table gives a model that scores everything 0.5.
    """
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t"))

    @F.pandas_udf("int")
    def voted(ts: pd.Series) -> pd.Series:
        return pd.Series([pattern(votes(t)) for t in ts], dtype="int32")

    counted = texts.select(voted("t").alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3 ** LABELLERS rows
    counts = {r["p"]: r["n"] for r in counted}
    total = sum(counts.values())
    if not total:
        return QualityModel(LabelModel(0.5, np.full((LABELLERS, 2, 3), 1 / 3), {}), np.zeros(1 << BITS, np.float32), 0.0)
    labels = fit_labels(counts)
    posterior = labels.posterior

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shapes = Shapes()
        for batch in batches:
            got = []
            for t in batch["t"]:
                at, again, n = hashed(t, shapes)
                if n:
                    ids, uses = np.unique(at, return_counts=True)
                    got.append((posterior.get(pattern(votes(t)), labels.prior), [*ids.tolist(), AGAIN], [*(uses / n).tolist(), again / n]))
            yield pd.DataFrame(got, columns=["y", "ids", "vals"])

    part = min(1.0, max_rows / total)
    sample = texts.where(F.pmod(F.xxhash64("t"), F.lit(1_000_000)) < int(part * 1_000_000) + 1).distinct()
    got = sample.mapInPandas(rows, "y double, ids array<int>, vals array<double>").toPandas()
    w, b = fit_scorer(list(zip(got["y"], got["ids"].map(np.asarray), got["vals"].map(np.asarray), strict=True)))
    return QualityModel(labels, w, b)


QUALITY = "score double, kept boolean"
KEEP_FROM = 0.5


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text", out: str = "quality_model", keep_from: float = KEEP_FROM) -> DataFrame:
    """``docs`` with a struct ``out``: the scorer's score and whether it reaches ``keep_from``.

    Texts without words (null, empty, blank) score 0.  Rows are scored one by one, equal texts
    equally; other columns pass unread, and one named like ``out`` is replaced.
    """
    weights, bias = model.weights, model.bias
    shapes = Shapes()

    @F.pandas_udf(QUALITY)
    def scores(ts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in ts:
            at, again, n = hashed(t, shapes)
            z = (float(weights[at].sum(dtype=np.float64)) + float(weights[AGAIN]) * again) / n + bias if n else -50.0
            score = float(1 / (1 + np.exp(-max(min(z, 50.0), -50.0)))) if n else 0.0
            rows.append((score, score >= keep_from))
        return pd.DataFrame(rows, columns=["score", "kept"])

    return docs.withColumn(out, scores(F.coalesce(F.col(text), F.lit(""))))
