"""Toxicity by multiple-instance learning.

Only documents carry labels, sentences do not.  A sentence's score is a
logistic function of its hashed words and word beginnings; a document's score
is the noisy-or of its sentences (one minus the product of their complements).
Weights are fitted so that the noisy-or agrees with the document labels, which
teaches the model which sentences offend; scoring returns them as spans.

Training reads at most ``max_rows`` labelled documents of each class, chosen by a hash
of their id; scoring reads every whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTENCE = re.compile(r"[^.!?\n]+")
EDGES = ".,;:!?()[]{}\"'«»„“”‚‘’*#$%&|<>-_/\\"
BITS = 18
CACHE = 300_000  # words a worker remembers before it starts anew


def features(word: str) -> tuple[int, ...]:
    """Hashed features of a word: itself and its first four and five letters, without case or outer marks."""
    w = word.lower().strip(EDGES)
    return tuple(crc32(x.encode()) & ((1 << BITS) - 1) for x in ((w, f"4{w[:4]}", f"5{w[:5]}") if len(w) > 3 else (w,))) if w else ()


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float
    trained: bool = True


def noisy_or(z: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Log of one minus the score of each document, from its sentences' logits."""
    return np.add.reduceat(-np.logaddexp(0, z), starts)


def telling(seen: np.ndarray, toxic: np.ndarray, rate: float, least: int = 4, sigmas: float = 3.0) -> np.ndarray:
    """Marks features found in ``least`` documents and more often in toxic ones than chance explains."""
    return (seen >= least) & (toxic - seen * rate >= sigmas * np.sqrt(np.maximum(seen * rate * (1 - rate), 1e-9)))


def fit(feats: np.ndarray, sent_len: np.ndarray, doc_len: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 100, rate: float = 0.25, decay: float = 1e-5) -> ToxicityModel:
    """Weights by Adam on the noisy-or likelihood. ``sent_len``: features of each sentence, ``doc_len``: sentences of each document, at least 1."""
    sent = np.repeat(np.arange(len(sent_len)), sent_len)
    w, b = np.zeros(1 << BITS), -5.0
    doc_at = np.r_[0, np.cumsum(doc_len)[:-1]]
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.clip(np.bincount(sent, weights=w[feats], minlength=len(sent_len)) + b, -50, 50)
        none = np.exp(noisy_or(z, doc_at))
        p = 1 / (1 + np.exp(-z))
        pull = np.where(y == 1, -none / np.maximum(1 - none, 1e-9), 1.0) * weight
        dz = p * np.repeat(pull, doc_len)
        g = np.bincount(feats, weights=dz[sent], minlength=len(w)) + decay * w
        gb = dz.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= 0.1 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return ToxicityModel(w.astype(np.float32), float(b))


def train_toxicity(docs: DataFrame, labels: DataFrame, learn: Column | None = None, max_rows: int = 3000, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel:
    """A model from the documents whose ``label`` is 0 or 1 and that satisfy ``learn`` (a condition on ``labels``).

    At most ``max_rows`` documents of each class are read; the loss is weighted back to
    the classes' shares among all labelled documents.  A document labelled twice counts as toxic if one label
    says so.  Null ids, labels and texts teach nothing.  Without both classes the
    model gives every text the score 0.
    """
    known = labels.where(learn if learn is not None else F.lit(True)).where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
    known = known.groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("int").alias("y"))
    share = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    empty = ToxicityModel(np.zeros(1 << BITS, np.float32), -50.0, False)
    if set(share) != {0, 1}:
        return empty
    # Bounded by max_rows a class, so it may be broadcast and collected.
    picked = [known.where(F.col("y") == c).orderBy(F.xxhash64("id"), "id").limit(max_rows) for c in (0, 1)]
    sample = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).where("t is not null").join(F.broadcast(picked[0].union(picked[1])), "id")

    def presence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            for y, t in zip(batch["y"], batch["t"], strict=True):
                seen[y, list({f for w in set(t.split()) for f in features(w)})] += 1
        at = np.flatnonzero(seen.sum(0))
        yield pd.DataFrame({"f": at, "clean": seen[0, at], "toxic": seen[1, at]})

    counted = sample.mapInPandas(presence, "f int, clean int, toxic int").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = n.get(1, 0) / max(sum(n.values()), 1)
    # At most one row for each of the hashed features.
    found = counted.where("clean + toxic >= 4").toPandas()
    keep = set(found["f"][telling((found["clean"] + found["toxic"]).to_numpy(), found["toxic"].to_numpy(), rate)].tolist())

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, list[int]] = {}
        for batch in batches:
            out = []
            for y, t in zip(batch["y"], batch["t"], strict=True):
                lens, feats = [], []
                for words in map(str.split, SENTENCE.findall(t)):
                    if words:
                        for w in words:
                            if w not in known:
                                known[w] = [f for f in features(w) if f in keep]
                        got = [f for w in words for f in known[w]]
                        lens.append(len(got))
                        feats += got
                if lens:
                    out.append((y, lens, feats))
            yield pd.DataFrame(out, columns=["y", "lens", "feats"])

    rows = sample.mapInPandas(bags, "y int, lens array<int>, feats array<int>").toPandas()
    y = rows["y"].to_numpy()
    if set(y.tolist()) != {0, 1}:
        return empty
    weight = np.where(y == 1, share[1] / (y == 1).sum(), share[0] / (y == 0).sum()) / (share[0] + share[1])
    return fit(np.concatenate(rows["feats"].to_list()).astype(np.int64), np.concatenate(rows["lens"].to_list()), rows["lens"].map(len).to_numpy(), y, weight)


SCORES = "score double, sentences array<struct<start: int, length: int, score: double>>"


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "toxicity", locate: float = 0.3) -> DataFrame:
    """``docs`` with a struct ``out``: the document's score and the spans of sentences that score at least ``locate``.

    Null and empty texts and texts without words score 0.  Spans count code points.  Rows are scored one
    by one, equal texts equally; other columns pass unread, and one named like ``out`` is replaced.
    """
    weights, bias = model.weights, model.bias

    class Known(dict):
        def __missing__(self, word: str) -> float:
            if len(self) >= CACHE:
                self.clear()
            value = self[word] = float(sum(weights[f] for f in features(word)))
            return value

    known = Known()

    def logit(sentence: str) -> float | None:
        words = sentence.split()
        return sum(map(known.__getitem__, words)) + bias if words else None

    @F.pandas_udf(SCORES)
    def scores(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            parts = t.replace("!", ".").replace("?", ".").replace("\n", ".").split(".")
            z = np.array([x for s in parts if (x := logit(s)) is not None])
            score = float(-np.expm1(-np.logaddexp(0, z).sum())) if len(z) else 0.0
            spans = []
            if score >= locate:
                for s, at in zip(parts, accumulate((len(s) + 1 for s in parts), initial=0), strict=False):
                    x = logit(s)
                    if x is not None and (p := 1 / (1 + np.exp(-max(x, -50.0)))) >= locate:
                        spans.append({"start": at, "length": len(s), "score": float(p)})
            rows.append((score, spans))
        return pd.DataFrame(rows, columns=["score", "sentences"])

    return docs.withColumn(out, scores(F.coalesce(F.col(text), F.lit(""))))
