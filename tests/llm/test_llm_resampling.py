"""Importance resampling against a plain computation, and the draw on ties and awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quire.llm import queries, resampling

SCHEMA = "doc_id long, text string, rank string, resampling string"
LONG = "wört" * 30


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return len(w), [zlib.crc32(x.encode()) % 10_000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]


def brute(docs, target):
    """doc_id, n_features, weight, score, rank by the definition, ties in input order."""
    s, t = (Counter(b for x in texts for b in features(x)[1]) for texts in ([d for _, d in docs], target))
    ss, tt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (ss + 10_000) / ((s[b] + 1.0) * (tt + 10_000))))
    rows = []
    for i, d in docs:
        n, f = features(d)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((k for k, r in enumerate(rows) if r[5] >= 20), key=lambda k: (-rows[k][3], rows[k][0] is None, rows[k][0] or 0))
    for rank, k in enumerate(fit[: 25 * len(fit) // 100], 1):
        rows[k][4] = rank
    return [tuple(r[:5]) for r in rows]


def corpus(n, seed=1):
    rng = random.Random(seed)
    pool = [f"w{k}" for k in range(300)] + ["É", "Straße", LONG, "A-B", "x_y", "ſ", "K"]
    rows = [(k, rng.choice([" ", ".\n", "--"]).join(rng.choice(pool) for _ in range(rng.choice([0, 1, 5, 19, 20, 21, 90])))) for k in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "-- \t"), (None, "w1 " * 25), (n + 3, "w2 w3 " * 20_000), (n + 4, "z" * 60_000)]


@pytest.mark.parametrize("n", [40, 400])
def test_resample_equals_the_definition(spark, n):
    docs = corpus(n)
    target = [" ".join(f"W{k}" for k in range(j, j + 30)) for j in range(0, 90, 7)]
    df = spark.createDataFrame([(i, t, "old", "old") for i, t in docs], SCHEMA)
    got = resampling.resample(df, spark.createDataFrame([(t,) for t in [*target, None]], "text string"))
    assert got.columns == ["doc_id", "text", "resampling", "rank"]
    got = sorted(((r.doc_id, *tuple(r.resampling)[1:], r["rank"]) for r in got.collect()), key=str)
    assert got == sorted(brute(docs, target), key=str)


def test_pairs_of_words_hash_as_their_text():
    words = [b"a", b"bc", b"x" * 63, b"y" * 64, b"z" * 65, b"q" * 500, "é".encode(), b"a"]
    got = resampling.FeatureHasher(10_000)(words)
    assert got.tolist() == [zlib.crc32(w) % 10_000 for w in words + [a + b" " + b for a, b in zip(words, words[1:], strict=False)]]
    small = resampling.FeatureHasher(97)
    small._room(3)  # forgets and grows
    assert small(words).tolist() == [zlib.crc32(w) % 97 for w in words + [a + b" " + b for a, b in zip(words, words[1:], strict=False)]]


@pytest.mark.parametrize("k", [1, 2, 250, 499, 500, 501])
def test_quickselect_finds_the_kth_key(spark, k):
    rng = random.Random(k)
    keys = [(rng.randint(0, 5), j) for j in range(500)]  # many ties in the first part
    got = resampling.kth_key(spark.createDataFrame(keys, "a long, b long"), ["a", "b"], k, pivots=4)
    assert got == (sorted(keys)[k - 1] if k <= 500 else None)


def test_ties_and_repeated_rows_fill_the_share_exactly(spark):
    text = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(5, text)] * 37 + [(None, text)] * 3, "doc_id long, text string").repartition(4)
    got = resampling.resample(df, df).collect()
    drawn = sorted(r["rank"] for r in got if r["rank"] is not None)
    assert len(got) == 40 and drawn == list(range(1, 11))
    assert len({r.resampling.score for r in got if r.doc_id == 5}) == 1


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    assert resampling.resample(none, one).count() == 0
    assert [(r.resampling.n_features, r["rank"]) for r in resampling.resample(one, none, share=100).collect()] == [(79, 1)]
    assert np.array_equal(resampling.bucket_counts(none), np.zeros(10_000))


def test_query_contract(spark, tmp_path):
    docs = corpus(60)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "w1 w2 w3"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.op13_resampling(spark, str(tmp_path))
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(docs, ["w1 w2 w3"]), key=str)
