"""Packing: token ids against the tokenizer, sequences without gaps, and close to plain best fit."""

import bisect
import random
from collections import Counter
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quire.llm import packing
from quire.llm.tokens import WordTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "", " \n ", "Hello, world!", "it's WE'LL 'tis don't", "Éà ñ ß İ Σς ΑΣ ﬁ Å é x́y", "a\x1cb\x85c d e", "12 3.5 x²  $$$", "<|endoftext|> a<|startoftext|>b",
    "日本語 テキスト 🎉🎉", "tabs\tand\r\nlines\x0b\x0c", "ends.\nHere, now; yes: no? go!", "ñandú,, ..a", "ǅ ŉ K Ω",
]


def best_fit(lengths, capacity):
    gaps, n = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, x)
        g = gaps.pop(i) if i < len(gaps) else capacity
        n += g == capacity
        if g > x:
            bisect.insort(gaps, g - x)
    return n


def test_ids_equal_the_tokenizer():
    t, w = Tokenizer.from_file(PATH), WordTokenizer(PATH)
    rng = random.Random(1)
    alphabet = "abcZÉé ,.!'\n\t09$|İΣ́ "
    for text in TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(800)]:
        assert np.frombuffer(w.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("kind", ["wide", "tiny", "same", "middle"])
def test_moves_place_every_piece_once_and_as_tightly_as_best_fit(kind):
    rng = random.Random(kind)
    lengths = {
        "wide": [min(4096, max(1, int(rng.lognormvariate(6.5, 1.2)))) for _ in range(5000)], "tiny": [rng.randint(1, 50) for _ in range(5000)],
        "same": [1500] * 600 + [100] * 100, "middle": [rng.randint(600, 2500) for _ in range(4000)],
    }[kind]
    fill, seen = Counter(), Counter()
    for n, lo, hi, per, first, gap in packing.best_fit_moves(Counter(lengths)):
        for r in range(lo, hi):
            seen[n, r] += 1
            b, k = first + (r - lo) // per, (r - lo) % per
            assert fill[b] == 4096 - gap + k * n
            fill[b] += n
    assert seen == Counter((n, r) for n, c in Counter(lengths).items() for r in range(c))
    assert max(fill.values()) <= 4096 and len(fill) <= best_fit(lengths, 4096) * 1.01 + 1


def test_documents_are_packed_whole(spark):
    rng = random.Random(7)
    rows = [(k, " ".join(rng.choice(["river", "Stone,", "the", "quiet", "żółw"]) for _ in range(rng.choice([3, 50, 400, 2000]))), k) for k in range(120)]
    rows += [(None, None, 1), (None, "", 2), (7, "twice", 3), (7, "twice", 3), (900, "long " * 9000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset long")
    got = packing.pack_documents(docs, PATH, capacity=512, with_ids=True).toPandas()
    t = Tokenizer.from_file(PATH)
    want = Counter()
    for i, text, _ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 512):
            part = ids[k:k + 512].tobytes()
            want[i, k // 512, k, len(part) // 4, crc32(part)] += 1
    have = Counter((None if np.isnan(a) else int(a), b, c, d, e) for a, b, c, d, e in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))
    assert have == want
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g["offset"].to_numpy() == np.r_[0, g["length"].cumsum().to_numpy()[:-1]]).all() and g["length"].sum() <= 512
    assert got["sequence_id"].nunique() <= best_fit(got["length"].tolist(), 512) * 1.01 + 1
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0
