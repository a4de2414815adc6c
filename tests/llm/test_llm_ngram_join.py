"""The n-gram join against comparing all pairs."""

import random
import re

import numpy as np
import pytest

from quire.llm import ngram_join
from quire.llm.common import components


def brute(rows, similar=90, of=100):
    def sh(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return frozenset(tuple(w[i:i + 3]) for i in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else [])

    sets = [sh(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and of * len(sets[i] & sets[j]) >= similar * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted([(d, len(sets[i]), low.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)], key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    rows, d = [], 1000
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 40, 120]))]
        if rng.random() < 0.5:
            base += passage
        for _ in range(rng.choice([1, 2, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((d, " ".join(w)))
            d -= rng.choice([1, 3])
    rows += [(1, None), (2, ""), (3, " \t"), (4, "One"), (5, "one"), (6, "one two"), (7, "ONE\vtwo"), (7, "ONE\vtwo"), (None, "one two"), (None, "alone here now")]
    rows += [(2000, "aa " * 5000), (2001, "aa " * 5001), (2002, "one\x85two three four")]
    return rows


@pytest.mark.parametrize("seed,similar,least", [(1, 90, 16), (2, 60, 3)])
def test_components_equal_all_pairs(spark, monkeypatch, seed, similar, least):
    rows = corpus(seed)
    many = ngram_join.frequent_shingles
    monkeypatch.setattr(ngram_join, "frequent_shingles", lambda texts, k: many(texts, k, least))
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, component_id string")
    got = ngram_join.similar_components(df, similar=similar)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, similar)


def variants(seed):
    """Near copies in classes of several raw texts: case, white space and repeated passages, some without ids."""
    rng = random.Random(seed)
    rows = []
    for _ in range(30):
        base = [f"w{rng.randrange(400)}" for _ in range(40)]
        for w in (base, base[:-1] + ["last"]):
            texts = [" ".join(w), "  ".join(w), " ".join(w).upper(), " ".join(w + w + w[:2]), " ".join(w + w[:2])]
            rows += [(None if rng.random() < 0.3 else rng.randrange(10**6), t) for t in rng.sample(texts, rng.randint(1, 4))]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_of_several_texts_keep_their_links(spark, seed):
    rows = variants(seed)
    got = ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), similar=80)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 80)


def test_one_of_each_component_stays(spark):
    rows = [r for r in corpus(3) if r[0] is not None]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, component_id string")
    kept = ngram_join.drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _, c in brute(rows) if d == c)
    assert ngram_join.drop_near_copies(df.limit(0)).count() == 0


def test_null_and_repeated_ids_leave_one_row_of_each_component(spark):
    base = [[f"{c}{k}" for k in range(60)] for c in "abcdef"]
    near = [" ".join(w[:-1] + ["last"]) for w in base]
    whole = [" ".join(w) for w in base]
    rows = [
        (None, whole[0]), (None, near[0]), (None, whole[1]), (4, near[1]), (None, whole[2]), (5, whole[3]), (5, whole[4]), (3, near[4]),
        (9, whole[5]), (9, whole[5]), (9, near[5]), (None, " "), (None, None), (9, ""), (9, ""),
    ]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, component_id string")
    got = [(r.doc_id, r.text) for r in ngram_join.drop_near_copies(df).collect()]
    assert sorted((t or "").strip() for _, t in got)[:4] == [""] * 4
    named = [(d, t) for d, t in got if (t or "").strip()]
    assert len(named) == 6 and sum(t in (whole[0], near[0]) and d is None for d, t in named) == 1
    assert {(4, near[1]), (None, whole[2]), (5, whole[3]), (3, near[4])} <= set(named)
    assert sum(d == 9 and t in (whole[5], near[5]) for d, t in named) == 1


def test_components_of_a_long_chain(spark):
    edges = [(k + 1, k) for k in range(60)] + [(200, 150), (150, 150)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{k: 0 for k in range(61)}, 200: 150, 150: 150}


def test_hashes_agree_with_shingles():
    t = "A b  c\td a B c D " * 5
    assert len(ngram_join.shingle_hashes(t, ngram_join._Hashes())) == len(ngram_join.shingles(t))
    assert len(ngram_join.shingle_hashes("", ngram_join._Hashes())) == 0 and np.uint64 == ngram_join.shingle_hashes("a", {}).dtype
