"""Exact copies, quality rules, quality model and toxicity against brute force and on awkward rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import exact_dedup, quality_model, quality_rules, toxicity

AWKWARD = [
    (1, None, "en", "x"), (2, "", None, "y"), (3, "   \n\t ", "fr", "x"), (4, "Same TEXT here. And é more!", "en", "x"),
    (5, "same text HERE. and é more!", "en", "x"), (5, "same text HERE. and é more!", "en", "x"), (6, "same text HERE. and É more!", "zz", "x"),
    (7, "long " * 40_000, "en", "x"), (8, "no-break " + "x" * 5000, "en", "x"), (None, "lonely text", "en", "x"), (None, None, None, None),
]
SCHEMA = "doc_id long, text string, lang string, kept string"  # kept clashes with a result column


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute_groups(rows):
    by = {}
    for i, t in rows:
        by.setdefault(lower(t), []).append(i)
    out = []
    for i, t in rows:
        ids = [x for x in by[lower(t)] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(by[lower(t)]), i == keep))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [64, 2])
def test_exact_groups_equal_brute_force_even_when_identifiers_collide(spark, docs, bits):
    rng = random.Random(3)
    extra = [(100 + k, ". ".join(rng.choice(["ab " * 70, "cd " * 80, "ef"]) for _ in range(rng.randint(1, 4))), "en", "x") for k in range(60)]
    df = docs.union(spark.createDataFrame(extra, SCHEMA))
    got = exact_dedup.exact_groups(df, bits=bits).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=str) == brute_groups([r[:2] for r in AWKWARD + extra])
    assert exact_dedup.exact_groups(df.limit(0)).count() == 0


def test_chunks_join_to_the_text(spark, docs):
    for r in docs.select("text", F.array_join(exact_dedup.chunks(F.col("text")), "").alias("again")).where("text is not null").collect():
        assert r.text == r.again


def test_dropping_copies_leaves_one_row_of_each_group(docs):
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    texts = [lower(r.text) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({lower(r[1]) for r in AWKWARD})


def brute_rules(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_rule_counts_equal_brute_force(spark, docs):
    rng = random.Random(5)
    made = [(200 + k, "".join(rng.choice(["a ", "b ", "c\n", "é|", "\x0b", "\x85", " ", "# "]) for _ in range(rng.randint(0, 200))), "en", "k") for k in range(80)]
    got = quality_rules.quality_rules(docs.union(spark.createDataFrame(made, SCHEMA))).select("text", "rules.*").collect()
    assert len(got) == len(AWKWARD) + len(made)
    for r in got:
        want = brute_rules(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)


def test_repeated_windows_with_many_distinct_words():
    words = [str(k).encode() for k in range(60_000)]
    words[30_000:30_005] = words[:5]
    assert quality_rules.repeated_window_words(words, Counter(words)) == 10


def test_rules_without_reference_rows_and_empty_table(docs):
    assert quality_rules.quality_rules(docs.where("lang = 'zz'")).where("rules.kept").count() == 0
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0


def test_prose_of_every_declared_language_is_kept(spark):
    rng = random.Random(6)

    def text(words):
        return " ".join(rng.choice(words.split()) for _ in range(80)) + "."

    english = "the of and river stone bridge quiet to in with path field"
    russian = "река камень мост тихий дорога поле лес и в на с по"
    finnish = "joki kivi silta hiljainen polku ja on ei se kun mutta talo"
    rows = [(k, text(w), c, "x") for k, (w, c) in enumerate([(english, "en"), (russian, "ru"), (finnish, "FI-fi")] * 30)]
    rows += [(900, text(russian), "bg", "x"), (901, text(russian), "ru", "x"), (902, " ".join("#$%|" * 8 for _ in range(80)), "ru", "x"), (903, text("qx vz kj wq zx bn"), "en", "x")]
    got = {r.doc_id: r.rules for r in quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "rules").collect()}
    assert all(got[k].kept for k in range(90)) and got[901].kept
    assert got[900].kept and got[900].char_distance is None and got[900].word_distance is None
    assert got[902].char_distance > quality_rules.CHAR_LIMIT and not got[902].kept
    assert got[903].word_distance > quality_rules.WORD_LIMIT and not got[903].kept


def test_distance_is_zero_for_equal_and_one_for_disjoint():
    assert quality_rules.js_distance(np.array([0.5, 0.5]), np.array([[0.5, 0.5]]))[0] < 1e-7
    assert abs(quality_rules.js_distance(np.array([1.0, 0.0]), np.array([[0.0, 1.0]]))[0] - 1) < 1e-7


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "river", "stone", "bridge", "quiet", "to", "in"]) + rng.choice(["", "", ",", "."]) for _ in range(n))


def test_quality_model_keeps_prose_and_rejects_junk(spark, docs):
    rng = random.Random(1)
    good = [(k, prose(rng, 80) + ".", "en", "g") for k in range(60)]
    bad = [(1000 + k, " | ".join(w + "$$$" for w in prose(rng, 60).split()), "en", "b") for k in range(15)]
    df = spark.createDataFrame(good + bad, SCHEMA)
    model = quality_model.train_quality(df)
    got = {r.doc_id: r.q.kept for r in quality_model.score_quality(df, model, out="q").collect()}
    assert all(got[k] for k, *_ in good) and not any(got[k] for k, *_ in bad)
    odd = quality_model.score_quality(docs, model, out="q").collect()
    assert len(odd) == len(AWKWARD) and all(0 <= r.q.score <= 1 for r in odd) and all(r.q.score == 0 for r in odd if not (r.text or "").strip())
    assert quality_model.score_quality(docs.limit(0), quality_model.train_quality(docs.limit(0))).count() == 0


def test_label_model_ranks_an_unreliable_labeller_lower():
    counts = Counter()
    rng = random.Random(2)
    for _ in range(4000):
        good = rng.random() < 0.7
        vs = [int(good) if rng.random() < 0.95 else int(not good) for _ in range(quality_model.LABELLERS)]
        vs[0] = rng.randint(0, 1)
        counts[quality_model.pattern(vs)] += 1
    m = quality_model.fit_labels(counts)
    right = (m.table[:, 0, 0] + m.table[:, 1, 1]) / 2
    assert right[0] < right[1:].min() - 0.1 and abs(m.prior - 0.7) < 0.05


def test_toxicity_learns_sentences_from_document_labels(spark, docs):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(400):
        sents = [prose(rng, 8).replace(".", "") for _ in range(6)]
        toxic = k % 4 == 0
        if toxic:
            sents[rng.randint(0, 5)] += " you " + rng.choice(["blarg", "snotface", "vequtu"])
        rows.append((k, ". ".join(sents), "en", "x"))
        labels.append((k, 1, int(toxic)))
    df, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*labels, (None, 1, 1), (999, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train_toxicity(df, lab, learn=F.col("doc_id") % 2 == 0)
    got = toxicity.score_toxicity(df, model).collect()
    held = [(r.doc_id % 4 == 0, r.toxicity.score >= 0.3) for r in got if r.doc_id % 2]
    seen = [(r.doc_id % 4 == 0, r.toxicity.score >= 0.3) for r in got if not r.doc_id % 2]
    assert sum(a == b for a, b in held + seen) >= 396
    for r in got:
        for s in r.toxicity.sentences:
            assert re.search("blarg|snotface|vequtu", r.text[s.start:s.start + s.length])
    odd = toxicity.score_toxicity(docs, model).collect()
    assert len(odd) == len(AWKWARD) and all(r.toxicity.score == 0 for r in odd if not (r.text or "").strip())
    assert not toxicity.train_toxicity(df, lab.limit(0)).trained
