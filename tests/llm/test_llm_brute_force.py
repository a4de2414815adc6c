"""Toxicity, language evidence and the quality model against plain computations, long texts, and the columns of every query."""

import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quire.llm import language_id, quality_model, queries, toxicity

DOCS = "doc_id long, text string, lang string, source string"
WORDS = "the river stone bridge quiet and with of path lamp".split()


def prose(rng, n, extra=()):
    return " ".join(rng.choice([*WORDS, *extra]) + rng.choice(["", "", "", ".", "!", "?\n", ","]) for _ in range(n))


# ---- op2: noisy-or of sentences -----------------------------------------------------------------------------------


def plain_toxicity(text, model):
    """1 - product of (1 - p) over the sentences, one feature at a time."""
    none = 1.0
    for sentence in re.split(r"[.!?\n]", text or ""):
        if sentence.split():
            z = model.bias + sum(float(model.weights[f]) for w in sentence.split() for f in toxicity.features(w))
            none *= 1 - 1 / (1 + math.exp(-z))
    return 1 - none


def test_toxicity_scores_equal_a_plain_noisy_or(spark):
    rng = np.random.default_rng(1)
    model = toxicity.ToxicityModel(rng.normal(0, 1, 1 << toxicity.BITS).astype(np.float32), -3.0)
    r = random.Random(2)
    texts = [prose(r, r.randint(0, 60), ("Ä", "(stone)", "x" * 30)) for _ in range(120)] + [None, "", " .. ", "a\n\nb", "no end", "long " * 60_000]
    rows = toxicity.score_toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert len(rows) == len(texts)
    for row in rows:
        text = row.text or ""
        assert row.toxicity.score == pytest.approx(plain_toxicity(text, model), abs=1e-6)
        spans = {(s.start, s.length): s.score for s in row.toxicity.sentences}
        want = {m.span(): plain_toxicity(m[0], model) for m in re.finditer(r"[^.!?\n]+", text) if m[0].split()}
        assert spans == pytest.approx({(a, b - a): p for (a, b), p in want.items() if p >= 0.3}, abs=1e-6)


def test_toxicity_fit_lowers_the_plain_loss():
    rng = np.random.default_rng(3)
    doc_len, y = rng.integers(1, 5, 60), np.arange(60) % 3 == 0
    sent_len = rng.integers(1, 6, doc_len.sum())
    feats = rng.integers(1, 50, sent_len.sum())
    at = np.r_[0, np.cumsum(sent_len)]
    first = np.r_[0, np.cumsum(doc_len)]
    for d in np.flatnonzero(y):
        feats[at[first[d]]] = 99  # one offending sentence in each toxic document

    def loss(model):
        total = 0.0
        for d in range(60):
            none = 1.0
            for s in range(first[d], first[d + 1]):
                none *= 1 - 1 / (1 + math.exp(-(model.bias + sum(float(model.weights[f]) for f in feats[at[s] : at[s + 1]]))))
            total -= math.log(max(1 - none if y[d] else none, 1e-12))
        return total

    fitted = toxicity.fit(feats, sent_len, doc_len, y.astype(int), np.full(60, 1 / 60))
    assert loss(fitted) < 0.2 * loss(toxicity.ToxicityModel(np.zeros(1 << toxicity.BITS), -1.0)) and fitted.weights.argmax() == 99


# ---- op8: fusion of evidence --------------------------------------------------------------------------------------


def softmax(x):
    e = np.exp(x - x.max())
    return e / e.sum()


def plain_fusion(pages, model):
    """(declared, text_lang, lang, confidence) of every page, from whole lists in memory."""
    names, n = model.languages, len(model.languages)
    rows = []
    for _, url, html in pages:
        body = html or ""
        m = re.match(r"[a-z]+://([^/?#]*)", url or "")
        code = re.search(r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", body)
        declared = "none" if not code else code[1].lower() if code[1].lower() in names else "other"
        text = re.sub(r"(?s)<[^>]*>", " ", body)
        grams = [g for w in text.split() for g in language_id.trigrams(w)]
        logs = np.zeros(n)
        if grams:
            logs = model.table[grams].sum(0) / len(grams) * model.halved * math.log1p(len(grams) / model.halved) * language_id.TEMPER
        host = m[1].lower() if m else ""
        rows.append((host, host.split(".")[-1], declared, logs, softmax(logs), bool(grams)))
    voters = [r for r in rows if r[5]]
    whole = sum((r[4] for r in voters), np.zeros(n))
    top = (whole + 1) / (whole.sum() + n)
    out = []
    for host, suffix, declared, logs, p, votes in rows:
        said = sum((r[4] for r in voters if r[2] == declared), np.zeros(n))
        likelihood = np.array([(said[k] + language_id.DECLARED_WEIGHT * (0.5 if declared == names[k] else 0.5 / (n + 1))) / (whole[k] + language_id.DECLARED_WEIGHT) for k in range(n)])
        prior = top
        if any(r[0] == host for r in voters):
            h = sum((r[4] for r in voters if r[0] == host), np.zeros(n))
            s = sum((r[4] for r in voters if r[1] == suffix), np.zeros(n))
            above = np.maximum(s - h + language_id.SUFFIX_WEIGHT * top, 1e-9) / (s.sum() - h.sum() + language_id.SUFFIX_WEIGHT)
            prior = np.maximum(h - (p if votes else 0), 0) + language_id.HOST_WEIGHT * above
        q = softmax(logs + np.log(prior) + np.log(likelihood))
        out.append((declared, names[int(logs.argmax())] if votes else None, names[int(q.argmax())], float(q.max())))
    return out


def test_language_fusion_equals_a_plain_one(spark):
    rng = random.Random(4)
    pools = {"en-US": "the river and stone quiet bridge", "de": "der fluss und stein ruhig brücke", "FR": "la rivière et pierre calme pont", "xx": "qa zu vo"}
    docs = [(" ".join(rng.choice(p.split()) for _ in range(40)), c) for c, p in pools.items() for _ in range(12 if c != "xx" else 2)]
    model = language_id.train_text_model(spark.createDataFrame(docs, "text string, lang string"))
    assert model.languages == ["de", "en", "fr", "other"]
    pages = []
    for k in range(200):
        code = rng.choice(list(pools))
        text = " ".join(rng.choice(pools[code].split()) for _ in range(rng.choice([0, 1, 3, 30])))
        mark = rng.choice(["", f'<html lang="{code}">', "<html lang=en>", "<html lang='zz-ZZ'>"])
        pages.append((k, rng.choice([f"http://h{rng.randrange(9)}.{rng.choice(['de', 'com'])}/{k}", f"https://only{k}.fr/", None]), f"{mark}<p>{text}</p>"))
    pages += [(900, None, None), (901, "http://h1.de/long", "<p>" + "der fluss " * 40_000)]
    got = {r.page_id: r for r in language_id.page_languages(spark.createDataFrame(pages, "page_id long, url string, html string"), model).collect()}
    for (k, *_), (declared, text_lang, lang, confidence) in zip(pages, plain_fusion(pages, model), strict=True):
        r = got[k]
        assert (r.declared, r.text_lang) == (declared, text_lang) and r.confidence == pytest.approx(confidence, rel=1e-6)
        assert r.lang == lang


# ---- op10: label model over rows, scorer over words -----------------------------------------------------------------


def plain_labels(rows, rounds):
    """Expectation-maximisation with one posterior a row of votes."""
    good, bad = quality_model.GOOD, quality_model.BAD
    q = [0.95 if all(v != bad for v in r) else 0.3 if sum(v == bad for v in r) == 1 else 0.02 for r in rows]
    for _ in range(rounds):
        prior = min(max(sum(q) / len(q), 0.01), 0.99)
        table = np.zeros((quality_model.LABELLERS, 2, 2))
        for k in range(quality_model.LABELLERS):
            for c in (0, 1):
                w = [sum((x if c else 1 - x) for r, x in zip(rows, q, strict=True) if r[k] == v) for v in (bad, good)]
                w = [a + quality_model.BELIEF_WEIGHT * len(rows) * b for a, b in zip(w, quality_model.BELIEF[c], strict=True)]
                table[k, c] = np.array(w) / sum(w)
        new = []
        for r in rows:
            like = [math.log(1 - prior), math.log(prior)]
            for k, v in enumerate(r):
                if v in (bad, good):
                    for c in (0, 1):
                        like[c] += math.log(table[k, c, int(v == good)])
            new.append(1 / (1 + math.exp(min(max(like[0] - like[1], -50), 50))))
        done, q = max(abs(a - b) for a, b in zip(q, new, strict=True)) < 1e-6, new
        if done:
            break
    return prior, table, q


def test_label_model_over_counts_equals_one_over_rows():
    rng = random.Random(5)
    rows = []
    for _ in range(300):
        truth = rng.random() < 0.7
        rows.append(tuple(rng.choice([quality_model.NONE, quality_model.GOOD if (rng.random() < 0.85) == truth else quality_model.BAD]) for _ in range(quality_model.LABELLERS)))
    counts = {}
    for r in rows:
        counts[quality_model.pattern(r)] = counts.get(quality_model.pattern(r), 0) + 1
    model = quality_model.fit_labels(counts, rounds=30)
    prior, table, q = plain_labels(rows, 30)
    assert model.prior == pytest.approx(prior, abs=1e-9) and np.allclose(model.table, table, atol=1e-9)
    assert [model.posterior[quality_model.pattern(r)] for r in rows] == pytest.approx(q, abs=1e-9)


def test_quality_scores_equal_a_plain_sum(spark):
    rng, r = np.random.default_rng(6), random.Random(7)
    weights = rng.normal(0, 1, 1 << quality_model.BITS).astype(np.float32)
    model = quality_model.QualityModel(quality_model.LabelModel(0.5, np.zeros((9, 2, 2)), {}), weights, 0.3)
    texts = [prose(r, r.randint(0, 80), ("A1b2", "||", "www.a-b.example/path?x=1", "NASA", "é", "é")) for _ in range(100)] + [None, "", "\n", "one", "a " * 50_000]
    rows = quality_model.score_quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, out="q").collect()
    for row in rows:
        words = (row.text or "").split()
        if not words:
            assert row.q.score == 0 and not row.q.kept
            continue
        shapes = [quality_model.shape(w) for w in words]
        z = sum(float(weights[s]) for s in shapes)
        z += sum(float(weights[(a * 40503 + b + 7) % (1 << quality_model.BITS)]) for a, b in zip(shapes, shapes[1:], strict=False))
        z += float(weights[quality_model.AGAIN]) * sum(a == b for a, b in zip(words, words[1:], strict=False))
        want = 1 / (1 + math.exp(-min(max(z / len(words) + 0.3, -50), 50)))
        assert row.q.score == pytest.approx(want, rel=1e-6) and row.q.kept == (row.q.score >= 0.5)


def test_long_words_of_unlike_ends_have_unlike_shapes():
    assert quality_model.shape("a-b-c-d-e-f-g-h") != quality_model.shape("a-b-c-d-e-f-g-|")


# ---- the queries' columns -------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    base, rng = str(tmp_path_factory.mktemp("tables")), random.Random(8)
    docs = [(k, prose(rng, rng.choice([5, 40, 300])), rng.choice(["en", "de"]), "s") for k in range(80)]
    docs += [(80, None, None, None), (81, "", "en", "s"), (None, docs[3][1], "en", "s"), (82, docs[3][1].upper(), "en", "s"), (82, docs[3][1].upper(), "en", "s")]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(k, 1, k % 5 == 0) for k in range(80)], "doc_id long, quality int, toxic boolean").select("doc_id", "quality", F.col("toxic").cast("int").alias("toxic")).write.parquet(f"{base}/labels.parquet")
    pages = [(k, f"http://h{k % 3}.de/{k}", f"<html lang=en><p>{prose(rng, 30)}</p>") for k in range(30)] + [(30, None, None), (None, "", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{base}/pages.parquet")
    return base, docs, pages


CONTRACTS = {
    "op1_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op2_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op3_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op4_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op5_ngram_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op7_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op8_language_id": {"page_id": "bigint", "lang": "string"},
    "op9_sentence_pieces": {"doc_id": "bigint", "round_trip": "boolean"},
    "op10_quality_model": {"doc_id": "bigint", "kept": "boolean"},
}


@pytest.mark.parametrize("name", CONTRACTS)
def test_every_row_comes_back_with_the_columns_of_the_contract(spark, tables, name):
    base, docs, pages = tables
    got = queries.QUERIES[name](spark, base)
    kinds = dict(got.dtypes)
    assert {c: kinds.get(c) for c in CONTRACTS[name]} == CONTRACTS[name]
    rows = got.collect()
    if name == "op1_packing":
        assert {r.doc_id for r in rows} == {d[0] for d in docs} and all(1 <= r.length and r.offset + r.length <= 4096 for r in rows)
    else:
        key, want = ("page_id", pages) if "page_id" in kinds else ("doc_id", docs)
        assert sorted((r[key] for r in rows), key=str) == sorted((w[0] for w in want), key=str)
    if name == "op2_toxicity":
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    if name == "op9_sentence_pieces":
        assert all(r.round_trip for r in rows)


def test_public_files_are_found():
    assert queries.tokenizer_path("word_bpe_49k.json") == public_tokenizers.path("word_bpe_49k.json")
