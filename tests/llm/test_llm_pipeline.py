"""The near stage at the pipeline's own setting against comparing all pairs, and the whole run against its stages."""

import random

import corpus_pipeline


def sets(text):
    w = text.lower().split()
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)}


def corpus():
    rng = random.Random(8)
    vocabulary = "the of and to in is river stone bridge quiet lamp field path market garden window letter morning".split()
    rows = []
    for _ in range(12):
        base = [rng.choice(vocabulary) + rng.choice(["", "", ",", "."]) for _ in range(120)]
        for changed in (0, 1, 3, 6):
            w = list(base)
            for k in rng.sample(range(120), changed):
                w[k] = f"x{rng.randrange(99)}"
            rows.append((len(rows), " ".join(w)))
    return rows


def near(rows):
    root = {d: d for d, _ in rows}
    shingles = {d: sets(t) for d, t in rows}
    for a, _ in rows:
        for b, _ in rows:
            if b < a and 10 * len(shingles[a] & shingles[b]) >= 8 * len(shingles[a] | shingles[b]) and root[a] != root[b]:
                high, low = max(root[a], root[b]), min(root[a], root[b])
                root = {d: low if r == high else r for d, r in root.items()}
    return {d for d, r in root.items() if d == r}


def test_near_stage_equals_all_pairs(spark):
    rows = corpus()
    got = corpus_pipeline.near(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    kept = [r.doc_id for r in got.collect()]
    assert sorted(kept) == sorted(near(rows)) and 12 <= len(kept) < len(rows)


def test_whole_run_loses_no_row_between_its_stages(spark, monkeypatch, tmp_path):
    rows = corpus()
    rows += [(1000 + k, rows[k][1].capitalize()) for k in range(0, 12, 3)] + [(2000, "too short"), (2001, None)]
    spark.createDataFrame([(d, t, "en") for d, t in rows], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    seen = {}

    def watched(name, stage):
        def run(s, docs, sf_dir):
            out = stage(s, docs, sf_dir)
            seen[name] = {r.doc_id for r in docs.select("doc_id").collect()}, {r.doc_id for r in out.select("doc_id").collect()}
            return out

        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, watched(name, stage)) for name, stage in corpus_pipeline.STAGES])
    packed = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()}
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert list(seen) == names and seen[names[0]][0] == {d for d, _ in rows}
    assert all(seen[a][1] == seen[b][0] for a, b in zip(names, names[1:]))
    text = dict(rows)
    before, after = seen["quality rules"]
    assert before - after == {2000, 2001}
    before, after = seen["exact dedup"]
    assert after == {max(e for e in before if text[e].lower() == text[d].lower()) for d in before}
    before, after = seen["n-gram Jaccard join"]
    assert after == near([(d, text[d]) for d in sorted(before)]) and after
    assert packed == after
