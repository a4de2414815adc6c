"""Licence scan against a plain walk over the words, and on awkward rows."""

import random
import re

import pytest

from quire.llm import license_scan as ls
from quire.llm import queries

SCHEMA = "doc_id long, text string, n_words long, places string"  # clashing names
AWKWARD = [
    (1, None, 0, "x"), (2, "", 0, "x"), (3, " .,;\n\0\t", 0, "x"), (4, "Under the MIT License", 0, "x"), (5, "under the mit licenses", 0, "x"),
    (6, "..Under-the_MIT\nlicense under the MIT license, Apache License, Version 2.0 (CC BY-NC)!", 0, "x"), (7, "under the éMIT license", 0, "x"),
    (8, "This work is licensed under the GNU General Public License, version 3.", 0, "x"), (8, "This work is licensed under the GNU General Public License, version 3.", 0, "x"),
    (None, "cc by nc cc by nc", 0, "x"), (9, "mit " * 20_000 + "under the mit license " + "license " * 5_000, 0, "x"), (10, "x" * 70_000, 0, "x"),
    (11, "worK K Work by cc BY nc", 0, "x"), (12, "this worK is licensed under a creative commons attribution 4 0 international license", 0, "x"),
    (13, "İnç under the mıt license. Under the mİt license", 0, "x"), (14, "license license mit mit the the under", 0, "x"),
    (15, "Redistribution and use, in source and binary forms, are not permitted by anybody here at all", 0, "x"),
    (16, "Redistribution and use in source and binary forms, with or without changes, are permitted provided that the following conditions are met:", 0, "x"),
]


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_scan(texts):
    """(n_words, places, {label: best share}) of every text, trying every start of every template."""
    rows = [plain_words(t) for t in texts]
    vocabulary = {w for _, t, _ in ls.TEMPLATES for w in t.split()} | {w for _, p in ls.PHRASES for w in p.split()}
    index = ls.LicenceIndex(ls.TEMPLATES, ls.PHRASES, len(rows), {w: sum(w in r for r in map(set, rows)) for w in vocabulary})
    out = []
    for w in rows:
        places = sorted((i, label, len(p.split())) for label, p in ls.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        best = {}
        for label, t, key in ls.TEMPLATES:
            ts, anchors = t.split(), index.rarest(t, ls.ANCHORS)
            starts = {i - p for i, x in enumerate(w) if x in anchors for p, y in enumerate(ts) if x == y}
            for at in starts:
                near = sum(a in w[max(0, at + ts.index(a) - ls.SLACK) : max(0, at + ts.index(a) + ls.SLACK + 1)] for a in anchors)
                seen = w[max(0, at - ls.SLACK) : max(0, at + len(ts) + ls.SLACK)]
                share = sum(index.idf(x) for x in sorted(set(ts)) if x in seen) / sum(map(index.idf, set(ts)))
                if near >= min(2, len(anchors)) and f" {key} " in f" {' '.join(seen)} " and share >= ls.LEAST:
                    best[label] = max(share, best.get(label, 0))
        out.append((len(w), places, best))
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    found = ls.scan_licences(df, ls.build_index(df)).collect()
    want = plain_scan([r[1] for r in rows])
    key = lambda x: repr(x[:3])
    got = sorted(((r.doc_id, r.n_words, [tuple(p) for p in r.places], {n.label: max(m.share for m in r.notices if m.label == n.label) for n in r.notices}) for r in found), key=key)
    want = sorted(((r[0], *x) for r, x in zip(rows, want, strict=True)), key=key)
    assert [g[:3] for g in got] == [x[:3] for x in want]
    for g, x in zip(got, want, strict=True):
        assert g[3] == pytest.approx(x[3])


def test_scan_equals_a_plain_walk_on_awkward_rows(spark):
    check(spark, AWKWARD)


def test_scan_equals_a_plain_walk_on_edited_notices(spark):
    rng = random.Random(5)
    pool = [w for _, t, _ in ls.TEMPLATES for w in t.split()] + ["lorem", "Ipsum", "é", "MIT", "mit"] * 20
    rows = []
    for k in range(150):
        parts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))]
        for _ in range(rng.randint(0, 3)):
            ws = rng.choice([t for _, t, _ in ls.TEMPLATES] + [p for _, p in ls.PHRASES]).split()
            for _ in range(rng.randint(0, 2)):
                i = rng.randrange(len(ws))
                ws[i : i + rng.randint(0, 1)] = [rng.choice(pool)]
            parts += [" ".join(ws).title(), " ".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))]
        rows.append((k, rng.choice([" ", ", ", "\n"]).join(parts), 0, ""))
    check(spark, rows)


def test_query_equals_its_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(6)
    pool = [w for _, t, _ in ls.TEMPLATES for w in t.split()] + ["lorem"] * 80
    rows = [r for r in AWKWARD if r[0] != 9]
    for k in range(100, 220):
        ws = rng.choice(ls.TEMPLATES)[1].split()
        for _ in range(rng.randint(0, 4)):
            ws[rng.randrange(len(ws))] = rng.choice(pool)
        rows.append((k, " ".join([rng.choice(pool) for _ in range(9)] + ws), 0, ""))
    df = spark.createDataFrame(rows, SCHEMA)
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    found = con.execute(queries.SQL["op12_license_scan"])
    names = [d[0] for d in found.description]
    got = queries.op12_license_scan(spark, str(tmp_path)).select(*names)
    want = found.fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert len({r[names.index("score")] for r in want}) > 10


def test_empty_table_and_no_templates(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert ls.scan_licences(df, ls.build_index(df)).count() == 0
    some = spark.createDataFrame(AWKWARD, SCHEMA)
    none = ls.scan_licences(some, ls.build_index(some, templates=(), phrases=()))
    assert none.where("size(places) + size(notices) > 0").count() == 0 and none.count() == len(AWKWARD)


def test_query_contract(spark, tmp_path):
    spark.createDataFrame(AWKWARD, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_license_scan(spark, str(tmp_path))
    assert got.dtypes == [
        ("doc_id", "bigint"), ("n_words", "bigint"), ("n_base", "bigint"), ("first_word", "bigint"), ("last_word", "bigint"),
        ("base_labels", "string"), ("labels", "string"), ("score", "double"),
    ]
    rows = {r.doc_id: r for r in got.collect()}
    assert tuple(rows[6])[1:6] == (16, 4, 0, 13, "apache-2,cc-by-nc,mit") and rows[6].score == 1.0
    assert tuple(rows[1]) == (1, 0, 0, None, None, "", "", 0.0) and rows[8].labels == "gpl-3" and rows[8].n_base == 0
    assert rows[9].first_word == rows[9].last_word == 20_000 and rows[None].n_base == 2 and rows[7].base_labels == ""
    assert rows[16].labels == "bsd" and 0.75 <= rows[16].score <= 1 and rows[15].labels == ""
