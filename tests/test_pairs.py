"""Pair operators against direct walks."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quire.operators import pairs as p

TYPES = ["skills", "experience", "other", "summary"]


def walk_sections(src, out):
    """Three passes over lists, each output taking the first source it may."""
    pairs, us, uo = [], set(), set()

    def run(no, ok):
        for oi, (oh, ot) in enumerate(out):
            for si, (sh, st) in enumerate(src):
                if oi not in uo and si not in us and ok(sh, st, oh, ot):
                    pairs.append((si, oi, no))
                    us.add(si)
                    uo.add(oi)
                    break

    run(1, lambda sh, st, oh, ot: sh.lower() == oh.lower() and not (ot == "other" and st in p.GENERATED_TYPES))
    run(2, lambda sh, st, oh, ot: st == ot != "other")
    run(3, lambda sh, st, oh, ot: ot == "skills" and any(w in sh.lower() for w in p.SKILL_TITLE_WORDS))
    return sorted(pairs)


@pytest.mark.parametrize("limit", [0, 10**9])
def test_sections_pair_as_in_a_walk(spark, hot, limit):
    hot(limit)
    rnd = random.Random(7)
    one = lambda: (rnd.choice(["Alpha", "ALPHA", "Beta", "Tools", "Gamma"]), rnd.choice(TYPES))
    docs = {d: ([one() for _ in range(rnd.randint(0, 14))], [one() for _ in range(rnd.randint(0, 14))]) for d in range(60)}
    frame = lambda k: spark.createDataFrame(
        [(d, i, h, t) for d, v in docs.items() for i, (h, t) in enumerate(v[k])], "doc_id int, idx int, heading string, section_type string")
    got = {d: [] for d in docs}
    for r in p.align_sections(frame(0), frame(1)).collect():
        got[r.doc_id].append((r.si, r.oi, r["pass"]))
    assert {d: sorted(v) for d, v in got.items()} == {d: walk_sections(*v) for d, v in docs.items()}


def walk_bullets(a, b):
    um, ut = set(), set()
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            if j not in ut and x.strip().lower() == y.strip().lower():
                um.add(i)
                ut.add(j)
                break
    sims = [(SequenceMatcher(None, x.lower(), y.lower()).ratio(), i, j) for i, x in enumerate(a) for j, y in enumerate(b) if i not in um and j not in ut]
    out = []
    for s, i, j in sorted((t for t in sims if t[0] >= 0.45), reverse=True):
        if i not in um and j not in ut:
            um.add(i)
            ut.add(j)
            out.append(("changed", a[i], b[j]))
    out += [("removed", x, "") for i, x in enumerate(a) if i not in um] + [("added", "", y) for j, y in enumerate(b) if j not in ut]
    return sorted(out)


def test_bullets_pair_as_in_a_walk(spark):
    rnd = random.Random(9)
    words = ["built", "the", "billing", "service", "cut", "costs", "led", "team", "kafka", "python"]
    line = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randint(2, 6)))
    docs = {d: ([line() for _ in range(6)], [line() for _ in range(6)]) for d in range(12)}
    docs[0] = (["Same", "same", "x y z"], ["SAME", "q"])
    frame = lambda k: spark.createDataFrame([(d, i, x) for d, v in docs.items() for i, x in enumerate(v[k])], "doc_id int, idx int, text string")
    got = {d: [] for d in docs}
    for r in p.diff_bullets(frame(0), frame(1), ["doc_id"]).collect():
        got[r.doc_id].append((r.kind, r.before, r.after))
    assert {d: sorted(v) for d, v in got.items()} == {d: walk_bullets(*v) for d, v in docs.items()}


def test_roles_use_each_strategy(spark):
    src = [(1, 0, "Engineer | Acme", "2010 - 2012"), (1, 1, "Globex Data | Berlin", "2013 - 2014"), (1, 2, "(2015-2017)", ""), (1, 3, "Nothing alike", "")]
    out = [(1, 0, "Other words", ""), (1, 1, "Globex Data Services | Bonn", "2001 - 2002"), (1, 2, "engineer - acme!", ""), (1, 3, "Zeta | Rome", "2015 - 2017")]
    schema = "doc_id int, idx int, header string, dates string"
    got = {(r.si, r.oi, r.strategy) for r in p.align_roles(spark.createDataFrame(src, schema), spark.createDataFrame(out, schema)).collect()}
    assert got == {(0, 2, "exact_header"), (1, 1, "company_similarity"), (2, 3, "date_range"), (3, 0, "position")}


def test_names(spark):
    left = spark.createDataFrame([(1, "Plata Card"), (2, "ACME, Inc."), (3, "!!"), (4, "plata"), (5, "Solo")], "id int, name string")
    right = spark.createDataFrame([(1, "Acme"), (2, "plata"), (3, "Plata Card")], "ord int, rname string")
    assert {(r.id, r.match_ord) for r in p.name_match(left, right, "id", "name", "ord", "rname").collect()} == {(1, 2), (2, 1), (4, 2)}


def test_experience_diff_pairs_roles_by_position(spark):
    src = ["Experience", "Dev | A", "Built the billing service", "Jan 2019 - 2020", "Dev | B", "Kept it alive", "Education", "x"]
    out = ["Experience", "Dev | A", "- Built a billing service", "- New thing entirely", "Dev | B", "- Kept it alive", "Skills"]
    frame = lambda ls: spark.createDataFrame([(1, i, x) for i, x in enumerate(ls)], "doc_id int, line_no int, line string")
    got = {(r.role, r.kind, r.before, r.after) for r in p.experience_diff(frame(src), frame(out)).collect()}
    assert got == {(1, "changed", "Built the billing service", "Built a billing service"), (1, "added", "", "New thing entirely")}


@pytest.mark.parametrize("threshold", [0.62])
def test_container_reuse_legs(spark, threshold):
    texts = [(1, 1, "prepared work sheets"), (1, 2, "oversees engineering projects"), (1, 3, "zzz"), (1, 4, "unrelated words right here")]
    lines = [(1, 1, "She prepared work sheets daily"), (1, 2, "overseeing a lot"), (1, 3, "engineered the project plan")]
    got = p.container_reuse(spark.createDataFrame(texts, "d int, i int, t string"), spark.createDataFrame(lines, "d int, l int, s string"), "d", "i", "l", "t", "s")
    assert {r.i: r.reused for r in got.collect()} == {1: True, 2: True, 3: False, 4: False}


def test_set_similarity_guards_empty_sides(spark):
    df = spark.createDataFrame([(1, "", ""), (2, "2023Ginyard makes", "ginyard makes things")], "k int, a string, b string")
    got = {r.k: (r.jaccard, r.recall) for r in p.set_similarity(df, "k", "a", "b").collect()}
    assert got[1] == (0.0, 0.0) and got[2] == (2 / 3, 2 / 3)


def test_f1_is_symmetric_in_its_product(spark):
    df = spark.createDataFrame([(1, "a b b c", "b b b d"), (2, "", "x")], "pair_id int, src_text string, out_text string")
    a = {r.pair_id: r.f1 for r in p.token_f1(df).collect()}
    b = {r.pair_id: r.f1 for r in p.token_f1(df, src="out_text", out="src_text").collect()}
    assert a == b == {1: pytest.approx(0.5), 2: 0.0}
    assert p.token_overlap(df.withColumn("g", F.lit("")), "pair_id", "src_text", "g", "out_text", 1).filter("pair_id = 1").first().surviving == 2


def test_sequence_ratio(spark):
    rows = [(1, "Built the API", "built an api"), (2, "", "x"), (3, "same", "SAME")]
    got = {r.k: r.ratio for r in p.sequence_similarity(spark.createDataFrame(rows, "k int, a string, b string"), "k", "a", "b").collect()}
    assert got == {k: SequenceMatcher(None, a.lower(), b.lower()).ratio() for k, a, b in rows}
