"""Lines that lie by their document: what grouping them moves, and that results stay the same."""

import os
import random

import pytest

SF = "/root/testdata/sf0.001"
SECTIONS = ["summary", "experience", "skills", "education", None]
WORDS = ["alpha", "Bravo", "delta9echo", "kafka", "at", "team", "2019", "University", "naïve", "foxtrot", "golfing", "[FirstName]", "lorem ipsum", "3kilo"]


def table(spark, rnd, n):
    rows = [(rnd.choice([None, *range(9)]), rnd.choice(SECTIONS), " ".join(rnd.choices(WORDS, k=rnd.randint(0, 6))) or None) for _ in range(n)]
    return spark.createDataFrame(rows, "doc_id long, section string, line string")


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_coherence_of_laid_lines_moves_nothing(spark):
    from quire.operators.segments import coherence_scores
    from quire.plans import cut_laid

    out = table(spark, random.Random(1), 200).withColumnRenamed("section", "section_type")
    laid = cut_laid(out.repartition(3, "doc_id"))
    of = lambda df: coherence_scores(df.filter("doc_id % 4 <> 0"), df)
    assert shuffles(of(laid)) == 0
    same(of(laid), of(out))
    assert any(r.stale_overlap == 1 for r in of(laid).collect()) and spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_injection_score_of_laid_lines_moves_nothing(spark):
    from quire.operators.segments import injection_score
    from quire.plans import cut_laid

    rows = table(spark, random.Random(2), 300)
    laid = cut_laid(rows.repartition(3, "doc_id"))
    of = lambda df: injection_score(df.filter("length(line) % 3 > 0"), df.filter("length(line) % 4 > 0"), df.filter("length(line) % 2 > 0"))
    assert shuffles(of(laid)) == 0
    same(of(laid), of(rows))


def test_injection_score_counts_sections_of_other_names(spark):
    from quire.operators.segments import injection_score

    frame = lambda *rows: spark.createDataFrame(rows, "doc_id long, section string, line string")
    target = frame((1, "education", "alpha bravo charlie delta"), (1, "skills", "kafka"), (2, "education", "alpha bravo"), (2, None, "unused"))
    rendered = frame((1, "education", "foxtrot golfing"), (1, "skills", "kafka"), (2, "education", "alpha"), (2, "summary", "bravo"))
    template = frame((1, "education", "foxtrot golfing"), (2, "education", "hotel"))
    got = {r.doc_id: (round(r.recall, 6), r.failed_sections, r.hard) for r in injection_score(target, rendered, template).collect()}
    # Document 1 still has the template's education section; in document 2 the words stand in other sections, for which there is no floor.
    assert got == {1: (0.2, 1, True), 2: (1.0, 0, False)}


def test_sections_take_one_sort_and_carry_the_text_once(spark):
    from quire.operators.segments import pre_section_prose, segment_sections

    rows = [(d, i, x) for d in range(6) for i, x in enumerate(["Jane", "A long line of prose " * 4, "Skills", "x", ["Summary", "Awards"][d % 2]])]
    lines = spark.createDataFrame(rows, "doc_id long, line_no long, line string")
    segmented = segment_sections(lines, hot=None)
    plan = segmented._jdf.queryExecution().executedPlan().toString()
    assert plan.count("+- Sort [") == 1 and plan.count("Exchange hashpartitioning") == 1
    prose = pre_section_prose(segmented)
    assert shuffles(prose) == 1
    assert {r.doc_id for r in prose.collect()} == {1, 3, 5}


@pytest.mark.skipif(not os.path.isdir(SF), reason="supplied tables are not here")
@pytest.mark.parametrize("query", ["w8_segment_sections", "w8_pre_section_prose", "w9_segment_roles", "a12_section_features", "j19_near_duplicate_lines", "j19_repeated_top_lines"])
def test_line_queries_move_line_items_only(spark, query):
    from bindings import pairs_queries, segment_queries

    plan = (segment_queries.QUERIES | pairs_queries.QUERIES)[query](spark, SF)._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
    assert len(moved) == 1 and "l_orderkey" in moved[0]


def test_resume_lines_of_equal_parts(spark, tmp_path):
    from bindings import views

    sf = str(tmp_path)
    item = lambda o, n, p, s: (o, n, p, s, 5.0 + n, 1.0, 0.02, None)
    spark.createDataFrame([item(1, 1, 7, 3), item(1, 2, 8, 3), item(2, 1, 9, 4), item(None, 1, 7, None), item(3, 1, None, 5)],
                          "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_tax double, l_shipdate date").write.parquet(f"{sf}/lineitem.parquet")
    spark.createDataFrame([(7, "a", "t", "b", 1), (7, "a2", None, "b", 2), (8, "c", "u", "d", 3), (None, "n", "n", "n", 4)],
                          "p_partkey long, p_name string, p_type string, p_brand string, p_size long").write.parquet(f"{sf}/part.parquet")
    spark.createDataFrame([(3, "S3"), (3, None), (None, "S0")], "s_suppkey long, s_name string").write.parquet(f"{sf}/supplier.parquet")
    got, want = views.view(spark, sf, "v_resume_lines"), views._plain_view(spark, sf, "v_resume_lines")
    assert got.dtypes == want.dtypes
    same(got.select("doc_id", "line_no", "line"), want.select("doc_id", "line_no", "line"))


def test_best_pairs_with_known_scores_equal_a_walk_over_all(spark):
    from difflib import SequenceMatcher

    from quire.operators.pairs import SIMILARITY, _held, _ratio, _reaches
    from quire.plans.matching import best_pairs

    rnd, scored = random.Random(3), []
    parts = ["built alpha, ", "reduced cost", "- ", "led team", "ab" * 60, "lowered", "x", ""]
    against = _ratio()

    def counting(right):
        f = against(right)
        return lambda left: scored.append(1) or f(left)

    pairs = 0
    for _ in range(300):
        sides = [[(i, "".join(rnd.choices(parts, k=rnd.randint(0, 4)))) for i in range(rnd.randint(0, 5))] for _ in range(2)]
        edges = sorted((-SequenceMatcher(None, a, b).ratio(), -x, -y, i, j) for i, (x, a) in enumerate(sides[0]) for j, (y, b) in enumerate(sides[1]))
        want, left, right = set(), set(), set()
        for v, _, _, i, j in edges:
            if -v >= SIMILARITY and i not in left and j not in right:
                want.add((i, j))
                left.add(i)
                right.add(j)
        assert set(best_pairs(*sides, counting, SIMILARITY, _held, _reaches)) == want
        pairs += len(want)
    assert len(scored) < pairs
    scored.clear()
    assert best_pairs([(1, "- built alpha, reduced")], [(1, "built alpha, lowered cost")], counting, SIMILARITY, _held, _reaches) == [(0, 0)] and not scored


def test_experience_diff_of_laid_lines_moves_nothing(spark, hot, monkeypatch):
    from quire.operators import pairs
    from quire.plans import cut_laid

    rnd = random.Random(4)
    kinds = ["Acme | x", "Beta | y", *["- Built the thing fast", "- Built the thing faster", "- Led a team"] * 4, "Education", "", None, "Jan 2019"]
    frame = lambda: spark.createDataFrame([(d, i, rnd.choice(kinds) if i else "Experience") for d in [None, *range(30)] for i in range(rnd.randint(0, 25))], "doc_id long, line_no long, line string")
    a, b = frame(), frame()
    laid = [cut_laid(x.repartition(3, "doc_id")) for x in (a, b)]
    assert shuffles(pairs.experience_diff(*laid)) == 0 and pairs.experience_diff(*laid).count() > 10
    same(pairs.experience_diff(*laid), pairs.experience_diff(a, b))
    small = pairs.experience_diff(a, b)
    monkeypatch.setattr(pairs, "GROUP_ROWS", 30)
    same(pairs.experience_diff(*laid), small)
