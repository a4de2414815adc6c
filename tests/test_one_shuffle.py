"""Readers of many short documents: what they shuffle, and that results stay the same."""

import random


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_merged_titles_take_one_shuffle_of_the_lines(spark, hot):
    from quire.operators.texts import merge_title_lines

    rnd = random.Random(12)
    kinds = ["Lead Builder", "Lead Builder.", "Acme | 2019", "Acme | x", "", "  ", "- Built it", None, "SHOUT"]
    rows = [(d, i, rnd.choice(kinds)) for d in range(30) for i in range(rnd.randint(1, 20))]

    def merged(lines):  # one document
        out, prev = [], None
        for i, text in lines:
            s = (text or "").strip()
            if s == "Acme | 2019" and prev and prev[1] == "Lead Builder":
                out = [o for o in out if o[0] != prev[0]] + [(prev[0], f"{prev[1]} | {s}", True)]
            else:
                out.append((i, text, False))
            prev = (i, s) if s else prev
        return out

    want = sorted(str((d, *r)) for d in range(30) for r in merged([x[1:] for x in rows if x[0] == d]))
    df = spark.createDataFrame(rows, "doc_id long, line_no long, line string")
    out = merge_title_lines(df)
    plan = plan_of(out)
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    run = lambda x: sorted(str((r.doc_id, r.line_no, r.line, r.merged)) for r in x.collect())
    assert run(out) == want and any("True" in w for w in want)
    hot(5)
    assert run(merge_title_lines(df)) == want


def test_section_types_are_joined_to_blocks_once(spark):
    from quire.operators import quality as k

    rnd = random.Random(18)
    kinds = ["summary", "skills", "education", "experience", "projects", "other", "bogus"]
    sec = spark.createDataFrame(
        [(d, str(s), rnd.choice(kinds), rnd.choice(["preserve", "rewrite_body", None]), rnd.random() < 0.5, None) for d in range(9) for s in range(4)],
        "doc_id long, section_id string, semantic_type string, rewrite_policy string, preserve_heading boolean, preserve_body_structure boolean")
    blk = spark.createDataFrame(
        [(d, str(s), "", rnd.choice(["block", "header", "meta", "body"]), i, f"b{i}", rnd.choice(["", "p1", f"p{i}"]),
          rnd.choice(["summary_paragraph", "project_entry", "role_header", "x"]), rnd.choice(["preserve", "rewrite_text"]), rnd.choice([True, False, None]))
         for d in range(10) for s in range(5) for i in range(4)],
        "doc_id long, section_id string, role_id string, grp string, ord long, block_id string, para_id string, semantic_type string, rewrite_policy string, is_new boolean")
    typed = k.with_section_type(sec, blk)
    run = lambda x: sorted(map(str, x.collect()))
    before = k.classification_rules(sec, typed)
    assert run(before) == run(k.classification_rules(sec, blk)) != []
    fixed, again = k.autocorrect_blocks(sec, typed)[1], k.autocorrect_blocks(sec, blk)[1]
    assert run(fixed.drop("section_type")) == run(again) and set(fixed.columns) == {*again.columns, "section_type"}
    after = k.classification_rules(sec, fixed)
    assert run(after) == run(k.classification_rules(sec, again))
    joins = lambda x: x._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins(before) < joins(k.classification_rules(sec, blk)) and joins(after) < joins(k.classification_rules(sec, again))


def test_horizontal_occupancy_adds_whole_numbers(spark):
    from quire.operators.layout import horizontal_occupancy

    rnd = random.Random(25)
    rows = [(rnd.randint(1, 3), 1, 612.0, 792.0, x, x + rnd.randint(1, 300), y, y + rnd.randint(1, 60))
            for x, y in ((float(rnd.randint(0, 500)), float(rnd.randint(0, 700))) for _ in range(60))]
    df = spark.createDataFrame(rows, "doc_id long, page long, page_w double, page_h double, x0 double, x1 double, y0 double, y1 double")
    out = horizontal_occupancy(df)
    assert "decimal" not in plan_of(out).lower()
    want = {}
    for d, _, w, h, x0, x1, y0, y1 in rows:
        for i in range(20):
            over = max(0.0, min(x1 / w, 1.0, (i + 1) / 20) - max(x0 / w, i / 20)) * (min(y1 / h, 1.0) - y0 / h)
            want[d, i] = want.get((d, i), 0.0) + over * 20
    got = {(r.doc_id, r.bin): r.occupancy for r in out.collect()}
    assert set(got) == {k for k, v in want.items() if v > 1e-11} and all(abs(v - min(1.0, want[k])) < 1e-9 for k, v in got.items())


def test_detectors_read_the_paragraphs_few_times(spark):
    from quire.operators import quality as k

    docs = spark.createDataFrame([(1, True, False, True), (2, False, True, False)], "doc_id long, label_column_fixed boolean, table_layout_fixed boolean, table_layout_aborted boolean")
    sec = spark.createDataFrame([(d, s, n, c) for d in (1, 2) for s, n, c in (("s0", "Experience", "experience"), ("s1", "Certificates held", "certifications"))],
                                "doc_id long, section_id string, raw_title string, semantic_type string")
    text = ["me@example.com", "Education", "- a bullet", "alpha beta gamma delta epsilon zeta", "Bachelor of Arts at Night", "Phone: 555 0100 BSc of things"]
    paras = spark.createDataFrame([(d, s, f"p{i}", i, x, "paragraph") for d in (1, 2) for s in ("s0", "s1") for i, x in enumerate(text)],
                                  "doc_id long, section_id string, para_id string, ord long, text string, parser_semantic string")
    members = spark.createDataFrame([(1, "s0", "r", "bullet", "p0")], "doc_id long, section_id string, role_id string, kind string, para_id string")
    out = k.diagnostic_detectors(docs, sec, paras, members)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert sum("ord#" in line for line in plan.splitlines() if "LogicalRDD" in line) <= 6
    got = {(r.doc_id, r.code, r.section_id, r.para_id) for r in out.collect()}
    assert {x[3] for x in got if x[:3] == (2, "TABLE_CONTACT_INSIDE_EXPERIENCE", "s0")} == {"p0", "p5"}
    assert {x[3] for x in got if x[:3] == (2, "TABLE_EDUCATION_INSIDE_EXPERIENCE", "s0")} == {"p4", "p5"}
    assert (1, "MERGED_SECTION_SUSPECTED", "s0", "p1") in got and (1, "HEADING_NOT_RECOGNIZED", "s0", "p1") in got
    assert (1, "TABLE_CONTACT_INSIDE_EXPERIENCE", "s0", "p0") not in got and (1, "BULLET_NOT_RECOGNIZED", "s1", "p2") in got
    assert (2, "TABLE_SKILLS_INSIDE_NON_SKILLS_SECTION", "s1", "p3") in got
