"""Large and odd values that must neither end a job nor take long, and rules on nulls and missing rows."""

import time

import pytest
from pyspark.sql import functions as F

from quire.functions import text as t
from quire.operators import evals, pairs, quality, texts, usage, web
from quire.plans import lag1, ordered_scan, rank_in, running_sum
from quire.plans import scan as scan_module


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("value,column", [
    ("x" + " " * 100_000 + "y", t.strip), ("x" + " " * 100_000 + "y", t.canonical_text), ("a " * 50_000, t.unspaced), ("a " * 50_000, t.unspaced),
    ("<b>" * 50_000 + "x", web.text_without_noise), ("a" + "_" * 100_000 + "b", t.file_safe), ("word " * 50_000 + "2019", t.has_year),
])
def test_long_runs_take_no_time(spark, value, column):
    one(spark, "warm", column)
    start = time.time()
    one(spark, value, column)
    assert time.time() - start < 5


def test_distinct_keeps_first_spellings_of_long_lists(spark):
    start = time.time()
    rows = spark.createDataFrame([(["B", "a", "b", "A", "c", None],), ([str(k % 20_000) for k in range(40_000)],)], "v array<string>")
    small, large = [r.r for r in rows.select(t.distinct_ci(F.col("v")).alias("r")).collect()]
    assert small == ["B", "a", "c"] and large == [str(k) for k in range(20_000)] and time.time() - start < 20


def test_letter_spaced_headings(spark):
    cases = {"S K I L L S": "skills", "W O R K  H I S T O R Y": "work history", "A": "a", "A b Cd": "a b cd", "": "", "a\nb": "a\nb"}
    for value, want in cases.items():
        assert one(spark, value, t.unspaced) == want


def test_years(spark):
    df = spark.createDataFrame([("in 2019, x2020 1899 20211 2100é (1999)",)], "v string")
    assert df.select(t.years(F.col("v")).alias("r"), t.has_year(F.col("v")).alias("h")).first() == ([2019, 1999], True)


def next_data(spark, *values):
    df = spark.createDataFrame([(k, f'<script id="__NEXT_DATA__">{v}</script>') for k, v in enumerate(values)], "id int, html string")
    return [tuple(r.next_data) for r in web.next_data_fields(df).orderBy("id").collect()]


def test_embedded_props(spark):
    deep = '{"props":' + '{"a":' * 5000 + "1" + "}" * 5000 + "}"
    nested = lambda n: '{"props":' + '{"a":' * n + '{"description":"d"}' + "}" * n + "}"
    got = next_data(
        spark, deep, "no json", "[1]", '{"props":{"companyName":"C","job":{"jobTitle":"T","description":" <b>Do</b>   it "}}}',
        '{"props":{"a":{"description":"<p>"},"b":[{"x":1},{"employer":"E","body":"B"}]}}', nested(10), nested(11), '{"title":"t","description":"top","x":{"description":"in"}}',
    )
    none = (None, None, "")
    assert got == [none, none, none, ("C", "T", "Do\n\nit"), ("E", None, "B"), (None, None, "d"), none, (None, "t", "top")]


@pytest.mark.parametrize("limit", [100, 2])
def test_scans_treat_null_as_a_key(spark, monkeypatch, limit):
    monkeypatch.setattr(scan_module, "HOT_ROWS", limit)
    rows = [(k, i, i) for k in (None, 1, 2) for i in range(6)]
    df = spark.createDataFrame(rows, "k int, i int, v int")
    for hot_keys in (100_000, 0):
        monkeypatch.setattr(scan_module, "HOT_KEYS", hot_keys)
        got = ordered_scan(df, ["k"], ["i"], [F.floor(F.col("i") / 2)], [rank_in("n"), running_sum("s", "v"), lag1("p", "v")]).collect()
        want = [(k, i, i + 1, i * (i + 1) // 2, i - 1 if i else None) for k in (None, 1, 2) for i in range(6)]
        assert sorted(((r.k, r.i, r.n, r.s, r.p) for r in got), key=str) == sorted(want, key=str)


SECTION = "doc_id int, section_id string, semantic_type string, rewrite_policy string, preserve_heading boolean, preserve_body_structure boolean"
BLOCK = "doc_id int, section_id string, role_id string, grp string, ord int, block_id string, para_id string, semantic_type string, rewrite_policy string, is_new boolean"


def test_null_types_and_policies_break_rules(spark):
    sections = spark.createDataFrame([(1, "a", None, None, None, None), (1, "b", "education", "preserve", True, True)], SECTION)
    blocks = spark.createDataFrame([(1, "b", "", "block", 1, "b1", "p1", "education_entry", None, False)], BLOCK)
    got = {(r.section_id, r.code) for r in quality.classification_rules(sections, blocks).collect()}
    assert ("a", "SEC_INVALID_SEMANTIC_TYPE") in got and any(s == "b" and "POLICY" in c for s, c in got)


def test_block_numbers_beyond_three_digits(spark):
    sections = spark.createDataFrame([(1, "a", "education", "preserve", True, True)], SECTION)
    blocks = spark.createDataFrame([(1, "a", "", "block", k, "", f"p{k}", "x", "preserve", False) for k in range(1500)], BLOCK)
    errors = spark.createDataFrame([(1, "a", "E", "")], "doc_id int, section_id string, code string, block_id string")
    ids = [r.block_id for r in quality.downgrade_invalid(sections, blocks, errors)[1].collect()]
    assert sorted(ids) == sorted(f"blk_{k:03d}" for k in range(1, 1501))


def test_totals_are_not_mistaken_for_null_groups(spark):
    df = spark.createDataFrame([(None, "a", 1.0, False), ("t", None, 0.5, False)], "template_class string, severity string, score double, is_error boolean")
    got = sorted(((r.template_class, r.severity, r.total) for r in evals.suite_report(df).collect()), key=str)
    assert got == sorted([("(all)", "(all)", 2), (None, "(all)", 1), ("t", "(all)", 1), ("(all)", "a", 1), ("(all)", None, 1)], key=str)


def test_grades_without_keys(spark):
    df = spark.createDataFrame([("pass", 1.0), ("fail", 4.0)], "status string, score double")
    r = evals.grade_aggregate(df, []).first()
    assert (r.sample_count, r.pass_count, r.average_score, r.median_score) == (2, 1, 2.5, 2.5)
    r = evals.grade_aggregate(df.limit(0), []).first()
    assert (r.sample_count, r.average_score, r.min_score, r.median_score) == (0, 0.0, 0.0, 0.0)


def test_users_do_not_comply_without_a_current_document(spark):
    users = spark.createDataFrame([(1,), (2,)], "user_id int")
    docs = spark.createDataFrame([], "document_id int, doc_type string, status string, requires_reaccept boolean, effective_at timestamp")
    got = usage.compliance(users, docs, spark.createDataFrame([(1, "terms", 5)], "user_id int, doc_type string, document_id int")).collect()
    assert sorted((r.user_id, r.compliant) for r in got) == [(1, False), (2, False)]


def test_a_merged_title_takes_the_titles_place(spark):
    df = spark.createDataFrame([(1, 1, "Senior Engineer"), (1, 2, ""), (1, 3, "Acme | 2020"), (1, 4, "end")], "doc_id int, line_no int, line string")
    got = [(r.line_no, r.line) for r in texts.merge_title_lines(df).orderBy("line_no").collect()]
    assert got == [(1, "Senior Engineer | Acme | 2020"), (2, ""), (4, "end")]


def test_a_later_experience_section_does_not_count(spark):
    def doc(lines):
        return spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)], "doc_id int, line_no int, line string")

    tail = ["Education", "School", "Professional Experience", "Other | Two"]
    head = ["Experience", "Engineer | One", "Built a thing"]
    a, b = doc([*head, *tail, "Sold a thing"]), doc(["Experience", "Engineer | One", "- Built a thing", *tail, "- Bought quite another thing"])
    changed = [r for r in pairs.experience_diff(a, b).collect() if r.asDict().get("kind", r.asDict().get("status")) not in ("same", "unchanged", "matched")]
    assert changed == []


def test_ascii_fold_equals_the_compatibility_decomposition(spark):
    import sys
    import unicodedata

    from quire.functions import text as t

    chars = [chr(c) for c in (*range(0xD800), *range(0xE000, sys.maxunicode + 1)) if unicodedata.category(chr(c)) != "Cn" or c < 128]
    rows = [("".join(chars[i : i + 500]),) for i in range(0, len(chars), 500)] + [(c,) for c in "éﬁ½①ǅ한 ſK"] + [("",), (None,)]
    df = spark.createDataFrame(rows, "s string")
    for r in df.select("s", t.ascii_fold(F.col("s")).alias("f")).collect():
        assert r.f == (None if r.s is None else unicodedata.normalize("NFKD", r.s).encode("ascii", "ignore").decode())


def plain_posting(page):
    """A plain walk in document order: objects before their members, down to the tenth level."""
    names = {k: set(v) for k, v in web.PROP_NAMES.items()}

    def held(obj, field):
        return next((str(obj[k]) for k in web.PROP_NAMES[field] if k in names[field] and isinstance(obj.get(k), str) and obj[k]), None)

    def walk(obj, depth, company, title):
        if depth > web.PROP_DEPTH:
            return None
        if isinstance(obj, dict):
            company, title = held(obj, "company") or company, held(obj, "job_title") or title
            if (text := held(obj, "description")) and text.strip():
                return company, title, text.strip()
        for v in obj.values() if isinstance(obj, dict) else obj if isinstance(obj, list) else ():
            if (found := walk(v, depth + 1, company, title)) is not None:
                return found
        return None

    return walk(page.get("props", page), 0, None, None) or (None, None, "")


def test_props_are_searched_in_document_order(spark):
    import json
    import random

    rng = random.Random(12)

    def node(depth):
        kind = rng.random()
        if depth > 11 or kind < 0.25:
            return rng.choice([1, None, True, "text", "", '{"description":"no object"}', "[1]"])
        if kind < 0.45:
            return [node(depth + 1) for _ in range(rng.randint(0, 3))]
        keys = rng.sample(["z", "a", "m", "title", "employer", "body", "q", "company"], rng.randint(1, 4))
        return {k: (rng.choice([f"v{rng.random():.3f}", ""]) if k in ("title", "employer", "body", "company") else node(depth + 1)) for k in keys}

    pages = [{"props": {"z": {"description": "first"}, "a": {"description": "second"}}}, {"a": [[{"body": "x"}]], "title": "T"}]
    deep = {"description": "deep"}
    for _ in range(10):
        deep = {"k": deep}
    pages += [{"props": deep}, {"props": {"k": deep}}]
    while len(pages) < 60:
        top = node(0)
        if isinstance(top, dict):
            pages.append(top if rng.random() < 0.5 else {"props": top})
    df = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(pages)], "id int, raw string")
    got = {r.id: tuple(r.hit) for r in web.posting_in_props(df, "raw", "hit").collect()}
    for i, p in enumerate(pages):
        assert got[i] == plain_posting(p), (i, p)


def test_nested_noise_ends_at_its_own_close(spark):
    cases = {
        "<p>a</p><nav>x<nav>y</nav>z</nav><p>b</p>": "\na\nb\n", "<NAV class=m>x<header>y</header>z</NAV>b": "b", "a</nav>b": "a\nb", "a<nav>b": "a\nb",
        "<header><footer>x</footer>y<header>z</header>w</header>k<navigate>v</navigate>": "k\nv\n", "<script>var t='<nav>'</script>a<nav>b</nav>": "a", "<header\n>x</header >y": "y", "": "",
        "<nav>a</nav><nav>b<nav>c</nav></nav>d<footer>e": "\nd\ne",
    }
    for value, want in cases.items():
        assert one(spark, value, web.text_without_noise) == want, value
    start = time.time()
    assert one(spark, "<nav>" * 3000 + "x" + "</nav>" * 3000 + "y", web.text_without_noise) == "y" and time.time() - start < 10
