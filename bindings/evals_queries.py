"""Evaluation block: A3-A7, A31-A35, J4-J6, J10-J13, K2-K6, S8."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.views import sql_with, view
from quire.operators import evals as e

QUERIES: dict = {}
SQL: dict = {}


def q(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f
    return add


_W = {"truthfulness": 0.20, "role_fit": 0.20, "clarity_impact": 0.15, "overall_readiness": 0.05}
_NUM = " + ".join(f"coalesce({k} * {int(w * 100)}, 0)" for k, w in _W.items())
_DEN = " + ".join(f"CASE WHEN {k} IS NULL THEN 0 ELSE {int(w * 100)} END" for k, w in _W.items())


@q("a3_integrated_score", sql_with(
    f"SELECT position_id, floor((2 * 100 * ({_NUM}) + ({_DEN})) / (2 * ({_DEN}))) / 100 AS integrated_score FROM v_scores", "v_li", "v_scores"))
def _(s, sf):
    return e.score_rows(view(s, sf, "v_scores"), _W).select("position_id", "integrated_score")


_CENT = ", ".join(
    f"CAST(CASE WHEN count({k}) = 0 THEN 0 ELSE floor((200 * sum({k}) + count({k})) / (2 * count({k}))) END AS BIGINT) AS {k}" for k in _W)
_NUM4 = " + ".join(f"{k} * {int(w * 100)}" for k, w in _W.items())


@q("a4_score_rollup", sql_with(
    f"""SELECT run_id, positions, {", ".join(f"{k} / 100 AS avg_{k}" for k in _W)}, floor((2 * ({_NUM4}) + 60) / 120) / 100 AS integrated_score
FROM (SELECT run_id, count(*) AS positions, {_CENT} FROM v_scores GROUP BY run_id)""", "v_li", "v_scores"))
def _(s, sf):
    return e.score_rollup(view(s, sf, "v_scores"), ["run_id"], _W)


_EV = {"truthfulness": "truthfulness", "role_fit": "role_fit", "clarity": "clarity_impact", "readiness": "overall_readiness"}


@q("a31_eval_scores", sql_with(
    """SELECT position_id, round(truthfulness / 10, 4) AS truthfulness, round(role_fit / 10, 4) AS role_fit, coalesce(round(clarity_impact / 10, 4), -1) AS clarity,
coalesce(round(overall_readiness / 10, 4), -1) AS readiness,
round((truthfulness + role_fit + coalesce(clarity_impact, 0) + coalesce(overall_readiness, 0)) / (10.0 * (2 + (clarity_impact IS NOT NULL)::INT + (overall_readiness IS NOT NULL)::INT))::DOUBLE, 4) AS integrated FROM v_scores""", "v_scores"))
def _(s, sf):
    out = e.eval_scores(view(s, sf, "v_scores"), _EV, "position_id")
    return out.withColumns({c: F.coalesce(c, F.lit(-1.0)) for c in ("clarity", "readiness")})


@q("a5_run_summary", sql_with(
    """SELECT template_class, count(*) AS total, count(*) FILTER (status='pass') AS passed, count(*) FILTER (status='fail') AS failed, count(*) FILTER (status='error') AS errors
FROM v_results GROUP BY template_class""", "v_results"))
def _(s, sf):
    return e.run_summary(view(s, sf, "v_results"), ["template_class"])


_ISSUES = """SELECT case_id, CASE WHEN status = 'error' THEN 'error' ELSE 'x' END AS e,
case_id % 3 = 0 AS i1, case_id % 5 = 0 AS i2, score < 0.5 AS i3 FROM v_results"""


@q("a5_issue_frequency", sql_with(
    """SELECT issue, n FROM (SELECT 'heading_missing' AS issue, count(*) AS n FROM v_results WHERE case_id % 3 = 0
UNION ALL SELECT 'page_break_change', count(*) FROM v_results WHERE case_id % 5 = 0 UNION ALL SELECT 'missing_text', count(*) FROM v_results WHERE score < 0.5)""", "v_results"))
def _(s, sf):
    r = view(s, sf, "v_results").withColumn("issues", F.array_compact(F.array(
        F.when(F.col("case_id") % 3 == 0, "heading_missing"), F.when(F.col("case_id") % 5 == 0, "page_break_change"),
        F.when(F.col("score") < 0.5, "missing_text"))))
    return e.issue_frequency(r)


@q("a6_suite_report", sql_with(
    """SELECT CASE WHEN grouping(template_class) = 1 THEN '(all)' ELSE template_class END AS template_class, CASE WHEN grouping(severity) = 1 THEN '(all)' ELSE severity END AS severity, count(*) AS total,
count(*) FILTER (NOT is_error AND score >= 0.70) AS passed, count(*) FILTER (NOT is_error AND score < 0.70) AS failed, count(*) FILTER (is_error) AS errors,
round(coalesce(CAST(sum(CAST(score AS DECIMAL(18,6))) FILTER (NOT is_error) AS DOUBLE) / nullif(count(*) FILTER (NOT is_error), 0), 0), 6) AS average_score
FROM v_results GROUP BY GROUPING SETS ((), (template_class), (severity))""", "v_results"))
def _(s, sf):
    return e.suite_report(view(s, sf, "v_results"))


@q("a6_class_frequency", sql_with(
    """SELECT failure_class, count(*) AS n FROM (SELECT unnest(CASE WHEN score < 0.3 THEN ['A', 'D'] WHEN score < 0.7 THEN ['C'] WHEN is_error THEN ['F'] ELSE [] END) AS failure_class FROM v_results) GROUP BY 1""", "v_results"))
def _(s, sf):
    r = view(s, sf, "v_results").withColumn("failure_classes", F.expr(
        "CASE WHEN score < 0.3 THEN array('A','D') WHEN score < 0.7 THEN array('C') WHEN is_error THEN array('F') ELSE array() END"))
    return e.class_frequency(r)


_GRADES = """SELECT case_id, template_class, CAST(case_id * 7919 % 1000 AS DOUBLE) / 10 AS score,
CASE WHEN case_id % 17 = 0 THEN 'hard_fail' WHEN case_id * 7919 % 1000 >= 750 THEN 'pass' WHEN case_id * 7919 % 1000 >= 600 THEN 'warning' ELSE 'fail' END AS status FROM v_results"""


def _grades(s, sf):
    view(s, sf, "v_results").createOrReplaceTempView("quire_v_results")
    return s.sql(_GRADES.replace("FROM v_results", "FROM quire_v_results"))


@q("a7_grade_aggregate", sql_with(
    """SELECT template_class, count(*) AS sample_count, count(*) FILTER (status='pass') AS pass_count, count(*) FILTER (status='warning') AS warning_count,
count(*) FILTER (status IN ('fail','hard_fail')) AS fail_count, count(*) FILTER (status='hard_fail') AS hard_fail_count,
round(CAST(sum(CAST(score AS DECIMAL(18,6))) AS DOUBLE) / count(*), 6) AS average_score, min(score) AS min_score, max(score) AS max_score, round(median(score), 6) AS median_score FROM g GROUP BY template_class""",
    "v_results", extra=f"g AS ({_GRADES})"))
def _(s, sf):
    return e.grade_aggregate(_grades(s, sf), ["template_class"])


_TRANS = """SELECT case_id, status, coalesce(base, '') AS base_status, CASE WHEN base = 'pass' AND status IN ('fail','error') THEN 'regression' WHEN base IN ('fail','error') AND status = 'pass' THEN 'improvement'
WHEN base = 'pass' AND status = 'pass' THEN 'still_passing' WHEN base IS NOT NULL THEN 'still_failing' ELSE 'none' END AS transition
FROM (SELECT *, CASE WHEN in_baseline THEN base_status END AS base FROM v_results)"""


def _transitions(s, sf):
    r = view(s, sf, "v_results")
    base = r.filter("in_baseline").select("case_id", F.col("base_status").alias("status"))
    return e.baseline_transitions(r.select("case_id", "status"), base, "case_id")


@q("j4_baseline_transitions", sql_with(_TRANS, "v_results"))
def _(s, sf):
    return _transitions(s, sf).withColumn("base_status", F.coalesce("base_status", F.lit("")))


@q("j5_score_regressions", sql_with(
    """SELECT case_id, prev AS score_before, score AS score_after, delta AS score_delta, CASE WHEN delta <= -15 OR (prev >= 75 AND status IN ('fail','hard_fail')) THEN 'SEVERE_REGRESSION' ELSE 'REGRESSION' END AS regression_class,
CASE WHEN prev >= 75 THEN 'pass' WHEN prev >= 60 THEN 'warning' ELSE 'fail' END AS status_before, status AS status_after
FROM (SELECT g.*, CAST(r.case_id * 104729 % 1000 AS DOUBLE) / 10 AS prev, g.score - CAST(r.case_id * 104729 % 1000 AS DOUBLE) / 10 AS delta FROM g JOIN v_results r USING (case_id) WHERE r.in_baseline) WHERE delta <= -5""",
    "v_results", extra=f"g AS ({_GRADES})"))
def _(s, sf):
    base = view(s, sf, "v_results").filter("in_baseline").selectExpr("case_id", "CAST(case_id * 104729 % 1000 AS DOUBLE) / 10 AS score")
    return e.score_regressions(_grades(s, sf), base, "case_id")


@q("j6_promotion_gate", sql_with(
    "SELECT count(*) FILTER (transition = 'regression') AS regressions, count(*) FILTER (transition = 'regression') = 0 AS may_promote FROM t",
    "v_results", extra=f"t AS ({_TRANS})"))
def _(s, sf):
    return e.promotion_gate(_transitions(s, sf))


@q("k2_worst_k", sql_with("SELECT case_id, score FROM v_results WHERE NOT is_error ORDER BY score, case_id LIMIT 5", "v_results"))
def _(s, sf):
    return e.worst_k(view(s, sf, "v_results").filter("NOT is_error").select("case_id", "score"), "score", "case_id")


@q("k3_top_values", sql_with("SELECT n_chars, count(*) AS n FROM v_blocks GROUP BY 1 ORDER BY n DESC, n_chars LIMIT 10", "v_blocks"))
def _(s, sf):
    return e.top_values(view(s, sf, "v_blocks"), "n_chars", 10)


@q("k6_top_candidates", sql_with("SELECT position_id, (coalesce(truthfulness, 0) * 2000 + coalesce(role_fit, 0) * 2000 + coalesce(clarity_impact, 0) * 1500 + coalesce(overall_readiness, 0) * 500) / 10000 AS weight FROM v_scores ORDER BY weight DESC, position_id LIMIT 20", "v_scores"))
def _(s, sf):
    return e.top_candidates(view(s, sf, "v_scores"), _W, "position_id", 20).select("position_id", "weight")


@q("k4_examples_per_group", sql_with(
    "SELECT status, case_id, nth FROM (SELECT status, case_id, row_number() OVER (PARTITION BY status ORDER BY case_id) AS nth FROM v_results) WHERE nth <= 8", "v_results"))
def _(s, sf):
    r = view(s, sf, "v_results").select("status", "case_id")
    return e.examples_per_group(r, "status", "case_id", F.expr("case_id div 4096"))


@q("k5_triage_order", sql_with(
    "SELECT case_id, status, score, list_position(['error','fail','pass'], status) AS status_rank FROM v_results", "v_results"))
def _(s, sf):
    return e.triage_order(view(s, sf, "v_results").select("case_id", "status", "score"), ["error", "fail", "pass"], ["score"], "case_id")


_KEY = "left(sha256(concat(source, coalesce(text, ''), 'judge-1', 'v1')), 16)"


def _keys(s, sf):
    d = view(s, sf, "documents")
    return d.withColumn("cache_key", e.cache_key(F.col("source"), F.col("text"), F.lit("judge-1"), F.lit("v1"))).select("doc_id", "cache_key")


@q("j10_cache_split", f"""SELECT doc_id, {_KEY} AS cache_key, {_KEY} IN (SELECT {_KEY} FROM documents WHERE doc_id % 2 = 0) AS cached FROM documents""")
def _(s, sf):
    k = _keys(s, sf)
    return e.cache_split(k, k.filter("doc_id % 2 = 0"))


@q("j11_density_check", sql_with(
    """SELECT p.doc_id, count(*) FILTER (p.new_len > greatest(200, o.old_len * 2)) AS density_overflow_count,
count(*) FILTER (p.ord % 3 = 0 AND p.new_len > o.old_len * 1.3 AND o.old_len > 0) AS multi_bullet_packing_count
FROM v_paras p JOIN (SELECT doc_id, para_id, arg_max(old_len, ord) AS old_len FROM v_paras WHERE para_id <> '' GROUP BY ALL) o ON o.doc_id = p.doc_id AND o.para_id = p.para_id WHERE p.para_id <> '' GROUP BY p.doc_id""", "v_paras"))
def _(s, sf):
    p = view(s, sf, "v_paras")
    return e.density_check(p.select("doc_id", "para_id", "ord", "old_len"),
                           p.select("doc_id", "para_id", "new_len", (F.col("ord") % 3 == 0).alias("has_newline")))


@q("j12_top_expansions", sql_with(
    "SELECT doc_id, ord, old_len, new_len, round(new_len / greatest(old_len, 1), 6) AS ratio FROM v_paras WHERE new_len / greatest(old_len, 1) > 1.01 ORDER BY ratio DESC, doc_id, ord LIMIT 10", "v_paras"))
def _(s, sf):
    p = view(s, sf, "v_paras")
    return e.top_expansions(p.select("doc_id", "ord", "old_len"), p.select("doc_id", "ord", "new_len"), ["doc_id", "ord"])


_MEMBERS = """SELECT doc_id, para_id, 'layout' AS place FROM v_paras WHERE ord % 5 <> 0 UNION ALL
SELECT doc_id, para_id, CASE WHEN parser_semantic = 'paragraph' THEN 'body' ELSE 'role' END FROM v_paras WHERE ord % 7 <> 0"""


@q("j13_id_consistency", sql_with(
    """SELECT doc_id, count(*) FILTER (l AND NOT (b OR r)) AS layout_only, count(*) FILTER (NOT l AND (b OR r)) AS model_only, count(*) FILTER (b AND r) AS split_brain
FROM (SELECT doc_id, para_id, bool_or(place='layout') AS l, bool_or(place='body') AS b, bool_or(place='role') AS r FROM m WHERE para_id <> '' GROUP BY ALL) GROUP BY doc_id""",
    "v_paras", extra=f"m AS ({_MEMBERS})"))
def _(s, sf):
    view(s, sf, "v_paras").createOrReplaceTempView("quire_v_paras")
    return e.id_consistency(s.sql(_MEMBERS.replace("FROM v_paras", "FROM quire_v_paras")))


# Metric rows derived from the result keys.
METRICS = """SELECT case_id, CAST(case_id * 31 % 101 AS DOUBLE) / 100 AS topology, CAST(case_id * 17 % 101 AS DOUBLE) / 100 AS sections,
CAST(case_id * 13 % 91 AS DOUBLE) / 100 AS stale_ratio, CAST(case_id % 7 AS INT) - 3 AS page_delta, CAST(case_id % 5 AS DOUBLE) / 4 AS leakage,
CAST(case_id % 4 + 1 AS DOUBLE) / 4 AS style, CAST(case_id * 37 % 1000 AS DOUBLE) / 1000 AS token_f1, CAST(case_id % 4 AS INT) AS missing_headings, CAST(case_id % 9 AS INT) - 2 AS bullet_delta,
case_id % 3 <> 0 AS page_count_match, CASE WHEN case_id % 6 <> 0 THEN CAST(case_id * 11 % 60 AS DOUBLE) / 1000 END AS indent_delta, CASE WHEN case_id % 8 <> 0 THEN CAST(case_id * 7 % 50 AS DOUBLE) / 1000 END AS gap_delta,
CAST(case_id % 2 AS INT) + 1 AS src_columns, CAST(case_id % 3 AS INT) % 2 + 1 AS out_columns, CASE case_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'none' END AS column_confidence,
CASE case_id % 5 WHEN 0 THEN 'sidebar_left' WHEN 1 THEN 'linear_single_column' WHEN 2 THEN 'unknown' ELSE 'mixed_or_ambiguous' END AS src_topology,
CASE case_id % 4 WHEN 0 THEN 'sidebar_left' WHEN 1 THEN 'linear_single_column' ELSE 'mixed_or_ambiguous' END AS out_topology,
case_id % 10 = 0 AS hard_fail, case_id % 6 = 1 AS soft_fail
FROM v_results"""


def metrics(s, sf):
    view(s, sf, "v_results").createOrReplaceTempView("quire_v_results")
    return s.sql(METRICS.replace("FROM v_results", "FROM quire_v_results"))


def _c(x):
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"


_OVER = f"CASE WHEN page_delta <= 0 THEN 0.0::DOUBLE ELSE {_c('page_delta * 0.40::DOUBLE')} END"
_DUP = _c("stale_ratio * 1.5::DOUBLE")


@q("a32_composite_layout", sql_with(
    f"""SELECT case_id, round({_OVER}, 6) AS overflow_penalty, round({_DUP}, 6) AS duplication_penalty,
round({_c(f"topology * 0.25::DOUBLE + sections * 0.25::DOUBLE + (1 - {_OVER}) * 0.15::DOUBLE + (1 - {_DUP}) * 0.20::DOUBLE + (1 - leakage) * 0.05::DOUBLE + style * 0.10::DOUBLE")}, 6) AS composite FROM m""",
    "v_results", extra=f"m AS ({METRICS})"))
def _(s, sf):
    out = e.composite_layout(metrics(s, sf))
    return out.select("case_id", *[F.round(c, 6).alias(c) for c in ("overflow_penalty", "duplication_penalty", "composite")])


_GRADE_COLS = {
    "ir_score": "CAST(case_id * 3 % 101 AS DOUBLE)", "content_injection_score": "CASE WHEN case_id % 4 <> 0 THEN CAST(case_id * 5 % 101 AS DOUBLE) END",
    "page_count_score": "CASE WHEN case_id % 9 <> 0 THEN 100.0::DOUBLE END", "blank_page_score": "CASE WHEN case_id % 7 <> 0 THEN 60.0::DOUBLE END",
    "region_score": "CASE WHEN case_id % 5 <> 0 THEN CAST(case_id * 7 % 101 AS DOUBLE) END", "container_score": "CAST(NULL AS DOUBLE)",
    "density_score": "CAST(50 + case_id % 51 AS DOUBLE)", "sparse_page_score": "CASE WHEN case_id % 2 = 0 THEN 100.0::DOUBLE END",
}


@q("a33_composite_grade", sql_with(
    """SELECT case_id, composite, CASE WHEN hard_fail THEN 'hard_fail' WHEN composite >= 75 THEN 'pass' WHEN composite >= 60 THEN 'warning' ELSE 'fail' END AS status FROM (
SELECT *, round(CASE WHEN hard_fail THEN least(t, 30.0) WHEN soft_fail THEN least(t, 74.0) ELSE t END, 6) AS composite FROM (
SELECT *, ir_score * 0.12::DOUBLE + coalesce(content_injection_score, 80) * 0.15::DOUBLE + coalesce(page_count_score, 80) * 0.07::DOUBLE + coalesce(blank_page_score, 100) * 0.08::DOUBLE + coalesce(region_score, 80) * 0.15::DOUBLE
 + coalesce(container_score, 80) * 0.08::DOUBLE + coalesce(density_score, 80) * 0.10::DOUBLE + coalesce(sparse_page_score, 80) * 0.25::DOUBLE AS t
FROM (SELECT *, """ + ", ".join(f"{v} AS {k}" for k, v in _GRADE_COLS.items()) + " FROM m)))", "v_results", extra=f"m AS ({METRICS})"))
def _(s, sf):
    m = metrics(s, sf).selectExpr("*", *[f"{v.replace('::DOUBLE', 'D')} AS {k}" for k, v in _GRADE_COLS.items()])
    m = m.withColumn("failure_classes", F.when(F.col("soft_fail"), F.array(F.lit("C_SUMMARY_MISSING"))).otherwise(F.array(F.lit("A_OTHER"))))
    return e.composite_grade(m).select("case_id", "composite", "status")


@q("a34_failure_classes", sql_with(
    f"""SELECT case_id, array_to_string(list_distinct_ordered, ',') AS classes FROM (SELECT case_id, list_filter(l, lambda x, i: x IS NOT NULL AND list_position(l, x) = i) AS list_distinct_ordered FROM (
SELECT case_id, [CASE WHEN (src_topology NOT IN ('unknown','mixed_or_ambiguous') AND out_topology NOT IN ('unknown','mixed_or_ambiguous') AND src_topology <> out_topology) OR (src_columns <> out_columns AND column_confidence = 'high') OR (topology < 0.5 AND column_confidence <> 'none') THEN 'F_TOPOLOGY_COLLAPSE' END,
CASE WHEN case_id % 11 = 0 OR page_delta > 0 OR {_OVER} >= 0.5 THEN 'C_OVERFLOW_FIT' END,
CASE WHEN {_DUP} >= 0.40 OR case_id % 13 = 0 THEN 'D_DUPLICATION_STALE' END,
CASE WHEN case_id % 5 <> 0 AND missing_headings > 2 THEN 'A_SECTION_BOUNDARY' END,
CASE WHEN case_id % 5 <> 0 AND case_id % 8 = 3 THEN 'B_CONTAINER_ASSIGNMENT' END,
CASE WHEN case_id % 5 <> 0 AND case_id % 4 >= 2 THEN 'F_TOPOLOGY_COLLAPSE' END,
CASE WHEN case_id % 5 = 0 AND (case_id % 6) / nullif(case_id % 7, 0) < 0.70 THEN 'A_SECTION_BOUNDARY' END,
CASE WHEN style < 0.60 THEN 'E_STYLE_PROTOTYPE' END, CASE WHEN leakage >= 0.25 THEN 'B_CONTAINER_ASSIGNMENT' END] AS l FROM m))""",
    "v_results", extra=f"m AS ({METRICS})"))
def _(s, sf):
    m = e.composite_layout(metrics(s, sf)).selectExpr(
        "*", "topology AS topology_preservation", "style AS style_score", "leakage AS leakage_penalty", "case_id % 11 = 0 AS high_stress",
        "case_id % 13 = 0 AS stale_section", "case_id % 5 <> 0 AS has_placement", "missing_headings - 2 AS missing_sections",
        "CASE WHEN case_id % 8 = 3 THEN 1 ELSE 0 END AS region_mismatches", "case_id % 4 AS bad_vertical",
        "case_id % 6 AS headings_found", "case_id % 7 AS headings_expected")
    return e.failure_classes(m).select("case_id", F.array_join("classes", ",").alias("classes"))


_TEXT = _c(f"{_c('token_f1')} - missing_headings * 0.10::DOUBLE")
_STRUCT = _c("1.0::DOUBLE - missing_headings * 0.15::DOUBLE - CASE WHEN bullet_delta > 0 THEN least(0.30::DOUBLE, bullet_delta * 0.05::DOUBLE) ELSE 0 END")
_LAY = _c("1.0::DOUBLE - CASE WHEN page_count_match THEN 0 ELSE 0.30::DOUBLE END - coalesce(CASE WHEN indent_delta IS NULL THEN 0 ELSE least(0.25::DOUBLE, greatest(0.0::DOUBLE, indent_delta - 0.020::DOUBLE) * 10) END, 0)"
          " - CASE WHEN gap_delta IS NULL THEN 0 ELSE least(0.15::DOUBLE, greatest(0.0::DOUBLE, gap_delta - 0.020::DOUBLE) * 7.5::DOUBLE) END - CASE WHEN src_columns <> out_columns AND column_confidence = 'high' THEN 0.20::DOUBLE ELSE 0 END")


@q("a35_fidelity_scores", sql_with(
    f"""SELECT case_id, round({_TEXT}, 6) AS text_score, round({_STRUCT}, 6) AS structure_score, round({_LAY}, 6) AS layout_score,
round({_TEXT} * 0.40::DOUBLE + {_STRUCT} * 0.30::DOUBLE + {_LAY} * 0.30::DOUBLE, 6) AS overall_score FROM m""", "v_results", extra=f"m AS ({METRICS})"))
def _(s, sf):
    cols = ("text_score", "structure_score", "layout_score", "overall_score")
    return e.fidelity_scores(metrics(s, sf)).select("case_id", *[F.round(c, 6).alias(c) for c in cols])


@q("s8_upsert", """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY side DESC, o_orderkey DESC) AS rn FROM (
SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice, 0 AS side FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1
UNION ALL SELECT o_custkey, o_orderkey, o_totalprice, 1 FROM orders WHERE o_orderkey % 3 = 0)) WHERE rn = 1""")
def _(s, sf):
    o = view(s, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    target = o.filter("o_orderkey % 3 <> 0").groupBy("o_custkey").agg(
        F.max_by(F.struct("o_orderkey", "o_totalprice"), "o_orderkey").alias("r")).select("o_custkey", "r.*")
    return e.upsert(target, o.filter("o_orderkey % 3 = 0"), ["o_custkey"], ["o_orderkey"])
