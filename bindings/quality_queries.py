"""Rule-engine block: P7, P10, P11, A8, A9, A23, A24, F29-F33, K5, U2, U4."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.evals_queries import METRICS, metrics
from bindings.views import sql_with, view
from quire.operators import quality as k
from quire.operators.evals import top_values, triage_order
from quire.plans import cut

QUERIES: dict = {}
SQL: dict = {}


def q(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f
    return add


def vals(rows):
    def one(v):
        return "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows) + ")"


def inl(names):
    return "(" + ", ".join("'" + n + "'" for n in names) + ")"


_M2 = "SELECT *, case_id % 9 <> 0 AS page_size_match, CAST(case_id % 3 AS INT) AS extra_headings, CASE WHEN case_id % 4 = 0 THEN CAST(case_id % 100 AS DOUBLE) / 1000 END AS shift_delta FROM m"


@q("p7_issue_flags", sql_with("""SELECT case_id, n_issues, high, CASE WHEN high > 0 THEN 'fail' ELSE 'pass' END AS verdict FROM (SELECT case_id,
(token_f1 < 0.9)::INT + missing_headings + extra_headings + (bullet_delta > 2)::INT + (NOT page_count_match)::INT + (NOT page_size_match)::INT + coalesce(indent_delta > 0.020, false)::INT + coalesce(gap_delta > 0.020, false)::INT + coalesce(shift_delta > 0.060, false)::INT + (src_columns <> out_columns AND column_confidence = 'high')::INT AS n_issues,
(token_f1 < 0.9)::INT + missing_headings + (NOT page_count_match)::INT + coalesce(indent_delta > 0.020, false)::INT + (src_columns <> out_columns AND column_confidence = 'high')::INT AS high FROM m2)""", "v_results", extra=f"m AS ({METRICS}), m2 AS ({_M2})"))
def _(s, sf):
    m = metrics(s, sf).selectExpr("*", "case_id % 9 <> 0 AS page_size_match", "CAST(case_id % 3 AS INT) AS extra_headings",
                                  "CASE WHEN case_id % 4 = 0 THEN CAST(case_id % 100 AS DOUBLE) / 1000 END AS shift_delta")
    d = k.issue_flags(m, "case_id")
    return d.select("case_id", F.size("issues").alias("n_issues"), F.size(F.filter("issues", lambda i: i["severity"] == "high")).alias("high"), "verdict")


@q("p10_threshold_check", sql_with("""SELECT case_id, array_to_string(list_filter(l, lambda x: x IS NOT NULL), ',') AS broken, len(list_filter(l, lambda x: x IS NOT NULL)) = 0 AS passed FROM (SELECT case_id, [CASE WHEN score < CASE WHEN case_id % 3 = 0 THEN 0.7 ELSE 0.4 END THEN 'min_layout_score' END,
CASE WHEN case_id % 4 = 0 AND base_score < 0.5 THEN 'min_topology_preservation' END, NULL, CASE WHEN base_score < CASE WHEN case_id % 5 = 0 THEN 0.35 ELSE 0.4 END THEN 'min_section_coherence' END,
CASE WHEN case_id % 9 > CASE WHEN case_id % 6 = 0 THEN 3 ELSE 6 END THEN 'max_high_stress_sections' END, CASE WHEN score < 0.20 THEN 'catastrophic_floor' END] AS l FROM v_results)""", "v_results"))
def _(s, sf):
    r = view(s, sf, "v_results")
    res = r.selectExpr("case_id", "score AS layout", "base_score AS topology", "base_score AS placement", "base_score AS coherence", "case_id % 9 AS high_stress")
    cases = r.filter("case_id % 3 = 0 OR case_id % 4 = 0 OR case_id % 5 = 0").selectExpr(
        "case_id", "CASE WHEN case_id % 3 = 0 THEN 0.7D END AS min_layout_score", "CASE WHEN case_id % 4 = 0 THEN 0.5D END AS min_topology_preservation",
        "CAST(NULL AS DOUBLE) AS min_section_placement", "CASE WHEN case_id % 5 = 0 THEN 0.35D END AS min_section_coherence", "CASE WHEN case_id % 6 = 0 THEN 3 END AS max_high_stress_sections")
    return k.threshold_check(res, cases)


_RAW = """SELECT position_id, CASE WHEN position_id % 23 = 0 THEN '[1]' WHEN position_id % 29 = 0 THEN '{"scores": 3}' ELSE concat('{"scores":{"truthfulness":{"score":', CAST(truthfulness AS STRING), '}',
CASE WHEN position_id % 5 = 0 THEN ',"role_fit":7' WHEN position_id % 7 = 0 THEN '' WHEN position_id % 3 = 0 THEN concat(',"role_fit":{"score":"', CAST(role_fit AS STRING), '"}') ELSE concat(',"role_fit":{"score":', CAST(role_fit AS STRING), '}') END,
CASE WHEN clarity_impact IS NULL THEN '' ELSE concat(',"clarity_impact":{"score":', CAST(clarity_impact AS STRING), CASE WHEN position_id % 11 = 0 THEN '.5' ELSE '' END, '}') END,
CASE WHEN overall_readiness IS NULL THEN '' ELSE concat(',"overall_readiness":{"score":', CAST(overall_readiness + CASE WHEN position_id % 13 = 0 THEN 9 ELSE 0 END AS STRING), '}') END, '}}') END AS raw FROM v_scores"""
_REQ = ("truthfulness", "role_fit", "clarity_impact", "overall_readiness")


def _chk(n):
    return (f"CASE WHEN json_type(raw, '$.scores.{n}') IS NULL THEN 'missing score key: {n}' WHEN json_type(raw, '$.scores.{n}') <> 'OBJECT' THEN 'scores.{n} is not a dict' "
            f"WHEN NOT coalesce(json_type(raw, '$.scores.{n}.score') IN ('UBIGINT', 'BIGINT') AND CAST(raw ->> '$.scores.{n}.score' AS DOUBLE) BETWEEN 1 AND 10, false) THEN 'scores.{n}.score must be int 1-10' END")


@q("p11_validate_scores", sql_with(f"""SELECT position_id, array_to_string(e, '; ') AS errors, CAST(len(e) AS INT) AS n_errors, len(e) = 0 AS valid FROM (SELECT position_id, CASE WHEN json_type(raw) <> 'OBJECT' THEN ['response is not a dict'] WHEN json_type(raw, '$.scores') <> 'OBJECT' THEN ['scores is not a dict']
ELSE list_filter([{', '.join(_chk(n) for n in _REQ)}], lambda x: x IS NOT NULL) END AS e FROM r)""", "v_scores", extra=f"r AS ({_RAW})"))
def _(s, sf):
    view(s, sf, "v_scores").createOrReplaceTempView("quire_v_scores")
    return k.validate_scores(s.sql(_RAW.replace("FROM v_scores", "FROM quire_v_scores")), "position_id", "raw", _REQ)


BLK = """SELECT l_orderkey % 3000 AS doc_id, CAST(l_orderkey AS STRING) AS section_id, CASE WHEN l_orderkey % 7 IN (4, 5) AND ln % 5 <> 0 THEN concat('r', CAST(ln % 2 AS STRING)) ELSE '' END AS role_id,
CASE WHEN l_orderkey % 7 = 4 OR (l_orderkey % 7 = 5 AND l_orderkey % 2 = 0) THEN CASE ln % 5 WHEN 0 THEN 'block' WHEN 1 THEN 'header' WHEN 2 THEN 'meta' ELSE 'body' END ELSE 'block' END AS grp,
ln AS ord, CASE WHEN l_suppkey % 10 = 0 THEN '' ELSE concat('b', CAST(ln AS STRING)) END AS block_id, CASE WHEN l_partkey % 17 = 0 THEN '' ELSE concat('para_', CAST(ln % 4 AS STRING)) END AS para_id,
CASE WHEN l_partkey % 11 = 0 THEN 'role_header' WHEN l_partkey % 13 = 0 THEN 'other_paragraph' ELSE CASE l_orderkey % 7 WHEN 0 THEN 'summary_paragraph' WHEN 1 THEN 'skills_paragraph' WHEN 2 THEN 'education_entry' WHEN 3 THEN 'other_paragraph'
WHEN 4 THEN CASE ln % 5 WHEN 1 THEN 'role_header' WHEN 2 THEN 'role_meta' WHEN 3 THEN 'role_tech_stack' ELSE 'bullet' END WHEN 5 THEN 'project_entry' ELSE 'x' END END AS semantic_type,
CASE WHEN l_suppkey % 9 = 0 THEN 'preserve' WHEN l_suppkey % 9 = 1 THEN 'rewrite_text' ELSE CASE l_orderkey % 7 WHEN 0 THEN 'rewrite_text' WHEN 4 THEN CASE WHEN ln % 5 IN (0, 4) THEN 'rewrite_text' ELSE 'preserve' END ELSE 'preserve' END END AS rewrite_policy,
l_suppkey % 23 = 0 AS is_new FROM v_li"""
SEC = """SELECT DISTINCT l_orderkey % 3000 AS doc_id, CAST(l_orderkey AS STRING) AS section_id, concat('Title ', CAST(l_orderkey % 50 AS STRING)) AS raw_title, CASE l_orderkey % 7 WHEN 0 THEN 'summary' WHEN 1 THEN 'skills' WHEN 2 THEN 'education' WHEN 3 THEN 'other' WHEN 4 THEN 'experience' WHEN 5 THEN 'projects' ELSE 'bogus' END AS semantic_type,
CASE WHEN l_orderkey % 19 = 0 THEN 'preserve' ELSE CASE l_orderkey % 7 WHEN 0 THEN 'rewrite_body' WHEN 1 THEN 'rewrite_body' WHEN 4 THEN 'rewrite_bullets_only' ELSE 'preserve' END END AS rewrite_policy,
(l_orderkey % 7 IN (2, 3, 4, 5)) <> (l_orderkey % 29 = 0) AS preserve_heading, (l_orderkey % 7 IN (2, 3, 4, 5)) <> (l_orderkey % 31 = 0) AS preserve_body_structure FROM v_li"""


def cls(s, sf):
    view(s, sf, "v_li").createOrReplaceTempView("quire_v_li")
    # One line item of an order has ln = 1 and the columns depend on the order only, so nothing is left to make distinct.
    sec = cut(s.sql(SEC.replace("SELECT DISTINCT", "SELECT").replace("FROM v_li", "FROM quire_v_li WHERE ln = 1")))
    return sec, s.sql(BLK.replace("FROM v_li", "FROM quire_v_li"))


def _errs(sec, blk):
    return f"""SELECT s.doc_id, s.section_id, r.code, '' AS block_id FROM (SELECT s.*, coalesce(nb, 0) AS nb, coalesce(nr, 0) AS nr FROM {sec} s LEFT JOIN (SELECT doc_id, section_id, count(*) FILTER (grp = 'block') AS nb, count(*) FILTER (grp <> 'block') AS nr FROM {blk} GROUP BY ALL) c ON c.doc_id = s.doc_id AND c.section_id = s.section_id) s
JOIN {vals(k.SECTION_RULES)} r(st, attribute, required, code) ON r.st = s.semantic_type WHERE required <> CASE attribute WHEN 'rewrite_policy' THEN rewrite_policy WHEN 'preserve_heading' THEN preserve_heading::VARCHAR WHEN 'preserve_body_structure' THEN preserve_body_structure::VARCHAR WHEN 'roles' THEN CASE WHEN nr > 0 THEN 'some' ELSE 'empty' END ELSE CASE WHEN nb > 0 THEN 'some' ELSE 'empty' END END
UNION ALL SELECT doc_id, section_id, 'SEC_INVALID_SEMANTIC_TYPE', '' FROM {sec} WHERE semantic_type NOT IN {inl(k.VALID_TYPES)}
UNION ALL SELECT doc_id, section_id, code, block_id FROM (SELECT b.doc_id, b.section_id, b.block_id, unnest([CASE WHEN t.ty IS NULL THEN type_code END, CASE WHEN coalesce(need, own) <> b.rewrite_policy THEN policy_code END, CASE WHEN new_code IS NOT NULL AND is_new THEN new_code END]) AS code
FROM {blk} b JOIN {sec} s ON s.doc_id = b.doc_id AND s.section_id = b.section_id JOIN {vals(k.BLOCK_GROUPS)} g(st, gr, type_code, policy_code, new_code, need) ON g.st = s.semantic_type AND g.gr = b.grp
LEFT JOIN {vals(k.BLOCK_TYPES)} t(st2, gr2, ty, own) ON t.st2 = s.semantic_type AND t.gr2 = b.grp AND t.ty = b.semantic_type) WHERE code IS NOT NULL"""


_CTE = f"sec AS ({SEC}), blk AS ({BLK}), err AS ({_errs('sec', 'blk')})"


@q("f29_classification_rules", sql_with("SELECT * FROM err", "v_li", extra=_CTE))
def _(s, sf):
    return k.classification_rules(*cls(s, sf))


_HEADS = """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 11 <> 0 THEN concat('doc_', doc_id) END AS document_id,
CASE WHEN lang <> 'es' THEN source END AS source_kind, CASE WHEN doc_id % 13 <> 0 THEN contains(text, '. ') END AS has_sections FROM documents"""


@q("f29_document_codes", f"""SELECT doc_id, 'DOC_MISSING_DOCUMENT_ID' AS code FROM ({_HEADS}) WHERE coalesce(document_id, '') = ''
UNION ALL SELECT doc_id, 'DOC_MISSING_SOURCE_KIND' FROM ({_HEADS}) WHERE coalesce(source_kind, '') = ''
UNION ALL SELECT doc_id, 'DOC_MISSING_SECTIONS' FROM ({_HEADS}) WHERE NOT coalesce(has_sections, false)""")
def _(s, sf):
    view(s, sf, "documents").createOrReplaceTempView("quire_documents")
    return k.missing_document_fields(s.sql(_HEADS.replace("FROM documents", "FROM quire_documents")))


@q("k3_top_error_codes", sql_with("SELECT code, count(*) AS n FROM err GROUP BY 1 ORDER BY n DESC, code LIMIT 10", "v_li", extra=_CTE))
def _(s, sf):
    return top_values(k.classification_rules(*cls(s, sf)), "code", 10)


_FIRST = """fp AS (SELECT doc_id, section_id, para_id, min((CASE WHEN grp = 'block' THEN 0 ELSE 1 END, role_id, CASE grp WHEN 'block' THEN 0 WHEN 'header' THEN 1 WHEN 'meta' THEN 2 ELSE 3 END, ord, block_id, semantic_type, is_new)) AS f FROM blk WHERE {} GROUP BY ALL)"""


@q("f30_downgrade_invalid", sql_with("""SELECT doc_id, section_id, n AS ord, CASE WHEN bid = '' THEN 'blk_' || lpad(CAST(n AS VARCHAR), 3, '0') ELSE bid END AS block_id, para_id, 'other_paragraph' AS semantic_type, 'preserve' AS rewrite_policy FROM (
SELECT doc_id, section_id, para_id, struct_extract(f, 5) AS bid, row_number() OVER (PARTITION BY doc_id, section_id ORDER BY f) AS n FROM fp WHERE (doc_id, section_id) IN (SELECT doc_id, section_id FROM err))
UNION ALL SELECT doc_id, section_id, ord, block_id, para_id, semantic_type, rewrite_policy FROM blk WHERE (doc_id, section_id) NOT IN (SELECT doc_id, section_id FROM err)""", "v_li", extra=_CTE + ", " + _FIRST.format("para_id <> ''")))
def _(s, sf):
    sec, blk = cls(s, sf)
    return k.downgrade_invalid(sec, blk, k.classification_rules(sec, blk))[1].select("doc_id", "section_id", "ord", "block_id", "para_id", "semantic_type", "rewrite_policy")


_FIXED = f"""fixed AS (SELECT b.doc_id, b.section_id, b.role_id, b.grp, b.ord, b.block_id, b.para_id, CASE WHEN s.semantic_type = 'education' AND b.semantic_type IN {inl(k.WRONG_IN_EDUCATION)} THEN 'education_entry' WHEN s.semantic_type = 'experience' AND grp = 'header' THEN 'role_header' WHEN s.semantic_type = 'experience' AND grp = 'meta' THEN 'role_meta'
WHEN s.semantic_type = 'experience' AND b.semantic_type NOT IN {inl(k.REWRITEABLE_BODY + k.PRESERVED_BODY)} THEN 'role_achievement_bullet' ELSE b.semantic_type END AS semantic_type,
CASE WHEN s.semantic_type = 'education' AND b.semantic_type IN {inl(k.WRONG_IN_EDUCATION)} THEN 'preserve' WHEN s.semantic_type = 'experience' AND (grp IN ('header', 'meta') OR b.semantic_type IN {inl(k.PRESERVED_BODY)}) THEN 'preserve' WHEN s.semantic_type = 'experience' THEN 'rewrite_text' ELSE b.rewrite_policy END AS rewrite_policy, is_new
FROM blk b JOIN sec s ON s.doc_id = b.doc_id AND s.section_id = b.section_id WHERE s.semantic_type <> 'projects' AND NOT (s.semantic_type = 'experience' AND grp = 'block')
UNION ALL SELECT doc_id, section_id, '', 'block', row_number() OVER (PARTITION BY doc_id, section_id ORDER BY f), struct_extract(f, 5), para_id, CASE WHEN struct_extract(f, 6) IN ('project_entry', 'other_paragraph') THEN struct_extract(f, 6) ELSE 'project_entry' END, 'preserve', struct_extract(f, 7)
FROM fp WHERE section_id IN (SELECT section_id FROM sec WHERE semantic_type = 'projects')),
fsec AS (SELECT doc_id, section_id, raw_title, semantic_type, CASE semantic_type WHEN 'experience' THEN 'rewrite_bullets_only' WHEN 'projects' THEN 'preserve' ELSE rewrite_policy END AS rewrite_policy, semantic_type = 'experience' OR preserve_heading AS preserve_heading, semantic_type = 'experience' OR preserve_body_structure AS preserve_body_structure FROM sec)"""
_ALL = _CTE + ", " + _FIRST.format("true") + ", " + _FIXED + f", err2 AS ({_errs('fsec', 'fixed')})"


@q("f31_autocorrect_blocks", sql_with("SELECT doc_id, section_id, role_id, grp, ord, block_id, para_id, semantic_type, rewrite_policy FROM fixed", "v_li", extra=_ALL))
def _(s, sf):
    return k.autocorrect_blocks(*cls(s, sf))[1].drop("is_new")


_STATUS = """st AS (SELECT doc_id, nb AS n_before, CASE WHEN rep THEN na ELSE nb END AS n_after, CASE WHEN nb = 0 THEN 'valid' WHEN NOT rep THEN 'downgraded' WHEN na = 0 THEN 'repaired' ELSE 'repaired_and_downgraded' END AS status FROM (
SELECT d.doc_id, coalesce(b.n, 0) AS nb, coalesce(a.n, 0) AS na, d.doc_id % 4 <> 0 AS rep FROM (SELECT DISTINCT doc_id FROM sec) d LEFT JOIN (SELECT doc_id, count(DISTINCT section_id) AS n FROM err GROUP BY 1) b ON b.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, count(DISTINCT section_id) AS n FROM err2 WHERE doc_id % 3 <> 0 GROUP BY 1) a ON a.doc_id = d.doc_id))"""


def _status(s, sf):
    sec, blk = cls(s, sf)
    blk = k.with_section_type(sec, blk)
    before = k.classification_rules(sec, blk)
    after = k.classification_rules(*k.autocorrect_blocks(sec, blk)).filter("doc_id % 3 <> 0")
    docs = sec.select("doc_id").distinct()
    return k.repair_status(docs, before, after, docs.filter("doc_id % 4 <> 0"))


@q("f32_repair_status", sql_with("SELECT doc_id, n_before, n_after, n_before - n_after AS repaired_count, n_after AS downgraded_count, status FROM st", "v_li", extra=_ALL + ", " + _STATUS))
def _(s, sf):
    return _status(s, sf)


@q("f32_merge_repaired", sql_with("""SELECT doc_id, section_id, ord, block_id, semantic_type FROM blk LEFT JOIN (SELECT DISTINCT doc_id, section_id, true AS bad FROM err) e USING (doc_id, section_id) LEFT JOIN (SELECT DISTINCT doc_id, section_id, true AS mended FROM fixed) f USING (doc_id, section_id)
WHERE NOT (doc_id % 4 <> 0 AND coalesce(bad, false) AND coalesce(mended, false)) UNION ALL SELECT doc_id, section_id, ord, block_id, semantic_type FROM fixed SEMI JOIN err USING (doc_id, section_id) WHERE doc_id % 4 <> 0""", "v_li", extra=_ALL))
def _(s, sf):
    sec, blk = cls(s, sf)
    fixed = k.autocorrect_blocks(sec, blk)[1].filter("doc_id % 4 <> 0")
    return k.merge_repaired(blk, fixed, k.classification_rules(sec, blk)).select("doc_id", "section_id", "ord", "block_id", "semantic_type")


_PCT = "floor(({0} * 2000 + documents) / (documents * 2)) / 10"


@q("a8_classification_report", sql_with(f"""SELECT *, {_PCT.format('initial_valid')} AS initial_valid_pct, {_PCT.format('repaired')} AS repaired_pct, {_PCT.format('downgraded')} AS downgraded_pct, {_PCT.format('final_valid')} AS final_valid_pct FROM (
SELECT CASE WHEN doc_id % 2 = 0 THEN 'docx' ELSE 'pdf' END AS source_kind, count(*) AS documents, count(*) FILTER (n_before = 0) AS initial_valid, count(*) FILTER (status = 'repaired') AS repaired, count(*) FILTER (status = 'repaired_and_downgraded') AS repair_partial, count(*) FILTER (status = 'downgraded') AS downgrade_only, count(*) FILTER (status = 'valid') AS valid,
count(*) FILTER (status IN ('downgraded', 'repaired_and_downgraded')) AS downgraded, count(*) FILTER (status IN ('valid', 'repaired')) AS final_valid, count(*) FILTER (n_before > 0) AS weak_initially FROM st GROUP BY 1)""", "v_li", extra=_ALL + ", " + _STATUS))
def _(s, sf):
    d = _status(s, sf).withColumn("source_kind", F.when(F.col("doc_id") % 2 == 0, "docx").otherwise("pdf"))
    return k.classification_report(d, ["source_kind"])


# Documents of about a hundred paragraphs in four sections.
P = """SELECT doc_id % 600 AS doc_id, concat('s', CAST(ord % 4 AS STRING)) AS section_id, concat('p', CAST(doc_id * 100 + ord AS STRING)) AS para_id, doc_id * 100 + ord AS ord, parser_semantic, CASE WHEN doc_id % 2 = 0 THEN 'role_1' ELSE 'role_2' END AS role_id,
CASE (doc_id * 7 + ord * 3) % 23 WHEN 0 THEN 'Technical Skills' WHEN 1 THEN 'Jan 2019 - Present' WHEN 2 THEN 'me@example.com' WHEN 3 THEN 'Phone: 555 0100' WHEN 4 THEN 'BSc of things' WHEN 5 THEN 'Bachelor of Arts at Night' WHEN 6 THEN 'Docker, Kafka, Python, SQL and more tools' WHEN 7 THEN 'alpha beta gamma delta epsilon zeta'
WHEN 8 THEN '1. First thing' WHEN 9 THEN 'Education' WHEN 10 THEN 'Current Date: x' ELSE text END AS text FROM v_paras"""
S = """SELECT DISTINCT doc_id % 600 AS doc_id, concat('s', CAST(ord % 4 AS STRING)) AS section_id, CASE ord % 4 WHEN 0 THEN CASE WHEN doc_id % 600 % 3 = 0 THEN '1. Experience' ELSE 'E X P E R I E N C E' END WHEN 1 THEN CASE WHEN doc_id % 600 % 2 = 0 THEN 'Certificates held' ELSE 'Skills' END WHEN 2 THEN 'Acme Tech Inc' ELSE 'Notes' END AS raw_title,
CASE ord % 4 WHEN 0 THEN 'experience' WHEN 1 THEN 'certifications' ELSE 'other' END AS semantic_type FROM v_paras"""
M = "SELECT doc_id, section_id, role_id, CASE parser_semantic WHEN 'role_header' THEN 'header' WHEN 'role_meta' THEN CASE WHEN ord % 3 = 0 THEN 'meta' ELSE 'bullet' END ELSE 'bullet' END AS kind, para_id FROM p WHERE parser_semantic <> 'paragraph' AND section_id IN ('s0', 's3') AND NOT (doc_id % 10 = 0 AND section_id = 's0')"
D = "SELECT DISTINCT doc_id, doc_id % 9 = 0 AS label_column_fixed, doc_id % 4 = 0 AS table_layout_fixed, doc_id % 4 IN (0, 1) AND doc_id % 3 = 0 AS table_layout_aborted FROM p"


def parser_docs(s, sf):
    # Line items meet their part once; the documents, sections, paragraphs and members are all read from what that gave.
    cut(view(s, sf, "v_paras").select("doc_id", "ord", "parser_semantic", "text")).createOrReplaceTempView("quire_v_paras")
    p = s.sql(P.replace("FROM v_paras", "FROM quire_v_paras"))
    p.createOrReplaceTempView("quire_p")
    return (cut(s.sql(D.replace("FROM p", "FROM quire_p"))), s.sql(S.replace("FROM v_paras", "FROM quire_v_paras")), p, s.sql(M.replace("FROM p", "FROM quire_p")))


_RX = {"d": k.DATE, "parts": k.DATE_PARTS, "b": k.BULLET_START}
_CON = "(" + " OR ".join(f"regexp_matches(trim(text), '{c}')" for c in k.CONTACT) + ")"
_EDU = "(NOT contains(text, '|') AND regexp_extract(lower(trim(text)), '^([a-z0-9_]*)', 1) NOT IN " + inl(k.DETECTOR_VERBS) + " AND (regexp_matches(trim(text), '" + k.DEGREE[0] + "') OR regexp_matches(trim(text), '" + k.DEGREE[1].replace("'", "''") + "')))"
_TOK = r"string_split_regex(trim(text), '\s+')"
_SKL = (f"(len({_TOK}) >= 4 AND length(trim(text)) >= 20 AND NOT regexp_matches(trim(text), '{k.DATE}') AND NOT {_CON} AND regexp_extract(lower(trim(text)), '^([a-z0-9_]*)', 1) NOT IN {inl(k.DETECTOR_VERBS)}"
        f" AND NOT (len({_TOK}) >= 8 AND regexp_matches(trim(text), '[.!?]$')) AND NOT (" + " OR ".join(f"contains(lower(trim(text)), '{c}')" for c in k.CONNECTORS + k.INSTITUTION_WORDS) + ")"
        rf" AND NOT (len({_TOK}) <= 4 AND NOT regexp_matches(text, '[,;]') AND len(list_filter({_TOK}, lambda w: regexp_matches(w, '^\p{{Lu}}'))) = len({_TOK})) AND (len(regexp_extract_all(text, '[,;]')) >= 2 OR (len({_TOK}) >= 6 AND NOT regexp_matches(trim(text), '[.!?]$'))))")
_DET = rf"""p AS (SELECT * FROM ({P})), sc AS (SELECT *, section_id = 's0' AS is_exp FROM ({S})), mem AS ({M}), d AS ({D}), ps AS (SELECT p.*, is_exp, raw_title, sc.semantic_type FROM p JOIN sc USING (doc_id, section_id)),
ro AS (SELECT doc_id, section_id, role_id, count(*) FILTER (kind = 'header') AS h, count(*) FILTER (kind = 'bullet') AS b FROM mem GROUP BY ALL),
ins AS (SELECT m.doc_id, m.section_id, m.role_id, count(*) AS n FROM mem m JOIN ps USING (doc_id, section_id, para_id) WHERE kind = 'bullet' AND is_exp AND parser_semantic = 'role_meta' GROUP BY ALL),
orp AS (SELECT * FROM ps WHERE is_exp AND parser_semantic = 'paragraph' AND (doc_id, section_id, para_id) NOT IN (SELECT doc_id, section_id, para_id FROM mem)),
sk AS (SELECT * FROM ps WHERE semantic_type = 'certifications' AND parser_semantic <> 'section_heading' AND NOT regexp_matches(lower(raw_title), 'skill|technical|expertise') AND doc_id IN (SELECT doc_id FROM d WHERE table_layout_fixed OR table_layout_aborted) AND {_SKL}),
iss AS (SELECT doc_id, 'EXPERIENCE_NO_ROLES' AS code, section_id, '' AS para_id, '' AS role_id FROM sc WHERE is_exp AND (doc_id, section_id) NOT IN (SELECT doc_id, section_id FROM ro)
UNION ALL SELECT doc_id, 'MERGED_SECTION_SUSPECTED', section_id, para_id, role_id FROM ps WHERE is_exp AND parser_semantic IN ('section_heading', 'paragraph', 'role_header') AND regexp_matches(trim(text), '^\p{{Lu}}') AND lower(trim(text)) IN {inl(k.KNOWN_HEADINGS)} AND lower(trim(text)) NOT IN {inl(k.EXPERIENCE_TITLES)}
UNION ALL SELECT doc_id, 'HEADING_NOT_RECOGNIZED', section_id, para_id, role_id FROM ps WHERE parser_semantic = 'paragraph' AND length(trim(text)) BETWEEN 1 AND 60 AND regexp_matches(trim(text), '^\p{{Lu}}') AND lower(trim(text)) IN {inl(k.KNOWN_HEADINGS)} AND list_has_any(string_split_regex(lower(trim(text)), '[\s/&,]+'), [{", ".join("'" + w + "'" for w in k.HEADING_TRIGGERS)}])
 AND NOT (regexp_matches(lower(raw_title), 'skill|competenc|expertise|proficien') AND len(list_distinct(string_split_regex(lower(trim(text)), '[\s/&,]+'))) = 1)
UNION ALL SELECT m.doc_id, 'ROLE_HEADER_CONTAINS_DATE', m.section_id, m.para_id, m.role_id FROM mem m JOIN p ON p.doc_id = m.doc_id AND p.para_id = m.para_id WHERE kind = 'header' AND regexp_matches(text, '{k.DATE}') AND len(list_filter(string_split_regex(regexp_replace(text, '{k.DATE_PARTS}', ' ', 'g'), '\s+'), lambda w: length(w) > 2 AND w NOT IN ('and', 'AND', 'the', 'THE'))) < 2
UNION ALL SELECT doc_id, 'EXPERIENCE_ROLE_BOUNDARY_INSIDE_BULLETS', section_id, '', role_id FROM ins UNION ALL SELECT doc_id, 'EXPERIENCE_OVERMERGED_ROLE', section_id, '', role_id FROM ins JOIN ro USING (doc_id, section_id, role_id) WHERE n >= 2 AND b >= 15
UNION ALL SELECT doc_id, 'BULLET_NOT_RECOGNIZED', section_id, para_id, role_id FROM ps WHERE parser_semantic NOT IN ('bullet', 'section_heading', 'role_header') AND regexp_matches(text, '{k.BULLET_START}')
UNION ALL SELECT doc_id, 'ROLE_GROUPING_WEAK', section_id, '', role_id FROM ro WHERE h >= 2 AND b = 0 UNION ALL SELECT DISTINCT doc_id, 'ROLE_LIKE_GROUPING_NON_EXPERIENCE', section_id, '', '' FROM ro JOIN sc USING (doc_id, section_id) WHERE NOT is_exp
UNION ALL SELECT doc_id, 'LABEL_COLUMN_DETECTED', '', '', '' FROM d WHERE label_column_fixed UNION ALL SELECT doc_id, 'TABLE_COLUMN_LAYOUT_DETECTED', '', '', '' FROM d WHERE table_layout_fixed UNION ALL SELECT doc_id, 'TABLE_COLUMN_REORDER_ABORTED', '', '', '' FROM d WHERE table_layout_aborted AND NOT table_layout_fixed
UNION ALL SELECT doc_id, 'TABLE_CONTACT_INSIDE_EXPERIENCE', section_id, para_id, role_id FROM orp WHERE {_CON} UNION ALL SELECT doc_id, 'TABLE_EDUCATION_INSIDE_EXPERIENCE', section_id, para_id, role_id FROM orp WHERE {_EDU}
UNION ALL SELECT doc_id, 'TABLE_SKILLS_INSIDE_NON_SKILLS_SECTION', section_id, para_id, role_id FROM sk
UNION ALL SELECT doc_id, 'TABLE_ORG_NAME_PROMOTED_TO_FAKE_SECTION', section_id, '', '' FROM (SELECT doc_id, section_id, raw_title, count(*) AS n, arg_max(text, (ord, para_id)) AS last FROM ps WHERE NOT is_exp AND trim(text) <> '' GROUP BY ALL) WHERE n <= 3 AND regexp_matches(last, '{k.DATE}') AND lower(trim(raw_title)) NOT IN {inl(k.KNOWN_HEADINGS + k.SKIPPED_TITLES)}
 AND list_has_any(string_split_regex(lower(raw_title), '[^a-z0-9_]+'), [{", ".join("'" + w + "'" for w in k.ORGANISATION_WORDS)}]) AND (doc_id, section_id) NOT IN (SELECT doc_id, section_id FROM ro))"""


def _issues(s, sf):
    docs, sec, p, mem = parser_docs(s, sf)
    return docs, k.diagnostic_detectors(docs, sec, p.drop("role_id"), mem)


@q("f33_diagnostic_detectors", sql_with("SELECT doc_id, code, section_id, para_id, count(*) AS n FROM iss GROUP BY ALL", "v_paras", extra=_DET))
def _(s, sf):
    return _issues(s, sf)[1].groupBy("doc_id", "code", "section_id", "para_id").agg(F.count("*").alias("n"))


_ROLL = f"""roll AS (SELECT d.doc_id, CAST(coalesce(pa, 0) AS BIGINT) AS parser_issue_score, CAST(coalesce(pb, 0) AS BIGINT) AS info_score, CASE WHEN coalesce(na, 0) > 0 THEN 'parser_issue' WHEN coalesce(nb, 0) > 0 THEN 'clean_with_info' ELSE 'clean' END AS status, CASE WHEN coalesce(na, 0) > 0 AND hi THEN 'high' WHEN coalesce(na, 0) > 0 THEN 'medium' WHEN coalesce(nb, 0) > 0 THEN 'info' ELSE 'none' END AS severity
FROM d LEFT JOIN (SELECT doc_id, count(*) FILTER (c.category = 'A') AS na, count(*) FILTER (c.category = 'B') AS nb, sum(CASE WHEN c.category = 'A' THEN weight ELSE 0 END) AS pa, sum(CASE WHEN c.category = 'B' THEN weight ELSE 0 END) AS pb, bool_or(c.category = 'A' AND c.severity = 'high') AS hi FROM iss JOIN {vals(k.ISSUE_CODES)} c(code, category, weight, severity) USING (code) GROUP BY 1) g ON g.doc_id = d.doc_id)"""


@q("a9_diagnostics_rollup", sql_with("SELECT * FROM roll", "v_paras", extra=_DET + ", " + _ROLL))
def _(s, sf):
    return k.diagnostics_rollup(*_issues(s, sf))


@q("a9_health_status", sql_with("""SELECT count(*) AS scanned, count(*) FILTER (status = 'clean') AS clean, count(*) FILTER (status = 'clean_with_info') AS clean_with_info, count(*) FILTER (status = 'parser_issue') AS parser_issue, CAST(sum(parser_issue_score) AS BIGINT) AS parser_issue_score, CAST(sum(info_score) AS BIGINT) AS info_score,
CASE WHEN count(*) FILTER (status = 'parser_issue') = 0 THEN 'ok' WHEN count(*) FILTER (status = 'parser_issue') / count(*) < 0.15 THEN 'warning' WHEN count(*) FILTER (status = 'parser_issue') / count(*) < 0.30 THEN 'degraded' ELSE 'critical' END AS health FROM roll""", "v_paras", extra=_DET + ", " + _ROLL))
def _(s, sf):
    return k.health_status(k.diagnostics_rollup(*_issues(s, sf)))


@q("k5_triage_diagnostics", sql_with("SELECT *, list_position(['parser_issue', 'clean_with_info', 'clean'], status) AS status_rank FROM roll", "v_paras", extra=_DET + ", " + _ROLL))
def _(s, sf):
    return triage_order(k.diagnostics_rollup(*_issues(s, sf)), ["parser_issue", "clean_with_info", "clean"], ["parser_issue_score", "info_score"], "doc_id")


@q("u4_suppress_covered", sql_with("""SELECT doc_id, para_id, count(*) AS n FROM v_paras a WHERE parser_semantic = 'paragraph' AND (doc_id, para_id) NOT IN (SELECT doc_id, para_id FROM v_paras WHERE parser_semantic = 'bullet') GROUP BY ALL""", "v_paras"))
def _(s, sf):
    p = view(s, sf, "v_paras")
    return k.suppress_covered(p.filter("parser_semantic = 'paragraph'"), p.filter("parser_semantic = 'bullet'"), ["doc_id", "para_id"]).groupBy("doc_id", "para_id").agg(F.count("*").alias("n"))


@q("u2_union_sources", sql_with("""SELECT source_kind, count(*) AS n, count(status) AS with_status, count(company_name) AS with_company FROM (SELECT 'runs' AS source_kind, status, NULL AS company_name FROM v_runs UNION ALL SELECT 'docs', NULL, company_name FROM v_docs) GROUP BY 1""", "v_runs", "v_docs"))
def _(s, sf):
    r = view(s, sf, "v_runs").select(F.lit("runs").alias("source_kind"), "status")
    d = view(s, sf, "v_docs").select(F.lit("docs").alias("source_kind"), "company_name")
    return k.union_all(r, d).groupBy("source_kind").agg(F.count("*").alias("n"), F.count("status").alias("with_status"), F.count("company_name").alias("with_company"))


_DQP = "SELECT doc_id, CASE WHEN doc_id % 50 = 0 AND ord % 2 = 1 THEN '' ELSE concat('s', CAST(ord % 2 AS STRING)) END AS section_id, para_id, CASE WHEN doc_id % 17 = 0 AND ord = 1 THEN 'Current Date: today' WHEN doc_id % 23 = 0 THEN '' ELSE text END AS text, CASE WHEN doc_id % 23 = 0 OR parser_semantic = 'paragraph' THEN 'body' WHEN parser_semantic = 'role_header' AND ord % 3 = 0 THEN 'bullet' WHEN parser_semantic = 'role_header' THEN 'header' WHEN parser_semantic = 'role_meta' THEN 'meta' ELSE 'bullet' END AS place, parser_semantic AS semantic FROM v_paras"
_DQS = "SELECT DISTINCT doc_id, section_id, CASE WHEN section_id = 's0' THEN 'experience' ELSE 'other' END AS semantic_type FROM dqp"


def _dq(s, sf):
    view(s, sf, "v_paras").createOrReplaceTempView("quire_v_paras")
    p = s.sql(_DQP.replace("FROM v_paras", "FROM quire_v_paras"))
    p.createOrReplaceTempView("quire_dqp")
    return p, s.sql(_DQS.replace("FROM dqp", "FROM quire_dqp"))


_DQ_CODES = ("EMPTY_PARA_ID", "DUPLICATE_PARA_ID", "EMPTY_SECTION_ID", "EXPERIENCE_NO_ROLES", "SPLIT_BRAIN_BODY_PARAS", "ROLE_BOUNDARY_CORRUPTION", "CURRENT_DATE_LEAKAGE")


@q("a23_document_dq", sql_with(f"""SELECT doc_id, array_to_string(list_filter([{", ".join(f"CASE WHEN {c} THEN '{c}' END" for c in _DQ_CODES)}], lambda x: x IS NOT NULL), ',') AS failures, greatest(0, 100 - ({" + ".join(f"CASE WHEN {c} THEN {k.DQ_PENALTY[c]} ELSE 0 END" for c in _DQ_CODES)})) AS score, EXPERIENCE_NO_ROLES AS hard_fail, empty_para_ids FROM (
SELECT d.doc_id, bool_or(trim(text) <> '' AND para_id = '') AS EMPTY_PARA_ID, max(dn) > 1 AS DUPLICATE_PARA_ID, bool_or(p.section_id = '') AS EMPTY_SECTION_ID, bool_or(coalesce(nr, false)) AS EXPERIENCE_NO_ROLES, bool_or(coalesce(sb, false)) AS SPLIT_BRAIN_BODY_PARAS, bool_or(semantic_type = 'experience' AND place = 'bullet' AND semantic IN ('role_header', 'section_heading')) AS ROLE_BOUNDARY_CORRUPTION,
bool_or(contains(lower(text), 'current date') OR contains(lower(text), 'currentdate')) AS CURRENT_DATE_LEAKAGE, count(*) FILTER (trim(text) <> '' AND para_id = '') AS empty_para_ids FROM (SELECT DISTINCT doc_id FROM dqp) d JOIN dqp p ON p.doc_id = d.doc_id JOIN dqs s ON s.doc_id = p.doc_id AND s.section_id = p.section_id
LEFT JOIN (SELECT doc_id, max(n) AS dn FROM (SELECT doc_id, para_id, count(*) AS n FROM dqp WHERE para_id <> '' GROUP BY ALL) GROUP BY 1) x ON x.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, bool_or(b AND r) AS sb FROM (SELECT doc_id, section_id, para_id, bool_or(place = 'body') AS b, bool_or(place <> 'body') AS r FROM dqp WHERE section_id = 's0' AND para_id <> '' GROUP BY ALL) GROUP BY 1) y ON y.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, NOT bool_or(place <> 'body') AND NOT bool_or(place = 'body' AND trim(text) <> '') AS nr FROM dqp WHERE section_id = 's0' GROUP BY 1) z ON z.doc_id = d.doc_id GROUP BY d.doc_id)""", "v_paras", extra=f"dqp AS ({_DQP}), dqs AS ({_DQS})"))
def _(s, sf):
    return k.document_dq(*_dq(s, sf))


@q("a24_health_violations", sql_with("""SELECT doc_id, unbound_non_empty_paras, unbound_bullets, sections_missing_id, role_boundary_violations, density_overflow, newline_packing, semantic_missing_in_lb, unbound_non_empty_paras + unbound_bullets + sections_missing_id + role_boundary_violations + density_overflow + newline_packing AS hard_violations,
unbound_non_empty_paras + unbound_bullets + sections_missing_id + role_boundary_violations + density_overflow + newline_packing = 0 AS healthy FROM (SELECT doc_id, count(*) FILTER (trim(text) <> '' AND para_id = '') AS unbound_non_empty_paras, count(*) FILTER (place = 'bullet' AND trim(text) <> '' AND para_id = '') AS unbound_bullets, count(DISTINCT section_id) FILTER (section_id = '' AND trim(text) <> '') AS sections_missing_id,
count(*) FILTER (place = 'bullet' AND semantic IN ('role_header', 'section_heading')) AS role_boundary_violations, count(*) FILTER (length(text) > 18) AS density_overflow, count(*) FILTER (length(text) > 16 AND para_id LIKE '%1') AS newline_packing, count(*) FILTER (para_id LIKE '%2') AS semantic_missing_in_lb FROM dqp GROUP BY 1)""", "v_paras", extra=f"dqp AS ({_DQP})"))
def _(s, sf):
    p, _s = _dq(s, sf)
    live = p.filter("trim(text) <> ''")
    n = lambda d: d.groupBy("doc_id").agg(F.count("*").alias("n"))
    counts = {
        "unbound_non_empty_paras": n(live.filter("para_id = ''")), "unbound_bullets": n(live.filter("para_id = '' AND place = 'bullet'")),
        "sections_missing_id": n(live.filter("section_id = ''").select("doc_id").distinct()),
        "role_boundary_violations": n(p.filter("place = 'bullet' AND semantic IN ('role_header', 'section_heading')")),
        "density_overflow": n(p.filter("length(text) > 18")), "newline_packing": n(p.filter("length(text) > 16 AND para_id LIKE '%1'")),
        "semantic_missing_in_lb": n(p.filter("para_id LIKE '%2'")),
    }
    return k.health_violations(counts, p.select("doc_id").distinct(), soft=("semantic_missing_in_lb",))
