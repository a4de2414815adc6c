"""Pair block: A21, U1, U3, J7, J8, J14-J16, J18, J19, J27, F26, F34-F37, K3."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.views import sql_with, view
from quire.functions import lexicons as L
from quire.operators import pairs as p
from quire.plans import ordered_scan, rank_in

QUERIES: dict = {}
SQL: dict = {}


def q(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f
    return add


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def bind(s, sf, text, *tables):
    """Run a binding view text on Spark."""
    for t in tables:
        view(s, sf, t).createOrReplaceTempView(f"quire_{t}")
        text = text.replace(f"FROM {t}", f"FROM quire_{t}")
    return s.sql(text)


_W = r"'[\p{L}\p{N}_]+'"


@q("a21_token_f1", sql_with(rf""", tok AS (SELECT pair_id, 's' AS side, lower(unnest(regexp_extract_all(src_text, {_W}))) AS tk FROM v_pairs UNION ALL SELECT pair_id, 'o', lower(unnest(regexp_extract_all(out_text, {_W}))) FROM v_pairs),
n AS (SELECT pair_id, tk, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 'o') AS o FROM tok GROUP BY ALL),
g AS (SELECT pair_id, CAST(sum(least(s, o)) AS BIGINT) AS common, CAST(sum(s) AS BIGINT) AS n_src, CAST(sum(o) AS BIGINT) AS n_out FROM n GROUP BY 1)
SELECT p.pair_id, coalesce(common, 0) AS common, coalesce(n_src, 0) AS n_src, coalesce(n_out, 0) AS n_out, round(coalesce(common / nullif(n_out, 0), 0), 6) AS precision, round(coalesce(common / nullif(n_src, 0), 0), 6) AS recall,
round(coalesce(2 * (common / nullif(n_out, 0)) * (common / nullif(n_src, 0)) / nullif(common / nullif(n_out, 0) + common / nullif(n_src, 0), 0), 0), 6) AS f1 FROM v_pairs p LEFT JOIN g USING (pair_id)""", "v_pairs").replace("\n, tok", ",\ntok"))
def _(s, sf):
    return r6(p.token_f1(view(s, sf, "v_pairs")), "precision", "recall", "f1")


_TRI = r"SELECT pair_id, concat(src_text, ' ', out_text) AS src, src_text AS gen, regexp_replace(out_text, '[Ee][a-z]+', ' ', 'g') AS outp FROM v_pairs"


def _tri(s, sf):
    return view(s, sf, "v_pairs").select(
        "pair_id", F.concat("src_text", F.lit(" "), "out_text").alias("src"), F.col("src_text").alias("gen"),
        F.regexp_replace("out_text", "[Ee][a-z]+", " ").alias("outp"))


_OV = rf"""tri AS ({_TRI}),
tok AS (SELECT pair_id, 's' AS side, unnest(regexp_extract_all(src, {_W})) AS tk FROM tri UNION ALL SELECT pair_id, 'g', unnest(regexp_extract_all(gen, {_W})) FROM tri UNION ALL SELECT pair_id, 'o', unnest(regexp_extract_all(outp, {_W})) FROM tri),
n AS (SELECT pair_id, lower(tk) AS tk, count(*) FILTER (side='s') AS s, count(*) FILTER (side='g') AS g, count(*) FILTER (side='o') AS o FROM tok WHERE regexp_matches(tk, '^[a-zA-Z]{{6,}}$') GROUP BY ALL)"""


@q("j18_token_overlap", sql_with("""SELECT pair_id, coalesce(st, 0) AS stale_total, coalesce(sv, 0) AS surviving, coalesce(mt, 0) AS matching, coalesce(ss, 0) AS src_total,
round(coalesce(sv / nullif(st, 0), 0), 6) AS stale_ratio, round(coalesce(mt / nullif(ss, 0), 0), 6) AS overlap FROM tri LEFT JOIN (
SELECT pair_id, CAST(sum(greatest(s - g, 0)) AS BIGINT) AS st, CAST(sum(least(greatest(s - g, 0), o)) AS BIGINT) AS sv, CAST(sum(least(s, o)) AS BIGINT) AS mt, CAST(sum(s) AS BIGINT) AS ss FROM n GROUP BY 1) USING (pair_id)""",
                                 "v_pairs", extra=_OV))
def _(s, sf):
    return r6(p.token_overlap(_tri(s, sf), "pair_id", "src", "gen", "outp"), "stale_ratio", "overlap")


@q("k3_top_survivors", sql_with("""SELECT tk AS token, CAST(sum(least(greatest(s - g, 0), o)) AS BIGINT) AS survived, count(*) AS docs FROM n WHERE least(greatest(s - g, 0), o) > 0 GROUP BY 1 ORDER BY survived DESC, token LIMIT 6""",
                                "v_pairs", extra=_OV))
def _(s, sf):
    return p.survivors(_tri(s, sf), "pair_id", "src", "gen", "outp").orderBy(F.col("survived").desc(), "token").limit(6)


def _ct(c):
    stop = ", ".join(f"'{w}'" for w in p.OVERLAP_STOP_WORDS)
    return rf"list_distinct(list_filter(regexp_extract_all(lower(regexp_replace({c}, '([0-9])([A-Za-z])', '\1 \2', 'g')), {_W}), lambda w: regexp_matches(w, '^[a-z]{{4,}}$') AND w NOT IN ({stop})))"


@q("u3_set_similarity", sql_with(f"""SELECT pair_id, CAST(len(a) AS INT) AS n_a, CAST(len(b) AS INT) AS n_b, round(coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0), 0), 6) AS jaccard, round(coalesce(len(list_intersect(a, b)) / nullif(len(b), 0), 0), 6) AS recall
FROM (SELECT pair_id, {_ct('src_text')} AS a, {_ct('out_text')} AS b FROM v_pairs)""", "v_pairs"))
def _(s, sf):
    return r6(p.set_similarity(view(s, sf, "v_pairs"), "pair_id", "src_text", "out_text"), "jaccard", "recall")


_H = "SELECT l_orderkey AS doc_id, ln AS idx, CASE l_partkey % 6 WHEN 0 THEN '1. Experience' WHEN 1 THEN 'SKILLS' WHEN 2 THEN 'Education' WHEN 3 THEN 'Some Name' WHEN 4 THEN 'Awards' ELSE 'P R O J E C T S' END AS heading, l_suppkey FROM v_li"
_KEY = r"regexp_replace(regexp_replace(lower(heading), '^[0-9.\s()]+', ''), '[^a-z0-9]', '', 'g')"


@q("u1_heading_diff", sql_with(f"""SELECT doc_id, idx, heading, 'missing' AS kind FROM a WHERE (doc_id, k) NOT IN (SELECT doc_id, k FROM b) UNION ALL SELECT doc_id, idx, heading, 'extra' FROM b WHERE (doc_id, k) NOT IN (SELECT doc_id, k FROM a)""",
                               "v_li", extra=f"""h AS ({_H}), kh AS (SELECT *, {_KEY} AS k FROM h WHERE {_KEY} IN ({", ".join(f"'{k}'" for k in L.KNOWN_SECTION_KEYS)})),
a AS (SELECT * FROM kh WHERE l_suppkey % 3 <> 0), b AS (SELECT * FROM kh WHERE l_suppkey % 4 <> 0)"""))
def _(s, sf):
    h = bind(s, sf, _H, "v_li")
    return p.heading_diff(h.filter("l_suppkey % 3 <> 0"), h.filter("l_suppkey % 4 <> 0"), "doc_id", "heading", "idx")


_INDEX = """SELECT CAST(row_number() OVER (ORDER BY name) AS INT) AS ord, name FROM (SELECT DISTINCT c_mktsegment AS name FROM customer UNION SELECT DISTINCT concat(c_mktsegment, ' card ', CAST(c_nationkey AS STRING), ' ', CAST(c_custkey % 10 AS STRING)) FROM customer)"""
_NAMES = "SELECT id, CASE WHEN id % 5 = 0 THEN raw WHEN id % 7 = 0 THEN concat('CARD ', CAST(id % 25 AS STRING)) ELSE name END AS name FROM v_names"


def _index(s, sf):
    c = view(s, sf, "customer")
    n = c.select(F.col("c_mktsegment").alias("name")).distinct().union(c.select(
        F.concat("c_mktsegment", F.lit(" card "), F.col("c_nationkey").cast("string"), F.lit(" "), (F.col("c_custkey") % 10).cast("string"))).distinct()).distinct()
    return ordered_scan(n, [], ["name"], [F.left("name", F.lit(2))], [rank_in("ord")]).select(F.col("ord").cast("int").alias("ord"), "name")


_MATCH = """nm AS (SELECT id, name, regexp_extract_all(lower(name), '[a-z0-9]+') AS lt FROM ({names})), ix AS (SELECT ord, name AS rname, regexp_extract_all(lower(name), '[a-z0-9]+') AS rt FROM ({index})),
hits AS (SELECT id, name, ord, rname FROM nm, ix WHERE len(lt) > 0 AND len(rt) > 0 AND CASE WHEN len(lt) <= len(rt) THEN list_has_all(rt, lt) ELSE list_has_all(lt, rt) END)""".replace("{names}", _NAMES).replace("{index}", _INDEX)


@q("j7_name_match", sql_with("SELECT id, min(ord) AS match_ord, arg_min(rname, ord) AS match_name FROM hits GROUP BY id", "v_names", extra=_MATCH))
def _(s, sf):
    return p.name_match(bind(s, sf, _NAMES, "v_names"), _index(s, sf), "id", "name", "ord", "name")


@q("j8_coverage_gaps", sql_with("""SELECT id, 'Missing resume for company: ''' || name || '''' AS message FROM nm WHERE id NOT IN (SELECT id FROM hits WHERE ord % 2 = 0)
UNION ALL SELECT id, 'Missing cover letter for company: ''' || name || '''' FROM nm WHERE id NOT IN (SELECT id FROM hits WHERE ord % 2 = 1)""", "v_names", extra=_MATCH))
def _(s, sf):
    ix = _index(s, sf)
    return p.coverage_gaps(bind(s, sf, _NAMES, "v_names"), {"resume": ix.filter("ord % 2 = 0"), "cover letter": ix.filter("ord % 2 = 1")}, "id", "name", "ord", "name")


_SEC = """SELECT l_orderkey AS doc_id, ln AS idx, {side} AS side, CASE (l_partkey + {side} * (l_suppkey % 2)) % 7 WHEN 0 THEN 'Experience' WHEN 1 THEN 'SKILLS' WHEN 2 THEN 'Technical Skills' WHEN 3 THEN 'Tools' WHEN 4 THEN 'My Qualifications' WHEN 5 THEN 'Summary' ELSE 'Education' END AS heading,
CASE (l_partkey + {side} * (l_suppkey % 2)) % 7 WHEN 0 THEN 'experience' WHEN 1 THEN 'skills' WHEN 2 THEN 'skills' WHEN 3 THEN 'other' WHEN 4 THEN '{mine}' WHEN 5 THEN 'summary' ELSE 'education' END AS section_type FROM v_li WHERE l_suppkey % 5 <> {drop}"""


def _sec(side, mine, drop):
    return _SEC.replace("{side}", str(side)).replace("{mine}", mine).replace("{drop}", str(drop))


_ALIGN = f"""sa AS ({_sec(0, 'skills', 1)}), sb AS ({_sec(1, 'other', 2)}),
a1 AS (SELECT doc_id, idx, lower(heading) AS h, section_type, row_number() OVER (PARTITION BY doc_id, lower(heading) ORDER BY idx) AS n FROM sa),
b1 AS (SELECT doc_id, idx, lower(heading) AS h, section_type, row_number() OVER (PARTITION BY doc_id, lower(heading) ORDER BY idx) AS n FROM sb WHERE lower(heading) <> 'my qualifications'),
p1 AS (SELECT a1.doc_id, a1.idx AS si, b1.idx AS oi FROM a1 JOIN b1 USING (doc_id, h, n)),
a2 AS (SELECT doc_id, idx, heading, section_type FROM sa WHERE (doc_id, idx) NOT IN (SELECT doc_id, si FROM p1)), b2 AS (SELECT doc_id, idx, section_type FROM sb WHERE (doc_id, idx) NOT IN (SELECT doc_id, oi FROM p1)),
p2 AS (SELECT x.doc_id, x.idx AS si, y.idx AS oi FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, section_type ORDER BY idx) AS n FROM a2 WHERE section_type <> 'other') x
 JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id, section_type ORDER BY idx) AS n FROM b2 WHERE section_type <> 'other') y USING (doc_id, section_type, n)),
p3 AS (SELECT x.doc_id, x.idx AS si, y.idx AS oi FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS n FROM a2 WHERE (doc_id, idx) NOT IN (SELECT doc_id, si FROM p2) AND regexp_matches(lower(heading), 'skill|proficien|abilit|competenc|expertise|technolog|tools|stack|technical')) x
 JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS n FROM b2 WHERE (doc_id, idx) NOT IN (SELECT doc_id, oi FROM p2) AND section_type = 'skills') y USING (doc_id, n))"""


@q("j14_align_sections", sql_with("SELECT doc_id, si, oi, 1 AS pass FROM p1 UNION ALL SELECT doc_id, si, oi, 2 FROM p2 UNION ALL SELECT doc_id, si, oi, 3 FROM p3", "v_li", extra=_ALIGN))
def _(s, sf):
    return p.align_sections(bind(s, sf, _sec(0, "skills", 1), "v_li"), bind(s, sf, _sec(1, "other", 2), "v_li"))


_ROLE = """SELECT l_orderkey AS doc_id, ln AS idx, {side} AS side, CASE WHEN l_suppkey % 4 = 0 AND {side} = 1 THEN concat(s_name, ' Corp | ', p_type) WHEN l_suppkey % 4 = 1 THEN concat('(', CAST(2000 + l_partkey % 20 AS STRING), '-2021)') ELSE concat(p_type, ' ', p_brand, ' | ', s_name) END AS header,
concat('Jan ', CAST(2000 + l_partkey % 20 AS STRING), ' - ', CASE WHEN l_suppkey % 3 = 0 THEN 'Present' ELSE '2021' END) AS dates FROM v_li JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE (ln + {side}) % 4 <> 0"""


@q("j15_align_roles")
def _(s, sf):
    def side(k):
        text = _ROLE.replace("{side}", str(k))
        for t in ("part", "supplier"):
            view(s, sf, t).createOrReplaceTempView(f"quire_{t}")
            text = text.replace(f"JOIN {t} ", f"JOIN quire_{t} ")
        return bind(s, sf, text, "v_li")
    return p.align_roles(side(0), side(1))


OUT_LINES = """SELECT doc_id, line_no, CASE WHEN doc_id % 3 = 0 AND line LIKE '- Built%' THEN concat(replace(line, 'reduced', 'lowered'), ' overall') WHEN doc_id % 3 = 0 AND line LIKE '- Led%' THEN concat('- Ran the ', replace(line, '- Led ', ''))
WHEN doc_id % 5 = 0 AND line = 'SUMMARY' THEN 'Professional Summary' WHEN doc_id % 7 = 0 AND line LIKE 'Engineer %' THEN concat(line, ' More.') ELSE line END AS line FROM v_resume_lines WHERE NOT (doc_id % 11 = 0 AND line_no = 501)"""


@q("f35_section_diff", sql_with("""SELECT doc_id, section, count(x) AS lines_before, count(y) AS lines_after, count(*) FILTER (x IS DISTINCT FROM y) AS differing FROM (
SELECT doc_id, section, n, a.line AS x, b.line AS y FROM a FULL JOIN b USING (doc_id, section, n)) GROUP BY ALL HAVING count(*) FILTER (x IS DISTINCT FROM y) > 0""", "v_resume_lines", extra=f"""o AS ({OUT_LINES}),
a AS (SELECT doc_id, CASE WHEN line_no < 10 THEN 'Professional Summary' ELSE 'Technical Skills' END AS section, row_number() OVER (PARTITION BY doc_id, line_no < 10 ORDER BY line_no) AS n, trim(line) AS line FROM v_resume_lines WHERE line_no = 2 OR line_no > 500),
b AS (SELECT doc_id, CASE WHEN line_no < 10 THEN 'Professional Summary' ELSE 'Technical Skills' END AS section, row_number() OVER (PARTITION BY doc_id, line_no < 10 ORDER BY line_no) AS n, trim(line) AS line FROM o WHERE line_no = 2 OR line_no > 500)"""))
def _(s, sf):
    return p.section_diff(view(s, sf, "v_resume_lines"), bind(s, sf, OUT_LINES, "v_resume_lines"))


def _bullets(s, sf):
    src = view(s, sf, "v_resume_lines")
    out = bind(s, sf, OUT_LINES, "v_resume_lines")
    pick = lambda d: d.filter("line LIKE '- %'").selectExpr("doc_id", "line_no AS idx", "substring(line, 3) AS text")
    return pick(src), pick(out)


@q("j16_diff_bullets")
def _(s, sf):
    a, b = _bullets(s, sf)
    return p.diff_bullets(a, b, ["doc_id"])


@q("f36_experience_diff")
def _(s, sf):
    return p.experience_diff(view(s, sf, "v_resume_lines"), bind(s, sf, OUT_LINES, "v_resume_lines"))


@q("f34_sequence_similarity")
def _(s, sf):
    return r6(p.sequence_similarity(view(s, sf, "v_pairs"), "pair_id", "src_text", "out_text"), "ratio")


# DuckDB's distance counts bytes, so other signs than ASCII are one and the same here.
@q("f34_levenshtein_similarity", """WITH conv AS (SELECT conv_id, "turn", regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g') AS text FROM conversations) SELECT a.conv_id, a."turn", round(CASE WHEN greatest(length(a.text), length(b.text)) = 0 THEN 1 ELSE 1 - levenshtein(lower(a.text), lower(b.text)) / greatest(length(a.text), length(b.text)) END, 6) AS similarity
FROM conv a JOIN conv b ON b.conv_id = a.conv_id AND b."turn" = a."turn" + 1""")
def _(s, sf):
    c = view(s, sf, "conversations").withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "?"))
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    pairs = c.join(after, ["conv_id", "turn"]).select(F.struct("conv_id", "turn").alias("k"), "text", "b")
    return r6(p.levenshtein_similarity(pairs, "k", "text", "b"), "similarity").select("k.*", "similarity")


_ND = "SELECT doc_id, line_no, concat(line, ' and kept the whole system running for years', CASE WHEN line_no % 20 < 10 THEN ' without trouble' ELSE '' END) AS line, CAST(line_no AS DOUBLE) / 600 AS y FROM v_resume_lines"


@q("j19_near_duplicate_lines", sql_with(rf"""SELECT a.doc_id, a.prefix, any_value(c.n) AS n_lines, count(*) AS n_flagged, bool_or(a.hard) AS hard FROM (
SELECT j.doc_id, j.prefix, j.line_no, bool_or(length(i.t) >= 70 AND length(j.t) >= 70) AS hard FROM pr i JOIN pr j ON i.doc_id = j.doc_id AND i.prefix = j.prefix AND (i.y, i.line_no) < (j.y, j.line_no) AND i.t <> j.t AND round(j.y - i.y, 9) <= 0.22 GROUP BY ALL) a
JOIN (SELECT doc_id, prefix, count(*) AS n FROM pr GROUP BY ALL) c USING (doc_id, prefix) GROUP BY a.doc_id, a.prefix""", "v_resume_lines", extra=rf"""nd AS ({_ND}),
pr AS (SELECT doc_id, line_no, y, lower(trim(line)) AS t, left(lower(trim(line)), 28) AS prefix FROM nd WHERE length(trim(line)) >= 60 AND len(string_split_regex(trim(line), '\s+')) >= 4 AND NOT regexp_matches(trim(line), '^[A-Z\s:./()|-]{{5,}}$') AND y <= 0.70
 AND regexp_replace(lower(string_split(trim(line), ' ')[1]), '[.,;:]+$', '') NOT IN ({", ".join(f"'{v}'" for v in L.ACTION_VERBS)}))"""))
def _(s, sf):
    return p.near_duplicate_lines(bind(s, sf, _ND, "v_resume_lines"), "doc_id", "line_no", "line", "y")


@q("j19_repeated_top_lines", sql_with(r"""SELECT doc_id, prefix, n AS n_lines, f AS n_flagged, coalesce(h, false) AS hard FROM (SELECT doc_id, prefix, count(*) AS n, count(*) FILTER (round(y - py, 9) <= 0.20) AS f FROM (SELECT *, lag(y) OVER (PARTITION BY doc_id, prefix ORDER BY y, line_no) AS py FROM pr) GROUP BY ALL HAVING count(*) FILTER (round(y - py, 9) <= 0.20) > 0)
LEFT JOIN (SELECT doc_id, prefix, true AS h FROM (SELECT *, lag(y) OVER (PARTITION BY doc_id, prefix ORDER BY y, line_no) AS py FROM pr WHERE length(t) >= 55) WHERE round(y - py, 9) <= 0.20 GROUP BY ALL) USING (doc_id, prefix)""", "v_resume_lines", extra=rf"""nd AS ({_ND}),
pr AS (SELECT doc_id, line_no, y, lower(trim(line)) AS t, left(lower(trim(line)), 37) AS prefix FROM nd WHERE length(trim(line)) >= 55 AND len(string_split_regex(trim(line), '\s+')) >= 4 AND NOT regexp_matches(trim(line), '^[A-Z\s:./()|-]{{5,}}$') AND y <= 0.60)"""))
def _(s, sf):
    return p.near_duplicate_lines(
        bind(s, sf, _ND, "v_resume_lines"), "doc_id", "line_no", "line", "y", min_len=55, prefix=37, zone=0.60, dy=0.20,
        allow_equal=True, skip_verbs=False, hard_len=55)


_SP_PARAS = """SELECT doc_id, CASE WHEN line_no < 10 THEN 1 WHEN line_no < 500 THEN 2 ELSE 3 END AS section_id, CASE WHEN line_no < 10 THEN 'summary' WHEN line_no < 500 THEN 'experience' ELSE 'skills' END AS section_type,
CASE WHEN line_no = 2 AND doc_id % 4 = 0 THEN 'Something else entirely, long enough to count here.' WHEN line_no = 501 AND doc_id % 4 IN (0, 1) AND doc_id % 3 <> 0 THEN concat('Note: Engineer working with ', line, ' for a long time now') ELSE concat(line, ' and more words') END AS text FROM v_resume_lines"""
_SP_EXP = "SELECT doc_id, 'Engineer working with machines of every kind' AS summary FROM v_resume_lines WHERE line_no = 1"


@q("j27_summary_presence", sql_with("""SELECT e.doc_id, coalesce(n, 0) AS sections, CASE WHEN n IS NULL THEN 'missing' WHEN n >= 2 THEN 'duplicated' WHEN NOT ins THEN 'misplaced' ELSE 'ok' END AS verdict FROM ex e LEFT JOIN (
SELECT p.doc_id, count(DISTINCT section_id) AS n, bool_or(section_type = 'summary') AS ins FROM pa p JOIN ex USING (doc_id) WHERE length(trim(text)) >= 40 AND contains(left(lower(trim(text)), 80), lower(left(summary, 21))) GROUP BY 1) f ON f.doc_id = e.doc_id""",
                                    "v_resume_lines", extra=f"pa AS ({_SP_PARAS}), ex AS (SELECT doc_id, 'Engineer working with' AS summary FROM v_resume_lines WHERE line_no = 1)"))
def _(s, sf):
    ex = view(s, sf, "v_resume_lines").filter("line_no = 1").select("doc_id", F.lit("Engineer working with").alias("summary"))
    return p.summary_presence(ex, bind(s, sf, _SP_PARAS, "v_resume_lines"))


_TX = "SELECT doc_id, ord AS tid, text FROM v_paras"
_LN = "SELECT doc_id, ord AS lid, CASE WHEN doc_id % 2 = 0 THEN replace(text, 'Text', 'Texture') ELSE 'Nothing alike at all' END AS line FROM v_paras"
_FOUR = "list_transform(list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda w: length(w) > 2), lambda w: left(w, 4))"


@q("f37_prefix_coverage", sql_with(f"""SELECT doc_id, tid, CAST(sum(n) AS BIGINT) AS words, CAST(sum(CASE WHEN h.p IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS covered, sum(n) >= 3 AND sum(CASE WHEN h.p IS NOT NULL THEN n ELSE 0 END) / sum(n) >= 0.85 AS reused FROM (
SELECT doc_id, tid, p, count(*) AS n FROM (SELECT doc_id, tid, unnest({_FOUR.format('text')}) AS p FROM tx) GROUP BY ALL) m LEFT JOIN (SELECT DISTINCT doc_id, unnest({_FOUR.format('line')}) AS p FROM lnn) h USING (doc_id, p) GROUP BY doc_id, tid""",
                                   "v_paras", extra=f"tx AS ({_TX}), lnn AS ({_LN})"))
def _(s, sf):
    return p.prefix_coverage(bind(s, sf, _TX, "v_paras"), bind(s, sf, _LN, "v_paras"), "doc_id", "tid", "text", "line")


@q("f37_container_reuse")
def _(s, sf):
    return p.container_reuse(bind(s, sf, _TX, "v_paras"), bind(s, sf, _LN, "v_paras"), "doc_id", "tid", "lid", "text", "line")
