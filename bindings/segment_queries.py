"""Segment block: W8, W9, W15, W17, A12, A13, F24, F26, F14, A30."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.text_queries import inlist
from bindings.views import sql_with, view
from quire.functions import lexicons as L
from quire.operators import profiles as pr
from quire.operators import segments as g
from quire.plans import cut, cut_laid, hot_keys

QUERIES: dict = {}
SQL: dict = {}


def q(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f
    return add


def bind(s, sf, text, *tables):
    for t in tables:
        view(s, sf, t).createOrReplaceTempView(f"quire_{t}")
        text = text.replace(f"FROM {t}", f"FROM quire_{t}")
    return s.sql(text)


# Lines with unlisted headings, letter spacing, a capitals opener, dates between roles and doubled headers.
LN = """SELECT doc_id, line_no, CASE WHEN line_no = 1 AND doc_id % 5 = 0 THEN 'SENIOR SOFTWARE BUILDER' WHEN line_no = 1 AND doc_id % 5 = 1 THEN 'S U M M A R Y' WHEN line_no = 1 AND doc_id % 5 = 2 THEN 'Jane Doe' WHEN line_no = 2 AND doc_id % 10 = 0 THEN 'Key Facts' WHEN line_no = 2 AND doc_id % 7 = 0 THEN concat('Before any heading there is a long line of prose about ', line)
WHEN line_no = 501 AND doc_id % 4 = 0 THEN 'Key Tools' WHEN line_no = 502 AND doc_id % 8 = 0 THEN 'Big Data' WHEN line_no = 503 AND doc_id % 6 = 0 THEN 'Awards' WHEN line_no % 10 = 1 AND line_no BETWEEN 20 AND 400 AND doc_id % 3 = 0 AND line_no % 20 = 1 THEN 'Acme Corp | Berlin'
WHEN line_no % 10 = 3 AND line_no BETWEEN 20 AND 400 AND doc_id % 4 = 1 THEN 'Jan 2015 - Present' ELSE line END AS line FROM v_resume_lines"""
_KNOWN = [n for ns in L.NAMES_BY_TYPE.values() for n in ns]
_TYPE = "CASE " + " ".join(f"WHEN nm IN {inlist(ns)} THEN '{k}'" for k, ns in L.NAMES_BY_TYPE.items()) + " END"
_SEG = rf"""ln AS ({LN}),
f0 AS (SELECT *, CASE WHEN lower(s) IN {inlist(_KNOWN)} THEN lower(s) WHEN regexp_matches(s, '^\S( \S)+$') THEN lower(replace(s, ' ', '')) ELSE lower(s) END AS nm, string_split_regex(s, '\s+') AS w FROM (SELECT *, trim(line) AS s FROM ln)),
f1 AS (SELECT *, {_TYPE} AS ty, s = upper(s) AND regexp_matches(regexp_replace(s, '[ -]', '', 'g'), '^\p{{L}}+$') AND len(w) >= 3 AND length(s) <= 60 AS caps,
 s <> '' AND NOT regexp_matches(s, '^[-•·–*]') AND NOT regexp_matches(s, '[|,;:]') AND length(s) <= 60 AND NOT regexp_matches(s, '[.!?]$') AND len(w) = 2 AND len(list_filter(w, lambda x: NOT regexp_matches(x, '^\p{{Lu}}'))) = 0 AND NOT regexp_matches(s, '(^|[^0-9A-Za-z_])(19|20)[0-9][0-9]($|[^0-9A-Za-z_])') AND NOT regexp_matches(s, '\p{{Ll}}\p{{Lu}}') AS pair FROM f0),
f2 AS (SELECT *, ty IS NOT NULL OR (caps AND line_no = min(line_no) FILTER (ty IS NOT NULL OR caps) OVER (PARTITION BY doc_id)) AS h0 FROM f1),
f3 AS (SELECT *, last_value(CASE WHEN h0 THEN line_no END IGNORE NULLS) OVER b AS lh, last_value(CASE WHEN h0 THEN coalesce(ty, 'other') END IGNORE NULLS) OVER b AS lt, last_value(CASE WHEN s <> '' AND NOT h0 AND NOT pair THEN line_no END IGNORE NULLS) OVER b AS lb FROM f2 WINDOW b AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f4 AS (SELECT *, h0 OR coalesce(pair AND lh IS NOT NULL AND lt <> 'experience' AND (lb IS NULL OR lb < lh), false) AS ih FROM f3),
seg AS (SELECT doc_id, line_no, line, s, ih AS is_heading, CAST(sum(ih::INT) OVER a AS BIGINT) AS section_no, coalesce(last_value(CASE WHEN ih THEN s END IGNORE NULLS) OVER a, '') AS heading, coalesce(last_value(CASE WHEN ih THEN coalesce(ty, 'other') END IGNORE NULLS) OVER a, '') AS section_type FROM f4 WINDOW a AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING))"""


def seg_hot(s, sf):
    """The segmented lines and the documents too long for one task."""
    hot = hot_keys(view(s, sf, "v_resume_lines"), ["doc_id"])
    return g.segment_sections(bind(s, sf, LN, "v_resume_lines"), hot=hot), hot


def seg(s, sf):
    return seg_hot(s, sf)[0]


@q("w8_segment_sections", sql_with("SELECT doc_id, line_no, line, is_heading, section_no, heading, section_type FROM seg", "v_resume_lines", extra=_SEG))
def _(s, sf):
    return seg(s, sf)


@q("w8_pre_section_prose", sql_with("SELECT doc_id, arg_min(s, line_no) AS prose FROM seg WHERE section_no = 0 AND length(s) >= 60 AND NOT regexp_matches(s, '^[-•·–*0-9]') AND NOT contains(s, '|') AND doc_id NOT IN (SELECT doc_id FROM seg WHERE is_heading AND section_type = 'summary') GROUP BY 1", "v_resume_lines", extra=_SEG))
def _(s, sf):
    return g.pre_section_prose(seg(s, sf))


_ROLE = rf""", r0 AS (SELECT doc_id, section_no, line_no, s, contains(s, '|') AND NOT regexp_matches(s, '^[-•]') AS pipe, regexp_matches(s, '^(?:- |• |● |– )') AS bul, regexp_matches(s, '{L.DATE_LINE}') AS dt, row_number() OVER (PARTITION BY doc_id, section_no ORDER BY line_no) AS n FROM seg WHERE section_type = 'experience' AND NOT is_heading AND s <> ''),
r1 AS (SELECT *, pipe AND (n - coalesce(last_value(CASE WHEN NOT pipe THEN n END IGNORE NULLS) OVER (PARTITION BY doc_id, section_no ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) % 2 = 1 AS op FROM r0),
r2 AS (SELECT *, CAST(sum(op::INT) OVER (PARTITION BY doc_id, section_no ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS role FROM r1),
r3 AS (SELECT *, coalesce(bool_or(bul) OVER (PARTITION BY doc_id, section_no, role ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS seen FROM r2), r4 AS (SELECT *, role > 0 AND seen AND dt AND NOT pipe AND NOT bul AS cl FROM r3),
r5 AS (SELECT *, CASE WHEN role = 0 THEN 'body' WHEN op THEN 'header' WHEN coalesce(bool_or(cl) OVER (PARTITION BY doc_id, section_no, role ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN 'body' WHEN cl THEN 'next_date' WHEN bul OR seen THEN 'bullet' ELSE 'meta' END AS label FROM r4)"""


@q("w9_segment_roles", sql_with("SELECT doc_id, section_no, line_no, role, label, CASE WHEN (label = 'bullet' AND bul) OR (label = 'body' AND starts_with(s, '- ')) THEN s[3:] ELSE s END AS text FROM r5", "v_resume_lines", extra=_SEG + _ROLE))
def _(s, sf):
    d, hot = seg_hot(s, sf)
    return g.segment_roles(d, hot=hot)


_WORDS = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+')"
_FEAT = rf"""SELECT {{keys}}, count(*) AS num_lines, CAST(sum(length(line)) AS BIGINT) AS char_count, count(*) FILTER (regexp_matches(line, '^\s*[-•·▪▸]\s')) AS bullet_count, CAST(sum(len(list_filter({_WORDS.format('line')}, lambda w: regexp_matches(w, '^(19|20)[0-9]{{2}}$')))) AS BIGINT) AS date_count,
CAST(sum(len(regexp_extract_all(line, '[|–—]')) + len(list_filter({_WORDS.format('line')}, lambda w: w = 'at'))) AS BIGINT) AS role_marker_count, CAST(sum(length(line) - length(replace(line, ',', ''))) AS BIGINT) AS comma_count, CAST(sum(length(line) - length(replace(line, ';', ''))) AS BIGINT) AS semicolon_count,
count(*) FILTER (length(line) < 60) AS short_lines, count(*) FILTER (length(line) > 120) AS long_lines, len(list_intersect(list_distinct(flatten(list({_WORDS.format('lower(line)')}))), [{", ".join("'" + w + "'" for w in L.EDUCATION_KEYWORDS)}])) AS education_kw_count,
len(list_intersect(list_distinct(flatten(list({_WORDS.format('lower(line)')}))), [{", ".join("'" + w + "'" for w in L.TECH_KEYWORDS)}])) AS tech_kw_count FROM {{src}} GROUP BY ALL"""
_FX = "SELECT doc_id, section_type, CASE WHEN section_type = 'summary' AND doc_id % 3 = 0 THEN concat(line, ' University degree; college of Kafka at large, Docker') ELSE line END AS line FROM seg WHERE NOT is_heading AND section_no > 0"


def _of_seg(s, sf, text):
    """What ``text`` reads of the segmented lines, and how to write it: small documents stay where they lie."""
    d, hot = seg_hot(s, sf)
    d.createOrReplaceTempView("quire_seg")
    return s.sql(text.replace("FROM seg", "FROM quire_seg")), cut if hot is not None else cut_laid


def _lines(s, sf):
    return _of_seg(s, sf, _FX)[0]


@q("a12_section_features", sql_with("""SELECT doc_id, section_type, num_lines, char_count, bullet_count, date_count, role_marker_count, education_kw_count, tech_kw_count, comma_count, semicolon_count, round(char_count / num_lines, 6) AS avg_line_length, round(bullet_count / num_lines, 6) AS bullet_density, round(date_count / num_lines, 6) AS date_density,
round(comma_count / num_lines, 6) AS comma_density, round(short_lines / num_lines, 6) AS short_line_ratio, round(long_lines / num_lines, 6) AS long_line_ratio FROM ft""", "v_resume_lines", extra=_SEG + f", fx AS ({_FX}), ft AS ({_FEAT.replace('{keys}', 'doc_id, section_type').replace('{src}', 'fx')})"))
def _(s, sf):
    f = g.section_features(_lines(s, sf), ["doc_id", "section_type"])
    dens = ("avg_line_length", "bullet_density", "date_density", "comma_density", "short_line_ratio", "long_line_ratio")
    return f.select("doc_id", "section_type", "num_lines", "char_count", "bullet_count", "date_count", "role_marker_count",
                    F.col("education_kw_count").cast("long").alias("education_kw_count"), F.col("tech_kw_count").cast("long").alias("tech_kw_count"),
                    "comma_count", "semicolon_count", *[F.round(c, 6).alias(c) for c in dens])


def _c(e):
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {e}))"


def _o(e):
    return f"least(1.0::DOUBLE, {e})"


_ND, _NM = _c("1 - dd / 0.10::DOUBLE"), _c("1 - md / 0.10::DOUBLE")
_FORMS = {
    "experience": f"(CASE WHEN dd >= 0.05 THEN {_c('1 - greatest(0.0::DOUBLE, dd - 0.40::DOUBLE) / 0.60::DOUBLE')} ELSE dd / 0.05::DOUBLE END * 0.28::DOUBLE + CASE WHEN bd >= 0.20 THEN {_o('bd / 0.30::DOUBLE')} ELSE bd / 0.20::DOUBLE END * 0.22::DOUBLE + {_o('md / 0.15::DOUBLE')} * 0.20::DOUBLE + {_c('1 - cd / 1.5::DOUBLE')} * 0.12::DOUBLE + {_c('1 - ed * 5')} * 0.08::DOUBLE + {_o('num_lines / 6')} * 0.10::DOUBLE)",
    "skills": f"({_o('cd / 2')} * 0.30::DOUBLE + {_o('td / 0.5::DOUBLE')} * 0.28::DOUBLE + sr * 0.20::DOUBLE + {_ND} * 0.12::DOUBLE + {_NM} * 0.10::DOUBLE)",
    "summary": f"(CASE WHEN num_lines <= 8 THEN {_o('num_lines / 3')} ELSE 0.7::DOUBLE END * 0.20::DOUBLE + (1 - sr) * 0.28::DOUBLE + {_c('1 - bd / 0.30::DOUBLE')} * 0.22::DOUBLE + {_c('1 - md * 4')} * 0.15::DOUBLE + {_c('1 - dd / 0.30::DOUBLE')} * 0.15::DOUBLE)",
}
_COH = "CASE WHEN num_lines < 2 THEN 0.5::DOUBLE " + " ".join(f"WHEN section_type = '{k}' THEN {_c(e)}" for k, e in _FORMS.items()) + " ELSE 0.5::DOUBLE END"
_SRCX = "SELECT doc_id, section_type, CASE WHEN doc_id % 2 = 0 THEN line ELSE replace(line, 'reduced', 'lowered') END AS line FROM fx WHERE doc_id % 9 <> 0"


@q("f24_coherence_scores", sql_with(f"""SELECT doc_id, section_type, num_lines, round({_COH}, 9) AS coherence, round(coalesce(m / nullif(t, 0), 0), 9) AS stale_overlap, coalesce(m / nullif(t, 0), 0) >= 0.70 AND coalesce(sl, 0) >= 2 AND num_lines >= 2 AND section_type NOT IN ('education', 'certifications', 'languages', 'websites') AS stale FROM (
SELECT *, bullet_count / num_lines AS bd, date_count / num_lines AS dd, role_marker_count / num_lines AS md, comma_count / num_lines AS cd, education_kw_count / num_lines AS ed, tech_kw_count / num_lines AS td, short_lines / num_lines AS sr FROM ft)
LEFT JOIN (SELECT doc_id, section_type, sum(least(a, b)) AS m, sum(a) AS t FROM (SELECT doc_id, section_type, tk, count(*) FILTER (side = 's') AS a, count(*) FILTER (side = 'o') AS b FROM tok GROUP BY ALL) GROUP BY ALL) USING (doc_id, section_type) LEFT JOIN (SELECT doc_id, section_type, count(*) AS sl FROM sx GROUP BY ALL) USING (doc_id, section_type)""",
    "v_resume_lines", extra=_SEG + f", fx AS ({_FX}), ft AS ({_FEAT.replace('{keys}', 'doc_id, section_type').replace('{src}', 'fx')}), sx AS ({_SRCX})," + rf"""
tok AS (SELECT doc_id, section_type, side, lower(tk) AS tk FROM (SELECT doc_id, section_type, 's' AS side, unnest(regexp_extract_all(line, '[\p{{L}}\p{{N}}_]+')) AS tk FROM sx UNION ALL SELECT doc_id, section_type, 'o', unnest(regexp_extract_all(line, '[\p{{L}}\p{{N}}_]+')) FROM fx) WHERE regexp_matches(tk, '^[a-zA-Z]{{6,}}$'))""".replace("{{", "{").replace("}}", "}")))
def _(s, sf):
    out, kept = _of_seg(s, sf, _FX)
    out = kept(out)
    out.createOrReplaceTempView("quire_fx")
    return g.coherence_scores(s.sql(_SRCX.replace("FROM fx", "FROM quire_fx")), out)


_OB = "SELECT doc_id, 1 + line_no % 2 + CASE WHEN line_no % 7 = 0 THEN 2 ELSE 0 END AS role, line_no AS idx, line AS text FROM v_resume_lines WHERE line LIKE '- %'"
_SB = "SELECT doc_id, 1 + line_no % 2 AS role, CASE WHEN doc_id % 10 = 0 THEN 0 ELSE count(*) END AS bullets FROM v_resume_lines WHERE line LIKE '- %' AND line_no < 100 GROUP BY doc_id, 1 + line_no % 2"


@q("w17_cap_bullets", sql_with("""SELECT doc_id, role, idx, nth, text FROM (SELECT o.*, row_number() OVER (PARTITION BY o.doc_id, o.role ORDER BY idx) AS nth, coalesce(s.bullets, m.mean, 3) AS n FROM ob o LEFT JOIN sb s ON s.doc_id = o.doc_id AND s.role = o.role LEFT JOIN (SELECT doc_id, CAST(round_even(sum(bullets) / count(*), 0) AS BIGINT) AS mean FROM sb GROUP BY 1) m ON m.doc_id = o.doc_id)
WHERE n = 0 OR nth <= greatest(n + 1, 4)""", "v_resume_lines", extra=f"ob AS ({_OB}), sb AS ({_SB})"))
def _(s, sf):
    return g.cap_bullets(bind(s, sf, _SB, "v_resume_lines"), bind(s, sf, _OB, "v_resume_lines"))


_RD = "SELECT doc_id % 2500 AS doc_id, CASE WHEN ord <= 6 THEN 's1' ELSE 's2' END AS section_id, concat('r', CAST(doc_id % 5 AS STRING)) AS role_id, CASE WHEN doc_id % 2500 % 7 = 0 AND ord <= 6 THEN 'header' ELSE CASE parser_semantic WHEN 'paragraph' THEN 'body' WHEN 'role_header' THEN 'header' WHEN 'role_meta' THEN 'meta' ELSE 'bullet' END END AS place, text FROM v_paras"


@q("a13_role_density", sql_with("""SELECT s.doc_id, coalesce(r.roles, 0) AS roles, coalesce(empty, 0) AS empty, coalesce(dense, 0) AS dense, greatest(0, 100 - CASE WHEN coalesce(r.roles, 0) > 0 THEN CASE WHEN empty * 2 > r.roles THEN 35 WHEN empty * 4 > r.roles THEN 15 ELSE 0 END + least(20, dense * 7) ELSE 0 END - CASE WHEN coalesce(content, 0) < n * 2 THEN 20 ELSE 0 END) AS score, coalesce(r.roles >= 2 AND empty = r.roles AND coalesce(bc, 0) < 100, false) AS hard
FROM (SELECT doc_id, count(DISTINCT section_id) AS n, count(*) FILTER (place <> 'header') AS content FROM rd GROUP BY 1) s LEFT JOIN (SELECT doc_id, count(*) AS roles, count(*) FILTER (b = 0) AS empty, count(*) FILTER (b > 12) AS dense FROM (SELECT doc_id, role_id, count(*) FILTER (place = 'bullet') AS b FROM rd WHERE section_id = 's1' AND place <> 'body' GROUP BY ALL) GROUP BY 1) r ON r.doc_id = s.doc_id
LEFT JOIN (SELECT doc_id, sum(CASE WHEN length(trim(text)) > 20 THEN length(trim(text)) ELSE 0 END) AS bc FROM rd WHERE section_id = 's1' AND place = 'body' GROUP BY 1) b ON b.doc_id = s.doc_id""", "v_paras", extra=f"rd AS ({_RD})"))
def _(s, sf):
    p = bind(s, sf, _RD, "v_paras")
    sec = p.select("doc_id", "section_id").distinct().withColumn("semantic_type", F.when(F.col("section_id") == "s1", "experience").otherwise("other"))
    return g.role_density(p, sec)


ENRICH = """SELECT doc_id % 700 AS doc_id, CASE WHEN ord % 2 = 0 THEN 's1' ELSE 's2' END AS section_id, CASE WHEN ord % 2 = 1 AND doc_id % 700 % 3 = 0 THEN 'Projects' ELSE 'Experience' END AS raw_title, doc_id * 100 + ord AS ord, parser_semantic, (doc_id + ord) % 3 = 0 AS in_meta, (doc_id + ord) % 3 = 1 AS in_bullets,
CASE (doc_id * 7 + ord * 5) % 13 WHEN 0 THEN 'Tools: Kafka, Docker' WHEN 1 THEN 'Highlights: much' WHEN 2 THEN 'Databases: MySQL, Oracle' WHEN 3 THEN 'a link Portfolio' WHEN 4 THEN 'Chess engine 2021' WHEN 5 THEN 'Payments project' WHEN 6 THEN 'Contribution to the internal project that keeps the service portal of the whole group running' WHEN 7 THEN 'Worked closely with several product teams.'
WHEN 8 THEN 'and helped them to grow over the years' WHEN 9 THEN 'Backend Development' WHEN 10 THEN '*Helping people*' WHEN 11 THEN 'Responsible for many things at once.' ELSE text END AS text FROM v_paras"""


@q("w15_enrich_paragraphs")
def _(s, sf):
    return g.enrich_paragraphs(g.with_hints(bind(s, sf, ENRICH, "v_paras"))).filter("event <> ''")


_INJ_T = "SELECT doc_id, CASE section_type WHEN 'summary' THEN 'summary' WHEN 'experience' THEN 'experience' WHEN 'skills' THEN 'skills' END AS section, line FROM seg WHERE NOT is_heading"
_INJ_R = "SELECT doc_id, CASE WHEN doc_id % 6 = 0 AND section = 'summary' THEN NULL ELSE section END AS section, CASE WHEN doc_id % 5 = 0 THEN regexp_replace(line, '[A-Za-z]+e', 'x') WHEN doc_id % 11 = 0 THEN concat('[FirstName] ', line) WHEN doc_id % 31 = 0 THEN 'Lorem Ipsum' ELSE line END AS line FROM it"
_INJ_O = "SELECT doc_id, section, CASE WHEN doc_id % 5 = 0 THEN regexp_replace(line, '[A-Za-z]+e', 'x') ELSE 'template wording only' END AS line FROM it"


def _ct(c):
    from quire.operators.pairs import OVERLAP_STOP_WORDS
    return rf"list_distinct(list_filter(regexp_extract_all(lower(regexp_replace({c}, '([0-9])([A-Za-z])', '\1 \2', 'g')), '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_matches(w, '^[a-z]{{4,}}$') AND w NOT IN {inlist(OVERLAP_STOP_WORDS)}))"


@q("f26_injection_score", sql_with("""SELECT d.doc_id, round(coalesce(found / words, 0), 9) AS recall, coalesce(bad, 0) AS failed_sections, CASE WHEN lorem THEN 0 ELSE greatest(0, 100 - CASE WHEN ph THEN 25 ELSE 0 END - CASE WHEN words IS NULL OR found / words >= 0.80 THEN 0 WHEN found / words >= 0.50 THEN 15 WHEN found / words >= 0.25 THEN 30 ELSE 50 END) END AS score,
lorem OR coalesce(bad, 0) > 0 OR coalesce(found / words < 0.10, false) AS hard FROM (SELECT doc_id, bool_or(contains(lower(line), '[firstname]')) AS ph, bool_or(contains(lower(line), 'lorem ipsum')) AS lorem FROM ir GROUP BY 1) d
LEFT JOIN (SELECT doc_id, count(*) AS words, count(*) FILTER ((doc_id, w) IN (SELECT doc_id, w FROM fv)) AS found FROM (SELECT DISTINCT doc_id, w FROM tv) GROUP BY 1) x ON x.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS bad FROM (SELECT t.doc_id, t.section, CASE t.section WHEN 'summary' THEN 1.0 WHEN 'experience' THEN 0.55 ELSE 0.35 END AS fl, t.r / t.n AS rr, t.f / t.n AS ff, (t.doc_id, t.section) IN (SELECT doc_id, section FROM rv) AS has, u.i / u.u AS jac, u.na, u.nb FROM (
 SELECT doc_id, section, count(*) AS n, count(*) FILTER ((doc_id, section, w) IN (SELECT doc_id, section, w FROM rv)) AS r, count(*) FILTER ((doc_id, w) IN (SELECT doc_id, w FROM fv)) AS f FROM tv GROUP BY ALL) t
 LEFT JOIN (SELECT doc_id, section, count(*) FILTER (a AND b) AS i, count(*) AS u, count(*) FILTER (a) AS na, count(*) FILTER (b) AS nb FROM (SELECT doc_id, section, w, bool_or(k = 1) AS a, bool_or(k = 2) AS b FROM (SELECT *, 1 AS k FROM rv UNION ALL SELECT *, 2 FROM ov) GROUP BY ALL) GROUP BY ALL) u ON u.doc_id = t.doc_id AND u.section = t.section)
 WHERE CASE WHEN has THEN rr < fl ELSE ff < CASE WHEN section = 'summary' THEN 0.95 ELSE fl END END OR (has AND na > 0 AND nb > 0 AND jac >= 0.95 AND rr < 0.80) GROUP BY 1) y ON y.doc_id = d.doc_id""", "v_resume_lines",
    extra=_SEG + f", it AS ({_INJ_T}), ir AS ({_INJ_R.replace(', ' + chr(39) + 'x' + chr(39) + ')', ', ' + chr(39) + 'x' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}), io AS ({_INJ_O.replace(', ' + chr(39) + 'x' + chr(39) + ')', ', ' + chr(39) + 'x' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}), tv AS (SELECT DISTINCT doc_id, section, unnest({_ct('line')}) AS w FROM it WHERE section IS NOT NULL), rv AS (SELECT DISTINCT doc_id, section, unnest({_ct('line')}) AS w FROM ir WHERE section IS NOT NULL), ov AS (SELECT DISTINCT doc_id, section, unnest({_ct('line')}) AS w FROM io WHERE section IS NOT NULL), fv AS (SELECT DISTINCT doc_id, unnest({_ct('line')}) AS w FROM ir)"))
def _(s, sf):
    it, kept = _of_seg(s, sf, _INJ_T)
    it = kept(it)
    it.createOrReplaceTempView("quire_it")
    return g.injection_score(it, s.sql(_INJ_R.replace("FROM it", "FROM quire_it")), s.sql(_INJ_O.replace("FROM it", "FROM quire_it")))


_ITEMS = """[' "' || p_name || '",', replace(p_name, ' ', '_'), replace(p_name, ' ', '_') || ' kafka_' || p_type || ' REST_api', '\\"' || p_brand || '\\"', 'He said "hi" ' || p_type, '"open ' || p_type, upper(p_type), p_type, '', ' , ', 'sql_' || p_size || '_JSON']"""


def _strip(e):
    return rf"regexp_replace({e}, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g')"


def _san(e):
    comma = lambda x: _strip(f"regexp_replace({x}, ',$', '')")
    a = comma(_strip(e))
    a = rf"""regexp_replace({a}, '^(?:\\"\s*)+', '')"""
    a = comma(_strip(rf"""regexp_replace({a}, '(?:\s*\\")+$', '')"""))
    return a


_CASED = "coalesce(map_extract(" + "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in L.PROPER_NOUNS.items()) + "}, lower(p))[1], CASE WHEN regexp_matches(p, '^[A-Z][A-Z0-9]*$') THEN p WHEN i = 1 THEN upper(p[1]) || lower(p[2:]) ELSE lower(p) END)"
_PROF = rf"""items AS (SELECT p_partkey, unnest(a) AS raw, generate_subscripts(a, 1) AS pos FROM (SELECT p_partkey, {_ITEMS} AS a FROM part)),
s1 AS (SELECT p_partkey, pos, raw, {_san('raw')} AS s FROM items),
s2 AS (SELECT p_partkey, pos, raw, {_strip("regexp_replace(" + _strip('''CASE WHEN regexp_matches(s, '(?s)^".*"$') THEN regexp_replace(s, '(?s)^"(.*)"$', '\\1') WHEN starts_with(s, '"') AND len(regexp_extract_all(s, '"')) = 1 THEN s[2:] WHEN ends_with(s, '"') AND len(regexp_extract_all(s, '"')) = 1 THEN s[:-2] ELSE s END''') + ", ',$', '')")} AS s FROM s1),
s3 AS (SELECT p_partkey, pos, unnest(CASE WHEN contains(s, ' ') AND len(list_filter(string_split_regex(s, '\s+'), lambda x: contains(x, '_'))) >= 2 THEN list_filter(string_split_regex(s, '\s+'), lambda x: x <> '') ELSE [s] END) AS s, generate_subscripts(CASE WHEN contains(s, ' ') AND len(list_filter(string_split_regex(s, '\s+'), lambda x: contains(x, '_'))) >= 2 THEN list_filter(string_split_regex(s, '\s+'), lambda x: x <> '') ELSE [s] END, 1) AS sub FROM s2 WHERE s <> ''),
s4 AS (SELECT p_partkey, pos, sub, CASE WHEN contains(s, '_') THEN array_to_string(list_transform(list_filter(string_split({_strip('s')}, '_'), lambda x: x <> ''), lambda p, i: {_CASED}), ' ') ELSE {_strip('s')} END AS v FROM s3),
s5 AS (SELECT p_partkey, string_agg(v, '|' ORDER BY pos, sub) AS items FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey, lower(v) ORDER BY pos, sub) AS rn FROM s4) WHERE rn = 1 GROUP BY 1)"""


def _profiles(s, sf):
    n, ty = F.col("p_name"), F.col("p_type")
    us = F.replace(n, F.lit(" "), F.lit("_"))
    arr = F.array(
        F.concat(F.lit(' "'), n, F.lit('",')), us, F.concat(us, F.lit(" kafka_"), ty, F.lit(" REST_api")), F.concat(F.lit('\\"'), "p_brand", F.lit('\\"')),
        F.concat(F.lit('He said "hi" '), ty), F.concat(F.lit('"open '), ty), F.upper(ty), ty, F.lit(""), F.lit(" , "),
        F.concat(F.lit("sql_"), F.col("p_size").cast("string"), F.lit("_JSON")))
    return view(s, sf, "part").select("p_partkey", arr.alias("skills"))


@q("f14_normalize_profiles", "WITH " + _PROF + " SELECT p_partkey, items FROM s5")
def _(s, sf):
    return pr.normalize_profiles(_profiles(s, sf), ["skills"]).select("p_partkey", F.array_join("skills", "|").alias("items"))


@q("f14_migrate_profiles", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'old|' || p_brand ELSE 'old' END AS auth, CASE WHEN p_partkey % 2 = 0 THEN 'note' ELSE '' END AS claims, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE '' END AS scale, CASE WHEN p_partkey % 2 = 0 THEN 'c0|sc' ELSE 'c0' END AS first_light, 'c1' AS second_light FROM part")
def _(s, sf):
    d = view(s, sf, "part").selectExpr(
        "p_partkey", "named_struct('security_auth_patterns', array('old'), 'scalability_reliability_patterns', CAST(NULL AS ARRAY<STRING>)) AS technical_skills",
        "named_struct('security_auth', CAST(NULL AS ARRAY<STRING>)) AS claim_boundaries",
        "array(named_struct('constraints_and_tradeoffs', array('c0')), named_struct('constraints_and_tradeoffs', array('c1'))) AS experience_highlights",
        "CASE WHEN p_partkey % 2 = 0 THEN named_struct('implemented', array(p_brand), 'notes', array('note'), 'scalability_challenges', array('sc')) END AS authz_authn_experience",
        "CASE WHEN p_partkey % 3 = 0 THEN array(p_type) END AS scalability_reliability_patterns")
    twice = pr.migrate_profiles(pr.migrate_profiles(d))
    j = lambda c: F.array_join(c, "|")
    return twice.select(
        "p_partkey", j("technical_skills.security_auth_patterns").alias("auth"), j("claim_boundaries.security_auth").alias("claims"),
        j("technical_skills.scalability_reliability_patterns").alias("scale"), j(F.col("experience_highlights")[0]["constraints_and_tradeoffs"]).alias("first_light"),
        j(F.col("experience_highlights")[1]["constraints_and_tradeoffs"]).alias("second_light"))


_CHANGED = "(contains(p_name, ' ') AND p_partkey % 2 = 0 OR p_partkey % 5 = 0)"


def _part_profiles(s, sf):
    d = view(s, sf, "part").select("p_partkey", F.when(F.col("p_size") % 3 > 0, F.col("p_size") % 3 == 1).alias("prompt_synched"), F.array(
        F.when(F.col("p_partkey") % 2 == 0, F.replace("p_name", F.lit(" "), F.lit("_"))).otherwise(F.col("p_name")),
        F.when(F.col("p_partkey") % 5 == 0, F.concat("p_type", F.lit(","))).otherwise(F.concat("p_type", F.lit(" x")))).alias("skills"))
    return pr.normalize_profiles(d, ["skills"])


@q("a30_backfill_report", f"SELECT count(*) AS total, count(*) FILTER {_CHANGED.replace('(', '(WHERE ', 1)} AS changed, count(*) FILTER (WHERE NOT {_CHANGED}) AS unchanged FROM part")
def _(s, sf):
    return pr.backfill_report(_part_profiles(s, sf))


@q("a30_mark_unsynched", f"SELECT p_partkey, CASE WHEN {_CHANGED} THEN false WHEN p_size % 3 > 0 THEN p_size % 3 = 1 END AS prompt_synched FROM part")
def _(s, sf):
    return pr.mark_unsynched(_part_profiles(s, sf)).select("p_partkey", "prompt_synched")


_UD = f"CASE WHEN lower(trim(line)) IN {inlist(_KNOWN)} THEN 1 ELSE 0 END"


@q("x3_split_sections", sql_with(f"""SELECT doc_id, CAST(line_no AS INT) AS line_no, CAST(sum(h) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS INT) AS section_no, line FROM (
SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS line_no, CASE WHEN lower(trim(unnest(lines))) IN {inlist(_KNOWN)} THEN 1 ELSE 0 END AS h FROM (SELECT doc_id, string_split(concat('Summary', chr(10), text, chr(10), ' SKILLS', chr(10), lang), chr(10)) AS lines FROM documents))"""))
def _(s, sf):
    s.udtf.register("split_sections", g.split_sections_udtf())
    view(s, sf, "documents").createOrReplaceTempView("quire_documents")
    return s.sql("""SELECT d.doc_id, t.line_no, t.section_no, t.line FROM quire_documents d,
LATERAL split_sections(concat('Summary', char(10), d.text, char(10), ' SKILLS', char(10), d.lang)) t""")
