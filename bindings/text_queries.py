"""Text block: F1-F4, F11-F13, F15-F20, F27, F28, P6, P8, P9, P12, A25, A26, A28, U5, W10, W18."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.views import sql_with, view
from quire.functions import lexicons as L
from quire.functions import text as t
from quire.operators import texts as x

QUERIES: dict = {}
SQL: dict = {}


def q(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f
    return add


def strip(e):
    return rf"regexp_replace({e}, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g')"


def inlist(names):
    return "(" + ", ".join("'" + n + "'" for n in names) + ")"


_CLEAN = rf"regexp_replace({{}}, '[\x{{e000}}-\x{{f8ff}}]', '', 'g')"
_F1 = strip(rf"""regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(src, '[\x{{e000}}-\x{{f8ff}}]', '', 'g'), '^[\s\x{{a0}}]+', ''), '^[•·▪▸◦→›●○■□◆◇✓✔✗✘][\s\x{{a0}}]+', '• '), '—', ' - '), '–', ' - '), '[\s\x{{a0}}]+', ' ', 'g')""")
_F1_SRC = "SELECT doc_id, lang, concat(CASE doc_id % 4 WHEN 0 THEN concat(chr(57344), ' ▪  ') WHEN 1 THEN '  ● ' WHEN 2 THEN concat('a—b', chr(160), chr(160), '–') ELSE '' END, text) AS src FROM documents"


def _f1_src(s, sf):
    d = view(s, sf, "documents")
    return d.select("doc_id", "lang", F.concat(
        F.when(F.col("doc_id") % 4 == 0, " ▪  ").when(F.col("doc_id") % 4 == 1, "  ● ")
        .when(F.col("doc_id") % 4 == 2, "a—b  –").otherwise(""), "text").alias("src"))


@q("f1_clean_text_corpus", f"SELECT doc_id, {_F1} AS clean, {_F1} <> src AS changed FROM ({_F1_SRC})")
def _(s, sf):
    return x.clean_text_corpus(_f1_src(s, sf), "src").select("doc_id", "clean", "changed")


@q("f1_change_counts", f'SELECT lang, count(*) AS "rows", count(*) FILTER ({_F1} <> src) AS changed_rows FROM ({_F1_SRC}) GROUP BY lang')
def _(s, sf):
    return x.change_counts(x.clean_text_corpus(_f1_src(s, sf), "src"), ["lang"])


_F2_SRC = "SELECT doc_id, concat(CASE doc_id % 3 WHEN 0 THEN concat('ef', chr(64257), chr(8203), 'x', chr(160), '    y') WHEN 1 THEN concat('a', chr(19), 'b', chr(1), chr(8201)) ELSE '' END, text) AS src FROM documents"
_F2 = "src"
for _bad, _good in L.LIGATURES.items():
    _F2 = f"replace({_F2}, chr({ord(_bad)}), '{_good}')"
for _c in L.SPACE_VARIANTS:
    _F2 = f"replace({_F2}, chr({ord(_c)}), ' ')"
for _c in L.INVISIBLE:
    _F2 = f"replace({_F2}, chr({ord(_c)}), '')"
for _c, _g in ((0x13, "–"), (0x96, "–"), (0x97, "—")):
    _F2 = f"replace({_F2}, chr({_c}), '{_g}')"
_F2 = strip(rf"regexp_replace(regexp_replace({_F2}, '[\x01-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), ' {{3,}}', '  ', 'g')")


@q("f2_unicode_cleanup", f"SELECT doc_id, {_F2} AS clean, {_F2} <> src AS changed FROM ({_F2_SRC})")
def _(s, sf):
    d = view(s, sf, "documents").select("doc_id", F.concat(
        F.when(F.col("doc_id") % 3 == 0, "efﬁ​x     y").when(F.col("doc_id") % 3 == 1, "a\u0013b\u0001 ").otherwise(""),
        "text").alias("src"))
    return x.unicode_cleanup(d, "src").select("doc_id", "clean", "changed")


_HEADS = """SELECT page_id, CASE page_id % 8 WHEN 0 THEN '1. Work Experience' WHEN 1 THEN 'Education & Training' WHEN 2 THEN 'S U M M A R Y' WHEN 3 THEN concat('T E C H N I C A L', chr(160), 'S K I L L S')
WHEN 4 THEN '(2) SKILLS:' WHEN 5 THEN '  Languages and Frameworks ' WHEN 6 THEN h1 ELSE 'Tech Stack' END AS heading FROM (SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g')) AS h1 FROM pages)"""


def _heads(s, sf):
    from quire.operators.web import page_meta
    p = page_meta(view(s, sf, "pages").select("page_id", "html"))
    k = F.col("page_id") % 8
    return p.select("page_id", F.when(k == 0, "1. Work Experience").when(k == 1, "Education & Training").when(k == 2, "S U M M A R Y")
                    .when(k == 3, "T E C H N I C A L S K I L L S").when(k == 4, "(2) SKILLS:").when(k == 5, "  Languages and Frameworks ")
                    .when(k == 6, F.coalesce("h1", F.lit(""))).otherwise("Tech Stack").alias("heading"))


_ALIAS = "CASE key_b " + " ".join(f"WHEN '{a}' THEN '{k}'" for k, names in L.SECTION_ALIASES.items() for a in names) + " ELSE '' END"
_SP = r"""lower(CASE WHEN regexp_matches(sh, '^[^\s\x{a0}](?:[ \t]+[^\s\x{a0}])*(?:[ \t]*\x{a0}[ \t\x{a0}]*[^\s\x{a0}](?:[ \t]+[^\s\x{a0}])*)*$')
 THEN replace(regexp_replace(regexp_replace(sh, '[ \t]*\x{a0}[ \t\x{a0}]*', chr(1), 'g'), '[ \t]+', '', 'g'), chr(1), ' ') ELSE heading END)"""


@q("f3_heading_keys", rf"""SELECT page_id, heading, key_a, key_b, {_ALIAS} AS canonical, {_SP} AS unspaced, key_a IN {inlist(L.KNOWN_SECTION_KEYS)} AS known_section FROM (
SELECT *, {strip('heading')} AS sh, regexp_replace(regexp_replace({strip('lower(heading)')}, '^[0-9.\s()]+', ''), '[^a-z0-9]', '', 'g') AS key_a,
{strip(r"regexp_replace(regexp_replace(regexp_replace(replace(" + strip('lower(heading)') + r", '&', 'and'), '^[0-9]+[.\s]+', ''), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g')")} AS key_b FROM ({_HEADS}))""")
def _(s, sf):
    return x.heading_keys(_heads(s, sf), "heading").withColumn("canonical", F.coalesce("canonical", F.lit("")))


_GLUE = """SELECT doc_id, line_no, CASE WHEN line = 'Experience' AND doc_id % 2 = 0 THEN 'EDUCATIONReally Great University' WHEN line = 'SUMMARY' AND doc_id % 3 = 0 THEN 'SUMMARYMaster Degree'
WHEN line = 'SUMMARY' AND doc_id % 3 = 1 THEN 'Current Date: 2024' WHEN line = 'Technical Skills' AND doc_id % 5 = 0 THEN 'TECHNICAL SKILLSPython, Kafka' ELSE line END AS line FROM v_resume_lines"""
_KNOWN_NOSUM = [n for k, ns in L.NAMES_BY_TYPE.items() if k != "summary" for n in ns]


@q("f4_split_glued_headings", sql_with(rf"""SELECT doc_id, line_no, CAST(u.part AS INT) AS part, CASE WHEN glued THEN CASE u.part WHEN 1 THEN head ELSE tail END ELSE line END AS line FROM (
SELECT *, lower(head) IN {inlist(_KNOWN_NOSUM)} AS glued FROM (SELECT *, trim(regexp_extract(trim(line), '^([A-Z][A-Z &/]{{2,}}?)([A-Z][a-z].*)$', 1)) AS head, regexp_extract(trim(line), '^([A-Z][A-Z &/]{{2,}}?)([A-Z][a-z].*)$', 2) AS tail
FROM g WHERE NOT regexp_matches(line, '(?i)^\s*Current\s+Date\s*:'))), (SELECT 1 AS part UNION ALL SELECT 2) u WHERE u.part = 1 OR glued""", "v_resume_lines", extra=f"g AS ({_GLUE})"))
def _(s, sf):
    view(s, sf, "v_resume_lines").createOrReplaceTempView("quire_v_resume_lines")
    return x.split_glued_headings(s.sql(_GLUE.replace("FROM v_resume_lines", "FROM quire_v_resume_lines")))


_CV = """SELECT doc_id, concat(CASE doc_id % 5 WHEN 0 THEN 'Jane Q. Doe jane.doe@mail.example.com +1 (555) 123-4567' WHEN 1 THEN concat('12345', chr(10), 'Ada Lovelace linkedin.com/in/ada-l github.com/adal') WHEN 2 THEN concat(chr(10), 'PROFILE', chr(10), 'One line', chr(10), 'Two line') ELSE '' END, chr(10), text) AS text FROM documents"""
_EM, _PH = L.EMAIL, L.PHONE
_STRIPPED = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(l, '{_EM}', '', 'g'), '{_PH}', '', 'g'), '{L.LINKEDIN}', '', 'g'), '{L.GITHUB}', '', 'g')"
_RUN = rf"""string_split_regex({strip(r"regexp_extract(array_to_string(list_transform(string_split_regex(" + strip(_STRIPPED) + r", '\s+'), lambda w: CASE WHEN regexp_matches(regexp_replace(w, '[^\p{L}]', '', 'g'), '^\p{Lu}\p{L}') THEN regexp_replace(w, '[^\p{L}]', '', 'g') ELSE '|' END), ' '), '^[| ]*([^|]+)', 1)")}, ' +')"""


@q("f11_contact_extraction", rf"""SELECT doc_id, regexp_extract(text, '({_EM})', 1) AS email, {strip(f"regexp_extract(left(text, 500), '({_PH})', 1)")} AS phone,
regexp_extract(text, '(?i)(linkedin\.com/in/[\p{{L}}\p{{N}}_-]+)', 1) AS linkedin, regexp_extract(text, '(?i)(github\.com/[\p{{L}}\p{{N}}_-]+)', 1) AS github,
coalesce(array_to_string(list_filter(list_transform(lines[1:8], lambda l: {_RUN}), lambda r: len(r) >= 2)[1][1:4], ' '), 'Unknown') AS name,
CASE WHEN pos = 0 THEN '' ELSE array_to_string(list_transform(lines[pos + 1 : pos + 3], lambda l: {strip('l')}), ' ') END AS summary
FROM (SELECT *, coalesce(list_position(list_transform(lines, lambda l: regexp_matches(l, '(?i)\b(summary|profile|objective)\b')), true), 0) AS pos
FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda l: {strip('l')} <> '') AS lines FROM ({_CV})))""")
def _(s, sf):
    k = F.col("doc_id") % 5
    d = view(s, sf, "documents").select("doc_id", F.concat(
        F.when(k == 0, "Jane Q. Doe jane.doe@mail.example.com +1 (555) 123-4567").when(k == 1, "12345\nAda Lovelace linkedin.com/in/ada-l github.com/adal")
        .when(k == 2, "\nPROFILE\nOne line\nTwo line").otherwise(""), F.lit("\n"), "text").alias("text"))
    return x.contact_extraction(d).drop("text")


_YEARS = r"list_transform(list_filter(regexp_extract_all(line, '[\p{L}\p{N}_]+'), lambda w: regexp_matches(w, '^(19|20)[0-9]{2}$')), lambda w: CAST(w AS INT))"


@q("f12_date_signals", sql_with(rf"""SELECT doc_id, line_no, len(ys) > 0 AS has_year, len(ys) > 0 AND NOT contains(line, '|') AND length({strip('line')}) < 60 AS is_date_line,
regexp_matches(line, '{L.DATE_LINE}') AS is_range, contains(lower(line), 'present') OR contains(lower(line), 'current') AS open_ended, coalesce(list_min(ys), 0) AS min_year, coalesce(list_max(ys), 0) AS max_year
FROM (SELECT *, {_YEARS} AS ys FROM v_resume_lines)""", "v_resume_lines"))
def _(s, sf):
    return x.date_signals(view(s, sf, "v_resume_lines")).drop("line")


_LETTER = "concat('March 5, 2024', chr(10), 'Dear ACME Corp, as of JUNE 12th 2021 I apply for Senior Engineer.', chr(10), text)"


@q("f13_replace_fields", rf"""SELECT doc_id, replace(replace(regexp_replace({_LETTER}, '{L.LETTER_DATE}', 'July 1, 2026', 'g'), 'ACME Corp', concat('Source ', source)), 'Senior Engineer', concat('Role ', lang)) AS letter FROM documents""")
def _(s, sf):
    d = view(s, sf, "documents").select(
        "doc_id", F.concat(F.lit("March 5, 2024\nDear ACME Corp, as of JUNE 12th 2021 I apply for Senior Engineer.\n"), "text").alias("text"),
        F.concat(F.lit("Source "), "source").alias("company"), F.concat(F.lit("Role "), "lang").alias("title"))
    return x.replace_fields(d, "text", "ACME Corp", "Senior Engineer", "company", "title", F.lit("July 1, 2026")).select("doc_id", "letter")


@q("f15_hash_keys", rf"""SELECT doc_id, sha256({strip(r"regexp_replace(regexp_replace(src, '\r\n?', chr(10), 'g'), '[ \t\x0B\f\x{a0}]+\n', chr(10), 'g')")} || chr(10)) AS text_hash
FROM (SELECT doc_id, replace(text, chr(10), CASE WHEN doc_id % 2 = 0 THEN concat('  ', chr(13), chr(10)) ELSE concat(chr(9), chr(10)) END) AS src FROM documents)""")
def _(s, sf):
    d = view(s, sf, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.when(F.col("doc_id") % 2 == 0, "  \r\n").otherwise("\t\n")).alias("src"))
    return x.hash_keys(d, "src").drop("src")


_TR = f"translate(text, '{L.ACCENTS_FROM}', '{L.ACCENTS_TO}')"


@q("f16_slugs", rf"""SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace({strip(rf"regexp_replace({_TR}, '[^\x01-\x7F]', '', 'g')")}, '\s+', '_', 'g'), '[^A-Za-z0-9_]', '', 'g'), ''), 'Unknown') AS slug,
regexp_replace(regexp_replace(regexp_replace(text, '[^A-Za-z0-9_-]', '_', 'g'), '^_+|_+$', '', 'g'), '_+', '_', 'g') AS file_name FROM documents""")
def _(s, sf):
    c = F.col("text")
    return view(s, sf, "documents").select("doc_id", t.slug(c).alias("slug"), t.file_safe(c).alias("file_name"))


_FENCE = """SELECT event_id, CASE event_id % 3 WHEN 0 THEN concat('```json', chr(10), props, chr(10), '```') WHEN 1 THEN props ELSE concat('  ```', chr(10), props, CASE WHEN event_id % 2 = 0 THEN ' broken{' ELSE '' END) END AS raw FROM events"""


@q("f17_code_fence_strip", """SELECT event_id, CASE WHEN event_id % 3 = 2 AND event_id % 2 = 0 THEN props || ' broken{' ELSE props END AS body, event_id % 3 = 2 AND event_id % 2 = 0 AS rejected,
CASE WHEN event_id % 3 = 2 AND event_id % 2 = 0 THEN -1 ELSE CAST(props ->> '$.k' AS INT) END AS k FROM events""")
def _(s, sf):
    view(s, sf, "events").createOrReplaceTempView("quire_events")
    d = s.sql(_FENCE.replace("FROM events", "FROM quire_events").replace("chr(10)", "char(10)"))
    return x.parse_fenced_json(d, "raw", "k int").select("event_id", "body", "rejected", F.when(F.col("rejected"), -1).otherwise(F.col("payload.k")).alias("k"))


_LT = """SELECT doc_id, concat('12 Main Road', chr(10), CASE doc_id % 3 WHEN 0 THEN 'Dear team,' WHEN 1 THEN 'Oh Dear you' ELSE 'Hello' END, chr(13), chr(10), CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10), concat(chr(10), chr(10), chr(10))) ELSE text END,
chr(10), chr(10), 'Sincerely,', chr(10), chr(10), 'Me') AS text FROM documents"""


def _letters(s, sf):
    view(s, sf, "documents").createOrReplaceTempView("quire_documents")
    return s.sql(_LT.replace("FROM documents", "FROM quire_documents").replace("chr(", "char("))


_PARAS = rf"""(SELECT doc_id, list_filter(list_transform(string_split(regexp_replace({strip("array_to_string(lines[st + 1:], chr(10))")}, '\n{{3,}}', chr(10) || chr(10), 'g'), chr(10) || chr(10)), lambda p: {strip('p')}), lambda p: p <> '') AS ps FROM (
SELECT *, coalesce(list_position(list_transform(lines, lambda l: regexp_matches({strip('l')}, '(?i)^Dear\b')), true), list_position(list_transform(lines, lambda l: regexp_matches(l, '(?i)\bDear\b')), true), 0) AS st
FROM (SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS lines FROM ({_LT}))))"""


@q("f18_letter_paragraphs", f"SELECT doc_id, len(ps) AS n, coalesce(ps[1], '') AS first_paragraph, array_to_string(ps, '#') AS body FROM {_PARAS}")
def _(s, sf):
    p = x.letter_paragraphs(_letters(s, sf))
    return p.select("doc_id", F.size("paragraphs").cast("long").alias("n"), F.coalesce(F.get("paragraphs", F.lit(0)), F.lit("")).alias("first_paragraph"),
                    F.array_join("paragraphs", "#").alias("body"))


@q("f18_collapse_letter", rf"""SELECT doc_id, CASE WHEN c = 0 THEN array_to_string(list_filter(lines, lambda l: {strip('l')} <> ''), chr(10))
ELSE array_to_string(list_filter(lines[1:c - 1], lambda l: {strip('l')} <> ''), chr(10)) || chr(10) || chr(10) || array_to_string(list_filter(lines[c:], lambda l: {strip('l')} <> ''), chr(10)) END AS letter
FROM (SELECT *, coalesce(list_position(list_transform(lines, lambda l: starts_with(lower({strip('l')}), 'sincerely')), true), 0) AS c FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM ({_LT})))""")
def _(s, sf):
    return x.collapse_letter(_letters(s, sf)).select("doc_id", "letter")


_SPANS = "SELECT doc_id, 'P1' AS proof_id, left(text, 12) AS span FROM documents UNION ALL SELECT doc_id, 'P2', 'Sincerely' FROM documents UNION ALL SELECT doc_id, 'P3', 'no such span' FROM documents"


@q("f19_span_ledger", f"""SELECT doc_id, proof_id, CASE WHEN pos > 0 THEN span ELSE '' END AS exact_span, CASE WHEN pos > 0 THEN 'paragraph[' || pos || ']' ELSE 'missing' END AS location FROM (
SELECT s.doc_id, proof_id, span, coalesce(list_position(list_transform(ps, lambda p: contains(p, span)), true), 0) AS pos FROM {_PARAS} p JOIN ({_SPANS}) s ON s.doc_id = p.doc_id)""")
def _(s, sf):
    letters = x.letter_paragraphs(_letters(s, sf))
    spans = s.sql(_SPANS.replace("FROM documents", "FROM quire_documents"))
    return x.span_ledger(letters, spans, "doc_id")


@q("f19_bridge_sentence", f"""SELECT doc_id, CASE WHEN pos > 0 THEN {strip("regexp_extract(ps[pos][strpos(lower(ps[pos]), 'the '):], '(?s)^([^.!]*[.!]?)', 1)")} ELSE '' END AS exact_span, CASE WHEN pos > 0 THEN 'paragraph[' || pos || ']' ELSE 'missing' END AS location FROM (
SELECT doc_id, ps, coalesce(list_position(list_transform(ps, lambda p: contains(lower(p), 'the ')), true), 0) AS pos FROM {_PARAS})""")
def _(s, sf):
    return x.bridge_sentence(x.letter_paragraphs(_letters(s, sf)), "doc_id", "the ")


@q("p12_letter_structure", rf"""SELECT doc_id, n AS paragraph_count, n < 3 OR n > 4 AS off FROM (SELECT doc_id, CAST(len(list_filter(string_split_regex(array_to_string(lines[st + 1:], chr(10)), '\n{{2,}}'), lambda p: {strip('p')} <> '')) AS INT) AS n FROM (
SELECT *, coalesce(list_position(list_transform(lines, lambda l: regexp_matches(l, '(?i)^\s*Dear\b')), true), 0) AS st FROM (SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS lines FROM ({_LT}))))""")
def _(s, sf):
    return x.letter_structure(_letters(s, sf)).select("doc_id", "paragraph_count", "off")


_LAB = """SELECT doc_id, line_no, CASE line_no % 6 WHEN 0 THEN concat('Languages: ', line) WHEN 1 THEN concat('Spoken Languages : English (fluent), ', line) WHEN 2 THEN concat('Certifications and Training: AWS ', line) WHEN 3 THEN concat('GitHub: ', line)
WHEN 4 THEN concat('Awards: ', line) ELSE line END AS line FROM v_resume_lines"""
_KINDS = "CASE " + " ".join(f"WHEN regexp_matches(s, '{p}') THEN '{k}'" for k, p in L.LABEL_PATTERNS.items()) + " ELSE '' END"
_VALS = "CASE " + " ".join(f"WHEN regexp_matches(s, '{p}') THEN trim(regexp_replace(s, '{p}', ''))" for k, p in L.LABEL_PATTERNS.items()) + " ELSE line END"


@q("f20_label_split", sql_with(f"""SELECT doc_id, line_no, CASE WHEN stays THEN '' ELSE kind END AS subkind, CASE WHEN stays THEN line ELSE val END AS value FROM (
SELECT *, kind = 'languages' AND regexp_matches(s, '{L.PROGRAMMING_LANGUAGE}') AND NOT regexp_matches(s, '{L.PROFICIENCY}') AS stays FROM (SELECT *, {_KINDS} AS kind, {_VALS} AS val FROM (SELECT *, trim(line) AS s FROM lab)))""",
                               "v_resume_lines", extra=f"lab AS ({_LAB})"))
def _(s, sf):
    view(s, sf, "v_resume_lines").createOrReplaceTempView("quire_v_resume_lines")
    return x.label_split(s.sql(_LAB.replace("FROM v_resume_lines", "FROM quire_v_resume_lines"))).drop("line")


_LK = """concat(CASE doc_id % 6 WHEN 0 THEN '{{name}} [TODO] ' WHEN 1 THEN 'Generated on ' WHEN 2 THEN '[your name] Current_Date ' WHEN 3 THEN 'Lorem Ipsum ' WHEN 4 THEN 'ipsum of lorem [FirstName] ' ELSE '' END, text)"""


@q("p8_leakage", rf"""SELECT doc_id, m AS markers, contains(t, 'CURRENT_DATE') OR contains(t, '{{{{') OR contains(t, '}}}}') OR contains(t, '__TEMPLATE__') OR contains(t, 'Generated on') AS verbatim_marker,
contains(lower(t), '[firstname]') OR contains(lower(t), '[lastname]') OR contains(lower(t), '[name]') OR contains(lower(t), 'firstname lastname') AS placeholder,
contains(lower(t), 'lorem ipsum') OR (list_contains(string_split_regex(lower(t), '\s+'), 'lorem') AND list_contains(string_split_regex(lower(t), '\s+'), 'ipsum')) AS hard_fail, least(1.0, m * 0.25)::DOUBLE AS penalty
FROM (SELECT doc_id, t, CAST(len(regexp_extract_all(t, '{L.INTERNAL_MARKER}')) AS INT) AS m FROM (SELECT doc_id, {_LK} AS t FROM documents))""")
def _(s, sf):
    k = F.col("doc_id") % 6
    d = view(s, sf, "documents").select("doc_id", F.concat(
        F.when(k == 0, "{{name}} [TODO] ").when(k == 1, "Generated on ").when(k == 2, "[your name] Current_Date ").when(k == 3, "Lorem Ipsum ")
        .when(k == 4, "ipsum of lorem [FirstName] ").otherwise(""), "text").alias("text"))
    return x.leakage(d).drop("text")


@q("p9_contacts_complete", """SELECT c_custkey, c_custkey % 3 <> 0 AND c_custkey % 4 NOT IN (0, 1) AS complete FROM customer""")
def _(s, sf):
    d = view(s, sf, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("email"),
        F.when(F.col("c_custkey") % 4 == 0, "  ").when(F.col("c_custkey") % 4 == 1, "").otherwise(F.col("c_mktsegment")).alias("phone"))
    return x.contacts_complete(d).select("c_custkey", "complete")


@q("p6_parse_status", """SELECT c_custkey, coalesce(company, '') AS company, coalesce(job_title, '') AS job_title, CASE WHEN c_custkey % 10 = 0 THEN 'manual' WHEN company IS NOT NULL AND job_title IS NOT NULL THEN 'ok' ELSE 'partial' END AS parse_status FROM (
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS company, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS job_title FROM customer)""")
def _(s, sf):
    k = F.col("c_custkey")
    d = view(s, sf, "customer").select(
        "c_custkey", F.when(k % 10 == 0, "manual").otherwise("scraped").alias("source_type"),
        F.when(k % 8 == 0, " UNKNOWN ").when(k % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), "c_mktsegment")).alias("company"),
        F.when(k % 3 == 0, "unknown").otherwise(F.col("c_name")).alias("job_title"))
    return x.parse_status(d).select("c_custkey", F.coalesce("company", F.lit("")).alias("company"), F.coalesce("job_title", F.lit("")).alias("job_title"), "parse_status")


_PREFIX = r"""
elig AS (SELECT doc_id, ord, trim(text) AS s FROM v_paras WHERE parser_semantic NOT IN ('section_heading','empty') AND length(trim(text)) >= 4),
pre AS (SELECT doc_id, ord, s, s[1:2] AS prefix FROM elig WHERE s[2] = ' ' UNION ALL SELECT doc_id, ord, s, s[1:3] FROM elig WHERE s[3] = ' '),
best AS (SELECT doc_id, prefix, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, fo, length(prefix)) AS rn FROM (
 SELECT p.doc_id, prefix, count(*) AS n, min(ord) AS fo, min(length(s) - length(prefix)) AS rest, any_value(e.c) AS c FROM pre p JOIN (SELECT doc_id, count(*) AS c FROM elig GROUP BY 1) e ON e.doc_id = p.doc_id GROUP BY ALL)
 WHERE c >= 3 AND n >= 3 AND n * 5 >= c AND rest >= 3 AND NOT regexp_matches(rtrim(prefix), '^\p{Lu}$') AND lower(rtrim(prefix)) NOT IN ('in','on','at','to','of','by','an','as','or','up','do','is','it','be','we','he','if','so')) WHERE rn = 1)"""


@q("a26_artifact_prefix", sql_with("SELECT doc_id, prefix, n FROM best", "v_paras", extra=_PREFIX))
def _(s, sf):
    return x.artifact_prefix(view(s, sf, "v_paras"))


@q("f27_paragraph_cleanup", sql_with(r"""SELECT p.doc_id, p.ord, stage, new_text, CASE WHEN stage <> '' AND new_text = '' THEN 'empty' ELSE parser_semantic END AS new_semantic FROM (
SELECT *, CASE stage WHEN 'C_link_standalone' THEN '' WHEN 'C_link_prefix' THEN trim(regexp_replace(s, '(?i)^a\s+link\s*', '')) WHEN 'B_repeated_prefix' THEN trim(s[length(prefix) + 1:]) WHEN 'A_bullet_glyph_strip' THEN trim(regexp_replace(s, '^[•◦▪▸●►▶·]\s+', '')) ELSE text END AS new_text FROM (
SELECT p.*, prefix, trim(p.text) AS s, CASE WHEN lower(trim(p.text)) IN ('a link', 'a link.', 'link') THEN 'C_link_standalone' WHEN regexp_matches(trim(p.text), '(?i)^a\s+link\s*') THEN 'C_link_prefix'
WHEN prefix IS NOT NULL AND starts_with(trim(p.text), prefix) THEN 'B_repeated_prefix' WHEN parser_semantic = 'paragraph' AND regexp_matches(trim(p.text), '^[•◦▪▸●►▶·]\s+.*\S') THEN 'A_bullet_glyph_strip' ELSE '' END AS stage
FROM paras2 p LEFT JOIN best b ON b.doc_id = p.doc_id)) p""", "v_paras", extra=_PREFIX.replace("FROM v_paras", "FROM paras2").replace("\nelig AS", """
paras2 AS (SELECT doc_id, ord, parser_semantic, CASE WHEN ord = 3 AND doc_id % 4 = 0 THEN 'A link' WHEN ord = 3 AND doc_id % 4 = 1 THEN concat('a  link ', text) WHEN ord = 2 AND doc_id % 4 = 2 THEN concat('• ', text) ELSE text END AS text FROM v_paras),
elig AS""")))
def _(s, sf):
    p = view(s, sf, "v_paras").withColumn("text", F.expr(
        "CASE WHEN ord = 3 AND doc_id % 4 = 0 THEN 'A link' WHEN ord = 3 AND doc_id % 4 = 1 THEN concat('a  link ', text) WHEN ord = 2 AND doc_id % 4 = 2 THEN concat('• ', text) ELSE text END"))
    return x.paragraph_cleanup(p).select("doc_id", "ord", "stage", "new_text", "new_semantic")


_CONF = """(SELECT doc_id, fake, total, CASE WHEN total = 0 THEN 'high' WHEN fake / total > 0.05 THEN 'low' WHEN fake / total > 0.01 THEN 'medium' ELSE 'high' END AS confidence FROM (
SELECT doc_id, count(*) FILTER (regexp_matches(trim(text), '^f [A-Z]')) AS fake, count(*) AS total FROM v_paras GROUP BY doc_id))"""


@q("a25_structure_confidence", sql_with(f"SELECT * FROM {_CONF}", "v_paras"))
def _(s, sf):
    return x.structure_confidence(view(s, sf, "v_paras"))


@q("f28_paragraph_hints", sql_with(f"""SELECT p.doc_id, p.ord, CASE WHEN regexp_matches(s, '{L.TECH_STACK_LINE}') THEN 'tech_stack_candidate' WHEN starts_with(s, '*') AND ends_with(s, '*') THEN 'intro_candidate'
WHEN parser_semantic = 'bullet' OR regexp_matches(s, '^f [A-Z]') OR starts_with(s, '- ') THEN 'bullet_candidate' ELSE '' END AS hint,
CASE WHEN regexp_matches(s, '{L.TECH_STACK_LINE}') OR (starts_with(s, '*') AND ends_with(s, '*')) THEN '' WHEN parser_semantic = 'bullet' THEN CASE WHEN confidence = 'low' THEN 'medium' ELSE 'strong' END WHEN regexp_matches(s, '^f [A-Z]') THEN 'weak' WHEN starts_with(s, '- ') THEN 'medium' ELSE '' END AS bullet_confidence
FROM (SELECT *, CASE WHEN ord = 4 THEN concat('Tools: ', text) WHEN ord = 5 THEN concat('*', text, '*') ELSE trim(text) END AS s FROM v_paras) p JOIN (SELECT * FROM {_CONF.replace('FROM v_paras', "FROM (SELECT doc_id, CASE WHEN ord = 4 THEN concat('Tools: ', text) WHEN ord = 5 THEN concat('*', text, '*') ELSE text END AS text FROM v_paras)")}) c ON c.doc_id = p.doc_id""", "v_paras"))
def _(s, sf):
    p = view(s, sf, "v_paras").withColumn("text", F.expr("CASE WHEN ord = 4 THEN concat('Tools: ', text) WHEN ord = 5 THEN concat('*', text, '*') ELSE text END"))
    return x.paragraph_hints(p).select("doc_id", "ord", "hint", "bullet_confidence")


@q("a28_duplicate_pages", """SELECT grp, doc_id, row_number() OVER (PARTITION BY grp, regexp_replace(trim(text), '\\s+', ' ', 'g') ORDER BY doc_id) > 1 AS duplicate FROM (SELECT doc_id, source AS grp, text FROM documents)""")
def _(s, sf):
    d = view(s, sf, "documents").select("doc_id", F.col("source").alias("grp"), "text")
    return x.duplicate_pages(d, "grp", "doc_id", "text").select("grp", "doc_id", "duplicate")


_NAMES = "list_concat(string_split(p_name, ' '), [upper(p_name[1]) || p_name[2:], p_brand, p_type, upper(p_type), string_split(p_name, ' ')[1]])"


@q("u5_distinct_ci", f"""SELECT p_partkey, array_to_string(list_filter(a, lambda v, i: list_position(list_transform(a, lambda z: lower(z)), lower(v)) = i), '|') AS items FROM (SELECT p_partkey, {_NAMES} AS a FROM part)""")
def _(s, sf):
    arr = F.concat(F.split("p_name", " "), F.array(
        F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)")), "p_brand", "p_type", F.upper("p_type"), F.split("p_name", " ")[0]))
    return view(s, sf, "part").select("p_partkey", F.array_join(t.distinct_ci(arr), "|").alias("items"))


_TITLES = """SELECT doc_id, line_no, CASE WHEN line_no % 10 = 2 AND line_no > 10 AND doc_id % 2 = 0 THEN concat('Lead Builder', CASE WHEN doc_id % 4 = 0 THEN '.' ELSE '' END) WHEN line_no % 10 = 3 AND line_no > 10 THEN '' WHEN line_no % 10 = 0 AND line_no > 10 AND line_no < 500 AND doc_id % 3 <> 0 THEN concat(line, ' 2019') ELSE line END AS line FROM v_resume_lines"""


@q("w10_merge_title_lines", sql_with(r"""
SELECT doc_id, CASE WHEN m THEN pat ELSE line_no END AS line_no, CASE WHEN m THEN ps || ' | ' || s ELSE line END AS line, m AS merged FROM mk WHERE NOT eaten
UNION ALL SELECT doc_id, line_no, line, false FROM cand WHERE s = ''""", "v_resume_lines", extra=f"""tt AS ({_TITLES}),
fl AS (SELECT *, trim(line) AS s FROM tt), cand AS (SELECT *, s <> '' AND NOT contains(s, '|') AND NOT starts_with(s, '- ') AND s <> upper(s) AND lower(string_split(s, ' ')[1]) NOT IN {inlist(L.TITLE_MERGE_STOP_WORDS)} AND length(s) <= 60 AND right(s, 1) NOT IN ('.', '!', '?', ',', ':', ';') AS ti,
 s <> '' AND contains(s, '|') AND regexp_matches(s, '(^|[^0-9A-Za-z_])(19|20)[0-9][0-9]($|[^0-9A-Za-z_])') AS tg FROM fl),
mk AS (SELECT doc_id, line_no, line, s, lag(s) OVER w AS ps, lag(line_no) OVER w AS pat, coalesce(tg AND lag(ti) OVER w, false) AS m, coalesce(ti AND lead(tg) OVER w, false) AS eaten
 FROM cand WHERE s <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))"""))
def _(s, sf):
    view(s, sf, "v_resume_lines").createOrReplaceTempView("quire_v_resume_lines")
    return x.split_glued_headings(s.sql(_GLUE.replace("FROM v_resume_lines", "FROM quire_v_resume_lines")))


_CV = """SELECT doc_id, concat(CASE doc_id % 5 WHEN 0 THEN 'Jane Q. Doe jane.doe@mail.example.com +1 (555) 123-4567' WHEN 1 THEN concat('12345', chr(10), 'Ada Lovelace linkedin.com/in/ada-l github.com/adal') WHEN 2 THEN concat(chr(10), 'PROFILE', chr(10), 'One line', chr(10), 'Two line') ELSE '' END, chr(10), text) AS text FROM documents"""
_EM, _PH = L.EMAIL, L.PHONE
_STRIPPED = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(l, '{_EM}', '', 'g'), '{_PH}', '', 'g'), '{L.LINKEDIN}', '', 'g'), '{L.GITHUB}', '', 'g')"
_RUN = rf"""string_split_regex({strip(r"regexp_extract(array_to_string(list_transform(string_split_regex(" + strip(_STRIPPED) + r", '\s+'), lambda w: CASE WHEN regexp_matches(regexp_replace(w, '[^\p{L}]', '', 'g'), '^\p{Lu}\p{L}') THEN regexp_replace(w, '[^\p{L}]', '', 'g') ELSE '|' END), ' '), '^[| ]*([^|]+)', 1)")}, ' +')"""


@q("f11_contact_extraction", rf"""SELECT doc_id, regexp_extract(text, '({_EM})', 1) AS email, {strip(f"regexp_extract(left(text, 500), '({_PH})', 1)")} AS phone,
regexp_extract(text, '(?i)(linkedin\.com/in/[\p{{L}}\p{{N}}_-]+)', 1) AS linkedin, regexp_extract(text, '(?i)(github\.com/[\p{{L}}\p{{N}}_-]+)', 1) AS github,
coalesce(array_to_string(list_filter(list_transform(lines[1:8], lambda l: {_RUN}), lambda r: len(r) >= 2)[1][1:4], ' '), 'Unknown') AS name,
CASE WHEN pos = 0 THEN '' ELSE array_to_string(list_transform(lines[pos + 1 : pos + 3], lambda l: {strip('l')}), ' ') END AS summary
FROM (SELECT *, coalesce(list_position(list_transform(lines, lambda l: regexp_matches(l, '(?i)\b(summary|profile|objective)\b')), true), 0) AS pos
FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda l: {strip('l')} <> '') AS lines FROM ({_CV})))""")
def _(s, sf):
    k = F.col("doc_id") % 5
    d = view(s, sf, "documents").select("doc_id", F.concat(
        F.when(k == 0, "Jane Q. Doe jane.doe@mail.example.com +1 (555) 123-4567").when(k == 1, "12345\nAda Lovelace linkedin.com/in/ada-l github.com/adal")
        .when(k == 2, "\nPROFILE\nOne line\nTwo line").otherwise(""), F.lit("\n"), "text").alias("text"))
    return x.contact_extraction(d).drop("text")


_YEARS = r"list_transform(list_filter(regexp_extract_all(line, '[\p{L}\p{N}_]+'), lambda w: regexp_matches(w, '^(19|20)[0-9]{2}$')), lambda w: CAST(w AS INT))"


@q("f12_date_signals", sql_with(rf"""SELECT doc_id, line_no, len(ys) > 0 AS has_year, len(ys) > 0 AND NOT contains(line, '|') AND length({strip('line')}) < 60 AS is_date_line,
regexp_matches(line, '{L.DATE_LINE}') AS is_range, contains(lower(line), 'present') OR contains(lower(line), 'current') AS open_ended, coalesce(list_min(ys), 0) AS min_year, coalesce(list_max(ys), 0) AS max_year
FROM (SELECT *, {_YEARS} AS ys FROM v_resume_lines)""", "v_resume_lines"))
def _(s, sf):
    return x.date_signals(view(s, sf, "v_resume_lines")).drop("line")


_LETTER = "concat('March 5, 2024', chr(10), 'Dear ACME Corp, as of JUNE 12th 2021 I apply for Senior Engineer.', chr(10), text)"


@q("f13_replace_fields", rf"""SELECT doc_id, replace(replace(regexp_replace({_LETTER}, '{L.LETTER_DATE}', 'July 1, 2026', 'g'), 'ACME Corp', concat('Source ', source)), 'Senior Engineer', concat('Role ', lang)) AS letter FROM documents""")
def _(s, sf):
    d = view(s, sf, "documents").select(
        "doc_id", F.concat(F.lit("March 5, 2024\nDear ACME Corp, as of JUNE 12th 2021 I apply for Senior Engineer.\n"), "text").alias("text"),
        F.concat(F.lit("Source "), "source").alias("company"), F.concat(F.lit("Role "), "lang").alias("title"))
    return x.replace_fields(d, "text", "ACME Corp", "Senior Engineer", "company", "title", F.lit("July 1, 2026")).select("doc_id", "letter")


@q("f15_hash_keys", rf"""SELECT doc_id, sha256({strip(r"regexp_replace(regexp_replace(src, '\r\n?', chr(10), 'g'), '[ \t\x0B\f\x{a0}]+\n', chr(10), 'g')")} || chr(10)) AS text_hash
FROM (SELECT doc_id, replace(text, chr(10), CASE WHEN doc_id % 2 = 0 THEN concat('  ', chr(13), chr(10)) ELSE concat(chr(9), chr(10)) END) AS src FROM documents)""")
def _(s, sf):
    d = view(s, sf, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.when(F.col("doc_id") % 2 == 0, "  \r\n").otherwise("\t\n")).alias("src"))
    return x.hash_keys(d, "src").drop("src")


_TR = f"translate(text, '{L.ACCENTS_FROM}', '{L.ACCENTS_TO}')"


@q("f16_slugs", rf"""SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace({strip(rf"regexp_replace({_TR}, '[^\x01-\x7F]', '', 'g')")}, '\s+', '_', 'g'), '[^A-Za-z0-9_]', '', 'g'), ''), 'Unknown') AS slug,
regexp_replace(regexp_replace(regexp_replace(text, '[^A-Za-z0-9_-]', '_', 'g'), '^_+|_+$', '', 'g'), '_+', '_', 'g') AS file_name FROM documents""")
def _(s, sf):
    c = F.col("text")
    return view(s, sf, "documents").select("doc_id", t.slug(c).alias("slug"), t.file_safe(c).alias("file_name"))


_FENCE = """SELECT event_id, CASE event_id % 3 WHEN 0 THEN concat('```json', chr(10), props, chr(10), '```') WHEN 1 THEN props ELSE concat('  ```', chr(10), props, CASE WHEN event_id % 2 = 0 THEN ' broken{' ELSE '' END) END AS raw FROM events"""


@q("f17_code_fence_strip", """SELECT event_id, CASE WHEN event_id % 3 = 2 AND event_id % 2 = 0 THEN props || ' broken{' ELSE props END AS body, event_id % 3 = 2 AND event_id % 2 = 0 AS rejected,
CASE WHEN event_id % 3 = 2 AND event_id % 2 = 0 THEN -1 ELSE CAST(props ->> '$.k' AS INT) END AS k FROM events""")
def _(s, sf):
    view(s, sf, "events").createOrReplaceTempView("quire_events")
    d = s.sql(_FENCE.replace("FROM events", "FROM quire_events").replace("chr(10)", "char(10)"))
    return x.parse_fenced_json(d, "raw", "k int").select("event_id", "body", "rejected", F.when(F.col("rejected"), -1).otherwise(F.col("payload.k")).alias("k"))


_LT = """SELECT doc_id, concat('12 Main Road', chr(10), CASE doc_id % 3 WHEN 0 THEN 'Dear team,' WHEN 1 THEN 'Oh Dear you' ELSE 'Hello' END, chr(13), chr(10), CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10), concat(chr(10), chr(10), chr(10))) ELSE text END,
chr(10), chr(10), 'Sincerely,', chr(10), chr(10), 'Me') AS text FROM documents"""


def _letters(s, sf):
    view(s, sf, "documents").createOrReplaceTempView("quire_documents")
    return s.sql(_LT.replace("FROM documents", "FROM quire_documents").replace("chr(", "char("))


_PARAS = rf"""(SELECT doc_id, list_filter(list_transform(string_split(regexp_replace({strip("array_to_string(lines[st + 1:], chr(10))")}, '\n{{3,}}', chr(10) || chr(10), 'g'), chr(10) || chr(10)), lambda p: {strip('p')}), lambda p: p <> '') AS ps FROM (
SELECT *, coalesce(list_position(list_transform(lines, lambda l: regexp_matches({strip('l')}, '(?i)^Dear\b')), true), list_position(list_transform(lines, lambda l: regexp_matches(l, '(?i)\bDear\b')), true), 0) AS st
FROM (SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS lines FROM ({_LT}))))"""


@q("f18_letter_paragraphs", f"SELECT doc_id, len(ps) AS n, coalesce(ps[1], '') AS first_paragraph, array_to_string(ps, '#') AS body FROM {_PARAS}")
def _(s, sf):
    p = x.letter_paragraphs(_letters(s, sf))
    return p.select("doc_id", F.size("paragraphs").cast("long").alias("n"), F.coalesce(F.get("paragraphs", F.lit(0)), F.lit("")).alias("first_paragraph"),
                    F.array_join("paragraphs", "#").alias("body"))


@q("f18_collapse_letter", rf"""SELECT doc_id, CASE WHEN c = 0 THEN array_to_string(list_filter(lines, lambda l: {strip('l')} <> ''), chr(10))
ELSE array_to_string(list_filter(lines[1:c - 1], lambda l: {strip('l')} <> ''), chr(10)) || chr(10) || chr(10) || array_to_string(list_filter(lines[c:], lambda l: {strip('l')} <> ''), chr(10)) END AS letter
FROM (SELECT *, coalesce(list_position(list_transform(lines, lambda l: starts_with(lower({strip('l')}), 'sincerely')), true), 0) AS c FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM ({_LT})))""")
def _(s, sf):
    return x.collapse_letter(_letters(s, sf)).select("doc_id", "letter")


_SPANS = "SELECT doc_id, 'P1' AS proof_id, left(text, 12) AS span FROM documents UNION ALL SELECT doc_id, 'P2', 'Sincerely' FROM documents UNION ALL SELECT doc_id, 'P3', 'no such span' FROM documents"


@q("f19_span_ledger", f"""SELECT doc_id, proof_id, CASE WHEN pos > 0 THEN span ELSE '' END AS exact_span, CASE WHEN pos > 0 THEN 'paragraph[' || pos || ']' ELSE 'missing' END AS location FROM (
SELECT s.doc_id, proof_id, span, coalesce(list_position(list_transform(ps, lambda p: contains(p, span)), true), 0) AS pos FROM {_PARAS} p JOIN ({_SPANS}) s ON s.doc_id = p.doc_id)""")
def _(s, sf):
    letters = x.letter_paragraphs(_letters(s, sf))
    spans = s.sql(_SPANS.replace("FROM documents", "FROM quire_documents"))
    return x.span_ledger(letters, spans, "doc_id")


@q("f19_bridge_sentence", f"""SELECT doc_id, CASE WHEN pos > 0 THEN {strip("regexp_extract(ps[pos][strpos(lower(ps[pos]), 'the '):], '(?s)^([^.!]*[.!]?)', 1)")} ELSE '' END AS exact_span, CASE WHEN pos > 0 THEN 'paragraph[' || pos || ']' ELSE 'missing' END AS location FROM (
SELECT doc_id, ps, coalesce(list_position(list_transform(ps, lambda p: contains(lower(p), 'the ')), true), 0) AS pos FROM {_PARAS})""")
def _(s, sf):
    return x.bridge_sentence(x.letter_paragraphs(_letters(s, sf)), "doc_id", "the ")


@q("p12_letter_structure", rf"""SELECT doc_id, n AS paragraph_count, n < 3 OR n > 4 AS off FROM (SELECT doc_id, CAST(len(list_filter(string_split_regex(array_to_string(lines[st + 1:], chr(10)), '\n{{2,}}'), lambda p: {strip('p')} <> '')) AS INT) AS n FROM (
SELECT *, coalesce(list_position(list_transform(lines, lambda l: regexp_matches(l, '(?i)^\s*Dear\b')), true), 0) AS st FROM (SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS lines FROM ({_LT}))))""")
def _(s, sf):
    return x.letter_structure(_letters(s, sf)).select("doc_id", "paragraph_count", "off")


_LAB = """SELECT doc_id, line_no, CASE line_no % 6 WHEN 0 THEN concat('Languages: ', line) WHEN 1 THEN concat('Spoken Languages : English (fluent), ', line) WHEN 2 THEN concat('Certifications and Training: AWS ', line) WHEN 3 THEN concat('GitHub: ', line)
WHEN 4 THEN concat('Awards: ', line) ELSE line END AS line FROM v_resume_lines"""
_KINDS = "CASE " + " ".join(f"WHEN regexp_matches(s, '{p}') THEN '{k}'" for k, p in L.LABEL_PATTERNS.items()) + " ELSE '' END"
_VALS = "CASE " + " ".join(f"WHEN regexp_matches(s, '{p}') THEN trim(regexp_replace(s, '{p}', ''))" for k, p in L.LABEL_PATTERNS.items()) + " ELSE line END"


@q("f20_label_split", sql_with(f"""SELECT doc_id, line_no, CASE WHEN stays THEN '' ELSE kind END AS subkind, CASE WHEN stays THEN line ELSE val END AS value FROM (
SELECT *, kind = 'languages' AND regexp_matches(s, '{L.PROGRAMMING_LANGUAGE}') AND NOT regexp_matches(s, '{L.PROFICIENCY}') AS stays FROM (SELECT *, {_KINDS} AS kind, {_VALS} AS val FROM (SELECT *, trim(line) AS s FROM lab)))""",
                               "v_resume_lines", extra=f"lab AS ({_LAB})"))
def _(s, sf):
    view(s, sf, "v_resume_lines").createOrReplaceTempView("quire_v_resume_lines")
    return x.label_split(s.sql(_LAB.replace("FROM v_resume_lines", "FROM quire_v_resume_lines"))).drop("line")


_LK = """concat(CASE doc_id % 6 WHEN 0 THEN '{{name}} [TODO] ' WHEN 1 THEN 'Generated on ' WHEN 2 THEN '[your name] Current_Date ' WHEN 3 THEN 'Lorem Ipsum ' WHEN 4 THEN 'ipsum of lorem [FirstName] ' ELSE '' END, text)"""


@q("p8_leakage", rf"""SELECT doc_id, m AS markers, contains(t, 'CURRENT_DATE') OR contains(t, '{{{{') OR contains(t, '}}}}') OR contains(t, '__TEMPLATE__') OR contains(t, 'Generated on') AS verbatim_marker,
contains(lower(t), '[firstname]') OR contains(lower(t), '[lastname]') OR contains(lower(t), '[name]') OR contains(lower(t), 'firstname lastname') AS placeholder,
contains(lower(t), 'lorem ipsum') OR (list_contains(string_split_regex(lower(t), '\s+'), 'lorem') AND list_contains(string_split_regex(lower(t), '\s+'), 'ipsum')) AS hard_fail, least(1.0, m * 0.25)::DOUBLE AS penalty
FROM (SELECT doc_id, t, CAST(len(regexp_extract_all(t, '{L.INTERNAL_MARKER}')) AS INT) AS m FROM (SELECT doc_id, {_LK} AS t FROM documents))""")
def _(s, sf):
    k = F.col("doc_id") % 6
    d = view(s, sf, "documents").select("doc_id", F.concat(
        F.when(k == 0, "{{name}} [TODO] ").when(k == 1, "Generated on ").when(k == 2, "[your name] Current_Date ").when(k == 3, "Lorem Ipsum ")
        .when(k == 4, "ipsum of lorem [FirstName] ").otherwise(""), "text").alias("text"))
    return x.leakage(d).drop("text")


@q("p9_contacts_complete", """SELECT c_custkey, c_custkey % 3 <> 0 AND c_custkey % 4 NOT IN (0, 1) AS complete FROM customer""")
def _(s, sf):
    d = view(s, sf, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("email"),
        F.when(F.col("c_custkey") % 4 == 0, "  ").when(F.col("c_custkey") % 4 == 1, "").otherwise(F.col("c_mktsegment")).alias("phone"))
    return x.contacts_complete(d).select("c_custkey", "complete")


@q("p6_parse_status", """SELECT c_custkey, coalesce(company, '') AS company, coalesce(job_title, '') AS job_title, CASE WHEN c_custkey % 10 = 0 THEN 'manual' WHEN company IS NOT NULL AND job_title IS NOT NULL THEN 'ok' ELSE 'partial' END AS parse_status FROM (
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS company, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS job_title FROM customer)""")
def _(s, sf):
    k = F.col("c_custkey")
    d = view(s, sf, "customer").select(
        "c_custkey", F.when(k % 10 == 0, "manual").otherwise("scraped").alias("source_type"),
        F.when(k % 8 == 0, " UNKNOWN ").when(k % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), "c_mktsegment")).alias("company"),
        F.when(k % 3 == 0, "unknown").otherwise(F.col("c_name")).alias("job_title"))
    return x.parse_status(d).select("c_custkey", F.coalesce("company", F.lit("")).alias("company"), F.coalesce("job_title", F.lit("")).alias("job_title"), "parse_status")


_PREFIX = r"""
elig AS (SELECT doc_id, ord, trim(text) AS s FROM v_paras WHERE parser_semantic NOT IN ('section_heading','empty') AND length(trim(text)) >= 4),
pre AS (SELECT doc_id, ord, s, s[1:2] AS prefix FROM elig WHERE s[2] = ' ' UNION ALL SELECT doc_id, ord, s, s[1:3] FROM elig WHERE s[3] = ' '),
best AS (SELECT doc_id, prefix, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, fo, length(prefix)) AS rn FROM (
 SELECT p.doc_id, prefix, count(*) AS n, min(ord) AS fo, min(length(s) - length(prefix)) AS rest, any_value(e.c) AS c FROM pre p JOIN (SELECT doc_id, count(*) AS c FROM elig GROUP BY 1) e ON e.doc_id = p.doc_id GROUP BY ALL)
 WHERE c >= 3 AND n >= 3 AND n * 5 >= c AND rest >= 3 AND NOT regexp_matches(rtrim(prefix), '^\p{Lu}$') AND lower(rtrim(prefix)) NOT IN ('in','on','at','to','of','by','an','as','or','up','do','is','it','be','we','he','if','so')) WHERE rn = 1)"""


@q("a26_artifact_prefix", sql_with("SELECT doc_id, prefix, n FROM best", "v_paras", extra=_PREFIX))
def _(s, sf):
    return x.artifact_prefix(view(s, sf, "v_paras"))


@q("f27_paragraph_cleanup", sql_with(r"""SELECT p.doc_id, p.ord, stage, new_text, CASE WHEN stage <> '' AND new_text = '' THEN 'empty' ELSE parser_semantic END AS new_semantic FROM (
SELECT *, CASE stage WHEN 'C_link_standalone' THEN '' WHEN 'C_link_prefix' THEN trim(regexp_replace(s, '(?i)^a\s+link\s*', '')) WHEN 'B_repeated_prefix' THEN trim(s[length(prefix) + 1:]) WHEN 'A_bullet_glyph_strip' THEN trim(regexp_replace(s, '^[•◦▪▸●►▶·]\s+', '')) ELSE text END AS new_text FROM (
SELECT p.*, prefix, trim(p.text) AS s, CASE WHEN lower(trim(p.text)) IN ('a link', 'a link.', 'link') THEN 'C_link_standalone' WHEN regexp_matches(trim(p.text), '(?i)^a\s+link\s*') THEN 'C_link_prefix'
WHEN prefix IS NOT NULL AND starts_with(trim(p.text), prefix) THEN 'B_repeated_prefix' WHEN parser_semantic = 'paragraph' AND regexp_matches(trim(p.text), '^[•◦▪▸●►▶·]\s+.*\S') THEN 'A_bullet_glyph_strip' ELSE '' END AS stage
FROM paras2 p LEFT JOIN best b ON b.doc_id = p.doc_id)) p""", "v_paras", extra=_PREFIX.replace("FROM v_paras", "FROM paras2").replace("\nelig AS", """
paras2 AS (SELECT doc_id, ord, parser_semantic, CASE WHEN ord = 3 AND doc_id % 4 = 0 THEN 'A link' WHEN ord = 3 AND doc_id % 4 = 1 THEN concat('a  link ', text) WHEN ord = 2 AND doc_id % 4 = 2 THEN concat('• ', text) ELSE text END AS text FROM v_paras),
elig AS""")))
def _(s, sf):
    p = view(s, sf, "v_paras").withColumn("text", F.expr(
        "CASE WHEN ord = 3 AND doc_id % 4 = 0 THEN 'A link' WHEN ord = 3 AND doc_id % 4 = 1 THEN concat('a  link ', text) WHEN ord = 2 AND doc_id % 4 = 2 THEN concat('• ', text) ELSE text END"))
    return x.paragraph_cleanup(p).select("doc_id", "ord", "stage", "new_text", "new_semantic")


_CONF = """(SELECT doc_id, fake, total, CASE WHEN total = 0 THEN 'high' WHEN fake / total > 0.05 THEN 'low' WHEN fake / total > 0.01 THEN 'medium' ELSE 'high' END AS confidence FROM (
SELECT doc_id, count(*) FILTER (regexp_matches(trim(text), '^f [A-Z]')) AS fake, count(*) AS total FROM v_paras GROUP BY doc_id))"""


@q("a25_structure_confidence", sql_with(f"SELECT * FROM {_CONF}", "v_paras"))
def _(s, sf):
    return x.structure_confidence(view(s, sf, "v_paras"))


@q("f28_paragraph_hints", sql_with(f"""SELECT p.doc_id, p.ord, CASE WHEN regexp_matches(s, '{L.TECH_STACK_LINE}') THEN 'tech_stack_candidate' WHEN starts_with(s, '*') AND ends_with(s, '*') THEN 'intro_candidate'
WHEN parser_semantic = 'bullet' OR regexp_matches(s, '^f [A-Z]') OR starts_with(s, '- ') THEN 'bullet_candidate' ELSE '' END AS hint,
CASE WHEN regexp_matches(s, '{L.TECH_STACK_LINE}') OR (starts_with(s, '*') AND ends_with(s, '*')) THEN '' WHEN parser_semantic = 'bullet' THEN CASE WHEN confidence = 'low' THEN 'medium' ELSE 'strong' END WHEN regexp_matches(s, '^f [A-Z]') THEN 'weak' WHEN starts_with(s, '- ') THEN 'medium' ELSE '' END AS bullet_confidence
FROM (SELECT *, CASE WHEN ord = 4 THEN concat('Tools: ', text) WHEN ord = 5 THEN concat('*', text, '*') ELSE trim(text) END AS s FROM v_paras) p JOIN (SELECT * FROM {_CONF.replace('FROM v_paras', "FROM (SELECT doc_id, CASE WHEN ord = 4 THEN concat('Tools: ', text) WHEN ord = 5 THEN concat('*', text, '*') ELSE text END AS text FROM v_paras)")}) c ON c.doc_id = p.doc_id""", "v_paras"))
def _(s, sf):
    p = view(s, sf, "v_paras").withColumn("text", F.expr("CASE WHEN ord = 4 THEN concat('Tools: ', text) WHEN ord = 5 THEN concat('*', text, '*') ELSE text END"))
    return x.paragraph_hints(p).select("doc_id", "ord", "hint", "bullet_confidence")


@q("a28_duplicate_pages", """SELECT grp, doc_id, row_number() OVER (PARTITION BY grp, regexp_replace(trim(text), '\\s+', ' ', 'g') ORDER BY doc_id) > 1 AS duplicate FROM (SELECT doc_id, source AS grp, text FROM documents)""")
def _(s, sf):
    d = view(s, sf, "documents").select("doc_id", F.col("source").alias("grp"), "text")
    return x.duplicate_pages(d, "grp", "doc_id", "text").select("grp", "doc_id", "duplicate")


_NAMES = "list_concat(string_split(p_name, ' '), [upper(p_name[1]) || p_name[2:], p_brand, p_type, upper(p_type), string_split(p_name, ' ')[1]])"


@q("u5_distinct_ci", f"""SELECT p_partkey, array_to_string(list_filter(a, lambda v, i: list_position(list_transform(a, lambda z: lower(z)), lower(v)) = i), '|') AS items FROM (SELECT p_partkey, {_NAMES} AS a FROM part)""")
def _(s, sf):
    arr = F.concat(F.split("p_name", " "), F.array(
        F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)")), "p_brand", "p_type", F.upper("p_type"), F.split("p_name", " ")[0]))
    return view(s, sf, "part").select("p_partkey", F.array_join(t.distinct_ci(arr), "|").alias("items"))


_TITLES = """SELECT doc_id, line_no, CASE WHEN line_no % 10 = 2 AND line_no > 10 AND doc_id % 2 = 0 THEN concat('Lead Builder', CASE WHEN doc_id % 4 = 0 THEN '.' ELSE '' END) WHEN line_no % 10 = 3 AND line_no > 10 THEN '' WHEN line_no % 10 = 0 AND line_no > 10 AND line_no < 500 AND doc_id % 3 <> 0 THEN concat(line, ' 2019') ELSE line END AS line FROM v_resume_lines"""


@q("w10_merge_title_lines", sql_with(r"""
SELECT t.doc_id, CASE WHEN t.m THEN t.pat ELSE t.line_no END AS line_no, CASE WHEN t.m THEN t.ps || ' | ' || trim(t.line) ELSE t.line END AS line, t.m AS merged FROM mk t
LEFT JOIN (SELECT doc_id, pat AS eaten FROM mk WHERE m) e ON e.doc_id = t.doc_id AND e.eaten = t.line_no WHERE e.eaten IS NULL""", "v_resume_lines", extra=f"""tt AS ({_TITLES}),
fl AS (SELECT *, trim(line) AS s FROM tt), cand AS (SELECT *, s <> '' AND NOT contains(s, '|') AND NOT starts_with(s, '- ') AND s <> upper(s) AND lower(string_split(s, ' ')[1]) NOT IN {inlist(L.TITLE_MERGE_STOP_WORDS)} AND length(s) <= 60 AND NOT regexp_matches(s, '[.!?,:;]$') AS ti,
 s <> '' AND contains(s, '|') AND regexp_matches(s, '(^|[^0-9A-Za-z_])(19|20)[0-9][0-9]($|[^0-9A-Za-z_])') AS tg FROM fl),
pv AS (SELECT doc_id, line_no, lag(ti) OVER w AS pti, lag(s) OVER w AS ps, lag(line_no) OVER w AS pat FROM cand WHERE s <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
mk AS (SELECT c.doc_id, c.line_no, c.line, ps, pat, coalesce(c.tg AND pti, false) AS m FROM cand c LEFT JOIN pv USING (doc_id, line_no))"""))
def _(s, sf):
    view(s, sf, "v_resume_lines").createOrReplaceTempView("quire_v_resume_lines")
    return x.merge_title_lines(s.sql(_TITLES.replace("FROM v_resume_lines", "FROM quire_v_resume_lines")))


@q("w18_compact_summary", rf"""SELECT doc_id, CASE WHEN len(ss) > 3 THEN ss[1] || ' ' || ss[2] || ' ' || ss[-1] ELSE text END AS summary FROM (SELECT doc_id, text, list_filter(list_transform(string_split(regexp_replace({strip('text')}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda z: {strip('z')}), lambda z: z <> '') AS ss FROM documents)""")
def _(s, sf):
    return view(s, sf, "documents").select("doc_id", t.compact_summary(F.col("text")).alias("summary"))
