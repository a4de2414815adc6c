"""Web block: P4, P5, J9, F5-F10."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.views import sql_with, view
from quire.operators import web as w

QUERIES: dict = {}
SQL: dict = {}


def q(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f
    return add


_HOST = r"lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1))"
_SITE = f"""CASE WHEN {_HOST} LIKE '%hiring.cafe%' THEN 'hiring_cafe' WHEN {_HOST} LIKE '%indeed.com%' THEN 'indeed' WHEN {_HOST} LIKE '%linkedin.com%' THEN 'linkedin'
WHEN {_HOST} LIKE '%wellfound.com%' OR {_HOST} LIKE '%angel.co%' THEN 'wellfound' WHEN {_HOST} LIKE '%amazon.jobs%' THEN 'amazon' WHEN {_HOST} LIKE '%greenhouse.io%' THEN 'greenhouse'
WHEN regexp_extract(url, '\\?([^#]*)', 1) LIKE '%gh\\_jid%' ESCAPE '\\' THEN 'greenhouse' WHEN {_HOST} LIKE '%jobs.lever.co%' THEN 'lever' WHEN {_HOST} LIKE '%jobs.ashbyhq.com%' THEN 'ashby'
WHEN {_HOST} LIKE '%jobs.smartrecruiters.com%' THEN 'smartrecruiters' WHEN {_HOST} LIKE '%jobbank.gc.ca%' THEN 'jobbank' WHEN {_HOST} LIKE '%notion.site%' OR {_HOST} LIKE '%notion.so%' THEN 'notion'
WHEN {_HOST} LIKE '%apply.workable.com%' THEN 'workable' ELSE 'generic' END"""


@q("p4_site_of", sql_with(f"SELECT page_id, {_SITE} AS site FROM v_urls", "v_urls"))
def _(s, sf):
    return w.with_site(view(s, sf, "v_urls")).select("page_id", "site")


_LOW = "lower(html)"


@q("p5_page_quality", sql_with(
    f"""SELECT {_SITE} AS site, count(*) AS pages,
count(*) FILTER (length(html) < 5000 OR {_LOW} LIKE '%datadome%' OR {_LOW} LIKE '%geo.captcha-delivery.com%' OR {_LOW} LIKE '%cf-mitigated%' OR {_LOW} LIKE '%just a moment%' OR {_LOW} LIKE '%enable javascript and cookies%' OR {_LOW} LIKE '%checking your browser%' OR {_LOW} LIKE '%blocked - indeed.com%') AS bot_blocked,
count(*) FILTER (length(html) < 20000 AND ({_LOW} LIKE '%authwall%' OR {_LOW} LIKE '%join linkedin%' OR {_LOW} LIKE '%sign in to linkedin%' OR {_LOW} LIKE '%uas/login%')) AS auth_wall,
count(*) FILTER (page_id % 4 <> 0 OR length(html) - 4000 > 100) AS valid_job
FROM (SELECT page_id, u.url, concat(CASE WHEN page_id % 6 = 0 THEN '<!-- AuthWall -->' WHEN page_id % 7 = 0 THEN '<!-- Just A Moment -->' ELSE '' END, p.html) AS html FROM pages p JOIN v_urls u USING (page_id)) GROUP BY 1""", "v_urls"))
def _(s, sf):
    p = view(s, sf, "pages").drop("url").join(view(s, sf, "v_urls"), "page_id")
    p = w.with_site(p).withColumn("html", F.concat(
        F.when(F.col("page_id") % 6 == 0, "<!-- AuthWall -->").when(F.col("page_id") % 7 == 0, "<!-- Just A Moment -->").otherwise(""), "html"))
    p = p.withColumns({
        "job_title": F.when(F.col("page_id") % 4 == 0, "Unknown").otherwise("Role"),
        "description": F.expr("substring(html, 4001)")})
    return w.page_quality(w.page_flags(p), ["site"])


_BARE = rf"regexp_replace({_HOST}, '^www\.', '')"


@q("j9_protected_hosts", sql_with(
    f"""SELECT page_id, host, coalesce(label, '') AS label, CASE WHEN label IS NULL THEN 'Scraping the job description from the URL failed. Please copy and paste the job description manually.'
ELSE label || ' uses bot protection, so the job description can''t be scraped from the URL. Please copy and paste the job description manually.' END AS message
FROM (SELECT page_id, host, CASE WHEN host = 'wellfound.com' OR host LIKE '%.wellfound.com' THEN 'Wellfound' WHEN host = 'hiring.cafe' OR host LIKE '%.hiring.cafe' THEN 'Hiring Cafe'
WHEN host = 'indeed.com' OR host LIKE '%.indeed.com' THEN 'Indeed' END AS label FROM (SELECT page_id, {_BARE} AS host FROM v_urls))""", "v_urls"))
def _(s, sf):
    return w.protected_hosts(view(s, sf, "v_urls")).select("page_id", "host", F.coalesce("label", F.lit("")).alias("label"), "message")


@q("f10_url_features", sql_with(
    rf"""SELECT page_id, {_BARE} AS host,
coalesce(array_to_string(list_transform(string_split(replace(list_filter(string_split({_HOST}, '.')[:-2], lambda p: p NOT IN ('careers','career','jobs','job','join','work','hiring','apply','talent','recruit','www') AND length(p) > 2)[1], '-', ' '), ' '), lambda x: upper(x[1]) || lower(x[2:])), ' '), '') AS company,
CASE WHEN jk <> '' THEN 'https://' || {_HOST} || '/viewjob?jk=' || jk ELSE url END AS clean_url,
coalesce(CASE WHEN {_HOST} LIKE '%linkedin.com%' THEN coalesce(nullif(regexp_extract(url, '[?&]currentJobId=([0-9]+)', 1), ''), nullif(regexp_extract(url, '/jobs/view/([0-9]+)(?:[/?]|$)', 1), ''), nullif(regexp_extract(url, '/jobs/view/[^/?]*?-([0-9]{{7,}})(?:[/?]|$)', 1), '')) END,
 nullif(jk, ''), nullif(regexp_extract(url, '(?i)greenhouse\.io/([^/?#]+)/jobs/([0-9]+)', 2), ''), nullif(regexp_extract(url, '[?&]gh_jid=([0-9]+)', 1), ''), nullif(regexp_extract(url, '(?i)jobs\.lever\.co/([^/?#]+)/([^/?#]+)', 2), ''),
 nullif(regexp_extract(url, '(?i)apply\.workable\.com/([^/]+)/j/([A-Za-z0-9]+)', 2), ''), '') AS job_id,
coalesce(nullif(regexp_extract(url, '(?i)greenhouse\.io/([^/?#]+)/jobs/([0-9]+)', 1), ''), nullif(regexp_extract(url, '(?i)jobs\.lever\.co/([^/?#]+)/([^/?#]+)', 1), ''), nullif(regexp_extract(url, '(?i)apply\.workable\.com/([^/]+)/j/([A-Za-z0-9]+)', 1), ''), '') AS board
FROM (SELECT *, regexp_extract(regexp_extract(url, '\?([^#]*)', 1), '(?:^|&)jk=([^&]+)', 1) AS jk FROM v_urls)""", "v_urls"))
def _(s, sf):
    return w.url_features(view(s, sf, "v_urls")).drop("url")


_CUT = "html"
for _t in w.NOISE_TAGS:
    _CUT = rf"regexp_replace({_CUT}, '(?is)<{_t}(?:\s[^>]*)?>.*?</{_t}\s*>', '', 'g')"
_CUT = rf"regexp_replace(regexp_replace({_CUT}, '(?s)<!--.*?-->|<![^>]*>', '', 'g'), '(?:<[^>]+>)+', chr(10), 'g')"


def _ent(x):
    return (f"replace(replace(replace(replace(replace(replace({x}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&#39;', ''''), '&quot;', '\"'), '&amp;', '&')")


_BUL = rf"""regexp_replace(regexp_replace(regexp_replace({_ent(r"regexp_replace(regexp_replace(regexp_replace(html, '(?i)<li[^>]*>', '• ', 'g'), '(?i)</li>|<br\s*/?>|</p>', chr(10), 'g'), '<[^>]+>', '', 'g')")}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g')"""


@q("f5_html_to_text", rf"""SELECT page_id, {_ent(_CUT)} AS text_plain, {_BUL} AS text_bullets, regexp_replace(html, '<[^>]+>', ' ', 'g') AS text_spaced FROM pages""")
def _(s, sf):
    return w.html_to_text(view(s, sf, "pages")).select("page_id", "text_plain", "text_bullets", "text_spaced")


_META = r"""SELECT page_id, coalesce(nullif(regexp_extract(html, '(?is)<meta\s[^>]*property=["'']og:site_name["''][^>]*content=["'']([^"'']*)["'']', 1), ''), '') AS og_site,
trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS doc_title, trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g')) AS h1 FROM ({src})"""
_BOTH = "SELECT page_id, html FROM v_pages_ld UNION ALL SELECT page_id, html FROM pages WHERE page_id % 3 = 0"


def _both(s, sf):
    return view(s, sf, "v_pages_ld").select("page_id", "html").unionByName(
        view(s, sf, "pages").filter("page_id % 3 = 0").select("page_id", "html"))


@q("f7_page_meta", sql_with("SELECT page_id, og_site, doc_title, h1, coalesce(nullif(h1, ''), doc_title) AS title FROM (" + _META.replace("{src}", _BOTH) + ")", "v_pages_ld"))
def _(s, sf):
    m = w.page_meta(_both(s, sf))
    return m.select("page_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("og_site", "doc_title", "h1", "title")])


@q("f6_jsonld_postings", """SELECT page_id, page_id % 3 <> 0 AS has_posting, CASE WHEN page_id % 3 <> 0 THEN concat('Org ', page_id % 17) ELSE 'Unknown' END AS company,
CASE WHEN page_id % 3 <> 0 THEN concat('Role ', page_id) ELSE 'Unknown' END AS job_title, CASE WHEN page_id % 3 <> 0 THEN concat('Text ', page_id * 3) ELSE '' END AS description FROM pages""")
def _(s, sf):
    return w.jsonld_postings(_both(s, sf)).drop("html")


def _with_props(s, sf):
    """Every page with embedded props: nested job object, list form, or props without a description."""
    pid = F.col("page_id").cast("string")
    props = F.when(F.col("page_id") % 3 == 0, F.concat(
        F.lit('{"props":{"companyName":"Outer '), pid, F.lit('","job":{"jobTitle":"Role '), pid, F.lit('","description":"<b>Do</b>   work '), pid, F.lit('"}}}'))
    ).when(F.col("page_id") % 3 == 1, F.concat(
        F.lit('{"props":{"items":[{"x":1},{"employer":"Emp '), pid, F.lit('","title":"T","body":"Body '), pid, F.lit('"}]}}'))
    ).otherwise(F.lit('{"props":{"title":"none"}}'))
    return view(s, sf, "pages").select("page_id", F.concat(
        F.lit('<script id="__NEXT_DATA__" type="application/json">'), props, F.lit("</script>"), "html").alias("html"))


@q("f8_next_data_fields", """SELECT page_id, CASE page_id % 3 WHEN 0 THEN concat('Outer ', page_id) WHEN 1 THEN concat('Emp ', page_id) ELSE '' END AS company,
CASE page_id % 3 WHEN 0 THEN concat('Role ', page_id) WHEN 1 THEN 'T' ELSE '' END AS job_title,
CASE page_id % 3 WHEN 0 THEN concat('Do', chr(10), chr(10), 'work ', page_id) WHEN 1 THEN concat('Body ', page_id) ELSE '' END AS description FROM pages""")
def _(s, sf):
    n = w.next_data_fields(_with_props(s, sf))
    return n.select("page_id", *[F.coalesce(f"next_data.{c}", F.lit("")).alias(c) for c in ("company", "job_title", "description")])


@q("f9_extract_posting", sql_with(rf"""SELECT source, count(*) AS pages, CAST(sum(length(description)) AS BIGINT) AS chars, count(*) FILTER (company <> '') AS with_company FROM (
SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN 'jsonld' ELSE 'text_only' END AS source, CASE WHEN page_id % 3 <> 0 THEN concat('Text ', page_id * 3) ELSE txt END AS description,
CASE WHEN page_id % 3 <> 0 THEN 'Org' ELSE coalesce(list_filter(string_split({_HOST}, '.')[:-2], lambda p: p NOT IN ('careers','career','jobs','job','join','work','hiring','apply','talent','recruit','www') AND length(p) > 2)[1], '') END AS company
FROM (SELECT page_id, url, regexp_replace({_ent(_CUT)}, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g') AS txt FROM pages)) GROUP BY source""", "v_urls"))
def _(s, sf):
    p = _both(s, sf).join(view(s, sf, "pages").select("page_id", "url"), "page_id")
    return w.posting_sources(w.extract_posting(p))
