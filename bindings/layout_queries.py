"""Geometry block: A14-A20, A22, A27, A36-A38, J17, J26, W11-W14, W16, F21-F23, F25."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.views import sql_with, view
from quire.functions import lexicons as L
from quire.operators import layout as y

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


# Larger documents of four pages with heading texts, from v_blocks.
GEO = """SELECT doc_id % 600 AS doc_id, 1 + (block_id + doc_id) % 4 AS page, doc_id * 100 + block_id AS block_id, CAST(n_chars % 3 % 2 AS INT) AS half, page_w, page_h, x0, x1, y0, y1, block_type, n_lines, n_chars, spacing_before,
CASE WHEN block_type <> 'heading' THEN concat('Body ', CAST(n_chars AS STRING)) ELSE CASE n_chars % 8 WHEN 0 THEN '1. Experience' WHEN 1 THEN 'SKILLS' WHEN 2 THEN 'Education' WHEN 3 THEN 'Summary' WHEN 4 THEN 'Languages' WHEN 5 THEN 'Certifications' WHEN 6 THEN 'Work History' ELSE 'Misc Notes' END END AS text FROM v_blocks"""
SIDES = f"""geo AS ({GEO}), sb AS (SELECT * REPLACE (y0 * CASE WHEN (doc_id + page) % 5 = 0 THEN 0.25::DOUBLE ELSE 1::DOUBLE END AS y0, y1 * CASE WHEN (doc_id + page) % 5 = 0 THEN 0.25::DOUBLE ELSE 1::DOUBLE END AS y1) FROM geo WHERE half = 0),
ob AS (SELECT * REPLACE (y0 * CASE WHEN (doc_id + page) % 3 = 0 THEN 0.5::DOUBLE ELSE 1::DOUBLE END + 30 AS y0, y1 * CASE WHEN (doc_id + page) % 3 = 0 THEN 0.5::DOUBLE ELSE 1::DOUBLE END + 30 AS y1) FROM geo WHERE half = 1)"""


def geo(s, sf):
    view(s, sf, "v_blocks").createOrReplaceTempView("quire_v_blocks")
    return s.sql(GEO.replace("FROM v_blocks", "FROM quire_v_blocks"))


def sides(s, sf):
    g = geo(s, sf)
    a = F.when((F.col("doc_id") + F.col("page")) % 5 == 0, 0.25).otherwise(1.0)
    b = F.when((F.col("doc_id") + F.col("page")) % 3 == 0, 0.5).otherwise(1.0)
    src = g.filter("half = 0").withColumns({"y0": F.col("y0") * a, "y1": F.col("y1") * a})
    out = g.filter("half = 1").withColumns({"y0": F.col("y0") * b + 30, "y1": F.col("y1") * b + 30})
    return src, out


def _fill(t):
    return f"""(SELECT doc_id, page, coalesce(CAST(area AS DOUBLE) / (w * h), 0) AS area_ratio, coalesce((bottom - top) / h, 0) AS vert_fill, coalesce((h - bottom) / h, 1) AS bottom_empty, blocks, CAST(lines AS BIGINT) AS lines, CAST(al AS BIGINT) AS all_lines, CAST(ac AS BIGINT) AS all_chars,
al < 4 AND ac < 150 AS blank, (cb - ct) / h AS content_fill, cb - ct AS content_height FROM (SELECT doc_id, page, max(page_w) AS w, max(page_h) AS h, sum(CAST((y1 - y0) * (x1 - x0) AS DECIMAL(24,12))) FILTER (n_chars >= 3) AS area, min(y0) FILTER (n_chars >= 3) AS top, max(y1) FILTER (n_chars >= 3) AS bottom,
count(*) FILTER (n_chars >= 3) AS blocks, coalesce(sum(n_lines) FILTER (n_chars >= 3), 0) AS lines, sum(n_lines) AS al, sum(n_chars) AS ac, min(y0) AS ct, max(y1) AS cb FROM {t} GROUP BY ALL))"""


@q("a14_page_fill", sql_with(f"SELECT * REPLACE (round(area_ratio, 6) AS area_ratio, round(vert_fill, 6) AS vert_fill, round(bottom_empty, 6) AS bottom_empty, round(content_fill, 6) AS content_fill) FROM {_fill('v_blocks')}", "v_blocks"))
def _(s, sf):
    return r6(y.page_fill(view(s, sf, "v_blocks")), "area_ratio", "vert_fill", "bottom_empty", "content_fill")


def _n(t):
    c = lambda e: f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {e}))"
    return f"(SELECT *, {c('x0 / page_w')} AS nx0, {c('x1 / page_w')} AS nx1, {c('y0 / page_h')} AS ny0, {c('y1 / page_h')} AS ny1 FROM {t})"


def _topo(t):
    return f"""(SELECT *, CASE WHEN lp >= 0.4 AND lnf >= 0.05 AND lnf <= 0.45 AND raf >= 0.3 THEN 'sidebar_left' WHEN rp >= 0.4 AND rnf >= 0.05 AND rnf <= 0.45 AND laf >= 0.3 THEN 'sidebar_right'
WHEN laf >= 0.28 AND raf >= 0.28 AND abs(laf - raf) < 0.25 AND waf < 0.6 THEN 'two_column_balanced' WHEN waf >= 0.55 AND lp < 0.4 AND rp < 0.4 THEN 'linear_single_column' ELSE 'mixed_or_ambiguous' END AS topology FROM (
SELECT doc_id, page, count(DISTINCT band) FILTER (w < 0.42 AND cx < 0.35) / 6 AS lp, count(DISTINCT band) FILTER (w < 0.42 AND cx > 0.65) / 6 AS rp, coalesce(CAST(sum(area) FILTER (cx < 0.5) AS DOUBLE), 0) / CAST(sum(area) AS DOUBLE) AS laf, coalesce(CAST(sum(area) FILTER (cx >= 0.5) AS DOUBLE), 0) / CAST(sum(area) AS DOUBLE) AS raf,
coalesce(CAST(sum(area) FILTER (w < 0.42 AND cx < 0.35) AS DOUBLE), 0) / CAST(sum(area) AS DOUBLE) AS lnf, coalesce(CAST(sum(area) FILTER (w < 0.42 AND cx > 0.65) AS DOUBLE), 0) / CAST(sum(area) AS DOUBLE) AS rnf, coalesce(CAST(sum(area) FILTER (w > 0.5) AS DOUBLE), 0) / CAST(sum(area) AS DOUBLE) AS waf, count(*) AS total_blocks
FROM (SELECT *, nx1 - nx0 AS w, (nx0 + nx1) / 2 AS cx, CAST(round((nx1 - nx0) * (ny1 - ny0), 12) AS DECIMAL(24,12)) AS area, least(5, floor((ny0 + ny1) / 2 * 6)) AS band FROM {_n(t)} WHERE n_chars >= 3 AND nx1 - nx0 >= 0.03 AND ny1 - ny0 >= 0.008) GROUP BY doc_id, page))"""


_CONF = """CASE topology WHEN 'sidebar_left' THEN least(1.0::DOUBLE, lp * 1.2::DOUBLE) * least(1.0::DOUBLE, raf / 0.5::DOUBLE) WHEN 'sidebar_right' THEN least(1.0::DOUBLE, rp * 1.2::DOUBLE) * least(1.0::DOUBLE, laf / 0.5::DOUBLE)
WHEN 'two_column_balanced' THEN least(1.0::DOUBLE, least(laf, raf) / 0.5::DOUBLE * (1 - abs(laf - raf))) WHEN 'linear_single_column' THEN least(1.0::DOUBLE, waf) * (1 - greatest(lp, rp)) ELSE 0.4::DOUBLE END"""
_SIG = ("lp", "rp", "laf", "raf", "lnf", "rnf", "waf")


@q("a15_page_topology", sql_with(f"SELECT doc_id, page, topology, total_blocks, round({_CONF}, 6) AS confidence, {', '.join(f'round({c}, 6) AS {c}' for c in _SIG)} FROM {_topo('v_blocks')}", "v_blocks"))
def _(s, sf):
    return r6(y.page_topology(view(s, sf, "v_blocks")), "confidence", *_SIG)


def _doc_topo(t):
    return f"""(SELECT d.doc_id, coalesce(w.topology, 'mixed_or_ambiguous') AS topology, CASE WHEN kinds = 0 THEN 0.30::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, w.n / pages * (1 - 0.15::DOUBLE * (kinds - 1)))) END AS confidence, pages FROM (
SELECT doc_id, CAST(sum(n) AS BIGINT) AS pages, count(*) FILTER (topology <> 'mixed_or_ambiguous') AS kinds FROM pt{t} GROUP BY 1) d LEFT JOIN (SELECT doc_id, topology, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS rn FROM pt{t} WHERE topology <> 'mixed_or_ambiguous') WHERE rn = 1) w ON w.doc_id = d.doc_id)"""


def _pt(t):
    return f"pt{t} AS (SELECT doc_id, topology, count(*) AS n, min(page) AS f FROM {_topo(t)} GROUP BY ALL)"


@q("a16_doc_topology", sql_with(f"SELECT doc_id, topology, round(confidence, 6) AS confidence, pages FROM {_doc_topo('sb')}", "v_blocks", extra=SIDES + ", " + _pt("sb")))
def _(s, sf):
    return r6(y.doc_topology(y.page_topology(sides(s, sf)[0])), "confidence").select("doc_id", "topology", "confidence", "pages")


_TR = "CASE " + " ".join(f"WHEN s.topology = '{a}' AND o.topology = '{b}' THEN {k}::DOUBLE" for a, b, k in y.TOPOLOGY_TRANSITIONS) + " ELSE 0.40::DOUBLE END"


@q("f25_topology_preservation", sql_with(f"""SELECT s.doc_id, s.topology AS src_topology, o.topology AS out_topology, round(CASE WHEN s.topology = o.topology AND s.topology = 'mixed_or_ambiguous' THEN 0.60::DOUBLE WHEN s.topology = o.topology THEN 0.70::DOUBLE + 0.30::DOUBLE * least(s.confidence, o.confidence)
WHEN s.topology = 'mixed_or_ambiguous' OR o.topology = 'mixed_or_ambiguous' THEN 0.55::DOUBLE ELSE {_TR} END, 6) AS preservation FROM {_doc_topo('sb')} s JOIN {_doc_topo('ob')} o ON o.doc_id = s.doc_id""", "v_blocks", extra=SIDES + ", " + _pt("sb") + ", " + _pt("ob")))
def _(s, sf):
    a, b = sides(s, sf)
    return r6(y.topology_preservation(y.doc_topology(y.page_topology(a)), y.doc_topology(y.page_topology(b))), "preservation")


@q("a17_horizontal_occupancy", sql_with(f"""SELECT doc_id, page, CAST(i AS INT) AS bin, round(least(1.0::DOUBLE, CAST(sum(CAST(round(greatest(least(nx1, (i + 1) / 20) - greatest(nx0, i / 20), 0) * (ny1 - ny0), 12) AS DECIMAL(24,12))) AS DOUBLE) * 20), 6) AS occupancy
FROM {_n('v_blocks')}, range(0, 20) b(i) WHERE nx1 > nx0 AND ny1 > ny0 GROUP BY ALL HAVING occupancy > 0""", "v_blocks"))
def _(s, sf):
    return r6(y.horizontal_occupancy(view(s, sf, "v_blocks")), "occupancy").filter("occupancy > 0")


_VC = "(SELECT doc_id, round_even(x0 / 2.0, 0) * 2.0 AS value, count(*) AS n, min(block_id) AS f FROM {} GROUP BY ALL)"


@q("a18_dominant_value", sql_with(f"""SELECT doc_id, CASE WHEN n >= total * 0.60 THEN value ELSE -1 END AS dominant, n, CAST(total AS BIGINT) AS total FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS rn FROM {_VC.format('v_blocks')}) WHERE rn = 1""", "v_blocks"))
def _(s, sf):
    return y.dominant_value(view(s, sf, "v_blocks"), ["doc_id"], "x0", "block_id", least_share=0.60).withColumn("dominant", F.coalesce("dominant", F.lit(-1.0)))


@q("k3_top_margins", sql_with(f"SELECT doc_id, value, n, CAST(rn AS INT) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f, value) AS rn FROM {_VC.format('v_blocks')}) WHERE rn <= 3", "v_blocks"))
def _(s, sf):
    return y.top_margins(view(s, sf, "v_blocks"), ["doc_id"], "x0", "block_id").select("doc_id", "value", "n", "nth")


@q("a19_median_gap", sql_with("""SELECT doc_id, coalesce(median(spacing_before) FILTER (block_type = 'heading'), -1) AS section_gap, coalesce(median(spacing_before) FILTER (block_type <> 'heading'), -1) AS line_gap FROM v_blocks WHERE spacing_before > 0 GROUP BY 1""", "v_blocks"))
def _(s, sf):
    return y.median_gap(view(s, sf, "v_blocks")).select("doc_id", *[F.coalesce(c, F.lit(-1.0)).alias(c) for c in ("section_gap", "line_gap")])


def _cols(t):
    return f"""(SELECT doc_id, page, CASE WHEN two AND least(l, r) >= 2 THEN 2 ELSE 1 END AS columns, CASE WHEN two AND least(l, r) >= 3 THEN 'high' ELSE 'low' END AS confidence FROM (
SELECT x.doc_id, x.page, coalesce(any_value(b.lines) >= 4 AND any_value(gap) >= any_value(x.w) * 0.15, false) AS two, coalesce(sum(x.n) FILTER (x.x < b.mid), 0) AS l, coalesce(sum(x.n) FILTER (x.x >= b.mid), 0) AS r FROM xs{t} x JOIN (
SELECT doc_id, page, max(gap) AS gap, arg_max(mid, (gap, -x)) FILTER (gap IS NOT NULL) AS mid, sum(n) AS lines FROM (SELECT *, x - lag(x) OVER w AS gap, (x + lag(x) OVER w) / 2 AS mid FROM xs{t} WINDOW w AS (PARTITION BY doc_id, page ORDER BY x)) GROUP BY ALL) b ON b.doc_id = x.doc_id AND b.page = x.page GROUP BY ALL))"""


def _xs(t):
    return f"xs{t} AS (SELECT doc_id, page, round_even(x0, 0) AS x, count(*) AS n, max(page_w) AS w FROM {t} WHERE n_chars > 5 GROUP BY ALL)"


@q("w13_column_count", sql_with(f"SELECT * FROM {_cols('geo')}", "v_blocks", extra=SIDES + ", " + _xs("geo")))
def _(s, sf):
    return y.column_count(geo(s, sf))


@q("a20_layout_features", sql_with(f"""SELECT b.doc_id, page_count, headings, bullets, coalesce(c.columns, 1) AS column_count, coalesce(c.confidence, 'none') AS column_confidence, coalesce(bl.value, -1) AS body_left, coalesce(m1, -1) AS margin_1, coalesce(m2, -1) AS margin_2, coalesce(m3, -1) AS margin_3, coalesce(sg, 0) AS section_gap, coalesce(lg, 0) AS line_gap
FROM (SELECT doc_id, max(page) AS page_count, count(*) FILTER (block_type = 'heading') AS headings, count(*) FILTER (block_type = 'bullet') AS bullets, median(spacing_before) FILTER (block_type = 'heading' AND spacing_before > 0) AS sg, median(spacing_before) FILTER (block_type <> 'heading' AND spacing_before > 0) AS lg FROM geo GROUP BY 1) b
LEFT JOIN (SELECT * FROM {_cols('geo')} WHERE page = 1) c ON c.doc_id = b.doc_id
LEFT JOIN (SELECT doc_id, value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS rn FROM {_VC.format("geo WHERE n_chars > 15 AND block_type <> 'heading'")}) WHERE rn = 1) bl ON bl.doc_id = b.doc_id
LEFT JOIN (SELECT doc_id, max(value) FILTER (rn = 1) AS m1, max(value) FILTER (rn = 2) AS m2, max(value) FILTER (rn = 3) AS m3 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f, value) AS rn FROM {_VC.format('geo WHERE n_chars > 0')}) GROUP BY 1) m ON m.doc_id = b.doc_id""", "v_blocks", extra=SIDES + ", " + _xs("geo")))
def _(s, sf):
    f = y.layout_features(geo(s, sf))
    return f.withColumns({c: F.coalesce(c, F.lit(-1.0)) for c in ("body_left", "margin_1", "margin_2", "margin_3")})


@q("w12_sparse_pages", sql_with("""SELECT o.doc_id, o.page, round(content_fill, 6) AS content_fill, round(o.area_ratio, 6) AS area_ratio, o.page = last AS is_last, coalesce(s.area_ratio < 0.30, false) AS structural,
o.page <> last AND NOT coalesce(s.area_ratio < 0.30, false) AND o.area_ratio < 0.30 AS hard, o.page <> last AND NOT coalesce(s.area_ratio < 0.30, false) AS counted
FROM (SELECT *, lag(content_fill) OVER (PARTITION BY doc_id ORDER BY page) AS prev, max(page) OVER (PARTITION BY doc_id) AS last FROM fo) o LEFT JOIN (SELECT doc_id, page, area_ratio FROM fs) s ON s.doc_id = o.doc_id AND s.page = o.page
WHERE o.page > 1 AND all_lines >= 18 AND NOT blank AND content_fill < 0.65 AND prev >= 0.75""", "v_blocks", extra=SIDES + f", fo AS (SELECT * FROM {_fill('ob')}), fs AS (SELECT * FROM {_fill('sb')})"))
def _(s, sf):
    a, b = sides(s, sf)
    return r6(y.sparse_pages(y.page_fill(b), y.page_fill(a)), "content_fill", "area_ratio")


@q("w14_column_jump", sql_with("""SELECT doc_id, page, tail, head, round(abs(head - tail) / 612, 6) AS "shift", CASE WHEN tail < 612 * 0.4 THEN 'left' ELSE 'right' END AS tail_side, CASE WHEN head < 612 * 0.4 THEN 'left' ELSE 'right' END AS head_side FROM (
SELECT t.doc_id, t.page, tail, head FROM (SELECT doc_id, page, median((x0 + x1) / 2) AS tail, count(*) AS n FROM geo WHERE n_chars >= 3 AND y0 >= 396 AND y0 <= 792 GROUP BY ALL) t JOIN (SELECT doc_id, page - 1 AS page, median((x0 + x1) / 2) AS head, count(*) AS n FROM geo WHERE n_chars >= 3 AND y0 <= 396 GROUP BY ALL) h
ON h.doc_id = t.doc_id AND h.page = t.page WHERE t.n >= 3 AND h.n >= 3) WHERE abs(head - tail) / 612 >= 0.25 AND ((tail < 612 * 0.4 AND head > 612 * 0.6) OR (tail > 612 * 0.6 AND head < 612 * 0.4))""", "v_blocks", extra=SIDES))
def _(s, sf):
    return r6(y.column_jump(geo(s, sf)), "shift")


@q("w16_reading_order", sql_with('SELECT doc_id, block_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, y0, x0, block_id) AS "position", row_number() OVER (PARTITION BY doc_id, block_type ORDER BY page, y0, x0, block_id) AS position_in_type FROM v_blocks', "v_blocks"))
def _(s, sf):
    b = view(s, sf, "v_blocks")
    a = y.reading_order(b).select("doc_id", "block_id", "position")
    t = y.reading_order(b, ["doc_id", "block_type"]).select("doc_id", "block_id", F.col("position").alias("position_in_type"))
    return a.join(t, ["doc_id", "block_id"])


_ALIAS = "CASE text WHEN '1. Experience' THEN 'experience' WHEN 'SKILLS' THEN 'skills' WHEN 'Education' THEN 'education' WHEN 'Summary' THEN 'summary' WHEN 'Languages' THEN 'languages' WHEN 'Certifications' THEN 'certifications' WHEN 'Work History' THEN 'experience' END"
_REG = "CASE WHEN nx1 <= nx0 THEN 'unknown' WHEN nx1 - nx0 < 0.45 AND (nx0 + nx1) / 2 < 0.35 THEN 'sidebar_left' WHEN nx1 - nx0 < 0.45 AND (nx0 + nx1) / 2 > 0.65 THEN 'sidebar_right' ELSE 'main' END"


def _anch(t):
    return f"""n{t} AS (SELECT *, {_REG} AS region, CASE WHEN block_type = 'heading' THEN {_ALIAS} END AS canonical FROM {_n(t)}),
an{t} AS (SELECT doc_id, block_id, canonical, page, ny0, ny1, region, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, ny0, nx0, block_id) - 1 AS INT) AS idx FROM n{t} WHERE canonical IS NOT NULL),
sp{t} AS (SELECT * FROM (SELECT *, last_value(CASE WHEN canonical IS NOT NULL THEN {{'page': page, 'ny0': ny0, 'ny1': ny1, 'region': region, 'canonical': canonical, 'block_id': block_id}} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page, ny0, canonical IS NOT NULL, nx0, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sec FROM n{t})
 WHERE canonical IS NULL AND sec IS NOT NULL AND CASE WHEN sec.region = 'main' THEN region NOT IN ('sidebar_left','sidebar_right') ELSE region = sec.region END)"""


@q("w11_section_spans", sql_with("SELECT s.doc_id, s.block_id, a.idx, a.canonical FROM spob s JOIN anob a ON a.doc_id = s.doc_id AND a.block_id = s.sec.block_id", "v_blocks", extra=SIDES + ", " + _anch("ob")))
def _(s, sf):
    return y.section_spans(sides(s, sf)[1]).select("doc_id", "block_id", F.col("sec.idx").alias("idx"), F.col("sec.canonical").alias("canonical"))


_PL = """(SELECT d.doc_id, c.canonical, s.doc_id IS NOT NULL AS in_source, o.doc_id IS NOT NULL AS in_output, s.f AS s, o.f AS o, greatest(0.0::DOUBLE, 1 - 0.5::DOUBLE * abs(o.f.page - s.f.page)) AS pg,
greatest(0.0::DOUBLE, 1 - abs(o.f.ny0 - s.f.ny0) / CASE WHEN s.f.region IN ('sidebar_left','sidebar_right') THEN 0.12::DOUBLE ELSE 0.20::DOUBLE END) AS vt, CASE WHEN s.f.region = o.f.region THEN 1.0::DOUBLE WHEN s.f.region = 'main' OR o.f.region = 'main' THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS rg,
greatest(0.0::DOUBLE, 1 - abs(s.li - o.li) * 0.25::DOUBLE) AS od FROM (SELECT doc_id FROM sb UNION SELECT doc_id FROM ob) d CROSS JOIN (SELECT unnest(['certifications','education','experience','languages','skills','summary']) AS canonical) c
LEFT JOIN (SELECT doc_id, canonical, arg_min({'page': page, 'ny0': ny0, 'region': region}, idx) AS f, max(idx) AS li FROM ansb GROUP BY ALL) s ON s.doc_id = d.doc_id AND s.canonical = c.canonical
LEFT JOIN (SELECT doc_id, canonical, arg_min({'page': page, 'ny0': ny0, 'region': region}, idx) AS f, max(idx) AS li FROM anob GROUP BY ALL) o ON o.doc_id = d.doc_id AND o.canonical = c.canonical)"""


def _sc(e):
    return f"round(CASE WHEN in_source AND in_output THEN {e} WHEN in_source THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END, 6)"


_PS = """CASE WHEN in_source AND in_output THEN least(1.0::DOUBLE, pg * 0.20::DOUBLE + vt * 0.35::DOUBLE + rg * 0.30::DOUBLE + od * 0.15::DOUBLE) WHEN in_source THEN 0.0::DOUBLE WHEN in_output AND canonical = 'summary' AND o.page = 1 AND o.region = 'main' AND o.ny0 < 0.40 THEN 0.70::DOUBLE ELSE 0.5::DOUBLE END"""


@q("j17_section_pairs", sql_with(f"SELECT doc_id, canonical, in_source, in_output, {_sc('pg')} AS page_score, {_sc('vt')} AS vertical_score, {_sc('rg')} AS region_score, {_sc('od')} AS order_score, round({_PS}, 6) AS placement_score FROM {_PL}",
                                 "v_blocks", extra=SIDES + ", " + _anch("sb") + ", " + _anch("ob")))
def _(s, sf):
    return r6(y.section_pairs(*sides(s, sf)), "page_score", "vertical_score", "region_score", "order_score", "placement_score")


@q("f22_placement_scores", sql_with(f"SELECT doc_id, count(*) AS sections, round(CAST(sum(CAST(round({_PS}, 12) AS DECIMAL(24,12))) AS DOUBLE) / count(*), 6) AS placement FROM {_PL} WHERE in_source OR in_output GROUP BY 1",
                                    "v_blocks", extra=SIDES + ", " + _anch("sb") + ", " + _anch("ob")))
def _(s, sf):
    return r6(y.placement_by_doc(y.section_pairs(*sides(s, sf))), "placement")


def _size(t):
    return f"""sz{t} AS (SELECT a.doc_id, a.idx, a.canonical, a.region, CAST(coalesce(chars, 0) AS BIGINT) AS chars, CAST(coalesce(lines, 0) AS BIGINT) AS lines, coalesce(height, 0) AS height FROM an{t} a LEFT JOIN (
SELECT doc_id, bid, sum(chars) AS chars, sum(lines) AS lines, round(CAST(sum(CAST(round(greatest(0.0::DOUBLE, bottom - CASE WHEN page = ap THEN ab ELSE top END), 12) AS DECIMAL(24,12))) AS DOUBLE), 4) AS height FROM (
SELECT doc_id, sec.block_id AS bid, page, sum(n_chars) AS chars, sum(n_lines) AS lines, min(ny0) AS top, max(ny1) AS bottom, max(sec.page) AS ap, max(sec.ny1) AS ab FROM sp{t} GROUP BY ALL) GROUP BY ALL) h ON h.doc_id = a.doc_id AND h.bid = a.block_id)"""


def _cl(e):
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {e}))"


def _pen(r, thr):
    return f"(CASE WHEN {r} <= {thr} THEN 0.0::DOUBLE ELSE {_cl(f'({r} - {thr}) / greatest(0.01::DOUBLE, {thr} - 1)')} END)"


_CT = "CASE canonical " + " ".join(f"WHEN '{c}' THEN {a}::DOUBLE" for c, a, b, s in y.STRESS_CONFIG) + " END"
_HT = "CASE canonical " + " ".join(f"WHEN '{c}' THEN {b}::DOUBLE" for c, a, b, s in y.STRESS_CONFIG) + " END"
_WT = ["CASE canonical " + " ".join(f"WHEN '{c}' THEN {y.STRESS_WEIGHTS[s][i]}::DOUBLE" for c, a, b, s in y.STRESS_CONFIG) + " END" for i in range(4)]
_STRESS = f"""SELECT doc_id, idx, canonical, region, chars, lines, height, in_source, stress, CASE WHEN stress < 0.30 THEN 'low' WHEN stress < 0.65 THEN 'medium' ELSE 'high' END AS level FROM (
SELECT *, round({_cl(f"({_pen('cr', 'ct')} * w0 + {_pen('lr', 'ct')} * w1 + {_pen('hr', 'ht')} * w2 + greatest({_cl('(cph - 1500.0::DOUBLE) / 4000.0::DOUBLE')}, {_cl('(chars / greatest(1, lines) - CASE WHEN side THEN 65 ELSE 90 END) / 30.0::DOUBLE')} * 0.5::DOUBLE) * w3) * CASE WHEN side THEN 1.4::DOUBLE WHEN region = 'main' THEN 1.0::DOUBLE ELSE 1.1::DOUBLE END")}, 9) AS stress FROM (
SELECT o.*, s.doc_id IS NOT NULL AS in_source, region IN ('sidebar_left','sidebar_right') AS side, {_CT} AS ct, {_HT} AS ht, {_WT[0]} AS w0, {_WT[1]} AS w1, {_WT[2]} AS w2, {_WT[3]} AS w3,
CASE WHEN s_chars > 0 THEN chars / greatest(1, s_chars) ELSE 1.0::DOUBLE END AS cr, CASE WHEN s_chars > 0 THEN lines / greatest(1, s_lines) ELSE 1.0::DOUBLE END AS lr, CASE WHEN s_height > 1e-6 THEN height / s_height ELSE 1.0::DOUBLE END AS hr, CASE WHEN height > 1e-6 THEN chars / height ELSE 0.0::DOUBLE END AS cph
FROM szob o LEFT JOIN (SELECT doc_id, canonical, sum(chars) AS s_chars, sum(lines) AS s_lines, CAST(sum(CAST(round(height, 12) AS DECIMAL(24,12))) AS DOUBLE) AS s_height FROM szsb GROUP BY ALL) s USING (doc_id, canonical)))"""


@q("f23_stress_scores", sql_with(_STRESS.replace("s.doc_id IS NOT NULL", "s_chars IS NOT NULL"), "v_blocks", extra=SIDES + ", " + ", ".join([_anch("sb"), _anch("ob"), _size("sb"), _size("ob")])))
def _(s, sf):
    return y.stress_scores(*sides(s, sf))


@q("f21_fit_risk", sql_with("""SELECT doc_id, block_type, round(c, 6) AS char_ratio, round(p, 6) AS para_ratio, CASE WHEN c >= hi OR p >= hi THEN 'high' WHEN c >= med OR p >= med THEN 'medium' ELSE 'low' END AS risk FROM (
SELECT doc_id, block_type, o.chars / greatest(1, s.chars) AS c, o.paras / greatest(1, s.paras) AS p, CASE WHEN s.narrow THEN 1.2 ELSE 1.8 END AS med, CASE WHEN s.narrow THEN 1.5 ELSE 2.5 END AS hi FROM (SELECT doc_id, block_type, sum(n_chars) AS chars, count(*) AS paras, max(x1 - x0) < 200 AS narrow FROM sb GROUP BY ALL) s JOIN (SELECT doc_id, block_type, sum(n_chars) AS chars, count(*) AS paras FROM ob GROUP BY ALL) o USING (doc_id, block_type))""", "v_blocks", extra=SIDES))
def _(s, sf):
    a, b = sides(s, sf)
    g = lambda d: d.groupBy("doc_id", "block_type").agg(F.sum("n_chars").alias("chars"), F.count("*").alias("paras"), (F.max(F.col("x1") - F.col("x0")) < 200).alias("narrow"))
    return r6(y.fit_risk(g(a), g(b), ["doc_id", "block_type"]), "char_ratio", "para_ratio")


_PENX = "CASE WHEN r > 2.5 THEN least(30.0::DOUBLE, (r - 2.5) * 10 + 15) WHEN r > 1.8 THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END"


@q("a37_container_expansion", sql_with(f"""SELECT d.doc_id, coalesce(e, 0) AS expanded, round(CASE WHEN p IS NULL THEN 80.0 ELSE greatest(0.0::DOUBLE, 100 - p) END, 6) AS score FROM (SELECT DISTINCT doc_id FROM fo) d LEFT JOIN (
SELECT doc_id, CAST(sum(CAST(round({_PENX}, 12) AS DECIMAL(24,12))) AS DOUBLE) AS p, count(*) FILTER ({_PENX} > 0) AS e FROM (SELECT doc_id, greatest(1.0::DOUBLE, fo.content_height) / greatest(1.0::DOUBLE, fs.content_height) AS r FROM fs JOIN fo USING (doc_id, page)) GROUP BY 1) x ON x.doc_id = d.doc_id""",
                                       "v_blocks", extra=SIDES + f", fo AS (SELECT * FROM {_fill('ob')}), fs AS (SELECT * FROM {_fill('sb')} WHERE doc_id % 7 <> 0)"))
def _(s, sf):
    a, b = sides(s, sf)
    return r6(y.container_expansion(y.page_fill(a).filter("doc_id % 7 <> 0"), y.page_fill(b)), "score")


_DEF_SIDES = SIDES + """, s2 AS (SELECT * FROM sb WHERE page <= 1 + doc_id % 4), o2 AS (SELECT * REPLACE (CASE WHEN page = 2 AND doc_id % 5 = 0 THEN n_lines % 2 ELSE n_lines END AS n_lines, CASE WHEN page = 2 AND doc_id % 5 = 0 THEN n_chars % 3 WHEN page = 1 AND doc_id % 11 = 0 AND n_chars % 9 <> 0 THEN 1 ELSE n_chars END AS n_chars) FROM ob),
fs AS (SELECT * FROM """ + _fill("s2") + "), fo AS (SELECT * FROM " + _fill("o2") + """), size AS (SELECT doc_id, a.m AS sp, b.m AS op FROM (SELECT doc_id, max(page) AS m FROM fs GROUP BY 1) a JOIN (SELECT doc_id, max(page) AS m FROM fo GROUP BY 1) b USING (doc_id)),
bt AS (SELECT o.*, sp, op, s.blank AS sbl, s.area_ratio AS sa, s.lines AS sl FROM fo o JOIN size USING (doc_id) LEFT JOIN fs s ON s.doc_id = o.doc_id AND s.page = o.page),
pc AS (SELECT t, doc_id, page, CASE WHEN l >= 2 AND r >= 2 THEN 2 ELSE 1 END AS cols FROM (SELECT t, doc_id, page, count(*) FILTER ((x0 + x1) / 2 < page_w * 0.35) AS l, count(*) FILTER ((x0 + x1) / 2 > page_w * 0.65) AS r FROM (SELECT 's' AS t, * FROM s2 UNION ALL SELECT 'o', * FROM o2) WHERE n_chars >= 3 GROUP BY ALL))"""


def _exp(t):
    return rf"(SELECT doc_id, arg_min((y0 + y1) / 2, (y0, x0, block_id)) AS yy FROM {t} WHERE page = 1 AND block_type = 'heading' AND regexp_matches(text, '(?i)^(?:(?:work\s+)?experience\b|employment\b|work\s+history\b)') GROUP BY 1)"


@q("a38_page_defects", sql_with(f"""SELECT doc_id, 'page_growth' AS defect, op AS page, CASE WHEN op - sp = 2 THEN 70.0 ELSE 0.0 END::DOUBLE AS score, op - sp > 2 AS hard FROM size WHERE op - sp > 1
UNION ALL SELECT doc_id, 'blank_middle', page, 0, true FROM bt WHERE blank AND page <> op AND NOT coalesce(sbl, false)
UNION ALL SELECT doc_id, 'blank_trailing', page, CASE WHEN all_chars < 50 AND all_lines = 0 AND (op - sp IN (0, 1) OR op = 1) THEN 0 ELSE 60 END, all_chars < 50 AND all_lines = 0 AND (op - sp IN (0, 1) OR op = 1) FROM bt WHERE blank AND page = op AND NOT coalesce(sbl, false)
UNION ALL SELECT doc_id, 'thin_page', page, CASE WHEN page = op THEN 100 ELSE 0 END, lines <= 2 AND area_ratio <= 0.005 AND NOT coalesce(sl <= 2 AND sa <= 0.005, false) AND page <> op FROM bt WHERE page > 1 AND lines < 8 AND area_ratio < 0.18 AND NOT coalesce(sl < 8 AND sa < 0.18, false)
UNION ALL SELECT b.doc_id, 'sparse_first_page', page, 0, true FROM bt b JOIN (SELECT doc_id, max(area_ratio) AS later FROM fo WHERE page > 1 GROUP BY 1) l ON l.doc_id = b.doc_id WHERE page = 1 AND area_ratio < 0.08 AND coalesce(sa, 1) >= 0.08 AND later >= 0.10
UNION ALL SELECT o.doc_id, 'column_loss', min(o.page), 0, true FROM pc o JOIN pc o1 ON o1.t = 'o' AND o1.doc_id = o.doc_id AND o1.page = 1 AND o1.cols = 2 JOIN pc s1 ON s1.t = 's' AND s1.doc_id = o.doc_id AND s1.page = 1 AND s1.cols = 2 JOIN pc s ON s.t = 's' AND s.doc_id = o.doc_id AND s.page = o.page AND s.cols = 2
 JOIN fo ON fo.doc_id = o.doc_id AND fo.page = o.page AND NOT (fo.lines <= 2 AND fo.area_ratio <= 0.005) WHERE o.t = 'o' AND o.page > 1 AND o.cols = 1 GROUP BY o.doc_id
UNION ALL SELECT doc_id, 'block_growth', 0, round(100 - least(20.0::DOUBLE, (r - 1.5) * 25), 6), false FROM (SELECT doc_id, b1 / b0 AS r FROM (SELECT doc_id, sum(blocks) AS b0 FROM fs GROUP BY 1) JOIN (SELECT doc_id, sum(blocks) AS b1 FROM fo GROUP BY 1) USING (doc_id) WHERE b0 > 0) WHERE r > 1.5
UNION ALL SELECT doc_id, 'experience_pushed_down', 1, 100, o.yy / 792 > 0.55 FROM {_exp('s2')} s JOIN {_exp('o2')} o USING (doc_id) WHERE (o.yy - s.yy) / 792 > 0.08""", "v_blocks", extra=_DEF_SIDES))
def _(s, sf):
    a, b = sides(s, sf)
    a = a.filter("page <= 1 + doc_id % 4")
    b = b.withColumns({
        "n_lines": F.expr("CASE WHEN page = 2 AND doc_id % 5 = 0 THEN n_lines % 2 ELSE n_lines END"),
        "n_chars": F.expr("CASE WHEN page = 2 AND doc_id % 5 = 0 THEN n_chars % 3 WHEN page = 1 AND doc_id % 11 = 0 AND n_chars % 9 <> 0 THEN 1 ELSE n_chars END")})
    return r6(y.page_defects(a, b), "score")


_OVL = "(SELECT a.doc_id, count(*) AS n FROM hb{0} a JOIN hb{0} b ON a.doc_id = b.doc_id AND a.block_id < b.block_id AND a.y0 < b.y1 - 3 AND b.y0 < a.y1 - 3 AND a.x0 < b.x1 - 3 AND b.x0 < a.x1 - 3 GROUP BY 1)"


@q("j26_bbox_overlaps", sql_with(f"""SELECT c.doc_id, c.n AS head_blocks, o.n AS overlaps, coalesce(s.n, 0) AS src_overlaps, o.n >= coalesce(s.n, 0) + 3 AS hard FROM (SELECT doc_id, count(*) AS n FROM hbob GROUP BY 1) c JOIN {_OVL.format('ob')} o ON o.doc_id = c.doc_id LEFT JOIN {_OVL.format('sb')} s ON s.doc_id = c.doc_id WHERE c.n >= 3 AND o.n > coalesce(s.n, 0) + 1""",
                                 "v_blocks", extra=SIDES + ", " + ", ".join(f"hb{t} AS (SELECT * FROM {t} WHERE page = 1 AND y0 < page_h * 0.40 AND n_chars >= 3)" for t in ("sb", "ob"))))
def _(s, sf):
    a, b = sides(s, sf)
    return y.bbox_overlaps(a, b)


_CR = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{a}')" for a in al) + f" THEN '{k}'" for k, al in y.REGION_HEADINGS.items()) + " ELSE regexp_replace(lower(text), '[^a-z0-9]', '', 'g') END"


def _heads(t, k):
    return f"h{t} AS (SELECT doc_id, {k}, row_number() OVER (PARTITION BY doc_id ORDER BY page, y0, x0, block_id) AS pos, CASE WHEN (y0 + y1) / 2 / page_h < 0.35 THEN 0 WHEN (y0 + y1) / 2 / page_h < 0.70 THEN 1 ELSE 2 END AS zone FROM (SELECT *, {_CR} AS {k} FROM {t} WHERE block_type IN ('heading', 'header')) WHERE {k} <> '')"


@q("a36_region_scores", sql_with("""SELECT d.doc_id, coalesce(expected, 0) AS expected, coalesce(found, 0) AS found, coalesce(inv, 0) AS inversions,
round(CASE WHEN expected IS NULL THEN 100 ELSE (0.55::DOUBLE * (0.65::DOUBLE * coalesce(found, 0) / expected + 0.35::DOUBLE * CASE WHEN coalesce(found, 0) > 1 THEN 1 - inv / (found - 1) ELSE 1 END) + 0.45::DOUBLE * coalesce(zs, 0.85)) * 100 END, 6) AS score, false AS hard
FROM (SELECT DISTINCT doc_id FROM s3) d LEFT JOIN (SELECT doc_id, count(*) AS expected FROM hs3 GROUP BY 1) e ON e.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS found, count(*) FILTER (pv > pos_b) AS inv FROM (SELECT *, lag(pos_b) OVER (PARTITION BY doc_id ORDER BY pos) AS pv FROM (SELECT h.doc_id, h.pos, b.pos_b FROM hs3 h JOIN best b ON b.doc_id = h.doc_id AND b.ka = h.ka)) GROUP BY 1) f ON f.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, sum(CASE abs(za - zb) WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END) / (2 * count(*)) AS zs FROM (SELECT doc_id, ka, arg_min(zone, pos) AS za FROM hs3 GROUP BY ALL) JOIN best USING (doc_id, ka) GROUP BY 1) z ON z.doc_id = d.doc_id""", "v_blocks",
    extra=SIDES + f""", s3 AS (SELECT * FROM sb WHERE doc_id % 2 = 0 OR block_type <> 'heading' OR n_chars % 3 = 0), o3 AS (SELECT * REPLACE (CASE WHEN text = 'Misc Notes' THEN 'Notes' ELSE text END AS text) FROM ob WHERE n_chars % 5 <> 0),
{_heads('s3', 'ka')}, {_heads('o3', 'kb')}, best AS (SELECT a.doc_id, ka, min(pos) AS pos_b, arg_min(zone, pos) AS zb FROM (SELECT DISTINCT doc_id, ka FROM hs3) a JOIN ho3 b ON b.doc_id = a.doc_id AND (contains(ka, kb) OR contains(kb, ka)) GROUP BY ALL)"""))
def _(s, sf):
    a, b = sides(s, sf)
    a = a.filter("doc_id % 2 = 0 OR block_type <> 'heading' OR n_chars % 3 = 0")
    b = b.filter("n_chars % 5 <> 0").withColumn("text", F.expr("CASE WHEN text = 'Misc Notes' THEN 'Notes' ELSE text END"))
    return r6(y.region_scores(a, b), "score")


@q("a27_repeated_zone_text", sql_with("""SELECT t.doc_id, t.text, n >= need AS by_text, coalesce(k.doc_id IS NOT NULL, false) AS by_bucket, last >= 2 AS later_page FROM (SELECT doc_id, text, count(DISTINCT page) AS n, max(page) AS last, any_value(need) AS need FROM z GROUP BY ALL) t
LEFT JOIN (SELECT DISTINCT z.doc_id, z.text FROM z JOIN (SELECT doc_id, bucket FROM z GROUP BY ALL HAVING count(DISTINCT page) >= any_value(need)) b USING (doc_id, bucket)) k ON k.doc_id = t.doc_id AND k.text = t.text WHERE n >= need OR k.doc_id IS NOT NULL OR last >= 2""", "v_blocks",
    extra=SIDES + """, np AS (SELECT doc_id, greatest(2, floor(count(DISTINCT page) / 2)) AS need FROM geo GROUP BY 1 HAVING count(DISTINCT page) >= 2), z AS (SELECT g.doc_id, page, text, round_even(y0 / page_h, 2) AS bucket, need FROM geo g JOIN np ON np.doc_id = g.doc_id WHERE y1 <= page_h * 0.08 OR y0 >= page_h * 0.92)""".replace("0.92", "(1 - 0.08::DOUBLE)")))
def _(s, sf):
    return y.repeated_zone_text(geo(s, sf))


_FR = "SELECT doc_id, CASE WHEN line_no % 3 = 0 OR doc_id % 4 = 0 THEN left(line, 1 + line_no % 2) WHEN doc_id % 5 = 0 THEN concat('A  B  ', upper(left(line, 1)), line) ELSE line END AS text FROM {}"


@q("a22_fragmentation", sql_with(r"""SELECT o.doc_id, o.n AS lines, o.m AS micro, o.sp AS spaced, o.n >= 10 AND o.m >= 10 AND o.m * 4 >= o.n AND NOT coalesce(s.n > 0 AND s.m * 4 >= s.n, false) AS fragmented, o.sp >= 3 AS spaced_capitals FROM st o LEFT JOIN (
SELECT doc_id, count(*) FILTER (trim(line) <> '') AS n, count(*) FILTER (trim(line) <> '' AND length(trim(line)) <= 2) AS m FROM sl GROUP BY 1) s ON s.doc_id = o.doc_id""", "v_resume_lines", extra=rf"""fr AS ({_FR.format('v_resume_lines')}), sl AS (SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN left(line, 2) ELSE line END AS line FROM v_resume_lines),
st AS (SELECT doc_id, count(*) FILTER (trim(text) <> '') AS n, count(*) FILTER (trim(text) <> '' AND length(trim(text)) <= 2) AS m, count(*) FILTER (regexp_matches(text, '(^|[^\p{{L}}\p{{N}}_])[A-Z]\s{{2,}}[A-Z]\s{{2,}}[A-Z]')) AS sp FROM fr GROUP BY 1)"""))
def _(s, sf):
    view(s, sf, "v_resume_lines").createOrReplaceTempView("quire_v_resume_lines")
    src = s.sql("SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN left(line, 2) ELSE line END AS text FROM quire_v_resume_lines")
    return y.fragmentation(s.sql(_FR.format("quire_v_resume_lines").replace("1 + line_no % 2", "CAST(1 + line_no % 2 AS INT)")), src)
