"""Page geometry: fill, columns, topology, anchors, spans, placement, stress and defects.

Block tables have (doc_id, page, block_id, page_w, page_h, x0, y0, x1, y1,
block_type, n_lines, n_chars, spacing_before) and, where headings are read, text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import lexicons as L
from quire.functions import text as t
from quire.operators.evals import clamp
from quire.plans import (
    cut, grouped_median, lag1, last_seen_before, ordered_scan, rank_in, rule_table,
)

# Fixed values.
TOPOLOGY_TRANSITIONS = (
    ("sidebar_left", "sidebar_right", 0.25), ("sidebar_right", "sidebar_left", 0.25),
    ("sidebar_left", "two_column_balanced", 0.50), ("sidebar_right", "two_column_balanced", 0.50),
    ("two_column_balanced", "sidebar_left", 0.50), ("two_column_balanced", "sidebar_right", 0.50),
    ("linear_single_column", "sidebar_left", 0.10), ("linear_single_column", "sidebar_right", 0.10),
    ("linear_single_column", "two_column_balanced", 0.25), ("sidebar_left", "linear_single_column", 0.10),
    ("sidebar_right", "linear_single_column", 0.10), ("two_column_balanced", "linear_single_column", 0.25),
)
SECTION_TYPES = ("certifications", "education", "experience", "languages", "skills", "summary")
STRESS_CONFIG = (  # type, growth threshold of characters, of height, sensitivity
    ("summary", 1.5, 1.3, "high"), ("skills", 1.8, 1.8, "high"), ("languages", 1.4, 1.4, "high"),
    ("certifications", 1.5, 1.5, "medium"), ("education", 2.0, 2.0, "medium"), ("experience", 2.5, 2.5, "low"),
)
STRESS_WEIGHTS = {"high": (0.20, 0.15, 0.45, 0.20), "medium": (0.22, 0.18, 0.42, 0.18), "low": (0.25, 0.20, 0.40, 0.15)}
REGION_HEADINGS = {
    "experience": ("experience", "work experience", "professional experience", "employment history", "work history",
                   "career history", "employment", "experiences"),
    "education": ("education", "academic", "qualifications", "degree"),
    "skills": ("skills", "competencies", "expertise", "technologies", "tech stack", "technical skills", "core competencies"),
    "summary": ("summary", "profile", "objective", "about", "overview", "career summary"),
    "certifications": ("certif", "certification", "license"),
    "projects": ("project",),
}
AMBIGUOUS = "mixed_or_ambiguous"


def normalised(blocks: DataFrame) -> DataFrame:
    """Blocks with edges as page fractions clamped to [0, 1]."""
    return blocks.filter("page_w > 0 AND page_h > 0").withColumns({
        "nx0": clamp(F.col("x0") / F.col("page_w")), "nx1": clamp(F.col("x1") / F.col("page_w")),
        "ny0": clamp(F.col("y0") / F.col("page_h")), "ny1": clamp(F.col("y1") / F.col("page_h")),
    })


def region_of(nx0: Column, nx1: Column) -> Column:
    width, centre = nx1 - nx0, (nx0 + nx1) / 2
    return (
        F.when(nx1 <= nx0, "unknown").when((width < 0.45) & (centre < 0.35), "sidebar_left")
        .when((width < 0.45) & (centre > 0.65), "sidebar_right").otherwise("main")
    )


def _dec(c: Column) -> Column:
    """Twelve exact decimals, so that sums do not depend on their order."""
    return F.round(c, 12).cast("decimal(24,12)")


def page_fill(blocks: DataFrame, min_chars: int = 3) -> DataFrame:
    """Per page: covered area, vertical fill, empty bottom, meaningful blocks and lines, blank flag."""
    live = F.col("n_chars") >= min_chars
    area = F.when(live, (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0")))
    g = blocks.groupBy("doc_id", "page").agg(
        F.max("page_w").alias("w"), F.max("page_h").alias("h"), F.sum(_dec(area)).alias("area"),
        F.min(F.when(live, F.col("y0"))).alias("top"), F.max(F.when(live, F.col("y1"))).alias("bottom"),
        F.count_if(live).alias("blocks"), F.sum(F.when(live, F.col("n_lines")).otherwise(0)).alias("lines"),
        F.sum("n_lines").alias("all_lines"), F.sum("n_chars").alias("all_chars"),
        F.min("y0").alias("content_top"), F.max("y1").alias("content_bottom"),
    )
    return g.select(
        "doc_id", "page",
        F.coalesce(F.col("area").cast("double") / (F.col("w") * F.col("h")), F.lit(0.0)).alias("area_ratio"),
        F.coalesce((F.col("bottom") - F.col("top")) / F.col("h"), F.lit(0.0)).alias("vert_fill"),
        F.coalesce((F.col("h") - F.col("bottom")) / F.col("h"), F.lit(1.0)).alias("bottom_empty"),
        "blocks", "lines", "all_lines", "all_chars",
        ((F.col("all_lines") < 4) & (F.col("all_chars") < 150)).alias("blank"),
        ((F.col("content_bottom") - F.col("content_top")) / F.col("h")).alias("content_fill"),
        (F.col("content_bottom") - F.col("content_top")).alias("content_height"),
    )


def page_topology(blocks: DataFrame) -> DataFrame:
    """Per page: the eight signals, the class they imply and its confidence."""
    b = normalised(blocks).withColumns({"w": F.col("nx1") - F.col("nx0"), "hh": F.col("ny1") - F.col("ny0")})
    b = b.filter("n_chars >= 3 AND w >= 0.03 AND hh >= 0.008").withColumns({
        "cx": (F.col("nx0") + F.col("nx1")) / 2, "area": _dec(F.col("w") * F.col("hh")),
        "band": F.least(F.lit(5), F.floor((F.col("ny0") + F.col("ny1")) / 2 * 6).cast("int")),
    })
    narrow = F.col("w") < 0.42
    left, right = narrow & (F.col("cx") < 0.35), narrow & (F.col("cx") > 0.65)
    bands = lambda cond: F.bit_count(F.coalesce(F.bit_or(F.when(cond, F.expr("shiftleft(1, band)"))), F.lit(0))) / 6
    share = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("area"))).cast("double"), F.lit(0.0)) / F.sum("area").cast("double")
    g = b.groupBy("doc_id", "page").agg(
        bands(left).alias("lp"), bands(right).alias("rp"),
        share(F.col("cx") < 0.50).alias("laf"), share(F.col("cx") >= 0.50).alias("raf"),
        share(left).alias("lnf"), share(right).alias("rnf"), share(F.col("w") > 0.50).alias("waf"),
        F.count(F.lit(1)).alias("total_blocks"),
    )
    lp, rp, laf, raf, lnf, rnf, waf = (F.col(c) for c in ("lp", "rp", "laf", "raf", "lnf", "rnf", "waf"))
    gap = F.abs(laf - raf)
    sb_l = (lp >= 0.40) & (lnf >= 0.05) & (lnf <= 0.45) & (raf >= 0.30)
    sb_r = (rp >= 0.40) & (rnf >= 0.05) & (rnf <= 0.45) & (laf >= 0.30)
    bal = (laf >= 0.28) & (raf >= 0.28) & (gap < 0.25) & (waf < 0.60)
    lin = (waf >= 0.55) & (lp < 0.40) & (rp < 0.40)
    one = F.lit(1.0)
    return g.withColumns({
        "topology": F.when(sb_l, "sidebar_left").when(sb_r, "sidebar_right").when(bal, "two_column_balanced")
        .when(lin, "linear_single_column").otherwise(AMBIGUOUS),
        "confidence": F.when(sb_l, F.least(one, lp * 1.2) * F.least(one, raf / 0.50))
        .when(sb_r, F.least(one, rp * 1.2) * F.least(one, laf / 0.50))
        .when(bal, F.least(one, F.least(laf, raf) / 0.50 * (1 - gap)))
        .when(lin, F.least(one, waf) * (1 - F.greatest(lp, rp))).otherwise(0.40),
    })


def doc_topology(pages: DataFrame) -> DataFrame:
    """Document class: the most frequent unambiguous page class, first seen winning ties."""
    per = pages.groupBy("doc_id", "topology").agg(F.count(F.lit(1)).alias("n"), F.min("page").alias("first"))
    clear = F.col("topology") != AMBIGUOUS
    g = per.groupBy("doc_id").agg(
        F.sum("n").alias("pages"), F.count_if(clear).alias("kinds"),
        F.max_by(F.struct("topology", "n"), F.when(clear, F.struct(F.col("n"), -F.col("first")))).alias("win"),
    )
    sig = pages.groupBy("doc_id").agg(*[F.round(F.avg(F.round(c, 9).cast("decimal(18,9)")).cast("double"), 6).alias(f"avg_{c}") for c in ("lp", "rp", "laf", "raf", "waf")])
    conf = clamp(F.col("win.n") / F.col("pages") * (1 - 0.15 * (F.col("kinds") - 1)))
    return g.join(sig, "doc_id").select(
        "doc_id", F.coalesce("win.topology", F.lit(AMBIGUOUS)).alias("topology"),
        F.when(F.col("kinds") == 0, 0.30).otherwise(conf).alias("confidence"), "pages", *[c for c in sig.columns if c != "doc_id"],
    )


def topology_preservation(src: DataFrame, out: DataFrame) -> DataFrame:
    """How well the document class survived, from the transition table."""
    table = rule_table(src.sparkSession, TOPOLOGY_TRANSITIONS, "s string, o string, kept double")
    j = src.select("doc_id", F.col("topology").alias("s"), F.col("confidence").alias("sc")).join(
        out.select("doc_id", F.col("topology").alias("o"), F.col("confidence").alias("oc")), "doc_id"
    ).join(table, ["s", "o"], "left")
    same = F.col("s") == F.col("o")
    return j.select(
        "doc_id", F.col("s").alias("src_topology"), F.col("o").alias("out_topology"),
        F.when(same & (F.col("s") == AMBIGUOUS), 0.60).when(same, 0.70 + 0.30 * F.least("sc", "oc"))
        .when((F.col("s") == AMBIGUOUS) | (F.col("o") == AMBIGUOUS), 0.55).otherwise(F.coalesce("kept", F.lit(0.40))).alias("preservation"),
    )


def horizontal_occupancy(blocks: DataFrame, bins: int = 20) -> DataFrame:
    """Share of each vertical strip of a page that blocks cover, capped at 1."""
    b = normalised(blocks).filter("nx1 > nx0 AND ny1 > ny0")
    last = F.least(F.lit(bins - 1), F.ceil(F.col("nx1") * bins).cast("int") - 1)
    b = b.withColumn("bin", F.explode(F.sequence(F.floor(F.col("nx0") * bins).cast("int"), F.greatest(last, F.floor(F.col("nx0") * bins).cast("int")))))
    over = F.least(F.col("nx1"), (F.col("bin") + 1) / bins) - F.greatest(F.col("nx0"), F.col("bin") / bins)
    # Twelve exact decimals as whole numbers, which add up in any order and cost far less than decimals; a sum beyond them is a full strip.
    part = F.floor(F.greatest(over, F.lit(0.0)) * (F.col("ny1") - F.col("ny0")) * 1e12 + 0.5)
    return b.select("doc_id", "page", "bin", part.alias("part")).groupBy("doc_id", "page", "bin").agg(
        F.least(F.lit(1.0), F.coalesce(F.try_sum("part") / F.lit(1e12) * bins, F.lit(1.0))).alias("occupancy")
    ).filter("occupancy > 0")


def value_counts(df: DataFrame, keys: Sequence[str], value: str, order: str, step: float = 2.0) -> DataFrame:
    """Values rounded to ``step`` (half to even) with counts and first position."""
    v = F.bround(F.col(value) / step, 0) * step
    return df.groupBy(*keys, v.alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))


def dominant_value(df: DataFrame, keys: Sequence[str], value: str, order: str, step: float = 2.0, least_share: float = 0.0) -> DataFrame:
    """Most frequent rounded value per key, null below ``least_share``."""
    g = value_counts(df, keys, value, order, step).groupBy(*keys).agg(
        F.max_by(F.struct("value", "n"), F.struct(F.col("n"), -F.col("first"))).alias("m"), F.sum("n").alias("total")
    )
    return g.select(
        *keys, F.when(F.col("m.n") >= F.col("total") * least_share, F.col("m.value")).alias("dominant"),
        F.col("m.n").alias("n"), "total",
    )


def top_margins(df: DataFrame, keys: Sequence[str], value: str, order: str, k: int = 3, step: float = 2.0) -> DataFrame:
    """The k most frequent rounded values per key (ranked with a limit per task first)."""
    w = Window.partitionBy(*keys).orderBy(F.col("n").desc(), "first", "value")
    return value_counts(df, keys, value, order, step).withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= k)


def median_gap(blocks: DataFrame) -> DataFrame:
    """Median positive spacing before heading and other blocks of a document."""
    b = blocks.filter("spacing_before > 0").withColumn("kind", F.when(F.col("block_type") == "heading", "section").otherwise("line"))
    m = grouped_median(b, ["doc_id", "kind"], "spacing_before", "gap")
    return m.groupBy("doc_id").agg(
        F.max(F.when(F.col("kind") == "section", F.col("gap"))).alias("section_gap"),
        F.max(F.when(F.col("kind") == "line", F.col("gap"))).alias("line_gap"),
    )


def column_count(lines: DataFrame, x: str = "x0", min_chars: int = 5) -> DataFrame:
    """Columns per page from the widest gap between left edges, with confidence.

    The scan over left edges sees whole points only, at most one row per point
    of page width.
    """
    xs = lines.filter(F.col("n_chars") > min_chars).groupBy("doc_id", "page", F.bround(x, 0).alias("x")).agg(
        F.count(F.lit(1)).alias("n"), F.max("page_w").alias("w")
    )
    win = Window.partitionBy("doc_id", "page").orderBy("x")
    gaps = xs.withColumn("gap", F.col("x") - F.lag("x").over(win)).withColumn("mid", F.col("x") - F.col("gap") / 2)
    best = gaps.groupBy("doc_id", "page").agg(
        F.max_by(F.struct("gap", "mid"), F.when(F.col("gap").isNotNull(), F.struct(F.col("gap"), -F.col("x")))).alias("g"),
        F.sum("n").alias("lines"), F.max("w").alias("w"),
    )
    j = xs.drop("w").join(best, ["doc_id", "page"]).groupBy("doc_id", "page").agg(
        F.max("lines").alias("lines"), F.max("g.gap").alias("gap"), F.max("w").alias("w"),
        F.sum(F.when(F.col("x") < F.col("g.mid"), F.col("n")).otherwise(0)).alias("l"),
        F.sum(F.when(F.col("x") >= F.col("g.mid"), F.col("n")).otherwise(0)).alias("r"),
    )
    two = F.coalesce((F.col("lines") >= 4) & (F.col("gap") >= F.col("w") * 0.15), F.lit(False))
    least = F.least("l", "r")
    return j.select(
        "doc_id", "page", F.when(two & (least >= 2), 2).otherwise(1).alias("columns"),
        F.when(two & (least >= 3), "high").otherwise("low").alias("confidence"),
    )


def layout_features(blocks: DataFrame) -> DataFrame:
    """One feature row per document."""
    b = cut(blocks)
    base = b.groupBy("doc_id").agg(
        F.max("page").alias("page_count"), F.count_if(F.col("block_type") == "heading").alias("headings"),
        F.count_if(F.col("block_type") == "bullet").alias("bullets"),
    )
    cols = column_count(b.filter("page = 1")).select("doc_id", F.col("columns").alias("column_count"), F.col("confidence").alias("column_confidence"))
    body = dominant_value(b.filter("n_chars > 15 AND block_type <> 'heading'"), ["doc_id"], "x0", "block_id").select("doc_id", F.col("dominant").alias("body_left"))
    marg = top_margins(b.filter("n_chars > 0"), ["doc_id"], "x0", "block_id").groupBy("doc_id").agg(
        *[F.max(F.when(F.col("nth") == i, F.col("value"))).alias(f"margin_{i}") for i in (1, 2, 3)]
    )
    out = base
    for d in (cols, body, marg, median_gap(b)):
        out = out.join(d, "doc_id", "left")
    return out.withColumns({
        "column_count": F.coalesce("column_count", F.lit(1)), "column_confidence": F.coalesce("column_confidence", F.lit("none")),
        "section_gap": F.coalesce("section_gap", F.lit(0.0)), "line_gap": F.coalesce("line_gap", F.lit(0.0)),
    })


def sparse_pages(out: DataFrame, src: DataFrame) -> DataFrame:
    """Continuation pages that are sparse after a full page, and whether that counts.

    Takes page-fill rows of both sides.  The last page and pages as sparse in the
    source do not count; below 30 % covered area a counted page is hard.
    """
    p = ordered_scan(out, ["doc_id"], ["page"], [F.floor(F.col("page") / 256)], [lag1("prev_fill", "content_fill")])
    last = out.groupBy("doc_id").agg(F.max("page").alias("last_page"))
    s = src.select("doc_id", "page", F.col("area_ratio").alias("src_area"))
    hit = p.filter("page > 1 AND all_lines >= 18 AND NOT blank AND content_fill < 0.65 AND prev_fill >= 0.75")
    j = hit.join(last, "doc_id").join(s, ["doc_id", "page"], "left")
    structural = F.coalesce(F.col("src_area") < 0.30, F.lit(False))
    counted = (F.col("page") != F.col("last_page")) & ~structural
    return j.select(
        "doc_id", "page", "content_fill", "area_ratio", (F.col("page") == F.col("last_page")).alias("is_last"),
        structural.alias("structural"), (counted & (F.col("area_ratio") < 0.30)).alias("hard"), counted.alias("counted"),
    )


def column_jump(blocks: DataFrame) -> DataFrame:
    """Pages whose tail sits in one column while the next page's head sits in another."""
    b = blocks.filter("n_chars >= 3").withColumn("cx", (F.col("x0") + F.col("x1")) / 2)
    tail = b.filter("y0 >= 0.5 * page_h AND y0 <= page_h")
    head = b.filter("y0 >= 0 AND y0 <= 0.5 * page_h").withColumn("page", F.col("page") - 1)

    def side(df, name):
        stats = df.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias(f"{name}_n"), F.max("page_w").alias(f"{name}_w"))
        return grouped_median(df, ["doc_id", "page"], "cx", name, F.floor(F.col("__v") / 64)).join(stats, ["doc_id", "page"])

    j = side(tail, "tail").join(side(head, "head"), ["doc_id", "page"]).filter("tail_n >= 3 AND head_n >= 3")
    at = lambda c: F.when(F.col(c) < F.col("tail_w") * 0.40, "left").when(F.col(c) > F.col("tail_w") * 0.60, "right").otherwise("center")
    j = j.withColumns({"shift": F.abs(F.col("head") - F.col("tail")) / F.col("tail_w"), "tail_side": at("tail"), "head_side": at("head")})
    return j.filter("shift >= 0.25 AND tail_side <> 'center' AND head_side <> 'center' AND tail_side <> head_side").select(
        "doc_id", "page", "tail", "head", "shift", "tail_side", "head_side"
    )


def reading_order(blocks: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Position of each block by page, then top, then left."""
    return ordered_scan(blocks, keys, ["page", "y0", "x0", "block_id"], ["page", F.floor(F.col("y0") / 64)], [rank_in("position")])


def section_anchors(blocks: DataFrame) -> DataFrame:
    """Heading blocks naming one of the six section types, in reading order (0-based index)."""
    rows = [(a, k) for k, names in L.SECTION_ALIASES.items() for a in names]
    alias = rule_table(blocks.sparkSession, rows, "key_b string, canonical string")
    heads = normalised(blocks.filter("block_type = 'heading'")).withColumn("key_b", t.alias_key(F.col("text"))).join(alias, "key_b")
    heads = heads.withColumn("region", region_of(F.col("nx0"), F.col("nx1")))
    ranked = ordered_scan(
        heads, ["doc_id"], ["page", "ny0", "nx0", "block_id"], ["page", F.floor(F.col("ny0") * 16)], [rank_in("position")]
    )
    return ranked.select(
        "doc_id", "block_id", "canonical", "page", "ny0", "ny1", "region", (F.col("position") - 1).cast("int").alias("idx")
    )


def section_spans(blocks: DataFrame) -> DataFrame:
    """Blocks with the anchor whose section they belong to (same visual region only)."""
    a = cut(section_anchors(blocks))
    tag = a.select("doc_id", "block_id", F.struct("idx", "canonical", "region", "page", "ny0", "ny1").alias("anchor"))
    b = normalised(blocks).join(tag, ["doc_id", "block_id"], "left").withColumn("__k", F.col("anchor").isNotNull().cast("int"))
    s = ordered_scan(
        b, ["doc_id"], ["page", "ny0", "__k", "nx0", "block_id"], ["page", F.floor(F.col("ny0") * 16)], [last_seen_before("sec", "anchor")]
    )
    region = region_of(F.col("nx0"), F.col("nx1"))
    fits = F.when(F.col("sec.region") == "main", ~region.isin("sidebar_left", "sidebar_right")).otherwise(region == F.col("sec.region"))
    return s.filter(F.col("anchor").isNull() & F.col("sec").isNotNull() & fits).select(
        "doc_id", "block_id", "page", "ny0", "ny1", "n_lines", "n_chars", "sec"
    )


def section_pairs(src: DataFrame, out: DataFrame) -> DataFrame:
    """Placement scores of the six section types: both, one or neither side found.

    Per type the first anchor counts; its order index is that of the type's last
    anchor on the page order.
    """
    def side(blocks, p):
        a = section_anchors(blocks).groupBy("doc_id", "canonical").agg(
            F.min_by(F.struct("page", "ny0", "region"), "idx").alias(p), F.max("idx").alias(f"{p}_idx")
        )
        return a

    a, b = side(src, "s"), side(out, "o")
    docs = src.select("doc_id").unionByName(out.select("doc_id")).distinct()
    domain = docs.select("doc_id", F.explode(F.array(*[F.lit(x) for x in SECTION_TYPES])).alias("canonical"))
    j = domain.join(a, ["doc_id", "canonical"], "left").join(b, ["doc_id", "canonical"], "left")
    has_s, has_o = F.col("s").isNotNull(), F.col("o").isNotNull()
    tol = F.when(F.col("s.region").isin("sidebar_left", "sidebar_right"), 0.12).otherwise(0.20)
    pg = clamp(1 - 0.5 * F.abs(F.col("o.page") - F.col("s.page")))
    vt = clamp(1 - F.abs(F.col("o.ny0") - F.col("s.ny0")) / tol)
    rg = F.when(F.col("s.region") == F.col("o.region"), 1.0).when((F.col("s.region") == "main") | (F.col("o.region") == "main"), 0.0).otherwise(0.5)
    od = clamp(1 - F.abs(F.col("s_idx") - F.col("o_idx")) * 0.25)
    both = clamp(pg * 0.20 + vt * 0.35 + rg * 0.30 + od * 0.15)
    expected = (F.col("canonical") == "summary") & (F.col("o.page") == 1) & (F.col("o.region") == "main") & (F.col("o.ny0") < 0.40)

    def score(full: Column) -> Column:
        return F.when(has_s & has_o, full).when(has_s, 0.0).otherwise(0.5)

    return j.select(
        "doc_id", "canonical", has_s.alias("in_source"), has_o.alias("in_output"), score(pg).alias("page_score"),
        score(vt).alias("vertical_score"), score(rg).alias("region_score"), score(od).alias("order_score"),
        F.when(has_s & has_o, both).when(has_s, 0.0).when(has_o & expected, 0.70).otherwise(0.5).alias("placement_score"),
    )


def placement_by_doc(pairs: DataFrame) -> DataFrame:
    """Mean placement over the section types found on either side."""
    live = pairs.filter("in_source OR in_output")
    return live.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("sections"),
        (F.sum(_dec(F.col("placement_score"))).cast("double") / F.count(F.lit(1))).alias("placement"),
    )


def section_sizes(blocks: DataFrame) -> DataFrame:
    """Per anchor: characters, lines and height (page fractions) of its section; empty sections too."""
    spans = section_spans(blocks).groupBy("doc_id", F.col("sec.idx").alias("idx"), "page").agg(
        F.sum("n_chars").alias("chars"), F.sum("n_lines").alias("lines"), F.min("ny0").alias("top"), F.max("ny1").alias("bottom"),
        F.max("sec.page").alias("a_page"), F.max("sec.ny1").alias("a_bottom"),
    )
    start = F.when(F.col("page") == F.col("a_page"), F.col("a_bottom")).otherwise(F.col("top"))
    h = spans.withColumn("height", _dec(F.greatest(F.lit(0.0), F.col("bottom") - start))).groupBy("doc_id", "idx").agg(
        F.sum("chars").alias("chars"), F.sum("lines").alias("lines"), F.round(F.sum("height").cast("double"), 4).alias("height")
    )
    return section_anchors(blocks).select("doc_id", "idx", "canonical", "region").join(h, ["doc_id", "idx"], "left").withColumns({
        "chars": F.coalesce("chars", F.lit(0)), "lines": F.coalesce("lines", F.lit(0)), "height": F.coalesce("height", F.lit(0.0)),
    })


def stress_scores(src: DataFrame, out: DataFrame) -> DataFrame:
    """Container stress of each output section from growth, density and long lines."""
    conf = rule_table(out.sparkSession, STRESS_CONFIG, "canonical string, char_thr double, height_thr double, sensitivity string")
    s = section_sizes(src).groupBy("doc_id", "canonical").agg(
        F.sum("chars").alias("s_chars"), F.sum("lines").alias("s_lines"), F.sum(_dec(F.col("height"))).cast("double").alias("s_height")
    )
    j = section_sizes(out).join(s, ["doc_id", "canonical"], "left").join(conf, "canonical", "left")
    grown = F.col("s_chars").isNotNull() & (F.col("s_chars") > 0)
    char_r = F.when(grown, F.col("chars") / F.greatest(F.lit(1), F.col("s_chars"))).otherwise(1.0)
    line_r = F.when(grown, F.col("lines") / F.greatest(F.lit(1), F.col("s_lines"))).otherwise(1.0)
    height_r = F.when(F.coalesce(F.col("s_height"), F.lit(0.0)) > 1e-6, F.col("height") / F.nullif("s_height", F.lit(0.0))).otherwise(1.0)
    pen = lambda r, thr: F.when(r <= F.col(thr), 0.0).otherwise(clamp((r - F.col(thr)) / F.greatest(F.lit(0.01), F.col(thr) - 1)))
    cph = F.when(F.col("height") > 1e-6, F.col("chars") / F.nullif("height", F.lit(0.0))).otherwise(0.0)
    side = F.col("region").isin("sidebar_left", "sidebar_right")
    long_pen = clamp((F.col("chars") / F.greatest(F.lit(1), F.col("lines")) - F.when(side, 65).otherwise(90)) / 30.0)
    density = F.greatest(clamp((cph - 1500.0) / 4000.0), long_pen * 0.5)
    terms = (pen(char_r, "char_thr"), pen(line_r, "char_thr"), pen(height_r, "height_thr"), density)
    weighted = lambda w: sum((x * k for x, k in zip(terms[1:], w[1:])), terms[0] * w[0])
    raw = F.when(F.col("sensitivity") == "high", weighted(STRESS_WEIGHTS["high"])).when(
        F.col("sensitivity") == "medium", weighted(STRESS_WEIGHTS["medium"])).otherwise(weighted(STRESS_WEIGHTS["low"]))
    mult = F.when(side, 1.4).when(F.col("region") == "main", 1.0).otherwise(1.1)
    d = j.withColumn("stress", F.round(clamp(raw * mult), 9))
    return d.select(
        "doc_id", "idx", "canonical", "region", "chars", "lines", "height", F.col("s_chars").isNotNull().alias("in_source"),
        "stress", F.when(F.col("stress") < 0.30, "low").when(F.col("stress") < 0.65, "medium").otherwise("high").alias("level"),
    )


def fit_risk(src: DataFrame, out: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Risk that new content overflows its container, stricter for narrow ones.

    ``src`` has (keys, chars, paras, narrow); ``out`` has (keys, chars, paras).
    """
    j = src.select(*keys, F.col("chars").alias("c0"), F.col("paras").alias("p0"), "narrow").join(
        out.select(*keys, F.col("chars").alias("c1"), F.col("paras").alias("p1")), list(keys))
    c, p = F.col("c1") / F.greatest(F.lit(1), F.col("c0")), F.col("p1") / F.greatest(F.lit(1), F.col("p0"))
    med, hi = F.when(F.col("narrow"), 1.2).otherwise(1.8), F.when(F.col("narrow"), 1.5).otherwise(2.5)
    return j.select(
        *keys, c.alias("char_ratio"), p.alias("para_ratio"),
        F.when((c >= hi) | (p >= hi), "high").when((c >= med) | (p >= med), "medium").otherwise("low").alias("risk"),
    )


def container_expansion(src: DataFrame, out: DataFrame) -> DataFrame:
    """Per document score lost by pages whose content grew in height; 80 without common pages.

    Takes page-fill rows of both sides.
    """
    h = lambda df, n: df.select("doc_id", "page", F.greatest(F.lit(1.0), F.col("content_height")).alias(n))
    r = F.col("h1") / F.col("h0")
    pen = F.when(r > 2.5, F.least(F.lit(30.0), (r - 2.5) * 10 + 15)).when(r > 1.8, 10.0).otherwise(0.0)
    j = h(src, "h0").join(h(out, "h1"), ["doc_id", "page"]).groupBy("doc_id").agg(
        F.sum(_dec(pen)).cast("double").alias("penalty"), F.count_if(pen > 0).alias("expanded"))
    docs = out.select("doc_id").distinct()
    return docs.join(j, "doc_id", "left").select(
        "doc_id", F.coalesce("expanded", F.lit(0)).alias("expanded"),
        F.when(F.col("penalty").isNull(), 80.0).otherwise(F.greatest(F.lit(0.0), 100 - F.col("penalty"))).alias("score"),
    )


def page_columns(blocks: DataFrame) -> DataFrame:
    """Two columns when both outer zones of a page hold at least two blocks."""
    cx = (F.col("x0") + F.col("x1")) / 2
    return blocks.filter("n_chars >= 3").groupBy("doc_id", "page").agg(
        F.count_if(cx < F.col("page_w") * 0.35).alias("l"), F.count_if(cx > F.col("page_w") * 0.65).alias("r")
    ).select("doc_id", "page", F.when((F.col("l") >= 2) & (F.col("r") >= 2), 2).otherwise(1).alias("cols"))


def page_defects(src: DataFrame, out: DataFrame) -> DataFrame:
    """(doc, defect, page, score, hard): page growth, blank, thin, sparse first page, lost columns,
    block growth, and experience pushed down.  Defects the source page shares are left out.
    """
    src, out = cut(src), cut(out)
    ps, po = cut(page_fill(src)), cut(page_fill(out))
    n = lambda df, c: df.groupBy("doc_id").agg(F.max("page").alias(c))
    size = cut(n(ps, "s_pages").join(n(po, "o_pages"), "doc_id"))
    row = lambda df, name, page, score, hard: df.select("doc_id", F.lit(name).alias("defect"), page.alias("page"), score.alias("score"), hard.alias("hard"))
    grow = F.col("o_pages") - F.col("s_pages")
    growth = row(size.filter("o_pages - s_pages > 1"), "page_growth", F.col("o_pages"), F.when(grow == 2, 70.0).otherwise(0.0), grow > 2)
    keep = ps.select("doc_id", "page", F.col("blank").alias("s_blank"), F.col("area_ratio").alias("s_area"), F.col("lines").alias("s_lines"))
    both = cut(po.join(size, "doc_id").join(keep, ["doc_id", "page"], "left"))
    fresh = ~F.coalesce("s_blank", F.lit(False))
    last = F.col("page") == F.col("o_pages")
    middle = row(both.filter(F.col("blank") & ~last & fresh), "blank_middle", F.col("page"), F.lit(0.0), F.lit(True))
    empty = (F.col("all_chars") < 50) & (F.col("all_lines") == 0) & (grow.isin(0, 1) | (F.col("o_pages") == 1))
    trail = row(both.filter(F.col("blank") & last & fresh), "blank_trailing", F.col("page"), F.when(empty, 0.0).otherwise(60.0), empty)
    thin_src = F.coalesce((F.col("s_lines") < 8) & (F.col("s_area") < 0.18), F.lit(False))
    thin = both.filter((F.col("page") > 1) & (F.col("lines") < 8) & (F.col("area_ratio") < 0.18) & ~thin_src)
    near = (F.col("lines") <= 2) & (F.col("area_ratio") <= 0.005)
    near_src = F.coalesce((F.col("s_lines") <= 2) & (F.col("s_area") <= 0.005), F.lit(False))
    thin = row(thin, "thin_page", F.col("page"), F.when(last, 100.0).otherwise(0.0), near & ~near_src & ~last)
    later = po.filter("page > 1").groupBy("doc_id").agg(F.max("area_ratio").alias("later"))
    first = both.filter("page = 1").join(later, "doc_id")
    first = row(first.filter((F.col("area_ratio") < 0.08) & (F.coalesce("s_area", F.lit(1.0)) >= 0.08) & (F.col("later") >= 0.10)),
                "sparse_first_page", F.col("page"), F.lit(0.0), F.lit(True))
    co = page_columns(out)
    cs = page_columns(src).withColumnRenamed("cols", "s_cols")
    two = co.filter("page = 1 AND cols = 2").select("doc_id").join(cs.filter("page = 1 AND s_cols = 2").select("doc_id"), "doc_id")
    lost = co.filter("page > 1 AND cols = 1").join(two, "doc_id").join(cs.filter("s_cols = 2").select("doc_id", "page"), ["doc_id", "page"])
    lost = lost.join(po.filter("NOT (lines <= 2 AND area_ratio <= 0.005)").select("doc_id", "page"), ["doc_id", "page"])
    lost = row(lost.groupBy("doc_id").agg(F.min("page").alias("page")), "column_loss", F.col("page"), F.lit(0.0), F.lit(True))
    total = lambda df, c: df.groupBy("doc_id").agg(F.sum("blocks").alias(c))
    ratio = F.col("b1") / F.col("b0")
    blocks = total(ps, "b0").join(total(po, "b1"), "doc_id").filter("b0 > 0").withColumn("r", ratio).filter("r > 1.5")
    blocks = row(blocks, "block_growth", F.lit(0).cast("long"), 100 - F.least(F.lit(20.0), (F.col("r") - 1.5) * 25), F.lit(False))
    exp = lambda df, c: df.filter((F.col("page") == 1) & (F.col("block_type") == "heading") & t.strip(F.col("text")).rlike(
        r"(?i)^(?:(?:work\s+)?experience\b|employment\b|work\s+history\b)")).groupBy("doc_id").agg(
            F.min_by(F.struct(((F.col("y0") + F.col("y1")) / 2).alias("y"), "page_h"), F.struct("y0", "x0", "block_id")).alias(c))
    push = exp(src, "s").join(exp(out, "o"), "doc_id")
    push = push.filter((F.col("o.y") - F.col("s.y")) / F.col("o.page_h") > 0.08)
    push = row(push, "experience_pushed_down", F.lit(1).cast("long"), F.lit(100.0), F.col("o.y") / F.col("o.page_h") > 0.55)
    every = growth
    for d in (middle, trail, thin, first, lost, blocks, push):
        every = every.unionByName(d.withColumn("page", F.col("page").cast("long")))
    return every


def box_overlaps(blocks: DataFrame, top: float = 0.40, slack: float = 3.0, cell: float = 24.0) -> DataFrame:
    """Number of overlapping block pairs in the head of page 1, per document.

    Equal boxes are counted first; distinct boxes meet in horizontal bands and
    vertical strips of ``cell`` points and a pair counts once, in the cell of its
    upper-left corner, so a crowded page is divided over its cells.
    """
    head = blocks.filter(F.col("page") == 1).filter((F.col("y0") < F.col("page_h") * top) & (F.col("n_chars") >= 3))
    box = head.groupBy("doc_id", "x0", "y0", "x1", "y1").agg(F.count(F.lit(1)).alias("n"))
    inner = (F.col("x1") - F.col("x0") > slack) & (F.col("y1") - F.col("y0") > slack)
    same = box.filter(inner).groupBy("doc_id").agg(F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("long")).alias("overlaps"))
    bins = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
    spread = box.withColumn("cy", F.explode(bins("y0", "y1"))).withColumn("cx", F.explode(bins("x0", "x1")))
    l = spread.select("doc_id", "cx", "cy", *[F.col(c).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1", "n")])
    r = spread.select("doc_id", "cx", "cy", *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1", "n")])
    before = F.struct("a_x0", "a_y0", "a_x1", "a_y1") < F.struct("b_x0", "b_y0", "b_x1", "b_y1")
    home = (F.col("cx") == F.floor(F.greatest("a_x0", "b_x0") / cell)) & (F.col("cy") == F.floor(F.greatest("a_y0", "b_y0") / cell))
    hit = (
        (F.col("a_y0") < F.col("b_y1") - slack) & (F.col("b_y0") < F.col("a_y1") - slack)
        & (F.col("a_x0") < F.col("b_x1") - slack) & (F.col("b_x0") < F.col("a_x1") - slack)
    )
    cross = l.join(r, ["doc_id", "cx", "cy"]).filter(before & home & hit).groupBy("doc_id").agg(
        F.sum(F.col("a_n") * F.col("b_n")).alias("overlaps"))
    total = same.unionByName(cross).groupBy("doc_id").agg(F.sum("overlaps").alias("overlaps"))
    return head.groupBy("doc_id").agg(F.count(F.lit(1)).alias("head_blocks")).join(total, "doc_id", "left").withColumn(
        "overlaps", F.coalesce("overlaps", F.lit(0)))


def bbox_overlaps(src: DataFrame, out: DataFrame) -> DataFrame:
    """Documents whose output head has more overlapping boxes than the source allows."""
    s = box_overlaps(src).select("doc_id", F.col("overlaps").alias("src_overlaps"))
    j = box_overlaps(out).filter("head_blocks >= 3 AND overlaps > 0").join(s, "doc_id", "left").withColumn(
        "src_overlaps", F.coalesce("src_overlaps", F.lit(0)))
    return j.filter("overlaps > src_overlaps + 1").select(
        "doc_id", "head_blocks", "overlaps", "src_overlaps", (F.col("overlaps") >= F.col("src_overlaps") + 3).alias("hard"))


def canonical_region_heading(c: Column) -> Column:
    """Section a heading belongs to by substring, else its letters and digits."""
    low = F.lower(t.strip(c))
    out = F.regexp_replace(low, "[^a-z0-9]", "")
    for name, aliases in reversed(list(REGION_HEADINGS.items())):
        out = F.when(t.any_of(low, aliases), name).otherwise(out)
    return out


def _contained(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc, ka, kb) with one key contained in the other, met on the shorter key's first letters."""
    def head(df, k):
        return df.withColumn("g", F.left(k, F.lit(3)))

    def every(df, k):
        def of(m):
            return F.transform(F.sequence(F.lit(1), F.length(k)), lambda i: F.substr(F.col(k), i, F.lit(m)))

        return df.withColumn("g", F.explode(F.array_distinct(F.concat(of(1), of(2), of(3)))))

    ab = head(a, "ka").join(every(b, "kb"), ["doc_id", "g"]).filter(F.col("kb").contains(F.col("ka")))
    ba = every(a, "ka").join(head(b, "kb"), ["doc_id", "g"]).filter(F.col("ka").contains(F.col("kb")))
    return ab.select("doc_id", "ka", "kb").unionByName(ba.select("doc_id", "ka", "kb")).distinct()


def region_scores(src: DataFrame, out: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """Presence, order and vertical region of the source headings in the output, 0-100.

    ``columns`` (doc_id, src_columns, out_columns) adds the lost-column penalty.
    """
    def heads(df, k):
        h = df.filter("block_type IN ('heading', 'header')").withColumn(k, canonical_region_heading(F.col("text"))).filter(F.col(k) != "")
        h = ordered_scan(h, ["doc_id"], ["page", "y0", "x0", "block_id"], ["page", F.floor(F.col("y0") / 64)], [rank_in("pos")])
        rel = (F.col("y0") + F.col("y1")) / 2 / F.col("page_h")
        return cut(h.select("doc_id", k, "pos", F.when(rel < 0.35, 0).when(rel < 0.70, 1).otherwise(2).alias("zone")))

    a, b = heads(src, "ka"), heads(out, "kb")
    fa = a.groupBy("doc_id", "ka").agg(F.min_by("zone", "pos").alias("za"))
    fb = b.groupBy("doc_id", "kb").agg(F.min("pos").alias("pos_b"), F.min_by("zone", "pos").alias("zb"))
    met = _contained(fa.select("doc_id", "ka"), fb.select("doc_id", "kb"))
    best = cut(met.join(fb, ["doc_id", "kb"]).groupBy("doc_id", "ka").agg(F.min("pos_b").alias("pos_b"), F.min_by("zb", "pos_b").alias("zb")))
    seq = a.join(best.select("doc_id", "ka", "pos_b"), ["doc_id", "ka"], "left")
    seen = ordered_scan(seq.filter("pos_b IS NOT NULL"), ["doc_id"], ["pos"], [F.floor(F.col("pos") / 256)], [lag1("before", "pos_b")])
    inv = seen.groupBy("doc_id").agg(F.count(F.lit(1)).alias("found"), F.count_if(F.col("before") > F.col("pos_b")).alias("inversions"))
    total = a.groupBy("doc_id").agg(F.count(F.lit(1)).alias("expected"))
    dist = F.abs(F.col("za") - F.col("zb"))
    zone = fa.join(best, ["doc_id", "ka"]).groupBy("doc_id").agg(
        (F.sum(F.when(dist == 0, 2).when(dist == 1, 1).otherwise(0)) / (2 * F.count(F.lit(1)))).alias("zone_share"))
    docs = src.select("doc_id").distinct()
    j = docs.join(total, "doc_id", "left").join(inv, "doc_id", "left").join(zone, "doc_id", "left")
    found = F.coalesce("found", F.lit(0))
    order = F.when(found > 1, 1 - F.col("inversions") / (found - 1)).otherwise(1.0)
    base = F.when(F.col("expected").isNull(), 100.0).otherwise(
        (0.55 * (0.65 * found / F.col("expected") + 0.35 * order) + 0.45 * F.coalesce("zone_share", F.lit(0.85))) * 100)
    if columns is None:
        lost = F.lit(False)
    else:
        j = j.join(columns, "doc_id", "left")
        lost = F.coalesce((F.col("src_columns") >= 2) & (F.col("out_columns") < 2), F.lit(False))
    return j.select(
        "doc_id", F.coalesce("expected", F.lit(0)).alias("expected"), found.alias("found"),
        F.coalesce("inversions", F.lit(0)).alias("inversions"), F.greatest(F.lit(0.0), base - F.when(lost, 35.0).otherwise(0.0)).alias("score"), lost.alias("hard"),
    )


def repeated_zone_text(blocks: DataFrame, zone: float = 0.08) -> DataFrame:
    """Texts in the top or bottom zone that are running heads or feet, with the rule that says so."""
    pages = blocks.groupBy("doc_id").agg(F.countDistinct("page").alias("pages")).filter("pages >= 2")
    z = blocks.filter((F.col("y1") <= F.col("page_h") * zone) | (F.col("y0") >= F.col("page_h") * (1 - zone)))
    z = z.filter(F.length(t.strip(F.col("text"))) > 0).join(pages, "doc_id").select(
        "doc_id", "page", "text", "pages", F.bround(F.col("y0") / F.col("page_h"), 2).alias("bucket"))
    need = F.greatest(F.lit(2), F.floor(F.col("pages") / 2))
    by_text = z.groupBy("doc_id", "text").agg(F.countDistinct("page").alias("n"), F.max("pages").alias("pages"), F.max("page").alias("last"))
    often = z.groupBy("doc_id", "bucket").agg(F.countDistinct("page").alias("bn"), F.max("pages").alias("pages")).filter(F.col("bn") >= need).select("doc_id", "bucket")
    bucket = z.join(often, ["doc_id", "bucket"], "left_semi").select("doc_id", "text").distinct().withColumn("by_bucket", F.lit(True))
    return by_text.join(bucket, ["doc_id", "text"], "left").select(
        "doc_id", "text", (F.col("n") >= need).alias("by_text"), F.coalesce("by_bucket", F.lit(False)).alias("by_bucket"), (F.col("last") >= 2).alias("later_page"),
    ).filter("by_text OR by_bucket OR later_page")


def fragmentation(lines: DataFrame, src_lines: DataFrame) -> DataFrame:
    """Documents whose first page broke into micro-lines or spaced capitals; lines have (doc_id, text)."""
    def stats(df, p):
        s = t.strip(F.col("text"))
        live = s != ""
        return df.groupBy("doc_id").agg(
            F.count_if(live).alias(f"{p}lines"), F.count_if(live & (F.length(s) <= 2)).alias(f"{p}micro"),
            F.count_if(F.col("text").rlike(r"(^|[^\p{L}\p{N}_])[A-Z]\s{2,}[A-Z]\s{2,}[A-Z]")).alias(f"{p}spaced"))

    j = stats(lines, "").join(stats(src_lines, "s_").select("doc_id", "s_lines", "s_micro"), "doc_id", "left")
    src_frag = F.coalesce((F.col("s_lines") > 0) & (F.col("s_micro") * 4 >= F.col("s_lines")), F.lit(False))
    micro = (F.col("lines") >= 10) & (F.col("micro") >= 10) & (F.col("micro") * 4 >= F.col("lines")) & ~src_frag
    return j.select("doc_id", "lines", "micro", "spaced", micro.alias("fragmented"), (F.col("spaced") >= 3).alias("spaced_capitals"))
