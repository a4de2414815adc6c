"""Line tables to sections and roles, paragraph labels, and what is computed on them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import lexicons as L
from quire.functions import text as t
from quire.operators.evals import clamp
from quire.operators.pairs import OVERLAP_STOP_WORDS, content_words
from quire.operators.texts import classify_heading, paragraph_hints
from quire.plans import (
    COUNT, cut, hot_keys, last_seen, last_seen_before, lead1, ordered_scan, rank_in, running_sum,
)

# Fixed values.
STRUCTURAL = ("role_header", "role_meta", "role_intro", "project_entry")
TECH_LAYER_WORDS = (
    "application", "persistence", "container", "containers", "monitoring", "monitor", "metric", "metrics", "storage",
    "cache", "caching", "message", "messaging", "queue", "deployment", "deploy", "logging", "log", "logs",
    "authentication", "authorization", "auth", "elk", "devops", "databases", "database",
)
DOMAIN_WORDS = (
    r"(?i)\b(?:backend|front.?end|full.?stack|devops|infrastructure|cloud|architecture|engineering|development|"
    r"platform|security|data|api|microservices|embedded|mobile|web|systems|integration|distributed)\b"
)
YEAR_AT_END = r"\b(?:19|20)[0-9]{2}(?:-(?:19|20)?[0-9]{2})?\s*$"
GLYPH_START = r"^[•◦▪▸●►*-]"
VERBATIM_TYPES = ("education", "certifications", "languages", "websites")
INJECTION_FLOORS = {"summary": 1.0, "experience": 0.55, "skills": 0.35}
SECTION_WORDS = (
    ("experience", "experience"), ("employment", "experience"), ("history", "experience"), ("summary", "summary"),
    ("profile", "summary"), ("objective", "summary"), ("about", "summary"), ("skill", "skills"),
    ("competenc", "skills"), ("technolog", "skills"), ("expertise", "skills"),
)
STOP_WORDS_SECTION = (
    "education", "certif", "reference", "award", "language", "volunteer", "project", "publication", "additional",
    "interest", "achievement", "honor", "affiliation", "contact",
)


def _blocks(order: str, size: int = 4096) -> list[Column]:
    return [F.floor(F.col(order) / size)]


def title_pair(column: str) -> Column:
    """Two capitalised words that could be an unlisted heading."""
    s = t.strip_plain(column)
    w = F.split(s, r"\s+")
    return (
        (s != "") & (F.length(s) <= 60) & ~s.rlike(r"^[-•·–*]") & ~s.rlike(r"[|,;:]") & ~s.rlike("[.!?]$") & (F.size(w) == 2)
        & ~F.exists(w, lambda x: ~x.rlike(r"^\p{Lu}")) & ~t.has_year(s) & ~s.rlike(r"\p{Ll}\p{Lu}")
    )


def segment_sections(lines: DataFrame, doc: str = "doc_id", order: str = "line_no", line: str = "line",
                     hot: DataFrame | None | object = COUNT) -> DataFrame:
    """Lines with section number, heading, type and whether they are the heading; section 0 precedes the first.

    Known names always open a section.  Before the first one an all-capitals line
    of three words does too.  After a heading that is not experience, two-word
    title lines open sections as long as nothing else intervened.  ``hot`` is what
    ``hot_keys(lines, [doc])`` found, if that is known; without hot documents
    nothing is written and all steps share one shuffle.
    """
    if hot is COUNT:
        hot = hot_keys(lines, [doc])
    s = F.col("__text")
    words = F.size(F.split(s, r"\s+"))
    caps = (F.length(s) <= 60) & (s == F.upper(s)) & F.regexp_replace(s, "[ -]", "").rlike(r"^\p{L}+$") & (words >= 3) & ~t.has_year(s)
    d = classify_heading(lines.withColumn("__text", t.strip_plain(line)), "__text", "__type").withColumns({
        "__full": s != "", "__caps": caps, "__pair": title_pair("__text"), "__known": F.col("__type").isNotNull() & (s != ""),
    }).drop("__text")
    opening = F.col("__known") | F.col("__caps")
    if hot is None:
        # In the order of the scans after it, so that all of them share one sort.
        whole = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        d = d.withColumn("__first", F.min(F.when(opening, F.col(order))).over(whole))
    else:
        d = d.join(d.filter(opening).groupBy(doc).agg(F.min(order).alias("__first")), doc, "left")
    d = d.withColumn("__h0", F.col("__known") | (F.col("__caps") & (F.col(order) == F.col("__first"))))
    d = d.withColumns({
        "__hat": F.when(F.col("__h0"), F.struct(F.col(order).alias("at"), F.coalesce("__type", F.lit("other")).alias("type"))),
        "__brk": F.when(F.col("__full") & ~F.col("__h0") & ~F.col("__pair"), F.col(order)),
    })
    d = ordered_scan(d, [doc], [order], _blocks(order), [last_seen_before("__lh", "__hat"), last_seen_before("__lb", "__brk")], hot)
    d = d if hot is None else cut(d)
    chain = F.col("__pair") & F.col("__lh").isNotNull() & (F.col("__lh.type") != "experience") & (
        F.col("__lb").isNull() | (F.col("__lb") < F.col("__lh.at")))
    d = d.withColumn("is_heading", F.col("__h0") | F.coalesce(chain, F.lit(False)))
    d = d.withColumn("__head", F.when(F.col("is_heading"), F.struct(t.strip_plain(line).alias("heading"), F.coalesce("__type", F.lit("other")).alias("type"))))
    d = ordered_scan(d, [doc], [order], _blocks(order), [
        running_sum("section_no", F.col("is_heading").cast("long")), last_seen("__cur", "__head")], hot)
    return d.select(
        *lines.columns, "is_heading", "section_no", F.coalesce("__cur.heading", F.lit("")).alias("heading"),
        F.coalesce("__cur.type", F.lit("")).alias("section_type"),
    )


def pre_section_prose(segmented: DataFrame, doc: str = "doc_id", order: str = "line_no", line: str = "line") -> DataFrame:
    """First long prose line before any heading, for documents without a summary section."""
    s = t.strip(F.col(line))
    prose = (F.length(s) >= 60) & s.contains(" ") & ~s.contains("@") & ~s.contains("://") & ~s.contains("|") & ~s.rlike("^[-•·–*0-9]")
    early, has = (F.col("section_no") == 0) & prose, F.col("is_heading") & (F.col("section_type") == "summary")
    d = segmented.filter(early | has).withColumn("__early", F.coalesce(early, F.lit(False)))
    g = d.groupBy(doc).agg(
        F.min_by(s, F.when(F.col("__early"), F.col(order))).alias("prose"), F.count_if("__early").alias("__n"), F.count_if(has).alias("__has"),
    )
    # The heading of a null document is no document's.
    return g.filter((F.col("__n") > 0) & ((F.col("__has") == 0) | F.col(doc).isNull())).select(doc, "prose")


def segment_roles(segmented: DataFrame, doc: str = "doc_id", order: str = "line_no", line: str = "line",
                  hot: DataFrame | None | object = COUNT) -> DataFrame:
    """Lines of experience sections with role number and label.

    ``hot`` is as in :func:`segment_sections`.

    A pipe line opens a role; a second one right after it is meta.  In a role
    lines are meta up to the first bullet; a date line after bullets closes the
    role and belongs to the next (``next_date``); what follows it is body.
    """
    s = t.strip(F.col(line))
    key = [doc, "section_no"]
    d = segmented.filter((F.col("section_type") == "experience") & ~F.col("is_heading") & (s != "")).select(doc, "section_no", order, s.alias("s"))
    d = d.withColumns({
        "pipe": F.col("s").contains("|") & ~F.col("s").rlike("^[-•]"), "bullet": F.col("s").rlike("^(?:- |• |● |– )"),
        "date": F.col("s").rlike(L.DATE_LINE),
    })
    if hot is COUNT:
        d = cut(d)
        hot = hot_keys(d, [doc])
    scan = lambda df, keys, one: ordered_scan(df, keys, [order], _blocks(order), [one], hot)
    kept = cut if hot is not None else lambda df: df
    d = kept(scan(d, key, rank_in("n")))
    d = scan(d, key, last_seen_before("lp", F.when(~F.col("pipe"), F.col("n"))))
    run = F.col("n") - F.coalesce("lp", F.lit(0))
    d = d.withColumn("opens", F.col("pipe") & (run % 2 == 1))
    d = kept(scan(d, key, running_sum("role", F.col("opens").cast("long"))))
    inner = [*key, "role"]
    d = scan(d, inner, last_seen_before("seen", F.when(F.col("bullet"), F.lit(1))))
    d = kept(d.withColumn("closes", (F.col("role") > 0) & (F.col("seen") == 1) & F.col("date") & ~F.col("pipe") & ~F.col("bullet")))
    d = scan(d, inner, last_seen_before("closed", F.when(F.col("closes"), F.lit(1))))
    label = (
        F.when(F.col("role") == 0, "body").when(F.col("opens"), "header").when(F.col("closed") == 1, "body").when(F.col("closes"), "next_date")
        .when(F.col("bullet"), "bullet").when(F.col("seen") == 1, "bullet").otherwise("meta")
    )
    text = F.when((label == "bullet") & F.col("bullet"), F.substr("s", F.lit(3))).when(
        (label == "body") & F.col("s").startswith("- "), F.substr("s", F.lit(3))).otherwise(F.col("s"))
    return d.select(doc, "section_no", order, "role", label.alias("label"), text.alias("text"))


def _mask(words: Sequence[str], of_line: Column) -> Column:
    """Bit set of the listed words among those of a line."""
    bits = F.create_map(*[x for i, w in enumerate(words) for x in (F.lit(w), F.lit(1 << i).cast("long"))])
    hit = F.filter(of_line, lambda w: w.isin(*words))
    return F.aggregate(hit, F.lit(0).cast("long"), lambda acc, w: acc.bitwiseOR(F.try_element_at(bits, w)))


def section_features(lines: DataFrame, keys: Sequence[str], line: str = "line") -> DataFrame:
    """Counts and densities of a section's lines; distinct keywords as bit sets, so all parts merge."""
    c = F.col(line)
    n = F.length(c)
    # Patterns are sought only where their fixed signs are.
    years = F.when(c.contains("19") | c.contains("20"), F.regexp_count(c, F.lit(L.YEAR_IN_TEXT))).when(c.isNotNull(), 0)
    at = F.when(c.contains("at"), F.size(F.filter(t.words(c), lambda w: w == "at"))).otherwise(0)
    signs = lambda x: n - F.length(F.replace(c, F.lit(x), F.lit("")))
    marks = F.regexp_count(c, F.lit("[|–—]")) + at
    known = F.filter(t.words(F.lower(c)), lambda w: w.isin(*L.EDUCATION_KEYWORDS, *L.TECH_KEYWORDS))
    d = lines.select(*keys, c.alias(line), known.alias("__words"))
    d = d.select(*keys, n.alias("n"), c.rlike(r"^\s*[-•·▪▸]\s").alias("b"), years.alias("y"), marks.alias("m"),
                 signs(",").alias("c"), signs(";").alias("sc"),
                 _mask(L.EDUCATION_KEYWORDS, F.col("__words")).alias("e"), _mask(L.TECH_KEYWORDS, F.col("__words")).alias("k"))
    g = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_lines"), F.sum("n").alias("char_count"), F.count_if("b").alias("bullet_count"), F.sum("y").alias("date_count"),
        F.sum("m").alias("role_marker_count"), F.bit_count(F.bit_or("e")).alias("education_kw_count"), F.bit_count(F.bit_or("k")).alias("tech_kw_count"),
        F.sum("c").alias("comma_count"), F.sum("sc").alias("semicolon_count"), F.count_if(F.col("n") < 60).alias("short_lines"), F.count_if(F.col("n") > 120).alias("long_lines"),
    )
    den = lambda a: F.col(a) / F.col("num_lines")
    return g.withColumns({
        "avg_line_length": den("char_count"), "bullet_density": den("bullet_count"), "date_density": den("date_count"),
        "role_marker_density": den("role_marker_count"), "education_kw_density": den("education_kw_count"), "tech_kw_density": den("tech_kw_count"),
        "comma_density": den("comma_count"), "short_line_ratio": den("short_lines"), "long_line_ratio": den("long_lines"),
    })


def coherence(features: DataFrame, kind: str = "section_type") -> DataFrame:
    """How well a section's features fit its type; 0.5 for unknown types and under two lines."""
    f = F.col
    one = lambda c: F.least(F.lit(1.0), c)
    date, bullet, mark, comma = f("date_density"), f("bullet_density"), f("role_marker_density"), f("comma_density")
    short, n = f("short_line_ratio"), f("num_lines")
    no_dates, no_marks = clamp(1 - date / 0.10), clamp(1 - mark / 0.10)
    forms = {
        "experience": (
            F.when(date >= 0.05, clamp(1 - F.greatest(F.lit(0.0), date - 0.40) / 0.60)).otherwise(date / 0.05) * 0.28
            + F.when(bullet >= 0.20, one(bullet / 0.30)).otherwise(bullet / 0.20) * 0.22 + one(mark / 0.15) * 0.20
            + clamp(1 - comma / 1.5) * 0.12 + clamp(1 - f("education_kw_density") * 5) * 0.08 + one(n / 6) * 0.10),
        "education": (
            one(f("education_kw_count") / 2.0) * 0.42 + F.when(date <= 0.35, one(date / 0.15)).otherwise(clamp(1.5 - date / 0.30)) * 0.20
            + clamp(1 - bullet / 0.30) * 0.15 + clamp(1 - comma / 1.5) * 0.13 + clamp(1 - mark * 4) * 0.10),
        "skills": one(comma / 2.0) * 0.30 + one(f("tech_kw_density") / 0.5) * 0.28 + short * 0.20 + no_dates * 0.12 + no_marks * 0.10,
        "languages": one(F.lit(8) / F.greatest(F.lit(1), n)) * 0.28 + short * 0.27 + no_dates * 0.20 + no_marks * 0.13 + clamp(1 - bullet / 0.20) * 0.12,
        "certifications": (
            one(F.lit(10) / F.greatest(F.lit(1), n)) * 0.25 + F.when(date <= 0.50, one(date / 0.25)).otherwise(0.5) * 0.20 + short * 0.20
            + no_marks * 0.20 + clamp(1 - comma / 2.0) * 0.15),
        "summary": (
            F.when(n <= 8, one(n / 3)).otherwise(0.7) * 0.20 + (1 - short) * 0.28 + clamp(1 - bullet / 0.30) * 0.22
            + clamp(1 - mark * 4) * 0.15 + clamp(1 - date / 0.30) * 0.15),
    }
    score = F.lit(0.5)
    for name, expr in forms.items():
        score = F.when(F.col(kind) == name, clamp(expr)).otherwise(score)
    return features.withColumn("coherence", F.round(F.when(n < 2, 0.5).otherwise(score), 9))


def coherence_scores(src: DataFrame, out: DataFrame, doc: str = "doc_id", kind: str = "section_type", line: str = "line") -> DataFrame:
    """Coherence of each output section type and whether it is stale source content.

    Both sides are line tables with (doc, section_type, line), headings left out.
    """
    feat = coherence(section_features(out, [doc, kind], line), kind)
    words = lambda df, side: df.select(doc, kind, F.lit(side).alias("side"), F.explode(t.letter_words(F.col(line), 6)).alias("w")).withColumn("w", F.lower("w"))
    of = lambda side: F.count_if(F.col("side") == side)
    n = words(out, 1).unionByName(words(src, 0)).groupBy(doc, kind, "w").agg(of(0).alias("a"), of(1).alias("b"))
    over = n.groupBy(doc, kind).agg(F.sum(F.least("a", "b")).alias("m"), F.sum("a").alias("t"))
    sl = src.groupBy(doc, kind).agg(F.count(F.lit(1)).alias("src_lines"))
    # Put side by side by one more grouping, so that lines which lie by the document are never moved.
    values = {"num_lines": "long", "coherence": "double", "m": "long", "t": "long", "src_lines": "long"}
    wide = lambda df: df.select(doc, kind, *[F.col(c) if c in df.columns else F.lit(None).cast(k).alias(c) for c, k in values.items()])
    j = wide(feat).unionByName(wide(over)).unionByName(wide(sl)).groupBy(doc, kind).agg(*[F.max(c).alias(c) for c in values]).filter("num_lines IS NOT NULL")
    met = F.col(doc).isNotNull() & F.col(kind).isNotNull()  # null meets nothing
    overlap = F.coalesce(F.when(met, F.col("m") / F.nullif("t", F.lit(0))), F.lit(0.0))
    stale = (overlap >= 0.70) & met & (F.coalesce("src_lines", F.lit(0)) >= 2) & (F.col("num_lines") >= 2) & ~F.col(kind).isin(*VERBATIM_TYPES)
    return j.select(doc, kind, "num_lines", "coherence", F.round(overlap, 9).alias("stale_overlap"), stale.alias("stale"))


def cap_bullets(src_roles: DataFrame, out_roles: DataFrame, doc: str = "doc_id", order: str = "idx", minimum: int = 4) -> DataFrame:
    """Output bullets kept per role: the source role's count plus one, at least ``minimum``.

    Roles beyond the source's use its rounded mean; a count of zero keeps all.
    ``src_roles`` has (doc, role, bullets), ``out_roles`` (doc, role, idx, text).
    """
    # Mean to the nearest integer, halves to even.
    mean = src_roles.groupBy(doc).agg(F.bround(F.sum("bullets") / F.count(F.lit(1)), 0).cast("long").alias("mean"))
    d = out_roles.join(src_roles.select(doc, "role", "bullets"), [doc, "role"], "left").join(mean, doc, "left")
    n = F.coalesce("bullets", "mean", F.lit(3))
    ranked = ordered_scan(d.withColumn("__n", n), [doc, "role"], [order], _blocks(order), [rank_in("nth")])
    return ranked.filter((F.col("__n") == 0) | (F.col("nth") <= F.greatest(F.col("__n") + 1, F.lit(minimum)))).select(doc, "role", order, "nth", "text")


def role_density(paras: DataFrame, sections: DataFrame) -> DataFrame:
    """Density score per document from role and section sizes.

    ``paras`` has (doc_id, section_id, role_id, place, text) with place in body /
    header / meta / bullet; ``sections`` has (doc_id, section_id, semantic_type).
    """
    exp = sections.filter("semantic_type = 'experience'").select("doc_id", "section_id")
    p = paras.join(exp, ["doc_id", "section_id"], "left_semi")
    roles = p.filter("place <> 'body'").groupBy("doc_id", "section_id", "role_id").agg(F.count_if(F.col("place") == "bullet").alias("b"))
    r = roles.groupBy("doc_id").agg(F.count(F.lit(1)).alias("roles"), F.count_if(F.col("b") == 0).alias("empty"), F.count_if(F.col("b") > 12).alias("dense"))
    s = F.length(t.strip(F.col("text")))
    body = p.filter("place = 'body'").groupBy("doc_id").agg(F.sum(F.when(s > 20, s).otherwise(0)).alias("body_chars"))
    total = paras.filter("place <> 'header'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("content"))
    n = sections.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sections"))
    j = n
    for d in (r, body, total):
        j = j.join(d, "doc_id", "left")
    j = j.fillna(0, ["roles", "empty", "dense", "body_chars", "content"])
    hard = (F.col("roles") >= 2) & (F.col("empty") == F.col("roles")) & (F.col("body_chars") < 100)
    share = F.when(F.col("empty") * 2 > F.col("roles"), 35).when(F.col("empty") * 4 > F.col("roles"), 15).otherwise(0)
    score = 100 - F.when(F.col("roles") > 0, share + F.least(F.lit(20), F.col("dense") * 7)).otherwise(0) - F.when(F.col("content") < F.col("sections") * 2, 20).otherwise(0)
    return j.select("doc_id", "roles", "empty", "dense", F.greatest(F.lit(0), score).alias("score"), hard.alias("hard"))


def enrich_paragraphs(paras: DataFrame, keys: Sequence[str] = ("doc_id", "section_id"), order: str = "ord") -> DataFrame:
    """Promoted paragraph labels with event and confidence.

    ``paras`` has the keys, ord, text, parser_semantic, hint, raw_title, in_meta
    and in_bullets.  Two rules depend on the promoted label of the previous
    paragraph; runs of such paragraphs are resolved by comparing the last row
    that starts a run with the last row that breaks it.
    """
    s = t.strip(F.col("text"))
    n = F.length(s)
    projects = F.lower("raw_title").contains("project")
    in_role = F.col("in_meta") | F.col("in_bullets")
    para = (F.col("parser_semantic") == "paragraph") & (s != "")
    word = s.rlike(r"(?i)\bproject\b")
    glyph, fake = s.rlike(GLYPH_START), s.rlike("^f [A-Z]")
    colon = F.locate(":", s)
    layer = (colon >= 2) & (colon <= 41) & F.lower(F.regexp_extract(s, r"^\s*([^\s:]+)", 1)).isin(*TECH_LAYER_WORDS)
    nxt = F.col("__next")
    d = cut(ordered_scan(paras, keys, [order], _blocks(order), [lead1("__next", "parser_semantic")]))
    c = lambda cond, conf, label, event, rank: F.when(cond, F.struct(
        (conf if isinstance(conf, Column) else F.lit(conf)).cast("double").alias("conf"), F.lit(-rank).alias("rank"), F.lit(label).alias("label"), F.lit(event).alias("event")))
    header = word & (n <= 60) & ~s.rlike("[.!?,;]$") & ~glyph & ~s.contains(":")
    special = s.rlike(DOMAIN_WORDS) & (n <= 80) & ~s.rlike("[.!?,;]$") & ~s.rlike("[0-9]") & ~glyph & ~s.contains(":")
    intro_shape = s.rlike("[.!?]$") & (n >= 25) & (F.regexp_count(s, F.lit(" ")) >= 3)
    fixed = F.greatest(
        c(para & (F.col("hint") == "tech_stack_candidate"), 0.95, "tech_stack", "ENRICH_TECH_STACK", 1),
        c(para & (F.col("hint") == "highlight_candidate"), 0.95, "highlight_header", "ENRICH_HIGHLIGHT_HEADER", 2),
        c(para & layer, 0.90, "tech_stack", "ENRICH_TECH_STACK_DETAIL", 3),
        c(para & projects & ~in_role & s.rlike(r"(?i)^a link\s"), 0.90, "project_entry", "ENRICH_PROJECT_ENTRY", 4),
        c(para & projects & ~in_role & s.rlike(YEAR_AT_END), 0.85, "project_entry", "ENRICH_PROJECT_ENTRY", 4),
        c(para & header, F.when(nxt == "bullet", 0.94).otherwise(0.85), "project_header", "ENRICH_PROJECT_HEADER", 5),
        c(para & (F.col("hint") == "intro_candidate"), 0.90, "role_intro", "ENRICH_ROLE_INTRO", 6),
        c(para & F.col("in_meta") & intro_shape, 0.82, "role_intro", "ENRICH_ROLE_INTRO", 6),
        c(para & in_role & word & (n > 60) & (n <= 250) & ~glyph & ~fake & ~F.left(s, F.lit(20)).contains(":"), 0.84, "project_intro", "ENRICH_INTERNAL_PROJECT", 7),
        c(para & special, F.when(nxt.isin("bullet", "paragraph"), 0.87).otherwise(0.80), "specialization_header", "ENRICH_SPECIALIZATION_HEADER", 9),
        c((F.col("parser_semantic") == "bullet") & (F.col("hint") == "tech_stack_candidate") & (s != ""), 0.95, "tech_stack", "ENRICH_TECH_STACK", 1),
        c((F.col("parser_semantic") == "role_meta") & projects & (s != ""), 0.90, "project_entry", "ENRICH_PROJECT_ENTRY", 4),
    )
    open_ = para & (F.col("__fix").isNull() | (F.col("__fix.conf") < 0.82))
    cont = in_role & ~glyph & ~fake & (n >= 10) & ~s.rlike(r"^\p{Lu}")
    d = d.withColumn("__fix", fixed).withColumn("__base", F.coalesce("__fix.label", "parser_semantic"))
    d = d.withColumns({"__sable": open_ & intro_shape, "__pable": open_ & cont, "__isS": F.col("__base").isin(*STRUCTURAL), "__isP": F.col("__base") == "project_intro"})
    at = lambda cond: F.when(cond, F.col(order))
    d = ordered_scan(d, keys, [order], _blocks(order), [
        last_seen_before("__s1", at(F.col("__isS"))), last_seen_before("__s0", at(~F.col("__isS") & ~F.col("__sable"))),
        last_seen_before("__p1", at(F.col("__isP"))), last_seen_before("__p0", at(~F.col("__isP") & ~F.col("__pable"))),
    ])
    on = lambda a, b: F.col(a).isNotNull() & (F.col(b).isNull() | (F.col(a) > F.col(b)))
    intro = F.col("__sable") & on("__s1", "__s0")
    more = F.col("__pable") & ~intro & on("__p1", "__p0")
    label = F.when(intro, "role_intro").when(more, "project_intro").otherwise(F.col("__base"))
    event = F.when(intro, "ENRICH_ROLE_INTRO").when(more, "ENRICH_PROJECT_INTRO_CONTINUATION").otherwise(F.coalesce("__fix.event", F.lit("")))
    conf = F.when(intro | more, 0.82).otherwise(F.coalesce("__fix.conf", F.lit(0.0)))
    return d.select(*keys, order, "parser_semantic", label.alias("enriched"), event.alias("event"), conf.alias("confidence"))


def with_hints(paras: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Paragraphs with the ``hint`` column the enrichment reads."""
    return paragraph_hints(paras, doc).drop("bullet_confidence")


def target_section(heading: Column) -> Column:
    """summary / experience / skills from heading words; null for other or stopping headings."""
    low = F.lower(heading)
    out = F.lit(None).cast("string")
    for w, kind in reversed(SECTION_WORDS):
        out = F.when(low.contains(w), kind).otherwise(out)
    return F.when(t.any_of(low, STOP_WORDS_SECTION), None).otherwise(out)


def injection_score(target: DataFrame, rendered: DataFrame, template: DataFrame, doc: str = "doc_id", line: str = "line") -> DataFrame:
    """How much of the target vocabulary reached the rendered document, with per-section floors.

    The three line tables have (doc, section, line), section being summary,
    experience, skills or null.  Vocabularies are (doc, section, word) rows with
    the sides they occur on; no document is held as one text.
    """
    # One bit a side: target, rendered, template.  A word of a document has one number with the three bits of each of its
    # sections: first those without a name, then those with a floor.  A section of another name has none, so its words count
    # for the document as if without a name, and once more by themselves.  The document has a name of its own in all sides, as
    # Spark knows that a union's sides lie alike only where their columns come from no view.
    target_bit, rendered_bit, template_bit = 1, 2, 4
    named = list(INJECTION_FLOORS)
    place = F.lit(0)
    for k, name in enumerate(named, 1):
        place = F.when(F.col("section") == name, 3 * k).otherwise(place)
    other = F.col("section").isNotNull() & ~F.col("section").isin(*named)
    once = F.array(F.struct(F.lit(None).cast("string").alias("other"), F.coalesce(place, F.lit(0)).alias("place")))
    copies = F.when(other, F.concat(once, F.array(F.struct(F.col("section").alias("other"), F.lit(0).alias("place"))))).otherwise(once)

    def words(df: DataFrame, bit: int) -> DataFrame:
        d = df.select(F.col(doc).alias("__doc"), line, F.explode(copies).alias("x"))
        d = d.select("__doc", "x.other", F.lit(bit).alias("bit"), "x.place", F.explode(content_words(F.col(line))).alias("w"))
        return d.filter(~F.col("w").isin(*OVERLAP_STOP_WORDS)).select("__doc", "other", "w", F.expr("shiftleft(bit, place)").alias("bits"))

    sides = (
        words(rendered, rendered_bit).unionByName(words(target.filter("section IS NOT NULL"), target_bit))
        .unionByName(words(template.filter("section IS NOT NULL"), template_bit))
    )
    by_word = sides.groupBy("__doc", "other", "w").agg(F.bit_or("bits").alias("bits"))
    in_place = lambda k: F.shiftright("bits", 3 * k)
    anywhere = reduce(lambda a, b: a.bitwiseOR(b), [in_place(k) for k in range(len(named) + 1)])
    by_word = by_word.withColumn("any", anywhere)
    on = lambda c, *bits: c.bitwiseAND(F.lit(sum(bits))) == sum(bits)

    def counts(k: int) -> list[Column]:
        x = in_place(k)
        return [c.alias(f"{n}{k}") for n, c in {
            "n": F.count_if(on(x, target_bit)), "r": F.count_if(on(x, target_bit, rendered_bit)),
            "f": F.count_if(on(x, target_bit) & on(F.col("any"), rendered_bit)), "i": F.count_if(on(x, rendered_bit, template_bit)),
            "u": F.count_if(on(x, rendered_bit) | on(x, template_bit)), "na": F.count_if(on(x, rendered_bit)), "nb": F.count_if(on(x, template_bit)),
        }.items()]

    def failed(k: int, floor: float, bare: float) -> Column:
        c = lambda n: F.col(f"{n}{k}")
        has, r, f = c("na") > 0, c("r") / F.greatest(c("n"), F.lit(1)), c("f") / F.greatest(c("n"), F.lit(1))
        low = F.when(has, r < floor).otherwise(f < bare)
        unchanged = has & (c("nb") > 0) & (c("i") / F.greatest(c("u"), F.lit(1)) >= 0.95) & (r < 0.80)
        return F.when((c("n") > 0) & (low | unchanged), 1).otherwise(0)

    j = by_word.groupBy("__doc", "other").agg(
        F.count_if(on(F.col("any"), target_bit)).alias("words"), F.count_if(on(F.col("any"), target_bit, rendered_bit)).alias("found"),
        *[c for k in range(len(named) + 1) for c in counts(k)],
    )
    of_named = reduce(lambda a, b: a + b, [failed(k, v, 0.95 if name == "summary" else v) for k, (name, v) in enumerate(INJECTION_FLOORS.items(), 1)])
    of_doc = F.col("other").isNull()
    found = j.groupBy("__doc").agg(
        F.nullif(F.max(F.when(of_doc, F.col("words"))), F.lit(0)).alias("words"), F.max(F.when(of_doc, F.col("found"))).alias("found"),
        F.sum(F.when(of_doc, of_named).otherwise(failed(0, 0.0, 0.0))).alias("failed_sections"),
    )
    text = rendered.select(F.col(doc).alias("__doc"), line).groupBy("__doc").agg(F.max(t.any_of(F.lower(line), L.PLACEHOLDERS)).alias("placeholder"), F.max(F.lower(line).contains("lorem ipsum")).alias("lorem"))
    # Put side by side by one more grouping, so that lines which lie by the document are never moved; null meets nothing.
    values = {"placeholder": "boolean", "lorem": "boolean", "words": "long", "found": "long", "failed_sections": "long"}
    wide = lambda df: df.select("__doc", F.lit("lorem" in df.columns).alias("here"), *[F.col(c) if c in df.columns else F.lit(None).cast(k).alias(c) for c, k in values.items()])
    d = wide(text).unionByName(wide(found)).groupBy("__doc").agg(F.max("here").alias("here"), *[F.max(c).alias(c) for c in values]).filter("here")
    d = d.withColumnRenamed("__doc", doc).withColumns({c: F.when(F.col(doc).isNotNull(), F.col(c)) for c in ("words", "found", "failed_sections")})
    sim = F.coalesce(F.col("found") / F.col("words"), F.lit(0.0))
    cut_ = F.when(F.col("words").isNull() | (sim >= 0.80), 0).when(sim >= 0.50, 15).when(sim >= 0.25, 30).otherwise(50)
    hard = F.col("lorem") | (F.coalesce("failed_sections", F.lit(0)) > 0) | (F.col("words").isNotNull() & (sim < 0.10))
    return d.select(
        doc, F.round(sim, 9).alias("recall"), F.coalesce("failed_sections", F.lit(0)).alias("failed_sections"),
        F.when(F.col("lorem"), 0).otherwise(F.greatest(F.lit(0), 100 - F.when(F.col("placeholder"), 25).otherwise(0) - cut_)).alias("score"), hard.alias("hard"),
    )


def split_sections_udtf():
    """Table function for SQL: the stateless section split of one text, line by line.

    ``spark.udtf.register("split_sections", split_sections_udtf())`` makes
    ``SELECT * FROM docs, LATERAL split_sections(text)`` available.
    """
    from pyspark.sql.functions import udtf

    names = {n: k for k, v in L.NAMES_BY_TYPE.items() for n in v}

    @udtf(returnType="line_no int, section_no int, section_type string, line string")
    class SplitSections:
        def eval(self, text: str):
            no, kind = 0, ""
            for i, line in enumerate((text or "").split("\n")):
                low = line.strip().lower()
                if low in names:
                    no, kind = no + 1, names[low]
                yield i, no, kind, line

    return SplitSections
