"""Comparing two documents, two name lists or two sets of lines."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import lexicons as L
from quire.functions import text as t
from quire.plans import cut, hot_keys, lag1, last_seen, ordered_scan, rank_in, running_min, running_sum
from quire.plans.matching import GROUP_ROWS, best_pairs, by_group, cell_edges, greedy_match, parted, rank_pairs, ratio_bounds

# Fixed values.
OVERLAP_STOP_WORDS = (
    "have", "from", "with", "that", "this", "will", "been", "were", "they", "them", "their", "your", "when", "what",
    "where", "which", "also", "more", "both", "into", "over", "each", "than", "then", "such", "well", "able", "work",
    "lead", "team", "role", "year", "company", "position", "resume", "section", "summary",
)
GENERATED_TYPES = ("skills", "experience", "education", "certifications")
SKILL_TITLE_WORDS = (
    "skill", "proficien", "abilit", "competenc", "expertise", "technolog", "tools", "stack", "technical",
)
DIFF_HEADERS = (
    "experience", "professional experience", "education", "technical skills", "skills", "skill", "certifications",
    "projects", "publications", "volunteer", "awards", "references", "professional summary", "summary",
    "additional information",
)
DIFF_SECTIONS = {
    "Professional Summary": ("professional summary", "summary"),
    "Technical Skills": ("technical skills", "skills", "skill"),
}
COMPANY_STOP_WORDS = (
    "inc", "co", "llc", "ltd", "corp", "international", "group", "the", "and", "of", "for", "a", "an",
)
SIMILARITY = 0.45


def token_counts(df: DataFrame, keys: Sequence[str], sides: dict[str, str], pattern: str | None = None,
                 lower: bool = True) -> DataFrame:
    """(keys.., token, one count per side): all sides of a row counted in one grouping."""
    def toks(col: str) -> Column:
        w = t.words(F.col(col))
        return w if pattern is None else F.filter(w, lambda x: x.rlike(pattern))

    def tag(name: str):
        return lambda x: F.struct(F.lit(name).alias("side"), (F.lower(x) if lower else x).alias("token"))

    tagged = F.concat(*[F.transform(toks(c), tag(name)) for name, c in sides.items()])
    rows = df.select(*keys, F.explode(tagged).alias("e")).select(*keys, "e.*")
    return rows.groupBy(*keys, "token").agg(*[F.count_if(F.col("side") == n).alias(n) for n in sides])


def token_f1(pairs: DataFrame, key: str = "pair_id", src: str = "src_text", out: str = "out_text") -> DataFrame:
    """Multiset precision, recall and F1 of word tokens."""
    n = token_counts(pairs, [key], {"s": src, "o": out})
    g = n.groupBy(key).agg(
        F.sum(F.least("s", "o")).alias("common"), F.sum("s").alias("n_src"), F.sum("o").alias("n_out")
    )
    p = F.coalesce(F.col("common") / F.nullif("n_out", F.lit(0)), F.lit(0.0))
    r = F.coalesce(F.col("common") / F.nullif("n_src", F.lit(0)), F.lit(0.0))
    return pairs.select(key).join(g, key, "left").select(
        key, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("common", "n_src", "n_out")],
        F.coalesce(p, F.lit(0.0)).alias("precision"), F.coalesce(r, F.lit(0.0)).alias("recall"),
        F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)).alias("f1"),
    )


def token_overlap(docs: DataFrame, key: str, src: str, gen: str, out: str, min_len: int = 6) -> DataFrame:
    """Stale tokens (in the source beyond the generated text) and how many survive in the output."""
    n = token_counts(docs, [key], {"s": src, "g": gen, "o": out}, rf"^[a-zA-Z]{{{min_len},}}$")
    stale = F.greatest(F.col("s") - F.col("g"), F.lit(0))
    g = n.groupBy(key).agg(
        F.sum(stale).alias("stale_total"), F.sum(F.least(stale, F.col("o"))).alias("surviving"),
        F.sum(F.least("s", "o")).alias("matching"), F.sum("s").alias("src_total"),
    )
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return docs.select(key).join(g, key, "left").select(
        key, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("stale_total", "surviving", "matching", "src_total")],
        F.coalesce(share("surviving", "stale_total"), F.lit(0.0)).alias("stale_ratio"),
        F.coalesce(share("matching", "src_total"), F.lit(0.0)).alias("overlap"),
    )


def survivors(docs: DataFrame, key: str, src: str, gen: str, out: str) -> DataFrame:
    """Surviving stale tokens over the whole corpus with their counts."""
    n = token_counts(docs, [key], {"s": src, "g": gen, "o": out}, r"^[a-zA-Z]{6,}$")
    live = F.least(F.greatest(F.col("s") - F.col("g"), F.lit(0)), F.col("o"))
    return n.withColumn("live", live).filter("live > 0").groupBy("token").agg(F.sum("live").alias("survived"), F.count(F.lit(1)).alias("docs"))


def content_words(c: Column) -> Column:
    """Words of at least four ASCII letters, stop words among them; digits glued to letters are parted."""
    return t.letter_words(F.lower(F.regexp_replace(c, "([0-9])([A-Za-z])", "$1 $2")), 4, "a-z")


def content_tokens(c: Column) -> Column:
    """Distinct words of at least four ASCII letters without stop words; digits glued to letters are parted."""
    return F.array_distinct(F.filter(content_words(c), lambda x: ~x.isin(*OVERLAP_STOP_WORDS)))


def jaccard(a: Column, b: Column) -> Column:
    inter, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.coalesce(inter / F.nullif(union, F.lit(0)), F.lit(0.0))


def recall(rendered: Column, reference: Column) -> Column:
    inter = F.size(F.array_intersect(rendered, reference))
    return F.coalesce(inter / F.nullif(F.size(reference), F.lit(0)), F.lit(0.0))


def set_similarity(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Jaccard and recall (of ``b`` in ``a``) over distinct content tokens, inside the row."""
    d = pairs.withColumns({"__a": content_tokens(F.col(a)), "__b": content_tokens(F.col(b))})
    return d.select(
        key, F.size("__a").alias("n_a"), F.size("__b").alias("n_b"),
        jaccard(F.col("__a"), F.col("__b")).alias("jaccard"), recall(F.col("__a"), F.col("__b")).alias("recall"),
    )


def heading_diff(src: DataFrame, out: DataFrame, doc: str, heading: str, order: str) -> DataFrame:
    """Known section headings missing from, or extra in, the output."""
    def known(df):
        return df.withColumn("__k", t.heading_key(F.col(heading))).filter(F.col("__k").isin(*L.KNOWN_SECTION_KEYS))

    a, b = known(src), known(out)
    missing = a.join(b.select(doc, "__k").distinct(), [doc, "__k"], "left_anti").withColumn("kind", F.lit("missing"))
    extra = b.join(a.select(doc, "__k").distinct(), [doc, "__k"], "left_anti").withColumn("kind", F.lit("extra"))
    return missing.unionByName(extra).select(doc, order, heading, "kind")


def name_match(left: DataFrame, right: DataFrame, lid: str, name: str, ord_: str, rname: str) -> DataFrame:
    """For each left name the first right name (by ``ord_``) naming the same thing.

    Token lists match when equal or when the shorter one is contained in the
    longer.  Equal token lists are handled once; candidates meet on the rarest
    token of the shorter side, so frequent words join nothing.
    """
    toks = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0)
    lnames = left.select(lid, toks(F.col(name)).alias("lt")).filter(F.size("lt") > 0)
    ls = lnames.select("lt").distinct()
    rs = right.select(ord_, F.col(rname), toks(F.col(rname)).alias("rt")).filter(F.size("rt") > 0)
    rs = rs.groupBy("rt").agg(F.min(F.struct(ord_, rname)).alias("r"))
    freq = (
        ls.select(F.explode(F.array_distinct("lt")).alias("tok")).unionByName(rs.select(F.explode(F.array_distinct("rt")).alias("tok")))
        .groupBy("tok").agg(F.count(F.lit(1)).alias("n"))
    )

    def by_token(df, arr):
        return df.withColumn("tok", F.explode(F.array_distinct(arr)))

    def rarest(df, arr):
        return by_token(df, arr).join(freq, "tok").groupBy(arr).agg(F.min_by("tok", F.struct("n", "tok")).alias("tok"))

    right_all = by_token(rs.select("rt"), "rt")
    left_all = by_token(ls, "lt")
    cand = (
        rarest(ls, "lt").join(right_all, "tok").filter(F.size("lt") <= F.size("rt")).select("lt", "rt")
        .unionByName(rarest(rs.select("rt"), "rt").join(left_all, "tok").filter(F.size("rt") < F.size("lt")).select("lt", "rt"))
    )
    short, long_ = F.when(F.size("lt") <= F.size("rt"), F.col("lt")).otherwise(F.col("rt")), F.when(F.size("lt") <= F.size("rt"), F.col("rt")).otherwise(F.col("lt"))
    hit = cand.filter(F.size(F.array_except(short, long_)) == 0).join(rs, "rt").groupBy("lt").agg(F.min("r").alias("r"))
    return lnames.join(hit, "lt").select(lid, F.col(f"r.{ord_}").alias("match_ord"), F.col(f"r.{rname}").alias("match_name"))


def coverage_gaps(names: DataFrame, indexes: dict[str, DataFrame], lid: str, name: str, ord_: str, rname: str) -> DataFrame:
    """One message per name and index without a match."""
    out = None
    for label, index in indexes.items():
        miss = names.join(name_match(names, index, lid, name, ord_, rname).select(lid), lid, "left_anti").select(
            lid, F.concat(F.lit(f"Missing {label} for company: '"), F.col(name), F.lit("'")).alias("message")
        )
        out = miss if out is None else out.unionByName(miss)
    return out


def align_sections(src: DataFrame, out: DataFrame, doc: str = "doc_id", idx: str = "idx") -> DataFrame:
    """One-to-one section pairs (doc, src_idx, out_idx, pass).

    Pass 1 equal heading, pass 2 equal type, pass 3 skills against skill-like
    titles.  In pass 1 an ``other`` section may not take a slot of a generated
    type.
    """
    a = cut(src.select(doc, F.col(idx).alias("si"), F.lower("heading").alias("h"), F.col("section_type").alias("st")))
    b = cut(out.select(doc, F.col(idx).alias("oi"), F.lower("heading").alias("h"), F.col("section_type").alias("ot")))
    gen = F.col("st").isin(*GENERATED_TYPES)
    mix_s = a.groupBy(doc, "h").agg(F.max(gen).alias("g"), F.max(~gen).alias("ng"))
    mix_o = b.groupBy(doc, "h").agg(F.max(F.col("ot") == "other").alias("ot_other"), F.max(F.col("ot") != "other").alias("ot_rest"))
    mixed = mix_s.join(mix_o, [doc, "h"]).filter("g AND ng AND ot_other AND ot_rest").select(doc, "h")
    a1, b1 = a.join(mixed, [doc, "h"], "left_anti"), b.join(mixed, [doc, "h"], "left_anti")
    kind = mix_s.join(mix_o, [doc, "h"]).select(doc, "h", "g", "ng", "ot_other", "ot_rest")
    # Outside the mixed headings the guard removes one whole class of a side.
    a1 = a1.join(kind, [doc, "h"]).filter(~(F.col("st").isin(*GENERATED_TYPES) & F.col("ot_other") & ~F.col("ot_rest")))
    b1 = b1.join(kind, [doc, "h"]).filter(~((F.col("ot") == "other") & F.col("g") & ~F.col("ng")))
    p1 = rank_pairs(a1, b1, [doc, "h"], "si", "oi").select(doc, "si", "oi")
    guarded = _guarded_pairs(a.join(mixed, [doc, "h"]), b.join(mixed, [doc, "h"]), [doc, "h"])
    p1 = cut(p1.unionByName(guarded.select(doc, "si", "oi")).withColumn("pass", F.lit(1)))
    a2, b2 = _rest(a, p1, doc, "si"), _rest(b, p1, doc, "oi")
    p2 = rank_pairs(
        a2.filter("st <> 'other'").withColumn("k", F.col("st")), b2.filter("ot <> 'other'").withColumn("k", F.col("ot")),
        [doc, "k"], "si", "oi",
    ).select(doc, "si", "oi", F.lit(2).alias("pass"))
    p2 = cut(p2)
    a3 = _rest(a2, p2, doc, "si").filter(t.any_of(F.col("h"), SKILL_TITLE_WORDS))
    b3 = _rest(b2, p2, doc, "oi").filter("ot = 'skills'")
    p3 = rank_pairs(a3, b3, [doc], "si", "oi").select(doc, "si", "oi", F.lit(3).alias("pass"))
    return p1.unionByName(p2).unionByName(p3)


def _guarded_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First-come pairs of one heading when ``other`` outputs may not take generated sources.

    In walking order every output takes the first source it may.  So the g-th
    generated source, at merged position m(g), goes to the first output not of
    type other that stands at step m(g) or later and is still free.  Counted in
    those outputs this is slot g + max over j <= g of (slots before m(j)) - j,
    a running maximum; the other outputs share the remaining sources in order.
    """
    gen, rest = F.col("st").isin(*GENERATED_TYPES), F.col("ot") != "other"
    src = cut(ordered_scan(a, keys, ["si"], [F.floor(F.col("si") / 1024)], [rank_in("m"), running_sum("g", gen.cast("long"))]))
    out = cut(ordered_scan(b, keys, ["oi"], [F.floor(F.col("oi") / 1024)], [rank_in("k"), running_sum("r", rest.cast("long"))]))
    before = out.select(*keys, F.col("k").alias("m"), (F.col("r") - rest.cast("long")).alias("f"))
    g = src.filter(gen).join(before, [*keys, "m"], "left").withColumn("lead", F.col("g") - 1 - F.coalesce("f", F.lit(1 << 40)))
    g = ordered_scan(g, keys, ["si"], [F.floor(F.col("si") / 1024)], [running_min("least", "lead")])
    slots = g.select(*keys, "si", (F.col("g") - F.col("least")).alias("r"))
    first = cut(slots.join(out.filter(rest).select(*keys, "oi", "r"), [*keys, "r"]).select(*keys, "si", "oi"))
    left = out.join(first.select(*keys, "oi"), [*keys, "oi"], "left_anti")
    return first.unionByName(rank_pairs(src.filter(~gen), left, keys, "si", "oi").select(*keys, "si", "oi"))


def _rest(df: DataFrame, pairs: DataFrame, doc: str, i: str) -> DataFrame:
    return df.join(pairs.select(doc, i), [doc, i], "left_anti")


def company_tokens(c: Column) -> Column:
    """Distinct significant tokens of the company part of a role header.

    Bracketed date spans go; the part is the one before the first dated part
    when that is the third or later, else the first.
    """
    c = F.regexp_replace(c, r"\([^)]*(?:19|20)[0-9]{2}[^)]*\)", "")
    parts = F.split(c, r"\s[–—-]\s|\|")
    dated = t.first_at(F.transform(parts, lambda p: t.has_year(p) | p.rlike("(?:19|20)[Xx]{2}")))
    part = F.lower(F.when(dated >= 3, F.get(parts, dated - 2)).otherwise(F.get(parts, F.lit(0))))
    part = F.regexp_replace(F.regexp_replace(part, r"[^\p{L}\p{N}_\s]", " "), "([0-9])([a-z])", "$1 $2")
    words = F.split(t.strip(part), r"\s+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*COMPANY_STOP_WORDS)))


def align_roles(src: DataFrame, out: DataFrame, doc: str = "doc_id", idx: str = "idx") -> DataFrame:
    """One-to-one role pairs (doc, si, oi, strategy).

    Exact header, then best company-token overlap above 0.3, then a unique year
    signature, then position.  Sources choose in their order; both role tables
    have (doc, idx, header, dates).
    """
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))

    def prep(df, i):
        y = t.years(F.concat_ws(" ", "header", "dates"))
        return cut(df.select(
            doc, F.col(idx).alias(i), norm(F.col("header")).alias("h"), company_tokens(F.col("header")).alias("tk"),
            F.array_min(y).alias("y0"), F.array_max(y).alias("y1"),
            F.concat_ws(" ", "header", "dates").rlike(r"(?i)\b(now|present|current|ongoing)\b").alias("open"),
        ))

    a, b = prep(src, "si"), prep(out, "oi")
    p0 = cut(rank_pairs(a.filter("h <> ''"), b.filter("h <> ''"), [doc, "h"], "si", "oi").select(doc, "si", "oi", F.lit("exact_header").alias("strategy")))
    a1, b1 = cut(_rest(a, p0, doc, "si")), cut(_rest(b, p0, doc, "oi"))
    shared = (
        a1.select(doc, "si", F.size("tk").alias("na"), F.explode("tk").alias("tok"))
        .join(b1.select(doc, "oi", F.size("tk").alias("nb"), F.explode("tk").alias("tok")), [doc, "tok"])
        .groupBy(doc, "si", "oi", "na", "nb").agg(F.count(F.lit(1)).alias("c"))
    )
    j = F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))
    scored = shared.withColumn("score", F.when(F.col("c") == F.col("nb"), F.greatest(j, F.lit(0.5))).otherwise(j)).filter("score > 0.3")
    p1 = cut(greedy_match(scored.select(doc, "si", "oi", "score"), [doc], "si", "oi", [F.col("si"), -F.col("score"), F.col("oi")])
             .select(doc, "si", "oi", F.lit("company_similarity").alias("strategy")))
    a2, b2 = cut(_rest(a1, p1, doc, "si")), cut(_rest(b1, p1, doc, "oi"))
    p2 = cut(_by_dates(a2, b2, doc))
    a3, b3 = _rest(a2, p2, doc, "si"), _rest(b2, p2, doc, "oi")
    p3 = rank_pairs(a3, b3, [doc], "si", "oi").select(doc, "si", "oi", F.lit("position").alias("strategy"))
    return p0.unionByName(p1).unionByName(p2).unionByName(p3)


def _by_dates(a: DataFrame, b: DataFrame, doc: str) -> DataFrame:
    """Sources with exactly one free output of the same start year and compatible end.

    Sources sharing a start year decide one after the other; all others at once.
    """
    left = a.filter("y0 IS NOT NULL").select(doc, "si", "y0", "y1", "open")
    right = b.filter("y0 IS NOT NULL").select(doc, "oi", "y0", F.col("y1").alias("r1"), F.col("open").alias("ropen"))
    edges = cut(left.join(right, [doc, "y0"]).filter("open = ropen OR y1 = r1").select(doc, "y0", "si", "oi"))
    taken = edges.limit(0).select(doc, "si", "oi")
    while not edges.isEmpty():
        turn = edges.groupBy(doc, "y0").agg(F.min("si").alias("si"))
        now = edges.join(turn, [doc, "y0", "si"])
        one = cut(now.groupBy(doc, "y0", "si").agg(F.count(F.lit(1)).alias("n"), F.min("oi").alias("oi")).filter("n = 1").select(doc, "si", "oi"))
        taken = taken.unionByName(one)
        edges = cut(edges.join(turn, [doc, "y0", "si"], "left_anti").join(one.select(doc, "oi"), [doc, "oi"], "left_anti"))
    return taken.withColumn("strategy", F.lit("date_range"))


def _ratio():
    def against(right: str):
        from difflib import SequenceMatcher

        m = SequenceMatcher(None, "", right)

        def ratio(left: str) -> float:
            m.set_seq1(left)
            return m.ratio() if m.real_quick_ratio() >= 0.45 and m.quick_ratio() >= 0.45 else 0.0

        return ratio

    return against


JUNK_FROM = 200  # signs from which on the matcher passes over frequent ones


def _held(a: str, b: str) -> float | None:
    """The ratio, where one text holds the other: all of the shorter one is the longest common run."""
    if len(b) < JUNK_FROM and (a in b or b in a):
        return 2.0 * min(len(a), len(b)) / (len(a) + len(b)) if a or b else 1.0
    return None


def _reaches(a: str, b: str, least: float) -> bool:
    """Whether a common run alone brings the ratio to ``least``."""
    both = len(a) + len(b)
    n = max(1, int(least * both / 2))
    while 2.0 * n / both < least:
        n += 1
    return len(b) < JUNK_FROM and any(a[k:k + n] in b for k in range(len(a) - n + 1))


def diff_bullets(src: DataFrame, out: DataFrame, group: Sequence[str], idx: str = "idx", text: str = "text") -> DataFrame:
    """(group.., kind, before, after): bullets changed, added and removed.

    Equal bullets (any case) cancel out pairwise; the rest is paired best
    similarity first from 0.45 up; what is left was added or removed.  Groups of
    up to ``GROUP_ROWS`` bullets are compared where they lie, after one shuffle.
    """
    tag = lambda df, side: df.select(*group, F.lit(side).alias("__side"), F.col(idx).cast("long").alias("__i"), F.col(text).alias("__t"))
    rows = tag(src, 0).unionByName(tag(out, 1))
    small, large = parted(rows, group, hot_keys(rows, group, GROUP_ROWS))
    found = _diff_small(small.repartition(*group), group)
    if large is None:
        return found
    large = cut(large)
    side = lambda n: large.filter(F.col("__side") == n).select(*group, F.col("__i").alias(idx), F.col("__t").alias(text))
    return found.unionByName(_diff_large(side(0), side(1), group, idx, text))


def _diff_small(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """The diff of groups known to be small; ``rows`` has the group, __side, __i and __t and lies by the group."""
    d = rows.withColumn("__k", F.lower(t.strip(F.col("__t"))))
    # Of equal bullets the n-th of one side cancels out the n-th of the other; null equals nothing.
    equal = Window.partitionBy(*group, "__k")
    nth = F.row_number().over(Window.partitionBy(*group, "__k", "__side").orderBy("__i"))
    known = F.col("__k").isNotNull() & reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in group])
    d = d.withColumn("__n", nth).withColumn("__both", F.least(F.count_if(F.col("__side") == 0).over(equal), F.count_if(F.col("__side") == 1).over(equal)))
    d = d.filter(~known | (F.col("__n") > F.col("__both"))).select(*group, "__side", "__i", "__t", F.when(known, F.lower("__t")).alias("__low"))
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*[f"{c} {fields[c]}" for c in group], "kind string", "before string", "after string"])
    return by_group(d, group, ["__side", "__i"], _diff_of_group(), schema)


def _diff_of_group():
    def diff(key: tuple, rows: list[tuple]) -> list[tuple]:
        a, b = ([(i, text, low) for s, i, text, low in rows if s == side] for side in (0, 1))
        pairable = lambda side: [(i, low, k) for k, (i, _, low) in enumerate(side) if low is not None]
        pa, pb = pairable(a), pairable(b)
        near = {pa[i][2]: pb[j][2] for i, j in best_pairs(pa, pb, score, SIMILARITY, _held, _reaches)}
        gone = set(near.values())
        out = [(*key, "changed", a[i][1], b[j][1]) for i, j in near.items()]
        out += [(*key, "removed", text, "") for k, (_, text, _) in enumerate(a) if k not in near]
        return out + [(*key, "added", "", text) for k, (_, text, _) in enumerate(b) if k not in gone]

    score = _ratio()
    return diff


def _diff_large(src: DataFrame, out: DataFrame, group: Sequence[str], idx: str, text: str) -> DataFrame:
    """The diff of groups of any size, in cells and rounds."""
    low = lambda df, i: cut(df.select(*group, F.col(idx).alias(i), F.col(text), F.lower(t.strip(F.col(text))).alias("k")))
    a, b = low(src, "si"), low(out, "oi")
    same = cut(rank_pairs(a, b, [*group, "k"], "si", "oi").select(*group, "si", "oi"))
    a1 = cut(a.join(same.select(*group, "si"), [*group, "si"], "left_anti"))
    b1 = cut(b.join(same.select(*group, "oi"), [*group, "oi"], "left_anti"))
    edges = cell_edges(
        a1.withColumn("low", F.lower(text)), b1.withColumn("low", F.lower(text)), group, "si", "oi", "low", _ratio(),
        SIMILARITY, length_ratio=SIMILARITY / (2 - SIMILARITY),
    )
    near = cut(greedy_match(edges, group, "si", "oi", [-F.col("score"), -F.col("si"), -F.col("oi")]))
    changed = (
        near.join(a1.select(*group, "si", F.col(text).alias("before")), [*group, "si"])
        .join(b1.select(*group, "oi", F.col(text).alias("after")), [*group, "oi"])
        .select(*group, F.lit("changed").alias("kind"), "before", "after")
    )
    removed = a1.join(near.select(*group, "si"), [*group, "si"], "left_anti").select(
        *group, F.lit("removed").alias("kind"), F.col(text).alias("before"), F.lit("").alias("after"))
    added = b1.join(near.select(*group, "oi"), [*group, "oi"], "left_anti").select(
        *group, F.lit("added").alias("kind"), F.lit("").alias("before"), F.col(text).alias("after"))
    return changed.unionByName(removed).unionByName(added)


def seq_ratio_udf():
    """Arrow UDF: Ratcliff-Obershelp similarity of two lower-cased texts."""
    @F.pandas_udf("double")
    def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, x.lower(), y.lower()).ratio() for x, y in zip(a, b)], dtype="float64")

    return seq_ratio


def sequence_similarity(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    return pairs.select(key, seq_ratio_udf()(F.col(a), F.col(b)).alias("ratio"))


def levenshtein_similarity(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """1 - edit distance / longer length: a built-in measure, not the same as the ratio above."""
    n = F.greatest(F.length(a), F.length(b))
    return pairs.select(key, (1 - F.levenshtein(F.lower(a), F.lower(b)) / F.greatest(n, F.lit(1))).alias("similarity"))


def near_duplicate_lines(
    lines: DataFrame, doc: str, order: str, line: str, y: str, min_len: int = 60, prefix: int = 28,
    zone: float = 0.70, dy: float = 0.22, allow_equal: bool = False, skip_verbs: bool = True, hard_len: int = 70,
    block: int = 1024,
) -> DataFrame:
    """Per document and opening: prose lines that nearly repeat an earlier close line.

    Among lines with one opening it is enough to look back to the latest line
    with another text, so each opening is scanned once instead of paired.
    """
    # Exploded, so that a text which the lines still have to make is made once and not for each of the conditions.
    d = lines.filter(F.col(y) <= zone).select(doc, F.col(order).alias("__i"), F.col(y).alias("__y"), F.explode(F.array(t.strip(F.col(line)))).alias("__s"))
    s = F.col("__s")
    first = F.regexp_replace(F.lower(F.split(s, r"\s+")[0]), "[.,;:]+$", "")
    keep = (F.length(s) >= min_len) & (F.size(F.split(s, r"\s+")) >= 4) & ~s.rlike(r"^[A-Z\s:./()|-]{5,}$")
    if skip_verbs:
        keep = keep & ~first.isin(*L.ACTION_VERBS)
    d = d.filter(keep).select(doc, "__i", F.lower(s).alias("__t"), "__y")
    d = d.withColumn("prefix", F.left("__t", F.lit(prefix)))

    # Counted on whole documents, so that both scans of all openings and of the long lines know their hot keys beforehand.
    hot = hot_keys(lines, [doc])
    kept = cut if hot is not None else lambda df: df
    at, blk = ["__y", "__i"], [F.floor(F.col("__y") * 64)]

    def flagged(rows: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
        d1 = ordered_scan(rows, keys, at, blk, [lag1("__p", F.struct("__t", "__y"))], hot)
        if allow_equal:
            prev = F.col("__p.__y")
        else:
            d1 = kept(d1).withColumn("__other", F.when(F.col("__p.__t") != F.col("__t"), F.col("__p.__y")))
            d1 = ordered_scan(d1, keys, at, blk, [last_seen("__prev", "__other")], hot)
            prev = F.col("__prev")
        near = F.coalesce(F.round(F.col("__y") - prev, 9) <= dy, F.lit(False))
        return kept(d1.select(*rows.columns, near.alias(out)))

    d = flagged(kept(d), [doc, "prefix"], "__near")
    d = d.withColumn("__long", F.length("__t") >= hard_len)
    d = flagged(d, [doc, "prefix", "__long"], "__near_long")
    return d.groupBy(doc, "prefix").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if("__near").alias("n_flagged"),
        F.coalesce(F.max(F.col("__long") & F.col("__near_long")), F.lit(False)).alias("hard"),
    ).filter("n_flagged > 0")


def summary_presence(expected: DataFrame, paras: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Where the expected summary ended up: ``ok``, ``missing``, ``duplicated`` or ``misplaced``.

    ``expected`` has (doc, summary); ``paras`` has (doc, section_id, section_type, text).
    """
    key = F.lower(F.left("summary", F.lit(30)))
    p = paras.join(expected.withColumn("__k", key), doc)
    s = t.strip(F.col("text"))
    hit = (F.length(s) >= 40) & F.left(F.lower(s), F.lit(80)).contains(F.col("__k"))
    found = p.filter(hit).groupBy(doc).agg(
        F.countDistinct("section_id").alias("sections"), F.max(F.col("section_type") == "summary").alias("in_summary")
    )
    return expected.select(doc).join(found, doc, "left").select(
        doc, F.coalesce("sections", F.lit(0)).alias("sections"),
        F.when(F.col("sections").isNull(), "missing").when(F.col("sections") >= 2, "duplicated")
        .when(~F.col("in_summary"), "misplaced").otherwise("ok").alias("verdict"),
    )


def section_lines(lines: DataFrame, doc: str, order: str, line: str, block: int = 4096) -> DataFrame:
    """Lines with the diff section they belong to and whether they open its first occurrence."""
    low = F.lower(t.strip(F.col(line)))
    d = lines.withColumn("__head", F.when(low.isin(*DIFF_HEADERS), low))
    return ordered_scan(d, [doc], [order], [F.floor(F.col(order) / block)], [last_seen("__sec", "__head"), lag1("__before", "__head")])


def section_diff(src: DataFrame, out: DataFrame, doc: str = "doc_id", order: str = "line_no", line: str = "line",
                 block: int = 4096) -> DataFrame:
    """Per named section whose text differs: lines before and after, and differing positions.

    Sections are compared line by line on their rank; none is gathered as text.
    A later section of the same name counts as part of its own run only.
    """
    rows = src.select(doc, order, F.col(line).alias("line"), F.lit(0).alias("__side")).unionByName(
        out.select(doc, order, F.col(line).alias("line"), F.lit(1).alias("__side")))
    if hot_keys(rows, [doc]) is None:
        return _section_diff_small(rows, doc, order)

    def named(df):
        low = F.lower(t.strip(F.col(line)))
        d = cut(df.select(doc, order, line, F.when(low.isin(*DIFF_HEADERS), low).alias("__head")))
        parts = None
        for name, aliases in DIFF_SECTIONS.items():
            starts = d.filter(F.col("__head").isin(*aliases)).groupBy(doc).agg(F.min(F.struct(order, "__head")).alias("__st"))
            runs = d.join(starts, doc).filter(F.col(order) > F.col(f"__st.{order}"))
            stop = runs.filter(F.col("__head").isNotNull() & (F.col("__head") != F.col("__st.__head"))).groupBy(doc).agg(F.min(order).alias("__end"))
            body = runs.join(stop, doc, "left").filter(F.col("__end").isNull() | (F.col(order) < F.col("__end")))
            one = body.select(doc, F.lit(name).alias("section"), order, t.strip(F.col(line)).alias("txt"))
            parts = one if parts is None else parts.unionByName(one)
        parts = cut(parts)
        live = parts.filter("txt <> ''").groupBy(doc, "section").agg(F.min(order).alias("__lo"), F.max(order).alias("__hi"))
        inside = parts.join(live, [doc, "section"]).filter(F.col(order).between(F.col("__lo"), F.col("__hi")))
        return ordered_scan(inside.select(doc, "section", order, "txt"), [doc, "section"], [order], [F.floor(F.col(order) / block)], [rank_in("n")]).drop(order)

    j = named(src).withColumnRenamed("txt", "before").join(named(out).withColumnRenamed("txt", "after"), [doc, "section", "n"], "full_outer")
    return _differing(j, doc)


def _section_diff_small(rows: DataFrame, doc: str, order: str) -> DataFrame:
    """The section diff of documents known to be small: one shuffle of both sides' lines (doc, order, line, __side)."""
    txt, at = t.strip(F.col("line")), F.col(order)
    low, side = F.lower(txt), Window.partitionBy(doc, "__side")
    # A null document meets nothing, so it has no sections.
    d = rows.filter(F.col(doc).isNotNull()).repartition(doc).select(doc, order, "__side", txt.alias("txt"), F.when(low.isin(*DIFF_HEADERS), low).alias("__head"))
    section = F.lit(None).cast("string")
    for i, (name, aliases) in enumerate(DIFF_SECTIONS.items()):
        st, end = f"__st{i}", f"__end{i}"
        d = d.withColumn(st, F.min(F.when(F.col("__head").isin(*aliases), F.struct(order, "__head"))).over(side))
        closes = F.col("__head").isNotNull() & (F.col("__head") != F.col(f"{st}.__head")) & (at > F.col(f"{st}.{order}"))
        d = d.withColumn(end, F.min(F.when(closes, at)).over(side))
        # The other section's heading closes this one, so a line is in one section at most.
        section = F.when((at > F.col(f"{st}.{order}")) & (F.col(end).isNull() | (at < F.col(end))), name).otherwise(section)
    d = d.withColumn("section", section).filter("section IS NOT NULL").select(doc, "__side", "section", order, "txt")
    part = Window.partitionBy(doc, "__side", "section")
    live = F.when(F.col("txt") != "", at)
    d = d.withColumns({"__lo": F.min(live).over(part), "__hi": F.max(live).over(part)}).filter(at.between(F.col("__lo"), F.col("__hi")))
    d = d.withColumn("n", F.row_number().over(part.orderBy(order)))
    of = lambda k: F.max(F.when(F.col("__side") == k, F.col("txt")))
    j = d.groupBy(doc, "section", "n").agg(of(0).alias("before"), of(1).alias("after"))
    return _differing(j, doc)


def _differing(j: DataFrame, doc: str) -> DataFrame:
    return j.groupBy(doc, "section").agg(
        F.count("before").alias("lines_before"), F.count("after").alias("lines_after"),
        F.count_if(~F.col("before").eqNullSafe(F.col("after"))).alias("differing"),
    ).filter("differing > 0")


EXPERIENCE_HEADS = ("experience", "professional experience")


def _experience_lines(lines: DataFrame, doc: str, order: str, line: str) -> DataFrame:
    """Lines of the experience section: it closes at the first other heading after an experience heading
    and starts at the last experience heading before that."""
    low = F.lower(t.strip(F.col(line)))
    d = lines.withColumn("__head", F.when(low.isin(*DIFF_HEADERS), low))
    mine = F.col("__head").isin(*EXPERIENCE_HEADS)
    heads = cut(d.filter(F.col("__head").isNotNull()).select(doc, F.col(order).alias("__at"), mine.alias("__mine")))
    first = heads.filter("__mine").groupBy(doc).agg(F.min("__at").alias("__first"))
    stop = heads.filter("NOT __mine").join(first, doc).filter("__at > __first").groupBy(doc).agg(F.min("__at").alias("__stop"))
    start = heads.filter("__mine").join(stop, doc, "left").filter("__stop IS NULL OR __at < __stop").groupBy(doc, "__stop").agg(F.max("__at").alias("__start"))
    inside = (F.col(order) > F.col("__start")) & (F.col("__stop").isNull() | (F.col(order) < F.col("__stop"))) & F.col("__head").isNull()
    return d.join(start, doc).filter(inside).drop("__start", "__stop")


def experience_bullets(lines: DataFrame, dashed: bool, doc: str = "doc_id", order: str = "line_no", line: str = "line",
                       block: int = 4096) -> DataFrame:
    """(doc, role, idx, text): bullets of each role in the experience section.

    With ``dashed`` only dash or dot lines are bullets; otherwise every line but
    a date line is.
    """
    d = _experience_lines(lines, doc, order, line)
    s = t.strip(F.col(line))
    head = s.contains("|") & ~s.startswith("-") & ~s.startswith("•")
    d = d.filter(s != "").select(doc, order, s.alias("__s"), head.alias("__r"))
    d = ordered_scan(d, [doc], [order], [F.floor(F.col(order) / block)], [running_sum("role", F.col("__r").cast("long"))])
    date = t.has_year(F.col("__s")) & ~F.col("__s").contains("|") & (F.length("__s") < 60)
    is_bullet = F.col("__s").rlike("^[-•] ") if dashed else ~date
    text = t.strip(F.substr(F.col("__s"), F.lit(3))) if dashed else F.col("__s")
    return d.filter((F.col("role") > 0) & ~F.col("__r") & is_bullet).select(doc, "role", F.col(order).alias("idx"), text.alias("text"))


def experience_diff(src: DataFrame, out: DataFrame, doc: str = "doc_id", order: str = "line_no", line: str = "line") -> DataFrame:
    """Bullet diff of roles paired by position; roles beyond the shorter list are left out.

    Documents of up to ``GROUP_ROWS`` lines on both sides together are read and compared after one shuffle of their lines.
    """
    # The document has a name of its own: Spark knows that both sides lie alike only where their columns come from no view.
    tag = lambda df, side: df.select(F.col(doc).alias("__doc"), F.lit(side).alias("__side"), F.col(order).cast("long").alias("__i"), F.col(line).alias("__t"))
    rows = tag(src, 0).unionByName(tag(out, 1))
    over = hot_keys(rows, ["__doc"], GROUP_ROWS)
    small, large = parted(rows, ["__doc"], over)
    bullets = _experience_small(small, "__doc")
    if src.sparkSession.conf.get("spark.sql.requireAllClusterKeysForDistribution") == "true":
        bullets = bullets.repartition("__doc", "role")
    found = _diff_small(bullets, ["__doc", "role"]).withColumnRenamed("__doc", doc)
    if large is None:
        return found
    over = over.withColumnRenamed("__doc", doc)
    part = lambda df: cut(df.join(over, doc, "left_semi"))
    return found.unionByName(_experience_large(part(src), part(out), doc, order, line))


def _experience_small(rows: DataFrame, doc: str) -> DataFrame:
    """(doc, role, __side, __i, __t): the bullets of both sides, by windows over a document, which share one sort."""
    s = t.strip(F.col("__t"))
    both = Window.partitionBy(doc).orderBy("__side", "__i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    side, of = Window.partitionBy(doc, "__side"), lambda n: F.col("__side") == n
    low, at = F.lower(s), F.col("__i")
    # A null document meets nothing, so it has no section.
    mine = F.col("__head").isin(*EXPERIENCE_HEADS) & F.col(doc).isNotNull()
    in_side = lambda f, c: F.when(of(0), f(F.when(c & of(0), at)).over(both)).otherwise(f(F.when(c & of(1), at)).over(both))
    d = rows.withColumn("__s", s).withColumn("__head", F.when(low.isin(*DIFF_HEADERS), low))
    d = d.withColumn("__first", in_side(F.min, mine))
    d = d.withColumn("__stop", in_side(F.min, F.col("__head").isNotNull() & ~mine & (at > F.col("__first"))))
    open_ = F.col("__stop").isNull() | (at < F.col("__stop"))
    d = d.withColumn("__start", in_side(F.max, mine & open_))
    d = d.filter((at > F.col("__start")) & open_ & F.col("__head").isNull() & (F.col("__s") != ""))
    d = d.withColumn("__r", F.col("__s").contains("|") & ~F.col("__s").rlike("^[-•]"))
    d = d.withColumn("role", F.sum(F.col("__r").cast("long")).over(side.orderBy("__i").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    roles = lambda n: F.coalesce(F.max(F.when(of(n), F.col("role"))).over(both), F.lit(0))
    d = d.withColumn("__roles", F.least(roles(0), roles(1)))
    dashed, s = of(1), F.col("__s")
    date = t.has_year(s) & ~s.contains("|") & (F.length(s) < 60)
    is_bullet = F.when(dashed, s.rlike("^[-•] ")).otherwise(~date)
    text = F.when(dashed, t.strip(F.substr(s, F.lit(3)))).otherwise(s)
    return d.filter(F.col("role").between(1, F.col("__roles")) & ~F.col("__r") & is_bullet).select(doc, "role", "__side", "__i", text.alias("__t"))


def _experience_large(src: DataFrame, out: DataFrame, doc: str, order: str, line: str) -> DataFrame:
    a = cut(experience_bullets(src, False, doc, order, line))
    b = cut(experience_bullets(out, True, doc, order, line))

    def head(df: DataFrame) -> DataFrame:
        s = t.strip(F.col(line))
        d = _experience_lines(df, doc, order, line)
        return d.filter(s.contains("|") & ~s.rlike("^[-•]")).groupBy(doc).agg(F.count(F.lit(1)).alias("roles"))

    both = cut(head(src).join(head(out).withColumnRenamed("roles", "r2"), doc).select(doc, F.least("roles", "r2").alias("roles")))
    cap = lambda df: df.join(both, doc).filter("role <= roles").drop("roles")
    return diff_bullets(cap(a), cap(b), [doc, "role"])


def prefix_coverage(texts: DataFrame, lines: DataFrame, doc: str, tid: str, text: str, line: str) -> DataFrame:
    """Share of a text's words (3+ characters, first four compared) found in the lines of the same document."""
    toks = lambda c: F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0), lambda w: F.length(w) > 2)
    four = lambda c: F.transform(toks(c), lambda w: F.left(w, F.lit(4)))
    have = lines.select(doc, F.explode(four(F.col(line))).alias("p")).distinct().withColumn("hit", F.lit(1))
    mine = texts.select(doc, tid, F.explode(four(F.col(text))).alias("p")).groupBy(doc, tid, "p").agg(F.count(F.lit(1)).alias("n"))
    g = mine.join(have, [doc, "p"], "left").groupBy(doc, tid).agg(
        F.sum("n").alias("words"), F.sum(F.when(F.col("hit") == 1, F.col("n")).otherwise(0)).alias("covered")
    )
    return g.withColumn("reused", (F.col("words") >= 3) & (F.col("covered") * 100 >= F.col("words") * 85))


def container_reuse(texts: DataFrame, lines: DataFrame, doc: str, tid: str, lid: str, text: str, line: str, threshold: float = 0.62) -> DataFrame:
    """Texts already present in the other document: containment, similarity or word coverage.

    Only texts that their words do not cover already are compared with the lines.
    """
    squash = lambda c: F.lower(t.strip(F.regexp_replace(c, r"\s+", " ")))
    cov = prefix_coverage(texts, lines, doc, tid, text, line).filter("reused").select(doc, tid, F.lit(True).alias("cov"))
    found = cut(texts.join(cov, [doc, tid], "left").select(doc, tid, F.coalesce("cov", F.lit(False)).alias("cov"), squash(F.col(text)).alias("s")))
    a = found.filter("NOT cov AND s <> ''").select(doc, tid, "s")
    b = lines.select(doc, lid, squash(F.col(line)).alias("s")).filter("s <> ''")
    rows = a.select(doc, F.lit(0).alias("__side"), tid, "s").unionByName(b.select(doc, F.lit(1).alias("__side"), F.lit(None).cast(dict(a.dtypes)[tid]).alias(tid), "s"))
    large = hot_keys(rows, [doc], GROUP_ROWS)
    small, _ = parted(rows, [doc], large)
    types = dict(a.dtypes)
    near = by_group(small.filter(F.col(doc).isNotNull()).repartition(doc), [doc], ["__side"], _reused_of_group(threshold), f"{doc} {types[doc]}, {tid} {types[tid]}")
    if large is not None:
        edges = cell_edges(parted(a, [doc], large)[1], parted(b, [doc], large)[1], [doc], tid, lid, "s", _reuse(threshold), 1.0)
        near = near.unionByName(edges.select(doc, tid))
    near = near.distinct().withColumn("near", F.lit(True))
    return found.join(near, [doc, tid], "left").select(doc, tid, (F.coalesce("near", F.lit(False)) | F.col("cov")).alias("reused"))


def _reused_of_group(threshold: float):
    def reused(key: tuple, rows: list[tuple]) -> list[tuple]:
        lines = list(dict.fromkeys(s for side, _, s in rows if side == 1))
        texts = list(dict.fromkeys(s for side, _, s in rows if side == 0))
        if not lines or not texts:
            return []
        hit = {s for s in texts if any(s in x or x in s for x in lines)}
        rest = [s for s in texts if s not in hit]
        if rest:
            bounds = ratio_bounds(rest, lines)
            for i, s in enumerate(rest):
                best = [j for j in np.argsort(-bounds[i], kind="stable") if bounds[i, j] >= threshold]
                if any(against(lines[j])(s) >= 1.0 for j in best):
                    hit.add(s)
        return [(*key, i) for side, i, s in rows if side == 0 and s in hit]

    against = _reuse(threshold)
    return reused


def _reuse(threshold: float):
    def against(right: str):
        from difflib import SequenceMatcher

        m = SequenceMatcher(None, "", right)

        def hit(left: str) -> float:
            if left in right or right in left:
                return 1.0
            m.set_seq1(left)
            ok = m.real_quick_ratio() >= threshold and m.quick_ratio() >= threshold and m.ratio() >= threshold
            return 1.0 if ok else 0.0

        return hit

    return against
