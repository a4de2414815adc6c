"""Evaluation scores, roll-ups, regressions against a baseline, gates and caches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.plans import grouped_median, lookup_join, ordered_scan, rank_in

# Score keys and weights.
SCORE_WEIGHTS = {
    "truthfulness": 0.20,
    "role_fit": 0.20,
    "seniority_positioning": 0.10,
    "clarity_impact": 0.15,
    "mechanism_quality": 0.10,
    "constraint_compliance": 0.15,
    "cover_letter_effectiveness": 0.05,
    "overall_readiness": 0.05,
}
LAYOUT_WEIGHTS = {
    "topology": 0.25, "sections": 0.25, "no_overflow": 0.15, "no_dup": 0.20, "no_leak": 0.05, "style": 0.10,
}
GRADE_WEIGHTS = {
    "ir_score": 0.12, "content_injection_score": 0.15, "page_count_score": 0.07, "blank_page_score": 0.08,
    "region_score": 0.15, "container_score": 0.08, "density_score": 0.10, "sparse_page_score": 0.25,
}
GRADE_DEFAULTS = {
    "content_injection_score": 80.0, "page_count_score": 80.0, "blank_page_score": 100.0, "region_score": 80.0,
    "container_score": 80.0, "density_score": 80.0, "sparse_page_score": 80.0,
}
SOFT_CAP_CLASSES = (
    "C_SUMMARY_MISSING", "D_DENSITY_DEGRADED", "D_EXPERIENCE_DISPLACED_SEVERE",
    "E_DUPLICATE_SEMANTIC_BLOCK", "F_RIGHT_COLUMN_INJECTION",
)


def clamp(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def _units(w: float) -> int:
    return int(Decimal(str(w)) * 10000)


def _half_up(num: Column, den: Column) -> Column:
    """num / den rounded half up to an integer, in integer arithmetic."""
    return F.floor((num * 2 + den) / (den * 2))


def integrated_score(weights: Mapping[str, float], scale: int = 1) -> Column:
    """Weighted mean of the non-null score columns, weights renormalised, 2 decimals.

    ``scale`` says how many units one point has in the columns (100 when they
    hold hundredths).
    """
    num = reduce(lambda a, b: a + b, [F.coalesce(F.col(k).cast("long") * _units(w), F.lit(0)) for k, w in weights.items()])
    den = reduce(lambda a, b: a + b, [F.when(F.col(k).isNotNull(), _units(w)).otherwise(0) for k, w in weights.items()])
    return F.when(den == 0, 0.0).otherwise(_half_up(num * 100, den * scale) / 100)


def score_rows(positions: DataFrame, weights: Mapping[str, float] = SCORE_WEIGHTS) -> DataFrame:
    """Each scored position with its integrated score."""
    return positions.withColumn("integrated_score", integrated_score(weights))


def score_rollup(positions: DataFrame, keys: Sequence[str], weights: Mapping[str, float] = SCORE_WEIGHTS) -> DataFrame:
    """Category means (0 when a category has no value) and the integrated score of those means."""
    sums = positions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("positions"),
        *[F.sum(F.col(k).cast("long")).alias(f"s_{k}") for k in weights],
        *[F.count(k).alias(f"n_{k}") for k in weights],
    )
    cents = {
        k: F.when(F.col(f"n_{k}") == 0, F.lit(0)).otherwise(_half_up(F.col(f"s_{k}") * 100, F.col(f"n_{k}"))).cast("long")
        for k in weights
    }
    rows = sums.select(*keys, "positions", *[c.alias(k) for k, c in cents.items()])
    return rows.select(
        *keys, "positions", *[(F.col(k) / 100).alias(f"avg_{k}") for k in weights],
        integrated_score(weights, 100).alias("integrated_score"),
    )


def eval_scores(raw: DataFrame, mapping: Mapping[str, str], key: str) -> DataFrame:
    """Scores out of ten as fractions and the mean of those present (null when none)."""
    vals = {out: (F.col(src).cast("double") / 10) for out, src in mapping.items()}
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(s).cast("double"), F.lit(0.0)) for s in mapping.values()])
    n = reduce(lambda a, b: a + b, [F.col(s).isNotNull().cast("int") for s in mapping.values()])
    return raw.select(
        key, *[F.round(v, 4).alias(o) for o, v in vals.items()],
        F.when(n > 0, F.round(total / (n * 10), 4)).alias("integrated"),
    )


def run_summary(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Totals by status."""
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(o) for s, o in (("pass", "passed"), ("fail", "failed"), ("error", "errors"))],
    )


def issue_frequency(results: DataFrame, issues: str = "issues") -> DataFrame:
    """How often each issue type occurs, most frequent first."""
    return results.select(F.explode(issues).alias("issue")).groupBy("issue").agg(
        F.count(F.lit(1)).alias("n")
    ).orderBy(F.col("n").desc(), "issue")


def suite_report(results: DataFrame, group_cols: Sequence[str] = ("template_class", "severity")) -> DataFrame:
    """Counts and mean score overall and per dimension in one pass; errors are out of the means.

    ``(all)`` marks totals; a null dimension value stays null.
    """
    sets = [[]] + [[g] for g in group_cols]
    ok = ~F.col("is_error")
    agg = results.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(g) for g in group_cols]).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok & (F.col("score") >= 0.70)).alias("passed"),
        F.count_if(ok & (F.col("score") < 0.70)).alias("failed"),
        F.count_if(F.col("is_error")).alias("errors"),
        F.sum(F.when(ok, F.col("score").cast("decimal(18,6)"))).alias("s"),
        F.count_if(ok).alias("n"),
        *[F.grouping(g).alias(f"__g{i}") for i, g in enumerate(group_cols)],
    )
    return agg.select(
        *[F.when(F.col(f"__g{i}") == 1, "(all)").otherwise(F.col(g)).alias(g) for i, g in enumerate(group_cols)],
        "total", "passed", "failed", "errors",
        F.round(F.coalesce(F.col("s").cast("double") / F.nullif("n", F.lit(0)), F.lit(0.0)), 6).alias("average_score"),
    )


def class_frequency(results: DataFrame, classes: str = "failure_classes") -> DataFrame:
    """Failure-class frequency, errors included."""
    return results.select(F.explode(classes).alias("failure_class")).groupBy("failure_class").agg(F.count(F.lit(1)).alias("n"))


def grade_aggregate(grades: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """Counts, mean, exact median, min and max per key; ``fail`` counts hard fails too.

    Without keys there is one row, of zeros when there are no grades.
    """
    stats = grades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.count_if(F.col("status") == "pass").alias("pass_count"),
        F.count_if(F.col("status") == "warning").alias("warning_count"),
        F.count_if(F.col("status").isin("fail", "hard_fail")).alias("fail_count"),
        F.count_if(F.col("status") == "hard_fail").alias("hard_fail_count"),
        F.round(F.sum(F.col(score).cast("decimal(18,6)")).cast("double") / F.count(F.lit(1)), 6).alias("average_score"),
        F.min(score).alias("min_score"), F.max(score).alias("max_score"),
    )
    if not keys:
        med = grouped_median(grades.withColumn("__all", F.lit(1)), ["__all"], score, "median_score").drop("__all")
        numbers = ["average_score", "min_score", "max_score", "median_score"]
        return stats.join(F.broadcast(med), how="left").withColumn("median_score", F.round("median_score", 6)).fillna(0.0, numbers)  # one row each
    med = grouped_median(grades, keys, score, "median_score")
    return stats.join(med, list(keys), "left").withColumn("median_score", F.round("median_score", 6))


def baseline_transitions(cur: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """Current results with their transition against the baseline's status."""
    b = base.select(key, F.col("status").alias("base_status"))
    bad = lambda c: F.col(c).isin("fail", "error")
    return cur.join(b, key, "left").withColumn(
        "transition",
        F.when((F.col("base_status") == "pass") & bad("status"), "regression")
        .when(bad("base_status") & (F.col("status") == "pass"), "improvement")
        .when((F.col("base_status") == "pass") & (F.col("status") == "pass"), "still_passing")
        .when(bad("base_status") & bad("status"), "still_failing").otherwise("none"),
    )


def score_regressions(cur: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """Cases that lost at least 5 points; severe from 15, or from a pass to a fail."""
    b = base.select(key, F.col("score").alias("score_before"))
    j = cur.join(b, key).withColumn("score_delta", F.col("score") - F.col("score_before"))
    prev = F.col("score_before")
    severe = (F.col("score_delta") <= -15) | ((prev >= 75) & F.col("status").isin("fail", "hard_fail"))
    return j.filter("score_delta <= -5").select(
        key, "score_before", F.col("score").alias("score_after"), "score_delta",
        F.when(severe, "SEVERE_REGRESSION").otherwise("REGRESSION").alias("regression_class"),
        F.when(prev >= 75, "pass").when(prev >= 60, "warning").otherwise("fail").alias("status_before"),
        F.col("status").alias("status_after"),
    ).orderBy("score_delta", key)


def promotion_gate(transitions: DataFrame, allow_regressions: bool = False) -> DataFrame:
    """One row: whether the run may become the baseline."""
    return transitions.agg(F.count_if(F.col("transition") == "regression").alias("regressions")).select(
        "regressions", (F.lit(allow_regressions) | (F.col("regressions") == 0)).alias("may_promote")
    )


def worst_k(df: DataFrame, score: str, key: str, k: int = 5) -> DataFrame:
    """The k lowest scores (top-k per task, then merged; no full sort)."""
    return df.orderBy(score, key).limit(k)


def top_values(df: DataFrame, col: str, k: int) -> DataFrame:
    """The k most frequent values, ties by value."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), col).limit(k)


def top_candidates(df: DataFrame, weights: Mapping[str, float], key: str, k: int) -> DataFrame:
    """Head of a work list by weighted sum (four exact decimals per weight), ties by key."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c).cast("long") * _units(w), F.lit(0)) for c, w in weights.items()])
    return df.withColumn("weight", total / 10000).orderBy(F.col("weight").desc(), key).limit(k)


def examples_per_group(df: DataFrame, group: str, order: str, block: Column, k: int = 8) -> DataFrame:
    """First k rows of each group, ranked in blocks so that no group is sorted as a whole."""
    return ordered_scan(df, [group], [order], [block], [rank_in("nth")]).filter(F.col("nth") <= k)


def triage_order(df: DataFrame, statuses: Sequence[str], scores: Sequence[str], key: str) -> DataFrame:
    """Rows by status position, then scores descending."""
    pos = F.array_position(F.array(*[F.lit(s) for s in statuses]), F.col("status"))
    return df.withColumn("status_rank", pos).orderBy("status_rank", *[F.col(s).desc() for s in scores], key)


def cache_key(*parts: Column) -> Column:
    """16 hex digits of the sha256 of the parts."""
    return F.left(F.sha2(F.concat(*[F.coalesce(p, F.lit("")) for p in parts]), 256), F.lit(16))


def cache_split(work: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """Work rows with whether their key is already cached."""
    have = cache.select(key).distinct().withColumn("__hit", F.lit(True))
    return lookup_join(work, have, [key], "left").withColumn("cached", F.coalesce("__hit", F.lit(False))).drop("__hit")


def density_check(orig: DataFrame, updated: DataFrame, keys: Sequence[str] = ("doc_id", "para_id")) -> DataFrame:
    """Per document: updated paragraphs that overflow, or are packed with line breaks.

    ``orig`` has (keys, ord, old_len), the last row of a repeated id counting;
    ``updated`` has (keys, new_len, has_newline).
    """
    last = orig.filter(F.col(keys[-1]) != "").groupBy(*keys).agg(F.max_by("old_len", "ord").alias("old_len"))
    j = updated.filter(F.col(keys[-1]) != "").join(last, list(keys))
    over = F.col("new_len") > F.greatest(F.lit(200), F.col("old_len") * 2)
    packed = F.col("has_newline") & (F.col("new_len") * 10 > F.col("old_len") * 13) & (F.col("old_len") > 0)
    return j.groupBy(keys[0]).agg(
        F.count_if(over).alias("density_overflow_count"), F.count_if(packed).alias("multi_bullet_packing_count")
    )


def top_expansions(orig: DataFrame, updated: DataFrame, keys: Sequence[str], n: int = 10) -> DataFrame:
    """The n paragraphs that grew most (ratio above 1.01)."""
    j = updated.join(orig, list(keys))
    ratio = F.col("new_len") / F.greatest("old_len", F.lit(1))
    return j.withColumn("ratio", F.round(ratio, 6)).filter("ratio > 1.01").orderBy(
        F.col("ratio").desc(), *keys
    ).limit(n)


def id_consistency(members: DataFrame, doc: str = "doc_id", pid: str = "para_id") -> DataFrame:
    """Per document: ids only in the layout, only in the model, and in both body and role.

    ``members`` is one row per (doc, id, place), place in layout / body / role.
    One grouping of the union replaces three outer joins.
    """
    p = F.col("place")
    ids = members.filter(F.col(pid) != "").groupBy(doc, pid).agg(
        F.max(p == "layout").alias("in_layout"), F.max(p == "body").alias("in_body"), F.max(p == "role").alias("in_role")
    )
    model = F.col("in_body") | F.col("in_role")
    return ids.groupBy(doc).agg(
        F.count_if(F.col("in_layout") & ~model).alias("layout_only"),
        F.count_if(~F.col("in_layout") & model).alias("model_only"),
        F.count_if(F.col("in_body") & F.col("in_role")).alias("split_brain"),
    )


def composite_layout(m: DataFrame) -> DataFrame:
    """Weighted layout score from component scores and penalties, clamped to [0, 1]."""
    w = LAYOUT_WEIGHTS
    dup = clamp(F.col("stale_ratio") * 1.5)
    over = F.when(F.col("page_delta") <= 0, 0.0).otherwise(clamp(F.col("page_delta") * 0.40))
    score = (
        F.col("topology") * w["topology"] + F.col("sections") * w["sections"] + (1 - over) * w["no_overflow"]
        + (1 - dup) * w["no_dup"] + (1 - F.col("leakage")) * w["no_leak"] + F.col("style") * w["style"]
    )
    return m.withColumns({"overflow_penalty": over, "duplication_penalty": dup, "composite": clamp(score)})


def style_score(generated: Column, output: Column) -> Column:
    """Banded share of generated bullets that reached the output."""
    r = output / F.nullif(generated, F.lit(0))
    return F.when(generated == 0, 1.0).when(r >= 0.80, 1.0).when(r >= 0.60, 0.75).when(r >= 0.40, 0.50).otherwise(0.25)


def composite_grade(m: DataFrame) -> DataFrame:
    """Weighted grade with defaults for missing metrics, soft cap 74, hard cap 30, bands 75/60."""
    total = reduce(lambda a, b: a + b, [
        F.coalesce(F.col(k), F.lit(GRADE_DEFAULTS.get(k))) * w if k in GRADE_DEFAULTS else F.col(k) * w
        for k, w in GRADE_WEIGHTS.items()
    ])
    soft = F.arrays_overlap("failure_classes", F.array(*[F.lit(c) for c in SOFT_CAP_CLASSES]))
    score = F.when(F.col("hard_fail"), F.least(total, F.lit(30.0))).when(soft, F.least(total, F.lit(74.0))).otherwise(total)
    g = m.withColumn("composite", F.round(score, 6))
    return g.withColumn(
        "status",
        F.when(F.col("hard_fail"), "hard_fail").when(F.col("composite") >= 75, "pass")
        .when(F.col("composite") >= 60, "warning").otherwise("fail"),
    )


def failure_classes(m: DataFrame) -> DataFrame:
    """Failure classes A-F in rule order, without repeats."""
    known = lambda c: ~F.col(c).isin("unknown", "mixed_or_ambiguous")
    changed = known("src_topology") & known("out_topology") & (F.col("src_topology") != F.col("out_topology"))
    columns = (F.col("src_columns") != F.col("out_columns")) & (F.col("column_confidence") == "high")
    low = (F.col("topology_preservation") < 0.50) & (F.col("column_confidence") != "none")
    coverage = F.col("headings_found") / F.nullif("headings_expected", F.lit(0))
    placed = F.col("has_placement")
    rules = [
        (changed | columns | low, "F_TOPOLOGY_COLLAPSE"),
        (F.col("high_stress") | (F.col("page_delta") > 0) | (F.col("overflow_penalty") >= 0.50), "C_OVERFLOW_FIT"),
        ((F.col("duplication_penalty") >= 0.40) | F.col("stale_section"), "D_DUPLICATION_STALE"),
        (placed & (F.col("missing_sections") > 0), "A_SECTION_BOUNDARY"),
        (placed & (F.col("region_mismatches") > 0), "B_CONTAINER_ASSIGNMENT"),
        (placed & (F.col("bad_vertical") >= 2), "F_TOPOLOGY_COLLAPSE"),
        (~placed & F.coalesce(coverage < 0.70, F.lit(False)), "A_SECTION_BOUNDARY"),
        (F.col("style_score") < 0.60, "E_STYLE_PROTOTYPE"),
        (F.col("leakage_penalty") >= 0.25, "B_CONTAINER_ASSIGNMENT"),
    ]
    return m.withColumn("classes", F.array_distinct(F.array_compact(F.array(*[F.when(c, name) for c, name in rules]))))


def fidelity_scores(m: DataFrame) -> DataFrame:
    """Text, structure, layout and overall fidelity."""
    text = clamp(clamp(F.col("token_f1")) - F.col("missing_headings") * 0.10)
    structure = clamp(
        1.0 - F.col("missing_headings") * 0.15
        - F.when(F.col("bullet_delta") > 0, F.least(F.lit(0.30), F.col("bullet_delta") * 0.05)).otherwise(0.0)
    )
    indent = F.least(F.lit(0.25), F.greatest(F.lit(0.0), F.col("indent_delta") - 0.020) * 10.0)
    gap = F.least(F.lit(0.15), F.greatest(F.lit(0.0), F.col("gap_delta") - 0.020) * 7.5)
    layout = clamp(
        1.0 - F.when(~F.col("page_count_match"), 0.30).otherwise(0.0) - F.coalesce(indent, F.lit(0.0))
        - F.coalesce(gap, F.lit(0.0))
        - F.when((F.col("src_columns") != F.col("out_columns")) & (F.col("column_confidence") == "high"), 0.20).otherwise(0.0)
    )
    return m.withColumns({
        "text_score": text, "structure_score": structure, "layout_score": layout,
        "overall_score": text * 0.40 + structure * 0.30 + layout * 0.30,
    })


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Target with the last source row per key replacing or adding to it.

    ``source`` may repeat keys; the latest by ``order`` wins.  Null is a key like any other.
    """
    cols = target.columns
    last = source.groupBy(*keys).agg(
        F.max_by(F.struct(*[c for c in cols if c not in keys]), F.struct(*order)).alias("__r")
    ).select(*keys, "__r.*").select(*cols)
    # A struct of the keys is never null itself, so null keys find each other.
    replaced = last.select(F.struct(*keys).alias("__key"))
    return target.join(replaced, F.struct(*keys) == F.col("__key"), "left_anti").unionByName(last)
