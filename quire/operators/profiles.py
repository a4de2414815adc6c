"""Profile records: value sanitising, list normalising, structure migration and the backfill report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import lexicons as L
from quire.functions import text as t


def _unescaped(c: Column) -> Column:
    """Trailing commas and escaped boundary quotes off."""
    comma = lambda x: t.strip(F.regexp_replace(x, r",$", ""))
    s = F.regexp_replace(comma(t.strip(c)), r'^(?:\\"\s*)+', "")
    return comma(t.strip(F.regexp_replace(s, r'(?:\s*\\")+$', "")))


def _unquoted(s: Column) -> Column:
    """Boundary quotes off, inner quotes kept, then a trailing comma."""
    one = F.regexp_count(s, F.lit('"')) == 1
    cut = (
        F.when(s.rlike('(?s)^".*"$'), F.regexp_replace(s, '(?s)^"(.*)"$', "$1"))
        .when(one & s.startswith('"'), F.substr(s, F.lit(2))).when(one & s.endswith('"'), F.regexp_replace(s, '"$', "")).otherwise(s)
    )
    return t.strip(F.regexp_replace(t.strip(cut), r",$", ""))


def sanitize(c: Column) -> Column:
    """One value without boundary quotes, escaped quotes and trailing commas; inner quotes stay."""
    return F.get(sanitize_list(F.array(c), keep_empty=True), F.lit(0))


def sanitize_list(arr: Column, keep_empty: bool = False) -> Column:
    """Sanitised items, empty ones dropped.

    Each step is a pass of its own, so that its input is bound once instead of
    being repeated in the expression.
    """
    out = F.transform(F.transform(arr, _unescaped), _unquoted)
    return out if keep_empty else F.filter(out, lambda x: x != "")


def readable(token: Column) -> Column:
    """Underscore token as a phrase; proper nouns and capitals keep their form."""
    nouns = F.create_map(*[F.lit(x) for kv in L.PROPER_NOUNS.items() for x in kv])
    parts = F.filter(F.split(token, "_"), lambda p: p != "")
    cased = F.transform(parts, lambda p, i: F.coalesce(
        F.try_element_at(nouns, F.lower(p)),
        F.when(p.rlike("^[A-Z][A-Z0-9]*$"), p).when(i == 0, F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substr(p, F.lit(2))))).otherwise(F.lower(p)),
    ))
    return F.when(token.contains("_"), F.array_join(cased, " ")).otherwise(token)


def normalise_list(arr: Column) -> Column:
    """Combined items split and tokens made readable; :func:`normalize_profiles` drops repeats."""
    def expand(x: Column) -> Column:
        parts = F.filter(F.split(x, r"\s+"), lambda p: p != "")
        many = F.size(F.filter(parts, lambda p: p.contains("_"))) >= 2
        return F.when(x.contains(" ") & many, parts).otherwise(F.array(x))

    return F.transform(F.transform(F.flatten(F.transform(arr, expand)), t.strip), readable)


def migrate_profiles(df: DataFrame) -> DataFrame:
    """Version 1 fields moved to their version 2 places; rows already moved stay as they are.

    Expects technical_skills, claim_boundaries, experience_highlights,
    authz_authn_experience and scalability_reliability_patterns.
    """
    empty = F.array().cast("array<string>")
    plus = lambda a, b: F.concat(F.coalesce(a, empty), F.coalesce(b, empty))
    authz = F.col("authz_authn_experience")
    skills = (
        F.col("technical_skills")
        .withField("security_auth_patterns", plus(F.col("technical_skills.security_auth_patterns"), authz["implemented"]))
        .withField("scalability_reliability_patterns", plus(
            F.col("technical_skills.scalability_reliability_patterns"), F.col("scalability_reliability_patterns")))
    )
    claims = F.col("claim_boundaries").withField("security_auth", plus(F.col("claim_boundaries.security_auth"), authz["notes"]))
    lights = F.transform("experience_highlights", lambda h, i: F.when(
        (i == 0) & (F.size(F.coalesce(authz["scalability_challenges"], empty)) > 0),
        h.withField("constraints_and_tradeoffs", plus(h["constraints_and_tradeoffs"], authz["scalability_challenges"])),
    ).otherwise(h))
    null = lambda c: F.lit(None).cast(df.schema[c].dataType)
    return df.withColumns({
        "technical_skills": skills, "claim_boundaries": claims, "experience_highlights": lights,
        "authz_authn_experience": null("authz_authn_experience"), "scalability_reliability_patterns": null("scalability_reliability_patterns"),
        "candidate_profile_version": F.lit("2.0"),
    })


def normalize_profiles(df: DataFrame, lists: Sequence[str]) -> DataFrame:
    """List columns sanitised and normalised, with a flag for changed rows.

    A dotted name addresses a list inside a struct column.
    """
    # Three projections per list: items, readable items, distinct items.
    out = df
    changed = F.lit(False)
    for i, name in enumerate(lists):
        out = out.withColumn(f"__l{i}", sanitize_list(F.col(name)))
    for i in range(len(lists)):
        out = out.withColumn(f"__l{i}", normalise_list(F.col(f"__l{i}")))
    for i, name in enumerate(lists):
        out = out.withColumn(f"__l{i}", t.distinct_ci(F.col(f"__l{i}")))
        changed = changed | ~F.col(f"__l{i}").eqNullSafe(F.col(name))
    out = out.withColumn("changed", changed)
    for i, name in enumerate(lists):
        top, _, field = name.partition(".")
        new = F.col(f"__l{i}")
        out = out.withColumn(top, F.col(top).withField(field, new) if field else new)
    return out.drop(*[f"__l{i}" for i in range(len(lists))])


def backfill_report(normalised: DataFrame, flag: str = "changed") -> DataFrame:
    """One row: profiles seen, changed, and to be synchronised again."""
    return normalised.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col(flag)).alias("changed"), F.count_if(~F.col(flag)).alias("unchanged"),
    )


def mark_unsynched(normalised: DataFrame, flag: str = "changed") -> DataFrame:
    """Changed rows lose their prompt synchronisation."""
    return normalised.withColumn("prompt_synched", F.when(F.col(flag), F.lit(False)).otherwise(F.col("prompt_synched")))
