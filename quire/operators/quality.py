"""Rule engines over nested documents held as tables.

sections (doc_id, section_id, raw_title, semantic_type, rewrite_policy,
preserve_heading, preserve_body_structure); blocks (doc_id, section_id, role_id,
grp, ord, block_id, para_id, semantic_type, rewrite_policy, is_new) with grp in
block / header / meta / body; paras (doc_id, section_id, para_id, ord, text,
parser_semantic); members (doc_id, section_id, role_id, kind, para_id) with kind
in header / meta / bullet.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as t
from quire.operators.evals import SCORE_WEIGHTS
from quire.plans import cut, ordered_scan, rank_in, rule_table

# What each section type must look like (attribute, required, code).
SECTION_RULES = (
    ("summary", "rewrite_policy", "rewrite_body", "SUMMARY_REWRITE_POLICY"),
    ("summary", "preserve_heading", "false", "SUMMARY_PRESERVE_HEADING"),
    ("summary", "preserve_body_structure", "false", "SUMMARY_PRESERVE_BODY_STRUCTURE"),
    ("summary", "roles", "empty", "SUMMARY_ROLES_PRESENT"),
    ("summary", "blocks", "some", "SUMMARY_BLOCKS_EMPTY"),
    ("skills", "rewrite_policy", "rewrite_body", "SKILLS_REWRITE_POLICY"),
    ("skills", "roles", "empty", "SKILLS_ROLES_PRESENT"),
    ("experience", "rewrite_policy", "rewrite_bullets_only", "EXPERIENCE_REWRITE_POLICY"),
    ("experience", "preserve_heading", "true", "EXPERIENCE_PRESERVE_HEADING"),
    ("experience", "preserve_body_structure", "true", "EXPERIENCE_PRESERVE_BODY_STRUCTURE"),
    ("experience", "blocks", "empty", "EXPERIENCE_BLOCKS_PRESENT"),
    ("experience", "roles", "some", "EXPERIENCE_ROLES_EMPTY"),
    ("education", "rewrite_policy", "preserve", "EDUCATION_REWRITE_POLICY"),
    ("education", "preserve_heading", "true", "EDUCATION_PRESERVE_HEADING"),
    ("education", "preserve_body_structure", "true", "EDUCATION_PRESERVE_BODY_STRUCTURE"),
    ("education", "roles", "empty", "EDUCATION_ROLES_PRESENT"),
    ("education", "blocks", "some", "EDUCATION_BLOCKS_EMPTY"),
    ("projects", "rewrite_policy", "preserve", "PROJECTS_REWRITE_POLICY"),
    ("projects", "roles", "empty", "PROJECTS_ROLES_PRESENT"),
    ("projects", "blocks", "some", "PROJECTS_BLOCKS_EMPTY"),
    ("additional", "rewrite_policy", "preserve", "ADDITIONAL_REWRITE_POLICY"),
    ("additional", "roles", "empty", "ADDITIONAL_ROLES_PRESENT"),
    ("additional", "blocks", "some", "ADDITIONAL_BLOCKS_EMPTY"),
    ("other", "rewrite_policy", "preserve", "OTHER_REWRITE_POLICY"),
    ("other", "roles", "empty", "OTHER_ROLES_PRESENT"),
    ("other", "blocks", "some", "OTHER_BLOCKS_EMPTY"),
)
# Type, group, type code, policy code, code for is_new, policy of every block (null: any or by type).
BLOCK_GROUPS = (
    ("summary", "block", "SUMMARY_BLOCK_TYPE", "SUMMARY_BLOCK_POLICY", "SUMMARY_BLOCK_NEW_NOT_FALSE", "rewrite_text"),
    ("skills", "block", "SKILLS_BLOCK_TYPE", "SKILLS_BLOCK_POLICY", "SKILLS_BLOCK_NEW_NOT_FALSE", None),
    ("education", "block", "EDUCATION_BLOCK_TYPE", "EDUCATION_BLOCK_POLICY", None, "preserve"),
    ("projects", "block", "PROJECTS_BLOCK_TYPE", "PROJECTS_BLOCK_POLICY", None, "preserve"),
    ("additional", "block", "ADDITIONAL_BLOCK_TYPE", "ADDITIONAL_BLOCK_POLICY", None, "preserve"),
    ("other", "block", "OTHER_BLOCK_TYPE", "OTHER_BLOCK_POLICY", None, "preserve"),
    ("experience", "header", "EXPERIENCE_ROLE_HEADER_BLOCK_TYPE", "EXPERIENCE_ROLE_HEADER_BLOCK_POLICY", None, "preserve"),
    ("experience", "meta", "EXPERIENCE_ROLE_META_BLOCK_TYPE", "EXPERIENCE_ROLE_META_BLOCK_POLICY", None, "preserve"),
    ("experience", "body", "EXPERIENCE_ROLE_BODY_BLOCK_TYPE", "EXPERIENCE_ROLE_BODY_BLOCK_POLICY", None, None),
)
REWRITEABLE_BODY = ("bullet", "role_achievement_bullet", "role_responsibility_bullet")
PRESERVED_BODY = (
    "role_intro", "role_highlight", "role_project_label", "role_project_context", "role_tech_stack",
    "role_key_technologies", "role_tools", "role_nested_detail", "role_freeform_note",
)
BLOCK_TYPES = (
    ("summary", "block", "summary_paragraph", None), ("skills", "block", "skills_paragraph", None),
    ("education", "block", "education_entry", None), ("projects", "block", "project_entry", None),
    ("projects", "block", "other_paragraph", None), ("additional", "block", "additional_item", None),
    ("additional", "block", "other_paragraph", None), ("other", "block", "other_paragraph", None),
    ("experience", "header", "role_header", None), ("experience", "meta", "role_meta", None),
    *[("experience", "body", b, "rewrite_text") for b in REWRITEABLE_BODY],
    *[("experience", "body", b, "preserve") for b in PRESERVED_BODY],
)
VALID_TYPES = ("summary", "skills", "experience", "education", "projects", "additional", "other")
WRONG_IN_EDUCATION = (
    "role_header", "role_meta", "other_paragraph", "summary_paragraph", "skills_paragraph", "project_entry",
    "additional_item",
)
# Code, category, weight, severity.
ISSUE_CODES = (
    ("EXPERIENCE_NO_ROLES", "A", 3, "high"), ("MERGED_SECTION_SUSPECTED", "A", 4, "high"),
    ("HEADING_NOT_RECOGNIZED", "A", 2, "medium"), ("ROLE_HEADER_CONTAINS_DATE", "B", 2, "low"),
    ("EXPERIENCE_ROLE_BOUNDARY_INSIDE_BULLETS", "A", 5, "high"), ("EXPERIENCE_OVERMERGED_ROLE", "A", 3, "high"),
    ("BULLET_NOT_RECOGNIZED", "B", 1, "info"), ("ROLE_GROUPING_WEAK", "B", 2, "low"),
    ("ROLE_LIKE_GROUPING_NON_EXPERIENCE", "B", 1, "info"), ("LABEL_COLUMN_DETECTED", "B", 1, "info"),
    ("TABLE_COLUMN_LAYOUT_DETECTED", "B", 1, "info"), ("TABLE_COLUMN_REORDER_ABORTED", "B", 1, "info"),
    ("TABLE_COLUMN_CONTAMINATION_SUSPECTED", "B", 1, "info"), ("TABLE_CONTACT_INSIDE_EXPERIENCE", "B", 2, "low"),
    ("TABLE_SKILLS_INSIDE_NON_SKILLS_SECTION", "B", 1, "info"), ("TABLE_EDUCATION_INSIDE_EXPERIENCE", "B", 2, "low"),
    ("TABLE_ORG_NAME_PROMOTED_TO_FAKE_SECTION", "B", 1, "info"),
)
EXPERIENCE_TITLES = (
    "experience", "experiences", "work experience", "professional experience", "employment history", "employment",
    "career history", "work history", "professional background", "employment summary", "work summary",
    "experience summary",
)
KNOWN_HEADINGS = (
    "experience", "work experience", "professional experience", "employment history", "employment", "career history",
    "summary", "professional summary", "objective", "profile", "skills", "technical skills", "core competencies",
    "competencies", "education", "academic background", "degrees", "certifications", "certification", "licenses",
    "languages", "language skills", "projects", "publications", "awards", "honors", "references", "activities",
    "volunteer", "volunteering", "leadership", "interests", "additional information", "communication", "contact",
    "about me",
)
HEADING_TRIGGERS = (
    "experience", "education", "skills", "summary", "objective", "certifications", "projects", "references", "awards",
    "profile", "leadership", "communication", "publications", "languages", "employment", "qualifications",
    "volunteer", "interests", "career", "background", "contact", "about",
)
SKILL_SECTION_WORDS = (
    "skill", "skills", "competenc", "expertise", "proficien", "key skills", "technical skills", "core competencies",
)
SKIPPED_TITLES = (
    "contact", "contact info", "contact information", "personal information", "personal details", "references",
    "personal references", "professional references", "education", "educational history", "academic background",
    "degrees", "educational background", "academic credentials", "languages", "language skills", "websites",
    "profiles", "links", "portfolio", "summary", "professional summary", "objective", "profile", "about me",
)
ORGANISATION_WORDS = (
    "inc", "corp", "co", "ltd", "llc", "company", "tech", "technologies", "university", "college", "school",
    "institute",
)
INSTITUTION_WORDS = ("university", "college", "school", "institute", "academy", "polytechnic")
DETECTOR_VERBS = (
    "developed", "built", "implemented", "led", "designed", "created", "improved", "managed", "architected",
    "deployed", "delivered", "collaborated", "optimized", "maintained", "integrated", "migrated", "automated",
    "reduced", "increased", "launched", "established", "coordinated", "analyzed", "analysed", "resolved", "supported",
    "mentored", "spearheaded", "streamlined", "facilitated", "engineered", "authored", "assisted", "participated",
    "conducted", "oversaw", "supervised", "directed", "administered", "operated", "executed", "planned", "monitored",
    "evaluated", "trained", "prepared", "produced",
)
CONNECTORS = (
    " to ", " for ", " with ", " using ", " by ", " in order to ", " through ", " across ", " within ", " on behalf of ",
)
MONTHS3 = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
DATE = rf"(?i)\b(19|20)[0-9]{{2}}\b|20[Xx]{{2}}|\b({MONTHS3})\b|\bpresent\b|[-–—]\s*(present|current)\b"
DATE_PARTS = rf"(?i)\b(19|20)[0-9]{{2}}\b|20[Xx]{{2}}|\b({MONTHS3})\w*\b|\bpresent\b|\bcurrent\b|[-–—/]|\bto\b"
BULLET_START = r"^(\s*[-•·–*●◦][ \t]|\s*[0-9]+[.)]\s)"
CONTACT = (
    r"^\+?[0-9][0-9\s().-]{6,}$", r"^[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_]{2,}$", r"(?i)^(https?://|www\.)\S+$",
    r"(?i)^(email|e-mail|phone|mobile|landline|tel|website|linkedin|github|twitter)\s*[:-]\s*\S",
)
DEGREE = (
    r"(?i)\b(b\.?s\.?|m\.?s\.?|b\.?a\.?|m\.?a\.?|ph\.?d\.?|m\.?b\.?a\.|b\.?sc\.?|m\.?sc\.?)\b",
    r"(?i)\b(bachelor|master|doctorate|diploma|associate)\s+(of|in|degree)\b|\b(bachelor|master|doctorate|diploma|associate)'?s\b|\bGPA\b|\bcoursework\b",
)
DQ_PENALTY = {
    "DUPLICATE_PARA_ID": 35, "SPLIT_BRAIN_BODY_PARAS": 25, "ROLE_BOUNDARY_CORRUPTION": 20, "CURRENT_DATE_LEAKAGE": 15,
    "EMPTY_SECTION_ID": 15, "EMPTY_PARA_ID": 30, "EXPERIENCE_NO_ROLES": 30,
}


def _set(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    return df.withColumns(cols)


def issue_flags(m: DataFrame, key: str) -> DataFrame:
    """Issues of a text and layout comparison as rows of a struct array, and the verdict."""
    def issue(cond: Column, kind: str, severity: str, delta: Column | None = None) -> Column:
        d = (delta if delta is not None else F.lit(None)).cast("double")
        return F.when(cond, F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), d.alias("delta")))

    heads = lambda n, kind, sev: F.transform(
        F.when(F.col(n) > 0, F.sequence(F.lit(1), F.col(n))).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.lit(kind).alias("type"), F.lit(sev).alias("severity"), F.lit(None).cast("double").alias("delta")),
    )
    first = F.array(issue(F.col("token_f1") < 0.90, "missing_text", "high"))
    rest = F.array(
        issue(F.col("bullet_delta") > 2, "bullet_count_mismatch", "medium", F.col("bullet_delta")),
        issue(~F.col("page_count_match"), "page_break_change", "high"),
        issue(~F.col("page_size_match"), "content_bbox_shift", "low"),
        issue(F.coalesce(F.col("indent_delta") > 0.020, F.lit(False)), "bullet_indent_error", "high", F.col("indent_delta")),
        issue(F.coalesce(F.col("gap_delta") > 0.020, F.lit(False)), "section_spacing_error", "medium", F.col("gap_delta")),
        issue(F.coalesce(F.col("shift_delta") > 0.060, F.lit(False)), "content_bbox_shift", "low", F.col("shift_delta")),
        issue((F.col("src_columns") != F.col("out_columns")) & (F.col("column_confidence") == "high"), "column_collapse", "high"),
    )
    d = m.withColumn("issues", F.array_compact(F.concat(
        first, heads("missing_headings", "heading_missing", "high"), heads("extra_headings", "heading_extra", "low"), rest)))
    return d.withColumn("verdict", F.when(F.exists("issues", lambda i: i["severity"] == "high"), "fail").otherwise("pass"))


THRESHOLD_DEFAULTS = {
    "min_layout_score": 0.40, "min_topology_preservation": 0.00, "min_section_placement": 0.00,
    "min_section_coherence": 0.40, "max_high_stress_sections": 6.0,
}


def threshold_check(results: DataFrame, cases: DataFrame, defaults: Mapping[str, float] = THRESHOLD_DEFAULTS) -> DataFrame:
    """Floors and ceilings each case breaks; a case's own limit beats the default.

    ``results`` has (case_id, layout, topology, placement, coherence, high_stress).
    """
    j = results.join(cases, "case_id", "left")
    lim = {k: F.coalesce(F.col(k).cast("double"), F.lit(v)) for k, v in defaults.items()}
    floor = lambda c, k, always=False: F.when((F.lit(always) | (lim[k] > 0)) & (F.col(c) < lim[k]), k)
    broken = F.array_compact(F.array(
        floor("layout", "min_layout_score", True), floor("topology", "min_topology_preservation"),
        floor("placement", "min_section_placement"), floor("coherence", "min_section_coherence"),
        F.when(F.col("high_stress") > lim["max_high_stress_sections"], "max_high_stress_sections"),
        F.when(F.col("layout") < 0.20, "catastrophic_floor"),
    ))
    return j.select("case_id", F.array_join(broken, ",").alias("broken"), (F.size(broken) == 0).alias("passed"))


def validate_scores(raw: DataFrame, key: str, col: str = "raw", required: Sequence[str] = tuple(SCORE_WEIGHTS)) -> DataFrame:
    """Errors of raw assessment JSON: each required score must be an integer from 1 to 10."""
    kind = lambda c: F.coalesce(F.schema_of_variant(c), F.lit("VOID"))
    # A value with a member is an object, so the costly schema of a whole object is asked for only where a member is missing.
    d = raw.withColumn("__v", F.try_parse_json(F.col(col))).withColumn("__s", F.try_variant_get("__v", "$.scores", "variant"))
    d = d.withColumns({f"__n{i}": F.try_variant_get("__s", f"$.{k}.score", "variant") for i, k in enumerate(required)})
    checks = []
    for i, k in enumerate(required):
        score, entry = F.col(f"__n{i}"), F.try_variant_get("__s", f"$.{k}", "variant")
        ok = score.isNotNull() & (kind(score) == "BIGINT") & F.try_variant_get(score, "$", "bigint").between(1, 10)
        checks.append(
            F.when(F.coalesce(ok, F.lit(False)), F.lit(None).cast("string")).when(score.isNotNull(), f"scores.{k}.score must be int 1-10")
            .when(entry.isNull(), f"missing score key: {k}").when(~kind(entry).startswith("OBJECT"), f"scores.{k} is not a dict")
            .otherwise(f"scores.{k}.score must be int 1-10")
        )
    scored = F.lit(False)
    for i in range(len(required)):
        scored = scored | F.col(f"__n{i}").isNotNull()
    errors = (
        F.when(F.col("__s").isNull() & ~kind(F.col("__v")).startswith("OBJECT"), F.array(F.lit("response is not a dict")))
        .when(F.col("__s").isNotNull() & ~scored & ~kind(F.col("__s")).startswith("OBJECT"), F.array(F.lit("scores is not a dict")))
        .otherwise(F.array_compact(F.array(*checks)))
    )
    return d.withColumn("errors", errors).select(
        key, F.array_join("errors", "; ").alias("errors"), F.size("errors").alias("n_errors"), (F.size("errors") == 0).alias("valid")
    )


def with_section_type(sections: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks with the ``section_type`` of their section, joined and written once for all that reads them afterwards."""
    return cut(_typed(sections, blocks))


def _typed(sections: DataFrame, blocks: DataFrame) -> DataFrame:
    if "section_type" in blocks.columns:
        return blocks
    return blocks.join(sections.select("doc_id", "section_id", F.col("semantic_type").alias("section_type")), ["doc_id", "section_id"])


def classification_rules(sections: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row per broken rule (doc_id, section_id, code, block_id), from the rule tables.

    ``blocks`` may come from :func:`with_section_type`; the sections are then not joined to them again.
    """
    spark = sections.sparkSession
    counts = blocks.groupBy("doc_id", "section_id").agg(
        F.count_if(F.col("grp") == "block").alias("nb"), F.count_if(F.col("grp") != "block").alias("nr")
    )
    some = lambda c: F.when(F.coalesce(c, F.lit(0)) > 0, "some").otherwise("empty")
    facts = F.array(*[
        F.struct(F.lit(a).alias("attribute"), v.alias("value"))
        for a, v in (
            ("rewrite_policy", F.coalesce("rewrite_policy", F.lit(""))),
            ("preserve_heading", F.coalesce(F.col("preserve_heading").cast("string"), F.lit(""))),
            ("preserve_body_structure", F.coalesce(F.col("preserve_body_structure").cast("string"), F.lit(""))),
            ("roles", some(F.col("nr"))), ("blocks", some(F.col("nb"))),
        )
    ])
    rules = rule_table(spark, SECTION_RULES, "semantic_type string, attribute string, required string, code string")
    s = sections.join(counts, ["doc_id", "section_id"], "left").select("doc_id", "section_id", "semantic_type", F.explode(facts).alias("f"))
    bad_section = (
        s.select("doc_id", "section_id", "semantic_type", "f.*").join(rules, ["semantic_type", "attribute"])
        .filter("value <> required").select("doc_id", "section_id", "code", F.lit("").alias("block_id"))
    )
    base = sections.select("doc_id", "section_id", "semantic_type")
    invalid = base.filter(~F.coalesce(F.col("semantic_type").isin(*VALID_TYPES), F.lit(False))).select(
        "doc_id", "section_id", F.lit("SEC_INVALID_SEMANTIC_TYPE").alias("code"), F.lit("").alias("block_id"))
    no_id = base.filter(F.coalesce("section_id", F.lit("")) == "").select(
        "doc_id", "section_id", F.lit("SEC_MISSING_SECTION_ID").alias("code"), F.lit("").alias("block_id"))
    groups = rule_table(spark, BLOCK_GROUPS, "section_type string, grp string, type_code string, policy_code string, new_code string, need string")
    types = rule_table(spark, BLOCK_TYPES, "section_type string, grp string, semantic_type string, own string")
    b = (
        _typed(sections, blocks).join(groups, ["section_type", "grp"])
        .join(types.withColumn("known", F.lit(True)), ["section_type", "grp", "semantic_type"], "left")
    )
    need = F.coalesce("need", "own")
    codes = F.array(
        F.when(F.col("known").isNull(), F.col("type_code")),
        F.when(need.isNotNull() & ~F.col("rewrite_policy").eqNullSafe(need), F.col("policy_code")),
        F.when(F.col("new_code").isNotNull() & F.coalesce("is_new", F.lit(True)), F.col("new_code")),
    )
    bad_block = b.select("doc_id", "section_id", F.explode(codes).alias("code"), "block_id").filter("code IS NOT NULL")
    return bad_section.unionByName(invalid).unionByName(no_id).unionByName(bad_block)


def missing_document_fields(docs: DataFrame) -> DataFrame:
    """Documents without an id, a source kind or a section list."""
    codes = F.array_compact(F.array(
        F.when(F.coalesce("document_id", F.lit("")) == "", "DOC_MISSING_DOCUMENT_ID"),
        F.when(F.coalesce("source_kind", F.lit("")) == "", "DOC_MISSING_SOURCE_KIND"),
        F.when(~F.coalesce("has_sections", F.lit(False)), "DOC_MISSING_SECTIONS"),
    ))
    return docs.select("doc_id", F.explode(codes).alias("code"))


GROUP_ORDER = {"block": 0, "header": 1, "meta": 2, "body": 3}


def _in_order(df: DataFrame) -> DataFrame:
    pos = F.lit(9)
    for g, i in GROUP_ORDER.items():
        pos = F.when(F.col("grp") == g, i).otherwise(pos)
    # Plain blocks first, then the roles one after the other.
    return df.withColumn("__at", F.struct(
        (F.col("grp") != "block").cast("int").alias("a"), F.coalesce("role_id", F.lit("")).alias("b"), pos.alias("c"), F.col("ord").alias("d")))


def _first_paras(blocks: DataFrame) -> DataFrame:
    """First block of every non-empty para id of a section, with its order."""
    return _in_order(blocks.filter(F.coalesce("para_id", F.lit("")) != "")).groupBy("doc_id", "section_id", "para_id").agg(
        F.min(F.struct("__at", "block_id", "semantic_type")).alias("f")
    ).select("doc_id", "section_id", "para_id", "f.*")


def downgrade_invalid(sections: DataFrame, blocks: DataFrame, errors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sections, blocks) with invalid sections turned into preserved ``other`` sections."""
    bad = cut(errors.select("doc_id", "section_id").distinct())
    flag = bad.withColumn("__bad", F.lit(True))
    s = sections.join(flag, ["doc_id", "section_id"], "left").withColumn("__bad", F.coalesce("__bad", F.lit(False)))
    swap = lambda c, v: F.when(F.col("__bad"), F.lit(v)).otherwise(F.col(c))
    s = _set(s, {
        "semantic_type": swap("semantic_type", "other"), "rewrite_policy": swap("rewrite_policy", "preserve"),
        "preserve_heading": swap("preserve_heading", True), "preserve_body_structure": swap("preserve_body_structure", True),
    }).withColumnRenamed("__bad", "downgraded")
    first = _first_paras(blocks.join(bad, ["doc_id", "section_id"], "left_semi"))
    ranked = ordered_scan(
        first, ["doc_id", "section_id"], ["__at", "para_id"], ["__at.a", "__at.b", "__at.c", F.floor(F.col("__at.d") / 1024)], [rank_in("n")])
    new = ranked.select(
        "doc_id", "section_id", F.lit("").alias("role_id"), F.lit("block").alias("grp"), F.col("n").alias("ord"),
        F.coalesce(F.nullif("block_id", F.lit("")), F.concat(F.lit("blk_"), F.when(F.col("n") < 1000, F.lpad(F.col("n").cast("string"), 3, "0")).otherwise(F.col("n").cast("string")))).alias("block_id"),
        "para_id", F.lit("other_paragraph").alias("semantic_type"), F.lit("preserve").alias("rewrite_policy"), F.lit(False).alias("is_new"),
    )
    kept = blocks.join(bad, ["doc_id", "section_id"], "left_anti").select(*new.columns)
    return s, kept.unionByName(new)


def autocorrect_blocks(sections: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sections, blocks) with education, experience and projects forced into shape.

    ``blocks`` may come from :func:`with_section_type` and keep their ``section_type`` then.
    """
    st = F.col("semantic_type")
    exp, proj = st == "experience", st == "projects"
    s = _set(sections, {
        "rewrite_policy": F.when(exp, "rewrite_bullets_only").when(proj, "preserve").otherwise(F.col("rewrite_policy")),
        "preserve_heading": exp | F.col("preserve_heading"), "preserve_body_structure": exp | F.col("preserve_body_structure"),
    })
    cols = blocks.columns
    b = _typed(sections, blocks)
    sec, grp, bt = F.col("section_type"), F.col("grp"), F.col("semantic_type")
    b = b.filter(~((sec == "experience") & (grp == "block")))
    edu = (sec == "education") & (grp == "block") & bt.isin(*WRONG_IN_EDUCATION)
    e_head, e_meta, e_body = [(sec == "experience") & (grp == g) for g in ("header", "meta", "body")]
    known = bt.isin(*REWRITEABLE_BODY, *PRESERVED_BODY)
    fixed = _set(b.filter("section_type <> 'projects'"), {
        "rewrite_policy": F.when(edu | e_head | e_meta, "preserve").when(e_body & bt.isin(*PRESERVED_BODY), "preserve")
        .when(e_body, "rewrite_text").otherwise(F.col("rewrite_policy")),
        "semantic_type": F.when(edu, "education_entry").when(e_head, "role_header").when(e_meta, "role_meta")
        .when(e_body & ~known, "role_achievement_bullet").otherwise(bt),
    }).select(*cols)
    p = b.filter("section_type = 'projects'")
    once = _in_order(p).groupBy("doc_id", "section_id", F.coalesce("para_id", F.lit("")).alias("para_id")).agg(
        F.min(F.struct("__at", "block_id", "semantic_type", "is_new")).alias("f"))
    merged = ordered_scan(
        once.select("doc_id", "section_id", "para_id", "f.*"), ["doc_id", "section_id"], ["__at", "para_id"],
        ["__at.a", "__at.b", "__at.c", F.floor(F.col("__at.d") / 1024)], [rank_in("n")])
    flat = merged.select(
        "doc_id", "section_id", F.lit("").alias("role_id"), F.lit("block").alias("grp"), F.col("n").alias("ord"), "block_id", "para_id",
        F.when(bt.isin("project_entry", "other_paragraph"), bt).otherwise("project_entry").alias("semantic_type"),
        F.lit("preserve").alias("rewrite_policy"), "is_new", F.lit("projects").alias("section_type"),
    )
    return s, fixed.unionByName(flat.select(*cols))


def merge_repaired(current: DataFrame, repaired: DataFrame, invalid: DataFrame) -> DataFrame:
    """Rows of invalid sections replaced by their repaired rows; other repairs are ignored."""
    keys = ["doc_id", "section_id"]
    usable = repaired.join(invalid.select(*keys).distinct(), keys, "left_semi")
    return current.join(usable.select(*keys).distinct(), keys, "left_anti").unionByName(usable.select(*current.columns))


def repair_status(docs: DataFrame, before: DataFrame, after: DataFrame, repaired: DataFrame) -> DataFrame:
    """Outcome per document from invalid sections before and after, and whether a repair exists."""
    n = lambda e, c: e.select("doc_id", "section_id").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias(c))
    has = repaired.select("doc_id").distinct().withColumn("has_repair", F.lit(True))
    j = docs.select("doc_id").join(n(before, "n_before"), "doc_id", "left").join(n(after, "n_after"), "doc_id", "left").join(has, "doc_id", "left")
    j = _set(j, {"n_before": F.coalesce("n_before", F.lit(0)), "n_after": F.coalesce("n_after", F.lit(0)), "has_repair": F.coalesce("has_repair", F.lit(False))})
    left = F.when(F.col("has_repair"), F.col("n_after")).otherwise(F.col("n_before"))
    return j.select(
        "doc_id", "n_before", left.alias("n_after"), (F.col("n_before") - left).alias("repaired_count"), left.alias("downgraded_count"),
        F.when(F.col("n_before") == 0, "valid").when(~F.col("has_repair"), "downgraded").when(left == 0, "repaired")
        .otherwise("repaired_and_downgraded").alias("status"),
    )


def classification_report(docs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts and shares of repair outcomes; docs have (doc_id, status, n_before)."""
    g = docs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("n_before") == 0).alias("initial_valid"),
        F.count_if(F.col("status") == "repaired").alias("repaired"),
        F.count_if(F.col("status") == "repaired_and_downgraded").alias("repair_partial"),
        F.count_if(F.col("status") == "downgraded").alias("downgrade_only"), F.count_if(F.col("status") == "valid").alias("valid"),
    )
    g = g.withColumns({
        "downgraded": F.col("repair_partial") + F.col("downgrade_only"), "final_valid": F.col("valid") + F.col("repaired"),
        "weak_initially": F.col("documents") - F.col("initial_valid"),
    })
    pct = lambda c: (F.floor((F.col(c) * 2000 + F.col("documents")) / (F.col("documents") * 2)) / 10).alias(f"{c}_pct")
    return g.select("*", *[pct(c) for c in ("initial_valid", "repaired", "downgraded", "final_valid")])


def experience_title(c: Column) -> Column:
    """Whether a title names experience, after numbering or letter spacing is removed."""
    low = F.lower(t.strip(c))
    bare = F.regexp_replace(low, r"^[0-9]+\.\s+|^[ivxl]+\.\s+", "")
    return low.isin(*EXPERIENCE_TITLES) | bare.isin(*EXPERIENCE_TITLES) | t.unspaced(low).isin(*EXPERIENCE_TITLES)


def contact_line(c: Column) -> Column:
    s = t.strip(c)
    out = F.lit(False)
    for p in CONTACT:
        out = out | s.rlike(p)
    return out


def education_line(c: Column) -> Column:
    s = t.strip(c)
    first = F.regexp_extract(F.lower(s), "^([a-z0-9_]*)", 1)
    return (s != "") & ~s.contains("|") & ~first.isin(*DETECTOR_VERBS) & (s.rlike(DEGREE[0]) | s.rlike(DEGREE[1]))


def skills_list_line(c: Column) -> Column:
    """Strict test for a list of skills: exclusions first, then one list signal."""
    s = t.strip(c)
    low = F.lower(s)
    tok = F.split(s, r"\s+")
    n = F.size(tok)
    first = F.regexp_extract(low, "^([a-z0-9_]*)", 1)
    ends = s.rlike("[.!?]$")
    caps = F.size(F.filter(tok, lambda w: w.rlike(r"^\p{Lu}"))) == n
    seps = F.regexp_count(s, F.lit("[,;]"))
    out = (n < 4) | (F.length(s) < 20) | s.rlike(DATE) | contact_line(s) | first.isin(*DETECTOR_VERBS) | ((n >= 8) & ends)
    out = out | t.any_of(low, CONNECTORS) | t.any_of(low, INSTITUTION_WORDS) | ((n <= 4) & (seps == 0) & caps)
    return ~out & ((seps >= 2) | ((n >= 6) & ~ends))


def diagnostic_detectors(docs: DataFrame, sections: DataFrame, paras: DataFrame, members: DataFrame) -> DataFrame:
    """(doc_id, code, section_id, para_id, role_id): findings of the seventeen detectors.

    ``docs`` has (doc_id, label_column_fixed, table_layout_fixed, table_layout_aborted).
    """
    sec = cut(sections.select("doc_id", "section_id", "raw_title", "semantic_type", experience_title(F.col("raw_title")).alias("is_exp")))
    key = ["doc_id", "section_id"]
    p = cut(paras.select(*key, "para_id", "ord", "text", "parser_semantic").join(sec, key)).withColumns({"s": t.strip(F.col("text"))})
    mem = cut(members.select(*key, "role_id", "kind", "para_id"))
    roles = cut(mem.groupBy(*key, "role_id").agg(
        F.count_if(F.col("kind") == "header").alias("headers"), F.count_if(F.col("kind") == "bullet").alias("bullets")).join(sec, key))

    def found(df: DataFrame, code: str | Column) -> DataFrame:
        have = df.columns
        opt = lambda c: F.col(c) if c in have else F.lit("")
        code = F.lit(code) if isinstance(code, str) else code
        return df.select("doc_id", code.alias("code"), opt("section_id").alias("section_id"), opt("para_id").alias("para_id"), opt("role_id").alias("role_id"))

    def each(df: DataFrame, tests: Mapping[str, Column]) -> DataFrame:
        """The rows once for every test they meet, from one pass over them."""
        met = F.lit(False)
        for c in tests.values():
            met = met | c
        return found(df.filter(met), F.explode(F.array(*[F.when(c, code) for code, c in tests.items()]))).filter("code IS NOT NULL")

    low = F.lower(F.col("s"))
    upper = F.col("s").rlike(r"^\p{Lu}")
    paragraph = F.col("parser_semantic") == "paragraph"
    with_roles = roles.select(*key).distinct()
    words = F.array_distinct(F.filter(F.split(low, r"[\s/&,]+"), lambda w: w != ""))
    in_skills = t.any_of(F.lower("raw_title"), SKILL_SECTION_WORDS)
    title = F.lower(t.strip(F.col("raw_title")))
    multi = docs.filter(F.col("table_layout_fixed") | F.col("table_layout_aborted")).select("doc_id")
    text_of = p.select("doc_id", "para_id", F.col("text").alias("member_text"), "parser_semantic")
    heads = mem.filter("kind = 'header'").join(text_of, ["doc_id", "para_id"])
    rest = F.filter(F.split(F.regexp_replace("member_text", DATE_PARTS, " "), r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin("and", "AND", "the", "THE"))
    inside = (
        mem.filter("kind = 'bullet'").join(sec.filter("is_exp").select(*key), key, "left_semi")
        .join(p.filter("parser_semantic = 'role_meta'").select(*key, "para_id"), [*key, "para_id"])
        .groupBy(*key, "role_id").agg(F.count(F.lit(1)).alias("metas"))
    )
    # Both tests of an orphan come before the join, which then sees few rows.
    orphans = p.filter(F.col("is_exp") & paragraph & (contact_line(F.col("s")) | education_line(F.col("s")))).join(mem.filter("para_id <> ''").select(*key, "para_id").distinct(), [*key, "para_id"], "left_anti")
    certs = p.filter((F.col("semantic_type") == "certifications") & (F.col("parser_semantic") != "section_heading"))
    plain = ~t.any_of(F.lower("raw_title"), ("skill", "technical", "expertise"))
    certs = cut(certs.filter(plain & skills_list_line(F.col("s"))).join(multi, "doc_id", "left_semi").select(*key, "para_id"))
    skills = found(certs, "TABLE_SKILLS_INSIDE_NON_SKILLS_SECTION")
    umbrella = found(certs.select(*key).distinct(), "TABLE_COLUMN_CONTAMINATION_SUSPECTED")
    body = p.filter("s <> ''").groupBy(*key, "raw_title", "is_exp").agg(F.count(F.lit(1)).alias("n"), F.max_by("text", F.struct("ord", "para_id")).alias("last"))
    org_words = F.split(title, "[^a-z0-9_]+")
    orgs = body.filter(~F.col("is_exp") & F.col("n").between(1, 3) & ~title.isin(*KNOWN_HEADINGS, *SKIPPED_TITLES) & F.col("last").rlike(DATE)
                       & F.arrays_overlap(org_words, F.array(*[F.lit(w) for w in ORGANISATION_WORDS]))).join(with_roles, key, "left_anti")
    return union_all(
        found(sec.filter("is_exp").join(with_roles, key, "left_anti"), "EXPERIENCE_NO_ROLES"),
        each(p, {
            "MERGED_SECTION_SUSPECTED": F.col("is_exp") & F.col("parser_semantic").isin("section_heading", "paragraph", "role_header") & upper
            & low.isin(*KNOWN_HEADINGS) & ~low.isin(*EXPERIENCE_TITLES),
            "HEADING_NOT_RECOGNIZED": paragraph & (F.col("s") != "") & (F.length("s") <= 60) & upper & low.isin(*KNOWN_HEADINGS)
            & F.arrays_overlap(words, F.array(*[F.lit(w) for w in HEADING_TRIGGERS])) & ~(in_skills & (F.size(words) == 1)),
            "BULLET_NOT_RECOGNIZED": ~F.col("parser_semantic").isin("bullet", "section_heading", "role_header") & F.col("text").rlike(BULLET_START),
        }),
        found(heads.filter(F.col("member_text").rlike(DATE) & (F.size(rest) < 2)), "ROLE_HEADER_CONTAINS_DATE"),
        found(inside, "EXPERIENCE_ROLE_BOUNDARY_INSIDE_BULLETS"),
        found(inside.filter("metas >= 2").join(roles.filter("bullets >= 15").select(*key, "role_id"), [*key, "role_id"]), "EXPERIENCE_OVERMERGED_ROLE"),
        found(roles.filter("headers >= 2 AND bullets = 0"), "ROLE_GROUPING_WEAK"),
        found(with_roles.join(sec.filter("NOT is_exp"), key), "ROLE_LIKE_GROUPING_NON_EXPERIENCE"),
        found(docs.filter("label_column_fixed"), "LABEL_COLUMN_DETECTED"),
        found(docs.filter("table_layout_fixed"), "TABLE_COLUMN_LAYOUT_DETECTED"),
        found(docs.filter("table_layout_aborted AND NOT table_layout_fixed"), "TABLE_COLUMN_REORDER_ABORTED"),
        each(orphans, {"TABLE_CONTACT_INSIDE_EXPERIENCE": contact_line(F.col("s")), "TABLE_EDUCATION_INSIDE_EXPERIENCE": education_line(F.col("s"))}),
        skills, suppress_covered(umbrella, skills, key), found(orgs, "TABLE_ORG_NAME_PROMOTED_TO_FAKE_SECTION"),
    )


def union_all(*dfs: DataFrame) -> DataFrame:
    """Rule outputs or folders as one table, matched by name."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def suppress_covered(umbrella: DataFrame, specific: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Umbrella issues of places that carry no specific issue."""
    return umbrella.join(specific.select(*keys).distinct(), list(keys), "left_anti")


def diagnostics_rollup(docs: DataFrame, issues: DataFrame) -> DataFrame:
    """Scores, status and severity per document."""
    codes = rule_table(docs.sparkSession, ISSUE_CODES, "code string, category string, weight int, severity string")
    a, b = F.col("category") == "A", F.col("category") == "B"
    g = issues.join(codes, "code").groupBy("doc_id").agg(
        F.count_if(a).alias("na"), F.count_if(b).alias("nb"), F.sum(F.when(a, F.col("weight")).otherwise(0)).alias("parser_issue_score"),
        F.sum(F.when(b, F.col("weight")).otherwise(0)).alias("info_score"), F.max(a & (F.col("severity") == "high")).alias("high"),
    )
    j = docs.select("doc_id").join(g, "doc_id", "left")
    na, nb = F.coalesce("na", F.lit(0)), F.coalesce("nb", F.lit(0))
    return j.select(
        "doc_id", F.coalesce("parser_issue_score", F.lit(0)).alias("parser_issue_score"), F.coalesce("info_score", F.lit(0)).alias("info_score"),
        F.when(na > 0, "parser_issue").when(nb > 0, "clean_with_info").otherwise("clean").alias("status"),
        F.when((na > 0) & F.col("high"), "high").when(na > 0, "medium").when(nb > 0, "info").otherwise("none").alias("severity"),
    )


def health_status(rollup: DataFrame) -> DataFrame:
    """One row: document counts by status, total scores and overall health."""
    g = rollup.agg(
        F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("status") == "clean").alias("clean"),
        F.count_if(F.col("status") == "clean_with_info").alias("clean_with_info"), F.count_if(F.col("status") == "parser_issue").alias("parser_issue"),
        F.sum("parser_issue_score").alias("parser_issue_score"), F.sum("info_score").alias("info_score"),
    )
    n, k = F.col("scanned"), F.col("parser_issue")
    return g.withColumn("health", F.when(k == 0, "ok").when(k * 100 < n * 15, "warning").when(k * 100 < n * 30, "degraded").otherwise("critical"))


def document_dq(paras: DataFrame, sections: DataFrame) -> DataFrame:
    """Structural codes and score per document.

    ``paras`` has (doc_id, section_id, para_id, text, place, semantic) with place
    in body / header / meta / bullet; ``sections`` has (doc_id, section_id,
    semantic_type).
    """
    s = t.strip(F.col("text"))
    pid = F.coalesce("para_id", F.lit(""))
    low = F.lower(F.col("text"))
    p = paras.join(sections.select("doc_id", "section_id", "semantic_type"), ["doc_id", "section_id"])
    exp = F.col("semantic_type") == "experience"
    flags = p.groupBy("doc_id").agg(
        F.max((s != "") & (pid == "")).alias("EMPTY_PARA_ID"),
        F.max(low.contains("current date") | low.contains("currentdate")).alias("CURRENT_DATE_LEAKAGE"),
        F.max(exp & (F.col("place") == "bullet") & F.col("semantic").isin("role_header", "section_heading")).alias("ROLE_BOUNDARY_CORRUPTION"),
        F.count_if((s != "") & (pid == "")).alias("empty_para_ids"),
    )
    dup = p.filter(pid != "").groupBy("doc_id", "para_id").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id").agg((F.max("n") > 1).alias("DUPLICATE_PARA_ID"))
    both = p.filter(exp & (pid != "")).groupBy("doc_id", "section_id", "para_id").agg(
        F.max(F.col("place") == "body").alias("b"), F.max(F.col("place") != "body").alias("r")
    ).groupBy("doc_id").agg(F.max(F.col("b") & F.col("r")).alias("SPLIT_BRAIN_BODY_PARAS"))
    content = p.groupBy("doc_id", "section_id").agg(
        F.max(F.col("place") != "body").alias("roles"), F.max((F.col("place") == "body") & (s != "")).alias("body"))
    sec = sections.join(content, ["doc_id", "section_id"], "left").groupBy("doc_id").agg(
        F.max(F.coalesce("section_id", F.lit("")) == "").alias("EMPTY_SECTION_ID"),
        F.max(exp & ~F.coalesce("roles", F.lit(False)) & ~F.coalesce("body", F.lit(False))).alias("EXPERIENCE_NO_ROLES"),
    )
    j = sec
    for d in (flags, dup, both):
        j = j.join(d, "doc_id", "left")
    order = ("EMPTY_PARA_ID", "DUPLICATE_PARA_ID", "EMPTY_SECTION_ID", "EXPERIENCE_NO_ROLES", "SPLIT_BRAIN_BODY_PARAS", "ROLE_BOUNDARY_CORRUPTION", "CURRENT_DATE_LEAKAGE")
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    penalty = F.lit(0)
    for c in order:
        penalty = penalty + F.when(on(c), DQ_PENALTY[c]).otherwise(0)
    return j.select(
        "doc_id", F.array_join(F.array_compact(F.array(*[F.when(on(c), c) for c in order])), ",").alias("failures"),
        F.greatest(F.lit(0), 100 - penalty).alias("score"), on("EXPERIENCE_NO_ROLES").alias("hard_fail"),
        F.coalesce("empty_para_ids", F.lit(0)).alias("empty_para_ids"),
    )


def health_violations(counts: Mapping[str, DataFrame], docs: DataFrame, soft: Sequence[str] = ()) -> DataFrame:
    """Per document the count of every violation, their hard total and the verdict.

    ``counts`` maps a violation to rows (doc_id, n); all are added up in one grouping.
    """
    every = union_all(*[d.select("doc_id", F.lit(k).alias("rule"), F.col("n").cast("long").alias("n")) for k, d in counts.items()])
    g = every.groupBy("doc_id").agg(*[F.sum(F.when(F.col("rule") == k, F.col("n")).otherwise(0)).alias(k) for k in counts])
    j = docs.select("doc_id").join(g, "doc_id", "left").select("doc_id", *[F.coalesce(k, F.lit(0)).alias(k) for k in counts])
    total = F.lit(0)
    for k in counts:
        if k not in soft:
            total = total + F.col(k)
    return j.withColumn("hard_violations", total).withColumn("healthy", F.col("hard_violations") == 0)
