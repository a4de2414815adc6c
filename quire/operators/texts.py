"""Corpus jobs over text: each takes a table and returns the transformed table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import lexicons as L
from quire.functions import text as t
from quire.plans import hot_keys, lag1, lead1, ordered_scan, rule_table


def with_change(df: DataFrame, text: str, new: Column, out: str = "clean") -> DataFrame:
    """``out`` next to a flag telling whether it differs from ``text``."""
    return df.withColumn(out, new).withColumn("changed", ~F.col(out).eqNullSafe(F.col(text)))


def clean_text_corpus(df: DataFrame, text: str = "text") -> DataFrame:
    return with_change(df, text, t.clean_text(F.col(text)))


def unicode_cleanup(df: DataFrame, text: str = "text") -> DataFrame:
    return with_change(df, text, t.unicode_cleanup(F.col(text)))


def change_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many rows a transform changed, per ``keys``."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("changed").alias("changed_rows"),
    )


def heading_names(spark) -> DataFrame:
    """Known heading names and their type (fixed size)."""
    rows = [(n, k) for k, names in L.NAMES_BY_TYPE.items() for n in names]
    return rule_table(spark, rows, "name string, section_type string")


def heading_keys(df: DataFrame, heading: str) -> DataFrame:
    """Both heading keys, the canonical section of the alias key, and the letter-spaced form."""
    rows = [(a, k) for k, names in L.SECTION_ALIASES.items() for a in names]
    aliases = rule_table(df.sparkSession, rows, "key_b string, canonical string")
    keyed = df.withColumns({
        "key_a": t.heading_key(F.col(heading)), "key_b": t.alias_key(F.col(heading)),
        "unspaced": t.unspaced(F.col(heading)),
    })
    return keyed.join(aliases, "key_b", "left").withColumn(
        "known_section", F.col("key_a").isin(*L.KNOWN_SECTION_KEYS)
    )


def classify_heading(df: DataFrame, heading: str, out: str = "section_type") -> DataFrame:
    """Section type of a heading, plain or letter-spaced; null when not a known name."""
    names = heading_names(df.sparkSession)
    plain = names.select(F.col("name").alias("__p"), F.col("section_type").alias("__pt"))
    spaced = names.select(F.col("name").alias("__s"), F.col("section_type").alias("__st"))
    return (
        df.withColumns({"__p": F.lower(t.strip(F.col(heading))), "__s": t.unspaced(t.strip(F.col(heading)))})
        .join(F.broadcast(plain), "__p", "left").join(F.broadcast(spaced), "__s", "left")
        .withColumn(out, F.coalesce("__pt", "__st")).drop("__p", "__s", "__pt", "__st")
    )


def split_glued_headings(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines with fused headings divided (``part`` 1 and 2) and current-date lines dropped."""
    s = t.strip(F.col(line))
    parts = lines.filter(~F.col(line).rlike(L.CURRENT_DATE_LINE)).withColumns({
        "__head": t.strip(F.regexp_extract(s, L.GLUED_HEADING, 1)),
        "__tail": F.regexp_extract(s, L.GLUED_HEADING, 2),
    })
    known = classify_heading(parts, "__head", "__type")
    glued = F.col("__type").isNotNull() & (F.col("__type") != "summary") & (F.col("__head") != "")
    pieces = F.when(glued, F.array("__head", "__tail")).otherwise(F.array(line))
    return known.select(
        *[c for c in lines.columns if c != line], F.posexplode(pieces).alias("part", line)
    ).withColumn("part", F.col("part") + 1)


def contact_extraction(df: DataFrame, text: str = "text") -> DataFrame:
    """First e-mail, phone of the head, profile links, best-effort name and summary snippet."""
    c = F.col(text)
    first = lambda p, x: F.regexp_extract(x, f"({p})" if not p.startswith("(?i)") else f"(?i)({p[4:]})", 1)
    return df.withColumns({
        "email": first(L.EMAIL, c),
        "phone": t.strip(first(L.PHONE, F.left(c, F.lit(500)))),
        "linkedin": first(L.LINKEDIN, c),
        "github": first(L.GITHUB, c),
        "name": t.person_name(c),
        "summary": t.summary_snippet(c),
    })


def date_signals(df: DataFrame, line: str = "line") -> DataFrame:
    """Year, date-line, range and open-ended signals of a line, with its year signature."""
    c = F.col(line)
    y = t.years(c)
    return df.withColumns({
        "has_year": F.size(y) > 0,
        "is_date_line": (F.size(y) > 0) & ~c.contains("|") & (F.length(t.strip(c)) < 60),
        "is_range": c.rlike(L.DATE_LINE),
        "open_ended": F.lower(c).contains("present") | F.lower(c).contains("current"),
        "min_year": F.coalesce(F.array_min(y), F.lit(0)),
        "max_year": F.coalesce(F.array_max(y), F.lit(0)),
    })


def replace_fields(
    df: DataFrame, text: str, template_company: str, template_title: str, company: str, title: str, date: Column,
) -> DataFrame:
    """Letter text with every date, the template company and the template title replaced."""
    c = F.regexp_replace(F.col(text), F.lit(L.LETTER_DATE), date)
    c = F.replace(c, F.lit(template_company), F.col(company))
    c = F.replace(c, F.lit(template_title), F.col(title))
    return df.withColumn("letter", c)


def hash_keys(df: DataFrame, text: str = "text") -> DataFrame:
    """sha256 of the canonical text."""
    return df.withColumn("text_hash", F.sha2(t.canonical_text(F.col(text)), 256))


def parse_fenced_json(df: DataFrame, raw: str, schema: str) -> DataFrame:
    """Parsed payload of possibly fenced JSON; ``rejected`` marks rows that do not parse."""
    body = t.strip_code_fence(F.col(raw))
    one = F.concat(F.lit("["), body, F.lit("]"))  # the parser alone would accept trailing text
    fine = F.try_parse_json(one).isNotNull() & (F.json_array_length(one) == 1)
    return df.withColumns({"body": body, "rejected": ~F.coalesce(fine, F.lit(False))}).withColumn(
        "payload", F.from_json("body", schema)
    )


def letter_paragraphs(df: DataFrame, text: str = "text") -> DataFrame:
    """Body paragraphs after the salutation (line start, else anywhere, else all)."""
    norm = F.regexp_replace(F.col(text), r"\r\n?", "\n")
    lines = F.split(norm, "\n")
    d = df.withColumn("__lines", lines).withColumns({
        "__a": t.first_at(F.transform("__lines", lambda x: t.strip(x).rlike(r"(?i)^Dear\b"))),
        "__b": t.first_at(F.transform("__lines", lambda x: x.rlike(r"(?i)\bDear\b"))),
    })
    start = F.when(F.col("__a") > 0, F.col("__a")).otherwise(F.col("__b"))
    body = t.strip(F.array_join(F.slice("__lines", start + 1, F.size("__lines")), "\n"))
    paras = F.filter(F.transform(F.split(F.regexp_replace(body, r"\n{3,}", "\n\n"), "\n\n"), t.strip), lambda p: p != "")
    return d.withColumn("paragraphs", paras).drop("__lines", "__a", "__b")


def collapse_letter(df: DataFrame, text: str = "text") -> DataFrame:
    """Letter text without blank lines, but one before the closing."""
    d = df.withColumn("__lines", F.split(text, "\n")).withColumn(
        "__c", t.first_at(F.transform("__lines", lambda x: F.lower(t.strip(x)).startswith("sincerely")))
    )
    live = lambda a: F.filter(a, lambda x: t.strip(x) != "")
    head = live(F.slice("__lines", F.lit(1), F.greatest(F.col("__c") - 1, F.lit(0))))
    tail = live(F.slice("__lines", F.greatest(F.col("__c"), F.lit(1)), F.size("__lines")))
    return d.withColumn(
        "letter",
        F.when(F.col("__c") == 0, F.array_join(live(F.col("__lines")), "\n"))
        .otherwise(F.concat(F.array_join(head, "\n"), F.lit("\n\n"), F.array_join(tail, "\n"))),
    ).drop("__lines", "__c")


def span_ledger(letters: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Where each required span first occurs: ``paragraph[n]`` or ``missing``."""
    j = letters.select(key, "paragraphs").join(spans, key)
    at = t.first_at(F.transform("paragraphs", lambda p: p.contains(F.col("span"))))
    return j.select(
        key, "proof_id", F.when(at > 0, F.col("span")).otherwise("").alias("exact_span"),
        F.when(at > 0, F.concat(F.lit("paragraph["), at, F.lit("]"))).otherwise("missing").alias("location"),
    )


def bridge_sentence(letters: DataFrame, key: str, prefix: str) -> DataFrame:
    """The sentence starting with ``prefix`` (any case) and its paragraph."""
    at = t.first_at(F.transform("paragraphs", lambda p: F.lower(p).contains(prefix)))
    para = F.get("paragraphs", at - 1)
    rest = F.substr(para, F.instr(F.lower(para), prefix))
    return letters.select(
        key, F.when(at > 0, t.strip(F.regexp_extract(rest, r"(?s)^([^.!]*[.!]?)", 1))).otherwise("").alias("exact_span"),
        F.when(at > 0, F.concat(F.lit("paragraph["), at, F.lit("]"))).otherwise("missing").alias("location"),
    )


def letter_structure(df: DataFrame, text: str = "text") -> DataFrame:
    """Body paragraph count of each letter, flagged when it is not 3 or 4."""
    lines = F.split(F.regexp_replace(F.col(text), r"\r\n?", "\n"), "\n")
    at = t.first_at(F.transform(lines, lambda x: x.rlike(r"(?i)^\s*Dear\b")))
    body = F.array_join(F.slice(lines, at + 1, F.size(lines)), "\n")
    n = F.size(F.filter(F.split(body, r"\n{2,}"), lambda p: t.strip(p) != ""))
    return df.withColumn("paragraph_count", n).withColumn("off", (F.col("paragraph_count") < 3) | (F.col("paragraph_count") > 4))


def label_split(df: DataFrame, line: str = "line") -> DataFrame:
    """Skill lines with the sub-kind of their label and the value after it.

    A ``Languages:`` line naming programming languages without proficiency words
    stays a skill line.
    """
    s = t.strip(F.col(line))
    kind = F.lit("")
    value = F.col(line)
    for name, pattern in reversed(list(L.LABEL_PATTERNS.items())):
        kind = F.when(s.rlike(pattern), name).otherwise(kind)
        value = F.when(s.rlike(pattern), t.strip(F.regexp_replace(s, pattern, ""))).otherwise(value)
    stays = (kind == "languages") & s.rlike(L.PROGRAMMING_LANGUAGE) & ~s.rlike(L.PROFICIENCY)
    return df.withColumns({
        "subkind": F.when(stays, "").otherwise(kind), "value": F.when(stays, F.col(line)).otherwise(value),
    })


def leakage(df: DataFrame, text: str = "text") -> DataFrame:
    """Internal markers, their penalty, verbatim markers, and placeholder hard fails."""
    c = F.col(text)
    low = F.lower(c)
    parts = F.split(low, r"\s+")
    lorem = low.contains("lorem ipsum") | (F.array_contains(parts, "lorem") & F.array_contains(parts, "ipsum"))
    return df.withColumns({
        "markers": t.contains_marker(c),
        "verbatim_marker": t.any_of(c, L.INTERNAL_MARKERS),
        "placeholder": t.any_of(low, L.PLACEHOLDERS),
        "hard_fail": lorem,
    }).withColumn("penalty", F.least(F.lit(1.0), F.col("markers") * 0.25))


def contacts_complete(df: DataFrame, email: str = "email", phone: str = "phone") -> DataFrame:
    return df.withColumn("complete", ~t.blank(F.col(email)) & ~t.blank(F.col(phone)))


def parse_status(df: DataFrame) -> DataFrame:
    """Company and title without placeholders, and the parse status that follows."""
    clean = lambda c: F.when(t.blank(F.col(c)) | (F.lower(t.strip(F.col(c))) == "unknown"), None).otherwise(t.strip(F.col(c)))
    d = df.withColumns({"company": clean("company"), "job_title": clean("job_title")})
    return d.withColumn(
        "parse_status",
        F.when(F.col("source_type") == "manual", "manual")
        .when(F.col("company").isNotNull() & F.col("job_title").isNotNull(), "ok").otherwise("partial"),
    )


def artifact_prefix(paras: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document the one- or two-character prefix that recurs as an extraction artefact.

    It must occur 3 times and in 20 % of the eligible paragraphs, and leave at
    least 3 characters each time; upper-case letters and common words are out.
    """
    elig = paras.filter(
        ~F.col("parser_semantic").isin("section_heading", "empty") & (F.length(t.strip(F.col(text))) >= 4)
    ).select(doc, "ord", t.strip(F.col(text)).alias("__t"))
    pre = lambda n: F.when(F.substring("__t", n + 1, 1) == " ", F.substring("__t", 1, n + 1))
    found = elig.withColumn("prefix", F.explode(F.array_compact(F.array(pre(1), pre(2)))))
    stats = found.groupBy(doc, "prefix").agg(
        F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"),
        F.min(F.length("__t") - F.length("prefix")).alias("least_rest"),
    )
    totals = elig.groupBy(doc).agg(F.count(F.lit(1)).alias("eligible"))
    p = F.rtrim("prefix")
    bad = ((F.length(p) == 1) & p.rlike(r"^\p{Lu}$")) | ((F.length(p) == 2) & p.rlike(r"^\p{L}+$") & F.lower(p).isin(*L.COMMON_PREFIX_WORDS))
    ok = stats.join(totals, doc).filter(
        (F.col("eligible") >= 3) & (F.col("n") >= 3) & (F.col("n") * 5 >= F.col("eligible")) & ~bad
        & (F.length(p) >= 1) & (F.col("least_rest") >= 3)
    )
    return ok.groupBy(doc).agg(
        F.max_by(F.struct("prefix", "n"), F.struct(F.col("n"), -F.col("first_ord"), -F.length("prefix"))).alias("r")
    ).select(doc, "r.*")


def paragraph_cleanup(paras: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Link artefacts, then the document's artefact prefix, then a leading glyph; stage per change."""
    pref = artifact_prefix(paras, doc, text).select(doc, "prefix")
    d = paras.join(pref, doc, "left").withColumn("__t", t.strip(F.col(text)))
    s, p = F.col("__t"), F.col("prefix")
    solo = F.lower(s).isin("a link", "a link.", "link")
    link = s.rlike(r"(?i)^a\s+link\s*")
    hit = F.coalesce(s.startswith(p), F.lit(False))
    glyph = (F.col("parser_semantic") == "paragraph") & s.rlike(r"^[•◦▪▸●►▶·]\s+.*\S")
    d = d.withColumns({
        "stage": F.when(s == "", "").when(solo, "C_link_standalone").when(link, "C_link_prefix")
        .when(hit, "B_repeated_prefix").when(glyph, "A_bullet_glyph_strip").otherwise(""),
    })
    new = (
        F.when(F.col("stage") == "C_link_standalone", "")
        .when(F.col("stage") == "C_link_prefix", t.strip(F.regexp_replace(s, r"(?i)^a\s+link\s*", "")))
        .when(F.col("stage") == "B_repeated_prefix", t.strip(F.substr(s, F.length(p) + 1)))
        .when(F.col("stage") == "A_bullet_glyph_strip", t.strip(F.regexp_replace(s, r"^[•◦▪▸●►▶·]\s+", "")))
        .otherwise(F.col(text))
    )
    d = d.withColumn("new_text", new)
    return d.withColumn(
        "new_semantic", F.when((F.col("stage") != "") & (F.col("new_text") == ""), "empty").otherwise(F.col("parser_semantic"))
    ).drop("__t", "prefix")


def structure_confidence(paras: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """How far a document's structure can be trusted, from its share of fake bullets."""
    live = ~F.col("parser_semantic").isin("empty", "section_heading")
    fake = live & t.strip(F.col(text)).rlike("^f [A-Z]")
    g = paras.groupBy(doc).agg(F.count_if(fake).alias("fake"), F.count_if(live).alias("total"))
    return g.withColumn(
        "confidence",
        F.when(F.col("fake") * 20 > F.col("total"), "low").when(F.col("fake") * 100 > F.col("total"), "medium").otherwise("high"),
    )


def paragraph_hints(paras: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Advisory hint of each paragraph and, for bullets, how sure it is.

    Optional columns ``synthetic`` and ``rebuilt_role_header`` default to false.
    """
    conf = structure_confidence(paras, doc, text).select(doc, F.col("confidence").alias("__c"))
    d = paras
    for c in ("synthetic", "rebuilt_role_header"):
        if c not in d.columns:
            d = d.withColumn(c, F.lit(False))
    s, sem, low = t.strip(F.col(text)), F.col("parser_semantic"), F.col("__c") == "low"
    bullet = (
        F.when(sem == "bullet", F.when(F.col("synthetic"), F.when(low, "weak").otherwise("medium")).when(low, "medium").otherwise("strong"))
        .when(s.rlike("^f [A-Z]"), "weak")
        .when(s.rlike("^[•◦▪▸●►]") | s.startswith("- ") | s.startswith("– "), "medium")
    )
    skip = sem.isin("section_heading", "empty") | (s == "")
    tech, high = s.rlike(L.TECH_STACK_LINE), s.rlike(L.HIGHLIGHT_LINE)
    intro = s.startswith("*") & s.endswith("*") & (F.length(s) >= 3)
    hint = (
        F.when(skip, "").when(tech, "tech_stack_candidate").when(high, "highlight_candidate").when(intro, "intro_candidate")
        .when(bullet.isNotNull(), "bullet_candidate")
        .when(F.col("rebuilt_role_header") & (sem != "role_header"), "role_header_candidate").otherwise("")
    )
    return d.join(conf, doc).withColumns({
        "hint": hint, "bullet_confidence": F.when(hint == "bullet_candidate", bullet).otherwise(""),
    }).drop("__c", "synthetic", "rebuilt_role_header")


def duplicate_pages(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """Pages whose whitespace-normalised text occurred on an earlier page of the document."""
    fp = F.sha2(t.strip(F.regexp_replace(F.col(text), r"[\s\x{a0}]+", " ")), 256)
    d = pages.withColumn("fingerprint", fp)
    first = d.groupBy(doc, "fingerprint").agg(F.min(page).alias("first_page"))
    return d.join(first, [doc, "fingerprint"]).withColumn("duplicate", F.col(page) > F.col("first_page")).drop("fingerprint")


def merge_title_lines(lines: DataFrame, doc: str = "doc_id", order: str = "line_no", line: str = "line",
                      block: int = 4096) -> DataFrame:
    """A short title followed by a ``company | year`` line becomes one line, at the title's place."""
    s = t.strip(F.col(line))
    first_word = F.lower(F.split(s, r"\s+", 2)[0])
    title = (
        ~s.contains("|") & ~s.rlike("^(?:- |• |● |– )") & (s != F.upper(s))
        & ~first_word.isin(*L.TITLE_MERGE_STOP_WORDS) & (F.length(s) <= 60) & ~s.rlike("[.!?,:;]$")
    )
    # Blank lines stay as they are; of the others only the lines themselves are shuffled, once, and what is read of them is taken afterwards.
    live = lines.filter(s != "")
    hot = hot_keys(live, [doc])
    d = (live.repartition(doc) if hot is None else live).withColumns({
        "__title": F.when(title, s), "__target": s.contains("|") & t.has_year(F.col(line)),
    })
    d = ordered_scan(d, [doc], [order], [F.floor(F.col(order) / block)], [
        lag1("__prev", F.struct(F.col("__title").alias("s"), F.col(order).alias("at"))), lead1("__next", "__target"),
    ], hot=hot)
    d = d.withColumn("__m", F.col("__target") & F.col("__prev.s").isNotNull())
    eaten = F.col("__title").isNotNull() & F.coalesce("__next", F.lit(False))
    text = F.when(F.col("__m"), F.concat(F.col("__prev.s"), F.lit(" | "), s)).otherwise(F.col(line))
    out = d.filter(~eaten).select(
        *[F.when(F.col("__m"), F.col("__prev.at")).otherwise(F.col(order)).alias(c) if c == order else F.col(c) for c in lines.columns if c != line],
        text.alias(line), F.col("__m").alias("merged"),
    )
    blank = lines.filter(F.coalesce(s, F.lit("")) == "").withColumn("merged", F.lit(False))
    return out.unionByName(blank)
