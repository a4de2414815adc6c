"""Sections, roles and paragraph labels against line-by-line walks."""

import random
import re

import pytest

from quire.functions import lexicons as L
from quire.operators import segments as g

KIND = {n: k for k, ns in L.NAMES_BY_TYPE.items() for n in ns}
POOL = [
    "SUMMARY", "Experience", "Technical Skills", "S K I L L S", "Key Tools", "Big Data", "SENIOR SOFTWARE BUILDER", "Engineer | Acme",
    "Lead | Beta", "Jan 2019 - Present", "- did things", "• more", "plain words here", "", "Awards", "python, sql", "2020", "Jane Doe",
]


def known(s):
    if s.lower() in KIND:
        return KIND[s.lower()]
    if s and all(len(p) == 1 for p in s.split()):
        return KIND.get("".join(s.split()).lower())
    return None


def pair(s):
    w = s.split()
    return bool(len(w) == 2 and all(x[0].isupper() for x in w) and not re.search(r"[|,;:]|[.!?]$|^[-•]", s) and not re.search(r"\b(19|20)\d\d\b", s) and not re.search("[a-z][A-Z]", s))


def walk_sections(lines):
    """One pass with explicit state, as a reader would do it."""
    no, kind, fresh, out, any_head = 0, "", False, [], False
    for n, raw in lines:
        s = raw.strip()
        k = known(s)
        head = k is not None
        if not head and not any_head:
            head = s != "" and s == s.upper() and s.replace(" ", "").isalpha() and len(s.split()) >= 3
        if not head and any_head and fresh and kind != "experience":
            head = pair(s)
        if head:
            no, kind, any_head, fresh = no + 1, k or "other", True, True
        elif s:
            fresh = False
        out.append((n, no, kind, head))
    return out


@pytest.mark.parametrize("limit", [0, 10**9])
def test_sections(spark, hot, limit):
    hot(limit)
    rnd = random.Random(11)
    docs = {d: [(i, rnd.choice(POOL)) for i in range(40)] for d in range(25)}
    df = spark.createDataFrame([(d, i, x) for d, ls in docs.items() for i, x in ls], "doc_id int, line_no int, line string")
    got = {}
    for r in g.segment_sections(df).collect():
        got.setdefault(r.doc_id, []).append((r.line_no, r.section_no, r.section_type, r.is_heading))
    # A fallback heading after a typed one is never experience, so the walk's rule is exact here.
    assert {d: sorted(v) for d, v in got.items()} == {d: walk_sections(ls) for d, ls in docs.items()}


def walk_roles(lines):
    role, state, out, prev_opened = 0, None, [], False
    for n, s in lines:
        s = s.strip()
        if not s:
            continue
        if "|" in s and not s.startswith(("-", "•")):
            if prev_opened:
                out.append((n, role, "meta"))
                prev_opened, state = False, "meta"
            else:
                role, state, prev_opened = role + 1, "role", True
                out.append((n, role, "header"))
            continue
        prev_opened = False
        bullet = s.startswith(("- ", "• "))
        if state in (None, "closed"):
            out.append((n, role, "body"))
        elif bullet:
            state = "bullets"
            out.append((n, role, "bullet"))
        elif state == "bullets" and re.match(r"^(Jan )?(19|20)\d\d( - Present)?$", s):
            state = "closed"
            out.append((n, role, "next_date"))
        else:
            out.append((n, role, "bullet" if state == "bullets" else "meta"))
    return out


@pytest.mark.parametrize("limit", [0, 10**9])
def test_roles(spark, hot, limit):
    hot(limit)
    rnd = random.Random(4)
    pool = ["Engineer | Acme", "Lead | Beta", "Jan 2019 - Present", "- did", "• more", "some words", "", "2020"]
    docs = {d: [(i, rnd.choice(pool)) for i in range(1, 50)] for d in range(20)}
    rows = [(d, 0, "Experience", True, 1, "Experience", "experience") for d in docs]
    rows += [(d, i, x, False, 1, "Experience", "experience") for d, ls in docs.items() for i, x in ls]
    df = spark.createDataFrame(rows, "doc_id int, line_no int, line string, is_heading boolean, section_no long, heading string, section_type string")
    got = {}
    for r in g.segment_roles(df).collect():
        got.setdefault(r.doc_id, []).append((r.line_no, r.role, r.label))
    assert {d: sorted(v) for d, v in got.items()} == {d: walk_roles(ls) for d, ls in docs.items()}


def label(p, prev, nxt):
    """Best rule for one paragraph given the promoted label before it."""
    s, sem, hint = p["text"].strip(), p["sem"], p["hint"]
    proj, role = "project" in p["title"].lower(), p["meta"] or p["bul"]
    if sem == "role_meta" and proj and s:
        return "project_entry", 0.90
    if sem == "bullet" and hint == "tech_stack_candidate" and s:
        return "tech_stack", 0.95
    if sem != "paragraph" or not s:
        return sem, 0.0
    glyph, fake = s[0] in "•◦▪▸●►*-", bool(re.match("^f [A-Z]", s))
    word, c = bool(re.search(r"\bproject\b", s, re.I)), []
    if hint == "tech_stack_candidate":
        c.append((0.95, "tech_stack"))
    if hint == "highlight_candidate":
        c.append((0.95, "highlight_header"))
    i = s.find(":")
    if 1 <= i <= 40 and (s[:i].lower().split() or [""])[0] in g.TECH_LAYER_WORDS:
        c.append((0.90, "tech_stack"))
    if proj and not role:
        if re.match(r"a link\s", s, re.I):
            c.append((0.90, "project_entry"))
        elif re.search(g.YEAR_AT_END, s):
            c.append((0.85, "project_entry"))
    if word and len(s) <= 60 and s[-1] not in ".!?,;" and not glyph and ":" not in s:
        c.append((0.94 if nxt == "bullet" else 0.85, "project_header"))
    if hint == "intro_candidate":
        c.append((0.90, "role_intro"))
    elif s[-1] in ".!?" and len(s) >= 25 and s.count(" ") >= 3 and (prev in g.STRUCTURAL or p["meta"]):
        c.append((0.82, "role_intro"))
    if role and word and 60 < len(s) <= 250 and not glyph and not fake and ":" not in s[:20]:
        c.append((0.84, "project_intro"))
    if prev == "project_intro" and role and not glyph and not fake and len(s) >= 10 and not s[0].isupper():
        c.append((0.82, "project_intro"))
    if re.search(g.DOMAIN_WORDS, s) and len(s) <= 80 and s[-1] not in ".!?,;" and not re.search("[0-9]", s) and not glyph and ":" not in s:
        c.append((0.87 if nxt in ("bullet", "paragraph") else 0.80, "specialization_header"))
    if not c:
        return sem, 0.0
    best = max(c, key=lambda x: x[0])
    return best[1], best[0]


@pytest.mark.parametrize("limit", [0, 10**9])
def test_enrichment_equals_a_walk(spark, hot, limit):
    hot(limit)
    rnd = random.Random(8)
    texts = [
        "Tools: Kafka", "Databases: MySQL", "a link Portfolio", "Chess engine 2021", "Payments project", "Backend Development", "- point", "Short.",
        "Contribution to the internal project that keeps the service portal of the whole group running", "and helped them to grow over the years",
        "Worked closely with several product teams.", "it was good for all of the people there.", "Responsible for many things at once."]
    sems = ["paragraph"] * 6 + ["role_header", "role_meta", "bullet"]
    hints = [""] * 6 + ["tech_stack_candidate", "highlight_candidate", "intro_candidate"]
    docs = {
        d: [dict(text=rnd.choice(texts), sem=rnd.choice(sems), hint=rnd.choice(hints), title=["Projects", "Experience"][d % 2], meta=rnd.random() < 0.3,
                 bul=rnd.random() < 0.4) for _ in range(60)] for d in range(20)}
    want = {}
    for d, ps in docs.items():
        prev = ""
        for i, p in enumerate(ps):
            prev, conf = label(p, prev, ps[i + 1]["sem"] if i + 1 < len(ps) else None)
            want[(d, i)] = (prev, round(conf, 2))
    rows = [(d, "s", i, p["text"], p["sem"], p["hint"], p["title"], p["meta"], p["bul"]) for d, ps in docs.items() for i, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "doc_id int, section_id string, ord int, text string, parser_semantic string, hint string, raw_title string, in_meta boolean, in_bullets boolean")
    got = {(r.doc_id, r.ord): (r.enriched, round(r.confidence, 2)) for r in g.enrich_paragraphs(df).collect()}
    assert got == want
