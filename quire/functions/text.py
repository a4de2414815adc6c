"""Column builders for text. All are built-in expressions."""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import lexicons as L


BLANKS = " \t\n\x0b\f\r\u00a0"


def strip(c: Column) -> Column:
    """Both ends without white space of any kind."""
    return F.btrim(c, F.lit(BLANKS))


def strip_plain(column: str) -> Column:
    """:func:`strip` of a plain column, which it reads three times: texts without white space at their ends are left alone."""
    c = F.col(column)
    ends = lambda at: F.substr(c, F.lit(at), F.lit(1)).isin(*BLANKS)
    return F.when(ends(1) | ends(-1), strip(c)).otherwise(c)


def blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def words(c: Column) -> Column:
    """Unicode word runs."""
    return F.regexp_extract_all(c, F.lit(L.WORD), 0)


def letter_words(c: Column, least: int, letters: str = "a-zA-Z") -> Column:
    """The words of :func:`words` that are ``least`` or more of the given letters and nothing else; others are read over in the same pass."""
    p = rf"([{letters}]{{{least},}}+)(?![\p{{L}}\p{{N}}_])|{L.WORD}+"
    return F.array_remove(F.regexp_extract_all(c, F.lit(p), F.lit(1)), "")


def years(c: Column) -> Column:
    """Four-digit years standing as whole words, as integers."""
    return F.transform(F.regexp_extract_all(c, F.lit(L.YEAR_IN_TEXT), 0), lambda w: w.cast("int"))


def has_year(c: Column) -> Column:
    return c.rlike(L.YEAR_IN_TEXT)


def any_of(c: Column, needles: Iterable[str]) -> Column:
    """True when ``c`` contains one of the needles."""
    out = F.lit(False)
    for n in needles:
        out = out | c.contains(n)
    return out


def clean_text(c: Column) -> Column:
    """Private glyphs out, one bullet form, spaced dashes, single spaces."""
    c = F.regexp_replace(c, L.PRIVATE_USE, "")
    c = F.regexp_replace(c, r"^[\s\x{a0}]+", "")
    c = F.regexp_replace(c, rf"^[{L.BULLET_GLYPHS}][\s\x{{a0}}]+", "• ")
    c = F.replace(F.replace(c, F.lit("—"), F.lit(" - ")), F.lit("–"), F.lit(" - "))
    return strip(F.regexp_replace(c, r"[\s\x{a0}]+", " "))


def unicode_cleanup(c: Column) -> Column:
    """Ligatures, invisible characters, space variants, stray dashes and control characters."""
    for bad, good in L.LIGATURES.items():
        c = F.replace(c, F.lit(bad), F.lit(good))
    c = F.translate(c, L.SPACE_VARIANTS + L.INVISIBLE, " " * len(L.SPACE_VARIANTS))
    c = F.translate(c, "\u0013\u0096\u0097", "––—")
    c = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]", "")
    return strip(F.regexp_replace(c, " {3,}", "  "))


def heading_key(c: Column) -> Column:
    """Letters and digits of a heading without its numbering."""
    c = F.regexp_replace(strip(F.lower(c)), r"^[0-9.\s()]+", "")
    return F.regexp_replace(c, "[^a-z0-9]", "")


def alias_key(c: Column) -> Column:
    """Heading in alias form: & as and, no numbering, no punctuation, single spaces."""
    c = F.replace(strip(F.lower(c)), F.lit("&"), F.lit("and"))
    c = F.regexp_replace(c, r"^[0-9]+[.\s]+", "")
    c = F.regexp_replace(c, r"[^\p{L}\p{N}_\s]", "")
    return strip(F.regexp_replace(c, r"\s+", " "))


def unspaced(c: Column) -> Column:
    """Letter-spaced headings joined up; anything else lower-cased."""
    s = strip(c)
    signs = F.split(s, r"[ \t\x{a0}]+")
    # The second sign tells most texts apart without taking them to pieces.
    second = F.substr(s, F.lit(2), F.lit(1)).isin("", " ", "\t", "\u00a0")
    spaced = (s != "") & second & F.forall(signs, lambda w: (F.length(w) == 1) & ~w.rlike(r"\s"))
    marked = F.regexp_replace(F.translate(s, "\t", " "), r"(?<! ) *\x{a0}[ \x{a0}]*", "\u0001")
    joined = F.replace(F.regexp_replace(marked, r"[ \t]+", ""), F.lit("\u0001"), F.lit(" "))
    return F.lower(F.when(spaced, joined).otherwise(c))


def canonical_text(c: Column) -> Column:
    """Unix line ends, no trailing blanks, one final newline."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"(?<![ \t\x0B\f\x{a0}])[ \t\x0B\f\x{a0}]++\n", "\n")
    return F.concat(strip(c), F.lit("\n"))


@cache
def _ascii_forms() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose compatibility decomposition holds ASCII, by whether one or several ASCII characters are left of it."""
    one, many = {}, {}
    for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, sys.maxunicode + 1))):
        if unicodedata.decomposition(c) and (kept := "".join(x for x in unicodedata.normalize("NFKD", c) if x < "\x80")):
            (one if len(kept) == 1 else many)[c] = kept
    return one, many


def _class_of(chars) -> str:
    """A pattern class of characters, as ranges."""
    points, out = sorted(map(ord, chars)), []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in out) + "]"


def ascii_fold(c: Column) -> Column:
    """The ASCII characters of the compatibility decomposition; all others are dropped.

    Characters that decompose to several (ligatures, fractions, circled numbers) are rare: a text is searched for
    them once, and only those it has are replaced.
    """
    one, many = _ascii_forms()
    forms = F.from_json(F.lit(json.dumps(many)), "map<string,string>")
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(f"({_class_of(many)})"), F.lit(1)))
    wide = F.when(c.rlike(_class_of(many)), F.aggregate(found, c, lambda acc, x: F.replace(acc, x, F.element_at(forms, x)))).otherwise(c)
    folded = F.translate(wide, "".join(one), "".join(one.values()))
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.regexp_replace(folded, r"[^\x00-\x7F]", "")).otherwise(c)


def slug(c: Column) -> Column:
    s = F.regexp_replace(strip(ascii_fold(c)), r"\s+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(s, "[^A-Za-z0-9_]", ""), F.lit("")), F.lit("Unknown"))


def file_safe(c: Column) -> Column:
    """Runs of other characters as one underscore, none at the ends."""
    s = F.regexp_replace(c, "[^A-Za-z0-9_-]", "_")
    return F.regexp_replace(F.btrim(s, F.lit("_")), "_+", "_")


def strip_code_fence(c: Column) -> Column:
    """Text without a surrounding Markdown fence."""
    s = strip(c)
    body = F.regexp_replace(F.regexp_replace(s, r"^[^\n]*\n?", ""), r"(?:^|\n)[ \t]*```[ \t]*$", "")
    return F.when(s.startswith("```"), strip(body)).otherwise(s)


def sentences(c: Column) -> Column:
    """Sentences ended by . ! or ? and white space."""
    marked = F.regexp_replace(strip(c), r"([.!?])\s+", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), strip), lambda s: s != "")


def compact_summary(c: Column, n: int = 3) -> Column:
    """The first n-1 sentences and the last, when there are more than n."""
    s = sentences(c)
    kept = F.concat(F.slice(s, 1, n - 1), F.slice(s, -1, 1))
    return F.when(F.size(s) > n, F.array_join(kept, " ")).otherwise(c)


def non_blank_lines(c: Column) -> Column:
    return F.filter(F.split(c, "\n"), lambda x: x.rlike(r"[^\s\x{a0}]"))


def first_at(flags: Column) -> Column:
    """1-based index of the first true element, 0 when there is none."""
    return F.coalesce(F.array_position(flags, True), F.lit(0)).cast("int")


def person_name(c: Column) -> Column:
    """Best-effort name from the first eight non-blank lines.

    In each line known contact tokens go, then the first run of capitalised
    words counts when it has at least two.
    """
    def run(line: Column) -> Column:
        x = line
        for p in (L.EMAIL, L.PHONE, L.LINKEDIN, L.GITHUB):
            x = F.regexp_replace(x, p, "")
        x = F.when(line.rlike(r"[@/0-9]|[\s().-]{7}"), x).otherwise(line)  # each of the patterns needs one of these
        letters = F.transform(F.split(strip(x), r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}]", ""))
        marks = F.transform(letters, lambda w: F.when(w.rlike(r"^\p{Lu}\p{L}"), w).otherwise("|"))
        return F.split(strip(F.regexp_extract(F.array_join(marks, " "), r"^[| ]*([^|]+)", 1)), " +")

    runs = F.transform(F.slice(non_blank_lines(c), 1, 8), lambda x: run(x))
    good = F.filter(runs, lambda r: F.size(r) >= 2)
    return F.coalesce(F.array_join(F.slice(F.get(good, F.lit(0)), 1, 4), " "), F.lit("Unknown"))


def summary_snippet(c: Column) -> Column:
    """The three non-blank lines after the first summary-like line."""
    lines = non_blank_lines(c)
    at = first_at(F.transform(lines, lambda x: x.rlike(r"(?i)\b(summary|profile|objective)\b")))
    tail = F.transform(F.slice(lines, at + 1, 3), strip)
    return F.when(at == 0, F.lit("")).otherwise(F.array_join(tail, " "))


def distinct_ci(arr: Column) -> Column:
    """Case-insensitive distinct, first spelling kept, order kept."""
    keyed = F.array_sort(F.transform(arr, lambda x, i: F.struct(F.lower(x).alias("k"), i.alias("i"), x.alias("x"))))
    # Beside every element the one before it, so that no element looks into the whole list.
    before = F.slice(F.concat(F.array(F.lit(None).cast("string")), F.transform(keyed, lambda e: e["k"])), 1, F.size(keyed))
    marked = F.zip_with(keyed, before, lambda e, b: F.struct(e["i"].alias("i"), e["x"].alias("x"), (e["k"].isNotNull() & ~e["k"].eqNullSafe(b)).alias("first")))
    return F.transform(F.array_sort(F.filter(marked, lambda e: e["first"])), lambda e: e["x"])


def contains_marker(c: Column) -> Column:
    return F.regexp_count(c, F.lit(L.INTERNAL_MARKER))
