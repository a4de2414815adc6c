"""Quality rules by distribution divergence.

Every document is described by two histograms: classes of characters, and how
often the common words of each language occur.  References are the mean
histograms of all documents declared to be in a language, gathered in one
grouped aggregation, for every language declared.  A document is rejected when its Jensen-Shannon distance
to even its nearest reference is large; short texts are not judged by a
histogram they cannot fill, nor documents by one that their language has no reference for.

The counted rules (words, symbols, repeated lines, repeated five-word windows)
are plain and exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Frequent function words, the languages that have a reference of words.
COMMON_WORDS = {
    "en": "the of and to in is was that for with on as by an be at from are this it not or have which",
    "fr": "de la le et les des en un une du dans que est pour qui au sur pas par plus avec il ce être",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más sus está",
}
LANGUAGES = tuple(COMMON_WORDS)
WORDS = tuple(sorted({w for ws in COMMON_WORDS.values() for w in ws.split()}))
_WORD_BYTES = tuple((w.encode(), w.capitalize().encode()) for w in WORDS)
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\r\x0b\x0c"

# Character classes of a UTF-8 byte: lower, upper, letters beyond ASCII (one per lead byte), digit, blank, stop, other mark, symbol; 8 is left out.
CLASSES = 8
_CLASS = np.full(256, 6, np.uint8)
_CLASS[ord("a"):ord("z") + 1] = 0
_CLASS[ord("A"):ord("Z") + 1] = 1
_CLASS[0x80:0xC0] = 8
_CLASS[0xC0:] = 2
_CLASS[ord("0"):ord("9") + 1] = 3
_CLASS[list(BLANKS.encode())] = 4
_CLASS[list(b".,;:!?'\"-()")] = 5
_CLASS[list(SYMBOLS.encode())] = 7

# Limits of the method's verdict.
MIN_CHARS, MIN_WORDS = 200, 50
MIN_DOCS = 20  # documents that make a reference of a language without common words
CHAR_LIMIT, WORD_LIMIT = 0.28, 0.40


def histograms(raw: bytes, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the character classes, and of the common words with the rest as the last entry."""
    chars = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=CLASSES + 1)[:CLASSES].astype(float)
    n = sum(counts.values())
    words = np.array([counts[a] + (counts[b] if a != b else 0) for a, b in _WORD_BYTES], float)
    return chars / max(chars.sum(), 1), np.append(words, n - words.sum()) / max(n, 1)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Square root of the Jensen-Shannon divergence to base 2 of ``p`` to each row of ``q``: 0 for equal, 1 for disjoint distributions."""
    m = (p + q) / 2
    d = _h(m) - (_h(p) + _h(q)) / 2
    return np.sqrt(np.maximum(d, 0))


def _h(p: np.ndarray) -> np.ndarray:
    """Entropy in bits of each row; 0 counts as 1e-300, whose share vanishes."""
    return -(p * np.log2(np.maximum(p, 1e-300))).sum(axis=-1)


def repeated_window_words(words: list[bytes], counts: Counter, size: int = 5) -> int:
    """Words inside windows of ``size`` words that occur twice or more, the first occurrence included."""
    n = len(words) - size + 1
    if n < 2 or len(counts) == len(words):
        return 0
    number = {w: i for i, w in enumerate(counts)}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    base, key, reach = len(number), ids[:n].copy(), len(number)
    for k in range(1, size):
        if reach > (1 << 62) // base:  # renumber before the key would overflow
            _, key = np.unique(key, return_inverse=True)
            reach = n
        key = key * base + ids[k : n + k]
        reach *= base
    _, at, seen = np.unique(key, return_inverse=True, return_counts=True)
    hit = seen[at] > 1
    if not hit.any():
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += hit
    edges[size:] -= hit
    return int((np.cumsum(edges[:-1]) > 0).sum())


def base_counts(text: str, raw: bytes, words: list[bytes], counts: Counter) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)), repeated_window_words(words, counts),
    )


def base_fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


def declared(lang: Column) -> Column:
    """The language of a declared code without its region, null for a blank one."""
    return F.nullif(F.lower(F.regexp_extract(F.trim(lang.cast("string")), "^[^-_]*", 0)), F.lit(""))


def references(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Mean histograms of the documents of each language of ``COMMON_WORDS``, and of each other one with ``MIN_DOCS`` or more; at most a hundred numbers a language reach the driver."""
    width = CLASSES + len(WORDS) + 1
    texts = docs.select(declared(F.col(lang)).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    sizes = texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= MIN_DOCS) | F.col("lang").isin(*LANGUAGES)).collect()

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for code, t in zip(batch["lang"], batch["text"], strict=True):
                raw = t.encode()
                counts = Counter(raw.split())
                if counts:
                    total.setdefault(code, np.zeros(width + 1))
                    total[code] += np.concatenate([*histograms(raw, counts), [1.0]])
        for code, v in total.items():
            yield pd.DataFrame({"lang": code, "pos": range(width + 1), "v": v})

    known = texts.where(F.col("lang").isin(*[r["lang"] for r in sizes]))
    rows = known.mapInPandas(sums, "lang string, pos int, v double").groupBy("lang", "pos").agg(F.sum("v").alias("v")).collect()
    out: dict[str, np.ndarray] = {}
    for r in rows:
        out.setdefault(r["lang"], np.zeros(width + 1))[r["pos"]] = r["v"]
    return {code: (v[:CLASSES] / v[width], v[CLASSES:width] / v[width]) for code, v in sorted(out.items())}


RULES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, char_distance double, word_distance double, kept boolean"


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", out: str = "rules") -> DataFrame:
    """``docs`` with a struct column ``out`` of the counts, distances and verdict of every row.

    Null text counts as empty and fails the base rules.  ``char_distance`` is
    null below ``MIN_CHARS`` characters and ``word_distance`` below ``MIN_WORDS``
    words, and where a language is declared that has no such reference; a null distance rejects nothing.  Without any reference
    the verdict is the base rules' alone.  Rows are judged one by
    one, so repeated rows get equal results; other columns pass unread, and one
    named like ``out`` is replaced.
    """
    refs = references(docs, text, lang)
    char_refs = np.array([r[0] for r in refs.values()])
    in_words = frozenset(refs) & frozenset(LANGUAGES)
    word_refs = np.array([r[1] for code, r in refs.items() if code in in_words])

    def judge(t: str, code: str | None) -> tuple:
        raw = t.encode()
        words = raw.split()
        counts = Counter(words)
        base = base_counts(t, raw, words, counts)
        failed = base_fails(base[0], base[4])
        chars, common = histograms(raw, counts)
        dc = float(js_distance(chars, char_refs).min()) if refs and len(t) >= MIN_CHARS and (code is None or code in refs) else None
        dw = float(js_distance(common, word_refs).min()) if in_words and len(words) >= MIN_WORDS and (code is None or code in in_words) else None
        return *base, failed, dc, dw, not failed and not (dc is not None and dc > CHAR_LIMIT) and not (dw is not None and dw > WORD_LIMIT)

    @F.pandas_udf(RULES)
    def rules(texts: pd.Series, codes: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([judge(t, code) for t, code in zip(texts, codes, strict=True)], columns=[x.split()[0] for x in RULES.split(", ")])

    return docs.withColumn(out, rules(F.coalesce(F.col(text), F.lit("")), declared(F.col(lang))))
