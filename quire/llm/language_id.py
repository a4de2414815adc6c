"""Language of web pages by Bayesian evidence fusion.

Three kinds of evidence are multiplied for each language: how likely the page's
text is under letter trigrams, how often pages of that language declare what this
page's markup declares, and how common the language is on the page's host.  Host
priors are smoothed by those of the address suffix, and these by all pages; they and the
declarations' likelihoods come from grouped sums of what the text alone says about every page.

Trigram counts are learned from at most ``max_rows`` labelled documents a language, picked
by a hash of their text; everything else covers all pages.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import written
from quire.llm.quality_rules import declared

BITS = 16
CACHE = 300_000
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|textarea)\b.*?(?:</\1\s*>|\Z)|<[^>]*>", re.S | re.I)
EDGES = ".,;:!?()[]{}\"'«»„“”‚‘’*#$%&|<>-_/\\0123456789"
# Neighbouring trigrams are no independent witnesses: evidence grows with half their number at first, and ever more slowly beyond some hundred.
HALVED, TEMPER = 100, 0.5
SUFFIX_WEIGHT, HOST_WEIGHT, DECLARED_WEIGHT = 20.0, 5.0, 5.0  # pages that the level above counts for
MAX_LANGUAGES, MIN_ROWS = 64, 5
OTHER = "other"  # all languages beyond these bounds


def trigrams(word: str) -> list[int]:
    """Hashed letter trigrams of a word and its ends, without case and outer marks."""
    w = word.lower().strip(EDGES)
    if not w:
        return []
    w = f"^{w}$"
    return [crc32(w[k : k + 3].encode()) & ((1 << BITS) - 1) for k in range(len(w) - 2)]


@dataclass
class TextModel:
    languages: list[str]
    table: np.ndarray  # trigram, language: log-probability
    halved: int = HALVED


class WordScores:
    """Sums of trigram log-probabilities of the words met, and their number of trigrams in the last column."""

    def __init__(self, model: TextModel):
        self.model, self.at = model, {}
        self.rows = np.zeros((1024, len(model.languages) + 1))

    def _learn(self, words: list[str]) -> None:
        if len(self.at) + len(words) > CACHE:
            self.at = {}
        while len(self.at) + len(words) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        for w in words:
            t = trigrams(w)
            self.at[w] = k = len(self.at)
            self.rows[k] = (*self.model.table[t].sum(0), len(t)) if t else 0

    def evidence(self, text: str) -> np.ndarray:
        """Tempered log-likelihood of a text under each language; zeros for a text without letters."""
        words = text.split()
        if new := [w for w in dict.fromkeys(words) if w not in self.at]:
            self._learn(new if len(self.at) + len(new) <= CACHE else list(dict.fromkeys(words)))
        total = self.rows[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))].sum(0)
        n = total[-1]
        return total[:-1] / n * (self.model.halved * np.log1p(n / self.model.halved)) * TEMPER if n else np.zeros(len(total) - 1)


def train_text_model(
    docs: DataFrame, text: str = "text", lang: str = "lang", max_rows: int = 1000, max_languages: int = MAX_LANGUAGES, min_rows: int = MIN_ROWS, halved: int = HALVED
) -> TextModel:
    """Trigram model of the languages that at least ``min_rows`` documents are in, at most the ``max_languages`` most frequent ones.

    A declared region does not count: ``en-US`` is ``en``.  All further languages together are one more, 'other'.
    ``halved`` is the number of trigrams from which more of them count for less.
    Null texts and languages teach nothing; without any language of ``min_rows`` documents the model has one, 'und'.
    """
    known = docs.select(declared(F.col(lang)).alias("lang"), F.col(text).alias("t")).where("lang is not null and t is not null")
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    listed = counts.where((F.col("n") >= min_rows) & (F.col("lang") != OTHER)).orderBy(F.col("n").desc(), "lang").limit(max_languages).collect()
    if not listed:
        return TextModel(["und"], np.zeros((1 << BITS, 1)), halved)
    sizes = {r["lang"]: r["n"] for r in listed}
    rest = counts.agg(F.sum("n").alias("n")).first()["n"] - sum(sizes.values())
    known = known.withColumn("lang", F.when(F.col("lang").isin(*sizes), F.col("lang")).otherwise(OTHER))
    if rest:
        sizes[OTHER] = rest
    languages = sorted(sizes)
    part = F.lit(0)
    for code, n in sizes.items():
        part = F.when(F.col("lang") == code, int(min(1.0, max_rows / n) * 1_000_000) + 1).otherwise(part)
    number = {x: k for k, x in enumerate(languages)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros((1 << BITS, len(languages)))
        for batch in batches:
            for code, t in zip(batch["lang"], batch["t"], strict=True):
                for w in t.split():
                    for g in trigrams(w):
                        table[g, number[code]] += 1
        g, k = np.nonzero(table)
        yield pd.DataFrame({"g": g, "k": k, "n": table[g, k]})

    sample = known.where(F.pmod(F.xxhash64("t"), F.lit(1_000_000)) < part)
    rows = sample.mapInPandas(count, "g int, k int, n double").groupBy("g", "k").agg(F.sum("n").alias("n")).toPandas()  # bounded by the table
    table = np.full((1 << BITS, len(languages)), 0.05)
    table[rows["g"], rows["k"]] += rows["n"]
    return TextModel(languages, np.log(table / table.sum(0)), halved)


def _softmax(logs: Column) -> Column:
    e = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def _sums(n: int) -> Column:
    return F.array(*[F.sum(F.col("p")[k]) for k in range(n)])


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def page_languages(pages: DataFrame, model: TextModel, page_id: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """One row per page: page_id, host, declared, text_lang, lang, confidence.

    ``declared`` is the markup's language, 'other' when the model does not know it, 'none' without one.
    ``text_lang`` is what the text alone says and null for pages without letters; ``lang`` is the most probable
    language given all evidence ('other' for those the model has only together; the first in the alphabet where several are) and ``confidence`` its probability.  A page's own text does not
    count in its host's prior.  Null markup is empty; null and odd addresses share the host ''.
    """
    languages = model.languages
    n = len(languages)
    holder: list[WordScores] = []

    @F.pandas_udf("array<double>")
    def evidence(values: pd.Series) -> pd.Series:
        if not holder:
            holder.append(WordScores(model))
        return pd.Series([holder[0].evidence(entities.unescape(MARKUP.sub(" ", v))) for v in values])

    body = F.coalesce(F.col(markup), F.lit(""))
    host = F.lower(F.coalesce(F.try_parse_url(F.col(url), F.lit("HOST")), F.lit("")))
    code = F.lower(F.regexp_extract(body, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    marked = F.when(code == "", "none").when(code.isin(*languages), code).otherwise(OTHER)
    seen = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), marked.alias("declared"), evidence(body).alias("logs"))
    seen = written(seen.withColumn("suffix", F.substring_index("host", ".", -1)).withColumn("p", _softmax(F.col("logs"))), "evidence")
    flat = F.array_max("logs") == F.array_min("logs")
    if n == 1:
        flat = F.lit(False)

    voters = seen.where(~flat)  # pages whose text says something
    hosts = voters.groupBy("host", "suffix").agg(_sums(n).alias("h"))
    suffixes = voters.groupBy("suffix").agg(_sums(n).alias("s"))
    whole = [x or 0.0 for x in voters.agg(_sums(n).alias("g")).first()["g"]]
    top = F.array(*[F.lit((x + 1.0) / (sum(whole) + n)) for x in whole])
    said = {r["declared"]: r["d"] for r in voters.groupBy("declared").agg(_sums(n).alias("d")).collect()}  # the languages and two more
    marks = [*languages, *({OTHER} - set(languages)), "none"]
    likelihood = F.lit(None).cast("array<double>")
    for m in marks:
        row = [((said[m][k] if m in said else 0.0) + DECLARED_WEIGHT * (0.5 if m == languages[k] else 0.5 / (n + 1))) / (whole[k] + DECLARED_WEIGHT) for k in range(n)]
        likelihood = F.when(F.col("declared") == m, F.array(*map(F.lit, row))).otherwise(likelihood)

    levels = hosts.join(suffixes, "suffix").select(
        "host", "h", F.zip_with("s", F.zip_with("h", top, lambda h, g: SUFFIX_WEIGHT * g - h), lambda s, r: s + r).alias("above"), _total(F.col("s")).alias("all")
    )
    levels = written(levels.select("host", "h", F.transform("above", lambda a: F.greatest(a, F.lit(1e-9)) / (F.col("all") - _total(F.col("h")) + SUFFIX_WEIGHT)).alias("above")), "hosts")
    # Both sides are read from files, so adaptive execution splits a host that holds many pages.
    own = F.when(flat, F.transform("p", lambda _: F.lit(0.0))).otherwise(F.col("p"))
    joined = seen.join(levels, "host", "left").withColumn("own", own)
    prior = F.zip_with(
        F.zip_with("h", "own", lambda h, p: F.greatest(h - p, F.lit(0.0))), "above", lambda h, a: (h + HOST_WEIGHT * a)
    )
    fused = joined.withColumn("prior", F.coalesce(prior, top)).withColumn(
        "q", _softmax(F.zip_with(F.zip_with("logs", "prior", lambda x, y: x + F.log(y)), likelihood, lambda x, y: x + F.log(y)))
    )
    names = F.array(*map(F.lit, languages))

    def best(p: Column) -> Column:
        return F.get(names, (F.array_position(p, F.array_max(p)) - 1).cast("int"))

    return fused.select(
        "page_id", "host", "declared", F.when(~flat, best(F.col("logs"))).alias("text_lang"), best(F.col("q")).alias("lang"), F.array_max("q").alias("confidence")
    )
