"""Licence scan with a positional index of rare words, in DataFrame functions only.

*Index.* Every licence notice is a template: its words, their positions and a key phrase.
One grouped count over all documents gives each template word its inverse document
frequency; the three rarest words of a template are its anchors, and the index holds
the templates and positions of every anchor.

*Look-up.* A file's words are held against the index where it has an anchor at all.
Each occurrence at place i, listed at position p of a template, says that the template would start
at i - p.  Starts stay where at least two anchors stand at their relative positions.

*Verification.* The window of such a start must hold the template's key phrase and the
greater part of the template's words, weighted by rarity.  Phrases that have to
stand word for word are looked up by their rarest word and compared whole, so every place is found.

All of this happens inside a file's own row: nothing but word counts is ever shuffled,
and a file costs time in proportion to its words, however often a word repeats.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import lower_ascii

# Phrases that name a licence word for word.
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

# Label, notice and key phrase, in the words of the licences.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "permission is hereby granted free of charge"),
    ("mit", "licensed under the mit license", "mit license"),
    ("mit", "released under the mit license", "mit license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license version 2 0"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "either version 3 of the license"),
    ("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "either version 2 of the license"),
    ("lgpl", "licensed under the gnu lesser general public license version", "gnu lesser general public license"),
    ("agpl-3", "licensed under the gnu affero general public license version 3", "gnu affero general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("all-rights-reserved", "copyright all rights reserved", "all rights reserved"),
)

ANCHORS = 3  # rarest words of a template that are looked up
SLACK = 4  # words by which a copy may be shifted inside a notice
LEAST = 0.75  # share of a notice's word weight that its window must hold
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ENDS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
_SHIFT, _BASE = 1 << 40, 1 << 20  # a template and a start in one number, which is quick to make distinct


@dataclass(frozen=True)
class LicenceIndex:
    """Templates with the document frequency of their words."""

    templates: tuple[tuple[str, str, str], ...]
    phrases: tuple[tuple[str, str], ...]
    n_docs: int
    found_in: dict[str, int]

    def idf(self, word: str) -> float:
        return math.log(1 + (self.n_docs + 1) / (self.found_in.get(word, 0) + 1))

    def rarest(self, text: str, k: int) -> list[str]:
        words = text.split()
        return sorted(set(words), key=lambda w: (-self.idf(w), w))[:k]


def words(text: Column) -> Column:
    """The text's words with A-Z as a-z, none of a null or empty text.

    ``lower`` changes more than A-Z, but of all letters beyond ASCII only the Kelvin sign becomes a plain ASCII word letter,
    and no separator comes or goes, so elsewhere comparison with ASCII words gives the same.
    """
    plain = F.coalesce(text, F.lit(""))
    low = F.when(F.contains(plain, F.lit("K")), lower_ascii(text)).otherwise(F.lower(plain))
    inner = F.btrim(low, F.lit(_ENDS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SEPARATOR))


def build_index(docs: DataFrame, text: str = "text", templates=TEMPLATES, phrases=PHRASES) -> LicenceIndex:
    """Counts in how many documents each template word occurs; one row a word comes to the driver."""
    vocabulary = sorted({w for t in [*(t for _, t, _ in templates), *(p for _, p in phrases)] for w in t.split()})
    held = F.array_intersect(words(F.col(text)), F.lit(vocabulary))
    rows = docs.select(F.explode(F.concat(F.array(F.lit("")), held)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()
    found_in = {r["word"]: r["n"] for r in rows}
    return LicenceIndex(tuple(templates), tuple(phrases), found_in.pop("", 0), found_in)


def _constant(value: object, schema: str) -> Column:
    """A nested Python value as one literal; the optimiser folds it before the plan runs."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def _postings(entries: list[tuple[str, int, int]]) -> Column:
    """word -> array of (template, position)."""
    by: dict[str, list] = {}
    for w, t, p in entries:
        by.setdefault(w, []).append({"t": t, "p": p})
    return _constant(by, "map<string,array<struct<t:bigint,p:bigint>>>")


def scan_licences(docs: DataFrame, index: LicenceIndex, doc_id: str = "doc_id", text: str = "text", slack: int = SLACK, least: float = LEAST) -> DataFrame:
    """One row per document: doc_id, n_words, places, notices.

    ``places``, in order: (label, word, words) of every place where a phrase stands word for word, words counted from 0.
    ``notices``: (label, word, share) of every start of a template that was verified; the same notice may be found from several starts.
    Null and empty texts hold no words; rows repeated are rows of their own; further columns are not read.
    """
    phrases = [(label, p.split()) for label, p in index.phrases]
    notices = [(label, t.split(), key) for label, t, key in index.templates]
    exact = [(w, k, p) for k, (_, ws) in enumerate(phrases) for w in index.rarest(" ".join(ws), 1) for p, x in enumerate(ws) if x == w]
    anchors = [index.rarest(" ".join(ws), ANCHORS) for _, ws, _ in notices]
    loose = [(w, k, p) for k, (_, ws, _) in enumerate(notices) for w in anchors[k] for p, x in enumerate(ws) if x == w]
    rare = sorted({w for w, _, _ in exact + loose})

    table = _constant([
        {
            "label": label, "length": len(ws), "key": f" {key} ", "weight": sum(map(index.idf, sorted(set(ws))), 0.0), "need": min(2, len(anchors[k])),
            "vocabulary": [{"word": w, "idf": index.idf(w)} for w in sorted(set(ws))], "anchors": [{"word": w, "p": ws.index(w)} for w in anchors[k]],
        } for k, (label, ws, key) in enumerate(notices)
    ], "array<struct<label:string,length:int,key:string,weight:double,need:int,vocabulary:array<struct<word:string,idf:double>>,anchors:array<struct<word:string,p:bigint>>>>")
    literal = _constant([{"label": label, "length": len(ws), "words": ws} for label, ws in phrases], "array<struct<label:string,length:int,words:array<string>>>")

    d = docs.select(F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("w"))
    d = d.select("doc_id", "w", F.arrays_overlap("w", F.lit(rare)).alias("any"))
    hits = F.filter(F.transform("w", lambda x, i: F.struct(x.alias("word"), i.cast("long").alias("i"))), lambda h: h.word.isin(rare))
    none = F.array().cast("array<struct<word:string,i:bigint>>")
    d = d.select("doc_id", "w", F.when(F.col("any"), hits).otherwise(none).alias("hits"))

    def starts(entries: list[tuple[str, int, int]]) -> Column:
        postings = _postings(entries)
        known = sorted({w for w, _, _ in entries})
        of = lambda h: F.transform(F.element_at(postings, h.word), lambda q: q.t * _SHIFT + h.i - q.p + _BASE)
        return F.array_distinct(F.flatten(F.transform(F.filter("hits", lambda h: h.word.isin(known)), of)))

    as_start = lambda c: F.struct(F.shiftright(c, 40).cast("int").alias("t"), ((c % _SHIFT) - _BASE).cast("int").alias("at"))
    d = d.select(
        "doc_id", "w", F.size("w").alias("n"), F.transform(starts(exact), as_start).alias("exact"), F.transform(starts(loose), as_start).alias("loose"),
    )

    def stands(c: Column) -> Column:
        p = F.get(literal, c.t)
        return (c["at"] >= 0) & (F.slice("w", F.greatest(c["at"], F.lit(0)) + 1, p.length) == p.words)

    def agree(c: Column) -> Column:
        t = F.get(table, c.t)
        at = lambda a: F.slice("w", F.greatest(c["at"] + a.p - slack, F.lit(0)).cast("int") + 1, F.greatest(F.least(c["at"] + a.p + slack + 1, F.lit(2 * slack + 1)), F.lit(0)).cast("int"))
        return F.size(F.filter(t.anchors, lambda a: F.array_contains(at(a), a.word))) >= t.need

    def window(c: Column) -> Column:
        first = F.greatest(c["at"] - slack, F.lit(0))
        return F.slice("w", first + 1, F.greatest(c["at"] + F.get(table, c.t).length + slack - first, F.lit(0)))

    d = d.select("doc_id", "w", "n", F.filter("exact", stands).alias("exact"), F.filter("loose", agree).alias("loose"))
    seen = F.transform("loose", lambda c: F.struct(c.t.alias("t"), c["at"].alias("at"), window(c).alias("w")))
    d = d.select("doc_id", F.col("n").cast("long").alias("n_words"), "exact", seen.alias("seen"))

    def share(s: Column) -> Column:
        t = F.get(table, s.t)
        found = F.filter(t.vocabulary, lambda v: F.array_contains(s.w, v.word))
        return F.aggregate(found, F.lit(0.0), lambda acc, v: acc + v.idf) / t.weight

    keyed = F.filter("seen", lambda s: F.contains(F.concat(F.lit(" "), F.array_join(s.w, " "), F.lit(" ")), F.get(table, s.t).key))
    rated = F.transform(keyed, lambda s: F.struct(F.get(table, s.t).label.alias("label"), F.greatest(s["at"], F.lit(0)).cast("long").alias("word"), share(s).alias("share")))
    places = F.transform("exact", lambda c: F.struct(c["at"].cast("long").alias("word"), F.get(literal, c.t).label.alias("label"), F.get(literal, c.t).length.alias("words")))
    return d.select("doc_id", "n_words", F.array_sort(places).alias("places"), F.array_sort(F.filter(rated, lambda r: r.share >= least)).alias("notices"))


def label_licences(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of scanned documents.

    The score is 1 where a phrase stands word for word, else the largest share of a notice that was found, to nine digits, 0 without any.
    """
    base, more = F.col("places.label"), F.col("notices.label")
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return scanned.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.word").alias("first_word"), F.array_max("places.word").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, more)).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.round(F.least(F.coalesce(F.array_max("notices.share"), F.lit(0.0)), F.lit(1.0)), 9)).alias("score"),
    )
