"""Whole texts to token ids with a public tokenizer, remembering words.

The tokenizer used here drops white space and never merges across it, so a
text's ids are its words' ids in a row; a worker keeps the ids of the words it
has met.  Words that are plain letters with at most one mark are taken apart
further; letters need no normalising but lower case and no splitting, so new ones go straight to
the tokenizer's merges.  A tokenizer of another build, where that does not give what it gives for whole texts, is called for each.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np

CACHE = 250_000  # words a worker remembers before it starts anew
AT_ONCE = 1_000_000  # characters whose words are learned together
# The byte alphabet of the merges: bytes that are no printable sign stand for the characters from 256 on, in order.
_SIGNS = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_LETTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SIGNS)}
MARKS = frozenset((b".", b",", b";", b":", b"!", b"?"))
WORD = re.compile(r"^(?:([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]?)|([^\n]+))$", re.M)


class WordTokenizer:
    """Ids of texts as little-endian unsigned 32-bit bytes, equal to ``encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain: bool | None = None
        self.words: dict[bytes, bytes] = {}
        self.stems: dict[bytes, bytes] = {}

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _merged(self, stems: list[bytes]) -> list[bytes]:
        """Ids of lower-case letters from the merges alone, in their byte alphabet."""
        tokenize = self.tokenizer.model.tokenize
        found = (tokenize(s.decode() if s.isascii() else s.decode("latin-1").translate(BYTE_LETTERS)) for s in stems)
        return [array("I", [t.id for t in tokens]).tobytes() for tokens in found]

    def _learn_stems(self, stems: set[bytes]) -> None:
        if self.plain is None:  # tried once: letters of all kinds, and the vocabulary's own words
            sample = [w for t in self.tokenizer.get_vocab() if (w := t.removesuffix("</w>")).isalpha() and w.isascii() and w.islower()][::8]
            sample += [chr(c) * n + t for c in range(0xDF, 0x100) if c != 0xF7 for n in (1, 2) for t in ("", "ab")]
            self.plain = all(ids == self._encode(s).tobytes() for s, ids in zip(sample, self._merged([s.encode() for s in sample]), strict=True))
        order = list(stems)
        self.stems.update(zip(order, self._merged(order) if self.plain else [self._encode(s.decode()).tobytes() for s in order], strict=True))

    def _learn(self, words: set[bytes]) -> None:
        if len(self.stems) > CACHE:
            self.stems = {}
        # Most words are ASCII letters, alone or with a mark; the pattern takes those with other letters apart.
        alone = [w for w in words if w.isalpha()]
        marked = [w for w in words if w[-1:] in MARKS and w[:-1].isalpha()]
        rest = list(words.difference(alone, marked))
        stems = [w.lower() for w in alone], [w[:-1].lower() for w in marked]
        found = WORD.findall(b"\n".join(rest).decode()) if rest else []
        parts = [(w, stem.lower().encode(), mark.encode()) for w, (stem, mark, _) in zip(rest, found, strict=True) if stem]
        others = [(w, other) for w, (stem, _, other) in zip(rest, found, strict=True) if not stem]
        known = self.stems
        if new := {*stems[0], *stems[1], *(stem for _, stem, _ in parts)}.difference(known):
            self._learn_stems(new)
        known[b""] = b""
        for mark in MARKS.difference(known):
            known[mark] = self._encode(mark.decode()).tobytes()
        self.words.update(zip(alone, map(known.__getitem__, stems[0]), strict=True))
        self.words.update((w, known[stem] + known[w[-1:]]) for w, stem in zip(marked, stems[1], strict=True))
        self.words.update((w, known[stem] + known[mark]) for w, stem, mark in parts)
        if others:
            coded = self.tokenizer.encode_batch_fast([other for _, other in others], add_special_tokens=False)
            self.words.update((w, np.array(c.ids, "<u4").tobytes()) for (w, _), c in zip(others, coded, strict=True))

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of every text; the words of some ``AT_ONCE`` characters are learned together."""
        held, size = [], 0
        for text in texts:
            held.append(text.encode().split())
            size += len(text)
            if size >= AT_ONCE:
                yield from self._coded(held)
                held, size = [], 0
        yield from self._coded(held)

    def _coded(self, texts: list[list[bytes]]) -> Iterator[bytes]:
        all_words = set().union(*texts)
        if new := all_words.difference(self.words):
            if len(self.words) > CACHE:  # words of these texts stay
                self.words = {w: self.words[w] for w in all_words.intersection(self.words)}
            self._learn(new)
        known = self.words.__getitem__
        for words in texts:
            yield b"".join(map(known, words))
