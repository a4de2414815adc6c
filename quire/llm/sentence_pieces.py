"""SentencePiece encoding by streaming Viterbi, and decoding.

The best segmentation of a text into vocabulary pieces is found character by
character.  Only the last positions that a piece can still reach back to (the
longest piece's length) are kept; each holds the first boundary after the committed
part on its best path, and as soon as all of them agree on it, the piece before
it is committed and forgotten.  Memory is therefore bounded for any text.

A space is written as U+2581 and joined to the word after it.  No piece of such a
vocabulary holds U+2581 after another sign, so all paths converge before each word, and a worker may
remember the ids of the words it has met; short words are charted whole, many at a time, over arrays.  Characters outside the vocabulary become byte pieces.

The supplied model ranks its pieces by merges; a piece's log-probability follows from its rank by Zipf's law, so that
frequent and long pieces win.  A text's ids therefore differ from those of merging pair by pair, and decode to the same text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property
from itertools import batched, chain
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
CACHE = 100_000  # words a worker remembers before it starts anew
LITERAL = "\ud800"  # stands for a U+2581 of the text itself; no decoded text holds it
LETTER_MARK = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ][.,;:!?]")
ENDING = re.compile(r"(.*[A-Za-zÀ-ÖØ-öø-ÿ])([.,;:!?]+)", re.S)
MARKS = ".,;:!?"
SHORT = 64  # characters that are charted whole, being fewer than a window may grow to
TOGETHER = 4096  # words that are charted together
AT_ONCE = 400_000  # characters of texts whose new words are learned together
ROWS = 256  # values of an Arrow batch that are Python objects at a time
SEGMENT = re.compile(r" +[^ \n]*|\n[^ \n]*")


class Vocabulary:
    """Pieces with scores, byte pieces, and a memory of encoded words."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], byte_score: float):
        self.pieces, self.byte_ids, self.byte_score = pieces, byte_ids, byte_score
        self.longest = max(map(len, pieces), default=1)
        #: Paths converge before every word unless a piece has a space after another sign.
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in pieces) and not any("\n" in p for p in pieces)
        #: Paths converge between a letter and a mark unless a piece holds such a pair.
        self.by_mark = not any(LETTER_MARK.search(p) for p in pieces)
        self.words: dict[str, bytes] = {}
        self.keys: np.ndarray | None = None
        table = {i: p.replace(SPACE, " ").encode() for p, (i, _) in pieces.items()} | {i: bytes([b]) for b, i in enumerate(byte_ids)}
        self.table = [table.get(i, b"") for i in range(max(table) + 1)]

    @cached_property
    def beginnings(self) -> set[str]:
        return {p[:k] for p in self.pieces for k in range(1, len(p) + 1)}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces, byte_ids = {}, [0] * 256
        for i in range(n):
            text = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(text[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces[text] = (i, 0.0)
        rank = {p: r for r, p in enumerate(sorted(pieces, key=lambda p: pieces[p][0]), 2)}
        total = log(sum(1 / r for r in rank.values()))
        return cls({p: (i, -log(rank[p]) - total) for p, (i, _) in pieces.items()}, byte_ids, -log(n) - total - 1)

    def stream(self, text, out: list[int]) -> int:
        """Appends the ids of the best segmentation of ``text`` (an iterable of characters) to ``out``; the widest window that was held."""
        window, base, done = "", 0, 0  # characters base.. of the text; ids are committed up to done
        score, back, piece, first = {0: 0.0}, {}, {}, {}
        widest = at = 0
        for ch in text:
            window += ch
            at += 1
            best, where, ids = None, 0, ()
            for start in range(at - 1, max(at - self.longest, done) - 1, -1):
                part = window[start - base :]
                if start in score and (hit := self.pieces.get(part)) is not None and (best is None or score[start] + hit[1] >= best):
                    best, where, ids = score[start] + hit[1], start, (hit[0],)
            if ch not in self.pieces:  # unknown, or a space sign of the text itself
                raw = (SPACE if ch == LITERAL else ch).encode()
                by_bytes = score[at - 1] + self.byte_score * len(raw)
                if best is None or by_bytes > best:
                    best, where, ids = by_bytes, at - 1, tuple(self.byte_ids[b] for b in raw)
            score[at], back[at], piece[at] = best, where, ids
            first[at] = at if where == done else first[where]
            low = max(at - self.longest + 1, done)
            while len(ends := {first[j] if j > done else None for j in range(low, at + 1)}) == 1 and None not in ends:
                done = self._commit(ends.pop(), at, done, back, piece, first, out)
                low = max(low, done)
            for j in [j for j in score if j < low]:
                del score[j]
            keep = min(low, done)
            window, base = window[keep - base :], keep
            widest = max(widest, len(window))
        path = []
        while at > done:
            path.append(piece[at])
            at = back[at]
        for ids in reversed(path):
            out.extend(ids)
        return widest

    @staticmethod
    def _commit(end: int, at: int, done: int, back: dict, piece: dict, first: dict, out: list[int]) -> int:
        """Commits the piece that ends at ``end`` and finds the first boundaries after it."""
        out.extend(piece[end])
        for j in [j for j in back if j <= end]:
            del back[j], piece[j], first[j]
        for j in sorted(back):
            first[j] = j if back[j] == end else first.get(back[j], done)
        return end

    def chart(self, text: str) -> list[int]:
        """Ids of a short text's best segmentation, the same as :meth:`stream` commits, from one forward pass over the whole of it."""
        n, pieces, beginnings = len(text), self.pieces, self.beginnings
        score: list[float | None] = [0.0] + [None] * n
        back: list[tuple[int, tuple[int, ...]]] = [(0, ())] * (n + 1)
        for i in range(n):
            here = score[i]
            for j in range(i + 1, min(i + self.longest, n) + 1):
                part = text[i:j]
                if part not in beginnings:
                    break
                hit = pieces.get(part)
                if hit is not None and (score[j] is None or here + hit[1] > score[j]):
                    score[j], back[j] = here + hit[1], (i, (hit[0],))
            ch = text[i]
            if ch not in pieces:
                raw = (SPACE if ch == LITERAL else ch).encode()
                by_bytes = here + self.byte_score * len(raw)
                if score[i + 1] is None or by_bytes > score[i + 1]:
                    score[i + 1], back[i + 1] = by_bytes, (i, tuple(self.byte_ids[b] for b in raw))
        path, at = [], n
        while at:
            at, ids = back[at]
            path.append(ids)
        return [i for ids in reversed(path) for i in ids]

    def _build_trie(self) -> None:
        """Children by (node, character) as a sorted array of keys, and every node's piece."""
        nodes: dict[int, int] = {}
        held: dict[int, tuple[int, float]] = {}
        for p, hit in self.pieces.items():
            at = 0
            for ch in p:
                at = nodes.setdefault(at << 21 | ord(ch), len(nodes) + 1)
            held[at] = hit
        self.keys = np.array(sorted(nodes), np.int64)
        self.child = np.array([nodes[k] for k in self.keys.tolist()], np.int64)
        self.node_score, self.node_id = np.full(len(nodes) + 1, -np.inf), np.zeros(len(nodes) + 1, np.int64)
        for at, (i, score) in held.items():
            self.node_score[at], self.node_id[at] = score, i

    def chart_many(self, texts: list[str]) -> list[bytes]:
        """The ids of every text as :meth:`chart` finds them, in one pass over all of them position by position."""
        if self.keys is None:
            self._build_trie()
        size = np.array([len(t) for t in texts])
        n, flat = int(size.max()), np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        signs = np.full((len(texts), n), -1, np.int64)
        signs[np.arange(n) < size[:, None]] = flat
        score = np.full((n + 1, len(texts)), -np.inf)
        back, piece = np.zeros((n + 1, len(texts)), np.int64), np.zeros((n + 1, len(texts)), np.int64)
        score[0] = 0.0
        last = len(self.keys) - 1
        for i in range(n):
            rows = np.flatnonzero(size > i)
            node, here = np.zeros(len(rows), np.int64), score[i]
            for j in range(i + 1, min(i + self.longest, n) + 1):
                key = node << 21 | signs[rows, j - 1]  # -1 after a text's end fits no key
                at = np.minimum(np.searchsorted(self.keys, key), last)
                on = self.keys[at] == key
                rows, node = rows[on], self.child[at[on]]
                if j == i + 1:
                    alone = np.zeros(len(texts), bool)
                    alone[rows[self.node_score[node] > -np.inf]] = True
                if not len(rows):
                    break
                found = here[rows] + self.node_score[node]
                better = found > score[j, rows]
                up = rows[better]
                score[j, up], back[j, up], piece[j, up] = found[better], i, self.node_id[node[better]]
            for k in np.flatnonzero((size > i) & ~alone):  # bytes: -1 stands for those of the character
                ch = texts[k][i]
                by_bytes = here[k] + self.byte_score * len((SPACE if ch == LITERAL else ch).encode())
                if by_bytes > score[i + 1, k]:
                    score[i + 1, k], back[i + 1, k], piece[i + 1, k] = by_bytes, i, -1
        # Back along the best paths of all texts at once; a path's ids end in the last column.
        path, at, left = np.zeros((len(texts), n), "<u4"), size.copy(), np.full(len(texts), n)
        raw: dict[int, list[tuple[int, int]]] = {}
        rows = np.flatnonzero(at > 0)
        while len(rows):
            ids = piece[at[rows], rows]
            left[rows] -= 1
            path[rows, left[rows]] = np.maximum(ids, 0)
            for k in rows[ids < 0].tolist():
                raw.setdefault(k, []).append((int(left[k]), int(at[k]) - 1))
            at[rows] = back[at[rows], rows]
            rows = rows[at[rows] > 0]
        out = [path[k, first:].tobytes() for k, first in enumerate(left.tolist())]
        for k, places in raw.items():
            ids = [[i] for i in path[k].tolist()]
            for place, i in places:
                ids[place] = [self.byte_ids[b] for b in (SPACE if texts[k][i] == LITERAL else texts[k][i]).encode()]
            out[k] = np.array([i for part in ids[left[k] :] for i in part], "<u4").tobytes()
        return out

    def _segments(self, texts: list[str]) -> dict[str, bytes]:
        """Ids of segments: short ones in charts of texts of like length, longer ones one by one."""
        signs = {t: t.replace(SPACE, LITERAL).replace(" ", SPACE) for t in texts}
        short = sorted((t for t in texts if 0 < len(signs[t]) <= SHORT), key=lambda t: len(signs[t]))
        ids = {}
        for k in range(0, len(short), TOGETHER):
            part = short[k : k + TOGETHER]
            ids.update(zip(part, self.chart_many([signs[t] for t in part]), strict=True))
        for t in texts:
            if t not in ids:
                out: list[int] = []
                self.stream(signs[t], out)
                ids[t] = np.array(out, "<u4").tobytes()
        return ids

    def _learn(self, new: set[str]) -> None:
        """Ids of words; the key of a segment that begins with a space leaves that out."""
        text = lambda key: key if self.by_word and key[:1] == "\n" else " " + key
        parts = {k: m for k in new if self.by_mark and k[-1:] in MARKS and k and (m := ENDING.fullmatch(k))}
        stems = (new - parts.keys()) | {m[1] for m in parts.values()}
        marks = {m[2] for m in parts.values()}
        ids = self._segments([*map(text, stems), *marks])
        self.words.update((k, ids[text(k)]) for k in stems)
        self.words.update((k, self.words[m[1]] + ids[m[2]]) for k, m in parts.items())

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes | None]:
        """Ids as little-endian unsigned 32-bit bytes; a text is read as if a space stood before it, an empty one has none, null stays null."""
        held: list[list[str] | None] = []
        size = 0
        for t in texts:
            held.append(None if t is None else self._words_of(t))
            size += len(t or "")
            if size >= AT_ONCE:
                yield from self._coded(held)
                held, size = [], 0
        yield from self._coded(held)

    def _words_of(self, text: str) -> list[str]:
        if not text:
            return []
        if not self.by_word:
            return [text]
        if "  " in text or " \n" in text or text[0] in " \n" or text[-1] == " ":
            return [s[1:] if s[0] == " " else s for s in SEGMENT.findall(" " + text)]
        return text.replace("\n", " \n").split(" ")

    def _coded(self, texts: list[list[str] | None]) -> Iterator[bytes | None]:
        every = set().union(*(t for t in texts if t is not None))
        if new := every.difference(self.words):
            if len(self.words) > CACHE:
                self.words.clear()
                new = every
            self._learn(new)
        known = self.words.__getitem__
        for words in texts:
            yield None if words is None else b"".join(map(known, words))

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_vocabularies: dict[str, Vocabulary] = {}


def _vocabulary(path: str) -> Vocabulary:
    """One vocabulary a worker, for encoding and decoding and from task to task."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary.load(path)
    return _vocabularies[path]


def _in_parts(values: pa.Array, f: Callable[[Iterator], Iterator], kind: pa.DataType) -> pa.Array:
    """``f`` over a whole batch, of which only a few values at a time are Python objects."""
    each = chain.from_iterable(values.slice(k, ROWS).to_pylist() for k in range(0, len(values), ROWS))
    return pa.concat_arrays([pa.array([], kind), *(pa.array(part, kind) for part in batched(f(each), ROWS))])


def encode(docs: DataFrame, model: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the ids of every whole text in ``out``, as little-endian unsigned 32-bit bytes.

    Null stays null and empty has no ids; other columns pass unread, and one named like ``out`` is replaced.
    """
    @F.arrow_udf("binary")
    def run(texts: pa.Array) -> pa.Array:
        return _in_parts(texts, _vocabulary(model).encode_all, pa.binary())

    # Marked so that Spark computes the ids once, however many columns are made of them.
    return docs.withColumn(out, run.asNondeterministic()(F.col(text)))


def decode(docs: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the text of ``ids`` in ``out``; null stays null."""
    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        pieces = _vocabulary(model)
        return _in_parts(values, lambda each: (None if v is None else pieces.decode(v) for v in each), pa.string())

    return docs.withColumn(out, run(F.col(ids)))
