"""Streaming Viterbi against the whole chart, bounded windows, and round trips."""

import random

import numpy as np
import public_tokenizers

from quire.llm import sentence_pieces
from quire.llm.sentence_pieces import LITERAL, SPACE, Vocabulary

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "hello  world", "  a b ", " \n\tx\n\ny \n", f"a{SPACE}b {SPACE}{SPACE}", "é…①𝄞", "a\0b", "one two\nthree", "\n", "a\n b", "ends ", "end. Next, e.g. this!?\nNo.", "日本語 テキスト", "x" * 3000]


def chart(v, text):
    """Score of the best segmentation, from the whole chart."""
    best = [0.0]
    for i in range(1, len(text) + 1):
        options = [best[j] + v.pieces[text[j:i]][1] for j in range(max(0, i - v.longest), i) if text[j:i] in v.pieces]
        if text[i - 1] not in v.pieces:
            options.append(best[i - 1] + v.byte_score * len((SPACE if text[i - 1] == LITERAL else text[i - 1]).encode()))
        best.append(max(options))
    return best[-1]


def score_of(v, ids):
    named = {i: s for i, s in v.pieces.values()} | dict.fromkeys(v.byte_ids, v.byte_score)
    return sum(named[i] for i in ids)


def test_stream_finds_the_best_score_in_a_bounded_window():
    v = Vocabulary.load(MODEL)
    rng = random.Random(1)
    words = ["internationalisation", "thththe", "aaaaaaa", f"{SPACE}un", LITERAL, "①", "ofanon", SPACE * 5]
    for _ in range(150):
        text = "".join(rng.choice(words) for _ in range(rng.randint(1, 12)))
        ids = []
        v.stream(iter(text), ids)
        assert abs(score_of(v, ids) - chart(v, text)) < 1e-6 and v.chart(text) == ids
    small = Vocabulary({"a": (1, -3.0), "aa": (2, -4.0), "aaa": (3, -5.5), "b": (4, -1.0), "ab": (5, -9.0)}, list(range(10, 266)), -20.0)
    for _ in range(300):
        text = "".join(rng.choice("aab?") for _ in range(rng.randint(0, 40)))
        ids = []
        small.stream(text, ids)
        assert abs(score_of(small, ids) - chart(small, text)) < 1e-9 and small.chart(text) == ids
        assert "".join(small.table[i].decode() for i in ids) == text
    ids = []
    assert v.stream("internationalisation" * 2000, ids) < 400 and len(ids) >= 2000


def test_charts_of_many_words_equal_charts_of_one():
    v = Vocabulary.load(MODEL)
    small = Vocabulary({"a": (1, -3.0), "aa": (2, -4.0), "aaa": (3, -5.5), "b": (4, -1.0), "ab": (5, -9.0)}, list(range(10, 266)), -20.0)
    rng = random.Random(3)
    for vocabulary, alphabet in ((v, ["the", "ing", "é", "①", LITERAL, SPACE, "𝄞", "x", "日", "."]), (small, ["a", "a", "b", "?", "é"])):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 15))) for _ in range(700)]
        assert [np.frombuffer(ids, "<u4").tolist() for ids in vocabulary.chart_many(texts)] == [vocabulary.chart(t) for t in texts]


def test_texts_together_equal_texts_alone(monkeypatch):
    monkeypatch.setattr(sentence_pieces, "AT_ONCE", 40)
    monkeypatch.setattr(sentence_pieces, "CACHE", 5)
    v = Vocabulary.load(MODEL)
    texts = [*TEXTS, None, "y" * 200, "\nab.", "ab.", ".", "?!"] * 2
    assert list(v.encode_all(texts)) == [None if t is None else Vocabulary.load(MODEL).encode(t) for t in texts]
    assert list(v.encode_all([])) == []
    joined = Vocabulary({"a ": (1, -1.0), "\n": (2, -1.0), f"x{SPACE}y": (3, -1.0), SPACE: (4, -5.0)}, list(range(10, 266)), -20.0)
    assert not joined.by_word and joined.decode(joined.encode("\nx y")) == "\nx y"


def test_words_remembered_equal_whole_stream():
    v = Vocabulary.load(MODEL)
    assert v.by_word
    for t in TEXTS:
        ids = []
        v.stream((" " + t).replace(SPACE, LITERAL).replace(" ", SPACE) if t else "", ids)
        assert np.frombuffer(v.encode(t), "<u4").tolist() == ids, t
        assert v.decode(v.encode(t)) == t


def test_columns_round_trip(spark):
    rng = random.Random(2)
    rows = [(k, t, "x") for k, t in enumerate([*TEXTS, None])] + [(99, "".join(rng.choice("ab \n\0é\U0001f389") for _ in range(500)), "x")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sentence_pieces.decode(sentence_pieces.encode(df, MODEL), MODEL).collect()
    assert len(got) == len(rows) and all(r.text == r.decoded for r in got)
    assert sentence_pieces.encode(df.limit(0), MODEL).count() == 0


def test_a_batch_is_taken_apart_a_few_values_at_a_time():
    import pyarrow as pa

    most = 0

    class Taken:
        def __init__(self, values, start=0, n=None):
            self.values, self.start, self.n = values, start, len(values) if n is None else n

        def __len__(self):
            return self.n

        def slice(self, k, n):
            return Taken(self.values, k, min(n, self.n - k))

        def to_pylist(self):
            nonlocal most
            most = max(most, self.n)
            return self.values[self.start : self.start + self.n]

    values = [None if i % 7 == 0 else str(i) for i in range(1000)]
    got = sentence_pieces._in_parts(Taken(values), iter, pa.string())
    assert got.to_pylist() == values and most <= sentence_pieces.ROWS
    assert sentence_pieces._in_parts(pa.array([], pa.string()), iter, pa.string()).to_pylist() == []
