"""Best-fit packing of documents into sequences of bounded length.

Bulk-synchronous best fit.  Pieces and the gaps of open sequences are kept
sorted by size, as runs of equal size: all pieces of one length are
interchangeable, so a run is (length, from rank, to rank), and there are at
most as many runs of pieces as a sequence has places, whatever the corpus holds.  One
range sort of the pieces gives every piece its rank inside its length.

A round is one sweep over the runs.  It gives every length the smallest gap
that holds it; lengths that want the same gap are served by rank, the longest
first; every served sequence's gap shrinks by what it took.  Lengths longer than
every gap open a share of the sequences that their total needs at least.  Rounds repeat
until no piece is left.  A move covers a whole interval of ranks, so the sweeps
handle thousands of numbers for any number of pieces, and finding each piece's place by its
rank is one broadcast join over all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import written
from quire.llm.tokens import WordTokenizer

CAPACITY = 4096
END_ID = 1
OPENED_AT_ONCE = 4  # new sequences open in portions of one in so many of those needed at least; more portions pack tighter
L = "long"


def document_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and with ``with_ids`` the ids as little-endian bytes.

    A document's ids are its tokens and then ``END_ID``; only documents longer
    than ``capacity`` are cut.  Null counts as empty, which still has its end id.
    """
    out = "doc_id {}, piece int, start long, length long, ids_crc32 long".format(dict(docs.dtypes)[doc_id]) + ", ids binary" * with_ids
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _tokenizer(tokenizer)
        for batch in batches:
            at, rows = [], []
            for k, ids in enumerate(coder.encode_all(batch.column(1).to_pylist())):
                ids += end
                for i in range(0, len(ids), 4 * capacity):
                    part = ids[i : i + 4 * capacity]
                    at.append(k)
                    rows.append((i // (4 * capacity), i // 4, len(part) // 4, crc32(part), *((part,) if with_ids else ())))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)] if rows else [pa.array([], t) for t in kinds[: 4 + with_ids]]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns) + 1]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(cut, out)


_tokenizers: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    """One tokenizer a worker, kept from task to task with the words it has met."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def _sweep(docs: dict[int, list[int]], gaps: dict[int, list[list[int]]], small: int) -> list[tuple[int, int, int, int, int, int]]:
    """One round over the runs: moves (len, lo, hi, per, bin, gap); ``docs`` and ``gaps`` keep what was not matched.

    Going up through the sizes, a gap serves the longest run still waiting below it, so a length gets its
    successor gap; where several lengths want one gap the longest has the better rank and the others wait for the next.
    """
    moves, waiting = [], []
    for size, is_gap in sorted([(n, False) for n in docs] + [(g, True) for g in gaps]):
        if not is_gap:
            waiting.append(size)
            continue
        open_bins = gaps.pop(size)
        while open_bins and waiting:
            n = waiting[-1]
            lo, hi = docs[n]
            first, last = open_bins[-1]
            per = size // n if n <= small else 1  # many short ones at once, else a round for each
            bins = min(last - first, -(-(hi - lo) // per))
            end = min(hi, lo + bins * per)
            moves.append((n, lo, end, per, first, size))
            docs[n][0], open_bins[-1][0] = end, first + bins
            if end == hi:
                del docs[n]
                waiting.pop()
            if first + bins == last:
                open_bins.pop()
        if open_bins:
            gaps[size] = open_bins
    return moves


def best_fit_moves(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Moves that place ``counts`` pieces of each length.

    A move (len, lo, hi, per, bin, gap) puts the pieces of ranks lo..hi of a length, ``per`` to a
    sequence, into the sequences from ``bin`` on, which had ``gap`` places left.
    """
    docs = {n: [0, c] for n, c in counts.items() if c}
    gaps: dict[int, list[list[int]]] = {}
    moves, opened = [], 0

    def place(move: tuple[int, int, int, int, int, int]) -> None:
        n, lo, hi, per, first, gap = move
        full, rest = divmod(hi - lo, per)
        for left, a, b in ((gap - per * n, first, first + full), (gap - rest * n, first + full, first + full + (rest > 0))):
            if a < b and left:
                runs = gaps.setdefault(left, [])
                if runs and runs[-1][1] == a:
                    runs[-1][1] = b
                else:
                    runs.append([a, b])
        moves.append(move)

    while docs:
        for move in _sweep(docs, gaps, capacity // 16):
            place(move)
        # Longer than every gap: a share of the new sequences that their total needs, for the longest; lengths
        # over half a sequence never share one with their like, so all of those open at once.
        lone = sorted((n for n in docs if n > max(gaps, default=0)), reverse=True)
        room = -(-sum(n * (docs[n][1] - docs[n][0]) for n in lone) // (OPENED_AT_ONCE * capacity))
        for n in lone:
            lo, hi = docs[n]
            per = capacity // n if 16 * n <= capacity else 1
            bins = min(-(-(hi - lo) // per), hi - lo if 2 * n > capacity else max(room, 0))
            room -= bins
            if bins:
                docs[n][0] = min(hi, lo + bins * per)
                place((n, lo, docs[n][0], per, opened, capacity))
                opened += bins
            if docs[n][0] == hi:
                del docs[n]
    return moves


def pack(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length", order: tuple[str, ...] = ()) -> DataFrame:
    """``pieces`` (each of 1 to ``capacity`` places) with sequence_id and offset; columns of those names are replaced.

    Pieces of equal length are told apart by their rank in a range sort over length and ``order``, so a
    length that a third of all pieces have is spread over many tasks.  An empty table gives an empty result.
    """
    keep = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    ordered = pieces.select(*keep).repartitionByRange(F.col(length), *order).sortWithinPartitions(length, *order)
    ranked = written(ordered.withColumn("__row", F.monotonically_increasing_id()), "ranked")
    # One row for each length and partition that has it: at most capacity plus the number of partitions.
    part = F.shiftright("__row", 33)
    firsts = ranked.groupBy(F.col(length).cast("int").alias("len"), part.alias("part")).agg(F.min("__row").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = written(firsts.withColumn("base", F.sum("n").over(Window.partitionBy("len").orderBy("part")) - F.col("n")), "firsts")
    counts = {r["len"]: r["n"] for r in firsts.groupBy("len").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    moves = pieces.sparkSession.createDataFrame(best_fit_moves(counts, capacity), "len int, lo long, hi long, per long, bin long, gap int")
    # Both sides broadcast below are bounded by the capacity times the rounds, whatever the number of pieces.
    at = ranked.join(F.broadcast(firsts.select("len", F.col("part").alias("__part"), "first", "base")), (F.col(length) == F.col("len")) & (part == F.col("__part"))).select(
        *keep, (F.col("__row") - F.col("first") + F.col("base")).alias("__rank")
    )
    j = F.col("__rank") - F.col("lo")
    return at.join(F.broadcast(moves), (F.col(length) == F.col("len")) & (F.col("__rank") >= F.col("lo")) & (F.col("__rank") < F.col("hi"))).select(
        *keep, (F.col("bin") + F.floor(j / F.col("per"))).cast(L).alias("sequence_id"),
        (F.lit(capacity) - F.col("gap") + (j % F.col("per")) * F.col("len")).cast(L).alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents, packed: doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset.

    Rows are packed one by one, so repeated rows and null ids are packed like others.
    """
    pieces = written(document_pieces(docs, tokenizer, capacity, doc_id, text, with_ids), "pieces")
    return pack(pieces, capacity, order=("ids_crc32", "doc_id", "piece"))
