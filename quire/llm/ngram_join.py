"""Exact Jaccard self-join of documents on word shingles, by set-relation skipping.

*Sets.* A document's set holds the hashes of its distinct three-word shingles.
Documents with the same set are one class; only classes are compared.

*Order.* Prefix filtering needs one order of shingles for all sets.  Shingles found many
times over (counted in every task over all documents) come last, the most frequent ones at the very end, so index lists
hold rare shingles; the order never changes a result.

*Index lists and block skipping.* A set is listed under the shingles of its
prefix with its position there and its size.  Lists are cut into blocks by size; a set probes only the
blocks of sizes that can reach the threshold, and passes over entries whose
positions leave too few shingles to share.  The smaller set of a pair is found in a shorter prefix.

*Answers from similar sets.* In each list the smallest set leads.  First every
set is compared with its leaders; a set found similar takes over the leader's
answers (its component), so lists whose sets all have one answer are skipped
whole.  Then only pairs with different answers so far are compared.  A group of n near
copies thus costs about n comparisons, not n squared, and no link between
components is lost.

Candidates are first held against bit sketches, which pass every pair that
reaches the threshold, and then verified on the words themselves, not on hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import components, written

WORDS_PER_SHINGLE, SIMILAR, OF = 3, 90, 100
CACHE = 300_000
CHUNK = 4_000_000  # shingles counted together in a task
MAX_FREQUENT = 500_000  # longest list of frequent shingles; only the order depends on it, not the result


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_hashes(text: str, hashes: dict, k: int = WORDS_PER_SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; of fewer than ``k`` words the whole is one shingle."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b"\0" + b" ".join(words))], np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    x = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        x = (x ^ h[j : len(h) - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return np.unique(x)


def shingles(text: str, k: int = WORDS_PER_SHINGLE) -> set:
    """A text's shingles themselves."""
    words = text.encode().lower().split()
    return set(zip(*(words[j:] for j in range(k)), strict=False)) if len(words) >= k else {tuple(words)} if words else set()


def frequent_shingles(texts: DataFrame, k: int, least: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Hashes found ``least`` times or more, as far as tasks met them repeatedly, sorted, and their counts; at most ``MAX_FREQUENT``."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, held, size = _Hashes(), [], 0

        def flush() -> pd.DataFrame:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            many = n >= 2
            held.clear()
            return pd.DataFrame({"h": h[many].view(np.int64), "n": n[many]})

        for batch in batches:
            for t in batch["t"]:
                held.append(shingle_hashes(t, hashes, k))
                size += len(held[-1])
                if size >= CHUNK:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    top = texts.select("t").mapInPandas(counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    rows = top.orderBy(F.col("n").desc(), "h").limit(MAX_FREQUENT).toPandas()
    h, n = rows["h"].to_numpy(np.int64).view(np.uint64), np.minimum(rows["n"].to_numpy(np.int64), 1 << 31).astype(np.uint32)
    order = np.argsort(h)
    return h[order], n[order]


def prefix(h: np.ndarray, length: int, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first ``length`` of a set's hashes: rare ones by hash, then frequent ones by their count."""
    known, counts = frequent
    if not len(known) or not len(h):
        return h[:length]
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    often = known[at] == h
    rare = h[~often]
    if len(rare) >= length:
        return rare[:length]
    late, n = h[often], counts[at[often]]
    return np.concatenate([rare, late[np.lexsort((late, n))]])[:length]


def sketch(h: np.ndarray) -> bytes:
    """Parities of a set's hashes in as many bins as half its size needs. Two sets differ in at least as many hashes as their sketches in bins."""
    bins = 1 << max(7, (len(h) // 2).bit_length())
    return np.packbits((np.bincount((h & np.uint64(bins - 1)).astype(np.int64), minlength=bins) & 1).astype(np.uint8)).tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Bins in which two sketches differ; the larger one is folded to the size of the smaller."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _block(n):
    """Sizes in blocks that grow by the tenth they may differ; rising with the size."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(10 / 9))).cast("int")


def _possible(pairs: DataFrame, classes: DataFrame, similar: int, of: int) -> DataFrame:
    """Pairs (x, y) whose sketches allow the threshold; no pair that reaches it is left out."""

    @F.pandas_udf("boolean")
    def may(a: pd.Series, b: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        return pd.Series([(similar + of) * differing(s, t) <= (of - similar) * (n + m) for s, t, n, m in zip(a, b, na, nb, strict=True)], dtype=bool)

    left, right = (classes.select(F.col("s").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"k{c}")) for c in "xy")
    return written(pairs.join(left, "x").join(right, "y").where(may("kx", "ky", "nx", "ny")).select("x", "y"), "possible")


MARKS = 1 << 24


def _texts_of(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(s, t): the text of one document of each class in ``pairs``.

    Documents are passed over by a bitmap of the wanted texts' hashes, of fixed size, before any text moves; copies are told apart by their id.
    """
    named = pairs.select(F.col("x").alias("s")).union(pairs.select(F.col("y").alias("s"))).distinct()
    wanted = written(named.join(classes.select("s", "rep", "one.t1", "one.t2"), "s"), "wanted")
    mark = F.pmod("t1", F.lit(MARKS))
    words = wanted.groupBy(F.floor(mark / 64).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(t1, {MARKS}) % 64 as int))")).alias("v")).toPandas()
    bitmap = np.zeros(MARKS // 64, np.uint64)
    bitmap[words["w"]] = words["v"].to_numpy(np.int64).view(np.uint64)

    @F.pandas_udf("boolean")
    def marked(at: pd.Series) -> pd.Series:
        m = at.to_numpy(np.int64)
        return pd.Series((bitmap[m >> 6] >> (m & 63).astype(np.uint64) & np.uint64(1)).astype(bool))

    some = texts.where(marked(mark))
    found = some.join(wanted, ["t1", "t2"]).where(F.col("rep").isNull() | (F.col("doc_id") == F.col("rep"))).select("s", "t")
    return written(found.dropDuplicates(["s"]), "texts")


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, k: int, similar: int, of: int) -> DataFrame:
    """The pairs (a, b) of classes whose representatives' shingle sets reach the threshold."""

    @F.pandas_udf("boolean")
    def reach(a: pd.Series, b: pd.Series) -> pd.Series:
        out, last, sets = [], None, None
        for s, t in zip(a, b, strict=True):
            if t != last:
                last, sets = t, shingles(t, k)
            other = shingles(s, k)
            inter = len(other & sets)
            out.append(of * inter >= similar * (len(other) + len(sets) - inter))
        return pd.Series(out, dtype=bool)

    pairs = _possible(pairs, classes, similar, of)
    one = _texts_of(pairs, classes, texts)
    both = pairs.join(one.select(F.col("s").alias("x"), F.col("t").alias("tx")), "x").join(one.select(F.col("s").alias("y"), F.col("t").alias("ty")), "y")
    return written(both.where(reach("tx", "ty")).select(F.col("x").alias("a"), F.col("y").alias("b")), "links")


def _unanswered(live: DataFrame, links: DataFrame, tested: DataFrame, similar: int, of: int) -> DataFrame:
    """Pairs (x, y) with different answers so far that share a list, in blocks and at positions that can reach the threshold."""
    comp = components(links, "answers")
    named = live.join(comp.withColumnRenamed("node", "s"), "s", "left").withColumn("component", F.coalesce("component", "s"))
    mixed = named.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
    named = written(named.join(mixed, "token", "left_semi"), "mixed")
    low = F.ceil(F.lit(similar) * F.col("n") / F.lit(of))
    probe = named.select(
        "token", F.col("s").alias("x"), F.col("n").alias("nx"), F.col("pos").alias("px"), F.col("component").alias("cx"),
        F.explode(F.sequence(_block(low), _block(F.col("n")))).alias("block"),
    )
    index = named.where("listed").select(
        F.col("token").alias("list"), F.col("s").alias("y"), F.col("n").alias("ny"), F.col("pos").alias("py"), F.col("component").alias("cy"), _block(F.col("n")).alias("sizes")
    )
    reachable = (
        (F.col("token") == F.col("list")) & (F.col("block") == F.col("sizes")) & (F.col("cx") != F.col("cy"))
        & ((F.col("ny") < F.col("nx")) | ((F.col("ny") == F.col("nx")) & (F.col("y") < F.col("x")))) & (of * F.col("ny") >= similar * F.col("nx"))
        & ((similar + of) * F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) >= similar * (F.col("nx") + F.col("ny")))
    )
    return written(probe.join(index, reachable).select("x", "y").distinct().join(tested, ["x", "y"], "left_anti"), "pairs")


def _components(docs: DataFrame, doc_id: str, text: str, k: int, similar: int, of: int) -> tuple[DataFrame, DataFrame]:
    """Every row's id, hashes and set, and every class with its representative and component."""
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    frequent = frequent_shingles(texts, k)
    hashes = _Hashes()

    @F.pandas_udf("n int, fp binary, sketch binary, prefix array<long>")
    def described(ts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in ts:
            h = shingle_hashes(t, hashes, k)
            n = len(h)
            first = prefix(h, n + similar * n // -of + 1 if n else 0, frequent)
            rows.append((n, xxhash.xxh3_128_digest(h.tobytes()), sketch(h), first.view(np.int64)))
        return pd.DataFrame(rows, columns=["n", "fp", "sketch", "prefix"])

    texts = texts.select("doc_id", "t", F.xxhash64("t").alias("t1"), F.xxhash64(F.lit(1), "t").alias("t2"))
    sets = written(texts.select("doc_id", "t1", "t2", described("t").alias("d")).select("doc_id", "t1", "t2", "d.*"), "sets")
    # A class is shown by one row: the smallest id, nulls last, with the hashes of that row's own text.
    classes = written(
        sets.where("n > 0").groupBy("fp", "n").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")).alias("one"), F.first("sketch").alias("sketch"), F.first("prefix").alias("prefix")
        ).withColumn("rep", F.col("one.doc_id")).withColumn("s", F.monotonically_increasing_id()), "classes"
    )

    # Index lists: entries of shingles that at least two classes list, with the list's leader.
    short = F.col("n") - F.ceil(F.lit(2 * similar) * F.col("n") / F.lit(similar + of)) + 1
    entries = classes.select("s", "n", F.posexplode("prefix").alias("pos", "token")).withColumn("listed", F.col("pos") < short)
    lists = entries.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min(F.when(F.col("listed"), F.struct("n", "s"))).alias("lead")).where("c > 1 and lead is not null")
    lists = written(lists.select("token", F.col("lead.n").alias("ln"), F.col("lead.s").alias("ls")), "lists")
    live = written(entries.join(lists, "token"), "entries")

    near = written(live.where((F.col("s") != F.col("ls")) & (of * F.col("ln") >= similar * F.col("n"))).select(F.col("s").alias("x"), F.col("ls").alias("y")).distinct(), "pairs")

    links = _verified(near, classes, texts, k, similar, of)
    more = _verified(_unanswered(live, links, near, similar, of), classes, texts, k, similar, of)
    comp = components(links.union(more), "components").withColumnRenamed("node", "s")
    named = classes.select("s", "fp", "rep", "one").join(comp, "s", "left").withColumn("component", F.coalesce("component", "s"))
    return sets, named


def similar_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = WORDS_PER_SHINGLE, similar: int = SIMILAR, of: int = OF) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Two documents link when ``of`` times their sets' intersection is at least ``similar`` times
    the union (``similar`` at least half of ``of``); A-Z count as a-z.  ``component_id`` is the smallest id reachable by links,
    itself included.  Null and blank texts have no shingles, link with nothing and keep their own id.
    Null ids are passed over when the smallest is sought; rows repeated are rows of one class.  Further columns are not read.
    """
    sets, named = _components(docs, doc_id, text, k, similar, of)
    low = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    final = written(named.join(low, "component").select("fp", "component_id"), "final")
    # The table of classes is read from files, so adaptive execution can split a hot class in this join.
    return sets.join(final, "fp", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = WORDS_PER_SHINGLE, similar: int = SIMILAR, of: int = OF) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns: one of each component, with the smallest id, and of several texts of that id the one of the smallest hash.

    A row without an id stays only where its whole component has none; rows repeated whole leave one.  Null and blank texts all stay.  No column may begin with two underscores.
    """
    sets, named = _components(docs, doc_id, text, k, similar, of)
    first = named.groupBy("component").agg(F.min("one").alias("one")).select("one.doc_id", "one.t1", "one.t2", F.lit(False).alias("__blank"))
    blank = sets.where("n = 0").select("doc_id", "t1", "t2", F.lit(True)).distinct()
    kept = written(first.union(blank).toDF("__id", "__k1", "__k2", "__blank"), "kept")
    body = F.coalesce(F.col(text), F.lit(""))
    marked = docs.withColumn("__t1", F.xxhash64(body)).withColumn("__t2", F.xxhash64(F.lit(1), body))
    same = F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__t1") == F.col("__k1")) & (F.col("__t2") == F.col("__k2"))

    def rows(some: DataFrame) -> DataFrame:
        return marked.join(some, same, "left_semi")

    chosen = kept.where("not __blank")
    match = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("t1") == F.col("__k1")) & (F.col("t2") == F.col("__k2"))
    again = sets.join(chosen, match, "left_semi").groupBy("doc_id", "t1", "t2").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    if again.isEmpty():
        one = rows(kept)
    else:
        one = rows(chosen).dropDuplicates([doc_id, "__t1", "__t2"]).union(rows(kept.where("__blank")))
    return one.drop("__t1", "__t2")
