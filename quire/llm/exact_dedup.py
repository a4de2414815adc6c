"""Exact de-duplication by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its content says so: a chunk runs for at least
``MIN_CHUNK`` characters to the next sentence end, and no longer than
``MAX_CHUNK``.  Each chunk becomes an identifier, each document the ordered
list of its chunks' identifiers (its recipe), and documents are equal when
their recipes are.  Chunk texts travel once, to be made distinct; after that
only identifiers move, so a long document counts for a few dozen bytes per
kilobyte.

Identifiers are two 64-bit hashes, verified against the content: the distinct
chunk table shows every identifier that stands for more than one chunk text,
and documents holding such a chunk get the chunk's rank among those texts
appended to their recipe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import lower_ascii, written

MIN_CHUNK, MAX_CHUNK = 192, 1536


def chunks(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """The content-defined chunks of a text, in order; joined together they are the text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least},{most}}}?[.!?]\s+|.{{1,{most}}}"), F.lit(0))


def _ids(chunk: Column, bits: int) -> tuple[Column, Column]:
    """Two hashes of a chunk; fewer ``bits`` make them collide, for tests."""
    a, b = F.xxhash64(chunk), F.xxhash64(F.lit(1), chunk)
    return (a, b) if bits == 64 else (a.bitwiseAND(F.lit((1 << bits) - 1)), F.lit(0).cast("long"))


def _chunk_rows(texts: DataFrame, bits: int) -> DataFrame:
    a, b = _ids(F.col("chunk"), bits)
    return texts.select("text_sha256", F.posexplode("chunks").alias("pos", "chunk")).select("text_sha256", "pos", "chunk", a.alias("a"), b.alias("b"))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as
    empty, and empty texts are equal to each other.  The largest ``doc_id`` of a
    group stays; a null id stays only where the whole group has none.  Rows
    repeated with the same id and text are all marked like their id.  An empty
    table gives an empty result; further columns are not read.
    """
    texts = docs.select(F.col(doc_id).alias("doc_id"), lower_ascii(F.col(text)).alias("t")).select(
        "doc_id", F.sha2("t", 256).alias("text_sha256"), F.length("t").alias("n"), chunks(F.col("t")).alias("chunks")
    )
    recipe = F.concat(F.transform("chunks", lambda c: _ids(c, bits)[0]), F.transform("chunks", lambda c: _ids(c, bits)[1]))
    recipes = written(texts.select("doc_id", "text_sha256", "n", recipe.alias("recipe")), "recipes")

    # Verification: chunk texts made distinct, then the identifiers that stand for several of them.
    distinct = _chunk_rows(texts, bits).groupBy("a", "b", "chunk").agg(F.count(F.lit(1)).alias("uses"))
    clashing = written(distinct.groupBy("a", "b").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1"), "clashes")
    if clashing.isEmpty():
        recipes = recipes.withColumn("ranks", F.array().cast("array<int>"))
    else:
        rows = _chunk_rows(texts, bits).join(clashing.select("a", "b"), ["a", "b"], "left_semi")
        ranked = rows.groupBy("a", "b", "chunk").agg(F.count(F.lit(1)).alias("uses")).withColumn(
            "rank", F.row_number().over(Window.partitionBy("a", "b").orderBy("chunk"))
        )
        ranks = rows.join(ranked.drop("uses"), ["a", "b", "chunk"]).groupBy("text_sha256").agg(
            F.array_sort(F.collect_set(F.struct("pos", "rank"))).getField("rank").alias("ranks")
        )
        recipes = recipes.join(ranks, "text_sha256", "left").withColumn("ranks", F.coalesce("ranks", F.array().cast("array<int>")))

    key = ["n", "recipe", "ranks"]
    groups = written(
        recipes.groupBy(*key).agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id")).where("group_size > 1"), "groups"
    )
    # Groups of one need no partner; the join below may be split by adaptive execution where a group is hot.
    return recipes.join(groups, key, "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("group_size").isNull(), True).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each group of equal texts, with all its columns; rows repeated whole leave one.

    No column may begin with two underscores.
    """
    kept = exact_groups(docs, doc_id, text).where("kept").groupBy(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__kept_sha"))
    kept = written(kept.agg(F.count(F.lit(1)).alias("__rows")), "kept")
    marked = docs.withColumn("__sha", F.sha2(lower_ascii(F.col(text)), 256))
    one = marked.join(kept, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__kept_sha")), "left_semi")
    if not kept.where("__rows > 1").isEmpty():  # else the rows are different already
        one = one.dropDuplicates([doc_id, "__sha"])
    return one.drop("__sha")
