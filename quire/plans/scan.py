"""Ordered scans inside a key that survive hot keys.

A plain ``Window.partitionBy(key)`` sends the whole key to one task.  That is
the cheapest plan while every key is small, so the rows per key are counted
first (a map-side combined count of the key columns only) and keys up to
``HOT_ROWS`` rows are scanned that way.

A larger key is divided into *blocks*: runs of the order column (``line_no div
4096``, ``date_trunc('hour', ts)``).  Each block is summarised by a normal aggregate
(so with map-side combine), the few block summaries of a key are scanned in
order to give every block its carry-in, and the rows are then scanned inside
their block only.  Rows are shuffled once, on (key, block); the part that sees a
whole key handles one small row per block.

``block`` must be non-decreasing along ``order`` and a function of the row, so
that lost tasks recompute to the same split.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.plans.lineage import cut

HOT_ROWS = 65_536  # rows of a key that one task may sort
HOT_KEYS = 100_000  # hot keys that may be broadcast


@dataclass(frozen=True)
class Scan:
    """One output column of :func:`ordered_scan`."""

    out: str
    summary: Callable[[Column], Column]  # order struct -> aggregate of a block
    carry: Callable[[Column, object, object], Column]  # summary, forward, backward window
    inside: Callable[[object, object], Column]  # forward, backward window
    merge: Callable[[Column, Column], Column]  # inside, carry
    alone: Callable[[Column], Column] = lambda i: i  # inside, when nothing is carried


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _own(columns: Sequence[str]) -> str:
    """A prefix that no column has, so names made here never stand for one of the caller's."""
    p = "__"
    while any(c.startswith(p) for c in columns):
        p += "_"
    return p


def _upto(w):
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before(w):
    return w.rowsBetween(Window.unboundedPreceding, -1)


def rank_in(out: str) -> Scan:
    """1-based position of the row inside its key."""
    return Scan(
        out,
        lambda o: F.count(F.lit(1)),
        lambda s, fw, bw: F.coalesce(F.sum(s).over(_before(fw)), F.lit(0)),
        lambda fw, bw: F.row_number().over(fw).cast("long"),
        lambda i, c: (i + c).cast("long"),
    )


def running_sum(out: str, col: str | Column) -> Scan:
    """Sum of ``col`` from the first row of the key to this row."""
    c = _col(col)
    return Scan(
        out,
        lambda o: F.sum(c),
        lambda s, fw, bw: F.sum(s).over(_before(fw)),
        lambda fw, bw: F.sum(c).over(_upto(fw)),
        lambda i, k: F.coalesce(i + k, i, k),
    )


def running_min(out: str, col: str | Column) -> Scan:
    """Least ``col`` from the first row of the key to this row."""
    c = _col(col)
    return Scan(
        out,
        lambda o: F.min(c),
        lambda s, fw, bw: F.min(s).over(_before(fw)),
        lambda fw, bw: F.min(c).over(_upto(fw)),
        lambda i, k: F.least(i, k),
    )


def last_seen(out: str, col: str | Column) -> Scan:
    """Latest non-null ``col`` at or before this row."""
    c = _col(col)
    return Scan(
        out,
        lambda o: F.max_by(c, F.when(c.isNotNull(), o)),
        lambda s, fw, bw: F.last(s, ignorenulls=True).over(_before(fw)),
        lambda fw, bw: F.last(c, ignorenulls=True).over(_upto(fw)),
        lambda i, k: F.coalesce(i, k),
    )


def last_seen_before(out: str, col: str | Column) -> Scan:
    """Latest non-null ``col`` strictly before this row."""
    c = _col(col)
    return Scan(
        out,
        lambda o: F.max_by(c, F.when(c.isNotNull(), o)),
        lambda s, fw, bw: F.last(s, ignorenulls=True).over(_before(fw)),
        lambda fw, bw: F.last(c, ignorenulls=True).over(_before(fw)),
        lambda i, k: F.coalesce(i, k),
    )


def next_seen_after(out: str, col: str | Column) -> Scan:
    """First non-null ``col`` strictly after this row."""
    c = _col(col)
    return Scan(
        out,
        lambda o: F.min_by(c, F.when(c.isNotNull(), o)),
        lambda s, fw, bw: F.last(s, ignorenulls=True).over(_before(bw)),
        lambda fw, bw: F.last(c, ignorenulls=True).over(_before(bw)),
        lambda i, k: F.coalesce(i, k),
    )


def lag1(out: str, col: str | Column) -> Scan:
    """``col`` of the previous row (null at the start of the key)."""
    c = F.struct(_col(col).alias("v"))
    return Scan(
        out,
        lambda o: F.max_by(c, o),
        lambda s, fw, bw: F.lag(s, 1).over(fw),
        lambda fw, bw: F.lag(c, 1).over(fw),
        lambda i, k: F.coalesce(i, k)["v"],
        lambda i: i["v"],
    )


def lead1(out: str, col: str | Column) -> Scan:
    """``col`` of the next row (null at the end of the key)."""
    c = F.struct(_col(col).alias("v"))
    return Scan(
        out,
        lambda o: F.min_by(c, o),
        lambda s, fw, bw: F.lead(s, 1).over(fw),
        lambda fw, bw: F.lead(c, 1).over(fw),
        lambda i, k: F.coalesce(i, k)["v"],
        lambda i: i["v"],
    )


def hot_keys(df: DataFrame, keys: Sequence[str], rows: int | None = None) -> DataFrame | None:
    """Keys with more than ``rows`` rows, written once; None when there are none."""
    limit = HOT_ROWS if rows is None else rows
    n = f"{_own(keys)}n"
    found = cut(df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)).filter(F.col(n) > limit).select(*keys))
    return None if found.isEmpty() else found


COUNT = object()  # hot keys are not known yet


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    block: Sequence[str | Column],
    scans: Sequence[Scan],
    hot: DataFrame | None | object = COUNT,
) -> DataFrame:
    """Add one column per scan, computed over ``keys`` in ``order``.

    ``order`` must be total inside a key; null is a key like any other.  ``hot``
    is what :func:`hot_keys` found for ``keys`` or for some of them, on these rows
    or more; a chain of scans that gives it counts once, and without hot keys
    its scans share one shuffle.
    """
    if not keys:
        return _blocked(df, keys, order, block, scans)
    if hot is COUNT:
        hot = hot_keys(df, keys)
    if hot is None:
        return _whole(df, keys, order, scans)
    if hot.limit(HOT_KEYS + 1).count() > HOT_KEYS:
        return _blocked(df, keys, order, block, scans)
    # A struct of the keys is never null itself, so rows with null keys find their hot key too.
    name = f"{_own(df.columns)}hot"
    few = F.broadcast(hot.select(F.struct(*hot.columns).alias(name)))
    is_hot = F.struct(*hot.columns) == F.col(name)
    return _whole(df.join(few, is_hot, "left_anti"), keys, order, scans).unionByName(
        _blocked(df.join(few, is_hot, "left_semi"), keys, order, block, scans)
    )


def _whole(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], scans: Sequence[Scan]) -> DataFrame:
    """Scan of keys known to be small: one shuffle on the key."""
    cols = [_col(c) for c in order]
    fw = Window.partitionBy(*keys).orderBy(*cols)
    bw = Window.partitionBy(*keys).orderBy(*[c.desc() for c in cols])
    outs = {s.out for s in scans}
    p = _own(df.columns)
    return df.select("*", *[s.inside(fw, bw).alias(f"{p}i{i}") for i, s in enumerate(scans)]).select(
        *[F.col(c) for c in df.columns if c not in outs], *[s.alone(F.col(f"{p}i{i}")).alias(s.out) for i, s in enumerate(scans)]
    )


def _blocked(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    block: Sequence[str | Column],
    scans: Sequence[Scan],
) -> DataFrame:
    """Scan by blocks with carried summaries."""
    order_cols = [_col(c) for c in order]
    at = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order_cols)])
    p = _own(df.columns)
    key, cell = f"{p}k", f"{p}kb"
    blocks = [f"{p}b{i}" for i in range(len(block))]
    rows = df.withColumns({b: _col(c) for b, c in zip(blocks, block)})
    # One struct of keys and block: equal also where a part is null, and one partitioning for the join and the windows.
    rows = rows.withColumns({key: F.struct(F.lit(0).alias("all"), *keys), cell: F.struct(F.lit(0).alias("all"), *keys, *blocks)})

    sums = rows.groupBy(key, cell, *blocks).agg(
        *[s.summary(at).alias(f"{p}s{i}") for i, s in enumerate(scans)]
    )
    bf = Window.partitionBy(key).orderBy(*blocks)
    bb = Window.partitionBy(key).orderBy(*[F.col(b).desc() for b in blocks])
    carried = sums.select(
        cell,
        *[s.carry(F.col(f"{p}s{i}"), bf, bb).alias(f"{p}c{i}") for i, s in enumerate(scans)],
    )

    wf = Window.partitionBy(cell).orderBy(*order_cols)
    wb = Window.partitionBy(cell).orderBy(*[c.desc() for c in order_cols])
    joined = rows.join(carried, cell, "left")
    inner = joined.select(
        "*", *[s.inside(wf, wb).alias(f"{p}i{i}") for i, s in enumerate(scans)]
    )
    return inner.select(
        *[F.col(c) for c in df.columns if c not in {s.out for s in scans}],
        *[s.merge(F.col(f"{p}i{i}"), F.col(f"{p}c{i}")).alias(s.out) for i, s in enumerate(scans)],
    )
