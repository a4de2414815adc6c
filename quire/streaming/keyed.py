"""Streaming jobs with keyed state in a state store: quota, credits and subscriptions per user.

Each job is one ``transformWithState`` query on a RocksDB store.  A batch touches the state of its own keys and
nothing else, so its cost follows the batch, not the stream's past; the store keeps its own versions
for replays.  The quota's state is one value a user and month, so a user's history is spread over
many keys, and an event-time timer drops a month's value once the watermark has passed its end.

One key's rows of one batch are put in order in one task.  How many that may be is bounded by the source's rate limit
(``maxFilesPerTrigger``), not by the stream; where one user has a great part of every batch, the block-wise jobs of
:mod:`quire.streaming.jobs` divide even those.

Late rows: a row older than what its key has applied is applied when it comes and goes to the side output ``late`` as well.
Rows older than the watermark never reach the state; they are counted, and a run that lost any raises an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quire.operators import usage as u
from quire.plans import cut
from quire.sources.buckets import upsert_table, vacuum

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LATENESS = "1 day"
VERSIONS = 3


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _run(rows: DataFrame, base: str, mode: str, each: Callable[[DataFrame, int], None]) -> None:
    with rocksdb(rows.sparkSession):
        q = (
            rows.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/_checkpoint")
            .trigger(availableNow=True).foreachBatch(each).start()
        )
        q.awaitTermination()
    lost = sum(s.get("numRowsDroppedByWatermark", 0) for p in q.recentProgress for s in p["stateOperators"])
    if lost:
        raise ValueError(f"{lost} rows came later than the watermark allows and were not applied; allow more lateness")


def _micros(times: pd.Series) -> np.ndarray:
    return times.to_numpy("datetime64[us]").astype(np.int64)


class _Sorted(StatefulProcessor):
    """Puts one key's rows of a batch in order and hands them to ``apply`` together with the key's state."""

    state = ""  # schema
    order: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.state)

    def apply(self, key: tuple, rows: pd.DataFrame, held: tuple | None) -> tuple[pd.DataFrame, tuple]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = [part for part in rows if len(part)]
        if parts:
            batch = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
            batch = batch.sort_values(list(self.order), kind="stable", ignore_index=True)
            out, new = self.apply(key, batch, self.value.get())
            self.value.update(new)
            yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.value.clear()
        return iter(())

    def close(self) -> None:
        pass


class QuotaState(_Sorted):
    """(used, last) of one user and month; the first ``limit`` attempts are monthly."""

    state, order = "used long, last long", ("at", "id")

    def apply(self, key, rows, held):
        used, last = held or (0, -(1 << 62))
        at = _micros(rows["at"])
        nth = used + np.arange(1, len(rows) + 1)
        out = pd.DataFrame({
            "id": rows["id"], "user": rows["user"], "month": rows["month"], "nth": nth, "bucket": np.where(nth <= rows["limit"].to_numpy(), "monthly", "overflow"), "late": at < last,
        })
        if held is None and key[1] is not None:  # the month's value is of no use once the watermark has passed its end
            end = (pd.Period(key[1], "M") + 1).start_time
            self.handle.registerTimer(int(end.value // 1_000_000))
        return out, (int(nth[-1]), int(max(last, at[-1])))


class LedgerState(_Sorted):
    """(balance, last) of one user: a running sum that stops at zero; a use that would pass zero is refused."""

    state, order = "balance long, last long", ("ts", "event_id")

    def apply(self, key, rows, held):
        opening, last = held or (0, -(1 << 62))
        total = opening + rows["delta"].to_numpy(np.int64).cumsum()
        low = np.minimum(np.minimum.accumulate(total), 0)
        balance, at = total - low, _micros(rows["ts"])
        fell = low < np.concatenate([[0], low[:-1]])
        accepted = pd.array(np.where(rows["kind"] == "use", ~fell, None), "boolean")
        out = rows[["user", "ts", "event_id", "delta", "kind"]].assign(balance=balance, accepted=accepted, late=at < last)
        return out, (int(balance[-1]), int(max(last, at[-1])))


class SubscriptionState(StatefulProcessor):
    """What the latest events after the first checkout say about one customer; every field is kept with the event that set it.

    Customers are many and have few rows in a batch, so their rows come as rows and not as a frame each.
    """

    FIELDS = ("status", "plan", "price")
    state = "gate_at long, gate_id long, " + ", ".join(f"{f}_at long, {f}_id long, {f} string" for f in FIELDS) + ", syncs long, failures long, applied long, last long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", self.state)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        events = sorted(((r.at, r.event_id, r.type or "", r.status, r.mapped_plan, r.price_id or "") for r in rows if r.at is not None), key=lambda e: e[:2])
        if events:
            out, new = self.apply(events, self.value.get())
            self.value.update(new)
            yield Row(customer=key[0], **out)

    def close(self) -> None:
        pass

    def apply(self, events: list[tuple], held: tuple | None) -> tuple[dict, tuple]:
        held = held or (None,) * 11 + (0, 0, 0, -(1 << 62))
        gate, counts, last = held[:2], held[11:14], held[14]
        known = dict(zip(self.FIELDS, (held[2:5], held[5:8], held[8:11]), strict=True))
        first = next((e[:2] for e in events if e[2] == "checkout.session.completed"), None)
        if first is not None:
            gate = first if gate[0] is None else min(first, gate)
        new, synced, failures, applied = {}, 0, 0, 0
        for at, i, kind, status, plan, price in events:
            if gate[0] is None or (at, i) <= gate:
                continue
            sub, paid, failed = kind.startswith("customer.subscription."), kind == "invoice.paid", kind == "invoice.payment_failed"
            values = (
                status if sub else "active" if paid else "past_due" if failed else None,
                "free" if sub and status in ("canceled", "unpaid") else plan if sub or paid else None,
                price if sub or paid else None,
            )
            new.update((f, (at, i, v)) for f, v in zip(self.FIELDS, values, strict=True) if v is not None)
            synced, failures, applied = synced + (sub or paid), failures + failed, applied + 1
        for f, v in new.items():
            known[f] = v if known[f][0] is None else max(known[f], v)
        counts = tuple(a + b for a, b in zip(counts, (synced, failures, applied), strict=True))
        status, plan, price = (known[f][2] for f in self.FIELDS)
        out = dict(status=status or "", plan=plan or "free", price_id=price or "", syncs=counts[0], failures=counts[1], applied=counts[2], late=events[0][0] < last)
        return out, (*gate, *(v for f in self.FIELDS for v in known[f]), *counts, max(last, events[-1][0]))


def keyed_quota(attempts: DataFrame, base: str, billing: DataFrame, user: str = "user_id", at: str = "started_at", key: str = "run_id", lateness: str = LATENESS) -> None:
    """Every attempt with its number in the user's month and its bucket, appended below ``placed``; late ones below ``late`` too."""
    rows = u.with_limits(attempts, billing, user)
    rows = rows.select(F.col(user).alias("user"), F.date_format(at, "yyyy-MM").alias("month"), F.col(at).cast("timestamp").alias("at"), F.col(key).alias("id"), F.col("limit").cast("long").alias("limit"))
    kind = dict(attempts.dtypes)
    out = rows.withWatermark("at", lateness).groupBy("user", "month").transformWithStateInPandas(
        QuotaState(), f"id {kind[key]}, user {kind[user]}, month string, nth long, bucket string, late boolean", "append", "EventTime")
    _append(out.withColumnsRenamed({"id": key, "user": user}), base, "placed")


def keyed_ledger(deltas: DataFrame, base: str, user: str = "user_id", lateness: str = LATENESS) -> None:
    """Every row of ``deltas`` (user, ts, event_id, delta, kind) with the balance after it, appended below ``ledger``; late ones below ``late`` too."""
    kind = dict(deltas.dtypes)
    rows = deltas.select(F.col(user).alias("user"), "ts", "event_id", F.col("delta").cast("long").alias("delta"), "kind")
    out = rows.withWatermark("ts", lateness).groupBy("user").transformWithStateInPandas(
        LedgerState(), f"user {kind[user]}, ts timestamp, event_id {kind['event_id']}, delta long, kind string, balance long, accepted boolean, late boolean", "append", "EventTime")
    _append(out.withColumnRenamed("user", user), base, "ledger")


def keyed_subscription(events: DataFrame, base: str, customer: str = "customer_id", lateness: str = LATENESS) -> None:
    """The state of every customer of a batch, merged into the bucketed table ``state``."""
    spark = events.sparkSession
    kind = dict(events.dtypes)[customer]
    rows = u.plan_lookup(events).select(F.col(customer).alias("customer"), "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", "type", "status", "price_id", "mapped_plan")
    out = rows.withWatermark("ts", lateness).groupBy("customer").transformWithState(
        SubscriptionState(), f"customer {kind}, status string, plan string, price_id string, syncs long, failures long, applied long, late boolean", "update", "EventTime")

    def each(batch: DataFrame, epoch: int) -> None:
        done = cut(batch)  # the upsert reads it more than once, and every read would run the state again
        upsert_table(spark, f"{base}/state", done.withColumnRenamed("customer", customer), [customer], ["applied"], epoch)
        vacuum(spark, f"{base}/state", VERSIONS)

    _run(out, base, "update", each)


def _append(rows: DataFrame, base: str, name: str) -> None:
    def each(batch: DataFrame, epoch: int) -> None:
        done = cut(batch)  # the state is read once for both outputs
        done.write.mode("overwrite").parquet(f"{base}/{name}/batch={epoch:010d}")
        done.where("late").write.mode("overwrite").parquet(f"{base}/late/batch={epoch:010d}")

    _run(rows, base, "append", each)
