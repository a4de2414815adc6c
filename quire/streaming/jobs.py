"""Structured Streaming jobs over the event-shaped rules.

Each job takes a streaming DataFrame and a folder in shared storage and starts
an ``availableNow`` query there; on a replayed finite source it returns what its
batch twin returns.  Where state would put all rows of a hot key into one task,
the job merges each micro-batch into versioned state tables with the same
block-wise operators as the batch code, instead of a per-key state function
(:mod:`quire.streaming.keyed` has those).  State tables are in hash buckets: a batch reads and
rewrites the buckets of its own keys only, and versions that no replay can need are dropped.

Late data: events are ordered by event time inside a batch.  An event older than
what was already applied for its key is applied when it arrives and marked
``late``; an end-of-stream replay of such input differs from a batch run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import usage as u
from quire.plans import cut, lookup_join
from quire.sources.buckets import SeenKeys, read_near, read_table, upsert_table, vacuum
from quire.sources.io import LOG_LINE, earlier_batches

VERSIONS = 3  # of a state table that are kept: a batch repeated after a failure needs the one before its own


def _run(stream: DataFrame, base: str, each: Callable[[DataFrame, int], None], mode: str = "append"):
    q = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/_checkpoint")
        .trigger(availableNow=True).foreachBatch(each).start()
    )
    q.awaitTermination()
    return q


def newest(spark: SparkSession, base: str) -> DataFrame:
    """The last written version of a job's table."""
    return read_table(spark, base)


def _keep(spark: SparkSession, base: str, rows: DataFrame, keys: list[str], order: list[str], epoch: int) -> None:
    """``rows`` as the newest values of their keys, and no more versions than a replay needs."""
    upsert_table(spark, base, rows, keys, order, epoch)
    vacuum(spark, base, VERSIONS)


def appended(spark: SparkSession, base: str) -> DataFrame:
    """All rows that a job has appended to a table."""
    return earlier_batches(spark, base)


def log_counts(lines: DataFrame, watermark: str = "1 day", size: str = "1 hour") -> DataFrame:
    """Tumbling counts of (level, logger) from a stream of log lines."""
    get = lambda i: F.regexp_extract("value", LOG_LINE, i)
    rows = lines.filter(F.col("value").rlike(LOG_LINE)).select(
        F.to_timestamp(get(1), "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), get(2).alias("level"), get(3).alias("logger"))
    return rows.withWatermark("ts", watermark).groupBy(F.window("ts", size), "level", "logger").agg(F.count(F.lit(1)).alias("records"))


def stream_log_counts(lines: DataFrame, base: str, **kw) -> None:
    """Log counts kept as a table, one row per window, level and logger."""
    spark = lines.sparkSession

    def each(batch: DataFrame, epoch: int) -> None:
        rows = batch.select(F.col("window.start").alias("start"), "level", "logger", "records", F.lit(epoch).alias("epoch"))
        _keep(spark, f"{base}/counts", rows, ["start", "level", "logger"], ["epoch"], epoch)

    _run(log_counts(lines, **kw), base, each, "update")


def dedup_within(events: DataFrame, key: str, at: str, watermark: str) -> DataFrame:
    """Bounded de-duplication: a repeat later than the watermark passes again.

    This is weaker than the contract of a unique key, which is for ever; use
    :func:`stream_dedup` for that.
    """
    return events.withWatermark(at, watermark).dropDuplicatesWithinWatermark([key])


def stream_dedup_within(events: DataFrame, base: str, key: str, at: str, watermark: str) -> None:
    """:func:`dedup_within` as a job that appends to a table."""
    q = (
        dedup_within(events, key, at, watermark).writeStream.outputMode("append").option("checkpointLocation", f"{base}/_checkpoint")
        .trigger(availableNow=True).format("parquet").start(f"{base}/within")
    )
    q.awaitTermination()


def stream_dedup(events: DataFrame, base: str, key: str, order: list[str], keep: list[str]) -> None:
    """First delivery per key, for ever: keys already in the table never enter again.

    Each batch appends its new keys only; a repeated batch rewrites its own part.  Keys of earlier batches are
    looked up in an index (:class:`quire.sources.buckets.SeenKeys`), not read.  Null is a key like any other.
    """
    spark = events.sparkSession
    seen = SeenKeys(spark, f"{base}/seen", key)

    def each(batch: DataFrame, epoch: int) -> None:
        first = cut(u.first_delivery(batch, key, order, keep).drop("deliveries"))
        _append_unseen(seen, first, f"{base}/first", epoch)

    _run(events, base, each)


def _append_unseen(seen: SeenKeys, first: DataFrame, base: str, epoch: int) -> None:
    """Append the rows of keys not met before, then their keys to the index: a batch repeated in between finds the index as it was."""
    spark, path = first.sparkSession, f"{base}/batch={epoch:010d}"
    seen.unseen(first, epoch).write.mode("overwrite").parquet(path)
    seen.add(spark.read.schema(first.schema).parquet(path), epoch)
    for part in (seen.keys, seen.filters):
        vacuum(spark, part, VERSIONS)


def stream_quota(attempts: DataFrame, base: str, billing: DataFrame, user: str = "user_id", at: str = "started_at",
                 key: str = "run_id", block: str = "hour") -> None:
    """Quota placement of attempts with the used counts of earlier batches carried over.

    State is (user, month, used, last) per version; the rank inside the batch is
    taken block-wise and shifted by the count carried over.
    """
    spark = attempts.sparkSession

    def each(batch: DataFrame, epoch: int) -> None:
        ranked = cut(u.allocate_quota(batch, billing, user, at, key, block))
        state = read_near(spark, f"{base}/used", ranked, [user, "month"], epoch - 1)
        if state is None:
            state = spark.createDataFrame([], f"{user} bigint, month string, used bigint, last timestamp")
        j = lookup_join(ranked, state, [user, "month"], "left", spread=F.col(key)).withColumn("nth", F.col("nth") + F.coalesce("used", F.lit(0)))
        out = cut(j.select(
            key, user, "month", "nth", F.when(F.col("nth") <= F.col("limit"), "monthly").otherwise("overflow").alias("bucket"),
            F.coalesce(F.col(at) < F.col("last"), F.lit(False)).alias("late"), F.col(at).alias("at"),
        ))
        out.drop("at").write.mode("overwrite").parquet(f"{base}/placed/batch={epoch:010d}")
        fresh = out.groupBy(user, "month").agg(F.count(F.lit(1)).alias("used"), F.max("at").alias("last"))
        both = state.join(fresh.select(user, "month"), [user, "month"], "left_semi").unionByName(fresh)
        both = both.groupBy(user, "month").agg(F.sum("used").alias("used"), F.max("last").alias("last"))
        _keep(spark, f"{base}/used", both, [user, "month"], ["used"], epoch)

    _run(attempts, base, each)


def stream_ledger(deltas: DataFrame, base: str, user: str = "user_id", block: str = "hour") -> None:
    """Credit ledger with the balance of earlier batches carried over as an opening grant.

    ``deltas`` has (user, ts, event_id, delta, kind).
    """
    spark = deltas.sparkSession

    def each(batch: DataFrame, epoch: int) -> None:
        rows = batch.select(user, "ts", "event_id", F.col("delta").cast("long").alias("delta"), "kind")
        state = read_near(spark, f"{base}/balance", rows, [user], epoch - 1)
        if state is None:
            state = spark.createDataFrame([], f"{user} bigint, balance bigint, last timestamp")
        opening = state.join(rows.groupBy(user).agg(F.min("ts").alias("ts")), user).select(
            user, "ts", F.lit(-1).cast("long").alias("event_id"), F.col("balance").alias("delta"), F.lit("opening").alias("kind"))
        out = cut(u.credit_ledger(rows.unionByName(opening), user, ["ts", "event_id"], "delta", "kind", [F.date_trunc(block, "ts")]))
        out.filter("kind <> 'opening'").write.mode("overwrite").parquet(f"{base}/ledger/batch={epoch:010d}")
        now = out.groupBy(user).agg(F.max_by("balance", F.struct("ts", "event_id")).alias("balance"), F.max("ts").alias("last"))
        _keep(spark, f"{base}/balance", now, [user], ["last"], epoch)

    _run(deltas, base, each)


def stream_subscription(events: DataFrame, base: str, customer: str = "customer_id") -> None:
    """Latest subscription state per customer, safe to replay.

    The state row holds for every field the event that set it, so batches merge
    by taking the later one.
    """
    spark = events.sparkSession

    def each(batch: DataFrame, epoch: int) -> None:
        state = read_near(spark, f"{base}/state", batch, [customer], epoch - 1)
        fresh = cut(_subscription_parts(batch, state, customer))
        if state is not None:
            fresh = _merge_parts(state.join(fresh.select(customer), customer, "left_semi").unionByName(fresh), customer)
        _keep(spark, f"{base}/state", fresh, [customer], ["applied"], epoch)

    _run(events, base, each)


_AT = "struct<ts:timestamp,event_id:bigint>"


def _subscription_parts(batch: DataFrame, state: DataFrame | None, customer: str) -> DataFrame:
    e = u.plan_lookup(batch)
    at = F.struct("ts", "event_id").cast(_AT)
    gates = e.filter("type = 'checkout.session.completed'").groupBy(customer).agg(F.min(at).alias("gate"))
    if state is not None:
        gates = gates.unionByName(state.select(customer, "gate")).groupBy(customer).agg(F.min("gate").alias("gate"))
    sub, paid, failed = F.col("type").startswith("customer.subscription."), F.col("type") == "invoice.paid", F.col("type") == "invoice.payment_failed"
    sync = sub | paid
    status = F.when(sub, F.col("status")).when(paid, "active").when(failed, "past_due")
    plan = F.when(sub & F.col("status").isin("canceled", "unpaid"), "free").when(sync, F.col("mapped_plan"))
    j = lookup_join(e, gates, [customer], "inner", spread=F.col("event_id")).withColumn("at", at)
    live = F.col("at") > F.col("gate")
    part = lambda v, cond: F.max(F.when(live & cond, F.struct("at", v.alias("v"))))
    return j.groupBy(customer).agg(
        F.min("gate").alias("gate"), part(status, status.isNotNull()).alias("status"), part(plan, plan.isNotNull()).alias("plan"),
        part(F.coalesce("price_id", F.lit("")), sync).alias("price"), F.count_if(live & sync).alias("syncs"), F.count_if(live & failed).alias("failures"),
        F.count_if(live).alias("applied"),
    )


def _merge_parts(parts: DataFrame, customer: str) -> DataFrame:
    return parts.groupBy(customer).agg(
        F.min("gate").alias("gate"), *[F.max(c).alias(c) for c in ("status", "plan", "price")],
        *[F.sum(c).alias(c) for c in ("syncs", "failures", "applied")],
    )


def subscription_table(state: DataFrame, customer: str = "customer_id") -> DataFrame:
    """The readable form of the subscription state."""
    return state.filter("applied > 0").select(
        customer, F.coalesce("status.v", F.lit("")).alias("status"), F.coalesce("plan.v", F.lit("free")).alias("plan"),
        F.coalesce("price.v", F.lit("")).alias("price_id"), "syncs", "failures",
    )


def stream_monthly_usage(runs: DataFrame, base: str, user: str = "user_id", at: str = "started_at") -> None:
    """Running counts per user and month."""
    spark = runs.sparkSession

    def each(batch: DataFrame, epoch: int) -> None:
        keys = [user, "year", "month"]
        fresh = cut(u.monthly_usage(batch, user, at))
        state = read_near(spark, f"{base}/usage", fresh, keys, epoch - 1)
        if state is not None:
            fresh = state.join(fresh.select(*keys), keys, "left_semi").unionByName(fresh).groupBy(*keys).agg(F.sum("used").alias("used"))
        _keep(spark, f"{base}/usage", fresh, keys, ["used"], epoch)

    _run(runs, base, each)


def stream_new_pages(pages: DataFrame, base: str, cache: DataFrame, key: str = "cache_key", order: str = "page_id") -> None:
    """Pages whose key is neither in the cache nor came earlier, appended batch by batch; keys met before are looked up in an index."""
    spark = pages.sparkSession
    seen = SeenKeys(spark, f"{base}/seen", key)

    def each(batch: DataFrame, epoch: int) -> None:
        cols = [c for c in batch.columns if c != key]
        first = batch.groupBy(key).agg(F.min_by(F.struct(*cols), order).alias("r")).select(key, "r.*")
        fresh = cut(first.join(cache.select(key).distinct(), key, "left_anti"))
        _append_unseen(seen, fresh, f"{base}/new", epoch)

    _run(pages, base, each)
