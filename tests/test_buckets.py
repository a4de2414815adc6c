"""Bucketed tables, the index of seen keys and keyed streams on small folders."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import evals, usage
from quire.sources import buckets as b
from quire.streaming import jobs, keyed

SCHEMA = "k string, n int, v int, s string"


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def held(spark, base, **kw):
    return sorted(map(tuple, b.read_table(spark, base, **kw).collect()), key=str)


def test_upsert_equals_a_dictionary_and_rewrites_touched_buckets_only(spark, tmp_path):
    base, want, rng = str(tmp_path / "t"), {}, random.Random(1)
    for version in range(1, 5):
        data = [(rng.choice([None, "a", *map(str, range(60))]), rng.choice([None, 1, 2]), rng.randint(0, 9) + 10 * version, rng.choice("xyz")) for _ in range(40 if version == 1 else 5)]
        before = b.manifest(spark, base)
        now = b.upsert_table(spark, base, rows(spark, data), ["k", "n"], ["v", "s"], version, buckets=16)
        for r in sorted(data, key=lambda r: r[2:]):
            want[r[:2]] = r
        assert held(spark, base) == sorted(want.values(), key=str)
        if before:
            rewritten = set(map(str, now["rewritten"]))
            assert len(rewritten) <= 5  # of up to sixteen
            assert all(now["runs"][k] == v for k, v in before["runs"].items() if k not in rewritten)
            assert all(now["runs"][k] != before["runs"].get(k) for k in rewritten)
    assert held(spark, base, upto=1) != held(spark, base)


def test_a_repeated_version_starts_from_the_one_before(spark, tmp_path):
    base = str(tmp_path / "t")
    b.upsert_table(spark, base, rows(spark, [("a", 1, 1, "one"), ("b", 1, 1, "one")]), ["k"], ["v"], 1)
    for s in ("first try", "second try"):
        b.upsert_table(spark, base, rows(spark, [("a", 1, 2, s)]), ["k"], ["v"], 2)
        b.upsert_table(spark, base, rows(spark, []), ["k"], ["v"], 3)
        assert held(spark, base) == [("a", 1, 2, s), ("b", 1, 1, "one")]
    assert b.versions(spark, base) == [1, 2, 3]


def test_vacuum_drops_what_no_kept_version_names(spark, tmp_path):
    base = str(tmp_path / "t")
    for v in range(1, 6):
        b.upsert_table(spark, base, rows(spark, [(str(v % 2), 1, v, "x"), (f"only{v}", 1, v, "y")]), ["k"], ["v"], v, buckets=8)
    want = held(spark, base)
    assert b.vacuum(spark, base, keep=1) and b.versions(spark, base) == [5] and held(spark, base) == want
    named = {f for runs in b.manifest(spark, base)["runs"].values() for f, _ in runs}
    assert {str(p.relative_to(tmp_path / "t")) for p in (tmp_path / "t" / "data").glob("*/bucket=*")} == named
    assert b.vacuum(spark, base, keep=1) == []
    with pytest.raises(ValueError):
        b.vacuum(spark, base, keep=0)


def test_an_empty_table_and_an_empty_first_source(spark, tmp_path):
    assert b.read_table(spark, str(tmp_path / "none")) is None
    b.upsert_table(spark, str(tmp_path / "t"), rows(spark, []), ["k"], ["v"], 1)
    assert held(spark, str(tmp_path / "t")) == []
    b.upsert_table(spark, str(tmp_path / "t"), rows(spark, [(None, None, None, None)]), ["k"], ["v"], 2)
    assert held(spark, str(tmp_path / "t")) == [(None, None, None, None)]


def test_values_that_are_structs_and_narrower_types(spark, tmp_path):
    base = str(tmp_path / "t")
    one = spark.sql("SELECT 1 AS k, struct(1 AS a, 'x' AS b) AS v, 10L AS n")
    b.upsert_table(spark, base, one, ["k"], ["n"], 1)
    b.upsert_table(spark, base, one.selectExpr("k + 1 AS k", "v", "CAST(n AS INT) AS n"), ["k"], ["n"], 2)
    assert held(spark, base) == [(1, (1, "x"), 10), (2, (1, "x"), 10)]


def test_plain_upsert_replaces_null_keys(spark):
    old, new = rows(spark, [(None, 1, 1, "old"), ("a", None, 1, "old")]), rows(spark, [(None, 1, 2, "new"), ("a", None, 3, "new"), ("a", 1, 1, "add")])
    got = evals.upsert(old, new, ["k", "n"], ["v"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(None, 1, 2, "new"), ("a", None, 3, "new"), ("a", 1, 1, "add")], key=str)


def test_filters_never_miss_and_seldom_err():
    rng = np.random.default_rng(2)
    keys, others = (rng.integers(-(1 << 63), 1 << 63, 40_000) for _ in range(2))
    filters, n = [], 0
    for part in np.array_split(keys, 7):
        filters, n = b._added(filters, n, part, 1 << 17)
    assert n == len(keys) and len(filters) == -(-n // ((1 << 17) // b.BITS_A_KEY))
    assert b._maybe(filters, keys).all() and b._maybe(filters, others).mean() < 0.02
    assert not b._maybe([], keys).any()


def test_seen_keys_equal_a_set_and_new_keys_read_few_buckets(spark, tmp_path):
    index, seen, rng = b.SeenKeys(spark, str(tmp_path), "k", buckets=8, bits=1 << 12), set(), random.Random(4)
    for batch in range(6):
        new = {f"{batch}-{i}" for i in range(rng.choice([3, 60, 200]))} | ({None} if batch > 1 else set())
        asked = new | set(rng.sample(sorted(seen, key=str), min(len(seen), 4)))
        df = spark.createDataFrame([(k, 0) for k in asked], "k string, v int")
        for _ in range(2):  # a batch may be repeated
            fresh = index.unseen(df, batch)
            assert {r.k for r in fresh.collect()} == asked - seen
            index.add(fresh, batch)
        if batch:
            assert index.last_hits < len(asked & seen) + 0.1 * len(asked) + 3
        seen |= asked
    runs = b.manifest(spark, index.keys)["runs"]
    assert sum(n for r in runs.values() for _, n in r) == len(seen) and max(map(len, runs.values())) <= 5
    only_new = spark.createDataFrame([(f"never-{i}", 0) for i in range(5)], "k string, v int")
    assert index.unseen(only_new, 6).count() == 5 and index.last_buckets <= 2


def test_dedup_streams_keep_one_null_key(spark, tmp_path):
    base, src, t0 = str(tmp_path / "job"), str(tmp_path / "in"), dt.datetime(2024, 1, 1)
    schema = "sid string, event_id int, ts timestamp"
    for ids in (range(0, 6), range(6, 12)):
        df = spark.createDataFrame([(None if i % 3 == 0 else f"s{i % 3}", i, t0 + dt.timedelta(minutes=i)) for i in ids], schema)
        df.coalesce(1).write.mode("append").parquet(src)
        jobs.stream_dedup(spark.readStream.schema(schema).parquet(src), base, "sid", ["ts", "event_id"], ["event_id"])
    assert sorted(((r.sid, r.event_id) for r in jobs.appended(spark, f"{base}/first").collect()), key=str) == [("s1", 1), ("s2", 2), (None, 0)]


def test_upsert_runs_its_source_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            read.add(len(frame))
            yield frame

    for version in (1, 2):
        source = rows(spark, [("a", 1, version, "x"), ("b", 2, version, "y")]).mapInPandas(counted, SCHEMA)
        b.upsert_table(spark, str(tmp_path / "t"), source, ["k"], ["v"], version, buckets=4)
        assert read.value == 2 * version


# ---- keyed state ------------------------------------------------------------------------------------------------


def replayed(spark, tmp_path, parts, schema, job):
    src, base = str(tmp_path / "in"), str(tmp_path / "job")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        job(spark.readStream.schema(schema).parquet(src), base)
    return base


def test_keyed_quota_equals_its_batch_twin_and_marks_late_rows(spark, tmp_path):
    rng, t0 = random.Random(6), dt.datetime(2024, 1, 20)
    data = sorted((t0 + dt.timedelta(hours=rng.randint(0, 700)), k, rng.choice([1, 1, 1, 2, 3])) for k in range(200))
    schema = "run_id bigint, user_id bigint, started_at timestamp"
    flat = [(k, user, at) for at, k, user in data]
    billing = spark.createDataFrame([(1, "free", 20), (2, "free", None)], "user_id bigint, plan_type string, monthly_limit_override int")
    base = replayed(spark, tmp_path, [flat[:90], flat[90:150], flat[150:]], schema, lambda st, b: keyed.keyed_quota(st, b, billing))
    got = spark.read.parquet(f"{base}/placed")
    want = usage.allocate_quota(spark.createDataFrame(flat, schema), billing).select("run_id", "user_id", "month", "nth", "bucket")
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert got.where("late").count() == spark.read.parquet(f"{base}/late").count() == 0


def test_keyed_quota_late_rows(spark, tmp_path):
    billing = spark.createDataFrame([(1, "free", None)], "user_id bigint, plan_type string, monthly_limit_override int")
    schema = "run_id bigint, user_id bigint, started_at timestamp"
    parts = [[(i, 1, dt.datetime(2024, 1, day, i)) for i in ids] for day, ids in ((10, (1, 2)), (9, (3, 4)))]
    base = replayed(spark, tmp_path, parts, schema, lambda st, b: keyed.keyed_quota(st, b, billing, lateness="30 days"))
    assert {r.run_id: (r.bucket, r.late) for r in spark.read.parquet(f"{base}/placed").collect()} == {
        1: ("monthly", False), 2: ("monthly", False), 3: ("monthly", True), 4: ("overflow", True)}
    assert sorted(r.run_id for r in spark.read.parquet(f"{base}/late").collect()) == [3, 4]


def test_rows_beyond_the_watermark_are_an_error(spark, tmp_path):
    schema = "user_id bigint, ts timestamp, event_id bigint, delta int, kind string"
    parts = [[(1, dt.datetime(2024, 3, day), day, 5, "grant")] for day in (20, 2)]
    with pytest.raises(ValueError, match="1 rows came later"):
        replayed(spark, tmp_path, parts, schema, lambda st, b: keyed.keyed_ledger(st, b))


def test_keyed_ledger_equals_its_batch_twin(spark, tmp_path):
    rng, t0 = random.Random(8), dt.datetime(2024, 5, 1)
    data = []
    for k in range(240):
        use = rng.random() < 0.7
        data.append((rng.choice([1, 1, 2, None]), t0 + dt.timedelta(minutes=13 * k + rng.randint(0, 9)), k, -rng.randint(1, 4) if use else rng.randint(0, 9), "use" if use else "grant"))
    schema = "user_id bigint, ts timestamp, event_id bigint, delta int, kind string"
    base = replayed(spark, tmp_path, [data[:100], data[100:101], data[101:]], schema, lambda st, b: keyed.keyed_ledger(st, b))
    got = sorted((r.event_id, r.user_id, r.balance, r.accepted) for r in spark.read.parquet(f"{base}/ledger").collect())
    want, balance = [], {}
    for user, _, k, delta, kind in data:
        after = balance.get(user, 0) + delta
        balance[user] = max(after, 0)
        want.append((k, user, balance[user], after >= 0 if kind == "use" else None))
    assert got == want


def test_keyed_subscription_equals_its_batch_twin(spark, tmp_path):
    rng, t0 = random.Random(9), dt.datetime(2024, 5, 1)
    kinds = ["checkout.session.completed", "customer.subscription.updated", "customer.subscription.deleted", "invoice.paid", "invoice.payment_failed", None]
    data = [
        (rng.choice([1, 2, 3, 4]), t0 + dt.timedelta(minutes=7 * k), k, rng.choice(kinds), rng.choice(["active", "canceled", "trialing", None]), rng.choice(["price_starter", "price_pro", "other", None]))
        for k in range(120)
    ]
    schema = "customer_id bigint, ts timestamp, event_id bigint, type string, status string, price_id string"
    base = replayed(spark, tmp_path, [data[:5], data[5:70], data[70:]], schema, lambda st, b: keyed.keyed_subscription(st, b))
    got = b.read_table(spark, f"{base}/state").where("applied > 0").drop("applied", "late")
    want = usage.subscription_state(spark.createDataFrame(data, schema)).withColumns({"status": F.coalesce("status", F.lit("")), "price_id": F.coalesce("price_id", F.lit(""))})
    assert sorted(map(tuple, got.select(sorted(got.columns)).collect())) == sorted(map(tuple, want.select(sorted(got.columns)).collect()))
