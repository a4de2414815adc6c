"""Quota, credits and subscription rules against step-by-step simulations."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quire.operators import usage as u

T0 = dt.datetime(2024, 1, 30)


def ledger_rows(n=300):
    rnd = random.Random(3)
    out = []
    for i in range(n):
        kind = rnd.choice(["use", "use", "use", "grant", "adjust"])
        out.append((rnd.choice([1, 1, 1, 2]), T0 + dt.timedelta(minutes=i * 7), i, {"use": -1, "grant": 3, "adjust": -2}[kind], kind))
    return out


def test_ledger_equals_a_simulation(spark):
    rows, balance, want = ledger_rows(), {}, {}
    for user, _, i, delta, kind in rows:
        b = balance.get(user, 0)
        ok = b > 0 if kind == "use" else None
        balance[user] = max(0, b + delta)
        want[i] = (balance[user], ok)
    df = spark.createDataFrame(rows, "user_id int, ts timestamp, event_id int, delta int, kind string")
    got = u.credit_ledger(df, "user_id", ["ts", "event_id"], "delta", "kind", [F.date_trunc("hour", "ts")])
    assert {r.event_id: (r.balance, r.accepted) for r in got.collect()} == want


@pytest.mark.parametrize("limit", [0, 10**9])
def test_quota_then_credits(spark, hot, limit):
    hot(limit)
    runs = [(i, 1 + i % 3, T0 + dt.timedelta(hours=i)) for i in range(60)]
    plans = {1: "free", 2: "starter"}  # user 3 has no billing row
    grants = [(1, T0 + dt.timedelta(hours=20, minutes=1), 900, 2), (3, T0, 901, 5)]
    moves = sorted([(t, 0, g, user, n) for user, t, g, n in grants] + [(t, 1, i, user, 0) for i, user, t in runs])
    used, credit, want = {}, {}, {}
    for t, seq, i, user, n in moves:
        if seq == 0:
            credit[user] = credit.get(user, 0) + n
            continue
        key = (user, t.year, t.month)
        if used.get(key, 0) < {"free": 3, "starter": 40}.get(plans.get(user, "free")):
            used[key] = used.get(key, 0) + 1
            want[i] = "monthly"
        elif user in plans and credit.get(user, 0) > 0:
            credit[user] -= 1
            want[i] = "credit"
        else:
            want[i] = "rejected"
    got = u.allocate_with_credits(
        spark.createDataFrame(runs, "run_id int, user_id int, started_at timestamp"),
        spark.createDataFrame([(k, v, None) for k, v in plans.items()], "user_id int, plan_type string, monthly_limit_override int"),
        spark.createDataFrame(grants, "user_id int, ts timestamp, grant_id int, amount int"))
    assert {r.id: r.outcome for r in got.collect()} == want
    assert set(want.values()) == {"monthly", "credit", "rejected"}


def test_last_fraction_of_the_day(spark):
    rows = [(1, "succeeded", dt.datetime(2024, 5, 2, 23, 59, 59, 500000)), (2, "succeeded", dt.datetime(2024, 5, 2, 23, 59, 59)), (3, "failed", T0)]
    df = spark.createDataFrame(rows, "run_id int, status string, started_at timestamp")
    ids = lambda d: [r.run_id for r in d.collect()]
    assert ids(u.succeeded_in_range(df, "2024-05-01", "2024-05-02")) == [2]
    assert ids(u.succeeded_in_range(df, "2024-05-01", "2024-05-02", inclusive_last_second=True)) == [2, 1]


def test_subscription_keeps_plan_on_unknown_price(spark):
    e = [
        (1, "checkout.session.completed", None, "active"), (2, "customer.subscription.updated", "price_pro", "active"),
        (3, "customer.subscription.updated", "price_unknown", "trialing"), (4, "invoice.payment_failed", None, "x")]
    rows = [(7, T0 + dt.timedelta(hours=i), i, k, p, s) for i, k, p, s in e] + [(8, T0, 9, "invoice.paid", "price_pro", "active")]
    got = u.subscription_state(spark.createDataFrame(rows, "customer_id int, ts timestamp, event_id int, type string, price_id string, status string")).collect()
    assert [(r.customer_id, r.status, r.plan, r.price_id) for r in got] == [(7, "past_due", "pro", "price_unknown")]
