"""Usage block on the supplied tables: P1-P3, K1, J1-J3, J20-J25, A1, A2, A11, A29, W1-W7."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.views import sql_with, view
from quire.operators import usage as u

QUERIES: dict = {}
SQL: dict = {}


def q(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f
    return add


def _ts(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@q("p1_live_rows", sql_with("SELECT run_id, user_id, status FROM v_runs WHERE NOT delete_flg", "v_runs"))
def _(s, sf):
    return u.live_rows(view(s, sf, "v_runs")).select("run_id", "user_id", "status")


@q("p2_succeeded_in_range", sql_with(
    """SELECT run_id, user_id, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started FROM v_runs
WHERE status = 'succeeded' AND started_at >= TIMESTAMP '2024-01-05 00:00:00' AND started_at <= TIMESTAMP '2024-03-20 23:59:59'""",
    "v_runs"))
def _(s, sf):
    r = u.succeeded_in_range(view(s, sf, "v_runs"), "2024-01-05", "2024-03-20")
    return r.select("run_id", "user_id", _ts("started_at").alias("started"))


@q("p3_active_runs", sql_with(
    "SELECT user_id, count(*) AS active, min(run_id) AS first_run FROM v_runs WHERE status IN ('queued','running') GROUP BY user_id", "v_runs"))
def _(s, sf):
    return u.active_runs(view(s, sf, "v_runs")).groupBy("user_id").agg(
        F.count("*").alias("active"), F.min("run_id").alias("first_run"))


@q("k1_page_newest", sql_with(
    "SELECT run_id, user_id, status FROM v_runs ORDER BY started_at DESC, run_id DESC LIMIT 50 OFFSET 100", "v_runs"))
def _(s, sf):
    return u.page_newest(view(s, sf, "v_runs"), "started_at", "run_id", 50, 100).select("run_id", "user_id", "status")


@q("j1_runs_with_documents", sql_with(
    """SELECT r.run_id, r.status, coalesce(d.doc_id, -1) AS doc_id, coalesce(d.company_name, '') AS company_name
FROM (SELECT * FROM v_runs ORDER BY started_at DESC, run_id DESC LIMIT 50) r LEFT JOIN v_docs d ON d.run_id = r.run_id""",
    "v_runs", "v_docs"))
def _(s, sf):
    return u.runs_with_documents(view(s, sf, "v_runs"), view(s, sf, "v_docs")).select(
        "run_id", "status", F.coalesce("doc_id", F.lit(-1)).alias("doc_id"),
        F.coalesce("company_name", F.lit("")).alias("company_name"))


@q("j2_backfill_key",
   """SELECT o_orderkey, o_custkey, coalesce(c.new_id, -1) AS customer_pk FROM orders
LEFT JOIN (SELECT c_custkey, 1000000 + c_custkey * 3 AS new_id FROM customer WHERE c_custkey % 5 <> 0) c ON c_custkey = o_custkey""")
def _(s, sf):
    parent = view(s, sf, "customer").filter("c_custkey % 5 <> 0").selectExpr("c_custkey", "1000000 + c_custkey * 3 AS new_id")
    out = u.backfill_key(view(s, sf, "orders"), parent, "o_custkey", "c_custkey", "new_id", "customer_pk")
    return out.select("o_orderkey", "o_custkey", F.coalesce("customer_pk", F.lit(-1)).alias("customer_pk"))


@q("j3_orphans",
   """SELECT o_orderkey, o_custkey FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_custkey END AS o_custkey FROM orders)
WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0)""")
def _(s, sf):
    child = view(s, sf, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_custkey END AS o_custkey")
    return u.orphans(child, view(s, sf, "customer").filter("c_custkey % 5 <> 0"), "o_custkey", "c_custkey")


@q("a1_system_stats", sql_with(
    """SELECT (SELECT count(*) FROM customer) AS users, (SELECT count(*) FROM v_runs) AS runs,
(SELECT count(*) FROM v_runs WHERE status='succeeded') AS succeeded, (SELECT count(*) FROM v_runs WHERE status='failed') AS failed,
(SELECT count(*) FROM v_docs) AS documents, (SELECT count(*) FROM labels) AS evaluations""", "v_runs", "v_docs"))
def _(s, sf):
    return u.system_stats(view(s, sf, "v_runs"), view(s, sf, "v_docs"), view(s, sf, "labels"), view(s, sf, "customer"))


@q("a2_monthly_usage", sql_with(
    """SELECT user_id, CAST(year(started_at) AS INT) AS "year", CAST(month(started_at) AS INT) AS "month", count(*) AS used
FROM v_runs WHERE status='succeeded' GROUP BY ALL""", "v_runs"))
def _(s, sf):
    return u.monthly_usage(view(s, sf, "v_runs").filter("status = 'succeeded'"))


@q("a11_token_cost", sql_with(
    """SELECT user_id, strftime(started_at, '%Y-%m') AS "month", split_part(model_name, '-20', 1) AS model, count(*) AS n_runs,
CAST(sum(token_input) AS BIGINT) AS tokens_in, CAST(sum(token_output) AS BIGINT) AS tokens_out,
round(CAST(sum(CAST(token_input AS DECIMAL(12,0)) * CASE split_part(model_name, '-20', 1) WHEN 'gpt-4o' THEN 0.00250 WHEN 'gpt-4o-mini' THEN 0.00015 WHEN 'gpt-4-turbo' THEN 0.01000 ELSE 0.00000 END
 + CAST(token_output AS DECIMAL(12,0)) * CASE split_part(model_name, '-20', 1) WHEN 'gpt-4o' THEN 0.01000 WHEN 'gpt-4o-mini' THEN 0.00060 WHEN 'gpt-4-turbo' THEN 0.03000 ELSE 0.00000 END) AS DOUBLE) / 1000, 8) AS cost_usd
FROM v_runs GROUP BY ALL""", "v_runs"))
def _(s, sf):
    return u.token_cost(view(s, sf, "v_runs"), ["user_id", F.date_format("started_at", "yyyy-MM").alias("month"), "model"])


_QUOTA = """
lim AS (SELECT user_id, coalesce(monthly_limit_override, CASE plan_type WHEN 'free' THEN 3 WHEN 'starter' THEN 40 WHEN 'pro' THEN 200 ELSE 3 END) AS lim FROM v_billing),
att AS (SELECT r.run_id, r.user_id, r.started_at, strftime(started_at, '%Y-%m') AS mon, l.user_id IS NOT NULL AS has_billing, coalesce(l.lim, 3) AS lim,
  row_number() OVER (PARTITION BY r.user_id, strftime(started_at, '%Y-%m') ORDER BY started_at, run_id) AS nth
  FROM v_runs r LEFT JOIN lim l ON l.user_id = r.user_id WHERE r.status = 'succeeded')"""


@q("w1_allocate_quota", sql_with(
    "SELECT run_id, user_id, mon AS \"month\", nth, CASE WHEN nth <= lim THEN 'monthly' ELSE 'overflow' END AS bucket FROM att",
    "v_runs", "v_billing", extra=_QUOTA))
def _(s, sf):
    runs = view(s, sf, "v_runs").filter("status = 'succeeded'")
    return u.allocate_quota(runs, view(s, sf, "v_billing")).select("run_id", "user_id", "month", "nth", "bucket")


_LEDGER = """
run AS (SELECT *, sum(delta) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM v_ledger),
low AS (SELECT *, least(0, min(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS m FROM run)"""


@q("w2_credit_ledger", sql_with(
    """SELECT event_id, user_id, kind, CAST(s - m AS BIGINT) AS balance,
CASE WHEN kind <> 'use' THEN 'n/a' WHEN m = coalesce(lag(m) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) THEN 'accepted' ELSE 'rejected' END AS verdict FROM low""",
    "v_ledger", extra=_LEDGER))
def _(s, sf):
    out = u.credit_ledger(view(s, sf, "v_ledger"), "user_id", ["ts", "event_id"], "delta", "kind", [F.date_trunc("hour", "ts")])
    return out.select("event_id", "user_id", "kind", "balance",
                      F.when(F.col("kind") != "use", "n/a").when(F.col("accepted"), "accepted").otherwise("rejected").alias("verdict"))


@q("w1_quota_then_credits", sql_with(
    """, use_run AS (SELECT *, sum(delta) OVER w AS s FROM mv WINDOW w AS (PARTITION BY user_id ORDER BY ts, id, seq ROWS UNBOUNDED PRECEDING)),
use_low AS (SELECT *, least(0, min(s) OVER (PARTITION BY user_id ORDER BY ts, id, seq ROWS UNBOUNDED PRECEDING)) AS m FROM use_run),
verdict AS (SELECT *, m = coalesce(lag(m) OVER (PARTITION BY user_id ORDER BY ts, id, seq), 0) AS fine FROM use_low)
SELECT user_id, id, CASE WHEN fine THEN 'credit' ELSE 'rejected' END AS outcome FROM verdict WHERE seq = 1
UNION ALL SELECT user_id, run_id, CASE WHEN nth <= lim THEN 'monthly' ELSE 'rejected' END FROM att WHERE nth <= lim OR NOT has_billing""",
    "v_runs", "v_billing", "v_ledger", extra=_QUOTA + """,
mv AS (SELECT user_id, started_at AS ts, run_id AS id, -1 AS delta, 1 AS seq FROM att WHERE nth > lim AND has_billing
  UNION ALL SELECT user_id, ts, event_id, 10, 0 FROM v_ledger WHERE kind = 'grant')""").replace("\n, use_run", ",\nuse_run"))
def _(s, sf):
    runs = view(s, sf, "v_runs").filter("status = 'succeeded'")
    grants = view(s, sf, "v_ledger").filter("kind = 'grant'").selectExpr("user_id", "ts", "event_id AS grant_id", "delta AS amount")
    return u.allocate_with_credits(runs, view(s, sf, "v_billing"), grants)


@q("w3_first_delivery", sql_with(
    """SELECT checkout_session_id, event_id, customer_id, 10 AS credits, n AS deliveries FROM (
SELECT *, row_number() OVER (PARTITION BY checkout_session_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY checkout_session_id) AS n
FROM v_sub_events WHERE type = 'checkout.session.completed') WHERE rn = 1""", "v_sub_events"))
def _(s, sf):
    e = view(s, sf, "v_sub_events").filter("type = 'checkout.session.completed'")
    return u.first_delivery(e, "checkout_session_id", ["ts", "event_id"], ["event_id", "customer_id"]).select(
        "checkout_session_id", "event_id", "customer_id", F.lit(u.CREDIT_PACK).alias("credits"), "deliveries")


@q("w4_subscription_state", sql_with(
    """SELECT customer_id, coalesce(arg_max(st, (ts, event_id)) FILTER (st IS NOT NULL), '') AS status, coalesce(arg_max(pl, (ts, event_id)) FILTER (pl IS NOT NULL), 'free') AS plan,
coalesce(arg_max(coalesce(price_id, ''), (ts, event_id)) FILTER (sync), '') AS price_id, count(*) FILTER (sync) AS syncs, count(*) FILTER (type = 'invoice.payment_failed') AS failures FROM ev GROUP BY customer_id""",
    "v_sub_events", extra="""
gate AS (SELECT customer_id, min((ts, event_id)) AS g FROM v_sub_events WHERE type = 'checkout.session.completed' GROUP BY customer_id),
ev AS (SELECT e.*, type LIKE 'customer.subscription.%' OR type = 'invoice.paid' AS sync,
  CASE WHEN type LIKE 'customer.subscription.%' THEN status WHEN type = 'invoice.paid' THEN 'active' WHEN type = 'invoice.payment_failed' THEN 'past_due' END AS st,
  CASE WHEN type LIKE 'customer.subscription.%' AND status IN ('canceled','unpaid') THEN 'free'
       WHEN type LIKE 'customer.subscription.%' OR type = 'invoice.paid' THEN CASE price_id WHEN 'price_starter' THEN 'starter' WHEN 'price_pro' THEN 'pro' END END AS pl
  FROM v_sub_events e JOIN gate USING (customer_id) WHERE (ts, event_id) > g)"""))
def _(s, sf):
    return u.subscription_state(view(s, sf, "v_sub_events")).withColumns({
        "status": F.coalesce("status", F.lit("")), "price_id": F.coalesce("price_id", F.lit(""))})


@q("j20_plan_lookup", sql_with(
    """SELECT coalesce(CASE price_id WHEN 'price_starter' THEN 'starter' WHEN 'price_pro' THEN 'pro' END, 'keep previous') AS plan, type, count(*) AS n FROM v_sub_events GROUP BY ALL""", "v_sub_events"))
def _(s, sf):
    return u.plan_lookup(view(s, sf, "v_sub_events")).groupBy(
        F.coalesce("mapped_plan", F.lit("keep previous")).alias("plan"), "type").agg(F.count("*").alias("n"))


_LEGAL_DOCS = """SELECT n_nationkey AS document_id, CASE WHEN n_nationkey % 2 = 0 THEN 'terms' ELSE 'privacy' END AS doc_type,
CASE WHEN n_nationkey % 5 = 4 THEN 'retired' ELSE 'active' END AS status, n_nationkey * 7 % 23 AS effective_at, n_nationkey % 3 <> 0 AS requires_reaccept FROM nation"""
_ACCEPT = """SELECT o_custkey AS user_id, o_orderdate AS accepted_at, o_orderkey AS event_id, CAST(o_orderkey * 3 % 25 AS INT) AS document_id,
CASE WHEN o_orderkey * 3 % 25 % 2 = 0 THEN 'terms' ELSE 'privacy' END AS doc_type FROM orders"""


def _spark_sql(s, sf, text, *tables):
    for t in tables:
        view(s, sf, t).createOrReplaceTempView(f"quire_{t}")
        text = text.replace(f"FROM {t}", f"FROM quire_{t}")
    return s.sql(text)


@q("w5_current_document", f"""SELECT doc_type, document_id, requires_reaccept FROM (SELECT *, row_number() OVER (PARTITION BY doc_type ORDER BY effective_at DESC, document_id DESC) AS rn
FROM ({_LEGAL_DOCS}) WHERE status = 'active') WHERE rn = 1""")
def _(s, sf):
    return u.current_document(_spark_sql(s, sf, _LEGAL_DOCS, "nation"))


_LATEST = f"""SELECT user_id, doc_type, document_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, doc_type ORDER BY accepted_at DESC, event_id DESC) AS rn FROM ({_ACCEPT})) WHERE rn = 1"""


def _latest(s, sf):
    return u.latest_per_key(_spark_sql(s, sf, _ACCEPT, "orders"), ["user_id", "doc_type"], ["accepted_at", "event_id"], ["document_id"])


@q("w6_latest_per_user", _LATEST)
def _(s, sf):
    return _latest(s, sf)


_COMPLY = f"""SELECT c_custkey AS user_id, coalesce(t.document_id = ct.document_id, false) OR NOT ct.requires_reaccept AS terms_ok,
coalesce(p.document_id = cp.document_id, false) OR NOT cp.requires_reaccept AS privacy_ok,
(coalesce(t.document_id = ct.document_id, false) OR NOT ct.requires_reaccept) AND (coalesce(p.document_id = cp.document_id, false) OR NOT cp.requires_reaccept) AS compliant
FROM customer LEFT JOIN (SELECT * FROM ({_LATEST}) WHERE doc_type='terms') t ON t.user_id = c_custkey
LEFT JOIN (SELECT * FROM ({_LATEST}) WHERE doc_type='privacy') p ON p.user_id = c_custkey,
(SELECT * FROM ({_LEGAL_DOCS}) WHERE status='active' AND doc_type='terms' ORDER BY effective_at DESC, document_id DESC LIMIT 1) ct,
(SELECT * FROM ({_LEGAL_DOCS}) WHERE status='active' AND doc_type='privacy' ORDER BY effective_at DESC, document_id DESC LIMIT 1) cp"""


def _users(s, sf):
    return view(s, sf, "customer").select(F.col("c_custkey").alias("user_id"))


def _comply(s, sf):
    return u.compliance(_users(s, sf), _spark_sql(s, sf, _LEGAL_DOCS, "nation"), _latest(s, sf))


@q("j21_compliance", _COMPLY)
def _(s, sf):
    return _comply(s, sf)


@q("j22_eligibility", sql_with(f"""SELECT c.user_id, CASE WHEN NOT c.compliant THEN 'compliance' WHEN NOT (cu.c_acctbal > 0) THEN 'onboarding'
WHEN o.user_id IS NULL THEN 'owned_input'
WHEN coalesce(us.used, 0) >= coalesce(b.monthly_limit_override, CASE b.plan_type WHEN 'starter' THEN 40 WHEN 'pro' THEN 200 ELSE 3 END) AND coalesce(us.credits, 0) <= 0 THEN 'quota' ELSE 'ok' END AS gate
FROM ({_COMPLY}) c JOIN customer cu ON cu.c_custkey = c.user_id
LEFT JOIN (SELECT DISTINCT o_custkey AS user_id FROM orders WHERE o_orderstatus = 'O') o ON o.user_id = c.user_id
LEFT JOIN (SELECT user_id, count(*) AS used, max(user_id % 2) AS credits FROM v_runs WHERE status = 'succeeded' AND started_at >= TIMESTAMP '2024-02-01' AND started_at < TIMESTAMP '2024-03-01' GROUP BY user_id) us ON us.user_id = c.user_id
LEFT JOIN v_billing b ON b.user_id = c.user_id""", "v_runs", "v_billing"))
def _(s, sf):
    cust = view(s, sf, "customer")
    onboarded = cust.select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") > 0).alias("onboarding_completed"))
    owners = view(s, sf, "orders").filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("user_id")).distinct()
    used = view(s, sf, "v_runs").filter("status = 'succeeded' AND started_at >= TIMESTAMP '2024-02-01' AND started_at < TIMESTAMP '2024-03-01'").groupBy("user_id").agg(
        F.count("*").alias("used"), F.max(F.col("user_id") % 2).alias("credits"))
    return u.eligibility(_users(s, sf), _comply(s, sf), onboarded, owners, used, view(s, sf, "v_billing"))


@q("j23_stale_drafts", """SELECT p_partkey, p_partkey * 10 AS draft_id,
sha256('{"p_brand":"' || p_brand || '","p_name":"' || p_name || CASE WHEN p_partkey % 4 = 0 THEN ' v0"}' ELSE '"}' END) <> sha256('{"p_brand":"' || p_brand || '","p_name":"' || p_name || '"}') AS stale FROM part""")
def _(s, sf):
    part = view(s, sf, "part")
    drafts = part.select("p_partkey", (F.col("p_partkey") * 10).alias("draft_id"), F.sha2(F.concat(
        F.lit('{"p_brand":"'), "p_brand", F.lit('","p_name":"'), "p_name",
        F.when(F.col("p_partkey") % 4 == 0, F.lit(' v0"}')).otherwise(F.lit('"}'))), 256).alias("source_hash"))
    return u.stale_drafts(drafts, part, "p_partkey", ["p_name", "p_brand"])


@q("j24_evaluable", sql_with(
    """SELECT run_id, run_id IN (SELECT doc_id FROM labels) AS replaces FROM v_runs WHERE status='succeeded' AND run_id IN (SELECT run_id FROM v_docs)""", "v_runs", "v_docs"))
def _(s, sf):
    evals = view(s, sf, "labels").select(F.col("doc_id").alias("run_id"))
    return u.evaluable(view(s, sf, "v_runs"), view(s, sf, "v_docs"), evals)


@q("j25_billing_status", sql_with(
    """SELECT c_custkey AS user_id, coalesce(b.plan_type, 'free') AS plan_type, CASE WHEN b.user_id IS NULL THEN 'none' WHEN b.user_id % 4 = 0 THEN 'past_due' ELSE 'active' END AS subscription_status,
coalesce(us.used, 0) AS monthly_used, CAST(coalesce(b.monthly_limit_override, CASE b.plan_type WHEN 'starter' THEN 40 WHEN 'pro' THEN 200 ELSE 3 END) AS INT) AS monthly_limit,
coalesce(b.user_id % 6, 0) AS extra_credits
FROM customer LEFT JOIN v_billing b ON b.user_id = c_custkey
LEFT JOIN (SELECT user_id, count(*) AS used FROM v_runs WHERE status='succeeded' AND strftime(started_at, '%Y-%m') = '2024-02' GROUP BY user_id) us ON us.user_id = c_custkey""", "v_runs", "v_billing"))
def _(s, sf):
    billing = view(s, sf, "v_billing").withColumns({
        "subscription_status": F.when(F.col("user_id") % 4 == 0, "past_due").otherwise("active"),
        "extra_credits": F.col("user_id") % 6})
    used = u.monthly_usage(view(s, sf, "v_runs").filter("status = 'succeeded'")).filter("year = 2024 AND month = 2").select("user_id", "used")
    return u.billing_status(_users(s, sf), billing, used)


@q("w7_signup_grant", """SELECT u.user_id, coalesce(NOT g.granted, true) AS granted_now, coalesce(g.extra_credits, 0) + CASE WHEN coalesce(g.granted, false) THEN 0 ELSE 5 END AS credits,
coalesce(CASE WHEN coalesce(g.granted, false) THEN g.ovr ELSE 0 END, -1) AS limit_override
FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup') u
LEFT JOIN (SELECT c_custkey AS user_id, c_custkey % 7 AS extra_credits, c_custkey % 3 = 0 AS granted, CASE WHEN c_custkey % 2 = 0 THEN 9 END AS ovr FROM customer WHERE c_custkey % 5 <> 0) g ON g.user_id = u.user_id""")
def _(s, sf):
    billing = view(s, sf, "customer").filter("c_custkey % 5 <> 0").selectExpr(
        "c_custkey AS user_id", "c_custkey % 7 AS extra_credits", "c_custkey % 3 = 0 AS granted",
        "CASE WHEN c_custkey % 2 = 0 THEN 9 END AS monthly_limit_override")
    out = u.signup_grant(view(s, sf, "events").filter("event_type = 'signup'"), billing, 5)
    return out.withColumn("limit_override", F.coalesce("limit_override", F.lit(-1)))


_CONFIG = """SELECT p_partkey AS id, CASE WHEN p_partkey % 4 <> 3 THEN '' ELSE concat('model-', p_brand) END AS model,
CASE WHEN p_size % 9 = 0 THEN concat('beta', CAST(p_size AS STRING)) ELSE 'normal' END AS mode FROM part"""


@q("a29_canonical_config", f"""SELECT min(id) AS id, coalesce(arg_min(model, id) FILTER (trim(model) <> ''), '') AS model,
coalesce(arg_max(mode, id) FILTER (mode <> 'normal'), 'normal') AS mode, count(*) AS collapsed FROM ({_CONFIG})""")
def _(s, sf):
    return u.canonical_config(_spark_sql(s, sf, _CONFIG, "part"))
