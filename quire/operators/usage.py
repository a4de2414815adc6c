"""Usage, quota, credit and subscription analytics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.plans import lookup_join, ordered_scan, rank_in, rule_table

# Plans, packs and token prices.
PLAN_LIMITS = {"free": 3, "starter": 40, "pro": 200}
CREDIT_PACK = 10
PRICE_TO_PLAN = {"price_starter": "starter", "price_pro": "pro"}
TOKEN_PRICES = {
    "gpt-4o": ("0.0025", "0.01"),
    "gpt-4o-mini": ("0.00015", "0.0006"),
    "gpt-4-turbo": ("0.01", "0.03"),
}


def live_rows(df: DataFrame, flag: str = "delete_flg") -> DataFrame:
    """Rows that are not soft-deleted."""
    return df.filter(~F.coalesce(F.col(flag), F.lit(False)))


def succeeded_in_range(
    runs: DataFrame, start: str, end: str, status: str = "status", at: str = "started_at",
    inclusive_last_second: bool = False,
) -> DataFrame:
    """Succeeded runs of the days ``start``..``end``, ascending.

    The upper bound is 23:59:59 sharp, so the last fraction of the final second
    is left out unless ``inclusive_last_second``.
    """
    lo = F.to_timestamp(F.lit(f"{start} 00:00:00"))
    if inclusive_last_second:
        upper = F.col(at) < F.to_timestamp(F.lit(f"{end} 00:00:00")) + F.expr("INTERVAL 1 DAY")
    else:
        upper = F.col(at) <= F.to_timestamp(F.lit(f"{end} 23:59:59"))
    return runs.filter((F.col(status) == "succeeded") & (F.col(at) >= lo) & upper).orderBy(at)


def active_runs(runs: DataFrame, status: str = "status") -> DataFrame:
    """Runs that are queued or running."""
    return runs.filter(F.col(status).isin("queued", "running"))


def page_newest(
    df: DataFrame, at: str, key: str, limit: int = 50, offset: int = 0
) -> DataFrame:
    """One page of rows, newest first, ties broken by ``key``."""
    return df.orderBy(F.col(at).desc(), F.col(key).desc()).offset(offset).limit(limit)


def runs_with_documents(
    runs: DataFrame, docs: DataFrame, limit: int = 50, offset: int = 0, run: str = "run_id",
    at: str = "started_at",
) -> DataFrame:
    """A page of runs (the limit counts runs) with one row per document of a run."""
    page = page_newest(runs, at, run, limit, offset)
    children = docs.join(F.broadcast(page.select(run)), run, "left_semi")
    return page.join(children.drop("user_id"), run, "left")


def backfill_key(
    child: DataFrame, parent: DataFrame, fk: str, old: str, new: str, out: str
) -> DataFrame:
    """Child rows with the parent's new key; orphans get null."""
    dim = parent.select(F.col(old).alias(fk), F.col(new).alias(out))
    return lookup_join(child, dim, [fk], "left")


def orphans(child: DataFrame, parent: DataFrame, fk: str, key: str) -> DataFrame:
    """Child rows whose non-null foreign key has no parent."""
    have = parent.select(F.col(key).alias(fk)).distinct()
    return lookup_join(child.filter(F.col(fk).isNotNull()), have, [fk], "left_anti")


def system_stats(runs: DataFrame, docs: DataFrame, evals: DataFrame, users: DataFrame) -> DataFrame:
    """One row of totals; one pass per table, joined as single rows."""
    r = runs.agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(F.col("status") == "succeeded").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )
    parts = [
        users.agg(F.count(F.lit(1)).alias("users")), r,
        docs.agg(F.count(F.lit(1)).alias("documents")),
        evals.agg(F.count(F.lit(1)).alias("evaluations")),
    ]
    one = [p.withColumn("__one", F.lit(1)) for p in parts]
    out = one[0]
    for p in one[1:]:
        out = out.join(p, "__one")
    return out.drop("__one")


def monthly_usage(runs: DataFrame, user: str = "user_id", at: str = "started_at") -> DataFrame:
    """Rows per user and calendar month (UTC session)."""
    return runs.groupBy(
        F.col(user), F.year(at).alias("year"), F.month(at).alias("month")
    ).agg(F.count(F.lit(1)).alias("used"))


def token_cost(
    runs: DataFrame, keys: Sequence[str | Column], prices: Mapping[str, tuple] = TOKEN_PRICES
) -> DataFrame:
    """Exact decimal cost per ``keys``; the model name is cut at ``-20``, unknown models cost 0."""
    table = rule_table(
        runs.sparkSession, [(m, *p) for m, p in prices.items()], "model string, p_in string, p_out string"
    )
    dec = "decimal(10,5)"
    per = (
        runs.withColumn("model", F.split("model_name", "-20")[0])
        .join(table, "model", "left")
        .withColumn(
            "cost",
            F.col("token_input").cast("decimal(12,0)") * F.coalesce(F.col("p_in").cast(dec), F.lit(0).cast(dec))
            + F.col("token_output").cast("decimal(12,0)") * F.coalesce(F.col("p_out").cast(dec), F.lit(0).cast(dec)),
        )
    )
    return per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.sum("token_input").alias("tokens_in"),
        F.sum("token_output").alias("tokens_out"),
        F.round(F.sum("cost").cast("double") / 1000, 8).alias("cost_usd"),
    )


def resolved_limit(plan: Column, override: Column) -> Column:
    """Override, else the plan's limit, unknown plans counting as free."""
    limit = F.lit(PLAN_LIMITS["free"])
    for name, n in PLAN_LIMITS.items():
        limit = F.when(plan == name, F.lit(n)).otherwise(limit)
    return F.coalesce(override.cast("int"), limit)


def with_limits(rows: DataFrame, billing: DataFrame, user: str = "user_id") -> DataFrame:
    """Rows with ``has_billing`` and the monthly ``limit`` of their user."""
    dim = billing.select(
        F.col(user), F.lit(True).alias("has_billing"),
        resolved_limit(F.col("plan_type"), F.col("monthly_limit_override")).alias("limit"),
    )
    return lookup_join(rows, dim, [user], "left").withColumns({
        "has_billing": F.coalesce("has_billing", F.lit(False)),
        "limit": F.coalesce("limit", F.lit(PLAN_LIMITS["free"])),
    })


def allocate_quota(
    attempts: DataFrame, billing: DataFrame, user: str = "user_id", at: str = "started_at",
    key: str = "run_id", block: str = "hour",
) -> DataFrame:
    """Each successful attempt as ``monthly`` or ``overflow``.

    The first ``limit`` attempts of a user and month are monthly.  The rank is
    taken in ``block``-sized pieces of time.
    """
    rows = with_limits(attempts, billing, user).withColumn("month", F.date_format(at, "yyyy-MM"))
    ranked = ordered_scan(
        rows, [user, "month"], [at, key], [F.date_trunc(block, at)], [rank_in("nth")]
    )
    return ranked.withColumn(
        "bucket", F.when(F.col("nth") <= F.col("limit"), "monthly").otherwise("overflow")
    )


def credit_ledger(
    deltas: DataFrame, user: str, order: Sequence[str], delta: str, kind: str,
    block: Sequence[Column],
) -> DataFrame:
    """Balance after each row, floored at zero, and whether a use was accepted.

    With S the running sum and M = min(0, running min of S), the balance is
    S - M and a use is refused exactly where M falls.  Blocks carry (sum, least
    prefix), which compose, so one shuffle of the rows is enough.
    """
    names = [f"__b{i}" for i in range(len(block))]
    rows = deltas.withColumns(dict(zip(names, block)))
    win = Window.partitionBy(user, *names).orderBy(*order)
    upto = win.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pre = rows.withColumn("__p", F.sum(delta).over(upto))
    sums = pre.groupBy(user, *names).agg(F.sum(delta).alias("__d"), F.min("__p").alias("__m"))
    prior = Window.partitionBy(user).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.withColumn("__s0", F.coalesce(F.sum("__d").over(prior), F.lit(0)))
    base = base.withColumn(
        "__m0", F.least(F.lit(0), F.coalesce(F.min(F.col("__s0") + F.col("__m")).over(prior), F.lit(0)))
    ).select(user, *names, "__s0", "__m0")
    run = pre.join(base, [user, *names]).withColumn("__s", F.col("__s0") + F.col("__p"))
    run = run.withColumn("__low", F.least(F.col("__m0"), F.min("__s").over(upto)))
    before = F.coalesce(F.lag("__low").over(win), F.col("__m0"))
    return run.withColumns({
        "balance": (F.col("__s") - F.col("__low")).cast("long"),
        "accepted": F.when(F.col(kind) == "use", F.col("__low") == before),
    }).select(*deltas.columns, "balance", "accepted")


def allocate_with_credits(
    attempts: DataFrame, billing: DataFrame, grants: DataFrame, user: str = "user_id",
    at: str = "started_at", key: str = "run_id", block: str = "hour",
) -> DataFrame:
    """Quota, then credits, then refusal: ``monthly`` / ``credit`` / ``rejected`` per attempt.

    ``grants`` has (user, ts, grant_id, amount).  Users without a billing row
    have no credits.
    """
    placed = allocate_quota(attempts, billing, user, at, key, block).select(
        user, F.col(at).alias("ts"), F.col(key).alias("id"), "bucket", "has_billing"
    )
    over = placed.filter((F.col("bucket") == "overflow") & F.col("has_billing"))
    moves = grants.select(
        user, "ts", F.col("grant_id").alias("id"), F.col("amount").cast("long").alias("delta"),
        F.lit(0).alias("seq"), F.lit("grant").alias("kind"),
    ).unionByName(over.select(
        user, "ts", "id", F.lit(-1).cast("long").alias("delta"), F.lit(1).alias("seq"), F.lit("use").alias("kind"),
    ))
    used = credit_ledger(
        moves, user, ["ts", "id", "seq"], "delta", "kind", [F.date_trunc(block, "ts")]
    ).filter(F.col("kind") == "use").select(
        user, "id", F.when(F.col("accepted"), "credit").otherwise("rejected").alias("outcome")
    )
    rest = placed.filter(~((F.col("bucket") == "overflow") & F.col("has_billing"))).select(
        user, "id", F.when(F.col("bucket") == "monthly", "monthly").otherwise("rejected").alias("outcome")
    )
    return rest.unionByName(used)


def first_delivery(events: DataFrame, key: str, order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The first row per ``key``; duplicates of an at-least-once feed fall away map-side."""
    return events.groupBy(key).agg(
        F.min_by(F.struct(*keep), F.struct(*order)).alias("__r"),
        F.count(F.lit(1)).alias("deliveries"),
    ).select(key, "__r.*", "deliveries")


def plan_lookup(events: DataFrame, price: str = "price_id", prices: Mapping[str, str] = PRICE_TO_PLAN) -> DataFrame:
    """Events with the plan of their price, null when unknown."""
    table = rule_table(events.sparkSession, list(prices.items()), f"{price} string, mapped_plan string")
    return events.join(table, price, "left")


def subscription_state(
    events: DataFrame, customer: str = "customer_id", at: str = "ts", key: str = "event_id",
    prices: Mapping[str, str] = PRICE_TO_PLAN,
) -> DataFrame:
    """Latest subscription state per customer.

    Status and price are overwritten by each sync, the plan only by a known
    price or by a cancellation.  Events before the customer's first checkout
    are ignored.  All parts are mergeable aggregates: nothing is sorted.
    """
    e = plan_lookup(events, "price_id", prices)
    at_ = F.struct(F.col(at), F.col(key))
    gate = e.filter(F.col("type") == "checkout.session.completed").groupBy(customer).agg(
        F.min(at_).alias("__gate")
    )
    sub = F.col("type").startswith("customer.subscription.")
    paid = F.col("type") == "invoice.paid"
    failed = F.col("type") == "invoice.payment_failed"
    sync = sub | paid
    status = F.when(sub, F.col("status")).when(paid, F.lit("active")).when(failed, F.lit("past_due"))
    plan = F.when(sub & F.col("status").isin("canceled", "unpaid"), F.lit("free")).when(sync, F.col("mapped_plan"))
    live = lookup_join(e, gate, [customer], "inner", spread=F.col(key)).filter(at_ > F.col("__gate"))
    return live.groupBy(customer).agg(
        F.max_by(status, F.when(status.isNotNull(), at_)).alias("status"),
        F.coalesce(F.max_by(plan, F.when(plan.isNotNull(), at_)), F.lit("free")).alias("plan"),
        F.max_by("price_id", F.when(sync, at_)).alias("price_id"),
        F.count_if(sync).alias("syncs"),
        F.count_if(failed).alias("failures"),
    )


def current_document(docs: DataFrame) -> DataFrame:
    """Per type the active document with the latest effective date."""
    return docs.filter(F.col("status") == "active").groupBy("doc_type").agg(
        F.max_by(F.struct("document_id", "requires_reaccept"), F.struct("effective_at", "document_id")).alias("d")
    ).select("doc_type", "d.*")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The newest row per key, as a mergeable aggregate."""
    return df.groupBy(*keys).agg(
        F.max_by(F.struct(*keep), F.struct(*order)).alias("__r")
    ).select(*keys, "__r.*")


def compliance(users: DataFrame, docs: DataFrame, accepted: DataFrame, user: str = "user_id") -> DataFrame:
    """Whether each user holds the current terms and privacy documents.

    ``accepted`` has (user, doc_type, document_id), one row per user and type.
    Without a current document of a type nobody complies.
    """
    current = {
        t: current_document(docs.filter(F.col("doc_type") == t)).select(
            F.col("document_id").alias(f"{t}_id"), F.col("requires_reaccept").alias(f"{t}_req")
        )
        for t in ("terms", "privacy")
    }
    held = accepted.groupBy(user).agg(
        F.max(F.when(F.col("doc_type") == "terms", F.col("document_id"))).alias("held_terms"),
        F.max(F.when(F.col("doc_type") == "privacy", F.col("document_id"))).alias("held_privacy"),
    )
    one = users.join(held, user, "left").withColumn("__one", F.lit(1))
    for c in current.values():
        one = one.join(F.broadcast(c.withColumn("__one", F.lit(1))), "__one", "left")  # one row at most
    ok = {
        t: F.coalesce(F.col(f"held_{t}") == F.col(f"{t}_id"), F.lit(False)) | F.coalesce(~F.col(f"{t}_req"), F.lit(False))
        for t in ("terms", "privacy")
    }
    return one.select(
        user, ok["terms"].alias("terms_ok"), ok["privacy"].alias("privacy_ok"),
        (ok["terms"] & ok["privacy"]).alias("compliant"),
    )


def eligibility(
    users: DataFrame, compliant: DataFrame, onboarded: DataFrame, owners: DataFrame, usage: DataFrame,
    billing: DataFrame, user: str = "user_id",
) -> DataFrame:
    """First failing gate per user: compliance, onboarding, owned_input, quota, else ``ok``."""
    flags = (
        users.join(compliant.select(user, "compliant"), user, "left")
        .join(onboarded.select(user, "onboarding_completed"), user, "left")
        .join(owners.select(user, F.lit(True).alias("owns_input")), user, "left")
        .join(usage.select(user, "used", "credits"), user, "left")
    )
    flags = with_limits(flags, billing, user)
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    spent = (F.coalesce("used", F.lit(0)) >= F.col("limit")) & (F.coalesce("credits", F.lit(0)) <= 0)
    return flags.select(
        user,
        F.when(no("compliant"), "compliance").when(no("onboarding_completed"), "onboarding")
        .when(no("owns_input"), "owned_input").when(spent, "quota").otherwise("ok").alias("gate"),
    )


def canonical_hash(struct: Column) -> Column:
    """sha256 of the JSON text of a struct whose fields are in name order."""
    return F.sha2(F.to_json(struct), 256)


def stale_drafts(drafts: DataFrame, resumes: DataFrame, key: str, payload: Sequence[str]) -> DataFrame:
    """Drafts whose stored hash differs from the hash of the resume they came from."""
    now = resumes.select(key, canonical_hash(F.struct(*sorted(payload))).alias("hash_now"))
    return drafts.join(now, key).select(
        key, "draft_id", (~F.col("source_hash").eqNullSafe(F.col("hash_now"))).alias("stale")
    )


def evaluable(runs: DataFrame, docs: DataFrame, evals: DataFrame, run: str = "run_id") -> DataFrame:
    """Succeeded runs that have a document, with whether an evaluation will be replaced."""
    have = docs.select(run).distinct()
    done = evals.select(run).distinct().withColumn("replaces", F.lit(True))
    return (
        runs.filter(F.col("status") == "succeeded").join(have, run, "left_semi")
        .join(done, run, "left").select(run, F.coalesce("replaces", F.lit(False)).alias("replaces"))
    )


def billing_status(users: DataFrame, billing: DataFrame, usage: DataFrame, user: str = "user_id") -> DataFrame:
    """Plan, subscription status, use this month, limit and credits, with defaults."""
    return users.join(billing, user, "left").join(usage, user, "left").select(
        user, F.coalesce("plan_type", F.lit("free")).alias("plan_type"),
        F.coalesce("subscription_status", F.lit("none")).alias("subscription_status"),
        F.coalesce("used", F.lit(0)).alias("monthly_used"),
        resolved_limit(F.col("plan_type"), F.col("monthly_limit_override")).alias("monthly_limit"),
        F.coalesce("extra_credits", F.lit(0)).alias("extra_credits"),
    )


def signup_grant(requests: DataFrame, billing: DataFrame, amount: int, user: str = "user_id") -> DataFrame:
    """Grant the signup amount once per user; a positive amount sets the monthly override to 0.

    ``requests`` may repeat users; ``billing`` has (user, extra_credits, granted,
    monthly_limit_override).
    """
    asked = requests.select(user).distinct()
    override = F.lit(0) if amount > 0 else F.lit(None).cast("int")
    first = ~F.coalesce(F.col("granted"), F.lit(False))
    return asked.join(billing, user, "left").select(
        user, first.alias("granted_now"),
        (F.coalesce("extra_credits", F.lit(0)) + F.when(first, amount).otherwise(0)).alias("credits"),
        F.when(first, F.coalesce(override, F.col("monthly_limit_override")))
        .otherwise(F.col("monthly_limit_override")).alias("limit_override"),
    )


def canonical_config(rows: DataFrame, default_mode: str = "normal") -> DataFrame:
    """Duplicate settings rows collapsed to one."""
    model = F.when(F.trim("model") != "", F.col("model"))
    mode = F.when(F.col("mode") != default_mode, F.col("mode"))
    return rows.agg(
        F.min("id").alias("id"),
        F.coalesce(F.min_by(model, F.when(model.isNotNull(), F.col("id"))), F.lit("")).alias("model"),
        F.coalesce(F.max_by(mode, F.when(mode.isNotNull(), F.col("id"))), F.lit(default_mode)).alias("mode"),
        F.count(F.lit(1)).alias("collapsed"),
    )


def log_counters(logs: DataFrame) -> DataFrame:
    """Records per (day, level, logger) with run counters read from the messages."""
    m = F.lower("message")
    return logs.groupBy(F.to_date("ts").alias("day"), "level", "logger").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(m.contains("generation run started")).alias("runs_started"),
        F.count_if(m.rlike("generation run finished .*status=succeeded")).alias("runs_succeeded"),
        F.count_if(m.rlike("generation run finished .*status=failed")).alias("runs_failed"),
    )
