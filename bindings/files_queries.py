"""Files and streams: S1-S7, A10, T1-T6. Inputs are written from the supplied tables first."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from bindings.usage_queries import SQL as USAGE_SQL
from bindings.views import sql_with, view
from quire.operators import evals as e
from quire.operators import usage as u
from quire.plans.lineage import ensure_checkpoint_dir
from quire.sources import buckets, io
from quire.streaming import jobs, keyed

QUERIES: dict = {}
SQL: dict = {}


def q(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f
    return add


def fresh_folder(s) -> str:
    """A new folder beside the checkpoints, in the shared storage the cluster names."""
    return f"{ensure_checkpoint_dir(s)}/run-{uuid.uuid4().hex}"


def replay(s, slices, base, job):
    """Append one slice after the other to a folder and run ``job`` on the stream after each.

    Every run starts from the checkpoint of the one before it, as after a restart.
    """
    for part in slices:
        part.write.mode("append").parquet(f"{base}/in")
        job(s.readStream.schema(part.schema).parquet(f"{base}/in"))


def in_time(df, at, cuts):
    """``df`` in slices of time."""
    edges = [None, *cuts, None]
    for lo, hi in zip(edges, edges[1:]):
        part = df
        if lo:
            part = part.filter(F.col(at) >= F.lit(lo).cast("timestamp"))
        if hi:
            part = part.filter(F.col(at) < F.lit(hi).cast("timestamp"))
        yield part


# Lists of a thousand lines a file, so that the number of files grows with the table.
@q("s1_read_url_list", sql_with("""SELECT url, CAST(n AS BIGINT) AS line_no FROM (SELECT page_id, row_number() OVER (PARTITION BY page_id // 1000 ORDER BY page_id) AS n, url FROM v_urls) WHERE page_id % 11 <> 0 AND page_id % 13 <> 0""", "v_urls"))
def _(s, sf):
    base = fresh_folder(s)
    line = F.when(F.col("page_id") % 11 == 0, F.concat(F.lit("# "), "url")).when(F.col("page_id") % 13 == 0, "   ").otherwise(F.concat(F.lit("  "), "url", F.lit(" ")))
    lists = view(s, sf, "v_urls").select("page_id", line.alias("value"), F.floor(F.col("page_id") / 1000).alias("list"))
    lists.repartition("list").sortWithinPartitions("list", "page_id").select("value", "list").write.partitionBy("list").text(base)
    return io.read_url_list(s, base)


def log_lines(s, sf):
    """Log lines of the events with their day and hour, errors with two traceback lines."""
    ev = view(s, sf, "events")
    body = F.when(F.col("event_type") == "signup", F.concat(F.lit("Generation run started run_id="), "event_id")).when(
        F.col("event_type") == "purchase", F.concat(F.lit("Generation run finished run_id="), "event_id", F.lit(" status=succeeded user_id="), "user_id")).when(
        F.col("event_type") == "error", F.concat(F.lit("Generation run finished run_id="), "event_id", F.lit(" status=failed error=x\nTraceback (most recent call last):\n  at line 3"))).otherwise(
        F.concat(F.lit("page "), "event_type"))
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" ["), level, F.lit("] app."), F.col("user_id") % 3, F.lit(": "), body)
    return ev.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "HH").alias("hour"), "ts", "event_id", line.alias("value"))


def write_logs(lines, folder):
    """A folder for each day and hour; their files are written side by side."""
    lines.repartition("day", "hour").sortWithinPartitions("day", "hour", "ts", "event_id").select("value", "day", "hour").write.mode("append").partitionBy("day", "hour").text(folder)
    return folder


def log_folder(s, sf):
    return write_logs(log_lines(s, sf), f"{fresh_folder(s)}/logs")


_CUTS = ["2024-01-10", "2024-01-20"]
_LOGS = """SELECT ts, CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'INFO' END AS level, concat('app.', user_id % 3) AS logger, event_type FROM events"""


@q("s2_read_logs", f"""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS file_date, level, logger, count(*) AS records, CAST(sum(CASE WHEN level = 'ERROR' THEN 3 ELSE 1 END) AS BIGINT) AS lines FROM ({_LOGS}) WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-20' GROUP BY ALL""")
def _(s, sf):
    r = io.read_logs(s, log_folder(s, sf), "2024-01-03", "2024-01-20")
    return r.groupBy(F.col("file_date").cast("string").alias("file_date"), "level", "logger").agg(F.count("*").alias("records"), F.sum("n_lines").alias("lines"))


@q("a10_log_counters", f"""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS "day", level, logger, count(*) AS records, count(*) FILTER (event_type = 'signup') AS runs_started, count(*) FILTER (event_type = 'purchase') AS runs_succeeded, count(*) FILTER (event_type = 'error') AS runs_failed FROM ({_LOGS}) GROUP BY ALL""")
def _(s, sf):
    r = io.read_logs(s, log_folder(s, sf), "2024-01-01", "2024-12-31")
    return u.log_counters(r).withColumn("day", F.col("day").cast("string"))


@q("t1_stream_log_counts", f"""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS "start", level, logger, count(*) AS records FROM ({_LOGS}) GROUP BY ALL""")
def _(s, sf):
    base = fresh_folder(s)
    for part in in_time(log_lines(s, sf), "ts", _CUTS):
        jobs.stream_log_counts(s.readStream.text(write_logs(part, f"{base}/logs")), base)
    return jobs.newest(s, f"{base}/counts").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "level", "logger", "records")


def _json_runs(s, sf, bad=False):
    """A folder of JSON files, one per order priority and month, some with broken text."""
    base = fresh_folder(s)
    o = view(s, sf, "orders").withColumn("m", F.date_format("o_orderdate", "yyyyMM")).groupBy("o_orderpriority", "m").agg(
        F.count("*").alias("n"), F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double"), 2).alias("total"))
    name = F.concat(F.substring("o_orderpriority", 1, 1), F.lit("-"), F.col("m"), F.lit("15-101500"))
    rows = o.withColumn("name", name).withColumn("value", F.to_json(F.struct("o_orderpriority", "m", "n", "total")))
    if bad:
        rows = rows.withColumn("value", F.when(F.col("m").endswith("03"), F.substring("value", 1, 9)).otherwise(F.col("value")))
    rows.select("value", "name").repartition("name").write.partitionBy("name").text(f"{base}/raw")
    fs = s.sparkContext._jvm.org.apache.hadoop.fs
    h = fs.Path(base).getFileSystem(s.sparkContext._jsc.hadoopConfiguration())
    h.mkdirs(fs.Path(f"{base}/json"))
    for d in h.listStatus(fs.Path(f"{base}/raw")):
        n = d.getPath().getName()
        if n.startswith("name="):
            for st in h.listStatus(d.getPath()):
                h.rename(st.getPath(), fs.Path(f"{base}/json/run_{n[5:]}.json"))
    return f"{base}/json"


_ORD = """SELECT o_orderpriority, strftime(o_orderdate, '%Y%m') AS m, count(*) AS n, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE), 2) AS total FROM orders GROUP BY ALL"""
_SCHEMA = "o_orderpriority string, m string, n bigint, total double"


@q("s3_read_run_files", f"""SELECT o_orderpriority, m, n, total, 'run_' || left(o_orderpriority, 1) || '-' || m || '15-101500.json' AS file_name FROM ({_ORD}) WHERE m BETWEEN '199601' AND '199706'""")
def _(s, sf):
    return io.read_run_files(s, _json_runs(s, sf), "1996-01-01", "1997-06-30", _SCHEMA).drop("run_at")


@q("s4_read_artefacts", f"""SELECT kind AS source_kind, count(*) FILTER (m NOT LIKE '%03') AS documents, count(*) FILTER (m LIKE '%03') AS rejected FROM ({_ORD}), (SELECT unnest(['docx', 'pdf']) AS kind) GROUP BY 1""")
def _(s, sf):
    f = _json_runs(s, sf, bad=True)
    docs, bad = io.read_artefacts(s, {"docx": f, "pdf": f}, _SCHEMA)
    return docs.groupBy("source_kind").agg(F.count("*").alias("documents")).join(bad.groupBy("source_kind").agg(F.count("*").alias("rejected")), "source_kind")


@q("s5_read_tables", sql_with("SELECT 'generation_runs' AS name, count(*) AS n FROM v_runs UNION ALL SELECT 'documents', count(*) FROM v_docs UNION ALL SELECT 'billing', count(*) FROM v_billing", "v_runs", "v_docs", "v_billing"))
def _(s, sf):
    base = fresh_folder(s)
    runs = view(s, sf, "v_runs").withColumns({"token_input": F.col("token_input").cast("int"), "token_output": F.col("token_output").cast("int"), "started_at": F.col("started_at").cast("timestamp")})
    runs.write.parquet(f"{base}/generation_runs")
    view(s, sf, "v_docs").write.parquet(f"{base}/documents")
    view(s, sf, "v_billing").write.parquet(f"{base}/billing")
    t = io.read_tables(s, base, ["generation_runs", "documents", "billing"])
    out = None
    for n, d in t.items():
        c = d.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
        out = c if out is None else out.unionByName(c)
    return out


@q("s6_write_scores_csv", sql_with("""SELECT concat('Company ', run_id % 7) AS company, count(*) AS n, CAST(sum(truthfulness) AS BIGINT) AS truth, CAST(sum(clarity_impact) AS BIGINT) AS clarity FROM v_scores GROUP BY 1""", "v_scores"))
def _(s, sf):
    base = fresh_folder(s)
    d = view(s, sf, "v_scores").selectExpr(
        "concat('Company ', CAST(run_id % 7 AS STRING)) AS company", "'Role' AS role_title", "truthfulness", "role_fit", "CAST(NULL AS INT) AS seniority_positioning", "clarity_impact",
        "CAST(NULL AS INT) AS mechanism_quality", "CAST(NULL AS INT) AS constraint_compliance", "CAST(NULL AS INT) AS cover_letter_effectiveness", "overall_readiness", "1.5D AS integrated_score", "position_id AS extra")
    io.write_scores_csv(d, base)
    return io.read_scores_csv(s, base).groupBy("company").agg(F.count("*").alias("n"), F.sum("truthfulness").alias("truth"), F.sum("clarity_impact").alias("clarity"))


@q("s7_write_report_json", sql_with("""SELECT 'assess_report_v1' AS version, template_class, count(*) AS total, count(*) FILTER (status = 'pass') AS passed FROM v_results GROUP BY template_class""", "v_results"))
def _(s, sf):
    base = fresh_folder(s)
    io.write_report_json(e.run_summary(view(s, sf, "v_results"), ["template_class"]), base)
    return s.read.schema("version string, template_class string, total bigint, passed bigint").json(base)


_RUN_CUTS = ["2024-02-01", "2024-03-10"]


@q("t2_stream_dedup", sql_with("""SELECT checkout_session_id, event_id, customer_id FROM (SELECT *, row_number() OVER (PARTITION BY checkout_session_id ORDER BY ts, event_id) AS rn FROM v_sub_events WHERE type = 'checkout.session.completed') WHERE rn = 1""", "v_sub_events"))
def _(s, sf):
    base = fresh_folder(s)
    ev = view(s, sf, "v_sub_events").filter("type = 'checkout.session.completed'").withColumn("ts", F.col("ts").cast("timestamp"))
    replay(s, in_time(ev, "ts", _CUTS), base, lambda st: jobs.stream_dedup(st, base, "checkout_session_id", ["ts", "event_id"], ["event_id", "customer_id"]))
    return jobs.appended(s, f"{base}/first")


@q("t2_dedup_within", sql_with("""SELECT DISTINCT checkout_session_id FROM v_sub_events WHERE type = 'checkout.session.completed'""", "v_sub_events"))
def _(s, sf):
    base = fresh_folder(s)
    ev = view(s, sf, "v_sub_events").filter("type = 'checkout.session.completed'").withColumn("ts", F.col("ts").cast("timestamp"))
    replay(s, in_time(ev, "ts", _CUTS), base, lambda st: jobs.stream_dedup_within(st, base, "checkout_session_id", "ts", "400 days"))
    return s.read.parquet(f"{base}/within").select("checkout_session_id")


@q("t3_stream_quota", USAGE_SQL["w1_allocate_quota"])
def _(s, sf):
    base = fresh_folder(s)
    runs = view(s, sf, "v_runs").filter("status = 'succeeded'").select("run_id", "user_id", F.col("started_at").cast("timestamp").alias("started_at"))
    replay(s, in_time(runs, "started_at", _RUN_CUTS), base, lambda st: jobs.stream_quota(st, base, view(s, sf, "v_billing")))
    return s.read.parquet(f"{base}/placed").select("run_id", "user_id", "month", "nth", "bucket")


@q("t3_stream_ledger", USAGE_SQL["w2_credit_ledger"])
def _(s, sf):
    base = fresh_folder(s)
    led = view(s, sf, "v_ledger").withColumn("ts", F.col("ts").cast("timestamp"))
    replay(s, in_time(led, "ts", _CUTS), base, lambda st: jobs.stream_ledger(st, base))
    return s.read.parquet(f"{base}/ledger").select(
        "event_id", "user_id", "kind", "balance", F.when(F.col("kind") != "use", "n/a").when(F.col("accepted"), "accepted").otherwise("rejected").alias("verdict"))


@q("t4_stream_subscription", USAGE_SQL["w4_subscription_state"])
def _(s, sf):
    base = fresh_folder(s)
    ev = view(s, sf, "v_sub_events").withColumn("ts", F.col("ts").cast("timestamp"))
    replay(s, in_time(ev, "ts", _CUTS), base, lambda st: jobs.stream_subscription(st, base))
    return jobs.subscription_table(jobs.newest(s, f"{base}/state"))


@q("t5_stream_monthly_usage", USAGE_SQL["a2_monthly_usage"])
def _(s, sf):
    base = fresh_folder(s)
    runs = view(s, sf, "v_runs").filter("status = 'succeeded'").select("run_id", "user_id", F.col("started_at").cast("timestamp").alias("started_at"))
    replay(s, in_time(runs, "started_at", _RUN_CUTS), base, lambda st: jobs.stream_monthly_usage(st, base))
    return jobs.newest(s, f"{base}/usage")


@q("t6_stream_new_pages", """SELECT doc_id, cache_key FROM (SELECT doc_id, k AS cache_key, row_number() OVER (PARTITION BY k ORDER BY (doc_id % 3), doc_id) AS rn FROM (SELECT doc_id, left(sha256(concat(source, text)), 16) AS k FROM documents WHERE doc_id % 2 = 1) WHERE k NOT IN (SELECT left(sha256(concat(source, text)), 16) FROM documents WHERE doc_id % 2 = 0)) WHERE rn = 1""")
def _(s, sf):
    base = fresh_folder(s)
    d = view(s, sf, "documents").select("doc_id", e.cache_key(F.col("source"), F.col("text")).alias("cache_key"))
    new = d.filter("doc_id % 2 = 1")
    slices = (new.filter(F.col("doc_id") % 3 == i) for i in range(3))
    replay(s, slices, base, lambda st: jobs.stream_new_pages(st, base, d.filter("doc_id % 2 = 0"), order="doc_id"))
    return jobs.appended(s, f"{base}/new").select("doc_id", "cache_key")


@q("t3_keyed_quota", USAGE_SQL["w1_allocate_quota"])
def _(s, sf):
    base = fresh_folder(s)
    runs = view(s, sf, "v_runs").filter("status = 'succeeded'").select("run_id", "user_id", F.col("started_at").cast("timestamp").alias("started_at"))
    replay(s, in_time(runs, "started_at", _RUN_CUTS), base, lambda st: keyed.keyed_quota(st, base, view(s, sf, "v_billing")))
    return s.read.parquet(f"{base}/placed").select("run_id", "user_id", "month", "nth", "bucket")


@q("t3_keyed_ledger", USAGE_SQL["w2_credit_ledger"])
def _(s, sf):
    base = fresh_folder(s)
    led = view(s, sf, "v_ledger").withColumn("ts", F.col("ts").cast("timestamp"))
    replay(s, in_time(led, "ts", _CUTS), base, lambda st: keyed.keyed_ledger(st, base))
    return s.read.parquet(f"{base}/ledger").select(
        "event_id", "user_id", "kind", "balance", F.when(F.col("kind") != "use", "n/a").when(F.col("accepted"), "accepted").otherwise("rejected").alias("verdict"))


@q("t4_keyed_subscription", USAGE_SQL["w4_subscription_state"])
def _(s, sf):
    base = fresh_folder(s)
    ev = view(s, sf, "v_sub_events").withColumn("ts", F.col("ts").cast("timestamp"))
    replay(s, in_time(ev, "ts", _CUTS), base, lambda st: keyed.keyed_subscription(st, base))
    return buckets.read_table(s, f"{base}/state").where("applied > 0").drop("applied", "late")


# Orders as drafts of their customers in two versions; every fifth customer has no id, so null is a key.
@q("s8_bucket_upsert", """SELECT k AS custkey, arg_max(o_orderkey, o_orderkey) AS orderkey, arg_max(o_orderpriority, o_orderkey) AS priority
FROM (SELECT CASE WHEN o_custkey % 5 <> 0 THEN o_custkey END AS k, o_orderkey, o_orderpriority FROM orders) GROUP BY k""")
def _(s, sf):
    base = f"{fresh_folder(s)}/drafts"
    o = view(s, sf, "orders").select(F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")).alias("custkey"), F.col("o_orderkey").alias("orderkey"), F.col("o_orderpriority").alias("priority"))
    middle = o.agg(F.expr("avg(orderkey)")).first()[0] or 0
    buckets.upsert_table(s, base, o.where(F.col("orderkey") <= middle), ["custkey"], ["orderkey"], 1)
    buckets.upsert_table(s, base, o.where(F.col("orderkey") > middle), ["custkey"], ["orderkey"], 2)
    return buckets.read_table(s, base)
