"""Views that give the supplied tables the shapes the operators expect.

Each view is one SQL text valid in Spark and DuckDB.  ``spark_view`` builds it
in Spark; ``sql_with`` writes it as a CTE for the comparison SQL.  ``v_li`` and
``v_pairs`` need an order inside a key, so on Spark they are built with
``ordered_scan`` instead of the plain window of their SQL text, and ``v_docs`` and
``v_resume_lines`` repeat rows with ``explode``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.plans import cut, hot_keys, lead1, ordered_scan, rank_in

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {
    "v_li": """
SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS ln FROM lineitem""",
    "v_runs": """
SELECT event_id AS run_id, user_id,
  CASE event_id % 3 WHEN 1 THEN ts + INTERVAL '40' DAY WHEN 2 THEN ts + INTERVAL '80' DAY ELSE ts END AS started_at,
  CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'view' AND event_id % 10 = 0 THEN 'running' ELSE 'succeeded' END AS status,
  CASE event_id % 4 WHEN 0 THEN 'gpt-4o-2024-08-06' WHEN 1 THEN 'gpt-4o-mini' WHEN 2 THEN 'gpt-4-turbo' ELSE 'other' END AS model_name,
  500 + (event_id * 37) % 4000 AS token_input, 100 + (event_id * 53) % 1500 AS token_output,
  event_id % 97 = 0 AS delete_flg
FROM events""",
    "v_docs": """
SELECT event_id * 10 + n AS doc_id, event_id AS run_id, user_id, concat('Company ', CAST(user_id % 40 AS STRING)) AS company_name
FROM events CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2 AS n) t
WHERE event_type <> 'error' AND event_id % 11 <> 0 AND (n = 1 OR event_id % 5 = 0)""",
    "v_billing": """
SELECT user_id, CASE user_id % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'starter' ELSE 'pro' END AS plan_type,
  CASE WHEN user_id % 20 = 0 THEN 0 WHEN user_id % 10 = 0 THEN 5 END AS monthly_limit_override
FROM (SELECT DISTINCT user_id FROM events) u WHERE user_id % 7 <> 0""",
    "v_ledger": """
SELECT event_id, user_id, ts, CASE WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 10 WHEN event_type = 'signup' AND event_id % 5 = 0 THEN -4 ELSE -1 END AS delta,
  CASE WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'grant' WHEN event_type = 'signup' AND event_id % 5 = 0 THEN 'adjust' ELSE 'use' END AS kind
FROM events WHERE event_type <> 'error'""",
    "v_sub_events": """
SELECT event_id, user_id AS customer_id, ts,
  CASE event_type WHEN 'signup' THEN 'checkout.session.completed' WHEN 'view' THEN 'customer.subscription.updated' WHEN 'click' THEN 'invoice.paid' WHEN 'error' THEN 'invoice.payment_failed' ELSE 'customer.subscription.deleted' END AS type,
  CASE event_id % 4 WHEN 0 THEN 'price_starter' WHEN 1 THEN 'price_pro' WHEN 2 THEN 'price_unknown' END AS price_id,
  CASE WHEN event_type = 'purchase' THEN 'canceled' WHEN event_id % 9 = 0 THEN 'unpaid' ELSE 'active' END AS status,
  concat('cs_', CAST(user_id AS STRING), '_', CAST(event_id % 4 AS STRING)) AS checkout_session_id
FROM events""",
    "v_pairs": """
SELECT conv_id * 1000 + turn AS pair_id, text AS src_text, nxt AS out_text FROM (
  SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt,
         lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt_role FROM conversations) c
WHERE role = 'user' AND nxt_role = 'assistant'""",
    "v_scores": """
SELECT l_suppkey AS run_id, l_orderkey * 100 + ln AS position_id,
  CAST(l_quantity AS INT) % 10 + 1 AS truthfulness, CAST(l_partkey % 10 AS INT) + 1 AS role_fit,
  CASE WHEN l_orderkey % 6 = 0 THEN NULL ELSE CAST(l_orderkey % 10 AS INT) + 1 END AS clarity_impact,
  CASE WHEN l_partkey % 8 = 0 THEN NULL ELSE CAST(l_tax * 100 AS INT) + 1 END AS overall_readiness
FROM v_li""",
    "v_results": """
SELECT o_orderkey AS case_id, o_orderpriority AS template_class, concat('S', CAST(o_custkey % 5 AS STRING)) AS severity,
  CAST(o_orderkey * 7919 % 1000 AS DOUBLE) / 1000 AS score, o_orderkey % 50 = 0 AS is_error,
  CASE WHEN o_orderkey % 50 = 0 THEN 'error' WHEN (o_orderkey * 7919 % 1000) >= 700 THEN 'pass' ELSE 'fail' END AS status,
  CASE WHEN (o_orderkey * 104729 % 1000) >= 650 THEN 'pass' ELSE 'fail' END AS base_status,
  CAST(o_orderkey * 104729 % 1000 AS DOUBLE) / 1000 AS base_score, o_orderkey % 13 <> 0 AS in_baseline
FROM orders""",
    "v_blocks": """
SELECT l_orderkey AS doc_id, ln % 2 + 1 AS page, ln AS block_id,
  CAST(612 AS DOUBLE) AS page_w, CAST(792 AS DOUBLE) AS page_h,
  CASE WHEN l_partkey % 3 = 0 THEN CAST(30 AS DOUBLE) WHEN l_partkey % 3 = 1 THEN CAST(230 AS DOUBLE) ELSE CAST(440 AS DOUBLE) END AS x0,
  CASE WHEN l_partkey % 3 = 0 THEN CAST(190 AS DOUBLE) WHEN l_partkey % 3 = 1 THEN CAST(580 AS DOUBLE) ELSE CAST(590 AS DOUBLE) END AS x1,
  20 + l_quantity * 14 AS y0, 20 + l_quantity * 14 + 15 + (l_suppkey % 9) * 12 AS y1,
  CASE WHEN l_suppkey % 4 = 0 THEN 'heading' ELSE 'paragraph' END AS block_type,
  CAST(l_suppkey % 25 AS INT) AS n_lines, (l_partkey * 13) % 400 AS n_chars, CAST(l_suppkey % 12 AS DOUBLE) AS spacing_before
FROM v_li""",
    "v_resume_lines": """
SELECT l_orderkey AS doc_id, CAST(1 AS BIGINT) AS line_no, 'SUMMARY' AS line FROM v_li WHERE ln = 1
UNION ALL SELECT l_orderkey, 2, concat('Engineer working with ', p_name, ' since ', CAST(2000 + p_size % 25 AS STRING), '.') FROM v_li JOIN part ON p_partkey = l_partkey WHERE ln = 1
UNION ALL SELECT l_orderkey, 10, 'Experience' FROM v_li WHERE ln = 1
UNION ALL SELECT l_orderkey, 10 + ln * 10, concat(p_type, ' | ', s_name) FROM v_li JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
UNION ALL SELECT l_orderkey, 11 + ln * 10, concat('Jan ', CAST(2000 + p_size % 20 AS STRING), ' - Present') FROM v_li JOIN part ON p_partkey = l_partkey
UNION ALL SELECT l_orderkey, 12 + ln * 10, concat('- Built ', p_name, ', reduced cost by ', CAST(CAST(l_quantity AS INT) AS STRING), '%') FROM v_li JOIN part ON p_partkey = l_partkey
UNION ALL SELECT l_orderkey, 13 + ln * 10, concat('- Led ', p_brand, ' team') FROM v_li JOIN part ON p_partkey = l_partkey WHERE l_partkey % 2 = 0
UNION ALL SELECT l_orderkey, 500, 'Technical Skills' FROM v_li WHERE ln = 1
UNION ALL SELECT l_orderkey, 500 + ln, concat('Python, Kafka, ', p_brand, ', ', p_type) FROM v_li JOIN part ON p_partkey = l_partkey""",
    "v_paras": """
SELECT l_orderkey AS doc_id, CASE WHEN l_partkey % 29 = 0 THEN '' WHEN l_partkey % 31 = 0 THEN 'para_1' ELSE concat('para_', CAST(ln AS STRING)) END AS para_id,
  ln AS ord, CASE l_suppkey % 5 WHEN 0 THEN 'bullet' WHEN 1 THEN 'paragraph' WHEN 2 THEN 'role_header' WHEN 3 THEN 'role_meta' ELSE 'paragraph' END AS parser_semantic,
  concat(CASE WHEN l_orderkey % 3 = 0 AND l_partkey % 2 = 0 THEN 'f ' WHEN l_partkey % 5 = 0 THEN '- ' ELSE '' END, 'Text ', p_name) AS text,
  length(p_name) + CAST(l_quantity AS INT) * 12 AS new_len, length(p_name) AS old_len
FROM v_li JOIN part ON p_partkey = l_partkey""",
    "v_urls": """
SELECT page_id, CASE page_id % 9
  WHEN 0 THEN concat('https://www.linkedin.com/jobs/view/role-at-acme-', CAST(4000000000 + page_id AS STRING))
  WHEN 1 THEN concat('https://ca.indeed.com/viewjob?from=x&jk=', CAST(page_id AS STRING), '&tk=1')
  WHEN 2 THEN concat('https://boards.greenhouse.io/acme/jobs/', CAST(page_id AS STRING))
  WHEN 3 THEN concat('https://jobs.lever.co/acme/', CAST(page_id AS STRING))
  WHEN 4 THEN concat('https://apply.workable.com/my-co/j/A', CAST(page_id AS STRING))
  WHEN 5 THEN concat('https://careers.example.com/x?gh_jid=', CAST(page_id AS STRING))
  WHEN 6 THEN 'https://www.hiring.cafe/viewjob/abc'
  ELSE url END AS url FROM pages""",
    "v_names": """
SELECT c_custkey AS id, c_name AS raw, concat(c_mktsegment, ' Card ', CAST(c_nationkey AS STRING)) AS name FROM customer""",
    "v_blocks_cls": """
SELECT l_orderkey AS section_id, ln AS block_ord, concat('para_', CAST(ln % 4 AS STRING)) AS para_id,
  CASE l_orderkey % 4 WHEN 0 THEN 'summary' WHEN 1 THEN 'skills' WHEN 2 THEN 'education' ELSE 'other' END AS section_type,
  CASE WHEN l_orderkey % 7 = 0 THEN 'preserve' WHEN l_orderkey % 4 IN (0,1) THEN 'rewrite_body' ELSE 'preserve' END AS rewrite_policy,
  CASE WHEN l_partkey % 11 = 0 THEN 'role_header' WHEN l_orderkey % 4 = 0 THEN 'summary_paragraph' WHEN l_orderkey % 4 = 1 THEN 'skills_paragraph' WHEN l_orderkey % 4 = 2 THEN 'education_entry' ELSE 'other_paragraph' END AS block_type
FROM v_li""",
    "v_pages_ld": """
SELECT page_id, concat('<html><head><script type="application/ld+json">{"@type":"JobPosting","title":"Role ', CAST(page_id AS STRING),
  '","hiringOrganization":{"name":"Org ', CAST(page_id % 17 AS STRING), '"},"description":"<p>Text ', CAST(page_id * 3 AS STRING), '</p>"}</script>',
  '<meta property="og:site_name" content="Site ', CAST(page_id % 5 AS STRING), '"></head>', html, '</html>') AS html
FROM pages WHERE page_id % 3 <> 0""",
}

_FROM = re.compile(r"\b(FROM|JOIN)\s+(\w+)")


def deps(name: str) -> list[str]:
    """Tables and views read by a view, in order of first use."""
    seen: list[str] = []
    for _, t in _FROM.findall(VIEWS[name]):
        if (t in VIEWS or t in BASE) and t not in seen:
            seen.append(t)
    return seen


def sql_with(body: str, *names: str, extra: str = "") -> str:
    """DuckDB SQL: the named views (and what they need) as CTEs, then ``body``."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in deps(n):
            if d in VIEWS:
                add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = [f"{n} AS ({VIEWS[n]})" for n in order]
    if extra.strip():
        ctes.append(extra.strip())
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body


_MEMO: dict[tuple, object] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: What the views and queries read of v_li; the columns beyond its order are neither moved nor written.
LI = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_tax", "ln"]


def _li(spark: SparkSession, sf: str) -> DataFrame:
    """v_li without the columns that nothing reads, built once per session and table folder and kept as a checkpoint."""
    key = (spark.sparkContext.applicationId, sf, "v_li")
    if key not in _MEMO:
        li = table(spark, sf, "lineitem")
        order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
        _MEMO[(*key, "hot")] = hot = hot_keys(li, ["l_orderkey"])
        _MEMO[key] = cut(
            ordered_scan(
                li, ["l_orderkey"], order,
                ["l_linenumber", F.expr("l_partkey div 4096")], [rank_in("ln")], hot,
            ).select(*LI)
        )
    return _MEMO[key]


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations")
    nxt = ordered_scan(
        turns, ["conv_id"], ["turn"], [F.expr("turn div 1024")],
        [lead1("nxt", F.struct("role", "text"))],
    )
    return nxt.filter((F.col("role") == "user") & (F.col("nxt.role") == "assistant")).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"),
        F.col("text").alias("src_text"), F.col("nxt.text").alias("out_text"),
    )


#: Line items that one task of the document lines reads; with their lines they are sorted in memory.
TASK_ITEMS = 100_000


def _items(spark: SparkSession, sf: str) -> DataFrame:
    """The line items with what their lines tell of supplier and part, which each of them meets once, kept as a checkpoint.

    Supplier and part grow with the line items, so neither is gathered for a broadcast.  Equal parts are numbered: a line
    item comes once for each of them, and once with a null number where it has none.
    """
    key = (spark.sparkContext.applicationId, sf, "items")
    if key not in _MEMO:
        li = view(spark, sf, "v_li").select("l_orderkey", "ln", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("qty"))
        number = F.row_number().over(Window.partitionBy("p_partkey").orderBy(F.lit(0)))
        part = table(spark, sf, "part").filter("p_partkey IS NOT NULL").select("p_partkey", "p_name", "p_type", "p_brand", "p_size", number.alias("nth"))
        names = table(spark, sf, "supplier").groupBy("s_suppkey").agg(F.collect_list(F.struct("s_name")).alias("names"))
        d = li.join(names.hint("merge"), F.col("s_suppkey") == F.col("l_suppkey"), "left").join(part.hint("merge"), F.col("p_partkey") == F.col("l_partkey"), "left")
        items = cut(d.select("l_orderkey", "ln", "qty", (F.col("l_partkey") % 2 == 0).alias("even"), F.col("names.s_name").alias("names"), "nth", "p_name", "p_type", "p_brand", "p_size"))
        _MEMO[key] = items, items.count()
    items, n = _MEMO[key]
    if _MEMO[(*key[:2], "v_li", "hot")] is not None:
        return items
    # Their lines lie by the document, so what is asked of a document moves nothing but these rows.
    return items.repartition(max(spark.sparkContext.defaultParallelism, -(-n // TASK_ITEMS)), "l_orderkey")


def _resume_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The union of the SQL text from one pass over the line items: each gives the kinds of its lines, and these the lines."""
    c, ten, summary, title = F.col, F.col("ln") * 10, 2, 9
    number = lambda x: x.cast("string")
    # Kinds from ``title`` on are titles, one for each name of the supplier.
    kinds = {
        1: (F.lit(1), F.lit("SUMMARY")),
        summary: (F.lit(2), F.concat(F.lit("Engineer working with "), "p_name", F.lit(" since "), number(2000 + c("p_size") % 25), F.lit("."))),
        3: (F.lit(10), F.lit("Experience")),
        4: (ten + 11, F.concat(F.lit("Jan "), number(2000 + c("p_size") % 20), F.lit(" - Present"))),
        5: (ten + 12, F.concat(F.lit("- Built "), "p_name", F.lit(", reduced cost by "), number(c("qty")), F.lit("%"))),
        6: (ten + 13, F.concat(F.lit("- Led "), "p_brand", F.lit(" team"))),
        7: (F.lit(500), F.lit("Technical Skills")),
        8: (c("ln") + 500, F.concat(F.lit("Python, Kafka, "), "p_brand", F.lit(", "), "p_type")),
    }
    some = lambda when, *of: F.when(when, F.array(*map(F.lit, of))).otherwise(F.array().cast("array<int>"))
    titles = F.when(F.size("names") > 0, F.sequence(F.lit(title), F.size("names") + title - 1)).otherwise(F.array().cast("array<int>"))
    body = F.concat(F.array(F.lit(4), F.lit(5), F.lit(8)), some(c("ln") == 1, summary), titles, some(c("even"), 6))
    of_item = F.concat(some((c("ln") == 1) & (F.coalesce("nth", F.lit(1)) == 1), 1, 3, 7), F.when(c("nth").isNotNull(), body).otherwise(F.array().cast("array<int>")))
    at, line = ten + 10, F.concat("p_type", F.lit(" | "), F.get("names", c("kind") - title))
    for k, (no, text) in kinds.items():
        at, line = F.when(c("kind") == k, no).otherwise(at), F.when(c("kind") == k, text).otherwise(line)
    return _items(spark, sf).withColumn("kind", F.explode(of_item)).select(c("l_orderkey").alias("doc_id"), at.cast("long").alias("line_no"), line.alias("line"))


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The named base table or view as a DataFrame.

    The line items behind ``v_resume_lines`` are written once per session, as
    most of its readers scan it several times.
    """
    if name in BASE:
        return table(spark, sf, name)
    if name == "v_li":
        return _li(spark, sf)
    if name == "v_pairs":
        return _pairs(spark, sf)
    if name == "v_docs":
        e = table(spark, sf, "events").filter("event_type <> 'error' AND event_id % 11 <> 0")
        e = e.withColumn("n", F.explode(F.when(F.col("event_id") % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
        company = F.concat(F.lit("Company "), (F.col("user_id") % 40).cast("string"))
        return e.select((F.col("event_id") * 10 + F.col("n")).alias("doc_id"), F.col("event_id").alias("run_id"), "user_id", company.alias("company_name"))
    if name == "v_resume_lines":
        return _resume_lines(spark, sf)
    return _plain_view(spark, sf, name)


def _plain_view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    for d in deps(name):
        view(spark, sf, d).createOrReplaceTempView(f"quire_{d}")
    known = set(deps(name))
    text = _FROM.sub(
        lambda m: f"{m[1]} quire_{m[2]}" if m[2] in known else m[0], VIEWS[name]
    )
    return spark.sql(text)
