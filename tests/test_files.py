"""Readers, writers, profiles and streams on small folders."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quire.operators import evals, profiles, quality, texts, usage, web
from quire.sources import io
from quire.streaming import jobs


def test_url_list_keeps_order_and_repeats(spark, tmp_path):
    (tmp_path / "u.txt").write_text("# head\n\n http://a \nhttp://b\nhttp://a\n")
    got = [(r.url, r.line_no) for r in io.read_url_list(spark, str(tmp_path)).orderBy("line_no").collect()]
    assert got == [("http://a", 3), ("http://b", 4), ("http://a", 5)]


def test_a_file_of_many_lines_is_numbered_in_order(spark, tmp_path):
    (tmp_path / "long.txt").write_text("".join(f"u{k}\n" if k % 5 else "#\n" for k in range(1, 200_001)))
    (tmp_path / "short.txt").write_text("a\nb\n")
    got = io.read_url_list(spark, str(tmp_path))
    assert got.where("url = concat('u', line_no)").count() == 160_000 and got.count() == 160_002


def test_a_long_log_keeps_its_records_together(spark, tmp_path):
    lines = "".join("2024-01-02T10:00:00 [INFO] a: m%d\n" % k if k % 3 == 0 else " more\n" for k in range(150_000))
    (tmp_path / "app.log.2024-01-02").write_text(lines)
    got = io.read_logs(spark, str(tmp_path), "2024-01-01", "2024-01-05")
    assert got.count() == 50_000 and got.where("n_lines <> 3 or message <> concat('m', 3 * (record - 1))").count() == 0
    counts = usage.log_counters(got).collect()
    assert sum(r.records for r in counts) == 50_000


def test_logs_glue_continuations_and_check_the_range(spark, tmp_path):
    (tmp_path / "app.log.2024-01-02").write_text("stray\n2024-01-02T10:00:00 [ERROR] a.b: boom: x\n  at 1\n2024-01-02T10:00:01 [INFO] a: fine\n")
    (tmp_path / "app.log.2024-01-09").write_text("2024-01-09T10:00:00 [INFO] a: late\n")
    (tmp_path / "app.log").write_text("2024-01-10T10:00:00 [INFO] a: today\n")
    got = sorted((r.message, r.n_lines) for r in io.read_logs(spark, str(tmp_path), "2024-01-01", "2024-01-05", today="2024-01-10").collect())
    assert got == [("boom: x", 2), ("fine", 1)]
    assert io.read_logs(spark, str(tmp_path), "2024-01-10", "2024-01-10", today="2024-01-10").first().message == "today"
    with pytest.raises(ValueError):
        io.read_logs(spark, str(tmp_path), "2024-01-05", "2024-01-01")


def test_empty_scores_write_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "company string")
    assert io.write_scores_csv(df, str(tmp_path / "x")) is False and not (tmp_path / "x").exists()


def test_upsert_folder_repeats_safely(spark, tmp_path):
    base = str(tmp_path / "t")
    a = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, v int, s string")
    b = spark.createDataFrame([(2, 2, "new"), (2, 1, "old"), (3, 1, "c")], "k int, v int, s string")
    io.upsert_folder(spark, base, a, ["k"], ["v"], 0)
    for _ in range(2):
        io.upsert_folder(spark, base, b, ["k"], ["v"], 1)
    assert sorted((r.k, r.s) for r in io.latest_version(spark, base, 9).collect()) == [(1, "a"), (2, "new"), (3, "c")]


def test_profile_values(spark):
    cases = {'"foo",': "foo", '\\"foo\\"': "foo", '"He said "hi""': 'He said "hi"', '"foo': "foo", 'foo"': "foo", 'OAuth2 "style': 'OAuth2 "style', "  ": "", "a,": "a"}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r.v: r.s for r in df.withColumn("s", profiles.sanitize(F.col("v"))).collect()} == cases


def test_profile_lists_settle(spark):
    df = spark.createDataFrame([(1, ["event_driven_kafka", "aws_lambda rest_api", "Kafka", "kafka", '"x",', ""])], "id int, skills array<string>")
    once = profiles.normalize_profiles(df, ["skills"])
    assert once.first().skills == ["Event driven Kafka", "AWS lambda", "REST API", "Kafka", "x"]
    twice = profiles.normalize_profiles(once.drop("changed"), ["skills"])
    assert twice.first().skills == once.first().skills and not twice.first().changed


def test_posting_forms(spark):
    page = lambda body: f'<script type="application/ld+json">{body}</script>'
    rows = [
        (1, page('{"@graph":[{"@type":"Org"},{"@type":"JobPosting","title":"T1"}]}')), (2, page('[{"@type":"JobPosting","title":"T2"}]')),
        (3, page("{bad") + page('{"@type":"JobPosting","title":"T3","hiringOrganization":{"name":"N"}}')), (4, "<p>none</p>")]
    got = {r.id: (r.job_title, r.company) for r in web.jsonld_postings(spark.createDataFrame(rows, "id int, html string")).collect()}
    assert got == {1: ("T1", "Unknown"), 2: ("T2", "Unknown"), 3: ("T3", "N"), 4: ("Unknown", "Unknown")}


def test_scores_must_be_integers(spark):
    rows = [(1, '{"scores":{"a":{"score":5}}}'), (2, '{"scores":{"a":{"score":5.5}}}'), (3, '{"scores":{"a":{"score":"5"}}}'), (4, '{"scores":{"a":7}}'), (5, '{"scores":{}}'), (6, "[]"), (7, '{"scores":{"a":{"score":11}}}')]
    got = {r.id: r.errors for r in quality.validate_scores(spark.createDataFrame(rows, "id int, raw string"), "id", "raw", ["a"]).collect()}
    bad = "scores.a.score must be int 1-10"
    assert got == {1: "", 2: bad, 3: bad, 4: "scores.a is not a dict", 5: "missing score key: a", 6: "response is not a dict", 7: bad}


def test_weights_may_be_scaled(spark):
    df = spark.createDataFrame([(1, 7, None), (2, None, None), (3, 3, 10)], "id int, a int, b int")
    one = {r.id: r.integrated_score for r in evals.score_rows(df, {"a": 0.2, "b": 0.3}).collect()}
    two = {r.id: r.integrated_score for r in evals.score_rows(df, {"a": 0.4, "b": 0.6}).collect()}
    assert one == two == {1: 7.0, 2: 0.0, 3: 7.2}


def test_glued_heading_and_dates(spark):
    lines = [(1, 1, "EDUCATIONReally Great University"), (1, 2, "SUMMARYMaster Degree"), (1, 3, "Current Date: now")]
    got = [(r.line_no, r.part, r.line) for r in texts.split_glued_headings(spark.createDataFrame(lines, "doc_id int, line_no int, line string")).orderBy("line_no", "part").collect()]
    assert got == [(1, 1, "EDUCATION"), (1, 2, "Really Great University"), (2, 1, "SUMMARYMaster Degree")]


def test_stream_resumes_without_repeats(spark, tmp_path):
    base, t0 = str(tmp_path / "job"), dt.datetime(2024, 1, 1)
    rows = lambda ids: spark.createDataFrame([(f"s{i % 3}", i, t0 + dt.timedelta(minutes=i)) for i in ids], "sid string, event_id int, ts timestamp")
    src = str(tmp_path / "in")
    for ids in (range(0, 4), range(4, 8)):
        rows(ids).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(rows([0]).schema).parquet(src)
        jobs.stream_dedup(stream, base, "sid", ["ts", "event_id"], ["event_id"])
    assert sorted((r.sid, r.event_id) for r in jobs.appended(spark, f"{base}/first").collect()) == [("s0", 0), ("s1", 1), ("s2", 2)]


def test_quota_stream_marks_late_rows(spark, tmp_path):
    base, src = str(tmp_path / "job"), str(tmp_path / "in")
    billing = spark.createDataFrame([(1, "free", None)], "user_id bigint, plan_type string, monthly_limit_override int")
    schema = "run_id bigint, user_id bigint, started_at timestamp"
    for day, ids in ((10, (1, 2)), (5, (3, 4))):
        df = spark.createDataFrame([(i, 1, dt.datetime(2024, 1, day, i)) for i in ids], schema)
        df.coalesce(1).write.mode("append").parquet(src)
        jobs.stream_quota(spark.readStream.schema(df.schema).parquet(src), base, billing)
    got = {r.run_id: (r.bucket, r.late) for r in spark.read.parquet(f"{base}/placed").collect()}
    assert got == {1: ("monthly", False), 2: ("monthly", False), 3: ("monthly", True), 4: ("overflow", True)}


def test_monthly_usage_counts(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 31, 23, 59)), (1, dt.datetime(2024, 2, 1))], "user_id int, started_at timestamp")
    assert sorted((r.month, r.used) for r in usage.monthly_usage(df).collect()) == [(1, 1), (2, 1)]


def test_raw_scores_keep_their_errors_without_schemas_of_whole_objects(spark):
    entry = {
        '{"score":3}': "", '{"score":11}': "a.score must be int 1-10", '{"score":"3"}': "a.score must be int 1-10", '{"score":3.5}': "a.score must be int 1-10",
        '{"score":null}': "a.score must be int 1-10", "{}": "a.score must be int 1-10", "null": "a is not a dict", "7": "a is not a dict", '[{"score":3}]': "a is not a dict",
    }
    raw = {f'{{"scores":{{"a":{k},"b":{{"score":1}}}}}}': v and f"scores.{v}" for k, v in entry.items()}
    raw |= {'{"scores":{"b":{"score":1}}}': "missing score key: a", '{"scores":null}': "scores is not a dict", "[1]": "response is not a dict", "x": "response is not a dict"}
    rows = spark.createDataFrame(list(enumerate(raw)), "id int, raw string")
    checked = quality.validate_scores(rows, "id", "raw", ["a", "b"])
    assert [r.errors for r in checked.orderBy("id").collect()] == list(raw.values())
    # Values are taken once as they are and read as numbers only in that form, not from the text's object again.
    assert "variant_get(__s" in (plan := checked._jdf.queryExecution().analyzed().toString()) and "$.a.score, BigintType" not in plan and "$.a.score, LongType" not in plan
