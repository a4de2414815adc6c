"""Chains of scans over small documents: what they write, what they broadcast, and that results stay the same."""

import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture
def checkpoints(monkeypatch):
    """Counts checkpoints."""
    from pyspark.sql.classic.dataframe import DataFrame

    made, real = [], DataFrame.checkpoint

    def counted(self, *a, **b):
        made.append(self.columns)
        return real(self, *a, **b)

    monkeypatch.setattr(DataFrame, "checkpoint", counted)
    return made


def near_lines(spark):
    rows = [(d, i, f"the same long opening of a line that goes on and on number {i % 3} of {(d or 0) % 2}", i / 100) for d in (1, 2, None) for i in range(40)]
    return spark.createDataFrame(rows, "doc_id long, line_no long, line string, y double")


def test_near_lines_write_nothing_but_the_hot_keys(spark, hot, checkpoints):
    from quire.operators.pairs import near_duplicate_lines

    at = lambda: sorted(map(str, near_duplicate_lines(near_lines(spark), "doc_id", "line_no", "line", "y").collect()))
    small = at()
    assert len(checkpoints) <= 2 and len(small) == 3
    hot(5)
    assert at() == small


@pytest.mark.skipif(not os.path.isdir(SF), reason="supplied tables are not here")
def test_resume_lines_meet_their_part_once_without_a_broadcast(spark, tmp_path):
    import shutil

    from bindings import views

    sf = str(tmp_path)
    for name in ("lineitem", "part", "supplier"):
        shutil.copy(f"{SF}/{name}.parquet", f"{sf}/{name}.parquet")
    # Line items without a supplier or part, and a supplier that is there twice.
    sup = spark.read.parquet(f"{SF}/supplier.parquet")
    shutil.rmtree(f"{sf}/supplier.parquet", ignore_errors=True)
    os.remove(f"{sf}/supplier.parquet")
    sup.filter("s_suppkey > 3").unionByName(sup.filter("s_suppkey = 5")).write.parquet(f"{sf}/supplier.parquet")
    os.remove(f"{sf}/part.parquet")
    spark.read.parquet(f"{SF}/part.parquet").filter("p_partkey % 7 <> 0").write.parquet(f"{sf}/part.parquet")
    got = views.view(spark, sf, "v_resume_lines")
    want = views._plain_view(spark, sf, "v_resume_lines")
    assert got.dtypes == want.dtypes
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    plan = views._resume_lines(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("part.parquet") <= 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="supplied tables are not here")
def test_sections_and_roles_of_small_documents_write_nothing(spark, hot, checkpoints):
    from bindings import segment_queries as q
    from bindings.views import view

    view(spark, SF, "v_resume_lines")
    checkpoints.clear()
    small = q.QUERIES["w9_segment_roles"](spark, SF)
    rows = small.count()
    assert len(checkpoints) == 1 and rows > 0
    hot(20)
    some = q.QUERIES["w9_segment_roles"](spark, SF)
    assert some.exceptAll(small).isEmpty() and some.count() == rows


def test_section_diff_of_small_documents_equals_the_large_path(spark, hot, checkpoints):
    import random

    from quire.operators.pairs import section_diff

    rnd = random.Random(6)
    lines = ["Summary", "professional summary", "Skills", "Technical Skills", "Education", "", " a ", "b", "c", "d", None]

    def table():
        rows = [(d, i, rnd.choice(lines)) for d in range(20) for i in range(rnd.randint(0, 15))]
        return spark.createDataFrame([*rows, (None, 1, "Skills"), (None, 2, "b")], "doc_id long, line_no long, line string")

    a, b = table(), table()
    run = lambda: sorted(map(str, section_diff(a, b).collect()))
    small = run()
    assert len(checkpoints) == 1 and small
    hot(4)
    assert run() == small


def test_line_items_are_kept_without_columns_that_nothing_reads(spark):
    from bindings import views

    views._MEMO.clear()
    li = views.view(spark, "/root/testdata/sf0.001", "v_li")
    assert sorted(li.columns) == sorted(views.LI) and "l_comment" not in li.columns
