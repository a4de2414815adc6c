"""Registered queries against DuckDB with nearly every key treated as hot."""

import os
import sys

import pytest

SF = "/root/testdata/sf0.001"
NAMES = (
    "w1_allocate_quota", "w2_credit_ledger", "a7_grade_aggregate", "k4_examples_per_group", "w8_segment_sections", "w9_segment_roles",
    "w10_merge_title_lines", "w11_section_spans", "w12_sparse_pages", "w14_column_jump", "j14_align_sections", "j19_near_duplicate_lines",
    "a21_token_f1", "f30_downgrade_invalid", "f35_section_diff", "s1_read_url_list", "s2_read_logs", "a10_log_counters",
    "w16_reading_order", "w17_cap_bullets", "a36_region_scores", "f31_autocorrect_blocks",
)


def test_every_query_has_a_known_operator_and_sql_names_exist():
    from bindings import registry

    queries, sql = registry.queries(), registry.oracle_sql()
    assert set(sql) <= set(queries) and len(set(queries) - set(sql)) == 6


@pytest.mark.skipif(not os.path.isdir(SF), reason="supplied tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_hot_path_equals_sql(spark, hot, name):
    import duckdb

    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
    from bindings import registry
    from bindings.views import BASE
    from check_oracle import norm

    hot(2)
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(str(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    res = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    want = sorted(str(tuple(norm(r[names.index(c)]) for c in cols)) for r in res.fetchall())
    assert sorted(names) == cols and got == want
