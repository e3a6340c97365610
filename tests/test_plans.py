"""Plans: early rank filters, pruned columns, pushed filters."""

from __future__ import annotations

import __spark_entry__ as contract

QUERIES = contract.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rank_filter_runs_before_the_shuffle(spark, sf_dir):
    for name in ("dedup_latest", "category_top_picks", "knn_topk", "diverse_topk"):
        text = plan(QUERIES[name](spark, sf_dir))
        assert "Partial" in text[text.index("WindowGroupLimit"):]


def test_columns_and_filters_reach_the_scan(spark, sf_dir):
    text = plan(QUERIES["delete_by_keys"](spark, sf_dir))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in text and "LessThan(c_acctbal,0.0)" in text
    text = plan(QUERIES["category_counts"](spark, sf_dir))
    assert "text" not in text


def test_categories_need_no_shuffle(spark, sf_dir):
    text = plan(QUERIES["fuzzy_category"](spark, sf_dir))
    assert "Exchange" not in text and "Join" not in text
