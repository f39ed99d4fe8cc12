"""Physical plans: what must not be in them, and what must."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as contract
from marketpulse.operators import normalize
from workload.registry import QUERIES

SF = "/root/testdata/sf0.001"
BATCH = sorted(n for n in QUERIES if not n.startswith("stream_"))
FORBIDDEN = (
    "CartesianProduct",
    "BroadcastNestedLoopJoin",
    "SortAggregate",
    "ObjectHashAggregate",
    "BatchEvalPython",
    "ArrowEvalPython",
    "MapInPandas",
)


def _plan(spark, name):
    return contract.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_quadratic_or_row_at_a_time_operator(spark, name):
    plan = _plan(spark, name)
    assert not [op for op in FORBIDDEN if op in plan]


def test_event_rows_are_shuffled_once_by_ticker_and_range(spark):
    plan = _plan(spark, "spike_scores")
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    # The event rows and the folded ranges go by ticker and range, balances by ticker alone.
    assert sum("_part" in line for line in shuffles) == 2
    assert len(shuffles) == 3 and "Join" not in plan


@pytest.mark.parametrize("name", ["dedup_events", "latest_metadata", "latest_window", "top_gainers"])
def test_best_row_per_key_is_picked_before_the_shuffle(spark, name):
    plan = _plan(spark, name)
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("name", ["recent_alerts", "top_gainers", "card_page", "incremental_since"])
def test_top_k_needs_no_full_sort(spark, name):
    assert "TakeOrderedAndProject" in _plan(spark, name)


def test_scan_reads_only_needed_columns_and_pushes_the_filter(spark):
    plan = _plan(spark, "daily_aggregates")
    assert re.search(r"PushedFilters: \[[^]]*Not\(EqualTo\(event_type,view", re.sub(r"\s+", " ", plan))
    assert "props" not in plan and "lineitem" not in plan


def test_overlapping_windows_do_not_multiply_shuffled_rows(spark):
    """Rows are spread over the 24 windows above the last shuffle of that branch."""
    plan = _plan(spark, "ma_24h_aggregates")
    assert plan.index("explode(sequence") < plan.index("Exchange")
    assert plan.count("Exchange") == 2


def test_all_windows_fold_the_sales_once(spark):
    df = contract.queries()["all_windows"](spark, SF)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("ReusedExchange") == 2
    assert final.count("FileScan") == 1


def test_hot_product_is_split_when_the_map_is_too_large_to_broadcast(spark):
    """One product holds a third of the rows; the lookup join must not leave it to one task."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        raw = spark.range(0, 90_000, 1, 8).selectExpr(
            "id AS event_id",
            "IF(id % 3 = 0, 7, id % 1000) AS product_id",
            "'Normal' AS sub_type_name",
            "'NM' AS condition",
            "CAST(id AS STRING) AS price_raw",
            "1 AS quantity",
            "timestamp_seconds(id) AS sold_at",
        )
        products = spark.range(1000).selectExpr("id AS product_id", "concat('c', id) AS card_id")
        resolved = normalize.resolve(raw, products, "sim")
        assert len(resolved.collect()) == 90_000
        plan = resolved._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
