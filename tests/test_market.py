from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal

import pytest
from conftest import CARD, KEY, T0
from pyspark.sql import functions as F

from marketpulse.operators import alerts, merge, serving, stats, windows
from marketpulse.schemas import ALERT, PRICE_WINDOW, SALE


def test_accumulator(sales):
    (row,) = stats.market_stats(sales((10, 0, 1), (20, 1, 2), (30, 2, 3))).collect()
    assert (row.sample_count, row.price_sum, row.volume) == (3, Decimal(60), 6)
    assert (row.min_price, row.max_price, row.last_price) == (10, 30, 30)
    assert row.last_trade_at == T0 + dt.timedelta(minutes=2)
    (row,) = stats.price_volatility(stats.market_stats(sales((10, 0), (20, 1), (30, 2)))).collect()
    assert row.avg_price == 20
    assert row.volatility**2 == pytest.approx(200 / 3)


def test_single_sample_has_no_volatility(sales):
    (row,) = stats.market_snapshot(sales((7, 0))).collect()
    assert (row.volatility, row.sample_count, row.finish, row.condition) == (0.0, 1, "HOLOFOIL", "NM")


def test_negative_quantity_adds_no_volume(sales):
    assert stats.market_stats(sales((1, 0, -5), (1, 1, 2))).first().volume == 2


def test_mean_rounds_half_up(sales):
    (row,) = stats.market_snapshot(sales(("10.01", 0), ("10.02", 1))).collect()
    assert row.avg_price == Decimal("10.02")


def test_no_sales_no_rows(spark):
    empty = spark.createDataFrame([], SALE).withColumn("market_key", F.lit(None).cast("string"))
    assert stats.market_snapshot(empty).count() == 0


def test_hourly_window_settles_when_a_later_sale_arrives(sales):
    rows = sales((10, 0), (20, 10), (30, 20), (15, 65))
    hourly = windows.windowed_aggregates(rows, ("HOURLY",))
    (row,) = windows.settled(hourly, rows).collect()
    assert (row.window_start, row.window_end) == (T0, T0 + dt.timedelta(hours=1))
    assert (row.avg_price, row.sample_count, row.volume) == (Decimal("20.00"), 3, 3)


def test_each_sale_is_in_24_hopping_windows(sales):
    rows = windows.windowed_aggregates(sales((10, 30)), ("MA_24H",)).collect()
    starts = sorted(r.window_start for r in rows)
    assert len(rows) == 24
    assert (starts[0], starts[-1]) == (T0 - dt.timedelta(hours=23), T0)


def test_unknown_window_type(sales):
    with pytest.raises(ValueError):
        windows.windowed_aggregates(sales((1, 0)), ("WEEKLY",))


@pytest.fixture
def random_sales(spark):
    rng = random.Random(3)
    rows = [
        (
            f"e{i:04d}", "sim", "hot" if i % 3 else f"c{rng.randrange(4)}", "NORMAL", "NM",
            Decimal(rng.randrange(1, 10_000)) / 100, rng.randrange(1, 5),
            T0 + dt.timedelta(minutes=rng.randrange(60 * 80)),
        )
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, SALE)
    return rows, df.withColumn("market_key", F.concat("card_id", F.lit("|NORMAL|NM")))


def test_windows_match_brute_force(random_sales):
    rows, df = random_sales
    want = defaultdict(list)
    for row in rows:
        hour = row[7].replace(minute=0)
        day = hour.replace(hour=0)
        want[row[2], "HOURLY", hour].append(row)
        want[row[2], "DAILY", day].append(row)
        for back in range(24):
            want[row[2], "MA_24H", hour - dt.timedelta(hours=back)].append(row)
    got = windows.windowed_aggregates(df).collect()
    assert len(got) == len(want)
    for r in got:
        members = want[r.card_id, r.window_type, r.window_start]
        total = sum(m[5] for m in members)
        mean = total / len(members)
        assert r.sample_count == len(members)
        assert r.volume == sum(m[6] for m in members)
        assert r.avg_price == mean.quantize(Decimal("0.01"), ROUND_HALF_UP)
        spread = sum((m[5] - mean) ** 2 for m in members) / len(members)
        assert r.volatility == pytest.approx(float(spread) ** 0.5, abs=1e-9)


@pytest.mark.parametrize("kind", ["HOURLY", "DAILY"])
def test_one_kind_equals_its_part_of_all(random_sales, kind):
    _, df = random_sales
    alone = windows.windowed_aggregates(df, (kind,))
    part = windows.windowed_aggregates(df).filter(F.col("window_type") == kind)
    assert alone.exceptAll(part).count() == 0 and part.exceptAll(alone).count() == 0


def _window(key, start, avg, kind="DAILY", n=5):
    at = T0.replace(hour=0) + dt.timedelta(days=start)
    card = key.split("|")[0]
    return (key, card, kind, at, at + dt.timedelta(days=1), Decimal(avg), 0.0, n, n)


@pytest.fixture
def price_table(spark):
    def build(*rows):
        return spark.createDataFrame([_window(*r) for r in rows], PRICE_WINDOW)

    return build


def test_upsert_replaces_by_key(price_table):
    keys = ["market_key", "window_type", "window_start"]
    base, delta = price_table((KEY, 0, "10.00")), price_table((KEY, 0, "11.00"), (KEY, 1, "12.00"))
    once = merge.upsert(base, delta, keys)
    assert {(r.window_start.day, r.avg_price) for r in once.collect()} == {(1, 11), (2, 12)}
    assert merge.upsert(once, delta, keys).count() == 2


def test_upsert_takes_the_last_of_several(spark):
    base = spark.createDataFrame([("a", 1, 0)], "k string, v int, at int")
    delta = spark.createDataFrame([("a", 2, 1), ("a", 3, 2), ("b", 9, 0)], base.schema)
    rows = merge.upsert(base, delta, ["k"], ["at"]).collect()
    assert {(r.k, r.v) for r in rows} == {("a", 3), ("b", 9)}


def test_insert_if_absent_keeps_what_is_stored(spark):
    row = ("a1", "SPIKE", "HIGH", "c", KEY, None, "{}", T0)
    base = spark.createDataFrame([row], ALERT)
    again = spark.createDataFrame([row[:2] + ("LOW",) + row[3:]] * 2, ALERT)
    assert [r.severity for r in merge.insert_if_absent(base, again, ["alert_id"]).collect()] == [
        "HIGH"
    ]
    assert merge.insert_if_absent(base.limit(0), again, ["alert_id"], ["ts"]).count() == 1


def test_top_movers(spark, price_table):
    cards = spark.createDataFrame([(CARD, "Bog Heron"), ("up", "Up")], "card_id string, name string")
    table = price_table(
        (KEY, 0, "10.00"), (KEY, 5, "15.00"),
        ("up|NORMAL|NM", 0, "1.00"), ("up|NORMAL|NM", 1, "4.00"), ("up|NORMAL|NM", 2, "2.00"),
        ("ghost|NORMAL|NM", 0, "1.00"), ("ghost|NORMAL|NM", 1, "9.00"),
        ("one|NORMAL|NM", 0, "1.00"),
    )
    gainers = serving.top_movers(table, cards).collect()
    assert [(r.card_name, r.pct_change) for r in gainers] == [("Bog Heron", 0.5), ("Up", -0.5)]
    losers = serving.top_movers(table, cards, direction="LOSERS", limit=1).collect()
    assert [r.card_name for r in losers] == ["Up"]


def test_history_bounds_are_inclusive_and_prefix_is_literal(price_table):
    table = price_table(("a_c|NORMAL|NM", 0, "1"), ("a_c|NORMAL|NM", 1, "2"), ("abc|NORMAL|NM", 1, "3"))
    day = T0.replace(hour=0)
    rows = serving.price_history(table, "a_c", "daily", day, day + dt.timedelta(days=1)).collect()
    assert [r.avg_price for r in rows] == [1, 2]
    assert serving.price_history(table, "a_c", "daily", day + dt.timedelta(seconds=1)).count() == 1
    assert serving.price_history(table, "a_c").count() == 0


@pytest.mark.parametrize("bad", ["weekly", "ma_24h", ""])
def test_bad_arguments(price_table, bad):
    with pytest.raises(ValueError):
        serving.window_type_of(bad)
    with pytest.raises(ValueError):
        serving.direction_of(bad)


def test_price_change_skips_gaps(price_table):
    rows = serving.price_change(price_table((KEY, 0, "1"), (KEY, 9, "2"))).orderBy("window_start")
    assert [r.prev_avg_price for r in rows.collect()] == [None, 1]


def test_ticker_answers(spark, sales):
    asked = spark.createDataFrame([(KEY,), ("x|NORMAL|NM",), ("x|SHINY|NM",)], "asked string")
    rows = serving.ticker_snapshot(stats.market_snapshot(sales((7, 0))), asked).collect()
    assert {r.asked: r.answer for r in rows} == {
        KEY: "found",
        "x|NORMAL|NM": "missing",
        "x|SHINY|NM": "invalid",
    }


@pytest.fixture
def alert_table(spark):
    def build(*rows):
        data = [
            (i, kind, severity, card, f"{card}|NORMAL|NM", None, "{}", T0 + dt.timedelta(minutes=m))
            for i, kind, severity, card, m in rows
        ]
        return spark.createDataFrame(data, ALERT)

    return build


def test_severity_split_is_complete(alert_table):
    rows = alert_table(("1", "SPIKE", "HIGH", "c", 0), ("2", "SPIKE", "MED", "c", 1), ("3", "SPIKE", "LOW", "c", 2))
    parts = [alerts.with_severity(rows, s).count() for s in ("HIGH", "MED", "LOW")]
    assert parts == [1, 1, 1]
    with pytest.raises(ValueError):
        alerts.with_severity(rows, "NONE")


def test_recent_filters_and_orders(alert_table):
    rows = alert_table(("1", "SPIKE", "HIGH", "c", 0), ("2", "ARBITRAGE", "HIGH", "c", 1), ("3", "SPIKE", "HIGH", "c", 2))
    assert [r.alert_id for r in alerts.recent(rows, limit=2).collect()] == ["3", "2"]
    assert [r.alert_id for r in alerts.recent(rows, "SPIKE", "HIGH").collect()] == ["3", "1"]
    with pytest.raises(ValueError):
        alerts.recent(rows, kind="CRASH")
    with pytest.raises(ValueError):
        alerts.recent(rows, severity="high")


def test_live_alert_hides_its_stored_copy(alert_table):
    stored = alert_table(("1", "SPIKE", "LOW", "c", 0), ("2", "SPIKE", "LOW", "c", 1))
    live = alert_table(("2", "SPIKE", "HIGH", "c", 1), ("3", "SPIKE", "HIGH", "c", 2))
    merged = alerts.merge_feed(live, stored).collect()
    assert [(r.alert_id, r.severity) for r in merged] == [("3", "HIGH"), ("2", "HIGH"), ("1", "LOW")]


def test_corrupt_detail_fails(alert_table):
    broken = alert_table(("1", "SPIKE", "LOW", "c", 0)).withColumn("detail", F.lit("{oops"))
    with pytest.raises(Exception, match="(?i)malformed"):
        alerts.parse_detail(broken, "SPIKE").collect()


def test_variant_detail_of_mixed_alerts(alert_table):
    rows = alert_table(*[(str(n), "SPIKE", "LOW", "c", n) for n in range(5)])
    texts = F.array(
        F.lit('{"price": 12.50, "sampleCount": 3}'), F.lit('{"listingPrice": 7, "sellerId": "s"}'),
        F.lit('{"price": null, "listingPrice": 1e2}'), F.lit("{}"), F.lit(None).cast("string"),
    )
    found = alerts.with_variant_detail(
        rows.withColumn("detail", F.element_at(texts, F.col("alert_id").cast("int") + 1))
    )
    got = found.orderBy("alert_id").select(
        alerts.detail_field("price", "listingPrice").alias("price"),
        alerts.detail_field("sellerId", kind="string").alias("seller"),
    )
    assert [tuple(r) for r in got.collect()] == [
        (12.5, None), (7.0, "s"), (100.0, None), (None, None), (None, None),
    ]
    with pytest.raises(ValueError):
        alerts.detail_field()


@pytest.mark.parametrize("text", ["{oops", '{"price": "dear"}'])
def test_corrupt_variant_detail_fails(alert_table, text):
    broken = alert_table(("1", "SPIKE", "LOW", "c", 0)).withColumn("detail", F.lit(text))
    with pytest.raises(Exception, match="(?i)malformed|invalid_variant_cast"):
        alerts.with_variant_detail(broken).select(alerts.detail_field("price")).collect()


def test_watchlist_scope(spark, alert_table):
    rows = alert_table(("1", "SPIKE", "LOW", "a", 0), ("2", "SPIKE", "LOW", "b", 1))
    watch = spark.createDataFrame([("u1", "a"), ("u2", "a"), ("u2", "b")], "user_id string, card_id string")
    assert serving.scoped_alerts(rows, watch).count() == 2
    assert [r.alert_id for r in serving.scoped_alerts(rows, watch, "u1").collect()] == ["1"]
    fanout = {(r.user_id, r.alert_id) for r in serving.watchlist_fanout(rows, watch).collect()}
    assert fanout == {("u1", "1"), ("u2", "1"), ("u2", "2")}
