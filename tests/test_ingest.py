from __future__ import annotations

import datetime as dt
import json
import random
from datetime import timedelta
from decimal import ROUND_HALF_UP, Decimal

import pytest
from conftest import T0
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketpulse.functions import feed, keys, money
from marketpulse.operators import late, normalize, quality
from marketpulse.plans.ingest import ingest
from marketpulse.schemas import ValidationLimits
from marketpulse.sources import catalog, feeds

NOW = dt.datetime(2025, 11, 8, 7, 20)
LIMITS = ValidationLimits()
EVENT = (
    "event_id string, source string, card_id string, finish string, condition string, "
    "price_raw string, quantity int, seller_id string, listed_at timestamp"
)


def _reason(spark, **changes):
    row = dict(
        event_id="sim:9", source="sim", card_id="fen-6", finish="NORMAL", condition="HP",
        price_raw="7.35", quantity=4, seller_id="stall", listed_at=NOW,
    )
    row.update(changes)
    events = spark.createDataFrame([tuple(row.values())], EVENT)
    cards = spark.createDataFrame([("fen-6",)], "card_id string")
    checked = quality.with_reject_reason(events, cards, F.lit(NOW), "listed_at")
    return checked.first().reject_reason


@pytest.mark.parametrize(
    ("changes", "reason"),
    [
        ({}, None),
        ({"card_id": "nowhere-0"}, "unknown_card"),
        ({"price_raw": "-0.01"}, "price_out_of_bounds"),
        ({"price_raw": "0.009"}, "price_out_of_bounds"),
        ({"price_raw": str(LIMITS.max_price + LIMITS.min_price)}, "price_out_of_bounds"),
        ({"price_raw": "7.350"}, "price_out_of_bounds"),
        ({"price_raw": "1,234.50"}, "price_out_of_bounds"),
        ({"price_raw": "12abc"}, "price_out_of_bounds"),
        ({"price_raw": str(LIMITS.max_price)}, None),
        ({"price_raw": "1e3"}, None),
        ({"price_raw": "1.25e1"}, None),
        ({"price_raw": "125e-3"}, "price_out_of_bounds"),
        ({"price_raw": "cheap"}, "price_out_of_bounds"),
        ({"price_raw": None}, "price_out_of_bounds"),
        ({"quantity": -3}, "quantity_out_of_bounds"),
        ({"quantity": LIMITS.max_quantity + 1}, "quantity_out_of_bounds"),
        ({"listed_at": NOW + LIMITS.max_future_skew + timedelta(seconds=1)}, "timestamp_out_of_window"),
        ({"listed_at": NOW + LIMITS.max_future_skew}, None),
        ({"listed_at": NOW - LIMITS.max_age - timedelta(seconds=1)}, "timestamp_out_of_window"),
        ({"listed_at": None}, "timestamp_out_of_window"),
        ({"seller_id": "two|parts"}, "bad_identifier"),
        ({"seller_id": None}, "bad_identifier"),
        ({"card_id": "fen-6\u0085"}, "bad_identifier"),
        ({"card_id": "  "}, "bad_identifier"),
        ({"card_id": "fen|6"}, "bad_identifier"),
        ({"condition": None}, "missing_enum"),
        ({"finish": "SHINY"}, "missing_enum"),
        # The first failed rule decides.
        ({"finish": None, "card_id": "nowhere-0", "quantity": -3}, "missing_enum"),
        ({"card_id": "nowhere-0", "price_raw": "0"}, "unknown_card"),
        ({"quantity": 0, "seller_id": ""}, "quantity_out_of_bounds"),
    ],
)
def test_reject_reason(spark, changes, reason):
    assert _reason(spark, **changes) == reason


def test_empty_catalogue_rejects_everything(spark, listings):
    rows = listings((5, 1)).withColumn("price_raw", F.lit("5.00"))
    none = spark.createDataFrame([], "card_id string")
    now = F.lit(T0 + timedelta(hours=2))
    checked = quality.with_reject_reason(rows, none, now, "listed_at")
    assert checked.first().reject_reason == "unknown_card"


def _record(event_id, product, printing, price, second, **more):
    return json.dumps(
        {
            "eventId": event_id, "productId": product, "skuId": 40 + event_id,
            "subTypeName": printing, "condition": "MP", "price": price, "quantity": 3,
            **{k: v.format(f"2025-11-08T06:30:{second:02d}Z") for k, v in more.items()},
        },
        separators=(",", ":"),
    )


LISTING_LINES = [
    _record(61, 7100, "Normal", 18.25, 10, sellerId="stall", listedAt="{}"),
    _record(62, 7999, "Holofoil", 0.75, 11, sellerId="booth", listedAt="{}"),
    _record(63, 7200, "Gold Edge", 2.5, 12, sellerId="kiosk", listedAt="{}"),
]
SALE_LINES = [_record(64, 7200, "Reverse Holofoil", 5.75, 13, soldAt="{}")]


@pytest.fixture
def raw(spark):
    def lines(texts, kind):
        frame = spark.createDataFrame([(t,) for t in texts], "value string")
        return feeds.readable(feeds.parse_lines(frame, kind))

    return lines


@pytest.fixture
def products(spark):
    return spark.createDataFrame(
        [(7100, "fen-6"), (7200, "fen-7")], "product_id long, card_id string"
    )


def test_normalise_drops_unknown_products_and_printings(raw, products):
    resolved = normalize.resolve(raw(LISTING_LINES, "listing"), products, "sim")
    kept = resolved.filter("drop_reason IS NULL").collect()
    assert [(r.event_id, r.source, r.card_id, r.finish, r.condition) for r in kept] == [
        ("sim:61", "sim", "fen-6", "NORMAL", "MP")
    ]
    counts = {r.reason: r.dropped for r in normalize.drop_counts(resolved).collect()}
    assert counts == {"unresolved_product": 1, "bad_subtype": 1}
    (sale,) = normalize.normalize(raw(SALE_LINES, "sale"), products, "sim").collect()
    assert (sale.event_id, sale.card_id, sale.finish, sale.condition) == (
        "sim:64", "fen-7", "REVERSE_HOLOFOIL", "MP",
    )


def test_written_price_scale_survives_parsing(raw):
    line = SALE_LINES[0].replace("5.75", "7.3500")
    assert raw([line], "sale").first().price_raw == "7.3500"


@pytest.mark.parametrize(
    ("written", "read"),
    [
        ('"price":"1,234.50"', "1,234.50"),
        ('"price":"12abc"', "12abc"),
        ('"fees":{"price":0.01},"price":99.00', "99.00"),
        ('"price":99.00,"fees":{"price":0.01}', "99.00"),
        ('"note":"\\"price\\": 3,","price": 4.10', "4.10"),
        ('"price":null', None),
    ],
)
def test_price_is_the_whole_member_of_the_record(raw, written, read):
    line = SALE_LINES[0].replace('"price":5.75', written)
    assert raw([line], "sale").first().price_raw == read


@pytest.mark.parametrize(
    "text", ["12:00:00", "T08:30", "2025", "2025-11-08", "2025-11-08T06:30:00", "2025-13-08T06:30:00Z"]
)
def test_anything_less_than_an_instant_is_no_time(raw, text):
    line = SALE_LINES[0].replace("2025-11-08T06:30:13Z", text)
    assert raw([line], "sale").first().sold_at is None


def test_rows_without_an_id_are_dropped_with_a_reason(raw, products):
    lines = [SALE_LINES[0].replace('"eventId":64,', ""), SALE_LINES[0]]
    resolved = normalize.resolve(raw(lines, "sale"), products, "sim").collect()
    assert sorted((r.event_id or "", r.drop_reason or "") for r in resolved) == [
        ("", "missing_id"), ("sim:64", ""),
    ]


def test_first_delivery_wins_whatever_its_time(spark, raw, products):
    again = SALE_LINES[0].replace("06:30:13", "06:30:01").replace('"quantity":3', '"quantity":1')
    sales = raw([SALE_LINES[0], again], "sale").withColumn(
        "arrival", F.when(F.col("quantity") == 3, 1).otherwise(2)
    )
    cards = spark.createDataFrame([("fen-7",)], "card_id string")
    run = ingest(raw(LISTING_LINES, "listing"), sales, products, cards, F.lit(NOW), "sim")
    assert [r.quantity for r in run.sales.collect()] == [3]


def test_missing_quantity_reads_as_zero(raw):
    line = SALE_LINES[0].replace('"quantity":3,', "")
    assert raw([line], "sale").first().quantity == 0


def test_broken_line_is_set_aside(spark):
    lines = spark.createDataFrame([(SALE_LINES[0],), (SALE_LINES[0][:30],)], "value string")
    parsed = feeds.parse_lines(lines, "sale")
    assert feeds.readable(parsed).count() == 1
    assert feeds.corrupt(parsed).first().corrupt_line == SALE_LINES[0][:30]


def test_ingest_counts_duplicates_before_validation(spark, raw, products):
    bad = SALE_LINES[0].replace('"quantity":3', '"quantity":0').replace(":64,", ":65,", 1)
    fixed = bad.replace('"quantity":0', '"quantity":2').replace("06:30:13", "06:30:19")
    cards = spark.createDataFrame([("fen-6",), ("fen-7",)], "card_id string")
    run = ingest(
        raw(LISTING_LINES, "listing"),
        raw([SALE_LINES[0], SALE_LINES[0], bad, fixed], "sale"),
        products,
        cards,
        F.lit(NOW),
        source="sim",
    )
    (status,) = run.status(F.lit(NOW)).collect()
    # The corrected redelivery of a rejected event is still a duplicate.
    assert (status.ingested, status.rejected, status.duplicates) == (2, 1, 2)
    assert status.listings_cursor == dt.datetime(2025, 11, 8, 6, 30, 10)
    assert status.sales_cursor == dt.datetime(2025, 11, 8, 6, 30, 19)
    assert [r.reject_reason for r in run.quarantine.collect()] == ["quantity_out_of_bounds"]
    assert run.sales.count() == 1 and run.listings.count() == 1


def test_listing_takes_the_id_before_a_sale(spark, raw, products):
    sale = SALE_LINES[0].replace('"eventId":64', '"eventId":61')
    cards = spark.createDataFrame([("fen-6",), ("fen-7",)], "card_id string")
    run = ingest(
        raw(LISTING_LINES, "listing"), raw([sale], "sale"), products, cards, F.lit(NOW), "sim"
    )
    assert [r.feed for r in run.checked.collect()] == ["listing"]


def test_cursor_ignores_future_and_null_and_never_moves_back(spark):
    rows = [("sim", "sale", NOW), ("sim", "sale", NOW + timedelta(days=1)), ("sim", "sale", None)]
    events = spark.createDataFrame(rows, "source string, feed string, ts timestamp")
    later = spark.createDataFrame(
        [("sim", "sale", NOW + timedelta(minutes=1))],
        "source string, feed string, cursor timestamp",
    )
    assert quality.source_cursor(events, F.lit(NOW)).first().cursor == NOW
    moved = quality.source_cursor(events, F.lit(NOW), previous=later).first().cursor
    assert moved == NOW + timedelta(minutes=1)


def _timed(spark, *offsets):
    rows = [(i + 1, NOW + timedelta(seconds=s)) for i, s in enumerate(offsets)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp")


def test_since_is_strict_and_limited(spark):
    events = _timed(spark, 0, 1, 2)
    assert [r.event_id for r in feeds.since(events, "ts", F.lit(NOW), 10).collect()] == [2, 3]
    assert [r.event_id for r in feeds.since(events, "ts", None, 2).collect()] == [1, 2]
    assert feeds.since(events, "ts", None, 0, default_limit=1).count() == 1
    with pytest.raises(ValueError):
        feeds.since(events, "ts", None, 1001)


def test_since_resumes_inside_one_instant(spark):
    events = _timed(spark, 0, 0, 0, 1)
    first = feeds.since(events, "ts", None, 2).collect()
    last = first[-1]
    rest = feeds.since(events, "ts", F.lit(last.ts), 10, after_id=F.lit(last.event_id)).collect()
    assert [r.event_id for r in first + rest] == [1, 2, 3, 4]


def test_retention_keeps_what_is_near_the_newest(spark):
    kept = feeds.retain(_timed(spark, 0, 20), "ts", timedelta(seconds=10))
    assert [r.event_id for r in kept.collect()] == [2]


def test_unknown_source_type_is_skipped(spark):
    readers = {"a": lambda s, config: s.createDataFrame([(config["n"],)], "n long")}
    configs = {
        "x": {"type": "a", "n": 1},
        "y": {"type": "b"},
        "z": {"type": "a", "n": 2, "enabled": False},
    }
    assert [tuple(r) for r in feeds.union_sources(spark, configs, readers).collect()] == [(1, "x")]
    with pytest.raises(ValueError):
        feeds.union_sources(spark, {"y": {"type": "b"}}, readers)


def test_product_pages_last_write_wins(spark, tmp_path):
    pages = [
        {"items": [{"productId": 1, "cardId": "a"}, {"productId": 2, "cardId": "b"}], "page": 0},
        {"items": [{"productId": 1, "cardId": "c"}, {"productId": 1, "cardId": "d"}], "page": 1},
    ]
    (tmp_path / "p.json").write_text("\n".join(json.dumps(p) for p in pages))
    found = catalog.product_map(catalog.read_product_pages(spark, str(tmp_path)))
    assert {r.product_id: r.card_id for r in found.collect()} == {1: "d", 2: "b"}


def test_market_key_round_trip_and_errors(spark):
    texts = ["a|NORMAL|NM", "a|NORMAL", "a|SHINY|NM", "a|NORMAL|NM|x", "|NORMAL|NM", None]
    df = spark.createDataFrame([(t,) for t in texts], T.StructType().add("k", "string"))
    parsed = df.select(keys.parse_market_key(F.col("k")).alias("p")).select("p.*").collect()
    assert [r.valid for r in parsed] == [True, False, False, False, True, False]
    assert (parsed[0].card_id, parsed[0].finish, parsed[0].condition) == ("a", "NORMAL", "NM")


def test_finish_and_release_date_and_scale(spark):
    df = spark.createDataFrame(
        [(" Reverse Holofoil ", "2024/05/03", "1.250"), ("Etched", "2024-05-03", "7")],
        "f string, d string, p string",
    )
    rows = df.select(
        feed.finish_of(F.col("f")).alias("f"),
        feed.release_date(F.col("d")).alias("d"),
        money.text_scale(F.col("p")).alias("s"),
    ).collect()
    assert tuple(rows[0]) == ("REVERSE_HOLOFOIL", dt.date(2024, 5, 3), 3)
    assert tuple(rows[1]) == (None, None, 0)


def test_late_sale_is_found_across_slices(spark):
    def at(minutes):
        return NOW + timedelta(minutes=minutes)

    rows = [("a", at(0), at(0)), ("b", at(61), at(61)), ("c", at(5), at(62)), ("d", at(62), at(63))]
    events = spark.createDataFrame(rows, "event_id string, ts timestamp, arrived timestamp")
    timed = late.with_stream_time(events, "arrived", "ts")
    flags = {r.event_id: r.late for r in late.with_lateness(timed, "ts").collect()}
    assert flags == {"a": False, "b": False, "c": True, "d": False}
    assert late.drop_late(timed, "ts").count() == 3


def test_trailing_windows_miss_what_came_after_they_closed(spark):
    """Against a plain replay: windows one by one, events in order of arrival."""
    rng = random.Random(11)
    hour = timedelta(hours=1)
    base = dt.datetime(2025, 9, 1)
    rows = []
    for i in range(400):
        made = base + timedelta(minutes=rng.randint(0, 60 * 72))
        if i % 9 == 0:  # on the hour, where windows close
            made = made.replace(minute=0)
        delay = timedelta(minutes=rng.choice([0, 1, 59, 60, 300, 1380, 1440, 2000]))
        key = rng.choice(["a|NORMAL|NM", "b|NORMAL|NM"])
        price = None if i % 50 == 7 else Decimal(rng.randint(1, 999)) / 100
        rows.append((f"e{i:03d}", key, price, rng.randint(-1, 3), made, made + delay))
    want, newest, missed = {}, dt.datetime.min, set()
    for event_id, key, price, quantity, made, came in sorted(rows, key=lambda r: (r[5], r[0])):
        newest = max(newest, made)
        own = made.replace(minute=0, second=0)
        reached = [s for s in (own - k * hour for k in range(24)) if s + 24 * hour > newest]
        if len(reached) < 24:
            missed.add(len(reached))
        for start in reached:
            n, total, volume = want.get((key, start), (0, Decimal(0), 0))
            seen = price is not None
            want[key, start] = (n + seen, total + (price or 0), volume + max(quantity, 0))
    assert {0, 1, 23} <= missed  # late for all, for most and for one window only
    events = spark.createDataFrame(
        rows,
        "event_id string, market_key string, price decimal(12,2), quantity int, "
        "sold_at timestamp, arrived timestamp",
    )
    timed = late.with_stream_time(events, "arrived", "sold_at")
    got = {
        (r.market_key, r.window_start): (r.sample_count, r.avg_price, r.volume)
        for r in late.trailing_aggregates(timed).collect()
    }
    cents = Decimal("0.01")
    assert got == {
        k: (n, (total / n).quantize(cents, ROUND_HALF_UP), volume)
        for k, (n, total, volume) in want.items()
        if n
    }


def test_trailing_windows_of_no_sales_and_of_sales_without_a_time(spark):
    rows = [("e1", "a|NORMAL|NM", Decimal("1.00"), 1, None, NOW)]
    events = spark.createDataFrame(
        rows,
        "event_id string, market_key string, price decimal(12,2), quantity int, "
        "sold_at timestamp, arrived timestamp",
    )
    for given in (events, events.limit(0)):
        timed = late.with_stream_time(given, "arrived", "sold_at")
        assert late.trailing_aggregates(timed).count() == 0
