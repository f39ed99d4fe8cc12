"""Live jobs over several micro-batches against the batch operators."""

from __future__ import annotations

import datetime as dt
import os
import random
from decimal import Decimal

import pytest
from conftest import T0
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from marketpulse import Thresholds
from marketpulse.functions.keys import market_key
from marketpulse.operators import alerts as alert_ops
from marketpulse.operators import running, signals, stats, windows
from marketpulse.operators.running import batch_totals
from marketpulse.schemas import ALERT, LISTING, PRICE_WINDOW, SALE
from marketpulse.session import ROCKSDB, STATE_STORE
from marketpulse.sources import feeds, tables
from marketpulse.streaming import alerts, ingest, keyed, sinks, snapshot
from marketpulse.streaming.windows import start_windows, stream_windows

LIMITS = Thresholds(min_samples=5)


def _sales(n=240, seed=11):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        card = "hot" if i % 3 == 0 else f"c{rng.randrange(4)}"
        price = Decimal(rng.randrange(500, 1500)) / 100 * (9 if rng.random() < 0.04 else 1)
        at = T0 + dt.timedelta(minutes=20 * i + rng.randrange(20))
        rows.append((f"s{i:04d}", "sim", card, "NORMAL", "NM", price, 1 + i % 3, at))
    return rows


def _listings(n=120, seed=5):
    rng = random.Random(seed)
    return [
        (
            f"l{i:04d}", "sim", "hot" if i % 2 else f"c{rng.randrange(4)}", "NORMAL", "NM",
            Decimal(rng.randrange(300, 1500)) / 100, 1, f"s-{i}",
            T0 + dt.timedelta(minutes=40 * i + rng.randrange(40)),
        )
        for i in range(n)
    ]


def _write_parts(spark, rows, schema, path, parts=4):
    """One file per part; files are told apart by age, so each must be newer than the last."""
    size = -(-len(rows) // parts)
    for i in range(parts):
        part = spark.createDataFrame(rows[i * size : (i + 1) * size], schema)
        part.coalesce(1).write.mode("append").parquet(path)


def _stream(spark, path, schema):
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    return reader.parquet(path).withColumn("market_key", market_key())


@pytest.fixture
def live(spark, tmp_path):
    path = f"{tmp_path}/sales"
    _write_parts(spark, _sales(), SALE, path)
    batch = spark.createDataFrame(_sales(), SALE).withColumn("market_key", market_key())
    return _stream(spark, path, SALE), batch


def _same(left, right):
    assert left.exceptAll(right).count() == 0
    assert right.exceptAll(left).count() == 0


def test_windows_are_emitted_once_when_closed(spark, live, tmp_path):
    stream, batch = live
    for query in start_windows(stream, f"{tmp_path}/pw", f"{tmp_path}/cp"):
        query.awaitTermination()
        assert len([p for p in query.recentProgress if p["numInputRows"]]) == 4
    log = tables.read_log(spark, f"{tmp_path}/pw", PRICE_WINDOW)
    keys = ["market_key", "window_type", "window_start"]
    assert log.count() == log.select(*keys).distinct().count()
    want = windows.settled(windows.windowed_aggregates(batch), batch)
    _same(tables.read_price_windows(spark, f"{tmp_path}/pw").select(*PRICE_WINDOW.names), want)


def test_stream_and_batch_reject_unknown_window(live):
    with pytest.raises(ValueError):
        stream_windows(live[0], "WEEKLY")


def test_snapshot_follows_the_stream(spark, live, tmp_path):
    stream, batch = live
    snapshot.start_snapshot(stream, f"{tmp_path}/sn", f"{tmp_path}/cp").awaitTermination()
    _same(tables.read_snapshot(spark, f"{tmp_path}/sn"), stats.market_snapshot(batch))
    log = tables.read_log(spark, f"{tmp_path}/sn", tables.MARKET_SNAPSHOT)
    assert log.select("batch_id").distinct().count() == 4
    sinks.compact(log, ["market_key"], f"{tmp_path}/small")
    _same(tables.read_snapshot(spark, f"{tmp_path}/small"), stats.market_snapshot(batch))


def test_alerts_over_batches_equal_one_batch(spark, live, tmp_path):
    stream, batch = live
    metadata = spark.createDataFrame([("hot", "Hot Card")], "card_id string, name string")
    sink = alerts.alert_sink(f"{tmp_path}/al", f"{tmp_path}/st", lambda: metadata, LIMITS)
    events = signals.sale_events(stream)
    sinks.start(events, sink, f"{tmp_path}/cp").awaitTermination()
    got = tables.read_alerts(spark, f"{tmp_path}/al")
    want = alert_ops.enrich(signals.market_alerts(batch, None, LIMITS), metadata)
    assert want.count() > 5
    _same(got.select(*ALERT.names), want.select(*ALERT.names))


def test_running_a_batch_again_changes_nothing(spark, tmp_path):
    sales = spark.createDataFrame(_sales(), SALE).withColumn("market_key", market_key())
    listings = spark.createDataFrame(_listings(), LISTING).withColumn("market_key", market_key())
    events = signals.market_events(sales, listings)
    cuts = [T0, T0 + dt.timedelta(hours=20), T0 + dt.timedelta(hours=50), T0 + dt.timedelta(days=99)]
    sink = alerts.alert_sink(f"{tmp_path}/al", f"{tmp_path}/st", None, LIMITS)
    for i in range(3):
        part = events.filter((F.col("ts") >= F.lit(cuts[i])) & (F.col("ts") < F.lit(cuts[i + 1])))
        sink(part, i)
        sink(part, i)  # as after a failure between the sink and the checkpoint
    log = tables.read_log(spark, f"{tmp_path}/al", ALERT)
    assert log.count() == log.select("alert_id").distinct().count()
    want = signals.market_alerts(sales, listings, LIMITS)
    assert {r.type for r in want.collect()} == {"SPIKE", "ARBITRAGE"}
    _same(log.select(*ALERT.names), want.select(*ALERT.names))


def _line(event_id, at, quantity=1):
    return (
        f'{{"eventId":{event_id},"productId":7,"skuId":1,"subTypeName":"Normal",'
        f'"condition":"NM","price":2.50,"quantity":{quantity},"soldAt":"{at.isoformat()}Z"}}'
    )


def test_ingest_drops_redeliveries_and_survives_a_future_record(spark, tmp_path):
    """A record far in the future must not make later ones count as late."""
    source = tmp_path / "lines"
    source.mkdir()
    batches = [
        [_line(1, T0), _line(2, T0 + dt.timedelta(days=900)), "not json"],
        [_line(1, T0), _line(3, T0 - dt.timedelta(hours=5)), _line(4, T0, quantity=0)],
        [_line(3, T0 - dt.timedelta(hours=5)), _line(5, T0)],
    ]
    for i, lines in enumerate(batches):
        (source / f"{i}.json").write_text("\n".join(lines))
        mtime = 1_700_000_000 + i
        os.utime(source / f"{i}.json", (mtime, mtime))
    raw = feeds.readable(
        feeds.parse_lines(feeds.stream_lines(spark, str(source), max_files_per_trigger=1), "sale")
    )
    products = spark.createDataFrame([(7, "c7")], "product_id long, card_id string")
    cards = spark.createDataFrame([("c7",)], "card_id string")
    rows = ingest.ingest_stream(None, raw, products, "sim")
    out = str(tmp_path / "out")
    sink = ingest.validating_sink(out, lambda: cards, F.lit(T0 + dt.timedelta(hours=1)))
    sinks.start(rows, sink, f"{tmp_path}/cp").awaitTermination()
    clean = ingest.clean_table(spark, out, "sale")
    assert clean.columns == [*SALE.names, "market_key"]
    assert sorted(r.event_id for r in clean.collect()) == ["sim:1", "sim:3", "sim:5"]
    assert {r.price for r in clean.collect()} == {Decimal("2.50")}
    bad = {r.event_id: r.reject_reason for r in spark.read.parquet(f"{out}/quarantine").collect()}
    assert bad == {"sim:2": "timestamp_out_of_window", "sim:4": "quantity_out_of_bounds"}
    counts = spark.read.parquet(f"{out}/counts").groupBy("outcome").agg(F.sum("rows"))
    assert {r[0]: r[1] for r in counts.collect()} == {
        "ingested": 3,
        "timestamp_out_of_window": 1,
        "quantity_out_of_bounds": 1,
    }


def _ingest_batch(spark, rows):
    """Resolved events (event_id, feed, arrival, quantity) of one micro-batch."""
    frame = spark.createDataFrame(rows, "event_id string, feed string, arrival long, quantity int")
    return frame.selectExpr(
        "event_id", "'sim' AS source", "'c7' AS card_id", "'NORMAL' AS finish", "'NM' AS condition",
        "'2.50' AS price_raw", "quantity", "'stall' AS seller_id",
        f"timestamp'{T0}' + make_interval(0,0,0,0,0,-arrival) AS ts", "feed",
        "IF(feed = 'listing', 0, 1) AS feed_rank", "arrival", "CAST(NULL AS STRING) AS drop_reason",
    )


def test_live_ingest_takes_listings_first_and_then_by_arrival(spark, tmp_path):
    cards = spark.createDataFrame([("c7",)], "card_id string")
    sink = ingest.validating_sink(str(tmp_path), lambda: cards, F.lit(T0 + dt.timedelta(hours=1)))
    first = [("a", "sale", 1, 5), ("a", "listing", 2, 6), ("b", "sale", 2, 7), ("b", "sale", 1, 8)]
    second = [("b", "listing", 3, 9), ("c", "sale", 3, 1)]
    for batch_id, rows in ((0, first), (1, second), (1, second)):
        sink(_ingest_batch(spark, rows), batch_id)
    sales = ingest.clean_table(spark, str(tmp_path), "sale").collect()
    listings = ingest.clean_table(spark, str(tmp_path), "listing").collect()
    assert sorted((r.event_id, r.quantity) for r in sales) == [("b", 8), ("c", 1)]
    assert [(r.event_id, r.quantity) for r in listings] == [("a", 6)]


def test_a_repeated_batch_shows_its_reader_no_new_files(spark, tmp_path):
    cards = spark.createDataFrame([("c7",)], "card_id string")
    sink = ingest.validating_sink(f"{tmp_path}/t", lambda: cards, F.lit(T0 + dt.timedelta(hours=1)))
    rows = [("a", "sale", 1, 5)]

    def drain():
        live = ingest.clean_table(spark, f"{tmp_path}/t", "sale", live=True)
        sinks.start(live, sinks.batch_writer(f"{tmp_path}/o"), f"{tmp_path}/cp").awaitTermination()
        return spark.read.parquet(f"{tmp_path}/o").count()

    sink(_ingest_batch(spark, rows), 0)
    assert drain() == 1
    sink(_ingest_batch(spark, rows), 0)
    assert drain() == 1


def test_sums_written_per_batch_follow_the_batch_and_not_the_idle_tickers(spark, tmp_path):
    def events(n, hour):
        return signals.sale_events(
            spark.range(n).selectExpr(
                f"concat('e', id, '-{hour}') AS event_id", "'sim' AS source",
                "concat('c', id) AS card_id", "'NORMAL' AS finish", "'NM' AS condition",
                "CAST(5 AS DECIMAL(12,2)) AS price", "1 AS quantity",
                f"timestamp'{T0}' + INTERVAL {hour} HOURS AS sold_at",
            )
        )

    sink = alerts.alert_sink(f"{tmp_path}/al", f"{tmp_path}/st", None, LIMITS, fold_every=3)
    for i, n in enumerate((500, 3, 3, 3, 3, 3, 3, 3)):
        sink(events(n, i), i)
    log = spark.read.parquet(f"{tmp_path}/st/log")
    sizes = {r.batch_id: r["count"] for r in log.groupBy("batch_id").count().collect()}
    assert sizes == {0: 500, **{i: 3 for i in range(1, 8)}}
    assert log.filter("batch_id = 7").first().prior_count == 8
    fold = spark.read.parquet(f"{tmp_path}/st/fold/batch_id=6")
    assert fold.count() == 500 and fold.agg(F.sum("prior_count")).first()[0] == 500 + 18


def test_arbitrage_flags_are_written_live(spark, tmp_path):
    sales = spark.createDataFrame(_sales(), SALE).withColumn("market_key", market_key())
    listings = spark.createDataFrame(_listings(), LISTING).withColumn("market_key", market_key())
    sink = alerts.alert_sink(
        f"{tmp_path}/al", f"{tmp_path}/st", None, LIMITS, flags_path=f"{tmp_path}/fl"
    )
    sink(signals.market_events(sales, listings), 0)
    got = spark.read.parquet(f"{tmp_path}/fl").drop("batch_id")
    _same(got, signals.arbitrage_flags(sales, listings, LIMITS))


def test_messages_are_keyed_json(spark):
    sale = spark.createDataFrame(_sales(1), SALE)
    row = sinks.messages(sale, "card_id").first()
    assert row.key == "hot" and '"event_id":"s0000"' in row.value


def _live_events(spark, path):
    """Sales and listings of :func:`_sales` and :func:`_listings` as four files, and as a table."""
    sales = spark.createDataFrame(_sales(), SALE).withColumn("market_key", market_key())
    listings = spark.createDataFrame(_listings(), LISTING).withColumn("market_key", market_key())
    events = signals.market_events(sales, listings)
    rows = [tuple(r) for r in events.orderBy("ts", "kind_rank", "event_id").collect()]
    _write_parts(spark, rows, events.schema, path)
    reader = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1)
    return sales, listings, reader


def test_keyed_alerts_go_on_from_their_state(spark, tmp_path):
    """Two runs over one checkpoint; a ticker with a third of the rows lies in several slices."""
    path = f"{tmp_path}/in"
    sales, listings, reader = _live_events(spark, path)
    metadata = spark.createDataFrame([("hot", "Hot Card")], "card_id string, name string")
    for _ in range(2):
        live = alerts.start_alerts(
            reader.parquet(path), f"{tmp_path}/al", f"{tmp_path}/cp", lambda: metadata, LIMITS,
            f"{tmp_path}/fl",
        )
        live.awaitTermination()
    got = tables.read_alerts(spark, f"{tmp_path}/al")
    want = alert_ops.enrich(signals.market_alerts(sales, listings, LIMITS), metadata)
    assert {r.type for r in want.collect()} == {"SPIKE", "ARBITRAGE"}
    _same(got.select(*ALERT.names), want.select(*ALERT.names))
    flags = spark.read.parquet(f"{tmp_path}/fl").drop("batch_id")
    _same(flags, signals.arbitrage_flags(sales, listings, LIMITS))
    state = keyed._state(spark, f"{tmp_path}/cp", "sums")
    assert state.filter("market_key LIKE 'hot%'").count() == keyed.SLICES
    sums = keyed.running_sums(spark, f"{tmp_path}/cp")
    counts = sales.groupBy("market_key").agg(F.count("price").alias("prior_count"))
    _same(sums.select("market_key", "prior_count"), counts)


def test_idle_sums_are_forgotten(spark, tmp_path):
    """With a time to live every batch starts from nothing, so no row tells earlier sums."""
    path = f"{tmp_path}/in"
    _, _, reader = _live_events(spark, path)
    opened = []
    for idle in (dt.timedelta(milliseconds=1), None):
        rows, found = keyed.with_openings(reader.parquet(path), idle=idle), []
        sink = lambda batch, _: found.append(batch.filter("opening").count())  # noqa: E731, B023
        job = sinks.start(
            rows, sink, f"{tmp_path}/cp{idle is None}", mode="update", every="100 milliseconds"
        )
        job.processAllAvailable()
        job.stop()
        opened.append(sum(found))
    assert opened[0] == 0 < opened[1]
    with pytest.raises(ValueError):
        alerts.start_alerts(rows, "a", "c", idle=dt.timedelta(hours=1))


def test_market_state_needs_no_log(spark, live, tmp_path):
    stream, batch = live
    snapshot.start_state(stream, f"{tmp_path}/cp").awaitTermination()
    _same(keyed.market_state(spark, f"{tmp_path}/cp"), stats.market_snapshot(batch))
    assert sorted(os.listdir(tmp_path)) == ["cp", "sales"]


def test_seen_ids_open_the_slices_of_their_horizon_only(spark, tmp_path):
    """Old slices go, ids outside the horizon are new, and a batch run again judges alike."""
    seen = ingest.SeenIds(spark, f"{tmp_path}/seen", dt.timedelta(minutes=3))
    ids = lambda *n: spark.createDataFrame([("sim", f"e{i}") for i in n], "source string, event_id string")
    at = dt.datetime(2025, 9, 1, 10, tzinfo=dt.timezone.utc)
    files = []
    for batch in range(10):
        now = at + dt.timedelta(minutes=batch)
        known = {r.event_id for r in seen.before(batch, now).collect()}
        assert known == {f"e{i}" for i in range(max(0, batch - 3), batch)}
        seen.add(ids(batch).coalesce(1), batch, now)
        files.append(sum(n.endswith(".parquet") for _, _, f in os.walk(f"{tmp_path}/seen") for n in f))
    assert max(files) <= 5 and files[-1] == files[6]
    again = seen.time_of(9, at + dt.timedelta(days=1))
    assert again == at + dt.timedelta(minutes=9)
    assert {r.event_id for r in seen.before(9, again).collect()} == {f"e{i}" for i in range(6, 9)}


def test_runs_of_trailing_windows_against_every_window():
    rng = random.Random(2)
    for _ in range(200):
        hours = sorted(rng.sample(range(1000, 1090), rng.randint(1, 12)))
        panes = [
            (h, n := rng.randint(0, 3), Decimal(7 * n), Decimal(49 * n), rng.randint(0, 5))
            for h in hours
        ]
        begin, end = hours[0] + 1, rng.randint(1000, 1130)
        middle = rng.randint(begin - 1, max(begin, end))
        # In one go, and cut in two as by two batches.
        for parts in ([(begin, end)], [(begin, min(middle, end)), (min(middle, end) + 1, end)]):
            got = {}
            for a, b in parts:
                for r in keyed.trailing_runs("k", panes, a, b):
                    for e in range(r.first_end, r.last_end + 1):
                        assert e not in got
                        got[e] = tuple(r)[3:]
            want = {}
            for e in range(begin, end + 1):
                inside = [p[1:] for p in panes if e - 24 <= p[0] < e]
                if sum(p[0] for p in inside):
                    want[e] = tuple(sum(v) for v in zip(*inside))
            assert got == want


def test_a_ticker_keeps_a_day_of_panes_and_is_forgotten_after_it(spark, tmp_path):
    rows = [
        (f"s{i:04d}", "sim", "hot", "NORMAL", "NM", Decimal("5.00"), 1, T0 + dt.timedelta(hours=i))
        for i in range(200)
    ]
    idle = ("s9999", "sim", "idle", "NORMAL", "NM", Decimal("5.00"), 1, T0)
    _write_parts(spark, [idle, *rows], SALE, f"{tmp_path}/in", parts=3)
    sales = _stream(spark, f"{tmp_path}/in", SALE)
    state = f"{tmp_path}/state"
    job = sinks.start(stream_windows(sales, "MA_24H"), sinks.batch_writer(f"{tmp_path}/out"), state)
    job.awaitTermination()
    reader = spark.read.format("statestore").option("stateVarName", "ring")
    operators = [p["operatorName"] for p in job.lastProgress["stateOperators"]]
    number = operators.index("transformWithStateInPySparkExec")
    rings = reader.option("operatorId", number).load(state).select("key.*", "value.*").collect()
    assert [r.market_key for r in rings] == ["hot|NORMAL|NM"]
    assert len(rings[0].panes) <= 24
    out = tables.read_log(spark, f"{tmp_path}/out", PRICE_WINDOW)
    assert out.filter("card_id = 'idle'").count() == 24  # closed by others' later sales


def _rows_through_state(spark, tmp_path, monkeypatch, tickers, n=300):
    """Rows that the sums' processor is given for one file of ``n`` sales dealt over tickers."""
    path = f"{tmp_path}/rows"

    class Counting(StatefulProcessor):
        def __init__(self, *args):
            self.args = args

        def init(self, handle):
            from marketpulse.streaming.keyed import RunningSums  # as it is in the worker

            self.sums = RunningSums(*self.args)
            self.sums.init(handle)

        def handleInputRows(self, key, rows, timerValues):
            rows = list(rows)
            with open(path, "a") as out:
                out.write(f"{len(rows)}\n")
            return self.sums.handleInputRows(key, iter(rows), timerValues)

        def close(self):
            pass

    monkeypatch.setattr(keyed, "RunningSums", Counting)
    sales = [(f"s{i}", "sim", f"c{i % tickers}", "NORMAL", "NM", Decimal(5), 1, T0) for i in range(n)]
    _write_parts(spark, sales, SALE, f"{tmp_path}/in", parts=1)
    events = signals.sale_events(_stream(spark, f"{tmp_path}/in", SALE))
    found = []
    sink = lambda batch, _: found.append(batch.filter("NOT opening").count())
    rows = keyed.with_openings(events)
    sinks.start(rows, sink, f"{tmp_path}/cp", mode="update").awaitTermination()
    assert found == [n]
    with open(path) as lines:
        return sum(map(int, lines))


@pytest.mark.parametrize("tickers", [1, 7])
def test_sums_and_not_events_pass_through_the_state(spark, tmp_path, monkeypatch, tickers):
    """Also where a column of the events, as the kind of sales alone, is never null."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        rows = _rows_through_state(spark, tmp_path, monkeypatch, tickers)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert rows == tickers * keyed.SLICES


def test_partial_sums_are_whole_when_a_task_passes_them_on_early(spark, monkeypatch):
    """Tickers without a counted price, and null tickers, are asked for as well."""
    rows = [(f"e{i}", f"c{i % 9}" if i % 10 else None, Decimal(i) / 100 if i % 7 else None, i % 3 > 0)
            for i in range(400)]
    names = "event_id string, market_key string, price decimal(12,2), counted boolean"
    events = spark.createDataFrame(rows, names).coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        whole = keyed._partial_sums(events, 4).collect()
        monkeypatch.setattr(keyed, "_HELD", 3)
        parts = keyed._partial_sums(events, 4).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(whole) == 10 * 4 < len(parts)
    want = {}
    for _, key, price, counted in rows:
        n, total, squares = want.get(key, (0, 0, 0))
        if counted and price is not None:
            n, total, squares = n + 1, total + price, squares + price * price
        want[key] = n, total, squares
    for got in (whole, parts):
        sums = {}
        for r in got:
            sums[r[0]] = tuple(a + b for a, b in zip(sums.get(r[0], (0, 0, 0)), r[2:]))
        assert sums == want


def test_the_alert_job_is_fed_by_all_tasks(spark, tmp_path, monkeypatch):
    """Each part of the feed is written by several tasks and read as one micro-batch."""
    from workload import stream_queries
    from workload.views import Feeds

    monkeypatch.setattr(stream_queries, "shared_dir", lambda *_: f"{tmp_path}/job")
    base = stream_queries._stream_alerts(Feeds(spark, "/root/testdata/sf0.001"))
    files = [n for n in os.listdir(f"{base}/in") if n.endswith(".parquet")]
    commits = [n for n in os.listdir(f"{base}/state/commits") if n.isdigit()]
    assert len(commits) == stream_queries.BATCHES < len(files)


def test_flags_of_live_sales_and_listings_that_are_not_stored_as_events(spark, tmp_path):
    """Their kind is never null, unlike that of events read from files."""
    sales = spark.createDataFrame(_sales(), SALE).withColumn("market_key", market_key())
    listings = spark.createDataFrame(_listings(), LISTING).withColumn("market_key", market_key())
    _write_parts(spark, _sales(), SALE, f"{tmp_path}/s", parts=1)
    _write_parts(spark, _listings(), LISTING, f"{tmp_path}/l", parts=1)
    events = signals.market_events(
        _stream(spark, f"{tmp_path}/s", SALE), _stream(spark, f"{tmp_path}/l", LISTING)
    )
    job = alerts.start_alerts(
        events, f"{tmp_path}/al", f"{tmp_path}/cp", None, LIMITS, f"{tmp_path}/fl"
    )
    job.awaitTermination()
    flags = spark.read.parquet(f"{tmp_path}/fl").drop("batch_id")
    assert flags.count() > 0
    _same(flags, signals.arbitrage_flags(sales, listings, LIMITS))


def test_running_sums_of_live_sales_alone(spark, live, tmp_path):
    stream, batch = live
    events = signals.sale_events(stream)
    alerts.start_alerts(events, f"{tmp_path}/al", f"{tmp_path}/cp", None, LIMITS).awaitTermination()
    want = batch_totals(signals.sale_events(batch))
    _same(keyed.running_sums(spark, f"{tmp_path}/cp").select(*want.columns), want)


def _without_prices(rows):
    """Every fourth sale, and all of one ticker, without a price."""
    return [
        (*r[:5], None if i % 4 == 1 or r[2] == "c0" else r[5], *r[6:]) for i, r in enumerate(rows)
    ]


def _events_without_prices(spark, path):
    """Sales, listings and both as four files of events in the order of time."""
    rows = _without_prices(_sales())
    sales = spark.createDataFrame(rows, SALE).withColumn("market_key", market_key())
    listings = spark.createDataFrame(_listings(), LISTING).withColumn("market_key", market_key())
    events = signals.market_events(sales, listings)
    rows = [tuple(r) for r in events.orderBy("ts", "kind_rank", "event_id").collect()]
    _write_parts(spark, rows, events.schema, path)
    reader = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1)
    return sales, listings, reader.parquet(path)


def test_flags_count_live_sales_without_a_price_as_a_batch_does(spark, tmp_path):
    sales, listings, events = _events_without_prices(spark, f"{tmp_path}/in")
    job = alerts.start_alerts(
        events, f"{tmp_path}/al", f"{tmp_path}/cp", None, LIMITS, f"{tmp_path}/fl"
    )
    job.awaitTermination()
    flags = spark.read.parquet(f"{tmp_path}/fl").drop("batch_id")
    assert flags.count() > 0
    _same(flags, signals.arbitrage_flags(sales, listings, LIMITS))


@pytest.mark.parametrize("live", [False, True])
def test_events_without_a_time_come_after_all_others(spark, live):
    at = [None, T0, None, T0 + dt.timedelta(hours=1)]
    rows = [(f"s{i}", "sim", "c", "NORMAL", "NM", Decimal(1), 1, t) for i, t in enumerate(at)]
    events = signals.sale_events(spark.createDataFrame(rows, SALE))
    width = alerts.SLICE_WIDTH if live else None
    scored = running.prior_stats(events, signals.TIE, slice_width=width).collect()
    assert {r.event_id: r.prior_count for r in scored} == {"s1": 0, "s3": 1, "s0": 2, "s2": 3}


def test_the_last_part_of_a_feed_holds_events_without_a_time(spark):
    from workload import stream_queries

    rows = [(i, None if i % 5 == 0 else T0 + dt.timedelta(hours=i)) for i in range(40)]
    feed = spark.createDataFrame(rows, "id int, ts timestamp")
    parts = [[r.id for r in p.collect()] for p in stream_queries._parts(feed, "ts")]
    assert sorted(sum(parts, [])) == list(range(40))
    assert [i for i, ids in enumerate(parts) for n in ids if n % 5 == 0] == [3] * 8


def test_a_micro_batch_is_computed_before_stages_share_it(spark, tmp_path, monkeypatch):
    """Stages that run side by side on several executors would each pass it through the state."""
    events = signals.sale_events(spark.createDataFrame(_sales(), SALE))
    names = {name: F.lit(None).cast(kind) for name, kind in running.SUMS}
    batch = events.withColumns({"opening": F.lit(False), **names}).repartition(3)
    cached = []

    def view(*args):
        for found in spark.sparkContext._jsc.sc().getRDDStorageInfo():
            cached.append(found.numCachedPartitions())
        return signals.alert_view(*args)

    monkeypatch.setattr(alerts, "alert_view", view)
    alerts.keyed_alert_sink(f"{tmp_path}/al", None, LIMITS)(batch, 0)
    assert 3 in cached


def test_running_sums_tell_tickers_that_sold_without_a_price(spark, tmp_path):
    sales, _, events = _events_without_prices(spark, f"{tmp_path}/in")
    alerts.start_alerts(events, f"{tmp_path}/al", f"{tmp_path}/cp", None, LIMITS).awaitTermination()
    got = keyed.running_sums(spark, f"{tmp_path}/cp")
    want = batch_totals(signals.sale_events(sales))
    assert want.filter("prior_count = 0 AND prior_sum IS NULL").count() == 1
    _same(got.select(*want.columns), want)


@pytest.fixture(params=[None, sinks._IN_MEMORY], ids=["unset", "default"])
def bare(spark, request):
    """A session with Spark's own state store, which has no keyed state; jobs leave it so."""
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", "UTC")
    if request.param:
        session.conf.set(STATE_STORE, request.param)
    else:
        session.conf.unset(STATE_STORE)
    before = session.conf.get(STATE_STORE, None)
    assert before != ROCKSDB
    yield session
    assert session.conf.get(STATE_STORE, None) == before
    assert session.conf.get(sinks._EMPTY_BATCHES, None) is None


def test_trailing_windows_run_in_a_session_without_their_store(bare, tmp_path):
    _write_parts(bare, _sales(), SALE, f"{tmp_path}/in")
    live = _stream(bare, f"{tmp_path}/in", SALE)
    writer = sinks.batch_writer(f"{tmp_path}/out")
    job = sinks.start(stream_windows(live, "MA_24H"), writer, f"{tmp_path}/cp")
    job.awaitTermination()
    got = tables.read_log(bare, f"{tmp_path}/out", PRICE_WINDOW).drop("batch_id")
    sales = bare.createDataFrame(_sales(), SALE).withColumn("market_key", market_key())
    last = sales.agg(F.max("sold_at")).first()[0]
    batch = windows.windowed_aggregates(sales, ("MA_24H",)).filter(F.col("window_end") <= last)
    _same(got, batch.select(*got.columns))


def test_keyed_alerts_run_in_a_session_without_their_store(bare, tmp_path):
    path = f"{tmp_path}/in"
    sales, listings, reader = _live_events(bare, path)
    job = alerts.start_alerts(
        reader.parquet(path), f"{tmp_path}/al", f"{tmp_path}/cp", None, LIMITS, f"{tmp_path}/fl"
    )
    job.awaitTermination()
    columns = ["type", "severity", "card_id", "market_key", "ts"]
    got = tables.read_alerts(bare, f"{tmp_path}/al")
    want = signals.market_alerts(sales, listings, LIMITS)
    assert {r.type for r in want.collect()} == {"SPIKE", "ARBITRAGE"}
    _same(got.select(*columns), want.select(*columns))
    flags = bare.read.parquet(f"{tmp_path}/fl").drop("batch_id")
    _same(flags, signals.arbitrage_flags(sales, listings, LIMITS))
    sums = keyed.running_sums(bare, f"{tmp_path}/cp")
    counts = sales.groupBy("market_key").agg(F.count("price").alias("prior_count"))
    _same(sums.select("market_key", "prior_count"), counts)


def test_market_state_runs_in_a_session_without_its_store(bare, tmp_path):
    _write_parts(bare, _sales(), SALE, f"{tmp_path}/in")
    live = _stream(bare, f"{tmp_path}/in", SALE)
    snapshot.start_state(live, f"{tmp_path}/cp").awaitTermination()
    sales = bare.createDataFrame(_sales(), SALE).withColumn("market_key", market_key())
    _same(keyed.market_state(bare, f"{tmp_path}/cp"), stats.market_snapshot(sales))
