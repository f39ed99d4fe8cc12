"""Structured Streaming jobs run over the test tables until they are drained."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketpulse.operators import signals
from marketpulse.session import shared_dir
from marketpulse.sources import tables
from marketpulse.sources.tables import read_log
from marketpulse.schemas import ALERT, PRICE_WINDOW
from marketpulse.streaming import alerts, ingest, keyed, sinks, snapshot, windows
from workload.checks import windows_sql
from workload.registry import query
from workload.tables import as_of, catalogue, products, rounded
from workload.views import Feeds

_WINDOW = (
    "market_key, card_id, window_type, window_start, window_end, avg_price, volatility, volume, "
    "sample_count"
)


def _live(f: Feeds) -> Feeds:
    return Feeds(f.spark, f.sf_dir, streaming=True)


def _stream_windows(kind: str):
    def run(f):
        base = shared_dir(f.spark, "stream")
        rows = windows.stream_windows(_live(f).sales, kind)
        out, state = f"{base}/out", f"{base}/state"
        sinks.start(rows, sinks.batch_writer(out), state).awaitTermination()
        return rounded(read_log(f.spark, out, PRICE_WINDOW).drop("batch_id"))

    return run


for _kind in ("HOURLY", "DAILY", "MA_24H"):
    query(
        f"stream_{_kind.lower()}",
        "settled_windows",
        f"SELECT {_WINDOW} FROM settled_windows WHERE window_type = '{_kind}'",
    )(_stream_windows(_kind))


BATCHES = 4


def _parts(df, ts: str):
    """All rows of ``df`` in parts of about equal size, in the order of ``ts``; nulls come last."""
    micros = df.select(F.unix_micros(ts).cast("double").alias("t"))
    shares = [i / BATCHES for i in range(1, BATCHES)]
    cuts = micros.filter("t IS NOT NULL").approxQuantile("t", shares, 0.01)
    number = sum((F.coalesce(F.unix_micros(ts) >= int(c), F.lit(True)).cast("int") for c in cuts), F.lit(0))
    marked = df.withColumn("_batch", number)
    return [marked.filter(F.col("_batch") == i).drop("_batch") for i in range(BATCHES)]


def _deliver(part, folder: str) -> None:
    part.coalesce(1).write.mode("append").parquet(folder)


def _feed(f: Feeds, schema, folder: str):
    """The files of a folder as a stream, one a micro-batch, by age."""
    reader = f.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    return reader.parquet(folder)


def _in_batches(f: Feeds, df, ts: str, folder: str):
    """All rows of ``df`` as a stream of four micro-batches in the order of ``ts``."""
    for part in _parts(df, ts):
        _deliver(part, folder)
    return _feed(f, df.schema, folder)


def _stream_alerts(f):
    """Four micro-batches in the order of time; the job goes on from where it was after each."""
    base = shared_dir(f.spark, "stream")
    given = signals.market_events(f.sales, f.listings)
    catalogue(f).metadata.write.parquet(f"{base}/metadata")
    for part in _parts(given, "ts"):
        part.write.mode("append").parquet(f"{base}/in")
        live = alerts.start_alerts(
            f.spark.readStream.schema(given.schema).parquet(f"{base}/in"),
            f"{base}/alerts",
            f"{base}/state",
            lambda: f.spark.read.parquet(f"{base}/metadata"),
            flags_path=f"{base}/flags",
        )
        live.awaitTermination()
    return base


def _alert_sql(kind: str) -> str:
    return f"""SELECT type, severity, card_id, market_key, name, ts FROM alerts
               WHERE type = '{kind}'"""


@query("stream_spikes", "alerts", _alert_sql("SPIKE"))
def stream_spikes(f):
    found = tables.read_alerts(f.spark, f"{_stream_alerts(f)}/alerts").filter("type = 'SPIKE'")
    return found.select("type", "severity", "card_id", "market_key", "name", "ts")


@query("stream_arbitrage", "alerts", _alert_sql("ARBITRAGE"))
def stream_arbitrage(f):
    found = tables.read_alerts(f.spark, f"{_stream_alerts(f)}/alerts")
    found = found.filter("type = 'ARBITRAGE'")
    return found.select("type", "severity", "card_id", "market_key", "name", "ts")


@query(
    "stream_flags",
    "flags",
    """SELECT event_id, market_key, seller_id, listing_price, reference_avg, discount_pct,
              sample_count, detected_at FROM flags""",
)
def stream_flags(f):
    found = f.spark.read.parquet(f"{_stream_alerts(f)}/flags")
    return found.select(
        "event_id", "market_key", "seller_id", "listing_price", "reference_avg", "discount_pct",
        "sample_count", "detected_at",
    )


@query(
    "state_running_sums",
    "sales",
    """SELECT market_key, count(price) AS prior_count,
              CAST(sum(price) AS DOUBLE) AS prior_sum,
              CAST(sum(price * price) AS DOUBLE) AS prior_sq_sum
       FROM sales GROUP BY market_key""",
)
def state_running_sums(f):
    return keyed.running_sums(f.spark, f"{_stream_alerts(f)}/state")


@query(
    "state_snapshot",
    "snapshot",
    """SELECT market_key, card_id, finish, condition, last_price, last_trade_at, avg_price,
              volatility, volume, sample_count FROM snapshot""",
)
def state_snapshot(f):
    base = shared_dir(f.spark, "stream")
    sales = _in_batches(f, f.sales, "sold_at", f"{base}/in")
    snapshot.start_state(sales, f"{base}/state").awaitTermination()
    return rounded(keyed.market_state(f.spark, f"{base}/state"))


@query(
    "stream_snapshot",
    "snapshot",
    """SELECT market_key, card_id, finish, condition, last_price, last_trade_at, avg_price,
              volatility, volume, sample_count FROM snapshot""",
)
def stream_snapshot(f):
    base = shared_dir(f.spark, "stream")
    sales = _in_batches(f, f.sales, "sold_at", f"{base}/in")
    snapshot.start_snapshot(sales, f"{base}/out", f"{base}/state").awaitTermination()
    return rounded(tables.read_snapshot(f.spark, f"{base}/out"))


def _stream_ingest(f, base: str, listings: bool = True):
    """Raw feeds, in micro-batches, to the clean tables under ``base``."""
    listed = _in_batches(f, f.raw_listings, "listed_at", f"{base}/listed") if listings else None
    sold = _in_batches(f, f.raw_sales, "sold_at", f"{base}/sold")
    _run_ingest(f, base, listed, sold)
    return f"{base}/out"


def _run_ingest(f, base: str, listed, sold) -> None:
    rows = ingest.ingest_stream(listed, sold, products(f), "sim")
    cards = catalogue(f).cards
    sink = ingest.validating_sink(f"{base}/out", lambda: cards, as_of())
    sinks.start(rows, sink, f"{base}/state").awaitTermination()


@query("stream_dedup", "polled", "SELECT DISTINCT source, event_id FROM polled WHERE feed = 'sale'")
def stream_dedup(f):
    out = _stream_ingest(f, shared_dir(f.spark, "stream"), listings=False)
    return f.spark.read.parquet(f"{out}/seen").select("source", "event_id")


@query(
    "stream_ingest",
    "judged",
    """SELECT event_id, feed, card_id, quantity, ts, reject_reason FROM judged""",
)
def stream_ingest(f):
    out = _stream_ingest(f, shared_dir(f.spark, "stream"))
    columns = ["event_id", "feed", "card_id", "quantity", "ts", "reject_reason"]
    frames = [f.spark.read.parquet(f"{out}/quarantine").select(*columns)]
    for feed, ts in (("sale", "sold_at"), ("listing", "listed_at")):
        clean = ingest.clean_table(f.spark, out, feed)
        frames.append(
            clean.withColumns(
                {"feed": F.lit(feed), "ts": F.col(ts), "reject_reason": F.lit(None).cast("string")}
            ).select(*columns)
        )
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query(
    "stream_pipeline",
    "judged",
    f"""SELECT * FROM (WITH clean AS (
          SELECT concat(card_id, '|', finish, '|', condition) AS market_key,
                 CAST(price_raw AS DECIMAL(12,2)) AS price, quantity, ts AS sold_at
          FROM judged WHERE reject_reason IS NULL AND feed = 'sale')
        SELECT market_key, window_start, window_end, avg_price, volume, sample_count
        FROM ({windows_sql("clean", "HOURLY")}) w
        WHERE window_end <= (SELECT max(sold_at) FROM clean)) closed""",
)
def stream_pipeline(f):
    """Raw feeds to clean tables, and the clean sales, as a stream again, to closed windows."""
    base = shared_dir(f.spark, "stream")
    deliveries = zip(_parts(f.raw_listings, "listed_at"), _parts(f.raw_sales, "sold_at"))
    for listed, sold in deliveries:  # both jobs go on from where they were
        _deliver(listed, f"{base}/listed")
        _deliver(sold, f"{base}/sold")
        _run_ingest(
            f, base, _feed(f, listed.schema, f"{base}/listed"), _feed(f, sold.schema, f"{base}/sold")
        )
        sales = ingest.clean_table(f.spark, f"{base}/out", "sale", live=True)
        rows = windows.stream_windows(sales, "HOURLY")
        sinks.start(rows, sinks.batch_writer(f"{base}/pw"), f"{base}/pw-state").awaitTermination()
    found = read_log(f.spark, f"{base}/pw", PRICE_WINDOW)
    return found.select(
        "market_key", "window_start", "window_end", "avg_price", "volume", "sample_count"
    )
