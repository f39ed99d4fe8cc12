"""Live ingest: raw feed records to clean and quarantine tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketpulse.functions.keys import market_key
from marketpulse.operators import normalize, quality
from marketpulse.plans.ingest import DELIVERY_ORDER, as_feed
from marketpulse.schemas import LISTING, SALE, ValidationLimits
from marketpulse.streaming.sinks import write_batch

DEDUP_HORIZON = timedelta(hours=1)
#: Slices of arrival time in a horizon.
SLICES = 12
_TIMES = {"sale": "sold_at", "listing": "listed_at"}
_LAYOUTS = {"sale": SALE, "listing": LISTING}
_SEEN = "source string, event_id string, seen_at timestamp, slice long, batch_id long"


def ingest_stream(
    raw_listings: DataFrame | None,
    raw_sales: DataFrame | None,
    products: DataFrame,
    source: str | None = None,
) -> DataFrame:
    """Resolved events of both feeds with their ``drop_reason``, for :func:`validating_sink`."""
    parts = []
    for raw, feed in ((raw_listings, "listing"), (raw_sales, "sale")):
        if raw is not None:
            resolved = normalize.resolve(raw, products, source)
            parts.append(as_feed(resolved, feed, keep=("drop_reason",)))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


class SeenIds:
    """Ids of delivered events, in folders by slice of their arrival and batch.

    A batch opens the slices that its horizon reaches and no others, and removes those that
    no horizon reaches any more, so what a batch reads does not grow with the job's age. The
    time of a batch is fixed when it first runs; run again, it judges the same ids.
    """

    def __init__(self, spark: SparkSession, path: str, horizon: timedelta = DEDUP_HORIZON):
        self.spark, self.path, self.horizon = spark, path, horizon
        self.width = max(1.0, horizon.total_seconds() / SLICES)
        self.folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.files = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def _slices(self) -> dict[int, str]:
        if not self.files.exists(self.folder):
            return {}
        names = [s.getPath().getName() for s in self.files.listStatus(self.folder)]
        return {int(n.split("=")[1]): f"{self.path}/{n}" for n in names if n.startswith("slice=")}

    def time_of(self, batch_id: int, now: dt.datetime) -> dt.datetime:
        """When the batch first ran, or ``now``."""
        for folder in self._slices().values():
            own = f"{folder}/batch_id={batch_id}"
            if self.files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{own}/_SUCCESS")):
                found = self.spark.read.schema("seen_at timestamp").parquet(own)
                micros = found.agg(F.max(F.unix_micros("seen_at"))).first()[0]
                if micros is not None:
                    return dt.datetime.fromtimestamp(micros / 1e6, dt.timezone.utc)
        return now

    def before(self, batch_id: int, at: dt.datetime) -> DataFrame:
        """(source, event_id) seen by earlier batches within the horizon before ``at``."""
        begin = at - self.horizon
        first = int(begin.timestamp() // self.width)
        open_ = [folder for n, folder in sorted(self._slices().items()) if n >= first]
        reader = self.spark.read.schema(_SEEN).option("basePath", self.path)
        rows = reader.parquet(*open_) if open_ else self.spark.createDataFrame([], _SEEN)
        kept = (F.col("batch_id") < batch_id) & (F.col("seen_at") >= F.lit(begin))
        return rows.filter(kept).select("source", "event_id")

    def add(self, ids: DataFrame, batch_id: int, at: dt.datetime) -> None:
        own = int(at.timestamp() // self.width)
        stamped = ids.withColumn("seen_at", F.lit(at).cast("timestamp"))
        write_batch(stamped, f"{self.path}/slice={own}", batch_id)
        for n, folder in self._slices().items():
            if n < own - SLICES - 1:  # a slice more than any horizon reaches
                self.files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(folder), True)


def first_deliveries(
    batch: DataFrame, batch_id: int, seen_path: str, horizon: timedelta = DEDUP_HORIZON
) -> DataFrame:
    """The first delivery of each event in the batch that no batch within ``horizon`` had.

    Within a batch listings come before sales and then the order of arrival counts, as in a
    batch run. Ids are logged by batch; a batch run again leaves its own ids out of account.
    The horizon runs on arrival: on event time a single future-dated record would push it
    ahead. A redelivery after it counts as new.
    """
    seen = SeenIds(batch.sparkSession, seen_path, horizon)
    at = seen.time_of(batch_id, dt.datetime.now(dt.timezone.utc))
    first = quality.dedup_events(batch, DELIVERY_ORDER)
    first = first.join(seen.before(batch_id, at), ["source", "event_id"], "left_anti")
    seen.add(first.select("source", "event_id"), batch_id, at)
    return first


def validating_sink(
    path: str,
    cards: Callable[[], DataFrame],
    as_of: Column | None = None,
    limits: ValidationLimits = ValidationLimits(),
    horizon: timedelta = DEDUP_HORIZON,
) -> Callable[[DataFrame, int], None]:
    """Sink that drops redeliveries and validates against the catalogue as it is at each batch.

    One read, several tables under ``path``: ``sale`` and ``listing`` with the accepted rows
    and their ``market_key``, ``quarantine`` with the rejected rows and their reason,
    ``counts`` with rows per source, feed and outcome (dropped rows too), and ``seen``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        now = F.current_timestamp() if as_of is None else as_of
        events = batch.persist()
        dropped = events.filter("drop_reason IS NOT NULL")
        kept = events.filter("drop_reason IS NULL").drop("drop_reason")
        fresh = first_deliveries(kept, batch_id, f"{path}/seen", horizon)
        checked = quality.with_reject_reason(fresh, cards(), now, "ts", limits).persist()
        try:
            priced = normalize.with_price(quality.accepted(checked))
            for feed, layout in _LAYOUTS.items():
                rows = priced.filter(F.col("feed") == feed).withColumn(_TIMES[feed], F.col("ts"))
                rows = rows.select(*layout.names).withColumn("market_key", market_key())
                write_batch(rows, f"{path}/{feed}", batch_id, once=True)
            write_batch(quality.quarantine(checked), f"{path}/quarantine", batch_id)
            outcomes = quality.outcome_counts(checked).unionByName(
                quality.outcome_counts(dropped.withColumnRenamed("drop_reason", "reject_reason"))
            )
            write_batch(outcomes, f"{path}/counts", batch_id)
        finally:
            checked.unpersist()
            events.unpersist()

    return write


def clean_table(spark: SparkSession, path: str, feed: str, live: bool = False, **options) -> DataFrame:
    """Accepted rows of a feed as :func:`validating_sink` wrote them, as a table or a stream."""
    schema = T.StructType([*_LAYOUTS[feed].fields, T.StructField("market_key", T.StringType())])
    reader = spark.readStream if live else spark.read
    return reader.schema(schema).options(**options).parquet(f"{path}/{feed}/batch_id=*")


def corrupt_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Sink for parsed lines that keeps the text of the unreadable ones."""

    def write(batch: DataFrame, batch_id: int) -> None:
        lines = batch.filter(F.col("corrupt_line").isNotNull()).select("corrupt_line")
        write_batch(lines, path, batch_id)

    return write
