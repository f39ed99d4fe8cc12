"""Live spike and arbitrage alerts.

Each micro-batch runs the batch detector with the ticker sums of all earlier batches as
its opening balance. A hot ticker is thus spread inside a micro-batch too, instead of
passing row by row through the one task that owns its key.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from marketpulse.operators import alerts as alert_ops
from marketpulse.operators.merge import last_per_key
from marketpulse.operators.running import SUMS, add_totals, batch_totals, prior_stats
from marketpulse.operators.signals import TIE, alert_view, flag_view, is_arbitrage, is_spike
from marketpulse.schemas import RUNNING_STATE, Thresholds
from marketpulse.streaming.keyed import sum_openings, with_openings
from marketpulse.streaming.sinks import start, write_batch

#: Batches after which the sums of all tickers are folded into one folder.
FOLD_EVERY = 64
_LOGGED = T.StructType([*RUNNING_STATE.fields, T.StructField("batch_id", T.LongType())])


def alert_sink(
    alerts_path: str,
    state_path: str,
    metadata: Callable[[], DataFrame] | None = None,
    limits: Thresholds = Thresholds(),
    flags_path: str | None = None,
    fold_every: int = FOLD_EVERY,
) -> Callable[[DataFrame, int], None]:
    """Sink for a stream of market events (see ``signals.market_events``).

    A batch writes the new sums of the tickers it touches, and nothing of others, to a log;
    every ``fold_every`` batches the log and the last fold become a new fold. Batch N reads
    the fold before it and the log since, so running it again gives the same rows and sums.
    ``metadata`` is read anew for each batch; ``flags_path`` takes the arbitrage flags.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        events = batch.persist()
        try:
            state = carry = None
            if batch_id > 0:
                state = sums_before(spark, state_path, batch_id, fold_every)
                carry = last_per_key(
                    state.join(events.select("market_key"), "market_key", "left_semi"),
                    ["market_key"], ["batch_id"],
                ).drop("batch_id")
            scored = prior_stats(events, TIE, carry=carry)
            found = alert_view(scored, limits)
            if metadata is not None:
                found = alert_ops.enrich(found, metadata())
            write_batch(found, alerts_path, batch_id, ("severity",))
            if flags_path is not None:
                write_batch(flag_view(scored.filter(is_arbitrage(limits))), flags_path, batch_id)
            totals = batch_totals(events)
            totals = totals if carry is None else add_totals(carry, totals)
            write_batch(totals, f"{state_path}/log", batch_id)
            if batch_id > 0 and batch_id % fold_every == 0:
                log = sums_before(spark, state_path, batch_id + 1, fold_every, batch_id - 1)
                fold = last_per_key(log, ["market_key"], ["batch_id"]).drop("batch_id")
                write_batch(fold, f"{state_path}/fold", batch_id)
        finally:
            events.unpersist()

    return write


def sums_before(
    spark: SparkSession, path: str, batch_id: int, fold_every: int, newest: int | None = None
) -> DataFrame:
    """Sums with the ``batch_id`` that wrote them, from the last fold and the log since.

    The fold is the last one before ``batch_id``, or at most ``newest`` where that is given.
    """
    last = batch_id - 1 if newest is None else newest
    fold = last // fold_every * fold_every
    read = spark.read.schema(_LOGGED)
    parts = [f"{path}/log/batch_id={i}" for i in range(fold + 1 if fold else 0, batch_id)]
    log = read.option("basePath", f"{path}/log").parquet(*parts)
    if not fold:
        return log
    folded = read.option("basePath", f"{path}/fold").parquet(f"{path}/fold/batch_id={fold}")
    return folded.unionByName(log)


#: Event time of a ticker that one task scores at once.
SLICE_WIDTH = timedelta(minutes=1)


def keyed_alert_sink(
    alerts_path: str,
    metadata: Callable[[], DataFrame] | None = None,
    limits: Thresholds = Thresholds(),
    flags_path: str | None = None,
) -> Callable[[DataFrame, int], None]:
    """Sink for ``keyed.with_openings``: the slices' earlier sums come with the events.

    A micro-batch is evaluated once, and its hits once for alerts and flags. Nothing is
    written but these.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        events = rows.filter("NOT opening").drop("opening", *[name for name, _ in SUMS])
        carry = sum_openings(rows.filter("opening"))
        scored = prior_stats(events, TIE, carry=carry, slice_width=SLICE_WIDTH)
        hits = scored.filter(is_spike(limits) | is_arbitrage(limits)).persist()
        try:
            # Two stages read these rows; on several executors each would compute them.
            rows.count()
            found = alert_view(hits, limits)
            if metadata is not None:
                found = alert_ops.enrich(found, metadata())
            write_batch(found, alerts_path, batch_id, ("severity",))
            if flags_path is not None:
                write_batch(flag_view(hits.filter(is_arbitrage(limits))), flags_path, batch_id)
        finally:
            hits.unpersist()
            rows.unpersist()

    return write


def start_alerts(
    events: DataFrame,
    alerts_path: str,
    checkpoint: str,
    metadata: Callable[[], DataFrame] | None = None,
    limits: Thresholds = Thresholds(),
    flags_path: str | None = None,
    idle: timedelta | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """Spike and arbitrage alerts of a stream of market events, with sums in keyed state.

    ``idle`` needs ``every``: while sums can run out, Spark goes on with batches without rows,
    and a job that is to work off what is there would never end.
    """
    if idle is not None and every is None:
        raise ValueError("idle needs a trigger interval")
    sink = keyed_alert_sink(alerts_path, metadata, limits, flags_path)
    return start(with_openings(events, idle=idle), sink, checkpoint, mode="update", every=every)
