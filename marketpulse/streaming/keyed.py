"""Keyed processors with their state in Spark's state store, and readers of that state.

State lives with the checkpoint of its query: a batch that is run again starts from the state
before it, nothing but touched keys is written, and keys are looked up one by one, so a batch
costs what it holds, however long the job has run. A key is a slice of a ticker: events are
dealt over slices by a hash of their id, so a ticker that trades a third of all rows is
spread too, and the slices' sums are added where they are read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from datetime import timedelta
from decimal import Decimal

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from marketpulse.operators.running import SUMS
from marketpulse.operators.stats import packed_sale, snapshot_view, unpacked_sale
from marketpulse.schemas import MONEY, PRICE_SQ_SUM, PRICE_SUM
from marketpulse.session import importable

SLICES = 4
_HOUR_MS = 60 * 60 * 1000
#: Hours of a trailing window.
SPAN = 24
_PRIOR = [
    T.StructField("prior_count", T.LongType()),
    T.StructField("prior_sum", PRICE_SUM),
    T.StructField("prior_sq_sum", PRICE_SQ_SUM),
]
#: Sums over the sales with a price, and the number of those without.
_RUNNING = T.StructType([*_PRIOR, T.StructField("unpriced", T.LongType())])
_OPENING = T.StructType([T.StructField("market_key", T.StringType()), *_PRIOR])
_OPENED = Row(*_OPENING.names)
_SLICE = T.StructField("slice", T.IntegerType())
#: Partial sums that a task holds before it passes them on.
_HELD = 200_000
_MARKET = T.StructType(
    [
        T.StructField("sample_count", T.LongType()),
        T.StructField("price_sum", PRICE_SUM),
        T.StructField("price_sq_sum", PRICE_SQ_SUM),
        T.StructField("volume", T.LongType()),
        T.StructField("last_micros", T.LongType()),
        T.StructField("last_price", MONEY),
    ]
)

_SUMS = [
    T.StructField("sample_count", T.LongType()),
    T.StructField("price_sum", PRICE_SUM),
    T.StructField("price_sq_sum", PRICE_SQ_SUM),
    T.StructField("volume", T.LongType()),
]
_PANE = T.StructType([T.StructField("hour", T.LongType()), *_SUMS])
_RING = T.StructType(
    [T.StructField("given", T.LongType()), T.StructField("panes", T.ArrayType(_PANE))]
)
_RUN = T.StructType(
    [
        T.StructField("market_key", T.StringType()),
        T.StructField("first_end", T.LongType()),
        T.StructField("last_end", T.LongType()),
        *_SUMS,
    ]
)


def slice_of(column: str = "event_id", slices: int = SLICES) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(slices)).cast("int").alias("slice")


def _millis(span: timedelta | None) -> int | None:
    return None if span is None else max(1, int(span.total_seconds() * 1000))


class _Keyed(StatefulProcessor):
    """One value of state per key, forgotten ``ttl`` milliseconds after its last update."""

    name: str
    layout: T.StructType

    def __init__(self, ttl: int | None = None):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState(self.name, self.layout, self.ttl)

    def close(self) -> None:
        pass


class RunningSums(_Keyed):
    """Adds partial sums to those of a ticker's slice, and gives the sums before them.

    These count all sales, as a batch does; the state tells sales without a price apart.
    """

    name, layout = "sums", _RUNNING

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.state.get() if self.state.exists() else None
        n, total, squares, unpriced = before or (0, Decimal(0), Decimal(0), 0)
        if before:
            yield _OPENED(key[0], n + unpriced, total, squares)
        counted = False
        for row in rows:
            if row["prior_count"] or row["unpriced"]:
                n, total = n + row["prior_count"], total + row["prior_sum"]
                squares, unpriced = squares + row["prior_sq_sum"], unpriced + row["unpriced"]
                counted = True
        if counted:
            self.state.update((n, total, squares, unpriced))


class MarketState(_Keyed):
    """Sums, volume and the newest sale of a ticker's slice; gives no rows."""

    name, layout = "market", _MARKET

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n, total, squares, volume, last, price = (
            self.state.get()
            if self.state.exists()
            else (0, Decimal(0), Decimal(0), 0, None, None)
        )
        for row in rows:
            p, at = row["price"], row["sold_micros"]
            volume += max(row["quantity"] or 0, 0)
            if p is None:
                continue
            n, total, squares = n + 1, total + p, squares + p * p
            # Of sales at one instant the dearest is the newest, as in a batch.
            if at is not None and (last is None or (at, p) > (last, price)):
                last, price = at, p
        self.state.update((n, total, squares, volume, last, price))
        return iter(())


class TrailingRing(_Keyed):
    """Closed hourly panes of a ticker, at most 24, and the last window end it has given.

    Gives runs of trailing windows with equal sums, by the hour numbers of their first and
    last end. A timer at the next end wakes a ticker that trades no more; a ticker whose last
    pane has left all its windows is forgotten.
    """

    name, layout = "ring", _RING

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r["hour"], *[r[f.name] or 0 for f in _SUMS]) for r in rows]
        return self._close(key[0], new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self._close(key[0], [], timerValues.getCurrentWatermarkInMs())

    def _close(self, market_key: str, new: list[tuple], watermark: int) -> Iterator[Row]:
        given, old = self.state.get() if self.state.exists() else (None, [])
        panes = sorted([*[tuple(p) for p in old], *new])
        if not panes:
            return
        now = watermark // _HOUR_MS
        begin = panes[0][0] + 1 if given is None else given + 1
        yield from trailing_runs(market_key, panes, begin, now)
        kept = [p for p in panes if p[0] + SPAN > now]
        if kept:
            self.state.update((max(now, begin - 1), kept))
            ahead = max(now, panes[-1][0]) + 1
            self.handle.registerTimer(ahead * _HOUR_MS)
        else:
            self.state.clear()


def trailing_runs(market_key: str, panes: list[tuple], begin: int, end: int) -> Iterator[Row]:
    """Runs of window ends from ``begin`` to ``end``; panes by hour number, in order.

    A pane enters with the window that ends with its hour and leaves after 24 ends.
    """
    out = Row(*_RUN.names)
    hours = [p[0] for p in panes]
    turns = {h + k for h in hours for k in (1, SPAN + 1)}
    cuts = sorted({begin, end + 1, *[t for t in turns if begin < t <= end]})
    for first, after in zip(cuts, cuts[1:]):
        inside = panes[bisect_left(hours, first - SPAN) : bisect_left(hours, first)]
        sums = [sum(values) for values in zip(*[p[1:] for p in inside])]
        if sums and sums[0] > 0:
            yield out(market_key, first, after - 1, *sums)


def trailing_windows(panes: DataFrame) -> DataFrame:
    """Closed 24-hour windows from a stream of closed hourly panes, for append mode.

    ``panes`` has one row per (``market_key``, ``window``) with its sums and a watermark. A
    ticker keeps its panes once instead of in 24 windows each, and Python sees a row per pane
    and gives one per run of equal windows; Spark spreads runs over their windows.
    """
    importable(panes.sparkSession)
    hour = F.floor(F.unix_millis("window.start") / F.lit(_HOUR_MS)).cast("long").alias("hour")
    at = F.window_time("window").alias("at")
    rows = panes.select("market_key", at, hour, *[f.name for f in _SUMS])
    keyed = rows.groupBy("market_key")
    runs = keyed.transformWithState(TrailingRing(), _RUN, "Append", "EventTime")
    ends = runs.withColumn("_end", F.explode(F.sequence("first_end", "last_end")))
    second = lambda hours: F.timestamp_seconds((F.col("_end") + hours) * 3600)
    span = F.struct(second(-SPAN).alias("start"), second(0).alias("end")).alias("w")
    return ends.select("market_key", span, *[f.name for f in _SUMS])


def _partial_sums(events: DataFrame, slices: int) -> DataFrame:
    """A task's sums per ticker and slice; all slices of a ticker it meets, empty ones too."""
    price = F.when(F.col("counted"), F.col("price")).alias("price")
    unpriced = F.when(F.col("counted") & F.col("price").isNull(), F.lit(1)).otherwise(F.lit(0))
    unpriced = unpriced.cast("long").alias("unpriced")
    out = T.StructType([_OPENING["market_key"], _SLICE, *_RUNNING.fields])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = arrow.empty_table()
        for batch in batches:
            held = added(pa.concat_tables([held, first(batch)]))
            if held.num_rows > _HELD:
                yield from held.to_batches()
                held = arrow.empty_table()
        yield from held.to_batches()

    def first(batch: pa.RecordBatch) -> pa.Table:
        prices = batch.column("price")
        one = pc.cast(pc.is_valid(prices), pa.int64())
        prices = pc.fill_null(prices, Decimal(0))
        squares = pc.multiply(prices, prices)
        keys = pc.unique(batch.column("market_key"))
        n = len(keys) * slices
        asked = [
            pa.concat_arrays([keys] * slices),
            pa.array([i // len(keys) for i in range(n)], pa.int32()),
            *[pa.array([0] * n, f.type) for f in list(arrow)[2:]],
        ]
        events = [batch.column("market_key"), batch.column("slice"), one, prices, squares]
        events.append(batch.column("unpriced"))
        events = [column.cast(f.type) for column, f in zip(events, arrow)]
        return pa.concat_tables([pa.table(part, schema=arrow) for part in (events, asked)])

    def added(rows: pa.Table) -> pa.Table:
        keys, sums = arrow.names[:2], arrow.names[2:]
        table = rows.group_by(keys).aggregate([(name, "sum") for name in sums])
        columns = [table.column(n) for n in (*keys, *[f"{name}_sum" for name in sums])]
        return pa.table([column.cast(f.type) for column, f in zip(columns, arrow)], schema=arrow)

    rows = events.select("market_key", slice_of(slices=slices), price, unpriced)
    return rows.mapInArrow(run, out)


def with_openings(
    events: DataFrame, slices: int = SLICES, idle: timedelta | None = None
) -> DataFrame:
    """Market events as they are, and rows with the earlier sums of each touched ticker.

    ``opening`` tells these rows, one per slice, apart. Only sums pass through the state,
    added up in the map tasks; both sides read the same offsets in a micro-batch. A slice that
    nothing was counted in for ``idle``, in processing time, starts again from nothing; without
    it sums are kept for good.
    """
    importable(events.sparkSession)
    keyed = _partial_sums(events, slices).groupBy("market_key", "slice")
    times = "ProcessingTime" if idle else "None"
    earlier = keyed.transformWithState(RunningSums(_millis(idle)), _OPENING, "Update", times)
    nothing = {f.name: F.lit(None).cast(f.dataType) for f in _PRIOR}
    plain = events.withColumns({"opening": F.lit(False), **nothing})
    return plain.unionByName(earlier.withColumn("opening", F.lit(True)), allowMissingColumns=True)


def keep_market_state(sales: DataFrame, slices: int = SLICES) -> DataFrame:
    """A stream without rows that keeps the market state; read it with ``market_state``."""
    importable(sales.sparkSession)
    micros = F.unix_micros("sold_at").alias("sold_micros")
    rows = sales.select("market_key", "price", "quantity", micros, slice_of(slices=slices))
    keyed = rows.groupBy("market_key", "slice")
    return keyed.transformWithState(MarketState(), "market_key string", "Update", "None")


def _state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    reader = spark.read.format("statestore").option("stateVarName", name)
    return reader.load(checkpoint).select("key.*", "value.*")


def running_sums(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Sums per ticker as of the last batch of a query over ``with_openings``.

    Over the sales with a price; a ticker without any has a count of 0 and null sums.
    """
    sums = sum_openings(_state(spark, checkpoint, RunningSums.name))
    priced = F.col("prior_count") > 0
    return sums.withColumns({f.name: F.when(priced, F.col(f.name)) for f in _PRIOR[1:]})


def sum_openings(rows: DataFrame) -> DataFrame:
    """Sums per ticker from those of its slices."""
    return rows.groupBy("market_key").agg(*[F.sum(n).cast(t).alias(n) for n, t in SUMS])


def market_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Current market state per ticker, read from the state of ``keep_market_state``."""
    rows = _state(spark, checkpoint, MarketState.name)
    newest = F.max(packed_sale(F.col("last_micros"), F.col("last_price"))).alias("_last")
    sums = [F.sum(f.name).cast(f.dataType).alias(f.name) for f in _MARKET.fields[:4]]
    return snapshot_view(unpacked_sale(rows.groupBy("market_key").agg(*sums, newest)))
