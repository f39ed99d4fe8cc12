"""Raw listing and sale feeds.

A feed is lines of JSON, from files or from a Kafka topic's value. Lines are read as
text and parsed here, because a JSON number such as ``12.5000`` loses its written scale
once a JSON reader has turned it into a value, and the validator needs that scale.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketpulse.functions.feed import iso_timestamp

log = logging.getLogger(__name__)

_COMMON = (
    "eventId long, productId long, skuId long, subTypeName string, condition string, "
    "price string, quantity int"
)
_LAYOUTS = {
    "listing": (_COMMON + ", sellerId string, listedAt string, _corrupt string", "listedAt"),
    "sale": (_COMMON + ", soldAt string, _corrupt string", "soldAt"),
}
# A price written as a number is quoted before the line is parsed, so that the parser finds
# the right member and keeps its text. Inside a JSON string the name's quotes are escaped.
_PRICE = r'("price"\s*:\s*)(-?[0-9][0-9.eE+-]*)(?=\s*[,}])'


def parse_lines(lines: DataFrame, kind: str, value: str = "value") -> DataFrame:
    """Parse text lines; ``corrupt_line`` holds the text of an unreadable one, else null."""
    schema, time_field = _LAYOUTS[kind]
    text = F.col(value).cast("string")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    record = F.from_json(F.regexp_replace(text, _PRICE, '$1"$2"'), schema, options)
    parsed = lines.select(text.alias("_line"), record.alias("r"))
    out = [
        F.col("r.eventId").alias("event_id"),
        F.col("r.productId").alias("product_id"),
        F.col("r.skuId").alias("sku_id"),
        F.col("r.subTypeName").alias("sub_type_name"),
        F.col("r.condition").alias("condition"),
        F.col("r.price").alias("price_raw"),
        # A missing number reads as zero and is rejected by the validator.
        F.coalesce("r.quantity", F.lit(0)).alias("quantity"),
    ]
    if kind == "listing":
        out.append(F.col("r.sellerId").alias("seller_id"))
    out.append(iso_timestamp(F.col(f"r.{time_field}")).alias(_snake(time_field)))
    broken = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    out.append(F.when(broken, F.col("_line")).alias("corrupt_line"))
    return parsed.select(*out)


def readable(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("corrupt_line").isNull()).drop("corrupt_line")


def corrupt(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("corrupt_line").isNotNull()).select("corrupt_line")


def read_raw_listings(spark: SparkSession, path: str) -> DataFrame:
    return readable(parse_lines(spark.read.text(path), "listing"))


def read_raw_sales(spark: SparkSession, path: str) -> DataFrame:
    return readable(parse_lines(spark.read.text(path), "sale"))


def stream_lines(
    spark: SparkSession,
    path: str | None = None,
    *,
    max_files_per_trigger: int | None = None,
    kafka: Mapping[str, str] | None = None,
) -> DataFrame:
    """Live lines from a folder, or from Kafka when its options are given.

    The Kafka connector is a separate Spark package and must be on the class path.
    """
    if kafka:
        return spark.readStream.format("kafka").options(**kafka).load().select("value")
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.text(path)


def since(
    events: DataFrame,
    ts: str,
    after: Column | None,
    limit: int,
    default_limit: int = 1000,
    after_id: Column | None = None,
) -> DataFrame:
    """Oldest events after a point, in the order of (``ts``, ``event_id``); one poll of a feed.

    The point is ``after``, or the event ``after_id`` at that time: resuming from both loses
    none of the events that share the last time. Without ``after`` all events count. A limit
    that is not positive means the default, which is also the most one poll may ask for.
    """
    if limit > default_limit:
        raise ValueError(f"one poll gives at most {default_limit} events, {limit} were asked for")
    newer = events
    if after is not None:
        later = F.col(ts) > after
        if after_id is not None:
            later = later | ((F.col(ts) == after) & (F.col("event_id") > after_id))
        newer = events.filter(later)
    return newer.orderBy(ts, "event_id").limit(limit if limit > 0 else default_limit)


def retain(events: DataFrame, ts: str, retention: timedelta) -> DataFrame:
    """Events not older than the newest one minus ``retention``."""
    newest = events.agg(F.max(ts)).scalar()
    return events.filter(F.col(ts) >= newest - F.lit(retention))


Reader = Callable[[SparkSession, Mapping], DataFrame]


def union_sources(
    spark: SparkSession, configs: Mapping[str, Mapping], readers: Mapping[str, Reader]
) -> DataFrame:
    """Read every enabled source, tag its rows with the source id and union them.

    A source whose ``type`` has no reader is skipped with a warning.
    """
    frames = []
    for source_id, config in configs.items():
        if not config.get("enabled", True):
            continue
        reader = readers.get(config.get("type"))
        if reader is None:
            log.warning("source %s skipped: unknown type %r", source_id, config.get("type"))
            continue
        frames.append(reader(spark, config).withColumn("source", F.lit(source_id)))
    if not frames:
        raise ValueError("no source is enabled")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _snake(name: str) -> str:
    return {"listedAt": "listed_at", "soldAt": "sold_at"}[name]
