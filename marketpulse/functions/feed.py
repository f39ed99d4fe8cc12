"""Feed vocabulary: finishes, event times, release dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The feed's printing names.
FINISH_BY_SUBTYPE = {
    "normal": "NORMAL",
    "holofoil": "HOLOFOIL",
    "reverse holofoil": "REVERSE_HOLOFOIL",
}


def finish_of(sub_type_name: Column) -> Column:
    """Finish for a printing name; null when unknown."""
    name = F.lower(F.trim(sub_type_name))
    result = F.lit(None).cast("string")
    for text, finish in FINISH_BY_SUBTYPE.items():
        result = F.when(name == text, F.lit(finish)).otherwise(result)
    return result


def event_time(event_ts: Column, record_ts: Column, partition_ts: Column) -> Column:
    """Business time, else a record time from 1970 on, else the partition time floored at 1970."""
    epoch = F.timestamp_seconds(F.lit(0))
    return F.coalesce(
        event_ts,
        F.when(record_ts >= epoch, record_ts),
        F.greatest(partition_ts, epoch),
        epoch,
    )


def release_date(text: Column) -> Column:
    """``yyyy/MM/dd`` to a date; null for missing, blank or malformed text."""
    return F.try_to_timestamp(text, F.lit("yyyy/MM/dd")).cast("date")


_INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})$"


def iso_timestamp(text: Column) -> Column:
    """A full ISO-8601 instant: date, time and zone; null for anything less."""
    return F.when(text.rlike(_INSTANT), text.try_cast("timestamp"))
