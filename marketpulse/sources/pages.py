"""Tables kept in order, with the rows of each range counted, so that a page opens its ranges only.

``OFFSET`` reads and sorts everything in front of a page. Here the rows are written once in
sorted ranges, one folder each, next to a small table with every range's first and last key
and its rows. The rows in front of a range are then a running sum, so page 10,000 costs what
page 1 does, and a token, the key of a page's last row, leads to the next page whatever has
been read before.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RANGE = "_range"


def write_pages(rows: DataFrame, path: str, keys: Sequence[str], ranges: int = 200) -> None:
    """Write ``rows`` in the order of ``keys`` as up to ``ranges`` sorted folders, and their counts.

    The keys must tell rows apart where pages are to be cut between them: rows with all keys
    equal stay in one range. Nulls come first, as in ``orderBy``. A table without rows
    has no range and only empty pages.
    """
    sorted_rows = rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    placed = sorted_rows.withColumn(_RANGE, F.spark_partition_id())
    placed.write.mode("overwrite").partitionBy(_RANGE).parquet(f"{path}/rows")
    schema = T.StructType([*rows.schema.fields, T.StructField(_RANGE, T.IntegerType())])
    written = rows.sparkSession.read.schema(schema).parquet(f"{path}/rows")
    key = F.struct(*keys)
    counts = written.groupBy(_RANGE).agg(
        F.count("*").alias("n"), F.min(key).alias("first"), F.max(key).alias("last")
    )
    counts.coalesce(1).write.mode("overwrite").parquet(f"{path}/counts")


@dataclass(frozen=True)
class Pages:
    """Reader of a table that :func:`write_pages` wrote.

    ``counts`` comes to the driver: it has one row per range, a number fixed at writing that
    does not grow with the table. A reader stands for the table as it was when opened.
    """

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    schema: T.StructType
    counts: tuple[Row, ...]

    @staticmethod
    def open(spark: SparkSession, path: str, keys: Sequence[str], schema: T.StructType) -> Pages:
        """``schema`` is that of the rows that were written."""
        counts = spark.read.parquet(f"{path}/counts").orderBy(_RANGE).collect()
        return Pages(spark, path, tuple(keys), schema, tuple(counts))

    @property
    def total(self) -> int:
        """All rows of the table, without reading one."""
        return sum(r.n for r in self.counts)

    def page(self, page: int, size: int) -> DataFrame:
        """Page ``page``, from 0, of ``size`` rows in order; beyond the end it is empty."""
        _positive(size)
        if page < 0:
            raise ValueError(f"no such page: {page}")
        begin, before, opened, skipped = page * size, 0, [], 0
        for r in self.counts:
            if before + r.n > begin and before < begin + size:
                if not opened:
                    skipped = begin - before
                opened.append(r[_RANGE])
            before += r.n
        return self._rows(opened).orderBy(*self.keys).offset(skipped).limit(size)

    def after(self, token: Sequence[Any] | None, size: int) -> DataFrame:
        """The ``size`` rows that follow the key ``token``; None means the first ones.

        The token need not be a key of the table, so a page can follow a row that has gone.
        """
        _positive(size)
        if token is None:
            return self.page(0, size)
        if len(token) != len(self.keys):
            raise ValueError(f"a token has {len(self.keys)} values, not {len(token)}")
        opened, sure = [], 0
        mark = _order(token)
        for r in self.counts:
            if _order(r["last"]) <= mark:
                continue
            if sure >= size:
                break
            opened.append(r[_RANGE])
            # Of the range that holds the token only the last row is known to follow it.
            sure += r.n if _order(r["first"]) > mark else 1
        rows = self._rows(opened)
        return rows.filter(self._follows(token)).orderBy(*self.keys).limit(size)

    def token(self, page: Sequence[Row]) -> tuple | None:
        """Token for what follows a collected page; None behind an empty one."""
        return tuple(page[-1][k] for k in self.keys) if page else None

    def _rows(self, ranges: list[int]) -> DataFrame:
        if not ranges:
            return self.spark.createDataFrame([], self.schema)
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*[f"{self.path}/rows/{_RANGE}={n}" for n in ranges])

    def _follows(self, token: Sequence[Any]) -> Column:
        """Whether a row's key comes after the token, key by key, nulls first."""
        out = F.lit(False)
        for name, value in reversed(list(zip(self.keys, token))):
            mark = F.lit(value).cast(self.schema[name].dataType)
            greater = F.col(name).isNotNull() if value is None else F.col(name) > mark
            out = F.coalesce(greater, F.lit(False)) | (F.col(name).eqNullSafe(mark) & out)
        return out


def _positive(size: int) -> None:
    if size <= 0:
        raise ValueError(f"a page has at least one row, not {size}")


def _order(key: Sequence[Any]) -> tuple:
    """Sorts in Python as Spark sorts: nulls first, text by code points as by UTF-8 bytes."""
    return tuple((value is not None, value if value is not None else 0) for value in key)
