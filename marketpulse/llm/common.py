"""What the text operators share: column selection, Arrow batches and shared folders."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SLICE_ROWS = 2048
#: Tasks over which the rows of one hot key are dealt.
SALTS = 8
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, as ``doc_id`` and ``text``; a null text is empty."""
    return df.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def _importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package wherever the driver started."""
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows each, which become Python objects one at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def map_batches(
    df: DataFrame, fn: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]], schema
) -> DataFrame:
    """Run ``fn`` over column batches of ``df`` inside the tasks.

    Spark bounds a batch by bytes as well as rows, so a partition of very long texts does
    not become one huge batch; it becomes Python objects in slices. ``fn`` gets and yields
    dicts of column lists.
    """
    _importable(df.sparkSession)
    struct = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = (
            {n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)}
            for part in slices(batches)
        )
        for out in fn(columns):
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow
            )

    return df.mapInArrow(run, struct)


def map_rows(df: DataFrame, make: Callable[[], Callable[..., tuple]], schema: str) -> DataFrame:
    """One output row per input row; ``make`` builds the row function once per task."""
    names = T._parse_datatype_string(schema).names

    def run(batches):
        fn = make()
        for batch in batches:
            rows = [fn(*row) for row in zip(*batch.values(), strict=True)]
            yield dict(zip(names, zip(*rows, strict=True), strict=True)) if rows else {
                n: [] for n in names
            }

    return map_batches(df, run, schema)


def _map_texts(df: DataFrame, change, text_col: str) -> DataFrame:
    _importable(df.sparkSession)
    at = [i for i, n in enumerate(df.columns) if n == text_col][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = None
        for batch in slices(batches):
            fn = fn or change()
            yield fn(batch, at, [t or "" for t in batch.column(at).to_pylist()])

    return df.mapInArrow(run, df.schema)


def keep_rows(df: DataFrame, make: Callable[[], Callable[[str], bool]], text_col="text"):
    """Rows whose text the function made per task accepts, with all their columns."""

    def change():
        keep = make()
        return lambda batch, at, found: batch.filter(pa.array([keep(t) for t in found], pa.bool_()))

    return _map_texts(df, change, text_col)


def replace_texts(df: DataFrame, make: Callable[[], Callable[[str], str]], text_col="text"):
    """All rows and columns of ``df``, each text replaced; a null text stays null if empty."""

    def change():
        replace = make()

        def run(batch, at, found):
            given = batch.column(at)
            new = [replace(t) if t else old for t, old in zip(found, given.to_pylist(), strict=True)]
            arrays = list(batch.columns)
            arrays[at] = pa.array(new, given.type)
            return pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

        return run

    return _map_texts(df, change, text_col)


def id_like(df: DataFrame, column: str = "doc_id") -> str:
    return df.schema[column].dataType.simpleString()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder that driver and executors share.

    It lies under ``spark.checkpoint.dir``; where that is unset, as in tests, under the
    warehouse folder, which a cluster shares as well.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or (
        f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    )
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to a shared folder and read it back: cuts lineage, survives lost executors."""
    folder = shared_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def salt(column: str, salts):
    """A number below ``salts``, a number or column, from a hash of ``column``."""
    return F.pmod(F.xxhash64(column), salts if isinstance(salts, Column) else F.lit(salts)).cast("int")


def salted_join(rows: DataFrame, small: DataFrame, key: str, by: str, how: str) -> DataFrame:
    """Join ``rows`` with the one row per key of ``small``; rows of a key are dealt over tasks.

    Rows go by a hash of their column ``by``, and ``small`` is repeated for each task.
    """
    copies = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", salt(by, SALTS)).join(copies, [key, "salt"], how).drop("salt")


def hex_digest(text: str | bytes) -> str:
    data = text if isinstance(text, bytes) else text.encode("utf-8")
    return hashlib.sha256(data).hexdigest()


def crc_mod(column: str, modulus: int):
    """crc32 of a column's decimal text, modulo ``modulus``: the folds of labelled rows."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus
