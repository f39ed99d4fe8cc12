"""Keyed merges: pick one row per key, upsert, insert-if-absent, delete.

Picking goes through ``row_number() = 1``: Spark then keeps only the best row per key
inside every map task, so a key that owns a third of the input shuffles one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Order = Sequence["str | Column"]


def first_per_key(df: DataFrame, keys: Sequence[str], order: Order) -> DataFrame:
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rank") == 1).drop("_rank")


def last_per_key(df: DataFrame, keys: Sequence[str], order: Order) -> DataFrame:
    newest = [(F.col(c) if isinstance(c, str) else c).desc_nulls_last() for c in order]
    return first_per_key(df, keys, newest)


def rows_like(base: DataFrame, other: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Semi or anti join by ``keys`` in which a null equals a null."""
    named = other.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = [base[k].eqNullSafe(named[f"_{k}"]) for k in keys]
    return base.join(named, same, how)


def upsert(
    base: DataFrame, delta: DataFrame, keys: Sequence[str], order: Order | None = None
) -> DataFrame:
    """``base`` with the rows of ``delta`` replacing or joining it by key.

    With ``order`` the last row per key of ``delta`` wins; without it the keys of
    ``delta`` must be unique. A null in a key equals a null.
    """
    fresh = last_per_key(delta, keys, order) if order else delta
    untouched = rows_like(base, fresh, keys, "left_anti")
    return untouched.select(*base.columns).unionByName(fresh.select(*base.columns))


def absent_rows(
    base: DataFrame, delta: DataFrame, keys: Sequence[str], order: Order | None = None
) -> DataFrame:
    """Rows of ``delta`` whose key ``base`` lacks; the first row per key by ``order``.

    Without ``order`` the rows of a key must be alike, and any of them is taken.
    """
    fresh = first_per_key(delta, keys, order or keys)
    return fresh.join(base.select(*keys), list(keys), "left_anti").select(*base.columns)


def insert_if_absent(
    base: DataFrame, delta: DataFrame, keys: Sequence[str], order: Order | None = None
) -> DataFrame:
    return base.unionByName(absent_rows(base, delta, keys, order))


def delete_keys(base: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return base.join(gone.select(*keys), list(keys), "left_anti").select(*base.columns)
