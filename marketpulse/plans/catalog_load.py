"""Catalogue pages to set, card and metadata tables."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketpulse.operators import catalog
from marketpulse.operators.merge import last_per_key, upsert
from marketpulse.sources.tables import upsert_table


@dataclass(frozen=True)
class Catalog:
    sets: DataFrame
    cards: DataFrame
    metadata: DataFrame
    cutoff: dt.date

    @property
    def summary(self) -> DataFrame:
        return catalog.load_summary(self.cards, self.sets, self.cutoff)


def load_catalog(
    raw_sets: DataFrame,
    raw_cards: DataFrame,
    cutoff: dt.date,
    position: list[str] | None = None,
) -> Catalog:
    """Recent sets with their cards.

    Of several rows with one id the last by ``position`` wins, such as page and place;
    without it ids must be unique.
    """
    if position:
        raw_sets = last_per_key(raw_sets, ["set_id"], position).drop(*position)
        raw_cards = last_per_key(raw_cards, ["card_id"], position).drop(*position)
    sets = catalog.recent_sets(raw_sets, cutoff)
    cards = catalog.recent_cards(raw_cards, sets)
    return Catalog(sets, cards, catalog.card_metadata(cards, sets), cutoff)


#: Folders of a stored catalogue table.
BUCKETS = 16


def write_catalog(loaded: Catalog, path: str) -> None:
    """Upsert sets, cards and card metadata into the tables under ``path``.

    Sets are keyed by their id, cards and metadata by the card's. Tables are laid out by a hash
    of the key, so a card that moves to another set, or a set that is renamed, replaces its row.
    """
    stamp = F.current_timestamp()
    _upsert(loaded.sets.withColumn("updated_at", stamp), f"{path}/sets", "set_id")
    _upsert(loaded.cards.withColumn("updated_at", stamp), f"{path}/cards", "card_id")
    _upsert(loaded.metadata, f"{path}/metadata", "card_id")


def _upsert(rows: DataFrame, path: str, key: str) -> None:
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
    upsert_table(rows.withColumn("bucket", bucket), path, [key], ["bucket"])


def read_catalog(spark: SparkSession, path: str, table: str) -> DataFrame:
    """``sets``, ``cards`` or ``metadata`` as ``write_catalog`` left them."""
    return spark.read.parquet(f"{path}/{table}").drop("bucket")


def refresh(base: DataFrame, loaded: DataFrame, key: str, position: list[str]) -> DataFrame:
    """Upsert loaded sets or cards and stamp them; other rows keep their stamp.

    Of several rows with one key the last by ``position`` wins, such as page and place.
    """
    last = last_per_key(loaded, [key], position)
    return upsert(base, last.withColumn("updated_at", F.current_timestamp()), [key])
