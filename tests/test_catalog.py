from __future__ import annotations

import datetime as dt
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marketpulse.operators import catalog
from marketpulse.plans.catalog_load import load_catalog, read_catalog, refresh, write_catalog
from marketpulse.sources.tables import upsert_table
from marketpulse.sources import catalog as pages
from marketpulse.sources.pages import Pages, write_pages

SETS = {
    "data": [
        {"id": "new", "name": "New", "series": "S", "printedTotal": 2, "total": 3,
         "releaseDate": "2024/05/03", "images": {"symbol": "s", "logo": "l"}},
        {"id": "edge", "name": "Edge", "releaseDate": "2024/01/01"},
        {"id": "old", "name": "Old", "releaseDate": "2022/03/11"},
        {"id": "none", "name": "None", "releaseDate": None},
    ]
}
CARDS = [
    {"setId": "new", "data": [
        {"id": "new-1", "name": "Ring 1", "number": "1", "rarity": "Common",
         "images": {"small": "s1", "large": "l1"}, "types": ["Fire"]},
        {"id": "new-2", "name": "Ring 2", "number": "10", "rarity": "Illustration Rare",
         "images": {"small": "s2"}},
    ]},
    {"setId": "edge", "data": [{"id": "edge-1", "name": "Bolt", "number": "2", "rarity": None}]},
    {"setId": "old", "data": [{"id": "old-1", "name": "Gone", "number": "3"}]},
]


@pytest.fixture
def loaded(spark, tmp_path):
    (tmp_path / "sets").mkdir()
    (tmp_path / "cards").mkdir()
    (tmp_path / "sets/p.json").write_text(json.dumps(SETS))
    (tmp_path / "cards/p.json").write_text("\n".join(json.dumps(c) for c in CARDS))
    return load_catalog(
        pages.read_sets(spark, f"{tmp_path}/sets"),
        pages.read_cards(spark, f"{tmp_path}/cards"),
        dt.date(2024, 1, 1),
    )


def test_cutoff_is_inclusive_and_undated_sets_are_left_out(loaded):
    assert {r.set_id for r in loaded.sets.collect()} == {"new", "edge"}
    summary = loaded.summary.first()
    assert tuple(summary) == (2, 3, dt.date(2024, 1, 1))


def test_metadata_prefers_the_large_image(loaded):
    images = {r.card_id: (r.image_url, r.set) for r in loaded.metadata.collect()}
    assert images == {"new-1": ("l1", "New"), "new-2": ("s2", "New"), "edge-1": (None, "Edge")}


def test_search(loaded):
    def ids(**filters):
        return [r.card_id for r in catalog.search(loaded.cards, loaded.sets, **filters).collect()]

    assert sorted(ids()) == ["edge-1", "new-1", "new-2"]
    assert ids(q="RING_1") == ["new-1"]  # the underscore is a wildcard
    assert ids(set_id="EDGE", q=" ") == ["edge-1"]
    assert ids(rarity="common", game="POKEMON") == ["new-1"]
    assert ids(game="MTG") == []
    assert catalog.search_count(loaded.cards, q="ring").first().total == 2
    with pytest.raises(ValueError):
        ids(game="CHESS")


def test_page_is_clamped_and_ordered_by_text_number(loaded):
    assert catalog.clamp_page(-1, 0) == (0, 50)
    assert catalog.clamp_page(3, 999) == (3, 200)
    page = catalog.card_page(loaded.cards, loaded.sets, page=1, page_size=1)
    assert [r.card_id for r in page.collect()] == ["new-1"]


def test_lookup(loaded):
    assert catalog.card_by_id(loaded.cards, loaded.sets, "new-2").count() == 1
    assert catalog.card_by_id(loaded.cards, loaded.sets, "ghost").count() == 0


def test_refresh_replaces_and_keeps(loaded):
    base = loaded.cards.withColumn("updated_at", F.timestamp_seconds(F.lit(0)))
    fresh = loaded.cards.filter("card_id = 'new-1'").withColumn("name", F.lit("Renamed"))
    rows = {r.card_id: r for r in refresh(base, fresh, "card_id", ["name"]).collect()}
    assert len(rows) == 3 and rows["new-1"].name == "Renamed"
    assert rows["new-1"].updated_at.year > 2000 and rows["new-2"].updated_at.year == 1970


def test_sku_universe_by_rarity(spark):
    cards = spark.createDataFrame(
        [("a", "Common"), ("b", "Illustration Rare"), ("c", None)], "card_id string, rarity string"
    )
    skus = catalog.sku_universe(cards, ("NM", "LP"))
    assert {r.card_id: r["count"] for r in skus.groupBy("card_id").count().collect()} == {
        "a": 4, "b": 6, "c": 4,
    }


def test_base_price_is_the_mean_of_what_traded(spark):
    cards = spark.createDataFrame(
        [("a", "Rare"), ("b", "Rare"), ("c", "Promo")], "card_id string, rarity string"
    )
    sales = spark.createDataFrame(
        [("a", "NORMAL", "NM", Decimal("2.00")), ("b", "NORMAL", "NM", Decimal("3.01"))],
        "card_id string, finish string, condition string, price decimal(12,2)",
    )
    skus = catalog.sku_universe(cards, ("NM",))
    priced = catalog.with_base_price(skus, sales, cards).filter("base_price IS NOT NULL")
    assert {(r.card_id, r.finish, str(r.base_price)) for r in priced.collect()} == {
        ("a", "NORMAL", "2.51"), ("b", "NORMAL", "2.51"),
    }


def test_price_bands(spark):
    df = spark.createDataFrame([("k", "c", Decimal("9.99"))], "market_key string, card_id string, avg_price decimal(12,2)")
    row = catalog.with_price_bands(df).first()
    assert [str(row[c]) for c in row.asDict() if c.endswith("price")] == [
        "8.49", "9.99", "12.99", "9.99", "7.99",
    ]


def test_ids_are_consecutive_over_many_partitions(spark):
    cards = spark.range(5000).selectExpr("concat('c', lpad(id, 5, '0')) AS card_id")
    rows = catalog.product_ids(cards.repartition(16)).orderBy("card_id").collect()
    assert [r.product_id for r in rows] == list(range(500_000, 505_000))


def test_distinct_cards_skip_missing_ids(spark):
    df = spark.createDataFrame([("b", 2), ("b", 1), (None, 0), ("a", 3)], "card_id string, n int")
    rows = catalog.distinct_cards(df, ["n"]).collect()
    assert {(r.card_id, r.n) for r in rows} == {("a", 3), ("b", 1)}


def test_catalogue_job_writes_and_upserts_its_tables(spark, tmp_path):
    sets = "set_id string, name string, series string, printed_total int, total int, release_date_raw string, logo_url string, symbol_url string, place int"
    cards = "card_id string, set_id string, name string, number string, rarity string, supertype string, image_small string, image_large string, place int"

    def load(*named):
        raw_sets = [("s1", "One", "a", 1, 1, "2025/01/01", "l", "s", 0), ("s2", "Two", "a", 1, 1, "2025/01/01", "l", "s", 1)]
        raw = [(c, s, n, "1", "Rare", "x", "i", None, i) for i, (c, s, n) in enumerate(named)]
        loaded = load_catalog(
            spark.createDataFrame(raw_sets, sets), spark.createDataFrame(raw, cards),
            dt.date(2024, 1, 1), ["place"],
        )
        write_catalog(loaded, str(tmp_path))

    load(("a", "s1", "old"), ("b", "s2", "kept"), ("a", "s1", "first"))
    stamps = {r.card_id: r.updated_at for r in spark.read.parquet(f"{tmp_path}/cards").collect()}
    load(("a", "s1", "v1"), ("a", "s1", "v2"), ("c", "s1", "new"))
    rows = {r.card_id: r for r in spark.read.parquet(f"{tmp_path}/cards").collect()}
    assert {c: r.name for c, r in rows.items()} == {"a": "v2", "b": "kept", "c": "new"}
    assert rows["b"].updated_at == stamps["b"] and rows["a"].updated_at > stamps["a"]
    assert spark.read.parquet(f"{tmp_path}/metadata").count() == 3
    assert spark.read.parquet(f"{tmp_path}/sets").count() == 2


def test_renamed_sets_and_moved_cards_replace_their_rows(spark, tmp_path):
    sets = "set_id string, name string, series string, printed_total int, total int, release_date_raw string, logo_url string, symbol_url string"
    cards = "card_id string, set_id string, name string, number string, rarity string, supertype string, image_small string, image_large string"

    def load(set_names, *placed):
        raw_sets = [(i, n, "a", 1, 1, "2025/01/01", "l", "s") for i, n in set_names.items()]
        raw = [(c, i, c.upper(), "1", "Rare", "x", "i", None) for c, i in placed]
        loaded = load_catalog(
            spark.createDataFrame(raw_sets, sets), spark.createDataFrame(raw, cards), dt.date(2024, 1, 1)
        )
        write_catalog(loaded, str(tmp_path))

    load({"s1": "Base", "s2": "Two"}, ("a", "s1"), ("b", "s1"), ("c", "s2"))
    load({"s1": "Base Set", "s2": "Two"}, ("a", "s2"), ("b", "s1"))
    stored = {t: read_catalog(spark, str(tmp_path), t).collect() for t in ("sets", "cards", "metadata")}
    assert {r.set_id: r.name for r in stored["sets"]} == {"s1": "Base Set", "s2": "Two"}
    assert sorted((r.card_id, r.set_id) for r in stored["cards"]) == [("a", "s2"), ("b", "s1"), ("c", "s2")]
    found = sorted((r.card_id, r.set) for r in stored["metadata"])
    assert found == [("a", "Two"), ("b", "Base Set"), ("c", "Two")]


def test_upsert_keeps_other_rows_of_null_partitions(spark, tmp_path):
    layout, path = "k string, v int, part string", f"{tmp_path}/t"

    def put(*rows):
        upsert_table(spark.createDataFrame(rows, layout), path, ["k", "part"], ["part"])
        return sorted(
            (tuple(r) for r in spark.read.schema(layout).parquet(path).select("k", "v", "part").collect()),
            key=repr,
        )

    put(("a", 1, "x"), ("b", 1, None), ("c", 1, None), (None, 1, "x"), ("d", 1, "y"))
    got = put(("b", 2, None), (None, 2, "x"))
    want = [("a", 1, "x"), ("b", 2, None), ("c", 1, None), (None, 2, "x"), ("d", 1, "y")]
    assert got == sorted(want, key=repr)


def test_stored_pages_against_sorting_everything(spark, tmp_path):
    rng = random.Random(4)
    rows = [
        (rng.choice([None, "a", "b", "Ä", "z"]), rng.choice([None, 1, 2, 10]), f"c{i:03d}")
        for i in range(500)
    ]
    rows += [("hot", 1, f"h{i:03d}") for i in range(250)]  # a third of all rows under one key
    keys = ["set_id", "number", "card_id"]
    table = spark.createDataFrame(rows, "set_id string, number int, card_id string")
    nulls_first = lambda r: [(v is not None, v if v is not None else 0) for v in r]
    want = sorted(rows, key=nulls_first)
    write_pages(table, f"{tmp_path}/p", keys, ranges=20)
    stored = Pages.open(spark, f"{tmp_path}/p", keys, table.schema)
    assert stored.total == len(want)
    for number in (0, 1, 9, 29, 30, 40):
        page = stored.page(number, 25)
        assert [tuple(r) for r in page.collect()] == want[number * 25 : number * 25 + 25]
        assert len(page.inputFiles()) <= 2
    token, got = None, []
    while page := stored.after(token, 100).collect():
        token = stored.token(page)
        got += [tuple(r) for r in page]
    assert got == want
    gone = stored.after(("a", 3, ""), 10)  # no row has this key
    place = next(i for i, r in enumerate(want) if nulls_first(r) > nulls_first(("a", 3, "")))
    assert [tuple(r) for r in gone.collect()] == want[place : place + 10]
    for bad in (lambda: stored.page(-1, 5), lambda: stored.page(0, 0), lambda: stored.after(("a",), 5)):
        with pytest.raises(ValueError):
            bad()


def test_stored_pages_of_an_empty_table(spark, tmp_path):
    table = spark.createDataFrame([], "set_id string, card_id string")
    write_pages(table, f"{tmp_path}/p", ["set_id", "card_id"])
    stored = Pages.open(spark, f"{tmp_path}/p", ["set_id", "card_id"], table.schema)
    assert stored.total == 0 and stored.page(0, 5).collect() == stored.after(None, 5).collect() == []
