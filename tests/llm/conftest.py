from __future__ import annotations

import pytest

from marketpulse.llm import queries  # noqa: F401  (registers the queries)

LONG = "lorem ipsum dolor " * 30_000
CLASHES = "label string, n long, tie long, first long, hashes string, score double, part int"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing columns."""
    rows = [
        (1, "one two three four five six"),
        (1, "one two three four five six"),
        (2, None),
        (3, ""),
        (None, "a text without an id"),
        (None, None),
        (4, LONG),
        (5, "   \n\t "),
        (6, "ünï 中文 😀 ▁ \x00 \u2028 end"),
    ]
    wide = [(*r, *([None] * 7)) for r in rows]
    return spark.createDataFrame(wide, f"doc_id long, text string, {CLASHES}")


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("doc_id > 100").coalesce(1)


@pytest.fixture(scope="session")
def docs(spark):
    def build(*found):
        return spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")

    return build


@pytest.fixture(scope="session")
def small(spark):
    """(doc_id, text) of the smallest documents table, by id."""
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    return sorted((r.doc_id, r.text) for r in rows)


@pytest.fixture(scope="session")
def labels_of(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (None, 0, 1), (3, None, None), (4, 0, 1)],
        "doc_id long, quality int, toxic int",
    )
