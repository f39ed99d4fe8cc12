"""MinHash near-duplicates against brute force: signatures, stars, open buckets, odd input."""

from __future__ import annotations

import random

import numpy as np
import pytest

from marketpulse.llm import jaccard, minhash
from marketpulse.llm.registry import QUERIES

from .conftest import SMALL
from .test_duplicates import brute_groups, family


def brute(found, width=3):
    rows = brute_groups(found, jaccard.Settings(width=width))
    return [(*r, r[0] == r[2]) for r in rows]


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_bins_agree_as_often_as_sets_are_alike():
    signer, rng = minhash.Signer(minhash.Settings()), np.random.default_rng(5)
    for size in (12, 60, 900):
        for share in (0.3, 0.85):
            rates = []
            for _ in range(60):
                pool = np.unique(rng.integers(0, 1 << 63, 3 * size, np.uint64))
                common = round(2 * size * share / (1 + share))
                a = np.sort(pool[:size])
                b = np.sort(np.concatenate([pool[:common], pool[size : 2 * size - common]]))
                rates.append((signer.bins(a) == signer.bins(b)).mean())
            exact = common / (2 * size - common)
            assert abs(np.mean(rates) - exact) < 0.05


def test_one_element_fills_every_bin():
    signer = minhash.Signer(minhash.Settings())
    assert set(signer.bins(np.array([5 << 40], np.uint64))) == {np.uint64(5 << 40)}
    assert len(signer.bands(np.empty(0, np.uint64))) == 0


@pytest.mark.parametrize(("limit", "star"), [(2_000_000, 1000), (800, 3)])
def test_groups_against_brute_force(docs, monkeypatch, limit, star):
    """Small limits cut open buckets into blocks and stars into salts."""
    monkeypatch.setattr(minhash, "STAR_ROWS", star)
    rng = random.Random(limit)
    found = ["", "one", "One", "two", "a b", "a b c", "a b c d", "a b c e", "  \n"]
    for size, n, changes in ((12, 300, 9), (40, 120, 6), (10, 20, 2), (8, 9, 1), (30, 60, 4)):
        found += family(rng, size, n, changes)
    # A chain: neighbours are linked, others are not, and the smallest id links with one only.
    base = [f"q{i}" for i in range(200)]
    for step in range(12):
        found.append(" ".join([*base[9 * step :], *(f"r{i}" for i in range(9 * step))]))
    rng.shuffle(found)
    s = minhash.Settings(task_shingles=limit)
    got = rows_of(minhash.near_duplicates(docs(*found), s))
    assert got == brute(found)
    assert 1 < len({g[2] for g in got}) < len(found)


def test_members_unlike_their_centre_still_meet(docs):
    """Bands of one row put all sets with a common passage into one bucket."""
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(60))
    found = [f"{passage} " + " ".join(f"z{i}" for i in range(60))]
    for k in range(6):
        own = " ".join(f"v{k}_{i}" for i in range(60))
        found += [f"{passage} {own}", f"{passage} {own} end{k}"]
    rng.shuffle(found)
    s = minhash.Settings(bands=4, rows=1)
    got = rows_of(minhash.near_duplicates(docs(*found), s))
    assert got == brute(found) and len({g[2] for g in got}) == 7


def test_without_broadcast(docs, monkeypatch):
    monkeypatch.setattr(minhash, "BROADCAST_IDS", 0)
    found = [*family(random.Random(4), 15, 60, 3), "one", "two words", ""]
    assert rows_of(minhash.near_duplicates(docs(*found))) == brute(found)


def test_odd_rows(spark, odd, none):
    """Repeated rows come out twice; a row without an id has no component and is kept."""
    got = minhash.near_duplicates(odd)
    rows = sorted((tuple(r) for r in got.collect()), key=repr)
    by_id = {r[0]: r for r in rows}
    assert len(rows) == odd.count() and [r for r in rows if r[0] == 1] == [(1, 4, 1, True)] * 2
    assert by_id[2] == (2, 0, 2, True) and by_id[3] == (3, 0, 3, True) and by_id[5][1] == 0
    assert [(r[2], r[3]) for r in rows if r[0] is None] == [(None, True)] * 2
    assert got.dtypes == [
        ("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean"),
    ]
    assert minhash.near_duplicates(none).collect() == []


def test_an_id_with_several_texts_joins_their_groups(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    rows = [(9, a), (4, b), (7, a), (7, b), (8, "alone here today")]
    got = rows_of(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [(r[0], r[2]) for r in got] == [(4, 4), (7, 4), (7, 4), (8, 8), (9, 4)]


def test_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    rows = sorted((r.doc_id, r.text or "") for r in rows)
    ids = [r[0] for r in rows]
    expected = [(ids[a], n, ids[c], k) for a, n, c, k in brute([r[1] for r in rows])]
    assert rows_of(QUERIES["op13_minhash"](spark, SMALL)) == expected
