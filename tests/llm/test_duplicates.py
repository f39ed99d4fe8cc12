"""Jaccard join, connected components, suffix arrays."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from marketpulse.llm import graph, jaccard, suffixes
from marketpulse.llm.registry import QUERIES

from .conftest import SMALL


def brute_groups(found, s):
    sets = []
    for text in found:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).split()
        size = min(s.width, len(words))
        sets.append({tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set())
    label = list(range(len(found)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and s.den * len(a & b) >= s.num * len(a | b):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return [(i, len(x), label[i]) for i, x in enumerate(sets)]


def family(rng, size, n, changes):
    base = [f"w{rng.randint(0, 5000)}" for _ in range(n)]
    out = []
    for _ in range(size):
        words = list(base)
        for _ in range(rng.randint(0, changes)):
            words[rng.randrange(n)] = f"x{rng.randint(0, 5000)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("limit", "num"), [(2_000_000, 85), (1500, 85), (2_000_000, 80)])
def test_groups_against_brute_force(spark, docs, limit, num):
    rng = random.Random(limit + num)
    found = ["", "one", "One", "two", "a b c", "a b c d", "a b c d e", "a b c d f"]
    for size, n, changes in ((12, 300, 6), (30, 120, 4), (10, 20, 2), (8, 9, 1), (25, 60, 6)):
        found += family(rng, size, n, changes)
    passage = " ".join(f"p{i}" for i in range(40))
    found += [f"{passage} {f}" for f in family(rng, 10, 30, 8)]
    rng.shuffle(found)
    s = jaccard.Settings(task_shingles=limit, num=num)
    got = sorted(tuple(r) for r in jaccard.similar_groups(docs(*found), s).collect())
    assert got == brute_groups(found, s)
    assert len({g[2] for g in got}) < len(found)


def test_groups_without_broadcast(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
    found = [*family(random.Random(3), 15, 60, 3), "one", "two words", ""]
    got = sorted(tuple(r) for r in jaccard.similar_groups(docs(*found)).collect())
    assert got == brute_groups(found, jaccard.Settings())


def test_a_large_regions_links_to_its_pivot_are_kept(docs):
    """The last text's first pivot shares a passage with it only and is linked with nothing."""
    s = jaccard.Settings(num=60, task_shingles=500)
    base = [f"w{i}" for i in range(120)]
    copies = [" ".join([*base[:i], f"c{i}", *base[i + 1 :]]) for i in range(10, 50, 4)]
    passage = [f"p{i}" for i in range(24)]
    variant = " ".join([*base[:60], *passage, *base[84:]])
    other = " ".join([*passage, *(f"o{i}" for i in range(96))])
    found = [other, " ".join(base), *copies, variant]

    first, *group, last = (
        set(jaccard.parts_of(jaccard.shingle_hashes(t.encode().split(), 4, jaccard._Hashes()), s))
        for t in found
    )
    assert first & last and last & group[0] and not any(first & x for x in group)
    want = brute_groups(found, s)
    assert [r[2] for r in want] == [0] + [1] * (len(found) - 1)
    assert sorted(tuple(r) for r in jaccard.similar_groups(docs(*found), s).collect()) == want


def test_linked_sets_share_a_part():
    rng = np.random.default_rng(1)
    s = jaccard.Settings()
    for n in (*range(1, 40), 63, 64, 65, 127, 128, 300, 1000):
        for _ in range(12):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            b = a
            while True:  # change as many as the threshold lets
                keep = np.delete(b, rng.integers(len(b)))
                if rng.random() < 0.5:
                    keep = np.unique(np.append(keep, rng.integers(0, 1 << 63, dtype=np.uint64)))
                shared = len(np.intersect1d(a, keep))
                if not len(keep) or not s.linked(shared, len(a) + len(keep) - shared):
                    break
                b = keep
            assert np.intersect1d(jaccard.parts_of(a, s), jaccard.parts_of(b, s)).size


def test_groups_of_odd_rows(odd, none):
    rows = jaccard.similar_groups(odd).collect()
    assert len(rows) == 9
    assert {r.component_id for r in rows if r.doc_id == 1} == {1}
    assert {(r.n_shingles, r.component_id) for r in rows if r.doc_id in (2, 3)} == {(0, 2), (0, 3)}
    assert all(r.component_id is None for r in rows if r.doc_id is None)
    assert jaccard.similar_groups(none).count() == 0
    kept = jaccard.one_of_each_group(odd)
    assert kept.columns == odd.columns and kept.count() == 9


def test_repeated_ids_are_one_document(spark):
    a, b = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    frame = spark.createDataFrame([(5, a), (5, b), (3, b), (9, a)], "doc_id long, text string")
    assert {r.component_id for r in jaccard.similar_groups(frame).collect()} == {3}


def test_components(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randint(0, 60), 100 + rng.randint(0, 60)) for _ in range(25)]
    label = {v: v for e in edges for v in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    want = {v: x for v, x in label.items() if any(v in e for e in edges if e[0] != e[1])}
    got = graph.components(spark.createDataFrame(edges, "a long, b long"))
    assert dict(map(tuple, got.collect())) == want


def test_suffix_array_against_sorting():
    rng = random.Random(2)
    for _ in range(400):
        most = rng.choice([1, 3, 300])
        t = np.array([rng.randint(0, most) for _ in range(rng.randint(0, 60))], np.int64)
        assert suffixes.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: tuple(t[i:]))


def brute_removed(rows, width=100):
    seen, out = set(), []
    for doc_id, text in rows:
        raw = text.encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - width + 1):
            window = raw[p : p + width]
            if window in seen:
                gone[p : p + width] = b"\1" * width
            seen.add(window)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(bool(g) and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_query_against_brute_force(spark, small):
    got = sorted(tuple(r) for r in QUERIES["op10_suffixes"](spark, SMALL).collect())
    assert got == brute_removed(small)


@pytest.mark.parametrize("options", [
    {}, {"crowded": 3}, {"filter_bits": 10, "bucket_bytes": 2000}, {"stretch": 130},
])
def test_repeats_against_brute_force(docs, options):
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh é") for _ in range(260))
    found = ["z" * 450, "ab" * 200, "z" * 99, passage]
    for _ in range(25):
        own = "".join(rng.choice("abcdefghij \n") for _ in range(rng.randint(0, 300)))
        a = rng.randint(0, 150)
        cut = passage[a : a + rng.randint(60, 160)]
        found.append(own[:80] + cut + own[80:] + rng.choice(["", cut]))
    found += [found[5], found[6] + "tail", passage]
    got = suffixes.remove_repeats(docs(*found), suffixes.Settings(**options)).collect()
    assert sorted(tuple(r) for r in got) == brute_removed(list(enumerate(found)))


def test_repeats_of_odd_rows(odd, none):
    rows = suffixes.remove_repeats(odd, with_text=True).collect()
    assert len(rows) == 9
    long = next(r for r in rows if r.doc_id == 4)
    assert long.kept == b"lorem ipsum dolor "  # all else starts one period later again
    assert {r.n_bytes for r in rows if r.doc_id in (2, 3)} == {0}
    assert suffixes.remove_repeats(none).count() == 0
