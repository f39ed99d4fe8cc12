"""The prefix trie against brute force: shards, shared spines, chains, odd conversations."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from marketpulse.llm import tries
from marketpulse.llm.parentheses import Parentheses
from marketpulse.llm.registry import QUERIES

from .conftest import SMALL

COLUMNS = (
    "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256"
).split()


def sequences(rows):
    """conv_id to its (role, text) turns in order, from (conv_id, turn, role, text)."""
    out = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            key = (turn is not None, turn or 0, role or "", text or "")
            out.setdefault(conv, []).append(key)
    return {c: [k[2:] for k in sorted(turns)] for c, turns in out.items()}


def rebuilt(found):
    out = {}
    for c, turns in found.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = found.get(c - c % 100, [])[:h] + turns[h:]
    return out


def brute(found):
    members = {}
    for c, turns in found.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for node, convs in members.items():
        below = [v for v in members if v[: len(node)] == node]
        kids = sum(len(v) == len(node) + 1 for v in below)
        leaves = sum(not any(w[: len(v)] == v and len(w) > len(v) for w in below) for v in below)
        saved = sum((len(members[v]) - 1) * len(v[-1][1]) for v in below if v)
        ends = ",".join(str(c) for c in sorted(convs) if len(found[c]) == len(node))
        out.add((
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), kids,
            leaves, saved, hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


def found_in(df):
    rows = [tuple(r) for r in df.select(COLUMNS).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def table_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def talk(rng, n, words=3, most=7):
    """Conversations over few turns, so that beginnings, ends and whole texts are shared."""
    rows = []
    for c in range(n):
        for t in range(rng.randint(0, most)):
            rows.append((c, t, rng.choice(["user", "assistant"][: 1 + t % 2]), "ab" * rng.randint(0, words)))
    return rows


@pytest.mark.parametrize("shard", [4, 25, 1 << 17])
def test_against_brute_force(spark, shard):
    """Small shards give several levels of shared spines."""
    rows = talk(random.Random(1), 160)
    given = table_of(spark, rows)
    s = tries.Settings(shard_nodes=shard)
    got = found_in(tries.prefix_trie(tries.ordered_turns(given), None, s))
    assert got == brute(sequences(rows))


def test_copies_chains_and_common_beginnings(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(40) for t in range(6 + (c > 30))]
    rows += [(50, t, "user", f"own {t}") for t in range(300)]
    rows += [(51, t, "user", f"own {t}") for t in range(300)]
    rows += [(60 + k, 0, "system", "s") for k in range(3)]
    given = table_of(spark, rows)
    plain = found_in(tries.prefix_trie(tries.ordered_turns(given), None, tries.Settings(64)))
    assert plain == brute(sequences(rows))
    ids = given.select("conv_id")
    common = tries.with_common_beginning(tries.ordered_turns(given))
    got = found_in(tries.prefix_trie(common, ids, tries.Settings(16)))
    assert got == brute(rebuilt(sequences(rows)))


def test_odd_conversations(spark):
    """Nulls, ties and repeated rows; conversations that lose all turns; a missing base."""
    rows = [
        (7, None, "user", "first"), (7, 1, None, "x"), (7, 1, "a", None), (7, 1, "a", None),
        (None, 1, "user", "nobody"), (230, 0, "user", "alone"), (231, 0, "user", "alone"),
        (232, 0, "", ""), (233, 0, None, None), (300, 0, "user", "z" * 100_000), (301, 0, "u", "v"),
    ]
    given = table_of(spark, rows)
    wide = given.selectExpr("*", "1 AS pos", "2 AS node", "'x' AS digest", "3 AS depth", "4 AS n")
    got = tries.prefix_trie(
        tries.with_common_beginning(tries.ordered_turns(wide)), wide.select("conv_id", "n")
    )
    assert found_in(got) == brute(rebuilt(sequences(rows)))
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]


def test_turnless_and_empty(spark):
    given = table_of(spark, [(205, 0, "user", "a"), (204, 0, "user", "a")])
    base = tries.ordered_turns(given)
    ids = given.select("conv_id")
    lone = found_in(tries.prefix_trie(base.filter("conv_id > 999"), ids))
    ends = hashlib.sha256(b"204,205").hexdigest()
    assert lone == {(204, 0, None, 2, 0, 1, 0, ends)}
    none = given.filter("conv_id > 999")
    assert found_in(tries.prefix_trie(tries.ordered_turns(none), none.select("conv_id"))) == set()


def test_query_against_brute_force(spark):
    table = spark.read.parquet(f"{SMALL}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert found_in(QUERIES["op12_prefix_trie"](spark, SMALL)) == brute(rebuilt(sequences(rows)))


@pytest.mark.parametrize("size", [1, 31, 32, 33, 2000])
def test_findclose(size):
    """Deep, wide and mixed forests that cross many blocks."""
    rng = np.random.default_rng(size)
    for lean in (0.5, 0.9, 0.1):
        bits, open_ = [], 0
        while len(bits) - (len(bits) - open_) // 2 < size:
            up = open_ == 0 or rng.random() < lean
            bits.append(int(up))
            open_ += 1 if up else -1
        bits += [0] * open_
        tree, stack, close = Parentheses(np.array(bits)), [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                close[stack.pop()] = i
        assert tree.findclose(tree.opens).tolist() == [close[i] for i in sorted(close)]
        ends, leaves = tree.subtrees()
        for k, i in enumerate(sorted(close)):
            inner = bits[i : close[i] + 1]
            assert ends[k] - k == sum(inner)
            assert leaves[k] == sum(a == 1 and b == 0 for a, b in zip(inner, inner[1:]))
