"""Spelling variants against brute force, with ties, chains, split blocks and odd input."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from marketpulse.llm import variants
from marketpulse.llm.registry import QUERIES

from .conftest import SMALL


def brute_words(rows, every=31):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if every and h % every == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            out[word] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def brute_variants(words):
    near = {
        w: [v for v in words if abs(len(v) - len(w)) < 2 and variants.one_edit(w, v)] for w in words
    }
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 10 * n:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {
        (w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None)
        for w, n in words.items()
    }


def found(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def table_of(spark, words):
    return spark.createDataFrame(sorted(words.items()), "word string, n long")


def edited(rng, word):
    at, letter = rng.randrange(len(word)), rng.choice("abcdeéÿÀ")
    return rng.choice(
        [word[:at] + word[at + 1 :], word[:at] + letter + word[at:], word[:at] + letter + word[at + 1 :]]
    )


@pytest.mark.parametrize(("groups", "tile"), [(5, 4096), (4, 6), (3, 5)])
def test_against_brute_force(spark, groups, tile):
    """Small tiles cut blocks into pairs of tiles; no pair is lost or doubled."""
    rng = random.Random(groups)
    words = {}
    for _ in range(25):
        word = "".join(rng.choice("abcdeé") for _ in range(rng.randint(7, 12)))
        for _ in range(14):
            words[word] = rng.choice([2, 3, 20, 40, 400, 5000])
            word = edited(rng, word)
    s = variants.Settings(groups=groups, tile=tile)
    got = variants.spelling_variants(table_of(spark, words), s)
    assert found(got) == brute_variants(words)
    assert len(got.columns) == 6 and got.count() == len(words)


def test_ties_chains_and_anagrams(spark):
    words = {
        "aaaaaaa": 3, "aaaaaab": 30, "aaaaaac": 30,  # of equal n the first word
        "bbbbbbb": 2, "bbbbbbbc": 20, "bbbbbbbcd": 200, "bbbbbbbcde": 2000,  # a chain
        "abcdefg": 5, "gfedcba": 500, "bacdefg": 500,  # anagrams are not one edit apart
        "éàüñçøÿ": 2, "éàüñçøÿÿ": 20, "ÀÀÀÀÀÀÀ": 2,
        "x" * 3000: 2, "x" * 2999: 2, "x" * 2998 + "y": 90,
    }
    got = found(variants.spelling_variants(table_of(spark, words)))
    assert got == brute_variants(words)
    rows = {r[0]: r for r in got}
    assert rows["aaaaaaa"][1] == "aaaaaab"
    assert rows["bbbbbbb"][2] == "bbbbbbbcde"
    assert rows["abcdefg"][1] is None


def test_words_of_odd_texts(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    rows += [(7, "Wörtlich wörtlich WÖRTLICH x1wörtlich Straßenbahn-Straßenbahn")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string")
    words = variants.word_counts(df, misspell_every=31)
    assert {r.word: r.n for r in words.collect()} == brute_words(rows)
    plain = {r.word: r.n for r in variants.word_counts(df).collect()}
    assert plain == brute_words(rows, every=None) and plain["wörtlich"] == 120
    assert found(variants.spelling_variants(variants.word_counts(none))) == set()


def test_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op11_spelling_variants"](spark, SMALL)
    words = brute_words(rows)
    assert found(got) == brute_variants(words)
    assert got.dtypes[3:] == [("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]


@pytest.mark.parametrize(
    ("a", "b", "near"),
    [("ab", "ab", False), ("ab", "abc", True), ("abc", "bc", True), ("abc", "abd", True),
     ("abc", "acb", False), ("aab", "ab", True), ("abcd", "ab", False), ("a", "b", True)],
)
def test_one_edit(a, b, near):
    assert variants.one_edit(a, b) == near == variants.one_edit(b, a)
