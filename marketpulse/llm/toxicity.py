"""Toxicity: a weighted lexicon matched by Aho-Corasick in folded text.

Folding undoes disguises: case, accents, look-alike letters of other scripts, and digits or
signs in place of letters. The lexicon holds whole words and word beginnings with weights
learned from labelled rows. Exception phrases, word pairs that hold an entry but are no
sign of toxicity, cancel that entry. The sum of weights is normalised by length.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketpulse.llm import labelled
from marketpulse.llm.common import crc_mod, id_like, keep_rows, map_batches, map_rows, texts

# Letters of other scripts that look like Latin ones.
_LOOK_ALIKES = dict(
    zip(
        "абвгдеёзикмнорстухіјѕԁɡαβεηικνορτυχω",
        "abbrdee3nkmhopctyxijsdgabenikvoptuxw",
        strict=True,
    )
)
# Digits and signs that stand in for letters inside words.
_STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
_STAND_INS |= {"@": "a", "$": "s", "!": "i"}
# "1" may stand for i or l: the two fold to one letter everywhere.
_SAME = {"l": "i"}

#: Features that a task counts before it passes them on.
MOST_FEATURES = 100_000

_INSIDE = re.compile(r"(?<=[a-z])[013457@$!89]+(?=[a-z])|(?<![^\s])[013457@$!89](?=[a-z])")
_STAND = str.maketrans(_STAND_INS)
_LOOKS = str.maketrans({**_LOOK_ALIKES, "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l"})
_KEEP = str.maketrans(
    {chr(i): (_SAME.get(chr(i), chr(i)) if chr(i).isalpha() else " ") for i in range(128)}
)
_SIGN = re.compile(r"[013457@$!89]")
_OTHER = re.compile(r"[^a-z]+")


def folded(text: str) -> str:
    """Words in folded letters, joined and enclosed by single blanks."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(_LOOKS)
        text = "".join(c for c in text if not unicodedata.combining(c)) if (
            not text.isascii()
        ) else text
    if _SIGN.search(text):
        text = _INSIDE.sub(lambda m: m[0].translate(_STAND), text)
    if text.isascii():
        return " " + " ".join(text.translate(_KEEP).split()) + " "
    return " " + " ".join(
        "".join(_SAME.get(c, c) if c.isalpha() else " " for c in text).split()
    ) + " "


@dataclass(frozen=True)
class Settings:
    """``max_rows`` bounds the labelled rows learned from, ``entries`` the lexicon."""

    max_rows: int = 8000
    entries: int = 512
    phrases: int = 512
    stem: tuple[int, int] = (4, 8)
    least_docs: int = 5
    least_odds: float = 2.5
    phrase_odds: float = 0.0


@dataclass(frozen=True)
class Lexicon:
    """Entries are " word " or " beginning"; ``phrases`` are " word word "."""

    weights: dict[str, float]
    phrases: frozenset[str]
    calibration: tuple[float, ...]


def _log_odds(toxic, other, all_toxic, all_other):
    a = (toxic + 0.5) / (all_toxic - toxic + 0.5)
    b = (other + 0.5) / (all_other - other + 0.5)
    return float(np.log(a) - np.log(b))


def _counts(sample: DataFrame, features) -> DataFrame:
    """Documents of each label that hold a feature; tasks add up before they pass rows on."""

    def partial(batches):
        found: dict[str, list[int]] = {}

        def out():
            return {
                "feature": list(found),
                "toxic": [v[1] for v in found.values()],
                "other": [v[0] for v in found.values()],
            }

        for batch in batches:
            for text, label in zip(batch["text"], batch["label"], strict=True):
                for f in features(text):
                    found.setdefault(f, [0, 0])[label] += 1
                if len(found) > MOST_FEATURES:
                    yield out()
                    found.clear()
        yield out()

    rows = map_batches(
        sample.select("text", "label"), partial, "feature string, toxic long, other long"
    )
    return rows.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def _word_features(stem: tuple[int, int]):
    def features(text):
        out = set()
        for w in set(folded(text).split()):
            out.add(f" {w} ")
            out.update(f" {w[:k]}" for k in range(stem[0], min(stem[1], len(w)) + 1))
        return out

    return features


def _phrase_features(entries: list[str]):
    def features(text):
        words = folded(text).split()
        stems = tuple(e[1:] for e in entries if not e.endswith(" "))
        whole = {e.strip() for e in entries if e.endswith(" ")}
        hit = [w in whole or w.startswith(stems) if stems else w in whole for w in words]
        return {
            f" {words[i]} {words[i + 1]} "
            for i in range(len(words) - 1)
            if hit[i] or hit[i + 1]
        }

    return features


def learn_lexicon(sample: DataFrame, s: Settings) -> Lexicon:
    """Entries and phrases by smoothed log odds over the sample's documents."""
    totals = Counter({r.label: r["count"] for r in sample.groupBy("label").count().collect()})
    everything = totals[1], totals[0]
    if not all(everything):
        return Lexicon({}, frozenset(), ())
    counted = _counts(sample, _word_features(s.stem)).filter(
        (F.col("toxic") >= s.least_docs)
        & (F.col("toxic") * everything[1] > F.col("other") * everything[0] * np.exp(s.least_odds))
    )
    rows = counted.orderBy(
        (F.col("toxic") - F.col("other")).desc(), F.length("feature"), "feature"
    ).limit(8 * s.entries)
    chosen: dict[str, float] = {}
    for r in rows.collect():
        covered = any(r.feature.startswith(e) or e.startswith(r.feature) for e in chosen)
        if not covered and len(chosen) < s.entries:
            chosen[r.feature] = _log_odds(r.toxic, r.other, *everything)
    if not chosen:
        return Lexicon({}, frozenset(), ())
    harmless = (
        _counts(sample, _phrase_features(sorted(chosen)))
        .filter(F.col("other") >= s.least_docs)
        .filter(
            F.col("toxic") * everything[1] <= F.col("other") * everything[0] * np.exp(s.phrase_odds)
        )
        .orderBy(F.col("other").desc(), "feature")
        .limit(s.phrases)
    )
    return Lexicon(chosen, frozenset(r.feature for r in harmless.collect()), ())


class Matcher:
    """Scores folded text with one automaton over entries and exception phrases."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.automaton = ahocorasick.Automaton()
        for entry, weight in lexicon.weights.items():
            self.automaton.add_word(entry, (len(entry), weight))
        for phrase in lexicon.phrases:
            self.automaton.add_word(phrase, (len(phrase), 0.0))
        self.automaton.make_automaton()

    def features(self, text: str) -> tuple[float, float, float]:
        """(sum of distinct entries' weights, greatest weight, sum over root of length)."""
        norm = folded(text)
        words = norm.count(" ") - 1 if len(norm) > 2 else 0
        if not words or not len(self.automaton):
            return 0.0, 0.0, 0.0
        hits, free = [], []
        for end, (size, weight) in self.automaton.iter(norm):
            start = end + 1 - size
            (hits.append((start, size, weight)) if weight else free.append((start, end)))
        if free:
            hits = [h for h in hits if not any(a <= h[0] < b for a, b in free)]
        if not hits:
            return 0.0, 0.0, 0.0
        best = {norm[a : a + n]: w for a, n, w in hits}
        total = sum(w for _, _, w in hits)
        return (
            min(sum(best.values()), 30.0) / 10,
            max(best.values()) / 5,
            min(total / np.sqrt(words), 10.0),
        )

    def score(self, text: str) -> float:
        weights = self.lexicon.calibration
        if not weights:
            return 0.0
        return float(labelled.sigmoid(np.dot(weights[:-1], self.features(text)) + weights[-1]))


def fit(sample: DataFrame, s: Settings | None = None) -> Lexicon:
    """Lexicon, phrases and the calibration of the score, from rows (doc_id, text, label)."""
    lexicon = learn_lexicon(sample, s or Settings())
    if not lexicon.weights:
        return lexicon
    shared = sample.sparkSession.sparkContext.broadcast(lexicon)

    def make():
        matcher = Matcher(shared.value)
        return lambda text, label: (*matcher.features(text), label)

    rows = map_rows(
        sample.select("text", "label"), make, "a double, b double, c double, label int"
    ).collect()
    data = np.array(sorted(tuple(r) for r in rows), float)
    weights = labelled.logistic(data[:, :3], data[:, 3])
    return Lexicon(lexicon.weights, lexicon.phrases, tuple(float(w) for w in weights))


def score_texts(df: DataFrame, lexicon: Lexicon, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, score, predicted) per row; a text without words has no entry."""
    shared = df.sparkSession.sparkContext.broadcast(lexicon)

    def make():
        matcher = Matcher(shared.value)

        def row(doc_id, text):
            p = matcher.score(text)
            return doc_id, p, int(p >= 0.5)

        return row

    source = texts(df, id_col, text_col)
    return map_rows(source, make, f"doc_id {id_like(source)}, score double, predicted int")


def drop_toxic(df: DataFrame, lexicon: Lexicon, limit: float = 0.5, text_col="text") -> DataFrame:
    """Rows of ``df`` that score below ``limit``, with all their columns."""
    shared = df.sparkSession.sparkContext.broadcast(lexicon)

    def make():
        matcher = Matcher(shared.value)
        return lambda text: matcher.score(text) < limit

    return keep_rows(df, make, text_col)


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    modulus: int = 5,
    held_out: int = 0,
    settings: Settings | None = None,
) -> DataFrame:
    """Learn from labelled rows outside the held-out fold and score every row of ``docs``.

    Every row gives one row, repeated ids too. A row without an id is in no fold. Without
    labels of both kinds nothing can be learned and all scores are zero.
    """
    s = settings or Settings()
    rows = labelled.sample(docs, labels, label, modulus, held_out, s.max_rows)
    scored = score_texts(docs, fit(rows, s))
    fold = F.coalesce(crc_mod("doc_id", modulus) == held_out, F.lit(False))
    return scored.select("doc_id", fold.alias("held_out"), "score", "predicted")
