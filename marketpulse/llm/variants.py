"""Spelling variants: words one edit apart, found by Gram matrices of letter counts in blocks.

A word is a vector of letter counts. One inserted or deleted letter puts two words at squared
distance 1 with lengths one apart; one replaced letter at squared distance 2 with equal
lengths. Distances of a block come from one NumPy product of its vectors, and what is near
enough is verified letter by letter.

Blocks lose no pair. The letters are dealt into groups of like frequency; an edit touches two
groups at most, so words one edit apart agree in the counts of all others. A word enters one
block for each choice of all groups but two. Inside a block only equal and adjacent lengths
meet. A block too large for one task is cut into tiles that meet pair by pair.
"""

from __future__ import annotations

import itertools
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from marketpulse.llm.common import map_batches, stored, texts

_CLASS = "a-zÀ-ÿ"
_LATIN = 0xC0
#: Letters a word may hold: a-z and the 64 of the class's upper range.
LETTERS = 26 + 64
#: Rows of one side of a matrix product.
_STRIP = 256
#: Words up to this length are verified as rows of one matrix.
_WIDE = 48
_COMBO_BITS = 4
#: Candidates of a task that are verified at once.
_VERIFY = 50_000


@dataclass(frozen=True)
class Settings:
    """``groups`` letters groups, two of which may differ; ``tile`` words of a block a task.

    A word's form has at least ``ratio`` times its occurrences.
    """

    least_length: int = 7
    least_count: int = 2
    ratio: int = 10
    groups: int = 5
    tile: int = 4096

    def __post_init__(self):
        if self.ratio < 2 or not 3 <= self.groups <= 6:
            raise ValueError("ratio must be at least 2, groups between 3 and 6")

    @property
    def combos(self) -> list[tuple[int, ...]]:
        return list(itertools.combinations(range(self.groups), self.groups - 2))


def word_counts(
    df: DataFrame,
    settings: Settings | None = None,
    misspell_every: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(word, n): runs of letters, A-Z in lower case, that occur often enough in all texts.

    Null texts have no words. With ``misspell_every`` = m, the run of a document whose crc32
    of ``<doc_id>:<run>`` m divides loses its letter number crc32 modulo length; a missing id
    reads as empty there. Runs are extracted, counted and cut with built-in functions only.
    """
    s = settings or Settings()
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    pattern = F.lit(f"[{_CLASS}]{{{s.least_length},}}")
    runs = texts(df, id_col, text_col).select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(lower, pattern, F.lit(0))).alias("run"),
    )
    word = F.col("run")
    if misspell_every:
        crc = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        at = (crc % F.char_length("run")).cast("int")
        cut = F.concat(
            F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.char_length("run"))
        )
        word = F.when(crc % misspell_every == 0, cut).otherwise(F.col("run"))
    counts = runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.filter(
        (F.char_length("word") >= s.least_length) & (F.col("n") >= s.least_count)
    )


def letter_counts(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts by word and letter, lengths, and all letters one after the other."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    letters = np.where(points < 128, points - ord("a"), points - _LATIN + 26)
    cell = np.repeat(np.arange(len(words)), size) * LETTERS + letters
    counts = np.bincount(cell, minlength=len(words) * LETTERS)
    return counts.reshape(len(words), LETTERS), size, letters


def letter_groups(words: DataFrame, groups: int) -> np.ndarray:
    """The group of each letter: the most frequent letters are dealt first, to the least load."""

    def run(batches):
        total = np.zeros(LETTERS, np.int64)
        for batch in batches:
            total += letter_counts(batch["word"])[0].sum(axis=0)
        yield {"letter": list(range(LETTERS)), "n": total.tolist()}

    sums = map_batches(words.select("word"), run, "letter int, n long").groupBy("letter").sum("n")
    total = np.zeros(LETTERS, np.int64)
    for letter, n in sums.collect():  # one row per letter
        total[letter] = n
    load, out = [0] * groups, np.zeros(LETTERS, np.int64)
    for letter in np.argsort(-total, kind="stable"):
        g = int(np.argmin(load))
        out[letter], load[g] = g, load[g] + int(total[letter])
    return out


def group_weights(group: np.ndarray, groups: int) -> np.ndarray:
    """Random weights by letter and group; letter counts times these are a hash per group."""
    weights = np.random.default_rng(7).integers(1, 1 << 62, LETTERS, np.int64)
    return np.where(group[:, None] == np.arange(groups), weights[:, None], 0)


def _keyed(words: DataFrame, by_group: np.ndarray, s: Settings) -> DataFrame:
    """(key, word, n): a word once per choice of groups; the low bits tell the choice."""
    combos = s.combos
    schema = T._parse_datatype_string("key long, word string, n long")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                sums = letter_counts(part.column(0).to_pylist())[0] @ by_group
                for number, combo in enumerate(combos):
                    key = sums[:, list(combo)].sum(axis=1)
                    key = (key ^ (key >> 29)) << _COMBO_BITS | number
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key), part.column(0), part.column(1)], schema=arrow
                    )

    return words.select("word", "n").mapInArrow(run, schema)


def _tiles(keyed: DataFrame, s: Settings) -> DataFrame:
    """(key, i, j, tile, word, n, size): blocks of several words, large ones as pairs of tiles."""
    sizes = (
        keyed.groupBy("key")
        .agg(F.count("*").alias("size"))
        .filter("size > 1")
        .withColumn("tiles", F.ceil(F.col("size") / s.tile).cast("int"))
    )
    own = (F.crc32(F.col("word").cast("binary")) % F.col("tiles")).cast("int")
    placed = keyed.join(sizes.select("key", "tiles"), "key").withColumn("tile", own)
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    return placed.select("key", "tile", other, "word", "n").select(
        "key",
        F.least("tile", "other").alias("i"),
        F.greatest("tile", "other").alias("j"),
        "tile",
        "word",
        "n",
        F.char_length("word").alias("size"),
    )


def one_edit(a: str, b: str) -> bool:
    """Whether words differ by exactly one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def _edits(words, size, letters, left, right) -> np.ndarray:
    """For each pair of rows, the shorter word left, whether it is one edit apart."""
    out = np.zeros(len(left), bool)
    wide = size[right] > _WIDE
    for k in np.flatnonzero(wide):
        out[k] = one_edit(words[left[k]], words[right[k]])
    near = np.flatnonzero(~wide)
    if not len(near):
        return out
    rows, at = np.unique(np.concatenate([left[near], right[near]]), return_inverse=True)
    width = int(size[rows].max()) + 2
    begins = (np.cumsum(size) - size)[rows]
    column = np.arange(width)
    held = column < size[rows][:, None]
    matrix = np.full((len(rows), width), -1, np.int16)
    matrix[held] = letters[(begins[:, None] + column)[held]]
    short, long = matrix[at[: len(near)]], matrix[at[len(near) :]]
    same = size[left[near]] == size[right[near]]
    differ = short != long
    first = differ.argmax(axis=1)
    shifted = (short[:, :-1] != long[:, 1:]) & (column[:-1] >= first[:, None])
    out[near] = np.where(same, differ.sum(axis=1) == 1, ~shifted.any(axis=1))
    return out


def _strips(block: np.ndarray, size: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """Pairs of row strips that share a block and lengths at most one apart."""
    n = len(block)
    for a in range(0, n, _STRIP):
        own = slice(a, min(a + _STRIP, n))
        yield own, own
        last = own.stop - 1
        for b in range(own.stop, n, _STRIP):
            if block[b] != block[last] or size[b] > size[last] + 1:
                break
            yield own, slice(b, min(b + _STRIP, n))


def block_pairs(
    words: list[str], block: np.ndarray, tile: np.ndarray, split: np.ndarray, choice: np.ndarray,
    combos: list[tuple[int, ...]], by_group: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of words one edit apart in rows sorted by block and length.

    Rows of a ``split`` block belong to two tiles and meet across these only. A pair that
    several choices of groups bring together is given by the first of them.
    """
    counts, size, letters = letter_counts(words)
    kind = np.float32 if size.max() < 2000 else np.float64  # squares stay exact
    x = counts[:, counts.any(axis=0)].astype(kind)
    half = -0.5 * (x * x).sum(axis=1, keepdims=True)
    one = np.ones_like(half)
    # Products of these rows are minus half the squared distance.
    row, col = np.hstack([x, half, one]), np.hstack([x, one, half])
    sums = counts @ by_group
    held, rows, out = [], 0, [np.empty((2, 0), np.int64)]

    def verified() -> np.ndarray:
        left, right = np.concatenate(held, axis=1)
        same = sums[left] == sums[right]
        clean = np.stack([same[:, list(c)].all(axis=1) for c in combos], axis=1)
        own = clean.argmax(axis=1) == choice[left]
        left, right = left[own], right[own]
        near = _edits(words, size, letters, left, right)
        return np.stack([left[near], right[near]])

    for a, b in _strips(block, size):
        product = row[a] @ col[b].T
        i, j = np.nonzero((product > -1.25) & (product < -0.25))
        twice = np.rint(-2 * product[i, j]).astype(np.int64)
        i, j = i + a.start, j + b.start
        gap = size[j] - size[i]
        fine = (block[i] == block[j]) & (twice == np.where(gap == 0, 2, 1))
        fine &= (gap == 1) | ((gap == 0) & (i < j)) if a == b else (gap >= 0) & (gap <= 1)
        fine &= ~split[i] | (tile[i] != tile[j])
        held.append(np.stack([i[fine], j[fine]]))
        rows += len(held[-1][0])
        if rows > _VERIFY:
            out.append(verified())
            held, rows = [], 0
    if rows:
        out.append(verified())
    return tuple(np.concatenate(out, axis=1))


def near_pairs(words: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(a, n_a, b, n_b): each pair of words of ``words`` (word, n) one edit apart, once."""
    s = settings or Settings()
    by_group = group_weights(letter_groups(words, s.groups), s.groups)
    combos = s.combos
    key = ["key", "i", "j"]
    tasks = (
        _tiles(_keyed(words, by_group, s), s)
        .repartition(*key)
        .sortWithinPartitions(*key, "size")
        .select("key", "i", "j", "tile", "word", "n")
    )
    schema = T._parse_datatype_string("a string, n_a long, b string, n_b long")
    arrow = to_arrow_schema(schema)

    def search(table: pa.Table) -> pa.RecordBatch:
        keys, i, j, tile = (table.column(c).to_numpy() for c in range(4))
        words, n = table.column(4).to_pylist(), table.column(5).to_numpy()
        new = np.ones(len(words), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        choice = keys & ((1 << _COMBO_BITS) - 1)
        left, right = block_pairs(words, np.cumsum(new), tile, i != j, choice, combos, by_group)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([words[k] for k in left], pa.string()), pa.array(n[left]),
                pa.array([words[k] for k in right], pa.string()), pa.array(n[right]),
            ],
            schema=arrow,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < 2 * s.tile:
                continue
            table = pa.Table.from_batches(held)
            ends = [table.column(c).to_numpy() for c in range(3)]
            # The last block may go on in the next batch.
            open_ = np.logical_and.reduce([e == e[-1] for e in ends])
            whole = int(np.argmax(open_))
            if whole:
                yield search(table.slice(0, whole))
                table = table.slice(whole)
            held, rows = table.to_batches(), table.num_rows
        if rows:
            yield search(pa.Table.from_batches(held))

    return tasks.mapInArrow(run, schema)


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): pointers are doubled, so rounds are few.

    A form has ``ratio`` times the occurrences of its word, so chains are short and end.
    """
    at = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        jump = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = stored(at.join(jump, "root", "left"), "roots")
        if after.filter("next IS NOT NULL").isEmpty():
            return at
        at = after.select("word", F.coalesce("next", "root").alias("root"))


def spelling_variants(words: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``words`` (word, n).

    ``words`` holds each word once, made of a-z and the letters U+00C0 to U+00FF. A word's
    form is the word one edit apart of largest n, of equal ones the first in code-point
    order, if its n is ``ratio`` times the word's own; else null. The root follows forms to
    the last, and is the word itself without one. No words give no rows.
    """
    s = settings or Settings()
    words = stored(words.select("word", "n"), "words")
    pairs = stored(near_pairs(words, s), "near")
    both = pairs.select(
        F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")
    ).union(pairs.select("b", "a", "n_a"))
    best = both.groupBy("word").agg(
        F.count("*").alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"),
    )
    top = -F.col("best.less")
    formed = F.col("best").isNotNull() & (top >= s.ratio * F.col("n"))
    named = stored(
        words.join(best, "word", "left").select(
            "word",
            F.when(formed, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(formed, top).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(named.filter("form IS NOT NULL"))
    return named.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
