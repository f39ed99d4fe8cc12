"""Removing repeated byte strings with suffix arrays built by difference cover.

A byte goes if it lies in a string of ``width`` bytes that also starts earlier in the corpus.

1. Anchors. In every window of ``width`` bytes the 32-byte gram with the least hash is its
   anchor, so equal windows have equal anchors at equal places. Consecutive windows of one
   anchor form a run; its bytes are the run's context.
2. A bitmap of fixed size tells which anchors can occur twice. Runs of others are unique.
   Runs of equal bytes are folded in the map task: all but the earliest are repeats.
3. The runs left are shuffled by anchor. Of a crowded anchor only windows that can occur
   twice, by a bitmap of their own, are shuffled, one by one by their bytes, so that no
   anchor's runs need meet in one task.
4. Windows alone in their bucket by a hash are dropped, stretches of equal bytes folded. The
   suffixes of what is left are sorted by the difference-cover algorithm: triples at positions
   not divisible by three are sorted and named, names are sorted recursively, the remaining
   suffixes are merged in. Adjacent suffixes are compared over ``width`` bytes; of a class of
   equal windows all but the earliest are repeats.
5. Repeats are joined to their documents and cut out.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketpulse.llm.common import id_like, map_batches, map_rows, stored, texts

GRAM = 32
#: Most anchors whose windows are shuffled one by one; beyond, only the most frequent ones.
MOST_CROWDED = 100_000
_WORDS = 1 << 14
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """``filter_bits``: log2 of the bitmap's bits; more let fewer unique runs through.
    ``crowded``: occurrences from which an anchor's windows are shuffled one by one.
    ``bucket_bytes``: aim for the run bytes of a bucket. ``stretch``: bytes hashed at once."""

    width: int = 100
    filter_bits: int = 28
    crowded: int = 50_000
    bucket_bytes: int = 4 << 20
    stretch: int = 1 << 20


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Positions of all suffixes of ``t`` in order; a shorter suffix sorts before a longer
    one that it begins. Values must be below 2**32."""
    n = len(t)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: tuple(t[i:])), np.int64)
    _, dense = np.unique(t, return_inverse=True)
    padded = np.concatenate([dense.astype(np.uint64) + np.uint64(1), np.zeros(3, np.uint64)])
    places = np.arange(n + (n % 3 == 1))  # one empty triple ends the first half, if need be
    sample = np.concatenate([places[places % 3 == 1], places[places % 3 == 2]])
    names = _name_triples(padded, sample)
    if int(names.max()) + 1 < len(sample):
        order = suffix_array(names)
        names = np.empty(len(sample), np.int64)
        names[order] = np.arange(len(sample))
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = names + 1
    by_rank = sample[np.argsort(names)]
    by_rank = by_rank[by_rank < n]
    rest = np.arange(0, n, 3)
    bits = np.uint64(int(n + 4).bit_length())

    def one(at):  # a character, then a sampled suffix
        return padded[at] << bits | rank[at + 1].astype(np.uint64)

    rest_keys = one(rest)
    rest = rest[np.argsort(rest_keys, kind="stable")]
    first, second = by_rank[by_rank % 3 == 1], by_rank[by_rank % 3 == 2]
    before = np.searchsorted(one(first), one(rest)) + _before_second(
        padded, rank, bits, second, rest
    )
    out = np.empty(n, np.int64)
    at = before + np.arange(len(rest))
    free = np.ones(n, bool)
    free[at] = False
    out[at] = rest
    out[free] = by_rank
    return out


def _name_triples(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    size = int(padded.max()) + 1
    pair = padded[at] * np.uint64(size) + padded[at + 1]
    if size**3 >= 1 << 63:
        _, pair = np.unique(pair, return_inverse=True)
        pair = pair.astype(np.uint64)
    _, names = np.unique(pair * np.uint64(size) + padded[at + 2], return_inverse=True)
    return names


def _before_second(padded, rank, bits, second, rest) -> np.ndarray:
    """How many of the sorted suffixes ``second`` come before each of ``rest``."""
    size = np.uint64(int(padded.max()) + 1)

    def pair(at):
        return padded[at] * size + padded[at + 1]

    pairs, mine = pair(second), pair(rest)
    values = np.unique(np.concatenate([pairs, mine]))
    key = np.searchsorted(values, pairs).astype(np.uint64) << bits
    other = np.searchsorted(values, mine).astype(np.uint64) << bits
    return np.searchsorted(
        key | rank[second + 2].astype(np.uint64), other | rank[rest + 2].astype(np.uint64)
    )


def repeated_windows(runs: list[bytes], width: int) -> list[np.ndarray]:
    """For runs in corpus order: the windows of each that also start earlier among them."""
    sizes = np.array([len(r) for r in runs])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    t = np.empty(starts[-1], np.int64)
    data = np.frombuffer(b"\0".join(runs) + b"\0", np.uint8)
    t[:] = data
    # Every run ends with a value of its own, so that no suffix equals another.
    t[starts[1:] - 1] = 256 + np.arange(len(runs))
    valid = np.zeros(len(t), bool)
    edge = np.zeros(len(t) + 1, np.int64)
    edge[starts[:-1]] += 1
    edge[starts[:-1] + sizes - width + 1] -= 1
    valid = np.cumsum(edge[:-1]) > 0
    order = suffix_array(t)
    order = order[valid[order]]
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    eight = np.zeros(len(t), np.uint64)
    for k in range(8):
        eight = eight << np.uint64(8) | padded[k : k + len(t)]
    new = np.ones(len(order), bool)
    if len(order) > 1:
        same = np.ones(len(order) - 1, bool)
        for k in [*range(0, width - 7, 8), width - 8]:
            word = eight[order + k]
            same &= word[1:] == word[:-1]
        new[1:] = ~same
    begins = np.flatnonzero(new)
    earliest = np.minimum.reduceat(order, begins) if len(order) else order
    repeat = np.zeros(len(t), bool)
    repeat[order] = True
    repeat[earliest] = False
    return [
        np.flatnonzero(repeat[a : a + n - width + 1])
        for a, n in zip(starts[:-1], sizes, strict=True)
    ]


def gram_hashes(data: np.ndarray, width: int = GRAM) -> np.ndarray:
    """A hash of the ``width`` bytes from each position on, by doubling."""
    h, size = data.astype(np.uint64) + np.uint64(1), 1
    while size < width:
        step = min(size, width - size)
        h = h[:-step] * (_ODD + np.uint64(2 * step)) + h[step:]
        h ^= h >> np.uint64(29)
        size += step
    h *= _ODD
    return h ^ (h >> np.uint64(32))


def likely_repeated(runs: list[bytes], width: int) -> list[tuple[int, int, bytes]]:
    """Stretches of the runs' windows whose hash occurs twice: (run, first window, bytes).

    A window whose hash is alone among the runs equals no other, so none is lost.
    """
    sizes = np.array([len(r) for r in runs])
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(runs), np.uint8)
    edge = np.zeros(len(data) + 1, np.int64)
    edge[ends - sizes] += 1
    edge[ends - width + 1] -= 1
    at = np.flatnonzero(np.cumsum(edge[:-1]))
    h = gram_hashes(data, width)[at]
    ordered = np.sort(h)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return []
    found = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
    at = at[twice[found] == h]
    owner = np.searchsorted(ends, at, side="right")
    first = np.flatnonzero(
        np.concatenate([[True], (np.diff(at) != 1) | (owner[1:] != owner[:-1])])
    )
    last = np.append(first[1:], len(at)) - 1
    begin = (ends - sizes)[owner[first]]
    return [
        (int(r), int(a - b), data[a : z + width].tobytes())
        for r, a, z, b in zip(owner[first], at[first], at[last], begin, strict=True)
    ]


def runs_of(data: np.ndarray, s: Settings):
    """(anchor hash, first window, last window) arrays of one document's runs."""
    parts = []
    for begin in range(0, max(0, len(data) - s.width + 1), s.stretch):
        piece = data[begin : begin + s.stretch + s.width - 1]
        h = gram_hashes(piece)
        span = s.width - GRAM + 1
        least, place, size = h, np.arange(len(h), dtype=np.int32), 1
        while size < span:
            step = min(size, span - size)
            later = least[step:] < least[:-step]  # the leftmost of equals stays
            place = np.where(later, place[step:], place[:-step])
            least = np.where(later, least[step:], least[:-step])
            size += step
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.append(first[1:], len(place)) - 1
        parts.append((least[first], first + begin, last + begin))
    if not parts:
        return (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _anchor_filter(source: DataFrame, s: Settings):
    """(bitmap of anchor slots seen twice, crowded slots, runs in slots seen twice)."""
    twice = _seen_twice(source, s, lambda data: runs_of(data, s)[0], "anchors")
    n_runs = twice.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    crowded = twice.filter(F.col("n") >= max(s.crowded, n_runs // MOST_CROWDED)).select("slot")
    many = np.array(sorted(r.slot for r in crowded.collect()), np.int64)
    return _bitmap(twice, s), many, n_runs


def _window_filter(source: DataFrame, s: Settings, many) -> np.ndarray:
    """Bitmap of the slots that windows of crowded anchors fill twice."""
    shared = source.sparkSession.sparkContext.broadcast(many)

    def keys(data):
        anchor, first, last = runs_of(data, s)
        hot = np.isin(_slots(anchor, s), shared.value)
        return gram_hashes(data, s.width)[_windows(first[hot], last[hot])] if hot.any() else anchor[:0]

    return _bitmap(_seen_twice(source, s, keys, "windows"), s)


def _windows(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    sizes = last - first + 1
    return np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _slots(keys: np.ndarray, s: Settings) -> np.ndarray:
    """Slots of 64-bit hashes. Anchors are least hashes, so their bits are spread first."""
    spread = (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (spread >> np.uint64(64 - s.filter_bits)).astype(np.int64)


def _bit(bitmap: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (bitmap[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) > 0


def _seen_twice(source: DataFrame, s: Settings, keys, name: str) -> DataFrame:
    """(slot, n) of the slots that the 64-bit ``keys`` of all texts fill more than once."""

    def slots(batches):
        for batch in batches:
            found = [
                _slots(keys(np.frombuffer(t.encode("utf-8"), np.uint8)), s) for t in batch["text"]
            ]
            slot, n = np.unique(np.concatenate(found), return_counts=True) if found else ([], [])
            yield {"slot": np.asarray(slot, np.int64), "n": np.asarray(n, np.int64)}

    found = map_batches(source, slots, "slot long, n long").groupBy("slot")
    return stored(found.agg(F.sum("n").alias("n")).filter("n > 1"), name)


def _bitmap(twice: DataFrame, s: Settings) -> np.ndarray:
    """The slots as bits. Its size is a setting; full, it lets everything through."""

    def block(key, pdf):
        words = np.zeros(_WORDS, "<i8")
        words[pdf["word"] % _WORDS] = pdf["bits"]
        return type(pdf)([(key[0], words.tobytes())], columns=["block", "bits"])

    blocks = (
        twice.groupBy(F.expr("slot >> 6").alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 AS int)))").alias("bits"))
        .groupBy(F.floor(F.col("word") / _WORDS).alias("block"))
        .applyInPandas(block, "block long, bits binary")
    )
    bitmap = np.zeros(-(-(1 << s.filter_bits) // 64 // _WORDS) * _WORDS, "<i8")
    for r in blocks.collect():
        bitmap[r.block * _WORDS : (r.block + 1) * _WORDS] = np.frombuffer(r.bits, "<i8")
    return bitmap.view(np.uint64)


class _Fold:
    """Keeps the earliest place of each run's bytes; all later places are repeats."""

    def __init__(self, buckets: int, most: int = 200_000):
        self.buckets, self.most = buckets, most
        self.kept: dict[bytes, tuple] = {}
        self.repeats: list[tuple] = []

    def add(self, key: int, place: tuple, data: bytes):
        digest = xxhash.xxh3_128_digest(data)
        known = self.kept.get(digest)
        if known is None:
            self.kept[digest] = (place, key % self.buckets, data)
        else:
            first, later = sorted((known[0], place), key=_in_order)
            self.kept[digest] = (first, known[1], data)
            self.repeats.append((later, len(data)))

    def rows(self):
        """Kept runs with their bytes, and repeats as joined byte ranges."""
        out = [(b, *place, place[2] + len(d), d) for place, b, d in self.kept.values()]
        ranges: dict[tuple, list] = {}
        for (doc_id, tie, first), size in self.repeats:
            ranges.setdefault((doc_id, tie), []).append((first, first + size))
        for (doc_id, tie), own in ranges.items():
            out += [
                (tie % self.buckets, doc_id, tie, a, b, None) for a, b in joined_ranges(own)
            ]
        self.kept, self.repeats = {}, []
        return out


def _in_order(place):
    doc_id, tie, first = place
    return doc_id is not None, doc_id, tie, first


def joined_ranges(ranges) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_RUN = ("bucket", "doc_id", "tie", "first", "end", "data")


def repeats(source: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, tie, first, end): byte ranges covered by repeated windows.

    ``source`` has (doc_id, tie, text).
    """
    kind = id_like(source)
    bitmap, crowded, n_runs = _anchor_filter(source.select("text"), s)
    windows = _window_filter(source.select("text"), s, crowded) if len(crowded) else None
    shared = source.sparkSession.sparkContext.broadcast((bitmap, crowded, windows))
    mean = s.width + (s.width - GRAM) // 2
    buckets = max(1, n_runs * mean // s.bucket_bytes)

    def open_runs(batches):
        seen, many, seen_windows = shared.value
        fold = _Fold(buckets)
        for batch in batches:
            for doc_id, tie, text in zip(*(batch[c] for c in ("doc_id", "tie", "text")), strict=True):
                raw = text.encode("utf-8")
                anchor, first, last = runs_of(np.frombuffer(raw, np.uint8), s)
                slot = _slots(anchor, s)
                twice, hot = _bit(seen, slot), np.isin(slot, many)
                plain = twice & ~hot
                for key, a, b in zip(
                    anchor[plain].tolist(), first[plain].tolist(), last[plain].tolist(),
                    strict=True,
                ):
                    fold.add(key, (doc_id, tie, a), raw[a : b + s.width])
                if hot.any():
                    each = _windows(first[hot], last[hot])
                    code = gram_hashes(np.frombuffer(raw, np.uint8), s.width)[each]
                    again = _bit(seen_windows, _slots(code, s))
                    for key, p in zip(code[again].tolist(), each[again].tolist(), strict=True):
                        fold.add(key, (doc_id, tie, p), raw[p : p + s.width])
                if len(fold.kept) + len(fold.repeats) > fold.most:
                    yield _columns(fold.rows())
        yield _columns(fold.rows())

    def _columns(rows):
        return {n: [r[i] for r in rows] for i, n in enumerate(_RUN)}

    def sort_bucket(pdf):
        out, best = [], {}
        given = pdf[list(_RUN[1:])].itertuples(index=False, name=None)
        rows = [(None if d is None or d != d else d, *r) for d, *r in given]
        for row in rows:
            if row[4] is None:
                out.append(row[:4])
        open_ = sorted((r for r in rows if r[4] is not None), key=lambda r: _in_order(r[:3]))
        for row in open_:
            if row[4] in best:
                out.append(row[:4])
            else:
                best[row[4]] = row
        rows, left = list(best.values()), {}
        for r, first, data in likely_repeated(list(best), s.width) if best else ():
            place = (*rows[r][:2], rows[r][2] + first)
            if data in left:
                out.append((*place, place[2] + len(data)))
            else:
                left[data] = place
        found = repeated_windows(list(left), s.width) if left else ()
        for (doc_id, tie, first), windows in zip(left.values(), found, strict=True):
            for a, b in joined_ranges((int(p), int(p) + s.width) for p in windows):
                out.append((doc_id, tie, first + a, first + b))
        return type(pdf)(out, columns=["doc_id", "tie", "first", "end"]).astype(
            {"doc_id": pdf["doc_id"].dtype}
        )

    runs = map_batches(
        source, open_runs,
        f"bucket long, doc_id {kind}, tie long, first long, end long, data binary",
    )
    return runs.groupBy("bucket").applyInPandas(
        sort_bucket, f"doc_id {kind}, tie long, first long, end long"
    )


def remove_repeats(
    df: DataFrame,
    settings: Settings | None = None,
    with_text: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row, judged on the input.

    Order is that of ``doc_id`` (a missing one first), then of a hash of the text; rows equal
    in id and text are one document and get the same result. Null and empty texts have no
    bytes. With ``with_text`` the bytes left come as ``kept``, which may cut a character.
    """
    s = settings or Settings()
    source = texts(df, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    found = (
        repeats(source.select("doc_id", "tie", "text"), s)
        .groupBy("doc_id", "tie")
        .agg(F.collect_list(F.struct("first", "end")).alias("ranges"))
        .select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), "ranges")
    )
    joined = source.join(
        found, source.doc_id.eqNullSafe(found._id) & (source.tie == found._tie), "left"
    )

    def make():
        def row(doc_id, text, ranges):
            raw = text.encode("utf-8")
            spans = joined_ranges((r["first"], r["end"]) for r in ranges or [])
            kept, at = [], 0
            for a, b in spans:
                kept.append(raw[at:a])
                at = b
            left = b"".join([*kept, raw[at:]])
            out = (
                doc_id, len(raw), len(raw) - len(left), len(spans),
                hashlib.sha256(left).hexdigest(),
            )
            return (*out, left) if with_text else out

        return row

    return map_rows(
        joined.select("doc_id", "text", "ranges"),
        make,
        f"doc_id {id_like(source)}, n_bytes long, n_removed long, n_spans long, "
        "kept_sha256 string" + (", kept binary" if with_text else ""),
    )
