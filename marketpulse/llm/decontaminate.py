"""Benchmark decontamination with one Aho-Corasick automaton over normalised items.

Items become windows of ``width`` consecutive words. The automaton over all windows runs
once along each normalised text; a match is mapped back to word numbers, and those to
offsets in the original text.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from marketpulse.llm.common import hex_digest, id_like, keep_rows, map_rows, texts

#: Bytes of windows that go into one automaton; a larger benchmark is scanned in blocks.
BLOCK_BYTES = 8 << 20

_WORD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)


def normalised(text: str) -> str:
    """Words joined and enclosed by single blanks; each character is one UTF-8 byte."""
    words = text.encode("utf-8").translate(_WORD).split(b" ")
    return " " + b" ".join(w for w in words if w).decode("latin-1") + " "


def windows(text: str, width: int) -> set[str]:
    """Distinct word windows, each enclosed by blanks; a shorter text is one window."""
    words = normalised(text).split(" ")[1:-1]
    if not words or words == [""]:
        return set()
    count = max(1, len(words) - width + 1)
    return {" " + " ".join(words[i : i + width]) + " " for i in range(count)}


def word_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code point offsets of each word's start and end in the original text."""
    data = np.frombuffer(text.encode("utf-8").translate(_WORD), np.uint8)
    inside = np.concatenate([[False], data != 32, [False]])
    starts = np.flatnonzero(~inside[:-1] & inside[1:])
    ends = np.flatnonzero(inside[:-1] & ~inside[1:])
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return points[starts], points[ends]


def item_blocks(
    benchmark: DataFrame, width: int, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES
) -> Iterator[dict[str, list]]:
    """Windows with their item ids, in blocks of bounded size, read item by item."""
    block: dict[str, set] = {}
    size = 0
    for row in texts(benchmark, id_col, text_col).distinct().toLocalIterator():
        if row.doc_id is None:
            continue
        for window in windows(row.text, width):
            if window not in block:
                if size > block_bytes:
                    yield {k: sorted(v) for k, v in block.items()}
                    block, size = {}, 0
                size += len(window)
            block.setdefault(window, set()).add(str(row.doc_id))
    yield {k: sorted(v) for k, v in block.items()}


def automaton(block: dict[str, list]):
    built = ahocorasick.Automaton()
    for window, items in block.items():
        built.add_word(window, (len(window), items))
    built.make_automaton()
    return built


def scan(text: str, built) -> tuple[int, list[tuple[int, int]], set[str]]:
    """(words, hit word ranges with exclusive ends in order of their ends, items)."""
    norm = normalised(text)
    n_words = norm.count(" ") - 1 if len(norm) > 2 else 0
    ranges, items = [], set()
    at, seen = 0, 0  # words before ``at``
    if n_words and len(built):
        for end, (size, found) in built.iter(norm):
            seen += norm.count(" ", at, end)
            at = end
            inner = norm.count(" ", end - size + 1, end + 1) - 1
            ranges.append((seen - inner, seen))
            items.update(found)
    return n_words, ranges, items


def covered(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of word ranges."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def contamination(
    df: DataFrame,
    benchmark: DataFrame,
    width: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Hit words, items and original spans per row of ``df``.

    ``benchmark`` is a stated query set: its windows are sent to the tasks in blocks of at
    most ``block_bytes``, and every text is scanned against every block. Every row of ``df``
    gives one row; null and empty texts have no words, items without an id or without words
    have no windows. ``hit_spans`` has code point offsets in the original text.
    """
    sc = df.sparkSession.sparkContext
    blocks = [
        sc.broadcast(b)
        for b in item_blocks(benchmark, width, item_col, item_text_col, block_bytes)
    ]

    def make():
        built = [automaton(b.value) for b in blocks]

        def row(doc_id, text):
            ranges, items, n_words = [], set(), 0
            for one in built:
                n_words, more, found = scan(text, one)
                ranges += more
                items |= found
            hit = covered(ranges)
            spans = []
            if hit:
                starts, ends = word_spans(text)
                spans = [f"{starts[a]}:{ends[b - 1]}" for a, b in hit]
            return (
                doc_id, n_words, sum(b - a for a, b in hit), len(items),
                hex_digest(",".join(sorted(items))), bool(hit), ",".join(spans),
            )

        return row

    source = texts(df, id_col, text_col)
    return map_rows(
        source,
        make,
        f"doc_id {id_like(source)}, n_words long, n_hit long, n_items long, "
        "items_sha256 string, contaminated boolean, hit_spans string",
    )


def drop_contaminated(
    df: DataFrame,
    benchmark: DataFrame,
    width: int = 10,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Rows of ``df`` whose text holds no window of any item, with all their columns."""
    sc = df.sparkSession.sparkContext
    blocks = [
        sc.broadcast(b)
        for b in item_blocks(benchmark, width, item_col, item_text_col, block_bytes)
    ]

    def make():
        built = [automaton(b.value) for b in blocks]
        return lambda text: not any(scan(text, one)[1] for one in built)

    return keep_rows(df, make, text_col)
