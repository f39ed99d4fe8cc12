"""Quality rules: repetition counts and zstandard compression bands.

A text is compressed whole and in fixed chunks. Its ratio (bytes before over bytes after)
must lie between two limits that depend on its length: text that repeats itself compresses
too well, noise hardly at all. A chunk is held to the limits of its own length, and one
outside them is enough, so a long clean text is found as well if a repetitive or random
stretch fills one of its chunks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame

from marketpulse.llm.common import id_like, map_rows, texts

SYMBOLS = b"#*$%&|<>"
BLANK = b" \t\n\v\f\r"


@dataclass(frozen=True)
class Bands:
    """Compression limits.

    ``limits`` holds (bytes up to, least ratio, greatest ratio), by length. The least ratio
    of short texts is below one because the frame header counts. ``bad_chunks`` is the share
    of chunks outside their limits from which a text is rejected; at zero, one such chunk is
    enough in a text of any length.
    """

    level: int = 3
    chunk_bytes: int = 8192
    bad_chunks: float = 0.0
    limits: tuple[tuple[float, float, float], ...] = (
        (64, 0.0, 2.0),
        (256, 0.80, 2.2),
        (1024, 1.05, 2.6),
        (4096, 1.20, 3.0),
        (16384, 1.30, 3.6),
        (float("inf"), 1.35, 4.5),
    )

    def inside(self, n_bytes: int, ratio: float) -> bool:
        low, high = next((lo, hi) for most, lo, hi in self.limits if n_bytes <= most)
        return low <= ratio <= high


def word_counts(text: str) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of one text."""
    data = text.encode("utf-8")
    words = data.split()
    n = len(words)
    chars = len(text) - (len(data) - len(data.translate(None, BLANK)))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return n, chars, symbols, len(lines) - len(set(lines)), _repeated(words)


def _repeated(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words which the text holds at least twice."""
    n = len(words)
    if n <= width:
        return 0
    number: dict[bytes, int] = {}
    codes = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    size = len(number)
    if size == n:
        return 0
    # Pairs get dense numbers first, so that no product can pass 64 bits.
    _, pairs = np.unique(codes[:-1] * size + codes[1:], return_inverse=True)
    _, index, counts = np.unique(
        pairs[:-1] * size + codes[2:], return_inverse=True, return_counts=True
    )
    hit = counts[index] > 1
    edge = np.zeros(n + 1, dtype=np.int64)
    edge[: len(hit)] += hit
    edge[width : width + len(hit)] -= hit
    return int((np.cumsum(edge[:n]) > 0).sum())


def band_verdict(text: str, bands: Bands, compressor) -> tuple[float, int, int, bool]:
    """(ratio of the whole text, chunks, chunks outside, inside the bands)."""
    data = text.encode("utf-8")
    if not data:
        return 0.0, 0, 0, True
    ratio = len(data) / len(compressor.compress(data))
    parts = [data[i : i + bands.chunk_bytes] for i in range(0, len(data), bands.chunk_bytes)]
    if len(parts) == 1:
        bad = int(not bands.inside(len(data), ratio))
    else:
        bad = sum(
            not bands.inside(len(p), len(p) / len(compressor.compress(p))) for p in parts
        )
    good = bands.inside(len(data), ratio) and bad < max(1.0, bands.bad_chunks * len(parts))
    return ratio, len(parts), bad, good


def compression_bands(
    df: DataFrame,
    bands: Bands | None = None,
    min_words: int = 50,
    most_repeated: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Counts, compression ratios and the verdict per row of ``df``.

    Every row gives one row, repeated ids too; other columns are not read. A null or empty
    text has no words and fails. ``kept`` is false if a base rule fails, else the verdict of
    the compression bands.
    """
    bands = bands or Bands()
    share = round(most_repeated * 100)

    def make():
        compressor = zstandard.ZstdCompressor(level=bands.level)

        def row(doc_id, text):
            counts = word_counts(text)
            n, repeated = counts[0], counts[4]
            failed = n < min_words or 100 * repeated > share * n
            ratio, parts, bad, good = band_verdict(text, bands, compressor)
            return doc_id, *counts, failed, good and not failed, ratio, parts, bad

        return row

    source = texts(df, id_col, text_col)
    return map_rows(
        source,
        make,
        f"doc_id {id_like(source)}, n_words long, word_chars long, n_symbols long, "
        "n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
        "ratio double, n_chunks long, bad_chunks long",
    )
