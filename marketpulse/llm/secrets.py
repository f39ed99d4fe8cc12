"""Secret scans: base patterns, and formats learned from the credentials those label.

The base patterns find assignments, access keys and long hexadecimal runs. Their values are
labelled credentials: for each kind, grammar inference gives a probabilistic automaton of
the format. All other candidates, runs of credential characters at least as long as the
shortest labelled value, are scored by how much likelier a format makes them than ordinary
runs do; those above a threshold, taken from labelled values and ordinary runs that taught
nothing, are reported as kind ``format``.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketpulse.llm import automata
from marketpulse.llm.common import (
    hex_digest,
    id_like,
    map_batches,
    map_rows,
    replace_texts,
    stored,
    texts,
)

KINDS = ("assign", "access", "hex", "format")
_WORDS = ("passw", "secret", "token", "api")
_ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
    r"""([A-Za-z0-9+/_.=-]+)""",
    re.ASCII,
)
# Cut to the least length at once: a shorter run of these classes holds no longer match.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CHARS = "[A-Za-z0-9+/_.=-]"
#: What the base patterns can find is at least as long as this.
_SHORTEST = 6
_RUN = re.compile(_CHARS + "{%d,}" % _SHORTEST)
_LONG_RUN = re.compile(_CHARS + "{20,}")

Span = tuple[int, int, str]


@dataclass(frozen=True)
class Settings:
    """``max_examples`` bounds the labelled values of a kind, and the ordinary runs, that the
    automata are inferred from, ``max_chars`` their characters together. A kind with fewer
    than ``least_examples`` values has no frequencies to compare and gets no automaton; a value
    longer than that share of ``max_chars`` teaches nothing.

    ``keep`` is the share of labelled values a threshold admits, ``refuse`` the share of
    ordinary runs it turns away.
    """

    max_examples: int = 1000
    max_chars: int = 100_000
    least_examples: int = 10
    alpha: float = 0.05
    keep: float = 0.98
    refuse: float = 0.99
    least_gain: float = 0.25

    @property
    def longest(self) -> int:
        return self.max_chars // self.least_examples


@dataclass(frozen=True)
class Formats:
    """Automata of the kinds, of ordinary runs, the gain a candidate needs per kind, and the
    length of the shortest labelled value, from which on runs are candidates."""

    kinds: dict[str, automata.Automaton]
    ordinary: automata.Automaton | None
    least: dict[str, float]
    shortest: int = _SHORTEST

    def best(self, text: str) -> tuple[str, float]:
        """The kind with the greatest gain over its threshold, per character."""
        if not self.kinds:
            return "", -math.inf
        plain = self.ordinary.log_likelihood(text)
        gains = {k: a.log_likelihood(text) - plain - self.least[k] for k, a in self.kinds.items()}
        kind = max(sorted(gains), key=gains.get)
        return kind, gains[kind]


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the base patterns, leftmost and non-overlapping per kind."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [
            (*m.span(), "assign", m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6
        ]
    for run in _LONG_RUN.finditer(text):
        # Both patterns match credential characters only, so they lie inside one run.
        start, value = run.start(), run[0]
        for kind, pattern in (("access", _ACCESS), ("hex", _HEX)):
            out += [
                (start + m.start(), start + m.end(), kind, m[0]) for m in pattern.finditer(value)
            ]
    return out


class Judge:
    """Finds the candidates of a text that a format accepts; remembers verdicts on short runs."""

    def __init__(self, formats: Formats, remembered: int = 100_000):
        self.formats, self.remembered = formats, remembered
        self.run = re.compile(_CHARS + "{%d,}" % max(1, formats.shortest))
        self.verdicts: dict[str, bool] = {}

    def accepts(self, value: str) -> bool:
        known = self.verdicts.get(value)
        if known is None:
            known = self.formats.best(value)[1] >= 0
            if len(value) <= 64:
                if len(self.verdicts) >= self.remembered:
                    self.verdicts.clear()
                self.verdicts[value] = known
        return known

    def spans(self, text: str, base: list[Span]) -> list[Span]:
        """Accepted candidates that touch no base span."""
        if not self.formats.kinds:
            return []
        found = {v for v in set(self.run.findall(text)) if self.accepts(v)}
        if not found:
            return []
        taken = Taken(base)
        return [
            (*m.span(), "format") for m in self.run.finditer(text)
            if m[0] in found and not taken.touches(*m.span())
        ]


class Taken:
    """Spans, joined where they overlap, that tell whether another one touches them."""

    def __init__(self, spans):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(x[:2] for x in spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def touches(self, a: int, b: int) -> bool:
        before = bisect_left(self.starts, b) - 1
        return before >= 0 and self.ends[before] > a


def joined(spans: list[Span]) -> str:
    order = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{k}:{a}:{b}" for a, b, k in order)


def learn_formats(df: DataFrame, s: Settings | None = None) -> Formats:
    """Infer the automata from rows (doc_id, text).

    All texts are searched. Of the distinct labelled values of a kind, and of the distinct
    ordinary runs, the first ``max_examples`` by a hash are used, up to ``max_chars``
    characters. Ordinary runs are as short as a base pattern's least value, so that words
    outnumber credentials without a label among them.
    """
    s = s or Settings()

    def found(batches):
        lowest: dict[str, str] = {}
        known: set[str] = set()
        for batch in batches:
            labelled = set()
            for text in batch["text"]:
                base = base_spans(text)
                labelled.update((k, v) for _, _, k, v in base)
                if base:
                    taken = Taken(base)
                    runs = {m[0] for m in _RUN.finditer(text) if not taken.touches(*m.span())}
                else:
                    runs = set(_RUN.findall(text))
                for v in runs - known:
                    if len(v) <= s.longest:
                        lowest[hex_digest(v)] = v
                if len(known) > 100_000:
                    known.clear()
                known.update(v for v in runs if len(v) <= 64)
            # Ordinary runs are many: a task passes on those that hash lowest.
            if len(lowest) > s.max_examples:
                lowest = {h: lowest[h] for h in sorted(lowest)[: s.max_examples]}
            yield _example_rows(list(labelled))
        yield _example_rows([("", v) for v in lowest.values()])

    values = map_batches(df.select("text"), found, "kind string, value string").distinct()
    size = F.length("value")
    ranked = stored(
        values.withColumns({"hash": F.sha2("value", 256), "size": size}), "values"
    )
    # Binary digits of a hash's beginning: as many as hold enough values of a kind, so that
    # its order stays a small task. Tasks have passed on low hashes, so none can be foretold.
    bits = F.length(F.conv(F.substring("hash", 1, 12), 16, 2))
    usable = ranked.filter(F.col("size") <= s.longest).withColumn("bits", bits)
    totals = usable.groupBy("kind", "bits").agg(
        F.count("*").alias("n"), F.min("size").alias("least")
    )
    totals = totals.orderBy("kind", "bits").collect()
    # The shortest of all labelled values, whichever are learned from.
    shortest = min((r.least for r in totals if r.kind), default=_SHORTEST)
    enough, seen = {}, dict.fromkeys(("", *KINDS[:3]), 0)
    for r in totals:
        if seen[r.kind] < s.max_examples:
            seen[r.kind] += r.n
            enough[r.kind] = r.bits
    early = F.lit(False)
    for kind, most in enough.items():
        early |= (F.col("kind") == kind) & (F.col("bits") <= most)
    usable = usable.filter(early)
    order = Window.partitionBy("kind").orderBy("hash")
    first = usable.withColumn("place", F.row_number().over(order))
    first = first.filter(F.col("place") <= s.max_examples)
    picked = first.withColumn("chars", F.sum("size").over(order)).filter(
        F.col("chars") <= s.max_chars
    )
    examples: dict[str, list[str]] = {}
    for r in picked.orderBy("hash").select("kind", "value").collect():
        examples.setdefault(r.kind, []).append(r.value)
    return formats_of(examples, s, shortest)


def _example_rows(rows: list[tuple[str, str]]) -> dict[str, list[str]]:
    return {"kind": [r[0] for r in rows], "value": [r[1] for r in rows]}


def formats_of(
    examples: dict[str, list[str]], s: Settings, shortest: int = _SHORTEST
) -> Formats:
    """Automata of the example values per kind; "" holds ordinary runs.

    Every fifth example sets the threshold and teaches nothing. A kind whose values gain no
    more than ordinary runs do is no format.
    """
    plain = examples.get("", [])
    taught = [v for i, v in enumerate(plain) if i % 5]
    if len(taught) < 2:
        taught = [*taught, "ordinary-words-in-a-row", "internationalisation"]
    ordinary = automata.infer(taught, s.alpha)
    kinds, least = {}, {}
    for kind in KINDS[:3]:
        values = examples.get(kind, [])
        if len(values) < s.least_examples:
            continue
        learned = automata.infer([v for i, v in enumerate(values) if i % 5], s.alpha)

        def gains(unseen: list[str]) -> list[float]:
            return sorted(
                learned.log_likelihood(v) - ordinary.log_likelihood(v) for v in unseen[::5]
            )

        own, other = gains(values), gains(plain)
        bounds = [s.least_gain, own[int((1 - s.keep) * len(own))]]
        if len(other) > 1:
            bounds.append(other[int(s.refuse * (len(other) - 1))])
        if max(bounds) <= own[-1]:
            kinds[kind], least[kind] = learned, max(bounds)
    return Formats(kinds, ordinary, least, shortest)


def scan(df: DataFrame, formats: Formats, id_col="doc_id", text_col="text") -> DataFrame:
    """Base and learned spans per row; offsets count code points, ends are exclusive.

    Every row gives one row; a null or empty text has no spans. ``redacted`` is the text
    with every span replaced by ``[SECRET]``.
    """
    shared = df.sparkSession.sparkContext.broadcast(formats)

    def make():
        judge = Judge(shared.value)

        def row(doc_id, text):
            base, spans = all_spans(text, judge)
            counts = [sum(k == kind for _, _, k in base) for kind in KINDS[:3]]
            return (
                doc_id, *counts, hex_digest(joined(base)), joined(spans), redacted(text, spans),
            )

        return row

    source = texts(df, id_col, text_col)
    return map_rows(
        source,
        make,
        f"doc_id {id_like(source)}, n_assign long, n_access long, n_hex long, "
        "base_sha256 string, spans string, redacted string",
    )


def all_spans(text: str, judge: Judge) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans."""
    base = [b[:3] for b in base_spans(text)]
    return base, base + judge.spans(text, base)


def redact(df: DataFrame, formats: Formats, text_col="text") -> DataFrame:
    """All rows and columns of ``df``; every secret in a text becomes ``[SECRET]``.

    Null and empty texts stay as they are.
    """
    shared = df.sparkSession.sparkContext.broadcast(formats)

    def make():
        judge = Judge(shared.value)
        return lambda text: redacted(text, all_spans(text, judge)[1])

    return replace_texts(df, make, text_col)


def redacted(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    if not spans:
        return text
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def find_secrets(
    df: DataFrame, settings: Settings | None = None, id_col="doc_id", text_col="text"
) -> DataFrame:
    """Learn formats from all texts of ``df``, then scan each of its rows."""
    return scan(df, learn_formats(texts(df, id_col, text_col), settings), id_col, text_col)
