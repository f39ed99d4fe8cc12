"""MinHash near-duplicates: one-permutation hashing, banded buckets, star-shaped candidates.

1. One hash per shingle gives the whole signature: its high bits name a bin, and a bin keeps
   its least hash. Empty bins are filled by optimal densification: each probes bins by a hash
   of its own number and attempt until it meets a filled one, so two sets agree in a bin with
   a probability equal to their similarity.
2. Bands of the signature are bucket keys. Linked sets (similarity 0.85 or more) share no band
   of six in 32 with a probability below 3e-7.
3. A bucket of n sets gives the n - 1 edges to its smallest id, a star, so candidates are in
   proportion to rows of buckets. Candidates are confirmed on the full sets.
4. A star says nothing of two members that are both unlike its centre. Buckets whose members
   do not hang together after the stars are searched exactly: sizes of linked sets differ by
   a bounded ratio, so members are cut into rings by size and only adjacent rings meet, in
   blocks of bounded size; no pairs are written but links that join.

Copies of one word sequence are folded before all of this.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketpulse.llm import jaccard
from marketpulse.llm.common import id_like, map_batches, map_rows, salt, salted_join, stored, texts
from marketpulse.llm.graph import components

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Edges of one star centre in a task.
STAR_ROWS = 1000
#: Ids are broadcast up to this number, 32 MB of hash table at most.
BROADCAST_IDS = 500_000


@dataclass(frozen=True)
class Settings:
    """Linked: ``100 * intersection >= percent * union`` of sets of ``width``-word shingles.

    ``task_shingles`` bounds the shingles of an open bucket, or pair of blocks, in one task.
    """

    width: int = 3
    percent: int = 85
    bands: int = 32
    rows: int = 6
    task_shingles: int = 2_000_000

    @property
    def bins(self) -> int:
        return self.bands * self.rows

    @property
    def exact(self) -> jaccard.Settings:
        return jaccard.Settings(width=self.width, num=self.percent, den=100)


class Signer:
    """Bands of a set of 64-bit hashes."""

    def __init__(self, s: Settings):
        self.s = s
        numbers = np.arange(s.bins, dtype=np.uint64)
        self.numbers = numbers
        self.marks = jaccard._mix((numbers + np.uint64(1)) * _ODD)
        self.band_marks = jaccard._mix((numbers[: s.bands] + np.uint64(7)) * _ODD)
        self.probes = self._probes(0)

    def _probes(self, begin: int) -> np.ndarray:
        """The bins that each bin looks at in the attempts from ``begin`` on."""
        tries = np.arange(begin, begin + 1024, dtype=np.uint64)[:, None]
        seeds = (tries << np.uint64(20)) + self.numbers
        return ((jaccard._mix(seeds * _ODD) >> np.uint64(33)) % np.uint64(self.s.bins)).astype(int)

    def bins(self, hashes: np.ndarray) -> np.ndarray:
        """The signature of sorted distinct hashes; one value per bin."""
        count = np.uint64(self.s.bins)
        at = ((hashes >> np.uint64(32)) * count) >> np.uint64(32)
        first = np.ones(len(at), bool)
        first[1:] = at[1:] != at[:-1]
        filled = np.zeros(self.s.bins, bool)
        out = np.zeros(self.s.bins, np.uint64)
        own = at[first].astype(np.int64)
        out[own], filled[own] = hashes[first], True
        empty = np.flatnonzero(~filled)
        # Probes come in as many attempts at once as will mostly do.
        probes, begin, at_once = self.probes, 0, 4 * self.s.bins // max(len(own), 1) + 1
        while len(empty):
            if begin and begin % 1024 == 0:
                probes = self._probes(begin)
            low = begin % 1024
            probe = probes[low : low + at_once, empty]
            hit = filled[probe]
            done = hit.any(axis=0)
            out[empty[done]] = out[probe[hit.argmax(axis=0), np.arange(len(empty))][done]]
            empty, begin = empty[~done], begin + len(probe)
        return out

    def bands(self, hashes: np.ndarray) -> np.ndarray:
        """One 64-bit key per band; a set without elements has none."""
        if not len(hashes):
            return np.empty(0, np.int64)
        mixed = jaccard._mix(self.bins(hashes) ^ self.marks)
        total = mixed.reshape(self.s.bands, self.s.rows).sum(axis=1)
        return jaccard._mix(total + self.band_marks).view(np.int64)


def _prepared(source: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, n, copy, bands) of every row: set size, digest of the words, bucket keys."""

    def make():
        known, signer = jaccard._Hashes(), Signer(s)

        def row(doc_id, text):
            words = jaccard.words_of(text)
            hashes = jaccard.shingle_hashes(words, s.width, known)
            digest = hashlib.md5(b" ".join(words)).digest()
            return doc_id, len(hashes), digest, signer.bands(hashes)

        return row

    return map_rows(
        source, make, f"doc_id {id_like(source)}, n int, copy binary, bands array<long>"
    )


def _members(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Star edges (x, c, salts) of all buckets, and rows (key, x, n) of those above two.

    ``rows`` has (key, x, n). A bucket of two sets is its own star.
    """
    buckets = stored(
        rows.groupBy("key")
        .agg(F.min("x").alias("c"), F.max("x").alias("most"), F.count("*").alias("size"))
        .filter("c < most"),
        "buckets",
    )
    two = buckets.filter("size = 2").select(F.col("most").alias("x"), "c", F.lit(1).alias("salts"))
    salts = F.ceil(F.col("size") / STAR_ROWS).cast("int").alias("salts")
    many = buckets.filter("size > 2").select("key", "c", salts)
    members = stored(salted_join(rows, many, "key", "x", "inner"), "members")
    return two.union(members.filter("x <> c").select("x", "c", "salts")), members


def _confirmed(edges: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Edges (a, b) whose full sets are linked. A centre's edges are dealt over tasks."""
    kind, exact = id_like(sets), s.exact
    pairs = edges.groupBy("x", "c").agg(F.max("salts").alias("salts"))
    dealt = stored(
        pairs.select("x", "c", salt("x", F.col("salts")).cast("int").alias("salt")), "stars"
    )
    own = dealt.join(sets.select(F.col("doc_id").alias("x"), F.col("hashes").alias("hx")), "x")
    centres = (
        dealt.select("c", "salt")
        .distinct()
        .join(sets.select(F.col("doc_id").alias("c"), F.col("hashes").alias("hc")), "c")
    )

    def run(batches):
        for batch in batches:
            keep = []
            for hx, hc in zip(batch["hx"], batch["hc"], strict=True):
                a, b = np.frombuffer(hx, np.uint64), np.frombuffer(hc, np.uint64)
                shared = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(exact.linked(shared, len(a) + len(b) - shared))
            yield {
                "a": [x for x, k in zip(batch["x"], keep, strict=True) if k],
                "b": [c for c, k in zip(batch["c"], keep, strict=True) if k],
            }

    joined = own.join(centres, ["c", "salt"]).select("x", "c", "hx", "hc")
    return map_batches(joined, run, f"a {kind}, b {kind}")


def _open_tasks(members: DataFrame, known: DataFrame, s: Settings) -> DataFrame:
    """(key, ring, i, j, x, label): what the stars leave undecided, in tasks of bounded size.

    Members of a bucket with one label hang together already. Buckets of equal members, which
    linked sets share in many bands, are searched once. Sizes of linked sets differ by less
    than a ring, so each set goes to the task of its ring and of the one below.
    """
    labelled = stored(
        members.select("key", "x", "n")
        .join(known, "x", "left")
        .withColumn("label", F.coalesce("label", "x")),
        "labelled",
    )
    mixed = F.min("label").alias("least"), F.max("label").alias("most")
    open_ = (
        labelled.groupBy("key")
        .agg(*mixed, F.count("*").alias("size"), F.bit_xor(F.xxhash64("x")).alias("print"))
        .filter("least <> most")
        .groupBy("size", "print")
        .agg(F.min("key").alias("key"))
        .select("key")
    )
    step = math.log(100 / s.percent) * 1.0001
    ring = F.floor(F.log("n") / step).cast("int")
    rows = stored(
        salted_join(labelled, open_, "key", "x", "inner").select(
            "key", "x", "n", "label", F.explode(F.array(ring, ring - 1)).alias("ring")
        ),
        "open",
    )
    sizes = (
        rows.groupBy("key", "ring")
        .agg(*mixed, F.sum("n").alias("weight"))
        .filter("least <> most")
        .select(
            "key",
            "ring",
            F.when(F.col("weight") <= s.task_shingles, 1)
            .otherwise(F.ceil(2 * F.col("weight") / s.task_shingles))
            .cast("int")
            .alias("blocks"),
        )
    )
    block = salt("x", F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    return (
        rows.join(sizes, ["key", "ring"])
        .select("key", "ring", "x", "label", block.alias("block"), other)
        .select(
            "key", "ring", F.least("block", "other").alias("i"),
            F.greatest("block", "other").alias("j"), "x", "label",
        )
    )


def _open_links(members: DataFrame, known: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Links (a, b) that join different labels of one bucket."""
    kind, exact = id_like(sets), s.exact
    key = ["key", "ring", "i", "j"]
    tasks = _open_tasks(members, known, s).join(
        sets.select(F.col("doc_id").alias("x"), "hashes"), "x"
    )
    ordered = (
        tasks.select(*key, "x", "label", "hashes").repartition(*key).sortWithinPartitions(*key)
    )

    def rows(batches):
        for batch in batches:
            yield from zip(*batch.values(), strict=True)

    def run(batches):
        out = []
        for _, own in groupby(rows(batches), key=lambda r: r[:4]):
            *_, ids, labels, hashes = zip(*own, strict=True)
            if len(set(labels)) > 1:
                found = [np.frombuffer(h, np.uint64) for h in hashes]
                out += jaccard.block_links(list(ids), list(labels), found, exact)
            if len(out) > 10_000:
                yield {"a": [r[0] for r in out], "b": [r[1] for r in out]}
                out = []
        yield {"a": [r[0] for r in out], "b": [r[1] for r in out]}

    return map_batches(ordered, run, f"a {kind}, b {kind}")


def _sets(ids: DataFrame, source: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, hashes) of the rows of ``source`` among ``ids``."""

    def make():
        known = jaccard._Hashes()

        def row(doc_id, text):
            hashes = jaccard.shingle_hashes(jaccard.words_of(text), s.width, known)
            return doc_id, hashes.tobytes()

        return row

    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    rows = source.join(side, "doc_id", "left_semi").select("doc_id", "text")
    return map_rows(rows, make, f"doc_id {id_like(source)}, hashes binary")


def near_duplicates(
    df: DataFrame,
    settings: Settings | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; linked rows share a component.

    Texts are lower-cased (A-Z) and split at ASCII white space. A text without words, null or
    empty, has no shingles and is linked with nothing; one of fewer words than a shingle has
    the whole sequence as its only one. A component's id is its smallest ``doc_id``, and that
    row is kept. Repeated rows count as one document and come out as often as they go in. A
    row without an id has no component and is kept.
    """
    s = settings or Settings()
    source = texts(df, id_col, text_col)
    kind = id_like(source)
    prepared = stored(_prepared(source, s), "prepared")
    unique = stored(
        prepared.filter("doc_id IS NOT NULL AND n > 0").dropDuplicates(["doc_id", "copy"]), "unique"
    )
    classes = stored(
        unique.groupBy("copy").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")),
        "classes",
    )
    reps = unique.join(
        classes.select("copy", F.col("rep").alias("doc_id")), ["doc_id", "copy"], "left_semi"
    )
    # A document id with several texts joins their classes.
    several = unique.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    owned = unique.join(several, "doc_id", "left_semi").join(classes, "copy").select("doc_id", "rep")
    least = owned.groupBy("doc_id").agg(F.min("rep").alias("b"))
    same = owned.join(least, "doc_id").select(F.col("rep").alias("a"), "b").filter("a <> b")

    rows = reps.select(F.explode("bands").alias("key"), F.col("doc_id").alias("x"), "n")
    stars, members = _members(rows)
    ids = stored(
        stars.select(F.col("x").alias("doc_id")).union(stars.select("c")).distinct(), "ids"
    )
    sets = stored(_sets(ids, source.filter("doc_id IS NOT NULL"), s).distinct(), "sets")
    links = stored(_confirmed(stars, sets, s).union(same).select("a", "b"), "links")
    known = components(links).toDF("x", "label")
    more = stored(_open_links(members, known, sets, s), "links")
    groups = (known if more.isEmpty() else components(links.union(more))).toDF("rep", "label")

    named = classes.join(groups, "rep", "left").select(
        "copy", F.coalesce("label", "rep").alias("label"), "copies", "rep"
    )
    moved = named.filter("copies > 1 OR label <> rep").select("copy", "label")
    placed = salted_join(prepared.select("doc_id", "n", "copy"), moved, "copy", "doc_id", "left")
    usable = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    component = F.when(usable, F.coalesce("label", "doc_id")).otherwise(F.col("doc_id"))
    return placed.select(
        F.col("doc_id").cast(kind),
        F.col("n").cast("long").alias("n_shingles"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )
