"""N-gram Jaccard join: pivots, regions around them, and triangle-inequality windows.

Jaccard distance is a metric, but unrelated texts all lie at distances near one from each
other, so pivots drawn from the whole corpus would give windows that hold everything. The
join therefore finds its pivots from the texts themselves, in three steps:

1. Routing. A set of n shingles is cut by hash into more parts than two linked sets can
   differ in, so linked sets agree in at least one part. Of all sets with the same part the
   smallest id is a pivot, and each of them belongs to its region. Every linked pair lies in
   a region.
2. Each set is compared with its first pivot. What lies within the threshold is linked to it;
   a region whose sets all hang together by then is done.
3. The other regions are joined exactly. A region too large for one task is cut into rings by
   distance from its pivot. By the triangle inequality, linked sets lie in rings at most the
   threshold apart, so a ring is joined with itself and those inside its window only; and
   rings linked to the pivot need not be joined with each other, as their links to the pivot
   are kept. Rings are cut further into blocks, and blocks are joined with blocks.

Copies of one word sequence are folded before all of this.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from marketpulse.llm.common import id_like, map_batches, map_rows, slices, stored, texts
from marketpulse.llm.graph import components

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Rings per unit of distance; a window is as many rings as the threshold needs.
RINGS = 20
BROADCAST_IDS = 2_000_000


@dataclass(frozen=True)
class Settings:
    """Linked: ``den * intersection >= num * union`` of sets of ``width``-word shingles.

    ``task_shingles`` bounds the shingles of a region, or pair of blocks, in one task.
    """

    width: int = 4
    num: int = 85
    den: int = 100
    task_shingles: int = 2_000_000

    def difference(self, n):
        """Most shingles in which a set linked to one of size n can differ from it."""
        return (self.den - self.num) * n // self.num

    def linked(self, shared, union):
        return self.den * shared >= self.num * union


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8").translate(_LOWER).split()


def shingle_hashes(words: list[bytes], width: int, known: _Hashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; fewer words are one shingle."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    if n < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], np.uint64)
    one = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    total = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        total = total * _ODD + one[k : n - width + 1 + k]
    return np.unique(_mix(total))


def parts_of(hashes: np.ndarray, s: Settings) -> np.ndarray:
    """Signatures of a set's parts, one of which it shares with each set linked to it.

    Sizes fall into classes by powers of two; a pair meets in the class of its larger set, so
    a set near the upper end of its class takes part in the next one too. Of its parts, a set
    gives only the well-filled ones: as many as it needs for one to be untouched by any
    possible difference. A set with too few filled parts adds the shingles of a prefix.
    """
    n, out = len(hashes), []
    if not n:
        return np.empty(0, np.uint64)
    level, differ = n.bit_length() - 1, s.difference(n)
    for own in {level, ((s.den * n) // s.num).bit_length() - 1}:
        count = np.uint64(int(1.1 * s.difference((2 << own) - 1)) + 2)
        part = ((hashes >> np.uint64(32)) * count) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        sizes = np.diff(np.append(starts, n))
        least = next((k for k in (6, 5, 4, 3, 2) if (sizes >= k).sum() > differ), 1)
        content = np.add.reduceat(_mix(hashes), starts)
        label = part[starts] * np.uint64(4096) + np.uint64(own * 32)
        signature = _mix(content + _mix(label + np.uint64(1)) + sizes.astype(np.uint64))
        out.append(signature[sizes >= least])
        if len(starts) <= differ:
            out.append(_mix(hashes[: n - -(-s.num * n // s.den) + 1] ^ _ODD))
    return np.unique(np.concatenate(out))


def _with_ids(ids: DataFrame, rows: DataFrame, count: int) -> DataFrame:
    """Rows whose ``doc_id`` is among ``ids``; broadcast only while ``count`` is bounded."""
    ids = ids.select("doc_id").distinct()
    return rows.join(F.broadcast(ids) if count <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def _signatures(reps: DataFrame, s: Settings) -> DataFrame:
    schema = T._parse_datatype_string(f"signature long, doc_id {id_like(reps)}")
    arrow = to_arrow_schema(schema)

    def run(batches):
        known = _Hashes()
        for batch in slices(batches):
            ids, found, sizes = batch.column(0), [], []
            for text in batch.column(1).to_pylist():
                found.append(parts_of(shingle_hashes(words_of(text), s.width, known), s))
                sizes.append(len(found[-1]))
            if found:
                flat = np.concatenate(found).view(np.int64)
                owner = ids.take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
                for at in range(0, len(flat), 100_000):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(flat[at : at + 100_000]), owner.slice(at, 100_000)],
                        schema=arrow,
                    )

    return reps.select("doc_id", "text").mapInArrow(run, schema)


def _sets(rows: DataFrame, s: Settings) -> DataFrame:
    def make():
        known = _Hashes()

        def row(doc_id, text):
            hashes = shingle_hashes(words_of(text), s.width, known)
            return doc_id, len(hashes), hashes.tobytes()

        return row

    return map_rows(
        rows.select("doc_id", "text"), make, f"doc_id {id_like(rows)}, n long, hashes binary"
    )


def _distances(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """(x, p, n, ring, linked) of pairs (x, p). A crowded pivot's pairs may be split."""
    kind = id_like(sets)
    joined = pairs.join(
        sets.select(F.col("doc_id").alias("x"), "n", F.col("hashes").alias("hx")), "x"
    ).join(sets.select(F.col("doc_id").alias("p"), F.col("hashes").alias("hp")), "p")

    def make():
        def row(x, p, n, hx, hp):
            a, b = np.frombuffer(hx, np.uint64), np.frombuffer(hp, np.uint64)
            shared = len(np.intersect1d(a, b, assume_unique=True))
            union = len(a) + len(b) - shared
            return x, p, n, RINGS * (union - shared) // union, s.linked(shared, union)

        return row

    return map_rows(
        joined.select("x", "p", "n", "hx", "hp"),
        make,
        f"x {kind}, p {kind}, n long, ring long, linked boolean",
    )


def block_links(ids: list, labels: list, sets: list[np.ndarray], s: Settings) -> list[tuple]:
    """Links that join the labels of a block, as (label, label); as few as join them.

    Sets of the most frequent label need no look-up of their own: all others are compared
    with everything in the block.
    """
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(code, kind="stable")
    bounds = np.searchsorted(code[order], np.arange(code.max() + 2))
    posting, ends = owner[order], np.cumsum(sizes)
    root = {label: label for label in labels}

    def find(v):
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    weight: dict = {}
    for label in labels:
        weight[label] = weight.get(label, 0) + 1
    largest = max(sorted(weight), key=weight.get)
    out = []
    for i, label in enumerate(labels):
        if label == largest:
            continue
        own = code[ends[i] - sizes[i] : ends[i]]
        near = np.concatenate([posting[bounds[c] : bounds[c + 1]] for c in own])
        shared = np.bincount(near, minlength=len(sets))
        hits = np.flatnonzero(s.linked(shared, sizes + sizes[i] - shared))
        for j in hits:
            a, b = find(label), find(labels[j])
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((label, labels[j]))
    return out


def _blocks(members: DataFrame, sets: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(task, x, label) for the regions left, whole or as pairs of ring blocks; links (a, b).

    ``members`` has (p, x, n, label). The links are those between a large region's sets and
    its pivot. Sets on them have the pivot's label, and no task looks for them again.
    """
    region = members.groupBy("p").agg(F.sum("n").alias("weight"))
    sized = stored(members.join(region, "p"), "regions")
    whole = sized.filter(F.col("weight") <= s.task_shingles).select(
        F.struct("p", F.lit(0).alias("i"), F.lit(0).alias("j")).alias("task"), "x", "label"
    )
    large = sized.filter(F.col("weight") > s.task_shingles)
    far = stored(_distances(large.select("x", "p"), sets, s), "rings")
    hung = far.filter("linked AND x <> p").select(F.col("x").alias("a"), F.col("p").alias("b"))
    centre = large.filter("x = p").select("p", F.col("label").alias("centre"))
    ringed = (
        large.join(far.select("x", "p", "ring", "linked"), ["x", "p"])
        .join(centre, "p")
        .withColumn("label", F.when(F.col("linked"), F.col("centre")).otherwise(F.col("label")))
        .withColumn("ring", F.col("ring") * 2 + F.when(F.col("linked"), 0).otherwise(1))
    )
    rings = ringed.groupBy("p", "ring").agg(
        F.ceil(F.sum("n") * 2 / s.task_shingles).cast("int").alias("blocks")
    )
    cut = ringed.join(rings, ["p", "ring"]).withColumn(
        "k", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int")
    )
    window = -(-(s.den - s.num) * RINGS // s.den)
    # Ring pairs (own, other) with own <= other inside the window, not both linked.
    pairs = (
        rings.select("p", "ring", "blocks", F.explode(F.sequence(
            F.lit(-1), F.lit(2 * window + 1))).alias("gap"))
        .withColumn("other", F.col("ring") + F.col("gap"))
        .join(rings.select("p", F.col("ring").alias("other"), F.col("blocks").alias("more")),
              ["p", "other"])
        .filter(F.col("other") >= F.col("ring"))
        .filter("NOT (ring % 2 = 0 AND other % 2 = 0)")
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("more") - 1)))
        .filter("ring <> other OR i <= j")
    )
    task = F.struct(
        "p", (F.col("ring") * 100_000 + F.col("i")).alias("i"),
        (F.col("other") * 100_000 + F.col("j")).alias("j"),
    ).alias("task")
    sides = pairs.select(task, "p", "ring", F.col("i").alias("k")).union(
        pairs.select(task, "p", F.col("other").alias("ring"), F.col("j").alias("k"))
    ).distinct()
    return whole.union(cut.join(sides, ["p", "ring", "k"]).select("task", "x", "label")), hung


def _region_links(members: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    kind = id_like(sets)
    blocks, hung = _blocks(members, sets, s)
    tasks = (
        blocks.join(sets.select(F.col("doc_id").alias("x"), "hashes"), "x")
        .select("task.p", "task.i", "task.j", "x", "label", "hashes")
    )

    def rows(batches):
        for batch in batches:
            yield from zip(*batch.values(), strict=True)

    def run(batches):
        # Regions are many and mostly small: they are read one after the other.
        out = []
        for _, own in groupby(rows(batches), key=lambda r: r[:3]):
            _, _, _, ids, labels, hashes = zip(*own, strict=True)
            if len(set(labels)) > 1:
                found = [np.frombuffer(h, np.uint64) for h in hashes]
                out += block_links(list(ids), list(labels), found, s)
            if len(out) > 10_000:
                yield {"a": [r[0] for r in out], "b": [r[1] for r in out]}
                out = []
        yield {"a": [r[0] for r in out], "b": [r[1] for r in out]}

    key = ["p", "i", "j"]
    ordered = tasks.repartition(*key).sortWithinPartitions(*key)
    return map_batches(ordered, run, f"a {kind}, b {kind}").union(hung)


def similar_groups(
    df: DataFrame, settings: Settings | None = None, id_col="doc_id", text_col="text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; linked rows share a component.

    Texts are lower-cased (A-Z) and split at ASCII white space. A text without words, null
    or empty, has no shingles and is linked with nothing; one of fewer words than a shingle
    has the whole sequence as its only one. A component's id is its smallest ``doc_id``. Rows
    of one id count as one document. A row without an id has no component.
    """
    s = settings or Settings()
    source = texts(df, id_col, text_col)
    kind = id_like(source)

    def make():
        known = _Hashes()

        def row(doc_id, text):
            words = words_of(text)
            n = len(shingle_hashes(words, s.width, known))
            return doc_id, n, hashlib.md5(b" ".join(words)).digest()

        return row

    prepared = stored(map_rows(source, make, f"doc_id {kind}, n long, copy binary"), "prepared")
    usable = prepared.filter("doc_id IS NOT NULL AND n > 0")
    first = usable.groupBy("copy").agg(F.min("doc_id").alias("rep"))
    folded = stored(usable.join(first, "copy").select("doc_id", "rep", "n").distinct(), "copies")
    reps = folded.select(F.col("rep").alias("doc_id")).distinct()

    documents = source.filter("doc_id IS NOT NULL")
    alone = F.min("doc_id").over(Window.partitionBy("signature"))
    regions = stored(
        _signatures(_with_ids(reps, documents, reps.count()), s)
        .withColumn("p", alone)
        .filter("doc_id <> p")
        .select(F.col("doc_id").alias("x"), "p")
        .distinct(),
        "regions",
    )
    named = regions.select(F.col("x").alias("doc_id")).union(regions.select("p")).distinct()
    sets = stored(_sets(_with_ids(named, documents, named.count()), s), "sets")

    nearest = regions.groupBy("x").agg(F.min("p").alias("p"))
    links = stored(
        _distances(nearest, sets, s).filter("linked").select(F.col("x").alias("a"), F.col("p").alias("b")),
        "links",
    )
    known = components(links).toDF("x", "label")
    members = regions.union(regions.select("p", "p").distinct())
    labelled = stored(
        members.join(known, "x", "left").withColumn("label", F.coalesce("label", "x")), "members"
    )
    open_ = (
        labelled.groupBy("p")
        .agg(F.min("label").alias("least"), F.max("label").alias("most"))
        .filter("least <> most")
        .select("p")
    )
    left = labelled.join(open_, "p", "left_semi").join(
        sets.select(F.col("doc_id").alias("x"), "n"), "x"
    )
    more = _region_links(left.select("p", "x", "n", "label"), sets, s)
    same = folded.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    final = components(links.union(more).union(same)).toDF("doc_id", "label")
    return (
        prepared.select("doc_id", F.col("n").alias("n_shingles"))
        .join(final, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))
    )


def one_of_each_group(df: DataFrame, id_col="doc_id", **options) -> DataFrame:
    """Rows of ``df`` but for those whose component has a smaller id, with all their columns."""
    groups = similar_groups(df, id_col=id_col, **options)
    drop = stored(
        groups.filter("component_id <> doc_id").select(F.col("doc_id").alias("id")).distinct(),
        "dropped",
    )
    side = F.broadcast(drop) if drop.count() <= BROADCAST_IDS else drop
    return df.join(side, df[id_col] == drop["id"], "left_anti")
