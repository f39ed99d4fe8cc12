"""The prefix trie of conversations: shared beginnings, subtree sizes and what sharing saves.

A node is a distinct sequence of first turns, named by a chain of digests. Counts per node are
aggregations. A run of nodes with the same members is one chain, so the path of a
conversation is the list of its chains' heads; as members fall strictly along it, a path has
at most sqrt(2 x turns of all conversations) entries, however long the conversation.

Sums over subtrees come from the tree's balanced parentheses. The paths of leaves are
range-partitioned by their order in the tree. A shard encodes its paths: findclose gives the
end of each subtree, ranks of leaf pairs its leaves, cumulative arrays its savings. Only nodes
on a shard's first and last path can go on in another shard; these shared spines, with the
sums of what hangs from them, are merged as the paths of a smaller tree, until one is left.
"""

from __future__ import annotations

import functools
import hashlib
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketpulse.llm.common import id_like, map_batches, salted_join, stored
from marketpulse.llm.parentheses import Parentheses

ROOT = bytes(16)
_ENTRY = "struct<node: binary, weight: long, leaves: long, saved: long, children: long>"
_OUT_ROWS = 4096


@dataclass(frozen=True)
class Settings:
    """``shard_nodes``: entries of paths that one task encodes."""

    shard_nodes: int = 1 << 17


def ordered_turns(
    df: DataFrame, id_col="conv_id", turn_col="turn", role_col="role", text_col="text"
) -> DataFrame:
    """(conv_id, pos, digest, chars): turns numbered from one within their conversation.

    Order is by turn, null first, then by role and text. A null role or text is empty. Rows
    without an id are left out. Repeated rows are turns of their own.
    """
    given = df.select(
        F.col(f"`{id_col}`").alias("conv_id"),
        F.col(f"`{turn_col}`").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    ).filter("conv_id IS NOT NULL")
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    named = F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text")
    return given.select(
        "conv_id",
        F.row_number().over(order).alias("pos"),
        F.unhex(F.md5(named.cast("binary"))).alias("digest"),
        F.char_length("text").cast("long").alias("chars"),
    )


def with_common_beginning(turns: DataFrame, group: int = 100, modulus: int = 6) -> DataFrame:
    """Replace the first h turns of conversation c by those of conversation c - c % ``group``.

    h is the unsigned crc32 of c in decimal, modulo ``modulus``. A shorter conversation gives
    all it has, a missing one nothing. The position holds the origin, then the turn's number.
    """
    turns = stored(turns, "turns")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % modulus).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % group
    long = F.col("pos").cast("long")
    own = turns.filter(F.col("pos") > h).withColumn("pos", long + (1 << 40))
    wanted = turns.select("conv_id").distinct().select("conv_id", base.alias("base"), h.alias("h"))
    first = turns.filter((base == F.col("conv_id")) & (F.col("pos") < modulus)).select(
        F.col("conv_id").alias("base"), "pos", "digest", "chars"
    )
    given = wanted.filter("h > 0").join(first, "base").filter("pos <= h")
    return given.select("conv_id", long.alias("pos"), "digest", "chars").union(own)


def _rows(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*batch.values(), strict=True)


def _tables(rows: Iterator[tuple], names: list[str]) -> Iterator[dict[str, list]]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == _OUT_ROWS:
            yield dict(zip(names, map(list, zip(*held, strict=True)), strict=True))
            held = []
    if held:
        yield dict(zip(names, map(list, zip(*held, strict=True)), strict=True))


def _with_next(rows: Iterator[tuple]) -> Iterator[tuple[tuple, tuple | None]]:
    """Each row and the next one, or None at the end."""
    last = None
    for row in rows:
        if last is not None:
            yield last, row
        last = row
    if last is not None:
        yield last, None


def _chained(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, node, chars, last) of every turn. A conversation is read as a stream."""
    kind = id_like(turns, "conv_id")

    def nodes(batches):
        depth, node = 0, ROOT
        for (conv, _, digest, chars), after in _with_next(_rows(batches)):
            depth, node = depth + 1, hashlib.md5(node + digest).digest()
            last = after is None or after[0] != conv
            yield conv, depth, node, chars, last
            if last:
                depth, node = 0, ROOT

    names = ["conv_id", "depth", "node", "chars", "last"]
    dealt = turns.select("conv_id", "pos", "digest", "chars").repartition("conv_id")
    return map_batches(
        dealt.sortWithinPartitions("conv_id", "pos"),
        lambda batches: _tables(nodes(batches), names),
        f"conv_id {kind}, depth long, node binary, chars long, last boolean",
    )


def _folded(chain: DataFrame, root_conv) -> DataFrame:
    """Nodes at their smallest member, and the paths of leaves; one table for both.

    A node row has its chain's ``head``, what the chain saves ``before`` it, and whether it is
    the chain's ``end``. A path row has ``path`` only: the heads from the root on and their
    chains' savings.
    """
    kind = id_like(chain, "conv_id")
    counts = (
        chain.groupBy("node")
        .agg(
            F.count("*").alias("n"),
            F.min("conv_id").alias("least"),
            F.sum(F.col("last").cast("long")).alias("ends"),
        )
        .filter("n > 1")
    )
    # Most nodes have one member and need no look-up.
    joined = salted_join(chain, counts, "node", "conv_id", "left").select(
        "conv_id", "depth", "node", "chars", "last",
        F.coalesce("n", F.lit(1)).alias("n"),
        F.coalesce("least", "conv_id").alias("least"),
        F.coalesce("ends", F.col("last").cast("long")).alias("ends"),
    )
    dealt = joined.repartition("conv_id").sortWithinPartitions("conv_id", "depth")

    def rows(batches):
        path, size, before, parent = [], None, 0, root_conv
        for (conv, depth, node, chars, last, n, least, ends), after in _with_next(_rows(batches)):
            if n != size:
                path.append([node, 0])
                size, before = n, 0
            end = last or after[5] != n
            if least == conv:
                yield node, conv, depth, parent, n, path[-1][0], before, end, None
            before += (n - 1) * chars
            path[-1][1] = before
            parent = least
            if last:
                if least == conv and ends == n:
                    heads = [{"node": ROOT, "weight": 0}, *({"node": k, "weight": w} for k, w in path)]
                    none = {"leaves": 0, "saved": 0, "children": 0}
                    yield None, None, None, None, None, None, None, None, [h | none for h in heads]
                path, size, before, parent = [], None, 0, root_conv

    names = ["node", "conv_id", "depth", "parent_conv_id", "n", "head", "before", "end", "path"]
    return map_batches(
        dealt.select("conv_id", "depth", "node", "chars", "last", "n", "least", "ends"),
        lambda batches: _tables(rows(batches), names),
        f"node binary, conv_id {kind}, depth long, parent_conv_id {kind}, n long, head binary, "
        f"before long, end boolean, path array<{_ENTRY}>",
    )


class Shard:
    """The tree of paths given in order, as parentheses and arrays in preorder.

    The path to an equal node is shared: its weight counts once, its other sums add up.
    """

    def __init__(self, paths: Iterator[list[dict]]):
        bits, self.nodes, self.parents = [], [], []
        sums, stack, first, self.last = [], [], None, []
        for path in paths:
            same = 0
            while same < min(len(stack), len(path)) and self.nodes[stack[same]] == path[same]["node"]:
                entry = sums[stack[same]]
                for k, name in ((1, "leaves"), (2, "saved"), (3, "children")):
                    entry[k] += path[same][name]
                same += 1
            bits += [0] * (len(stack) - same)
            del stack[same:]
            for entry in path[same:]:
                bits.append(1)
                self.parents.append(stack[-1] if stack else -1)
                stack.append(len(self.nodes))
                self.nodes.append(entry["node"])
                sums.append([entry[k] for k in ("weight", "leaves", "saved", "children")])
            first = first or list(stack)
            self.last = list(stack)
        bits += [0] * len(stack)
        self.first = first or []
        self.weight, self.leaves, self.saved, self.children = (
            np.array(sums, np.int64).reshape(-1, 4).T
        )
        self.tree = Parentheses(np.array(bits, np.int64))

    def _totals(self, count: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Sums over subtrees from one cumulative array."""
        upto = np.concatenate([[0], np.cumsum(count)])
        return upto[ends] - upto[: len(ends)]

    def sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leaves, savings and children of every node of a complete tree."""
        ends, pairs = self.tree.subtrees()
        leaves = pairs + self._totals(self.leaves, ends)
        saved = self._totals(self.weight + self.saved, ends)
        return leaves, saved, self.children + self._own_children(np.ones(len(ends), bool))

    def _own_children(self, of: np.ndarray) -> np.ndarray:
        parents = np.array(self.parents, np.int64)[of]
        return np.bincount(parents[parents >= 0], minlength=len(self.nodes))

    def spines(self) -> tuple[np.ndarray, list[list[dict]]]:
        """Which nodes are on the first or last path, and these paths for the next tree.

        An entry holds the sums of the complete subtrees at its node, on one path only.
        """
        spine = np.zeros(len(self.nodes), bool)
        spine[self.first], spine[self.last] = True, True
        ends, _ = self.tree.subtrees()
        lone = np.ones(len(ends), bool)
        lone[np.array(self.parents, np.int64)[1:]] = False
        inner = [
            self._totals(np.where(spine, 0, x), ends)
            for x in (self.leaves + lone, self.weight + self.saved)
        ]
        own = [x.copy() for x in inner]
        for k in np.flatnonzero(spine):
            if self.parents[k] >= 0:
                for x, total in zip(own, inner, strict=True):
                    x[self.parents[k]] -= total[k]
        leaves, saved = own[0] + self.leaves, own[1] + self.saved
        children = self.children + self._own_children(~spine)
        out, given = [], set()
        for path in [self.first, self.last][: 1 + (self.first != self.last)]:
            entries = []
            for k in path:
                mine = k not in given
                given.add(k)
                entries.append(
                    {
                        "node": self.nodes[k],
                        "weight": int(self.weight[k]),
                        "leaves": int(leaves[k]) * mine,
                        "saved": int(saved[k]) * mine,
                        "children": int(children[k]) * mine,
                    }
                )
            out.append(entries)
        return spine, out


def _encoded(paths: DataFrame, whole: bool) -> DataFrame:
    """(head, leaves, saved, children) of nodes, and rows of ``path`` for shared spines.

    Partitions of ``paths`` are sorted. Where one holds the ``whole`` tree, no spine is shared.
    Leaves that save nothing are left out.
    """

    def run(batches):
        shard = Shard(path for batch in batches for path in batch["path"])
        count = len(shard.nodes)
        if not count:
            return
        leaves, saved, children = shard.sums()
        spine, left = (np.zeros(count, bool), []) if whole else shard.spines()
        out = np.flatnonzero(~spine & ((children > 0) | (saved != 0)))
        for at in range(0, len(out), _OUT_ROWS):
            k = out[at : at + _OUT_ROWS]
            yield {
                "head": [shard.nodes[i] for i in k],
                "leaves": leaves[k].tolist(),
                "saved": saved[k].tolist(),
                "children": children[k].tolist(),
                "path": [None] * len(k),
            }
        for path in left:
            yield {"head": [None], "leaves": [0], "saved": [0], "children": [0], "path": [path]}

    return map_batches(
        paths.select("path"),
        run,
        f"head binary, leaves long, saved long, children long, path array<{_ENTRY}>",
    )


def subtree_sums(paths: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(head, leaves, saved, children) from the distinct ``path``s of all leaves.

    Nodes left out are leaves that save nothing.
    """
    s = settings or Settings()
    order = F.transform("path", lambda entry: entry["node"])
    paths, done = paths.select("path"), []
    while True:
        size, count = paths.agg(F.sum(F.size("path")), F.count("*")).first()
        parts = -(-(size or 0) // s.shard_nodes)
        whole = parts < 2 or 2 * parts >= count
        named = paths.select("path", order.alias("order"))
        dealt = named.coalesce(1) if whole else named.repartitionByRange(parts, "order")
        out = stored(_encoded(dealt.sortWithinPartitions("order"), whole), "shards")
        done.append(out.filter("head IS NOT NULL").drop("path"))
        if whole:
            return functools.reduce(DataFrame.union, done)
        paths = out.filter("path IS NOT NULL").select("path")


def _end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) from (node, conv_id); ids of a node are read as a stream."""

    def rows(batches):
        digest = None
        for (node, conv), after in _with_next(_rows(batches)):
            if digest is None:
                digest = hashlib.sha256(str(conv).encode())
            else:
                digest.update(b",%d" % conv)
            if after is None or after[0] != node:
                yield node, digest.hexdigest()
                digest = None

    ordered = ends.repartition("node").sortWithinPartitions("node", "conv_id")
    names = ["node", "ends_sha256"]
    return map_batches(
        ordered, lambda batches: _tables(rows(batches), names), "node binary, ends_sha256 string"
    )


def prefix_trie(
    turns: DataFrame, ids: DataFrame | None = None, settings: Settings | None = None
) -> DataFrame:
    """The nodes of the trie of all conversations in ``turns`` (conv_id, pos, digest, chars).

    ``conv_id`` is an integer and ``pos`` orders its turns. ``ids`` names all conversations;
    one without turns is a member of the root only. Per node: conv_id, the smallest member;
    depth; parent_conv_id; n_convs; n_children; n_leaves; saved_tokens, the characters that
    members after the first need not store, summed over the subtree; ends_sha256 of the
    members that end here. Without conversations there is no node, not even the root.
    """
    turns = turns.select("conv_id", "pos", "digest", "chars")
    kind = id_like(turns, "conv_id")
    known = turns.select("conv_id").distinct()
    everyone = stored(
        known if ids is None else ids.select("conv_id").filter("conv_id IS NOT NULL").union(known).distinct(),
        "ids",
    )
    least, members = everyone.agg(F.min("conv_id"), F.count("*")).first()
    chain = stored(_chained(turns), "chain")
    folded = stored(_folded(chain, least), "folded")
    sums = subtree_sums(folded.filter("path IS NOT NULL"), settings)

    root = everyone.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")).select(
        F.lit(ROOT).alias("node"), "conv_id", F.lit(0).cast("long").alias("depth"),
        F.lit(None).cast(kind).alias("parent_conv_id"), "n", F.lit(ROOT).alias("head"),
        F.lit(0).cast("long").alias("before"), F.lit(True).alias("end"),
    ).filter("n > 0")
    nodes = folded.filter("node IS NOT NULL").drop("path")
    single = nodes.filter("n = 1").select(
        "*", F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"),
        F.lit(0).cast("long").alias("children"),
    )
    shared = salted_join(nodes.filter("n > 1").union(root), sums, "head", "depth", "left").select(
        *nodes.columns,
        F.coalesce("leaves", F.lit(1)).alias("leaves"),
        F.coalesce("saved", F.lit(0)).alias("saved"),
        F.coalesce("children", F.lit(0)).alias("children"),
    )
    turnless = everyone.join(chain.filter("depth = 1"), "conv_id", "left_anti")
    ends = chain.filter("last").select("node", "conv_id")
    digests = _end_digests(ends.union(turnless.select(F.lit(ROOT).alias("node"), "conv_id")))
    return single.union(shared).join(digests, "node", "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        F.col("n").alias("n_convs"),
        F.when(F.col("end"), F.col("children")).otherwise(1).alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("saved") - F.col("before")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
