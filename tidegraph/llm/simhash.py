"""Near copies by SimHash fingerprints, with vantage-point trees.

Each text's 3-word shingles, repeats included, vote on the 64 bits of its fingerprint. Two fingerprints link when they
differ in at most two bits. Equal fingerprints are one node, known to all rows that have it, before anything else is
done; so no fingerprint has more than 2,080 links, however many copies there are.

A vantage-point tree, fitted on a bounded sample of the nodes, cuts the space into shards: at each branch, nodes within
some distance of the vantage point go one way and the others the other way. A node is a member of one shard. Where its
ball of two bits reaches across a boundary, by the triangle inequality, it also visits the shards beyond, those of higher
numbers only, since a pair needs to meet once. In a shard's task the members make a tree of their own, down to small
leaves, which members and visitors search with the same bounds; leaves are compared bit by bit, so pairs are exact. A
shard of more members than a task should hold is cut into blocks, in each of which its visitors, and members of the
blocks before it, search. A task returns a spanning forest of its pairs, never all pairs of a group. Components of the
forests are found distributed.

Rows with null, empty or wordless text have fingerprint zero and are linked like any other. With one or two words, the
whole sequence is the one shingle. Texts of any length are whole, read in slabs. Rows with a null id are returned with a
null component and take no part. Rows with one id and several fingerprints count as linked. Extra columns are dropped,
whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import bound_batches, salted, saved, scratch, utf8
from tidegraph.llm.components import components

#: Words of a shingle, seed of its hash, and differing bits up to which fingerprints link.
SHINGLE, SEED, RADIUS = 3, 42, 2
#: Bytes of a text that are split into words at once.
SLAB = 1 << 20
#: Members that a shard's task should hold; nodes of a leaf; queries that go down a tree at once; distances that are held at once.
SHARD_NODES, LEAF_NODES, QUERIES, HELD = 16_384, 48, 50_000, 1 << 21
#: Least sampled nodes of a shard; vantage points that are tried for a branch, and on how many nodes.
LEAST_SAMPLED, TRIED, TRIED_ON = 24, 5, 500
#: Pairs that are joined to a forest at once.
PAIRS = 1 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _slabs(text: bytes) -> Iterator[bytes]:
    """The text in pieces that end before white space."""
    at = 0
    while at < len(text):
        m = _SPACE.search(text, at + SLAB)
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end


def _hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of every run of so many words, joined by spaces."""
    n = len(words) - width + 1
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    pieces = (joined[a:b] for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True))
    return np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, n)


def fingerprint(text: bytes | None) -> int:
    """The 64 bits that more than half of the shingles' hashes have."""
    votes, n, words = np.zeros(64, np.int64), 0, []

    def vote(width: int) -> int:
        h = _hashes(words, width)
        votes[:] += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        return len(h)

    for slab in _slabs((text or b"").lower()):  # of bytes, only A-Z change
        words += slab.split()
        if len(words) >= SHINGLE:
            n += vote(SHINGLE)
            words = words[1 - SHINGLE :]
    if not n and words:
        n = vote(len(words))
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(id, fp) of (id, text); a fingerprint's bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter(map(fingerprint, utf8(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    return docs.mapInArrow(run, "id long, fp long")


def distance(a: np.ndarray | np.uint64, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


@dataclass
class Tree:
    """A vantage-point tree. Branch i sends what is within cut[i] bits of point[i] to inner[i], the rest to outer[i]; numbers below 0 are leaves: -1 - leaf."""

    point: list[np.uint64] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    inner: list[int] = field(default_factory=list)
    outer: list[int] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)  # what was built from, by leaf

    @classmethod
    def build(cls, x: np.ndarray, most: float, seed: int = 0) -> Tree:
        """A tree over x whose leaves hold at most so many, unless what they hold can't be told apart."""
        tree, r = cls(), np.random.default_rng(seed)
        todo: list[tuple[np.ndarray, int, list[int] | None]] = [(x, 0, None)]
        while todo:
            part, at, side = todo.pop()
            branch = cls._branch(part, r) if len(part) > most else None
            if branch is None:
                number = -1 - len(tree.leaves)
                tree.leaves.append(part)
            else:
                number = len(tree.point)
                point, cut = branch
                tree.point.append(point)
                tree.cut.append(cut)
                tree.inner.append(0)
                tree.outer.append(0)
                near = distance(part, point) <= cut
                todo += [(part[~near], number, tree.outer), (part[near], number, tree.inner)]
            if side is not None:
                side[at] = number
        return tree

    @staticmethod
    def _branch(part: np.ndarray, r: np.random.Generator) -> tuple[np.uint64, int] | None:
        """The point and distance with the fewest nodes near the boundary, among some with enough nodes on both sides; None if there is none that helps."""
        some = part if len(part) <= TRIED_ON else part[r.integers(0, len(part), TRIED_ON)]
        best, least = None, 1.0
        for point in part[r.integers(0, len(part), TRIED)]:
            count = np.cumsum(np.bincount(distance(some, point), minlength=65 + RADIUS)) / len(some)
            for cut in np.unique(np.searchsorted(count, (0.35, 0.5, 0.65))).tolist():
                inside = count[cut]
                near = count[min(cut + RADIUS, 64)] - (count[cut - RADIUS] if cut >= RADIUS else 0.0)
                if 0.05 <= inside <= 0.95 and (load := max(inside, 1 - inside) + near / 2) < least:
                    best, least = (point, cut), load
        return best

    def visits(self, x: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, which of x may have a neighbour there, which of those lie there themselves)."""
        todo = [(0 if self.point else -1, np.arange(len(x)), np.ones(len(x), bool))]
        while todo:
            node, at, home = todo.pop()
            if not len(at):
                continue
            if node < 0:
                yield -1 - node, at, home
                continue
            d = distance(x[at], self.point[node]).astype(np.int64)
            inside = d <= self.cut[node]
            to_in, to_out = d - radius <= self.cut[node], d + radius > self.cut[node]
            todo += [(self.outer[node], at[to_out], home[to_out] & ~inside[to_out]), (self.inner[node], at[to_in], home[to_in] & inside[to_in])]

    def pairs(self, x: np.ndarray, where: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place in x, place in what was built from) of all pairs within the radius. where: places of each leaf's nodes."""
        for leaf, at, _ in self.visits(x):
            members = self.leaves[leaf]
            step = max(1, HELD // max(len(members), 1))
            for lo in range(0, len(at), step):
                part = at[lo : lo + step]
                i, j = np.nonzero(distance(x[part][:, None], members[None]) <= RADIUS)
                if len(i):
                    yield part[i], where[leaf][j]


class Forest:
    """Joins things by pairs; says which pairs joined something."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the pairs joined two groups."""
        used = []
        la, lb = self.label[a], self.label[b]
        up: dict[int, int] = {}

        def root(v: int) -> int:
            while (to := up.get(v, v)) != v:
                up[v] = up.get(to, to)
                v = to
            return v

        for k in np.flatnonzero(la != lb).tolist():
            p, q = root(int(la[k])), root(int(lb[k]))
            if p != q:
                up[max(p, q)] = min(p, q)
                used.append(k)
        if up:
            old = np.array(sorted(up))
            new = np.array([root(v) for v in old.tolist()])
            at = np.minimum(np.searchsorted(old, self.label), len(old) - 1)
            self.label = np.where(old[at] == self.label, new[at], self.label)
        return np.array(used, np.int64)


class Shard:
    """The members of one block, their tree, and what is joined so far."""

    def __init__(self, members: np.ndarray):
        self.members = members
        self.tree = Tree.build(members, LEAF_NODES)
        at = np.argsort(members)
        self.where = [at[np.searchsorted(members[at], x)] for x in self.tree.leaves]
        self.label = np.arange(len(members))

    def links(self, x: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """A forest of the pairs of members, or of others with members, on top of what is joined by then: fingerprints of both ends."""
        n, own = len(self.members), x is None
        others = self.members if own else x
        forest = Forest(n if own else n + len(others))
        forest.label[:n] = self.label
        for i, j in self.tree.pairs(others, self.where):
            if own:
                i, j = i[i < j], j[i < j]
            for lo in range(0, len(i), PAIRS):
                a, b = i[lo : lo + PAIRS], j[lo : lo + PAIRS]
                used = forest.join(a if own else a + n, b)
                if len(used):
                    yield others[a[used]], self.members[b[used]]
        self.label = forest.label[:n].copy()


def _sample(nodes: DataFrame, n: int, most: int) -> np.ndarray:
    """About so many of the nodes (fp), by a hash of them."""
    share = min(1.0, most / max(n, 1))
    chosen = nodes.filter(F.pmod(F.xxhash64(F.lit(7), "fp"), F.lit(1 << 30)) < int(share * (1 << 30))).select("fp")
    return np.sort(np.array([r.fp for r in chosen.limit(2 * most).collect()], np.int64)).view(np.uint64)


def _routed(nodes: DataFrame, tree: Tree) -> DataFrame:
    """(shard, role, fp): each node at home (role 0), and in the shards of higher numbers that its ball reaches (role 1)."""
    tree = Tree(tree.point, tree.cut, tree.inner, tree.outer)  # the sample stays here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            x = fp.view(np.uint64)
            found = list(tree.visits(x))
            own = np.zeros(len(x), np.int64)
            for leaf, at, home in found:
                own[at[home]] = leaf
            for leaf, at, _ in found:
                at = at[own[at] <= leaf]
                role = (own[at] != leaf).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), leaf, np.int32)), pa.array(role), pa.array(fp[at])], ["shard", "role", "fp"])

    return nodes.mapInArrow(run, "shard int, role int, fp long")


def _in_blocks(routed: DataFrame) -> DataFrame:
    """(shard, block, role, fp): members in a block each, visitors in all blocks, and members as visitors in the blocks after theirs."""
    sizes = routed.filter("role = 0").groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / SHARD_NODES).cast("int").alias("blocks"))  # one row a shard
    rows = routed.join(F.broadcast(sizes), "shard").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    at = F.when(F.col("role") == 1, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.sequence(F.col("own"), F.col("blocks") - 1))
    return rows.withColumn("block", F.explode(at)).select("shard", "block", F.when((F.col("role") == 0) & (F.col("own") == F.col("block")), 0).otherwise(1).alias("role"), "fp")


def _searched(rows: DataFrame) -> DataFrame:
    """(a, b): forests of the links of each (shard, block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple[int, int] | None = None
        members: list[np.ndarray] = []
        held: Shard | None = None
        waiting: list[np.ndarray] = []

        def out(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for a, b in found:
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        def ready() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if held is None and members:
                held = Shard(np.concatenate(members))
                members.clear()
                yield from out(held.links())

        def flush() -> Iterator[pa.RecordBatch]:
            yield from ready()
            if held is not None and waiting:
                yield from out(held.links(np.concatenate(waiting)))
            waiting.clear()

        for batch in batches:
            shard, block, role = (batch.column(c).to_numpy() for c in range(3))
            x = batch.column(3).to_numpy().view(np.uint64)
            edges = np.flatnonzero(np.diff(shard) | np.diff(block) | np.diff(role)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(x)], strict=True):
                if lo == hi:
                    continue
                if (int(shard[lo]), int(block[lo])) != key:
                    yield from flush()
                    key, held = (int(shard[lo]), int(block[lo])), None
                (members if role[lo] == 0 else waiting).append(x[lo:hi].copy())
                if role[lo] == 1 and sum(map(len, waiting)) >= QUERIES:
                    yield from flush()
        yield from flush()

    return rows.repartition("shard", "block").sortWithinPartitions("shard", "block", "role").mapInArrow(run, "a long, b long")


def links(nodes: DataFrame, *, sample_rows: int = 200_000) -> DataFrame:
    """(a, b): forests of the links between distinct fingerprints (fp), whose components are those of all links."""
    n = nodes.count()
    sample = _sample(nodes, n, sample_rows)
    tree = Tree.build(sample, max(LEAST_SAMPLED, SHARD_NODES * len(sample) / max(n, 1)))
    return _searched(_in_blocks(saved(_routed(nodes.select("fp"), tree), "routed")))


def near_copies(df: DataFrame, *, sample_rows: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component) of every row: 16 lower-case hex digits, and the smallest id that links lead to. sample_rows: about how many fingerprints the shards' tree is fitted on."""
    bound_batches(df.sparkSession)
    with scratch(df.sparkSession) as keep:
        rows = saved(fingerprints(df.select(df[id_col].cast("long").alias("id"), df[text_col].cast("string").alias("text"))), "fingerprints")
        some = rows.filter("id is not null")
        nodes = saved(some.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
        several = some.groupBy("id").agg(F.min("fp").alias("a"), F.max("fp").alias("last")).filter("a <> last").select("id", "a")
        same = some.join(several, "id").select("a", F.col("fp").alias("b")).filter("a <> b")  # rows of one id
        joined = saved(components(saved(links(nodes, sample_rows=sample_rows).unionByName(same), "forests")), "joined")
        known = nodes.join(joined.withColumnRenamed("id", "fp"), "fp").select("fp", "least", "component")
        names = known.groupBy("component").agg(F.min("least").alias("name"))
        named = salted(known, names, ["component"], ["fp"]).select("fp", "name")
        whole = nodes.join(named, "fp", "left").select("fp", F.coalesce("name", "least").alias("name"))
        found = salted(rows, whole, ["fp"], ["id"], how="left")
        hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
        return keep(found.select(F.col("id").alias(id_col), hexed.alias("fingerprint"), F.when(F.col("id").isNotNull(), F.col("name")).alias("component")), "near-copies")
