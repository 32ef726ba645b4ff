"""Hard-negative mining by dual-tree search over inner products.

For each anchor, its positives are the rows of its label with the highest scores; for each positive, its negatives are
the highest scores of other labels within a band below the positive's score. Scores are inner products of vectors whose
components are scaled and floored to whole numbers, so they are exact, and ties go to the smaller id.

Candidates lie in the cells of one tree and anchors in the groups of another; both are fitted on bounded samples, and
each node is known by a centre and the largest distance of its rows from it. For a pair of nodes these give an interval
that holds all inner products between them. A pair whose interval lies below what all anchors of the group have already,
or outside all their bands, is passed over, for the whole group at once; what is left are pairs of leaves, which are
scored exactly. Every anchor starts with what it finds in a bounded sample of the candidates, broadcast, as a lower bound
of its k-th best score.

The first search finds the positives, the second the negatives. In each, the groups of anchors are sent to the blocks of
cells that they can't pass over. A block is held by one task, and a cell with many rows, such as a group of copies, is cut
into several blocks. What the blocks find, k rows an anchor at most, is merged by window functions.

Rows with a null id, label or vector, or with a null or non-finite component, take no part, nor do those whose length
isn't the most frequent one, nor those whose scaled vector is so long that scores may not fit a long (2**31). Zero
vectors take part. Repeated rows, and rows with one id, are rows of their own: each is an anchor where its id says so,
and each is a candidate of all others. Extra columns are dropped, whatever their names. An empty table gives an empty
result, and so does an anchor without positives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegraph.llm.common import bound_batches, saved, scratch

#: Rows of a candidate cell, most cells, and rows of a block of cells that a task holds.
CELL_ROWS, MOST_CELLS, BLOCK_ROWS = 1024, 4096, 8192
#: Anchors of a group.
GROUP_ROWS = 256
#: A scaled vector's length from which scores may not fit a long; the product of two lengths up to which sums of doubles are exact.
MOST_LENGTH, EXACT = float(1 << 31), float(1 << 53)
#: What rounding may add to a bound, relative to its terms.
SLACK = 1e-9


@dataclass
class SplitTree:
    """A full binary tree of cuts across directions; branch i has the children 2i + 1 and 2i + 2, and its leaves have centres."""

    directions: np.ndarray
    cuts: np.ndarray
    centres: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, cells: int) -> SplitTree:
        """A tree with so many leaves or up to twice as many, each of about the same share of the sample."""
        depth = max(0, int(np.ceil(np.log2(max(cells, 1)))))
        branches, width = (1 << depth) - 1, sample.shape[1]
        directions, cuts = np.zeros((branches, width)), np.zeros(branches)
        parts = [sample]
        for i in range(branches):
            part = parts[i]
            if len(part) > 1:
                far = part[np.square(part - part.mean(axis=0)).sum(axis=1).argmax()]
                other = part[np.square(part - far).sum(axis=1).argmax()]
                long_ = np.sqrt(np.square(other - far).sum())
                directions[i] = (other - far) / long_ if long_ else 0
                cuts[i] = np.median(part @ directions[i])
            right = part @ directions[i] > cuts[i]
            parts += [part[~right], part[right]]
        centres = np.stack([p.mean(axis=0) if len(p) else np.zeros(width) for p in parts[branches:]])
        return cls(directions, cuts, centres)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at = np.zeros(len(x), np.int64)
        while len(x) and at[0] < len(self.cuts):
            along = np.einsum("nd,nd->n", x, self.directions[at])
            at = 2 * at + 1 + (along > self.cuts[at])
        return at - len(self.cuts)


def interval(a: np.ndarray, a_far: np.ndarray | float, b: np.ndarray, b_far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of all inner products between rows no farther than a_far from a and rows no farther than b_far from each b."""
    middle = b @ a
    length_a, length_b = np.sqrt(a @ a), np.sqrt(np.square(b).sum(axis=1))
    wide = a_far * length_b + b_far * length_a + a_far * b_far
    wide = wide + SLACK * (length_a * length_b + wide + 1)
    return middle - wide, middle + wide


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, exactly."""
    if not len(x) or not len(y):
        return np.zeros((len(x), len(y)), np.int64)
    length = lambda z: float(np.sqrt(np.square(z).sum(axis=1).max()))
    if length(x) * length(y) < EXACT / 2:
        return (x @ y.T).astype(np.int64)
    return x.astype(np.int64) @ y.astype(np.int64).T


def best_of(score: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: higher scores, then smaller ids."""
    if len(score) > 4 * k:
        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        some = np.arange(len(score))
    return some[np.lexsort((rows[some], ids[some], -score[some]))][:k]


class Best:
    """The k best candidates of each of some seekers; a seeker is an anchor with a band of scores."""

    def __init__(self, k: int, low: np.ndarray, high: np.ndarray):
        self.k, self.low, self.high = k, low.copy(), high  # low rises as more is found
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray] | None] = [None] * len(low)

    def add(self, which: int, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        old = self.found[which]
        if old is not None:
            score, ids, rows = (np.concatenate(x) for x in zip(old, (score, ids, rows), strict=True))
        at = best_of(score, ids, rows, self.k)
        self.found[which] = score[at], ids[at], rows[at]
        if len(at) == self.k:
            self.low[which] = max(self.low[which], score[at[-1]])

    def meet(self, scores: np.ndarray, fits: np.ndarray, seekers: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Candidates whose scores, one line a seeker, lie in its band and that fit it otherwise."""
        ok = fits & (scores >= self.low[seekers][:, None]) & (scores <= self.high[seekers][:, None])
        some = np.flatnonzero(ok.any(axis=1))
        for i in some.tolist():
            at = np.flatnonzero(ok[i])
            self.add(int(seekers[i]), scores[i, at], ids[at], rows[at])


def scaled(df: DataFrame, scale: float, id_col: str, vector_col: str, label: F.Column) -> DataFrame:
    """(id, label, v array<double>) of the rows that take part, v in whole numbers."""
    v = df[vector_col].cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(df[id_col].cast("long").alias("id"), label.cast("long").alias("label"), v.alias("raw")).filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("raw").isNotNull()).filter(sound)
    length = rows.groupBy(F.size("raw").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.filter(F.size("raw") == (length.n if length else 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with np.errstate(over="ignore"):
                x = np.floor(scale * _vectors(batch.column(2)))
                fits = np.sqrt(np.square(x).sum(axis=1)) < MOST_LENGTH
            width = x.shape[1]
            x = x[fits]
            mask = pa.array(fits)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * width, pa.int32()), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask), lists], ["id", "label", "v"])

    return rows.mapInArrow(run, "id long, label long, v array<double>")


def _vectors(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) if n else np.zeros((0, 0))


@dataclass
class Cells:
    """The candidates' tree, and how far the rows of each cell are from its centre; cells lie in blocks in their order."""

    tree: SplitTree
    far: np.ndarray  # below 0: no rows
    first_block: np.ndarray
    parts: np.ndarray  # over how many blocks a cell's rows are dealt


def _sample(rows: DataFrame, most: int) -> list:
    return rows.orderBy(F.xxhash64("id", "row"), "row").limit(most).collect()


def _celled(rows: DataFrame, tree: SplitTree) -> DataFrame:
    """rows (row, id, label, v) with their cell and the distance from its centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _vectors(batch.column(3))
                cell = tree.leaf(x)
                far = np.sqrt(np.square(x - tree.centres[cell]).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(far)], ["row", "id", "label", "v", "cell", "far"])

    return rows.mapInArrow(run, "row long, id long, label long, v array<double>, cell int, far double")


def _blocks(celled: DataFrame, tree: SplitTree) -> Cells:
    """Blocks of whole cells next to each other, or parts of one large cell."""
    far, rows = np.full(len(tree.centres), -1.0), np.zeros(len(tree.centres), np.int64)
    for r in celled.groupBy("cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect():  # a row a cell
        far[r.cell], rows[r.cell] = r.far, r.n
    first, parts = np.zeros(len(rows), np.int32), np.ones(len(rows), np.int32)
    following, open_, held = 0, None, 0
    for c, n in enumerate(rows.tolist()):
        if n > BLOCK_ROWS:
            first[c], parts[c], open_ = following, -(-n // BLOCK_ROWS), None
            following += int(parts[c])
        else:
            if open_ is None or held + n > BLOCK_ROWS:
                open_, held, following = following, 0, following + 1
            first[c], held = open_, held + n
    return Cells(tree, far, first, parts)


_HELD = "block int, role int, node int, row long, id long, label long, v array<double>, low array<long>, high array<long>"
_NAMES = ["block", "role", "node", "row", "id", "label", "v", "low", "high"]


def _held(celled: DataFrame, cells: Cells) -> DataFrame:
    """Candidates by block (role 0); the node is the cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, row = batch.column(4).to_numpy(), batch.column(0).to_numpy()
            block = cells.first_block[cell] + (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % cells.parts[cell]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(np.zeros(n, np.int32)), batch.column(4), *batch.columns[:4], pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))], _NAMES)

    return celled.mapInArrow(run, _HELD)


def _grouped(anchors: DataFrame, tree: SplitTree) -> DataFrame:
    """anchors (row, id, label, v, ...) with their group, in tasks of groups next to each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(tree.leaf(_vectors(batch.column(3))), pa.int32()), *batch.columns], ["node", *batch.schema.names])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema.fields)
    return anchors.mapInArrow(run, f"node int, {kinds}").repartition("node").sortWithinPartitions("node")


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as lines."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _visits(grouped: DataFrame, cells: Cells) -> DataFrame:
    """Anchors (node, row, id, label, v, low, high) by the blocks that they can't pass over (role 1). low, high: bands of scores that matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = np.flatnonzero(cells.far >= 0)
        for batch in batches:
            node = batch.column(0).to_numpy()
            for lo in _starts(node, GROUP_ROWS):
                part = batch.slice(lo, min(GROUP_ROWS, int(np.searchsorted(node, node[lo], "right")) - lo))
                x, low, high = _vectors(part.column(4)), _matrix(part.column(5)), _matrix(part.column(6))
                centre, far = ball(x)
                under, over = interval(centre, far, cells.tree.centres[some], cells.far[some])
                met = some[(over >= low.min()) & (under <= high.max())]
                visited = {b for c in met.tolist() for b in range(int(cells.first_block[c]), int(cells.first_block[c] + cells.parts[c]))}
                n = part.num_rows
                for block in sorted(visited):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block, np.int32)), pa.array(np.ones(n, np.int32)), *part.columns], _NAMES)

    return grouped.select("node", "row", "id", "label", "v", "low", "high").mapInArrow(run, _HELD)


def _starts(node: np.ndarray, most: int) -> list[int]:
    """Where groups begin in sorted nodes; large ones are cut."""
    edges = [0, *(np.flatnonzero(np.diff(node)) + 1).tolist(), len(node)]
    return [lo for a, b in zip(edges[:-1], edges[1:], strict=True) for lo in range(a, b, most)]


def ball(x: np.ndarray) -> tuple[np.ndarray, float]:
    centre = x.mean(axis=0)
    return centre, float(np.sqrt(np.square(x - centre).sum(axis=1).max()))


@dataclass
class Block:
    """Candidates of one block, by cell."""

    cell: np.ndarray
    row: np.ndarray
    id: np.ndarray
    label: np.ndarray
    v: np.ndarray

    def __post_init__(self) -> None:
        order = np.argsort(self.cell, kind="stable")
        for name in ("cell", "row", "id", "label", "v"):
            setattr(self, name, getattr(self, name)[order])
        edges = [0, *(np.flatnonzero(np.diff(self.cell)) + 1).tolist(), len(self.cell)]
        self.spans = list(zip(edges[:-1], edges[1:], strict=True))
        balls = [ball(self.v[a:b]) for a, b in self.spans]
        self.centres, self.far = np.stack([c for c, _ in balls]), np.array([f for _, f in balls])

    def search(self, row: np.ndarray, label: np.ndarray, v: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> Iterator[tuple[np.ndarray, ...]]:
        """(place of the anchor, band, row, id, score) of the k best in each anchor's bands, of its label or of others; leaves are taken in order of their upper bounds."""
        m, bands = low.shape
        seekers = np.arange(m * bands).reshape(m, bands)
        best = Best(k, low.reshape(-1), high.reshape(-1))
        centre, far = ball(v)
        under, over = interval(centre, far, self.centres, self.far)
        for c in np.argsort(-over).tolist():
            if over[c] < best.low.min():
                break
            if under[c] > high.max():
                continue
            # anchors of the group that this leaf alone may still give something
            a, b = self.spans[c]
            own_low, own_high = interval_rows(v, self.centres[c], self.far[c])
            wanted = ((own_high[:, None] >= best.low.reshape(m, bands)) & (own_low[:, None] <= high)).any(axis=1)
            at = np.flatnonzero(wanted)
            if not len(at):
                continue
            scores = products(v[at], self.v[a:b])
            fits = (label[at][:, None] == self.label[None, a:b]) if same else (label[at][:, None] != self.label[None, a:b])
            fits &= row[at][:, None] != self.row[None, a:b]
            for j in range(bands):
                best.meet(scores, fits, seekers[at, j], self.id[a:b], self.row[a:b])
        for i, found in enumerate(best.found):
            if found is not None:
                n = len(found[0])
                yield np.full(n, i // bands), np.full(n, i % bands), found[2], found[1], found[0]


def interval_rows(x: np.ndarray, b: np.ndarray, b_far: float) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of each x's inner products with rows no farther than b_far from b."""
    length = np.sqrt(np.square(x).sum(axis=1))
    wide = b_far * length
    wide = wide + SLACK * (length * np.sqrt(b @ b) + wide + 1)
    return x @ b - wide, x @ b + wide


_FOUND = "anchor long, anchor_id long, band int, row long, id long, score long"


def _searched(rows: DataFrame, k: int, same: bool) -> DataFrame:
    """What each block's candidates give its visitors; one block is held at a time, and one group of anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, block, group = None, [], None, []

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal block, parts, group
            if group:
                if block is None and parts:
                    block, parts = Block(*(np.concatenate(x) for x in zip(*parts, strict=True))), []
                _, row, ids, label, v, low, high = (np.concatenate(x) for x in zip(*group, strict=True))
                group = []
                if block is not None:
                    for who, band, other, other_id, score in block.search(row, label, v, low, high, k, same):
                        yield pa.RecordBatch.from_arrays([pa.array(row[who]), pa.array(ids[who]), pa.array(band, pa.int32()), pa.array(other), pa.array(other_id), pa.array(score)], ["anchor", "anchor_id", "band", "row", "id", "score"])

        for batch in batches:
            number, role, node = (batch.column(c).to_numpy() for c in range(3))
            edges = [0, *(np.flatnonzero(np.diff(number) | np.diff(role) | np.where(role[1:] == 1, np.diff(node), 0)) + 1).tolist(), len(number)]
            for lo in (x for a, b in zip(edges[:-1], edges[1:], strict=True) for x in range(a, b, GROUP_ROWS)):
                now = int(number[lo]), int(role[lo]), int(node[lo]) if role[lo] else -1
                hi = min(lo + GROUP_ROWS, edges[int(np.searchsorted(edges, lo, "right"))])
                part = batch.slice(lo, hi - lo)
                if now != key or sum(len(g[0]) for g in group) + hi - lo > GROUP_ROWS:
                    yield from out()
                    if key is None or now[0] != key[0]:
                        parts, block = [], None
                    key = now
                own = [*(part.column(c).to_numpy().copy() for c in (2, 3, 4, 5)), _vectors(part.column(6))]
                if role[lo] == 0:
                    parts.append(own)
                else:
                    group.append([*own, _matrix(part.column(7)), _matrix(part.column(8))])
        yield from out()

    return rows.repartition("block").sortWithinPartitions("block", "role", "node").mapInArrow(run, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each anchor and band, with their rank."""
    order = Window.partitionBy("anchor", "band").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _with_bounds(anchors: DataFrame, sample: list, k: int, bands: Callable[[list[int] | None], list[tuple[int, int]]], same: bool) -> DataFrame:
    """anchors (row, id, label, v[, scores]) with the bands that matter (low, high), raised to the k-th best score of the sample."""
    label, row, ids = (np.array([r[c] for r in sample], np.int64) for c in ("label", "row", "id"))
    block = Block(label, row, ids, label, np.array([r.v for r in sample], float))  # labels are its cells
    shared = anchors.sparkSession.sparkContext.broadcast(block)  # sample_rows vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4).to_pylist() if batch.num_columns > 4 else [None] * batch.num_rows
            limits = [bands(x) for x in lists]
            for lo in range(0, batch.num_rows, GROUP_ROWS):
                part, some = batch.slice(lo, GROUP_ROWS), limits[lo : lo + GROUP_ROWS]
                low, high = (np.array([[b[e] for b in x] for x in some], np.int64) for e in (0, 1))
                row, label, v = part.column(0).to_numpy(), part.column(2).to_numpy(), _vectors(part.column(3))
                raised = low.copy()
                for who, band, _, _, score in shared.value.search(row, label, v, low, high, k, same):
                    if len(score) == k:
                        raised[who[0], band[0]] = max(raised[who[0], band[0]], score.min())
                ends = pa.array(np.arange(len(row) + 1) * low.shape[1], pa.int32())
                more = [pa.ListArray.from_arrays(ends, pa.array(x.reshape(-1))) for x in (raised, high)]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], *more], ["row", "id", "label", "v", "low", "high"])

    return anchors.mapInArrow(run, "row long, id long, label long, v array<double>, low array<long>, high array<long>")


#: Below and above all scores.
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def mine(df: DataFrame, *, every: int = 100, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: float = 256.0, sample_rows: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", label: F.Column | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by every. A negative's score is at least ``least`` and at most ``most``
    percent of the positive's. label: the label of a row, where it isn't a column's value. sample_rows: candidates and
    anchors that the trees are fitted on, and candidates whose scores give the first lower bounds.
    """
    spark: SparkSession = df.sparkSession
    bound_batches(spark)
    with scratch(spark) as keep:
        rows = scaled(df, scale, id_col, vector_col, df[label_col] if label is None else label)
        rows = saved(rows.withColumn("row", F.monotonically_increasing_id()).select("row", "id", "label", "v"), "vectors")
        empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        anchors = rows.filter(F.col("id") % every == 0)
        n, m = rows.count(), anchors.count()
        if n < 2 or not m:
            return spark.createDataFrame([], empty)
        sample, some = _sample(rows, sample_rows), _sample(anchors, sample_rows)
        points = lambda held: np.array([r.v for r in held], float)
        tree = SplitTree.fit(points(sample), min(MOST_CELLS, -(-n // CELL_ROWS)))
        groups = SplitTree.fit(points(some), min(MOST_CELLS, -(-m // GROUP_ROWS)))
        celled = saved(_celled(rows, tree), "cells")
        cells = _blocks(celled, tree)
        held = _held(celled, cells)

        def search(seekers: DataFrame, k: int, bands: Callable, same: bool) -> DataFrame:
            visits = _visits(_grouped(_with_bounds(seekers, sample, k, bands, same), groups), cells)
            return saved(_best(_searched(held.unionByName(visits), k, same), k), "found")

        first = search(anchors, positives, lambda _: [(LEAST, MOST)], True)
        scores = first.groupBy(F.col("anchor").alias("row")).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("scores"))  # positives an anchor
        # a band that no score can lie in fills up the list of an anchor with fewer positives
        def bands(known: list[int] | None) -> list[tuple[int, int]]:
            wanted = [(-((-least * p) // 100), (most * p) // 100) for p in known or []]
            return wanted + [(MOST, LEAST)] * (positives - len(wanted))

        second = search(anchors.join(scores, "row").select("row", "id", "label", "v", "scores"), negatives, bands, False)
        pairs = first.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).alias("band"))
        found = second.join(pairs, ["anchor", "band"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        return keep(found, "hard-negatives")
