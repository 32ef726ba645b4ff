"""Graph kernels for what fits one task, in plain arrays. Nothing recurses, so paths may be as long as they like."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows, nodes and edges together, up to which a graph is solved inside one task.
LOCAL_ROWS = 2_000_000


def in_one_task(df: DataFrame, solve: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """solve, applied to all rows of a df whose size has been checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            yield from solve(pa.Table.from_batches(held)).to_batches()

    return df.repartition(1).mapInArrow(run, schema)


def neighbours(n: int, s: np.ndarray, t: np.ndarray) -> tuple[list[int], list[int]]:
    """Starts and targets: those of i are targets[starts[i]:starts[i + 1]]."""
    order = np.argsort(s, kind="stable")
    return np.searchsorted(s[order], np.arange(n + 1)).tolist(), t[order].tolist()


def strong(n: int, starts: list[int], targets: list[int], roots: Iterable[int] | None = None) -> list[list[int]]:
    """Strongly connected components of nodes 0..n-1, each after all that it reaches."""
    seen, low, out, open_ = [0] * n, [0] * n, [], []
    clock, done = 0, n + 1
    for root in range(n) if roots is None else roots:
        if seen[root]:
            continue
        path = [(root, starts[root])]
        clock += 1
        seen[root] = low[root] = clock
        open_.append(root)
        while path:
            v, at = path.pop()
            end, best = starts[v + 1], low[v]
            while at < end:
                w = targets[at]
                at += 1
                if not seen[w]:
                    low[v] = best
                    path += ((v, at), (w, starts[w]))
                    clock += 1
                    seen[w] = low[w] = clock
                    open_.append(w)
                    break
                best = min(best, low[w])  # done nodes are above all clocks
            else:
                low[v] = best
                if best == seen[v]:
                    group = []
                    while not group or group[-1] != v:
                        group.append(open_.pop())
                        low[group[-1]] = done
                    out.append(group)
                elif path:
                    up = path[-1][0]
                    low[up] = min(low[up], best)
    return out


def solve(src: np.ndarray, dst: np.ndarray, far: bool = False) -> pa.Table:
    """(id, component, level, rank) of an edge list's nodes. level: longest path to a sink; rank: order by level and component. far: also that, the greatest name of a component that the node leads to, its own included; levels then count among those of one such name only."""
    ids, flat = np.unique(np.concatenate((src, dst)), return_inverse=True)
    n = len(ids)
    s, t = flat[: len(src)], flat[len(src) :]
    groups = strong(n, *neighbours(n, s, t))
    of = np.zeros(n, np.int64)
    name = np.zeros(len(groups), np.int64)
    for k, g in enumerate(groups):
        of[g] = k
        name[k] = ids[min(g)]
    s, t = of[s], of[t]
    if far:
        best = farthest(name, s, t)
        near = best[s] == best[t]
        s, t = s[near], t[near]
    level = levels(len(groups), s, t)
    order = np.lexsort((name, level))
    rank = np.empty(len(groups), np.int64)
    rank[order] = np.arange(1, len(groups) + 1)
    found = {"id": ids, "component": name[of], "level": level[of], "rank": rank[of]}
    if far:
        found["far"] = best[of]
    return pa.table(found)


def farthest(name: np.ndarray, s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The greatest name that paths lead to, where every edge leads from a later to an earlier number or to itself."""
    best = name.tolist()
    starts, targets = neighbours(len(best), s, t)
    for v in range(len(best)):
        if starts[v] < starts[v + 1]:
            best[v] = max(best[v], max(best[w] for w in targets[starts[v] : starts[v + 1]]))
    return np.array(best, np.int64)


def levels(n: int, s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Longest paths to a sink, where every edge leads from a later to an earlier number or to itself."""
    level = [0] * n
    some = s != t
    starts, targets = neighbours(n, s[some], t[some])
    for v in range(n):
        if starts[v] < starts[v + 1]:
            level[v] = 1 + max(level[w] for w in targets[starts[v] : starts[v + 1]])
    return np.array(level, np.int64)


def reached(src: np.ndarray, dst: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Seeds, and nodes on paths from them."""
    ids, flat = np.unique(np.concatenate((src, dst, seeds)), return_inverse=True)
    n, m = len(ids), len(src)
    starts, targets = neighbours(n, flat[:m], flat[m : 2 * m])
    seen = np.zeros(n, bool)
    todo = np.unique(flat[2 * m :]).tolist()
    seen[todo] = True
    while todo:
        v = todo.pop()
        for w in targets[starts[v] : starts[v + 1]]:
            if not seen[w]:
                seen[w] = True
                todo.append(w)
    return ids[seen]


def carried(src: np.ndarray, dst: np.ndarray, ids: np.ndarray, values: np.ndarray, gain: int) -> pa.Table:
    """(id, value): the greatest that paths bring to a node from ids that hold values, gain more with every edge, where that is more than it holds itself. With a gain, there are no cycles."""
    names, flat = np.unique(np.concatenate((src, dst, ids)), return_inverse=True)
    n, m = len(names), len(src)
    starts, targets = neighbours(n, flat[:m], flat[m : 2 * m])
    held: list[int | None] = [None] * n
    for v, x in zip(flat[2 * m :].tolist(), values.tolist()):
        if held[v] is None or held[v] < x:
            held[v] = x
    best = held.copy()
    for group in reversed(strong(n, starts, targets, np.unique(flat[2 * m :]).tolist())):  # each before all that it reaches
        top = max(best[v] for v in group if best[v] is not None)
        for v in group:
            best[v] = top
        for v in group:
            for w in targets[starts[v] : starts[v + 1]]:
                if best[w] is None or best[w] < top + gain:
                    best[w] = top + gain
    grown = [v for v in range(n) if best[v] is not None and (held[v] is None or best[v] > held[v])]
    return pa.table({"id": names[grown].astype(np.int64), "value": pa.array([best[v] for v in grown], pa.int64())})
