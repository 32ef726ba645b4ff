"""Edge by edge and batch by batch maintenance inside one task, for graphs or parts of graphs that fit it.

A component is known by one of its nodes. Components in one space stand in an order, and edges inside a space lead from
a higher to a lower one. Without time coupling there is one space. With it, Gm is a space, each year of Gsi is one, and
the components of Gr have no place, since no edge can close a cycle there.

An edge that leads upward in its space is settled by a search between its ends, of one of three kinds:

* forward: all that the head leads to, down to the tail; it moves below the tail;
* both: that, and all that leads to the tail, up to the head; what both found takes its own places anew;
* two-way: both searches advance in turn, the one from the head downward and the one from the tail upward, and stop where
  they meet. What lies beyond the meeting is never looked at. What was found moves to the meeting.

What both ends reach is a new cycle, and becomes one component. A batch of edges is settled one after the other, by
islands, or in rounds. Islands: intervals of places that upward edges span are merged, and each island takes one search
from all its heads and tails, one solution, and one new order. Rounds: an edge whose ends lie in a region that this round
has changed waits for the next, where it often leads downward by itself.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import astuple, dataclass
from heapq import heappop, heappush
from time import perf_counter

import numpy as np

from tidegraph.operators import kernel

#: The space of Gm, and of everything without time coupling; a year of Gsi has twice its number. None: no space.
GM = -1
#: How single edges are searched, and how batches are settled.
SEARCHES, SETTLINGS = ("forward", "both", "two-way"), ("single", "islands", "rounds")
#: Between the labels of two neighbours, where there is room.
GAP = 1 << 32


def year_space(year: int) -> int:
    return 2 * year


@dataclass
class Counts:
    """What one run of insertions did.

    inserted: edges between components; unsettled: those of them that, as their batch began, led upward or changed parts;
    invalid: those that led upward at their turn; parted: those that changed parts; affected: components that got new
    places; visited: components met by searches; migrated: nodes that moved to Gm; merged: components that vanished into
    others; islands: merged intervals; rounds; deferred: edges that waited for another round; and seconds.
    """

    inserted: int = 0
    unsettled: int = 0
    parted: int = 0
    invalid: int = 0
    affected: int = 0
    visited: int = 0
    migrated: int = 0
    merged: int = 0
    islands: int = 0
    rounds: int = 0
    deferred: int = 0
    search_seconds: float = 0.0
    reassign_seconds: float = 0.0
    condense_seconds: float = 0.0

    def as_tuple(self) -> tuple:
        return astuple(self)


class Order:
    """Components of one space, lowest first: linked with their neighbours, and with labels that leave gaps. The labels of all spaces are kept in one place."""

    def __init__(self, rank: dict[int, int]):
        self.rank = rank
        self.up: dict[int, int | None] = {}
        self.down: dict[int, int | None] = {}
        self.first: int | None = None
        self.last: int | None = None

    def insert(self, below: int | None, run: list[int]) -> None:
        """Put the run, lowest first, just above below; None: under all."""
        if not run:
            return
        above = self.first if below is None else self.up[below]
        chain = [below, *run, above]
        for a, b in zip(chain[:-1], chain[1:], strict=True):
            if a is not None:
                self.up[a] = b
            if b is not None:
                self.down[b] = a
        if below is None:
            self.first = run[0]
        if above is None:
            self.last = run[-1]
        self._label(below, run, above)

    def _label(self, below: int | None, run: list[int], above: int | None) -> None:
        rank = self.rank
        if below is None and above is not None:
            for i, c in enumerate(reversed(run), 1):
                rank[c] = rank[above] - i * GAP
            return
        low, held = 0 if below is None else rank[below], list(run)
        while above is not None and rank[above] - low < (len(held) + 1) ** 2:  # too narrow: the neighbours above get new labels, too
            for _ in range(max(8, len(held))):
                if above is None:
                    break
                held.append(above)
                above = self.up[above]
        step = GAP if above is None else (rank[above] - low) // (len(held) + 1)
        for i, c in enumerate(held, 1):
            rank[c] = low + i * step

    def remove(self, c: int) -> None:
        d, u = self.down.pop(c), self.up.pop(c)
        if d is None:
            self.first = u
        else:
            self.up[d] = u
        if u is None:
            self.last = d
        else:
            self.down[u] = d
        del self.rank[c]

    def move(self, below: int | None, run: list[int]) -> None:
        for c in run:
            self.remove(c)
        self.insert(below, run)

    def deal(self, old: list[int], new: list[int]) -> None:
        """Each of new takes the place of its partner in old, some of which may be the same."""
        to = dict(zip(old, new, strict=True))
        places = [(self.down.pop(o), self.up.pop(o), self.rank.pop(o)) for o in old]
        for n, (d, u, r) in zip(new, places, strict=True):
            self.rank[n], self.down[n], self.up[n] = r, to.get(d, d), to.get(u, u)
            if d is None:
                self.first = n
            elif d not in to:
                self.up[d] = n
            if u is None:
                self.last = n
            elif u not in to:
                self.down[u] = n


class Replay:
    """Components and their order under insertions. Ids that aren't known come in with year 0, as components of their own. labels: the given ranks stay as labels, which islands deal anew and nothing else changes."""

    def __init__(self, ids: np.ndarray, component: np.ndarray, space: list[int | None], rank: list[int | None], year: np.ndarray, src: np.ndarray, dst: np.ndarray, *, coupled: bool = False, search: str = "two-way", settling: str = "single", labels: bool = False):
        if search not in SEARCHES or settling not in SETTLINGS or (labels and settling != "islands"):
            raise ValueError(f"search {search}, settling {settling}")
        self.coupled, self.search, self.settling = coupled, search, settling
        self.ids, self.year = ids.tolist(), year.tolist()
        self.index = {v: i for i, v in enumerate(self.ids)}
        self.of = [self.index[c] for c in component.tolist()]
        self.name = dict(enumerate(self.ids))  # smallest id of each component
        self.space, self.rank, self.members = {}, {}, {}
        self.orders: dict[int, Order] = {}
        places: dict[int, list[tuple[int, int]]] = {}
        for v, c in enumerate(self.of):
            if c not in self.members and space[v] is not None:
                places.setdefault(space[v], []).append((rank[v], c))
            self.members.setdefault(c, []).append(v)
        for at, held in places.items():
            for r, c in sorted(held):
                self._place(c, at)
                if labels:
                    self.rank[c] = r
        self.out: dict[int, list[int]] = {}
        self.into: dict[int, list[int]] = {}
        for s, t in zip(src.tolist(), dst.tolist(), strict=True):
            self._link(self.of[self._node(s)], self.of[self._node(t)])
        self.counts = Counts()
        self.scopes: dict[int, int] = {}  # by space, edges that led upward there as their batch began

    def _node(self, v: int) -> int:
        if v not in self.index:
            i = self.index[v] = len(self.ids)
            self.ids.append(v)
            self.year.append(0)
            self.of.append(i)
            self.name[i], self.members[i] = v, [i]
            if not self.coupled:
                self._place(i, GM)
        return self.index[v]

    def _order(self, space: int) -> Order:
        if space not in self.orders:
            self.orders[space] = Order(self.rank)
        return self.orders[space]

    def _place(self, c: int, space: int) -> None:
        """c stands above all of the space."""
        order = self._order(space)
        order.insert(order.last, [c])
        self.space[c] = space

    def _leave(self, c: int) -> None:
        if c in self.space:
            self.orders[self.space.pop(c)].remove(c)

    def _link(self, a: int, b: int) -> None:
        self.out.setdefault(a, []).append(b)
        self.into.setdefault(b, []).append(a)

    def _neighbours(self, links: dict[int, list[int]], c: int) -> list[int]:
        """Components at the other ends of c's links, each once; the list is kept so."""
        if c not in links:
            return []
        of = self.of
        links[c] = now = [x for x in {of[t] for t in links[c]} if x != c]
        return now

    def insert(self, src: list[int], dst: list[int]) -> None:
        """One batch: edges that lead downward first, then the others, each of which may lead downward by then."""
        later = []
        for s, t in zip(src, dst, strict=True):
            a, b = self._node(s), self._node(t)
            if self.of[a] == self.of[b]:
                continue
            self.counts.inserted += 1
            if self.coupled and not self._settled(a, b) or not self.coupled and self._upward(self.of[a], self.of[b]):
                later.append((a, b))
                if self._upward(self.of[a], self.of[b]):
                    at = self.space[self.of[a]]
                    self.scopes[at] = self.scopes.get(at, 0) + 1
            else:
                self._link(self.of[a], self.of[b])
        self.counts.unsettled += len(later)
        if self.settling == "islands":
            self._by_islands(later)
        elif self.settling == "rounds":
            self._by_rounds(later)
        else:
            for a, b in later:
                self._insert_one(a, b)

    def _insert_one(self, a: int, b: int) -> set[int]:
        """Insert an edge of nodes a and b; the region that it changed."""
        x, y = self.of[a], self.of[b]
        if x == y:
            return set()
        self._link(x, y)
        if self.coupled:
            self._enter(a, b)
        return self._maintain(self.of[a], self.of[b])

    def _by_islands(self, later: list[tuple[int, int]]) -> None:
        """All edges at once: parts first, then each space's islands."""
        edges = []
        for a, b in later:
            if self.of[a] != self.of[b]:
                self._link(self.of[a], self.of[b])
                edges.append((a, b))
        if self.coupled:
            moved = True
            while moved:  # what a node that has moved leads to has moved with it, but for unlisted order of the batch
                moved = any([self._enter(a, b) for a, b in edges])
        spans: dict[int, list[tuple[int, int, int, int]]] = {}
        for a, b in edges:
            x, y = self.of[a], self.of[b]
            if self._upward(x, y):
                spans.setdefault(self.space[x], []).append((self.rank[x], self.rank[y], x, y))
        for space, held in spans.items():
            self.counts.invalid += len(held)
            island: list[tuple[int, int, int, int]] = []
            far = 0
            for span in sorted(held):
                if island and span[0] > far:
                    self._settle_island(space, island, far)
                    island = []
                far = max(far, span[1]) if island else span[1]
                island.append(span)
            self._settle_island(space, island, far)

    def _settle_island(self, space: int, spans: list[tuple[int, int, int, int]], hi: int) -> None:
        """One search from all heads and tails; its cycles become components, and what it found takes its own places anew."""
        began = perf_counter()
        lo, order = spans[0][0], self.orders[space]
        ahead = self._reach(self.out, {y for *_, y in spans}, space, lo, hi)
        behind = self._reach(self.into, {x for _, _, x, _ in spans}, space, lo, hi)
        both = ahead & behind
        self.counts.islands += 1
        self.counts.visited += len(ahead) + len(behind)
        searched = perf_counter()
        names = sorted(both, key=self.rank.__getitem__)
        at = {c: k for k, c in enumerate(names)}
        targets = [[at[x] for x in self._neighbours(self.out, c) if x in at] for c in names]
        groups = [[names[k] for k in g] for g in kernel.strong(len(names), np.cumsum([0, *map(len, targets)]).tolist(), [k for t in targets for k in t])]
        low = sorted(ahead - both, key=self.rank.__getitem__)
        high = sorted(behind - both, key=self.rank.__getitem__)
        old = sorted(ahead | behind, key=self.rank.__getitem__)
        self.counts.affected += len(old)
        order.deal(old, [*low, *(c for g in groups for c in g), *high])
        dealt = perf_counter()
        for g in groups:
            if len(g) > 1:
                self._become_one(order, g, g[0])
        self.counts.search_seconds += searched - began
        self.counts.reassign_seconds += dealt - searched
        self.counts.condense_seconds += perf_counter() - dealt

    def _by_rounds(self, later: list[tuple[int, int]]) -> None:
        """The batch by group: Gm, each year, and what changes parts, one edge after the other. In a round, edges that touch a changed region wait."""
        groups: dict[int | None, list[tuple[int, int]]] = {}
        for a, b in later:
            x, y = self.of[a], self.of[b]
            groups.setdefault(self.space[x] if self._upward(x, y) else None, []).append((a, b))
        rest = groups.pop(None, [])
        for edges in groups.values():
            while edges:
                self.counts.rounds += 1
                changed: set[int] = set()
                waiting = []
                for a, b in edges:
                    if self.of[a] in changed or self.of[b] in changed:
                        waiting.append((a, b))
                    else:
                        changed |= self._insert_one(a, b)
                self.counts.deferred += len(waiting)
                edges = []
                for a, b in waiting:
                    x, y = self.of[a], self.of[b]
                    if self._upward(x, y):
                        edges.append((a, b))
                    elif x != y:
                        self._link(x, y)
        for a, b in rest:
            self._insert_one(a, b)

    def _upward(self, a: int, b: int) -> bool:
        return a != b and self.space.get(a) is not None and self.space[a] == self.space.get(b) and self.rank[a] < self.rank[b]

    def _settled(self, a: int, b: int) -> bool:
        """With time coupling: whether the edge of nodes a and b changes neither parts nor order."""
        x, y = self.of[a], self.of[b]
        if self.space.get(y) == GM:
            return self.space.get(x) != GM or not self._upward(x, y)
        if self.space.get(x) == GM or self.year[a] < self.year[b]:
            return False
        return self.year[a] > self.year[b] or self.space.get(y) is not None and not self._upward(x, y)

    def _enter(self, a: int, b: int) -> bool:
        """Change parts as an edge of nodes a and b asks; whether it did."""
        x, y = self.of[a], self.of[b]
        if self.space.get(y) == GM:
            return False
        if self.space.get(x) == GM or self.year[a] < self.year[b]:
            self._migrate(y, x if self.space.get(x) == GM else None)
            return True
        if self.year[a] == self.year[b] and self.space.get(y) is None:
            self.counts.parted += 1
            self._place(y, year_space(self.year[b]))  # no settled edge of its year led to it, so it may stand above the others
            return True
        return False

    def _maintain(self, a: int, b: int) -> set[int]:
        """Mend the order after an edge between components a and b, if it leads upward in a space; the region that was searched."""
        if not self._upward(a, b):
            return set()
        self.counts.invalid += 1
        return self._both(a, b) if self.search == "both" else self._meeting(a, b)

    def _reach(self, links: dict[int, list[int]], starts: Iterable[int], space: int, lo: int, hi: int) -> set[int]:
        """What the starts lead to by links, between two places of a space."""
        of, at, rank = self.of, self.space, self.rank
        found = set(starts)
        todo = list(found)
        while todo:
            for t in links.get(todo.pop(), ()):
                x = of[t]
                if x not in found and at.get(x) == space and lo <= rank[x] <= hi:
                    found.add(x)
                    todo.append(x)
        return found

    def _both(self, a: int, b: int) -> set[int]:
        """Both searches in full; first what the head leads to takes the found places, then the new component, then what leads to the tail."""
        began = perf_counter()
        space, lo, hi = self.space[a], self.rank[a], self.rank[b]
        ahead = self._reach(self.out, (b,), space, lo, hi)
        behind = self._reach(self.into, (a,), space, lo, hi)
        cycle = ahead & behind
        self.counts.visited += len(ahead) + len(behind)
        searched = perf_counter()
        place = self.rank.__getitem__
        old = sorted(ahead | behind, key=place)
        self.counts.affected += len(old)
        self.orders[space].deal(old, [*sorted(ahead - cycle, key=place), *cycle, *sorted(behind - cycle, key=place)])
        dealt = perf_counter()
        region = ahead | behind
        if cycle:
            first = next(iter(cycle))
            region.add(self._become_one(self.orders[space], list(cycle), first))
        self.counts.search_seconds += searched - began
        self.counts.reassign_seconds += dealt - searched
        self.counts.condense_seconds += perf_counter() - dealt
        return region

    def _meeting(self, a: int, b: int) -> set[int]:
        """Two searches that meet, or that from the head alone; what they found moves next to where they stop."""
        began = perf_counter()
        at, rank, of, out, into = self.space, self.rank, self.of, self.out, self.into
        space, lo, hi = at[a], rank[a], rank[b]
        order = self.orders[space]
        down, up = [(-hi, b)], [(lo, a)]
        from_head, to_tail = {b}, {a}
        ahead: list[int] = []
        behind: list[int] = []
        spent_ahead = spent_behind = 0
        alone, closed = self.search == "forward", False
        while down and up and (alone or -down[0][0] >= up[0][0]):
            if alone or spent_ahead <= spent_behind:
                c = heappop(down)[1]
                ahead.append(c)
                held = out.get(c, ())
                spent_ahead += len(held) + 1
                for t in held:
                    x = of[t]
                    if x not in from_head and at.get(x) == space and rank[x] >= lo:
                        from_head.add(x)
                        closed |= x in to_tail
                        heappush(down, (-rank[x], x))
            else:
                c = heappop(up)[1]
                behind.append(c)
                held = into.get(c, ())
                spent_behind += len(held) + 1
                for t in held:
                    x = of[t]
                    if x not in to_tail and at.get(x) == space and rank[x] <= hi:
                        to_tail.add(x)
                        closed |= x in from_head
                        heappush(up, (rank[x], x))
        self.counts.visited += len(ahead) + len(behind)
        cycle: set[int] = set()
        if closed:  # what the head leads to, lowest first, and what leads to the tail, highest first
            for c in sorted(ahead, key=rank.__getitem__):
                if c in to_tail or any((x := of[t]) in to_tail or x in cycle for t in out.get(c, ())):
                    cycle.add(c)
            more: set[int] = set()
            for c in sorted(behind, key=rank.__getitem__, reverse=True):
                if c in from_head or any((x := of[t]) in from_head or x in more for t in into.get(c, ())):
                    more.add(c)
            cycle |= more
        searched = perf_counter()
        low = sorted((c for c in ahead if c not in cycle), key=rank.__getitem__)
        high = sorted((c for c in behind if c not in cycle), key=rank.__getitem__)
        stays = -1
        if not down:  # all that the head leads to moves below the tail
            moved, stays = low, a
            for c in moved:
                order.remove(c)
            order.insert(order.down[a], moved)
        elif not up:  # all that leads to the tail moves above the head
            moved, stays = high, b
            order.move(b, moved)
        else:  # both move above the highest that the search from the head did not take
            top = down[0][1]
            stays = next((c for c in cycle if c != top), -1)
            moved = [*low, *([stays] if cycle else []), *(c for c in high if rank[c] < rank[top])]
            order.move(top, moved)
        self.counts.affected += len(set(moved) | cycle)
        dealt = perf_counter()
        region = {*ahead, *behind}
        if cycle:
            region.add(self._become_one(order, list(cycle), stays))
        self.counts.search_seconds += searched - began
        self.counts.reassign_seconds += dealt - searched
        self.counts.condense_seconds += perf_counter() - dealt
        return region

    def _become_one(self, order: Order, group: list[int], stays: int) -> int:
        """One component of several in a space, in the place of one of them."""
        space = self.space[stays]
        for c in group:
            del self.space[c]
            if c != stays:
                order.remove(c)
        keep = self._merge(group)
        if keep != stays:
            order.deal([stays], [keep])
        self.space[keep] = space
        return keep

    def _merge(self, group: list[int]) -> int:
        """One component of several, without a place; the one with the most members stays."""
        keep = max(group, key=lambda c: len(self.members[c]))
        for c in group:
            if c == keep:
                continue
            self.counts.merged += 1
            for v in (moved := self.members.pop(c)):
                self.of[v] = keep
            self.members[keep] += moved
            self.name[keep] = min(self.name[keep], self.name.pop(c))
            for links in (self.out, self.into):
                if c in links:
                    few, many = sorted((links.get(keep, []), links.pop(c)), key=len)
                    many += few
                    links[keep] = many
        for links in (self.out, self.into):
            self._neighbours(links, keep)
        return keep

    def _migrate(self, b: int, tail: int | None) -> None:
        """b, and what it leads to outside Gm, move to Gm, each just above the highest there that it leads to; cycles among them become components. What leads nowhere in Gm goes just below the tail that brought it, or, if that isn't in Gm, below all."""
        began = perf_counter()
        self.counts.parted += 1
        found, todo = {b: 0}, [b]
        while todo:
            for x in self._neighbours(self.out, todo.pop()):
                if x not in found and self.space.get(x) != GM:
                    found[x] = len(found)
                    todo.append(x)
        names = list(found)
        targets = [[found[x] for x in self._neighbours(self.out, c) if x in found] for c in names]
        groups = kernel.strong(len(names), np.cumsum([0, *map(len, targets)]).tolist(), [k for t in targets for k in t])
        self.counts.visited += len(names)
        self.counts.migrated += sum(len(self.members[c]) for c in names)
        self.counts.search_seconds += perf_counter() - began
        for c in names:
            self._leave(c)
        order = self._order(GM)
        for g in groups:  # each after all that it reaches
            c = self._merge([names[k] for k in g]) if len(g) > 1 else names[g[0]]
            inner = [x for x in self._neighbours(self.out, c) if self.space.get(x) == GM]
            if inner:
                order.insert(max(inner, key=self.rank.__getitem__), [c])
            else:
                order.insert(None if tail is None else order.down[tail], [c])
            self.space[c] = GM

    def part(self, v: int) -> str:
        at = self.space.get(self.of[v])
        return "gm" if at == GM else "gr" if at is None else "gsi"
