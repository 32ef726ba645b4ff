"""Token counts by rank-synchronous array merging.

Pre-tokens that a worker hasn't met yet are held together as one ragged numpy array: their symbols end to end, and
where each sequence starts. In every round each sequence finds its lowest-rank pair and applies all of that pair's
occurrences at once; sequences without a pair leave the array, and what is left of them is counted. Applying all
occurrences of the lowest pair equals applying them one by one, since a merge never makes a pair of a lower rank
than its own; that is checked when the vocabulary is loaded.

Null text counts as empty: 0 bytes, 0 tokens. Extra columns are dropped. Repeated rows are counted each for itself.
Texts of any length are counted whole, a very long one as a slice of its own, and a very long pre-token is merged like any
other. A null id stays null. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidegraph.llm.bpe import PRETOKEN, pretokens, vocabulary
from tidegraph.llm.common import bound_batches, keeps, take_turn

_INF = np.int32(2**31 - 1)
#: Pieces, and pre-tokens, that a worker remembers at least before it starts anew.
REMEMBERED = 400_000


class Merger:
    """The vocabulary as sorted arrays."""

    def __init__(self, path: str):
        v = vocabulary(path)
        self.v, self.base = v, np.int64(len(v.token))
        pairs = np.array([(a * int(self.base) + b, rank, new) for (a, b), (rank, new) in v.merge.items()], np.int64).reshape(-1, 3)
        pairs = pairs[np.argsort(pairs[:, 0])]
        self.key, self.rank = pairs[:, 0].copy(), pairs[:, 1].astype(np.int32)
        self.made = np.zeros(1 + max(self.rank, default=0), np.int32)
        self.made[self.rank] = pairs[:, 2]
        born = {new: rank for rank, new in sorted(v.merge.values(), reverse=True)}
        if any(rank <= max(born.get(a, -1), born.get(b, -1)) for (a, b), (rank, _) in v.merge.items()):
            raise ValueError("a merge ranks before the merges that make its parts")
        self.byte_id = np.array(v.byte_id, np.int32)

    def ranks(self, ids: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Rank of the pair that starts at each symbol; last marks the symbols that end a sequence."""
        out = np.full(len(ids), _INF, np.int32)
        if len(self.key) and len(ids) > 1:
            key = ids[:-1].astype(np.int64) * self.base + ids[1:]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            out[:-1] = np.where(self.key[at] == key, self.rank[at], _INF)
        out[last] = _INF
        return out

    def count(self, words: list[bytes]) -> np.ndarray:
        """Symbols that survive in each of the words."""
        left = np.array([len(w) for w in words], np.int64)
        ids = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        who = np.flatnonzero(left)  # the sequences that are still in the array
        length = left[who]
        while len(who):
            start = np.cumsum(length) - length
            rank = self.ranks(ids, start + length - 1)
            best = np.minimum.reduceat(rank, start)
            going = best < _INF
            left[who[~going]] = length[~going]
            stays = np.repeat(going, length)
            ids, rank, who, length, best = ids[stays], rank[stays], who[going], length[going], best[going]
            if not len(who):
                break
            seq = np.repeat(np.arange(len(who)), length)
            hit = np.flatnonzero(rank == best[seq])
            # in a run of equal symbols the pairs overlap: every second one of adjacent hits is applied
            fresh = np.ones(len(hit), bool)
            fresh[1:] = hit[1:] != hit[:-1] + 1
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            ids[hit] = self.made[rank[hit]]
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            ids = ids[keep]
            length = length - np.bincount(seq[hit], minlength=len(who))
        return left


class Counts:
    """Counts tokens of slices of texts; remembers words, and pieces between single spaces (None: white space meets the space)."""

    def __init__(self, path: str):
        self.m = Merger(path)
        self.piece: dict[str, int | None] = {}
        self.word: dict[str, int] = {}

    def of(self, texts: list[str]) -> list[int]:
        for store in (self.piece, self.word):
            if len(store) > REMEMBERED:
                store.clear()
        total, plain = [0] * len(texts), []
        for i, text in enumerate(texts):
            for k, segment in enumerate(self.m.v.segments(text)):
                if k % 2:
                    total[i] += 1
                elif segment:
                    plain.append((i, segment, segment.split(" ")))
        fresh = set().union(*(pieces[1:] for _, _, pieces in plain)).difference(self.piece)
        split = {p: pretokens(p) for p in fresh if p and not p[0].isspace() and not p[-1].isspace()}
        self.piece.update(dict.fromkeys(fresh))
        self._learn(split.values())
        self.piece.update((p, sum(map(self.word.__getitem__, words))) for p, words in split.items())
        rest: list[tuple[int, list[str]]] = []
        for i, segment, pieces in plain:
            head, found = pieces[0], list(map(self.piece.__getitem__, pieces[1:]))
            if None in found or head[-1:].isspace() or not head and found:
                rest.append((i, PRETOKEN.findall(segment)))
            else:
                total[i] += sum(found)
                rest.append((i, PRETOKEN.findall(head)))
        self._learn(words for _, words in rest)
        for i, words in rest:
            total[i] += sum(map(self.word.__getitem__, words))
        return total

    def _learn(self, words: Iterable[list[str]]) -> None:
        """Merge, as one ragged array, the words that aren't known."""
        fresh = list(set().union(*words).difference(self.word))
        for at in range(0, len(fresh), 50_000):
            part = fresh[at : at + 50_000]
            self.word.update(zip(part, self.m.count([w.encode() for w in part]).tolist(), strict=True))


@lru_cache(maxsize=2)
def counts(path: str) -> Counts:
    return Counts(path)


keeps("token_counts", counts.cache_clear)


def token_counts(df: DataFrame, path: str, *, limit: int, id_col: str = "doc_id", text_col: str = "text", slice_chars: int = 2_000_000) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row. Texts are merged in slices of a batch of about slice_chars."""
    bound_batches(df.sparkSession)
    source = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))
    out = T.StructType([T.StructField(id_col, source.schema["id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("token_counts")
        c = counts(path)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            n, slice_, size = [], [], 0
            for t in texts:
                slice_.append(t)
                size += len(t)
                if size >= slice_chars:
                    n += c.of(slice_)
                    slice_, size = [], 0
            n += c.of(slice_)
            n_bytes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return source.mapInArrow(run, out)
