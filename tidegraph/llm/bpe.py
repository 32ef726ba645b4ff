"""Byte-level BPE encoding and decoding by a contiguous rank array.

A short word is held as two plain lists: the part boundaries and, beside each boundary, the rank of the pair that
starts there. The minimum is found by scanning, its inner boundary is deleted, and the two neighbouring ranks are
looked up anew. Words over ``SHORT`` bytes keep the same arrays but find the minimum through a heap, since scanning
would take time quadratic in the word. Words repeat, so each worker remembers what it has encoded, up to a bound.

Input: any table with an id and a text column; other columns are dropped, so their names can't clash. Null text
counts as empty: no ids, and decoding gives "". Repeated rows are encoded each for itself. Strings of added tokens
inside a text become their own ids, as the tokenizers library does by default. Texts of any length are encoded whole. An
empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import json
import re
import string
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidegraph.llm.common import bound_batches, keeps, take_turn

#: Fixed value: the public pre-token pattern of byte-level BPE, white space being Unicode's White_Space.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: A single space between two characters that are no white space: a pre-token always starts there.
_SEAM = re.compile(r"(?<=\S) (?=\S)")
#: Bytes up to which the minimum is found by scanning.
SHORT = 96
#: Remembered words, and the longest that is remembered.
REMEMBERED, LONGEST_REMEMBERED = 250_000, 32
_NONE = 1 << 60


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in for each byte value in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """The tables of a byte-level BPE tokenizer file: byte ids, merge ranks and token bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, to_char = spec["model"], byte_alphabet()
        from_char = {c: b for b, c in to_char.items()}
        ids: dict[str, int] = model["vocab"]
        self.byte_id = [ids[to_char[b]] for b in range(256)]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merge.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        self.rank_of = {a << 32 | b: rank for (a, b), (rank, _) in self.merge.items()}.get
        self.made = {rank: new for rank, new in self.merge.values()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.token: list[bytes] = [b""] * (1 + max(chain(ids.values(), self.added.values())))
        for piece, i in ids.items():
            self.token[i] = bytes(from_char[c] for c in piece)
        for piece, i in self.added.items():
            self.token[i] = piece.encode()
        self._added_split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def segments(self, text: str) -> list[str]:
        """text cut at added tokens; every second piece is one of them."""
        return self._added_split.split(text) if self._added_split else [text]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_word(word: bytes, v: Vocabulary) -> list[int]:
    """Ids of one pre-token."""
    if len(word) > SHORT:
        return _encode_long(word, v)
    ids, rank_of, made = v.byte_id, v.rank_of, v.made
    part = [ids[b] for b in word]
    rank = [rank_of(a << 32 | b, _NONE) for a, b in zip(part, part[1:], strict=False)]
    while rank:
        low = min(rank)
        if low == _NONE:
            break
        i = rank.index(low)
        part[i] = new = made[low]
        del part[i + 1], rank[i]
        if i < len(rank):
            rank[i] = rank_of(new << 32 | part[i + 1], _NONE)
        if i:
            rank[i - 1] = rank_of(part[i - 1] << 32 | new, _NONE)
    return part


def _encode_long(word: bytes, v: Vocabulary) -> list[int]:
    """As encode_word, with a heap over the ranks and links between the live boundaries."""
    part = [v.byte_id[b] for b in word]
    n, merge = len(part), v.merge
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(m[0], i, m[1]) for i in range(n - 1) if (m := merge.get((part[i], part[i + 1])))]
    heapq.heapify(heap)
    while heap:
        rank, i, new = heapq.heappop(heap)
        j = after[i]
        if part[i] < 0 or j >= n or merge.get((part[i], part[j]), (-1, -1)) != (rank, new):
            continue
        part[i], part[j] = new, -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if m := merge.get((new, part[k])):
                heapq.heappush(heap, (m[0], i, m[1]))
        if (h := before[i]) >= 0 and (m := merge.get((part[h], new))):
            heapq.heappush(heap, (m[0], h, m[1]))
    return [x for x in part if x >= 0]


def pretokens(piece: str) -> list[str]:
    """Pre-tokens of a space and a piece that white space neither starts nor ends; letters with ASCII punctuation behind them need no pattern."""
    if piece.isalpha():
        return [" " + piece]
    core = piece.rstrip(string.punctuation)
    return [" " + core, piece[len(core) :]] if core.isalpha() else PRETOKEN.findall(" " + piece)


class _Pieces(dict):
    """What stands between two seams, with the space before it, to the bytes of its ids as int32; None where the space isn't a seam, as white space meets it."""

    def __init__(self, v: Vocabulary):
        super().__init__()
        self.v, self.words = v, {}

    def __missing__(self, piece: str) -> bytes | None:
        out = self.join(pretokens(piece)) if piece and not piece[0].isspace() and not piece[-1].isspace() else None
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = out
        return out

    def whole(self, text: str) -> bytes:
        """Ids of a text that starts and ends where pre-tokens do."""
        return self.join(PRETOKEN.findall(text))

    def join(self, pre: list[str]) -> bytes:
        out, words = [], self.words
        for w in pre:
            ids = words.get(w)
            if ids is None:
                ids = array("i", encode_word(w.encode(), self.v)).tobytes()
                if len(w) <= LONGEST_REMEMBERED:
                    if len(words) >= REMEMBERED:
                        words.clear()
                    words[w] = ids
            out.append(ids)
        return b"".join(out)


class Encoder:
    """Texts to ids and back; holds the words that it remembers."""

    def __init__(self, path: str):
        self.v = vocabulary(path)
        self.pieces = _Pieces(self.v)

    def encode(self, text: str) -> np.ndarray:
        parts: list[bytes] = []
        for k, segment in enumerate(self.v.segments(text)):
            if k % 2:
                parts.append(array("i", [self.v.added[segment]]).tobytes())
                continue
            head, *rest = segment.split(" ")
            found = list(map(self.pieces.__getitem__, rest))
            if None in found or head[-1:].isspace() or not head and rest:
                head, *rest = _SEAM.split(segment)
                found = [self.pieces.whole(" " + x) for x in rest]
            parts.append(self.pieces.whole(head))
            parts += found
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids: list[int]) -> str:
        """Unknown ids give nothing; bytes that aren't UTF-8 become U+FFFD."""
        token, n = self.v.token, len(self.v.token)
        return b"".join([token[i] for i in ids if i is not None and 0 <= i < n]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


keeps("bpe", encoder.cache_clear)


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(found) + 1, np.int32)
    np.cumsum([len(x) for x in found], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.empty(0, np.int32)))


def encode(df: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, token_ids array<int>) of every row."""
    bound_batches(df.sparkSession)
    source = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))
    out = T.StructType([T.StructField(id_col, source.schema["id"].dataType), T.StructField("token_ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("bpe")
        e = encoder(path)
        for batch in batches:
            found = [e.encode(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(found)], [id_col, "token_ids"])

    return source.mapInArrow(run, out)


def encode_and_decode(df: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, token_ids, decoded) of every row, as decode(encode(...)), in one pass."""
    bound_batches(df.sparkSession)
    source = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))
    out = T.StructType([T.StructField(id_col, source.schema["id"].dataType), T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("bpe")
        e = encoder(path)
        for batch in batches:
            found = [e.encode(x.as_py() or "") for x in batch.column(1)]
            texts = pa.array([e.decode(x.tolist()) for x in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(found), texts], [id_col, "token_ids", "decoded"])

    return source.mapInArrow(run, out)


def decode(df: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """(id, token_ids, decoded string) of every row; null ids count as none."""
    bound_batches(df.sparkSession)
    source = df.select(df[id_col].alias("id"), df[ids_col].cast("array<int>").alias("ids"))
    out = T.StructType([T.StructField(id_col, source.schema["id"].dataType), T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("bpe")
        e = encoder(path)
        for batch in batches:
            lists = batch.column(1)
            values, offsets, valid = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy(), lists.is_valid().to_numpy(zero_copy_only=False)
            texts = [e.decode(values[a:b].tolist()) if ok else "" for a, b, ok in zip(offsets, offsets[1:], valid, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(texts, pa.string())], [id_col, "token_ids", "decoded"])

    return source.mapInArrow(run, out)
