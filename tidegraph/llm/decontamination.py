"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items, normalised to words, form one automaton. A document's words are streamed through it; after each word the
automaton knows the longest run of words, ending there, that occurs in some item. Where that run is at least a window
long (13 words, or a whole item that is shorter), the window's words are hit. Spans of hits leave the text, or the
document leaves the table, by limits on length and coverage.

Words that no item has, and word pairs that no item has, reset the automaton; numpy finds the stretches between them
first, and only stretches that could hold a window are streamed.

The items are written to the shared folder in blocks of about ``BLOCK_BYTES`` of text, each with the hashes of its
windows, and never meet as a whole. One stage goes over the documents. A bit filter of the items' word pairs and
windows, of a size that is bounded, picks the documents that may hold a window, and lets the others go on. A task holds
what was picked up to ``HELD_BYTES``; then it goes through the blocks once: the hashes of a block's windows say which of
the held documents may have one, and only if there is any is the block's automaton built, which scans these documents.

Texts of any length are whole: a text is split into words once to be filtered, and again for each block that may match
it, one text at a time; a text that is longer than a batch or than ``HELD_BYTES`` is held alone.

Null or wordless texts have no words, no hits and no items, and aren't contaminated. Items that are null or wordless
have no window. Items with a null id make hits but aren't listed. Repeated documents are judged each for itself,
repeated item ids count once. Empty tables are allowed. Columns that ``find`` doesn't return are dropped;
``decontaminate`` returns the columns it was given, whatever their names.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.llm.common import WordHashes, bound_batches, filesystem, fresh_path, keeps, mix, take_turn, utf8

BLOCK_BYTES = 1 << 20
#: Bytes of picked documents that a task holds before it goes through the blocks.
HELD_BYTES = 32 << 20
#: Bits of the filter, at most, and bits for each word pair or window.
FILTER_BITS, BITS_EACH = 1 << 28, 16
#: A-Z to a-z; digits, a-z and bytes from 0x80 on stay; all else to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class SuffixAutomaton:
    """Of several sequences of numbers; knows for each window which items have it."""

    def __init__(self, window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: list[set[int]] = [set()]
        self.short: list[list[tuple[int, set[int]]]] = [[]]

    def _state(self, length: int, link: int, out: dict[int, int]) -> int:
        self.next.append(out)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _extend(self, last: int, word: int) -> int:
        """The state of the prefix at last and one word more."""
        if (q := self.next[last].get(word)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def _split(self, p: int, word: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def build(self, sequences: list[list[int]]) -> SuffixAutomaton:
        for s in sequences:
            last = 0
            for w in s:
                last = self._extend(last, w)
        n = len(self.length)
        self.items, self.short = [set() for _ in range(n)], [[] for _ in range(n)]
        whole: list[set[int]] = [set() for _ in range(n)]
        for i, s in enumerate(sequences):
            state = 0
            for k, w in enumerate(s, 1):
                state = self.next[state][w]
                if k >= self.window:
                    self.items[self.anchor(state)].add(i)
            if 0 < len(s) < self.window:
                whole[state].add((i, len(s)))
        for state in sorted(range(1, n), key=self.length.__getitem__):
            self.short[state] = self.short[self.link[state]] + [(k, {i}) for i, k in sorted(whole[state])]
        return self

    def anchor(self, state: int) -> int:
        """The state of the last window words of a match at least so long."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def scan(self, sequence: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Windows as (start, end), in order of their ends, and the items that have them."""
        state = matched = 0
        spans, items = [], set()
        for i, w in enumerate(sequence, 1):
            while state and w not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            to = self.next[state].get(w)
            if to is None:
                matched = 0
                continue
            state, matched = to, matched + 1
            longest = 0
            if matched >= self.window:
                longest = self.window
                items |= self.items[self.anchor(state)]
            for k, who in self.short[state]:
                if k <= matched:
                    longest = max(longest, k)
                    items |= who
            if longest:
                spans.append((i - longest, i))
        return spans, items


class Matcher:
    """The automaton of one block of items, with what decides quickly that a stretch of words can't hold a window."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        split = [(i, w) for i, text in items if (w := words_of(text))]
        self.ids = [i for i, _ in split]
        self.word: dict[bytes, int] = {}
        coded = [[self.word.setdefault(x, len(self.word)) for x in w] for _, w in split]
        self.auto = SuffixAutomaton(window).build(coded)
        self.least = min((min(window, len(s)) for s in coded), default=0)
        self.pairs = np.zeros(1 << 22, bool)
        for s in coded:
            a = np.array(s, np.int64)
            self.pairs[self._slot(a[:-1], a[1:])] = True

    @staticmethod
    def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a * 0x9E3779B1) ^ (b * 0x85EBCA77 + (a >> 7))) & ((1 << 22) - 1)

    def of(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Disjoint spans of hit words, and the ids of the items."""
        n = len(words)
        if not self.least or n < self.least:
            return [], set()
        coded = np.fromiter(map(self.word.get, words, repeat(-1)), np.int64, n)
        ok = coded >= 0
        if self.least > 1:
            ok = ok[:-1] & ok[1:] & self.pairs[self._slot(coded[:-1], coded[1:])]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], ok, [False])).astype(np.int8)))
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        wide = int(self.least > 1)
        for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if hi + wide - lo >= self.least:
                found, who = self.auto.scan(coded[lo : hi + wide].tolist())
                spans += [(a + lo, b + lo) for a, b in found]
                items |= who
        return merged(spans), {self.ids[i] for i in items if self.ids[i] is not None}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_words = WordHashes()
_matchers: dict[str, Matcher] = {}
_filters: dict[str, np.ndarray] = {}


def _forget() -> None:
    for kept in (_words, _matchers, _filters):
        kept.clear()


keeps("decontamination", _forget)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def run_hashes(words: np.ndarray, widths: set[int]) -> dict[int, np.ndarray]:
    """64-bit hashes of all runs of so many of the word hashes."""
    out, n = {}, len(words)
    h = words
    with np.errstate(over="ignore"):
        for j in range(1, min(max(widths, default=0), n) + 1):
            if j > 1:
                h = mix(h[: n - j + 1] * _ODD + words[j - 1 :])
            if j in widths:
                out[j] = mix(h ^ np.uint64(j))
    return out


@dataclass
class Blocks:
    """Where the items lie, and what is known of all of them."""

    folder: str
    window: int
    n: int
    widths: set[int]  # word counts of windows
    bits: Any = None  # the filter, broadcast
    size: int = 0

    def passing(self, words: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Hashes of the windows of a text that the filter lets through."""
        least = min(self.widths, default=0)
        if not least or len(words) < least:
            return np.empty(0, np.uint64)

        def there(h: np.ndarray) -> np.ndarray:
            at = h & np.uint64(self.size - 1)
            bit = known[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)
            return (bit & 1).astype(bool)

        if least == 1:
            edge = np.array([0, len(words)])
        else:
            ok = there(run_hashes(words, {2})[2])
            edge = np.flatnonzero(np.diff(np.concatenate(([False], ok, [False])).astype(np.int8)))
            edge[1::2] += 1
        found = []
        for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if hi - lo >= least:
                found += [h[there(h)] for h in run_hashes(words[lo:hi], self.widths).values()]
        return np.concatenate(found) if found else np.empty(0, np.uint64)

    def read(self, k: int, columns: list[str]) -> pa.Table:
        files, path = filesystem(f"{self.folder}/block={k}")
        names = sorted(f.path for f in files.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.path.endswith(".parquet"))
        return pa.concat_tables([pq.read_table(files.open_input_file(n), columns=columns) for n in names]) if names else pa.table({c: [] for c in columns})

    def windows(self, k: int) -> np.ndarray:
        got = self.read(k, ["windows"]).column(0)
        return np.unique(np.concatenate([c.values.to_numpy() for c in got.chunks]).view(np.uint64)) if len(got) else np.empty(0, np.uint64)

    def matcher(self, k: int) -> Matcher:
        """One automaton is kept a worker, that of the block used last."""
        key = f"{self.folder}/{k}"
        if key not in _matchers:
            _matchers.clear()
            t = self.read(k, ["item", "text"])
            _matchers[key] = Matcher(list(zip(t.column(0).to_pylist(), utf8(t.column(1)), strict=True)), self.window)
        return _matchers[key]


def write_blocks(benchmark: DataFrame, window: int, item_col: str, text_col: str, block_bytes: int) -> Blocks:
    """Write the items (item, text, windows) to a folder by block; only sums and the filter reach the driver."""
    spark = benchmark.sparkSession
    items = benchmark.select(benchmark[item_col].cast("string").alias("item"), F.coalesce(benchmark[text_col].cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("decontamination")
        for batch in batches:
            runs, pairs, widths = [], [], []
            for text in utf8(batch.column(1).cast(pa.string())):
                words = _words.of(words_of(text))
                width = min(window, len(words))
                runs.append(np.unique(run_hashes(words, {width})[width]).view(np.int64) if width else np.empty(0, np.int64))
                pairs.append(np.unique(run_hashes(words, {2})[2]).view(np.int64) if len(words) > 1 else np.empty(0, np.int64))
                widths.append(width)
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate(x) if x else [], pa.int64())) for x in (runs, pairs)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists, pa.array(widths, pa.int32())], ["item", "text", "block", "windows", "pairs", "width"])

    placed = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n)).cast("int"))
    found = placed.repartition(min(n, 10_000), "block").mapInArrow(run, "item string, text string, block int, windows array<long>, pairs array<long>, width int")
    folder = fresh_path(spark, "items")
    found.write.partitionBy("block").parquet(folder)
    rows = spark.read.schema(found.schema).parquet(folder)
    sums = rows.agg(F.sum(F.size("windows") + F.size("pairs")).alias("n"), F.collect_set("width").alias("widths")).first()  # window numbers at most
    size = min(FILTER_BITS, max(1 << 18, 1 << (BITS_EACH * (sums.n or 0)).bit_length()))
    slot = F.col("h").bitwiseAND(F.lit(size - 1)) + 1
    parts = rows.select(F.explode(F.concat("windows", "pairs")).alias("h")).select(slot.alias("v")).groupBy(F.bitmap_bucket_number("v").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("bits"))
    bits = np.zeros((-(-size // 32768), 4096), np.uint8)
    for r in parts.toLocalIterator():  # size bits
        bits[r.bucket - 1] = np.frombuffer(bytes(r.bits), np.uint8)
    return Blocks(folder, window, n, {w for w in sums.widths if w}, spark.sparkContext.broadcast(bits.reshape(-1)), size)


def _annotate(df: DataFrame, benchmark: DataFrame, window: int, text_col: str, item_col: str, block_bytes: int, names: tuple[str, str, str]) -> DataFrame:
    """df with the number of words, the hit spans as one flat array (start, end, start, end, ...), and the items' ids."""
    bound_batches(df.sparkSession)
    count, spans, items = names
    plain = df.schema
    full = T.StructType([*plain.fields, T.StructField(count, T.LongType()), T.StructField(spans, T.ArrayType(T.IntegerType())), T.StructField(items, T.ArrayType(T.StringType()))])
    where = plain.fieldNames().index(text_col)
    blocks = write_blocks(benchmark, window, item_col, "text", block_bytes)

    def annotated(batch: pa.RecordBatch, n_words: list[int], hits: list[tuple[list, set]]) -> pa.RecordBatch:
        flat = [[x for s in spans_ for x in s] for spans_, _ in hits]
        more = [pa.array(n_words, pa.int64()), pa.array(flat, pa.list_(pa.int32())), pa.array([sorted(who) for _, who in hits], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays([*batch.columns, *more], full.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("decontamination")
        known, only = blocks.bits.value, blocks.windows(0) if blocks.n == 1 else None
        held: list[tuple[pa.RecordBatch, list[int], list[np.ndarray]]] = []

        def settled() -> Iterator[pa.RecordBatch]:
            """The held documents with what all blocks say of them."""
            texts = [t for batch, *_ in held for t in utf8(batch.column(where).cast(pa.string()))]
            passing = [h for *_, hashes in held for h in hashes]
            flat, of = np.concatenate(passing), np.repeat(np.arange(len(passing)), [len(h) for h in passing])
            hits: list[tuple[list, set]] = [([], set()) for _ in texts]
            for k in range(blocks.n):
                windows = only if only is not None else blocks.windows(k)
                if len(windows):
                    at = np.minimum(np.searchsorted(windows, flat), len(windows) - 1)
                    for i in np.unique(of[windows[at] == flat]).tolist():
                        found, ids = blocks.matcher(k).of(words_of(texts[i]))
                        hits[i] = merged(hits[i][0] + found), hits[i][1] | ids
            lo = 0
            for batch, n_words, _ in held:
                yield annotated(batch, n_words, hits[lo : lo + batch.num_rows])
                lo += batch.num_rows
            held.clear()

        for batch in batches:
            n_words, picked, hashes = [], [], []
            for i, text in enumerate(utf8(batch.column(where).cast(pa.string()))):
                words = words_of(text)
                n_words.append(len(words))
                if len(passing := blocks.passing(_words.of(words), known)):
                    picked.append(i)
                    hashes.append(np.unique(passing))
            rest = sorted(set(range(len(n_words))) - set(picked))
            if rest:
                yield annotated(batch.take(pa.array(rest)), [n_words[i] for i in rest], [([], set())] * len(rest))
            if picked:
                held.append((batch.take(pa.array(picked)), [n_words[i] for i in picked], hashes))
                if sum(b.nbytes for b, *_ in held) >= HELD_BYTES:
                    yield from settled()
        if held:
            yield from settled()

    return df.mapInArrow(run, full)


def _hit(spans: str) -> F.Column:
    """Hit words of a flat array of spans: ends less starts."""
    return F.aggregate(F.transform(F.col(spans), lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)


def contaminated(n_hit: F.Column, n_words: F.Column, coverage: int) -> F.Column:
    """Hits make up at least one word in coverage."""
    return (n_hit > 0) & (coverage * n_hit >= n_words)


def find(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, coverage: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_words, n_hit, spans, items, contaminated) of every document."""
    source = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    found = _annotate(source, benchmark, window, "text", item_col, block_bytes, ("n_words", "spans", "items"))
    n_hit = _hit("spans")
    return found.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), "spans", "items", contaminated(n_hit, F.col("n_words"), coverage).alias("contaminated"))


def without_spans(text: bytes, spans: list[int]) -> bytes:
    """text without the words of the spans and what stands between them."""
    at = [m.span() for m in _WORD.finditer(text.translate(_FOLD))]
    out, last = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, text[last:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, coverage: int = 20, remove: str = "document", least_span: int = 13, text_col: str = "text", item_col: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without contamination.

    remove="document": contaminated documents go, all others stay as they are. remove="spans": contaminated documents
    lose all hit spans, others those of at least least_span words.
    """
    tag = uuid.uuid4().hex[:8]
    names = (f"n_words_{tag}", f"spans_{tag}", f"items_{tag}")
    found = _annotate(docs, benchmark, window, text_col, item_col, block_bytes, names)
    bad = contaminated(_hit(names[1]), F.col(names[0]), coverage)
    if remove == "document":
        return found.filter(~bad).select(docs.columns)
    if remove != "spans":
        raise ValueError(f"remove: {remove}")
    chosen = found.withColumn(names[0], F.when(bad, F.lit(1)).otherwise(F.lit(least_span)).cast("long"))
    where, schema = docs.columns.index(text_col), docs.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least, spans = batch.column(len(schema)).to_pylist(), batch.column(len(schema) + 1).to_pylist()
            texts = []
            for text, k, flat in zip(utf8(batch.column(where).cast(pa.string())), least, spans, strict=True):
                flat = [x for a, b in zip(flat[::2], flat[1::2], strict=True) if b - a >= k for x in (a, b)]
                texts.append(without_spans(text, flat).decode() if flat else text.decode() if text is not None else None)
            columns = list(batch.columns[: len(schema)])
            columns[where] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    return chosen.mapInArrow(cut, schema)
