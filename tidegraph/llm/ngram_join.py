"""N-gram Jaccard join with adaptive multi-match prefixes; its result is the groups that the links make.

Documents become sets of hashed k-word shingles. A fixed-size sketch counts every shingle of every document, and gives
the order of tokens, rare ones first. Similar sets share at least l tokens within their l-prefixes (the first
n - ceil(t n) + l tokens). Each document takes the l whose estimated cost is least: a longer prefix lists it more often,
but asks more matches of a candidate. Two documents are candidates if they share min(l, l') tokens of their prefixes.

Links aren't listed pair by pair, since copies would make them quadratic:
 1. documents with equal sets are one node, known by its smallest id. Each has a parity signature: bits that say
    whether an odd number of its tokens fell there. Two signatures differ in no more bits than the sets in tokens, so
    they rule out links for certain, and with few doubtful cases;
 2. every node is held against one pivot, the smallest node of most of its prefix tokens' lists, if they share enough;
 3. lists whose nodes are in one component already need no more. Of the others, those with equal nodes count once, and
    in each, all pairs of nodes of different components are held against each other, inside one task: sizes, signatures,
    and the number of shared prefix tokens. It returns a spanning forest of the pairs that pass. A list with many nodes
    is cut into blocks, and pairs of blocks are tasks;
 4. the forest's pairs are verified on whole sets. Where one fails, the nodes of its component are compared again, with
    whole sets, in all the lists that they share.
No list is dropped or cut short, however common its token. The sketch says which tokens are common: their rows are dealt
over several tasks wherever lists are joined. Hubs, roots and groups of equal sets are dealt likewise.

Rows with null, empty or wordless text have no shingles and are linked with nothing. Rows with a null id are returned
with a null component and take no part. Rows with one id and several sets are several nodes, which count as linked.
Shingles are compared by 64-bit hashes, sets by 128-bit ones. Texts of any length are whole. Extra columns are dropped.
An empty table gives an empty table.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.llm.common import WordHashes, bound_batches, keeps, mix, release, salted, saved, scratch, shingle_hashes, take_turn, utf8
from tidegraph.llm.components import components, roots

CELLS, CHUNKS = 1 << 20, 64
#: Longest l; relative cost of verifying a candidate against listing a token once.
MOST_MATCHES, VERIFY_COST = 4, 4.0
#: Nodes, bytes of their signatures and short hashes, and tokens of one block of a list that is compared inside a task.
BLOCK_NODES, BLOCK_BYTES, BLOCK_TOKENS = 2048, 16 << 20, 1_000_000
#: Tokens of one block of a component whose links are counted.
LINK_TOKENS = 300_000
#: Bits of the smallest and the largest signature; leaves of one hub that a task verifies.
LEAST_BITS, MOST_BITS, HUB_LEAVES = 256, 1 << 20, 1000
#: Most bits of the filter for the ids whose sets are needed.
FILTER_BITS = 1 << 27
#: Rows of a token from which its list is dealt over tasks, and over how many at most.
HOT_ROWS, MOST_SALTS = 1000, 256
#: Tokens that a set counts for at least, in blocks whose links are counted; tokens that are counted at once.
LEAST_WEIGHT, COLUMNS = 150, 2048

_words = WordHashes()
keeps("ngram_join", _words.clear)


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    return shingle_hashes(_words.of(text.lower().split()), k) if text else np.empty(0, np.uint64)


def _cell(tokens: np.ndarray) -> np.ndarray:
    return (mix(tokens) >> np.uint64(44)).astype(np.int64)


def _summed(blobs: Iterator[bytes]) -> bytes:
    total = np.zeros(CELLS // CHUNKS, np.int64)
    for b in blobs:
        total += np.frombuffer(zlib.decompress(b), np.int64)
    return zlib.compress(total.tobytes(), 1)


def token_sketch(docs: DataFrame, k: int) -> np.ndarray:
    """Occurrences of all shingle hashes of all documents (id, text), by cell; of a fixed size, whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("ngram_join")
        cells = np.zeros(CELLS, np.int64)
        for batch in batches:
            sets = [shingle_set(t, k) for t in utf8(batch.column(1))]
            if sets:
                cells += np.bincount(_cell(np.concatenate(sets)), minlength=CELLS)
        parts = [zlib.compress(x.tobytes(), 1) for x in cells.reshape(CHUNKS, -1)]
        salt = TaskContext.get().partitionId() % 256
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([salt] * CHUNKS, pa.int32()), pa.array(parts, pa.binary())], ["chunk", "salt", "counts"])

    def add(group: Iterator[pa.RecordBatch]) -> pa.Table:
        return pa.table({"chunk": group.column("chunk").slice(0, 1), "salt": group.column("salt").slice(0, 1), "counts": pa.array([_summed(x.as_py() for x in group.column("counts"))], pa.binary())})

    kind = "chunk int, salt int, counts binary"
    partial = docs.mapInArrow(count, kind).groupBy("chunk", "salt").applyInArrow(add, kind)
    rows = partial.groupBy("chunk").applyInArrow(add, kind).collect()  # CHUNKS rows
    out = np.zeros((CHUNKS, CELLS // CHUNKS), np.int64)
    for r in rows:
        out[r.chunk] = np.frombuffer(zlib.decompress(bytes(r.counts)), np.int64)
    return out.reshape(-1)


def adaptive_prefix(tokens: np.ndarray, cells: np.ndarray, noise: float, num: int, den: int) -> tuple[int, np.ndarray]:
    """l and the l-prefix of a set, rare tokens first."""
    n = len(tokens)
    if n == 0:
        return 1, tokens
    seen = cells[_cell(tokens)]
    order = np.lexsort((tokens, seen))
    base = n - -(-num * n // den) + 1  # tokens of the 1-prefix
    listed = np.cumsum(np.maximum(seen[order] - noise, 0.0))
    best, least = 1, np.inf
    for l in range(1, min(MOST_MATCHES, n - base + 1) + 1):
        entries = listed[base + l - 2]
        cost = entries + VERIFY_COST * entries / l + l
        if cost < least:
            best, least = l, cost
    return best, tokens[order[: base + best - 1]]


def signature(tokens: np.ndarray) -> np.ndarray:
    """Parity bits of a set, as uint64 words: one bit a token or more, a power of two of them."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << max(len(tokens) - 1, 0).bit_length()))
    odd = np.bincount((mix(~tokens) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """Signatures (in the last axis) of fewer bits, as if they had been made so."""
    while words.shape[-1] > size:
        half = words.shape[-1] // 2
        words = words[..., :half] ^ words[..., half:]
    return words


def _may_link(n: np.ndarray, other: np.ndarray | int, differ: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of n and other tokens that differ in so many at least can have the similarity."""
    return den * (n + other - differ) >= num * (n + other + differ)


def _prefixes(docs: DataFrame, k: int, num: int, den: int, sketch: np.ndarray) -> DataFrame:
    """(id, n, d1, d2, matches, prefix, salts, few, sign) of every row (id, text). salts: over how many tasks each prefix token's list is dealt; few: 16 bits of each prefix token."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)  # CELLS numbers
    noise = float(sketch.mean() + 3 * np.sqrt(sketch.mean()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("ngram_join")
        cells = shared.value
        for batch in batches:
            n, d1, d2, matches, prefix, ends, few, signs = [], [], [], [], [], [0], [], []
            for text in utf8(batch.column(1)):
                tokens = shingle_set(text, k)
                digest = xxhash.xxh3_128_intdigest(tokens.tobytes())
                l, first = adaptive_prefix(tokens, cells, noise, num, den)
                n.append(len(tokens))
                d1.append((digest >> 64) - (1 << 63))
                d2.append((digest & ((1 << 64) - 1)) - (1 << 63))
                matches.append(l)
                prefix.append(first)
                ends.append(ends[-1] + len(first))
                few.append(np.sort((mix(first) >> np.uint64(48)).astype(np.uint16)).tobytes())
                signs.append(signature(tokens).tobytes())
            flat = np.concatenate(prefix) if prefix else np.empty(0, np.uint64)
            salts = np.clip(np.ceil((cells[_cell(flat)] - noise) / max(HOT_ROWS, noise)), 1, MOST_SALTS).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x)) for x in (flat.view(np.int64), salts)]
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(matches, pa.int32()), *lists, pa.array(few, pa.binary()), pa.array(signs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "d1", "d2", "matches", "prefix", "salts", "few", "sign"])

    return docs.mapInArrow(run, "id long, n long, d1 long, d2 long, matches int, prefix array<long>, salts array<int>, few binary, sign binary")


def _bit_filter(ids: DataFrame, name: str = "id") -> tuple[int, F.Column, DataFrame]:
    """For ids (id, distinct): a number of bits, which follows theirs up to a bound; the bit of a column of that name; and (bucket, bits) with the ids' bits set."""
    bits = min(FILTER_BITS, max(1 << 16, 1 << (16 * ids.count()).bit_length()))
    slot = F.pmod(F.xxhash64(F.col(name)), F.lit(bits))
    marked = ids.select((slot + 1).alias("v")).groupBy(F.bitmap_bucket_number("v").alias("bucket"))
    return bits, slot, marked.agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("bits"))


def _without(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """df without the rows whose id is in ids (distinct). A bit filter of bounded size says of most rows that they stay; only the others are joined, so most texts aren't shuffled."""
    _, slot, parts = _bit_filter(ids, id_col)
    tag = f"_{uuid.uuid4().hex[:8]}"
    at = F.bitmap_bit_position(slot + 1)
    known = parts.select(F.col("bucket").alias(f"bucket{tag}"), F.col("bits").alias(f"bits{tag}"))
    flagged = df.withColumn(f"bucket{tag}", F.bitmap_bucket_number(slot + 1)).join(F.broadcast(known), f"bucket{tag}", "left")
    byte = F.conv(F.hex(F.substring(F.col(f"bits{tag}"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    maybe = F.coalesce(F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1, F.lit(False))
    flagged = flagged.withColumn(f"maybe{tag}", maybe)
    stay = flagged.filter(~F.col(f"maybe{tag}")).select(df.columns)
    return stay.unionByName(flagged.filter(f"maybe{tag}").select(df.columns).join(ids, id_col, "left_anti").select(df.columns))


def _sets_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, tokens) of the documents (id, text) whose id is in ids (id, distinct), and of few others: a bit filter spares the rest."""
    bits, slot, parts = _bit_filter(ids)
    parts = parts.collect()  # FILTER_BITS at most
    bitmap = np.zeros((-(-bits // 32768), 4096), np.uint8)
    for r in parts:
        bitmap[r.bucket - 1] = np.frombuffer(bytes(r.bits), np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap.reshape(-1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("ngram_join")
        known = shared.value
        for batch in batches:
            at = batch.column(2).to_numpy()
            some = batch.filter(pa.array((known[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            sets = [shingle_set(t, k) for t in utf8(some.column(1))]
            ends = np.zeros(len(sets) + 1, np.int32)
            np.cumsum([len(s) for s in sets], out=ends[1:])
            flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["id", "tokens"])

    return docs.filter("id is not null").select("id", "text", slot.alias("slot")).mapInArrow(run, "id long, tokens array<long>")


def _forest(ids: list[int], group: list[int], passing: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links between groups, from all pairs of different groups; pairs that are connected by then are passed over. passing: which of the given others an item is linked with."""
    m, links = len(ids), []
    names = {g: i for i, g in enumerate(dict.fromkeys(group))}
    root = np.array([names[g] for g in group])
    if len(names) < 2:
        return links
    biggest = int(np.bincount(root).argmax())  # its members are met from the other side
    for i in np.flatnonzero(root != biggest).tolist() if m > 2 else [0]:
        others = np.flatnonzero(root != root[i])
        for j in others[passing(i, others)].tolist() if len(others) else []:
            if root[i] != root[j]:
                links.append((ids[i], ids[j]))
                root[root == root[j]] = root[i]
    return links


def likely_links(ids: list[int], group: list[int], n: np.ndarray, signs: list[np.ndarray], matches: np.ndarray, few: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """A forest of the candidates: pairs that their sizes and signatures allow, and that share as many prefix tokens as both ask for. few: sorted short hashes of the prefixes, which never share fewer than the tokens."""
    size = np.array([len(s) for s in signs])
    row = np.zeros(len(ids), np.int64)
    table: dict[int, np.ndarray] = {}
    for w in np.unique(size).tolist():
        mine = np.flatnonzero(size == w)
        row[mine] = np.arange(len(mine))
        table[w] = np.stack([signs[i] for i in mine.tolist()])

    def passing(i: int, others: np.ndarray) -> np.ndarray:
        ok = den * np.minimum(n[others], n[i]) >= num * np.maximum(n[others], n[i])
        for w in table:
            at = np.flatnonzero(ok & (size[others] == w))
            if len(at):
                least = min(w, len(signs[i]))
                differ = np.bitwise_count(folded(table[w][row[others[at]]], least) ^ folded(signs[i], least)).sum(axis=1, dtype=np.int64)
                ok[at] = _may_link(n[others[at]], n[i], differ, num, den)
        need = np.minimum(matches[others], matches[i])
        at = np.flatnonzero(ok & (need > 1))
        if len(at):
            held = [few[j] for j in others[at].tolist()]
            ends = np.cumsum([0, *map(len, held)])
            both = np.concatenate(([0], np.cumsum(np.isin(np.concatenate(held), few[i]))))
            ok[at] = both[ends[1:]] - both[ends[:-1]] >= need[at]
        return ok

    return _forest(ids, group, passing)


def exact_links(ids: list[int], group: list[int], sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """A forest of the pairs that are linked."""
    size = np.array([len(s) for s in sets], np.int64)
    flat, who = np.concatenate(sets), np.repeat(np.arange(len(ids)), size)
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]

    def passing(i: int, others: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(flat, sets[i]), np.searchsorted(flat, sets[i], "right")
        count = hi - lo
        at = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
        shared = np.bincount(who[at], minlength=len(ids))[others]
        return den * shared >= num * (size[others] + size[i] - shared)

    return _forest(ids, group, passing)


def _slices(column: pa.Array, kind: type) -> list[np.ndarray]:
    """The values of a binary or list column as arrays of their own."""
    if pa.types.is_binary(column.type):
        return [np.frombuffer(x, kind) for x in utf8(column)]
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
    return [flat[a:b].astype(kind) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _by_list(rows: DataFrame, kernel: Callable[[list], list[tuple[int, int]]], *kinds: type) -> DataFrame:
    """(a, b) that the kernel finds among the rows of each (token, x, y, ...); the rest of a row is id, component, n, matches, and arrays of the given kinds. One group of rows is held at a time."""
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list) -> pa.RecordBatch:
            links = kernel(held) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])

        key, held = None, []
        for batch in batches:
            plain = (batch.column(c).to_pylist() for c in range(7))
            arrays = (_slices(batch.column(7 + j), kind) for j, kind in enumerate(kinds))
            for token, x, y, *rest in zip(*plain, *arrays, strict=True):
                if (token, x, y) != key:
                    if len(held) > 1:
                        yield out(held)
                    key, held = (token, x, y), []
                held.append(rest)
        yield out(held)

    assert columns[:7] == ["token", "x", "y", "id", "component", "n", "matches"], columns
    return rows.repartition("token", "x", "y").sortWithinPartitions("token", "x", "y", "id").mapInArrow(run, "a long, b long")


def _likely_kernel(num: int, den: int) -> Callable[[list], list[tuple[int, int]]]:
    def find(held: list) -> list[tuple[int, int]]:
        ids, group, n, matches, signs, few = zip(*held, strict=True)
        return likely_links(list(ids), list(group), np.array(n), list(signs), np.array(matches), list(few), num, den)

    return find


def _exact_kernel(num: int, den: int) -> Callable[[list], list[tuple[int, int]]]:
    return lambda held: exact_links([h[0] for h in held], [h[1] for h in held], [h[4] for h in held], num, den)


def _to_lists(rows: DataFrame, per_token: DataFrame) -> DataFrame:
    """rows (token, salt, ...) joined with what is known of each token (token, salts, ...), a copy for each salt."""
    return rows.join(per_token.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts"), ["token", "salt"])


def _open_lists(placed: DataFrame) -> DataFrame:
    """(token, salt, salts, id, component, biggest) of the lists (token, salt, salts, id, component, least_matches) that hold several components, one of those with equal nodes; biggest: the component that most need not meet itself."""
    mark = lambda seed: F.sum(F.xxhash64("id", F.lit(seed)) % (1 << 40))
    lists = placed.groupBy("token").agg(F.max("salts").alias("salts"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("m"), mark(1).alias("s1"), mark(2).alias("s2")).filter("lo <> hi")
    lists = saved(lists, "lists")
    once = lists.groupBy("m", "s1", "s2").agg(F.min(F.struct("token", "salts")).alias("list")).select("list.token", "list.salts")
    # a node whose open lists are fewer than any partner asks for can't be linked there
    enough = _to_lists(placed, lists.select("token", "salts")).groupBy("id").agg(F.count(F.lit(1)).alias("open"))
    rows = _to_lists(placed, once).join(enough, "id").filter("open >= least_matches")
    rows = saved(rows.select("token", "salt", "salts", "id", "component"), "open")
    sizes = rows.groupBy("token", "component").agg(F.count(F.lit(1)).alias("c"), F.max("salts").alias("salts"))
    return _to_lists(rows, sizes.groupBy("token").agg(F.max(F.struct("c", "component")).alias("top"), F.max("salts").alias("salts")).select("token", "salts", F.col("top.component").alias("biggest")))


def _in_blocks(rows: DataFrame, weight: str, most: int) -> DataFrame:
    """rows (token, salt, salts, id, component, biggest, ...) with blocks x and y: the biggest component's blocks meet the others', these also each other, so that all pairs of different components meet somewhere."""
    rows = rows.withColumn("inner", F.col("component") == F.col("biggest"))
    parts = rows.groupBy("token").agg(F.max("salts").alias("salts"), F.greatest(F.lit(1), F.ceil(F.sum(F.when(~F.col("inner"), F.col(weight))) / most)).cast("int").alias("outer_blocks"), F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col("inner"), F.col(weight))) / most)).cast("int").alias("inner_blocks"))
    rows = _to_lists(rows, parts).withColumn("block", F.pmod(F.xxhash64("id"), F.when(F.col("inner"), F.col("inner_blocks")).otherwise(F.col("outer_blocks"))).cast("int"))
    whole = (F.col("outer_blocks") == 1) & (F.col("inner_blocks") == 1)  # then all meet in one task
    outer, inner = F.sequence(F.lit(0), F.col("outer_blocks") - 1), F.sequence(-F.col("inner_blocks"), F.lit(-1))
    meets = F.when(whole, F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))).when(F.col("inner"), F.transform(outer, lambda o: F.struct((-F.col("block") - 1).alias("x"), o.alias("y")))).otherwise(
        F.concat(F.transform(inner, lambda i: F.struct(i.alias("x"), F.col("block").alias("y"))), F.transform(outer, lambda o: F.struct(F.least(o, F.col("block")).alias("x"), F.greatest(o, F.col("block")).alias("y"))))
    )
    return rows.withColumn("meet", F.explode(meets)).withColumns({"x": F.col("meet.x"), "y": F.col("meet.y")}).drop("meet", "inner", "block", "outer_blocks", "inner_blocks", "biggest")


def _star(shared: DataFrame, signs: DataFrame, num: int, den: int) -> DataFrame:
    """(id, parent): each node's pivot, if the signatures allow a link."""
    tried = shared.filter("id <> pivot").groupBy("id", "pivot").agg(F.count(F.lit(1)).alias("c"), F.min("least_matches").alias("least"))
    chosen = tried.filter("c >= least").groupBy("id").agg(F.max(F.struct("c", -F.col("pivot"))).alias("best")).select("id", (-F.col("best.col2")).alias("pivot"))
    other = signs.select(F.col("id").alias("pivot"), F.col("n").alias("pn"), F.col("sign").alias("psign"))
    both = salted(chosen.join(signs.select("id", "n", "sign"), "id"), other, ["pivot"], ["id"]).filter(den * F.least("n", "pn") >= num * F.greatest("n", "pn")).select("id", "pivot", "n", "pn", "sign", "psign")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, pn = (batch.column(c).to_numpy() for c in (2, 3))
            differ = np.zeros(len(n), np.int64)
            for r, (a, b) in enumerate(zip(utf8(batch.column(4)), utf8(batch.column(5)), strict=True)):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                least = min(len(a), len(b))
                differ[r] = np.bitwise_count(folded(a, least) ^ folded(b, least)).sum()
            yield batch.select([0, 1]).filter(pa.array(_may_link(n, pn, differ, num, den)))

    return both.mapInArrow(run, "id long, pivot long").withColumnRenamed("pivot", "parent")


def _verified(pairs: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b, ok) of the distinct pairs, by whole sets. Leaves of a hub b are dealt over several tasks, and its set to each."""
    salts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / HUB_LEAVES).cast("int").alias("salts"))
    leaves = salted(pairs, salts, ["b"], ["a"]).select(F.col("a").alias("id"), F.col("b").alias("hub"), F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"))
    hubs = salts.select(F.col("b").alias("id"), F.col("b").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"))
    parts = saved(leaves.unionByName(hubs), "pairs")
    sets = _sets_of(docs, parts.select("id").distinct(), k)
    rows = parts.join(sets, "id").select("hub", "salt", "role", "id", "tokens").repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, sets_of_hub = None, []
        for batch in batches:
            a, b, ok = [], [], []
            hubs, roles, ids = (batch.column(c).to_pylist() for c in (0, 2, 3))
            ends, flat = batch.column(4).offsets.to_numpy(), batch.column(4).values.to_numpy()
            for i in range(len(ids)):
                tokens = flat[ends[i] : ends[i + 1]]
                if roles[i] == 0:
                    sets_of_hub = [*(sets_of_hub if hub == hubs[i] else []), tokens.copy()]  # several if rows with one id have several texts
                    hub = hubs[i]
                    continue
                common = [(len(np.intersect1d(s, tokens, assume_unique=True)), len(s) + len(tokens)) for s in sets_of_hub]
                a.append(ids[i])
                b.append(hub)
                ok.append(any(den * c >= num * (both - c) for c, both in common))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    return rows.mapInArrow(run, "a long, b long, ok boolean").groupBy("a", "b").agg(F.max("ok").alias("ok"))


def _moved(rows: DataFrame, to: DataFrame, *columns: str) -> DataFrame:
    """rows with the columns' ids replaced by what to (id, component) says, where it says anything. Some ids may stand in many rows."""
    names = rows.columns
    for c in columns:
        rows = salted(rows, to.select(F.col("id").alias(c), F.col("component").alias("to_")), [c], [n for n in names if n != c] or [c], how="left").withColumn(c, F.coalesce("to_", c)).drop("to_")
    return rows.select(names)


def _lists(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(token, salt, salts, id, pivot, least_matches) of the prefix tokens that several nodes have."""
    listed = rows.join(nodes, ["id", "d1", "d2"], "left_semi").select("id", "matches", F.explode(F.arrays_zip("prefix", "salts")).alias("t"))
    listed = listed.select("id", "matches", F.col("t.prefix").alias("token"), F.col("t.salts").alias("salts")).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    lists = listed.groupBy("token").agg(F.max("salts").alias("salts"), F.count(F.lit(1)).alias("m"), F.min("id").alias("pivot"), F.min("matches").alias("list_matches")).filter("m > 1")
    return saved(_to_lists(listed, lists.drop("m")).select("token", "salt", "salts", "id", "pivot", F.least("matches", "list_matches").alias("least_matches")), "shared")


def _groups(rows: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(id, component) of the nodes that are linked with any. rows: as _prefixes; nodes: id, d1, d2."""
    shared = _lists(rows, nodes)
    release(docs.sparkSession)
    listed = nodes.join(shared.select("id").distinct(), "id", "left_semi")
    known = rows.select("id", "d1", "d2", "n", "matches", "sign", "few").join(listed, ["id", "d1", "d2"], "left_semi")
    signs = saved(known.select("id", "n", "matches", "sign", "few").dropDuplicates(["id"]), "signs")
    release(docs.sparkSession)
    star = saved(_star(shared, signs, num, den), "star")
    near = roots(star).withColumnRenamed("root", "component")
    placed = shared.join(near, "id", "left").select("token", "salt", "salts", "id", F.coalesce("component", "id").alias("component"), "least_matches")
    placed = saved(placed, "placed")
    release(docs.sparkSession)
    weight = signs.select("id", F.greatest(F.length("sign") + F.length("few"), F.lit(BLOCK_BYTES // BLOCK_NODES)).alias("weight"))
    rows = _in_blocks(_open_lists(placed).join(weight, "id"), "weight", BLOCK_BYTES).join(signs, "id").select("token", "x", "y", "id", "component", "n", "matches", "sign", "few")
    more = saved(_by_list(rows, _likely_kernel(num, den), np.uint64, np.uint16), "likely")
    release(docs.sparkSession)
    joined = components(_moved(more, near, "a", "b"))
    likely = saved(_moved(near, joined, "component").unionByName(joined), "likely")  # a root of near has no row there
    release(docs.sparkSession)
    pairs = star.select(F.col("id").alias("a"), F.col("parent").alias("b")).unionByName(more).distinct()
    checked = saved(_verified(pairs, docs, k, num, den), "checked")
    release(docs.sparkSession)
    doubtful = saved(_moved(checked.filter("not ok").select(F.col("a").alias("component")), likely, "component").distinct(), "doubtful")
    if doubtful.isEmpty():
        return likely
    members = likely.unionByName(doubtful.select(F.col("component").alias("id"), "component")).distinct()  # the root of a star has no row in likely
    again = saved(salted(members, doubtful, ["component"], ["id"]).select("id", F.col("component").alias("was")), "again")
    release(docs.sparkSession)
    sure = checked.filter("ok").join(again.select(F.col("id").alias("a")), "a", "left_semi").select("a", "b")
    solid = components(sure)
    # nodes are compared where they share a list and a doubtful component: the two together are the list now
    part = shared.join(again, "id").select(F.xxhash64("token", "was").alias("token"), "salt", "salts", "id", "least_matches")
    part = part.join(solid, "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_ = saved(_open_lists(saved(part, "part")), "open")
    release(docs.sparkSession)
    sets = saved(_sets_of(docs, open_.select("id").distinct(), k).join(open_.select("id").distinct(), "id", "left_semi"), "sets")
    release(docs.sparkSession)
    rows = _in_blocks(open_.join(signs.select("id", "n", "matches"), "id"), "n", BLOCK_TOKENS)
    links = _by_list(rows.join(sets, "id").select("token", "x", "y", "id", "component", "n", "matches", "tokens"), _exact_kernel(num, den), np.int64)
    links = saved(links, "exact")
    release(docs.sparkSession)
    settled = components(sure.unionByName(links))
    return likely.join(again.select("id"), "id", "left_anti").select("id", "component").unionByName(settled)


def _with_digest(df: DataFrame, k: int, text_col: str, d1: str, d2: str) -> DataFrame:
    """df with the digest of each row's set."""
    where, full = df.columns.index(text_col), T.StructType([*df.schema.fields, T.StructField(d1, T.LongType()), T.StructField(d2, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("ngram_join")
        for batch in batches:
            sums = [xxhash.xxh3_128_intdigest(shingle_set(t, k).tobytes()) for t in utf8(batch.column(where).cast(pa.string()))]
            both = [pa.array([(x >> 64) - (1 << 63) for x in sums], pa.int64()), pa.array([(x & ((1 << 64) - 1)) - (1 << 63) for x in sums], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *both], full.fieldNames())

    return df.mapInArrow(run, full)


def _keyed(docs: DataFrame, rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """docs (id, text), rows (id, d1, d2, ...) and links (a, b), such that no id has several sets: where one has, all but one of its sets get new ids, and links say so. No links if there are none such."""
    digests = rows.filter("n > 0 and id is not null").select("id", "d1", "d2")
    several = saved(digests.groupBy("id").agg(F.min(F.struct("d1", "d2")).alias("first"), F.max(F.struct("d1", "d2")).alias("last")).filter("first <> last").select("id", "first"), "several")
    if several.isEmpty():
        return docs, rows, None
    sets = saved(digests.join(several, "id").filter(F.struct("d1", "d2") != F.col("first")).select("id", "d1", "d2").distinct(), "sets-of-one-id")
    known = rows.select("id").distinct()
    attempt = 0
    while True:  # a new id must be nobody's
        new = sets.withColumn("key", F.xxhash64("id", "d1", "d2", F.lit(attempt)))
        if new.groupBy("key").count().filter("count > 1").isEmpty() and new.join(known.select(F.col("id").alias("key")), "key", "left_semi").isEmpty():
            break
        attempt += 1
    new = saved(new, "keys")

    of_several = docs.join(several.select("id"), "id", "left_semi").select("id", "text")
    of_several = _with_digest(of_several, k, "text", "d1", "d2")
    named = of_several.join(new, ["id", "d1", "d2"], "left").select(F.coalesce("key", "id").alias("id"), "text")
    apart = saved(docs.join(several.select("id"), "id", "left_anti").select("id", "text").unionByName(named), "apart")
    renamed = saved(rows.join(new, ["id", "d1", "d2"], "left").withColumn("id", F.coalesce("key", "id")).select(rows.columns), "renamed")
    return apart, renamed, new.select(F.col("id").alias("a"), F.col("key").alias("b"))


def _classes(docs: DataFrame, k: int, num: int, den: int, *, by_id: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs (id, text), with ids of which each has one set; (id, n, d1, d2) of every row given; and (n, d1, d2, node, equal, component) of every set, with the number of its rows. by_id: sets of one id count as linked, and components are known by real ids."""
    spark: SparkSession = docs.sparkSession
    bound_batches(spark)
    release(spark)
    rows = saved(_prefixes(docs, k, num, den, token_sketch(docs, k)), "prefixes")
    release(spark)
    apart, keyed, same = _keyed(docs, rows, k)
    some = keyed.filter("n > 0 and id is not null")
    nodes = saved(some.groupBy("n", "d1", "d2").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("equal")), "nodes")
    release(spark)
    groups = _groups(some, saved(nodes.select(F.col("node").alias("id"), "d1", "d2"), "one"), apart, k, num, den)
    found = saved(nodes.join(groups.select(F.col("id").alias("node"), "component"), "node", "left").select("n", "d1", "d2", "node", "equal", F.coalesce("component", "node").alias("component")), "groups")
    release(spark)
    if same is not None and by_id:
        at = lambda end: some.select(F.col("id").alias(end), "n", "d1", "d2").distinct().join(found.select("n", "d1", "d2", F.col("component").alias(f"c_{end}")), ["n", "d1", "d2"]).select(end, f"c_{end}")
        links = same.join(at("a"), "a").join(at("b"), "b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))
        found = saved(_moved(found, components(links), "component"), "joined")
        real = rows.filter("n > 0 and id is not null").groupBy("n", "d1", "d2").agg(F.min("id").alias("least"))
        names = salted(found.select("component", "n", "d1", "d2").join(real, ["n", "d1", "d2"]).groupBy("component").agg(F.min("least").alias("name")), found.select("component").distinct(), ["component"], ["name"])
        found = saved(salted(found, names, ["component"], ["n", "d1", "d2"]).withColumn("component", F.col("name")).drop("name"), "named")
    return apart, rows.select("id", "n", "d1", "d2"), found


def _placed(rows: DataFrame, sets: DataFrame, id_col: str, *more: str) -> DataFrame:
    """(id, n_shingles, component, ...) of every row (id, n, d1, d2). Rows of equal sets may be many, and rows without shingles meet nothing."""
    known = F.col("id").isNotNull()
    with_set = salted(rows.filter("n > 0"), sets.select("n", "d1", "d2", "component", *more), ["n", "d1", "d2"], ["id"], how="left")
    names = [F.col("id").alias(id_col), F.col("n").alias("n_shingles")]
    found = with_set.select(*names, F.when(known, F.coalesce("component", "id")).alias("component"), *[F.when(known, F.coalesce(c, F.lit(0))).alias(c) for c in more])
    return found.unionByName(rows.filter("n = 0").select(*names, F.col("id").alias("component"), *[F.when(known, F.lit(0).cast("long")).alias(c) for c in more]))


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(df[id_col].cast("long").alias("id"), df[text_col].cast("string").alias("text"))


def jaccard_groups(df: DataFrame, *, k: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component) of every row: two documents link when their sets' Jaccard similarity is num / den or more."""
    with scratch(df.sparkSession) as keep:
        _, rows, sets = _classes(_documents(df, id_col, text_col), k, num, den)
        return keep(_placed(rows, sets, id_col), "groups-of-documents")


def linked_with(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Which of the sets, distinct numbers each, are linked: a square of booleans. Counts are sums of products, some tokens at a time; those of one set only are left out."""
    size = np.array([len(s) for s in sets], np.int64)
    who = np.repeat(np.arange(len(sets)), size)
    _, token, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    some = often[token] > 1
    place = np.cumsum(often > 1) - 1
    who, token = who[some], place[token[some]]
    order = np.argsort(token, kind="stable")
    who, token = who[order], token[order]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int((often > 1).sum()), COLUMNS):
        lo, hi = np.searchsorted(token, (first, first + COLUMNS))
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[who[lo:hi], token[lo:hi] - first] = 1
        shared += part @ part.T
    both = shared.astype(np.int64)
    return (den * both >= num * (size[:, None] + size[None] - both)) & (both > 0)


def _linked(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(id, links) of members (id, n, equal, component) linked with any: how many rows the sets that theirs is linked with have. A component is cut into blocks, and every two of them meet in one task."""
    weight = F.greatest(F.col("n"), F.lit(LEAST_WEIGHT))
    parts = members.groupBy("component").agg(F.greatest(F.lit(1), F.ceil(F.sum(weight) / LINK_TOKENS)).cast("int").alias("blocks"))
    rows = salted(members, parts, ["component"], ["id"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("x"), F.greatest(o, F.col("block")).alias("y")))
    rows = rows.join(sets, "id").withColumn("meet", F.explode(meets)).select("component", "meet.x", "meet.y", "id", "block", "equal", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list) -> pa.RecordBatch:
            ids, block, equal = (np.array([h[c] for h in held], np.int64) for c in range(3))
            ok = linked_with([h[3] for h in held], num, den)
            np.fill_diagonal(ok, False)
            if key[1] != key[2]:  # each block meets itself elsewhere
                ok &= block[:, None] != block[None]
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ok @ equal)], ["id", "links"])

        key, held = None, []
        for batch in batches:
            for c, x, y, *rest in zip(*(batch.column(c).to_pylist() for c in range(6)), _slices(batch.column(6), np.int64), strict=True):
                if (c, x, y) != key:
                    if len(held) > 1:
                        yield out(held)
                    key, held = (c, x, y), []
                held.append(rest)
        if len(held) > 1:
            yield out(held)

    sums = rows.repartition("component", "x", "y").sortWithinPartitions("component", "x", "y").mapInArrow(run, "id long, links long")
    return sums.groupBy("id").agg(F.sum("links").alias("links"))


def jaccard_links(df: DataFrame, *, k: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component, n_links) of every row, as jaccard_groups, and how many other rows it is linked with; null without an id. Rows of equal sets are counted, not compared."""
    with scratch(df.sparkSession) as keep:
        docs, rows, sets = _classes(_documents(df, id_col, text_col), k, num, den)
        several = sets.groupBy("component").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("component")
        members = saved(salted(sets, several, ["component"], ["node"]).select(F.col("node").alias("id"), "n", "equal", "component"), "several")
        release(df.sparkSession)
        linked = saved(_linked(members, _sets_of(docs, members.select("id"), k).dropDuplicates(["id"]), num, den), "linked")
        counts = sets.join(linked.withColumnRenamed("id", "node"), "node", "left").withColumn("n_links", F.col("equal") - 1 + F.coalesce("links", F.lit(0)))
        return keep(_placed(rows, counts, id_col, "n_links"), "links-of-documents")


def first_of_groups(df: DataFrame, *, k: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each group, that with the smallest id. A row goes only where its own text is a copy: rows of one id with different texts are judged each for itself. Rows without an id or without words all stay; all columns stay."""
    tag = uuid.uuid4().hex[:8]
    with scratch(df.sparkSession) as keep:
        _, rows, sets = _classes(_documents(df, id_col, text_col), k, num, den, by_id=False)
        some = rows.filter("n > 0 and id is not null")
        least = some.groupBy("n", "d1", "d2").agg(F.min("id").alias("id"))
        first = sets.join(least, ["n", "d1", "d2"]).groupBy("component").agg(F.min(F.struct("id", "n", "d1", "d2")).alias("first")).select("first.id", "first.d1", "first.d2")
        first = saved(first, "first")
        release(df.sparkSession)
        again = keep(some.groupBy("id").count().filter("count > 1").select("id"), "again")
        stays = keep(first.join(again, "id", "left_semi").select("id", F.col("d1").alias(f"d1_{tag}"), F.col("d2").alias(f"d2_{tag}")), "stays")
        copies = some.join(again, "id", "left_anti").join(first, ["id", "d1", "d2"], "left_anti").select(F.col("id").alias(id_col))
        copies = keep(copies, "copies")
    release(df.sparkSession)
    left, names = _without(df, copies, id_col), df.columns
    if again.isEmpty():
        return left
    own = again.withColumnRenamed("id", id_col)
    both = _with_digest(left.join(own, id_col, "left_semi").select(names), k, text_col, f"d1_{tag}", f"d2_{tag}")
    none = xxhash.xxh3_128_intdigest(b"")
    wordless = (F.col(f"d1_{tag}") == (none >> 64) - (1 << 63)) & (F.col(f"d2_{tag}") == (none & ((1 << 64) - 1)) - (1 << 63))
    keys = [id_col, f"d1_{tag}", f"d2_{tag}"]
    one = both.filter(~wordless).join(stays.withColumnRenamed("id", id_col), keys, "left_semi").groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in names]), F.xxhash64(text_col)).alias(f"row_{tag}"))
    return left.join(own, id_col, "left_anti").select(names).unionByName(both.filter(wordless).select(names)).unionByName(one.select(f"row_{tag}.*").select(names))
