"""Toxicity: a convolutional text classifier in numpy, with a decision threshold for each language.

A word's embedding is the sum of the table rows that its hashes pick: of the whole word, without signs around it, and
of its first 4, 5 and 7 letters. Filters one, two and three words wide slide over the text; their rectified outputs are
max-pooled within stretches of 32 words; the mean and the maximum of the stretches enter a logistic output. Rows that
the training sample touches in few documents stay at zero, so rare words can't be learnt by heart.

It is fitted on whole texts of a bounded sample of labelled rows: at most ``most_rows``, and at most ``most_bytes`` of
text, in the order of a hash of the id; a row whose text doesn't fit what is left, or has over a sixteenth of
``most_bytes``, is passed over. It scores whole texts,
slab by slab, so that a text of any length needs the same memory. Rows whose crc32(id as text) mod 5 is 0 are held out
of fitting. A fifth of the other ids isn't fitted on: the scores of all its labelled texts, however many, calibrate the
thresholds, by counts that Spark sums. A score depends on
the text alone, and the id decides no more than which rows are in the sample; only the decision ``toxic`` also looks at
the language. An empty table gives an empty result.

Repeated documents have the same score, each for itself; of a labelled document that is repeated, every row of the
sample's id is fitted on.

Null text counts as empty, which has a score too. A null id gives held_out false. Labels that are null, not 0 or 1, or
without a document, don't count; a label that is given twice counts once, the larger. Without any labels of both
kinds all scores are 0. Columns other than those named are dropped by ``score`` and kept by ``keep_clean``.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.llm.common import bound_batches, keeps, take_turn

STRETCH, WIDTHS, FILTERS, DIM, ROWS = 32, (1, 2, 3), 8, 16, 1 << 15
LETTERS = (4, 5, 7)
#: Empty rows before a text, as many as a window reaches ahead.
LEAD = max(WIDTHS) - 1
SLAB = STRETCH * 1024
#: Weight of the squares of filters and output in the loss; words of a batch that is fitted on at once.
DECAY, BATCH_WORDS = 1e-4, 300_000
#: Share of most_bytes that one text to fit on may have.
LARGEST = 1 / 16
#: Words that a worker remembers at least before it starts anew.
REMEMBERED = 100_000
#: Characters that are scored at once, at least.
PART = 400_000
_SIGNS = "".join(chr(c) for c in range(33, 128) if not chr(c).isalnum())


def held_out(id_col: F.Column) -> F.Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def word_rows(word: str) -> tuple[int, ...]:
    """Table rows of a word; row 0 is never learnt."""
    w = word.strip(_SIGNS).lower()
    if not w:
        return (0,) * (1 + len(LETTERS))
    return tuple(1 + xxhash.xxh3_64_intdigest(f"{n}:{w[:n] if n else w}") % (ROWS - 1) if len(w) >= n else 0 for n in (0, *LETTERS))


class _WordIndex(dict):
    """Words to small numbers, with their table rows; starts anew beyond a bound."""

    def __init__(self):
        super().__init__()
        self.flat = array("i", (0,) * (1 + len(LETTERS)))

    @property
    def rows(self) -> np.ndarray:
        """Table rows of the numbers, a copy."""
        return np.array(self.flat, np.int32).reshape(-1, 1 + len(LETTERS))

    def forget(self) -> None:
        self.clear()
        del self.flat[1 + len(LETTERS) :]

    def __missing__(self, word: str) -> int:
        self[word] = k = len(self.flat) // (1 + len(LETTERS))
        self.flat.extend(word_rows(word))
        return k


def layout(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Where each text's words start, and how many stretches it has. Empty rows before every text keep windows from reaching into the next one, so that a score depends on the text alone."""
    stretches = (np.array(lengths, np.int64) + LEAD + STRETCH - 1) // STRETCH
    return (np.cumsum(stretches) - stretches) * STRETCH + LEAD, stretches


@dataclass
class Model:
    table: np.ndarray
    filters: list[np.ndarray] = field(default_factory=list)  # width x DIM x FILTERS each
    bias: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS, np.float32))
    out: np.ndarray = field(default_factory=lambda: np.zeros(2 * len(WIDTHS) * FILTERS, np.float32))
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    fitted: bool = False

    def convolved(self, x: np.ndarray) -> np.ndarray:
        """x: positions with max(WIDTHS) - 1 more than the outputs."""
        n = len(x) - max(WIDTHS) + 1
        parts = []
        for w in self.filters:
            y = x[:n] @ w[0]
            for j in range(1, len(w)):
                y += x[j : n + j] @ w[j]
            parts.append(y)
        y = np.concatenate(parts, axis=1) + self.bias
        return np.maximum(y, 0, out=y)

    def pooled(self, words: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """Maxima of all stretches of a padded sequence of word numbers."""
        more = np.zeros(max(WIDTHS) - 1, words.dtype)
        out = [self.convolved(vectors[np.concatenate((words[at : at + SLAB], words[at + SLAB : at + SLAB + len(more)], more))[: min(SLAB, len(words) - at) + len(more)]]).reshape(-1, STRETCH, len(self.bias)).max(axis=1) for at in range(0, len(words), SLAB)]
        return np.concatenate(out) if out else np.zeros((0, len(self.bias)), np.float32)

    def features(self, maxima: np.ndarray, stretches: np.ndarray) -> np.ndarray:
        start = np.cumsum(stretches) - stretches
        return np.concatenate((np.add.reduceat(maxima, start) / stretches[:, None], np.maximum.reduceat(maxima, start)), axis=1)

    def score(self, texts: list[str], index: _WordIndex) -> np.ndarray:
        if not texts or not self.fitted:
            return np.zeros(len(texts))
        if len(index) > REMEMBERED:
            index.forget()
        split = [t.split() for t in texts]
        start, stretches = layout([len(s) for s in split])
        padded = np.zeros(int(stretches.sum()) * STRETCH, np.int32)
        for s, at in zip(split, start.tolist(), strict=True):
            padded[at : at + len(s)] = np.fromiter(map(index.__getitem__, s), np.int32, len(s))
        used, local = np.unique(padded, return_inverse=True)
        rows = index.rows[used]
        vectors = sum(self.table[rows[:, j]] for j in range(rows.shape[1]))
        f = self.features(self.pooled(local, vectors), stretches)
        return 1 / (1 + np.exp(-np.clip(f @ self.out + self.shift, -30, 30)))


def gradients(model: Model, picked: np.ndarray, stretches: np.ndarray, y: np.ndarray) -> tuple[list[np.ndarray], float]:
    """Of the mean log loss of some texts, and half of DECAY times the squares of filters and output: by table, filters, bias, output, and by the shift. picked: table rows of every position."""
    width = len(WIDTHS) * FILTERS
    x = np.concatenate((model.table[picked].sum(axis=1), np.zeros((max(WIDTHS) - 1, DIM), np.float32)))
    z = model.convolved(x).reshape(-1, STRETCH, width)
    best = z.argmax(axis=1)
    top = np.take_along_axis(z, best[:, None], axis=1)[:, 0]
    f = model.features(top, stretches)
    p = 1 / (1 + np.exp(-np.clip(f @ model.out + model.shift, -30, 30)))
    error = (p - y) / len(y)
    of = np.repeat(np.arange(len(y)), stretches)
    back = error[:, None] * model.out[None]
    grad_top = back[of, :width] / stretches[of][:, None]
    first = np.cumsum(stretches) - stretches
    is_peak = (top == np.maximum.reduceat(top, first)[of]) & (top > 0)
    ties = np.maximum(np.add.reduceat(is_peak, first), 1)  # equal stretches share the maximum's part
    grad_top = ((grad_top + np.where(is_peak, back[of, width:] / ties[of], 0)) * (top > 0)).astype(model.table.dtype)
    position = best + np.arange(len(best))[:, None] * STRETCH
    grads = [np.zeros_like(model.table)]
    dx = np.zeros_like(x)
    for k, w in enumerate(model.filters):
        mine = slice(k * FILTERS, (k + 1) * FILTERS)
        g, pos = grad_top[:, mine], position[:, mine]
        dw = np.empty_like(w)
        for j in range(len(w)):
            dw[j] = np.einsum("sfd,sf->df", x[pos + j], g)
            np.add.at(dx, (pos + j).ravel(), (g[:, :, None] * w[j].T[None]).reshape(-1, DIM))
        grads.append(dw + DECAY * w)
    touched = np.flatnonzero(np.abs(dx[: len(picked)]).sum(axis=1))
    np.add.at(grads[0], picked[touched].ravel(), np.repeat(dx[touched], picked.shape[1], axis=0))
    return [*grads, grad_top.sum(axis=0), f.T @ error + DECAY * model.out], float(error.sum())


def in_batches(lengths: list[int], batch: int) -> list[list[int]]:
    """Places in their order, so many at once, and of BATCH_WORDS words together at most, or one."""
    out: list[list[int]] = []
    held = 0
    for i, n in enumerate(lengths):
        if not out or len(out[-1]) == batch or held + n > BATCH_WORDS:
            out.append([])
            held = 0
        out[-1].append(i)
        held += n
    return out


def fit(texts: list[str], labels: list[int], *, epochs: int = 6, batch: int = 32, rate: float = 0.01, least_docs: int = 5, seed: int = 0) -> Model:
    """A model of the texts' labels."""
    r = np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    model = Model(np.zeros((ROWS, DIM), np.float32))
    if not 0 < y.sum() < len(y):
        return model
    index = _WordIndex()
    docs = [np.fromiter(map(index.__getitem__, t.split()), np.int32) for t in texts]
    rows = index.rows
    seen = np.zeros((2, ROWS))
    for d, label in zip(docs, labels, strict=True):
        seen[label, np.unique(rows[d])] += 1
    odds = np.log((seen[1] + 0.5) / (y.sum() + 1)) - np.log((seen[0] + 0.5) / (len(y) - y.sum() + 1))
    n = seen.sum(axis=0)
    learnt = (n >= least_docs) & (np.arange(ROWS) > 0)
    model.table = (r.normal(0, 0.02, (ROWS, DIM)) * learnt[:, None]).astype(np.float32)
    model.table[:, 0] = np.where(learnt, np.maximum(odds, -1) * n / (n + 10), 0) / 4  # a start, not a verdict
    width = len(WIDTHS) * FILTERS
    model.filters = [r.normal(0, 0.15, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in model.filters:
        f[:, 0, : FILTERS // 2] += 0.5
    model.out[:] = 0.1
    model.shift, model.fitted = float(np.log(y.mean() / (1 - y.mean()))), True
    params = [model.table, *model.filters, model.bias, model.out]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        order = r.permutation(len(docs))
        for places in in_batches([len(docs[i]) for i in order], batch):
            part = order[places]
            start, stretches = layout([len(docs[i]) for i in part])
            words = np.zeros(int(stretches.sum()) * STRETCH, np.int32)
            for i, s in zip(part, start.tolist(), strict=True):
                words[s : s + len(docs[i])] = docs[i]
            grads, moved = gradients(model, rows[words], stretches, y[part])
            grads[0] *= learnt[:, None]
            step += 1
            for q, g, a, b in zip(params, grads, first, second, strict=True):
                a *= 0.9
                a += 0.1 * g
                b *= 0.99
                b += 0.01 * g * g
                q -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
            model.shift -= rate * moved * 10
    return model


#: Thresholds that are tried.
GRID = np.linspace(0.3, 0.7, 41)


def calibrate(scores: np.ndarray, labels: np.ndarray, langs: list[str], *, least: int = 30) -> dict[str, float]:
    """thresholds, by scores at hand."""
    counts: dict[tuple[str, int, int], int] = {}
    for lang, label, reached in zip(langs, labels.tolist(), np.searchsorted(GRID, scores, side="right").tolist(), strict=True):
        counts[lang, label, reached] = counts.get((lang, label, reached), 0) + 1
    return thresholds(counts, least=least)


def thresholds(counts: dict[tuple[str, int, int], int], *, least: int = 30) -> dict[str, float]:
    """The threshold of each language with enough labels of both kinds: midway in the widest range of fewest errors on the grid. Others take 0.5. counts: texts by language, label, and how many of the grid's thresholds their scores reach."""
    out = {}
    for lang in sorted({k[0] for k in counts}):
        texts = np.zeros((2, len(GRID) + 1), np.int64)
        for (of, label, reached), n in counts.items():
            if of == lang:
                texts[label, reached] += n
        if texts.sum() < least or not texts.sum(axis=1).all():
            continue
        missed = np.cumsum(texts[1])[:-1]  # of label 1, those that don't reach a threshold
        wrong = texts[0].sum() - np.cumsum(texts[0])[:-1]  # of label 0, those that do
        good = GRID[missed + wrong == (missed + wrong).min()]
        out[lang] = float((good.min() + good.max()) / 2)
    return out


def train(docs: DataFrame, labels: DataFrame, *, most_rows: int = 3000, most_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", epochs: int = 5) -> Model:
    """Fit on whole texts of at most most_rows labelled rows, of most_bytes together at most, and calibrate on all labelled rows of a fifth of the ids."""
    marked = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    known = marked.filter(~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(most_rows)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    apart = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(5)) == 0
    order = (F.xxhash64("id"), F.col("id"), F.xxhash64("text"))
    some = docs.select(docs[id_col].alias("id"), text.alias("text")).join(F.broadcast(chosen), "id").filter(~apart)  # most_rows numbers
    left, taken = most_bytes, []
    sizes = some.select("id", F.xxhash64("text").alias("h"), F.octet_length("text").alias("n")).orderBy(F.xxhash64("id"), "id", "h").limit(2 * most_rows).collect()  # numbers only
    for r in sizes:
        if r.n <= min(left, LARGEST * most_bytes):
            left -= r.n
            taken.append((r.id, r.h))
    fits = docs.sparkSession.createDataFrame([*set(taken)], some.select("id").schema.add("h", "long"))
    rows = some.withColumn("h", F.xxhash64("text")).join(F.broadcast(fits), ["id", "h"], "left_semi").orderBy(*order).limit(2 * most_rows).collect()  # most_rows and most_bytes at most, unless ids repeat
    model = fit([x.text for x in rows], [x.label for x in rows], epochs=epochs)
    if model.fitted:
        whole = docs.select(docs[id_col].alias("id"), text.alias("text"), docs[lang_col].cast("string").alias("lang")).filter(apart & ~held_out(F.col("id")))
        reached = sum((F.col("score") >= float(t)).cast("int") for t in GRID)
        scored = _scored(whole, model, "text", "score").select("id", F.coalesce("lang", F.lit("")).alias("lang"), reached.alias("reached")).join(known, "id")  # scores meet labels, texts stay
        counts = scored.groupBy("lang", "label", "reached").count().collect()  # at most 84 rows a language
        model.thresholds = thresholds({(x["lang"], x["label"], x["reached"]): x["count"] for x in counts})
    return model


_index = _WordIndex()
keeps("toxicity", _index.forget)


def _scored(df: DataFrame, model: Model, text_col: str, name: str) -> DataFrame:
    """df with a score."""
    bound_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # ROWS x DIM numbers
    where, full = df.columns.index(text_col), T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("toxicity")
        m = shared.value
        for batch in batches:
            texts = [x or "" for x in batch.column(where).cast(pa.string()).to_pylist()]
            scores, part, size = [], [], 0
            for t in texts:
                part.append(t)
                size += len(t)
                if size > PART:
                    scores.append(m.score(part, _index))
                    part, size = [], 0
            scores.append(m.score(part, _index))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores), pa.float64())], full.fieldNames())

    return df.mapInArrow(run, full)


def _threshold(model: Model, lang: F.Column) -> F.Column:
    at = F.lit(0.5)
    for k, v in model.thresholds.items():
        at = F.when(lang == k, v).otherwise(at)
    return at


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, score, predicted, toxic) of every row."""
    source = docs.select(docs[id_col].alias("id"), docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text"))
    got = _scored(source, model, "text", "score")
    return got.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), (F.col("score") >= _threshold(model, F.col("lang"))).alias("toxic"))


def keep_clean(docs: DataFrame, model: Model, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without those that are toxic by their language's threshold; all columns stay."""
    name = f"score_{uuid.uuid4().hex[:8]}"
    got = _scored(docs, model, text_col, name)
    return got.filter(F.col(name) < _threshold(model, F.coalesce(F.col(lang_col).cast("string"), F.lit("")))).select(docs.columns)
