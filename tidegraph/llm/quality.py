"""Quality classifier: document evidence shrunk by hierarchical empirical Bayes over hosts and paths.

A logistic regression on the shape of a text (character classes, repetition, lengths) gives each document's evidence. It
is fitted on a bounded sample of labelled rows (``most_rows``, by a hash of the id; ids whose crc32 mod 5 is 0 are held
out). Grouped aggregation over all documents gives each host, and each path of a host, its mass of evidence; labels
outside the held-out part count like documents. A host's posterior mean is its own mean shrunk toward the global prior,
a path's is its mean shrunk toward its host; how strongly is estimated from the spread of the means, by the method of
moments. A document's score is its evidence moved by its site's posterior odds against the prior, its own evidence
taken out of its site first, so that a site of one document has the prior.

Texts are scored first and joined with their sites afterwards; a site table up to a size is broadcast, and with a
larger one the rows of a large site are dealt over many tasks.

Null or empty texts have the evidence of an empty text, and texts of any length are counted whole. An empty table of
documents gives an empty result, and no labels, or labels of one kind, an evidence of 1/2 everywhere. Null hosts or paths are sites of their own, called "". A null
id gives held_out false. A label that is null, not 0 or 1, or without a document doesn't count; one that is given twice
counts once, the larger. Without labels of both kinds all evidence is 1/2. Repeated rows are documents of their own.
``judge`` drops columns that it doesn't name; ``keep_good`` keeps all columns.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.llm.common import bound_batches, salted, saved, take_turn, utf8
from tidegraph.llm.toxicity import held_out

_CLASS = np.zeros(256, np.int64)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = 0 if _b >= 128 or "a" <= _c <= "z" else 1 if "A" <= _c <= "Z" else 2 if _c.isdigit() else 3 if _c in " \t\r" else 4 if _c == "\n" else 5 if _c in ".,;:'\"-()?" else 6 if _c == "!" else 7 if _c == "|" else 8
N_FEATURES = 9 + 6
#: Limits of the strength of shrinking, in documents.
STRENGTH = (2.0, 1000.0)
#: Site tables up to so many rows are broadcast; larger ones are joined by shuffling.
MOST_BROADCAST = 100_000
#: Tasks that the rows of one site are dealt over at most: numbers only, and whole texts.
SALTS, TEXT_SALTS = 256, 1 << 14


def features(text: bytes | None) -> np.ndarray:
    """Shape of a text."""
    text = text or b""
    classes = np.bincount(_CLASS, np.bincount(np.frombuffer(text, np.uint8), minlength=256), 9) / max(len(text), 1)
    words = text.split()
    n = len(words)
    counts = Counter(words)
    top = max(counts.values(), default=0)
    again = sum(map(bytes.__eq__, words, words[1:]))
    more = (np.log1p(n), len(counts) / max(n, 1), top / max(n, 1), again / max(n, 1), len(text) / max(n, 1) / 10, np.log1p(n) * len(counts) / max(n, 1))
    return np.concatenate((np.log1p(100 * classes), more))


@dataclass
class Evidence:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray

    def of(self, f: np.ndarray) -> np.ndarray:
        z = np.clip((f - self.mean) / self.scale, -8, 8) @ self.weight[:-1] + self.weight[-1]
        return 1 / (1 + np.exp(-np.clip(z, -12, 12)))


def fit(f: np.ndarray, y: np.ndarray, *, ridge: float = 1.0, rounds: int = 30) -> Evidence:
    """Logistic regression by Newton's method."""
    none = Evidence(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES + 1))
    if not len(y) or not 0 < y.sum() < len(y):
        return none
    out = Evidence(f.mean(axis=0), f.std(axis=0) + 1e-3, np.zeros(N_FEATURES + 1))
    x = np.column_stack((np.clip((f - out.mean) / out.scale, -8, 8), np.ones(len(f))))
    penalty = ridge * np.diag([*[1.0] * N_FEATURES, 1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ out.weight, -12, 12)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ out.weight)
        out.weight += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return out


def _with_features(df: DataFrame, text_col: str) -> DataFrame:
    where, full = df.columns.index(text_col), T.StructType([*[f for f in df.schema.fields if f.name != text_col], T.StructField("shape", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = pa.array([features(t).tolist() for t in utf8(batch.column(where).cast(pa.string()))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(batch.columns) if i != where], shapes], full.fieldNames())

    return df.mapInArrow(run, full)


def _with_evidence(df: DataFrame, model: Evidence, text_col: str, name: str) -> DataFrame:
    """df with the evidence of each text."""
    bound_batches(df.sparkSession)
    where, full = df.columns.index(text_col), T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("quality")
        for batch in batches:
            shapes = np.array([features(t) for t in utf8(batch.column(where).cast(pa.string()))]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.of(shapes), pa.float64())], full.fieldNames())

    return df.mapInArrow(run, full)


def _labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    marked = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    return marked.filter(~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))


def train(docs: DataFrame, labels: DataFrame, *, most_rows: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Evidence:
    """The document classifier, from at most most_rows labelled rows."""
    bound_batches(docs.sparkSession)
    chosen = _labels(labels, id_col, label_col).orderBy(F.xxhash64("id"), "id").limit(most_rows)
    some = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).join(F.broadcast(chosen), "id")
    rows = _with_features(some, "text").orderBy(F.xxhash64("id"), "id").limit(2 * most_rows).collect()  # numbers only; most_rows, unless ids repeat
    return fit(np.array([r.shape for r in rows]).reshape(-1, N_FEATURES), np.array([r.label for r in rows], float))


def _strength(n: str, mean: str, around: F.Column) -> F.Column:
    """Method of moments: how many documents the prior weighs, from the spread of the sites' means around theirs."""
    p = F.sum(F.col(n) * F.col(mean)) / F.sum(n)
    noise = F.sum(F.col(mean) * (1 - F.col(mean)))
    between = F.sum(F.col(n) * F.pow(F.col(mean) - around, 2)) - noise
    room = F.sum(n) * p * (1 - p)
    ratio = room / F.greatest(between, F.lit(1e-9)) - 1
    return F.least(F.greatest(F.coalesce(ratio, F.lit(STRENGTH[0])), F.lit(STRENGTH[0])), F.lit(STRENGTH[1]))


def sites(docs: DataFrame, labels: DataFrame, model: Evidence, host: F.Column, path: F.Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(host, path, n, mass, host_mean, path_strength, prior) of every site, over all documents."""
    source = docs.select(docs[id_col].alias("id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), docs[text_col].cast("string").alias("text"))
    seen = saved(_with_evidence(source, model, "text", "p").drop("text"), "evidence")
    marked = seen.join(_labels(labels, id_col, label_col), "id").select("host", "path", F.col("label").cast("double").alias("p"))
    by_path = saved(seen.select("host", "path", "p").unionByName(marked).groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("p").alias("mass")), "paths")
    by_host = by_path.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("mass").alias("host_mass"))
    total = by_host.agg((F.sum("host_mass") / F.sum("host_n")).alias("prior")).first()
    prior = min(max(total.prior if total.prior is not None else 0.5, 0.01), 0.99)
    means = by_host.withColumn("mean", F.col("host_mass") / F.col("host_n"))
    strength = means.agg(_strength("host_n", "mean", F.lit(prior)).alias("s")).first().s
    hosts = means.select("host", ((F.col("host_mass") + strength * prior) / (F.col("host_n") + strength)).alias("host_mean"))
    both = by_path.join(hosts, "host").withColumn("mean", F.col("mass") / F.col("n"))
    inner = both.agg(_strength("n", "mean", F.col("host_mean")).alias("s")).first().s
    return saved(both.select("host", "path", "n", "mass", "host_mean", F.lit(float(inner)).alias("path_strength"), F.lit(float(prior)).alias("prior")), "sites")


def _posterior(docs: DataFrame, at: DataFrame, model: Evidence, host: F.Column, path: F.Column, text_col: str, names: dict[str, str], *, keep_text: bool = True) -> DataFrame:
    """docs with evidence, site posterior and score, under the given names; without the text, if nobody needs it."""
    keyed = docs.withColumns({names["host"]: F.coalesce(host.cast("string"), F.lit("")), names["path"]: F.coalesce(path.cast("string"), F.lit(""))})
    got = _with_evidence(keyed, model, text_col, names["evidence"])
    got = got if keep_text else got.drop(text_col)
    known = at.select(F.col("host").alias(names["host"]), F.col("path").alias(names["path"]), *[F.col(c).alias(names[c]) for c in ("n", "mass", "host_mean", "path_strength", "prior")])
    site = [names["host"], names["path"]]
    if at.count() <= MOST_BROADCAST:
        got = got.join(F.broadcast(known), site)
    else:
        got = salted(got, known, site, [names["evidence"], *([text_col] if keep_text else ["id"])], TEXT_SALTS if keep_text else SALTS)
    c = {k: F.col(v) for k, v in names.items()}
    others, mass = F.greatest(c["n"] - 1, F.lit(0.0)), F.greatest(c["mass"] - c["evidence"], F.lit(0.0))
    site = (F.least(mass, others) + c["path_strength"] * c["host_mean"]) / (others + c["path_strength"])
    odds = lambda x: F.log(x / (1 - x))
    held = F.least(F.greatest(site, F.lit(0.01)), F.lit(0.99))
    moved = odds(c["evidence"]) + odds(held) - odds(c["prior"])
    return got.withColumns({names["site"]: held, names["score"]: 1 / (1 + F.exp(-moved))})


def _names(tag: str) -> dict[str, str]:
    return {k: f"{k}{tag}" for k in ("host", "path", "n", "mass", "host_mean", "path_strength", "prior", "evidence", "site", "score")}


def judge(docs: DataFrame, at: DataFrame, model: Evidence, host: F.Column, path: F.Column, *, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, evidence, site, score, keep) of every row."""
    source = docs.select(docs[id_col].alias("id"), host.alias("h"), path.alias("p"), docs[text_col].cast("string").alias("text"))
    got = _posterior(source, at, model, F.col("h"), F.col("p"), "text", _names(""), keep_text=False)
    return got.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "evidence", "site", "score", (F.col("score") >= threshold).alias("keep"))


def keep_good(docs: DataFrame, at: DataFrame, model: Evidence, host: F.Column, path: F.Column, *, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs whose score is threshold or more; all columns stay."""
    names = _names(f"_{uuid.uuid4().hex[:8]}")
    return _posterior(docs, at, model, host, path, text_col, names).filter(F.col(names["score"]) >= threshold).select(docs.columns)
