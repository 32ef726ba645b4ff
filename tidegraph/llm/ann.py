"""Approximate nearest neighbours by multiprobe p-stable hashing.

In each of a few tables a vector falls into the bucket of its rounded Gaussian projections. A query visits buckets in
the order of their estimated success: the chance that a neighbour at the expected distance, whose projections differ by
Gaussian amounts, falls there. It stops when the visited buckets' chances, over all tables, reach the wanted success.
The candidates of a bucket are reranked by their exact distance inside the task that holds the bucket, the tables'
results are merged, and the nearest stay.

Projections, bucket width and expected distance are fitted on a bounded sample (``sample_rows``, by a hash of the
vector, so that copies count once); the expected distance is a high quantile of the sample's. Every row is indexed. How
many projections a table has follows the number of rows, so that buckets stay small. A bucket with many rows is cut into
blocks, each of which a query visits. Of equal vectors only the k + 1 with the smallest ids are indexed: no query can
return more of them. Queries that find fewer rows than they should are compared with all rows, in one pass, block by
block.

Vectors that are null or zero, or hold null or non-finite components, take no part, nor do those whose length isn't the
most frequent one, nor rows with a null id. Of rows with one id and several vectors each is a candidate and, where the
id is a query, a query; an id is found once, by its nearest. Ties go to the smaller id. With fewer than k other ids, all
of them are returned. An empty table gives an empty result. Extra columns are dropped.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.llm.common import bound_batches, filesystem, fresh_path, salted, saved, scratch

#: Rows that a bucket should hold about; effective buckets a projection is cut into.
OCCUPANCY, BINS = 2000, 3.0
#: Rows of a bucket that a task holds at once; rows that a task compares at once with all short queries, and how many of these it reads at once.
BLOCK_ROWS, HELD_ROWS, QUERY_BLOCK = 4000, 50_000, 1024
#: Share of the sample whose k-th neighbour is no farther than the expected distance.
QUANTILE = 0.7
#: Parts in which equal vectors are first thinned out.
SALTS = 1024


@dataclass
class Tables:
    projections: np.ndarray  # tables x hashes x dimension
    shifts: np.ndarray
    width: float
    near: float
    success: float

    def places(self, x: np.ndarray) -> np.ndarray:
        """Projections in units of the bucket width; rows x tables x hashes."""
        return (np.einsum("nd,lmd->nlm", x, self.projections) + self.shifts) / self.width

    def probes(self, place: np.ndarray) -> list[tuple[int, ...]]:
        """Buckets of one table in order of their estimated success, until that reaches what each table owes."""
        sigma, home = self.near / self.width, np.floor(place).astype(int)
        cdf = lambda z: 0.5 * (1 + math.erf(z / (sigma * math.sqrt(2))))
        choices: list[list[tuple[float, int]]] = []
        reach = max(1, math.ceil(3 * sigma))
        for p, h in zip(place.tolist(), home.tolist(), strict=True):
            chance = [(cdf(h + d + 1 - p) - cdf(h + d - p), h + d) for d in range(-reach, reach + 1)]
            choices.append(sorted(((-math.log(c), b) for c, b in chance if c > 1e-9), key=lambda x: x[0]))
        wanted = 1 - (1 - self.success) ** (1 / len(self.projections))
        first = (0,) * len(choices)
        heap, seen, got, out = [(sum(c[0][0] for c in choices), first)], {first}, 0.0, []
        while heap and got < wanted:
            cost, at = heapq.heappop(heap)
            got += math.exp(-cost)
            out.append(tuple(c[i][1] for c, i in zip(choices, at, strict=True)))
            for j, i in enumerate(at):
                if i + 1 < len(choices[j]):
                    to = (*at[:j], i + 1, *at[j + 1 :])
                    if to not in seen:
                        seen.add(to)
                        heapq.heappush(heap, (cost - choices[j][i][0] + choices[j][i + 1][0], to))
        return out


def fit(sample: np.ndarray, rows: int, k: int, *, tables: int, success: float, seed: int = 0) -> Tables:
    """Tables for so many rows like the sample's."""
    r = np.random.default_rng(seed)
    hashes = max(2, min(64, round(math.log(max(rows / OCCUPANCY, 2)) / math.log(BINS))))
    projections = r.normal(size=(tables, hashes, sample.shape[1]))
    spread = float(np.sqrt(((sample - sample.mean(axis=0)) ** 2).sum(axis=1).mean())) or 1.0
    some = sample[: min(200, len(sample))]
    apart = np.sqrt(np.maximum(((some[:, None] - sample[None]) ** 2).sum(axis=2), 0))
    nth = min(k, len(sample) - 1)
    near = float(np.quantile(np.partition(apart, nth, axis=1)[:, nth], QUANTILE)) if nth else spread
    width = 3.3 * spread / BINS
    return Tables(projections, r.uniform(0, width, (tables, hashes)), width, max(near, 1e-6 * spread), success)


def nearest(ids: np.ndarray, x: np.ndarray, query: int, q: np.ndarray, k: int, *, repeated: bool = False) -> list[tuple[float, int]]:
    """The k nearest of the ids to the query, without itself: (distance, id). repeated: some ids have several rows."""
    d = np.sqrt(np.square(x - q).sum(axis=1))
    d[ids == query] = np.inf
    if repeated:
        order = np.lexsort((d, ids))
        ids, first = np.unique(ids[order], return_index=True)
        d = d[order][first]
    if len(d) > k:
        some = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
    else:
        some = np.arange(len(d))
    return sorted((float(d[i]), int(ids[i])) for i in some if d[i] < np.inf)[:k]


def valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<double>) of the rows that take part."""
    v = df[vector_col].cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(df[id_col].cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(sound)
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (length.n if length else 0)).distinct()


def _vectors(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy().reshape(n, -1) if n else np.zeros((0, 0))


def _bucketed(df: DataFrame, t: Tables, probing: bool) -> DataFrame:
    """(slot, bucket, id, v) of the buckets where rows lie, or that queries visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                places = t.places(_vectors(part.column(1)))
                rows = [(i, slot, b) for i in range(len(places)) for slot in range(len(t.projections)) for b in (t.probes(places[i, slot]) if probing else [tuple(np.floor(places[i, slot]).astype(int).tolist())])]
                take = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int32()), pa.array([",".join(map(str, r[2])) for r in rows], pa.string()), part.column(0).take(take), part.column(1).take(take)], ["slot", "bucket", "id", "v"])

    return df.mapInArrow(run, "slot int, bucket string, id long, v array<double>")


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k nearest of each block to each query that visits it. rows: slot, bucket, block, role (0: row, 1: query), id, v; one block is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, held, ready, repeated = None, [], [], None, False
        for batch in batches:
            out: list[tuple[int, int, float]] = []
            keys = zip(*(batch.column(c).to_pylist() for c in range(4)), batch.column(4).to_pylist(), strict=True)
            x = _vectors(batch.column(5))
            for r, (*now, role, i) in enumerate(keys):
                if now != key:
                    key, ids, held, ready = now, [], [], None
                if role == 0:
                    ids.append(i)
                    held.append(x[r].copy())
                elif ids:
                    if ready is None:
                        ready, repeated = (np.array(ids), np.array(held)), len(set(ids)) < len(ids)
                    out += [(i, vec, d) for d, vec in nearest(*ready, i, x[r], k, repeated=repeated)]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True) if out else [[]] * 3, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    dealt = rows.repartition("slot", "bucket", "block").sortWithinPartitions("slot", "bucket", "block", "role")
    return dealt.select("slot", "bucket", "block", "role", "id", "v").mapInArrow(run, "query_id long, vec_id long, score double")


def _against_all(rows: DataFrame, folder: str, k: int) -> DataFrame:
    """As _ranked, of all rows and the queries (id, v) of a Parquet folder, of which a task reads one part after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = filesystem(folder)
        names = sorted(f.path for f in files.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet"))

        def out(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, x = np.concatenate([b.column(0).to_numpy() for b in held]), np.concatenate([_vectors(b.column(1)) for b in held])
            repeated = len(np.unique(ids)) < len(ids)
            for name in names:
                with files.open_input_file(name) as f:
                    for part in pq.ParquetFile(f).iter_batches(QUERY_BLOCK):
                        found = [(i, vec, d) for i, q in zip(part.column(0).to_pylist(), _vectors(part.column(1)), strict=True) for d, vec in nearest(ids, x, i, q, k, repeated=repeated)]
                        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*found, strict=True) if found else [[]] * 3, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= HELD_ROWS:
                yield from out(held)
                held = []
        if held:
            yield from out(held)

    return rows.mapInArrow(run, "query_id long, vec_id long, score double")


def _merged(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest that were found."""
    each = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(df: DataFrame, *, k: int = 10, every: int = 100, tables: int = 3, success: float = 0.9, sample_rows: int = 2000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by every, the nearest other rows by Euclidean distance."""
    spark = df.sparkSession
    bound_batches(spark)
    with scratch(spark) as keep:
        rows = saved(valid(df, id_col, vector_col), "vectors")
        n = rows.select("id").distinct().count()
        queries = rows.filter(F.col("id") % every == 0)
        if n < 2:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        thin = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
        for keys in (["v", "salt"], ["v"]):
            thin = thin.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).filter(F.col("nth") <= k + 1)
        thin = saved(thin.select("id", "v", "nth"), "thin")
        sample = np.array([r.v for r in thin.filter("nth = 1").orderBy(F.xxhash64("v"), "id").limit(sample_rows).collect()])
        t = fit(sample, n, k, tables=tables, success=success)
        index = saved(_bucketed(thin.select("id", "v"), t, False), "index")
        blocks = index.groupBy("slot", "bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
        own = salted(index, blocks, ["slot", "bucket"], ["id"]).select("slot", "bucket", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("role"), "id", "v")
        visits = _bucketed(queries, t, True).join(blocks, ["slot", "bucket"]).select("slot", "bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"), "id", "v")
        found = saved(_merged(_ranked(own.unionByName(visits), k), k), "found")
        full = found.groupBy("query_id").count().filter(F.col("count") >= min(k, n - 1)).select(F.col("query_id").alias("id"))
        folder = fresh_path(spark, "short")
        queries.join(full, "id", "left_anti").select("id", "v").write.parquet(folder)
        short = spark.read.schema(queries.schema).parquet(folder)
        if short.isEmpty():
            return keep(found)
        rest = _merged(_against_all(rows.select("id", "v"), folder, k), k)
        return keep(found.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").select("query_id", "rank", "vec_id", "score").unionByName(rest))
