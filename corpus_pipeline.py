"""A corpus run: toxicity, quality, near duplicates, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame; ``run`` writes
each one's rows as Parquet in the folder that the cluster shares, and reads them again as the next one's docs.

Columns that documents has besides its own stay until the last stage, whatever their names. A null text counts as empty;
an empty or wordless text is scored like any other by the first two stages, is nobody's copy, holds no benchmark item,
and has no ids. Texts of any length are whole. Rows with a null id are no copies of anything and stay there. Rows with
one id and different texts are judged each for itself, of equal ones the third stage keeps one. An empty table gives an empty result, and so does one of which nothing is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm import bpe, decontamination, ngram_join, quality, toxicity
from tidegraph.llm.common import saved, scratch
from tidegraph.llm.queries import BYTE_BPE, site_of, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model rejects go."""
    labels = table(spark, sf_dir, "labels")
    model = quality.train(docs, labels)
    return quality.keep_good(docs, quality.sites(docs, labels, model, *site_of(docs)), model, *site_of(docs))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, by 5-word shingles and a similarity of 0.8, the document with the smallest id stays."""
    return ngram_join.first_of_groups(docs, k=5, num=80, den=100)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages, by the contamination rule, go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of what is left, and whether they decode to the text."""
    done = bpe.encode_and_decode(docs, BYTE_BPE)
    return done.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", without_toxic), ("quality", of_quality), ("near_copies", without_near_copies), ("decontamination", without_benchmark), ("bpe", tokenised)]
#: The models of the first two stages have no SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with scratch(spark) as keep:  # only the last stage's rows stay
        for name, stage in STAGES[:-1]:
            docs = saved(stage(spark, docs, sf_dir), name)
        name, stage = STAGES[-1]
        return keep(stage(spark, docs, sf_dir), name)
