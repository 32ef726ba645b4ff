"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm import ann, bpe, decontamination, fill_in_middle, hard_negatives, ngram_join, quality, sharding, simhash, token_counts, toxicity, url_filter, warc
from tidegraph.llm.common import fresh_path
from tidegraph.llm.oracles import ORACLES

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
__all__ = ["ORACLES", "QUERIES", "site_of", "table"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document, decode the ids, and digest both."""
    done = bpe.encode_and_decode(table(spark, sf_dir, "documents"), BYTE_BPE)
    ids = F.concat_ws(",", F.col("token_ids").cast("array<string>"))
    return done.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents by 4-word shingles and a similarity of 0.85, and the number of links of every document."""
    return ngram_join.jaccard_links(table(spark, sf_dir, "documents"), k=4, num=85, den=100).withColumnRenamed("component", "component_id")


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, against a context of 1024 tokens."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), BYTE_BPE, limit=1024)


@query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of near-equal bytes."""
    done = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 8)
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document, by 13-word windows and a coverage of one word in twenty."""
    found = decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def site_of(docs: DataFrame) -> tuple[F.Column, F.Column]:
    """Host and path of a document: its source, and the section of its language."""
    return docs["source"], docs["lang"]


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence, site posterior and decision of every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels)
    return quality.judge(docs, quality.sites(docs, labels, model, *site_of(docs)), model, *site_of(docs))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


#: The url rules of the query, by verdict.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


@query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and, beyond them, the n-gram model, on every page's url."""
    labelled = spark.createDataFrame([(u, 1) for u in url_filter.BLOCKED] + [(u, 0) for u in url_filter.ALLOWED], "url string, blocked int")
    return url_filter.judge(table(spark, sf_dir, "pages"), [url_filter.rule(*r) for r in URL_RULES], url_filter.train(labelled))


@query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page, normalise the archives, and read them back."""
    folder = fresh_path(spark, "warc")
    archives = warc.archive(table(spark, sf_dir, "pages"), folder)
    return warc.read(archives.select("file"), f"{folder}/warc").withColumnRenamed("id", "page_id")


@query
def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all other vectors to every hundredth."""
    return ann.search(table(spark, sf_dir, "embeddings"))


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document transformed, or plain, and rebuilt."""
    done = fill_in_middle.restored(fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents")))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.col("restored.sha256").alias("restored_sha256"))


@query
def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of near copies of every document."""
    return simhash.near_copies(table(spark, sf_dir, "documents")).withColumnRenamed("component", "component_id")


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; of every seventh, the label is the next one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), label=label)
