"""Reading dated graphs: tab-separated files, and the graphs made of the parts and line items tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions.edges import YEAR_GAP, dated, within_gap, without_loops
from tidegraph.functions.order import numbered

#: The default file names of nodes, edges, and increments by kind of insertion.
NODE_FILE, EDGE_FILE = "indpyear.txt", "indpp_refine.txt"
INCREMENT_FILES = {"seq": "inc_s30.txt", "rand": "inc_r30.txt", "comb": "inc_c30.txt", "": ""}


def _lines(spark: SparkSession, path: str, first: str, second: str, stop_at_blank: bool) -> DataFrame:
    """(line, first, second) of a file, or a folder of them, of two tab-separated numbers; line (file, n) gives the order. stop_at_blank: nothing after an empty line counts."""
    text = spark.read.option("wholetext", False).text(path).select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n")).alias("line"))
    if stop_at_blank:
        end = text.filter("trim(value) = ''").agg(F.min("line")).first()[0]
        if end is not None:
            text = text.filter((F.col("line.file") < end.file) | (F.col("line.file") == end.file) & (F.col("line.n") < end.n))
    pair = F.split("value", "\t")
    return text.filter("trim(value) <> ''").select("line", pair[0].cast("long").alias(first), F.trim(pair[1]).cast("long").alias(second))


def write_pairs(df: DataFrame, path: str, *order: str) -> None:
    """The two columns of df as tab-separated lines; files are named in the order of the given columns, and so are their lines."""
    first, second = (c for c in df.columns if c not in order or len(df.columns) == 2)
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    rows.select(F.concat_ws("\t", F.col(first), F.col(second)).alias("value")).write.text(path)


def read_nodes(spark: SparkSession, path: str, *, stop_at_blank: bool = False) -> DataFrame:
    """(id, year); of rows with one id, the last one counts."""
    rows = _lines(spark, path, "id", "year", stop_at_blank)
    return rows.groupBy("id").agg(F.max_by("year", "line").alias("year"))


def year_range(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count(F.lit(1)).alias("n_nodes"), F.min("year").alias("min_year"), F.max("year").alias("max_year"))


def read_edges(spark: SparkSession, path: str, nodes: DataFrame | None = None, *, simplify: bool = False, gap: int = YEAR_GAP, stop_at_blank: bool = False) -> DataFrame:
    """(src, dst) without loops; simplify drops edges from older to much newer nodes. Parallel edges stay."""
    rows = without_loops(_lines(spark, path, "src", "dst", stop_at_blank))
    if simplify:
        if nodes is None:
            raise ValueError("simplify needs nodes")
        rows = dated(rows, nodes).filter(within_gap(gap))
    return rows.select("src", "dst")


def read_increment(spark: SparkSession, path: str, nodes: DataFrame | None = None, *, simplify: bool = False, stop_at_blank: bool = False) -> DataFrame:
    """(seq, src, dst), numbered from 0 in the file's order. Only lines' numbers meet in one task."""
    rows = without_loops(_lines(spark, path, "src", "dst", stop_at_blank))
    if simplify:
        rows = dated(rows, nodes).filter(within_gap()).select("line", "src", "dst")
    return numbered(rows, "line", name="seq").select((F.col("seq") - 1).alias("seq"), "src", "dst")


def increment_name(name: str, kind: str) -> str:
    """An increment's file: the one named, else that of the kind; no kind, no file."""
    if name:
        return name
    if kind not in INCREMENT_FILES:
        raise ValueError(f"unknown kind of insertion: {kind}")
    return INCREMENT_FILES[kind]


def local_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (id, year), raw edges (src, dst, b) with loops and parallels, and distinct edges (src, dst, b): parts that cite near ones."""
    part, item = spark.read.parquet(f"{sf_dir}/part.parquet"), spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    n = part.count()
    nodes = part.select(F.col("p_partkey").cast("long").alias("id"), F.expr(f"1980 + (p_partkey * 40) div {n}").cast("long").alias("year"))
    back = item.filter("l_orderkey % 17 = 0").selectExpr("cast(l_partkey as long) as src", "cast(l_partkey - 1 - (l_orderkey*7 + l_suppkey*13 + l_linenumber) % 80 as long) as dst", "cast(l_orderkey % 10 as long) as b")
    ahead = item.filter("l_orderkey % 31 = 1").selectExpr("cast(l_partkey as long) as src", "cast(l_partkey + 1 + (l_orderkey*5 + l_suppkey*11 + l_linenumber) % 12 as long) as dst", "cast(l_orderkey % 10 as long) as b")
    raw = back.unionByName(ahead).filter(f"dst >= 0 and dst < {n}")
    return nodes, raw, without_loops(raw).groupBy("src", "dst").agg(F.min("b").alias("b"))


def long_range_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, year) and distinct edges (src, dst) with wide gaps of years."""
    part, item = spark.read.parquet(f"{sf_dir}/part.parquet"), spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    nodes = part.select(F.col("p_partkey").cast("long").alias("id"), (1980 + F.col("p_size")).cast("long").alias("year"))
    raw = item.selectExpr("cast(l_partkey as long) as src", f"cast((l_orderkey*7 + l_suppkey*13 + l_linenumber) % {part.count()} as long) as dst", "l_orderkey as ok")
    ends = without_loops(raw)
    for end, year in (("src", "a"), ("dst", "b")):
        ends = ends.join(nodes.select(F.col("id").alias(end), F.col("year").alias(year)), end)
    return nodes, ends.filter("(a > b and ok % 23 = 0) or (a = b and ok % 3 = 0) or (a < b and ok % 115 = 0)").select("src", "dst").distinct()


def split_increment(edges: DataFrame, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """The starting graph (b of least or more) and the increment (seq, src, dst), in the order of b and the ends. Ranges are numbered apart."""
    rest = numbered(edges.filter(F.col("b") < least), "b", "src", "dst", name="seq")
    return edges.filter(F.col("b") >= least).select("src", "dst"), rest.select((F.col("seq") - 1).alias("seq"), "src", "dst")
