"""Command line: python -m tidegraph -f FOLDER -t TYPE -a NAME ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tidegraph.plans.registry import Config, report, run
from tidegraph.sources.graphs import EDGE_FILE, NODE_FILE


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tidegraph")
    p.add_argument("-f", "--data-folder", required=True)
    p.add_argument("-t", "--algo-type", required=True)
    p.add_argument("-a", "--algo-name", required=True)
    p.add_argument("-n", "--graph-node", type=int, default=None)
    p.add_argument("-p", "--insert-type", default="")
    p.add_argument("-l", "--insert-file", default="")
    p.add_argument("-d", "--node-name", default=NODE_FILE)
    p.add_argument("-g", "--edge-name", default=EDGE_FILE)
    p.add_argument("-b", "--batch-size", type=int, default=1)
    p.add_argument("-c", "--inc-percentage", type=float, default=0)
    p.add_argument("-s", "--simplify-dataset", type=lambda x: x.lower() in ("1", "true", "yes"), default=False)
    p.add_argument("-r", "--scale-factor", type=float, default=1)
    a = p.parse_args(argv)
    c = Config(a.data_folder, a.algo_type, a.algo_name, a.insert_type, a.insert_file, a.node_name, a.edge_name, a.batch_size, a.inc_percentage, a.simplify_dataset, a.scale_factor, nodes=a.graph_node)
    print(c)
    spark = SparkSession.builder.getOrCreate()
    print(report(run(spark, c), c, a.data_folder))


if __name__ == "__main__":
    main()
