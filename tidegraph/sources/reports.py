"""The text report of a run, and sinks for histograms, orders and unordered edges."""

from __future__ import annotations

import time
from typing import Any

from pyspark.sql import DataFrame

from tidegraph.storage import filesystem


def file_name(kind: str, name: str, cuts: str, batch: int, scale: float) -> str:
    return f"{kind}-{name}-inc-{cuts.split(' ')[-1]}-bat-{batch}-r-{scale:.1f}-{int(time.time())}.txt"


def text(result: Any) -> str:
    """Sections of facts and histograms; histograms have a row for each size."""
    lines = []
    for title, facts in (("general", result.general), ("static", result.static), ("dynamic", result.dynamic)):
        lines += [f"== {title}", *(f"{k}: {v}" for k, v in facts.items()), ""]
    for title, df in (("static components", result.static_histogram), ("dynamic components", result.dynamic_histogram)):
        lines.append(f"== {title}: size, count")
        if df is not None:
            lines += [f"{r['size']}\t{r['cnt']}" for r in df.orderBy("size").toLocalIterator()]
        lines.append("")
    return "\n".join(lines)


def write(result: Any, folder: str, name: str) -> str:
    body = text(result)
    files, path = filesystem(folder)
    files.create_dir(path, recursive=True)
    with files.open_output_stream(f"{path}/{name}") as f:
        f.write(body.encode())
    return body


def write_histogram(df: DataFrame, path: str) -> None:
    """size and count, tab-separated, in ascending order."""
    df.select("size", "cnt").orderBy("size").write.mode("overwrite").option("sep", "\t").csv(path)


def write_unordered(classed: DataFrame, path: str) -> None:
    """Edges from older to newer nodes, tab-separated."""
    classed.filter("edge_class = 'unorder'").select("src", "dst").write.mode("overwrite").option("sep", "\t").csv(path)


def show_order(order: DataFrame, n: int = 20) -> str:
    """The first components in the order of their ranks."""
    return "\n".join(f"{r['rank']}\t{r.component}" for r in order.orderBy("rank").limit(n).collect())


def write_order(order: DataFrame, path: str) -> None:
    """rank and component, tab-separated, in the order of the ranks."""
    order.select("rank", "component").repartitionByRange("rank").sortWithinPartitions("rank").write.mode("overwrite").option("sep", "\t").csv(path)


def write_components(members: DataFrame, path: str) -> None:
    """component and node, tab-separated, component by component."""
    members.select("component", "id").repartitionByRange("component", "id").sortWithinPartitions("component", "id").write.mode("overwrite").option("sep", "\t").csv(path)
