"""Connected components of an undirected edge table, by contraction."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyraster.llm.common import cut, drop


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """(node, label) for every node of edges(u, v): equal labels, the same component.

    Each round gives a node the smallest of itself and its neighbours, and goes on with the edges
    between different labels; node ids are hashes, so a round leaves at most about half the
    nodes, and a star none. All of it stays in tables, which shrink round by round; hot nodes are
    only summed over (partial aggregation) or split by the joins.
    """
    edges = cut(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct(), f"{folder}/{name}-edges")
    out = None
    for k in itertools.count():  # the smallest node of a component is never left over, so this ends
        both = edges.union(edges.select("v", "u"))
        labels = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label"))
        labels = cut(labels, f"{folder}/{name}-labels-{k}")
        step = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        before, out = out, labels if out is None else cut(out.join(step, "label", "left").select("node", F.coalesce("further", "label").alias("label")), f"{folder}/{name}-components-{k}")
        from_, to = (labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}2")) for c in "uv")
        left = edges.join(from_, "u").join(to, "v").where("u2 <> v2").select(F.least("u2", "v2").alias("u"), F.greatest("u2", "v2").alias("v")).distinct()
        done, edges = edges, cut(left, f"{folder}/{name}-edges-{k}")
        for table in (done, before, labels):
            if table is not None and table is not out:
                drop(table)
        if edges.isEmpty():
            return out
