"""Connected components of an edge table, by rounds of joins.

Each round hooks a node's parent, and the node itself, under the smallest parent
among its neighbours and then replaces parents by grandparents, so rounds grow
with the logarithm of the longest path. Minima are partial aggregates and the
joins have no ordering above them, so a node with very many neighbours is
combined before the shuffle or split by adaptive execution. Each round is
written to the shared folder; only a count of changes comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.plans.shared import materialize


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within a batch, edges become (node, smallest node it reaches): fewer edges, same components."""
    for b in batches:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := up.setdefault(x, x)) != x:
                up[x] = x = up[p]
            return x

        for u, v in zip(b["u"].to_pylist(), b["v"].to_pylist(), strict=True):
            x, y = root(u), root(v)
            if x != y:
                up[max(x, y)] = min(x, y)
        rows = [(x, root(x)) for x in up]
        rows = [r for r in rows if r[0] != r[1]]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["u", "v"])


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """From edges (u, v) of longs: (node, root) for every node that has an edge,
    root being the smallest node of its component."""
    edges = materialize(edges.select("u", "v").where("u <> v").mapInArrow(_stars, "u long, v long"), "cc-edges")
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    both = materialize(both, "cc-both")
    label = materialize(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("root")), "cc-labels")
    for _ in range(most_rounds):
        near = both.join(label.select(F.col("node").alias("v"), "root"), "v").groupBy("u").agg(F.min("root").alias("m"))
        hooks = label.join(near, label.node == near.u).select(F.explode(F.array(F.struct(F.col("node").alias("n"), "m"), F.struct(F.col("root").alias("n"), "m"))).alias("x"))
        least = hooks.groupBy(F.col("x.n").alias("node")).agg(F.min("x.m").alias("m"))
        hooked = materialize(label.join(least, "node", "left").select("node", F.least("root", F.coalesce("m", "root")).alias("root"), F.col("root").alias("was")), "cc-hooked")
        after = hooked.join(hooked.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
        label = materialize(after.select("node", F.least("root", F.coalesce("top", "root")).alias("root"), "was"), "cc-labels")
        if label.where("root <> was").isEmpty():
            return label.select("node", "root")
        label = label.select("node", "root")
    raise RuntimeError(f"components still change after {most_rounds} rounds")
