"""Standardised mean differences of groups from a reference group (Austin 2009; Yang & Dalton 2012)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.operators.describe import CHUNK, finite, keyed
from sondage.operators.levels import declared, first_present


def smd_numeric(df: DataFrame, by: str, names: list[str], reference=None, within: Sequence[str] = ()) -> DataFrame:
    """(within..., by, variable, smd): (m1 - m0) / sqrt((v1 + v0) / 2); the reference row
    is null. With modifiers in ``within``, groups are held against the reference group
    at the same levels; where it has no rows, all are null."""
    df = keyed(df, [*within, by])
    parts = []
    for at in range(0, len(names), CHUNK):
        chunk = names[at : at + CHUNK]
        row = df.groupBy(*within, by).agg(*[F.struct(F.lit(c).alias("variable"), F.avg(finite(c)).alias("m"), F.var_samp(finite(c)).alias("v")).alias(f"c{i}") for i, c in enumerate(chunk)])
        parts.append(row.select(*within, by, F.explode(F.array(*[F.col(f"c{i}") for i in range(len(chunk))])).alias("c")).select(*within, by, "c.*"))
    m = reduce(DataFrame.unionByName, parts)
    return _against(m, by, reference, (F.col("m") - F.col("m0")) / F.sqrt((F.col("v") + F.col("v0")) / 2), within)


def smd_binary(df: DataFrame, by: str, names: list[str], reference=None) -> DataFrame:
    """For two levels: the share of the second (in order) as above."""
    df = keyed(df, [by])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("x")) for c in names]))
    long = df.select(by, each.alias("c")).select(by, "c.*").where("x is not null")
    # of declared levels the second, else the later of those that occur
    given = {c: d.values[1] for c in names if (d := declared(df, c)) and len(d.values) > 1}
    top = F.max("x")
    for c, v in given.items():
        top = F.when(F.first("variable") == c, F.lit(v)).otherwise(top)
    # levels are counted where the rows are; a join of the rows would bring a variable's into one task
    counts = long.groupBy(by, "variable", "x").agg(F.count("*").alias("n"))
    second = counts.groupBy("variable").agg(top.alias("top"))
    p = counts.join(second, "variable").groupBy(by, "variable").agg((F.sum(F.when(F.col("x") == F.col("top"), F.col("n")).otherwise(0)) / F.sum("n")).alias("m"))
    p = p.withColumn("v", F.col("m") * (1 - F.col("m")))
    return _against(p, by, _reference(df, by, reference), (F.col("m") - F.col("m0")) / F.sqrt((F.col("v") + F.col("v0")) / 2))


def _reference(df: DataFrame, by: str, reference):
    """The group given, or the first declared level that occurs; None for the least value."""
    known = declared(df, by)
    if reference is not None or known is None:
        return reference
    there = {r[by] for r in df.where(F.col(by).isin(list(known.values))).select(by).distinct().collect()}
    return next((v for v in known.values if v in there), None)


def _against(m: DataFrame, by: str, reference, diff: Column, within: Sequence[str] = ()) -> DataFrame:
    if reference is None:
        reference = m.agg(F.min(by)).first()[0]
    base = m.where(F.col(by) == F.lit(reference)).select(*within, "variable", F.col("m").alias("m0"), F.col("v").alias("v0"))
    return m.join(base, [*within, "variable"], "left").select(*within, by, "variable", F.when(F.col(by) != F.lit(reference), diff).alias("smd"))


def smd_levels(df: DataFrame, by: str, col: str, reference=None) -> dict[object, float | None]:
    """For more than two levels: sqrt(d' S+ d) over the shares of all but one level."""
    t = keyed(df, [by]).where(F.col(col).isNotNull()).groupBy(by, col).agg(F.count("*").alias("n")).collect()
    groups, levels = sorted({r[by] for r in t}), sorted({r[col] for r in t})
    n = np.zeros((len(groups), len(levels)))
    for r in t:
        n[groups.index(r[by]), levels.index(r[col])] = r["n"]
    p = n / n.sum(1, keepdims=True)
    ref = groups.index(reference if reference is not None else first_present(df, by, groups)) if groups else 0
    out: dict[object, float | None] = {}
    for i, g in enumerate(groups):
        if i == ref:
            out[g] = None
            continue
        a, b = p[i, 1:], p[ref, 1:]
        s = sum(np.diag(x) - np.outer(x, x) for x in (a, b)) / 2
        out[g] = float(np.sqrt(max(0.0, (a - b) @ np.linalg.pinv(s, rcond=1e-12) @ (a - b))))
    return out


def describe_clusters(df: DataFrame, cluster: str, names: list[str] | None = None) -> dict[str, DataFrame | list[str]]:
    """``clusters``: sizes. ``cluster_vars``: columns with one value in every cluster;
    ``cluster_level``: their value for each; ``row_vars``: the others."""
    from sondage.operators.select import cols

    names = cols(df, names, by=[cluster])
    sizes = df.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.count("*").alias("k"))
    none = df.agg(F.count_if(F.col(cluster).isNull()).alias("n_no_cluster"))
    q = F.percentile("k", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")
    table = sizes.agg(F.count("*").alias("n_clusters"), F.sum("k").alias("n_rows"), F.avg("k").alias("rows_mean"), F.min("k").alias("rows_min"), q, F.max("k").alias("rows_max"))
    table = table.join(none, F.lit(True)).select(F.lit(cluster).alias("cluster"), "n_clusters", "n_rows", "n_no_cluster", "rows_mean", "rows_min", F.col("q")[0].alias("rows_p25"), F.col("q")[1].alias("rows_p50"), F.col("q")[2].alias("rows_p75"), "rows_max")
    inside = df.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(*[(F.coalesce(F.min(c) == F.max(c), F.lit(True))).alias(c) for c in names])
    flags = inside.agg(*[F.bool_and(c).alias(c) for c in names]).first()
    level = [c for c in names if flags[c]]
    firsts = df.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(*[F.min(c).alias(c) for c in level]) if level else sizes.select(cluster)
    return {"clusters": table, "cluster_level": firsts, "cluster_vars": level, "row_vars": [c for c in names if c not in level]}
