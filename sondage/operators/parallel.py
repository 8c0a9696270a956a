"""Parallel analysis: how many components columns have that shuffled columns don't.

Each original column is permuted on its own, with all its encoded columns together, and
a component is kept while its eigenvalue beats the ``q`` quantile of those of permuted
data (Buja & Eyuboglu 1992; the quantile is Glorfeld's, 1995), from the first.

Rows are dealt by a hash of their key to strata of about ``STRATUM`` rows, and columns
are permuted within each; the tasks add up cross products of all ``B`` replicates in one
pass. Up to one stratum that permutes whole columns. Beyond, it is a subgroup of the
permutations, under which the columns' independence is tested exactly, too: what stays
of their relation between strata, which are random, is one part in ``STRATUM``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.plans.shared import in_parts

STRATUM = 1 << 15


@dataclass
class Parallel:
    """``table`` has (dim, eigenvalue, threshold, beats)."""

    table: pd.DataFrame
    ndim: int


def dealt(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``rows`` with a random stratum, and a number that orders them within it."""
    place = F.xxhash64(F.lit(seed), key)
    return rows.withColumns({"stratum": F.pmod(place, F.lit(max(1, -(-n // STRATUM)))), "place": place})


def permuted_grams(rows: DataFrame, key: str, cols: Sequence[str], owner: Sequence[str], n: int, B: int, seed: int) -> np.ndarray:
    """(B + 1) matrices of cross products: of the columns as they are, then permuted."""
    p, blocks = len(cols), [np.flatnonzero(np.array(owner) == o) for o in dict.fromkeys(owner)]

    def products(t: pa.Table) -> pa.Table:
        stratum = t["stratum"][0].as_py()
        x = np.column_stack([t[c].to_numpy() for c in cols])
        # the same order wherever the rows come from
        x = x[np.lexsort((*x.T, t["place"].to_numpy()))]
        out = [(x.T @ x).ravel()]
        for b in range(B):
            rng = np.random.default_rng([seed, b, stratum])
            y = x.copy()
            for at in blocks:
                y[:, at] = x[rng.permutation(len(x))][:, at]
            out.append((y.T @ y).ravel())
        return pa.table({"b": pa.array(range(B + 1), pa.int32()), "v": pa.array([o.tolist() for o in out], pa.list_(pa.float64()))})

    few = dealt(rows.select(key, *[F.col(c).cast("double").alias(c) for c in cols]), key, n, seed).drop(key)
    each = in_parts(few, "stratum", -(-n // STRATUM)).groupBy("stratum").applyInArrow(products, "b int, v array<double>").select("b", F.posexplode("v").alias("at", "v"))
    out = np.zeros((B + 1, p * p))
    for r in each.groupBy("b", "at").agg(F.sum("v").alias("v")).collect():
        out[r.b, r["at"]] = r.v
    return out.reshape(B + 1, p, p)


def parallel_analysis(rows: DataFrame, key: str, cols: Sequence[str], n: int, owner: Sequence[str] | None = None, B: int = 30, q: float = 0.95, seed: int = 1, most: int | None = None) -> Parallel:
    """Of columns whose mean is zero; ``owner`` names the original column of each. At
    least one dimension is kept, and ``most`` at most."""
    grams = permuted_grams(rows, key, cols, owner or cols, n, B, seed)
    values = np.maximum(np.sort(np.linalg.eigvalsh(grams / n), axis=1)[:, ::-1], 0)
    real, limit = values[0], np.quantile(values[1:], q, axis=0)
    k = min(most or len(cols), len(cols), n)
    beats = real[:k] > limit[:k]
    ndim = k if beats.all() else int(np.argmin(beats))
    table = pd.DataFrame({"dim": np.arange(1, k + 1), "eigenvalue": real[:k], "threshold": limit[:k], "beats": beats})
    return Parallel(table, max(1, ndim))
