"""Principal components of mixed data (Pagès 2004), from one Gram matrix.

Numbers are standardised, with missing ones at the mean; a category is its
indicator minus its share over the root of the share, and a missing one is zero
everywhere. Z'Z/n is added up in the tasks and decomposed on the driver; its size
is the number of columns and levels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.operators.counts import missing
from sondage.operators.describe import finite
from sondage.operators.glrm import Glrm, rotated
from sondage.operators.glrm import glrm as low_rank
from sondage.operators.linalg import matrix_sum, project
from sondage.operators.select import class_of
from sondage.operators.timecode import encode as encode_time

MOST_LEVELS = 200


@dataclass
class Reduction:
    method: str
    eig: pd.DataFrame
    coords: DataFrame
    contrib: pd.DataFrame
    vectors: np.ndarray
    n: int
    #: Of a low-rank model: the model, and the dimensions that were fitted, of which ``eig`` has those that carry variation.
    fit: Glrm | None = None
    fitted: int | None = None
    #: The cycles of time columns that were used.
    cycles: dict[str, list[str]] = field(default_factory=dict)

    @property
    def note(self) -> str:
        """Which of the fitted dimensions carry no variation."""
        if self.fitted is None or len(self.eig) == self.fitted:
            return ""
        first, last = len(self.eig) + 1, self.fitted
        return f"dimension {first} of {last} carries no variation" if first == last else f"dimensions {first} to {last} carry no variation"


def encode(df: DataFrame, key: str, names: Sequence[str]) -> tuple[DataFrame, list[tuple[str, str | None]]]:
    """(key, z0, z1, ...) and what each z is: (column, level or None)."""
    numbers = [c for c in names if class_of(df.schema[c].dataType) == "numeric"]
    factors = [c for c in names if c not in numbers]
    aggs = [F.struct(F.avg(finite(c)).alias("m"), F.stddev_pop(finite(c)).alias("s"), F.count(finite(c)).alias("k")).alias(f"n{i}") for i, c in enumerate(numbers)]
    stats = df.agg(F.count("*").alias("n"), *aggs).first()
    cells: list[Column] = []
    what: list[tuple[str, str | None]] = []
    for i, c in enumerate(numbers):
        m, s, held = stats[f"n{i}"]
        sd = s
        if m is None or not s:
            continue
        if held < stats["n"]:  # missing values at the mean shrink the spread
            sd = s * (held / stats["n"]) ** 0.5
        cells.append(F.coalesce((finite(c) - F.lit(m)) / F.lit(sd), F.lit(0.0)))
        what.append((c, None))
    for c in factors:
        levels = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("l")).agg(F.count("*").alias("n")).orderBy("l").limit(MOST_LEVELS + 1).collect()
        if len(levels) > MOST_LEVELS:
            raise ValueError(f"{c} has more than {MOST_LEVELS} levels")
        for r in levels:
            p = r.n / stats["n"]
            cells.append(((F.coalesce(F.col(c).cast("string") == F.lit(r.l), F.lit(False))).cast("double") - F.lit(p)) / F.lit(p**0.5))
            what.append((c, r.l))
    return df.select(key, *[x.alias(f"z{i}") for i, x in enumerate(cells)]), what


def reduce(df: DataFrame, key: str, names: Sequence[str], ndim: int = 5, time: str = "cycles", method: str = "famd", **fit) -> Reduction:
    """pca, mca or famd by the classes of the columns, or the rotation of a low-rank model
    (``method="glrm"``, with the model's own arguments). A dimension's sign makes its
    largest loading positive. Time columns become numbers as ``timecode.encode`` says."""
    if method == "glrm":
        return reduce_glrm(df, key, names, ndim, time, **fit)
    if method != "famd" or fit:
        raise ValueError(f"the method is famd or glrm, and only glrm takes {sorted(fit)}" if fit else f"the method is famd or glrm, not {method!r}")
    coded = encode_time(df, key, names, time)
    df, names = coded.df, coded.names
    kinds = {class_of(df.schema[c].dataType) for c in names}
    method = "pca" if kinds == {"numeric"} else "famd" if "numeric" in kinds else "mca"
    z, what = encode(df, key, names)
    cols = z.columns[1:]
    if not cols:
        raise ValueError("no column varies")
    got = matrix_sum(z, cols, lambda x: np.vstack([x.T @ x, x.sum(0), np.full((1, x.shape[1]), len(x))]))
    n = int(got[-1, 0])
    mean = got[-2] / n
    gram = got[:-2] / n - np.outer(mean, mean)
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(-values)
    values, vectors = values[order], vectors[:, order]
    keep = values > 1e-10 * max(values[0], 1e-300)
    total = values[keep].sum()
    k = int(min(max(2, ndim), keep.sum()))
    values, vectors = values[:k], vectors[:, :k]
    top = np.abs(np.round(vectors, 12)).argmax(0)
    vectors = vectors * np.sign(vectors[top, np.arange(k)])
    coords = project(z, key, cols, lambda x: (x - mean) @ vectors, [f"dim{i + 1}" for i in range(k)])
    rows = []
    for c in names:
        at = [i for i, (name, _) in enumerate(what) if name == c]
        for d in range(k):
            # the share of a coordinate's variance that the column explains
            w = gram[at] @ vectors[:, d]
            rows.append((c, d + 1, float((w**2).sum() / values[d])))
    pct = 100 * values / total
    eig = pd.DataFrame({"dim": np.arange(1, k + 1), "eigenvalue": values, "pct_var": pct, "cum_pct_var": np.cumsum(pct)})
    return Reduction(method, eig, coords, pd.DataFrame(rows, columns=["variable", "dim", "sqload"]), vectors, n, cycles=coded.used)


def reduce_glrm(df: DataFrame, key: str, names: Sequence[str], ndim: int = 5, time: str = "cycles", **fit) -> Reduction:
    """A low-rank model's product of scores and archetypes, rotated to orthogonal
    dimensions; it and what it reconstructs stay the same. ``pct_var`` is a dimension's
    share of the variation of the numeric columns (quadratic and Poisson losses),
    ``pct_categorical`` its share of what was fitted to categories, which have no scale
    in common with their indicators. Loadings' squares sum to one a dimension."""
    coded = encode_time(df, key, names, time)
    m = low_rank(coded.df, key, coded.names, rank=ndim, **fit)
    turn = rotated(m)
    enc, k = m.encoding, turn.kept
    number = np.isin(enc.loss.kind, ["quadratic", "poisson"])
    cells = [F.coalesce(c, F.lit(0.0)) for c, is_number in zip(enc.cells, number, strict=True) if is_number]
    row = coded.df.agg(F.count("*").alias("n"), *[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(cells)]).first()
    n, size = row["n"], turn.values**2

    def part(of: np.ndarray) -> np.ndarray:
        return size * (turn.vectors[of] ** 2).sum(0) if of.any() else np.full(k, np.nan)

    total = n * sum(row[i + 1] or 0.0 for i in range(len(cells)))
    pct, categories = 100 * part(number) / max(total, np.finfo(float).eps), part(~number)
    share = 100 * categories / max(np.nansum(categories), np.finfo(float).eps)
    eig = pd.DataFrame({"dim": np.arange(1, k + 1), "eigenvalue": size, "pct_var": pct, "cum_pct_var": np.cumsum(pct), "pct_categorical": share, "cum_pct_categorical": np.cumsum(share)})
    squares = turn.vectors**2
    rows = [(c, d + 1, float(squares[[i for i, o in enumerate(enc.of) if o == c], d].sum())) for d in range(k) for c in dict.fromkeys(enc.of)]
    to = m.archetypes.T @ turn.vectors
    dims = [f"dim{i + 1}" for i in range(m.archetypes.shape[1])]
    coords = project(m.scores, key, dims, lambda x: (x - turn.mean) @ to, [f"dim{i + 1}" for i in range(k)])
    return Reduction("glrm", eig, coords, pd.DataFrame(rows, columns=["variable", "dim", "sqload"]), turn.vectors, n, m, turn.fitted, coded.used)


def na_markers(df: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """present/missing markers of partly missing columns."""
    row = df.agg(F.count("*").alias("n"), *[F.count_if(missing(df, c)).alias(f"c{i}") for i, c in enumerate(names)]).first()
    use = [c for i, c in enumerate(names) if 0 < row[i + 1] < row["n"]]
    if len(use) < 2:
        raise ValueError("at least two columns must be partly missing")
    return df.select(key, *[F.when(missing(df, c), "missing").otherwise("present").alias(c) for c in use])


def reduce_na(df: DataFrame, key: str, names: Sequence[str], ndim: int = 5) -> Reduction:
    marks = na_markers(df, key, names)
    return reduce(marks, key, marks.columns[1:], ndim)
