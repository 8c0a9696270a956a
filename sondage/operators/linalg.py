"""Sums over rows that are small matrices: each task adds up its rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Bins of a pass, and values that come to the driver in the last.
BINS, FETCHED = 2048, 20_000


def matrix_sum(df: DataFrame, cols: Sequence[str], f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """Sum over all rows of ``f``, which maps a block of rows to an array of fixed shape."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            x = np.column_stack([np.asarray(c, float) for c in b.columns]) if b.num_rows else None
            if x is not None:
                total = f(x) if total is None else total + f(x)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64())), pa.array([list(total.shape)], pa.list_(pa.int64()))], ["v", "shape"])

    parts = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).mapInArrow(run, "v array<double>, shape array<long>").collect()
    return sum(np.array(p.v).reshape(p.shape) for p in parts) if parts else None


def order_statistics(df: DataFrame, cols: Sequence[str], f: Callable[[np.ndarray], np.ndarray], ranks: Sequence[Callable[[int], Sequence[int]]]) -> tuple[list[np.ndarray], list[int]]:
    """Exact order statistics of values that are computed in the tasks: ``f`` maps a block
    of rows to one column of values for each of ``ranks``, which say for a count of values
    which ranks are wanted (from 0). NaN is left out. A histogram of fixed size is added up
    a pass, and each wanted rank's bin is cut finer in the next, until few enough values
    are left in it to be fetched. So nothing is sorted in one task, and nothing is stored."""
    side = np.r_[0.0, np.geomspace(1e-12, 1e12, BINS // 2)]
    first = np.r_[-np.inf, -side[:0:-1], side, np.inf]

    def count(edges: np.ndarray, column: np.ndarray) -> np.ndarray:
        """Values before, in and behind the bins of each of ``edges``."""

        def sums(a: np.ndarray) -> np.ndarray:
            values = f(a)
            out = np.zeros((len(edges), edges.shape[1] + 1))
            for i, (e, c) in enumerate(zip(edges, column.tolist(), strict=True)):
                x = values[:, c]
                out[i] = np.bincount(np.searchsorted(e, x[~np.isnan(x)], "right"), minlength=edges.shape[1] + 1)
            return out

        got = matrix_sum(df, cols, sums)
        return np.zeros((len(edges), edges.shape[1] + 1), np.int64) if got is None else got.astype(np.int64)

    held = count(np.tile(first, (len(ranks), 1)), np.arange(len(ranks)))
    sizes = held.sum(1).tolist()
    # a wanted rank: its column, its rank, the values before its window, those in it, and the window
    wanted = [[c, r, 0, sizes[c], -np.inf, np.inf] for c, want in enumerate(ranks) for r in (want(sizes[c]) if sizes[c] else [])]
    windows, edges = held[[w[0] for w in wanted]] if wanted else held[:0], [first] * len(wanted)
    while True:
        for w, h, e in zip(wanted, windows, edges, strict=True):
            if w[5] > w[4] and len(h):
                upto = w[2] + np.cumsum(h[1:-1])
                i = int(np.searchsorted(upto, w[1], "right"))
                w[2:] = [int(upto[i] - h[1 + i]), int(h[1 + i]), e[i], e[i + 1]]
        wide = [w for w in wanted if w[3] > FETCHED // max(1, len(wanted)) and w[5] > np.nextafter(w[4], np.inf)]
        if not wide:
            break
        cut = np.array([np.linspace(max(w[4], -1e300), min(w[5], 1e300), BINS + 1) for w in wide])
        found = count(cut, np.array([w[0] for w in wide]))
        # in front of a window stands what came before it
        found[:, 0] = 0
        step = {id(w): (h, e) for w, h, e in zip(wide, found, cut, strict=True)}
        windows, edges = [step.get(id(w), ([], []))[0] for w in wanted], [step.get(id(w), ([], []))[1] for w in wanted]
    spans = [(w[0], w[4], w[5]) for w in wanted]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                values = f(np.column_stack([np.asarray(c, float) for c in b.columns]))
                for i, (c, lo, hi) in enumerate(spans):
                    x = values[:, c]
                    x = x[(x >= lo) & (x < hi)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), i, np.int32)), pa.array(x)], ["i", "x"])

    known = [w[5] <= np.nextafter(w[4], np.inf) for w in wanted]
    out: list[list[float]] = [[] for _ in ranks]
    if not all(known):
        spans = [(c, lo, lo) if k else (c, lo, hi) for (c, lo, hi), k in zip(spans, known, strict=True)]
        rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).mapInArrow(fetch, "i int, x double").toPandas()
        near = {i: np.sort(g.to_numpy()) for i, g in rows.groupby("i")["x"]}
    for i, w in enumerate(wanted):
        out[w[0]].append(float(w[4]) if known[i] else float(near[i][w[1] - w[2]]))
    return [np.array(x) for x in out], sizes


def interpolated(prob: float) -> Callable[[int], list[int]]:
    """The two ranks between which a quantile lies."""
    return lambda n: [int(np.floor(prob * (n - 1))), int(np.ceil(prob * (n - 1)))]


def quantile_of(pair: np.ndarray, prob: float, n: int) -> float:
    """The quantile from the values at ``interpolated``'s ranks."""
    if not len(pair):
        return float("nan")
    at = prob * (n - 1)
    return float(pair[0] + (at - np.floor(at)) * (pair[1] - pair[0]))


def project(df: DataFrame, key: str, cols: Sequence[str], f: Callable[[np.ndarray], np.ndarray], names: Sequence[str]) -> DataFrame:
    """(key, names...): ``f`` of blocks of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                y = f(np.column_stack([np.asarray(c, float) for c in b.columns[1:]]))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(y[:, i])) for i in range(y.shape[1]))], [key, *names])

    kind = dict(df.dtypes)[key]
    return df.select(key, *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{n} double" for n in names))
