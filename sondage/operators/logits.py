"""Logistic regressions of several 0/1 columns, fitted side by side in the same passes.

A model names its response, its design columns (which hold NaN where they are
missing) and uses the rows on which all of them are there; an intercept is added.
Each Newton step is one pass over the rows in which tasks sum p x p matrices, and
Spark adds those up, so the driver gets p x p numbers a model whatever the rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.functions.dist import chi2_sf, norm_sf2


@dataclass
class Model:
    """``beta`` and ``bread`` (the inverse information) have the intercept first; ``kept``
    are the columns of ``x`` that aren't linear combinations of those before them.
    Rows must have the columns of ``also``, too."""

    y: str
    x: list[str]
    also: list[str] = field(default_factory=list)
    kept: list[str] = field(default_factory=list)
    beta: np.ndarray = field(default_factory=lambda: np.zeros(1))
    bread: np.ndarray = field(default_factory=lambda: np.eye(1))
    loglik: float = -np.inf
    n: int = 0
    hits: int = 0
    converged: bool = False

    def over(self, table: dict[str, np.ndarray], names: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows used, and their responses and design."""
        y = table[self.y]
        there = ~np.isnan(y)
        for c in [*self.x, *self.also]:
            there &= ~np.isnan(table[c])
        x = np.column_stack([np.ones(int(there.sum())), *(table[c][there] for c in names)])
        return there, y[there], x


def _table(b: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {c: np.asarray(b[c].to_numpy(zero_copy_only=False), float) for c in b.schema.names}


def _add_up(rows: DataFrame, sums) -> list[np.ndarray]:
    """Vectors of ``sums(batch)``, one a model, added over all batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[np.ndarray] | None = None
        for b in batches:
            here = sums(_table(b))
            total = here if total is None else [a + x for a, x in zip(total, here, strict=True)]
        if total is not None:
            ids = np.repeat(np.arange(len(total)), [len(t) for t in total])
            at = np.concatenate([np.arange(len(t)) for t in total])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(at), pa.array(np.concatenate(total))], ["model", "at", "value"])

    found = rows.mapInArrow(run, "model long, at long, value double").groupBy("model", "at").agg(F.sum("value").alias("value")).collect()
    out: dict[int, list] = {}
    for r in found:
        out.setdefault(r.model, []).append((r.at, r.value))
    return [np.array([v for _, v in sorted(out[i])]) for i in sorted(out)]


def grams(rows: DataFrame, models: Sequence[Model], more) -> list[np.ndarray]:
    """Of each model the matrix M'M, M being the design and the columns of ``more(model, y, x)``."""

    def sums(t):
        out = []
        for m in models:
            _, y, x = m.over(t, m.x)
            z = np.column_stack([x, more(m, y, x)])
            out.append((z.T @ z).ravel())
        return out

    return [g.reshape(int(len(g) ** 0.5), -1) for g in _add_up(rows, sums)]


def fit(rows: DataFrame, models: Sequence[Model], most: int = 25, tol: float = 1e-8, rank_tol: float = 1e-9) -> None:
    """Maximum likelihood by Newton's method, in place. Models without rows or with a constant response stay unfitted."""
    if not models:
        return
    first = grams(rows, models, lambda m, y, x: y)
    if not first:
        return
    for m, g in zip(models, first, strict=True):
        m.n, m.hits = int(round(g[0, 0])), int(round(g[0, -1]))
        # in-order Cholesky: a column whose rest is nothing is aliased
        a, kept = g[:-1, :-1].copy(), []
        scale = np.maximum(np.diag(a).copy(), 1e-300)
        for j in range(len(a)):
            if a[j, j] > rank_tol * scale[j]:
                kept.append(j)
                a -= np.outer(a[:, j], a[j]) / a[j, j]
        m.kept = [m.x[j - 1] for j in kept if j]
        m.beta = np.zeros(len(m.kept) + 1)
    open_ = [m for m in models if 0 < m.hits < m.n]
    for _ in range(most):
        if not open_:
            return

        def sums(t, open_=tuple(open_)):
            out = []
            for m in open_:
                _, y, x = m.over(t, m.kept)
                eta = np.clip(x @ m.beta, -30, 30)
                mu = 1 / (1 + np.exp(-eta))
                out.append(np.concatenate([((x * (mu * (1 - mu))[:, None]).T @ x).ravel(), x.T @ (y - mu), [y @ eta - np.log1p(np.exp(eta)).sum()]]))
            return out

        still = []
        for m, s in zip(open_, _add_up(rows, sums), strict=True):
            p = len(m.beta)
            m.bread, ll = np.linalg.pinv(s[: p * p].reshape(p, p)), float(s[-1])
            if abs(ll - m.loglik) < tol * (abs(ll) + 0.1):
                m.loglik, m.converged = ll, True
                continue
            m.beta, m.loglik = m.beta + m.bread @ s[p * p : -1], ll
            still.append(m)
        open_ = still


def partial_effects(rows: DataFrame, models: Sequence[Model], tested: Sequence[Sequence[str]]) -> list[float | None]:
    """Of each fitted model, the multiple correlation of its Pearson residuals with
    other columns (``tested``, among its ``also``), each replaced by its residuals on
    the model's design."""
    wide = [Model(m.y, [*m.x, *m.also], kept=m.kept, beta=m.beta) for m in models]

    def more(m, y, x):
        own = x[:, [0, *(1 + m.x.index(c) for c in m.kept)]]
        mu = 1 / (1 + np.exp(-np.clip(own @ m.beta, -30, 30)))
        return (y - mu) / np.sqrt(mu * (1 - mu))

    out: list[float | None] = []
    for m, g, cs in zip(wide, grams(rows, wide, more), tested, strict=True):
        o, e, r = [0, *(1 + m.x.index(c) for c in m.kept)], [1 + m.x.index(c) for c in cs], len(g) - 1
        solve = np.linalg.pinv(g[np.ix_(o, o)])
        s = g[np.ix_(e, e)] - g[np.ix_(e, o)] @ solve @ g[np.ix_(o, e)]
        c = g[e, r] - g[np.ix_(e, o)] @ solve @ g[o, r]
        total = g[r, r] - g[0, r] ** 2 / g[0, 0]
        out.append(float(np.sqrt(min(1.0, max(0.0, c @ np.linalg.pinv(s) @ c / total)))) if total > 0 else None)
    return out


def cluster_walds(rows: DataFrame, models: Sequence[Model], tested: Sequence[Sequence[str]], unit: str, least: int = 30) -> list[float | None]:
    """P-values of the tested coefficients with the sandwich covariance by ``unit``
    (Liang & Zeger 1986), times units / (units - 1); none below ``least`` units."""

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, units = [c for c in b.schema.names if c != unit], b[unit]
            codes = units.dictionary_encode()
            index, t = codes.indices.to_numpy(zero_copy_only=False), _table(b.select(names))
            for k, m in enumerate(models):
                there, y, x = m.over(t, m.kept)
                s = x * (y - 1 / (1 + np.exp(-np.clip(x @ m.beta, -30, 30))))[:, None]
                by = index[there]
                total = np.zeros((len(codes.dictionary), x.shape[1]))
                np.add.at(total, by, s)
                seen = np.unique(by)
                n, p = len(seen), x.shape[1]
                yield pa.RecordBatch.from_arrays([codes.dictionary.take(pa.array(np.repeat(seen, p))), pa.array(np.full(n * p, k)), pa.array(np.tile(np.arange(p), n)), pa.array(total[seen].ravel())], ["unit", "model", "at", "value"])

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total: dict[int, np.ndarray] = {}
            for k, s in zip(b["model"].to_pylist(), b["s"].to_pylist(), strict=True):
                v = np.array([x["value"] for x in s])
                total[k] = total.get(k, 0) + np.append(np.outer(v, v).ravel(), 1.0)
            ids = [np.full(len(v), k) for k, v in total.items()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate([np.arange(len(v)) for v in total.values()])), pa.array(np.concatenate(list(total.values())))], ["model", "at", "value"])

    each = rows.where(F.col(unit).isNotNull()).mapInArrow(scores, f"unit {dict(rows.dtypes)[unit]}, model long, at long, value double")
    each = each.groupBy("unit", "model", "at").agg(F.sum("value").alias("value")).groupBy("unit", "model").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("s"))
    sums: dict[int, dict[int, float]] = {}
    for r in each.select("model", "s").mapInArrow(outer, "model long, at long, value double").groupBy("model", "at").agg(F.sum("value").alias("value")).collect():
        sums.setdefault(r.model, {})[r.at] = r.value
    out: list[float | None] = []
    for k, (m, cs) in enumerate(zip(models, tested, strict=True)):
        p = len(m.beta)
        units = sums.get(k, {}).get(p * p, 0)
        if not m.converged or units < least or any(c not in m.kept for c in cs):
            out.append(None)
            continue
        meat = np.array([sums[k][i] for i in range(p * p)]).reshape(p, p)
        v = m.bread @ meat @ m.bread * units / (units - 1)
        at = [1 + m.kept.index(c) for c in cs]
        b, vb = m.beta[at], v[np.ix_(at, at)]
        if len(at) == 1:
            out.append(float(norm_sf2(abs(b[0]) / vb[0, 0] ** 0.5)) if vb[0, 0] > 0 else None)
        elif np.linalg.matrix_rank(vb) < len(at):
            out.append(None)
        else:
            out.append(float(chi2_sf(float(b @ np.linalg.solve(vb, b)), len(at))))
    return out
