"""Generalised low-rank models (Udell et al. 2016) by minimisation over the columns.

Only the column factors Y and offsets are kept between passes. A pass solves each row's
scores given them in its task, and adds up the objective, its slopes, the quadratics that
lie above it (p matrices of rank + 1) and, of up to ``WIDE`` unknowns, its second derivatives
with the scores following Y (Schur complement); so the scores are never stored or shuffled,
and come from Y at the end. The start is the leading directions of all rows, from one more
pass, which solve the problem already where all losses are quadratic and no cell is missing.
Of large tables, hashed parts of the rows are solved first, from small to large, each from
the last: they only say where to start. The result is a minimum over all rows, as passes
over all of them go on to ``tol``, by damped Newton steps, or of more unknowns from mixtures
of the last points (Anderson 1965, type II); a step that doesn't lower the objective is
made shorter and at last the plain one, so it never rises. The minimum is a local one.

Numbers (standardised) have quadratic loss, flags and two levels logistic loss, more
levels multinomial loss over one column each, and counts Poisson loss if asked for.
Each loss is divided by that of the best constant, so that columns weigh alike.

``rotated`` turns the product of scores and archetypes into orthogonal dimensions: the
R of the centred scores comes from a QR that tasks make of their rows (TSQR), and the
singular value decomposition of R times the archetypes, rank x columns, is small."""

from __future__ import annotations

import copy
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.operators.describe import finite
from sondage.operators.frame import tall_r
from sondage.operators.linalg import matrix_sum, project
from sondage.operators.select import class_of
from sondage.plans.shared import materialize

GRID = (0.1, 0.5, 1, 2, 5, 10, 20, 50, 100)
MOST_LEVELS = 200
#: Times that a step of a row's scores is halved.
HALVINGS = 12
#: Damped steps that are tried before the plain one.
SHORTER = 5
#: Most unknowns (archetypes and offsets) of which tasks add up second derivatives.
WIDE = 100
#: A part of the rows from which a start comes is so many times smaller than the next, and has so many rows at least.
NESTED, FEWEST = 4, 1 << 17


@dataclass
class Loss:
    """What each column of the encoded matrix is: its loss, the block of levels it
    belongs to, the weight of its loss and the offset of the best constant."""

    kind: np.ndarray
    block: np.ndarray
    weight: np.ndarray
    offset: np.ndarray

    def means(self, eta: np.ndarray) -> np.ndarray:
        mu = np.array(eta, float)
        at = self.kind == "logistic"
        mu[:, at] = 1 / (1 + np.exp(-np.clip(eta[:, at], -30, 30)))
        at = self.kind == "poisson"
        mu[:, at] = np.exp(np.clip(eta[:, at], -30, 30))
        for at in self.levels():
            e = np.exp(eta[:, at] - eta[:, at].max(1, keepdims=True))
            mu[:, at] = e / e.sum(1, keepdims=True)
        return mu

    def levels(self) -> list[np.ndarray]:
        return [np.flatnonzero(self.block == b) for b in np.unique(self.block[self.kind == "multinomial"])]

    def total(self, a: np.ndarray, eta: np.ndarray, row: np.ndarray | None = None) -> float:
        return float(Cells(self, a, row).losses(np.ascontiguousarray(eta.T))[1].sum())

    def scores(self, a: np.ndarray, y: np.ndarray, offset: np.ndarray, lam: float, steps: int = 40, row: np.ndarray | None = None) -> np.ndarray:
        """The best scores of rows; ``row`` are weights of the rows."""
        return Cells(self, a, row).scores(y, offset, lam, steps).T


class Cells:
    """A block of rows, held by column: arrays are columns x rows, so that every step runs
    along the rows. Missing cells weigh nothing."""

    def __init__(self, loss: Loss, a: np.ndarray, row: np.ndarray | None = None) -> None:
        self.loss, a = loss, np.ascontiguousarray(a.T)
        seen = ~np.isnan(a)
        self.y = np.where(seen, a, 0.0)
        self.weight = loss.weight[:, None] * seen * (1.0 if row is None else row)
        self.plain, self.logistic, self.poisson = (np.flatnonzero(loss.kind == k) for k in ("quadratic", "logistic", "poisson"))
        self.blocks = loss.levels()

    def at(self, rows: np.ndarray) -> Cells:
        out = copy.copy(self)
        out.y, out.weight = self.y[:, rows], self.weight[:, rows]
        return out

    def losses(self, eta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each cell's mean, and the loss of each row."""
        mu, cell = eta.copy(), np.empty_like(eta)
        at = self.plain
        cell[at] = (self.y[at] - eta[at]) ** 2 / 2
        at = self.logistic
        if len(at):
            e = np.exp(-np.abs(eta[at]))
            mu[at] = np.where(eta[at] >= 0, 1.0, e) / (1 + e)
            cell[at] = np.log1p(e) + np.maximum(eta[at], 0.0) - self.y[at] * eta[at]
        at = self.poisson
        if len(at):
            e, n = np.clip(eta[at], -30, 30), self.y[at]
            mu[at] = np.exp(e)
            cell[at] = mu[at] - n * e + np.where(n > 0, n * np.log(np.maximum(n, 1e-300)) - n, 0.0)
        for at in self.blocks:
            low = eta[at] - eta[at].max(0)
            e = np.exp(low)
            all_ = e.sum(0)
            mu[at] = e / all_
            cell[at] = self.y[at] * (np.log(all_) - low)
        return mu, np.einsum("ij,ij->j", cell, self.weight)

    def bends(self, mu: np.ndarray) -> np.ndarray:
        """Second derivatives of each cell's loss by its own place."""
        h = mu.copy()
        h[self.plain] = 1.0
        h[self.logistic] *= 1 - mu[self.logistic]
        return h * self.weight

    def upper(self, eta: np.ndarray, mu: np.ndarray) -> np.ndarray:
        """Weights of the quadratic that touches each cell's loss and lies above it
        between the two."""
        w = np.ones_like(eta)
        w[self.logistic] = 0.25
        w[self.poisson] = np.maximum(np.maximum(mu[self.poisson], self.y[self.poisson]), 0.01)
        for at in self.blocks:
            w[at] = 0.5
        return w * self.weight

    def shared(self, h: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each block of levels: where it is, and what its cells' second derivatives by
        each other are made of, the outer product of the second array, to be taken away."""
        out = []
        for at in self.blocks:
            # levels of a block share their weight and are missing together
            w = self.weight[at[0]]
            out.append((at, h[at] / np.sqrt(np.where(w > 0, w, 1.0))))
        return out

    def curvature(self, mu: np.ndarray, y: np.ndarray, lam: float, h: np.ndarray | None = None) -> np.ndarray:
        """Second derivatives of each row's loss by its scores: k x k x rows."""
        k = y.shape[1]
        weights = h is not None
        h = self.bends(mu) if h is None else h
        out = ((y[:, :, None] * y[:, None, :]).reshape(len(y), k * k).T @ h).reshape(k, k, -1)
        for at, u in [] if weights else self.shared(h):
            v = y[at].T @ u
            out -= v[:, None] * v[None]
        out[np.arange(k), np.arange(k)] += lam
        return out

    def scores(self, y: np.ndarray, offset: np.ndarray, lam: float, steps: int = 40) -> np.ndarray:
        """The best scores, k x rows. A row's problem is convex: Newton's steps, halved where
        they don't lower the loss, and at last replaced by the step of the quadratic above
        it, which does; rows that are there drop out."""
        x = np.zeros((y.shape[1], self.y.shape[1]))
        offset = offset[:, None]

        def reached(b: Cells, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            mu, cost = b.losses(y @ x + offset)
            return mu, cost + lam / 2 * np.einsum("ij,ij->j", x, x)

        def above(b: Cells, x: np.ndarray, mu: np.ndarray) -> np.ndarray:
            slope = y.T @ ((mu - b.y) * b.weight) + lam * x
            return x - solved(factor(b.curvature(mu, y, lam, b.upper(y @ x + offset, mu))), slope)

        b, at, here = self, np.arange(x.shape[1]), x.copy()
        mu, held = reached(b, here)
        if len(self.plain) == len(y):
            return above(b, here, mu)
        for _ in range(steps):
            if not len(at):
                break
            slope = y.T @ ((mu - b.y) * b.weight) + lam * here
            new = here - solved(factor(b.curvature(mu, y, lam)), slope)
            to, now = reached(b, new)
            most = held + 1e-12 * (1 + np.abs(held))
            worse = np.flatnonzero(~(now <= most))
            for _ in range(HALVINGS):
                if not len(worse):
                    break
                new[:, worse] = (here[:, worse] + new[:, worse]) / 2
                to[:, worse], now[worse] = reached(b.at(worse), new[:, worse])
                worse = worse[~(now[worse] <= most[worse])]
            if len(worse):
                new[:, worse] = above(b.at(worse), here[:, worse], mu[:, worse])
                to[:, worse], now[worse] = reached(b.at(worse), new[:, worse])
            left = np.abs(new - here).max(0) > 1e-6 * (1 + np.abs(new).max(0))
            here, mu, held = new, to, now
            if not left.all():
                x[:, at[~left]] = here[:, ~left]
                left = np.flatnonzero(left)
                at, b, here, mu, held = at[left], b.at(left), here[:, left], mu[:, left], held[left]
        x[:, at] = here
        return x

    def sums(self, y: np.ndarray, offset: np.ndarray, lam: float, bend: bool) -> np.ndarray:
        """Added up over the rows, at their best scores: the objective; slopes by archetypes
        and offsets; the normal equations of the quadratics above; and with ``bend`` the
        second derivatives, in which the scores follow the archetypes (Schur complement)."""
        p, k = y.shape
        x = self.scores(y, offset, lam)
        eta = y @ x + offset[:, None]
        mu, cost = self.losses(eta)
        z = np.vstack([x, np.ones(x.shape[1])])
        zz = (z[:, None] * z[None]).reshape((k + 1) ** 2, -1)
        slope = (mu - self.y) * self.weight
        out = [[cost.sum() + lam / 2 * (x**2).sum()], (slope @ z.T).ravel(), (self.upper(eta, mu) @ zz.T).ravel()]
        if bend:
            h = self.bends(mu)
            own = np.zeros((p, k + 1, p, k + 1))
            own[np.arange(p), :, np.arange(p)] = (h @ zz.T).reshape(p, k + 1, k + 1)
            # derivatives by archetypes and offsets, then scores
            cross = np.einsum("jn,ja->ajn", h, y)
            for at, u in self.shared(h):
                v = (u[:, None] * z[None]).reshape(len(at) * (k + 1), -1)
                own[np.ix_(at, range(k + 1), at, range(k + 1))] -= (v @ v.T).reshape(len(at), k + 1, len(at), k + 1)
                cross[:, at] -= (y[at].T @ u)[:, None] * u[None]
            cross = cross[:, :, None] * z
            for a in range(k):
                cross[a, :, a] += slope
            low = factor(self.curvature(mu, y, lam))
            through = solved(low, cross.reshape(k, p * (k + 1), -1), half=True)
            own = own.reshape(p * (k + 1), -1)
            for w in through:
                own = own - w @ w.T
            out.append(own.ravel())
        return np.concatenate(out)


def factor(a: np.ndarray) -> list[list[np.ndarray]]:
    """Lower triangles of Cholesky factors of matrices that lie along the last axis."""
    k = len(a)
    low: list[list[np.ndarray]] = [[None] * k for _ in range(k)]
    for j in range(k):
        for i in range(j, k):
            rest = a[i, j] - sum(low[i][m] * low[j][m] for m in range(j))
            low[i][j] = np.sqrt(np.maximum(rest, 1e-300)) if i == j else rest / low[j][j]
    return low


def solved(low: list[list[np.ndarray]], b: np.ndarray, half: bool = False) -> list[np.ndarray] | np.ndarray:
    """Solutions of the factors' equations, k x ... x rows; with ``half`` of the lower
    triangles alone."""
    k, x = len(low), list(b)
    for i in range(k):
        for m in range(i):
            x[i] = x[i] - low[i][m] * x[m]
        x[i] = x[i] / low[i][i]
    for i in [] if half else range(k - 1, -1, -1):
        for m in range(i + 1, k):
            x[i] = x[i] - low[m][i] * x[m]
        x[i] = x[i] / low[i][i]
    return x if half else np.array(x)


@dataclass
class Encoding:
    """Columns of the matrix: names, the data's columns they belong to, cells and losses;
    where a number's cell is (x - centre) / scale, and the level that a column stands for."""

    names: list[str]
    of: list[str]
    cells: list[Column]
    loss: Loss
    centre: np.ndarray
    scale: np.ndarray
    levels: dict[str, list[str]]


@dataclass
class Glrm:
    archetypes: np.ndarray
    offset: np.ndarray
    losses: list[str]
    columns: list[str]
    objective: list[float]
    lam: float
    scores: DataFrame
    key: str
    encoding: Encoding
    converged: bool


def encode(df: DataFrame, names: Sequence[str], poisson: Sequence[str] = ()) -> Encoding:
    """One pass for all numbers and flags, one small count of levels for each category."""
    labels, of, cells, kind, block, weight, offset, centre, scale = [], [], [], [], [], [], [], [], []
    levels: dict[str, list[str]] = {}

    def add(c: str, label: str, cell: Column, k: str, best: float, start: float, b: int, mid: float = 0.0, width: float = 1.0) -> None:
        labels.append(label), of.append(c), cells.append(cell), kind.append(k), block.append(b), weight.append(1 / max(best, 1e-12)), offset.append(start)  # noqa: B018
        centre.append(mid), scale.append(width)  # noqa: B018

    numbers = [c for c in names if class_of(df.schema[c].dataType) in ("numeric", "logical")]
    aggs = [F.struct(F.avg(finite(c)).alias("m"), F.stddev_pop(finite(c)).alias("s"), F.avg(F.when(finite(c) > 0, finite(c) * F.log(finite(c))).otherwise(F.when(finite(c) == 0, 0.0))).alias("e"), F.min(finite(c)).alias("lo")).alias(f"c{i}") for i, c in enumerate(numbers)]
    stats = dict(zip(numbers, df.agg(*aggs).first(), strict=True)) if numbers else {}
    for b, c in enumerate(names):
        if c in stats:
            m, s, e, lo = stats[c]
            m = m or 0.0
            if c in poisson:
                if lo is not None and lo < 0:
                    raise ValueError(f"{c} has negative values, so it can't have Poisson loss")
                m = max(m, 1e-9)
                add(c, c, finite(c), "poisson", (e or 0.0) - m * np.log(m), float(np.log(m)), b)
            elif class_of(df.schema[c].dataType) == "logical":
                p = min(max(m, 1e-6), 1 - 1e-6)
                add(c, c, finite(c), "logistic", -(p * np.log(p) + (1 - p) * np.log(1 - p)), float(np.log(p / (1 - p))), b)
            else:
                add(c, c, (finite(c) - F.lit(m)) / F.lit(s or 1.0), "quadratic", 0.5, 0.0, b, m, s or 1.0)
            continue
        text = F.col(c).cast("string")
        rows = df.select(text.alias("l")).where("l is not null").groupBy("l").agg(F.count("*").alias("n")).orderBy("l").limit(MOST_LEVELS + 1).collect()
        if not 2 <= len(rows) <= MOST_LEVELS:
            raise ValueError(f"{c} must have 2 to {MOST_LEVELS} levels")
        levels[c] = [r.l for r in rows]
        share = np.array([r.n for r in rows], float) / sum(r.n for r in rows)
        best = float(-(share * np.log(share)).sum())
        if len(rows) == 2:
            add(c, f"{c}={rows[1].l}", (text == F.lit(rows[1].l)).cast("double"), "logistic", best, float(np.log(share[1] / share[0])), b)
            continue
        for r, p in zip(rows, share, strict=True):
            add(c, f"{c}={r.l}", (text == F.lit(r.l)).cast("double"), "multinomial", best, float(np.log(p)), b)
    return Encoding(labels, of, cells, Loss(np.array(kind), np.array(block), np.array(weight), np.array(offset)), np.array(centre), np.array(scale), levels)


class Descent:
    """Points from one to the next, by Newton's steps in the metric of the plain steps: where
    the objective is bent down along a direction, the step is turned round (Dauphin et al.
    2014), and all are damped by what they gained last. The scores' turning together with
    the archetypes and a common move of a block's offsets change nothing, so steps have no
    part of them."""

    def __init__(self, loss: Loss, rank: int) -> None:
        self.loss, self.rank, self.damp, self.hoped = loss, rank, 0.0, 0.0

    def still(self, here: np.ndarray) -> np.ndarray:
        """Moves that change nothing, one a row."""
        out = []
        for a in range(self.rank):
            for b in range(a):
                move = np.zeros_like(here)
                move[:, a], move[:, b] = here[:, b], -here[:, a]
                out.append(move)
        for at in self.loss.levels():
            move = np.zeros_like(here)
            move[at, -1] = 1.0
            out.append(move)
        return np.array(out).reshape(-1, *here.shape)

    def look(self, here: np.ndarray, slope: np.ndarray, second: np.ndarray, metric: np.ndarray) -> float:
        """Prepares steps from ``here``; how much one is expected to lower the objective,
        or infinity where it isn't at the bottom of a bowl."""
        p, k1 = here.shape
        low = np.linalg.cholesky(metric)
        into = np.linalg.inv(low)
        turned = np.einsum("jab,jblc->jalc", into, second.reshape(p, k1, p, k1))
        turned = np.einsum("jalc,ldc->jald", turned, into).reshape(p * k1, p * k1)
        still = np.einsum("jba,mjb->mja", low, self.still(here)).reshape(-1, p * k1)
        _, size, still = np.linalg.svd(still, full_matrices=False)
        still = still[size > 1e-9 * size.max(initial=0.0)]
        free = np.eye(p * k1) - still.T @ still
        values, vectors = np.linalg.eigh(free @ turned @ free)
        along = vectors.T @ free @ np.einsum("jab,jb->ja", into, slope).ravel()
        bent = np.maximum(np.abs(values), 1e-10)
        self.here, self.parts = here, (into, values, vectors, along, bent)
        return float((along**2 / bent).sum() / 2) if values[0] >= -1e-8 else np.inf

    def step(self) -> np.ndarray:
        into, values, vectors, along, bent = self.parts
        by = 1 / (bent + self.damp)
        self.hoped = float((along**2 * by * (1 - values * by / 2)).sum())
        return self.here - np.einsum("jba,jb->ja", into, (vectors @ (along * by)).reshape(self.here.shape))

    def gained(self, gain: float) -> None:
        """A step that gains much of what was hoped for is followed by a bolder one."""
        if gain > 0.75 * self.hoped:
            self.damp = self.damp / 10 if self.damp > 1e-6 else 0.0
        elif gain < 0.25 * self.hoped:
            self.damp = max(1e-3, 4 * self.damp)


class Mixer:
    """Anderson mixing of a fixed-point map: of the last points and what the map makes of
    them, the combination whose steps cancel best."""

    def __init__(self, depth: int = 6) -> None:
        self.depth, self.points, self.images = depth, [], []

    def next(self, point: np.ndarray, image: np.ndarray) -> np.ndarray:
        self.points, self.images = [*self.points[-self.depth :], point], [*self.images[-self.depth :], image]
        if len(self.points) < 2:
            return image
        steps = np.array(self.images) - np.array(self.points)
        change = np.diff(steps, axis=0).T
        gram = change.T @ change
        coef = np.linalg.lstsq(gram + 1e-10 * np.trace(gram) * np.eye(len(gram)), change.T @ steps[-1], rcond=None)[0]
        return image - np.diff(np.array(self.images), axis=0).T @ coef

    def forget(self) -> None:
        self.points, self.images = [], []


def _start(rows: DataFrame, cols: Sequence[str], loss: Loss, rank: int, lam: float) -> np.ndarray:
    """Leading directions of all rows, with missing cells at the column's centre."""
    centre = loss.means(loss.offset[None].copy())[0]

    def sums(a: np.ndarray) -> np.ndarray:
        d = np.where(np.isnan(a), 0.0, a - centre)
        return d.T @ d

    gram = matrix_sum(rows, cols, sums)
    y = np.zeros((len(cols), rank))
    if gram is None:
        return y
    wide = np.where(gram.diagonal() > 0, np.sqrt(np.maximum(gram.diagonal(), 1e-300)), 1.0)
    # quadratic columns have one scale already; others are brought to it
    n = np.median(gram.diagonal()[loss.kind == "quadratic"]) if (loss.kind == "quadratic").any() else 1.0
    to = np.where(loss.kind == "quadratic", 1.0, np.sqrt(max(n, 1e-300)) / wide)
    values, vectors = np.linalg.eigh(gram * np.outer(to, to))
    top = np.argsort(-values)[:rank]
    v = vectors[:, top]
    v = v * np.where(v[np.abs(np.round(v, 12)).argmax(0), np.arange(v.shape[1])] < 0, -1.0, 1.0)
    d = np.sqrt(np.maximum(values[top], 0))
    y[:, : len(top)] = v * np.sqrt(np.maximum(d - lam / 2, 1e-3 * d))
    return y


def glrm(df: DataFrame, key: str, names: Sequence[str], rank: int = 2, lam: float = 1.0, maxit: int = 300, tol: float = 1e-7, poisson: Sequence[str] = (), encoding: Encoding | None = None, weights: str | None = None) -> Glrm:
    """Scores of rows and archetypes of columns. ``lam`` penalises both; ``weights`` names
    a column by which rows weigh, none of it missing or negative."""
    enc = encoding or encode(df, names, poisson)
    loss, p = enc.loss, len(enc.names)
    if not 1 <= rank < p:
        raise ValueError(f"the rank is {rank} and there are {p} encoded columns; it must be below that")
    cols = [f"a{i}" for i in range(p)]
    more = []
    if weights is not None:
        bad = df.where(F.col(weights).isNull() | ~(F.col(weights).cast("double") >= 0) | (F.col(weights).cast("double") == float("inf")))
        if not bad.isEmpty():
            raise ValueError("a weight is missing, negative or infinite")
        more = [F.col(weights).cast("double").alias("w")]
    rows = materialize(df.select(key, *[F.coalesce(x, F.lit(float("nan"))).alias(c) for c, x in zip(cols, enc.cells, strict=True)], *more), "glrm-cells")
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(rows.inputFiles()) < cores:
        # a table of few files would keep few cores busy in every pass
        rows = materialize(rows.repartition(cores), "glrm-cells")
    k1, weigh = rank + 1, ["w"] if more else []
    weighted = bool(weigh)

    bend = p * k1 <= WIDE

    def passed(rows: DataFrame, here: np.ndarray, share: float) -> tuple[float, np.ndarray, np.ndarray, np.ndarray | None]:
        """Of rows that are a share of all: the objective, the quadratic above it, by column,
        and the objective's slopes and second derivatives."""
        y, offset, pull = here[:, :rank], here[:, rank], np.diag([lam * share] * rank + [0.0])

        def sums(cells: np.ndarray) -> np.ndarray:
            return Cells(loss, cells[:, :p], cells[:, p] if weighted else None).sums(y, offset, lam, bend)

        got = matrix_sum(rows, [*cols, *weigh], sums)
        if got is None:
            return 0.0, np.tile(np.eye(k1), (p, 1, 1)), np.zeros_like(here), np.eye(here.size) if bend else None
        slope, left, second = np.split(got[1:], [here.size, here.size * (k1 + 1)])
        slope = slope.reshape(here.shape) + here @ pull
        metric = left.reshape(p, k1, k1) + pull + np.diag([0.0] * rank + [1e-9])
        return float(got[0] + lam * share / 2 * (y**2).sum()), metric, slope, second.reshape(here.size, -1) + np.kron(np.eye(p), pull) if bend else None

    def lowered(rows: DataFrame, here: np.ndarray, share: float, loose: float = 1.0) -> tuple[np.ndarray, list[float], bool]:
        """The lowest point found from ``here``, the objective on the way, and whether it
        ended there: no more, or ``loose`` times more, can be gained."""
        trace: list[float] = []
        descent, mixer, best, plain, fails = Descent(loss, rank), Mixer(), here, here, 0
        for _ in range(maxit):
            cost, metric, slope, second = passed(rows, here, share)
            if trace and not cost <= trace[-1]:
                if here is plain:
                    # no plain step from the last good point lowers it any more
                    return best, trace, True
                # the step went too far: on from the last good point by a shorter one, at last the plain one
                fails += 1
                mixer.forget()
                descent.damp = max(1e-3, 10 * descent.damp)
                here = descent.step() if bend and fails <= SHORTER else plain
                continue
            near = tol * max(1.0, abs(cost))
            gain = trace[-1] - cost if trace else np.inf
            if bend and trace and here is not plain:
                descent.gained(gain)
            best, plain = here, here - np.linalg.solve(metric, slope[:, :, None])[:, :, 0]
            trace.append(cost)
            if gain <= near or bend and descent.look(here, slope, second, metric) <= near * loose:
                return best, trace, True
            fails, here = 0, plain
            if bend:
                here = descent.step()
            else:
                mixed = mixer.next(best.ravel(), plain.ravel()).reshape(plain.shape)
                here = mixed if len(mixer.points) > 1 else plain
        return best, trace, False

    best = np.column_stack([_start(rows, cols, loss, rank, lam), loss.offset])
    n = rows.count()
    for parts in [NESTED**i for i in range(12, 0, -1) if n >= FEWEST * NESTED**i]:
        few = materialize(rows.where(F.pmod(F.xxhash64(key), F.lit(parts)) == 0), "glrm-cells")
        # closer than chance in drawing the part is no nearer to the whole
        best = lowered(few, best, 1 / parts, min(10.0, max(1.0, best.size * parts / n / tol)))[0]
    best, trace, converged = lowered(rows, best, 1.0)
    y, offset = best[:, :rank], best[:, rank]
    out = project(rows, key, [*cols, *weigh], lambda a: loss.scores(a[:, :p], y, offset, lam, row=a[:, p] if weighted else None), [f"dim{i + 1}" for i in range(rank)])
    return Glrm(y, offset, loss.kind.tolist(), enc.names, trace, lam, materialize(out, "glrm"), key, enc, converged)


@dataclass
class Rotation:
    """The centred product of scores and archetypes as orthogonal dimensions: the means
    of the scores, singular values, loadings by encoded column, and how many of the
    fitted dimensions carry variation."""

    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    fitted: int

    @property
    def kept(self) -> int:
        return len(self.values)


def rotated(m: Glrm) -> Rotation:
    """A singular value at or below the root of the machine's precision times the first
    is zero to rounding, and its direction arbitrary, so it is left out."""
    rank = m.archetypes.shape[1]
    dims = [f"dim{i + 1}" for i in range(rank)]
    row = m.scores.agg(*[F.avg(c) for c in dims]).first()
    mean = np.array([x or 0.0 for x in row])
    r = tall_r(m.scores.select(*[(F.col(c) - F.lit(float(x))).alias(c) for c, x in zip(dims, mean, strict=True)]), dims)
    _, d, vt = np.linalg.svd(r @ m.archetypes.T, full_matrices=False)
    k = max(1, int((d[:rank] > np.sqrt(np.finfo(float).eps) * max(d.max(initial=0.0), 0.0)).sum()))
    v = vt[:k].T
    top = np.abs(np.round(v, 12)).argmax(0)
    return Rotation(mean, d[:k], v * np.where(v[top, np.arange(v.shape[1])] < 0, -1.0, 1.0), rank)


def fitted(m: Glrm) -> DataFrame:
    """(key, columns...): what the model says of every cell, on the columns' own scales;
    a category is its likeliest level."""
    enc, loss, rank = m.encoding, m.encoding.loss, m.archetypes.shape[1]
    own = list(dict.fromkeys(enc.of))
    at = {c: [i for i, o in enumerate(enc.of) if o == c] for c in own}
    y, offset, scale, centre = m.archetypes, m.offset, enc.scale, enc.centre

    def values(x: np.ndarray) -> np.ndarray:
        mu = loss.means(x @ y.T + offset)
        out = []
        for c in own:
            i = at[c][0]
            kind = loss.kind[i]
            out.append(mu[:, at[c]].argmax(1) if kind == "multinomial" else (mu[:, i] > 0.5) * 1.0 if kind == "logistic" else mu[:, i] * scale[i] + centre[i])
        return np.column_stack(out)

    found = project(m.scores, m.key, [f"dim{i + 1}" for i in range(rank)], values, [f"c{i}" for i in range(len(own))])

    def shown(i: int, c: str) -> Column:
        x = F.col(f"c{i}")
        if c in enc.levels:
            return F.element_at(F.array(*[F.lit(v) for v in enc.levels[c]]), x.cast("int") + 1)
        return x > 0.5 if loss.kind[at[c][0]] == "logistic" else x

    return found.select(m.key, *[shown(i, c).alias(c) for i, c in enumerate(own)])


def choose_lambda(df: DataFrame, key: str, names: Sequence[str], rank: int = 2, held: float = 0.1, seed: int = 1, poisson: Sequence[str] = (), maxit: int = 300, tol: float = 1e-5) -> float:
    """The penalty with the least loss on held-out cells, from large to small; stops after two worse."""
    hide = lambda c: F.pmod(F.xxhash64(key, F.lit(c), F.lit(seed)), F.lit(1000)) < int(1000 * held)
    enc = encode(df, names, poisson)
    loss, p = enc.loss, len(enc.names)
    parts = [Encoding(enc.names, enc.of, [F.when(~hide(c) if open_ else hide(c), x) for c, x in zip(enc.of, enc.cells, strict=True)], enc.loss, enc.centre, enc.scale, enc.levels) for open_ in (True, False)]
    both = df.select(*[F.coalesce(x, F.lit(float("nan"))).alias(f"b{i}") for i, x in enumerate([*parts[0].cells, *parts[1].cells])])
    best, pick, worse = np.inf, GRID[-1], 0
    for lam in reversed(GRID):
        m = glrm(df, key, names, rank, lam, maxit, tol, encoding=parts[0])

        def error(a: np.ndarray, y: np.ndarray = m.archetypes, off: np.ndarray = m.offset, lam: float = lam) -> np.ndarray:
            eta = loss.scores(a[:, :p], y, off, lam) @ y.T + off
            return np.array([[loss.total(a[:, p:], eta)]])

        e = float(matrix_sum(both, both.columns, error)[0, 0])
        if e < best:
            best, pick, worse = e, lam, 0
        else:
            worse += 1
            if worse == 2:
                break
    return pick
