"""Rows that are implausible as a combination.

Reconstruction: principal components fitted to the most regular rows; the score
is the squared distance from their span, judged against ``B`` data sets of all n
rows simulated from the fitted structure: blocks of them are drawn in the tasks,
keyed by block, and meet the scores in ranges of the score, where they are sorted
and counted. Ranges are of bounded size and tasks get a few each, so a task's memory
doesn't grow with the rows. Simulated scores travel as the steps between sorted ones, to
the last bit, and a few data sets at a time, of which only counts stay on disk; p falls with
the score, so adjusted values (Benjamini-Hochberg)
come from ranks within ranges and the counts and minima of the other ranges. Noise scale and covariance come from all rows, cuts and medians from
histograms that are refined pass by pass. The tails of residuals are held against those
of the simulated sets, blocks of at most ``BLOCK`` rows at a time: of up to one block
that is the ratio of two percentiles of all rows, of more the mean over blocks, for real
rows (dealt at random) and simulated ones alike. Isolation forest: trees grown on the
driver from bounded hashed samples, scores in the tasks."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.operators.describe import finite, quantiles
from sondage.operators.linalg import interpolated, matrix_sum, order_statistics, project, quantile_of
from sondage.operators.parallel import STRATUM, Parallel, dealt, parallel_analysis
from sondage.operators.select import class_of
from sondage.plans.shared import in_parts, materialize, shuffles_removed, spread

SAMPLE, MOST_LEVELS = 20_000, 200
#: Simulated rows drawn by one generator; simulated values in a range of the score.
BLOCK, RANGE = 1 << 15, 1 << 18
#: Simulated values that a task holds before it deals them to ranges.
PACK = 1 << 24
#: Simulated values that are on their way at once, and the most parts that they go in.
ROUND, ROUNDS = 1 << 26, 8


#: What a scan says where residuals' tails are heavier than those it simulates.
HEAVY_TAILS = "residuals have heavier tails than the reference (p = {:.3g}): flagged rows are rows to look at, not findings"


def _span(gram: np.ndarray, rank: int) -> np.ndarray:
    w, v = np.linalg.eigh(gram)
    return v[:, np.argsort(-w)[:rank]]


def tail_of(r: np.ndarray, k: int, trim: float) -> float:
    """How heavy the tails of residuals are: the 99th over the 75th percentile of their
    sizes, each column centred and scaled robustly, over the rows that fit best."""
    s, many = (r**2).sum(1), max(k + 2, int(len(r) * (1 - trim)))
    if many < len(r):
        # of rows at the cut the first ones stay
        cut = np.partition(s, many - 1)[many - 1]
        held = s < cut
        held[np.flatnonzero(s == cut)[: many - held.sum()]] = True
        r = r[held]
    r = np.ascontiguousarray(r.T)
    off = np.abs(r - np.median(r, 1, keepdims=True))
    wide = 1.4826 * np.median(off, 1, keepdims=True)
    hi, lo = np.quantile(off / np.where(wide > 0, wide, 1.0), [0.99, 0.75])
    return float(hi / lo) if lo > 0 else float("inf")


@dataclass
class Structure:
    """What is simulated: directions, the variance along them, the columns' noise, and
    the factor that brings simulated scores to the level of the real ones."""

    n: int
    v: np.ndarray
    common: np.ndarray
    scale: np.ndarray
    trim: float
    seed: int
    #: Rows that one generator draws.
    block: int
    ratio: float = 1.0

    @property
    def blocks(self) -> int:
        return -(-self.n // self.block)

    def residuals(self, a: np.ndarray) -> np.ndarray:
        return a - a @ self.v @ self.v.T

    def drawn(self, rep: int, block: int) -> np.ndarray:
        """Residuals of one block of the simulated data set ``rep``."""
        rows, (p, k) = min(self.block, self.n - block * self.block), self.v.shape
        rng = np.random.default_rng([self.seed, rep, block])
        y = rng.multivariate_normal(np.zeros(k), self.common, rows) @ self.v.T + rng.normal(0, 1, (rows, p)) * self.scale
        return self.residuals(y) * self.ratio**0.5

    def folded(self, spark: SparkSession, reps: range, f: Callable[[Iterator[tuple[int, np.ndarray]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """``f`` of a task's pairs of the number of a data set and the residuals of one of its blocks."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids = (i for b in batches for i in b["id"].to_numpy().tolist())
            yield from f((reps[i // self.blocks], self.drawn(reps[i // self.blocks], i % self.blocks)) for i in ids)

        many = len(reps) * self.blocks
        return spark.range(many).repartition(min(many, 4 * spark.sparkContext.defaultParallelism), "id").mapInArrow(run, schema)

    def simulated(self, spark: SparkSession, reps: range, f: Callable[[int, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
        """``f`` of the number of a data set and the residuals of one of its blocks, over all blocks."""
        return self.folded(spark, reps, lambda pairs: (f(rep, r) for rep, r in pairs), schema)


@dataclass
class Scan:
    """``found`` has (key, score, driver, p, p_adj, flag); ``parallel`` is None where the
    rank was given; ``note`` says what the tail check found, if it found something."""

    found: DataFrame
    rank: int
    parallel: Parallel | None
    tail_p: float
    note: str
    structure: Structure
    B: int


def _batch(**x) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in x.values()], list(x))


def packed_steps(s: np.ndarray) -> tuple[int, int, bytes, bytes]:
    """Ascending numbers, none below zero, by the first one and steps of their bit patterns,
    which ascend as well: the steps' bytes, the two highest compressed, as they are few."""
    bits = s.view(np.int64)
    steps = np.diff(bits)
    wide = max(3, -(-int(steps.max(initial=0)).bit_length() // 8))
    planes = np.ascontiguousarray(steps.astype("<i8").view(np.uint8).reshape(-1, 8).T[:wide])
    return int(bits[0]), wide, planes[:-2].tobytes(), pa.compress(planes[-2:].tobytes(), "zstd", asbytes=True)


def unpacked_steps(first: int, wide: int, low: bytes, high: bytes) -> np.ndarray:
    many = len(low) // (wide - 2)
    planes = np.zeros((8, many), np.uint8)
    planes[: wide - 2] = np.frombuffer(low, np.uint8).reshape(wide - 2, many)
    planes[wide - 2 : wide] = np.frombuffer(pa.decompress(high, 2 * many, "zstd", asbytes=True), np.uint8).reshape(2, many)
    steps = np.ascontiguousarray(planes.T).view("<i8").ravel()
    return np.cumsum(np.r_[np.int64(first), steps]).view(np.float64)


def scan(df: DataFrame, key: str, names: Sequence[str], rank: int | None = None, trim: float = 0.25, B: int = 39, alpha: float = 0.05, seed: int = 1) -> Scan:
    """Complete rows judged by their distance from the span of ``rank`` directions, which
    parallel analysis chooses where it isn't given."""
    with shuffles_removed(df.sparkSession):
        return _scan(df, key, names, rank, trim, B, alpha, seed)


def _scan(df: DataFrame, key: str, names: Sequence[str], rank: int | None, trim: float, B: int, alpha: float, seed: int) -> Scan:
    p = len(names)
    if p < 3:
        raise ValueError("at least three numeric columns are needed")
    if not 0 <= trim < 0.5:
        raise ValueError("the share of rows left out of the fit lies from 0 to below one half")
    x = df.select(key, *[finite(c).alias(c) for c in names]).dropna(subset=list(names))
    stats = x.agg(F.count("*").alias("n"), *[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")) for c in names]).first()
    n = stats["n"]
    if n < 20:
        raise ValueError("at least 20 complete rows are needed")
    cols, spark = list(names), df.sparkSession
    z = x.select(key, *[((F.col(c) - F.lit(stats[i + 1].m)) / F.lit(stats[i + 1].s or 1.0)).alias(c) for i, c in enumerate(cols)])
    z = materialize(z, "anomaly-z")
    gram = matrix_sum(z, cols, lambda a: a.T @ a) / n
    found = None
    if rank is None:
        found = parallel_analysis(z, key, cols, n, seed=seed)
        rank = found.ndim
    k = max(1, min(rank, p - 1))
    v = _span(gram, k)
    keep = max(k + 2, int(n * (1 - trim)))
    for _ in range(2 if trim > 0 and keep < n else 0):  # refit on the rows that fit best
        size = lambda a, v=v: ((a - a @ v @ v.T) ** 2).sum(1)
        cut = order_statistics(z, cols, lambda a, size=size: size(a)[:, None], [lambda _: [keep - 1]])[0][0][0]

        def held(a: np.ndarray, size=size, cut=cut) -> np.ndarray:
            a = a[size(a) <= cut]
            return a.T @ a

        v = _span(matrix_sum(z, cols, held), k)

    def residual(a: np.ndarray) -> np.ndarray:
        r = a - a @ v @ v.T
        return np.column_stack([r, (r**2).sum(1)])

    half = interpolated(0.5)
    pairs, sizes = order_statistics(z, cols, residual, [half] * (p + 1))
    mid = np.array([quantile_of(x, 0.5, m) for x, m in zip(pairs, sizes, strict=True)])
    pairs, sizes = order_statistics(z, cols, lambda a: np.abs(residual(a)[:, :p] - mid[:p]), [half] * p)
    mad = np.array([quantile_of(x, 0.5, m) for x, m in zip(pairs, sizes, strict=True)])
    made = Structure(n, v, v.T @ gram @ v * n / (n - 1), 1.4826 * mad * np.sqrt(p / (p - k)), trim, seed, BLOCK)
    # scores of three data sets say how far simulated scores lie from the real ones
    trial = spark.range(made.blocks).select(F.col("id").cast("double").alias("id"))
    scores = lambda ids: np.vstack([np.column_stack([(made.drawn(B + r, int(i)) ** 2).sum(1) for r in range(3)]) for i in ids[:, 0]])
    pairs, sizes = order_statistics(trial, ["id"], scores, [half] * 3)
    level = np.median([quantile_of(x, 0.5, m) for x, m in zip(pairs, sizes, strict=True)])
    made.ratio = mid[p] / max(level, 1e-300)

    # ranges of the score, cut where either real or simulated ones are many
    parts = max(1, n * B // RANGE)
    at = np.linspace(0, 1, parts + 1)[1:-1]
    edges = np.empty(0)
    if len(at):
        own = project(z, key, cols, lambda a: residual(a)[:, p:], ["score"]).agg(F.percentile_approx("score", [float(q) for q in np.linspace(0, 1, min(parts, 4096) + 1)[1:-1]], 10_000)).first()[0]
        edges = np.unique(np.r_[np.quantile((made.drawn(B + 3, 0) ** 2).sum(1), at), own])
    place = lambda s: np.searchsorted(edges, s, "right")

    def placed_in(a: np.ndarray) -> np.ndarray:
        r = residual(a)
        return np.column_stack([r[:, p], np.abs(r[:, :p]).argmax(1), place(r[:, p])])

    placed = project(z, key, cols, placed_in, ["score", "at", "cell"]).withColumns({"at": F.col("at").cast("int"), "cell": F.col("cell").cast("int")})
    placed = materialize(placed, "anomaly-scores")

    def by_cell(rows: DataFrame) -> np.ndarray:
        out = np.zeros(len(edges) + 1, np.int64)
        for r in rows.groupBy("cell").agg(F.sum("n").alias("n")).collect():
            out[r.cell] = r.n
        return out

    own_higher = n - np.cumsum(by_cell(placed.select("cell", F.lit(1).alias("n"))))

    # tails block by block, of real rows dealt at random and of simulated ones
    def own_tail(t: pa.Table) -> pa.Table:
        r = made.residuals(np.column_stack([t[c].to_numpy() for c in cols]))
        return pa.table({"tail": [tail_of(r, k, trim) * len(r)]})

    strata = in_parts(dealt(z, key, n, seed).select("stratum", *cols), "stratum", -(-n // STRATUM)).groupBy("stratum").applyInArrow(own_tail, "tail double")
    heavy = strata.agg(F.sum("tail")).first()[0] / n

    def packed(pairs: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """The scores of many blocks, one row for each range: few rows are shuffled. Tails
        are on rows of their own."""
        held: list[np.ndarray] = []
        tails: dict[int, float] = {}
        types = {"first": pa.int64(), "wide": pa.int32(), "low": pa.binary(), "high": pa.binary(), "rep": pa.int32(), "tail": pa.float64()}

        def table(cell: np.ndarray, **found: Sequence) -> pa.RecordBatch:
            return _batch(cell=pa.array(cell, pa.int32()), **{c: pa.array(found[c], t) if c in found else pa.nulls(len(cell), t) for c, t in types.items()})

        def dealt_out() -> pa.RecordBatch:
            s = np.concatenate(held)
            held.clear()
            s.sort()
            first = np.r_[0, np.searchsorted(s, edges, "left"), len(s)]
            cell = np.flatnonzero(np.diff(first))
            rows = [packed_steps(s[first[c] : first[c + 1]]) for c in cell.tolist()]
            return table(cell, **dict(zip(("first", "wide", "low", "high"), zip(*rows, strict=True), strict=True)))

        for rep, r in pairs:
            held.append((r**2).sum(1))
            tails[rep] = tails.get(rep, 0.0) + tail_of(r, k, trim) * len(r)
            if sum(map(len, held)) >= PACK:
                yield dealt_out()
        if held:
            yield dealt_out()
        yield table(np.full(len(tails), -1), rep=list(tails), tail=list(tails.values()))

    def counted(real: pa.Table, sims: pa.Table) -> pa.Table:
        """How many simulated scores a range has, and how many lie between neighbours of its own."""
        cell = (real if real.num_rows else sims)["cell"][0].as_py()
        if cell < 0:
            return pa.table({"cell": sims["cell"], "n": pa.nulls(sims.num_rows, pa.int64()), "between": pa.nulls(sims.num_rows, pa.binary()), "rep": sims["rep"], "tail": sims["tail"]})
        own = np.sort(real["score"].to_numpy())
        s = np.sort(np.concatenate([np.empty(0), *(unpacked_steps(*(r[c] for c in ("first", "wide", "low", "high"))) for r in sims.to_pylist())]))
        between = np.diff(np.searchsorted(s, own, "left"), prepend=0).astype("<i4")
        return pa.table({"cell": pa.array([cell], pa.int32()), "n": pa.array([len(s)], pa.int64()), "between": pa.array([pa.compress(between.tobytes(), "zstd", asbytes=True) if len(own) else None], pa.binary()), "rep": pa.nulls(1, pa.int32()), "tail": pa.nulls(1, pa.float64())})

    # a few data sets at a time are dealt to ranges, and only counts stay
    kind, cells, few = dict(df.dtypes)[key], len(edges) + 1, max(-(-B // ROUNDS), ROUND // n, 1)
    counts = []
    for start in range(0, B, few):
        null = made.folded(spark, range(start, min(start + few, B)), packed, "cell int, first long, wide int, low binary, high binary, rep int, tail double")
        met = in_parts(placed.select("cell", "score"), "cell", cells).groupBy("cell").cogroup(in_parts(null, "cell", cells).groupBy("cell"))
        counts.append(materialize(met.applyInArrow(counted, "cell int, n long, between binary, rep int, tail double"), "anomaly-counts"))
    every = reduce(DataFrame.unionByName, counts)
    tails = [r.t / n for r in every.where("cell < 0").groupBy("rep").agg(F.sum("tail").alias("t")).collect()]
    tail_p = (1 + sum(t >= heavy for t in tails)) / (B + 1)
    count = by_cell(every.where("cell >= 0"))
    higher = count.sum() - np.cumsum(count)

    def compare(real: pa.Table, counts: pa.Table) -> pa.Table:
        score, cell = real["score"].to_numpy(), real["cell"].to_numpy()
        own = np.sort(score)
        at = np.searchsorted(own, score, "left")
        reach = sum((r["n"] - np.cumsum(np.frombuffer(pa.decompress(r["between"], 4 * len(own), "zstd", asbytes=True), "<i4").astype(np.int64)) for r in counts.to_pylist()), np.zeros(len(own), np.int64))
        p = (1 + reach[at] + higher[cell]) / (n * B + 1)
        # of rows that share p the lowest score has the last rank, and the minimum over lower scores finds it
        raw, order = p * n / (len(own) - at + own_higher[cell]), np.argsort(score, kind="stable")
        adj = np.empty(len(raw))
        adj[order] = np.minimum.accumulate(raw[order])
        return pa.table({key: real[key], "score": score, "at": real["at"], "p": p, "cell": real["cell"], "adj": adj})

    both = in_parts(placed, "cell", cells).groupBy("cell").cogroup(in_parts(every.where("between is not null").select("cell", "n", "between"), "cell", cells).groupBy("cell"))
    out = materialize(both.applyInArrow(compare, f"`{key}` {kind}, score double, at int, p double, cell int, adj double"), "anomaly-p")
    lower = np.full(cells + 1, 1.0)
    for r in out.groupBy("cell").agg(F.min("adj").alias("adj")).collect():
        lower[r.cell + 1] = r.adj
    lower = np.minimum.accumulate(np.minimum(lower, 1.0))

    @F.pandas_udf("double")
    def below(cell: pd.Series) -> pd.Series:
        return pd.Series(lower[cell.to_numpy()])

    driver = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("at") + 1)
    out = out.select(key, "score", driver.alias("driver"), "p", F.least("adj", below("cell")).alias("p_adj"))
    return Scan(out.withColumn("flag", F.col("p_adj") < alpha), k, found, tail_p, HEAVY_TAILS.format(tail_p) if tail_p <= 0.05 else "", made, B)


def anomaly(df: DataFrame, key: str, names: Sequence[str], rank: int | None = None, trim: float = 0.25, B: int = 39, alpha: float = 0.05, seed: int = 1) -> DataFrame:
    """(key, score, driver, p, p_adj, flag) of complete rows, most anomalous first to sort by
    ``score``. What the tail check says is a warning."""
    got = scan(df, key, names, rank, trim, B, alpha, seed)
    if got.note:
        warnings.warn(got.note, stacklevel=2)
    return got.found


def rank_band(got: Scan, ranks: Sequence[int] | None = None, points: int = 1000) -> DataFrame:
    """(rank, score, lo, mid, hi): the real score at each rank from the largest, and what
    simulated data sets have there: the 2.5 %, 50 % and 97.5 % quantiles. ``ranks`` may be
    given; else all of up to ``points`` rows, or that many by ratio.

    Scores are dealt by data set and range, and only rows at a wanted rank leave their
    range, with the rows of higher ranges counted before: no data set meets in one task."""
    made, spark, n = got.structure, got.found.sparkSession, got.structure.n
    wanted = np.unique(np.asarray(ranks) if ranks is not None else np.arange(1, n + 1) if n <= points else np.geomspace(1, n, points).round().astype(np.int64))
    if len(wanted) and not 1 <= wanted[0] <= wanted[-1] <= n:
        raise ValueError(f"ranks run from 1 to {n}")
    parts = max(1, n // RANGE)
    edges = np.unique(np.quantile((made.drawn(got.B + 3, 0) ** 2).sum(1), np.linspace(0, 1, parts + 1)[1:-1])) if parts > 1 else np.empty(0)
    own = [float(q) for q in np.linspace(0, 1, min(parts, 4096) + 1)[1:-1]]
    if own:
        edges = np.unique(np.r_[edges, got.found.agg(F.percentile_approx("score", own, 10_000)).first()[0]])

    def scored(rep: int, r: np.ndarray) -> pa.RecordBatch:
        s = (r**2).sum(1)
        return _batch(rep=np.full(len(s), rep), cell=np.searchsorted(edges, s, "right"), s=s)

    @F.pandas_udf("long")
    def cell_of(s: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, s.to_numpy(), "right"))

    sims = made.simulated(spark, range(got.B), scored, "rep long, cell long, s double")
    real = got.found.select(F.lit(-1).cast("long").alias("rep"), cell_of("score").alias("cell"), F.col("score").alias("s"))
    every = sims.unionByName(real)
    before = np.zeros((got.B + 1, len(edges) + 1), np.int64)
    for r in every.groupBy("rep", "cell").agg(F.count("*").alias("n")).collect():
        before[r.rep, r.cell] = r.n
    before = before.sum(1, keepdims=True) - np.cumsum(before, 1)

    def at_ranks(t: pa.Table) -> pa.Table:
        rep, cell = t["rep"][0].as_py(), t["cell"][0].as_py()
        s = np.sort(t["s"].to_numpy())[::-1]
        first = before[rep, cell]
        mine = wanted[(wanted > first) & (wanted <= first + len(s))]
        return pa.table({"rep": np.full(len(mine), rep), "rank": mine, "s": s[mine - first - 1]})

    rows = every.groupBy("rep", "cell").applyInArrow(at_ranks, "rep long, rank long, s double")
    sim = F.when(F.col("rep") >= 0, F.col("s"))
    band = rows.groupBy("rank").agg(F.max(F.when(F.col("rep") < 0, F.col("s"))).alias("score"), F.percentile(sim, [0.025, 0.5, 0.975]).alias("q"))
    return band.select("rank", "score", *[F.col("q")[i].alias(c) for i, c in enumerate(("lo", "mid", "hi"))])


#: A node: its column (-1 for a leaf), the cut of a number, the levels of a category that go left, both ways on, where a gap goes, and the path length of a leaf.
Node = tuple[int, float, np.ndarray | None, int, int, bool, float]


def _grow(x: np.ndarray, levels: Sequence[int], rng: np.random.Generator, depth: int) -> list[Node]:
    """A tree over rows of numbers and level codes (``levels`` is 0 for a number); a gap follows the larger side."""
    nodes: list[Node] = []

    def path(n: int) -> float:
        return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0

    def build(rows: np.ndarray, d: int) -> int:
        i = len(nodes)
        nodes.append((-1, 0.0, None, 0, 0, True, d + path(len(rows))))
        lo, hi = np.fmin.reduce(x[rows]), np.fmax.reduce(x[rows])
        can = np.flatnonzero(hi > lo)
        if d < depth and len(rows) > 1 and len(can):
            c = int(rng.choice(can))
            v = x[rows, c]
            cut, go = 0.0, None
            if levels[c]:
                here = np.unique(v[~np.isnan(v)]).astype(int)
                go = rng.random(levels[c]) < 0.5
                go[here] = rng.permutation(np.arange(len(here)) < rng.integers(1, len(here)))
                left = go[np.nan_to_num(v).astype(int)]
            else:
                cut = rng.uniform(lo[c], hi[c])
                left = v < cut
            gap = np.isnan(v)
            most = bool(left[~gap].sum() * 2 >= (~gap).sum())
            left = np.where(gap, most, left)
            nodes[i] = (c, cut, go, build(rows[left], d + 1), build(rows[~left], d + 1), most, 0.0)
        return i

    build(np.arange(len(x)), 0)
    return nodes


#: The most cells of a tree's table.
CELLS = 1 << 16


def _table(nodes: list[Node], levels: Sequence[int]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray] | None:
    """A tree as a table of its leaves by the place of each column: for a number how many of
    the tree's cuts are at or below it, for a category its level, and last a gap. (cuts,
    leaves, path lengths), or None where the table would be too large."""
    cuts = [np.unique([x[1] for x in nodes if x[0] == c]) if not k else np.empty(0) for c, k in enumerate(levels)]
    shape = [(k or len(cut) + 1) + 1 for k, cut in zip(levels, cuts, strict=True)]
    if math.prod(shape) > CELLS:
        return None
    leaf, length = np.empty(shape, np.uint16), []
    work = [(0, [np.arange(m) for m in shape])]
    while work:
        at, box = work.pop()
        c, cut, go, left, right, most, path = nodes[at]
        if c < 0:
            leaf[np.ix_(*box)] = len(length)
            length.append(path)
            continue
        own = np.zeros(shape[c], bool)
        own[:-1] = go if go is not None else np.arange(shape[c] - 1) <= np.searchsorted(cuts[c], cut)
        own[-1] = most
        for to, side in ((left, own[box[c]]), (right, ~own[box[c]])):
            if side.any():
                work.append((to, [*box[:c], box[c][side], *box[c + 1 :]]))
    return cuts, leaf.ravel(), np.array(length)


class Forest:
    """Trees as tables of their leaves, or as arrays where those are too large, scored over
    blocks of rows. A block's values are sorted once, so a tree's cuts are looked up among
    them, not each value among the cuts."""

    def __init__(self, trees: Sequence[list[Node]], levels: Sequence[int], size: int) -> None:
        self.levels = list(levels)
        self.tables = [_table(nodes, levels) for nodes in trees]
        wide = max([1, *levels])
        self.trees = []
        for nodes, table in zip(trees, self.tables, strict=True):
            if table:
                self.trees.append(None)
                continue
            go = np.zeros((len(nodes), wide), bool)
            for i, n in enumerate(nodes):
                if n[2] is not None:
                    go[i, : len(n[2])] = n[2]
            self.trees.append(([np.array([n[k] for n in nodes]) for k in (0, 1, 3, 4, 5, 6)], go))
        self.category = np.array([k > 0 for k in levels])
        self.norm = 2 * (np.log(size - 1) + 0.5772156649) - 2 * (size - 1) / size if size > 2 else 1.0

    def score(self, a: np.ndarray) -> np.ndarray:
        total = np.zeros(len(a))
        order = [np.argsort(x, kind="stable") for x in a.T]
        back, there, values = [np.empty_like(i) for i in order], [], []
        for c, i in enumerate(order):
            back[c][i] = np.arange(len(a))
            there.append(len(a) - int(np.isnan(a[:, c]).sum()))
            values.append(a[i[: there[c]], c])
        for tree, table in zip(self.trees, self.tables, strict=True):
            total += self._looked_up(a, table, back, there, values) if table else self._walked(a, *tree)
        return 2 ** (-total / len(self.tables) / self.norm)

    def _looked_up(self, a: np.ndarray, table: tuple[list[np.ndarray], np.ndarray, np.ndarray], back: list[np.ndarray], there: list[int], values: list[np.ndarray]) -> np.ndarray:
        cuts, leaf, length = table
        cell = np.zeros(len(a), np.int32)
        for c, k in enumerate(self.levels):
            n = k or len(cuts[c]) + 1
            if k:
                place = np.where(np.isnan(a[:, c]), n, np.nan_to_num(a[:, c])).astype(np.int32)
            else:
                ends = np.r_[0, np.searchsorted(values[c], cuts[c], "left"), there[c], len(a)]
                place = np.repeat(np.arange(n + 1, dtype=np.int32), np.diff(ends))[back[c]]
            cell *= n + 1
            cell += place
        return length[leaf[cell]]

    def _walked(self, a: np.ndarray, arrays: list[np.ndarray], go: np.ndarray) -> np.ndarray:
        col, cut, left, right, most, length = arrays
        at = np.zeros(len(a), int)
        while len(i := np.flatnonzero(col[at] >= 0)):
            n = at[i]
            v = a[i, col[n]]
            gap = np.isnan(v)
            code = np.where(self.category[col[n]] & ~gap, v, 0).astype(int)
            go_left = np.where(gap, most[n], np.where(self.category[col[n]], go[n, code], v < cut[n]))
            at[i] = np.where(go_left, left[n], right[n])
        return length[at]


class Expected:
    """What the other columns say of each: a number by least squares on them, a category
    by the commonest level among the ``near`` nearest of a pool of rows (a number's
    difference over its range and a category's mismatch, averaged)."""

    def __init__(self, gram: np.ndarray, levels: Sequence[int], pool: np.ndarray, near: int) -> None:
        self.levels, self.pool, self.near = levels, pool, near
        spread = np.fmax.reduce(pool) - np.fmin.reduce(pool)
        self.spread = np.where(np.isfinite(spread) & (spread > 0), spread, 1.0)
        self.coef = {}
        where = np.cumsum([1, *(max(1, k - 1) for k in levels)])
        for c, k in enumerate(levels):
            if not k:
                x = [i for i in range(len(gram)) if not where[c] <= i < where[c + 1]]
                self.coef[c] = (x, np.linalg.pinv(gram[np.ix_(x, x)], rcond=1e-10) @ gram[x, where[c]])

    def of(self, a: np.ndarray, c: int) -> np.ndarray:
        own = a[:, c]
        if not self.levels[c]:
            x, coef = self.coef[c]
            z = design_rows(a, self.levels)
            got = z[:, x] @ coef
        else:
            other = [i for i in range(a.shape[1]) if i != c]
            d, n = np.zeros((len(a), len(self.pool))), np.zeros((len(a), len(self.pool)))
            for i in other:
                far = np.abs(a[:, i, None] - self.pool[None, :, i])
                far = (far > 0).astype(float) + np.where(np.isnan(far), np.nan, 0) if self.levels[i] else far / self.spread[i]
                there = ~np.isnan(far)
                d += np.where(there, far, 0)
                n += there
            d = np.where(n > 0, d / np.maximum(n, 1), np.inf)
            # never the row itself
            d[(np.nan_to_num(a[:, None], nan=-1e300) == np.nan_to_num(self.pool[None], nan=-1e300)).all(2)] = np.inf
            nearest = np.argsort(d, 1, kind="stable")[:, : self.near]
            level = self.pool[nearest, c]
            count = np.stack([(level == k).sum(1) for k in range(self.levels[c])], 1)
            got = np.where(count.sum(1) > 0, count.argmax(1), np.nan)
        return np.where(np.isnan(got) | np.isnan(own), own, got)


def design_rows(a: np.ndarray, levels: Sequence[int]) -> np.ndarray:
    """An intercept, numbers, and indicators of all but the first level."""
    out = [np.ones(len(a))]
    for c, k in enumerate(levels):
        out += [np.where(np.isnan(a[:, c]), np.nan, a[:, c] == j) for j in range(1, max(k, 2))] if k else [a[:, c]]
    return np.column_stack(out)


def iforest(df: DataFrame, key: str, names: Sequence[str], ntrees: int = 500, size: int = 256, alpha: float = 0.05, seed: int = 1, pool: int = 2000, near: int = 10) -> DataFrame:
    """(key, score, flag, driver): isolation forest scores (Liu, Ting & Zhou 2008) of
    numbers and categories, gaps allowed; flagged above the (1 - alpha) quantile. The
    driver of a flagged row is the column whose value, replaced by what the others say
    of it, lowers the score most. Trees see ``size`` rows each, and categories are
    looked up among ``pool`` rows, both by hashes of the key; regressions and scores
    take all rows."""
    kinds = {c: class_of(df.schema[c].dataType) for c in names}
    if len(names) < 2:
        raise ValueError("two columns or more are needed")
    level_of: dict[str, list[str]] = {}
    for c in names:
        if kinds[c] != "numeric":
            found = df.where(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("l")).distinct().orderBy("l").limit(MOST_LEVELS + 1).collect()
            if len(found) > MOST_LEVELS:
                raise ValueError(f"{c} has more than {MOST_LEVELS} levels")
            level_of[c] = [r.l for r in found] or [""]
    code = lambda c: F.nullif(F.array_position(F.array(*[F.lit(x) for x in level_of[c]]), F.col(c).cast("string")), F.lit(0)) - 1
    x = df.select(key, *[(code(c) if c in level_of else finite(c)).cast("double").alias(c) for c in names])
    x = spread(x, "iforest-rows")
    levels = [len(level_of.get(c, ())) for c in names]
    rows = x.orderBy(F.xxhash64(F.lit(seed), key), key).limit(max(SAMPLE, pool)).select(*names).collect()
    sample = np.array([[np.nan if v is None else v for v in r] for r in rows], float).reshape(-1, len(names))
    rng = np.random.default_rng(seed)
    m = min(size, len(sample))
    forest = Forest([_grow(sample[rng.choice(len(sample), m, replace=False)], levels, rng, int(np.ceil(np.log2(max(m, 2))))) for _ in range(ntrees)], levels, m)

    def blocks(a: np.ndarray) -> np.ndarray:
        return forest.score(a)[:, None]

    def grams(a: np.ndarray) -> np.ndarray:
        z = design_rows(a, levels)
        z = z[~np.isnan(z).any(1)]
        return z.T @ z

    scored = materialize(project(x, key, list(names), blocks, ["score"]), "iforest")
    limit = quantiles(scored, ["score"], (), [1 - alpha]).first()["q"][0]
    expected = Expected(matrix_sum(x, list(names), grams), levels, sample[:pool], near)

    def drivers(a: np.ndarray) -> np.ndarray:
        real, drop = forest.score(a), []
        for c in range(len(names)):
            b = a.copy()
            b[:, c] = expected.of(a, c)
            drop.append(real - forest.score(b))
        return np.argmax(np.column_stack(drop), 1)[:, None].astype(float)

    odd = x.join(scored.where(F.col("score") > F.lit(limit)).select(key), key, "left_semi")
    driver = project(odd, key, list(names), drivers, ["at"]).select(F.col(key).alias("__key"), F.element_at(F.array(*[F.lit(c) for c in names]), F.col("at").cast("int") + 1).alias("driver"))
    out = scored.withColumn("flag", F.col("score") > F.lit(limit))
    return out.join(driver, F.col(key) == F.col("__key"), "left").select(key, "score", "flag", "driver")


def score_table(found: DataFrame, bins: int = 40) -> DataFrame:
    """(bin, lower, n, n_flagged) of the scores: the table behind their histogram."""
    lo, hi = found.agg(F.min("score"), F.max("score")).first()
    width = (hi - lo) / bins if lo is not None and hi > lo else 1.0
    at = F.least(F.lit(bins - 1), F.floor((F.col("score") - F.lit(lo)) / F.lit(width))).cast("long").alias("bin")
    return found.groupBy(at).agg(F.count("*").alias("n"), F.count_if("flag").alias("n_flagged")).select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lower"), "n", "n_flagged")


def driver_table(found: DataFrame) -> DataFrame:
    """(driver, n) of the flagged rows."""
    return found.where("flag").groupBy("driver").agg(F.count("*").alias("n"))


def row_table(found: DataFrame, df: DataFrame, key: str, value: object, names: Sequence[str]) -> DataFrame:
    """(variable, value, mean, z) of one row: how far each of its numbers is from the column's mean."""
    numbers = [c for c in names if class_of(df.schema[c].dataType) == "numeric"]
    stats = df.agg(*[F.struct(F.avg(finite(c)).alias("m"), F.stddev_samp(finite(c)).alias("s")).alias(f"c{i}") for i, c in enumerate(numbers)])
    one = found.where(F.col(key) == F.lit(value)).select(key).join(df, key).crossJoin(stats.limit(1))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), finite(c).alias("value"), F.col(f"c{i}.m").alias("mean"), F.try_divide(finite(c) - F.col(f"c{i}.m"), F.col(f"c{i}.s")).alias("z")) for i, c in enumerate(numbers)]))
    return one.select(each.alias("x")).select("x.*")


def anomalous(found: DataFrame, df: DataFrame, key: str, flagged: bool = True) -> DataFrame:
    """The rows of the data that were flagged, with their score and driver."""
    rows = found.where("flag") if flagged else found
    return df.join(rows, key)
