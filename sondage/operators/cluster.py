"""Clusters of reduced rows, what separates them and what they are like."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce as reduce_columns
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondage.functions.dist import hyper_upper_log, p_adjust
from sondage.functions.fmt import join_and, percent, signif
from sondage.operators.counts import missing
from sondage.operators.describe import cells, finite, running, value_counts
from sondage.operators.linalg import project
from sondage.operators.reduce import Reduction, na_markers, reduce, reduce_na
from sondage.operators.select import class_of
from sondage.operators.timecode import arcs, days
from sondage.plans.shared import materialize, spread


@dataclass
class Clusters:
    k: int
    rows: DataFrame
    clusters: DataFrame
    centers: np.ndarray
    gap: pd.DataFrame | None


def _fit(x: DataFrame, k: int, seed: int, starts: int):
    return min((KMeans(k=k, seed=seed + i, maxIter=50).fit(x) for i in range(starts)), key=lambda m: m.summary.trainingCost)


def _cost(x: DataFrame, names: Sequence[str], k: int, seed: int, starts: int) -> float:
    """The sum of squares within k clusters."""
    if k == 1:
        return sum(x.agg(*[F.var_pop(c) * F.count(c) for c in names]).first())
    return _fit(x, k, seed, starts).summary.trainingCost


def gap_search(x: DataFrame, names: Sequence[str], k_max: int, B: int, seed: int) -> tuple[int, pd.DataFrame]:
    """The gap statistic (Tibshirani et al. 2001): uniform reference sets in the box of
    the data, by the first k within one standard error of the next maximum."""
    spark, n = x.sparkSession, x.count()
    box = x.agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")) for c in names]).first()
    rows = []
    for k in range(1, k_max + 1):
        own = np.log(_cost(x, names, k, seed, 2))
        ref = []
        for b in range(B):
            unit = lambda j: (F.xxhash64("id", F.lit(seed * 1000 + b), F.lit(j)).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53))  # noqa: B023, E731
            sim = spark.range(n).select(*[(F.lit(box[j].lo) + unit(j) * (box[j].hi - box[j].lo)).alias(c) for j, c in enumerate(names)])
            sim = VectorAssembler(inputCols=list(names), outputCol="features").transform(sim)
            ref.append(np.log(_cost(sim, names, k, seed, 1)))
        rows.append((k, np.mean(ref) - own, np.std(ref) * (1 + 1 / B) ** 0.5))
    t = pd.DataFrame(rows, columns=["k", "gap", "se"])
    for i in range(len(t) - 1):
        if t.gap[i] >= t.gap[i + 1]:
            first = next(j for j in range(i + 1) if t.gap[j] >= t.gap[i] - t.se[i])
            return int(t.k[first]), t
    return k_max, t


def cluster(coords: DataFrame, key: str, k: int | None = None, k_max: int = 6, B: int = 10, nstart: int = 5, seed: int = 1, small_frac: float = 0.05, ambiguous: float = 0.1) -> Clusters:
    """k-means of the coordinates; clusters are numbered by size. The silhouette is the
    simplified one, from distances to the two nearest centres, so it costs one pass."""
    names = [c for c in coords.columns if c != key]
    coords = spread(coords, "cluster-coords")
    x = VectorAssembler(inputCols=names, outputCol="features").transform(coords).persist()
    try:
        gap = None
        if k is None:
            k, gap = gap_search(x, names, k_max, B, seed)
        if k == 1:
            *middle, n = x.agg(*map(F.avg, names), F.count("*")).first()
            sizes, centers = [n], np.array([middle], float)
        else:
            model = _fit(x, k, seed, nstart)
            found = model.transform(x).groupBy("prediction").agg(F.count("*").alias("n"), F.min(key).alias("first")).orderBy(F.desc("n"), "first").collect()
            sizes, centers = [r.n for r in found], np.array([model.clusterCenters()[r.prediction] for r in found])
    finally:
        x.unpersist()
    n = sum(sizes)

    def place(z: np.ndarray) -> np.ndarray:
        d = np.sqrt(np.maximum(((z[:, None] - centers[None]) ** 2).sum(2), 0))
        near = np.sort(d, 1)
        s = 1 - near[:, 0] / np.maximum(near[:, 1], 1e-300) if len(centers) > 1 else np.zeros(len(z))
        return np.column_stack([d.argmin(1) + 1.0, s])

    rows = project(coords, key, names, place, ["cluster", "silhouette"]).withColumn("cluster", F.col("cluster").cast("long"))
    least = max(1, int(np.ceil(small_frac * n)))
    small = [i + 1 for i, size in enumerate(sizes) if size < least]
    rows = rows.withColumns({"is_small_cluster": F.col("cluster").isin(small or [-1]), "is_ambiguous": F.col("silhouette") < ambiguous})
    table = rows.groupBy("cluster").agg(F.count("*").alias("size"), (100 * F.count("*") / n).alias("pct"), F.avg("silhouette").alias("mean_silhouette"))
    return Clusters(k, rows, table, centers, gap)


def stability(coords: DataFrame, key: str, fit: Clusters, B: int = 20, seed: int = 1) -> pd.DataFrame:
    """Mean Jaccard similarity of each cluster with its best match in B refits on
    bootstrap weights (Hennig 2007)."""
    names = [c for c in coords.columns if c != key]
    coords = materialize(coords, "stability")
    total = np.zeros(fit.k)
    for b in range(B):
        u = F.xxhash64(key, F.lit(seed), F.lit(b)).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
        # Poisson(1) weights by inversion
        weight = F.when(u < 0.36787944, 0.0).when(u < 0.73575888, 1.0).when(u < 0.9196986, 2.0).when(u < 0.98101184, 3.0).otherwise(4.0)
        x = VectorAssembler(inputCols=names, outputCol="features").transform(coords.withColumn("w", weight).where("w > 0"))
        again = KMeans(k=fit.k, seed=seed + b, weightCol="w", maxIter=50).fit(x).transform(x).select(key, F.col("prediction").alias("p"))
        both = fit.rows.select(key, "cluster").join(again, key).groupBy("cluster", "p").agg(F.count("*").alias("n"))
        a = both.groupBy("cluster").agg(F.sum("n").alias("na"))
        c = both.groupBy("p").agg(F.sum("n").alias("nb"))
        best = both.join(a, "cluster").join(c, "p").groupBy("cluster").agg(F.max(F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("j")).collect()
        for r in best:
            total[r.cluster - 1] += r.j
    j = total / B
    return pd.DataFrame({"cluster": np.arange(1, fit.k + 1), "jaccard": j, "stability": np.where(j > 0.75, "stable", np.where(j > 0.5, "moderate", "unstable"))})


def cluster_na(df: DataFrame, key: str, names: Sequence[str], ndim: int = 5, **args) -> Clusters:
    """Clusters of rows by which of their values are missing."""
    return cluster(reduce_na(df, key, names, ndim).coords, key, **args)


def incomplete_note(df: DataFrame, names: Sequence[str]) -> tuple[int, int, list[tuple[str, int]]]:
    """(rows, complete rows, columns with the complete rows that leaving each out would
    add, most first): which column costs most."""
    holes = [missing(df, c).cast("int") for c in names]
    total = reduce_columns(lambda a, b: a + b, holes)
    row = df.agg(F.count("*").alias("n"), F.count_if(total == 0).alias("full"), *[F.count_if((total == 1) & (h == 1)).alias(f"c{i}") for i, h in enumerate(holes)]).first()
    gains = [(c, row[f"c{i}"]) for i, c in enumerate(names) if row[f"c{i}"]]
    return row["n"], row["full"], sorted(gains, key=lambda x: -x[1])


def vtest_mean(df: DataFrame, cluster_col: str, names: Sequence[str]) -> DataFrame:
    """(cluster, variable, v): (mean_c - mean) / sqrt(s2 / n_c (n - n_c) / (n - 1)), s2 of the population."""
    long = cells(df, names, [cluster_col])
    per = long.groupBy(cluster_col, "variable").agg(F.count("*").alias("nc"), F.avg("x").alias("mc"))
    every = long.groupBy("variable").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("s2"))
    v = (F.col("mc") - F.col("m")) / F.sqrt(F.col("s2") / F.col("nc") * (F.col("n") - F.col("nc")) / (F.col("n") - 1))
    return per.join(every, "variable").select(cluster_col, "variable", v.alias("v"))


def vtest_share(n_both: int, n_level: int, n_cluster: int, n: int) -> float:
    """Signed normal quantile of the exact hypergeometric tail (Lebart et al. 2006);
    zero at expectation or where the tail passes one half."""
    expected = n_level * n_cluster / n
    if n_both == expected:
        return 0.0
    if n_both > expected:
        log = hyper_upper_log(n_both, n_level, n - n_level, n_cluster)
    else:
        log = hyper_upper_log(n_cluster - n_both, n - n_level, n_level, n_cluster)
    p = float(np.exp(log))
    if p > 0.5:
        return 0.0
    z = -NormalDist().inv_cdf(p) if p > 1e-300 else float(np.sqrt(-2 * log))
    return z if n_both > expected else -z


def frequencies(df: DataFrame, cluster_col: str, names: Sequence[str]) -> DataFrame:
    """(cluster, variable, value, n, share, share_all)."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("value")) for c in names]))
    t = df.select(cluster_col, each.alias("c")).where(F.col(cluster_col).isNotNull() & F.col("c.value").isNotNull()).groupBy(cluster_col, F.col("c.variable").alias("variable"), F.col("c.value").alias("value")).agg(F.count("*").alias("n"))
    per, every = t.groupBy(cluster_col, "variable").agg(F.sum("n").alias("nc")), t.groupBy("variable").agg(F.sum("n").alias("na"))
    level = t.groupBy("variable", "value").agg(F.sum("n").alias("nl"))
    return t.join(per, [cluster_col, "variable"]).join(level, ["variable", "value"]).join(every, "variable").select(cluster_col, "variable", "value", "n", (F.col("n") / F.col("nc")).alias("share"), (F.col("nl") / F.col("na")).alias("share_all"))


def separation(df: DataFrame, cluster_col: str, names: Sequence[str]) -> DataFrame:
    """(variable, separation): the share of a number's variance between clusters (eta squared)."""
    long = cells(df, names, [cluster_col]).where(F.col(cluster_col).isNotNull())
    per = long.groupBy(cluster_col, "variable").agg(F.count("*").alias("k"), F.avg("x").alias("mc"), F.var_pop("x").alias("v"))
    # between over total, from group moments
    m = per.groupBy("variable").agg(F.sum(F.col("k") * F.col("mc")).alias("s"), F.sum("k").alias("n"))
    both = per.join(m, "variable").withColumn("gm", F.col("s") / F.col("n"))
    out = both.groupBy("variable").agg(F.sum(F.col("k") * (F.col("mc") - F.col("gm")) ** 2).alias("between"), F.sum(F.col("k") * F.col("v")).alias("within"))
    return out.select("variable", F.when(F.col("between") + F.col("within") > 0, F.col("between") / (F.col("between") + F.col("within"))).alias("separation"))


#: Rows of a part in which labels are shuffled, at least.
PART = 1 << 16


#: The generator's own draws take fewer objects than this.
MANY = 1_000_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` drawn without return are good; any numbers. Beyond the generator's
    limit by the ratio of uniforms (Stadlober 1990): a hat of fixed shape over the mode,
    scaled by the standard deviation, and log factorials for the exact acceptance."""
    if good + bad < MANY:
        return int(rng.hypergeometric(good, bad, n))
    total, few, many = good + bad, min(good, bad), max(good, bad)
    m = min(n, total - n)
    if not m or not few:
        x = 0
    else:
        share = few / total
        centre = m * share + 0.5
        spread = math.sqrt((total - m) / (total - 1) * m * share * (1 - share) + 0.5)
        width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
        stop = min(min(m, few) + 1, math.floor(centre + 16 * spread))

        def log_p(k: int) -> float:
            return -(math.lgamma(k + 1) + math.lgamma(few - k + 1) + math.lgamma(m - k + 1) + math.lgamma(many - m + k + 1))

        top = log_p((m + 1) * (few + 1) // (total + 2))
        while True:
            u, v = rng.random(), rng.random()
            at = centre + width * (v - 0.5) / u if u else -1.0
            if not 0 <= at < stop:
                continue
            x = int(at)
            if 2 * math.log(u) <= log_p(x) - top:
                break
    # back from the smaller kind and the smaller of drawn and left
    if good > bad:
        x = m - x
    return good - x if m < n else x


def split(rng: np.random.Generator, labels: np.ndarray, n: int) -> np.ndarray:
    """How many of each label are among ``n`` drawn without return."""
    if labels.sum() < MANY:
        return rng.multivariate_hypergeometric(labels, n, method="marginals")
    out, left, rest = np.zeros_like(labels), int(labels.sum()), n
    for i, k in enumerate(labels.tolist()):
        out[i] = hypergeometric(rng, k, left - k, rest) if rest else 0
        left, rest = left - k, rest - int(out[i])
    return out


def dealt_to(seed: Sequence[int], labels: np.ndarray, ends: np.ndarray, at: int) -> np.ndarray:
    """How many of each label fall in part ``at`` when all rows are shuffled; ``ends`` are
    running sums of the parts' sizes. Parts are halved, and the draw at each halving is
    seeded by it, so every part finds its own in as many draws as halvings lead to it."""
    lo, hi = 0, len(ends)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = split(np.random.default_rng([*seed, lo, hi]), labels, int(ends[mid - 1] - (ends[lo - 1] if lo else 0)))
        if at < mid:
            hi, labels = mid, left
        else:
            lo, labels = mid, labels - left
    return labels


def _deal(rng: np.random.Generator, labels: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """How many of each label fall in each of a few parts when all rows are shuffled."""
    left, out = labels.copy(), np.empty((len(parts), len(labels)), np.int64)
    for i, n in enumerate(parts):
        out[i] = split(rng, left, int(n)) if i + 1 < len(parts) else left
        left = left - out[i]
    return out


def shuffled_separations(df: DataFrame, cluster_col: str, key: str, names: Sequence[str], B: int, seed: int) -> dict[str, np.ndarray]:
    """For each number the separation of the clusters, and of B shufflings of all rows'
    labels. Rows are parted by a hash of their key; a shuffling first deals the labels
    over the parts, by halvings that all tasks draw alike, and then shuffles those of
    each part, which is a shuffling of all rows."""
    x = [finite(c).alias(f"x{i}") for i, c in enumerate(names)]
    rows = df.where(F.col(cluster_col).isNotNull())
    n = rows.count()
    parts = int(np.ceil(n / max(PART, np.sqrt(n)))) or 1
    part = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(parts)).cast("int").alias("part")
    sizes = [F.count(f"x{i}").alias(f"n{i}") for i in range(len(names))]
    table = rows.select(F.col(cluster_col).cast("string").alias("g"), part, *x)
    held = table.groupBy("g", "part").agg(*sizes).toPandas()
    groups = sorted(held.g.unique())
    moments = table.agg(*[F.struct(F.avg(f"x{i}").alias("m"), (F.var_pop(f"x{i}") * F.count(f"x{i}")).alias("ss")) for i in range(len(names))]).first()
    by_part = {i: held.pivot_table(index="part", columns="g", values=f"n{i}", aggfunc="sum", fill_value=0).reindex(columns=groups, fill_value=0) for i in range(len(names))}
    order = by_part[0].index.to_numpy() if names else np.empty(0)
    label_n = {i: t.sum().to_numpy().astype(np.int64) for i, t in by_part.items()}
    ends = {i: np.cumsum(t.sum(axis=1).to_numpy().astype(np.int64)) for i, t in by_part.items()}
    means = [m.m or 0.0 for m in moments]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        at, out = int(np.searchsorted(order, rows["part"].iloc[0])), []
        rows = rows.sort_values(["g", *[f"x{i}" for i in range(len(names))]])
        code = rows["g"].map({g: i for i, g in enumerate(groups)}).to_numpy()
        for i in range(len(names)):
            v = rows[f"x{i}"].to_numpy(float) - means[i]
            there = ~np.isnan(v)
            v = v[there]
            sums = np.empty((B + 1, len(groups)))
            sums[0] = np.bincount(code[there], v, len(groups))
            own = np.random.default_rng([seed, 7, i, at])
            for b in range(1, B + 1):
                counts = dealt_to([seed, b, i], label_n[i], ends[i], at)
                edge = np.concatenate([[0], np.cumsum(own.permutation(v))])
                stops = np.cumsum(counts)
                sums[b] = edge[stops] - edge[stops - counts]
            out.append(pd.DataFrame({"variable": i, "rep": np.repeat(np.arange(B + 1), len(groups)), "g": np.tile(np.arange(len(groups)), B + 1), "s": sums.ravel()}))
        return pd.concat(out)

    got = table.groupBy("part").applyInPandas(run, "variable long, rep long, g long, s double").groupBy("variable", "rep", "g").agg(F.sum("s").alias("s"))
    size = df.sparkSession.createDataFrame([(i, k, int(c)) for i, t in label_n.items() for k, c in enumerate(t)], "variable long, g long, n long")
    between = got.join(F.broadcast(size), ["variable", "g"]).where("n > 0").groupBy("variable", "rep").agg(F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"), (F.sum("s") * F.sum("s") / F.sum("n")).alias("all"))
    out = {c: np.full(B + 1, np.nan) for c in names}
    for r in between.collect():
        if (ss := moments[r.variable].ss) and ss > 0:
            out[names[r.variable]][r.rep] = (r.between - r["all"]) / ss
    return out


def table_v(t: np.ndarray) -> float:
    """Cramér's V of a table of counts."""
    t = t[t.sum(1) > 0][:, t.sum(0) > 0]
    if min(t.shape) < 2:
        return float("nan")
    e = np.outer(t.sum(1), t.sum(0)) / t.sum()
    return float(np.sqrt(((t - e) ** 2 / e).sum() / t.sum() / (min(t.shape) - 1)))


def var_contrib(df: DataFrame, cluster_col: str, key: str, names: Sequence[str], B: int = 199, seed: int = 1) -> pd.DataFrame:
    """Separation against shuffled labels of all rows; BH over the columns. A category's
    shuffled tables follow from its counts by level and cluster alone (they are
    multivariate hypergeometric)."""
    numbers = [c for c in names if class_of(df.schema[c].dataType) == "numeric"]
    factors = [c for c in names if c not in numbers]
    found = shuffled_separations(df, cluster_col, key, numbers, B, seed) if numbers else {}
    if factors:
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level")) for c in factors]))
        cells = df.where(F.col(cluster_col).isNotNull()).select(F.col(cluster_col).cast("string").alias("g"), each.alias("c")).where("c.level is not null").groupBy("c.variable", "c.level", "g").agg(F.count("*").alias("n")).toPandas()
        for i, c in enumerate(factors):
            t = cells[cells.variable == c].pivot_table(index="level", columns="g", values="n", aggfunc="sum", fill_value=0).to_numpy().astype(np.int64)
            rng = np.random.default_rng([seed, 11, i])
            found[c] = np.array([table_v(t), *(table_v(_deal(rng, t.sum(0), t.sum(1))) for _ in range(B))]) if t.size else np.full(B + 1, np.nan)
    rows = []
    for c in names:
        real, null = found[c][0], found[c][1:]
        missing = np.isnan(real)
        rows.append((c, class_of(df.schema[c].dataType), None if missing else float(real), None if missing else float(null.mean()), None if missing else float((1 + (null >= real - 1e-12).sum()) / (B + 1))))
    out = pd.DataFrame(rows, columns=["variable", "type", "separation", "permuted", "p"]).astype({"separation": float, "permuted": float, "p": float})
    out["p_adj"] = p_adjust([None if np.isnan(p) else p for p in out.p], "BH")
    out["p_adj"] = out.p_adj.astype(float)
    out["verdict"] = np.select([out.separation >= 0.9, ~(out.p_adj <= 0.05), out.separation >= 0.15], ["defines", "chance", "carries"], "weak")
    return out.sort_values("separation", ascending=False, kind="stable")


#: The least difference worth naming, in standard deviations of a number and in shares.
LEAST_SIZE = {"number": 0.2, "share": 0.1}
#: The cycles of a time column, in words.
CYCLES = {"hour": "time of day", "wday": "day of the week", "mday": "day of the month", "yday": "time of year"}


def _middles(df: DataFrame, cluster_col: str, names: Sequence[str]) -> dict[tuple[object, str], tuple[float, float]]:
    """By (cluster, variable), and (None, variable) for all rows: the quartiles, as values that occur."""
    values = value_counts(df, names, [cluster_col])
    every = values.groupBy("variable", "x").agg(F.sum("cnt").alias("cnt"))
    out = {}
    for keys, table in (([cluster_col, "variable"], values.where(F.col(cluster_col).isNotNull())), (["variable"], every)):
        rows = running(table, keys, with_n=True)
        at = [F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * q), F.col("x"))).alias(f"q{i}") for i, q in enumerate((0.25, 0.75))]
        for r in rows.groupBy(*keys).agg(*at).collect():
            out[r[cluster_col] if len(keys) == 2 else None, r.variable] = (r.q0, r.q1)
    return out


def _of_them(share: float, every: float) -> str:
    own = "none of them" if round(100 * share) == 0 else f"{'only ' if share < every else ''}{percent(share)} of them"
    return f"{own}, of all rows {percent(every)}"


def characterize(df: DataFrame, cluster_col: str, names: Sequence[str], threshold: float = 1.96, cycles: dict[str, Sequence[str]] | None = None, missing: bool = False) -> pd.DataFrame:
    """(cluster, variable, aspect, kind, v, size, eligible, distinctive, description): means by
    ``vtest_mean``, categories by their most extreme level, times by their place on the
    line and by the stretch of each of their ``cycles`` in which a cluster stands out.
    ``size`` is a difference in standard deviations (kind number) or of shares (share);
    ``distinctive`` asks for both a v-test and a size, and of a stretch, which is chosen
    to differ, for three standard errors too. ``missing`` words markers of missingness."""
    kind = {c: class_of(df.schema[c].dataType) for c in names}
    times = [c for c in names if kind[c] == "time"]
    lengths = [c for c in times if isinstance(df.schema[c].dataType, T.DayTimeIntervalType)]
    numbers = [c for c in names if kind[c] == "numeric"]
    factors = [c for c in names if c not in numbers and c not in times]
    rows = []
    if numbers or times:
        line = df.select(cluster_col, *numbers, *[days(df, c).alias(c) for c in times])
        spread = {r.variable: r.s for r in cells(line, [*numbers, *times]).groupBy("variable").agg(F.stddev_samp("x").alias("s")).collect()}
        mean = {(r[cluster_col], r.variable): r.m for r in cells(line, [*numbers, *times], [cluster_col]).groupBy(cluster_col, "variable").agg(F.avg("x").alias("m")).collect()}
        every = {r.variable: r.m for r in cells(line, [*numbers, *times]).groupBy("variable").agg(F.avg("x").alias("m")).collect()}
        middle = _middles(line, cluster_col, [*numbers, *times])
        for r in vtest_mean(line, cluster_col, [*numbers, *times]).collect():
            c, g = r.variable, r[cluster_col]
            if g is None:
                continue
            up = r.v is not None and r.v > 0
            say = (lambda x: signif(x, 4)) if c in numbers else (lambda x: f"{signif(x, 4)} days") if c in lengths else lambda x: str((pd.Timestamp(0) + pd.Timedelta(days=x)).round("min")).removesuffix(" 00:00:00")
            word = ("higher" if up else "lower") if c in numbers else ("longer" if up else "shorter") if c in lengths else "later" if up else "earlier"
            own, of_all = middle[g, c], middle[None, c]
            said = f"{c} is {word}: the middle half {say(own[0])} to {say(own[1])}, of all rows {say(of_all[0])} to {say(of_all[1])}"
            size = abs(mean[g, c] - every[c]) / spread[c] if spread[c] else float("nan")
            rows.append((g, c, "" if c in numbers else "length" if c in lengths else "time line", "number", r.v, size, True, said))
    for (g, c, a), (arc, n_group, n_all) in arcs(df, cluster_col, {c: (cycles or {}).get(c, []) for c in times if c not in lengths}).items():
        v = vtest_share(arc.n_group, arc.n_all, n_group, n_all)
        rows.append((g, c, CYCLES[a], "share", v, abs(arc.share - arc.share_all), arc.stands_out, f"{c} falls {arc.label} for {_of_them(arc.share, arc.share_all)}"))
    if factors:
        t = frequencies(df, cluster_col, factors).toPandas()
        totals = t.groupby("variable").n.sum()
        per = t.groupby([cluster_col, "variable"]).n.sum()
        level = t.groupby(["variable", "value"]).n.sum()
        best: dict[tuple[object, str], tuple] = {}
        # a level that a cluster lacks is one of its shares, too
        for c in totals.index:
            held = {(getattr(r, cluster_col), r.value): int(r.n) for r in t[t.variable == c].itertuples()}
            for g in sorted(t[t.variable == c][cluster_col].unique()):
                for value in sorted(level[c].index):
                    n_group, n_all = int(per[g, c]), int(totals[c])
                    own, of_all = held.get((g, value), 0) / n_group, int(level[c, value]) / n_all
                    v = vtest_share(held.get((g, value), 0), int(level[c, value]), n_group, n_all)
                    if (g, c) not in best or abs(v) > abs(best[g, c][0]):
                        best[g, c] = (v, value, own, of_all)
        for (g, c), (v, value, own, of_all) in best.items():
            if kind[c] == "logical" and value == "false":
                v, value, own, of_all = -v, "true", 1 - own, 1 - of_all
            what = "is missing" if missing else "is true" if kind[c] == "logical" else f"is '{value}'"
            if missing and value == "present":
                v, own, of_all = -v, 1 - own, 1 - of_all
            rows.append((g, c, "" if kind[c] == "logical" or missing else value, "share", v, abs(own - of_all), True, f"{c} {what} for {_of_them(own, of_all)}"))
    out = pd.DataFrame(rows, columns=["cluster", "variable", "aspect", "kind", "v", "size", "eligible", "description"]).astype({"v": float, "size": float, "eligible": bool})
    floor = out["kind"].map(LEAST_SIZE).astype(float)
    out["distinctive"] = (out.v.abs() >= threshold) & (out["size"] >= floor) & out.eligible
    return out.assign(far=-out.v.abs()).sort_values(["cluster", "far", "variable", "aspect"], kind="stable").drop(columns="far").reset_index(drop=True)


@dataclass
class Profile:
    reduce: Reduction
    cluster: Clusters
    characterization: pd.DataFrame
    frequencies: DataFrame | None
    by_cluster: dict[str, DataFrame]
    var_contrib: pd.DataFrame
    summary: list[str]


def profile(df: DataFrame, key: str, names: Sequence[str], k: int | None = None, ndim: int = 5, B: int = 199, seed: int = 1, missing: bool = False) -> Profile:
    """reduce, cluster, describe."""
    from sondage.operators.describe import describe_all

    red = reduce(df, key, names, ndim)
    fit = cluster(red.coords, key, k, seed=seed)
    # joined once: a job that joins again sends a small side through the driver again
    rows = spread(df.join(fit.rows.select(key, "cluster"), key), "profile-rows")
    what = characterize(rows, "cluster", names, cycles=red.cycles, missing=missing)
    factors = [c for c in names if class_of(df.schema[c].dataType) not in ("numeric", "time")]
    lines = [f"Cluster {c}: {join_and(list(part.description.head(4)))}." for c, part in what[what.distinctive].groupby("cluster")]
    return Profile(red, fit, what, frequencies(rows, "cluster", factors) if factors else None, describe_all(rows, ["cluster"], list(names)), var_contrib(rows, "cluster", key, names, B, seed), lines)


def profile_na(df: DataFrame, key: str, names: Sequence[str], **args) -> Profile:
    """``profile`` of which values are missing."""
    marks = na_markers(df, key, names)
    return profile(marks, key, marks.columns[1:], missing=True, **args)
