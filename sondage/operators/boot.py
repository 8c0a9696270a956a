"""Bootstrap intervals of a statistic, and of differences between groups.

Every replicate is a resample of all values of the group, drawn from the counts of
its different values, whatever their number.

* Means and variances need sums alone. The different values of a group are parted
  by a hash into parts of about the square root of their number; a replicate first
  deals the n draws over the parts (a multinomial draw, the same in every task, as
  it is seeded by group and replicate) and then within each part over its values,
  which is the multinomial draw over all values. Parts are tasks; their sums are
  added up.
* A median needs two order statistics of the resample, whose ranks in the data
  follow from order statistics of uniform draws (beta-distributed). So ranks are
  drawn and read from the running counts of the values.
* A statistic of the caller's own is an aggregate of Spark, a function of a value
  column and a weight column. Its replicates have Poisson weights, drawn in Spark.

Generators are seeded by group, part and replicate: results don't depend on the
partitioning."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.operators.describe import finite, keyed, running
from sondage.plans.shared import materialize

#: Different values of a part, at least; replicates drawn at once.
PART, BLOCK = 4096, 64
#: A statistic: a name, or an aggregate of (values, weights).
Stat = str | Callable[[Column, Column], Column]


def _same(a: str, b: str, by: Sequence[str]) -> Column:
    on = F.lit(True)
    for c in by:
        on = on & (F.col(f"{a}.{c}") == F.col(f"{b}.{c}"))
    return on


def values(df: DataFrame, col: str, by: Sequence[str]) -> DataFrame:
    """(by..., x, cnt): the different finite values of each group."""
    return keyed(df, by).select(*by, finite(col).alias("x")).where("x is not null").groupBy(*by, "x").agg(F.count("*").alias("cnt"))


def _key(group: Sequence) -> list[int]:
    return [zlib.crc32(str(g).encode()) for g in group]


def _sums(rows: pd.DataFrame, weight: np.ndarray, R: int, seed: int, group: Sequence, part: int) -> np.ndarray:
    """Of one part: the draws, their sum and their sum of squares about the centre, by replicate."""
    rows = rows.sort_values("x")
    x, w = rows["x"].to_numpy() - rows["centre"].iloc[0], rows["cnt"].to_numpy()
    n, share = int(weight.sum()), w / w.sum()
    terms = np.column_stack([np.ones(len(x)), x, x * x])
    out = np.empty((R, 3))
    for at in range(0, R, BLOCK):
        reps = range(at, min(R, at + BLOCK))
        held = np.random.default_rng([seed, at, *_key(group)]).multinomial(n, weight / n, len(reps))[:, part]
        own = np.random.default_rng([seed, at, part + 1, *_key(group)])
        out[at : at + len(reps)] = own.multinomial(held, share) @ terms
    return out


def _sum_draws(vals: DataFrame, by: Sequence[str], stat: str, R: int, seed: int) -> DataFrame:
    n, total = F.sum("cnt"), F.sum(F.col("x") * F.col("cnt"))
    groups = vals.groupBy(*by).agg((total / n).alias("centre"), F.count("*").alias("k"))
    size = F.greatest(F.lit(float(PART)), F.sqrt("k"))
    parts = F.ceil(F.col("k") / size).cast("int")
    dealt = vals.alias("v").join(groups.alias("g"), _same("v", "g", by)).select(*[F.col(f"v.{c}").alias(c) for c in by], "x", "cnt", "centre", F.pmod(F.xxhash64("x"), parts).cast("int").alias("part"))
    dealt = materialize(dealt, "boot-values")
    weights = dealt.groupBy(*by, "part").agg(F.sum("cnt").alias("held"))
    weights = weights.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("part", "held"))).alias("weights"))
    # a part's weights are one more row of it, so that no value carries them
    known = dealt.groupBy(*by, "part").agg(F.first("centre").alias("centre")).alias("p").join(weights.alias("w"), _same("p", "w", by))
    known = known.select(*[F.col(f"p.{c}").alias(c) for c in by], "part", F.lit(None).cast("double").alias("x"), F.lit(None).cast("long").alias("cnt"), "centre", "weights")
    rows = dealt.select(*by, "part", "x", "cnt", "centre", F.lit(None).cast(known.schema["weights"].dataType).alias("weights")).unionByName(known)
    types = {f.name: f.dataType.simpleString() for f in vals.schema}

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        *group, part = key
        listed = rows["weights"].dropna().iloc[0]
        held = np.array([e["held"] for e in listed])
        at = [e["part"] for e in listed].index(part)
        got = _sums(rows[rows["weights"].isna()].astype({"cnt": "int64"}), held, R, seed, group, at)
        return pd.DataFrame({**dict(zip(by, group, strict=True)), "rep": np.arange(R), "s0": got[:, 0], "s1": got[:, 1], "s2": got[:, 2], "centre": rows["centre"].iloc[0]})

    got = rows.groupBy(*by, "part").applyInPandas(run, ", ".join([*(f"`{c}` {types[c]}" for c in by), "rep long, s0 double, s1 double, s2 double, centre double"]))
    sums = got.groupBy(*by, "rep").agg(F.sum("s0").alias("s0"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.max("centre").alias("centre"))
    mean = F.col("s1") / F.col("s0")
    var = F.when(F.col("s0") > 1, F.greatest(F.lit(0.0), F.col("s2") - F.col("s0") * mean * mean) / (F.col("s0") - 1))
    value = {"mean": F.col("centre") + mean, "var": var, "sd": F.sqrt(var)}[stat]
    return sums.select(*by, "rep", value.alias("value"))


#: Cells in which ranks and values meet.
CELLS = 1024


def _median_draws(vals: DataFrame, by: Sequence[str], R: int, seed: int) -> DataFrame:
    upto = running(vals, by)
    sizes = vals.groupBy(*by).agg(F.sum("cnt").alias("n"))
    types = {f.name: f.dataType.simpleString() for f in vals.schema}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for *group, n in p.itertuples(index=False):
                rng = np.random.default_rng([seed, *_key(group)])
                low, high = (n - 1) // 2 + 1, n // 2 + 1
                u = rng.beta(low, n - low + 1, R)
                v = u if low == high else 1 - (1 - u) * rng.beta(n - low, 1, R)
                ranks = np.minimum(np.column_stack([u, v]) * n, n - 1).astype(np.int64) + 1
                yield pd.DataFrame({**{c: [g] * (2 * R) for c, g in zip(by, group, strict=True)}, "rep": np.repeat(np.arange(R), 2), "rank": ranks.ravel()})

    ranks = materialize(sizes.select(*by, "n").mapInPandas(run, ", ".join([*(f"`{c}` {types[c]}" for c in by), "rep long, rank long"])), "boot-ranks")
    span = ranks.groupBy(*by).agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"))

    def with_span(rows: DataFrame) -> DataFrame:
        return rows.alias("r").join(span.alias("s"), _same("r", "s", by)).select(*[F.col(f"r.{c}").alias(c) for c in by], *[F.col(f"r.{c}") for c in rows.columns if c not in by], "lo", "hi")

    def cell(rank: Column) -> Column:
        return F.floor((rank - F.col("lo")) * CELLS / (F.col("hi") - F.col("lo") + 1))

    here = with_span(upto).where((F.col("upto") >= F.col("lo")) & (F.col("upto") - F.col("cnt") < F.col("hi")))
    first, last = F.greatest(F.col("upto") - F.col("cnt") + 1, F.col("lo")), F.least("upto", "hi")
    here = here.select(*by, "x", "upto", "cnt", F.explode(F.sequence(cell(first), cell(last))).alias("cell"))
    asked = with_span(ranks).select(*by, "rep", "rank", cell(F.col("rank")).alias("cell"))
    on = _same("a", "h", [*by, "cell"]) & (F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("cnt"))
    return asked.alias("a").join(here.alias("h"), on).groupBy(*[F.col(f"a.{c}").alias(c) for c in by], "rep").agg(F.avg("x").alias("value"))


def _poisson_draws(vals: DataFrame, by: Sequence[str], stat: Callable[[Column, Column], Column], R: int, seed: int) -> DataFrame:
    reps = np.arange(R)
    types = {f.name: f.dataType.simpleString() for f in vals.schema}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for *group, x, cnt in p[[*by, "x", "cnt"]].itertuples(index=False):
                w = np.random.default_rng([seed, *_key(group), int(np.float64(x).view(np.uint64))]).poisson(cnt, R)
                hit = w > 0
                yield pd.DataFrame({**{c: [g] * int(hit.sum()) for c, g in zip(by, group, strict=True)}, "rep": reps[hit], "x": x, "w": w[hit]})

    drawn = vals.mapInPandas(run, ", ".join([*(f"`{c}` {types[c]}" for c in by), "rep long, x double, w long"]))
    return drawn.groupBy(*by, "rep").agg(stat(F.col("x"), F.col("w")).cast("double").alias("value"))


def draws(df: DataFrame, col: str, by: Sequence[str] = (), stat: Stat = "mean", R: int = 2000, seed: int = 1) -> DataFrame:
    """(by..., rep, value): replicates of the statistic."""
    vals = values(df, col, by)
    if callable(stat):
        return _poisson_draws(vals, by, stat, R, seed)
    return _median_draws(vals, by, R, seed) if stat == "median" else _sum_draws(vals, by, stat, R, seed)


def observed(df: DataFrame, col: str, by: Sequence[str] = (), stat: Stat = "mean") -> DataFrame:
    x = finite(col)
    if callable(stat):
        out = values(df, col, by).groupBy(*by).agg(stat(F.col("x"), F.col("cnt")).cast("double").alias("observed"), F.sum("cnt").alias("n"))
    elif stat == "median":
        out = _middle(running(values(df, col, by), by), by).select(*by, ((F.col("b1") + F.col("b2")) / 2).alias("observed"), "n")
    else:
        f = {"mean": F.avg(x), "sd": F.stddev_samp(x), "var": F.var_samp(x)}[stat]
        return keyed(df, by).groupBy(*by).agg(f.alias("observed"), F.count(x).alias("n"))
    groups = keyed(df, by).groupBy(*by).agg(F.count(x).alias("held"))
    both = groups.alias("g").join(out.alias("o"), _same("g", "o", by), "left")
    return both.select(*[F.col(f"g.{c}").alias(c) for c in by], "observed", F.coalesce("n", F.lit(0)).alias("n"))


def _middle(upto: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., n, a0, a1, c0, c1, b1, b2): values at the ranks that a median needs.
    ``b`` are those of the whole group; ``a``, ``c`` those of the group less one
    value, below and above which it was."""
    n = upto.groupBy(*by).agg(F.max("upto").alias("n"))
    at = upto.alias("u").join(n.alias("n"), _same("u", "n", by)).select(*[F.col(f"u.{c}").alias(c) for c in by], "x", "cnt", "upto", "n")

    def holds(rank: Column) -> Column:
        return F.max(F.when((F.col("upto") > rank) & (F.col("upto") - F.col("cnt") <= rank), F.col("x")))

    end = F.col("n") - 1
    low, high = F.floor((F.col("n") - 2) / 2), F.floor(end / 2)
    ranks = {"a0": low, "a1": F.least(low + 1, end), "c0": high, "c1": F.least(high + 1, end), "b1": F.floor(end / 2), "b2": F.floor(F.col("n") / 2)}
    return at.groupBy(*by, "n").agg(*[holds(r).alias(k) for k, r in ranks.items()])


def acceleration(df: DataFrame, col: str, by: Sequence[str], stat: str) -> DataFrame:
    """(by..., acc) of the BCa interval (Efron 1987): from the statistic without one
    copy of each value, in closed form, weighted by its count."""
    if stat == "median":
        upto = running(values(df, col, by), by)
        rows = upto.alias("v").join(_middle(upto, by).alias("g"), _same("v", "g", by))
        gone = F.col("upto") - 1
        low, high = F.floor((F.col("n") - 2) / 2), F.floor((F.col("n") - 1) / 2)
        jack = (F.when(low < gone, F.col("a0")).otherwise(F.col("a1")) + F.when(high < gone, F.col("c0")).otherwise(F.col("c1"))) / 2
    else:
        # sums over the rows themselves: without order, nothing has to be counted or shuffled first
        vals = keyed(df, by).select(*by, finite(col).alias("x"), F.lit(1).alias("cnt")).where("x is not null")
        m = vals.groupBy(*by).agg(F.count("*").alias("n"), F.avg("x").alias("m"))
        far = vals.alias("v").join(m.alias("g"), _same("v", "g", by)).select(*[F.col(f"v.{c}").alias(c) for c in by], "n", "m", (F.col("x") - F.col("m")).alias("d"))
        ss = materialize(far.groupBy(*by, "n", "m").agg(F.sum(F.col("d") * F.col("d")).alias("ss")), "boot-squares")
        rows = vals.alias("v").join(ss.alias("g"), _same("v", "g", by))
        d, size = F.col("x") - F.col("m"), F.col("n")
        var = F.when(size > 2, F.greatest(F.lit(0.0), F.col("ss") - size / (size - 1) * d * d) / (size - 2)).otherwise(0.0)
        jack = {"mean": (size * F.col("m") - F.col("x")) / (size - 1), "var": var, "sd": F.sqrt(var)}[stat]
    rows = rows.where("n > 1").select(*[F.col(f"v.{c}").alias(c) for c in by], "cnt", jack.alias("jack"))
    mean = rows.groupBy(*by).agg((F.sum(F.col("jack") * F.col("cnt")) / F.sum("cnt")).alias("jm"))
    d = F.col("jm") - F.col("jack")
    cubes = rows.alias("r").join(mean.alias("m"), _same("r", "m", by)).groupBy(*[F.col(f"r.{c}").alias(c) for c in by]).agg(F.sum(d * d * d * F.col("cnt")).alias("d3"), F.sum(d * d * F.col("cnt")).alias("d2"))
    return cubes.select(*by, F.when(F.col("d2") > 0, F.col("d3") / (6 * F.pow("d2", F.lit(1.5)))).otherwise(0.0).alias("acc"))


def _interval(kind: str, obs: float, r: np.ndarray, conf: float, acc: float = 0.0) -> tuple[float, float]:
    a, nd = (1 - conf) / 2, NormalDist()
    if kind == "normal":
        z = nd.inv_cdf(1 - a)
        s = r.std(ddof=1)
        return obs - z * s, obs + z * s
    lo, hi = np.quantile(r, [a, 1 - a])
    if kind == "basic":
        return 2 * obs - hi, 2 * obs - lo
    below = (r < obs).mean()
    if kind == "percentile" or below in (0, 1):
        return float(lo), float(hi)
    z0 = nd.inv_cdf(below)
    ends = [nd.cdf(z0 + (z0 + z) / (1 - acc * (z0 + z))) for z in (nd.inv_cdf(a), nd.inv_cdf(1 - a))]
    return tuple(float(q) for q in np.quantile(r, ends))


def boot_ci(df: DataFrame, col: str, by: Sequence[str] = (), stat: Stat = "mean", R: int = 2000, conf: float = 0.95, ci_type: str = "percentile", seed: int = 1) -> DataFrame:
    """(by..., stat, observed, lower, upper, conf, R, ci_type, n). A statistic of the
    caller's own has no closed jackknife, so BCa corrects its bias alone."""
    if ci_type not in ("percentile", "bca", "normal", "basic"):
        raise ValueError(f"unknown ci_type {ci_type!r}")
    if not 0 < conf < 1 or R < 2:
        raise ValueError("conf must lie between 0 and 1, and R be 2 or more")
    obs = observed(df, col, by, stat)
    types = {f.name: f.dataType.simpleString() for f in obs.schema}
    reps = draws(df, col, by, stat, R, seed).groupBy(*by).agg(F.sort_array(F.collect_list("value")).alias("reps"))
    both = obs.alias("o").join(reps.alias("r"), _same("o", "r", by), "left").select(*[F.col(f"o.{c}").alias(c) for c in by], "observed", "n", "reps")
    if ci_type == "bca" and not callable(stat):
        acc = acceleration(df, col, by, stat)
        both = both.alias("o").join(acc.alias("a"), _same("o", "a", by), "left").select(*[F.col(f"o.{c}").alias(c) for c in by], "observed", "n", "reps", "acc")
    else:
        both = both.withColumn("acc", F.lit(0.0))
    label = "custom" if callable(stat) else stat

    def run(parts):
        for p in parts:
            lower, upper = [], []
            for o, n, r, acc in zip(p["observed"], p["n"], p["reps"], p["acc"], strict=True):
                if n < 2 or r is None or not len(r):
                    lower.append(None)
                    upper.append(None)
                    continue
                lo, hi = _interval(ci_type, o, np.asarray(r), conf, acc or 0.0)
                lower.append(lo)
                upper.append(hi)
            yield p[list(by)].assign(stat=label, observed=p["observed"], lower=lower, upper=upper, conf=conf, R=R, ci_type=ci_type, n=p["n"])

    return both.mapInPandas(run, ", ".join([*(f"`{b}` {types[b]}" for b in by), "stat string, observed double, lower double, upper double, conf double, R long, ci_type string, n long"]))


def boot_diff(df: DataFrame, col: str, group: str, stat: Stat = "mean", R: int = 2000, conf: float = 0.95, adjust: str = "max_t", seed: int = 1, ref=None, ci_type: str = "percentile") -> tuple[pd.DataFrame, np.ndarray]:
    """All pairs of groups (or each against ``ref``): D = to - from, simultaneous by
    the largest |Z| of each replicate (Westfall & Young 1993). Without it intervals are
    of ``ci_type``, where BCa corrects the bias only. Groups are few."""
    obs = {r[group]: (r.observed, r.n) for r in observed(df, col, [group], stat).collect() if r.n >= 2}
    rep = draws(df, col, [group], stat, R, seed).toPandas().pivot(index="rep", columns=group, values="value")
    names = sorted(obs)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]] if ref is None else [(ref, b) for b in names if b != ref]
    if len(pairs) == 1:
        adjust = "none"
    d = np.column_stack([rep[b] - rep[a] for a, b in pairs])
    point = np.array([obs[b][0] - obs[a][0] for a, b in pairs])
    se = d.std(0, ddof=1)
    z = np.abs(d - d.mean(0)) / se
    top = z.max(1)
    raw = np.abs(point) / se
    if adjust == "max_t":
        q = np.quantile(top, conf)
        lower, upper = point - q * se, point + q * se
        p, p_adj = (z >= raw).mean(0), (top[:, None] >= raw).mean(0)
    else:
        m = len(pairs) if adjust == "bonferroni" else 1
        ends = np.array([_interval(ci_type, float(o), d[:, i], 1 - (1 - conf) / m) for i, o in enumerate(point)])
        lower, upper = ends[:, 0], ends[:, 1]
        p = np.minimum(1, 2 * np.minimum((d <= 0).mean(0), (d >= 0).mean(0)))
        p_adj = np.minimum(1, m * p)
    out = pd.DataFrame({"stat": "custom" if callable(stat) else stat, "from": [a for a, _ in pairs], "to": [b for _, b in pairs], "observed": point, "lower": lower, "upper": upper, "conf": conf, "R": R, "ci_type": ci_type, "adjust": adjust, "n_comparisons": len(pairs), "n_from": [obs[a][1] for a, _ in pairs], "n_to": [obs[b][1] for _, b in pairs], "p_value": p, "p_adj": p_adj, "p_superiority": (d > 0).mean(0)})
    out["excludes_zero"] = (out.lower > 0) | (out.upper < 0)
    return out, d
