"""The small tables behind plots, and which geometry a pair of columns gets."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.functions.dist import t_ppf
from sondage.functions.kernel import bandwidth, peaks
from sondage.functions.kernel import density as kernel_density
from sondage.operators.counts import na_counts
from sondage.functions.fmt import fixed
from sondage.operators.describe import categorical, finite, gauss_check, keyed, logical, quantiles
from sondage.operators.outliers import hinges
from sondage.operators.select import class_of

MANY = 5000
GEOMS = {
    ("continuous", None): "histogram", ("categorical", None): "bar", ("continuous", "continuous"): "scatter",
    ("categorical", "continuous"): "box", ("continuous", "categorical"): "box", ("categorical", "categorical"): "bar",
}


def plot_class(df: DataFrame, c: str) -> str:
    return "continuous" if class_of(df.schema[c].dataType) in ("numeric", "time") else "categorical"


def pick_geom(df: DataFrame, x: str, y: str | None = None) -> str:
    """Two continuous columns of more than ``MANY`` rows are binned; a time against a number is a line."""
    kind = (plot_class(df, x), plot_class(df, y) if y else None)
    if kind == ("continuous", "continuous"):
        if class_of(df.schema[x].dataType) == "time":
            return "line"
        return "bin2d" if df.limit(MANY + 1).count() > MANY else "scatter"
    return GEOMS[kind]


def histogram(df: DataFrame, col: str, bins: int | None = None) -> DataFrame:
    """(bin, lower, upper, n): equal widths over the range, by Sturges' rule."""
    x = finite(col)
    lo, hi, n = df.agg(F.min(x), F.max(x), F.count(x)).first()
    bins = bins or max(1, math.ceil(math.log2(max(n, 1)) + 1))
    if not n:
        return df.sparkSession.createDataFrame([], "bin long, lower double, upper double, n long")
    width = (hi - lo) / bins or 1.0
    b = F.least(F.floor((x - lo) / width), F.lit(bins - 1)).cast("long")
    return df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n")).select("bin", (F.lit(lo) + F.col("bin") * width).alias("lower"), (F.lit(lo) + (F.col("bin") + 1) * width).alias("upper"), "n")


def bin2d(df: DataFrame, x: str, y: str, bins: int = 60) -> DataFrame:
    """(x_bin, y_bin, n) on a grid of equal cells."""
    a, b = finite(x), finite(y)
    lx, hx, ly, hy = df.agg(F.min(a), F.max(a), F.min(b), F.max(b)).first()

    def cell(v, lo, hi):
        width = ((hi or 0.0) - (lo or 0.0)) / bins or 1.0
        return F.least(F.floor((v - F.lit(lo or 0.0)) / F.lit(width)), F.lit(bins - 1)).cast("long")

    return df.where(a.isNotNull() & b.isNotNull()).groupBy(cell(a, lx, hx).alias("x_bin"), cell(b, ly, hy).alias("y_bin")).agg(F.count("*").alias("n"))


def density(df: DataFrame, col: str, grid: int = 512) -> pd.DataFrame:
    """(x, y): Gaussian kernel density on a grid, from counts in 1,024 bins and Silverman's bandwidth."""
    x = finite(col)
    lo, hi, n, sd, q = df.agg(F.min(x), F.max(x), F.count(x), F.stddev_samp(x), F.lit(None)).first()
    q = quantiles(df, [col], (), (0.25, 0.75)).first()["q"] if n else None
    h = bandwidth(n, sd or 0.0, q[1] - q[0]) if n else 0.0
    if not h:
        return pd.DataFrame({"x": [lo], "y": [np.inf]}) if n else pd.DataFrame({"x": [], "y": []})
    t = histogram(df, col, 1024).toPandas()
    at, y = kernel_density(((t.lower + t.upper) / 2).to_numpy(), t.n.to_numpy(), h, lo, hi, grid)
    return pd.DataFrame({"x": at, "y": y})


def modes(df: DataFrame, col: str) -> int:
    """The ``peaks`` of the density."""
    return peaks(density(df, col).y.to_numpy())


def box(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., variable, q1, q3, low, median, high, n_out): hinges, and whiskers at the last value within 1.5 widths."""
    h = hinges(df, [col], by)
    rows = keyed(df, by).select(*by, finite(col).alias("x")).where("x is not null").join(h, list(by) or F.lit(True))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    middle = quantiles(df, [col], by, (0.5,)).select(*by, F.col("q")[0].alias("median"))
    rows = rows.join(middle, list(by) or F.lit(True))
    inside = (F.col("x") >= F.col("q1") - reach) & (F.col("x") <= F.col("q3") + reach)
    return rows.groupBy(*by, "variable", "q1", "q3", "median").agg(F.min(F.when(inside, F.col("x"))).alias("low"), F.max(F.when(inside, F.col("x"))).alias("high"), F.count_if(~inside).alias("n_out")).select(*by, "variable", "q1", "q3", "low", "median", "high", "n_out")


def bar(df: DataFrame, col: str, most: int = 20) -> DataFrame:
    """(value, n) with levels beyond ``most`` lumped into "(other)"."""
    c = df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("value")).agg(F.count("*").alias("n"))
    top = c.orderBy(F.desc("n"), "value").limit(most)
    rest = c.join(top, "value", "left_anti").agg(F.lit("(other)").alias("value"), F.sum("n").alias("n")).where("n is not null")
    return top.unionByName(rest)


def line(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, mean, n): the mean at each place."""
    return df.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("x")).agg(F.avg(finite(y)).alias("mean"), F.count(finite(y)).alias("n"))


def stat_error(df: DataFrame, col: str, by: str, kind: str = "mean") -> DataFrame:
    """(by, center, lower, upper, n): mean with its standard error, or median with quartiles."""
    x = finite(col)
    g = keyed(df, [by]).groupBy(by)
    if kind == "mean":
        return g.agg(F.avg(x).alias("center"), (F.stddev_samp(x) / F.sqrt(F.count(x))).alias("se"), F.count(x).alias("n")).select(by, "center", (F.col("center") - F.col("se")).alias("lower"), (F.col("center") + F.col("se")).alias("upper"), "n")
    middle = quantiles(df.where(F.col(by).isNotNull()), [col], [by], (0.5, 0.25, 0.75)).select(by, "q")
    return g.agg(F.count(x).alias("n")).join(middle, by, "left").select(by, F.col("q")[0].alias("center"), F.col("q")[1].alias("lower"), F.col("q")[2].alias("upper"), "n")


def trend(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., slope, intercept, r2, n) of the least-squares line."""
    a, b = finite(x), finite(y)
    return keyed(df, by).groupBy(*by).agg(F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), F.regr_r2(b, a).alias("r2"), F.regr_count(b, a).alias("n"))


def trend_band(df: DataFrame, x: str, y: str, points: int = 50, conf: float = 0.95) -> pd.DataFrame:
    """(x, fit, lower, upper): the line with the band of its mean."""
    a, b = finite(x), finite(y)
    ok = a.isNotNull() & b.isNotNull()
    r = df.where(ok).agg(F.count("*").alias("n"), F.avg(a).alias("mx"), F.regr_slope(b, a).alias("s"), F.regr_intercept(b, a).alias("i"), F.regr_sxx(b, a).alias("sxx"), F.regr_syy(b, a).alias("syy"), F.regr_sxy(b, a).alias("sxy"), F.min(a).alias("lo"), F.max(a).alias("hi")).first()
    at = np.linspace(r.lo, r.hi, points)
    s2 = max(0.0, r.syy - r.sxy**2 / r.sxx) / (r.n - 2)
    half = t_ppf(1 - (1 - conf) / 2, r.n - 2) * np.sqrt(s2 * (1 / r.n + (at - r.mx) ** 2 / r.sxx))
    fit = r.i + r.s * at
    return pd.DataFrame({"x": at, "fit": fit, "lower": fit - half, "upper": fit + half})


def na_summary(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Missing counts with a "a / b" label of the group."""
    t = na_counts(df, by)
    return t.withColumn("group", F.concat_ws(" / ", *[F.col(c).cast("string") for c in by])) if by else t


def verdict_line(df: DataFrame, x: str, y: str | None = None) -> str:
    """What a plot says under its title of the column that it shows: how far a number is
    from normal and why, or the note of another column. Empty where there is nothing to say."""
    c = y or x
    kind = class_of(df.schema[c].dataType)
    one = df.select(c)
    if kind == "numeric":
        r = gauss_check(one).first()
        if r is None:
            return ""
        return r.gauss_note if r.gauss is None else f"gauss {fixed(r.gauss, 2)}" + (f": {r.gauss_note}" if r.gauss_note else "")
    if kind == "logical":
        r = logical(one).first()
        return f"p(true) = {fixed(r.p_TRUE, 3)}: {r.note}" if r.note else ""
    return (categorical(one).first().note if kind == "categorical" else "") or ""


def diff_density(result: pd.DataFrame, draws: np.ndarray, row: int = 0, ref: float = 0.0, grid: int = 512) -> tuple[pd.DataFrame, dict[str, object]]:
    """For one comparison of ``boot_diff``: (x, y) of the density of its replicates, and
    what is marked on it: the share above ``ref``, the ends of the interval, the title.
    The replicates are as few as they were asked to be."""
    if not 0 <= row < len(result):
        raise ValueError(f"there are {len(result)} comparisons")
    d, r = draws[:, row], result.iloc[row]
    share = float((d > ref).mean())
    q1, q3 = np.quantile(d, [0.25, 0.75])
    h = bandwidth(len(d), float(d.std(ddof=1)), float(q3 - q1))
    marks = {"share_above": share, "ref": ref, "lower": r.lower, "upper": r.upper, "label": f"{r['to']} - {r['from']} ({r['stat']})", "title": f"{len(d)} replicates; {fixed(100 * share, 0)}% above {ref:g}"}
    if not h:
        return pd.DataFrame({"x": [d[0]], "y": [np.inf]}), marks
    value, count = np.unique(d, return_counts=True)
    at, y = kernel_density(value, count, h, value[0], value[-1], grid)
    return pd.DataFrame({"x": at, "y": y}), marks
