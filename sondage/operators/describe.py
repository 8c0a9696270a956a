"""One call describes every column by class.

Numbers are finite doubles; null and NaN count as missing, infinities apart.
Groups with a null key are left out of grouped output.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondage.functions.sqlmath import norm_cdf
from sondage.operators.counts import long_text, numeric_names
from sondage.operators.levels import declared
from sondage.operators.select import check_by, class_of, cols, columns_of
from sondage.plans.shared import materialize

#: Columns per aggregation, so that generated code stays within method limits.
CHUNK = 10
MIN_N, CAP = 20, 0.06


def keyed(df: DataFrame, by: Sequence[str]) -> DataFrame:
    check_by(df, by)
    for c in by:
        df = df.where(F.col(c).isNotNull())
    return df


def finite(c: str | Column) -> Column:
    """The column as a double if it is finite, else null."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r as an aggregate of columns that are missing at the same rows; null where one doesn't vary."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def quantile_name(q: float) -> str:
    return f"p{100 * q:g}"


def numeric(df: DataFrame, by: Sequence[str] = (), which=None, probs: Sequence[float] = (0, 0.5, 1), skew: bool = False, kurt: bool = False, dispersion: bool = True, empty: float = 0, approx: bool = False, values: DataFrame | None = None) -> DataFrame:
    """(by..., variable, obs, n, na, n_inf, sum, mean, sd, se, p..., [skew, kurt,]
    p_zero, [dispersion]). Quantiles are exact, or KLL sketches with ``approx``;
    skewness and kurtosis are the sample-adjusted G1 and G2 (Joanes & Gill 1998).
    ``values`` may be the columns' ``value_counts``, where they are known."""
    df, names = keyed(df, by), numeric_names(df, which, by)
    if not names:
        raise ValueError("no numeric column is left")
    parts = []
    for at in range(0, len(names), CHUNK):
        chunk = names[at : at + CHUNK]
        aggs = [F.count("*").alias("obs")]
        for i, c in enumerate(chunk):
            x, raw = finite(c), F.col(c).cast("double")
            q = F.percentile_approx(x, list(map(float, probs)), 10000) if approx else F.when(F.count(x) > 0, F.array(*[F.min(x) if p == 0 else F.max(x) if p == 1 else F.lit(None).cast("double") for p in probs]))
            whole = F.bool_and((F.abs(x - F.round(x)) <= 1e-8) & (x >= 0))
            aggs.append(F.struct(
                F.count(x).alias("n"), F.count_if(raw.isNull() | F.isnan(raw)).alias("na"), F.count_if(F.abs(raw) == float("inf")).alias("n_inf"),
                F.sum(x).alias("sum"), F.sum(F.when(F.abs(raw) == float("inf"), raw)).alias("inf_sum"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), q.alias("q"),
                F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2"), F.avg((x == 0).cast("int")).alias("p_zero"), whole.alias("whole"),
            ).alias(f"c{i}"))
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"c{i}").alias("x")) for i, c in enumerate(chunk)]))
        parts.append(df.groupBy(*by).agg(*aggs).select(*by, "obs", cells.alias("c")).select(*by, "c.variable", "obs", "c.x.*"))
    out = reduce(DataFrame.unionByName, parts)
    if not approx and any(0 < p < 1 for p in probs):
        # only the ends of a column come with its moments
        inner = quantiles_of(value_counts(df, names, by) if values is None else values, [*by, "variable"], probs).withColumnRenamed("q", "inner")
        out = out.join(inner, [*by, "variable"], "left").withColumn("q", F.coalesce("inner", "q")).drop("inner")
    n, g1, g2 = F.col("n"), F.col("g1"), F.col("g2")
    extra = []
    if skew:
        extra.append(F.when((n >= 3) & ~F.isnan(g1), g1 * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"))
    if kurt:
        extra.append(F.when((n >= 4) & ~F.isnan(g2), ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3))).alias("kurt"))
    if dispersion:
        rating = rating_names(df, names, values)
        fits = F.col("whole") & (F.col("mean") > 0) & ~F.col("variable").isin(rating or ["\0"])
        extra.append(F.when(fits, F.col("sd") * F.col("sd") / F.col("mean")).alias("dispersion"))
    total = F.when(n > 0, F.col("sum")).otherwise(F.coalesce("inf_sum", F.lit(float(empty))))
    at = [F.col("q")[i].alias(quantile_name(p)) for i, p in enumerate(probs)]
    return out.select(*by, "variable", "obs", "n", "na", "n_inf", total.alias("sum"), "mean", "sd", (F.col("sd") / F.sqrt("n")).alias("se"), *at, *extra[: int(skew) + int(kurt)], "p_zero", *extra[int(skew) + int(kurt) :])


def scales(df: DataFrame, names: Sequence[str], values: DataFrame | None = None) -> dict[str, tuple[str, float | None, float | None]]:
    """(kind, lowest, highest) of each column from all its values; the kind is
    continuous, rating, either (a count or a rating) or count. ``values`` may be the
    columns' ``value_counts``."""
    if not names:
        return {}
    ends = lambda x: F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"), F.bool_and(F.abs(x - F.round(x)) <= 1e-8).alias("whole"))
    if values is None:
        row = df.agg(*[ends(finite(c)).alias(f"c{i}") for i, c in enumerate(names)]).first()
        found = {c: row[f"c{i}"] for i, c in enumerate(names)}
    else:
        found = {r.variable: r.x for r in values.groupBy("variable").agg(ends(F.col("x")).alias("x")).collect()}
    kinds = {}
    for c in names:
        lo, hi, whole = found.get(c, (None, None, None))
        if lo is None or not whole:
            kind = "continuous"
        elif (lo >= 1 or (lo < 0 and lo == -hi)) and hi - lo <= 10:
            kind = "rating"
        elif lo == 0 and hi <= 10:
            kind = "either"
        else:
            kind = "count" if lo >= 0 else "continuous"
        kinds[c] = (kind, lo, hi)
    return kinds


def scale_kinds(df: DataFrame, names: Sequence[str], values: DataFrame | None = None) -> dict[str, str]:
    """The kind of each column of ``scales``."""
    return {c: x[0] for c, x in scales(df, names, values).items()}


def rating_names(df: DataFrame, names: Sequence[str], values: DataFrame | None = None) -> list[str]:
    return [c for c, k in scale_kinds(df, names, values).items() if k == "rating"]


def cells(df: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., variable, x): finite values of numeric columns, one row a cell."""
    if not names:
        return df.select(*by, F.lit("").alias("variable"), F.lit(0.0).alias("x")).where(F.lit(False))
    wide = df.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], *[finite(c).alias(c) for c in names])
    # an unpivot is generated code; exploded arrays of structs are made row by row
    long = wide.unpivot([f"`__by{i}`" for i in range(len(by))], [f"`{c}`" for c in names], "variable", "x").where("x is not null")
    return long.toDF(*by, "variable", "x")


def value_counts(df: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., variable, x, cnt): the different finite values of numeric columns, written once."""
    keys = [*by, "variable"]
    return materialize(cells(df, names, by).groupBy(*keys, "x").agg(F.count("*").alias("cnt")), "value-counts")


#: A key of more different values than the first number is counted in so many parts.
WIDE, CUTS = 1_000_000, 256
#: Cuts are compared in two steps, of this many each.
STEP = 16


def running(values: DataFrame, keys: Sequence[str], with_n: bool = False) -> DataFrame:
    """Distinct values (keys..., x, cnt) with ``upto``, the count of values up to x in
    the key (and ``n``, the count of all). A key of very many values is cut at its
    approximate quantiles, so that it is counted in many tasks; only the sums of the
    parts meet by key. Where the cuts lie doesn't matter for the counts, and they are
    written, so that a task that runs again finds the same ones. Where no key has very
    many values, which their table says, they are summed as they are."""
    if values.groupBy(*keys).agg(F.count("*").alias("k")).where(F.col("k") > WIDE).isEmpty():
        group = Window.partitionBy(*keys)
        rows = values.dropna(subset=list(keys)) if keys else values
        out = rows.withColumn("upto", F.sum("cnt").over(group.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)))
        return out.select(*keys, "x", "cnt", "upto", *([F.sum("cnt").over(group).alias("n")] if with_n else []))
    cuts = F.percentile_approx("x", [i / CUTS for i in range(1, CUTS)], 2000)
    held = values.groupBy(*keys).agg(F.sum("cnt").alias("n"), F.when(F.count("*") > WIDE, cuts).alias("cuts"))
    coarse = F.array(*[F.get("cuts", F.lit(i - 1)) for i in range(STEP, CUTS, STEP)])
    fine = F.array(*[F.slice("cuts", i + 1, STEP - 1) for i in range(0, CUTS, STEP)])
    held = held.select(*keys, "n", F.when(F.col("cuts").isNotNull(), coarse).alias("coarse"), F.when(F.col("cuts").isNotNull(), fine).alias("fine"))
    held = materialize(held, "running-cuts")

    def with_keys(a: DataFrame, b: DataFrame, more: Sequence[str] = ()) -> DataFrame:
        on = F.lit(True)
        for k in (*keys, *more):
            on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
        return a.alias("a").join(b.alias("b"), on).select("a.*", *[F.col(f"b.{c}") for c in b.columns if c not in (*keys, *more)])

    def below(cuts: Column) -> Column:
        return F.size(F.filter(cuts, lambda c: c < F.col("x")))

    parts = with_keys(values.select(*keys, "x", "cnt"), held).withColumn("first", below(F.col("coarse")))
    part = F.when(F.col("coarse").isNotNull(), F.col("first") * STEP + below(F.get("fine", F.col("first")))).otherwise(0)
    parts = parts.withColumn("part", part).drop("coarse", "fine", "first")
    sums = parts.groupBy(*keys, "part").agg(F.sum("cnt").alias("held"))
    before = sums.select(*keys, "part", (F.sum("held").over(Window.partitionBy(*keys).orderBy("part")) - F.col("held")).alias("before"))
    here = F.sum("cnt").over(Window.partitionBy(*keys, "part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    out = with_keys(parts.withColumn("here", here), before, ["part"]).withColumn("upto", F.col("here") + F.col("before"))
    return out.select(*keys, "x", "cnt", "upto", *(["n"] if with_n else []))


def quantiles_of(values: DataFrame, keys: Sequence[str], probs: Sequence[float], name: str = "q") -> DataFrame:
    """(keys..., q): exact quantiles of counted values, interpolated between ranks."""
    rows = running(values, keys, with_n=True)

    def holds(rank: Column) -> Column:
        return F.max(F.when((F.col("upto") > rank) & (F.col("upto") - F.col("cnt") <= rank), F.col("x")))

    at = [F.lit(float(p)) * (F.col("n") - 1) for p in probs]
    ends = rows.groupBy(*keys, "n").agg(*[x for i, a in enumerate(at) for x in (holds(F.floor(a)).alias(f"lo{i}"), holds(F.ceil(a)).alias(f"hi{i}"))])
    share = [a - F.floor(a) for a in at]
    return ends.select(*keys, F.array(*[F.col(f"lo{i}") * (1 - w) + F.col(f"hi{i}") * w for i, w in enumerate(share)]).alias(name))


def quantiles(df: DataFrame, names: Sequence[str], by: Sequence[str] = (), probs: Sequence[float] = (0.5,)) -> DataFrame:
    """(by..., variable, q): exact quantiles of numeric columns, from running counts of their values."""
    return quantiles_of(value_counts(df, names, by), [*by, "variable"], probs)


def moments(df: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., variable, n, m, s, g2, lo, hi, whole) of numeric columns, in one pass."""
    parts = []
    for at in range(0, len(names), CHUNK):
        chunk = names[at : at + CHUNK]
        row = df.groupBy(*by).agg(*[F.struct(F.lit(c).alias("variable"), F.count(finite(c)).alias("n"), F.avg(finite(c)).alias("m"), F.stddev_samp(finite(c)).alias("s"), F.kurtosis(finite(c)).alias("g2"), F.min(finite(c)).alias("lo"), F.max(finite(c)).alias("hi"), F.bool_and(F.abs(finite(c) - F.round(finite(c))) <= 1e-8).alias("whole")).alias(f"c{i}") for i, c in enumerate(chunk)])
        parts.append(row.select(*by, F.explode(F.array(*[F.col(f"c{i}") for i in range(len(chunk))])).alias("c")).select(*by, "c.*").where("n > 0"))
    return reduce(DataFrame.unionByName, parts)


#: Notes where a column is too small, too even or too large to judge.
TOO_FEW, ONE_VALUE, TOO_LARGE = "too few values to judge", "only one value", "too large to judge"


def _index(n: Column, ks_d: Column, cap: float) -> Column:
    return 1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), (ks_d - 0.9 / F.sqrt(n)) / cap))


def _unfit(min_n: int) -> Column:
    return F.when(F.col("n") < min_n, TOO_FEW).when(F.col("s") == 0, ONE_VALUE).when(F.isnan("s") | (F.col("s") == float("inf")), TOO_LARGE)


def gauss(df: DataFrame, by: Sequence[str] = (), which=None, min_n: int = MIN_N, cap: float = CAP) -> DataFrame:
    """(by..., variable, n, ks_d, gauss, gauss_note): the distance of the empirical
    from the fitted normal distribution (Lilliefors 1967) as an index from 0 to 1."""
    df, names = keyed(df, by), numeric_names(df, which, by)
    keys = [*by, "variable"]
    held = moments(df, names, by).select(*keys, "n", "m", "s")
    far = _steps(value_counts(df, names, by), held, keys).where("s > 0").groupBy(*keys).agg(F.max("d").alias("ks_d"))
    out = held.join(far, keys, "left").withColumn("gauss_note", _unfit(min_n))
    return out.select(*keys, "n", "ks_d", F.when(F.col("gauss_note").isNull(), _index(F.col("n"), F.col("ks_d"), cap)).alias("gauss"), "gauss_note")


def _steps(values: DataFrame, held: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The running counts of values with their moments, and ``d``, how far the normal distribution is from the step at each."""
    phi = F.expr(norm_cdf("((x - m) / s)"))
    d = F.when(F.col("s") > 0, F.greatest(F.abs(phi - F.col("upto") / F.col("n")), F.abs(phi - (F.col("upto") - F.col("cnt")) / F.col("n"))))
    return running(values, keys).join(held, list(keys)).withColumn("d", d)


#: How a departure from normal is worded, by its code; the order is that in which reasons are told.
REASONS = {
    "floor": "{share}% of the values are the lowest one ({end}): a floor, as of a detection limit",
    "zeros": "{share}% of the values are 0, far more than at the next one: excess zeros, for a two-part model",
    "rating_floor": "{share}% of the values are the scale's lowest point ({end}), where it tells nobody apart: for an ordinal model",
    "either_floor": "{share}% of the values are 0, far more than at the next one: excess zeros of a count, or the lowest point of a rating",
    "ceiling": "{share}% of the values are the highest one ({end}): a ceiling, as of a cap",
    "rating_ceiling": "{share}% of the values are the scale's highest point ({end}), where it tells nobody apart: for an ordinal model",
    "either_ceiling": "{share}% of the values are {end}, far more than at the next one: a cap of a count, or the highest point of a rating",
    "multimodal": "several peaks, maybe of subgroups", "discrete": "few different values ({distinct})", "bounded_zero": "cut off at zero",
    "right_skewed": "skewed to the right", "left_skewed": "skewed to the left", "heavy_tailed": "heavy tails", "light_tailed": "light tails",
    "unclear": "not normal, for no one reason",
}
#: The share of an index above which nothing but ends is told, and the most reasons of a note.
FINE, TOLD = 0.95, 2


def ends_of(kind: str, distinct: int, n: int, low: tuple[float, int, int], high: tuple[float, int, int], scale: tuple[float, float]) -> list[tuple[str, float, float]]:
    """(code, share, end) of a floor and a ceiling; ``low`` and ``high`` are the outermost
    value, its count and that of the next one inward, ``scale`` the ends of the whole column."""
    from sondage.functions.dist import binom_half_upper

    least, share, ratio, alpha = FLOOR
    if distinct < (4 if kind in ("rating", "either") else 5):
        return []
    out = []
    for name, (x, c1, c2), end in (("floor", low, scale[0]), ("ceiling", high, scale[1])):
        if kind != "continuous" and x != end:
            continue
        if c1 >= least and c1 / n >= share and c1 >= ratio * c2 and binom_half_upper(c1, c1 + c2) <= alpha:
            code = f"{kind}_{name}" if kind in ("rating", "either") else "zeros" if name == "floor" and kind == "count" and x == 0 else name
            out.append((code, c1 / n, x))
    return out


def gauss_check(df: DataFrame, by: Sequence[str] = (), which=None, min_n: int = MIN_N, cap: float = CAP, values: DataFrame | None = None) -> DataFrame:
    """``gauss`` with its reasons: (by..., variable, n, ks_d, gauss, gauss_kind,
    gauss_note). A floor or ceiling comes first, whatever the index; other reasons
    only below ``FINE``. With ``by``, a group is held against the scale of the whole
    column. All comes from one table of value counts, which may be given; modes from 1,024 bins a group."""
    from sondage.functions.kernel import bandwidth, density, peaks

    df, names = keyed(df, by), numeric_names(df, which, by)
    keys = [*by, "variable"]
    values = value_counts(df, names, by) if values is None else values
    scale = scales(df, names, values)
    held = materialize(moments(df, names, by), "moments")
    steps = _steps(values, held, keys)

    def rank(r: Column) -> Column:
        return F.max(F.when((F.col("upto") > r) & (F.col("upto") - F.col("cnt") <= r), F.col("x")))

    at = {f"q{p}": F.lit(p / 4) * (F.col("n") - 1) for p in (1, 2, 3)}
    ends = [x for k, a in at.items() for x in (rank(F.floor(a)).alias(f"{k}a"), rank(F.ceil(a)).alias(f"{k}b"))]
    pair = F.struct("x", "cnt")
    seen = steps.groupBy(*keys, "n", "m", "s", "g2", "lo", "hi", "whole").agg(
        F.max("d").alias("ks_d"), F.count("*").alias("distinct"), F.max(F.when(F.col("x") == F.col("lo"), F.col("cnt"))).alias("lo1"), F.max(F.when(F.col("x") == F.col("hi"), F.col("cnt"))).alias("hi1"),
        F.min(F.when(F.col("x") > F.col("lo"), pair)).alias("lo2"), F.max(F.when(F.col("x") < F.col("hi"), pair)).alias("hi2"), *ends,
    )
    seen = seen.select("*", *[(F.col(f"{k}a") + (F.col(f"{k}b") - F.col(f"{k}a")) * (a - F.floor(a))).alias(k) for k, a in at.items()])
    seen = seen.withColumn("why", _unfit(min_n))
    seen = materialize(seen.withColumn("gauss", F.when(F.col("why").isNull(), _index(F.col("n"), F.col("ks_d"), cap))), "gauss")
    discrete = F.col("whole") & (F.col("distinct") <= F.greatest(F.lit(20.0), F.col("n") / 50))
    doubtful = seen.where((F.col("gauss") < FINE) & ~discrete).select(*keys, "n", "s", "lo", "hi", "q1", "q3")
    slot = F.least(F.lit(1023), F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 1024)).alias("slot")
    bins = values.join(doubtful, keys).groupBy(*keys, "n", "s", "lo", "hi", "q1", "q3", slot).agg(F.sum("cnt").alias("cnt"))
    types = {f.name: f.dataType.simpleString() for f in values.schema}

    def count_modes(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        r = rows.iloc[0]
        h = bandwidth(r["n"], r["s"], r["q3"] - r["q1"])
        mid = r["lo"] + (rows["slot"].to_numpy() + 0.5) * (r["hi"] - r["lo"]) / 1024
        found = peaks(density(mid, rows["cnt"].to_numpy(), h, r["lo"], r["hi"])[1]) if h else 1
        return pd.DataFrame([(*key, found)], columns=[*keys, "modes"])

    modes = bins.groupBy(*keys).applyInPandas(count_modes, ", ".join([*(f"`{k}` {types[k]}" for k in keys), "modes long"]))
    both = seen.join(modes, keys, "left")

    def tell(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for r in p.to_dict("records"):
                n, distinct = int(r["n"]), int(r["distinct"])
                kind, *whole = scale[r["variable"]]
                found = [] if r["lo2"] is None else ends_of(kind, distinct, n, (r["lo"], int(r["lo1"]), int(r["lo2"]["cnt"])), (r["hi"], int(r["hi1"]), int(r["hi2"]["cnt"])), tuple(whole))
                notes = [(code, REASONS[code].format(share=round(100 * share), end=f"{end:.4g}")) for code, share, end in found]
                if r["why"]:
                    notes.append(("not_assessed", r["why"]))
                elif r["gauss"] < FINE:
                    g2, iqr = r["g2"], r["q3"] - r["q1"]
                    kurt = ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3))
                    bowley = (r["q3"] + r["q1"] - 2 * r["q2"]) / iqr if iqr > 0 else 0.0
                    few = bool(r["whole"]) and distinct <= max(20, n / 50)
                    holds = {"multimodal": not few and (r["modes"] or 0) >= 2, "discrete": few, "bounded_zero": 0 <= r["lo"] < 0.05 * r["s"], "right_skewed": bowley > 0.1, "left_skewed": bowley < -0.1, "heavy_tailed": kurt > 1, "light_tailed": kurt < -1}
                    more = [(code, REASONS[code].format(distinct=distinct)) for code, yes in holds.items() if yes]
                    notes += more if more or found else [("unclear", REASONS["unclear"])]
                gauss = None if r["why"] else r["gauss"]
                rows.append((*(r[k] for k in keys), n, None if r["why"] else r["ks_d"], gauss, notes[0][0] if notes else "none", "; ".join(t for _, t in notes[:TOLD])))
            yield pd.DataFrame(rows, columns=[*keys, "n", "ks_d", "gauss", "gauss_kind", "gauss_note"])

    return both.mapInPandas(tell, ", ".join([*(f"`{k}` {types[k]}" for k in keys), "n long, ks_d double, gauss double, gauss_kind string, gauss_note string"]))


def categorical(df: DataFrame, by: Sequence[str] = (), which=None, rare_n: int = 5) -> DataFrame:
    """(by..., variable, obs, n, na, n_empty, n_unique, ordered, p_max, n_rare, n_unused,
    case_variants, counts_tb, note). Levels are those that ``levels.declare`` gave; of an
    ordered column a pile at its first or last level is noted first. The three most frequent values are picked among those of each of
    ``CUTS`` parts of the values, so no column is ordered in one task."""
    df = keyed(df, by)
    names = [c for c in cols(df, which, by=by) if class_of(df.schema[c].dataType) == "categorical"]
    if not names:
        raise ValueError("no categorical column is left")
    keys = [*by, "variable"]
    value = materialize(long_text(df, names, by).groupBy(*keys, "value").agg(F.count("*").alias("n")), "level-counts")
    order = [F.desc("n"), F.asc("value")]
    some = value.where("value is not null").withColumn("part", F.pmod(F.xxhash64("value"), F.lit(CUTS)))
    first = some.withColumn("r", F.row_number().over(Window.partitionBy(*keys, "part").orderBy(*order))).where("r <= 3")
    first = first.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("r <= 3")
    top = first.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", F.concat_ws("_", "value", F.col("n").cast("string")).alias("t")))), lambda x: x["t"]), ", ").alias("counts_tb"))
    folded = F.lower(F.trim(F.regexp_replace("value", r"^[ \t\r\n]+|[ \t\r\n]+$", "")))
    variants = value.where("value is not null").groupBy(*keys, folded.alias("f")).agg(F.count("*").alias("k")).groupBy(*keys).agg(F.count_if(F.col("k") > 1).alias("case_variants"))
    there = F.col("value").isNotNull()
    known = {c: d for c in names if (d := declared(df, c))}

    def of(each: dict[str, Column], otherwise: Column) -> Column:
        out = otherwise
        for c, x in each.items():
            out = F.when(F.col("variable") == c, x).otherwise(out)
        return out

    none = F.lit(None)
    code = of({c: F.nullif(F.array_position(F.array(*[F.lit(v) for v in d.values]), F.col("value")), F.lit(0)) for c, d in known.items()}, none.cast("long"))
    value = value.withColumn("code", code)
    out = value.groupBy(*keys).agg(
        F.count("code").alias("used"), F.sort_array(F.collect_list(F.when(F.col("code").isNotNull(), F.struct("code", "n")))).alias("codes"),
        F.sum("n").alias("obs"), F.sum(F.when(there, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(there, 0).otherwise(F.col("n"))).alias("na"),
        F.sum(F.when(F.trim(F.regexp_replace("value", r"[ \t\r\n]", "")) == "", F.col("n")).otherwise(0)).alias("n_empty"), F.count_if(there).alias("n_unique"),
        F.max(F.when(there, F.col("n"))).alias("most"), F.count_if(there & (F.col("n") < rare_n)).alias("n_rare"),
    )
    out = out.join(variants, keys, "left").join(top, keys, "left").withColumn("counts_tb", F.coalesce("counts_tb", F.lit("")))
    n_levels = of({c: F.lit(len(d.values)) for c, d in known.items()}, F.lit(0))
    ordered = {c: d for c, d in known.items() if d.ordered}
    out = out.withColumns({"ordered": of({c: F.lit(True) for c in ordered}, F.lit(False)), "n_unused": (n_levels - F.col("used")).cast("long"), "p_max": F.col("most") / F.col("n"), "case_variants": F.coalesce("case_variants", F.lit(0).cast("long"))})
    ends = []
    if ordered:
        last = F.size("codes")
        for name, a, b, end in (("floor", F.lit(0), F.lit(1), F.lit(1)), ("ceiling", last - 1, last - 2, n_levels)):
            c1, c2 = (F.get("codes", x) for x in (a, b))
            fair = _fair_split(c1["n"], c2["n"])
            least, share, ratio, alpha = FLOOR
            fires = F.col("ordered") & (last >= 4) & (c1["code"] == end) & (c1["n"] >= least) & (c1["n"] / F.col("n") >= share) & (c1["n"] >= ratio * c2["n"]) & (fair <= alpha)
            label = of({c: F.element_at(F.array(*[F.lit(v) for v in d.values]), c1["code"].cast("int")) for c, d in ordered.items()}, none.cast("string"))
            words = REASONS[f"rating_{name}"].split("{share}")[1].split("{end}")
            said = F.concat(F.round(100 * c1["n"] / F.col("n"), 0).cast("int").cast("string"), F.lit(words[0]), label, F.lit(words[1]))
            ends.append(F.when(fires, said))

    def told(c: str, words: str) -> Column:
        return F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {words}")))

    notes = F.array(*ends, told("n_empty", "empty texts"), told("n_unused", "unused levels"), told("case_variants", "variants by case or space"), told("n_rare", "rare levels"), F.when(F.col("p_max") > 0.99, "nearly one value"))
    note = F.array_join(F.slice(F.filter(notes, lambda x: x.isNotNull()), 1, TOLD), "; ")
    return out.select(*keys, "obs", "n", "na", "n_empty", "n_unique", "ordered", "p_max", "n_rare", "n_unused", "case_variants", "counts_tb", note.alias("note"))


@F.pandas_udf(T.DoubleType())
def _fair_split(c1: pd.Series, c2: pd.Series) -> pd.Series:
    """The chance that a fair coin gives the first count or more; of the few rows of a result."""
    from sondage.functions.dist import binom_half_upper

    return pd.Series([binom_half_upper(int(a), int(a + b)) if a == a and b == b else 1.0 for a, b in zip(c1.astype(float), c2.astype(float), strict=True)])


def logical(df: DataFrame, by: Sequence[str] = (), which=None) -> DataFrame:
    """(by..., variable, obs, n, na, n_TRUE, n_FALSE, p_TRUE, note)."""
    df = keyed(df, by)
    names = [c for c in cols(df, which, by=by) if class_of(df.schema[c].dataType) == "logical"]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("x")) for c in names]))
    out = df.select(*by, each.alias("c")).groupBy(*by, F.col("c.variable").alias("variable")).agg(F.count("*").alias("obs"), F.count("c.x").alias("n"), F.count_if(F.col("c.x").isNull()).alias("na"), F.count_if("c.x").alias("n_TRUE"), F.count_if(~F.col("c.x")).alias("n_FALSE"))
    p = F.col("n_TRUE") / F.col("n")
    return out.withColumn("p_TRUE", F.when(F.col("n") > 0, p)).withColumn("note", F.when((F.col("p_TRUE") < 0.01) | (F.col("p_TRUE") > 0.99), "near-constant"))


def _spacing(unit: str) -> str:
    if unit == "day":
        return "CASE WHEN md = 1 THEN 'daily' WHEN md = 7 THEN 'weekly' WHEN md BETWEEN 28 AND 31 THEN 'monthly' WHEN md BETWEEN 90 AND 92 THEN 'quarterly' WHEN md BETWEEN 365 AND 366 THEN 'yearly' ELSE concat(cast(cast(md AS bigint) AS string), ' days') END"
    return "CASE WHEN md = 1 THEN 'every second' WHEN md = 60 THEN 'every minute' WHEN md = 3600 THEN 'hourly' WHEN md = 86400 THEN 'daily' WHEN md = 604800 THEN 'weekly' ELSE concat(cast(cast(md AS bigint) AS string), ' secs') END"


def time(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., variable, obs, n, na, n_unique, start, end, span_days, spacing,
    regular, n_gaps, n_dup_times). Steps between distinct times; the most common
    one, the smallest of equals, is the spacing. Neighbours across the borders of
    range partitions are joined, so no column is ordered in one task."""
    df = keyed(df, by)
    day = dict(df.dtypes)[col] == "date"
    x = F.unix_date(F.col(col)).cast("double") if day else F.unix_micros(F.col(col).cast("timestamp")) / 1e6
    rows = df.select(*by, x.alias("x"), F.col(col).cast("string").alias("shown"))
    base = rows.groupBy(*by).agg(F.count("*").alias("obs"), F.count("x").alias("n"), F.min("shown").alias("start"), F.max("shown").alias("end"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    part = materialize(rows.where("x is not null").select(*by, "x").distinct().repartitionByRange(*by, "x").withColumn("part", F.spark_partition_id()), "times")
    inner = part.withColumn("before", F.lag("x").over(Window.partitionBy(*by, "part").orderBy("x")))
    edges = part.groupBy(*by, "part").agg(F.min("x").alias("first"), F.max("x").alias("last"))
    edges = edges.withColumn("before", F.lag("last").over(Window.partitionBy(*by).orderBy("part"))).select(*by, (F.col("first") - F.col("before")).alias("d"))
    step = inner.select(*by, (F.col("x") - F.col("before")).alias("d")).unionByName(edges).where("d is not null").groupBy(*by, F.round("d", 6).alias("d")).agg(F.count("*").alias("k"))
    common = step.groupBy(*by).agg(F.max_by(F.col("d"), F.struct("k", -F.col("d"))).alias("md"), F.sum("k").alias("steps"))
    key = list(by) or ["__one"]
    one = (lambda d: d) if by else (lambda d: d.withColumn("__one", F.lit(1)))
    gaps = one(step).join(one(common), key).groupBy(*key).agg(F.sum(F.when(F.col("d") > 1.5 * F.col("md"), F.col("k")).otherwise(0)).alias("n_gaps"), F.bool_and(F.abs(F.col("d") - F.col("md")) <= F.greatest(F.lit(1e-6), 0.15 * F.col("md"))).alias("regular"), F.first("md").alias("md"), F.first("steps").alias("steps"))
    out = one(base).join(gaps, key, "left")
    unique = F.when(F.col("n") > 0, F.coalesce("steps", F.lit(0)) + 1).otherwise(0)
    span = (F.col("hi") - F.col("lo")) / (1 if day else 86400)
    return out.select(*by, F.lit(col).alias("variable"), "obs", "n", (F.col("obs") - F.col("n")).alias("na"), unique.alias("n_unique"), "start", "end", span.alias("span_days"), F.expr(_spacing("day" if day else "sec")).alias("spacing"), "regular", F.coalesce("n_gaps", F.lit(0)).alias("n_gaps"), (F.col("n") - unique).alias("n_dup_times"))


def constants(df: DataFrame) -> DataFrame:
    """(variable, class, obs, n, na, value): columns with at most one distinct value; no distinct count, only extremes."""
    names = [f.name for f in df.schema if class_of(f.dataType) != "nested"]
    aggs = [F.struct(F.count(c).alias("n"), F.min(c).cast("string").alias("lo"), (F.min(c).eqNullSafe(F.max(c))).alias("one")).alias(f"c{i}") for i, c in enumerate(names)]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.lit(class_of(df.schema[c].dataType)).alias("class"), F.col(f"c{i}").alias("x")) for i, c in enumerate(names)]))
    out = df.agg(F.count("*").alias("obs"), *aggs).select("obs", each.alias("c")).where("c.x.one")
    return out.select("c.variable", "c.class", "obs", "c.x.n", (F.col("obs") - F.col("c.x.n")).alias("na"), F.col("c.x.lo").alias("value"))


def _beside(table: DataFrame, more: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``table`` with the other columns of ``more`` at the same keys."""
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{i}")) for i, k in enumerate(keys)])
    named = more.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)], *[c for c in more.columns if c not in keys])
    return table.join(named, on, "left").drop(*[f"__{i}" for i in range(len(keys))])


def describe_all(df: DataFrame, by: Sequence[str] = (), which=None, gauss: bool = False, smd: bool = False, reference=None, **numeric_args) -> dict[str, DataFrame]:
    """One table per class of the columns, in the order in which classes first appear, and
    the constants. With ``gauss`` numbers have their index and its reasons; with ``smd``
    and one grouping column, numbers, flags and categories have the standardised
    difference from the reference group, the first one if none is given."""
    from sondage.operators import smd as differences

    if smd and len(by) != 1:
        raise ValueError("differences are between the groups of one column")
    use = df.select(*by, *cols(df, which, by=by))
    tables: dict[str, DataFrame] = {}
    of: dict[str, list[str]] = {}
    for c in cols(use, None, by=by):
        of.setdefault(class_of(use.schema[c].dataType), []).append(c)
    keys = [*by, "variable"]
    for kind, names in of.items():
        if kind == "numeric":
            # what numbers and their shape both need is counted once
            values = value_counts(keyed(use, by), names, by) if gauss else None
            tables[kind] = numeric(use, by, values=values, **numeric_args)
            if gauss:
                told = gauss_check(use, by, names, values=values).select(*keys, "gauss", "gauss_kind", "gauss_note")
                tables[kind] = _beside(tables[kind], told, keys)
            if smd:
                tables[kind] = _beside(tables[kind], differences.smd_numeric(use, by[0], names, reference), keys)
        elif kind == "categorical":
            tables[kind] = categorical(use, by)
            if smd:
                found = [(g, c, x) for c in names for g, x in differences.smd_levels(use, by[0], c, reference).items()]
                group = use.schema[by[0]].dataType.simpleString()
                tables[kind] = _beside(tables[kind], df.sparkSession.createDataFrame(found, f"`{by[0]}` {group}, variable string, smd double"), keys)
        elif kind == "logical":
            tables[kind] = logical(use, by)
            if smd:
                tables[kind] = _beside(tables[kind], differences.smd_binary(use, by[0], names, reference), keys)
        elif kind == "time":
            tables[kind] = reduce(DataFrame.unionByName, [time(use, t, by) for t in names])
    tables["constant"] = constants(use)
    return tables


FLOOR = (5, 0.02, 2.0, 0.001)


def floor_ends(df: DataFrame, col: str) -> dict[str, object]:
    """Whether a column piles up at an end of its scale: the two outermost values with
    their counts, against a fair split."""
    value = value_counts(df, [col])
    low, high = value.orderBy("x").limit(2).collect(), value.orderBy(F.desc("x")).limit(2).collect()
    n, distinct = value.agg(F.sum("cnt"), F.count("*")).first()
    kind, *whole = scales(df, [col])[col]
    out: dict[str, object] = {"kind": kind, "floor": False, "ceiling": False}
    if (distinct or 0) < 2:
        return out
    outer = [(rows[0]["x"], rows[0]["cnt"], rows[1]["cnt"]) for rows in (low, high)]
    for code, _, _ in ends_of(kind, distinct, n, *outer, tuple(whole)):
        out["ceiling" if code.endswith("ceiling") else "floor"] = True
    return out
