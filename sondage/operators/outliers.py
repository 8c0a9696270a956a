"""Values that are extreme for their own column.

Bounds come from a grouped aggregate; rows meet them by a join that Spark sends
to every task while it is small, so rows are not shuffled by column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sondage.operators.counts import numeric_names
from sondage.operators.describe import cells, finite, keyed, quantiles_of, running, value_counts
from sondage.plans.shared import materialize

THRESHOLD = {"iqr": 1.5, "mad": 3.5, "zscore": 3.0}


def hinges(df: DataFrame, names: Sequence[str], by: Sequence[str] = (), with_n: bool = False) -> DataFrame:
    """(by..., variable, q1, q3): Tukey's hinges, from the ranks of distinct values; ``__n`` values, if asked for."""
    keys = [*by, "variable"]
    at = running(value_counts(df, names, by), keys, with_n=True).withColumn("n4", F.floor((F.col("n") + 3) / 2) / 2)
    low, high = F.floor("n4"), F.ceil("n4")

    def holds(rank):
        return F.max(F.when((F.col("upto") >= rank) & (F.col("upto") - F.col("cnt") < rank), F.col("x")))

    picked = at.groupBy(*keys).agg(F.max("n").alias("__n"), holds(low).alias("a"), holds(high).alias("b"), holds(F.col("n") + 1 - low).alias("c"), holds(F.col("n") + 1 - high).alias("d"))
    return picked.select(*keys, ((F.col("a") + F.col("b")) / 2).alias("q1"), ((F.col("c") + F.col("d")) / 2).alias("q3"), *(["__n"] if with_n else []))


def outliers_all(df: DataFrame, key: str, by: Sequence[str] = (), which=None, method: str = "iqr", threshold: float | None = None, flagged_only: bool = True, checked: Observation | None = None) -> DataFrame:
    """(by..., key, variable, value, score, is_outlier). Columns with fewer than two values
    in a group are left out. ``checked`` counts the values of each column that were
    judged, while the result is computed."""
    df, names = keyed(df, by), [c for c in numeric_names(df, which, by) if c != key]
    limit = THRESHOLD[method] if threshold is None else threshold
    keys = [*by, "variable"]
    x = F.col("value")
    if method == "iqr":
        bounds = hinges(df, names, by, with_n=True)
        iqr = F.col("q3") - F.col("q1")
        score = F.when(iqr > 0, F.greatest((F.col("q1") - x) / iqr, (x - F.col("q3")) / iqr, F.lit(0.0))).otherwise(0.0)
    elif method == "mad":
        values = value_counts(df, names, by)
        mid = materialize(quantiles_of(values, keys, [0.5]).select(*keys, F.col("q")[0].alias("mid")), "medians")
        far = values.join(mid, keys).groupBy(*keys, F.abs(F.col("x") - F.col("mid")).alias("x")).agg(F.sum("cnt").alias("cnt"))
        sizes = values.groupBy(*keys).agg(F.sum("cnt").alias("__n"))
        bounds = mid.join(quantiles_of(materialize(far, "distances"), keys, [0.5]), keys).join(sizes, keys).select(*keys, "mid", (1.4826 * F.col("q")[0]).alias("mad"), "__n")
        score = F.when(F.col("mad") > 0, F.abs(x - F.col("mid")) / F.col("mad")).otherwise(0.0)
    elif method == "zscore":
        bounds = cells(df, names, by).groupBy(*keys).agg(F.avg("x").alias("mid"), F.stddev_samp("x").alias("sd"), F.count("*").alias("__n"))
        score = F.when(F.col("sd") > 0, F.abs(x - F.col("mid")) / F.col("sd")).otherwise(0.0)
    else:
        raise ValueError(f"unknown method {method!r}")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), finite(c).alias("value")) for c in names]))
    rows = df.select(*by, key, each.alias("c")).select(*by, key, "c.*")
    out = rows.join(bounds.where("__n >= 2").drop("__n"), keys).withColumn("score", F.when(x.isNotNull(), score))
    out = out.withColumn("is_outlier", F.col("score") > limit).select(*by, key, "variable", "value", "score", "is_outlier")
    if checked is not None:
        out = out.observe(checked, *[F.count_if((F.col("variable") == c) & x.isNotNull()).alias(c) for c in names])
    return out.where("is_outlier") if flagged_only else out


def outliers(df: DataFrame, key: str, col: str, method: str = "iqr", threshold: float | None = None) -> DataFrame:
    """``outliers_all`` of one column, all rows."""
    return outliers_all(df, key, which=[col], method=method, threshold=threshold, flagged_only=False)
