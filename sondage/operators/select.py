"""Which rows and columns an analysis uses, and samples of rows or groups."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondage.plans.shared import materialize

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
TIME = (T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType)


def class_of(kind: T.DataType) -> str:
    """logical, time, numeric, categorical; nested for types that are only counted."""
    if isinstance(kind, T.BooleanType):
        return "logical"
    if isinstance(kind, TIME):
        return "time"
    if isinstance(kind, NUMERIC):
        return "numeric"
    return "nested" if isinstance(kind, T.ArrayType | T.MapType | T.StructType | T.VariantType) else "categorical"


def columns_of(df: DataFrame, *classes: str) -> list[str]:
    return [f.name for f in df.schema if class_of(f.dataType) in classes]


def cols(df: DataFrame, which: str | Sequence[str] | Callable[[T.StructField], bool] | None = None, negate: bool = False, fixed: bool = False, by: Sequence[str] = ()) -> list[str]:
    """Names by list, by one pattern or by a predicate of the field. A name beats a pattern."""
    check_by(df, by)
    eligible = [c for c in df.columns if c not in by]
    if which is None:
        hits = eligible
    elif callable(which):
        hits = [f.name for f in df.schema if f.name in eligible and which(f)]
    elif isinstance(which, str) and which not in df.columns:
        hits = [c for c in eligible if (which in c if fixed else re.search(which, c))]
        if not hits:
            raise ValueError(f"no column matches {which!r}")
    else:
        wanted = [which] if isinstance(which, str) else list(which)
        unknown = [c for c in wanted if c not in df.columns]
        if unknown:
            raise ValueError(f"unknown columns {unknown}; there are {df.columns[:12]}")
        hits = [c for c in wanted if c in eligible]
    if negate:
        hits = [c for c in eligible if c not in hits]
    if not hits:
        raise ValueError("no column is left")
    return hits


def check_by(df: DataFrame, by: Sequence[str]) -> None:
    unknown = [c for c in by if c not in df.columns]
    if unknown:
        raise ValueError(f"'by' takes names of columns; unknown: {unknown}")


def row_filter(rows: Column | dict[str, str], negate: bool = False, fixed: bool = False) -> Column:
    """A condition (null is out either way), or patterns that all match (null never does, so negation keeps it)."""
    if isinstance(rows, Column):
        return F.coalesce(~rows if negate else rows, F.lit(False))
    hit = F.lit(True)
    for c, pattern in rows.items():
        one = F.col(c).contains(pattern) if fixed else F.col(c).rlike(pattern)
        hit = hit & F.coalesce(one, F.lit(False))
    return ~hit if negate else hit


def subset(df: DataFrame, rows: Column | dict[str, str] | Sequence[int] | None = None, which=None, negate: bool = False, fixed: bool = False, key: str | None = None) -> DataFrame:
    """Rows by a condition (null is out either way), by patterns (all must match;
    null never does, so negation keeps it), or by the values of ``key``; then columns.
    Values that no row has, and a selection of no rows, are errors."""
    if isinstance(rows, Column | dict):
        df = df.where(row_filter(rows, negate, fixed))
    elif rows is not None:
        if key is None or len(set(rows)) != len(rows) or any(r < 0 for r in rows):
            raise ValueError("positions are unique, not negative, and need 'key'")
        ids = df.sparkSession.createDataFrame([(r,) for r in rows], f"`{key}` long")
        if (held := ids.join(df.select(key).distinct(), key, "left_semi").count()) < len(rows):
            raise ValueError(f"{len(rows) - held} positions are not in the table")
        df = df.join(ids, key, "left_anti" if negate else "left_semi")
    if rows is not None and df.isEmpty():
        raise ValueError("no row is left")
    return df if which is None else df.select(*cols(df, which))


def _draw(keys: Sequence[str], seed: int) -> list[Column]:
    return [F.xxhash64(F.lit(seed), *keys), *map(F.col, keys)]


def sample_rows(df: DataFrame, key: Sequence[str], n: int | None = None, prop: float | None = None, seed: int = 1, most: int | None = None) -> DataFrame:
    """Exactly ``n`` rows, or the rounded share of them, or all but ``most`` at most, by a
    hash of the key: the same rows however the data are partitioned. Rows are counted by
    the first bits of the hash; all below a threshold are taken, and only the bin that
    holds it is ordered."""
    draw, *keys = _draw(key, seed)
    bin_ = F.shiftright(draw, 48).alias("bin")
    counts = sorted((r["bin"], r["n"]) for r in df.groupBy(bin_).agg(F.count("*").alias("n")).collect())
    total = sum(k for _, k in counts)
    if most is not None:
        if most >= total:
            return df
        n = most
    elif n is None:
        if not 0 < prop <= 1:
            raise ValueError("a share lies above 0 and is 1 at most")
        n = round(prop * total)
    if not 0 < n <= total:
        raise ValueError(f"{n} rows can't be drawn from {total}")
    below = 0
    for at, k in counts:
        if below + k > n:
            rest = df.where(bin_ == at).orderBy(draw, *keys).limit(n - below)
            return df.where(bin_ < at).unionByName(rest) if below else rest
        below += k
    return df


def sample_groups(df: DataFrame, by: str, n: int | None = None, prop: float | None = None, seed: int = 1) -> DataFrame:
    """All rows of the groups drawn; null is a group."""
    groups = sample_rows(df.select(by).distinct(), [by], n, prop, seed).select(F.col(by).alias("__g"))
    return df.join(groups, F.col(by).eqNullSafe(F.col("__g")), "left_semi")


def sample_crossed(df: DataFrame, by: dict[str, float | int | str], seed: int = 1) -> DataFrame:
    """Each factor's levels drawn on their own (a share below 1, a count, or "all"); rows with all levels drawn stay."""
    if len(by) < 2 or any(size != "all" and not size > 0 for size in by.values()):
        raise ValueError("two factors or more, each with a share, a count or 'all'")
    for c, size in by.items():
        if size == "all" or size == 1:
            continue
        df = sample_groups(df, c, n=size if size > 1 else None, prop=size if size < 1 else None, seed=seed)
    return df


def within_levels(df: DataFrame, within: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """(columns, __size): rows by the combination of nested columns, and the columns from
    the coarsest to the finest, by how many values they have. Each value of a finer column
    lies under one value of the coarser; else the levels aren't nested, which is an error,
    as the data can't say whether a repeated value is one unit or several. Null is a value."""
    check_by(df, within)
    sizes = materialize(df.groupBy(*within).agg(F.count("*").alias("__size")), "within-sizes")
    if len(within) == 1:
        return sizes, list(within)
    known = sizes.agg(*[(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in within]).first()
    order = sorted(within, key=lambda c: (known[c] or 0, list(within).index(c)))
    for coarse, fine in zip(order, order[1:], strict=False):
        over = sizes.select(coarse, fine).distinct().groupBy(fine).agg(F.count("*").alias("__k")).where("__k > 1")
        bad = over.orderBy(F.desc("__k"), fine).first()
        if bad:
            raise ValueError(f"values of {fine} repeat across {coarse} ({bad[fine]!r} is under {bad['__k']} of them), so the levels aren't nested: give different units different ids, or draw each factor's levels with sample_crossed")
    return sizes, order


def _dealt(sizes: DataFrame, fine: str, n: int, seed: int) -> DataFrame:
    """(fine, __size, __want): ``n`` rows over clusters by largest remainder. Clusters of one
    size have one remainder, so the driver sees sizes, of which there are few, and those of
    the remainder at which the rest runs out are drawn by a hash."""
    by_size = {r["__size"]: r["k"] for r in sizes.groupBy("__size").agg(F.count("*").alias("k")).collect()}
    total = sum(size * k for size, k in by_size.items())
    if not 0 < n <= total:
        raise ValueError(f"{n} rows can't be drawn from {total}")
    left = n - sum(n * size // total * k for size, k in by_size.items())
    more = F.lit(0)
    remainders = sorted({n * size % total for size in by_size}, reverse=True)
    for rest in remainders:
        same = [size for size in by_size if n * size % total == rest]
        k = sum(by_size[size] for size in same)
        if k <= left:
            more = F.when(F.col("__size").isin(same), 1).otherwise(more)
            left -= k
        if k > left or not left:
            break
    whole = F.floor(F.lit(n).cast("decimal(38,0)") * F.col("__size") / F.lit(total)) if total > 1 << 31 else F.floor(F.lit(n) * F.col("__size") / F.lit(total))
    if left:
        extra = sample_rows(sizes.where(F.col("__size").isin(same)), [fine], n=left, seed=seed).select(F.col(fine).alias("__x"), F.lit(1).alias("__more"))
        sizes = sizes.join(extra, F.col(fine).eqNullSafe(F.col("__x")), "left").drop("__x")
        more = F.coalesce("__more", more)
    return sizes.select(fine, "__size", (whole + more).cast("long").alias("__want"))


#: Leading bits of the hash by which rows of a cluster are counted.
DRAW_BITS = 12


def sample_within(df: DataFrame, by: str | Sequence[str], key: Sequence[str], prop: float | None = None, n: int | None = None, least: int = 2, seed: int = 1, half: str = "even") -> DataFrame:
    """Rows within every cluster, the values of ``by`` or the finest of nested columns: a
    rounded share, or ``n`` in all dealt out by largest remainder, but ``least`` at least
    where a cluster has them. ``inclusion`` is the probability. A share that ends in one
    half goes to the ``even`` number, or ``up``; it is taken of the share as written.

    A cluster's rows are counted by the leading bits of a hash of their key, and bins
    below the one in which its share ends are taken whole; only rows of that bin are
    ordered, so a cluster of very many rows is never ranked in one task."""
    sizes, levels = within_levels(df, [by] if isinstance(by, str) else list(by))
    fine = levels[-1]
    sizes = sizes.groupBy(fine).agg(F.sum("__size").alias("__size"))
    if prop is not None:
        if not 0 < prop <= 1:
            raise ValueError("a share lies above 0 and is 1 at most")
        if half not in ("even", "up"):
            raise ValueError("a half goes to 'even' or 'up'")
        share = F.col("__size").cast("decimal(19,0)") * F.lit(Decimal(str(prop)))
        wanted = sizes.withColumn("__want", (F.bround if half == "even" else F.round)(share).cast("long"))
    else:
        wanted = _dealt(sizes, fine, n, seed)
    take = F.least(F.col("__size"), F.greatest(F.col("__want"), F.least(F.lit(least), F.col("__size"))))
    wanted = wanted.select(F.col(fine).alias("__g"), "__size", take.cast("long").alias("__take"))
    draw, *keys = _draw(key, seed)
    bin_ = F.shiftrightunsigned(draw, 64 - DRAW_BITS).alias("__bin")
    bins = df.groupBy(F.col(fine).alias("__b"), bin_).agg(F.count("*").alias("__k"))
    upto = F.sum("__k").over(Window.partitionBy("__b").orderBy("__bin"))
    bins = bins.withColumn("__before", upto - F.col("__k"))
    ends = wanted.join(bins, F.col("__g").eqNullSafe(F.col("__b")))
    # all bins before the first are taken, and of that one so many rows
    ends = ends.where("__before <= __take and __before + __k > __take").select("__g", "__size", "__take", F.col("__bin").alias("__end"), (F.col("__take") - F.col("__before")).alias("__of"))
    ends = materialize(wanted.join(ends.drop("__size", "__take").withColumnRenamed("__g", "__h"), F.col("__g").eqNullSafe(F.col("__h")), "left").drop("__h"), "within-ends")
    rows = df.withColumn("__bin", bin_).join(ends, F.col(fine).eqNullSafe(F.col("__g")))
    whole = rows.where(F.col("__end").isNull() | (F.col("__bin") < F.col("__end")))
    last = rows.where((F.col("__bin") == F.col("__end")) & (F.col("__of") > 0))
    last = last.withColumn("__rank", F.row_number().over(Window.partitionBy(fine).orderBy(draw, *keys))).where("__rank <= __of").drop("__rank")
    return whole.unionByName(last).select(*df.columns, (F.col("__take") / F.col("__size")).alias("inclusion"))
