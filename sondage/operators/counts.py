"""Value counts, missing counts and duplicated rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondage.operators.select import NUMERIC, check_by, cols
from sondage.plans.shared import materialize


def counts(df: DataFrame, col: str, n: int | None = None, order: str = "d", na_rm: bool = False) -> DataFrame:
    """(value, n): most frequent first (d), rarest first (a), or by value (i); ties by value."""
    rows = df.where(F.col(col).isNotNull()) if na_rm else df
    out = rows.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    keys = {"d": [F.desc("n"), F.asc("value")], "a": [F.asc("n"), F.asc("value")], "i": [F.asc("value")]}[order]
    return out.orderBy(*keys) if n is None else out.orderBy(*keys).limit(n)


def counts_tb(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    """The ``n`` most and least frequent values side by side; each end is a top-k of its own."""
    base = df.groupBy(F.col(col).cast("string").alias("value")).agg(F.count("*").alias("n"))
    ends = []
    for side, keys in (("top", [F.desc("n"), F.asc("value")]), ("bottom", [F.asc("n"), F.asc("value")])):
        rank = F.row_number().over(Window.orderBy(*keys))
        ends.append(base.orderBy(*keys).limit(n).select(rank.cast("long").alias("rank"), F.col("value").alias(f"{side}_value"), F.col("n").alias(f"{side}_n")))
    return ends[0].join(ends[1], "rank", "full")


def long_text(df: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., variable, value): the columns as text, one row a cell."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("value")) for c in names]))
    return df.select(*by, cells.alias("c")).select(*by, "c.variable", "c.value")


def counts_all(df: DataFrame, by: Sequence[str] = (), which=None) -> DataFrame:
    """(by..., variable, value, n) of every column; groups with a null key are left out."""
    check_by(df, by)
    for c in by:
        df = df.where(F.col(c).isNotNull())
    return long_text(df, cols(df, which, by=by), by).groupBy(*by, "variable", "value").agg(F.count("*").alias("n"))


def counts_tb_all(df: DataFrame, n: int = 10, which=None) -> DataFrame:
    """``counts_tb`` of every column."""
    base = counts_all(df, which=which)
    ends = []
    for side, way in (("top", F.desc), ("bottom", F.asc)):
        rank = F.row_number().over(Window.partitionBy("variable").orderBy(way("n"), F.asc("value"))).cast("long")
        ends.append(base.withColumn("rank", rank).where(F.col("rank") <= n).select("variable", "rank", F.col("value").alias(f"{side}_value"), F.col("n").alias(f"{side}_n")))
    return ends[0].join(ends[1], ["variable", "rank"], "full")


def missing(df: DataFrame, c: str):
    """Null, or NaN for a floating-point column."""
    return F.col(c).isNull() | (F.isnan(c) if dict(df.dtypes)[c] in ("double", "float") else F.lit(False))


def na_counts(df: DataFrame, by: Sequence[str] = (), which=None) -> DataFrame:
    """(by..., variable, obs, n, na, p_na) of every column in one pass."""
    check_by(df, by)
    for c in by:
        df = df.where(F.col(c).isNotNull())
    names = cols(df, which, by=by)
    agg = df.groupBy(*by).agg(F.count("*").alias("obs"), *[F.count_if(missing(df, c)).alias(f"na_{i}") for i, c in enumerate(names)])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"na_{i}").alias("na")) for i, c in enumerate(names)]))
    return agg.select(*by, "obs", cells.alias("c")).select(*by, "c.variable", "obs", (F.col("obs") - F.col("c.na")).alias("n"), "c.na", (F.col("c.na") / F.col("obs")).alias("p_na"))


#: Rows of one key from which they are numbered in parts.
WIDE = 100_000


def _same(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{i}")) for i, k in enumerate(keys)])


def _repeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(__0, ..., n_copies) of the keys that stand twice or more: a frequent key is combined
    in the tasks that read it, and its rows may be split when they meet their count."""
    return df.groupBy(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("n_copies")).where("n_copies > 1")


def _numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``copy_number`` of rows that are dealt to parts by key and order, so that a key may
    span many: a number within the part, after the key's rows in the parts before. The
    parts are written, so that a task that runs again finds the same ones."""
    parts = rows.withColumn("__tie", F.monotonically_increasing_id())
    parts = materialize(parts.repartitionByRange(*[F.col(k) for k in keys], *order, "__tie").withColumn("__part", F.spark_partition_id()), "copies")
    held = parts.groupBy(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)], F.col("__part").alias("__p")).agg(F.count("*").alias("__n"))
    names = [f"__{i}" for i in range(len(keys))]
    before = held.withColumn("__before", F.sum("__n").over(Window.partitionBy(*names).orderBy("__p")) - F.col("__n"))
    here = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order, "__tie"))
    return parts.withColumn("__here", here).join(before, _same(keys) & (F.col("__part") == F.col("__p"))).select(*rows.columns, (F.col("__here") + F.col("__before")).cast("long").alias("copy_number"))


def copies(df: DataFrame, keys: Sequence[str] | None = None, filter: str = "all", row_id: Sequence[str] = ()) -> DataFrame:
    """Rows by how often their key occurs; null equals null. ``all`` adds copy_number
    (in the order of ``row_id``) and n_copies, ``dupes`` keeps repeated rows with
    n_copies, ``first``, ``last`` and ``unique`` keep rows."""
    keys = list(keys or df.columns)
    order = [F.col(c) for c in (row_id or keys)]
    if filter == "all":
        sizes = materialize(_repeated(df, keys), "copies-sizes")
        found = df.join(sizes, _same(keys), "left").select(*df.columns, F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"))
        few = found.where(F.col("n_copies") <= WIDE)
        out = few.withColumn("copy_number", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
        if not (wide := sizes.where(F.col("n_copies") > WIDE)).isEmpty():
            out = out.unionByName(_numbered(df.join(wide, _same(keys)).select(*df.columns, "n_copies"), keys, order))
        return out.select(*df.columns, "copy_number", "n_copies")
    if filter == "dupes":
        return df.join(_repeated(df, keys), _same(keys)).select(*df.columns, "n_copies")
    if filter not in ("first", "last", "unique"):
        raise ValueError("filter is all, dupes, first, last or unique")
    # an extreme per key is combined before the shuffle, so a very frequent key is no hot task
    pick = F.max_by if filter == "last" else F.min_by
    found = df.groupBy(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)]).agg(pick(F.struct(*df.columns), F.struct(*order)).alias("r"), F.count("*").alias("__n"))
    return (found.where("__n = 1") if filter == "unique" else found).select("r.*")


def dupes(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    return copies(df, keys, "dupes")


def numeric_names(df: DataFrame, which=None, by: Sequence[str] = ()) -> list[str]:
    return [c for c in cols(df, which, by=by) if isinstance(df.schema[c].dataType, NUMERIC)]
