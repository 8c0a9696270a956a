"""What a selection or a sample left: an account that goes with a result.

A selection's record counts its rows while the result is computed (``observe``), so it
costs no pass of its own. A sample's report says how many levels and rows of grouping
columns are left, and whether the levels of each pair of columns still hang together."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondage.operators.describe import quantiles_of
from sondage.operators.select import check_by, cols, row_filter
from sondage.plans.components import components
from sondage.plans.shared import materialize

#: Names of left-out columns that a line shows.
SHOWN = 8


@dataclass
class Record:
    """``given`` and ``kept`` are filled by the first action on the data; what asks for
    them before waits for it. Actions that stop early (``take``, ``show``) count what they read."""

    form: str
    negate: bool
    columns_given: list[str]
    columns_kept: list[str]
    given: Observation | None = None
    kept: Observation | None = None

    @property
    def n_rows_given(self) -> int | None:
        return self.given.get["n"] if self.given else None

    @property
    def n_rows_kept(self) -> int | None:
        return self.kept.get["n"] if self.kept else None

    @property
    def columns_excluded(self) -> list[str]:
        return [c for c in self.columns_given if c not in self.columns_kept]

    def lines(self) -> list[str]:
        """One line for rows, if some were chosen, and one for columns."""
        out = []
        if self.kept:
            if not self.n_rows_kept and self.n_rows_given:
                raise ValueError("no row is left")
            out.append(f"{self.n_rows_kept:,} of {self.n_rows_given:,} rows ({self.form}{', negated' if self.negate else ''})")
        if self.columns_excluded:
            gone = self.columns_excluded
            more = f", and {len(gone) - SHOWN} more" if len(gone) > SHOWN else ""
            out.append(f"Columns: {len(self.columns_kept)} of {len(self.columns_given)} (excluded: {', '.join(gone[:SHOWN])}{more})")
        return out


def recorded(df: DataFrame, rows: Column | dict[str, str] | None = None, which: str | Sequence[str] | Callable[[T.StructField], bool] | None = None, negate: bool = False, fixed: bool = False, by: Sequence[str] = ()) -> tuple[DataFrame, Record]:
    """The rows and columns chosen, as ``subset`` does, and the record of the choice."""
    check_by(df, by)
    given = [c for c in df.columns if c not in by]
    kept = given if which is None else cols(df, which, fixed=fixed, by=by)
    note = Record("subset" if isinstance(rows, Column) else "patterns", negate, given, kept)
    if rows is not None:
        note.given, note.kept = Observation(), Observation()
        df = df.observe(note.given, F.count(F.lit(1)).alias("n"))
        df = df.where(row_filter(rows, negate, fixed)).observe(note.kept, F.count(F.lit(1)).alias("n"))
    return (df if which is None else df.select(*by, *kept)), note


def semi_recorded(df: DataFrame, used: DataFrame, key: Sequence[str], negate: bool = False, form: str = "model") -> tuple[DataFrame, Record]:
    """The rows whose key is among those of ``used``, for instance the rows that a model
    was fitted to, with a record; null keys agree with null keys."""
    given, kept = Observation(), Observation()
    note = Record(form, negate, df.columns, df.columns, given, kept)
    ids = used.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(key)]).distinct()
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{i}")) for i, k in enumerate(key)])
    rows = df.observe(given, F.count(F.lit(1)).alias("n")).join(ids, on, "left_anti" if negate else "left_semi")
    return rows.observe(kept, F.count(F.lit(1)).alias("n")), note


def model_rows(df: DataFrame, model, key: Sequence[str], negate: bool = False) -> tuple[DataFrame, Record]:
    """The rows that a fitted model used. A model names them itself (``rows_used``, a
    DataFrame with the key), or is a fitted Spark ML model, or a pipeline of such, that
    was fitted with ``handleInvalid`` other than keep: then rows with a missing or
    non-finite input column are those it left out."""
    own = getattr(model, "rows_used", None)
    if own is not None:
        return semi_recorded(df, own() if callable(own) else own, key, negate)
    inputs = sorted(input_columns(model) & set(df.columns))
    if not inputs:
        raise ValueError("the model names no input column of this table")
    whole = F.lit(True)
    for c in inputs:
        kind = df.schema[c].dataType
        whole = whole & F.col(c).isNotNull()
        if isinstance(kind, T.DoubleType | T.FloatType):
            whole = whole & ~F.isnan(c)
    out, note = recorded(df, whole, negate=negate)
    note.form = "model"
    return out, note


def input_columns(model) -> set[str]:
    """Columns that the stages of a fitted pipeline read and no stage makes."""
    read, made = set(), set()
    for stage in getattr(model, "stages", [model]):
        if hasattr(stage, "stages"):
            inner = input_columns(stage)
            read |= inner - made
        for name in ("inputCol", "featuresCol", "labelCol", "weightCol"):
            if stage.hasParam(name) and stage.isDefined(name):
                read |= {stage.getOrDefault(name)} - made
        if stage.hasParam("inputCols") and stage.isDefined("inputCols"):
            read |= set(stage.getOrDefault("inputCols")) - made
        for name in ("outputCol", "predictionCol", "probabilityCol", "rawPredictionCol"):
            if stage.hasParam(name) and stage.isDefined(name):
                made.add(stage.getOrDefault(name))
        if stage.hasParam("outputCols") and stage.isDefined("outputCols"):
            made |= set(stage.getOrDefault("outputCols"))
    return read


@dataclass
class SampleReport:
    """``columns`` has (column, levels_given, levels_kept, rows_min, rows_median,
    levels_below_2), ``pairs`` (a, b, pieces, connected)."""

    columns: DataFrame
    pairs: DataFrame | None

    def notes(self) -> list[str]:
        out = [f"{r.levels_below_2} of {r.levels_kept} levels of {r.column} have fewer than 2 rows" for r in self.columns.where("levels_below_2 > 0").orderBy("column").collect()]
        if self.pairs is not None:
            out += [f"{r.a} and {r.b} fall into {r.pieces} unconnected pieces" for r in self.pairs.where("not connected").orderBy("a", "b").collect()]
        return out


def sample_report(given: DataFrame, kept: DataFrame, names: Sequence[str]) -> SampleReport:
    """What ``kept`` has left of the levels of grouping columns of ``given``; null is a level.

    The levels of two columns are the nodes of a graph and rows that have both its edges;
    the graphs of all pairs are one table, whose components are found by rounds of joins."""
    check_by(given, names)
    check_by(kept, names)

    def levels(df: DataFrame) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in names]))
        return df.select(each.alias("x")).groupBy("x.column", "x.v").agg(F.count("*").alias("n"))

    whole = levels(given).groupBy("column").agg(F.count("*").alias("levels_given"))
    left = materialize(levels(kept), "sample-levels")
    stats = left.groupBy("column").agg(F.count("*").alias("levels_kept"), F.min("n").alias("rows_min"), F.count_if(F.col("n") < 2).alias("levels_below_2"))
    middle = quantiles_of(left.groupBy("column", F.col("n").cast("double").alias("x")).agg(F.count("*").alias("cnt")), ["column"], [0.5])
    none = F.lit(0).cast("long")
    table = whole.join(stats, "column", "left").join(middle, "column", "left")
    table = table.select("column", "levels_given", *[F.coalesce(c, none).alias(c) for c in ("levels_kept", "rows_min")], F.coalesce(F.col("q")[0], F.lit(0.0)).alias("rows_median"), F.coalesce("levels_below_2", none).alias("levels_below_2"))
    if len(names) < 2:
        return SampleReport(table, None)

    def node(c: str, pair: int) -> Column:
        return F.xxhash64(F.lit(pair), F.lit(c), F.col(c).isNull(), F.coalesce(F.col(c).cast("string"), F.lit("")))

    couples = list(combinations(names, 2))
    edges = [kept.select(*c).distinct().select(F.lit(i).alias("pair"), node(c[0], i).alias("u"), node(c[1], i).alias("v")) for i, c in enumerate(couples)]
    edges = materialize(reduce(DataFrame.unionByName, edges), "sample-edges")
    # each piece is named by one of its nodes, and nodes know their pair
    nodes = edges.select("pair", F.explode(F.array("u", "v")).alias("node")).distinct()
    pieces = components(edges).where("node = root").join(nodes, "node").groupBy("pair").agg(F.count("*").alias("pieces"))
    known = kept.sparkSession.createDataFrame([(i, *c) for i, c in enumerate(couples)], "pair int, a string, b string")
    pairs = known.join(pieces, "pair", "left").select("a", "b", F.coalesce("pieces", none).alias("pieces"), (F.coalesce("pieces", none) == 1).alias("connected"))
    return SampleReport(table, pairs)
