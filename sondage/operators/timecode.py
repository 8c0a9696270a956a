"""Time columns as numbers: days since the first, and places in cycles.

A cycle is a sine and a cosine, so that its ends meet. It is a candidate if the data
span it twice, and is used if some other column varies along it: more than along
shuffled places, on a hashed sample of at most ``SAMPLE`` rows. A column that is a
cycle itself, such as the name of the weekday, is no evidence for it."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondage.functions.fmt import ordinal
from sondage.operators.describe import finite
from sondage.operators.select import class_of, sample_rows

SAMPLE, SHUFFLES, SEED = 5000, 199, 1
#: The days that the data must span for each cycle.
SPANS = {"hour": 2.0, "wday": 14.0, "mday": 61.0, "yday": 730.5}
#: Standard deviations and separation above shuffled places, and the separation at which a column is the cycle.
LEAST_SD, LEAST_GAIN, SAME = 5.0, 0.01, 0.9


@dataclass
class Place:
    """How far a row is in a cycle, from 0 to 1, and its bin for the test."""

    share: Column
    bin: Column


def days(df: DataFrame, c: str) -> Column:
    """Days since the epoch, or the length of a duration in days."""
    kind = df.schema[c].dataType
    if isinstance(kind, T.DayTimeIntervalType):
        return F.col(c).cast("interval second").cast("decimal(20,6)").cast("double") / 86400
    if isinstance(kind, T.DateType):
        return F.unix_date(F.col(c)).cast("double")
    return F.unix_micros(F.col(c).cast("timestamp")) / 86400e6


def places(df: DataFrame, c: str) -> dict[str, Place]:
    """The cycles of a date or a timestamp. The month's is the share of its own month."""
    x, dated = F.col(c), isinstance(df.schema[c].dataType, T.DateType)
    clock = F.lit(0.0) if dated else (F.hour(x) * 3600 + F.minute(x) * 60 + F.second(x)) / 86400
    length = F.dayofmonth(F.last_day(x))
    gone = (F.dayofmonth(x) - 1) / length
    out = {} if dated else {"hour": Place(clock, F.hour(x))}
    return out | {
        "wday": Place((F.dayofweek(x) - 1 + clock) / 7, F.dayofweek(x)),
        "mday": Place(gone + clock / length, F.least(F.lit(9), F.floor(gone * 10))),
        "yday": Place((F.dayofyear(x) - 1 + clock) / 366, F.month(x)),
    }


#: The bins in which a stretch of a cycle is looked for, and their names.
ARC_BINS = {"hour": 24, "wday": 7, "mday": 31, "yday": 12}
DAYS, MONTHS = ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"), ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
#: A stretch stands out by this difference of shares, and by so many standard errors.
ARC_LEAST, ARC_ERRORS = 0.15, 3.0


def arc_bin(c: str, cycle: str) -> Column:
    """The bin of a time in a cycle, from 0."""
    x = F.col(c)
    return {"hour": lambda: F.hour(x), "wday": lambda: F.dayofweek(x) - 1, "mday": lambda: F.dayofmonth(x) - 1, "yday": lambda: F.month(x) - 1}[cycle]()


@dataclass
class Arc:
    """A stretch of a cycle, which may wrap: its first bin, its length, how many of the
    group's and of all rows fall in it, and their shares."""

    cycle: str
    first: int
    length: int
    n_group: int
    n_all: int
    share: float
    share_all: float
    stands_out: bool

    @property
    def label(self) -> str:
        last = (self.first + self.length - 1) % ARC_BINS[self.cycle]
        if self.cycle == "hour":
            return f"between {self.first:02d}:00 and {last:02d}:59"
        if self.cycle == "mday":
            return f"on the {ordinal(self.first + 1)} of the month" if self.length == 1 else f"from the {ordinal(self.first + 1)} to the {ordinal(last + 1)} of the month"
        names = DAYS if self.cycle == "wday" else MONTHS
        said = names[self.first] if self.length == 1 else f"{names[self.first]}-{names[last]}"
        return f"{'on' if self.cycle == 'wday' else 'in'} {said}"


def best_arc(cycle: str, group: np.ndarray, every: np.ndarray) -> Arc | None:
    """Of all stretches up to half a cycle, the one in which the group's share differs most
    from that of all rows, shortest first; it may be one where the group is absent. The
    counts go once around and once more, so that stretches that wrap are plain sums."""
    if not group.sum():
        return None
    nb = len(group)
    a, b = (np.r_[0, np.cumsum(np.tile(x, 2))] for x in (group, every))
    best = None
    for length in range(1, nb // 2 + 1):
        first = np.arange(nb)
        in_group, in_all = a[first + length] - a[first], b[first + length] - b[first]
        far = np.abs(in_group / group.sum() - in_all / every.sum())
        for s in first.tolist():
            if best is None or far[s] > best[0] + 1e-12:
                best = (far[s], s, length, int(in_group[s]), int(in_all[s]))
    far, s, length, n_group, n_all = best
    share, share_all = n_group / int(group.sum()), n_all / int(every.sum())
    error = math.sqrt(share_all * (1 - share_all) / int(group.sum()))
    return Arc(cycle, s, length, n_group, n_all, share, share_all, bool(far >= max(ARC_LEAST, ARC_ERRORS * error)))


def arcs(df: DataFrame, group: str, cycles: dict[str, Sequence[str]]) -> dict[tuple[object, str, str], tuple[Arc, int, int]]:
    """By (group, column, cycle): the best arc, and how many of the group's and of all rows
    have a time. One pass counts rows by group and bin, of which few come to the driver."""
    cells = [F.struct(F.lit(c).alias("c"), F.lit(a).alias("a"), arc_bin(c, a).alias("b")) for c, names in cycles.items() for a in names]
    if not cells:
        return {}
    held = df.select(F.col(group).alias("g"), F.explode(F.array(*cells)).alias("x")).where("x.b is not null").groupBy("g", "x.c", "x.a", "x.b").agg(F.count("*").alias("n")).collect()
    tables: dict[tuple[str, str], dict[object, np.ndarray]] = {}
    for r in held:
        tables.setdefault((r.c, r.a), {}).setdefault(r.g, np.zeros(ARC_BINS[r.a], np.int64))[r.b] += r.n
    out = {}
    for (c, a), by in tables.items():
        every = sum(by.values())
        for g, own in by.items():
            if g is not None and (arc := best_arc(a, own, every)):
                out[g, c, a] = (arc, int(own.sum()), int(every.sum()))
    return out


def _separation(cell: np.ndarray, number: bool, bins: np.ndarray) -> float:
    """Eta squared of a number, Cramér's V of codes; missing cells are out."""
    ok = ~np.isnan(cell)
    cell, bins = cell[ok], np.unique(bins[ok], return_inverse=True)[1]
    if len(cell) < 2 or bins.max(initial=0) < 1:
        return 0.0
    if number:
        d = cell - cell.mean()
        total = d @ d
        return float((np.bincount(bins, d) ** 2 / np.bincount(bins)).sum() / total) if total > 0 else 0.0
    codes = np.unique(cell, return_inverse=True)[1]
    shape = (codes.max() + 1, bins.max() + 1)
    if min(shape) < 2:
        return 0.0
    table = np.bincount(codes * shape[1] + bins, minlength=shape[0] * shape[1]).reshape(shape)
    expected = np.outer(table.sum(1), table.sum(0)) / len(cell)
    return float(math.sqrt(((table - expected) ** 2 / expected).sum() / len(cell) / (min(shape) - 1)))


def follows(cells: dict[str, tuple[np.ndarray, bool]], bins: np.ndarray, seed: int = SEED) -> tuple[bool, list[str]]:
    """Whether a column varies along the bins, and the columns that are the cycle."""
    real = {c: _separation(x, number, bins) for c, (x, number) in cells.items()}
    same = [c for c, s in real.items() if s >= SAME]
    rest = [c for c in cells if c not in same]
    if not rest or len(np.unique(bins)) < 2:
        return False, same
    rng = np.random.default_rng(seed)
    null = np.array([max(_separation(*cells[c], shuffled) for c in rest) for shuffled in (rng.permutation(bins) for _ in range(SHUFFLES))])
    gain = max(real[c] for c in rest) - null.mean()
    return bool(gain >= LEAST_GAIN and gain >= LEAST_SD * null.std(ddof=1)), same


@dataclass
class TimeCode:
    df: DataFrame
    names: list[str]
    #: One row a cycle that the data span: column, cycle, used, columns that are the cycle.
    cycles: pd.DataFrame

    @property
    def used(self) -> dict[str, list[str]]:
        """The cycles that became columns, by time column."""
        on = self.cycles[self.cycles["used"].astype(bool)] if len(self.cycles) else self.cycles
        return {c: list(g["cycle"]) for c, g in on.groupby("column")}


def encode(df: DataFrame, key: str, names: Sequence[str], time: str = "cycles") -> TimeCode:
    """``names`` with time columns replaced by numbers (``cycles``), by the elapsed days
    alone (``elapsed``), or left out (``drop``). Without other columns to test
    against every candidate is used; with fewer than ten rows none is."""
    if time not in ("cycles", "elapsed", "drop"):
        raise ValueError(f"time must be cycles, elapsed or drop, not {time!r}")
    times = [c for c in names if class_of(df.schema[c].dataType) == "time"]
    others = [c for c in names if c not in times]
    rows, new, out = [], {}, []
    cycled = [c for c in times if not isinstance(df.schema[c].dataType, T.DayTimeIntervalType)]
    span = {c: r for c, r in zip(times, df.agg(*[F.struct(F.min(days(df, c)).alias("lo"), F.max(days(df, c)).alias("hi")) for c in times]).first(), strict=True)} if times and time != "drop" else {}

    def fresh(name: str) -> str:
        taken, n, got = {*df.columns, *new}, 1, name
        while got in taken:
            got, n = f"{name}_{n}", n + 1
        return got

    for c in names:
        if c in others:
            out.append(c)
            continue
        if time == "drop":
            continue
        lo, hi = span[c]
        at = fresh(f"{c}_elapsed")
        new[at] = days(df, c) if c not in cycled else days(df, c) - F.lit(lo)
        out.append(at)
        if time == "elapsed" or c not in cycled or lo is None:
            continue
        can = {a: p for a, p in places(df, c).items() if hi - lo >= SPANS[a]}
        found: dict[str, tuple[bool, list[str]]] = {a: (True, []) for a in can}
        if others and can:
            cells = [finite(o) if class_of(df.schema[o].dataType) in ("numeric", "logical") else F.col(o).cast("string") for o in others]
            pdf = sample_rows(df.where(F.col(c).isNotNull()), [key], most=SAMPLE).select(*[x.alias(f"o{i}") for i, x in enumerate(cells)], *[p.bin.alias(f"b_{a}") for a, p in can.items()]).toPandas()
            table = {}
            for i, o in enumerate(others):
                number = class_of(df.schema[o].dataType) == "numeric"
                codes = pdf[f"o{i}"].to_numpy(float) if class_of(df.schema[o].dataType) in ("numeric", "logical") else pd.factorize(pdf[f"o{i}"])[0].astype(float)
                table[o] = (codes if number else np.where(codes < 0, np.nan, codes), number)
            found = {a: follows(table, pdf[f"b_{a}"].to_numpy()) if len(pdf) >= 10 else (False, []) for a in can}
        for a, (used, same) in found.items():
            rows.append((c, a, used, ", ".join(same)))
            if used:
                for name, f in (("sin", F.sin), ("cos", F.cos)):
                    at = fresh(f"{c}_{a}_{name}")
                    new[at] = f(can[a].share * (2 * math.pi))
                    out.append(at)
    return TimeCode(df.withColumns(new) if new else df, out, pd.DataFrame(rows, columns=["column", "cycle", "used", "same"]))
