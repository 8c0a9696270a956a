"""Problems that belong to columns, pairs of columns or sets of them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.operators.describe import correlation, finite
from sondage.operators.select import class_of, cols
from sondage.plans.shared import materialize

PAIRS = 60


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("n"))


def cramer_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """(chi2, n, levels_a, levels_b, v): Cramér's V without correction, as one row.
    chi2 = n (sum n_ij^2 / (r_i c_j) - 1) needs the cells that occur only."""
    t = crosstab(df, a, b)
    r, c = t.groupBy("a").agg(F.sum("n").alias("ra")), t.groupBy("b").agg(F.sum("n").alias("cb"))
    s = t.join(r, "a").join(c, "b").agg(F.sum(F.col("n").cast("double") * F.col("n") / F.col("ra") / F.col("cb")).alias("s"), F.sum("n").alias("n"), F.count_distinct("a").alias("levels_a"), F.count_distinct("b").alias("levels_b"))
    chi2 = F.col("n") * (F.col("s") - 1)
    k = F.least("levels_a", "levels_b") - 1
    return s.select(chi2.alias("chi2"), "n", "levels_a", "levels_b", F.when(k > 0, F.sqrt(F.greatest(chi2 / F.col("n") / k, F.lit(0.0)))).alias("v"))


def correlations(df: DataFrame, names: Sequence[str]) -> dict[tuple[str, str], float]:
    """Pairwise complete correlations; a bounded number of pairs for each pass."""
    out, pairs = {}, list(combinations(names, 2))
    for at in range(0, len(pairs), PAIRS):
        aggs = []
        for i, (a, b) in enumerate(pairs[at : at + PAIRS]):
            x, y = finite(a), finite(b)
            both = x.isNotNull() & y.isNotNull()
            aggs.append(correlation(F.when(both, x), F.when(both, y)).alias(f"r{i}"))
        row = df.agg(*aggs).first()
        out |= {p: r for p, r in zip(pairs[at : at + PAIRS], row, strict=True) if r is not None and not np.isnan(r)}
    return out


def id_like(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Text or whole numbers, all different and never missing. An approximate
    count rules columns out first; only the rest are counted exactly."""
    n = df.count()
    if not n or not names:
        return []
    kinds = {c: class_of(df.schema[c].dataType) for c in names}
    row = df.agg(*[F.struct(F.count(c).alias("n"), F.approx_count_distinct(c, 0.02).alias("d"), (F.bool_and(finite(c) == F.floor(finite(c))) if kinds[c] == "numeric" else F.lit(True)).alias("whole")).alias(f"c{i}") for i, c in enumerate(names)]).first()
    maybe = [c for i, c in enumerate(names) if kinds[c] in ("numeric", "categorical") and row[i]["n"] == n and row[i]["whole"] and row[i]["d"] >= 0.85 * n]
    return [c for c in maybe if df.select(c).distinct().count() == n]


def duplicate_columns(df: DataFrame, names: Sequence[str]) -> list[tuple[str, str]]:
    """Columns of one type that are equal at every row: candidates by a sum of hashes, then compared."""
    if len(names) < 2:
        return []
    types = dict(df.dtypes)
    row = df.agg(*[F.sum(F.xxhash64(c).cast("decimal(38,0)")).alias(f"c{i}") for i, c in enumerate(names)]).first()
    same = [(a, b) for (i, a), (j, b) in combinations(enumerate(names), 2) if types[a] == types[b] and row[i] == row[j]]
    if not same:
        return []
    off = df.agg(*[F.count_if(~F.col(a).eqNullSafe(F.col(b))) for a, b in same]).first()
    return [p for p, n in zip(same, off, strict=True) if n == 0]


def _qr(p: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, p))
        for b in batches:
            x = np.column_stack([np.asarray(c, float) for c in b.columns])
            r = np.linalg.qr(np.vstack([r, x]), mode="r")
        yield pa.RecordBatch.from_arrays([pa.array(list(r), pa.list_(pa.float64()))], ["r"])

    return run


def tall_r(df: DataFrame, names: Sequence[str]) -> np.ndarray:
    """The R of a QR decomposition of the columns: each task decomposes its rows, and
    stacked R's again; a task returns one p x p triangle."""
    p = len(names)
    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)]).mapInArrow(_qr(p), "r array<double>")
    width = max(1, rows.rdd.getNumPartitions() // 64)
    if width > 1:
        rows = rows.select(*[F.col("r")[i].alias(f"c{i}") for i in range(p)]).coalesce(64).mapInArrow(_qr(p), "r array<double>")
    stacked = np.array([r.r for r in rows.collect()]).reshape(-1, p)
    return np.linalg.qr(stacked, mode="r") if len(stacked) else np.zeros((0, p))


#: Levels of a category whose indicators enter the rank check.
LEVELS = 50


def unit_level(df: DataFrame, names: Sequence[str]) -> list[tuple[str, str]]:
    """(number, category) pairs: the number varies, but takes one value at each level of
    a category whose levels have two rows or more on average."""
    numbers = [c for c in names if class_of(df.schema[c].dataType) == "numeric"]
    groups = [c for c in names if class_of(df.schema[c].dataType) == "categorical"]
    if not numbers or not groups:
        return []
    parts = []
    for g in groups:
        own = [F.struct(F.min(finite(c)).alias("lo"), F.max(finite(c)).alias("hi")).alias(f"c{i}") for i, c in enumerate(numbers)]
        levels = df.where(F.col(g).isNotNull()).groupBy(g).agg(F.count("*").alias("n"), *own)
        flat = [(F.bool_and(F.coalesce(F.col(f"c{i}.lo") == F.col(f"c{i}.hi"), F.lit(True))) & (F.min(f"c{i}.lo") < F.max(f"c{i}.hi"))).alias(f"c{i}") for i in range(len(numbers))]
        parts.append(levels.agg(F.lit(g).alias("g"), F.count("*").alias("k"), F.sum("n").alias("n"), *flat))
    rows = reduce(DataFrame.unionByName, parts).collect()
    return [(c, r.g) for r in rows if r.k and r.n >= 2 * r.k for i, c in enumerate(numbers) if r[f"c{i}"]]


def rank_findings(df: DataFrame, names: Sequence[str], tol: float = 1e-7, known: Sequence[set[str]] = ()) -> list[tuple[str, str, list[str]]]:
    """(issue, column, sources) of columns that are linear combinations of those before
    them, with an intercept and with categories as indicators of all but their first
    level: by in-order Gram-Schmidt on the scaled R over the complete rows. Column
    sets in ``known`` are reported elsewhere. ``rank_unchecked`` where complete rows
    are no more than the columns, or a category has over ``LEVELS`` levels."""
    if not names:
        return []
    numbers = [c for c in names if class_of(df.schema[c].dataType) == "numeric"]
    factors = [c for c in names if c not in numbers]
    out: list[tuple[str, str, list[str]]] = []
    levels: dict[str, list[str]] = {}
    if factors:
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in factors]))
        seen = df.select(each.alias("x")).where("x.v is not null").groupBy("x.c").agg(F.approx_count_distinct("x.v", 0.01).alias("k")).collect()
        few = [r.c for r in seen if r.k <= 1.1 * LEVELS]
        if few:
            found = df.select(each.alias("x")).where(F.col("x.c").isin(few) & F.col("x.v").isNotNull()).groupBy("x.c").agg(F.sort_array(F.collect_set("x.v")).alias("v")).collect()
            levels = {r.c: list(r.v) for r in found if len(r.v) <= LEVELS}
        out += [("rank_unchecked", c, []) for c in factors if c not in levels]
    cells: list = []
    owner: list[str] = []
    for c in names:
        if c in numbers:
            cells.append(finite(c))
            owner.append(c)
        for v in levels.get(c, [])[1:]:
            cells.append((F.col(c).cast("string") == F.lit(v)).cast("double"))
            owner.append(c)
    if not cells:
        return out
    alias = [f"x{i}" for i in range(len(cells))]
    rows = df.select(*[x.alias(n) for x, n in zip(cells, alias, strict=True)]).dropna()
    stats = rows.agg(F.count("*").alias("n"), *[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")) for c in alias]).first()
    if stats["n"] <= len(cells) + 1:
        return [*out, ("rank_unchecked", ", ".join(dict.fromkeys(owner)), [])]
    scaled = [((F.col(c) - F.lit(stats[i + 1]["m"])) / F.lit(stats[i + 1]["s"] or 1.0)).alias(c) for i, c in enumerate(alias)]
    r = tall_r(rows.select(F.lit(1.0).alias("__one"), *scaled), ["__one", *alias])
    kept: list[int] = []
    basis: list[np.ndarray] = []
    made: dict[str, set[str]] = {}
    for j in range(r.shape[1]):
        v = r[:, j].copy()
        for q in basis:
            v -= (q @ v) * q
        if np.linalg.norm(v) > tol * max(np.linalg.norm(r[:, j]), 1e-300):
            basis.append(v / np.linalg.norm(v))
            kept.append(j)
        elif j:
            coef = np.linalg.lstsq(r[:, kept], r[:, j], rcond=None)[0]
            made.setdefault(owner[j - 1], set()).update(owner[k - 1] for k, c in zip(kept, coef, strict=True) if k and abs(c) > 1e-6)
    for c, sources in made.items():
        sources.discard(c)
        if {c, *sources} in known:
            continue
        unit = c in numbers and len(sources) == 1 and next(iter(sources)) in factors
        out.append(("unit_level" if unit else "rank_deficient", c, [x for x in names if x in sources]))
    return out


def rank_deficient(df: DataFrame, names: Sequence[str], tol: float = 1e-7) -> list[tuple[str, list[str]]]:
    """(column, sources) of the linear combinations among ``rank_findings``."""
    return [(c, s) for issue, c, s in rank_findings(df, names, tol) if issue == "rank_deficient"]


def factor_pairs(df: DataFrame, names: Sequence[str], v_cut: float = 0.95) -> list[tuple[str, str, str]]:
    """(issue, columns, detail) of pairs of categorical columns: aliased, nested,
    redundant. The cells of a bounded number of pairs are counted in one pass."""
    out = []
    pairs = list(combinations(names, 2))
    for at in range(0, len(pairs), PAIRS):
        part = pairs[at : at + PAIRS]
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("p"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")) for i, (a, b) in enumerate(part)]))
        cells = df.select(each.alias("x")).select("x.*").where("a is not null and b is not null").groupBy("p", "a", "b").agg(F.count("*").alias("n"))
        cells = materialize(cells, "factor-cells")
        ra, cb = cells.groupBy("p", "a").agg(F.sum("n").alias("ra")), cells.groupBy("p", "b").agg(F.sum("n").alias("cb"))
        both = cells.join(ra, ["p", "a"]).join(cb, ["p", "b"])
        sums = both.groupBy("p").agg(
            F.count("*").alias("cells"), F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n") / F.col("ra") / F.col("cb")).alias("s"),
        )
        la = ra.groupBy("p").agg(F.count("*").alias("la"), F.avg((F.col("ra") >= 2).cast("int")).alias("again_a"))
        lb = cb.groupBy("p").agg(F.count("*").alias("lb"), F.avg((F.col("cb") >= 2).cast("int")).alias("again_b"))
        for x in sorted(sums.join(la, "p").join(lb, "p").collect(), key=lambda x: x.p):
            a, b = part[x.p]
            if min(x.la, x.lb) < 2:
                continue
            if x.cells == x.la == x.lb:
                out.append(("aliased_factors", f"{a}, {b}", f"{x.la} levels each, one to one"))
                continue
            if x.cells in (x.la, x.lb):
                fine, coarse, again = (a, b, x.again_a) if x.cells == x.la else (b, a, x.again_b)
                if again >= 0.5:
                    out.append(("nested", f"{fine}, {coarse}", f"each level of {fine} lies in one level of {coarse}"))
                    continue
            v = max(0.0, (x.s - 1) / (min(x.la, x.lb) - 1)) ** 0.5
            if v >= v_cut:
                out.append(("redundant_categories", f"{a}, {b}", f"Cramér's V {v:.3f}"))
    return out


REMEDY = {
    "constant": "drop it", "id_like": "use it as a key, not a predictor", "duplicate_columns": "keep one", "collinear": "keep one or combine them",
    "aliased_factors": "keep one", "nested": "model the nesting or keep one", "redundant_categories": "keep one", "rank_deficient": "drop it or one of its sources",
    "unit_level": "group by the category, or leave one out where it has fixed effects", "rank_unchecked": "check fewer columns, or get more complete rows",
}


def overview(df: DataFrame, names: Sequence[str]) -> tuple[int, dict]:
    """The number of rows, and of each column in one pass: values, whether all are one,
    about how many differ, whether they are whole, and a sum of their hashes."""
    aggs = []
    for i, c in enumerate(names):
        whole = F.bool_and(finite(c) == F.floor(finite(c))) if class_of(df.schema[c].dataType) == "numeric" else F.lit(True)
        aggs.append(F.struct(
            F.count(c).alias("n"), F.min(c).eqNullSafe(F.max(c)).alias("one"), F.approx_count_distinct(c, 0.02).alias("d"), whole.alias("whole"), F.sum(F.xxhash64(c).cast("decimal(38,0)")).alias("hash"),
        ).alias(f"c{i}"))
    row = df.agg(F.count("*").alias("n"), *aggs).first()
    return row["n"], {c: row[f"c{i}"] for i, c in enumerate(names)}


def frame_issues(df: DataFrame, cor_cut: float = 0.999, v_cut: float = 0.95, which=None) -> DataFrame:
    """(issue, columns, detail, remedy), in the order of ``REMEDY``."""
    use = df.select(*cols(df, which))
    flat = [f.name for f in use.schema if class_of(f.dataType) != "nested"]
    kinds, types = {c: class_of(use.schema[c].dataType) for c in flat}, dict(use.dtypes)
    n, seen = overview(use, flat)
    constant = [c for c in flat if seen[c]["one"]]
    names = [c for c in flat if c not in constant]
    maybe = [c for c in names if kinds[c] in ("numeric", "categorical") and seen[c]["n"] == n and seen[c]["whole"] and seen[c]["d"] >= 0.85 * n]
    ids = [c for c in maybe if use.select(c).distinct().count() == n]
    rows = [("constant", c, "one value") for c in constant] + [("id_like", c, "all values differ") for c in ids]
    equal = [(a, b) for a, b in combinations(names, 2) if types[a] == types[b] and seen[a]["hash"] == seen[b]["hash"]]
    off = use.agg(*[F.count_if(~F.col(a).eqNullSafe(F.col(b))) for a, b in equal]).first() if equal else []
    same = [p for p, k in zip(equal, off, strict=True) if k == 0]
    rows += [("duplicate_columns", f"{a}, {b}", "equal at every row") for a, b in same]
    numbers = [c for c in names if kinds[c] == "numeric"]
    r = correlations(use, numbers)
    close = {(a, b): x for (a, b), x in r.items() if abs(x) >= cor_cut and (a, b) not in same}
    rows += [("collinear", f"{a}, {b}", f"r = {x:.6f}") for (a, b), x in close.items()]
    factors = [c for c in names if kinds[c] in ("categorical", "logical") and c not in ids]
    pairs = factor_pairs(use, factors, v_cut)
    rows += pairs
    second = {b for _, b in same}
    left = [c for c in names if c not in second and c not in ids and (c in numbers or c in factors)]
    known = [set(x[1].split(", ")) for x in pairs]
    found = rank_findings(use, left, known=known)
    units = dict.fromkeys([(c, s[0]) for issue, c, s in found if issue == "unit_level"] + unit_level(use, left))
    rows += [("rank_deficient", c, "from " + ", ".join(s)) for issue, c, s in found if issue == "rank_deficient"]
    rows += [("unit_level", f"{c}, {g}", f"one value of {c} at each level of {g}") for c, g in units]
    rows += [("rank_unchecked", c, "too few complete rows or too many levels") for issue, c, _ in found if issue == "rank_unchecked"]
    return df.sparkSession.createDataFrame([(*x, REMEDY[x[0]]) for x in rows], "issue string, columns string, detail string, remedy string")
