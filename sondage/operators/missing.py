"""How much is missing, in which patterns, and whether it matters for a question."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.functions.dist import chi2_sf, p_adjust, t_sf2
from sondage.operators import logits
from sondage.operators.counts import missing
from sondage.operators.describe import correlation, finite
from sondage.operators.select import class_of
from sondage.plans.shared import materialize


def incomplete(df: DataFrame, names: Sequence[str]) -> list[tuple[str, int]]:
    """Columns with missing values, most first; ties in column order."""
    row = df.agg(*[F.count_if(missing(df, c)).alias(f"c{i}") for i, c in enumerate(names)]).first()
    return sorted([(c, n) for c, n in zip(names, row, strict=True) if n], key=lambda x: -x[1])


def patterns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(pattern, n, n_missing): 1 for missing, in the order of ``names``."""
    bits = [F.when(missing(df, c), "1").otherwise("0") for c in names]
    out = df.groupBy(F.concat(*bits).alias("pattern")).agg(F.count("*").alias("n"))
    return out.withColumn("n_missing", F.length(F.replace("pattern", F.lit("0"), F.lit(""))).cast("long")).orderBy(F.desc("n"), "pattern")


def monotone(df: DataFrame, names: Sequence[str]) -> bool:
    """Whether columns, fewest missing first, are missing only where the next one is."""
    order = [c for c, _ in sorted(incomplete(df, names), key=lambda x: x[1])]
    if len(order) < 2:
        return True
    row = df.agg(*[F.count_if(missing(df, a) & ~missing(df, b)).alias(f"c{i}") for i, (a, b) in enumerate(zip(order[:-1], order[1:], strict=True))]).first()
    return not any(row)


def screen_numeric(df: DataFrame, gaps: Sequence[str], others: Sequence[str]) -> DataFrame:
    """(missing_in, related_to, n, r): correlation of the missing indicator with the
    observed values of the other column; one pass for all pairs."""
    aggs, names = [], []
    for v in gaps:
        for w in others:
            if v != w:
                x = finite(w)
                hole = F.when(x.isNotNull(), missing(df, v).cast("double"))
                aggs.append(F.struct(F.lit(v).alias("missing_in"), F.lit(w).alias("related_to"), F.count(x).alias("n"), correlation(hole, x).alias("r")).alias(f"p{len(names)}"))
                names.append((v, w))
    return df.agg(*aggs).select(F.explode(F.array(*[F.col(f"p{i}") for i in range(len(names))])).alias("x")).select("x.*")


def screen_categorical(df: DataFrame, gaps: Sequence[str], others: Sequence[str]) -> DataFrame:
    """(missing_in, related_to, n, levels, chi2, v): chi-squared without correction and
    Cramér's V, from the counts of level and indicator."""
    flags = [missing(df, v).cast("int").alias(f"m{i}") for i, v in enumerate(gaps)]
    each = F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.col(w).cast("string").alias("level")) for w in others]))
    cells = df.select(*flags, each.alias("c")).where("c.level is not null").groupBy("c.w", "c.level").agg(F.count("*").alias("n"), *[F.sum(f"m{i}").alias(f"m{i}") for i in range(len(gaps))])
    long = cells.select("w", "level", "n", F.explode(F.array(*[F.struct(F.lit(v).alias("v"), F.col(f"m{i}").alias("m")) for i, v in enumerate(gaps)])).alias("x")).select("w", "level", "n", "x.*").where("v <> w")
    total = long.groupBy("v", "w").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.count("*").alias("levels"), F.sum(F.col("m").cast("double") * F.col("m") / F.col("n")).alias("s"))
    p = F.col("m") / F.col("n")
    chi2 = F.when((p > 0) & (p < 1), (F.col("s") - F.col("n") * p * p) / (p * (1 - p)))
    return total.select(F.col("v").alias("missing_in"), F.col("w").alias("related_to"), "n", "levels", chi2.alias("chi2"), F.sqrt(F.greatest(chi2, F.lit(0.0)) / F.col("n")).alias("v"))


def _unit_rows(df: DataFrame, unit: str, other: str) -> DataFrame:
    """One row of each unit, among those where ``other`` is there."""
    return df.where(F.col(unit).isNotNull() & ~missing(df, other)).dropDuplicates([unit])


def within_units(df: DataFrame, unit: str, pairs: Sequence[tuple[str, str]]) -> set[tuple[str, str]]:
    """The pairs (v, w) whose indicator "v is missing" and w are constant within every unit, where w is there."""
    out: set[tuple[str, str]] = set()
    for at in range(0, len(pairs), 40):
        part = pairs[at : at + 40]
        aggs = []
        for i, (v, w) in enumerate(part):
            there = ~missing(df, w)
            hole, value = F.when(there, missing(df, v)), F.when(there, F.col(w))
            aggs.append((F.min(hole).eqNullSafe(F.max(hole)) & F.min(value).eqNullSafe(F.max(value))).alias(f"p{i}"))
        row = df.where(F.col(unit).isNotNull()).groupBy(unit).agg(*aggs).agg(*[F.bool_and(f"p{i}") for i in range(len(part))]).first()
        out |= {p for p, same in zip(part, row, strict=True) if same}
    return out


def screen(df: DataFrame, names: Sequence[str], min_effect: float = 0.1, alpha: float = 0.05, adjust: str = "holm", unit: str | None = None) -> list[dict]:
    """Every pair of an incomplete and another column, strongest first. With ``unit``,
    a pair that is constant within every unit is tested on units, and others by a
    Wald test that is robust to clusters (none below 30 units)."""
    names = [c for c in names if c != unit]
    gaps = [c for c, _ in incomplete(df, names)]
    if not gaps:
        return []
    kinds = {c: class_of(df.schema[c].dataType) for c in names}

    def tests(df: DataFrame, gaps: Sequence[str], others: Sequence[str]) -> list[dict]:
        numbers = [c for c in others if kinds[c] == "numeric"]
        factors = [c for c in others if kinds[c] in ("categorical", "logical", "time")]
        out = []
        for r in screen_numeric(df, gaps, numbers).collect() if any(v != w for v in gaps for w in numbers) else []:
            if r.n >= 10 and r.r is not None and not np.isnan(r.r):
                t = abs(r.r) * np.sqrt((r.n - 2) / max(1 - r.r**2, 1e-300))
                out.append({"missing_in": r.missing_in, "related_to": r.related_to, "effect": abs(r.r), "p_value": float(t_sf2(float(t), r.n - 2)), "method": "correlation"})
        for r in screen_categorical(df, gaps, factors).collect() if factors else []:
            if r.n >= 10 and r.chi2 is not None and r.levels > 1:
                out.append({"missing_in": r.missing_in, "related_to": r.related_to, "effect": r.v, "p_value": float(chi2_sf(r.chi2, r.levels - 1)), "method": "chi-squared"})
        return out

    out = tests(df, gaps, names)
    if unit is not None and out:
        whole = within_units(df, unit, [(x["missing_in"], x["related_to"]) for x in out])
        on_units = [t for w in sorted({w for _, w in whole}) for t in tests(_unit_rows(df, unit, w), sorted({v for v, x in whole if x == w}), [w])]
        rest = [x for x in out if (x["missing_in"], x["related_to"]) not in whole]
        rows, index = _design_rows(df, gaps, sorted({x["related_to"] for x in rest}), unit)
        models = [logits.Model(f"m{gaps.index(x['missing_in'])}", index[x["related_to"]]) for x in rest]
        logits.fit(rows, models)
        for x, p in zip(rest, logits.cluster_walds(rows, models, [m.x for m in models], "unit") if rest else [], strict=True):
            x["p_value"], x["method"] = p, "clusters"
        out = [x | {"method": "units"} for x in on_units] + rest
    for x, p in zip(out, p_adjust([x["p_value"] for x in out], adjust), strict=True):
        x["p_adj"], x["flag"] = p, p is not None and p < alpha and x["effect"] >= min_effect
    return sorted(out, key=lambda x: -x["effect"])


def design(df: DataFrame, names: Sequence[str]) -> list:
    """Numeric columns as they are, categories as indicators of all but the first level (2 to 20 levels)."""
    out = []
    for c in names:
        kind = class_of(df.schema[c].dataType)
        if kind == "numeric":
            out.append(finite(c))
        elif kind == "time":
            out.append(F.unix_date(F.col(c).cast("date")).cast("double"))
        else:
            levels = sorted(r[0] for r in df.select(F.col(c).cast("string").alias("l")).where("l is not null").distinct().limit(21).collect())
            if 2 <= len(levels) <= 20:
                out += [F.when(F.col(c).isNotNull(), (F.col(c).cast("string") == F.lit(x)).cast("double")) for x in levels[1:]]
    return out


def _design_rows(df: DataFrame, gaps: Sequence[str], names: Sequence[str], unit: str | None = None) -> tuple[DataFrame, dict[str, list[str]]]:
    """Indicators m0.. of the gaps and the standardised design columns x0.. of the
    names (NaN where missing), written once; and the columns of each name.
    Standardising keeps the steps stable and changes neither likelihood nor effect."""
    cells, index = [], {}
    for c in names:
        own = design(df, [c])
        index[c] = [f"x{len(cells) + i}" for i in range(len(own))]
        cells += own
    flags = [missing(df, v).cast("double").alias(f"m{i}") for i, v in enumerate(gaps)]
    key = [F.col(unit).alias("unit")] if unit else []
    rows = df.select(*key, *flags, *[c.cast("double").alias(f"x{i}") for i, c in enumerate(cells)])
    if cells:
        stats = rows.agg(*[F.struct(F.avg(f"x{i}").alias("m"), F.stddev_pop(f"x{i}").alias("s")) for i in range(len(cells))]).first()
        scaled = [F.coalesce((F.col(f"x{i}") - F.lit(s.m)) / F.lit(s.s or 1.0), F.lit(float("nan"))).alias(f"x{i}") for i, s in enumerate(stats)]
        rows = rows.select(*(["unit"] if unit else []), *[f"m{i}" for i in range(len(gaps))], *scaled)
    return materialize(rows, "missing-design"), index


def outcome_tests(df: DataFrame, gaps: Sequence[str], y: str, covariates: Sequence[str] = (), unit: str | None = None) -> list[dict]:
    """For each gap, whether it is missing more often for some outcomes, given the
    covariates. The p-value is that of the likelihood ratio of two logistic models;
    the effect is the multiple correlation of the smaller one's Pearson residuals
    with the outcome's columns, these less what the covariates tell of them. With
    ``unit``: on one row a unit if all is constant within units, else by a Wald
    test of the larger model that is robust to clusters."""
    rows, index = _design_rows(df, gaps, [*covariates, y], unit)
    covs, out = [x for c in covariates for x in index[c]], index[y]
    blank = [{"missing_in": v, "effect": None, "p_value": None, "n": 0, "method": "rows"} for v in gaps]
    live = [i for i, v in enumerate(gaps) if v != y and out]
    if not live:
        return blank
    sets = [("rows", rows, live)]
    if unit is not None:
        rows = rows.where(F.col("unit").isNotNull())
        there = F.lit(True)
        for x in [*covs, *out]:
            there = there & ~F.isnan(x)
        same = lambda c: F.min(c) == F.max(c)
        used = rows.where(there)
        flat = F.lit(True)
        for x in [*covs, *out]:
            flat = flat & same(x)
        fixed = used.groupBy("unit").agg(*[(same(f"m{i}") & flat).alias(f"m{i}") for i in live]).agg(*[F.bool_and(f"m{i}") for i in live]).first()
        whole = [i for i, f in zip(live, fixed, strict=True) if f]
        sets = [("units", used.dropDuplicates(["unit"]), whole), ("clusters", rows, [i for i in live if i not in whole])]
    for method, data, which in sets:
        small = [logits.Model(f"m{i}", covs, also=out) for i in which]
        large = [logits.Model(f"m{i}", [*covs, *out]) for i in which]
        logits.fit(data, [*small, *large])
        for i, a in zip(which, small, strict=True):
            blank[i]["n"], blank[i]["method"] = a.n, method
        fine = [(i, a, b) for i, a, b in zip(which, small, large, strict=True) if a.n >= 20 and a.converged and b.converged and set(out) <= set(b.kept)]
        if not fine:
            continue
        effects = logits.partial_effects(data, [a for _, a, _ in fine], [out] * len(fine))
        walds = logits.cluster_walds(data, [b for _, _, b in fine], [out] * len(fine), "unit") if method == "clusters" else [None] * len(fine)
        for (i, a, b), effect, wald in zip(fine, effects, walds, strict=True):
            ratio = float(chi2_sf(max(0.0, 2 * (b.loglik - a.loglik)), len(out)))
            blank[i] |= {"effect": effect, "p_value": None if effect is None else wald if method == "clusters" else ratio}
    return blank


def outcome_test(df: DataFrame, v: str, y: str, covariates: Sequence[str] = (), unit: str | None = None) -> dict:
    """``outcome_tests`` of one gap."""
    return outcome_tests(df, [v], y, covariates, unit)[0]


def unit_hint(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Categorical columns of each of whose levels another column has one value only:
    they may name units that have several rows, whose p-values need ``unit``."""
    from sondage.operators.frame import unit_level

    return sorted({u for _, u in unit_level(df, names)})


def check_missing(df: DataFrame, y: str | None = None, covariates: Sequence[str] = (), min_effect: float = 0.1, alpha: float = 0.05, adjust: str = "holm", unit: str | None = None) -> dict:
    """Everything about missing values, with a verdict. Without ``unit``, ``unit_hint``
    names columns that look like one."""
    names = [c for c in df.columns if class_of(df.schema[c].dataType) != "nested"]
    asked = [c for c in (y, unit, *covariates) if c is not None]
    if set(asked) - set(names) or len(set(asked)) != len(asked):
        raise ValueError(f"y, unit and covariates are different columns of {names[:12]}")
    gaps = incomplete(df, names)
    n = df.count()
    shape = patterns(df, [c for c, _ in gaps]) if gaps else None
    pairs = screen(df, names, min_effect, alpha, adjust, unit)
    tests = outcome_tests(df, [v for v, _ in gaps if v != unit], y, covariates, unit) if y and gaps else []
    for x, p in zip(tests, p_adjust([t["p_value"] for t in tests], adjust), strict=True):
        x["p_adj"], x["flag"] = p, p is not None and p < alpha and x["effect"] >= min_effect
    if not gaps:
        verdict = "NONE"
    elif any(t["flag"] for t in tests) or any(p["flag"] and p["related_to"] == y for p in pairs):
        verdict = "RELATED_TO_OUTCOME"
    else:
        verdict = "RELATED_TO_COVARIATES" if any(p["flag"] for p in pairs) else "MCAR_NOT_REJECTED"
    holes = F.lit(False)
    for c, _ in gaps:
        holes = holes | missing(df, c)
    return {
        "variables": [{"variable": c, "n_missing": k, "p_missing": k / n} for c, k in gaps], "patterns": shape, "associations": pairs, "outcome_test": tests,
        "monotone": monotone(df, names), "n": n, "n_complete": df.where(~holes).count(), "y": y, "min_effect": min_effect, "verdict": verdict,
        "unit": unit, "unit_hint": unit_hint(df, names) if unit is None and gaps else [],
    }
