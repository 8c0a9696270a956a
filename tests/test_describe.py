import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from sondage.operators import clean, counts, describe, frame, outliers, select, smd
from sondage.sources.example import example_data


def test_special_values_and_empty_groups(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([("a", 1.0), ("a", nan), ("a", None), ("a", inf), ("b", None), ("c", inf), (None, 5.0), ("d", 2.0)], "g string, x double")
    r = {x.g: x for x in describe.numeric(df, ["g"]).collect()}
    assert set(r) == {"a", "b", "c", "d"}
    assert (r["a"].obs, r["a"].n, r["a"].na, r["a"].n_inf, r["a"]["sum"]) == (4, 1, 2, 1, 1.0)
    assert (r["b"].n, r["b"]["sum"], r["b"]["mean"], r["c"]["sum"]) == (0, 0.0, None, inf)
    assert r["d"].sd is None
    assert describe.numeric(df.limit(0)).first().obs == 0


def test_partitioning_changes_nothing(spark):
    df = example_data(spark)
    for f in (lambda d: describe.gauss(d, ["grp"], ["score", "income"]), lambda d: outliers.hinges(d, ["score", "visits"], ["grp"]), lambda d: describe.time(d, "date", ["grp"]), lambda d: describe.categorical(d)):
        a, b = f(df).toPandas(), f(df.repartition(13)).toPandas()
        keys = [c for c in ("grp", "variable") if c in a]
        a, b = a.sort_values(keys).reset_index(drop=True), b.sort_values(keys).reset_index(drop=True)
        assert np.allclose(a.select_dtypes("number"), b.select_dtypes("number"), equal_nan=True)


def test_planted_defects_are_described(spark):
    df = example_data(spark)
    t = {r.variable: r for r in describe.categorical(df).collect()}
    assert t["site"].case_variants == 1 and t["site"].n_empty > 0 and t["grp"].n_rare == 1 and t["cohort"].p_max == 1
    assert [r.variable for r in describe.constants(df).collect()] == ["cohort"]
    g = {r.variable: r.gauss for r in describe.gauss(df, which=["score", "income", "visits"]).collect()}
    assert g["score"] > 0.95 > g["income"]
    time = describe.time(df, "date").first()
    assert (time.spacing, time.regular, time.n_gaps, time.n_unique) == ("monthly", True, 0, 12)
    tables = describe.describe_all(df)
    assert list(tables) == ["numeric", "time", "categorical", "logical", "constant"]
    assert describe.floor_ends(df, "downtime")["floor"] and not describe.floor_ends(df, "visits")["ceiling"]


def test_gauss_notes(spark):
    df = spark.createDataFrame([(float(i), 7.0) for i in range(10)], "x double, c double")
    assert {r.gauss_note for r in describe.gauss(df).collect()} == {describe.TOO_FEW}
    df = spark.range(50).select(F.lit(7.0).alias("c"))
    r = describe.gauss(df).first()
    assert r.gauss is None and r.gauss_note == describe.ONE_VALUE


def test_skewness_by_formula(spark):
    x = np.array([1, 2, 2, 3, 9, 12.5])
    r = describe.numeric(spark.createDataFrame([(float(v),) for v in x], "x double"), skew=True, kurt=True).first()
    n, d = len(x), x - x.mean()
    g1, g2 = (d**3).mean() / (d**2).mean() ** 1.5, (d**4).mean() / (d**2).mean() ** 2 - 3
    assert r["skew"] == pytest.approx(g1 * math.sqrt(n * (n - 1)) / (n - 2))
    assert r["kurt"] == pytest.approx(((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3)))


def test_hinges_and_outliers(spark):
    for x in ([1.0, 2, 3, 4, 5], [1.0, 2, 3, 4], [5.0, 5, 5, 6, 90, 91], [3.0, 1]):
        s = sorted(x)
        n4 = math.floor((len(s) + 3) / 2) / 2
        at = lambda r: s[int(r) - 1]  # noqa: B023, E731
        want = ((at(math.floor(n4)) + at(math.ceil(n4))) / 2, (at(len(s) + 1 - math.floor(n4)) + at(len(s) + 1 - math.ceil(n4))) / 2)
        df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, x double")
        r = outliers.hinges(df, ["x"]).first()
        assert (r.q1, r.q3) == want
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 1.0, 1.0, 1.0, None, 50.0])], "id long, x double")
    rows = {r.id: r for r in outliers.outliers(df, "id", "x").collect()}
    assert rows[4].score is None and rows[5].score == 0.0
    assert [r.id for r in outliers.outliers_all(df, "id", method="zscore", threshold=1.5).collect()] == [5]


def test_selection(spark):
    df = example_data(spark, 5, 4)
    assert select.cols(df, "^c") == ["consented", "claims", "cohort"] and select.cols(df, "score") == ["score"]
    assert "id" not in select.cols(df, ["id", "score"], negate=True)
    assert select.cols(df, lambda f: f.dataType.typeName() == "boolean") == ["flag", "consented"]
    for bad in ("nothing", ["score", "nope"]):
        with pytest.raises(ValueError):
            select.cols(df, bad)
    with pytest.raises(ValueError):
        select.cols(df, by=["^g"])
    x = spark.createDataFrame([(1, "ab"), (2, None), (3, "cd")], "id long, s string")
    assert [r.id for r in select.subset(x, {"s": "a"}).collect()] == [1]
    assert sorted(r.id for r in select.subset(x, {"s": "a"}, negate=True).collect()) == [2, 3]
    assert [r.id for r in select.subset(x, F.col("s") == "ab", negate=True).collect()] == [3]
    assert select.subset(x, [2, 3], key="id").count() == 2


def test_samples(spark):
    df = example_data(spark, 30, 12).withColumn("row", F.monotonically_increasing_id())
    a = select.sample_rows(df, ["id", "date"], n=50, seed=3)
    assert a.count() == 50 and a.exceptAll(select.sample_rows(df.repartition(5), ["id", "date"], n=50, seed=3)).drop("row").count() == 0
    assert select.sample_groups(df, "id", 7).count() == 84
    assert select.sample_crossed(df, {"id": 0.5, "date": 3}).count() == 45
    w = select.sample_within(df, "grp", ["id", "date"], n=40)
    assert 40 <= w.count() <= 42
    r = w.groupBy("grp").agg(F.count("*").alias("n"), F.first("inclusion").alias("p")).collect()
    assert {x.grp: x.n for x in r}["delta"] == 2 and all(0 < x.p <= 1 for x in r)


def test_cleaning(spark):
    names = ["Miles per gallon", "# of cylinders", "DISP", "HTTPServer", "Café Größe", "a%b", "2nd", "", "x", "x"]
    got = clean.snake(names)
    assert got[:7] == ["miles_per_gallon", "number_of_cylinders", "disp", "http_server", "cafe_grosse", "a_percent_b", "x2nd"] and len(set(got)) == len(got)
    rows = [(" 1", "N/A", "t", " ", None), ("2 ", "3", "FALSE", "", None), (None, " ", None, None, None)]
    df = clean.wash(spark.createDataFrame(rows, "`A b` string, mix string, flag string, blank string, none int"))
    assert df.dtypes == [("a_b", "int"), ("mix", "string"), ("flag", "boolean")] and df.count() == 2
    x = spark.createDataFrame([(1, "a"), (999, None), (None, "z")], "n int, s string")
    assert [r.n for r in clean.recode_errors(x, [999]).collect()] == [1, None, None]
    assert [r.s for r in clean.translate(x, "s", ["a", "a"], ["first", "second"], "other").collect()] == ["first", None, "other"]
    with pytest.raises(ValueError):
        clean.drop_cols(x, ["q"])
    raw = spark.createDataFrame([(bytearray("é".encode()),), (bytearray(b"caf\xe9"),)], "b binary")
    assert [r.b for r in clean.repair_encoding(raw, "b").collect()] == ["é", "café"]
    raw = spark.createDataFrame([(bytearray(b"\x80 5 \x93q\x94"),), (bytearray(b"caf\xe9 \x81"),), (None,)], "b binary")
    assert [r.b for r in clean.repair_encoding(raw, "b").collect()] == ["€ 5 “q”", None, None]


def test_fingerprint(spark):
    df = spark.range(200).withColumn("x", F.col("id") * 3)
    a = clean.data_id(df, ["id"])
    assert a == clean.data_id(df.repartition(9), ["id"]) and a.startswith("200x2:")
    moved = df.withColumn("id", F.when(F.col("id") == 3, 4).when(F.col("id") == 4, 3).otherwise(F.col("id")))
    assert clean.data_id(moved, ["id"]) != a and clean.data_id(df) == clean.data_id(df.orderBy(F.desc("id")))
    assert clean.data_id(df.withColumn("x", F.when(F.col("id") == 7, 0).otherwise(F.col("x")))) != clean.data_id(df)


def test_copies_of_a_frequent_key(spark, monkeypatch):
    """Numbered in parts as by one window, null keys too, and rows without an order."""
    df = spark.createDataFrame([(i, None if i % 5 == 0 else "often" if i % 5 < 4 else f"k{i}", i % 7) for i in range(3000)], "id long, k string, v int").repartition(9)
    want = sorted(map(tuple, counts.copies(df, ["k"], row_id=["v", "id"]).collect()), key=repr)
    monkeypatch.setattr(counts, "WIDE", 100)
    assert sorted(map(tuple, counts.copies(df, ["k"], row_id=["v", "id"]).collect()), key=repr) == want
    loose = counts.copies(df, ["k"]).toPandas()
    assert sorted(loose[loose.k == "often"].copy_number) == list(range(1, 1801)) and sorted(loose[loose.k.isna()].copy_number) == list(range(1, 601))
    assert counts.copies(df, ["k"], "unique").count() == 600 and counts.dupes(df, ["k"]).count() == 2400


def test_values_checked_for_outliers(spark):
    rows = [(i, "a" if i < 30 else "b" if i < 39 else "c", float(i % 7) if i % 4 else None, 900.0 if i == 5 else float(i % 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, g string, x double, y double")
    for method in ("iqr", "mad", "zscore"):
        seen = Observation()
        found = outliers.outliers_all(df, "id", ["g"], method=method, checked=seen).collect()
        assert [(r.id, r.variable) for r in found if r.variable == "y" and r.value == 900] == [(5, "y")]
        # the only row of c can't be judged
        assert seen.get == {"x": sum(i % 4 > 0 for i in range(39)), "y": 39}


def test_all_tables_with_differences(spark):
    rows = [(("a", "b", None)[i % 3], float(i % 11), "uvw"[i % 3 if i % 2 else 0], i % 5 == 0, i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, x double, kind string, flag boolean, at int").withColumn("at", F.date_add(F.lit("2024-01-01").cast("date"), F.col("at")))
    got = describe.describe_all(df, ["g"], gauss=True, smd=True)
    assert set(got) == {"numeric", "categorical", "logical", "time", "constant"}
    for kind, column in (("numeric", "x"), ("categorical", "kind"), ("logical", "flag")):
        found = {r.g: r.smd for r in got[kind].where(F.col("variable") == column).collect()}
        assert found["a"] is None and found["b"] is not None and set(found) == {"a", "b"}
    assert got["numeric"].where("gauss between 0 and 1 and gauss_note is not null").count() == 2
    levels = smd.smd_levels(df, "g", "kind")
    assert abs({r.g: r.smd for r in got["categorical"].collect()}["b"] - levels["b"]) < 1e-12
    with pytest.raises(ValueError):
        describe.describe_all(df, smd=True)


def test_copies(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", 1), (4, None, None)], "id long, k string, v int")
    t = {r.id: (r.copy_number, r.n_copies) for r in counts.copies(df, ["k", "v"], row_id=["id"]).collect()}
    assert t == {1: (1, 2), 2: (2, 2), 3: (1, 1), 4: (1, 1)}
    ids = lambda f: sorted(r.id for r in counts.copies(df, ["k", "v"], f, ["id"]).collect())
    assert (ids("first"), ids("last"), ids("unique"), ids("dupes")) == ([1, 3, 4], [2, 3, 4], [3, 4], [1, 2])


def test_frame_issues(spark):
    df = example_data(spark).withColumns({"score2": F.col("score"), "double": F.col("income") * 2, "sum": F.col("visits") + F.col("claims"), "code": F.when(F.col("grp") == "alpha", "A").when(F.col("grp") == "beta", "B").when(F.col("grp") == "gamma", "C").otherwise("D"), "row": F.concat_ws("-", "id", "date")})
    found = {(r.issue, r.columns) for r in frame.frame_issues(df).collect()}
    assert {("constant", "cohort"), ("id_like", "row"), ("duplicate_columns", "score, score2"), ("collinear", "income, double"), ("aliased_factors", "grp, code"), ("rank_deficient", "double"), ("rank_deficient", "sum")} <= found
    assert frame.rank_deficient(df, ["visits", "claims", "sum"]) == [("sum", ["visits", "claims"])]
    assert frame.rank_deficient(df, ["visits", "claims"]) == []


def test_frame_rank_and_units(spark):
    rows = [(f"g{i % 4}", f"h{i % 4 // 2}", float(i % 4 // 2 * 3), float(i * i % 37), i % 4 == 0, float(i % 11)) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, h string, age double, x double, first boolean, w double")
    found = {(r.issue, r.columns) for r in frame.frame_issues(df).collect()}
    assert ("nested", "g, h") in found and ("unit_level", "age, h") in found and ("unit_level", "age, g") in found
    # the indicator of one level is a combination of the category's indicators; the nested pair isn't told twice
    assert ("rank_deficient", "first") in found or ("nested", "g, first") in found
    assert not any(i == "rank_deficient" and c in ("h", "g") for i, c in found)
    many = df.withColumn("m", F.concat_ws("-", "x", "w"))
    assert ("rank_unchecked", "m") in {(r.issue, r.columns) for r in frame.frame_issues(many).collect()}
    assert ("rank_unchecked", "age, x, w") in {(r.issue, r.columns) for r in frame.frame_issues(spark.createDataFrame([(1.0, 2.0, 5.0), (1.0, 7.0, 5.0), (3.0, 2.0, 6.0)], "age double, x double, w double")).collect()}
    sums = df.withColumn("s", F.col("age") + F.when(F.col("g") == "g1", 2.0).otherwise(0.0) + F.col("w"))
    assert ("s", ["g", "w"]) in frame.rank_deficient(sums, ["g", "x", "w", "s"])
    assert frame.unit_level(df, ["g", "h", "age", "x"]) == [("age", "g"), ("age", "h")]


def test_gauss_reasons(spark):
    """Each kind of departure by a sample that shows it."""
    rng = np.random.default_rng(4)
    n = 3000
    data = {
        "normal": rng.normal(10, 1, n), "floor": np.maximum(rng.normal(10, 1, n), 9.0), "zeros": np.where(rng.random(n) < 0.4, 0, rng.poisson(20, n)).astype(float),
        "rating": np.clip(np.round(rng.normal(5.6, 1.2, n)), 1, 5), "two": np.where(rng.random(n) < 0.5, rng.normal(0, 1, n), rng.normal(9, 1, n)), "dice": rng.integers(3, 9, n).astype(float) + 0,
        "lognormal": rng.lognormal(0, 1, n), "left": -rng.lognormal(0, 0.6, n), "tails": rng.standard_t(2, n), "flat": rng.uniform(-1, 1, n), "one": np.full(n, 2.0),
    }
    df = spark.createDataFrame(pd.DataFrame(data))
    got = {r.variable: r for r in describe.gauss_check(df).collect()}
    kinds = {c: r.gauss_kind for c, r in got.items()}
    assert kinds == {"normal": "none", "floor": "floor", "zeros": "zeros", "rating": "rating_ceiling", "two": "multimodal", "dice": "discrete", "lognormal": "bounded_zero", "left": "left_skewed", "tails": "heavy_tailed", "flat": "light_tailed", "one": "not_assessed"}
    assert got["normal"].gauss_note == "" and got["one"].gauss_note == describe.ONE_VALUE and "skewed to the right" in got["lognormal"].gauss_note
    assert all(r.gauss_note.count(";") <= 1 for r in got.values())
    index = {r.variable: r.gauss for r in describe.gauss(df).collect()}
    assert all(index[c] == r.gauss or abs(index[c] - r.gauss) < 1e-12 for c, r in got.items())


def test_group_against_the_scale_of_its_column(spark):
    """A group whose values start at the second point has no floor of the scale."""
    rows = [("a", float(v)) for v in [2] * 60 + [3] * 10 + [4] * 8 + [5] * 6 + [6] * 4] + [("b", float(v)) for v in [1] * 60 + [2] * 10 + [3] * 8 + [4] * 6 + [7] * 3]
    got = {r.g: r.gauss_kind for r in describe.gauss_check(spark.createDataFrame(rows, "g string, x double"), ["g"]).collect()}
    assert got == {"a": "discrete", "b": "rating_floor"}


def test_cut_counts(spark, monkeypatch):
    """Keys that are counted in parts give the same quantiles, in the presence of ties and groups."""
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.choice(["p", "q"], 5000), "x": np.round(rng.lognormal(0, 2, 5000), 2)})
    df = spark.createDataFrame(pdf)
    monkeypatch.setattr(describe, "WIDE", 50)
    monkeypatch.setattr(describe, "CUTS", 32)
    monkeypatch.setattr(describe, "STEP", 8)
    probs = (0.1, 0.25, 0.5, 0.9, 0.999)
    got = {r.g: r.q for r in describe.quantiles(df, ["x"], ["g"], probs).collect()}
    for g, q in got.items():
        assert np.allclose(q, np.quantile(pdf.x[pdf.g == g], probs))
    run = describe.running(describe.value_counts(df, ["x"]), ["variable"], with_n=True).toPandas().sort_values("x")
    assert (run.upto == run.cnt.cumsum()).all() and (run.n == 5000).all()


def test_no_such_columns(spark):
    for f, frame_ in ((describe.numeric, spark.createDataFrame([("a",)], "t string")), (describe.categorical, spark.createDataFrame([(1,)], "n int"))):
        with pytest.raises(ValueError):
            f(frame_)


def test_wash_with_row_names(spark):
    df = spark.createDataFrame([(1, " 3", None, "x "), (2, None, None, " "), (3, "4", None, "y")], "Row int, `A b` string, gone string, T string")
    out = clean.wash(df, names_col="Row")
    assert out.columns == ["Row", "a_b", "t"] and dict(out.dtypes)["a_b"] == "int"
    assert sorted(map(tuple, out.collect())) == [("1", 3, "x"), ("3", 4, "y")]
    with pytest.raises(ValueError):
        clean.wash(df, names_col="none")
    with pytest.warns(UserWarning):
        clean.translate(df, "T", ["x ", "x "], ["p", "q"])


def test_numbers_and_their_shape_are_counted_once(spark, monkeypatch):
    df = spark.createDataFrame([("p" if i % 2 else "q", float(i % 37), i % 5 or None, float(i * i)) for i in range(400)], "g string, b0 double, variable int, x double")
    apart = describe.numeric(df, ["g"]).join(describe.gauss_check(df, ["g"]).select("g", "variable", "gauss", "gauss_kind"), ["g", "variable"])
    calls, real = [], describe.value_counts
    monkeypatch.setattr(describe, "value_counts", lambda *a, **b: (calls.append(a), real(*a, **b))[1])
    both = describe.describe_all(df, ["g"], gauss=True, smd=True)["numeric"]
    assert len(calls) == 1
    assert sorted(map(str, both.select(apart.columns).collect())) == sorted(map(str, apart.collect()))
    means = {(r.g, r.variable): r for r in both.collect()}
    for c in ("b0", "variable", "x"):
        p, q = means["p", c], means["q", c]
        assert p.smd is None and abs(q.smd - (q.mean - p.mean) / ((p.sd**2 + q.sd**2) / 2) ** 0.5) < 1e-9
