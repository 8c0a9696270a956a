import uuid

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from sondage.operators import record, select
from sondage.queries import QUERIES


def panel(spark, n=900):
    rows = [(i, f"r{i % 3}", f"n{i % 9}", None if i % 50 == 0 else float(i % 7)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, region string, nation string, x double")


def test_nested_levels(spark):
    df = panel(spark)
    got = select.sample_within(df, ["nation", "region"], ["id"], prop=0.1, seed=3)
    assert {r["count"] for r in got.groupBy("nation").count().collect()} == {10}
    assert got.exceptAll(select.sample_within(df.repartition(7), ["region", "nation"], ["id"], prop=0.1, seed=3)).isEmpty()
    with pytest.raises(ValueError, match="aren't nested"):
        select.sample_within(df.withColumn("nation", F.concat(F.lit("n"), F.col("id") % 4)), ["region", "nation"], ["id"], prop=0.1)


def test_rows_are_dealt_by_largest_remainder(spark):
    sizes = {"a": 10, "b": 11, "c": 13, None: 5, "d": 1, "e": 60}
    rows = [(f"{g}{i}", g) for g, k in sizes.items() for i in range(k)]
    df = spark.createDataFrame(rows, "id string, g string").repartition(5)
    for n in (20, 33, 49, 100):
        exact = {g: n * k / 100 for g, k in sizes.items()}
        want = {g: int(x) for g, x in exact.items()}
        for g in sorted(sizes, key=lambda g: -(exact[g] - int(exact[g])))[: n - sum(want.values())]:
            want[g] += 1
        want = {g: min(k, max(want[g], min(2, k))) for g, k in sizes.items()}
        got = select.sample_within(df, "g", ["id"], n=n)
        assert {r.g: r["count"] for r in got.groupBy("g").count().collect()} == want
        assert all(abs(r.inclusion - want[r.g] / sizes[r.g]) < 1e-12 for r in got.collect())
    ties = spark.createDataFrame([(i, i // 3) for i in range(300)], "id long, g long")
    got = select.sample_within(ties, "g", ["id"], n=150, least=1)
    counts = [r["count"] for r in got.groupBy("g").count().collect()]
    assert len(counts) == 100 and sum(counts) == 150 and set(counts) == {1, 2}


def test_draws_are_even(spark):
    """Every row of a large cluster has the same chance, whichever bin of the hash it is in."""
    df = spark.range(20000).withColumn("g", F.lit("one"))
    got = select.sample_within(df, "g", ["id"], n=5000)
    ids = [r.id for r in got.collect()]
    assert len(set(ids)) == 5000 and abs(sum(ids) / 5000 - 9999.5) < 250


def test_pieces_of_level_graphs(spark):
    rows = [("a", "x", 1), ("b", "x", 1), ("b", "y", 2), ("c", "z", 2), (None, "z", 3), ("d", None, 3)]
    given = spark.createDataFrame([*rows, ("e", "x", 4)], "p string, q string, k int")
    kept = spark.createDataFrame(rows, "p string, q string, k int")
    got = record.sample_report(given, kept, ["p", "q", "k"])
    table = {r.column: tuple(r)[1:] for r in got.columns.collect()}
    assert table == {"p": (6, 5, 1, 1.0, 4), "q": (4, 4, 1, 1.5, 2), "k": (4, 3, 2, 2.0, 0)}
    assert {(r.a, r.b): (r.pieces, r.connected) for r in got.pairs.collect()} == {("p", "q"): (3, False), ("p", "k"): (2, False), ("q", "k"): (2, False)}
    assert got.notes() == ["4 of 5 levels of p have fewer than 2 rows", "2 of 4 levels of q have fewer than 2 rows", "p and k fall into 2 unconnected pieces", "p and q fall into 3 unconnected pieces", "q and k fall into 2 unconnected pieces"]
    none = record.sample_report(given, kept.limit(0), ["p", "q"])
    assert [r.levels_kept for r in none.columns.collect()] == [0, 0] and none.pairs.first().pieces == 0


def jobs(spark, f):
    group = f"record-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, group)
    out = f()
    found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, found


def test_a_record_costs_no_job(spark):
    df = panel(spark).repartition(4)
    plain, few = jobs(spark, lambda: df.where("x > 3").count())
    (rows, note), none = jobs(spark, lambda: record.recorded(df, F.col("x") > 3, ["id", "x"]))
    assert none == 0
    n, again = jobs(spark, lambda: rows.count())
    assert n == plain and again == few
    assert (note.n_rows_kept, note.n_rows_given) == (plain, 900)
    assert note.lines() == [f"{plain} of 900 rows (subset)", "Columns: 2 of 4 (excluded: region, nation)"]
    rows, note = record.recorded(df, {"region": "^r1"}, negate=True)
    rows.collect()
    assert note.lines() == ["600 of 900 rows (patterns, negated)"]
    rows, note = record.recorded(df, F.col("x") > 99)
    rows.collect()
    with pytest.raises(ValueError, match="no row"):
        note.lines()


def test_rows_that_a_model_used(spark):
    df = panel(spark).withColumn("y", F.when(F.col("id") % 40 != 0, F.col("id") * 2.0))
    pipe = Pipeline(stages=[VectorAssembler(inputCols=["x", "id"], outputCol="features", handleInvalid="skip"), LinearRegression(labelCol="y")])
    model = pipe.fit(df.dropna(subset=["y"]))
    assert record.input_columns(model) == {"x", "id", "y"}
    rows, note = record.model_rows(df, model, ["id"])
    ids = {r.id for r in rows.collect()}
    assert ids == {i for i in range(900) if i % 50 and i % 40} and note.lines()[0] == f"{len(ids)} of 900 rows (model)"

    class Fitted:
        rows_used = df.where("id < 10").select("id")

    rows, note = record.model_rows(df, Fitted(), ["id"], negate=True)
    assert rows.count() == 890 and note.lines() == ["890 of 900 rows (model, negated)"]


def test_a_share_of_one_half_follows_the_rule_given(spark, tmp_path):
    df = spark.range(80).select("id", F.when(F.col("id") < 45, "a").otherwise("b").alias("g"))
    for half, n in (("even", [4, 4]), ("up", [5, 4])):
        got = select.sample_within(df, "g", ["id"], prop=0.1, half=half).groupBy("g").count().orderBy("g").collect()
        assert [r["count"] for r in got] == n
    df.select(F.col("id").alias("o_orderkey"), F.col("g").alias("o_orderstatus")).write.parquet(f"{tmp_path}/orders.parquet")
    got = QUERIES["sample_within_counts"](spark, str(tmp_path)).orderBy("o_orderstatus").collect()
    assert [tuple(r) for r in got] == [("a", 5), ("b", 4)]
