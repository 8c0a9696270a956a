import re

import pytest

from sondage.operators import describe, levels, smd
from sondage.sources.example import example_data

SCALE = ("never", "seldom", "often", "mostly", "always")


def answers(spark):
    rows = [(i, "never" if i % 2 else SCALE[1 + i % 3], "ab"[i % 3 == 0], "xy"[i % 5 == 0]) for i in range(200)]
    return spark.createDataFrame(rows, "id long, said string, arm string, sex string")


def test_levels_stay_with_the_column(spark, tmp_path):
    df = levels.declare(answers(spark), "said", SCALE, ordered=True)
    want = levels.Levels(SCALE, True)
    other = spark.range(200).withColumnRenamed("id", "key")
    for d in (df.select("said", "id"), df.where("id > 3"), df.join(other, df.id == other.key), df.withColumnRenamed("id", "n"), df.orderBy("id").limit(9)):
        assert levels.declared(d, "said") == want
    df.write.parquet(str(tmp_path / "p"))
    assert levels.declared(spark.read.parquet(str(tmp_path / "p")), "said") == want
    assert levels.declared(levels.undeclare(df, "said"), "said") is None and levels.declared(df, "arm") is None
    few = levels.declare(answers(spark), "said", SCALE[1:])
    assert few.where("said is null").count() == 100
    for bad in ([], ["a", "a"], ["a", None]):
        with pytest.raises(ValueError):
            levels.declare(df, "said", bad)


def test_unused_levels_and_declared_ends(spark):
    df = answers(spark)
    plain = {r.variable: r for r in describe.categorical(df).collect()}["said"]
    assert (plain.ordered, plain.n_unused, plain.note) == (False, 0, "")
    got = {r.variable: r for r in describe.categorical(levels.declare(df, "said", SCALE, ordered=True)).collect()}["said"]
    assert (got.ordered, got.n_unused) == (True, 1) and got.note.startswith("50% of the values are the scale's lowest point (never)") and got.note.endswith("1 unused levels")
    # a pile one step in isn't one at the end of the scale
    below = {r.variable: r for r in describe.categorical(levels.declare(df, "said", ("not asked", *SCALE), ordered=True)).collect()}["said"]
    assert below.note == "2 unused levels"
    by = {r.arm: r for r in describe.categorical(levels.declare(df, "said", SCALE), ["arm"], ["said"]).collect()}
    assert all(r.n_unused == len(SCALE) - r.n_unique and not r.ordered for r in by.values())


def test_first_level_is_the_reference(spark):
    df = answers(spark)
    a = {r.arm: r.smd for r in smd.smd_binary(df, "arm", ["sex"]).collect()}
    b = {r.arm: r.smd for r in smd.smd_binary(levels.declare(df, "arm", ("b", "a")), "arm", ["sex"]).collect()}
    assert a["a"] is None and b["b"] is None and abs(a["b"] + b["a"]) < 1e-12
    c = {r.arm: r.smd for r in smd.smd_binary(levels.declare(df, "sex", ("y", "x")), "arm", ["sex"]).collect()}
    assert abs(c["b"] + a["b"]) < 1e-12
    d = smd.smd_levels(levels.declare(df, "arm", ("b", "a")), "arm", "said")
    assert d["b"] is None and abs(d["a"] - smd.smd_levels(df, "arm", "said")["b"]) < 1e-9


def test_example_declares_a_level_that_no_row_has(spark):
    got = {r.variable: r for r in describe.categorical(example_data(spark)).collect()}["grp"]
    assert got.n_unused == 1 and got.n_unique == 4


def test_rows_are_counted_before_they_meet_their_second_level(spark):
    """A join of the rows brings all those of a variable into one task."""
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), ("b", "y"), ("b", "x"), ("b", None)], "g string, s string")
    got = smd.smd_binary(df, "g", ["s"])
    assert {r.g: r.smd and round(r.smd, 6) for r in got.collect()} == {"a": None, "b": round((2 / 3 - 0.5) / ((2 / 9 + 0.25) / 2) ** 0.5, 6)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[g#\d+, variable#\d+, x#\d+\]", plan)
