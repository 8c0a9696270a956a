import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage.operators import reduce, timecode


def hours(spark, n=2400):
    """One row an hour; load follows the clock, noise follows nothing, name is the weekday."""
    t = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 3600)
    df = spark.range(n).withColumn("at", t)
    noise = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000
    return df.withColumns({"load": F.sin(F.hour("at") / 24 * 2 * math.pi) + noise, "noise": F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1000)) / 1000, "name": F.date_format("at", "E")})


def test_cycles_that_others_follow(spark):
    df = hours(spark)
    got = timecode.encode(df, "id", ["at", "load", "noise"])
    assert got.names == ["at_elapsed", "at_hour_sin", "at_hour_cos", "load", "noise"]
    assert {r.cycle: r.used for r in got.cycles.itertuples()} == {"hour": True, "wday": False, "mday": False}
    r = got.df.orderBy("id").limit(2).collect()
    assert (r[0].at_elapsed, round(r[1].at_elapsed, 9)) == (0.0, round(1 / 24, 9))
    assert timecode.encode(df.repartition(5), "id", ["at", "load", "noise"]).names == got.names
    named = timecode.encode(df, "id", ["at", "noise", "name"]).cycles.set_index("cycle")
    assert named.same["wday"] == "name" and not named.used["wday"]


def test_other_ways_and_names(spark):
    df = hours(spark, 200).withColumns({"at_elapsed": F.lit(1), "took": F.expr("make_dt_interval(1, 12)")})
    assert timecode.encode(df, "id", ["at", "load"], "elapsed").names == ["at_elapsed_1", "load"]
    assert timecode.encode(df, "id", ["at", "load"], "drop").names == ["load"]
    assert "at_hour_sin" in timecode.encode(df, "id", ["at"]).names
    took = timecode.encode(df, "id", ["took", "load"])
    assert took.df.select(took.names[0]).first()[0] == 1.5
    with pytest.raises(ValueError):
        timecode.encode(df, "id", ["at"], "never")
    empty = timecode.encode(df.limit(0), "id", ["at", "load"])
    assert empty.df.count() == 0 and empty.names == ["at_elapsed_1", "load"]


def test_month_and_year(spark):
    df = spark.range(900).select("id", F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    p = timecode.places(df, "d")
    r = {str(x.d): x for x in df.select("d", *[v.share.alias(a) for a, v in p.items()]).collect()}
    assert set(p) == {"wday", "mday", "yday"}
    assert r["2020-02-29"].mday == 28 / 29 and r["2021-02-28"].mday == 27 / 28 and r["2020-01-05"].wday == 0.0 and r["2020-12-31"].yday == 365 / 366


def test_reduction_takes_time_columns(spark):
    df = hours(spark, 800)
    got = reduce.reduce(df, "id", ["at", "load", "noise"], 3)
    assert got.method == "pca" and {"at_elapsed", "at_hour_sin", "at_hour_cos", "load", "noise"} == set(got.contrib.variable)
    assert np.isclose(reduce.reduce(df, "id", ["at", "load", "noise"], 3, time="drop").eig.eigenvalue.sum(), 2)
