import pytest
from pyspark.sql import functions as F

from sondage.operators import clean, remedies


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(40).select("id", F.lit("c").alias("same"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("x2"))


def test_loop_and_replay(spark, table):
    """Found, chosen, applied, logged, and replayed from the script."""
    checks = remedies.check_data(table)
    assert checks[0].status == "FAIL" and {f["finding"] for f in checks[0].findings} >= {"constant", "duplicate_columns", "id_like"}
    rows = remedies.remedies(checks)
    assert [r.id for r in rows] == list(range(1, len(rows) + 1)) and remedies.find(rows, 1).tier == "representation"
    one = remedies.apply(table, rows, "drop_cols/same", "one value")
    assert one.df.columns == ["id", "x", "x2"] and one.log[0]["id_after"] == clean.data_id(one.df)
    with pytest.raises(ValueError, match="another state"):
        remedies.apply(one, rows, "keep_one/x,x2", "copies")
    two = remedies.apply(one, remedies.remedies(one.checks), "keep_one/x, x2", "copies", recheck=False)
    assert two.df.columns == ["id", "x"] and [e["step"] for e in two.log] == [1, 2]
    space = {}
    exec(remedies.cleaning_script(two), space)
    assert clean.data_id(space["replay"](table)) == clean.data_id(two.df)
    with pytest.raises(AssertionError):
        space["replay"](table.where("id > 0"))


def test_by_hand_and_unknown(table):
    rows = remedies.remedies(remedies.check_data(table))
    hand = next(r for r in rows if r.by_hand)
    with pytest.raises(ValueError, match="by hand"):
        remedies.apply(table, rows, hand.key, "no")
    with pytest.raises(KeyError):
        remedies.find(rows, "drop_cols/none")


def test_tables_of_the_users_own(spark, table, monkeypatch):
    own = remedies.remedy_table(table, [{"key": "drop_cols/x2", "fn": "drop_cols", "args": {"names": ["x2"]}, "tier": "rows"}])
    both = remedies.merge(remedies.remedies(remedies.check_data(table)), own)
    assert remedies.find(both, "drop_cols/x2").tier == "rows" and both[-1].key == "drop_cols/x2"
    with pytest.raises(ValueError):
        remedies.merge(own, remedies.remedy_table(table.limit(3), [{"key": "k", "fn": "drop_cols", "args": {"names": ["x"]}}]))
    for bad in ({"key": "k", "fn": "eval", "args": {}}, {"key": "k", "fn": "drop_cols", "args": {"names": ["x"]}, "tier": "top"}):
        with pytest.raises(ValueError):
            remedies.remedy_table(table, [bad])
    clash = [remedies.Remedy("k", ("a",), "WARN", "values", "", "drop_cols", {"names": [n]}, "t") for n in ("x", "y")]
    with pytest.raises(ValueError):
        remedies.assemble(clash)
    monkeypatch.setenv("SONDAGE_TEST_NAME", "x")
    hidden = remedies.remedy_table(table, [{"key": "drop/hidden", "fn": "drop_cols", "args": {"names": remedies.secret("SONDAGE_TEST_NAME")}}])
    done = remedies.apply(table, hidden, "drop/hidden", "told apart", recheck=False)
    assert "x" not in done.df.columns and '"x"' not in done.log[0]["change"]


def test_findings_without_a_change(spark):
    df = spark.createDataFrame([(f"u{i // 4}", float(i // 4 % 5)) for i in range(40)], "who string, age double")
    check = remedies.check_frame(df)
    assert [c.key for c in check.candidates if c.by_hand] == ["group_by/age,who"]
