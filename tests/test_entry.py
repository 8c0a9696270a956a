import __spark_entry__ as entry


def test_entry_and_names(spark):
    df = entry.entry(spark)
    assert df.count() == 12 and df.columns[0] == "l_returnflag"
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_outside_imports_the_optional_subpackage():
    import pathlib
    import re

    root = pathlib.Path(entry.__file__).parent
    for p in root.glob("sondage/**/*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"sondage\.llm|from \.*llm", p.read_text()), p
