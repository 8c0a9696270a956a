"""Small tables with every awkward row: nulls, blanks, very long texts, repeated rows, clashing extra columns."""

import random

DOC = "doc_id long, text string, lang string, source string, n_chars long, words string, failed int, print string, component_id string"


def words(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


def documents(spark, texts, start=0):
    rows = [(start + i, t, "en", "src0", len(t or ""), "x", 1, "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def awkward(spark):
    rng = random.Random(5)
    a, b = words(rng, 120), words(rng, 90)
    texts = [a, a, a + " tail", b, None, "", " \t\n", "one", "two words", b.upper(), "é" * 300, "x" * 70000, " ".join(["la"] * 9000), "\ud7ff\U0001f600 ok", a + "\n" + b + "\n" + a]
    rows = documents(spark, texts)
    odd = spark.createDataFrame([(None, a, None, None, None, None, None, None, None), (0, a, "en", "src0", 3, "x", 1, "y", "z"), (0, a, "en", "src0", 3, "x", 1, "y", "z")], DOC)
    return rows.unionByName(odd)


def empty(spark):
    return spark.createDataFrame([], DOC)
