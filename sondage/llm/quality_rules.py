"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements
and one bit per rule that the document fails; a *policy* is a versioned choice
of rules, applied by one ``AND`` with the ledger, so a changed policy needs no
second pass over texts, and an ablation is a bitwise aggregation of masks.

All of it is DataFrame expressions. Defined results: a null or blank text has
no words and fails ``few_words``; null ids and repeated rows are judged row by
row and pass through; an empty table gives an empty ledger; columns other than
the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.llm.common import BLANK, text_of, words_of


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over the measurements. The bit never changes once given."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "n_lines >= 10 and 100 * n_dup_lines > 50 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 15 * n_words"),
    Rule(6, "capitals", "100 * n_upper > 40 * word_chars"),
)
BASE = ("few_words", "repeated_words")
#: Policies by version: the names of the rules that a document must pass.
POLICIES = {
    1: BASE,
    2: ("few_words", "repeated_words", "symbols", "repeated_lines", "short_words", "long_words", "capitals"),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper")


def mask_of(names: Iterable[str], rules: Iterable[Rule] = RULES) -> int:
    bits = {r.name: r.bit for r in rules}
    return sum(1 << bits[n] for n in names)


def _windows(words: Column, n: Column) -> Column:
    """(hash, position) of each window of three words. The 64-bit hash stands for
    the three words within one document; no two documents are compared."""
    return F.transform(
        F.slice(words, 1, F.greatest(n - 2, F.lit(0))),
        lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("p")),
    )


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``MEASURES`` of each row. Each step is a projection that the next
    one reads more than once, so no array is built twice."""
    text = text_of(text_col)
    split = df.select(
        F.col(id_col).alias("doc_id"),
        words_of(text).alias("words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{BLANK[1:]}")).alias("lines"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
    )
    n = F.size("words")
    ordered = split.select(
        "doc_id", "n_symbols", "n_upper",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(_windows(F.col("words"), n)).alias("win"),
    )
    k = F.greatest(F.size("win") - 1, F.lit(0))
    none = F.array().cast("array<int>")
    starts = F.flatten(
        F.zip_with(
            F.slice("win", 1, k), F.slice("win", 2, k),
            lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])).otherwise(none),
        )
    )
    covered = F.flatten(F.transform(F.array_distinct(starts), lambda p: F.array(p, p + 1, p + 2)))
    return ordered.withColumn("n_repeat_words", F.size(F.array_distinct(covered)).cast("long")).select("doc_id", *MEASURES)


def ledger(df: DataFrame, rules: Iterable[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``measure`` and ``failed``: the bits of the rules that the row fails."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in rules]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measure(df, id_col, text_col).withColumn("failed", failed)


def apply_policy(book: DataFrame, version: int, rules: Iterable[Rule] = RULES) -> DataFrame:
    """The ledger with ``kept``: no rule of that policy is failed."""
    return book.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask_of(POLICIES[version], rules))) == 0)


def ablation(book: DataFrame, version: int, rules: Iterable[Rule] = RULES) -> DataFrame:
    """For each rule of a policy: how many rows fail it, and how many it alone
    removes (they would be kept without it). Rows are first counted by mask, of
    which there are at most two to the number of rules."""
    names, policy = POLICIES[version], mask_of(POLICIES[version], rules)
    bits = {r.name: 1 << r.bit for r in rules}
    within = F.col("failed").bitwiseAND(F.lit(policy))
    masks = book.groupBy(within.alias("mask")).agg(F.count("*").alias("n"))
    n = F.col("n")
    each = F.explode(F.array(*[
        F.struct(
            F.lit(name).alias("rule"),
            F.when(F.col("mask").bitwiseAND(F.lit(bits[name])) != 0, n).otherwise(0).alias("fails"),
            F.when(F.col("mask") == bits[name], n).otherwise(0).alias("alone"),
        )
        for name in names
    ]))
    return masks.select(each.alias("x")).groupBy("x.rule").agg(F.sum("x.fails").alias("n_fail"), F.sum("x.alone").alias("n_only"))
