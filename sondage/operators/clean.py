"""Names, types, empty rows and columns, recoded values, and a table's fingerprint."""

from __future__ import annotations

import re
import unicodedata
import uuid
import warnings
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondage.operators.select import cols

#: Letters that Unicode does not take apart.
LIGATURES = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ı": "i"}


def snake(names: Sequence[str]) -> list[str]:
    """snake_case names, unique by numbers."""
    out = []
    for name in names:
        s = re.sub(r"['\"]", "", name).replace("%", "_percent_").replace("#", "_number_")
        s = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", s)).lower()
        s = "".join(LIGATURES.get(c, c) for c in s)
        s = re.sub(r"(?<=[a-z])[̀-ͯ]+", "", unicodedata.normalize("NFD", s))
        s = re.sub(r"[^\w]|_", "_", unicodedata.normalize("NFC", s))
        s = re.sub("_+", "_", s).strip("_") or "x"
        out.append("x" + s if s[0].isdigit() else s)
    while len(set(out)) < len(out):
        seen: dict[str, int] = {}
        for i, s in enumerate(out):
            seen[s] = seen.get(s, 0) + 1
            if seen[s] > 1:
                out[i] = f"{s}_{seen[s]}"
    return out


def _blank(c: str, text: bool) -> Column:
    return F.col(c).isNull() | (F.trim(F.regexp_replace(c, r"\s", "")) == "" if text else F.lit(False))


def retype_plan(df: DataFrame, names: Sequence[str]) -> dict[str, str]:
    """boolean, int, double or string for each text column, in one pass: a type fits if every value that isn't blank does."""
    aggs = []
    for i, c in enumerate(names):
        t = F.trim(c)
        there = t.isNotNull() & (t != "")
        number = F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.expr(f"try_cast(trim(`{c}`) AS double)"))
        aggs.append(F.struct(
            F.count_if(there).alias("n"), F.count_if(there & F.lower(t).isin("true", "false", "t", "f")).alias("flag"), F.count_if(there & number.isNotNull()).alias("num"),
            F.count_if(there & (number == F.floor(number)) & (F.abs(number) < 2**31)).alias("whole"),
        ).alias(f"c{i}"))
    row = df.agg(*aggs).first()
    plan = {}
    for i, c in enumerate(names):
        n, flag, num, whole = row[f"c{i}"]
        plan[c] = "string" if n == 0 else "boolean" if flag == n else "int" if whole == n else "double" if num == n else "string"
    return plan


def retype(df: DataFrame, which=None) -> DataFrame:
    names = [c for c in cols(df, which) if dict(df.dtypes)[c] == "string"]
    if not names:
        return df
    text = {c: F.when(F.trim(c) == "", None).otherwise(F.trim(c)) for c in names}
    return df.withColumns({c: text[c] if kind == "string" else text[c].cast("double").cast("int") if kind == "int" else text[c].cast(kind) for c, kind in retype_plan(df, names).items()})


def _kept(df: DataFrame, drop_empty: bool) -> list[str]:
    """The columns that aren't blank throughout."""
    if not drop_empty or not df.columns:
        return df.columns
    types = dict(df.dtypes)
    row = df.agg(*[F.count_if(~_blank(c, types[c] == "string")).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return [c for i, c in enumerate(df.columns) if row[i]]


def wash(df: DataFrame, clean_names: bool = True, retype_text: bool = True, drop_empty: bool = True, names_col: str | None = None) -> DataFrame:
    """Blank columns go, then blank rows; text that is all numbers or flags is retyped;
    names become snake_case. ``names_col`` names the rows: it comes first, as text, is
    neither retyped nor renamed, and a row of nothing else is blank. Equal names stay
    as they are, as rows have no order by which to number them."""
    if names_col is not None:
        if names_col not in df.columns:
            raise ValueError(f"unknown column {names_col!r}")
        key = f"__{uuid.uuid4().hex}"
        rest = [c for c in df.columns if c != names_col]
        label = F.col(names_col).cast("string").alias(key)
        if drop_empty and rest:
            types = dict(df.dtypes)
            df = df.where(reduce(lambda a, b: a | b, [~_blank(c, types[c] == "string") for c in rest]))
        kept = _kept(df.select(*rest), drop_empty)
        out = df.select(label, *kept)
        out = retype(out, kept) if retype_text and kept else out
        return out.toDF(names_col, *(snake(kept) if clean_names else kept))
    types = dict(df.dtypes)
    if drop_empty:
        df = df.select(*_kept(df, drop_empty))
        if df.columns:
            keep = F.lit(False)
            for c in df.columns:
                keep = keep | ~_blank(c, types[c] == "string")
            df = df.where(keep)
    if retype_text:
        df = retype(df) if df.columns else df
    return df.toDF(*snake(df.columns)) if clean_names and df.columns else df


def drop_cols(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*cols(df, list(names)))


def translate(df: DataFrame, col: str, old: Sequence, new: Sequence, default=None, to: str | None = None) -> DataFrame:
    """The column looked up in a dictionary, compared as text; the first of equal
    entries wins, a missing entry gives ``default`` and null stays null."""
    table: dict[str, object] = {}
    for o, n in zip(old, new, strict=True):
        if table.setdefault(str(o), n) != n:
            warnings.warn(f"{o!r} has several translations; the first is taken", stacklevel=2)
    kind = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    value = F.coalesce(kind[F.col(col).cast("string")], F.lit(default))
    return df.withColumn(to or col, F.when(F.col(col).isNotNull(), value))


def translate_by(df: DataFrame, col: str, dictionary: DataFrame, old: str, new: str, default=None, to: str | None = None) -> DataFrame:
    """``translate`` with a dictionary table, as a left join on its smallest new value per old one."""
    d = dictionary.where(F.col(old).isNotNull()).groupBy(F.col(old).cast("string").alias("__old")).agg(F.min(new).alias("__new"))
    out = df.join(d, F.col(col).cast("string") == F.col("__old"), "left")
    value = F.when(F.col(col).isNotNull(), F.coalesce("__new", F.lit(default)))
    return out.withColumn(to or col, value).drop("__old", "__new")


def recode_errors(df: DataFrame, errors: Sequence, replacement=None, rows: Column | None = None, which=None, ind: bool = False) -> DataFrame:
    """Listed codes become ``replacement`` in the chosen rows and columns; ``ind`` adds a flag for each column."""
    hit = F.lit(True) if rows is None else F.coalesce(rows, F.lit(False))
    new = {}
    for c in cols(df, which):
        kind = df.schema[c].dataType
        codes = [F.lit(e).cast(kind) if not isinstance(e, str) else F.lit(e) for e in errors if isinstance(e, str) == (kind.typeName() == "string")]
        if not codes:
            continue
        wrong = hit & F.coalesce(F.col(c).isin(*codes), F.lit(False))
        new[c] = F.when(wrong, F.lit(replacement)).otherwise(F.col(c))
        if ind:
            new[f"{c}_error"] = wrong
    return df.withColumns(new)


def repair_encoding(df: DataFrame, col: str, encoding: str = "windows-1252") -> DataFrame:
    """Binary text as UTF-8; bytes that aren't are read in the single-byte ``encoding``
    if that can be undone, else null. Spark decodes few encodings itself, so the
    characters are put in place of those of ISO 8859-1."""
    table = {chr(b): bytes([b]).decode(encoding, "replace") for b in range(256)}
    moved = {c: to for c, to in table.items() if to not in (c, "\ufffd")}
    none = "".join(f"\\x{{{ord(c):02X}}}" for c, to in table.items() if to == "\ufffd")
    plain = F.decode(F.col(col), "iso-8859-1")
    other = F.translate(plain, "".join(moved), "".join(moved.values()))
    undone = ~plain.rlike(f"[{none}]") if none else F.lit(True)
    valid = F.expr(f"is_valid_utf8(cast(`{col}` AS string))")
    return df.withColumn(col, F.when(valid, F.decode(F.col(col), "UTF-8")).when(undone, other))


def data_id(df: DataFrame, key: Sequence[str] | None = None) -> str:
    """"rows x columns : digest". With ``key`` rows are placed by their order, and
    a moved row changes the digest; without, only the set of rows counts. Places
    come from range partitions, sums are modulo two primes below 2**20."""
    from sondage.plans.shared import materialize

    word = F.xxhash64(F.lit("|".join(f"{n}:{t}" for n, t in df.dtypes)), *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) if t[:3] != "map" else F.to_json(c) for c, t in df.dtypes])
    primes = (1048573, 1048571)
    if key is None:
        row = df.agg(F.count("*"), *[F.sum(F.pmod(word, F.lit(p))).alias(f"p{p}") for p in primes], F.bit_xor(word)).first()
        n, parts = row[0], [(row[1] or 0) % primes[0], (row[2] or 0) % primes[1], (row[3] or 0) & 0xFFFFFFFF]
        return f"{n}x{len(df.columns)}:~" + "".join(f"{x:05x}" for x in parts)
    part = materialize(df.select(*key, word.alias("__w")).repartitionByRange(*key).withColumn("__p", F.spark_partition_id()), "data-id")
    sizes = {r[0]: r[1] for r in part.groupBy("__p").agg(F.count("*")).collect()}
    before, total = {}, 0
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    place = F.row_number().over(Window.partitionBy("__p").orderBy(*key, "__w")) + F.element_at(F.create_map(*[F.lit(x) for kv in (before or {0: 0}).items() for x in kv]), F.col("__p"))
    sums = part.select("__w", place.cast("long").alias("i")).agg(*[F.sum(F.pmod(F.pmod(F.col("__w"), F.lit(p)) * F.pmod(F.col("i"), F.lit(p)), F.lit(p))) for p in primes]).first()
    return f"{total}x{len(df.columns)}:" + "".join(f"{(s or 0) % p:05x}" for s, p in zip(sums, primes, strict=True))
