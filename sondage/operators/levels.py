"""Declared levels of categories: which values a column may have, and in which order.

They are metadata of the column's field, so they stay with it through ``select``, joins,
filters and Parquet, and cost nothing. What is declared beats what occurs: unused levels
are counted, an ordered column's ends are its declared ones, and the first level is the
reference of comparisons."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Levels:
    values: tuple[str, ...]
    ordered: bool


def declare(df: DataFrame, col: str, levels: Sequence[str], ordered: bool = False) -> DataFrame:
    """``col`` with its levels declared. A value that is no level becomes missing."""
    if not isinstance(df.schema[col].dataType, T.StringType):
        raise ValueError(f"{col} isn't text")
    if len(set(levels)) < len(levels) or not levels or any(v is None for v in levels):
        raise ValueError("levels are not missing and stand once")
    kept = df.withColumn(col, F.when(F.col(col).isin(list(levels)), F.col(col)))
    return kept.withMetadata(col, {**df.schema[col].metadata, "levels": list(levels), "ordered": ordered})


def undeclare(df: DataFrame, col: str) -> DataFrame:
    return df.withMetadata(col, {k: v for k, v in df.schema[col].metadata.items() if k not in ("levels", "ordered")})


def declared(df: DataFrame, col: str) -> Levels | None:
    found = df.schema[col].metadata
    return Levels(tuple(found["levels"]), bool(found.get("ordered"))) if "levels" in found else None


def first_present(df: DataFrame, col: str, present: Sequence[object]) -> object:
    """The first declared level that occurs; without levels the least value."""
    known = declared(df, col)
    there = [v for v in (known.values if known else ()) if v in set(present)]
    return there[0] if there else min(present)
