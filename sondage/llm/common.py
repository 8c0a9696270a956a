"""What the operators on documents, pages and conversations share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII blanks of ``[\x20\x09-\x0D]``, which is also what ``bytes.split()`` splits at.
BLANK = r"[\x20\x09-\x0D]"
#: A-Z only, in either direction; other letters keep their case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str | Column) -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words_of(text: Column) -> Column:
    """The maximal runs of non-blank characters, in order."""
    return F.filter(F.split(text, BLANK + "+"), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow binary column, and the offsets of its rows in them."""
    if pa.types.is_large_binary(column.type):
        offsets = np.frombuffer(column.buffers()[1], np.int64)
    else:
        offsets = np.frombuffer(column.buffers()[1], np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offsets


def whole_keys(batches: Iterator[pa.RecordBatch], key: str, least: int) -> Iterator[pa.Table]:
    """Rows that come sorted by ``key``, in tables of about ``least`` rows or more
    that never part the rows of one key."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        last = b[key][b.num_rows - 1]
        if size >= least and last != held[-1][key][held[-1].num_rows - 1]:
            # what is held, and the rows of its last key in this batch
            cut = int(np.searchsorted(b[key].to_numpy(), last.as_py(), "left"))
            yield pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks()
            b, held, size = b.slice(cut), [], 0
        held.append(b)
        size += b.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
