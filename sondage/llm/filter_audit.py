"""How filters interact: what each removes, in every order in which they may be applied.

A task scans the bytes of a block of texts in Arrow's own buffer. A table of byte
classes marks blanks, capitals, symbols and the first bytes of code points; running
sums of the marks, read at the rows' offsets, count them. Running sums of keyed bytes
give every word a 64-bit hash, and a document's hashes are sorted: the bytes of
neighbours with one hash are compared, so a distinct word is a distinct word. What
remains of a document is a mask of the filters that it fails.

Copies are found by a 128-bit digest of the whole text: each digest's least id is a
minimum that tasks compute before they shuffle, and rows that hold it are found by
(digest, id), so a text of very many copies is no hot key. Rows are summed by part and
mask, of which there are 32, and every order, step and Shapley share follows from those
sums: a filter is charged n / k of n rows that k filters fail.

Defined results: a null text is empty and a null part is the empty string; a row of
null id is never a copy, as nothing is smaller, and has no labels; rows of one id and
text are no copies of each other; a document with several labels is good, or toxic,
if one says so; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.llm.common import buffers, text_of

#: Filters in the order of their bits.
FILTERS = "ABCDE"
FEW_WORDS, DISTINCT_SHARE, CAPITAL_SHARE = 50, 65, 5
#: Bytes of text that are classed at once.
BLOCK = 1 << 20

BLANK_BYTE, CAPITAL, SYMBOL, FIRST = 1, 2, 4, 8
CLASSES = np.zeros(256, np.uint8)
CLASSES[[9, 10, 11, 12, 13, 32]] |= BLANK_BYTE
CLASSES[65:91] |= CAPITAL
CLASSES[list(b"#$%&*|")] |= SYMBOL
CLASSES[[b for b in range(256) if b >> 6 != 2]] |= FIRST
#: A random odd number for each byte, and the powers of an odd base and of its inverse, by place in a block.
KEYS = np.random.default_rng(42).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: list[np.ndarray] = []


def powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        _POWERS.extend((_powers(BASE, BLOCK + 1), _powers(pow(BASE, -1, 1 << 64), BLOCK + 1)))
    return _POWERS[0], _POWERS[1]


def words(data: np.ndarray, blank: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the words of a block; no word crosses one of ``edges``."""
    inside = np.r_[False, ~blank, False]
    cut = np.zeros(len(data) + 1, bool)
    cut[edges] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    power, inverse = powers()
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(KEYS[data] * power[: len(data)], out=total[1:])
    # by its place in the block divided out, a word has one hash wherever it stands
    return start, end, (total[end] - total[start]) * inverse[start]


def distinct(data: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Different words of each of ``n`` rows. Words of one hash are compared byte by byte."""
    order = np.lexsort((hashes, row))
    row, start, end, hashes = row[order], start[order], end[order], hashes[order]
    same = (row[1:] == row[:-1]) & (hashes[1:] == hashes[:-1])
    pairs = np.flatnonzero(same)
    size = end - start
    wrong = pairs[size[pairs] != size[pairs + 1]]
    pairs = pairs[size[pairs] == size[pairs + 1]]
    # all bytes of the pairs side by side, a bounded number of them at a time
    ends = np.cumsum(size[pairs])
    at = 0
    while at < len(pairs):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, "right")))
        some = pairs[at:to]
        k = size[some]
        within = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        differ = data[np.repeat(start[some], k) + within] != data[np.repeat(start[some + 1], k) + within]
        wrong = np.r_[wrong, some[np.unique(np.repeat(np.arange(len(some)), k)[differ])]]
        at = to
    out = np.bincount(row, minlength=n) - np.bincount(row[1:][same], minlength=n)
    for r in np.unique(row[wrong]).tolist():
        mine = np.flatnonzero(row == r)
        out[r] = len({data[start[i] : end[i]].tobytes() for i in mine.tolist()})
    return out


def masks(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The bits of A to D that each text fails. ``off`` are the rows' offsets in ``data``."""
    n = len(off) - 1
    counts = np.zeros((3, n), np.int64)
    starts, ends, hashes, rows = [], [], [], []
    at, stop = int(off[0]), int(off[-1])
    while at < stop:
        to = min(stop, at + BLOCK)
        part = data[at:to]
        kind = CLASSES[part]
        blank = (kind & BLANK_BYTE) != 0
        if to < stop and not blank[-1] and not np.any(off == to):
            # the block ends before its last word, if that isn't its only one
            seen = np.flatnonzero(blank)
            edge = off[(off > at) & (off < to)]
            last = max(int(seen[-1]) + 1 if len(seen) else 0, int(edge[-1]) - at if len(edge) else 0)
            if last:
                to, part, kind, blank = at + last, part[:last], kind[:last], blank[:last]
        first, last = int(np.searchsorted(off, at, "right")) - 1, int(np.searchsorted(off, to, "left"))
        bounds = np.clip(off[first : last + 1], at, to) - at
        for i, bit in enumerate((CAPITAL, SYMBOL, FIRST)):
            sums = np.r_[0, np.cumsum((kind & bit) != 0)]
            counts[i, first:last] += np.diff(sums[bounds])
        s, e, h = words(part, blank, bounds)
        owner = first + np.searchsorted(bounds, s, "right") - 1
        s, e = s + at, e + at
        if starts and len(s) and ends[-1][-1] == s[0] and rows[-1][-1] == owner[0]:
            # only a word longer than a block reaches into the next
            ends[-1][-1], s, e, h, owner = e[0], s[1:], e[1:], h[1:], owner[1:]
        if len(s):
            starts.append(s), ends.append(e), hashes.append(h), rows.append(owner)  # noqa: B018
        at = to
    s, e, h, row = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((starts, np.int64), (ends, np.int64), (hashes, np.uint64), (rows, np.int64)))
    for i in np.flatnonzero(e - s > BLOCK).tolist():
        # its hash must not depend on where blocks begin
        h[i] = int.from_bytes(hashlib.blake2b(memoryview(data[s[i] : e[i]]), digest_size=8).digest())
    n_words = np.bincount(row, minlength=n)
    n_distinct = distinct(data, row, s, e, h, n)
    capitals, symbols, points = counts
    return (
        (n_words < FEW_WORDS).astype(np.int64)
        | (100 * n_distinct < DISTINCT_SHARE * n_words) << 1
        | (100 * capitals > CAPITAL_SHARE * points) << 2
        | (symbols > 0) << 3
    )


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = buffers(b["bytes"])
        view = memoryview(data)
        digests = [hashlib.blake2b(view[off[i] : off[i + 1]], digest_size=16).digest() for i in range(b.num_rows)]
        found = masks(data, off) if b.num_rows else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["part"], pa.array(digests, pa.binary()), pa.array(found.astype(np.int32))], ["doc_id", "part", "digest", "failed"])


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, digest, failed) of each row: the digest of its text and the bits of
    the filters A to D that it fails."""
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), part.alias("part"), text_of(text_col).cast("binary").alias("bytes"))
    return rows.mapInArrow(_scan, "doc_id long, part string, digest binary, failed int")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with ``good`` and ``toxic``, from the labels of its ids."""
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality").cast("int") == 1).cast("int")).alias("good"), F.max((F.col("toxic").cast("int") == 1).cast("int")).alias("toxic"))
    none = F.lit(0)
    with_id = rows.where("doc_id is not null").join(said, "doc_id", "left")
    with_id = with_id.withColumns({"good": F.coalesce("good", none), "toxic": F.coalesce("toxic", none)})
    return with_id.unionByName(rows.where("doc_id is null").withColumns({"good": none, "toxic": none}))


def mask_counts(scanned: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): rows by the filters that they fail, copies included.

    ``scanned`` is read twice: write it before if its texts are long. Rows are counted
    once with the bit of E and, where they hold the least id of their text, once
    without it and taken off."""
    # rows that agree in everything are one with a count
    rows = scanned.groupBy("doc_id", "part", "digest", "failed").agg(F.count("*").alias("k"))
    least = scanned.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    first = rows.join(least.withColumn("first", F.lit(True)), ["digest", "doc_id"], "left")
    copy = F.when(F.col("doc_id").isNull() | F.coalesce("first", F.lit(False)), 0).otherwise(1 << FILTERS.index("E"))
    counted = labelled(first.select("doc_id", "part", F.col("failed").bitwiseOR(copy).alias("mask"), "k"), labels)
    return counted.groupBy("part", "mask").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("good")).alias("good"), F.sum(F.col("k") * F.col("toxic")).alias("toxic"))


def orders() -> list[dict]:
    """Every order's steps, with the bits of the filters before and the step's own bit."""
    out = []
    for order in map("".join, permutations(FILTERS)):
        before = 0
        for step, f in enumerate(order, 1):
            out.append({"filter_order": order, "step": step, "before": before, "own": 1 << FILTERS.index(f)})
            before |= 1 << FILTERS.index(f)
    return out


def audit(counts: DataFrame) -> DataFrame:
    """One row a part, order and step, from ``mask_counts``: at most 32 sums a part."""
    held = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("m"))
    plan = F.from_json(F.lit(json.dumps(orders())), "array<struct<filter_order:string,step:int,before:int,own:int>>")
    each = held.select("part", "m", F.explode(plan).alias("p")).select("part", "m", "p.*")
    before, own = F.col("before"), F.col("own")

    def total(hit, what: str = "n", share=None) -> Column:
        value = lambda x: x[what] if share is None else share(x)
        return F.aggregate("m", F.lit(0).cast("long"), lambda s, x: s + F.when(hit(x["mask"]), value(x)).otherwise(0))

    def passed(m: Column) -> Column:
        return m.bitwiseAND(before) == 0

    def fails(m: Column) -> Column:
        return m.bitwiseAND(own) != 0

    removed = lambda m: passed(m) & fails(m)
    everyone = math.factorial(len(FILTERS))
    return each.select(
        "part", "filter_order", "step",
        total(lambda m: passed(m) & ~fails(m)).alias("kept"),
        total(removed).alias("removed"),
        total(lambda m: fails(m) & ~passed(m)).alias("redundant"),
        total(lambda m: m == own).alias("unique_fails"),
        total(removed, "good").alias("good_lost"),
        total(removed, "toxic").alias("toxic_lost"),
        # of the orders, one in k has the filter before the others that a row fails
        total(fails, share=lambda x: x["n"] * (F.lit(everyone) / F.bit_count(x["mask"])).cast("long")).alias("shapley"),
    )
