"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are sequences of words (A-Z lower-cased, outer
punctuation off). Seeds are the windows of ``SEED`` words that a document shares
with an item. Tiling repeats: the longest match not yet marked, found by running
Karp-Rabin hashes from the seeds along their diagonals, is marked in both texts,
until no match of ``SEED`` words is left. Tiles may come in any order, so passages
that were moved about inside the document still cover the item. A document is
contaminated by an item whose words are covered to ``COVERAGE`` or more.

The seeds of the items are sent to every task if there are ``MOST_SEEDS`` at
most, which is checked first; beyond that documents and items meet in a shuffle
join on seeds instead, with the same result.

Defined results: null texts and items of fewer than ``SEED`` words match nothing;
null ids pass through; repeated documents return rows each, and rows that agree
in item_id and words are one item; empty tables give an empty result; other
columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.llm.common import LOWER_BYTES, buffers, text_of
from sondage.plans.shared import materialize

SEED, COVERAGE = 5, 0.8
MOST_SEEDS = 1_000_000
#: Bytes of text that are split into words at once, and words that a task remembers.
PIECE, REMEMBERED = 1 << 20, 1 << 17
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
BLANKS = b" \t\n\x0b\x0c\r"
_M = np.uint64(0x9E3779B97F4A7C15)


class WordIds(dict):
    """64-bit numbers of words, zero for punctuation alone; the memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        bare = word.strip(PUNCTUATION)
        self[word] = n = (xxhash.xxh64_intdigest(bare) >> 1 | 1) if bare else 0
        return n


def word_ids(text: bytes, known: WordIds) -> np.ndarray:
    found, at = [], 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and text[end] not in BLANKS:
            end += 1
        words = text[at:end].translate(LOWER_BYTES).split()
        ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        found.append(ids[ids != 0])
        at = end
    return np.concatenate(found) if found else np.empty(0, np.int64)


def seeds_of(ids: np.ndarray, length: int = SEED) -> np.ndarray:
    """The hash of each window of ``length`` words."""
    n = len(ids) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    u = ids.view(np.uint64)
    h = u[:n].copy()
    for i in range(1, length):
        h *= _M
        h += u[i : i + n]
    h ^= h >> np.uint64(31)
    h *= _M
    return h


Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


def runs_of(at_item: np.ndarray, at_doc: np.ndarray, length: np.ndarray | None = None) -> Runs:
    """Seeds (or runs of them) of one item that follow each other along a diagonal, as
    runs: start in the item, start in the document, number of seeds."""
    length = np.ones(len(at_item), np.int64) if length is None else length
    order = np.lexsort((at_item, at_doc - at_item))
    i, j, n = at_item[order], at_doc[order], length[order]
    if not len(i):
        return i, j, n
    first = np.flatnonzero(np.r_[True, (np.diff(j - i) != 0) | (i[1:] != i[:-1] + n[:-1])])
    return i[first], j[first], np.add.reduceat(n, first)


def tile(item: np.ndarray, doc: np.ndarray, at_item: np.ndarray, at_doc: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in item, start in document, length) from the seeds at
    which item and document agree: longest first, then leftmost in the item, then
    leftmost in the document."""
    span = np.arange(least)
    real = (item[at_item[:, None] + span] == doc[at_doc[:, None] + span]).all(1)
    return tile_runs(len(item), runs_of(at_item[real], at_doc[real]), least)


def tile_runs(size: int, runs: Runs, least: int = SEED) -> list[tuple[int, int, int]]:
    """``tile`` from the runs of seeds, for an item of ``size`` words."""
    i, j, seeds = runs
    heap = [(-int(n), int(a), int(b)) for n, a, b in zip(seeds + least - 1, i, j, strict=True)]
    heapq.heapify(heap)
    free_item, marked, tiles = np.ones(size, bool), set(), []
    while heap:
        n, a, b = heapq.heappop(heap)
        n = -n
        free = free_item[a : a + n].copy()
        if marked:
            free &= np.fromiter((k not in marked for k in range(b, b + n)), bool, n)
        if free.all():
            tiles.append((a, b, n))
            free_item[a : a + n] = False
            marked.update(range(b, b + n))
            continue
        edge = np.flatnonzero(np.diff(np.r_[0, free.astype(np.int8), 0]))
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if e - s >= least:
                heapq.heappush(heap, (s - e, a + s, b + s))
    return tiles


class Items:
    """Benchmark items by seed."""

    def __init__(self, rows: list[tuple[int | None, np.ndarray]]) -> None:
        self.ids, self.words = [r[0] for r in rows], [r[1] for r in rows]
        seeds = [seeds_of(w) for w in self.words]
        h = np.concatenate(seeds) if seeds else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
        pos = np.concatenate([np.arange(len(s)) for s in seeds]) if seeds else item
        order = np.argsort(h, kind="stable")
        self.h, self.item, self.pos = h[order], item[order], pos[order]
        self.near = np.zeros(1 << 20, bool)
        self.near[(self.h >> np.uint64(44)).astype(np.int64)] = True

    def matches(self, words: np.ndarray, coverage: float) -> Iterator[tuple[int | None, float, int, int]]:
        """(item_id, coverage, tiles, longest) of each item covered enough."""
        h = seeds_of(words)
        at = np.flatnonzero(self.near[(h >> np.uint64(44)).astype(np.int64)])
        lo, hi = np.searchsorted(self.h, h[at], "left"), np.searchsorted(self.h, h[at], "right")
        hit = hi > lo
        at, lo, n = at[hit], lo[hit], (hi - lo)[hit]
        if not len(at):
            return
        found: dict[int, list[Runs]] = {}
        upto, span, first = np.cumsum(n), np.arange(SEED), 0
        while first < len(at):
            # so many seeds at once; runs along a diagonal go on from one stretch to the next
            last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + STRETCH, "right")))
            m = n[first:last]
            k = np.repeat(lo[first:last], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            item, pos, place = self.item[k], self.pos[k], np.repeat(at[first:last], m)
            order = np.argsort(item, kind="stable")
            item, pos, place = item[order], pos[order], place[order]
            edge = np.r_[np.flatnonzero(np.r_[True, item[1:] != item[:-1]]), len(item)]
            for s, e in zip(edge[:-1], edge[1:], strict=True):
                own = self.words[item[s]]
                real = (own[pos[s:e, None] + span] == words[place[s:e, None] + span]).all(1)
                found.setdefault(int(item[s]), []).append(runs_of(pos[s:e][real], place[s:e][real]))
            first = last
        for item, parts in sorted(found.items()):
            runs = parts[0] if len(parts) == 1 else runs_of(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            if got := covered(len(self.words[item]), runs, coverage):
                yield (self.ids[item], *got)


#: Seeds of a document that are listed with their items at once.
STRETCH = 1 << 18


def covered(size: int, runs: Runs, coverage: float) -> tuple[float, int, int] | None:
    """Coverage, tiles and longest tile, if an item of ``size`` words is covered enough.
    Tiles lie within runs, so runs that cover too little end it before tiling."""
    i, _, seeds = runs
    reach = np.zeros(size + 1, np.int64)
    np.add.at(reach, i, 1)
    np.add.at(reach, i + seeds + SEED - 1, -1)
    if np.count_nonzero(np.cumsum(reach)) < coverage * size:
        return None
    tiles = tile_runs(size, runs)
    words = sum(t[2] for t in tiles)
    if words < coverage * size:
        return None
    return words / size, len(tiles), max(t[2] for t in tiles)


FOUND = "doc_id long, item_id long, coverage double, n_tiles long, longest long"


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_id", "item_id", "coverage", "n_tiles", "longest"])


def _scan(items: Items, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordIds()
        for b in batches:
            data, off = buffers(b["bytes"])
            rows = [(i, *m) for i in range(len(off) - 1) for m in items.matches(word_ids(data[off[i] : off[i + 1]].tobytes(), known), coverage)]
            ids = b["doc_id"]
            yield _found([(ids[r[0]].as_py(), *r[1:]) for r in rows])

    return run


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordIds()
    for b in batches:
        data, off = buffers(b["bytes"])
        words = [word_ids(data[off[i] : off[i + 1]].tobytes(), known) for i in range(len(off) - 1)]
        seeds = [seeds_of(w).view(np.int64) for w in words]
        cols = [b[c] for c in b.schema.names if c != "bytes"]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(words, pa.list_(pa.int64())), pa.array(seeds, pa.list_(pa.int64()))], [*(c for c in b.schema.names if c != "bytes"), "words", "seeds"])


def _pairs(coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, item_id, item, doc in zip(b["doc_id"].to_pylist(), b["item_id"].to_pylist(), b["item_words"], b["words"], strict=True):
                one = Items([(item_id, np.asarray(item.values))])
                rows += [(doc_id, *m) for m in one.matches(np.asarray(doc.values), coverage)]
            yield _found(rows)

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE, most_seeds: int = MOST_SEEDS) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest) of each contaminated document and the item found in it."""
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("bytes"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of("text").cast("binary").alias("bytes"))
    items = materialize(items.mapInArrow(_words, "item_id long, words array<long>, seeds array<long>").where(F.size("seeds") > 0).distinct(), "benchmark-items")
    if (items.agg(F.sum(F.size("seeds"))).first()[0] or 0) <= most_seeds:
        rows = [(r.item_id, np.array(r.words, np.int64)) for r in items.select("item_id", "words").collect()]
        return given.mapInArrow(_scan(Items(rows), coverage), FOUND)
    item = items.select("item_id", F.col("words").alias("item_words"), F.xxhash64("item_id", "words").alias("item_key"), "seeds")
    words = materialize(given.mapInArrow(_words, "doc_id long, words array<long>, seeds array<long>").withColumn("key", F.expr("uuid()")), "document-words")
    seeded = words.select("key", F.explode(F.array_distinct("seeds")).alias("seed"))
    wanted = item.select("item_key", F.size("item_words").alias("n"), F.explode("seeds").alias("seed"))
    shared = seeded.join(wanted, "seed").groupBy("key", "item_key", "n").agg(F.count("*").alias("hits"))
    # every word of a tile lies in a seed, and each place of a seed covers SEED words
    pairs = shared.where(F.col("hits") * SEED >= F.lit(coverage) * F.col("n")).select("key", "item_key")
    both = pairs.join(item.select("item_key", "item_id", "item_words"), "item_key").join(words.select("key", "doc_id", "words"), "key")
    return both.select("doc_id", "item_id", "item_words", "words").mapInArrow(_pairs(coverage), FOUND)


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The documents that no item contaminates, all columns kept. A row goes if
    its id and text agree with a contaminated one's."""
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(F.col("doc_id"), text_of("text")).alias("key"), F.col("text"))
    bad = contaminated(rows, benchmark, id_col="key", coverage=coverage).select(F.col("doc_id").alias("key")).distinct()
    stays = rows.drop("text").join(materialize(bad, "contaminated"), "key", "left_anti")
    return stays.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
