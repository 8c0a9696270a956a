"""SimHash near-duplicates by a binary-trie self-join.

A fingerprint is the bitwise majority of the XXH64 hashes of the text's word
shingles. Equal fingerprints are merged first, so copies cost one node. Two
fingerprints within ``budget`` bits agree on at least two of four 16-bit blocks
(budget 2), so they meet in one of six groupings by two blocks. In each group
the other 32 bits form a binary trie, joined with itself level by level: a pair
of nodes carries the bits in which they differ so far and is dropped once the
error budget is exceeded. No pairs of a group are listed beyond that: a
fingerprint has at most 2,080 neighbours.

Components of the links are found by ``components`` and named by their smallest
doc_id. Defined results: a null or blank text has fingerprint zero and links as
any other; rows with a null id get fingerprints and a component, whose id is
null if no member has one; repeated rows are equal members; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.llm.common import LOWER_BYTES, text_of
from sondage.llm.components import components
from sondage.plans.shared import materialize

SEED, SHINGLE, BUDGET = 42, 3, 2
BLOCKS = 4
#: The two blocks that a grouping holds equal; with two errors at least one grouping fits.
GROUPINGS = tuple(combinations(range(BLOCKS), 2))


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Signed 64-bit value of the fingerprint."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_digest
    if len(words) <= shingle:
        h = digest(joined, seed)
    else:
        h = b"".join([digest(joined[a : b - 1], seed) for a, b in zip([0, *ends], ends[shingle - 1 :])])  # noqa: B905
    return majority(np.frombuffer(h, np.uint8))


def majority(hashes: np.ndarray) -> int:
    """Signed 64-bit value of the bits set in over half of the hashes, given as bytes."""
    bits = hashes.reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(bits), 1 << 16):
        ones += np.unpackbits(bits[at : at + (1 << 16)], axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(bits)).view(">i8")[0])


def _fingerprints(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = [fingerprint(t, shingle, seed) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(prints, pa.int64())], ["doc_id", "print"])

    return run


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, print) of each row."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(_fingerprints(shingle, seed), "doc_id long, print long")


def trie_pairs(group: np.ndarray, rest: np.ndarray, budget: int, most: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of ``rest`` (32-bit, sorted within runs of ``group``) that differ
    in ``budget`` bits at most and lie in one run. A node is a range of the sorted
    array; its children are the halves with the next bit 0 and 1. Node pairs are
    walked in pieces of ``most`` so that memory stays bounded."""
    edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    lo, hi = edge[:-1], edge[1:]
    keep = hi - lo > 1
    z = np.zeros(int(keep.sum()), np.int64)
    work = [(31, lo[keep], hi[keep], lo[keep], hi[keep], z)]
    ones: dict[int, np.ndarray] = {}
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while work:
        bit, al, ah, bl, bh, err = work.pop()
        if len(al) > most:
            work += [(bit, *(x[i : i + most] for x in (al, ah, bl, bh, err))) for i in range(0, len(al), most)]
            continue
        single = (ah - al == 1) & (bh - bl == 1)
        if single.any():
            i, j = al[single], bl[single]
            near = np.bitwise_count(rest[i] ^ rest[j]) <= budget
            found.append((i[near], j[near]))
            al, ah, bl, bh, err = (x[~single] for x in (al, ah, bl, bh, err))
        if not len(al) or bit < 0:
            continue
        if bit not in ones:
            ones[bit] = np.r_[0, np.cumsum((rest >> np.uint32(bit)) & np.uint32(1), dtype=np.int64)]
        c = ones[bit]
        am, bm = ah - (c[ah] - c[al]), bh - (c[bh] - c[bl])
        same = (al == bl) & (ah == bh)
        other = ~same
        sides = [
            (al, am, bl, bm, err, np.ones(len(al), bool)),
            (am, ah, bm, bh, err, np.ones(len(al), bool)),
            (al, am, bm, bh, err + 1, np.ones(len(al), bool)),
            (am, ah, bl, bm, err + 1, other),
        ]
        nxt = []
        for a0, a1, b0, b1, e, ok in sides:
            ok = ok & (a1 > a0) & (b1 > b0) & (e <= budget) & ~((a0 == b0) & (a1 == b1) & (a1 - a0 == 1))
            nxt.append([x[ok] for x in (a0, a1, b0, b1, e)])
        work.append((bit - 1, *(np.concatenate([n[i] for n in nxt]) for i in range(5))))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _block(x: np.ndarray, i: int) -> np.ndarray:
    return (x >> np.uint64(48 - 16 * i)) & np.uint64(0xFFFF)


def _links(budget: int):
    def join(g: np.ndarray, key: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        rest = np.empty(len(g), np.uint32)
        for n, (i, j) in enumerate(GROUPINGS):
            k, m = (x for x in range(BLOCKS) if x not in (i, j))
            at = g == n
            rest[at] = ((_block(prints[at], k) << np.uint64(16)) | _block(prints[at], m)).astype(np.uint32)
        order = np.lexsort((rest, key, g))
        g, key, rest, prints = g[order], key[order], rest[order], prints[order]
        run = np.cumsum(np.r_[True, (g[1:] != g[:-1]) | (key[1:] != key[:-1])])
        i, j = trie_pairs(run, rest, budget)
        x = prints[i] ^ prints[j]
        first = np.ones(len(i), bool)  # a pair that several groupings hold is told by the first alone
        for n, (p, q) in enumerate(GROUPINGS):
            first &= ~((g[i] > n) & (_block(x, p) == 0) & (_block(x, q) == 0))
        i, j = i[first], j[first]
        for s in range(0, max(1, len(i)), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(prints[y[s : s + (1 << 16)]].view(np.int64)) for y in (i, j)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by grouping and key; the last key of a batch waits for the next batch."""
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)]
        for b in batches:
            new = (b["g"].to_numpy().astype(np.int64), b["key"].to_numpy(), b["print"].to_numpy().view(np.uint64))
            held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            if len(held[0]) < 1 << 17:
                continue
            last = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
            if not last.all():
                yield from join(*(x[~last] for x in held))
                held = [x[last] for x in held]
        if len(held[0]):
            yield from join(*held)

    return run


def links(prints: DataFrame, budget: int = BUDGET) -> DataFrame:
    """From distinct ``print`` values, the pairs (u, v) that differ in at most ``budget`` bits."""
    if budget > BLOCKS - 2:
        raise ValueError("the groupings hold for two differing bits at most")
    block = [F.expr(f"shiftrightunsigned(print, {48 - 16 * i}) & 65535") for i in range(BLOCKS)]
    keys = F.array(*[F.struct(F.lit(n).cast("byte").alias("g"), (F.shiftleft(block[i], 16) + block[j]).alias("key")) for n, (i, j) in enumerate(GROUPINGS)])
    rows = prints.select("print", F.explode(keys).alias("x")).select("x.g", "x.key", "print")
    return rows.repartition("g", "key").sortWithinPartitions("g", "key").mapInArrow(_links(budget), "u long, v long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row."""
    prints = materialize(fingerprints(df, id_col, text_col), "simhash")
    nodes = materialize(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    root = components(links(nodes.select("print"), budget))
    named = nodes.join(root.withColumnRenamed("node", "print"), "print", "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    named = materialize(named, "simhash-roots")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    out = prints.join(named.join(ids, "root").select("print", "component_id"), "print")
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
