"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

A text's shingles are XXH64 hashes of five ASCII-lowered words in a row (of all
words, if there are fewer). Equal texts after that are one node. Candidates are, first,
the links of op6: SimHash fingerprints (of the different shingles) that differ in two
bits at most, found by its groupings and trie join. At similarity 0.8 two fingerprints
of 64 bits are 9 to 10 bits apart on average, beyond what blocks of equal bits can bring
together, so candidates also meet by MinHash: ``BANDS`` keys of ``DEEP`` minima each, so
that a pair of similarity 0.8 shares no key with probability (1 - 0.8^DEEP)^BANDS, which
is below 1e-6, and a more similar pair with less. Each bucket is one star, and the
components of links and stars are clusters; the shingles of a cluster's nodes meet in one task, and there the
links are those of a similarity join of all of them: its prefix filter takes shingles
from the rarest on, so texts that share much but not enough (headers, licences,
navigation) meet nobody. Pairs are not listed, so rows stay in proportion to the nodes;
the task of a cluster grows with the cluster.

Defined results: null and blank texts are one node; texts of fewer than five words
are near only if equal; rows with a null id get a component, whose id is null if no
member has one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.llm.common import LOWER_BYTES, text_of, whole_keys
from sondage.llm.components import components
from sondage.llm.simhash import links, majority
from sondage.plans.shared import materialize

SHINGLE, SEED = 5, 42
BANDS, DEEP = 48, 6
#: Tasks in which the rows of one group meet its id.
SPREAD = 16
#: Pairs that aren't similar and are remembered as such.
JUDGED = 1 << 20
_RNG = np.random.default_rng(SEED)
_MUL = _RNG.integers(0, 2**64, BANDS * DEEP, np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 2**64, BANDS * DEEP, np.uint64)


def shingles(text: str | None) -> tuple[int, np.ndarray]:
    """The signed hash of the lowered words, and the sorted hashes of the different shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    ends = list(accumulate(len(w) + 1 for w in words))
    if len(words) <= SHINGLE:
        h = digest(joined, SEED) if words else b""
    else:
        h = b"".join([digest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[SHINGLE - 1 :])])  # noqa: B905
    node = int(np.frombuffer(digest(joined, SEED + 1), np.int64)[0])
    return node, np.unique(np.frombuffer(h, np.uint64))


def band_keys(found: np.ndarray) -> list[int]:
    """A signed hash of each band of minima; none without shingles."""
    if not len(found):
        return []
    least = np.full(BANDS * DEEP, 2**64 - 1, np.uint64)
    for at in range(0, len(found), 512):
        np.minimum(least, (found[at : at + 512, None] * _MUL + _ADD).min(0), out=least)
    data = least.tobytes()
    n = 8 * DEEP
    return np.frombuffer(b"".join([xxhash.xxh64_digest(data[i * n : i * n + n], i) for i in range(BANDS)]), np.int64).tolist()


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        nodes, prints, keys = [], [], []
        for t in b["text"].to_pylist():
            node, found = shingles(t)
            nodes.append(node)
            prints.append(majority(found.view(np.uint8)))
            keys.append(band_keys(found))
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["tid"], pa.array(nodes, pa.int64()), pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "tid", "node", "print", "keys"])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingles have a Jaccard similarity of 0.8 or more."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def linked(sets: list[np.ndarray]) -> list[int]:
    """For each set the first one of its component, over all pairs that are similar.

    Shingles are ordered from the rarest here. Two similar sets share one among the first
    fifth (and one more) of either, and from there on each must have 4/9 of both sizes
    left, so a set meets only those of sizes that what is left of it allows. What very
    many texts have in common stands at the end, where it brings nobody together."""
    n, sizes = len(sets), np.array([len(x) for x in sets], np.int64)
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    owner = np.repeat(np.arange(n), sizes)
    _, token, held = np.unique(np.concatenate(sets) if n else np.empty(0, np.uint64), return_inverse=True, return_counts=True)
    order = np.lexsort((token, held[token], owner))
    owner, token = owner[order], token[order]
    pos = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    size = sizes[owner]
    # the largest partner that what is left allows
    most = 9 * (size - pos) // 4 - size
    early = (pos < size - (4 * size + 4) // 5 + 1) & (held[token] > 1) & (5 * most >= 4 * size)
    owner, token, size, most = owner[early], token[early], size[early], most[early]
    order = np.lexsort((size, token, held[token]))
    owner, token, size, most = owner[order], token[order], size[order], most[order]
    edge = np.flatnonzero(np.r_[True, token[1:] != token[:-1], True]) if len(token) else np.zeros(1, np.int64)
    judged: set[int] = set()
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if hi - lo < 2:
            continue
        s, top = size[lo:hi], most[lo:hi]
        # by size, each with the smaller ones and those of its own size before it
        first = np.searchsorted(s, -(-4 * s // 5), "left")
        last = np.minimum(np.arange(hi - lo), np.searchsorted(s, top, "right"))
        nodes = owner[lo:hi].tolist()
        # components as they stand; those that meet in this bucket are renamed in it
        label = np.array([root(x) for x in nodes])
        if (label == label[0]).all():
            continue
        for i in np.flatnonzero(first < last).tolist():
            x, at = nodes[i], int(first[i])
            while len(near := np.flatnonzero((top[at : last[i]] >= s[i]) & (label[at : last[i]] != label[i]))):
                for j in (near + at).tolist():
                    at, y = j + 1, nodes[j]
                    pair = min(x, y) << 32 | max(x, y)
                    if pair in judged:
                        continue
                    if similar(sets[x], sets[y]):
                        a, b = sorted((int(label[i]), int(label[j])))
                        up[b] = a
                        label[label == b] = a
                        break
                    if len(judged) >= JUDGED:
                        judged.clear()
                    judged.add(pair)
                else:
                    break
    return [root(x) for x in range(n)]


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by cluster."""
    for t in whole_keys(batches, "cluster", 512):
        cluster, node, texts = t["cluster"].to_numpy(), t["node"].to_numpy(), t["text"]
        edge = np.flatnonzero(np.r_[True, cluster[1:] != cluster[:-1], True])
        top = np.empty_like(node)
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            first = linked([shingles(texts[i].as_py())[1] for i in range(lo, hi)])
            top[lo:hi] = node[lo:hi][first]
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(top)], ["node", "top"])


def print_links(nodes: DataFrame) -> DataFrame:
    """From (node, print) the links (u, v) of nodes whose fingerprints differ in two bits
    at most: a fingerprint's nodes are a star, and its first node stands for it in the join."""
    heads = materialize(nodes.groupBy("print").agg(F.min("node").alias("head")), "near-prints")
    stars = nodes.join(heads, "print").where("node <> head").select(F.col("head").alias("u"), F.col("node").alias("v"))
    near = links(heads.select("print"))
    for end in ("u", "v"):
        near = near.join(heads.select(F.col("print").alias(end), F.col("head").alias(f"{end}_head")), end)
    return stars.unionByName(near.select(F.col("u_head").alias("u"), F.col("v_head").alias("v")))


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tid, root, component_id) of each row, ``tid`` being the xxhash64 of its text."""
    text = text_of(text_col)
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tid"))
    rows = materialize(texts.mapInArrow(_sketches, "doc_id long, tid long, node long, print long, keys array<long>"), "near-sketches")
    nodes = materialize(rows.groupBy("node").agg(F.min_by(F.struct("tid", "print", "keys"), "tid").alias("x")).select("node", "x.*"), "near-nodes")
    buckets = nodes.select("node", F.explode("keys").alias("key"))
    stars = buckets.groupBy("key").agg(F.min("node").alias("u"), F.count("*").alias("n")).where("n > 1")
    met = buckets.join(stars, "key").where("u <> node").select("u", F.col("node").alias("v"))
    clusters = components(print_links(nodes.select("node", "print")).unionByName(met))
    held = materialize(nodes.join(clusters, "node").select(F.col("root").alias("cluster"), "node", "tid"), "near-clusters")
    first = texts.join(held.select("tid"), "tid", "left_semi").groupBy("tid").agg(F.min("text").alias("text"))
    judged = held.join(first, "tid").select("cluster", "node", "text").repartition("cluster").sortWithinPartitions("cluster", "node")
    tops = materialize(judged.mapInArrow(_judge, "node long, top long"), "near-tops")
    named = materialize(rows.select("doc_id", "tid", "node").join(tops, "node", "left").select("doc_id", "tid", F.coalesce("top", "node").alias("root")), "near-named")
    # a group of very many copies meets its id in ``SPREAD`` tasks; a row alone needs no join
    ids = named.groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    ids = ids.select("root", "least", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("part"))
    parts = named.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SPREAD)).cast("int"))
    both = parts.join(ids, ["root", "part"], "left")
    return both.select("doc_id", "tid", "root", F.coalesce("least", "doc_id").alias("component_id"))
