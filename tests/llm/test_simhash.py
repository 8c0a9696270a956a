import re

import numpy as np
import xxhash

from sondage.llm import simhash
from tests.llm import frames


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute(rows):
    fp = [brute_print(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(fp[i] ^ fp[j]).count("1") <= 2:
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d if d is not None else -1, f"{fp[i]:016x}", least.get(root(i), -1)) for i, (d, _) in enumerate(rows))


def got(df):
    return sorted((r[0] if r[0] is not None else -1, r[1], r[2] if r[2] is not None else -1) for r in simhash.near_duplicates(df).collect())


def test_awkward_rows(spark):
    df = frames.awkward(spark)
    assert got(df) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert got(df) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_empty(spark):
    assert simhash.near_duplicates(frames.empty(spark)).count() == 0


def test_links_of_chains_and_stars(spark):
    """Planted prints: chains of two flips, whole neighbourhoods, and far ones."""
    rng = np.random.default_rng(1)
    vals = set()
    for c in rng.integers(0, 2**64, 20, dtype=np.uint64).tolist():
        vals |= {c} | {c ^ (1 << i) for i in range(64)}
        x = c
        for _ in range(6):
            a, b = rng.choice(64, 2, replace=False).tolist()
            x ^= (1 << a) | (1 << b)
            vals.add(x)
    vals = sorted(vals)
    signed = [v - (1 << 64) if v >> 63 else v for v in vals]
    df = spark.createDataFrame([(v,) for v in signed], "print long")
    found = [tuple(sorted((r.u, r.v))) for r in simhash.links(df).collect()]
    assert len(found) == len(set(found))
    arr = np.array(vals, np.uint64)
    want = {tuple(sorted((signed[i], signed[j]))) for i in range(len(arr)) for j in np.flatnonzero(np.bitwise_count(arr[i] ^ arr[:i]) <= 2)}
    assert set(found) == want
