import random
import re

import numpy as np

from sondage.llm import decontaminate as d
from tests.llm import frames

ITEM = "item_id long, text string, words string, seeds int"


def plain(text):
    w = [x.strip("".join(map(chr, d.PUNCTUATION))) for x in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    return [x for x in w if x]


def tiling(a, b, least):
    """Greedy string tiling by comparing every two places, again after each tile."""
    free_a, free_b, tiles = [True] * len(a), [True] * len(b), []
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return tiles
        i, j, n = best
        free_a[i : i + n] = [False] * n
        free_b[j : j + n] = [False] * n
        tiles.append(best)


def brute(docs, items, coverage=d.COVERAGE):
    out = set()
    for doc_id, t in docs:
        for item_id, it in items:
            a, b = plain(it), plain(t)
            if len(a) >= d.SEED:
                tiles = tiling(a, b, d.SEED)
                n = sum(x[2] for x in tiles)
                if n >= coverage * len(a) and n:
                    out.add((doc_id, item_id, round(n / len(a), 9), len(tiles), max(x[2] for x in tiles)))
    return out


def got(docs, items, **k):
    rows = [(r.doc_id, r.item_id, round(r.coverage, 9), r.n_tiles, r.longest) for r in d.contaminated(docs, items, **k).collect()]
    return set(rows), len(rows)


def test_tiles_against_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(5, 25))] for _ in range(2))
        known = d.WordIds()
        x, y = (d.word_ids(" ".join(t).encode(), known) for t in (a, b))
        h, g = d.seeds_of(x), d.seeds_of(y)
        i, j = np.nonzero(h[:, None] == g[None, :])
        assert d.tile(x, y, i, j) == tiling(a, b, d.SEED)


def test_reordered_and_partial_passages(spark):
    rng = random.Random(2)
    items = [(i, frames.words(rng, 30, 5000)) for i in range(8)] + [(50, "too short it is"), (51, None), (None, frames.words(rng, 12, 5000)), (0, frames.words(rng, 20, 5000))]
    docs = []
    for i in range(60):
        w = (items[i % 8][1]).split()
        k = rng.randrange(6, 24)
        half = [w[k:], w[:k]] if i % 2 else [w[: 30 - i // 3]]
        pad = lambda: frames.words(rng, rng.randrange(30), 5000)
        docs.append((i, " ".join([pad(), " ".join(half[0]).upper() + ".", pad(), " ".join(half[-1]), pad()])))
    docs += [(100, None), (101, ""), (None, items[10][1]), (102, items[1][1]), (102, items[1][1])]
    df = spark.createDataFrame([(*r, "en", "s", 1, "x", 1, "y", "z") for r in docs], frames.DOC)
    bench = spark.createDataFrame([(*r, "w", 1) for r in items], ITEM)
    want = brute(docs, items)
    assert got(df, bench) == (want, len(want) + 1)
    assert got(df, bench, most_seeds=0) == (want, len(want) + 1)
    clean = {r.doc_id for r in d.clean(df, bench).collect()}
    assert clean == {x for x, _ in docs} - {x[0] for x in want}


def test_awkward_rows(spark):
    df, bench = frames.awkward(spark), spark.createDataFrame([(1, "la la la la la la la la", "w", 1), (2, "x " * 9, "w", 1)], ITEM)
    assert {r.doc_id for r in d.contaminated(df, bench).collect()} == {12}
    assert d.contaminated(frames.empty(spark), bench).count() == 0
    assert d.contaminated(df, bench.limit(0)).count() == 0
    assert d.clean(df, bench).columns == df.columns
    assert d.clean(df, bench).count() == df.count() - 1


def test_planted_leaks(spark):
    sf = "/root/testdata/sf0.1"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in d.contaminated(docs, bench).collect()}
    squash = lambda t: " ".join(t.split())
    items = [(r.item_id, squash(r.text)) for r in bench.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for t in [squash(r.text)] for i, x in items if x in t}
    assert want and want <= found and len(found) <= len(want) * 1.02


def test_repetitive_texts_in_bounded_memory():
    """Equal words meet an item of equal words at every place; stretches of seeds give one pass's result."""
    import tracemalloc

    known = d.WordIds()
    rng = random.Random(9)
    items = d.Items([(1, d.word_ids(b"la " * 60, known)), (2, d.word_ids(" ".join(rng.choice("ab") for _ in range(40)).encode(), known))])
    words = d.word_ids(b"la " * 100_000 + " ".join(rng.choice("ab") for _ in range(30_000)).encode(), known)
    tracemalloc.start()
    got = {i: x for i, *x in items.matches(words, 0.0)}
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()
    assert got[1] == [1.0, 1, 60]
    h, g = d.seeds_of(items.words[1]), d.seeds_of(words)
    j = np.flatnonzero(np.isin(g, h))
    k, at = np.nonzero(h[:, None] == g[None, j])
    tiles = d.tile(items.words[1], words, k, j[at])
    assert got[2] == [sum(t[2] for t in tiles) / 40, len(tiles), max(t[2] for t in tiles)]
