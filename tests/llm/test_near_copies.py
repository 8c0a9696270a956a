import random
import re
import time

import numpy as np
import pyarrow as pa

import corpus_pipeline
from sondage.llm import near_copies
from tests.llm import frames

SF = "/root/testdata/sf0.01"


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute(rows):
    """The ids that stay, from all pairs of shingle sets."""
    sets = [grams(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and root(i) != root(j):
                both = len(a & b)
                if 5 * both >= 4 * (len(a) + len(b) - both):
                    up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted(least.values())


def stays(spark, df):
    return sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, SF).collect())


def test_whole_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert stays(spark, df) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_copies_near_the_threshold(spark):
    """Copies with ever more words changed, chains, and a group whose members differ from one another."""
    rng = random.Random(3)
    texts = []
    for n in (6, 30, 100, 400):
        for _ in range(12):
            w = frames.words(rng, n, 5000).split()
            texts.append(" ".join(w))
            for share in (0.005, 0.02, 0.03, 0.05):
                v = list(w)
                for i in rng.sample(range(n), max(1, int(n * share))):
                    v[i] = "changed"
                texts.append(" ".join(v))
    w = frames.words(rng, 200, 5000).split()
    for _ in range(150):
        v = list(w)
        for i in rng.sample(range(200), 4):
            v[i] = f"own{rng.random()}"
        texts.append(" ".join(v))
    df = frames.documents(spark, texts)
    assert stays(spark, df) == brute(list(enumerate(texts)))


def test_empty_and_short(spark):
    assert near_copies.near_copies(frames.empty(spark)).count() == 0
    assert stays(spark, frames.documents(spark, ["a b", "A  b", "a b c", None, " ", "a b c d e f", "a b c d e g"])) == [0, 2, 3, 5, 6]


def test_texts_that_share_an_id(spark):
    """A clean text isn't lost with another text of its id, nor for coming after it."""
    rng = random.Random(4)
    a, b, c, d = (frames.words(rng, 80, 5000) for _ in range(4))
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c + " tail"), (3, c), (3, d)]
    df = spark.createDataFrame([(i, t, "en", "src0", len(t), "x", 1, "y", "z") for i, t in rows], frames.DOC)
    got = sorted((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, df, SF).collect())
    assert got == sorted([(1, a), (2, b), (3, c), (3, d)])


def joined(sets):
    """The first of each component, from all pairs."""
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(set(a.tolist()) & set(b.tolist()))
            if 5 * both >= 4 * (len(a) + len(b) - both) and root(i) != root(j):
                up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(x) for x in range(len(sets))]


def test_join_of_sets_as_all_pairs(monkeypatch):
    rng = np.random.default_rng(5)
    for judged in (1 << 20, 3):
        monkeypatch.setattr(near_copies, "JUDGED", judged)
        for _ in range(25):
            base = [rng.choice(4000, rng.integers(1, 60), replace=False) for _ in range(6)]
            sets = []
            for _ in range(60):
                x = set(base[rng.integers(0, 6)].tolist())
                for _ in range(rng.integers(0, 8)):
                    x.discard(int(rng.choice(sorted(x)))) if len(x) > 1 and rng.random() < 0.5 else x.add(int(rng.integers(0, 9000)))
                sets.append(np.unique(np.array(sorted(x), np.uint64)))
            sets += [sets[0], np.empty(0, np.uint64)]
            got = near_copies.linked(sets)
            assert got[:-1] == joined(sets[:-1]) and got[-1] == len(sets) - 1


def test_texts_that_share_much_but_not_enough():
    """No pair of 5,000 texts of similarity 0.69 is judged; their copies are found."""
    rng = np.random.default_rng(6)
    common = np.arange(1, 242, dtype=np.uint64)
    sets = [np.unique(np.r_[common, rng.integers(1 << 20, 1 << 60, 55).astype(np.uint64)]) for _ in range(5000)]
    for i in range(0, 1000, 10):
        sets[i + 1] = np.r_[sets[i][:-3], sets[i][-1:]]
    start = time.perf_counter()
    got = near_copies.linked(sets)
    assert time.perf_counter() - start < 60
    assert got == [i - 1 if i < 1000 and i % 10 == 1 else i for i in range(5000)]


def test_very_many_near_copies_of_one_text():
    """A large component is not compared pair by pair."""
    rng = np.random.default_rng(7)
    base = np.arange(1, 301, dtype=np.uint64)
    sets = []
    for _ in range(6000):
        x = base.copy()
        x[rng.choice(300, 9, replace=False)] = rng.integers(1 << 20, 1 << 60, 9).astype(np.uint64)
        sets.append(np.unique(x))
    start = time.perf_counter()
    assert set(near_copies.linked(sets)) == {0}
    assert time.perf_counter() - start < 30


def test_fingerprints_link_without_minhash(spark, monkeypatch):
    """Fingerprints up to two bits apart bring copies together, even where no MinHash key does."""
    rng = random.Random(11)
    texts = []
    for _ in range(6):
        w = frames.words(rng, 1500, 5000).split()
        for at in (None, 3, 700, 1400):
            texts.append(" ".join(w if at is None else [*w[:at], "changed", *w[at + 1 :]]))
    sketches = near_copies._sketches

    def without_keys(batches):
        for b in sketches(batches):
            yield b.set_column(b.num_columns - 1, "keys", pa.array([[]] * b.num_rows, pa.list_(pa.int64())))

    monkeypatch.setattr(near_copies, "_sketches", without_keys)
    found = [near_copies.shingles(t)[1] for t in texts]
    prints = [near_copies.majority(x.view(np.uint8)) & (1 << 64) - 1 for x in found]
    up = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and near_copies.similar(found[i], found[j]):
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(frames.documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == up and len(set(up)) < len(texts)
