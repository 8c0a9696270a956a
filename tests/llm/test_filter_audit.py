import random
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from sondage.llm import filter_audit as a
from tests.llm import frames


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    text = text or ""
    return (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text)))


def bits(text):
    return sum(1 << i for i, f in enumerate(fails(text)) if f)


def brute(rows, labels):
    """Applies every order to the rows themselves."""
    failed = []
    for doc, text, part in rows:
        copy = doc is not None and any(d is not None and d < doc and (t or "") == (text or "") for d, t, _ in rows)
        own = [x for x in labels if doc is not None and x[0] == doc]
        failed.append((part or "", dict(zip("ABCDE", (*fails(text), copy), strict=True)), any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = {}
    for part in {f[0] for f in failed}:
        mine = [f for f in failed if f[0] == part]
        share = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [f for f in left if f[1][x]]
                out[part, order, step] = [
                    len(left) - len(gone), len(gone), sum(f[1][x] for f in mine) - len(gone),
                    sum(f[1][x] and sum(f[1].values()) == 1 for f in mine), sum(f[2] for f in gone), sum(f[3] for f in gone),
                ]
                share[x] += len(gone)
                left = [f for f in left if not f[1][x]]
        for (p, order, step), got in out.items():
            if p == part:
                got.append(share[order[step - 1]])
    return out


def check(df, labels):
    rows = [(r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()]
    want = brute(rows, [tuple(x) for x in labels.select("doc_id", "quality", "toxic").collect()])
    got = a.audit(a.mask_counts(a.scan(df), labels)).collect()
    assert len(got) == len(want)
    for r in got:
        assert want[r.part, r.filter_order, r.step] == [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley]


LABEL = "doc_id long, quality int, toxic int, part string"


def test_every_order(spark):
    rng = random.Random(2)
    base = [frames.words(rng, n, v) for n in (3, 55, 80) for v in (20, 4000)]
    texts = [rng.choice(base) + rng.choice(["", "", " CAPITALS" * 9, " a#b", "\n|"]) for _ in range(150)]
    rows = [(rng.choice([i, i, i, 7]), t, rng.choice(["x", "y", None, ""]), "p", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, part string, failed int").repartition(6)
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 3 == 0, "q") for i in range(100) for _ in range(1 + i % 2)] + [(None, 1, True, "q"), (3, None, None, "q")], "doc_id long, quality int, toxic boolean, part string")
    check(df, labels)


def test_awkward_rows(spark):
    labels = spark.createDataFrame([(0, 1, 0, "q"), (0, 0, 1, "q"), (4, 1, None, "q")], LABEL)
    check(frames.awkward(spark), labels)
    assert a.audit(a.mask_counts(a.scan(frames.empty(spark)), labels)).count() == 0
    assert a.audit(a.mask_counts(a.scan(frames.awkward(spark)), labels.limit(0))).count() == 2 * 600


def column(texts):
    return a.buffers(pa.array([t.encode() for t in texts], pa.binary()))


def text(rng, n):
    letters = ["a", "b", "ab", "A", "é", "中", "\U0001f600", " ", " ", "\n", "\t", "\x0b", "\x1c", "#", "w1", "\u00a0"]
    return "".join(rng.choice(letters) for _ in range(n))


@pytest.mark.parametrize("block", [5, 16, 64, 1 << 20])
def test_blocks_of_any_size(monkeypatch, block):
    rng = random.Random(block)
    monkeypatch.setattr(a, "BLOCK", block)
    monkeypatch.setattr(a, "_POWERS", [])
    long = "x" * 200
    texts = ["", text(rng, 900), "", "", *(text(rng, rng.randrange(0, 300)) for _ in range(40)), long, f"{long} {long} {long}x {long}", "", " ".join(["it"] * 60), "", " \n "]
    data, off = column(texts)
    assert a.masks(data, off).tolist() == [bits(t) for t in texts]
    data, off = column(texts[:0])
    assert a.masks(data, off).tolist() == []


def test_a_slice_of_a_column():
    rng = random.Random(9)
    texts = [text(rng, 200) for _ in range(9)]
    data, off = a.buffers(pa.array([t.encode() for t in texts], pa.binary()).slice(3, 4))
    assert a.masks(data, off).tolist() == [bits(t) for t in texts[3:7]]


def test_words_of_one_hash_are_compared(monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["aa", "ab", "ba", "c", "cc"]) for _ in range(70)), " ".join(f"w{i}" for i in range(80)), " ".join(["q"] * 90)]
    monkeypatch.setattr(a, "KEYS", np.zeros(256, np.uint64))
    data, off = column(texts)
    assert a.masks(data, off).tolist() == [bits(t) for t in texts]
