import hashlib
import random

import numpy as np

from sondage.llm import suffix_dedup as s
from tests.llm import frames


def brute(rows):
    """rows of (order key, doc_id, bytes); equal keys are one document."""
    seen, gone = {}, {}
    for key, _, b in sorted({(k, d, x) for k, d, x in rows}, key=lambda r: r[0]):
        cover = np.zeros(len(b), bool)
        for i in range(len(b) - s.LENGTH + 1):
            w = b[i : i + s.LENGTH]
            if w in seen:
                cover[i : i + s.LENGTH] = True
            seen.setdefault(w, key)
        gone[key] = cover
    out = []
    for key, d, b in rows:
        c = gone[key]
        kept = bytes(np.frombuffer(b, np.uint8)[~c])
        out.append((d if d is not None else -1, len(b), int(c.sum()), int((np.diff(np.r_[0, c.astype(int), 0]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def check(df):
    rows = [((r.doc_id, r.sub), r.given, bytes(r.bytes)) for r in s.keyed(df).collect()]
    got = sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in s.dedup(df).collect())
    assert got == brute(rows)


def test_awkward_rows(spark):
    check(frames.awkward(spark))
    assert s.dedup(frames.empty(spark)).count() == 0


def test_shared_passages_edits_and_periods(spark):
    rng = random.Random(3)
    base = [frames.words(rng, 60, 50) for _ in range(6)]
    texts = []
    for _ in range(120):
        parts = [rng.choice(base) if rng.random() < 0.6 else frames.words(rng, rng.randrange(40), 50) for _ in range(rng.randrange(5))]
        t = list(" ".join(parts))
        for _ in range(rng.randrange(4)):
            if t:
                t[rng.randrange(len(t))] = rng.choice("xyzé")
        texts.append("".join(t))
    texts += ["ab" * 90, "ab" * 200, "a" * 99, "a" * 100, "a" * 101, "abc " * 70 + base[0] + "abc " * 70, "\0" * 300]
    check(frames.documents(spark, texts).repartition(5))


def test_whole_table(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(6))


def test_blind_tries_against_sorting():
    rng = np.random.default_rng(2)
    data = rng.choice(np.array([0, 1, 255], np.uint8), 3000, p=[0.05, 0.9, 0.05])
    for span in (3000, 300):
        data[:] = np.resize(data[:span], 3000)
        start = rng.integers(0, 2900, 4000)
        group = np.sort(rng.integers(0, 3, 4000))
        got = s.repeats(data, start, group)
        seen, want = set(), []
        for a, g in zip(start, group, strict=True):
            k = (g, data[a : a + 100].tobytes())
            want.append(k in seen)
            seen.add(k)
        assert (got == np.array(want)).all()


def test_gram_with_many_surroundings(spark):
    """More slices of one gram than ``MANY``: they are parted, and equal windows still meet."""
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    # a gram that is nearly always the anchor of the windows that hold it
    many = word(400_000)
    _, at, gram, *_ = s.anchors(np.frombuffer(many.encode(), np.uint8), np.array([0, len(many)]))
    low = int(at[np.argmin(gram)])
    hot = many[low : low + s.GRAM]
    shared = [word(30) + hot + word(45) for _ in range(9)]
    texts = [word(rng.randrange(70)) + hot + word(rng.randrange(90)) for _ in range(2 * s.MANY)]
    texts += [word(rng.randrange(50)) + rng.choice(shared) + word(rng.randrange(50)) for _ in range(150)] + [hot * 4, hot * 3 + "x"]
    rng.shuffle(texts)
    df = frames.documents(spark, texts).repartition(3)
    met = s.keyed(df).select("doc_id", "sub", "bytes").mapInArrow(s._scan, s.ROWS).repartition("gram").sortWithinPartitions("gram").mapInArrow(s._by_gram, s.ROWS)
    assert met.where(f"kind = {s.MET} and sides >= {s.PARTED}").count() > s.MANY
    check(df)


def test_long_text_in_stretches():
    rng = np.random.default_rng(7)
    text = rng.integers(97, 101, 2 * s.CHUNK + 5000).astype(np.uint8)
    text[s.CHUNK - 300 : s.CHUNK + 300] = 97
    whole = s.anchors(text, np.array([0, len(text)]))
    got = [[] for _ in range(6)]
    for _, _, lo, hi in s._parts(np.array([0]), np.array([len(text)])):
        near = max(0, lo - s.MARGIN)
        doc, at, *rest = s.anchors(text[near : hi + s.MARGIN], np.array([0, min(len(text), hi + s.MARGIN) - near]))
        keep = (at + near >= lo) & (at + near < hi)
        for out, x in zip(got, (doc[keep], at[keep] + near, *(x[keep] for x in rest)), strict=True):
            out.append(x)
    for a, b in zip(whole, got, strict=True):
        assert np.array_equal(a, np.concatenate(b))


def test_rows_of_a_key_stay_together():
    import pyarrow as pa

    from sondage.llm.common import whole_keys

    rng = np.random.default_rng(1)
    keys = np.sort(np.r_[rng.integers(0, 50, 900), np.full(4000, 25)])
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 37]), pa.array(np.arange(i, min(i + 37, len(keys))))], ["k", "n"]) for i in range(0, len(keys), 37)]
    got = list(whole_keys(iter(batches), "k", 100))
    assert np.array_equal(np.concatenate([t["n"].to_numpy() for t in got]), np.arange(len(keys)))
    ends = [(t["k"][0].as_py(), t["k"][t.num_rows - 1].as_py()) for t in got if t.num_rows]
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:])) and len(got) > 5
