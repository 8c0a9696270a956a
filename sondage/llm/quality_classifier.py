"""Ordinal cumulative-link regression on graded ratings.

A text is a sparse vector of hashed features: its different words, the shares of
word shapes (``A`` capitals, ``a`` small letters, ``0`` digits, ``.`` stops,
``!``, ``#`` other marks; runs as one), its length and how far its words repeat.
One weight per feature is shared by all grades; ordered thresholds cut the score:

    P(grade <= k) = 1 / (1 + exp(score - threshold_k))

so a text gets tail probabilities and an expected grade. The fit maximises the
penalised likelihood with Adam over a sample of at most ``SAMPLE`` rated texts,
chosen by a hash of their ids; everything else covers all rows.

Defined results: a null or blank text has the features of no words; null ids and
repeated rows are scored row by row; ratings with null fields, or for ids without
a document, are ignored; an id with several rows counts once per row; without
ratings of at least two grades every text has tail probability 1 for any grade;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.llm.common import LOWER_BYTES, text_of

#: Hash buckets, rated texts in the fit, passes over them, and the L2 penalty.
BUCKETS, SAMPLE, PASSES, PENALTY = 1 << 18, 12_000, 40, 1e-5
#: How clearly a feature must tell grades apart to get a weight.
LEAST_Z = 5.0
#: Words that a task remembers.
REMEMBERED = 1 << 17
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
GRADES = 3
_CLASS = bytes(
    65 if chr(i).isupper() else 97 if chr(i).islower() or i > 127 else 48 if chr(i).isdigit() else 46 if chr(i) in ".,;:?'\"()" else 33 if i == 33 else 35
    for i in range(256)
)
_LEVELS = 10


def _bucket(name: bytes) -> int:
    return xxhash.xxh64_intdigest(name) % BUCKETS


def shape(word: bytes) -> bytes:
    kinds = word.translate(_CLASS)
    return bytes(c for i, c in enumerate(kinds) if not i or kinds[i - 1] != c)[:6]


class Known(dict):
    """(bucket of the word, bucket of its shape) of raw words; the memory is bounded."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) >= REMEMBERED:
            self.clear()
        bare = word.translate(LOWER_BYTES).strip(PUNCTUATION)
        self[word] = x = (_bucket(b"w " + bare), _bucket(b"s " + shape(word)))
        return x


def features(text: str | None, known: Known) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    different = set(words)
    pairs = [known[w] for w in different]
    at = {b: 1.0 for b, _ in pairs}
    for b, n in Counter(s for _, s in pairs).items():
        at[b] = at.get(b, 0.0) + 4.0 * n / len(pairs)
    names = [b"l %d" % min(16, len(words).bit_length())]
    if len(words) >= 20:
        names.append(b"d %d" % (_LEVELS * len(different) // len(words)))
    for n in names:
        b = _bucket(n)
        at[b] = at.get(b, 0.0) + 1.0
    return np.fromiter(at, np.int32, len(at)), np.fromiter(at.values(), np.float32, len(at))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, at: np.ndarray, value: np.ndarray) -> float:
        return float(self.weights[at] @ value)

    def tails(self, score: float) -> list[float]:
        """P(grade > k) for each threshold."""
        return [1.0 / (1.0 + math.exp(max(-50.0, min(50.0, t - score)))) for t in self.thresholds]


def _telling(grade: np.ndarray, offsets: np.ndarray, at: np.ndarray, grades: int) -> np.ndarray:
    """Buckets whose texts have some grade or lower clearly more or less often than
    all texts: a binomial z score of ``LEAST_Z`` at least, and five texts."""
    n = np.bincount(at, minlength=BUCKETS)
    tells = np.zeros(BUCKETS, bool)
    for k in range(grades - 1):
        low = grade <= k
        p = low.mean()
        if 0 < p < 1:
            seen = np.bincount(at, np.repeat(low, np.diff(offsets)), BUCKETS)
            tells |= np.abs(seen - n * p) >= LEAST_Z * np.sqrt(np.maximum(n, 1) * p * (1 - p))
    return tells & (n >= 5)


def fit_rows(grade: np.ndarray, offsets: np.ndarray, at: np.ndarray, value: np.ndarray, passes: int = PASSES, penalty: float = PENALTY, grades: int = GRADES, seed: int = 1) -> Model:
    """Adam on the negative log-likelihood of a cumulative logit. Only features
    that tell grades apart get weights. Thresholds are a first one and positive steps."""
    if len(np.unique(grade)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), np.full(grades - 1, -50.0))
    value = value * _telling(grade, offsets, at, grades)[at]
    w, m, v = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(BUCKETS)
    share = np.array([(grade <= k).mean() for k in range(grades - 1)]).clip(1e-3, 1 - 1e-3)
    cut = np.log(share / (1 - share))
    t = np.r_[cut[0], np.log(np.maximum(np.diff(cut), 1e-2))]
    tm, tv = np.zeros_like(t), np.zeros_like(t)
    rng, step, size = np.random.default_rng(seed), 0, 256
    sig = lambda x: 1.0 / (1.0 + np.exp(-np.clip(x, -50, 50)))
    for epoch in range(passes):
        order = rng.permutation(len(grade))
        rate = 0.05 / (1 + epoch / 4)
        for s in range(0, len(order), size):
            rows = order[s : s + size]
            n = offsets[rows + 1] - offsets[rows]
            i = np.repeat(offsets[rows] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            a, x, r = at[i], value[i], np.repeat(np.arange(len(rows)), n)
            f = np.bincount(r, w[a] * x, len(rows))
            th = np.cumsum(np.r_[t[0], np.exp(t[1:])])
            y = grade[rows]
            up, down = np.r_[th, np.inf][y], np.r_[-np.inf, th][y]
            su, sd = np.where(np.isinf(up), 1.0, sig(up - f)), np.where(np.isinf(down), 0.0, sig(down - f))
            p = np.maximum(su - sd, 1e-9)
            du, dd = su * (1 - su) / p, sd * (1 - sd) / p
            gf = (du - dd) / len(rows)
            gth = np.array([-(du[y == k].sum() - dd[y == k + 1].sum()) for k in range(grades - 1)]) / len(rows)
            gt = np.r_[gth.sum(), [np.exp(t[k]) * gth[k:].sum() for k in range(1, len(t))]]
            u, inverse = np.unique(a, return_inverse=True)
            g = np.bincount(inverse, gf[r] * x) + penalty * w[u]
            step += 1
            m[u] = 0.9 * m[u] + 0.1 * g
            v[u] = 0.999 * v[u] + 0.001 * g * g
            fix = math.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            w[u] -= rate * fix * m[u] / (np.sqrt(v[u]) + 1e-8)
            tm = 0.9 * tm + 0.1 * gt
            tv = 0.999 * tv + 0.001 * gt * gt
            t -= rate * fix * tm / (np.sqrt(tv) + 1e-8)
    return Model(w.astype(np.float32), np.cumsum(np.r_[t[0], np.exp(t[1:])]))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Known()
    for b in batches:
        rows = [features(t, known) for t in b["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([b["grade"], pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float32()))], ["grade", "at", "value"])


def grade_of(quality: Column, toxic: Column) -> Column:
    """0 for toxic, 1 for poor, 2 for good; null if either rating is. Toxic is lowest:
    its words add up without bound, while poor texts differ by shares."""
    return F.when(quality.isNull() | toxic.isNull(), None).when(toxic == 1, 0).when(quality == 0, 1).otherwise(2)


def fit(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE) -> Model:
    """From documents (doc_id, text) and ratings (doc_id, grade). Of rows that share an
    id the first text is taken, so the sample bounds the rows."""
    chosen = ratings.where("doc_id is not null and grade is not null").select("doc_id", "grade").orderBy(F.xxhash64("doc_id"), "grade").limit(sample)
    rated = docs.select("doc_id", text_of("text").alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text")).select("grade", "text")
    rows = rated.mapInArrow(_features, "grade int, at array<int>, value array<float>").toArrow().combine_chunks()
    if not rows.num_rows:
        return fit_rows(np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32))
    at, value = rows["at"].combine_chunks(), rows["value"].combine_chunks()
    # the order in which tasks ended is not part of the result
    grade, offsets = rows["grade"].to_numpy().astype(np.int64), np.r_[0, np.cumsum(at.value_lengths().to_numpy())]
    flat, vals = at.flatten().to_numpy(), value.flatten().to_numpy()
    keys = [(int(g), flat[a:b].tobytes()) for g, a, b in zip(grade, offsets[:-1], offsets[1:], strict=True)]
    order = np.array(sorted(range(len(keys)), key=lambda i: xxhash.xxh64_intdigest(b"%d" % keys[i][0] + np.sort(np.frombuffer(keys[i][1], np.int32)).tobytes())), np.int64)
    flat = np.concatenate([flat[offsets[i] : offsets[i + 1]] for i in order])
    vals = np.concatenate([vals[offsets[i] : offsets[i + 1]] for i in order])
    return fit_rows(grade[order], np.r_[0, np.cumsum(np.diff(offsets)[order])], flat, vals)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for b in batches:
            scores = [model.score(*features(t, known)) for t in b["text"].to_pylist()]
            tails = [model.tails(s) for s in scores]
            names = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array(scores, pa.float64()), pa.array([sum(x) for x in tails], pa.float64()), pa.array([x[-1] for x in tails], pa.float64())], [*names, "score", "expected_grade", "p_top"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, expected_grade, p_top) of each row; ``p_top`` is the
    probability of the highest grade. The model is of fixed size."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(_score(model), "doc_id long, score double, expected_grade double, p_top double")


#: Least probability of the highest grade of a text that is kept.
KEEP = 0.5


def ratings_of(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade_of(F.col("quality"), F.col("toxic")).alias("grade"))


def _keep(model: Model, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for b in batches:
            keep = [model.tails(model.score(*features(t, known)))[-1] >= least for t in b["text"].to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return run


def kept(docs: DataFrame, model: Model, least: float = KEEP) -> DataFrame:
    """The rows of ``docs`` whose text is kept, as they are."""
    return docs.mapInArrow(_keep(model, least), docs.schema)
