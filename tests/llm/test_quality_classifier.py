import numpy as np

from sondage.llm import quality_classifier as q
from tests.llm import frames


def test_gradient_finds_planted_order():
    """Grades from a planted ordinal model are found again."""
    rng = np.random.default_rng(1)
    n, p = 4000, 12
    cols = rng.random((n, p)) < 0.4
    truth = rng.normal(0, 2, p)
    f = cols @ truth
    cuts = np.quantile(f, [0.3, 0.7])
    y = (f + rng.logistic(0, 0.5, n) > cuts[0]).astype(int) + (f + rng.logistic(0, 0.5, n) > cuts[1])
    at = np.concatenate([np.flatnonzero(c) + 100 for c in cols]).astype(np.int32)
    off = np.r_[0, np.cumsum(cols.sum(1))]
    m = q.fit_rows(y.astype(np.int64), off, at, np.ones(len(at), np.float32))
    score = np.array([m.score(at[a:b], np.ones(b - a, np.float32)) for a, b in zip(off[:-1], off[1:], strict=True)])
    assert np.corrcoef(score, f)[0, 1] > 0.98
    assert m.thresholds[0] < m.thresholds[1]
    tails = np.array([m.tails(s) for s in score])
    assert (tails[:, 0] >= tails[:, 1]).all()
    for k in (0, 1):
        assert abs(tails[:, k].mean() - (y > k).mean()) < 0.03


def test_held_out_rows(spark):
    """Fitted on even documents, judged on odd ones."""
    sf = "/root/testdata/sf0.1"
    docs, ratings = spark.read.parquet(f"{sf}/documents.parquet"), q.ratings_of(spark.read.parquet(f"{sf}/labels.parquet"))
    model = q.fit(docs, ratings.where("doc_id % 2 = 0"))
    out = q.score(docs, model).join(ratings.where("doc_id % 2 = 1"), "doc_id").toPandas()
    kept = out.p_top >= q.KEEP
    assert kept[out.grade == 2].mean() > 0.98
    assert kept[out.grade == 1].mean() < 0.15
    assert kept[out.grade == 0].mean() < 0.15
    means = out.groupby("grade").expected_grade.mean()
    assert means[0] < means[1] < means[2]


def test_fit_repeats_and_ignores_partitioning(spark):
    sf = "/root/testdata/sf0.01"
    docs, ratings = spark.read.parquet(f"{sf}/documents.parquet"), q.ratings_of(spark.read.parquet(f"{sf}/labels.parquet"))
    a, b = q.fit(docs, ratings), q.fit(docs.repartition(7), ratings.repartition(3))
    assert (a.weights == b.weights).all() and (a.thresholds == b.thresholds).all()


def test_awkward_rows(spark):
    df = frames.awkward(spark)
    labels = spark.createDataFrame([(0, 1, 0), (3, 0, 0), (4, 0, 1), (None, 1, 1), (5, None, 1), (999, 1, 0)], "doc_id long, quality int, toxic int")
    model = q.fit(df, q.ratings_of(labels))
    assert q.score(df, model).count() == df.count()
    assert q.kept(df, model, 0.0).count() == df.count() and q.kept(df, model).columns == df.columns
    none = q.fit(df, q.ratings_of(labels.limit(0)))
    assert q.score(df, none).where("p_top < 1 - 1e-9").count() == 0
    assert q.score(frames.empty(spark), model).count() == 0
