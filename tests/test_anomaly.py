import numpy as np
from pyspark.sql import functions as F

from sondage.operators import anomaly


def rows(spark, n):
    rng = np.random.default_rng(2)
    f = rng.normal(0, 1, n)
    x = np.column_stack([f + rng.normal(0, 0.3, n) for _ in range(3)])
    x[7] = (9, -9, 9)
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double")


def test_one_extreme_row_among_many(spark):
    """p reaches down to 1 / (n B + 1), so a lone row is flagged at any size."""
    n = 45_000
    got = anomaly.anomaly(rows(spark, n), "id", ["a", "b", "c"], rank=1)
    top = got.where("id = 7").first()
    assert got.count() == n and top.flag and np.isclose(top.p, 1 / (n * 39 + 1))
    mid = got.agg({"p": "avg"}).first()[0]
    assert 0.45 < mid < 0.55 and got.where("flag").count() < 10


def test_forest_of_numbers_and_categories(spark):
    """An odd number and an odd category are flagged, each with its own column as the driver."""
    rng = np.random.default_rng(5)
    n = 1500
    a = rng.normal(size=n)
    kind = np.where(a > 0, "hi", "lo").astype(object)
    data = [[i, float(a[i]), float(2 * a[i] + rng.normal(0, 0.1)), str(kind[i])] for i in range(n)]
    data[10][2] = 40.0
    data[11][1:] = [2.5, 5.0, "lo"]
    data[12][1] = data[13][3] = None
    df = spark.createDataFrame(data, "id long, a double, b double, kind string")
    got = {r.id: r for r in anomaly.iforest(df, "id", ["a", "b", "kind"], ntrees=80, size=n, alpha=0.02).collect()}
    assert len(got) == n and sum(r.flag for r in got.values()) == 30
    assert got[10].flag and got[10].driver == "b" and got[10].score == max(r.score for r in got.values())
    assert got[11].flag and got[11].driver == "kind"
    assert all((r.driver is not None) == r.flag for r in got.values())
    found = spark.createDataFrame(list(got.values()))
    assert sum(r.n for r in anomaly.score_table(found).collect()) == n and sum(r.n for r in anomaly.driver_table(found).collect()) == 30
    row = {r.variable: r for r in anomaly.row_table(found, df, "id", 10, ["a", "b", "kind"]).collect()}
    assert row["b"].value == 40 and row["b"].z > 10 and set(row) == {"a", "b"}
    assert anomaly.anomalous(found, df, "id").count() == 30


def test_trees_isolate_by_path_length():
    """Against walking each tree by hand."""
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.normal(size=60), rng.integers(0, 3, 60).astype(float)])
    x[3, 0] = x[4, 1] = np.nan
    trees = [anomaly._grow(x, [0, 3], rng, 6) for _ in range(7)]
    forest = anomaly.Forest(trees, [0, 3], 60)

    def walk(nodes, row):
        at = 0
        while nodes[at][0] >= 0:
            c, cut, go, left, right, most, _ = nodes[at]
            v = row[c]
            at = left if (most if np.isnan(v) else go[int(v)] if go is not None else v < cut) else right
        return nodes[at][6]

    want = [2 ** (-np.mean([walk(t, r) for t in trees]) / forest.norm) for r in x]
    assert np.allclose(forest.score(x), want)


def normal(spark, n, p=6, df=None):
    rng = np.random.default_rng(8)
    f = rng.normal(size=(n, 2))
    noise = rng.standard_t(df, size=(n, p)) if df else rng.normal(size=(n, p))
    x = f @ rng.normal(size=(2, p)) + 0.5 * noise
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, " + ", ".join(f"c{j} double" for j in range(p)))


def test_heavy_tails_are_told(spark, monkeypatch):
    cols = [f"c{j}" for j in range(6)]
    even = anomaly.scan(normal(spark, 1500), "id", cols)
    assert even.rank == 2 and even.parallel.ndim == 2 and even.note == "" and even.tail_p > 0.05
    heavy = anomaly.scan(normal(spark, 1500, df=2.5), "id", cols, rank=2)
    assert heavy.tail_p == 1 / 40 and heavy.note and heavy.parallel is None


def test_tail_of_a_matrix():
    rng = np.random.default_rng(3)
    r = rng.normal(size=(4000, 3)) * [1, 5, 0.2]
    kept = r[np.argsort((r**2).sum(1))[:3000]]
    z = np.abs(kept - np.median(kept, 0)) / (1.4826 * np.median(np.abs(kept - np.median(kept, 0)), 0))
    assert np.isclose(anomaly.tail_of(r, 2, 0.25), np.quantile(z, 0.99) / np.quantile(z, 0.75))


def test_band_by_rank(spark, monkeypatch):
    """Against sorting every simulated data set, with scores dealt to many ranges and blocks."""
    monkeypatch.setattr(anomaly, "BLOCK", 300)
    monkeypatch.setattr(anomaly, "RANGE", 256)
    n = 2000
    got = anomaly.scan(normal(spark, n), "id", [f"c{j}" for j in range(6)], rank=2, B=19)
    made = got.structure
    sims = []
    for b in range(19):
        s = []
        for i in range(-(-n // 300)):
            rows = min(300, n - i * 300)
            rng = np.random.default_rng([made.seed, b, i])
            y = rng.multivariate_normal(np.zeros(2), made.common, rows) @ made.v.T + rng.normal(0, 1, (rows, 6)) * made.scale
            s += (((y - y @ made.v @ made.v.T) ** 2).sum(1) * made.ratio).tolist()
        sims.append(np.sort(s)[::-1])
    want = np.quantile(sims, [0.025, 0.5, 0.975], axis=0).T
    band = anomaly.rank_band(got, points=n).toPandas().set_index("rank").sort_index()
    assert len(band) == n and np.allclose(band[["lo", "mid", "hi"]], want)
    assert np.allclose(band.score, np.sort(got.found.toPandas().score)[::-1])
    few = anomaly.rank_band(got, ranks=[1, 10, 2000]).toPandas().set_index("rank").sort_index()
    assert np.allclose(few, band.loc[[1, 10, 2000]])
    pooled = np.concatenate(sims)
    rows = got.found.toPandas()
    assert np.allclose(rows.p, [(1 + (pooled >= s).sum()) / (n * 19 + 1) for s in rows.score])


def test_adjusted_values_over_many_ranges(spark, monkeypatch):
    """Ranges that are ranked apart give what Benjamini and Hochberg give for all rows at once,
    and tasks grow in number with the ranges."""
    from sondage.functions.dist import p_adjust
    from sondage.plans.shared import in_parts

    monkeypatch.setattr(anomaly, "BLOCK", 300)
    monkeypatch.setattr(anomaly, "RANGE", 256)
    monkeypatch.setattr(anomaly, "PACK", 500)
    df = normal(spark, 1500, df=3).unionByName(normal(spark, 300, df=3).withColumn("id", F.col("id") + 5000))
    got = anomaly.scan(df, "id", [f"c{j}" for j in range(6)], rank=2, B=19).found.toPandas()
    want = np.array(p_adjust(got.p.tolist(), "BH"), float)
    assert len(got) == 1800 and np.allclose(got.p_adj, want, rtol=1e-12) and 0 < got.flag.sum() == (want < 0.05).sum()
    assert in_parts(spark.range(10), "id", 10_000).rdd.getNumPartitions() == 625


def test_tables_and_walks_agree(monkeypatch):
    """Trees as tables give each row the very score that walking gives, at cuts and gaps too."""
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(size=400).round(1), rng.integers(0, 4, 400).astype(float), rng.normal(size=400)])
    x[::7, 0] = x[::11, 1] = x[::13, 2] = np.nan
    trees = [anomaly._grow(x[:200], [0, 4, 0], rng, 8) for _ in range(20)]
    for nodes in trees[:3]:
        x = np.vstack([x, *[[n[1], 1.0, n[1]] for n in nodes if n[0] in (0, 2)]])
    tables = anomaly.Forest(trees, [0, 4, 0], 200)
    monkeypatch.setattr(anomaly, "CELLS", 0)
    walks = anomaly.Forest(trees, [0, 4, 0], 200)
    assert all(t is not None for t in tables.tables) and all(t is None for t in walks.tables)
    assert (tables.score(x) == walks.score(x)).all() and len(tables.score(x[:0])) == 0


def test_scores_travel_to_the_last_bit():
    rng = np.random.default_rng(6)
    for s in (rng.chisquare(3, 5000), rng.lognormal(0, 40, 300), np.r_[0.0, 0.0, 5e-324, 1.0, 1.0, 1e308], np.array([2.5]), np.full(70, 0.1)):
        s = np.sort(s)
        first, wide, low, high = anomaly.packed_steps(s)
        assert (anomaly.unpacked_steps(first, wide, low, high) == s).all()
    s = np.sort(rng.chisquare(3, 1 << 20))
    assert sum(map(len, anomaly.packed_steps(s)[2:])) < 0.7 * s.nbytes


def test_disk_of_simulated_scores(spark, monkeypatch):
    """What lies in the shuffles of a job goes with it, data sets are dealt a few at a time,
    and values are those of all at once."""
    cols = [f"c{j}" for j in range(6)]
    df = normal(spark, 6000)
    whole = anomaly.scan(df, "id", cols, rank=2).found.toPandas().set_index("id").sort_index()
    reps, own = [], anomaly.Structure.folded

    def folded(self, spark, of, f, schema):
        if "wide" in schema:
            reps.append(list(of))
        return own(self, spark, of, f, schema)

    monkeypatch.setattr(anomaly, "ROUND", 1)
    monkeypatch.setattr(anomaly.Structure, "folded", folded)
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    parts = anomaly.scan(df, "id", cols, rank=2).found.toPandas().set_index("id").sort_index()
    assert [len(r) for r in reps] == [5] * 7 + [4] and sum(reps, []) == list(range(39))
    assert np.allclose(parts[["score", "p", "p_adj"]], whole[["score", "p", "p_adj"]]) and (parts.driver == whole.driver).all() and spark.conf.get(setting) == before
