import datetime as dt

import numpy as np
import pandas as pd
import pytest

from sondage.operators import cluster
from sondage.operators.timecode import best_arc


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(12)
    g = np.repeat([0, 1, 2], [300, 200, 100])
    x = np.column_stack([g * 6.0, (g == 1) * 5.0]) + rng.normal(size=(600, 2))
    return pd.DataFrame({"id": np.arange(600), "a": x[:, 0], "b": x[:, 1], "c": rng.normal(size=600), "kind": np.where(rng.random(600) < 0.9, np.array(["p", "q", "r"])[g], "p"), "coin": rng.choice(["h", "t"], 600), "g": g})


def test_three_blobs(spark, blobs):
    fit = cluster.cluster(spark.createDataFrame(blobs[["id", "a", "b"]]), "id", 3)
    rows = fit.rows.toPandas().merge(blobs, on="id")
    assert (pd.crosstab(rows.cluster, rows.g) > 0).sum().sum() == 3
    assert rows.groupby("cluster").size().tolist() == [300, 200, 100]
    centres = blobs.groupby("g")[["a", "b"]].mean().to_numpy()
    assert np.allclose(fit.centers, centres, atol=0.05)
    d = np.sort(np.sqrt(((rows[["a", "b"]].to_numpy()[:, None] - fit.centers[None]) ** 2).sum(2)), 1)
    assert np.allclose(rows.silhouette, 1 - d[:, 0] / d[:, 1])
    table = fit.clusters.toPandas().set_index("cluster")
    assert table["size"].to_dict() == {1: 300, 2: 200, 3: 100} and np.isclose(table.pct[3], 100 / 6)


def test_rows_of_one_file_use_all_cores(spark, blobs):
    fit = cluster.cluster(spark.createDataFrame(blobs[["id", "a", "b"]]).coalesce(1), "id", 3)
    assert fit.rows.rdd.getNumPartitions() > 1 and fit.rows.count() == 600


def test_gap_finds_three(spark, blobs):
    assert cluster.cluster(spark.createDataFrame(blobs[["id", "a", "b"]]), "id", k_max=4, B=4).k == 3


def test_one_cluster(spark, blobs):
    one = cluster.cluster(spark.createDataFrame(blobs[["id", "c"]]), "id", 1)
    assert one.clusters.collect()[0]["size"] == 600 and np.isclose(one.centers[0, 0], blobs.c.mean())


def eta2(x, g):
    s = pd.Series(x).groupby(g)
    return float((s.count() * (s.mean() - x.mean()) ** 2).sum() / ((x - x.mean()) ** 2).sum())


def test_shuffled_labels_of_all_rows(spark, blobs, monkeypatch):
    """Parts of 64 rows give the same null as shuffling the whole column."""
    monkeypatch.setattr(cluster, "PART", 64)
    rng = np.random.default_rng(5)
    df = blobs.assign(holes=np.where(blobs.id % 7 == 0, np.nan, blobs.c))
    got = cluster.shuffled_separations(spark.createDataFrame(df), "g", "id", ["a", "c", "holes"], 400, 3)
    for name in ("a", "c", "holes"):
        d = df.dropna(subset=[name])
        x, g = d[name].to_numpy(), d.g.to_numpy()
        want = np.array([eta2(x, rng.permutation(g)) for _ in range(1500)])
        assert np.isclose(got[name][0], eta2(x, g)) and len(got[name]) == 401
        assert abs(got[name][1:].mean() / want.mean() - 1) < 0.15
        for q in (0.5, 0.9):
            assert abs(np.quantile(got[name][1:], q) / np.quantile(want, q) - 1) < 0.25


def test_contributions(spark, blobs):
    t = cluster.var_contrib(spark.createDataFrame(blobs), "g", "id", ["a", "b", "c", "kind", "coin"], B=99).set_index("variable")
    assert t.verdict.to_dict() == {"a": "defines", "b": "carries", "kind": "carries", "c": "chance", "coin": "chance"} or t.verdict["b"] in ("carries", "defines")
    assert t.verdict["c"] == t.verdict["coin"] == "chance" and t.p["a"] == 0.01
    cross = pd.crosstab(blobs.kind, blobs.g).to_numpy()
    e = np.outer(cross.sum(1), cross.sum(0)) / 600
    assert np.isclose(t.separation["kind"], np.sqrt(((cross - e) ** 2 / e).sum() / 600 / 2))


def test_v_of_a_share(spark):
    """Against counting every draw."""
    from math import comb
    from statistics import NormalDist

    n, level, size = 12, 5, 4
    p = [comb(level, k) * comb(n - level, size - k) / comb(n, size) for k in range(size + 1)]
    for k in range(size + 1):
        tail = sum(p[k:]) if k > level * size / n else sum(p[: k + 1])
        want = 0.0 if tail > 0.5 else (1 if k > level * size / n else -1) * -NormalDist().inv_cdf(tail)
        assert np.isclose(cluster.vtest_share(k, level, size, n), want, atol=1e-9)


def test_profile(spark, blobs):
    got = cluster.profile(spark.createDataFrame(blobs.drop(columns="g")), "id", ["a", "b", "kind"], k=3, B=39)
    assert got.var_contrib.verdict.isin(["defines", "carries"]).all() and len(got.summary) == 3
    assert sorted(got.by_cluster) == ["categorical", "constant", "numeric"]
    assert got.cluster.clusters.count() == 3 and all(s.startswith("Cluster ") for s in got.summary)


def test_clusters_of_what_is_missing(spark):
    rows = [(i, None if i % 3 == 0 else 1.0, None if i % 3 == 0 else "a", None if i % 3 == 1 else 2.0) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, a double, b string, c double")
    fit = cluster.cluster_na(df, "id", ["a", "b", "c"], 2, k=3)
    got = {}
    for r in fit.rows.collect():
        got.setdefault(r.cluster, set()).add(r.id % 3)
    assert sorted(map(tuple, got.values())) == [(0,), (1,), (2,)]
    n, full, gains = cluster.incomplete_note(df, ["a", "b", "c"])
    assert (n, full, gains) == (90, 30, [("c", 30)])


def test_stability_of_blobs(spark, blobs):
    coords = spark.createDataFrame(blobs[["id", "a", "b"]])
    t = cluster.stability(coords, "id", cluster.cluster(coords, "id", 3), B=3)
    assert (t.stability == "stable").all()


def test_a_night_shift_is_named_by_its_hours(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(900):
        g = i % 3
        hour = int(rng.choice([22, 23, 0, 1, 2, 3])) if g == 1 else int(rng.integers(0, 24))
        day = dt.date(2024, 1, 1) + dt.timedelta(days=int(rng.integers(0, 28)) + (200 if g == 2 else 0))
        rows.append((i, g, dt.datetime.combine(day, dt.time(hour, int(rng.integers(0, 60)))), dt.timedelta(hours=i % 50 + 30 * (g == 0)), bool(i % 2), "ab"[int(g == 2 or rng.random() < 0.5)]))
    df = spark.createDataFrame(rows, "id long, g int, at timestamp, long interval day to second, flag boolean, kind string")
    got = cluster.characterize(df, "g", ["at", "long", "flag", "kind"], cycles={"at": ["hour", "wday"]})
    one = got.set_index(["cluster", "variable", "aspect"])
    night = one.loc[(1, "at", "time of day")]
    assert night.distinctive and "between 22:00 and 03:59" in night.description and night.v > 10 and "100% of them" in night.description
    assert "only" in one.loc[(0, "at", "time of day")].description and one.loc[(0, "at", "time of day")].v < -5
    assert not one.loc[(1, "at", "day of the week")].distinctive
    late, soon = one.loc[(2, "at", "time line")], one.loc[(0, "at", "time line")]
    assert late.distinctive and "later" in late.description and "2024-07" in late.description and late["kind"] == "number" and "earlier" in soon.description
    assert one.loc[(0, "long", "length")].distinctive and "longer" in one.loc[(0, "long", "length")].description
    assert one.loc[(2, "kind", "a")].description.endswith("none of them, of all rows " + one.loc[(2, "kind", "a")].description.split()[-1])
    assert list(got.cluster) == sorted(got.cluster) and "is true for" in one.loc[(0, "flag", "")].description


def test_best_arc_by_hand():
    rng = np.random.default_rng(3)
    for _ in range(60):
        every = rng.integers(0, 9, 12)
        group = np.minimum(every, rng.integers(0, 5, 12))
        got = best_arc("yday", group, every)
        if not group.sum():
            assert got is None
            continue
        want = None
        for length in range(1, 7):
            for s in range(12):
                idx = [(s + i) % 12 for i in range(length)]
                far = abs(group[idx].sum() / group.sum() - every[idx].sum() / every.sum())
                if want is None or far > want[0] + 1e-12:
                    want = (far, s, length)
        assert (got.first, got.length) == want[1:]
    assert best_arc("wday", np.array([5, 0, 0, 0, 0, 0, 5]), np.full(7, 10)).label == "on Sat-Sun"
    assert best_arc("mday", np.eye(31, dtype=int)[20] * 9, np.full(31, 10)).label == "on the 21st of the month"


def test_draws_of_any_number(monkeypatch):
    """Small draws by ratio of uniforms against the generator's own, large ones by their moments."""
    rng = np.random.default_rng(4)
    for good, bad, n in ((40, 25, 30), (7, 90, 60), (90, 7, 60), (500, 600, 1000), (3, 3, 6), (0, 9, 4), (9, 0, 4)):
        own = rng.hypergeometric(good, bad, n, 20000)
        with monkeypatch.context() as m:
            m.setattr(cluster, "MANY", 1)
            got = np.array([cluster.hypergeometric(rng, good, bad, n) for _ in range(20000)])
        lo, hi = min(own.min(), got.min()), max(own.max(), got.max())
        a, b = (np.bincount(x - lo, minlength=hi - lo + 1) for x in (own, got))
        there = a + b > 0
        chi2 = ((a - b)[there] ** 2 / (a + b)[there]).sum()
        assert chi2 < there.sum() + 6 * np.sqrt(2 * there.sum())
    good, bad, n = 3_000_000_000, 2_000_000_000, 1_000_000_000
    got = np.array([cluster.hypergeometric(rng, good, bad, n) for _ in range(4000)], float)
    sd = np.sqrt(n * 0.6 * 0.4 * (good + bad - n) / (good + bad - 1))
    assert abs(got.mean() - 0.6 * n) < 5 * sd / np.sqrt(4000) and 0.93 < got.std() / sd < 1.07


def test_labels_are_dealt_by_halvings():
    rng = np.random.default_rng(1)
    labels, sizes = np.array([300, 150, 50]), rng.integers(1, 20, 100)
    sizes[-1] += 500 - sizes.sum() if sizes.sum() < 500 else 0
    labels[0] += sizes.sum() - labels.sum()
    ends = np.cumsum(sizes)
    dealt = np.array([cluster.dealt_to([1, 2, 3], labels, ends, i) for i in range(100)])
    assert (dealt.sum(1) == sizes).all() and (dealt.sum(0) == labels).all() and (dealt >= 0).all()
    many = np.array([cluster.dealt_to([1, b, 3], labels, ends, 40) for b in range(3000)])
    assert np.allclose(many.mean(0), sizes[40] * labels / labels.sum(), atol=0.15)
    # five thousand million labels in 80,000 parts: seventeen draws lead to a part
    parts = np.full(80_000, 62_500)
    whole = np.array([3_000_000_000, 1_999_000_000, 1_000_000])
    for at in (0, 41_234, 79_999):
        own = cluster.dealt_to([1, 2, 3], whole, np.cumsum(parts), at)
        assert own.sum() == 62_500 and abs(own[0] - 37_500) < 800 and own[2] < 100


def test_profile_joins_its_rows_once(spark, blobs, monkeypatch):
    """The rows that every step of a profile reads are a table, not a join made again by each job."""
    seen = []
    told = cluster.characterize
    monkeypatch.setattr(cluster, "characterize", lambda df, *a, **b: (seen.append(df._jdf.queryExecution().toString()), told(df, *a, **b))[1])
    got = cluster.profile(spark.createDataFrame(blobs[["id", "a", "b"]]), "id", ["a", "b"], 3, B=9)
    assert len(seen) == 1 and "Join" not in seen[0] and got.cluster.k == 3
