import math
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from sondage.llm import queries
from sondage.llm import url_filters as u

PAGE = "page_id long, url string, host int, rule string, spelling string"


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule(host, path):
    best = None
    for act, text in u.RULES:
        h, _, p = text.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(text) > len(best[1])):
            best = (act, text)
    return best


def test_parts_and_rules(spark):
    urls = ["http://A.Example.NET/en/1?x#y", "https://example.net", "https://example.net/", "net/", None, "", "x://example.com/de/?q", "ftp://ÄB.org/fr/a", "http://badexample.net?/en/", "http://notexample.com/de/1", "://org/fr/", "http://a.org#/fr/", "http://h/p://q/r"]
    df = spark.createDataFrame([(i, x, 1, "r", "s") for i, x in enumerate(urls + urls[:2])] + [(None, "http://x.org/fr/b", 1, "r", "s")], PAGE)
    got = {(r.page_id, r.host, r.path, r.rule) for r in u.judge(df).collect()}
    rows = [(r.page_id, r.url) for r in df.collect()]
    want = {(i, *parts(x), (rule(*parts(x)) or (None, None))[1]) for i, x in rows}
    assert got == want
    assert u.judge(df).count() == len(rows)
    assert u.judge(df.limit(0)).count() == 0


def test_model_against_recursion(spark):
    texts = [("good.org/a", 3, 0), ("goods.org/ab", 1, 0), ("bad.com/x", 0, 2), ("neither", 0, 0)]
    model = {r.gram: r.ratio for r in u.fit(spark.createDataFrame(texts, "spelling string, n_acc long, n_rej long"), 2).collect()}
    seen = [defaultdict(lambda: defaultdict(int)) for _ in range(2)]
    for t, *n in texts:
        full = "^^" + t + "$"
        for i in range(2, len(full)):
            for k in range(3):
                for c in range(2):
                    seen[c][full[i - k : i]][full[i]] += n[c]

    def p(c, ctx, ch):
        lower = u.UNIFORM if not ctx and False else None
        below = p(c, ctx[1:], ch) if ctx else u.UNIFORM
        x = {k: v for k, v in seen[c][ctx].items() if v}
        total = sum(x.values()) + len(x)
        assert lower is None
        return (x.get(ch, 0) + len(x) * below) / total if total else below

    assert model
    for g, ratio in model.items():
        assert abs(ratio - (math.log(p(0, g[:-1], g[-1])) - math.log(p(1, g[:-1], g[-1])))) < 1e-9


def test_spelled_like_rejected_hosts(spark):
    """Hosts near the marked ones are blocked and the clean ones stay."""
    rows = queries.op2_url_filters(spark, "/root/testdata/sf0.1").where("rule is null").toPandas()
    spam = rows.host.str.contains("pills|bets|casino|adult|spam|ads-")
    assert (rows[spam].verdict == "block").mean() > 0.95
    assert (rows[~spam].verdict == "allow").mean() > 0.98


def test_model_and_terms_differ(spark):
    """Names spelled like rejected ones are blocked without holding a term; a term in a common name is allowed."""
    rng = random.Random(3)
    part = lambda: rng.choice("ther on ing tion ble er an re st in at ed or es ly".split())
    clean = ["".join(part() for _ in range(rng.randrange(2, 5))) for _ in range(300)]
    bad = ["cazino-winn", "pokerz-bonuz", "pilll-cheep", "betz-sloots", "gammbling-prizes"]
    odd = ["live-theringeronationering", "theresaleronting", "onthestfreeration"]
    hosts = [f"www.{x}.example.com" for x in clean + bad + odd]
    rows = [(i * 10 + k, f"https://{x}/en/{rng.randrange(9999)}{end}", 1, "r", "s") for i, x in enumerate(hosts) for k, end in enumerate(("", "/", ".html"))]
    got = {r.page_id: r.verdict for r in u.judge(spark.createDataFrame(rows, PAGE)).collect()}
    of = lambda names: [got[i * 10 + k] for i, x in enumerate(hosts) if any(n in x for n in names) for k in range(3)]
    words = {w for x in bad for w in x.split("-")}
    assert words.isdisjoint(u.TERMS) and {"live", "sale", "free"} <= set(u.TERMS)
    assert set(of(bad)) == {"block"} and set(of(odd)) == {"allow"}
    assert sum(v == "allow" for v in of(clean)) >= 0.98 * 900


def test_threshold_against_every_cut(spark):
    rng = random.Random(4)
    rows = [(rng.gauss(1, 1), 1, 0) for _ in range(80)] + [(rng.gauss(-1, 1), 0, 1) for _ in range(50)]
    got = u.calibrate(spark.createDataFrame(rows, "score double, h_acc long, h_rej long"))
    rate = lambda c: sum(r[2] for r in rows if r[0] < c) / 50 - sum(r[1] for r in rows if r[0] < c) / 80
    assert rate(got) >= max(rate(k * u.BIN) for k in range(-500, 500)) - 1e-9
    one = spark.createDataFrame(rows[:80], "score double, h_acc long, h_rej long")
    assert u.calibrate(one) == float("-inf") == u.calibrate(one.limit(0))


def test_examples(spark):
    df = spark.createDataFrame([("www.theron.org/a", "www.theron.org", "/a"), ("www.theron.org/a", "www.theron.org", "/a"), ("x", "x", ""), ("", "", "")], "spelling string, host string, path string")
    rows = u.examples(df, ("bet",)).collect()
    own = [r for r in rows if r.h_acc]
    assert sorted(r.spelling for r in own) == ["www.theron.org/a", "x"] and all(r.n_acc == 0 for r in own)
    assert {r.spelling for r in rows} - {"www.theron.org/a", "x"} <= {f"{a}{w}{b}" for w in ("bet", "betbet", "bet-bet") for a, b in (("www.", ".org/a"), ("", ""))}
    assert not any(r.n_rej for r in u.examples(df, ()).collect())
    names = spark.createDataFrame([("www.a.b.c",), ("m",), ("blog.www.com",), ("a.com",), ("",)], "h string").select(u.site_name(F.col("h")).alias("n")).collect()
    assert [r.n for r in names] == ["a", "", "", "a", ""]
