import re
from collections import Counter

from sondage.llm import quality_rules as q
from sondage.llm import queries
from tests.llm import frames


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(win)
    cov = {i + k for i, g in enumerate(win) if c[g] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cov))


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:])


def check(df):
    rows = df.select("doc_id", "text").collect()
    want = sorted(((r.doc_id, *brute(r.text)) for r in rows), key=key)
    got = sorted((tuple(r) for r in q.measure(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()), key=key)
    assert got == want


def test_measures(spark):
    check(frames.awkward(spark))
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert q.ledger(frames.empty(spark)).count() == 0


def test_policies_and_ablation(spark):
    book = q.ledger(frames.awkward(spark)).cache()
    for version, names in q.POLICIES.items():
        rows = q.apply_policy(book, version).collect()
        bits = {r.name: 1 << r.bit for r in q.RULES}
        assert all(r.kept == (not any(r.failed & bits[n] for n in names)) for r in rows)
        found = {r.rule: (r.n_fail, r.n_only) for r in q.ablation(book, version).collect()}
        for n in names:
            others = sum(bits[m] for m in names if m != n)
            fails = [r for r in rows if r.failed & bits[n]]
            assert found[n] == (len(fails), sum(not r.failed & others for r in fails))


def test_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    kept = queries.op10_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    clean = kept[(kept.quality == 1) & ~kept.base_failed]
    assert clean.kept.mean() == 1.0
    assert not kept[kept.quality == 0].kept.mean() > 0.4
