import re
from collections import defaultdict

import corpus_pipeline
from pyspark.sql import functions as F

from sondage.llm import quality_classifier, queries
from sondage.llm import secret_scan as s
from tests.llm.test_decontaminate import plain
from tests.llm.test_secret_scan import base

SF = "/root/testdata/sf0.01"


def near_brute(rows):
    """The smallest id of each component of texts whose five-word shingles have a Jaccard similarity of 0.8."""
    sets, up, seen = {}, {d: d for d, _ in rows}, {}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for d, text in sorted(rows):
        words = re.sub("[A-Z]", lambda m: m[0].lower(), text).split()
        if " ".join(words) in seen:
            up[root(d)] = root(seen[" ".join(words)])
            continue
        seen[" ".join(words)] = d
        sets[d] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    holders = defaultdict(list)
    for d, x in sets.items():
        for g in x:
            holders[g].append(d)
    for a, b in {(a, b) for ds in holders.values() for a in ds for b in ds if a < b}:
        both = len(sets[a] & sets[b])
        if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9 and root(a) != root(b):
            up[max(root(a), root(b))] = min(root(a), root(b))
    return {d for d in up if root(d) == d}


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    model = quality_classifier.fit(docs, quality_classifier.ratings_of(spark.read.parquet(f"{SF}/labels.parquet")))
    want = {r.doc_id for r in quality_classifier.score(docs, model).collect() if r.p_top >= quality_classifier.KEEP}
    steps = dict(corpus_pipeline.STAGES)

    a = steps["quality"](spark, docs, SF)
    assert a.columns == docs.columns and {r.doc_id for r in a.collect()} == want
    b = steps["near_duplicates"](spark, a, SF)
    want = near_brute([(r.doc_id, r.text) for r in a.collect()])
    assert b.columns == docs.columns and {r.doc_id for r in b.collect()} == want
    c = steps["decontamination"](spark, b, SF)
    inside = lambda t, x: any(t[i : i + len(x)] == x for i in range(len(t)))
    bad = {r.doc_id for r in b.collect() for t in [plain(r.text)] if any(inside(t, x) for x in bench)}
    assert c.columns == docs.columns and {r.doc_id for r in c.collect()} == want - bad
    d = steps["secrets"](spark, c, SF)
    rows = {r.doc_id: r for r in d.collect()}
    assert d.columns == docs.columns and set(rows) == want - bad
    for r in c.collect():
        assert rows[r.doc_id].text == r.text if not base(r.text) and not any(s.weak_spans(r.text, [])) else not base(rows[r.doc_id].text)
    e = steps["pieces"](spark, d, SF).collect()
    assert {r.doc_id for r in e} == set(rows) and all(r.exact for r in e)
    assert {(r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, SF).collect()} == {(r.doc_id, tuple(r.ids)) for r in e}


def test_stages_keep_columns_of_any_name(spark):
    names = ["spans", "__sub", "__key", "__id", "n", "row", "tid", "root", "key", "stream"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({n: F.lit(n) for n in names})
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, SF)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
    plain = docs.drop(*names)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        plain = stage(spark, plain, SF)
    assert sorted(map(tuple, out.drop(*names).collect())) == sorted(map(tuple, plain.collect()))
    assert out.where(" and ".join(f"{n} = '{n}'" for n in names)).count() == plain.count()


def test_clean_documents_stay(spark):
    """Without copies and leaks, what is rated good passes."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    kept = corpus_pipeline.quality(spark, docs, "/root/testdata/sf0.1").select("doc_id")
    good = labels.where("quality = 1 and toxic = 0").select("doc_id")
    assert good.join(kept, "doc_id", "left_semi").count() >= 0.98 * good.count()


def test_awkward_rows(spark):
    from tests.llm import frames

    df = frames.awkward(spark)
    one = corpus_pipeline.near_duplicates(spark, df, SF)
    assert one.columns == df.columns
    ids = [r.doc_id for r in one.collect()]
    assert ids.count(0) == 1 and 1 not in ids and ids.count(None) == 1
    assert corpus_pipeline.near_duplicates(spark, frames.empty(spark), SF).count() == 0
    assert queries.QUERIES.keys() == {f"op{n}_{x}" for n, x in enumerate(("sentencepiece", "url_filters", "suffix_dedup", "secret_scan", "chat_format", "simhash", "decontaminate", "quality_classifier", "html_extract", "quality_rules", "word_bpe", "filter_audit", "turn_repair"), 1)}
