"""URL filters: host and path rules first, then a character language-model ratio.

Two smoothed variable-order Markov models are counted: one for accepted URLs, one
for rejected ones. A URL's score is the difference of its log-likelihoods under
both, divided by its length; the threshold is calibrated on examples that the
models haven't seen.

No URL of the table has a label. Accepted examples are the table's own URLs, of
which most are taken to be good; rejected examples are the same URLs with the name
of the site replaced by one made of words of ``TERMS``, a parameter, so that both
kinds differ in names alone. Names are parted in two folds, and a URL is scored by
models that have seen the accepted names of the other fold only: a bad name that
the table holds can't vouch for itself, and what decides is how it is spelled, not
whether a term is in it. Held-out rejected names calibrate the threshold against
all the table's URLs. Interpolation is Witten-Bell:
``P_k(c|ctx) = (n(ctx,c) + t(ctx) P_{k-1}) / (n(ctx) + t(ctx))`` with ``t`` the
number of different characters seen after the context.

Everything is DataFrame expressions. URLs are scored once per distinct spelling
(digits are one class), so repeated URLs cost one row, and a site with many pages
counts by its different spellings. Defined results: a null URL, or one without
``://``, has empty host and path, no rule, and is allowed; without terms the method
allows; null ids and repeated rows pass through; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.llm.common import ascii_lower, text_of
from sondage.plans.shared import materialize

#: (action, host/path) rules of the query.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Words of which names of rejected sites are made; a parameter.
TERMS = tuple(
    "ad adult ads affiliate bet bets betting bonus buy cam casino cash cheap cialis click coupon crack credit dating deal deals discount download earn escort farm fast fat fetish free gamble gambling games girls hack hot jackpot "
    "keygen live loan loans lottery lucky meds millionaire money nude offer online payday pharma pharmacy pill pills poker popup porn prize profit promo replica rich sale seo sex sexy slots spam spin track tracker traffic torrent "
    "viagra video warez watches webcam weight win winner x xxx".split()
)
#: Labels of a host that come before the name of its site.
SERVICES = ("www", "m", "blog", "mobile", "news", "shop", "forum", "en", "de", "fr", "es")
#: Characters of context of the longest order.
ORDER = 4
#: One in so many rejected names is kept for calibration, and the folds of the table's own names.
HELD_OUT, FOLDS = 5, 2
#: Probability of a character under the empty model.
UNIFORM = 1 / 128
#: Width of the bins in which the threshold is searched, and its bound.
BIN, BINS = 0.01, 1000


def url_parts(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.locate("://", url) > 0, F.expr("substring({0}, locate('://', {0}) + 3)".format("url"))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its action; both null if none does."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, text in sorted(rules, key=lambda r: len(r[1])):
        h, slash, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def spelling(host: Column, path: Column) -> Column:
    return F.regexp_replace(F.concat(host, path), "[0-9]", "0")


def _grams(text: Column, order: int) -> Column:
    """Every character with ``order`` characters before it; ``^`` pads the front, ``$`` ends."""
    padded = F.concat(F.lit("^" * order), text, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(padded, i, F.lit(order + 1)))


def fit(examples: DataFrame, order: int = ORDER) -> DataFrame:
    """From (spelling, n_acc, n_rej), the model: each gram of the longest order
    with ``ratio``, the log of its probability under the accepted over that
    under the rejected model. All lower orders are sums over these grams."""
    grams = (
        examples.select(F.explode(_grams(F.col("spelling"), order)).alias("gram"), "n_acc", "n_rej")
        .groupBy("gram").agg(F.sum("n_acc").alias("n_acc"), F.sum("n_rej").alias("n_rej"))
    )
    orders = F.explode(F.sequence(F.lit(0), F.lit(order))).alias("k")
    tails = grams.select("*", orders).withColumn("tail", F.expr("right(gram, k + 1)"))
    counts = tails.groupBy("tail").agg(F.sum("n_acc").alias("c_acc"), F.sum("n_rej").alias("c_rej"))
    before = F.expr("left(tail, length(tail) - 1)")
    contexts = counts.groupBy(before.alias("ctx")).agg(
        F.sum("c_acc").alias("s_acc"), F.sum("c_rej").alias("s_rej"),
        F.count_if(F.col("c_acc") > 0).alias("t_acc"), F.count_if(F.col("c_rej") > 0).alias("t_rej"),
    )
    levels = (
        tails.select("gram", "k", "tail", before.alias("ctx")).join(counts, "tail").join(contexts, "ctx")
        .groupBy("gram").agg(F.sort_array(F.collect_list(F.struct("k", "c_acc", "s_acc", "t_acc", "c_rej", "s_rej", "t_rej"))).alias("levels"))
    )

    def logp(kind: str) -> Column:
        def step(p: Column, x: Column) -> Column:
            total = x[f"s_{kind}"] + x[f"t_{kind}"]
            return F.when(total > 0, (x[f"c_{kind}"] + x[f"t_{kind}"] * p) / total).otherwise(p)

        return F.log(F.aggregate("levels", F.lit(UNIFORM), step))

    return levels.select("gram", (logp("acc") - logp("rej")).alias("ratio"))


def score(spellings: DataFrame, model: DataFrame, order: int = ORDER) -> DataFrame:
    """``fold, spelling, score``: the mean log ratio of its characters under the
    model of its fold, which holds every gram of the spellings it was fitted on; an
    unknown one counts zero."""
    parts = spellings.select("fold", "spelling", F.explode(_grams(F.col("spelling"), order)).alias("gram"))
    return parts.join(model, ["fold", "gram"], "left").groupBy("fold", "spelling").agg((F.sum(F.coalesce("ratio", F.lit(0.0))) / F.count("*")).alias("score"))


def site_name(host: Column, services: Sequence[str] = SERVICES) -> Column:
    """The first label of the host that isn't a service's, of those before its last one."""
    labels = F.split(host, "[.]")
    return F.coalesce(F.get(F.filter(F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(1))), lambda x: ~x.isin(*services)), F.lit(0)), F.lit(""))


def rejected_name(key: Column, terms: Sequence[str]) -> Column:
    """One or two of the terms, joined by a hyphen or by nothing."""
    words = F.array(*[F.lit(t) for t in terms])
    word = lambda i: F.get(words, F.pmod(F.xxhash64(key, F.lit(i)), F.lit(len(terms))).cast("int"))
    kind = F.pmod(F.xxhash64(key, F.lit(2)), F.lit(4))
    return F.when(kind == 0, word(0)).when(kind == 1, F.concat(word(0), word(1))).otherwise(F.concat_ws("-", word(0), word(1)))


def examples(parts: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(fold, spelling, n_acc, n_rej, h_acc, h_rej) for each model: what it counts,
    what it is calibrated on (``h_``), and zeros for what it scores alone."""
    own = parts.where("spelling <> ''").select("spelling", "host", "path").distinct()
    name = site_name(F.col("host"))
    fold = F.pmod(F.xxhash64(name), F.lit(FOLDS)).cast("int")
    own = own.groupBy("spelling").agg(F.min_by(F.struct("host", "path"), F.struct("host", "path")).alias("x")).select("spelling", "x.*").select("*", fold.alias("fold"), name.alias("name"))
    bad = own.where("name <> ''").withColumn("new", rejected_name(F.col("spelling"), terms) if terms else F.lit(None).cast("string")).where("new is not null")
    at = F.expr("locate(name, host)")
    renamed = F.concat(F.expr("substring(host, 1, locate(name, host) - 1)"), F.col("new"), F.expr("substring(host, locate(name, host) + length(name))"))
    bad = bad.where(at > 0).select(spelling(renamed, F.col("path")).alias("spelling"), (F.pmod(F.xxhash64("new"), F.lit(HELD_OUT)) == 0).alias("held"), F.xxhash64("spelling").alias("key"))
    each = F.explode(F.array(*[F.lit(f) for f in range(FOLDS)])).alias("model")
    rows = own.select("spelling", each, (F.col("fold") != F.col("model")).cast("int").alias("n_acc"), F.lit(0).alias("n_rej"), (F.col("fold") == F.col("model")).cast("int").alias("h_acc"), F.lit(0).alias("h_rej"))
    half = F.pmod("key", F.lit(FOLDS)) == F.col("model")
    worse = bad.select("*", each).select("spelling", "model", F.lit(0).alias("n_acc"), (~F.col("held")).cast("int").alias("n_rej"), F.lit(0).alias("h_acc"), (F.col("held") & half).cast("int").alias("h_rej"))
    sums = [F.sum(c).alias(c) for c in ("n_acc", "n_rej", "h_acc", "h_rej")]
    return rows.unionByName(worse).groupBy(F.col("model").alias("fold"), "spelling").agg(*sums)


def calibrate(scored: DataFrame) -> float:
    """The threshold that best parts held-out accepted from rejected examples
    (largest sum of the two rates kept right), found over fixed bins; the
    middle of the best run of bins. -inf without examples of both kinds."""
    b = F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.floor(F.col("score") / BIN).cast("int")))
    bins = scored.groupBy(b.alias("b")).agg(F.sum("h_acc").alias("acc"), F.sum("h_rej").alias("rej"))
    rows = sorted((r["b"], r["acc"], r["rej"]) for r in bins.collect())
    acc, rej = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not acc or not rej:
        return float("-inf")
    best, low, high, below_acc, below_rej = -1.0, 0.0, 0.0, 0, 0
    for i, (at, a, r) in enumerate(rows):
        below_acc, below_rej = below_acc + a, below_rej + r
        rate = below_rej / rej - below_acc / acc
        if rate > best:
            upper = rows[i + 1][0] if i + 1 < len(rows) else at + 1
            best, low, high = rate, (at + 1) * BIN, upper * BIN
    return (low + high) / 2


def judge(df: DataFrame, rules: Sequence[tuple[str, str]] = RULES, terms: Sequence[str] = TERMS, id_col: str = "page_id", url_col: str = "url", order: int = ORDER) -> DataFrame:
    """One row a URL: id, host, path, rule, verdict, and the method's score."""
    urls = df.select(F.col(id_col).alias("page_id"), text_of(url_col).alias("url"))
    host, path = url_parts(F.col("url"))
    parts = urls.select("page_id", host.alias("host"), path.alias("path"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    parts = parts.select("page_id", "host", "path", rule.alias("rule"), action.alias("action"), spelling(F.col("host"), F.col("path")).alias("spelling"))
    known = materialize(examples(parts, terms), "url-spellings")
    models = [fit(known.where(F.col("fold") == f), order).withColumn("fold", F.lit(f)) for f in range(FOLDS)]
    judged = known.where("h_acc + h_rej > 0")
    scored = score(judged, reduce(DataFrame.unionByName, models), order)
    scored = materialize(scored.join(judged.select("fold", "spelling", "h_acc", "h_rej"), ["fold", "spelling"]), "url-scores")
    least = calibrate(scored)
    method = F.when(F.col("score") < F.lit(least), "block").otherwise("allow")
    return parts.join(scored.where("h_acc > 0").select("spelling", "score"), "spelling", "left").select("page_id", "host", "path", "rule", F.coalesce("action", method).alias("verdict"), "score")
