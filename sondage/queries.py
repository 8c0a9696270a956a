"""Every query of the analysis verbs, and SQL that another engine runs for it.

Results are rounded where sums of doubles may differ in their last digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.functions.sqlmath import norm_cdf
from sondage.operators import anomaly as anom
from sondage.operators import boot, clean, cluster, counts, describe, frame, levels, outliers, plotdata, record, reduce, remedies, select, smd, timecode
from sondage.operators import glrm as low_rank
from sondage.operators import missing as miss
from sondage.sources import example
from sondage.streaming import describe as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, **own: int) -> DataFrame:
    """Doubles rounded; ``own`` names other digits for some columns."""
    return df.select(*[F.round(F.col(c), own.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _lines(expr: str, by: str = "") -> str:
    """One SELECT for each of four columns of lineitem; ``{x}`` is the column."""
    group = f" GROUP BY {by}" if by else ""
    head = f"{by}, " if by else ""
    return " UNION ALL ".join(f"SELECT {head}'{c}' AS variable, {expr.format(x=c)} FROM lineitem{group}" for c in LINE)


_NUM = "count(*) AS obs, count({x}) AS n, 0::BIGINT AS na, 0::BIGINT AS n_inf, round(sum({x}), 2) AS sum, round(avg({x}), 6) AS mean, round(stddev_samp({x}), 6) AS sd, round(stddev_samp({x}) / sqrt(count({x})), 6) AS se, min({x}) AS p0, round(quantile_cont({x}, 0.5), 6) AS p50, max({x}) AS p100, round(avg(({x} = 0)::INT), 6) AS p_zero"


@query(_lines(_NUM))
def describe_numeric(spark, sf):
    return rounded(describe.numeric(read(spark, sf, "lineitem"), which=LINE, dispersion=False), sum=2)


@query(_lines(_NUM, "l_returnflag"))
def describe_numeric_by(spark, sf):
    return rounded(describe.numeric(read(spark, sf, "lineitem"), ["l_returnflag"], LINE, dispersion=False), sum=2)


@query(_lines("round(quantile_cont({x}, 0.025), 6) AS \"p2.5\", round(quantile_cont({x}, 0.25), 6) AS p25, round(quantile_cont({x}, 0.75), 6) AS p75, round(quantile_cont({x}, 0.975), 6) AS \"p97.5\"", "l_linestatus"))
def describe_quantiles(spark, sf):
    out = describe.numeric(read(spark, sf, "lineitem"), ["l_linestatus"], LINE, probs=(0.025, 0.25, 0.75, 0.975), dispersion=False)
    return rounded(out.select("l_linestatus", "variable", "`p2.5`", "p25", "p75", "`p97.5`").toDF("l_linestatus", "variable", "p2_5", "p25", "p75", "p97_5")).toDF("l_linestatus", "variable", "p2.5", "p25", "p75", "p97.5")


@query(_lines("round(skewness({x}), 5) AS skew, round(kurtosis({x}), 5) AS kurt"))
def describe_shape(spark, sf):
    return rounded(describe.numeric(read(spark, sf, "lineitem"), which=LINE, skew=True, kurt=True).select("variable", "skew", "kurt"), 5)


@query("SELECT 'p_size' AS variable, round(var_samp(p_size) / avg(p_size), 6) AS dispersion FROM part UNION ALL SELECT 'p_retailprice', CASE WHEN bool_and(p_retailprice = round(p_retailprice)) THEN round(var_samp(p_retailprice) / avg(p_retailprice), 6) END FROM part")
def describe_dispersion(spark, sf):
    return rounded(describe.numeric(read(spark, sf, "part"), which=["p_size", "p_retailprice"]).select("variable", "dispersion"))


def _cat(table: str, c: str, by: str = "") -> str:
    head, on = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    group = f" GROUP BY {by}" if by else ""
    return f"SELECT {head}'{c}' AS variable, sum(k)::BIGINT AS obs, sum(k)::BIGINT AS n, 0::BIGINT AS na, coalesce(sum(k) FILTER (trim(v) = ''), 0)::BIGINT AS n_empty, count(*) AS n_unique, round(max(k) / sum(k), 6) AS p_max, count(*) FILTER (k < 5) AS n_rare, 0::BIGINT AS case_variants, false AS ordered, 0::BIGINT AS n_unused, array_to_string(list_filter([CASE WHEN count(*) FILTER (k < 5) > 0 THEN count(*) FILTER (k < 5) || ' rare levels' END, CASE WHEN max(k) / sum(k) > 0.99 THEN 'nearly one value' END], lambda x: x IS NOT NULL), '; ') AS note, string_agg(v || '_' || k, ', ' ORDER BY r) FILTER (r <= 3) AS counts_tb FROM (SELECT *, row_number() OVER ({on}ORDER BY k DESC, v) r FROM (SELECT {head}{c} v, count(*) k FROM {table} GROUP BY {head}{c})){group}"


@query(" UNION ALL ".join(_cat("part", c) for c in ("p_name", "p_brand", "p_type")))
def describe_categorical(spark, sf):
    return rounded(describe.categorical(read(spark, sf, "part")))


@query(_cat("orders", "o_orderpriority", "o_orderstatus"))
def describe_categorical_by(spark, sf):
    return rounded(describe.categorical(read(spark, sf, "orders"), ["o_orderstatus"], ["o_orderpriority"]))


@query(" UNION ALL ".join(f"SELECT l_returnflag, '{c}' AS variable, n, round(m, 6) AS mean, CASE WHEN l_returnflag <> 'A' THEN round((m - m0) / sqrt((v + v0) / 2), 6) END AS smd, true AS assessed FROM (SELECT l_returnflag, count({c}) n, avg({c}) m, var_samp({c}) v FROM lineitem GROUP BY 1), (SELECT avg({c}) m0, var_samp({c}) v0 FROM lineitem WHERE l_returnflag = 'A')" for c in LINE))
def describe_all(spark, sf):
    """Numbers of every group with their difference from the first and how normal they are."""
    table = describe.describe_all(read(spark, sf, "lineitem"), ["l_returnflag"], list(LINE), gauss=True, smd=True)["numeric"]
    return rounded(table.select("l_returnflag", "variable", "n", "mean", "smd", F.col("gauss").between(0, 1).alias("assessed")))


_PRIORITY = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NONE", "7-NEVER")


@query(f"WITH d(v) AS (VALUES {', '.join(f"('{v}')" for v in _PRIORITY)}), c AS (SELECT o_orderpriority AS v, count(*) AS k FROM orders GROUP BY 1) SELECT 'o_orderpriority' AS variable, sum(k)::BIGINT AS n, count(*) AS n_unique, true AS ordered, (SELECT count(*) FROM d WHERE v NOT IN (SELECT v FROM c)) AS n_unused, (SELECT count(*) FROM d WHERE v NOT IN (SELECT v FROM c)) || ' unused levels' AS note FROM c")
def describe_levels(spark, sf):
    df = levels.declare(read(spark, sf, "orders"), "o_orderpriority", _PRIORITY, ordered=True)
    return describe.categorical(df.select("o_orderkey", "o_orderpriority")).select("variable", "n", "n_unique", "ordered", "n_unused", "note")


@query("SELECT l_returnflag, 'high_tax' AS variable, count(*) AS obs, count(*) AS n, 0::BIGINT AS na, count(*) FILTER (l_tax > 0.04) AS \"n_TRUE\", count(*) FILTER (l_tax <= 0.04) AS \"n_FALSE\", round(avg((l_tax > 0.04)::INT), 6) AS \"p_TRUE\", CASE WHEN avg((l_tax > 0.04)::INT) < 0.01 OR avg((l_tax > 0.04)::INT) > 0.99 THEN 'near-constant' END AS note FROM lineitem GROUP BY l_returnflag")
def describe_logical(spark, sf):
    return rounded(describe.logical(read(spark, sf, "lineitem").select("l_returnflag", (F.col("l_tax") > 0.04).alias("high_tax")), ["l_returnflag"]))


@query("""WITH d AS (SELECT DISTINCT o_orderdate::DATE x FROM orders), s AS (SELECT date_diff('day', lag(x) OVER (ORDER BY x), x) d FROM d), m AS (SELECT d md FROM s WHERE d IS NOT NULL GROUP BY d ORDER BY count(*) DESC, d LIMIT 1)
SELECT 'day' AS variable, count(*) AS obs, count(*) AS n, 0::BIGINT AS na, (SELECT count(*) FROM d) AS n_unique, min(o_orderdate::DATE)::VARCHAR AS start, max(o_orderdate::DATE)::VARCHAR AS end, date_diff('day', min(o_orderdate::DATE), max(o_orderdate::DATE))::DOUBLE AS span_days, (SELECT CASE md WHEN 1 THEN 'daily' WHEN 7 THEN 'weekly' ELSE md || ' days' END FROM m) AS spacing, (SELECT bool_and(abs(d - md) <= 0.15 * md) FROM s, m WHERE d IS NOT NULL) AS regular, (SELECT count(*) FROM s, m WHERE d > 1.5 * md) AS n_gaps, count(*) - (SELECT count(*) FROM d) AS n_dup_times FROM orders""")
def describe_time(spark, sf):
    return describe.time(read(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("day")), "day")


@query("""WITH e AS (SELECT event_type, ts, epoch_us(ts) / 1e6 AS x FROM events), d AS (SELECT DISTINCT event_type, x FROM e), s AS (SELECT event_type, round(x - lag(x) OVER (PARTITION BY event_type ORDER BY x), 6) d FROM d), k AS (SELECT event_type, d, count(*) k FROM s WHERE d IS NOT NULL GROUP BY ALL), m AS (SELECT event_type, d md FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY k DESC, d) r FROM k) WHERE r = 1)
SELECT event_type, 'ts' AS variable, count(*) AS obs, (SELECT count(*) FROM d WHERE d.event_type = e.event_type) AS n_unique, round((max(x) - min(x)) / 86400, 6) AS span_days, (SELECT sum(k.k)::BIGINT FROM k, m WHERE k.event_type = e.event_type AND m.event_type = e.event_type AND k.d > 1.5 * md) AS n_gaps FROM e GROUP BY event_type""")
def describe_time_by(spark, sf):
    return rounded(describe.time(read(spark, sf, "events"), "ts", ["event_type"]).select("event_type", "variable", "obs", "n_unique", "span_days", "n_gaps"))


_GAUSS = "WITH c AS ({cells}), m AS (SELECT {keys}, count(*) n, avg(x) m, stddev_samp(x) s FROM c GROUP BY {keys}), v AS (SELECT {keys}, x, count(*) k FROM c GROUP BY {keys}, x), r AS (SELECT *, sum(k) OVER (PARTITION BY {keys} ORDER BY x) u FROM v), d AS (SELECT {keys}, n, max(greatest(abs({phi} - u / n), abs({phi} - (u - k) / n))) d FROM r JOIN m USING ({keys}) GROUP BY {keys}, n) SELECT {keys}, n, round(d, 6) AS ks_d, round(1 - least(1, greatest(0, (d - 0.9 / sqrt(n)) / 0.06)), 5) AS gauss FROM d"
_CELLS = " UNION ALL ".join(f"SELECT l_returnflag, '{c}' AS variable, {c} AS x FROM lineitem" for c in LINE[:2])


@query(_GAUSS.format(cells=_CELLS, keys="variable", phi=norm_cdf("((x - m) / s)")))
def gauss_index(spark, sf):
    return rounded(describe.gauss(read(spark, sf, "lineitem"), which=LINE[:2]).drop("gauss_note"), gauss=5)


@query(_GAUSS.format(cells=_CELLS, keys="l_returnflag, variable", phi=norm_cdf("((x - m) / s)")))
def gauss_index_by(spark, sf):
    return rounded(describe.gauss(read(spark, sf, "lineitem"), ["l_returnflag"], LINE[:2]).drop("gauss_note"), gauss=5)


@query("SELECT k AS variable, 'numeric' AS class, count(*) AS obs, count(*) AS n, 0::BIGINT AS na, '1' AS value FROM orders, (SELECT 'one' k) GROUP BY k")
def frame_constant(spark, sf):
    return describe.constants(read(spark, sf, "orders").select("*", F.lit(1).alias("one")))


@query("SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def counts_desc(spark, sf):
    return counts.counts(read(spark, sf, "orders"), "o_orderpriority", 3)


@query("SELECT p_name AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY 2, 1 LIMIT 7")
def counts_asc(spark, sf):
    return counts.counts(read(spark, sf, "part"), "p_name", 7, "a")


_TB = "WITH b AS (SELECT {c}::VARCHAR v, count(*) n FROM {t} GROUP BY 1), t AS (SELECT row_number() OVER (ORDER BY n DESC, v) AS rank, v top_value, n top_n FROM b), u AS (SELECT row_number() OVER (ORDER BY n, v) AS rank, v bottom_value, n bottom_n FROM b) SELECT rank, top_value, top_n, bottom_value, bottom_n FROM t JOIN u USING (rank) WHERE rank <= 10"


@query(_TB.format(c="p_brand", t="part"))
def counts_tb(spark, sf):
    return counts.counts_tb(read(spark, sf, "part"), "p_brand")


@query(" UNION ALL ".join(f"SELECT '{c}' AS variable, {c}::VARCHAR AS value, count(*) AS n FROM part GROUP BY 2" for c in ("p_name", "p_brand", "p_type", "p_size")))
def counts_all(spark, sf):
    return counts.counts_all(read(spark, sf, "part").drop("p_partkey", "p_retailprice"))


@query(" UNION ALL ".join(f"SELECT l_returnflag, '{c}' AS variable, {c}::VARCHAR AS value, count(*) AS n FROM lineitem GROUP BY 1, 3" for c in ("l_linestatus", "l_linenumber")))
def counts_by(spark, sf):
    return counts.counts_all(read(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber"), ["l_returnflag"])


@query("WITH c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS variable, {c}::VARCHAR AS v, count(*) AS n FROM part GROUP BY 2" for c in ("p_name", "p_brand", "p_size")) + "), t AS (SELECT variable, row_number() OVER (PARTITION BY variable ORDER BY n DESC, v) AS rank, v top_value, n top_n FROM c), u AS (SELECT variable, row_number() OVER (PARTITION BY variable ORDER BY n, v) AS rank, v bottom_value, n bottom_n FROM c) SELECT * FROM t JOIN u USING (variable, rank) WHERE rank <= 5")
def counts_tb_all(spark, sf):
    return counts.counts_tb_all(read(spark, sf, "part").select("p_name", "p_brand", "p_size"), 5)


def _gaps(df: DataFrame) -> DataFrame:
    """orders with missing values by rule: a, b and c nested, d unrelated, e where prices are high."""
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    hide = lambda c: F.when(~c, price)
    return df.select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", hide(k % 4 == 0).alias("a"), hide(k % 8 == 0).alias("b"), hide(k % 16 == 0).alias("c"), hide(k % 7 == 0).alias("d"), hide(price > 200000).alias("e"))


_GAPS = "g AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice, " + ", ".join(f"CASE WHEN NOT ({c}) THEN o_totalprice END AS {n}" for n, c in (("a", "o_orderkey % 4 = 0"), ("b", "o_orderkey % 8 = 0"), ("c", "o_orderkey % 16 = 0"), ("d", "o_orderkey % 7 = 0"), ("e", "o_totalprice > 200000"))) + " FROM orders)"


@query(f"WITH {_GAPS} " + " UNION ALL ".join(f"SELECT '{c}' AS variable, count(*) AS obs, count({c}) AS n, count(*) - count({c}) AS na, round((count(*) - count({c})) / count(*), 6) AS p_na FROM g" for c in ("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", *"abcde")))
def na_counts(spark, sf):
    return rounded(counts.na_counts(_gaps(read(spark, sf, "orders"))))


@query(f"WITH {_GAPS} " + " UNION ALL ".join(f"SELECT o_orderstatus, '{c}' AS variable, count(*) AS obs, count({c}) AS n, count(*) - count({c}) AS na, round((count(*) - count({c})) / count(*), 6) AS p_na FROM g GROUP BY 1" for c in "abcde"))
def na_counts_by(spark, sf):
    return rounded(counts.na_counts(_gaps(read(spark, sf, "orders")), ["o_orderstatus"], list("abcde")))


_DOCS = "SELECT doc_id, text FROM documents"


@query("SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS copy_number, count(*) OVER (PARTITION BY text) AS n_copies FROM documents")
def copies_all(spark, sf):
    return counts.copies(read(spark, sf, "documents").select("doc_id", "text"), ["text"], "all", ["doc_id"])


@query(f"SELECT * FROM (SELECT doc_id, text, count(*) OVER (PARTITION BY text) AS n_copies FROM ({_DOCS})) WHERE n_copies > 1")
def dupes(spark, sf):
    return counts.dupes(read(spark, sf, "documents").select("doc_id", "text"), ["text"])


@query("SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def first_of_copies(spark, sf):
    return counts.copies(read(spark, sf, "documents").select("doc_id", "text"), ["text"], "first", ["doc_id"])


@query("SELECT max(doc_id) AS doc_id, text FROM documents GROUP BY text")
def last_of_copies(spark, sf):
    return counts.copies(read(spark, sf, "documents").select("doc_id", "text"), ["text"], "last", ["doc_id"])


@query("SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text HAVING count(*) = 1")
def unique_rows(spark, sf):
    return counts.copies(read(spark, sf, "documents").select("doc_id", "text"), ["text"], "unique")


_HINGE = "h AS (SELECT {k} variable, max(n) n, (max(x) FILTER (r = floor(floor((n + 3) / 2.0) / 2)) + max(x) FILTER (r = ceil(floor((n + 3) / 2.0) / 2))) / 2 q1, (max(x) FILTER (r = n + 1 - floor(floor((n + 3) / 2.0) / 2)) + max(x) FILTER (r = n + 1 - ceil(floor((n + 3) / 2.0) / 2))) / 2 q3 FROM (SELECT *, row_number() OVER (PARTITION BY {k} variable ORDER BY x) r, count(*) OVER (PARTITION BY {k} variable) n FROM c) GROUP BY {k} variable)"
_ORDER_CELLS = "c AS (SELECT o_orderkey, o_orderstatus, 'o_totalprice' AS variable, o_totalprice AS x FROM orders)"
_IQR = "greatest((q1 - x) / (q3 - q1), (x - q3) / (q3 - q1), 0)"


@query(f"WITH {_ORDER_CELLS}, {_HINGE.format(k='')} SELECT o_orderkey, variable, x AS value, round({_IQR}, 6) AS score, {_IQR} > 0.3 AS is_outlier FROM c JOIN h USING (variable)")
def outliers_iqr(spark, sf):
    return rounded(outliers.outliers(read(spark, sf, "orders"), "o_orderkey", "o_totalprice", threshold=0.3))


@query(f"WITH {_ORDER_CELLS}, m AS (SELECT variable, median(x) m FROM c GROUP BY 1), d AS (SELECT variable, m, 1.4826 * median(abs(x - m)) s FROM c JOIN m USING (variable) GROUP BY ALL) SELECT o_orderkey, variable, x AS value, round(abs(x - m) / s, 6) AS score, abs(x - m) / s > 1.2 AS is_outlier FROM c JOIN d USING (variable)")
def outliers_mad(spark, sf):
    return rounded(outliers.outliers(read(spark, sf, "orders"), "o_orderkey", "o_totalprice", "mad", 1.2))


@query(f"WITH {_ORDER_CELLS}, m AS (SELECT variable, avg(x) m, stddev_samp(x) s FROM c GROUP BY 1) SELECT o_orderkey, variable, x AS value, round(abs(x - m) / s, 6) AS score, abs(x - m) / s > 1.6 AS is_outlier FROM c JOIN m USING (variable)")
def outliers_z(spark, sf):
    return rounded(outliers.outliers(read(spark, sf, "orders"), "o_orderkey", "o_totalprice", "zscore", 1.6))


@query(f"WITH {_ORDER_CELLS}, {_HINGE.format(k='o_orderstatus,')} SELECT o_orderstatus, o_orderkey, variable, x AS value, round({_IQR}, 6) AS score, true AS is_outlier FROM c JOIN h USING (o_orderstatus, variable) WHERE {_IQR} > 0.4")
def outliers_by(spark, sf):
    return rounded(outliers.outliers_all(read(spark, sf, "orders"), "o_orderkey", ["o_orderstatus"], ["o_totalprice"], threshold=0.4))


@query("SELECT variable FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS variable, count(DISTINCT {c}) = count(*) AS ok FROM customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")) + " UNION ALL SELECT 'c_acctbal', count(DISTINCT c_acctbal) = count(*) AND bool_and(c_acctbal = round(c_acctbal)) FROM customer) WHERE ok")
def frame_id_like(spark, sf):
    df = read(spark, sf, "customer")
    return spark.createDataFrame([(c,) for c in frame.id_like(df, df.columns)], "variable string")


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(LINE) for b in LINE[i + 1 :]) + ")")
def frame_collinear(spark, sf):
    found = frame.correlations(read(spark, sf, "lineitem"), LINE)
    return rounded(spark.createDataFrame([(*k, r) for k, r in found.items()], "a string, b string, r double"))


_CNR = "c AS (SELECT n_nationkey::VARCHAR k, n_name n, r_name r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
_PAIR = "SELECT CASE WHEN cells = la AND cells = lb THEN 'aliased_factors' WHEN cells IN (la, lb) AND again >= 0.5 THEN 'nested' END AS issue, '{names}' AS columns FROM (SELECT count(DISTINCT ({x}, {y})) cells, count(DISTINCT {x}) la, count(DISTINCT {y}) lb, (SELECT avg((k >= 2)::INT) FROM (SELECT count(*) k FROM c GROUP BY {x})) again FROM c)"


@query(f"WITH {_CNR} SELECT * FROM (" + " UNION ALL ".join(_PAIR.format(x=x, y=y, names=n) for x, y, n in (("k", "n", "n_nationkey, n_name"), ("k", "r", "n_nationkey, r_name"), ("n", "r", "n_name, r_name"))) + ") WHERE issue IS NOT NULL")
def frame_nested(spark, sf):
    df = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    found = frame.factor_pairs(df.select(F.col("n_nationkey").cast("string").alias("n_nationkey"), "n_name", "r_name"), ["n_nationkey", "n_name", "r_name"])
    return spark.createDataFrame([x[:2] for x in found], "issue string, columns string")


@query("WITH t AS (SELECT p_brand a, p_type b, count(*) n FROM part GROUP BY 1, 2), r AS (SELECT a, sum(n) ra FROM t GROUP BY 1), c AS (SELECT b, sum(n) cb FROM t GROUP BY 1), s AS (SELECT sum(n * n / (ra * cb)::DOUBLE) s, sum(n) n, count(DISTINCT a) la, count(DISTINCT b) lb FROM t JOIN r USING (a) JOIN c USING (b)) SELECT round(n * (s - 1), 6) AS chi2, n::BIGINT AS n, la AS levels_a, lb AS levels_b, round(sqrt((s - 1) / (least(la, lb) - 1)), 6) AS v FROM s")
def frame_cramer_v(spark, sf):
    return rounded(frame.cramer_v(read(spark, sf, "part"), "p_brand", "p_type"))


_PARTS = "p AS (SELECT p_partkey, p_size, ((p_partkey * 7919) % 97)::DOUBLE noise, 1 AS k, p_size AS size2, p_size * 2.0 AS double, p_size + ((p_partkey * 7919) % 97) AS total, p_brand, floor(ascii(right(p_brand, 1)) / 2.0) AS code FROM part)"
_SHARE = "(r1 * r1 + r2 * r2 - 2 * r1 * r2 * r12) / (1 - r12 * r12) > 1 - 1e-10"


@query(f"""WITH {_PARTS}, c AS (SELECT corr(p_size, double) sd, corr(p_size, total) st, corr(noise, total) nt, corr(p_size, noise) sn FROM p)
SELECT 'constant' AS issue, 'k' AS columns FROM p HAVING count(DISTINCT k) = 1
UNION ALL SELECT 'id_like', 'p_partkey' FROM p HAVING count(DISTINCT p_partkey) = count(*)
UNION ALL SELECT 'duplicate_columns', 'p_size, size2' FROM p HAVING bool_and(p_size = size2)
UNION ALL SELECT 'collinear', 'p_size, double' FROM c WHERE sd >= 0.999 UNION ALL SELECT 'collinear', 'size2, double' FROM c WHERE sd >= 0.999
UNION ALL SELECT 'collinear', 'p_size, total' FROM c WHERE st >= 0.999 UNION ALL SELECT 'collinear', 'noise, total' FROM c WHERE nt >= 0.999
UNION ALL SELECT 'rank_deficient', 'double' FROM c WHERE sd * sd > 1 - 1e-10
UNION ALL SELECT 'rank_deficient', 'total' FROM (SELECT st r1, nt r2, sn r12 FROM c) WHERE {_SHARE}
UNION ALL SELECT 'unit_level', 'code, p_brand' FROM (SELECT p_brand, min(code) = max(code) AS one, count(*) n FROM p GROUP BY 1) HAVING bool_and(one) AND avg(n) >= 2""")
def frame_issues(spark, sf):
    noise = F.pmod(F.col("p_partkey") * 7919, F.lit(97))
    df = read(spark, sf, "part").select("p_partkey", "p_size", noise.cast("double").alias("noise"), F.lit(1).alias("k"), F.col("p_size").alias("size2"), (F.col("p_size") * 2.0).alias("double"), (F.col("p_size") + noise).alias("total"), "p_brand", F.floor(F.ascii(F.expr("right(p_brand, 1)")) / 2.0).alias("code"))
    return frame.frame_issues(df).select("issue", "columns")


@query()
def gauss_check(spark, sf):
    return rounded(describe.gauss_check(read(spark, sf, "lineitem"), ["l_returnflag"], LINE))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END AS l_quantity, l_linenumber = 7 AS l_quantity_error FROM lineitem")
def recode_errors(spark, sf):
    df = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 7, F.lit(999.0)).otherwise(F.col("l_quantity")).alias("l_quantity"))
    return clean.recode_errors(df, [999.0], None, which=["l_quantity"], ind=True)


@query("SELECT n_nationkey, n_name, r_name AS region FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 4")
def translate(spark, sf):
    dictionary = read(spark, sf, "region").where("r_regionkey < 4")
    return clean.translate_by(read(spark, sf, "nation"), "n_regionkey", dictionary, "r_regionkey", "r_name", to="region").select("n_nationkey", "n_name", "region")


@query("SELECT l_orderkey, l_linenumber, l_quantity::INT AS l_quantity, l_linestatus = 'O' AS open, strftime(l_shipdate, '%Y-%m-%d') AS day FROM lineitem")
def retype(spark, sf):
    df = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit(" "), F.col("l_quantity").cast("string")).alias("l_quantity"), F.when(F.col("l_linestatus") == "O", "T").otherwise("false").alias("open"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"))
    return clean.retype(df)


@query("SELECT o_orderkey AS order_key, o_totalprice AS total_price FROM orders WHERE o_orderkey % 3 <> 0")
def wash_drop_empty(spark, sf):
    gone = F.col("o_orderkey") % 3 == 0
    df = read(spark, sf, "orders").select(F.when(~gone, F.col("o_orderkey")).alias("OrderKey"), F.when(~gone, F.col("o_totalprice")).alias("Total Price"), F.lit("  ").alias("Empty!"), F.lit(None).cast("int").alias("none"))
    return clean.wash(df)


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%' AND p_type LIKE '%E%'")
def row_patterns(spark, sf):
    return select.subset(read(spark, sf, "part"), {"p_name": "a", "p_type": "E"}, ["p_partkey", "p_name"])


@query("SELECT o_orderstatus, least(count(*), greatest(round(count(*) * 0.1), least(2, count(*))))::BIGINT AS n FROM orders GROUP BY 1")
def sample_within_counts(spark, sf):
    return select.sample_within(read(spark, sf, "orders"), "o_orderstatus", ["o_orderkey"], prop=0.1, half="up").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


_CLERKS = "SELECT r_name, n_name, c_custkey, c_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _customers(spark, sf):
    nation = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return read(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("r_name", "n_name", "c_custkey", "c_nationkey")


@query(f"SELECT r_name, n_name, least(k, greatest(round_even(k * 0.15, 0)::BIGINT, least(2, k))) AS n, round(least(k, greatest(round_even(k * 0.15, 0)::BIGINT, least(2, k))) / k, 6) AS inclusion FROM (SELECT r_name, n_name, count(*) k FROM ({_CLERKS}) GROUP BY ALL)")
def sample_nested(spark, sf):
    """Customers by nation within region."""
    got = select.sample_within(_customers(spark, sf), ["r_name", "n_name"], ["c_custkey"], prop=0.15)
    return got.groupBy("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.first("inclusion"), 6).alias("inclusion"))


@query("SELECT count(*)::BIGINT AS clusters, sum(w)::BIGINT AS floors, 400::BIGINT AS n FROM (SELECT floor(400 * count(*) / (SELECT count(*) FROM orders)) AS w FROM orders GROUP BY o_orderpriority)")
def sample_dealt(spark, sf):
    """A number of rows dealt to clusters by largest remainder: none gets less than its whole part."""
    df = read(spark, sf, "orders")
    got = select.sample_within(df, "o_orderpriority", ["o_orderkey"], n=400).groupBy("o_orderpriority").agg(F.count("*").alias("got"))
    whole = df.groupBy("o_orderpriority").agg(F.count("*").alias("k")).withColumn("w", F.floor(400 * F.col("k") / df.count()))
    both = got.join(whole, "o_orderpriority").where("got between w and w + 1")
    return both.agg(F.count("*").alias("clusters"), F.sum("w").cast("long").alias("floors"), F.sum("got").cast("long").alias("n"))


_KEPT = "SELECT l_suppkey, l_partkey FROM lineitem WHERE l_quantity = 50 AND l_discount = 0.1"
_LEVELS = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", (SELECT count(DISTINCT {c}) FROM lineitem) AS levels_given, count(*) AS levels_kept, coalesce(min(n), 0)::BIGINT AS rows_min, coalesce(median(n), 0)::DOUBLE AS rows_median, count(*) FILTER (n < 2) AS levels_below_2 FROM (SELECT {c}, count(*) n FROM ({_KEPT}) GROUP BY 1)" for c in ("l_suppkey", "l_partkey"))


@query(_LEVELS)
def sample_report_columns(spark, sf):
    df = read(spark, sf, "lineitem")
    return record.sample_report(df, df.where("l_quantity = 50 and l_discount = 0.1"), ["l_suppkey", "l_partkey"]).columns


@query(f"WITH RECURSIVE e AS (SELECT DISTINCT 's' || l_suppkey AS u, 'p' || l_partkey AS v FROM ({_KEPT})), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e), r(x, y) AS (SELECT u, u FROM b UNION SELECT r.x, b.v FROM r JOIN b ON r.y = b.u) SELECT 'l_suppkey' AS a, 'l_partkey' AS b, count(DISTINCT m) AS pieces, count(DISTINCT m) = 1 AS connected FROM (SELECT x, min(y) m FROM r GROUP BY x)")
def sample_report_pairs(spark, sf):
    df = read(spark, sf, "lineitem")
    return record.sample_report(df, df.where("l_quantity = 50 and l_discount = 0.1"), ["l_suppkey", "l_partkey"]).pairs


@query("SELECT count(*) FILTER (o_totalprice > 100000) AS n_kept, count(*) AS n_given FROM orders")
def selection_record(spark, sf):
    """Rows counted while the selection itself is computed."""
    rows, note = record.recorded(read(spark, sf, "orders"), F.col("o_totalprice") > 100000, ["o_orderkey", "o_totalprice"])
    rows.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(note.n_rows_kept, note.n_rows_given)], "n_kept long, n_given long")


@query("SELECT round(count(*) * 0.2)::BIGINT AS n FROM orders")
def sample_rows_count(spark, sf):
    return select.sample_rows(read(spark, sf, "orders"), ["o_orderkey"], prop=0.2).agg(F.count("*").alias("n"))


@query("SELECT 6::BIGINT AS n_groups, sum(k)::BIGINT >= 6 AS whole FROM (SELECT c_nationkey, count(*) k FROM customer GROUP BY 1)")
def sample_groups(spark, sf):
    df = read(spark, sf, "customer")
    drawn = select.sample_groups(df, "c_nationkey", 6)
    sizes = df.groupBy("c_nationkey").agg(F.count("*").alias("k"))
    got = drawn.groupBy("c_nationkey").agg(F.count("*").alias("got")).join(sizes, "c_nationkey")
    return got.agg(F.count("*").alias("n_groups"), F.bool_and(F.col("got") == F.col("k")).alias("whole"))


@query(" UNION ALL ".join(f"SELECT l_returnflag, '{c}' AS variable, CASE WHEN l_returnflag <> 'A' THEN round((m - m0) / sqrt((v + v0) / 2), 6) END AS smd FROM (SELECT l_returnflag, avg({c}) m, var_samp({c}) v FROM lineitem GROUP BY 1), (SELECT avg({c}) m0, var_samp({c}) v0 FROM lineitem WHERE l_returnflag = 'A')" for c in LINE))
def smd_numeric(spark, sf):
    return rounded(smd.smd_numeric(read(spark, sf, "lineitem"), "l_returnflag", list(LINE)))


@query(" UNION ALL ".join(f"SELECT g.l_linestatus, l_returnflag, '{c}' AS variable, CASE WHEN l_returnflag <> 'A' THEN round((m - m0) / sqrt((v + v0) / 2), 6) END AS smd FROM (SELECT l_linestatus, l_returnflag, avg({c}) m, var_samp({c}) v FROM lineitem GROUP BY 1, 2) g LEFT JOIN (SELECT l_linestatus, avg({c}) m0, var_samp({c}) v0 FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) b ON g.l_linestatus = b.l_linestatus" for c in LINE[:2]))
def smd_within(spark, sf):
    return rounded(smd.smd_numeric(read(spark, sf, "lineitem"), "l_returnflag", list(LINE[:2]), within=["l_linestatus"]))


@query("WITH g AS (SELECT l_returnflag, avg((l_linestatus = 'O')::INT) m FROM lineitem GROUP BY 1) SELECT l_returnflag, 'l_linestatus' AS variable, CASE WHEN l_returnflag <> 'A' THEN round((m - m0) / sqrt((m * (1 - m) + m0 * (1 - m0)) / 2), 6) END AS smd FROM g, (SELECT m m0 FROM g WHERE l_returnflag = 'A')")
def smd_binary(spark, sf):
    return rounded(smd.smd_binary(read(spark, sf, "lineitem"), "l_returnflag", ["l_linestatus"]))


# d'S^-1 d by Woodbury's identity: S is the diagonal D of mean shares less half of pp' + qq'
@query("""WITH t AS (SELECT o_orderstatus s, o_orderpriority l, count(*) n FROM orders GROUP BY 1, 2), g AS (SELECT DISTINCT s FROM t), k AS (SELECT DISTINCT l FROM t WHERE l > (SELECT min(l) FROM t)),
p AS (SELECT g.s, k.l, coalesce(n, 0) / (sum(n) OVER (PARTITION BY g.s) + first0)::DOUBLE p FROM g CROSS JOIN k JOIN (SELECT s, sum(n) FILTER (l = (SELECT min(l) FROM t)) first0 FROM t GROUP BY 1) z ON z.s = g.s LEFT JOIN t ON t.s = g.s AND t.l = k.l),
d AS (SELECT a.s, a.p, b.p q, (a.p + b.p) / 2 d FROM p a JOIN p b ON a.l = b.l AND b.s = (SELECT min(s) FROM g)),
u AS (SELECT s, 1 - sum(p * p / d) / 2 a, -sum(p * q / d) / 2 b, 1 - sum(q * q / d) / 2 c, sum((p - q) * p / d) e, sum((p - q) * q / d) f, sum((p - q) * (p - q) / d) g FROM d GROUP BY s)
SELECT s AS o_orderstatus, CASE WHEN s > (SELECT min(s) FROM g) THEN round(sqrt(g + (c * e * e - 2 * b * e * f + a * f * f) / (a * c - b * b) / 2), 6) END AS smd FROM u""")
def smd_levels(spark, sf):
    got = smd.smd_levels(read(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")
    return rounded(spark.createDataFrame(list(got.items()), "o_orderstatus string, smd double"))


@query("WITH k AS (SELECT l_orderkey, count(*) k FROM lineitem GROUP BY 1) SELECT 'l_orderkey' AS cluster, count(*) AS n_clusters, sum(k)::BIGINT AS n_rows, 0::BIGINT AS n_no_cluster, round(avg(k), 6) AS rows_mean, min(k) AS rows_min, quantile_cont(k, 0.25)::DOUBLE AS rows_p25, quantile_cont(k, 0.5)::DOUBLE AS rows_p50, quantile_cont(k, 0.75)::DOUBLE AS rows_p75, max(k) AS rows_max FROM k")
def cluster_sizes(spark, sf):
    return rounded(smd.describe_clusters(read(spark, sf, "lineitem"), "l_orderkey", ["l_quantity", "l_returnflag"])["clusters"])


_BITS = " || ".join(f"CASE WHEN {c} IS NULL THEN '1' ELSE '0' END" for c in "abcde")


@query(f"WITH {_GAPS} SELECT {_BITS} AS pattern, count(*) AS n, length(replace({_BITS}, '0', ''))::BIGINT AS n_missing FROM g GROUP BY ALL")
def na_patterns(spark, sf):
    return miss.patterns(_gaps(read(spark, sf, "orders")), list("abcde"))


@query(f"WITH {_GAPS} SELECT count(*) FILTER (c IS NULL AND b IS NOT NULL) + count(*) FILTER (b IS NULL AND a IS NOT NULL) = 0 AS monotone FROM g")
def na_monotone(spark, sf):
    df = _gaps(read(spark, sf, "orders"))
    return spark.createDataFrame([(miss.monotone(df, list("abc")),)], "monotone boolean")


@query(f"WITH {_GAPS} SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{v}' AS missing_in, '{w}' AS related_to, count({w}) AS n, round(corr(({v} IS NULL)::INT, {w}) FILTER ({w} IS NOT NULL), 6) AS r FROM g" for v in "ad" for w in ("o_totalprice", "d", "e") if v != w) + ")")
def na_screen_numeric(spark, sf):
    return rounded(miss.screen_numeric(_gaps(read(spark, sf, "orders")), ["a", "d"], ["o_totalprice", "d", "e"]))


@query(f"WITH {_GAPS}, t AS (" + " UNION ALL ".join(f"SELECT '{v}' v, '{w}' w, {w} l, count(*) n, sum(({v} IS NULL)::INT) m FROM g GROUP BY {w}" for v in "ae" for w in ("o_orderstatus", "o_orderpriority")) + "), s AS (SELECT v, w, sum(n) n, sum(m) m, count(*) k, sum(m * m / n::DOUBLE) s FROM t GROUP BY v, w) SELECT v AS missing_in, w AS related_to, n::BIGINT AS n, k AS levels, round((s - m * m / n::DOUBLE) / (m / n::DOUBLE * (1 - m / n::DOUBLE)), 5) AS chi2, round(sqrt((s - m * m / n::DOUBLE) / (m / n::DOUBLE * (1 - m / n::DOUBLE)) / n), 6) AS v FROM s")
def na_screen_categorical(spark, sf):
    return rounded(miss.screen_categorical(_gaps(read(spark, sf, "orders")), ["a", "e"], ["o_orderstatus", "o_orderpriority"]), chi2=5)


@query()
def check_missing(spark, sf):
    got = miss.check_missing(_gaps(read(spark, sf, "orders")).drop("o_orderkey", "a", "b", "c"), "o_totalprice", ["o_orderstatus"])
    rows = [("verdict", got["verdict"], None), *[(f"{t['missing_in']} ~ outcome", str(t["flag"]), t["p_value"]) for t in got["outcome_test"]], *[(f"{a['missing_in']} ~ {a['related_to']}", str(a["flag"]), a["p_value"]) for a in got["associations"]]]
    return spark.createDataFrame(rows, "item string, value string, p_value double")


@query(" UNION ALL ".join(f"SELECT l_returnflag, '{c}' AS variable, round((mc - m) / sqrt(s2 / nc * (n - nc) / (n - 1)), 6) AS v FROM (SELECT l_returnflag, avg({c}) mc, count(*) nc FROM lineitem GROUP BY 1), (SELECT avg({c}) m, var_pop({c}) s2, count(*) n FROM lineitem)" for c in LINE))
def vtest_mean(spark, sf):
    return rounded(cluster.vtest_mean(read(spark, sf, "lineitem"), "l_returnflag", LINE))


@query(" UNION ALL ".join(f"SELECT '{c}' AS variable, round(1 - sum(k * v) / max(n * s2), 8) AS separation FROM (SELECT count(*) k, var_pop({c}) v FROM lineitem GROUP BY l_linenumber), (SELECT count(*) n, var_pop({c}) s2 FROM lineitem)" for c in LINE))
def separation_eta2(spark, sf):
    return rounded(cluster.separation(read(spark, sf, "lineitem"), "l_linenumber", LINE), 8)


@query(" UNION ALL ".join(f"SELECT l_returnflag, '{c}' AS variable, v AS value, n, round(n / (sum(n) OVER (PARTITION BY l_returnflag)), 6) AS share, round((sum(n) OVER (PARTITION BY v)) / (sum(n) OVER ()), 6) AS share_all FROM (SELECT l_returnflag, {c}::VARCHAR v, count(*) n FROM lineitem GROUP BY 1, 2)" for c in ("l_linestatus", "l_linenumber")))
def profile_frequencies(spark, sf):
    return rounded(cluster.frequencies(read(spark, sf, "lineitem"), "l_returnflag", ["l_linestatus", "l_linenumber"]))


@query("WITH b AS (SELECT min(o_totalprice) lo, max(o_totalprice) hi, ceil(log2(count(*)) + 1) k FROM orders), w AS (SELECT lo, (hi - lo) / k w, k FROM b) SELECT least(floor((o_totalprice - lo) / w), k - 1)::BIGINT AS bin, round(lo + least(floor((o_totalprice - lo) / w), k - 1) * w, 4) AS lower, round(lo + (least(floor((o_totalprice - lo) / w), k - 1) + 1) * w, 4) AS upper, count(*) AS n FROM orders, w GROUP BY ALL")
def histogram(spark, sf):
    return rounded(plotdata.histogram(read(spark, sf, "orders"), "o_totalprice"), 4)


@query("WITH b AS (SELECT min(l_quantity) lx, (max(l_quantity) - min(l_quantity)) / 60 wx, min(l_extendedprice) ly, (max(l_extendedprice) - min(l_extendedprice)) / 60 wy FROM lineitem) SELECT least(floor((l_quantity - lx) / wx), 59)::BIGINT AS x_bin, least(floor((l_extendedprice - ly) / wy), 59)::BIGINT AS y_bin, count(*) AS n FROM lineitem, b GROUP BY ALL")
def bin2d(spark, sf):
    return plotdata.bin2d(read(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


@query("SELECT l_returnflag, round(avg(l_tax), 8) AS center, round(avg(l_tax) - stddev_samp(l_tax) / sqrt(count(*)), 8) AS lower, round(avg(l_tax) + stddev_samp(l_tax) / sqrt(count(*)), 8) AS upper, count(*) AS n FROM lineitem GROUP BY 1")
def stat_error(spark, sf):
    return rounded(plotdata.stat_error(read(spark, sf, "lineitem"), "l_tax", "l_returnflag"), 8)


@query("SELECT l_linestatus, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, regr_count(l_extendedprice, l_quantity)::BIGINT AS n FROM lineitem GROUP BY 1")
def trend_lm(spark, sf):
    return rounded(plotdata.trend(read(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_linestatus"]), slope=4, intercept=3)


@query(f"WITH {_ORDER_CELLS}, {_HINGE.format(k='')}, f AS (SELECT *, x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1) AS ok FROM c JOIN h USING (variable)) SELECT variable, round(q1, 4) AS q1, round(q3, 4) AS q3, min(x) FILTER (ok) AS low, round(median(x), 4) AS median, max(x) FILTER (ok) AS high, count(*) FILTER (NOT ok) AS n_out FROM f GROUP BY ALL")
def box(spark, sf):
    return rounded(plotdata.box(read(spark, sf, "orders"), "o_totalprice"), 4)


@query("WITH c AS (SELECT p_name v, count(*) n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, v) k FROM c) SELECT CASE WHEN k <= 20 THEN v ELSE '(other)' END AS value, sum(n)::BIGINT AS n FROM r GROUP BY 1")
def bar(spark, sf):
    return plotdata.bar(read(spark, sf, "part"), "p_name")


@query("SELECT l_linenumber AS x, round(avg(l_quantity), 6) AS mean, count(l_quantity) AS n FROM lineitem GROUP BY 1")
def line(spark, sf):
    return rounded(plotdata.line(read(spark, sf, "lineitem"), "l_linenumber", "l_quantity"))


@query("SELECT l_returnflag, round(avg(l_quantity), 6) AS observed, count(*) AS n FROM lineitem GROUP BY 1")
def boot_ci_observed(spark, sf):
    return rounded(boot.observed(read(spark, sf, "lineitem"), "l_quantity", ["l_returnflag"]))


@query()
def boot_ci(spark, sf):
    return boot.boot_ci(read(spark, sf, "lineitem"), "l_quantity", ["l_returnflag"])


@query()
def boot_ci_bca(spark, sf):
    return boot.boot_ci(read(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"], "sd", ci_type="bca")


@query()
def boot_diff(spark, sf):
    return spark.createDataFrame(boot.boot_diff(read(spark, sf, "lineitem"), "l_tax", "l_returnflag")[0])


@query("SELECT 'true - false (mean)' AS label, (avg(l_quantity) FILTER (l_quantity > 25) > avg(l_quantity) FILTER (l_quantity <= 25))::INT::DOUBLE AS share_above FROM lineitem")
def diff_density(spark, sf):
    """Groups so far apart that all replicates lie on one side."""
    df = read(spark, sf, "lineitem").select("l_quantity", (F.col("l_quantity") > 25).cast("string").alias("many"))
    _, marks = plotdata.diff_density(*boot.boot_diff(df, "l_quantity", "many", R=200))
    return spark.createDataFrame([(marks["label"], marks["share_above"])], "label string, share_above double")


@query("SELECT date_trunc('day', ts)::VARCHAR AS start, event_type, count(*) AS n, 0::BIGINT AS na, round(avg(value), 6) AS mean, round(min(value), 6) AS lo, round(max(value), 6) AS hi FROM events GROUP BY ALL")
def stream_windowed(spark, sf):
    schema = read(spark, sf, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf}/events.parque*")
    out = stream.drained(stream.windowed(events, "ts", "value", ["event_type"]), "stream")
    return rounded(out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "na", "mean", "lo", "hi"))


@query()
def reduce_famd(spark, sf):
    got = reduce.reduce(read(spark, sf, "part"), "p_partkey", ["p_size", "p_retailprice", "p_type"])
    return spark.createDataFrame(got.eig)


@query("SELECT 1::BIGINT AS dim, round(1 + abs(r), 6) AS eigenvalue FROM (SELECT corr(l_quantity, l_extendedprice) r FROM lineitem) UNION ALL SELECT 2, round(1 - abs(r), 6) FROM (SELECT corr(l_quantity, l_extendedprice) r FROM lineitem)")
def reduce_pca(spark, sf):
    """Two standardised columns have eigenvalues 1 + |r| and 1 - |r|."""
    df = read(spark, sf, "lineitem").withColumn("id", F.xxhash64("l_orderkey", "l_linenumber"))
    got = reduce.reduce(df, "id", ["l_quantity", "l_extendedprice"])
    return rounded(spark.createDataFrame(got.eig).select("dim", "eigenvalue"))


@query()
def reduce_na(spark, sf):
    got = reduce.reduce_na(_gaps(read(spark, sf, "orders")), "o_orderkey", list("abcde"))
    return spark.createDataFrame(got.eig)


@query()
def cluster_k3(spark, sf):
    red = reduce.reduce(read(spark, sf, "part"), "p_partkey", ["p_size", "p_retailprice", "p_type"], 3)
    return cluster.cluster(red.coords, "p_partkey", 3).clusters


@query()
def var_contrib(spark, sf):
    return spark.createDataFrame(cluster.var_contrib(read(spark, sf, "orders"), "o_orderstatus", "o_orderkey", ["o_totalprice", "o_orderpriority"]))


@query()
def profile(spark, sf):
    got = cluster.profile(read(spark, sf, "part"), "p_partkey", ["p_size", "p_retailprice", "p_type"], 3, B=39)
    return spark.createDataFrame(got.characterization)


@query()
def anomaly(spark, sf):
    df = read(spark, sf, "lineitem").withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return anom.anomaly(df, "id", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query()
def anomaly_band(spark, sf):
    df = read(spark, sf, "part").withColumn("weight", F.col("p_size") * F.col("p_retailprice"))
    return anom.rank_band(anom.scan(df, "p_partkey", ["p_size", "p_retailprice", "weight"]))


@query()
def iforest(spark, sf):
    return anom.iforest(read(spark, sf, "orders").withColumn("day", F.unix_date(F.col("o_orderdate").cast("date"))), "o_orderkey", ["o_totalprice", "day"])


@query()
def glrm(spark, sf):
    df = read(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), *LINE, (F.col("l_linestatus") == "O").alias("open"))
    return low_rank.glrm(df, "id", [*LINE, "open"]).scores


@query()
def glrm_mixed(spark, sf):
    """Poisson, multinomial and quadratic losses together."""
    df = read(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), "l_linenumber", "l_extendedprice", "l_quantity", "l_returnflag")
    return low_rank.glrm(df, "id", ["l_linenumber", "l_extendedprice", "l_quantity", "l_returnflag"], poisson=["l_linenumber"]).scores


@query("SELECT 1::BIGINT AS dim, round((sqrt(n * (1 + abs(r))) - 0.5) ** 2 / n, 5) AS per_row, round(100 * (sqrt(n * (1 + abs(r))) - 0.5) ** 2 / (2 * n), 4) AS pct_var FROM (SELECT corr(l_quantity, l_extendedprice) r, count(*) n FROM lineitem)")
def glrm_reduce(spark, sf):
    """Of two standardised columns, penalised by 1, the fitted singular value is that of the data less 1/2."""
    df = read(spark, sf, "lineitem").withColumn("id", F.xxhash64("l_orderkey", "l_linenumber"))
    got = reduce.reduce(df, "id", ["l_quantity", "l_extendedprice"], 1, method="glrm")
    out = spark.createDataFrame(got.eig.assign(per_row=got.eig.eigenvalue / got.n)[["dim", "per_row", "pct_var"]])
    return out.select("dim", F.round("per_row", 5).alias("per_row"), F.round("pct_var", 4).alias("pct_var"))


@query()
def glrm_reduce_mixed(spark, sf):
    got = reduce.reduce(read(spark, sf, "part"), "p_partkey", ["p_size", "p_retailprice", "p_type"], 3, method="glrm")
    return spark.createDataFrame(got.eig)


@query("SELECT o_orderkey, round(epoch_us(o_orderdate) / 86400e6 - min(epoch_us(o_orderdate) / 86400e6) OVER (), 6) AS o_orderdate_elapsed FROM orders")
def time_elapsed(spark, sf):
    df = read(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return rounded(timecode.encode(df, "o_orderkey", ["o_orderdate"], "elapsed").df.drop("o_orderdate"))


@query("SELECT o_orderkey, round((dayofweek(d) + h) / 7, 6) AS wday, round((day(d) - 1 + h) / day(last_day(d)), 6) AS mday, round((dayofyear(d) - 1 + h) / 366, 6) AS yday FROM (SELECT o_orderkey, o_orderdate d, (hour(o_orderdate) * 3600 + minute(o_orderdate) * 60 + second(o_orderdate)) / 86400 h FROM orders)")
def time_places(spark, sf):
    df = read(spark, sf, "orders")
    at = timecode.places(df, "o_orderdate")
    return rounded(df.select("o_orderkey", *[at[a].share.alias(a) for a in ("wday", "mday", "yday")]))


@query()
def reduce_time(spark, sf):
    got = reduce.reduce(read(spark, sf, "orders"), "o_orderkey", ["o_orderdate", "o_totalprice", "o_orderpriority"], 3)
    return spark.createDataFrame(got.eig)


_ARC_ROWS = "SELECT o_orderstatus AS g, dayofweek(o_orderdate)::INT AS b FROM orders"


@query(f"WITH c AS (SELECT g, b, count(*) AS n FROM ({_ARC_ROWS}) GROUP BY ALL), k AS (SELECT s, len, x.b FROM range(0, 7) AS s(s), range(1, 4) AS l(len), range(0, 7) AS x(b) WHERE (x.b - s + 7) % 7 < len), a AS (SELECT g, s, len, sum(n) AS i FROM c JOIN k USING (b) GROUP BY ALL), z AS (SELECT q.g, s.s, l.len, coalesce(i, 0) / (SELECT sum(n) FROM c WHERE c.g = q.g) AS share FROM (SELECT DISTINCT g FROM c) q, range(0, 7) AS s(s), range(1, 4) AS l(len) LEFT JOIN a ON a.g = q.g AND a.s = s.s AND a.len = l.len), e AS (SELECT s, len, sum(i) / (SELECT sum(n) FROM c) AS share_all FROM a GROUP BY ALL) SELECT g AS o_orderstatus, s::BIGINT AS first, len::BIGINT AS length, round(share, 6) AS share, round(share_all, 6) AS share_all FROM z JOIN e USING (s, len) QUALIFY row_number() OVER (PARTITION BY g ORDER BY round(abs(share - share_all), 11) DESC, len, s) = 1")
def time_arcs(spark, sf):
    """The days of the week on which orders of a status stand out."""
    found = timecode.arcs(read(spark, sf, "orders"), "o_orderstatus", {"o_orderdate": ["wday"]})
    rows = [(g, a.first, a.length, a.share, a.share_all) for (g, _, _), (a, _, _) in found.items()]
    return rounded(spark.createDataFrame(rows, "o_orderstatus string, first long, length long, share double, share_all double"))


@query()
def characterize_times(spark, sf):
    what = cluster.characterize(read(spark, sf, "orders"), "o_orderstatus", ["o_orderdate", "o_totalprice", "o_orderpriority"], cycles={"o_orderdate": ["wday", "mday", "yday"]})
    return spark.createDataFrame(what)


@query()
def cleaning_loop(spark, sf):
    df = read(spark, sf, "part").withColumns({"k": F.lit(1), "size2": F.col("p_size")})
    table = remedies.remedies(remedies.check_data(df))
    done = remedies.apply(remedies.apply(df, table, "drop_cols/k", "one value", recheck=False), remedies.remedies(remedies.check_frame(df.drop("k"))), "keep_one/p_size,size2", "copies")
    return spark.createDataFrame([(e["step"], e["key"], e["reason"]) for e in done.log], "step long, key string, reason string")


@query()
def data_id(spark, sf):
    df = read(spark, sf, "orders")
    return spark.createDataFrame([(clean.data_id(df, ["o_orderkey"]), clean.data_id(df))], "placed string, as_set string")


@query()
def example_panel(spark, sf):
    return example.example_data(spark)
