"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.llm import chat_format, decontaminate, filter_audit, html_extract, quality_classifier, quality_rules, secret_scan, sentencepiece_codec, simhash, suffix_dedup, turn_repair, url_filters, word_bpe
from sondage.llm.common import table
from sondage.plans.shared import materialize

Query = Callable[[SparkSession, str], DataFrame]
#: The piece model of the queries and the pipeline; operators take its path as a parameter.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
WORD_MODEL = "/opt/tokenizers/word_bpe_49k.json"


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encoded(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.read_back(chat_format.render(chat_format.fold(chat_format.as_events(rows))))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, quality_classifier.ratings_of(table(spark, sf_dir, "labels")))
    scored = quality_classifier.score(docs, model)
    return scored.withColumn("kept", F.col("p_top") >= quality_classifier.KEEP)


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")), 2)
    base = F.col("failed").bitwiseAND(F.lit(quality_rules.mask_of(quality_rules.BASE))) != 0
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept")


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = word_bpe.encoded(table(spark, sf_dir, "documents"), WORD_MODEL, back=True)
    written = F.array_join(F.col("ids").cast("array<string>"), " ")
    return ids.select("doc_id", "n_tokens", F.sha2(written, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = materialize(filter_audit.scan(table(spark, sf_dir, "documents")), "filter-audit")
    return filter_audit.audit(filter_audit.mask_counts(scanned, table(spark, sf_dir, "labels")))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.digest(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_sentencepiece, op2_url_filters, op3_suffix_dedup, op4_secret_scan, op5_chat_format,
        op6_simhash, op7_decontaminate, op8_quality_classifier, op9_html_extract, op10_quality_rules,
        op11_word_bpe, op12_filter_audit, op13_turn_repair,
    )
}

#: Code points of a role or message once it is escaped.
_ESCAPED = "length(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'))"

#: SQL where it can express an operator. Fitted models, tries, suffix sorting, tilings, Viterbi paths and wrappers are
#: held against brute-force versions in the tests instead.
ORACLES: dict[str, str] = {
    "op5_chat_format": f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(chat_format.TURN + chat_format.TEXT + chat_format.END)} + {_ESCAPED.format(x="role")} + {_ESCAPED.format(x="text")})::BIGINT AS formatted_chars
FROM t GROUP BY conv_id""",
    "op10_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS k FROM g) WHERE k > 1),
c AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY rid),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
  len(lines) AS n_lines, length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS n_upper
  FROM w LEFT JOIN c USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR (n_lines >= 10 AND 100 * n_dup_lines > 50 * n_lines)
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 100 * n_upper > 40 * word_chars) AS kept
FROM b""",
    "op12_filter_audit": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
  min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
  [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words),
   100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t),
   regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, false)] AS f FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, f),
s AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM s a, s b, s c, s d, s e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
r AS (SELECT part, o, s.i AS step, f[o[s.i]] AS fails, len(list_filter(range(1, s.i), lambda j: f[o[j]])) > 0 AS gone,
  len(list_filter(f, lambda x: x)) AS k, n, good, toxic, o[s.i] AS own FROM c, o, s),
g AS (SELECT part, list_transform(o, lambda x: 'ABCDE'[x]).array_to_string('') AS filter_order, step::INT AS step, own,
  coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (fails AND k = 1), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM r GROUP BY part, o, step, own)
SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM g""",
    "op13_turn_repair": r"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
h AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda d, e: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END)), 4294967295::BIGINT) % 20 AS way FROM k),
x AS (SELECT conv_id, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN way = 1 THEN '' WHEN way = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE way WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) FROM h),
w AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth FROM x),
y AS (SELECT conv_id, turn, role, text, nth, row_number() OVER t AS i, count(*) OVER (PARTITION BY conv_id) AS n,
  regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last, left(role, 1) AS r, lag(left(role, 1)) OVER t AS p FROM w
  WINDOW t AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth)),
f AS (SELECT *, CASE WHEN last = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
  p IS NOT NULL AND p || r NOT IN ('su', 'ua', 'au') AS illegal FROM y),
s AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, n, {'c': 0, 'a': '', 't': ''} AS z, {'c': 999999, 'a': '', 't': ''} AS s,
    {'c': 999999, 'a': '', 't': ''} AS u, {'c': 999999, 'a': '', 't': ''} AS a FROM f
  UNION ALL
  SELECT conv_id, i, n,
    {'c': z.c + 3, 'a': z.a || 'D', 't': z.t},
    least({'c': s.c + 3, 'a': s.a || 'D', 't': s.t}, {'c': z.c + k + CASE WHEN r = 's' THEN 0 ELSE 999999 END, 'a': z.a || 'K', 't': z.t || role || ':' || text || chr(10)}),
    least({'c': u.c + 3, 'a': u.a || 'D', 't': u.t}, {'c': b.c + k + CASE WHEN r = 'u' THEN 0 ELSE 999999 END, 'a': b.a || 'K', 't': b.t || role || ':' || text || chr(10)},
      {'c': b.c + k + 2, 'a': b.a || 'R', 't': b.t || 'user:' || text || chr(10)}),
    least({'c': a.c + 3, 'a': a.a || 'D', 't': a.t}, {'c': u.c + k + CASE WHEN r = 'a' THEN 0 ELSE 999999 END, 'a': u.a || 'K', 't': u.t || role || ':' || text || chr(10)},
      {'c': u.c + k + 2, 'a': u.a || 'R', 't': u.t || 'assistant:' || text || chr(10)})
  FROM (SELECT *, least(z, s, a) AS b FROM (
    SELECT o.conv_id, f.i, o.n, f.r, f.role, f.text, CASE f.fault WHEN 't' THEN 1 WHEN '' THEN 0 ELSE 999999 END AS k, o.z, o.s,
      least(o.u, {'c': o.z.c + 2, 'a': o.z.a || 'I', 't': o.z.t || 'user:' || chr(10)}, {'c': o.s.c + 2, 'a': o.s.a || 'I', 't': o.s.t || 'user:' || chr(10)},
        {'c': o.a.c + 2, 'a': o.a.a || 'I', 't': o.a.t || 'user:' || chr(10)}) AS u,
      least(o.a, {'c': o.u.c + 2, 'a': o.u.a || 'I', 't': o.u.t || 'assistant:' || chr(10)},
        {'c': o.z.c + 4, 'a': o.z.a || 'II', 't': o.z.t || 'user:' || chr(10) || 'assistant:' || chr(10)},
        {'c': o.s.c + 4, 'a': o.s.a || 'II', 't': o.s.t || 'user:' || chr(10) || 'assistant:' || chr(10)}) AS a
    FROM s AS o JOIN f ON f.conv_id IS NOT DISTINCT FROM o.conv_id AND f.i = o.i + 1))),
e AS (SELECT conv_id, least(z, a, {'c': u.c + 2, 'a': u.a || 'I', 't': u.t || 'assistant:' || chr(10)},
  {'c': s.c + 4, 'a': s.a || 'II', 't': s.t || 'user:' || chr(10) || 'assistant:' || chr(10)}) AS best FROM s WHERE i = n),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
  count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (illegal) AS illegal FROM f GROUP BY conv_id)
SELECT q.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
  coalesce(best.a, '') AS audit, sha256(coalesce(left(best.t, length(best.t) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS q
LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM q.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM q.conv_id""",
}
