"""From documents to piece ids, in five stages, each written and read again.

Every stage but the last returns rows of ``documents`` with their columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.llm import decontaminate, near_copies, quality_classifier, secret_scan, sentencepiece_codec
from sondage.llm.common import table, text_of
from sondage.llm.queries import PIECE_MODEL
from sondage.plans.shared import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: those whose probability of the highest grade is below one half."""
    model = quality_classifier.fit(docs, quality_classifier.ratings_of(table(spark, sf_dir, "labels")))
    return quality_classifier.kept(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word shingles, a
    similarity of 0.8) stays: the one whose id names it. Rows are known by id and
    text, so texts that share an id are judged apart. Of rows of a component that
    share that id, one stays, the first by text. Rows without an id are all kept."""
    found = materialize(near_copies.near_copies(docs).distinct(), "near-duplicates")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of("text")).alias("tid"))
    stays = rows.join(found.where("doc_id <> component_id").select("doc_id", "tid"), ["doc_id", "tid"], "left_anti")
    again = stays.where("doc_id is not null").join(found.select("doc_id", "tid", "root"), ["doc_id", "tid"]).groupBy("doc_id", "root").agg(F.count("*").alias("n"), F.collect_set("tid").alias("tids"))
    again = materialize(again.where("n > 1").select("doc_id", F.explode("tids").alias("tid"), "root"), "repeated-ids")
    once = stays.join(again, ["doc_id", "tid"], "left_anti")
    # all columns decide which of repeated rows is first, so that ties are only between rows that are the same
    order = F.struct(text_of("row.text"), F.xxhash64(F.to_json("row")))
    first = stays.join(again, ["doc_id", "tid"]).groupBy("doc_id", "root").agg(F.min_by("row", order).alias("row"))
    return once.select("row").unionByName(first.select("row")).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets and linked parts of credentials are masked; all documents stay."""
    return secret_scan.masked(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, and whether decoding them gives it back."""
    return sentencepiece_codec.encoded(docs, PIECE_MODEL)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("pieces", pieces)]

#: A fitted model, components and Viterbi paths are not for SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
