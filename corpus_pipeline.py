"""A corpus through five operators: quality rules, near-duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's result to the shared folder
and reads it again for the next. All stages but the last return the columns of documents; a changed text has its
new length in n_chars. Rows whose doc_id is null stay, but are no copies of anything.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationcast.llm import common, jaccard_join, packing, quality_rules, secrets, substring_dedup

POLICY = 2


def _with_length(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule of the policy go."""
    return quality_rules.accepted(quality_rules.ledger(docs), POLICY).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document with the smallest id stays."""
    found = jaccard_join.join_components(docs.select("doc_id", "text"))
    gone = common.materialize(found.where("doc_id <> component_id").select("doc_id").distinct())
    # Only documents that may have to go are compared with the list of those that do.
    maybe = common.may_contain(spark, common.key_filter(gone, gone.count()), "doc_id")
    marked = docs.withColumn("_maybe", F.coalesce(maybe, F.lit(False)))
    kept = marked.where("not _maybe").unionByName(marked.where("_maybe").join(gone, "doc_id", "left_anti"))
    return kept.select(*docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose passages that occur earlier; texts that lose nothing stay as they are."""
    return _with_length(substring_dedup.remove_repeats(docs, touch=False), docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return _with_length(secrets.redact(docs, secrets.train(docs.select("doc_id", "text"))), docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality_stage), ("n-gram Jaccard join", near_duplicate_stage),
          ("substring dedup", substring_stage), ("secret scans", secret_stage), ("packing", packing_stage)]

#: Tokenizing, a trained network and the order of packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir))
    return docs
