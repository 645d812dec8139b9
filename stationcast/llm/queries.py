"""The queries of this subpackage: name -> (function of the session and the data folder, expected rows as SQL or None)."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from stationcast.llm import (bpe_automaton, conversations, embedding_dedup, jaccard_join, language_id, mixing, packing,
                             periodic_runs, quality_classifier, quality_rules, secrets, substring_dedup, toxicity)

Run = Callable[[SparkSession, str], DataFrame]

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _reachable(run: Run) -> Run:
    """Python workers on this machine look for the package where the driver found it; a cluster ships or installs it."""
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        environment = spark.sparkContext.environment
        if _ROOT not in environment.get("PYTHONPATH", "").split(os.pathsep):
            environment["PYTHONPATH"] = os.pathsep.join(filter(None, [_ROOT, environment.get("PYTHONPATH", "")]))
        return run(spark, sf_dir)
    return call


QUERIES: dict[str, tuple[Run, str | None]] = {name: (_reachable(run), sql) for name, (run, sql) in {
    "op1_toxicity": (toxicity.op1, None),
    "op2_embedding_dedup": (embedding_dedup.op2, embedding_dedup.OP2_SQL),
    "op3_language_id": (language_id.op3, None),
    "op4_packing": (packing.op4, None),
    "op5_quality_rules": (quality_rules.op5, quality_rules.OP5_SQL),
    "op6_jaccard_join": (jaccard_join.op6, jaccard_join.OP6_SQL),
    "op7_bpe": (bpe_automaton.op7, None),
    "op8_secret_scan": (secrets.op8, None),
    "op9_substring_dedup": (substring_dedup.op9, substring_dedup.OP9_SQL),
    "op10_quality_classifier": (quality_classifier.op10, None),
    "op11_mixing": (mixing.op11, mixing.OP11_SQL),
    "op12_conversation_repair": (conversations.op12, None),
    "op13_periodic_runs": (periodic_runs.op13, None),
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
}.items()}
