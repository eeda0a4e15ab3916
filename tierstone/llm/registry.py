"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tierstone.llm import bpe, decontaminate, importance, near_dup, pii, quality_rules, range_coder, secrets, sharding, warc

Query = Callable[[SparkSession, str], DataFrame]
ROOT = str(Path(__file__).resolve().parents[2])


def importable(query: Query) -> Query:
    """Python workers import this library too, wherever the driver was started; their path is told once a session."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        env = spark.sparkContext.environment
        if ROOT not in env.get("PYTHONPATH", "").split(":"):
            env["PYTHONPATH"] = ":".join(filter(None, [env.get("PYTHONPATH", ""), ROOT]))
        return query(spark, sf_dir)

    return run


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    found = {
        "op1_transaction_assembly": warc.op1_transaction_assembly,
        "op2_multi_index_hamming": near_dup.op2_multi_index_hamming,
        "op3_decontaminate": decontaminate.op3_decontaminate,
        "op4_transducer_bpe": bpe.op4_transducer_bpe,
        "op5_decision_list": quality_rules.op5_decision_list,
        "op6_sampled_splitters": sharding.op6_sampled_splitters,
        "op7_importance_resampling": importance.op7_importance_resampling,
        "op8_context_mixing": range_coder.op8_context_mixing,
        "op9_ownership_frequency": secrets.op9_ownership_frequency,
        "op10_surrogates": pii.op10_surrogates,
        "pipeline": _pipeline,
    }
    return {name: importable(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_transaction_assembly": warc.OP1_SQL,
        "op2_multi_index_hamming": near_dup.OP2_SQL,
        "op3_decontaminate": decontaminate.OP3_SQL,
        "op6_sampled_splitters": sharding.OP6_SQL,
        "op9_ownership_frequency": secrets.OP9_SQL,
    }
