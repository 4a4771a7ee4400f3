"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import common


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(common.documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge

    return judge(common.documents(spark, sf_dir)).drop("p_good")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


#: A public byte-pair model; a parameter of the operator.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import digest

    return digest(common.documents(spark, sf_dir), MODEL)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import passages

    return passages(common.documents(spark, sf_dir))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaks

    return leaks(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("key")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .classifiers import score_quality

    return score_quality(common.documents(spark, sf_dir), _labels(spark, sf_dir))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .backoff_lm import score

    return score(common.documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .classifiers import score_toxicity

    return score_toxicity(common.documents(spark, sf_dir), _labels(spark, sf_dir))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import report

    return report(common.documents(spark, sf_dir))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import removed

    return removed(common.documents(spark, sf_dir)).drop("kept")


QUERIES = {f.__name__: f for f in (op1_simhash, op2_quality_rules, op3_sentencepiece, op4_substring_dedup, op5_decontamination, op6_quality_classifier, op7_lm_scoring, op8_toxicity, op9_pii, op10_suffix_dedup)}
ORACLES: dict[str, str] = {}
