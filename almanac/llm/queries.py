"""The queries op1 to op13 and their SQL; each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, mixing, nn_descent, quality_model, quality_rules, rolling_median, secrets, simhash, substrings, token_counts, toxicity, warc
from .common import documents, labels


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file on the driver; workers get what they need from there."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op3_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op4_mixing_ipf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).withColumn("p", F.round("p", 6))


def op5_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), labels(spark, sf_dir))


def op7_secret_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(documents(spark, sf_dir))


def op8_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.judge(quality_rules.ledger(documents(spark, sf_dir)), "v1")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed", "n_lines", "n_shouted")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of a policy decides, by bitwise aggregation over the ledger's masks."""
    return quality_rules.ablations(quality_rules.ledger(documents(spark, sf_dir)), "v1")


def op9_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score(documents(spark, sf_dir), labels(spark, sf_dir))


def op10_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def op12_rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling_median.rolling(spark.read.parquet(f"{sf_dir}/clicks.parquet"))


def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removed(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe_transducer": op1_bpe_transducer,
        "op2_token_counts": op2_token_counts,
        "op3_simhash_trie": op3_simhash_trie,
        "op4_mixing_ipf": op4_mixing_ipf,
        "op5_nn_descent": op5_nn_descent,
        "op6_toxicity_mil": op6_toxicity_mil,
        "op7_secret_linking": op7_secret_linking,
        "op8_rule_ledger": op8_rule_ledger,
        "quality_ablations": quality_ablations,
        "op9_nbsvm_quality": op9_nbsvm_quality,
        "op10_arc_to_warc": op10_arc_to_warc,
        "op11_alignment": op11_alignment,
        "op12_rolling_median": op12_rolling_median,
        "op13_substrings": op13_substrings,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_mixing_ipf": mixing.SQL,
        "op5_nn_descent": nn_descent.SQL,
        "op7_secret_linking": secrets.SQL,
        "op8_rule_ledger": quality_rules.SQL,
        "quality_ablations": quality_rules.ABLATIONS,
        "op10_arc_to_warc": warc.SQL,
        "op12_rolling_median": rolling_median.SQL,
        "op13_substrings": substrings.SQL,
    }
