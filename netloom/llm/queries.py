"""The queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_bpe() -> str:
    """The definition of the public word BPE; operators take the text, so that only the driver reads the file."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import adaptive_rules

    return adaptive_rules(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), word_bpe())


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mil_classifier import classify, fit

    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, table(spark, sf_dir, "labels")))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .interpolated_lm import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_density import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import digest_texts

    return digest_texts(table(spark, sf_dir, "documents"), word_bpe())


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeated_bytes

    return remove_repeated_bytes(table(spark, sf_dir, "documents")).drop("kept")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import remove_repeated_lines

    out = remove_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from . import decontaminate, line_dedup, quality_rules

    return {"op2_quality_rules": quality_rules.ORACLE_SQL, "op6_decontamination": decontaminate.ORACLE_SQL, "op10_line_dedup": line_dedup.ORACLE_SQL}
