"""The training-data operators as queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkfolio.llm import bpe_codec, chat, language, media, mixing, quality, secret_scan, sharding, simhash, token_counts
from sparkfolio.llm.common import documents


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(documents(spark, sf_dir))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(documents(spark, sf_dir))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(documents(spark, sf_dir), tokenizer(bpe_codec.TOKENIZER))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), tokenizer(token_counts.TOKENIZER))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_mixing": op2_mixing,
        "op3_language": op3_language,
        "op4_sharding": op4_sharding,
        "op5_chat": op5_chat,
        "op6_secret_scan": op6_secret_scan,
        "op7_media": op7_media,
        "op8_quality": op8_quality,
        "op9_bpe_codec": op9_bpe_codec,
        "op10_token_counts": op10_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixing.ORACLE_SQL, "op5_chat": chat.ORACLE_SQL}
