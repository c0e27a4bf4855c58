"""The ``opN_<name>`` queries: thin readers of the operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tangentia.llm import chat, codes, decontaminate, html, langid, licences, lm, minhash, mixing, negatives, quality, sql, topk, warc


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op2_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_documents(spark, sf_dir))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = [(-7, k, role, r"\### Assistant: </turn> ok") for k, role in enumerate(("user", "assistant"))]
    more = spark.createDataFrame(planted, "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(conversations.unionByName(more)))


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(_documents(spark, sf_dir))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(_documents(spark, sf_dir))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_documents(spark, sf_dir))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir))


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.search(rows.where("vec_id % 100 = 0"), rows)


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return codes.with_label_errors(found.rows).select("vec_id", "code", "error", "label_error", F.lit(found.digest).alias("codebooks_sha256"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.col("label").cast("long")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return negatives.mine(rows.where("vec_id % 100 = 0"), rows)


_ALL = (
    op1_html,
    op2_divergence,
    op3_chat,
    op4_decontaminate,
    op5_licences,
    op6_lm,
    op7_mix,
    op8_warc,
    op9_langid,
    op10_minhash,
    op11_topk,
    op12_codes,
    op13_negatives,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_divergence": sql.quality(),
        "op3_chat": sql.CHAT,
        "op4_decontaminate": sql.DECONTAMINATE,
        "op7_mix": sql.MIX,
        "op8_warc": sql.WARC,
        "op10_minhash": sql.NEAR_DUPLICATES,
        "op11_topk": sql.TOP,
        "op12_codes": sql.codes(),
        "op13_negatives": sql.NEGATIVES,
    }
