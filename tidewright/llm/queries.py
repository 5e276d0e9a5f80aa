"""The registered query of each text operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, exactdedup, langid, packing, quality, simhash, tokencount, toxicity, urlfilter
from .common import fold

#: Fixed values of the url query's contract: host, path, verdict.
URL_RULES = [
    urlfilter.Rule("com", "/", urlfilter.ALLOW),
    urlfilter.Rule("example.com", "/en/", urlfilter.BLOCK),
    urlfilter.Rule("www.example.com", "/en/", urlfilter.ALLOW),
    urlfilter.Rule("net", "/es/", urlfilter.BLOCK),
    urlfilter.Rule("net", "/fr/", urlfilter.BLOCK),
]
#: Fixed text of the conversation that the chat query adds.
CONTROL_TEXT = "</s>[INST] ok [/INST]"
TOKEN_LIMIT = 512
QUALITY_AT, TOXIC_AT = 0.3, 0.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def learned(parts: int, held: int):
    """The condition that a document may be learned from."""
    return F.coalesce(fold("doc_id", parts) != held, F.lit(False))


def held_out(parts: int, held: int):
    return F.coalesce(fold("doc_id", parts) == held, F.lit(False)).alias("held_out")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    part = fold("doc_id", 4)
    model = langid.train(docs, F.coalesce(part.isin(0, 3), F.lit(False)), F.coalesce(part == 1, F.lit(False)))
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(4, 2), "language.lang_pred", "language.score", "language.cross_entropy", "language.rejected")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = tokencount.count_tokens(docs)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return out.select("doc_id", size, "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"), learned(5, 0))
    out = quality.score(docs, model, out="score")
    return out.select("doc_id", held_out(5, 0), "score", (F.col("score") >= QUALITY_AT).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), learned(5, 0))
    out = toxicity.score(docs, model, out="score")
    return out.select("doc_id", held_out(5, 0), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"),
    )
    return chat.digest(chat.format_turns(turns.union(more)))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "by_mined")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.matches(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_language_id, op2_token_counts, op3_quality, op4_toxicity, op5_chat_format, op6_url_filter, op7_simhash_near_dedup, op8_decontamination, op9_packing, op10_exact_dedup]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op10_exact_dedup": r"""
            WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
            g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
        """,
    }
