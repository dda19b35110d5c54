"""The queries of this subpackage: one for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chatformat, decontaminate, jaccard, lexical, mixing, packing, pii, pitman_yor, quality, substring, tandem, tokencount, toxicity
from .common import SPACE, text_of

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(mod: int):
    return F.crc32(F.col("doc_id").cast("string")) % mod


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(remainder(5) == 0, F.lit(False))
    out = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), train=~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted", "evidence")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(remainder(7) == 2, F.lit(False))
    out = pitman_yor.score(table(spark, sf_dir, "documents"), train=~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = chatformat.of_table(table(spark, sf_dir, "conversations"))
    return chatformat.digests(chatformat.format_chats(records, "conv_id", "turn"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.similar_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)
    return out.select("doc_id", "n_shingles", "component_id")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # only this query needs its vocabulary

    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.substring_dedup(table(spark, sf_dir, "documents"), min_words=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # as in op9

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth document, by its id's CRC-32, repeats its words from one on."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    crc = F.crc32(F.col("doc_id").cast("string"))
    docs = docs.select("doc_id", "text", F.floor(crc / 10).alias("g"), F.when(crc % 10 == 0, F.filter(F.split(text_of("text"), SPACE), lambda x: x != "")).alias("w"))
    docs = docs.withColumn("a", F.when(F.size("w") > 0, F.col("g") % F.size("w")))
    docs = docs.withColumn("p", 1 + F.floor((F.size("w") - F.col("a")) / (3 + F.col("g") % 8)))
    again = F.transform("w", lambda x, i: F.when(i >= F.col("a"), F.element_at("w", (F.col("a") + (i - F.col("a")) % F.col("p") + 1).cast("int"))).otherwise(x))
    docs = docs.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))
    runs = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return tandem.periodic_runs(docs).select("doc_id", "n_runs", "start", "length", "period", F.floor(1000 * F.col("length") / F.col("period")).alias("exponent_milli"), F.sha2(runs, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def queries() -> dict[str, Query]:
    return {"op1_score_toxicity": op1, "op2_score_language": op2, "op3_find_contamination": op3, "op4_mix_sources": op4, "op5_format_chats": op5, "op6_quality_rules": op6, "op7_join_similar": op7, "op8_find_personal_data": op8, "op9_token_counts": op9, "op10_substring_dedup": op10, "op11_pack_sequences": op11, "op12_ranked_search": op12, "op13_periodic_runs": op13}


def oracle_sql() -> dict[str, str]:
    return {"op4_mix_sources": mixing.ORACLE, "op5_format_chats": chatformat.ORACLE, "op6_quality_rules": quality.ORACLE, "op7_join_similar": jaccard.ORACLE, "op10_substring_dedup": substring.ORACLE, "op12_ranked_search": lexical.ORACLE, "op13_periodic_runs": tandem.ORACLE}
