"""One query for each operator over its whole table, with the parameters meant for production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import audit, collocations, encoding, langid, lm, minhash, packing, quality, relative, suffix, tokencount, toxicity, vectors
from faultline.llm import sql
from faultline.llm.common import fold, table


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold("doc_id", 3) == 1)
    model = langid.learn(docs.where("NOT held_out"))
    return langid.predict(docs, model, also=("held_out",))


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.strip(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.digests(table(spark, sf_dir, "documents"), word_tokenizer())


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold("doc_id", 5) == 0)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    index = toxicity.learn(docs, labels, "crc32(cast(doc_id AS string)) % 5 = 0")
    return toxicity.predict(docs, index, also=("held_out",))


def op6_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_texts(table(spark, sf_dir, "documents"))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm.score(docs.withColumn("held_out", fold("doc_id", 5) == 1), "held_out")


def op9_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relative.strip(table(spark, sf_dir, "documents")).drop("kept_text")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_tokenizer())


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencount.counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_langid": op2_langid,
    "op3_suffix": op3_suffix,
    "op4_bpe": op4_bpe,
    "op5_toxicity": op5_toxicity,
    "op6_vectors": op6_vectors,
    "op7_minhash": op7_minhash,
    "op8_lm": op8_lm,
    "op9_relative": op9_relative,
    "op10_packing": op10_packing,
    "op11_collocations": op11_collocations,
    "op12_token_counts": op12_token_counts,
    "op13_audit": op13_audit,
}
ORACLE_SQL: dict[str, str] = {"op1_quality": sql.QUALITY, "op11_collocations": sql.COLLOCATIONS, "op13_audit": sql.AUDIT}
