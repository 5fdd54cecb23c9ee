"""The stages of corpus_pipeline.py: an operator's verdict applied to documents, whose columns stay as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import langid, minhash, quality, suffix
from faultline.llm import packing as _packing
from faultline.llm.anchors import filter_of
from faultline.llm.common import fresh, importable, materialize, small_batches
from faultline.llm.queries import word_tokenizer


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the languages that the documents name; all of them if they name none."""
    _ready(spark)
    model = langid.learn(docs)
    if not model[0]:
        return docs
    found = langid.predict(docs.select(F.struct("*").alias("doc")), model, key="doc", text="doc.text")
    sure = (F.length("doc.text") < langid.LONG) | (F.col("score") >= langid.LEAST)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & sure).select("doc.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their boilerplate lines."""
    return _counted(quality.cleaned(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: one with the smallest doc_id.

    Null texts, texts without a word and rows without a doc_id stay. Rows of one doc_id are judged each by its own text;
    of those that are alike one stays. An empty table stays empty; all columns are returned.
    """
    _ready(spark)
    found = materialize(minhash.near_texts(docs))
    mark = fresh("text_id", docs.columns)
    gone = materialize(found.where("NOT kept").select("doc_id", F.col("text_id").alias(mark)).distinct())
    # the filter is asked where the texts lie, so only texts that may be gone are shuffled
    hit = filter_of(gone, F.col("doc_id"), F.col(mark))(F.col("doc_id").cast("long"), F.col(mark))
    marked = docs.withColumn(mark, F.xxhash64("text"))
    left = marked.where(~hit).unionAll(marked.where(hit).join(gone, ["doc_id", mark], "left_anti").select(*marked.columns))
    # ids that several of the rows left have, which are few: one row of each class stays
    group = fresh("class_hash", docs.columns)
    kept = found.where("kept AND class_hash IS NOT NULL").select("doc_id", F.col("text_id").alias(mark), F.col("class_hash").alias(group))
    several = materialize(kept.groupBy("doc_id", group).agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    repeated = materialize(kept.join(several, ["doc_id", group]).distinct())
    if repeated.isEmpty():
        return left.select(*docs.columns)
    once = left.join(repeated, ["doc_id", mark], "left_anti")
    again = left.join(repeated, ["doc_id", mark]).dropDuplicates(["doc_id", group])
    return once.select(*docs.columns).unionAll(again.select(*docs.columns))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings that documents before them hold; one may be left empty."""
    _ready(spark)
    return _counted(suffix.stripped(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in token sequences."""
    _ready(spark)
    return _packing.pack(docs, word_tokenizer())


def _ready(spark: SparkSession) -> None:
    importable(spark)
    small_batches(spark)


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs
