"""The training-data pipeline: each stage calls one operator on the documents its predecessor kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import crf_quality, jaccard_join, suffix_array_dedup, toxicity
from tidemark.llm import packing as best_fit
from tidemark.llm.common import prepare, shared_dir, stored, table


def _judged(docs: DataFrame, score: Callable[[DataFrame], DataFrame], kept: str) -> DataFrame:
    """The rows of docs that `score` keeps, as they are: it sees their texts, and its own columns replace none of theirs."""
    columns = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    return score(docs.select(columns.alias("__doc"), F.col("text").alias("__text"))).where(kept).select("__doc.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null and empty texts have no bad line and are accepted. Rows are judged one by one, so rows that repeat an id or a text
    and null ids stay or go each on its own; columns of any name stay as they are; an empty table stays empty. Where the
    labels show one class only, or none, nothing can be told apart and all stay.
    """
    prepare(spark)
    model = crf_quality.fit(docs, table(spark, sf_dir, "labels"))
    if model.crf is None:
        return docs
    return _judged(docs, lambda df: crf_quality.score(df, model, text_col="__text"), "predicted = 1")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without toxic passages.

    Null and empty texts have none. Rows are judged one by one, as in the stage before; without toxic labels all stay.
    """
    prepare(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _judged(docs, lambda df: toxicity.score(df, model, text_col="__text"), "predicted = 0")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five-word shingles, similarity of 0.8): the one with the smallest id.

    Ids may repeat or be null: a null id comes after all others, and of rows with the same id the first one read stays.
    Null texts and those without words all stay; columns of any name stay as they are; an empty table stays empty.
    """
    prepare(spark)
    columns = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = stored(docs.select(columns.alias("doc"), "text", F.monotonically_increasing_id().alias("row")), "rows")
    groups = jaccard_join.near_duplicates(rows, least=80, size=5, id_col="row").select("row", "component_id")
    groups = stored(groups.join(rows.select("row", "doc.doc_id"), "row"), "groups")
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("first"))
    gone = groups.select("row").join(first.select("first.row"), "row", "left_anti")
    return rows.join(gone, "row", "left_anti").select("doc.*")


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the byte strings of 50 or more that an earlier document has.

    A null text stays null. Rows that repeat an id are not earlier than each other, null ids come after all others; n_chars, if
    there is one, is counted anew, other columns stay as they are; an empty table stays empty.
    """
    prepare(spark)
    kept = suffix_array_dedup.kept_texts(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*(f"`{c}`" for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 4096 tokens; null and empty texts are one piece of one token."""
    import public_tokenizers

    prepare(spark)
    return best_fit.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("toxicity", toxic), ("near duplicates", near_duplicates), ("repeated strings", repeated_strings), ("packing", packing)]
#: Classifiers and suffix arrays are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/stage-{name.replace(" ", "-")}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
