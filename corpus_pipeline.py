"""The corpus pipeline: quality rules, near duplicates, secrets, source mixing, piece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents, whatever further columns docs has. A row's identity is its id, text, language and
source, so rows with null or repeated ids are judged each by its own contents; rows that are equal
in all of these are one document. After mixing, a document stands there as often as the mix takes
it. Empty input gives an empty result of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.llm.jaccard import jaccard_components
from webloom.llm.mixing import pareto_mix
from webloom.llm.pieces import encode
from webloom.llm.quality_rules import judge_quality
from webloom.llm.secrets import mask_secrets

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keyed(docs: DataFrame) -> DataFrame:
    """The columns of documents and a hash of a row's contents."""
    return docs.select(*COLUMNS).withColumn("_key", F.xxhash64("doc_id", "text", "lang", "source"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts fail the base limits and go; null languages and sources are groups of
    their own; repeated rows stay or go together.
    """
    rows = _keyed(docs)
    kept = judge_quality(rows, id_col="_key").where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return rows.join(kept, F.col("_key") == F.col("_kept"), "left_semi").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, the document with the smallest id (null ids last; ties by content).

    Texts without words are linked with nothing and stay; of equal rows one stays.
    """
    rows = docs.select(*COLUMNS).withColumn("_key", F.xxhash64("doc_id", "text"))
    first = jaccard_components(rows).where("row_key = first_key").select(F.col("row_key").alias("_first")).distinct()
    return rows.join(first, F.col("_key") == F.col("_first"), "left_semi").dropDuplicates(["_key"]).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked; n_chars is that of the masked text. Null texts stay null."""
    return mask_secrets(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; documents without words count for nothing.

    A null source is a source of its own. Equal rows share the copies that the mix takes of them.
    """
    rows = _keyed(docs)
    mixed = pareto_mix(rows, id_col="_key")
    # equal rows have one key, so their copies are dealt anew among them
    taken = mixed.groupBy("doc_id").agg(F.sum("copies").alias("all"), F.count(F.lit(1)).alias("n")).where("all > 0").select(F.col("doc_id").alias("_taken"), F.col("all").alias("_all"), F.col("n").alias("_n"))
    each = rows.join(taken, F.col("_key") == F.col("_taken")).withColumn("_nth", F.when(F.col("_n") > 1, F.row_number().over(Window.partitionBy("_key").orderBy("n_chars"))).otherwise(1))
    copies = F.floor(F.col("_all") / F.col("_n")) + (F.col("_nth") <= F.col("_all") % F.col("_n")).cast("int")
    return each.withColumn("_copies", copies.cast("int")).where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*COLUMNS)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix; a null or empty text has none."""
    return encode(docs)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("piece_encoding", piece_encoding)]

#: The near-duplicate join and the estimates behind the quality rules have no plain SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; every stage's result is written, read by the next, and then deleted."""
    from webloom.llm.common import drop_stash, stash

    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
        if last is not None:
            drop_stash(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
