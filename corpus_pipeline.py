"""A corpus pipeline: quality rules, near duplicates, repeated passages, packing.

Each stage works on all rows that the one before it kept, and all but the last return the columns of their input,
whatever these are called. Awkward rows are those of the operators: see the stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm import ngram_join, packing, quality, suffix_dedup
from weftline.llm.common import free_name, mark, materialize, release_since, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive rules keep. Null and empty texts fail the base rule and go; null languages and sources are groups; repeated rows are judged one by one; an empty table stays empty."""
    return quality.apply_rules(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each class of near duplicates.

    Of rows with one id and one text (repeated rows) one stays. A document without an id goes if its class holds one
    with an id, else one of each text stays; texts without words are in no class and stay; an empty table stays empty.
    """
    found = ngram_join.join(docs)
    names = [free_name(n, docs.columns) for n in ("_id", "_key", "_goes", "_copies", "_turn")]
    row_id, key, goes, copies, turn = names
    # An id below all others stands for none: joins and windows then deal rows by the same two columns.
    known = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    leaves = F.coalesce(F.col("class_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("class_id")), F.lit(False))
    verdicts = found.groupBy(known.alias(row_id), F.col("thash").alias(key)).agg(F.max(leaves).alias(goes), F.max("copies").alias(copies))
    keyed = docs.withColumn(row_id, known).withColumn(key, F.xxhash64("text"))
    judged = keyed.join(verdicts, [row_id, key]).where(~F.col(goes))
    judged = judged.withColumn(turn, F.row_number().over(Window.partitionBy(row_id, key).orderBy(key)))
    return judged.where((F.col(copies) == 1) | (F.col(turn) == 1)).select(*docs.columns)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what an earlier document has, of any length; documents of which nothing is left go. Null texts and documents without an id stay as they are; an empty table stays empty."""
    count = free_name("n_removed", docs.columns)
    left = suffix_dedup.remove_repeats(docs, texts=True, count_as=count)
    kept = left.where((F.col(count) == 0) | (F.trim(F.col("text")) != ""))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col(count) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences. Null and empty texts are their closing id; repeated rows and null ids are packed like others; an empty table gives none."""
    return packing.pack(docs)


STAGES = [("quality rules", quality_stage), ("n-gram Jaccard join", near_duplicate_stage), ("suffix-array dedup", repeats_stage), ("packing", packing_stage)]

#: Near duplicates, byte-wise repeats and tokenization can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        at = mark()
        docs = materialize(stage(spark, docs, sf_dir), "pipeline")
        release_since(at, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
