"""A corpus pipeline of five stages: each reads its predecessor's documents, and its decisions take effect."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import exact, jaccard, packing, pii, quality
from millrace.llm.common import discard, located, made, shared_folder, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the classifier's threshold go; it learns from the labels of this stage's documents.

    A null text is scored as an empty one and stays null; every row is scored by itself, rows that come twice or share a doc_id too; a null doc_id has no label; with no
    labels at all every score is the same. Columns stay as they are, whatever their names; an empty table gives no rows.
    """
    docs, place = located(docs)
    scored = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=(place,))
    good = scored.filter(F.col("score") >= quality.THRESHOLD).select(place)
    return docs.join(good.hint("merge"), place, "left_semi").drop(place)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays.

    Null and empty texts are equal; of rows that share text and doc_id the one latest in the files stays; a row with a null doc_id stays only if no other has its text. Columns stay as they are; an empty table
    gives no rows.
    """
    return exact.kept_rows(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similarity 0.8 or more join, the one with the least doc_id stays.

    Texts without words (null, empty, white space) are one group; a null doc_id is below all others; of rows that share the least doc_id the one first in the files stays. Columns stay as they
    are; an empty table gives no rows.
    """
    docs, place = located(docs)
    group = jaccard.jaccard_join(docs, carry=(place,))
    first = group.groupBy("label").agg(F.min(F.struct("doc_id", place)).alias("stay")).select(F.col("stay")[place].alias(place))
    return docs.join(first.hint("merge"), place, "left_semi").drop(place)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind.

    Every row stays, repeated ones and those without a doc_id too; a null text stays null and an empty one empty. Columns stay as they are, but for n_chars (a number of the table's own), which is set right; an empty
    table gives no rows.
    """
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: where each piece of each document lies.

    A null or empty text is one piece of one token, its end; rows that come twice or share a doc_id have pieces of their own; a null doc_id is a document like others. The columns are those of the packing alone;
    an empty table gives no rows.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), carry={"ids_crc32": F.crc32("ids")})


STAGES = [("quality classifier", quality_stage), ("exact dedup", exact_dedup_stage), ("n-gram Jaccard join", near_dedup_stage), ("PII", pii_stage), ("best-fit packing", packing_stage)]

#: SQL can't express the classifier, the join, the field or the packing; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), ""
    for k, (_, stage) in enumerate(STAGES):
        before = made()
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            mine = [f for f in made() if f not in before]
            old, folder = folder, shared_folder(spark)
            docs = written(docs, folder)
            discard(spark, mine + ([old] if old else []))  # what this stage made on its way, and what it read
    return docs
