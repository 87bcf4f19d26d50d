"""The corpus pipeline: toxic documents go, one document of each near-duplicate group stays, repeated units and benchmark
passages go from the texts, and what is left is encoded.

STAGES lists the steps; each takes (spark, docs, sf_dir), works on all that the step before kept, and is written as
Parquet and read again before the next one. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.llm import bpe, decontaminate, forest, lines, toxicity
from tidewire.llm.common import staged, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5.

    Null, empty and blank texts score as without evidence, and stay; repeated rows are judged alike, each for itself; without
    labels of both kinds all rows stay; an empty table stays empty. Ids that are no whole numbers are an error, in each stage."""
    return toxicity.keep_clean(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked documents: that of the least doc_id, null ones last, then of the least text hash.

    Of rows that repeat this doc_id and text the least by the other columns stays, of wholly equal rows any one. Null, empty and
    word-free texts are linked to nothing: all of them stay, repeated ones too. An empty table stays empty."""
    docs = docs.select(*COLUMNS)
    kept = forest.survivors(docs).select(F.col("doc_id").alias("_kept"), F.col("th").alias("_found"), "alone")
    rows = docs.withColumn("_th", F.xxhash64(F.col("text").cast("string")))
    rows = rows.join(kept, rows["doc_id"].cast("long").eqNullSafe(kept["_kept"]) & (rows["_th"] == kept["_found"]))
    rows = rows.withColumn("_each", F.when(F.col("alone"), F.monotonically_increasing_id()))
    order = [c for c in COLUMNS if c not in ("doc_id", "text")]
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "_th", "_each").orderBy(*order))).filter("_n = 1").select(*COLUMNS)


def drop_repeated_units(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines, and the runs of 20 words or more of sentences, that an earlier document or line has: earlier by doc_id, null first, then by place in the text.

    All rows stay, with what is left of their text; null and empty texts stay as they are; rows that repeat a doc_id and text keep alike
    what that document keeps. An empty table stays empty."""
    return lines.remove(docs.select(*COLUMNS), run=lines.RUN)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents of which more than half of the words stand in such passages go.

    Null, empty and word-free texts have no passages, and stay; so do all rows, untouched, with an empty benchmark. Repeated rows are
    treated alike, each for itself. An empty table stays empty."""
    return decontaminate.strip(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and digests of the ids and of the text that they decode to, a row for each row; null and empty texts have no ids."""
    return bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("repeated_units", drop_repeated_units), ("decontamination", drop_benchmark), ("bpe", encode)]

#: A trained field, hashed signatures and byte-pair merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs
