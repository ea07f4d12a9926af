"""The corpus pipeline: language ID, exact dedup, near dedup, secret scan, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All stages but the last
return the columns of documents; each result is written as Parquet and read again as the next one's docs.
Extra columns of any name stay with their rows; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import _common, exact_dedup, language_id, near_dedup, packing, secret_scan
from netloom.plans.tables import work_dir, written


def _filtered(docs: DataFrame, decided: DataFrame, grouped) -> DataFrame:
    """docs without the rows that `decided` (_tag, kept) drops, one copy of each repeated row.

    Rows are told apart by 128 bits of identifier and text; of rows that agree in both, the least in the other
    columns stays. Only rows of groups, which a filter finds, are shuffled with their texts.
    """
    where = work_dir(docs.sparkSession)
    decided = written(decided.where(grouped).select("_tag", "kept"), f"{where}/decided")
    tag, maybe = _common.free_name(docs, "_tag"), _common.free_name(docs, "_maybe")
    filtered = exact_dedup.DigestFilter(decided, "_tag", f"{where}/filter")
    flagged = filtered.flag(docs.withColumn(tag, _common.row_tag(docs)), tag, maybe)
    rest = flagged.where(maybe).join(decided.where(~F.col("kept")).select(F.col("_tag").alias(tag)).distinct(), tag, "left_anti")
    one = rest.groupBy(tag).agg(F.min(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias(maybe)).select(f"{maybe}.*")
    return flagged.where(~F.col(maybe)).select(*docs.columns).unionByName(one)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID rejects go: null or letterless texts, and scores below the calibrated one."""
    return language_id.accepted(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased, null is empty) the row with the largest identifier stays; null is least."""
    return _filtered(docs, exact_dedup.exact_dedup(docs, tag=_common.row_tag(docs)), F.col("group_size") > 1)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (shingles of five words, similarity 0.8) stays: that of the
    least identifier. Texts without words are near to nothing and stay."""
    return _filtered(docs, near_dedup.near_dedup(docs, width=5, percent=80, tag=_common.row_tag(docs)), ~F.col("kept"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts, and n_chars follows; every row stays, null texts stay null."""
    clean = secret_scan.without_secrets(docs)
    if "n_chars" in docs.columns:
        changed = F.when(F.col("text").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        clean = clean.withColumn("n_chars", changed)
    return clean.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, with the checksum of their ids; each row, null texts too, is a document."""
    return packing.with_digest(packing.pack_documents(docs, keep_words=False))


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("secret_scan", secret_stage),
    ("packing", packing_stage),
]

#: A trained model decides in the first stage; SQL can't express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    where = work_dir(spark)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"{where}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
