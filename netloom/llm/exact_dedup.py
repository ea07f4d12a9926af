"""Exact dedup over a log-structured index of text digests; DataFrame operations only.

Rows are split into memtables by a hash of their identifier. A memtable aggregates to one row a digest
(largest identifier, number of rows), asks the filters of the live runs which of its digests may be known,
looks up only those in the runs, and is flushed as a sorted run with a filter of its own, sized by its digests.
Runs are compacted level by level; compaction keeps the largest identifier. Digests with several rows are
verified on the bytes: their texts are grouped by (digest, text), so a hash collision splits into its texts.

Defined results: null text is empty text; a null identifier is smaller than any other and is returned as
null; rows repeating an identifier count as rows of their own; an empty table gives no rows; columns of
the input other than identifier and text are neither read nor returned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common
from .lsm import LevelledRuns

def normalised(text: Column) -> Column:
    return _common.ascii_lower(F.coalesce(text, F.lit("")))


class DigestFilter:
    """A Bloom filter of one hash function over a column: 16 bits for each key, a power of two of them, but
    BROADCAST_BITS at most, so that its bitmaps (4 KB each) may be broadcast. More keys than it serves well are
    not filtered at all: flag() then says that all may be there, which is right, if slower."""

    BROADCAST_BITS = 1 << 29

    def __init__(self, keys: DataFrame, column: str, path: str, bits: int | None = None):
        n = keys.count()
        self.bits = bits or min(self.BROADCAST_BITS, 1 << max(22, (16 * n).bit_length()))
        self.useful = 2 * n < self.bits
        self.path, bit = path, self._slot(column)
        if self.useful:
            at = keys.select(F.bitmap_bucket_number(bit).alias("_bucket"), F.bitmap_bit_position(bit).alias("_bit"))
            self.bitmap = _common.written(at.groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bitmap")), path)

    def _slot(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.bits))

    def flag(self, rows: DataFrame, column: str, name: str) -> DataFrame:
        """Adds whether the filter may hold the key."""
        if not self.useful:
            return rows.withColumn(name, F.lit(True))
        own = [_common.free_name(rows, x) for x in ("_bucket", "_bitmap")]
        bit = F.bitmap_bit_position(self._slot(column))
        byte = F.conv(F.hex(F.substring(F.col(own[1]), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        is_set = byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (bit % 8).cast("int"))) != 0
        joined = rows.withColumn(own[0], F.bitmap_bucket_number(self._slot(column))).join(F.broadcast(self.bitmap.toDF(*own)), own[0], "left")
        return joined.withColumn(name, F.coalesce(is_set, F.lit(False))).drop(*own)

    def maybe_in(self, rows: DataFrame, column: str) -> DataFrame:
        """The rows whose key the filter doesn't rule out."""
        name = _common.free_name(rows, "_maybe")
        return self.flag(rows, column, name).where(name).drop(name)


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    memtables: int = 4,
    digest: Column | None = None,
    tag: Column | None = None,
) -> DataFrame:
    """One row for each input row: identifier, keep_id, group_size, kept, text_sha256; and _tag if given.

    `digest` replaces SHA-256 of the normalised text `_norm` as the index key; a weak one is still right,
    as equal digests are verified on the texts.
    """
    spark = docs.sparkSession
    _common.check_id(docs, id_col)
    where = _common.work_dir(spark)
    norm = normalised(F.col(text_col))
    texts = docs.select(_common.row_key(id_col).alias("_id"), F.col(id_col).isNull().alias("_no_id"), norm.alias("_norm"), (tag if tag is not None else F.lit(None)).cast("binary").alias("_tag"))
    key = digest if digest is not None else F.unhex("_sha")
    rows = _common.written(
        texts.withColumn("_sha", F.sha2("_norm", 256))
        .select("_id", "_no_id", "_tag", F.unhex("_sha").alias("_sha"), key.cast("binary").alias("_digest"))
        .withColumn("_memtable", F.pmod(F.xxhash64("_id"), F.lit(memtables)).cast("int")),
        f"{where}/digests",
    )

    index = LevelledRuns(spark, ["_digest"], {"_keep": F.max("_keep"), "_n": F.sum("_n")}, filtered=True)
    hits: list[DataFrame] = []
    for i in range(memtables):
        table = rows.where(F.col("_memtable") == i).groupBy("_digest").agg(F.max("_id").alias("_keep"), F.count("*").alias("_n"))
        table = _common.written(table, f"{where}/memtable-{i}")
        again = [table.where("_n > 1").select("_digest"), *(run.probed(table.select("_digest")) for run in index.live())]
        hits.append(_common.written(reduce(DataFrame.unionByName, again).distinct(), f"{where}/hits-{i}"))
        index.add(table)

    known = reduce(DataFrame.unionByName, hits).distinct()
    suspects = _common.written(rows.join(known, "_digest", "left_semi").select("_id", "_digest"), f"{where}/suspects")
    # Byte verification: only rows whose identifier is a hit are read as texts again and normalised.
    raw = docs.select(_common.row_key(id_col).alias("_id"), F.col(text_col).alias("_text"))
    again = DigestFilter(suspects, "_id", f"{where}/suspect-filter").maybe_in(raw, "_id").withColumn("_norm", normalised(F.col("_text"))).drop("_text")
    again = again.withColumn("_sha", F.sha2("_norm", 256)).withColumn("_digest", key.cast("binary"))
    exact = again.join(suspects.distinct(), ["_id", "_digest"], "left_semi")
    variants = _common.written(
        exact.groupBy("_digest", "_norm").agg(F.max("_id").alias("_keep"), F.count("*").alias("_n")).withColumn("_sha", F.unhex(F.sha2("_norm", 256))).drop("_norm"),
        f"{where}/variants",
    )
    collided = variants.groupBy("_digest").agg(F.count("*").alias("_texts")).where("_texts > 1").select("_digest")

    groups = index.merged().join(collided, "_digest", "left_anti").where("_n > 1")
    groups = groups.select("_digest", "_keep", "_n", F.lit(None).cast("binary").alias("_of"))
    split = variants.join(collided, "_digest", "left_semi").select("_digest", "_keep", "_n", F.col("_sha").alias("_of"))
    # A digest is either whole in groups or split in variants, so a row meets one group at most.
    found = rows.join(groups.unionByName(split).withColumnRenamed("_digest", "_d"), (F.col("_digest") == F.col("_d")) & (F.col("_of").isNull() | (F.col("_of") == F.col("_sha"))), "left")
    keep = F.coalesce("_keep", "_id")
    return found.select(
        F.when(~F.col("_no_id"), F.col("_id")).alias(id_col),
        F.when(keep != _common.NULL_ID, keep).alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("_id") == keep).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
        *([F.col("_tag")] if tag is not None else []),
    )


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
