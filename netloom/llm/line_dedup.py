"""Line dedup over levelled sorted runs of line hashes.

Every text is split at \\n. A line's key is the line without white space at both ends, A-Z lower-cased.
Documents come in batches of descending identifiers. A batch aggregates its keys and merge-anti-joins the
runs: keys that no run has get this batch's largest document as their owner, known keys only add to the
count of documents. Each batch adds its own sorted run; runs are compacted level by level. Keys of enough
documents then lose all their lines but those in the owner, the largest identifier that holds them.

Keys travel as two 64-bit hashes. Defined results: null text is one empty line; a null identifier is
smaller than any other; rows repeating an identifier count as one document and all get an output row;
an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common
from .lsm import LevelledRuns

#: The six characters that are stripped.
SPACE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return _common.ascii_lower(F.btrim(line, F.lit(SPACE)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def duplicate_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int, batches: int) -> DataFrame:
    """(_id, _text_hash, _drop array of line numbers) of the rows that lose lines."""
    spark = docs.sparkSession
    where = _common.work_dir(spark)
    lines = (
        docs.select(_common.row_key(id_col).alias("_id"), F.xxhash64(text_col).alias("_text_hash"), _lines(F.col(text_col)).alias("_lines"))
        .select("_id", "_text_hash", F.posexplode("_lines").alias("_at", "_line"))
        .withColumn("_key", line_key(F.col("_line")))
        .where(F.char_length("_key") >= min_chars)
        .select("_id", "_text_hash", "_at", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(7), "_key").alias("_h2"))
    )
    lines = _common.written(lines, f"{where}/lines")

    # Batches of about equal size; where the cuts fall changes no result.
    cuts = docs.select(F.percentile_approx(_common.row_key(id_col), [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    bounds = [None, *sorted(set(cuts)), None]
    runs = LevelledRuns(spark, ["_h1", "_h2"], {"_owner": F.max("_owner"), "_n": F.sum("_n")})
    for low, high in reversed(list(zip(bounds, bounds[1:]))):
        part = lines
        part = part if low is None else part.where(F.col("_id") > low)
        part = part if high is None else part.where(F.col("_id") <= high)
        # Two steps of counting keep a line that fills one document or one that fills all apart.
        keys = part.groupBy("_h1", "_h2", "_id").agg(F.lit(1).alias("_one")).groupBy("_h1", "_h2").agg(F.max("_id").alias("_owner"), F.count("*").alias("_n"))
        live = runs.live()
        if live:
            known = reduce(DataFrame.unionByName, [r.rows.select("_h1", "_h2") for r in live]).distinct().withColumn("_known", F.lit(True))
            keys = keys.join(known, ["_h1", "_h2"], "left").withColumn("_owner", F.when(F.col("_known").isNull(), F.col("_owner"))).drop("_known")
        runs.add(keys)

    common = runs.merged().where(F.col("_n") >= min_docs).select("_h1", "_h2", "_owner")
    losing = lines.join(common, ["_h1", "_h2"]).where(F.col("_id") != F.col("_owner"))
    return losing.groupBy("_id", "_text_hash").agg(F.collect_set("_at").alias("_drop"))


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, batches: int = 4
) -> DataFrame:
    """The input with text_col rewritten, and n_lines and n_dropped (long) of each row.

    Columns of the input named n_lines or n_dropped are replaced; all others stay, whatever their names.
    """
    _common.check_id(docs, id_col)
    drops = duplicate_lines(docs, id_col, text_col, min_chars, min_docs, batches)
    own = {n: _common.free_name(docs, n) for n in ("_id", "_text_hash", "_drop", "_lines")}
    keyed = docs.withColumns({own["_id"]: _common.row_key(id_col), own["_text_hash"]: F.xxhash64(text_col)})
    # The drop lists are the small side of each partition; the texts are neither sorted nor broadcast.
    drops = drops.select(*(F.col(n).alias(own[n]) for n in ("_id", "_text_hash", "_drop")))
    found = keyed.join(drops.hint("shuffle_hash"), [own["_id"], own["_text_hash"]], "left")
    lines, drop = F.col(own["_lines"]), F.col(own["_drop"])
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop), lambda i: F.get(lines, i))
    return (
        found.withColumn(own["_lines"], _lines(F.col(text_col)))
        .withColumns({
            "n_lines": F.size(lines).cast("long"),
            "n_dropped": F.when(drop.isNull(), 0).otherwise(F.size(drop)).cast("long"),
            text_col: F.when(drop.isNull(), F.coalesce(text_col, F.lit(""))).otherwise(F.array_join(left, "\n")),
        })
        .drop(*own.values())
    )


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP2_SQL = """
WITH l AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
c AS (SELECT k, max(doc_id) AS owner FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT l.doc_id, i, line, c.k IS NOT NULL AND c.owner <> l.doc_id AS gone FROM l LEFT JOIN c ON l.k = c.k)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
