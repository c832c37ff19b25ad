"""Exact deduplication: groups by a 128-bit content hash, bytes compared inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veclens.session import stage

from . import query
from .texts import documents, whole, without_white


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text", *, key: Column | None = None) -> DataFrame:
    """Every row's group of texts that are equal when white space is deleted.

    Returns ``id_column, keep_id, group_size, kept, text_sha256``. Of a group
    the row with the most code points in the original text stays, then the
    smallest id. A null text counts as empty, and empty texts are one group.
    Each row counts, also rows that repeat an id (all rows of the id that stays
    are then kept); a null id loses to any other. An empty table gives no rows;
    only the two named columns are read, so others may have any name.

    Rows are grouped by the md5 of the normalised bytes (``key`` replaces it in
    tests). The bytes under a key are compared by their least and greatest: a
    task sends two texts for each key that it has, so copies collapse before the
    only exchange that carries texts, and a large group is a few rows per task.
    Keys whose least and greatest differ are grouped again by the bytes
    themselves. Rows learn of their group from a staged table of the groups of
    two or more, so Spark can split the rows of a large group over tasks.
    """
    plain = without_white(text)
    rows = stage(
        docs.select(
            F.col(id_column).alias("doc_id"),
            F.length(whole(text)).alias("n"),
            (F.md5(plain) if key is None else key).alias("h"),
            F.sha2(plain, 256).alias("text_sha256"),
        ),
        "exact-rows",
    )

    def groups(df: DataFrame, *by: str) -> DataFrame:
        # the row that stays: most code points, then the smallest id
        best = F.min_by("doc_id", F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id"))
        return df.groupBy(*by).agg(best.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))

    several = stage(groups(rows, "h").where("group_size > 1"), "exact-groups")

    def named(df: DataFrame) -> DataFrame:
        one = F.col("group_size").isNull()
        return df.join(several, "h", "left").withColumns({
            "keep_id": F.when(one, F.col("doc_id")).otherwise(F.col("keep_id")),
            "group_size": F.when(one, F.lit(1).cast("bigint")).otherwise(F.col("group_size")),
        })

    bytes_of = docs.select(
        F.col(id_column).alias("doc_id"), (F.md5(plain) if key is None else key).alias("h"), plain.alias("bytes")
    )
    ends = bytes_of.groupBy("h").agg(F.min("bytes").alias("least"), F.max("bytes").alias("greatest"))
    differing = stage(ends.where("least < greatest").select("h"), "collisions")
    if differing.isEmpty():
        result = named(rows)
    else:
        apart = bytes_of.join(differing, "h", "left_semi").select("doc_id", "bytes").distinct()
        apart = apart.select(F.col("doc_id").alias("_id"), "bytes", F.sha2("bytes", 256).alias("_sha"))
        again = rows.join(differing, "h", "left_semi")
        again = again.join(apart, again.doc_id.eqNullSafe(apart._id) & (again.text_sha256 == apart._sha)).drop("_id", "_sha")
        exact = again.join(groups(again, "h", "bytes"), ["h", "bytes"]).drop("bytes")
        result = named(rows.join(differing, "h", "left_anti")).unionByName(exact)
    return result.select(
        F.col("doc_id").alias(id_column),
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY t) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""


@query("op2_exact_dedup", SQL)
def op2_exact_dedup(spark, sf_dir):
    return exact_groups(documents(spark, sf_dir))
