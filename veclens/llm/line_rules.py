"""Quality rules: repetition inside a text, and lines that many documents of a host share.

Only DataFrame functions; no Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veclens.session import stage

from . import query
from .texts import WORD, documents, n_words, whole, without_white

SYMBOLS = "#*$%&|<>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def repeated_words(df: DataFrame, words: str, name: str) -> DataFrame:
    """Adds how many words stand in 3-word windows that occur twice or more in the row.

    ``words`` is an array of word hashes. Most rows have no such window: a set
    of plain numbers shows that, and only the others sort positions.
    """
    windows = df.withColumn(
        "_w",
        F.expr(f"CASE WHEN size({words}) > 3 THEN transform(sequence(0, size({words}) - 3), "
               f"i -> xxhash64({words}[i], {words}[i + 1], {words}[i + 2])) END"),
    )
    twice = windows.withColumn("_any", F.expr("size(array_distinct(_w)) < size(_w)"))
    placed = twice.withColumn(
        "_p", F.expr("CASE WHEN _any THEN array_sort(transform(_w, (h, i) -> struct(h, i))) END")
    ).withColumn(
        "_p",
        F.expr("CASE WHEN _any THEN array_sort(transform(filter(transform(_p, (x, j) -> "
               "struct(x.i AS i, (get(_p, j - 1).h <=> x.h) OR (get(_p, j + 1).h <=> x.h) AS hit)), y -> y.hit), y -> y.i)) END"),
    )
    count = F.expr("coalesce(aggregate(_p, struct(0L AS n, -3 AS last), "
                   "(a, i) -> struct(a.n + least(3, i - a.last) AS n, i AS last), a -> a.n), 0L)")
    return placed.withColumn(name, count).drop("_w", "_any", "_p")


def base_counts(docs: DataFrame, id_column: str, text: str, host: str) -> DataFrame:
    """One row per document with its counts and ``lines``: hash and words of each line with a word."""
    body = whole(text)
    white = r"[\x20\x09-\x0D]+"
    small = F.translate(body, UPPER, LOWER)
    read = docs.select(
        F.col(id_column).alias("id"),
        F.col(host).alias("host"),
        n_words(text).alias("n_words"),
        F.length(without_white(text)).cast("bigint").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.transform(F.regexp_extract_all(body, F.lit(f"({WORD})")), lambda w: F.xxhash64(w)).alias("words"),
        F.transform(
            F.filter(F.split(body, "\n"), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]"))),
            lambda line: F.xxhash64(line),
        ).alias("plain_lines"),
        F.transform(
            F.filter(F.split(small, "\n"), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]"))),
            lambda line: F.struct(
                F.xxhash64(F.trim(F.regexp_replace(line, white, " "))).alias("h"),
                F.regexp_count(line, F.lit(WORD)).alias("words"),
            ),
        ).alias("lines"),
    )
    return repeated_words(read, "words", "n_repeat_words").select(
        "id", "host", "n_words", "word_chars", "n_symbols",
        (F.size("plain_lines") - F.size(F.array_distinct("plain_lines"))).cast("bigint").alias("n_dup_lines"),
        "n_repeat_words", "lines",
    )


def line_rules(
    docs: DataFrame,
    *,
    max_docs: int = 100,
    least_docs: int = 3,
    max_percent: int = 1,
    min_left: int = 50,
    id_column: str = "doc_id",
    text: str = "text",
    host: str = "source",
) -> DataFrame:
    """Counts of each text, and whether it stands without its host's common lines.

    Lines are normalised (A-Z lowered, white space runs to one space, trimmed)
    and hashed. A line is removed where it stands in more distinct documents of
    one host than the host's limit: ``max_percent`` of the host's documents, but
    ``least_docs`` for small hosts and never over ``max_docs``. A document that
    keeps less than ``min_left`` percent of its words is rejected.
    ``base_failed`` marks texts of under 50 words or with more than half their
    words in repeated 3-word windows.

    A null text has no words, null is a host of its own, rows that repeat an id
    are documents of their own, an empty table gives no rows, and columns other
    than the three named are not read.

    The counts are staged once, so text is scanned once. Lines are counted with
    partial sums per task, so a line of every document costs one row per task;
    lines above ``least_docs`` meet the limits, one row per host, and only
    occurrences of lines above the limit are summed per document.
    """
    counted = stage(
        base_counts(docs, id_column, text, host).withColumn("row", F.monotonically_increasing_id()), "line-rules"
    )
    name = F.when(F.col("host").isNull(), F.lit(0)).otherwise(F.xxhash64(F.lit(1), "host"))
    lines = counted.select("row", name.alias("host"), F.explode("lines").alias("line")).select(
        "row", "host", F.col("line.h").alias("h"), F.col("line.words").alias("words")
    )
    distinct = counted.select(name.alias("host"), F.explode(F.array_distinct(F.col("lines.h"))).alias("h"))
    share = F.floor(F.count(F.lit(1)) * max_percent / 100)
    limit = F.least(F.lit(max_docs), F.greatest(F.lit(least_docs), share))
    limits = stage(counted.groupBy(name.alias("host")).agg(limit.alias("limit")), "line-limits")
    often = distinct.groupBy("host", "h").count().where(F.col("count") > min(least_docs, max_docs))
    common = often.join(limits, "host").where(F.col("count") > F.col("limit")).select("host", "h")
    removed = lines.join(common, ["host", "h"], "left_semi").groupBy("row").agg(F.sum("words").alias("cut"))
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    cut = F.coalesce("cut", F.lit(0))
    return (
        counted.drop("lines")
        .join(removed, "row", "left")
        .select(
            F.col("id").alias(id_column),
            "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            base_failed.alias("base_failed"),
            (~base_failed & (100 * (F.col("n_words") - cut) >= min_left * F.col("n_words"))).alias("kept"),
            cut.cast("bigint").alias("n_common_words"),
        )
    )


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT row, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), g AS (
  SELECT row, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT row, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), p AS (
  SELECT row, i FROM g QUALIFY count(*) OVER (PARTITION BY row, g) > 1
), r AS (
  SELECT row, CAST(sum(least(3, i - before)) AS BIGINT) AS n
  FROM (SELECT row, i, coalesce(lag(i) OVER (PARTITION BY row ORDER BY i), -9) AS before FROM p) GROUP BY row
), l AS (
  SELECT row, source, trim(regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+', ' ', 'g')) AS h, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT row, source, unnest(lines) AS x FROM w)
), s AS (
  SELECT source, least(100, greatest(3, count(*) // 100)) AS most FROM documents GROUP BY source
), c AS (
  SELECT row, sum(n) AS cut FROM (
    SELECT l.row, l.n FROM l JOIN (
      SELECT k.source, k.h FROM (
        SELECT source, h, count(*) AS n_docs FROM (SELECT DISTINCT row, source, h FROM l) GROUP BY 1, 2
      ) k JOIN s ON k.source IS NOT DISTINCT FROM s.source WHERE n_docs > most
    ) o ON l.source IS NOT DISTINCT FROM o.source AND l.h = o.h)
  GROUP BY row
), b AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         coalesce(r.n, 0) AS n_repeat_words, CAST(coalesce(cut, 0) AS BIGINT) AS n_common_words
  FROM w LEFT JOIN r USING (row) LEFT JOIN c USING (row)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
       AND 100 * (n_words - n_common_words) >= 50 * n_words AS kept
FROM b
"""


@query("op10_line_rules", SQL)
def op10_line_rules(spark, sf_dir):
    return line_rules(documents(spark, sf_dir))
