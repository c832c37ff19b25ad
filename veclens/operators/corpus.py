"""From a corpus table to one row per token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import has_folder, stage
from .ordering import BUCKET_DIGITS, running, seeded_rank

#: Tokens that are ranked together, a power of two, and frequent ones that are looked up from a broadcast.
RANK_BLOCK, HEAD_TOKENS = 4096, 50_000


def read_corpus(
    spark: SparkSession,
    path: str,
    *,
    format: str = "parquet",
    schema=None,
    split: str | None = None,
    glob: str | None = None,
    streaming: bool = False,
) -> DataFrame:
    """Scan a corpus in batch or as a stream.

    ``split`` names a subfolder and ``glob`` the files to take; a table that was
    written as a folder of that name is taken with all its files. A stream needs
    a folder and a schema.
    """
    reader = spark.readStream if streaming else spark.read
    folder = f"{path}/{split}" if split else path
    if glob and has_folder(f"{folder}/{glob}"):
        folder = f"{folder}/{glob}"  # the filter below would look at the names of the files in it
    elif glob:
        reader = reader.option("pathGlobFilter", glob)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.format(format).load(folder)


def spread(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Hashes a table over all cores when it has fewer scan tasks than cores.

    For inputs of a few files in front of costly per-row work. Large inputs
    have more scan tasks than cores and pass unchanged. Call it on a plain
    scan: counting the partitions of a plan with shuffles would run them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def with_text(df: DataFrame) -> DataFrame:
    """Sets ``text``: the column of that name, else ``content``, else ``""``.

    The choice is made on the schema. A null ``text`` stays null and does not
    fall through to ``content``.
    """
    for name in ("text", "content"):
        if name in df.columns:
            return df.withColumn("text", F.col(name))
    return df.withColumn("text", F.lit(""))


def nonempty(df: DataFrame) -> DataFrame:
    """Drops null and empty text; text of blanks only is kept."""
    return df.where(F.col("text").isNotNull() & (F.col("text") != ""))


def words(text: str | Column = "text", max_length: int | None = None) -> Column:
    """Whitespace tokens of the whole text, or the first ``max_length``."""
    column = F.col(text) if isinstance(text, str) else text
    tokens = F.array_remove(F.split(column, r"\s+"), "")
    return tokens if max_length is None else F.slice(tokens, 1, max_length)


def has_words(df: DataFrame) -> DataFrame:
    """Drops texts without a word. Stops at the first one, unlike a count."""
    return nonempty(df).where(F.col("text").rlike(r"\S"))


def tokenize(df: DataFrame, max_length: int | None = None) -> DataFrame:
    """Adds ``tokens`` and drops documents that have none.

    The filter looks at the text, not at ``tokens``: Spark would push a filter
    on ``tokens`` below the projection and split every text twice.
    """
    return has_words(df).withColumn("tokens", words("text", max_length))


def flatten_tokens(tokenized: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per token: the keys, ``pos`` from 0, and ``token``.

    ``tokenized`` has no empty token lists. The outer form gives the same rows
    then, but keeps Spark from adding a filter on the list's size, for which it
    would split every text again before the projection does.
    """
    return tokenized.select(*keys, F.posexplode_outer("tokens").alias("pos", "token"))


def build_vocabulary(token_rows: DataFrame, size: int | None = None) -> DataFrame:
    """All tokens, numbered from 0 by count, then text; or the ``size`` most frequent.

    The count combines before its shuffle, so a token that makes up a third of
    the corpus costs one row per map task. All tokens are put in order by
    ranges and ranked in blocks of ``RANK_BLOCK`` of them, whatever their counts
    and letters; ``size`` kept rows are ranked in one task.
    """
    counted = token_rows.groupBy("token").agg(F.count("*").alias("n"))
    if size is None:
        order = (F.desc("n"), F.asc("token"))
        parts = int(token_rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ordered = counted.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        placed = stage(ordered.withColumn("place", F.monotonically_increasing_id()), "token-counts")
        blocks = placed.withColumn("bucket", F.expr(f"shiftright(place, {RANK_BLOCK.bit_length() - 1})"))
        ranked = running(blocks, bucket="bucket", order=("place",), sums={"rank": F.lit(1).cast("bigint")})
        return ranked.select("token", (F.col("rank") - 1).cast("int").alias("token_id"))
    kept = counted.orderBy(F.desc("n"), "token").limit(size)
    number = F.row_number().over(Window.orderBy(F.desc("n"), "token")) - 1
    return kept.select("token", number.cast("int").alias("token_id"))


def frequent(vocabulary: DataFrame) -> DataFrame:
    """The head of a vocabulary that is numbered by count; numbers are unique, so ``HEAD_TOKENS`` bounds its broadcast."""
    return F.broadcast(vocabulary.where(F.col("token_id").between(0, HEAD_TOKENS - 1)))


def coded_tokens(token_rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Adds ``token_id``, null for tokens outside the vocabulary.

    Frequent tokens, most of a text, get theirs from a broadcast; only the rare
    ones are shuffled to the rest of the vocabulary. So no task gets all the
    rows of a frequent token.
    """
    looked_up = token_rows.join(frequent(vocabulary), "token", "left")
    known = looked_up.where(F.col("token_id").isNotNull())
    rest = vocabulary.where(~F.col("token_id").between(0, HEAD_TOKENS - 1))
    rare = looked_up.where(F.col("token_id").isNull()).drop("token_id").join(rest, "token", "left")
    return known.unionByName(rare)


def encode_tokens(token_rows: DataFrame, vocabulary: DataFrame, unknown_id: int) -> DataFrame:
    """Adds ``token_id``; tokens outside the vocabulary get ``unknown_id``."""
    coded = coded_tokens(token_rows, vocabulary)
    return coded.withColumn("token_id", F.coalesce("token_id", F.lit(unknown_id).cast("int")))


def document_ids(token_rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``doc_id`` and its ``token_ids`` in order, by a join with the vocabulary."""
    known = coded_tokens(token_rows, vocabulary).where(F.col("token_id").isNotNull())
    coded = known.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "token_id"))).alias("coded")
    )
    return coded.select("doc_id", F.col("coded.token_id").alias("token_ids"))


def decode_tokens(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Adds ``token``, or ``<token_id=N>`` for an id the vocabulary lacks."""
    fallback = F.format_string("<token_id=%d>", F.col("token_id"))
    return rows.join(vocabulary, "token_id", "left").withColumn(
        "token", F.coalesce("token", fallback)
    )


def shuffle_documents(df: DataFrame, id_column: str = "doc_id", seed: int = 42,
                      digits: int = BUCKET_DIGITS) -> DataFrame:
    """Adds ``order_key``, ``bucket`` and ``position`` (from 0) in the seeded order."""
    ranked = seeded_rank(df, id_column, seed, name="position", digits=digits)
    return ranked.withColumn("position", F.col("position") - 1)


def shard_documents(shuffled: DataFrame, num_shards: int) -> DataFrame:
    """Deals documents to shards in turn; all shards at once, as a column."""
    return shuffled.withColumns({
        "shard_id": F.pmod("position", F.lit(num_shards)).cast("int"),
        "pos_in_shard": F.expr(f"position div {int(num_shards)}"),
    })


def skip_seen(sharded: DataFrame, seen: DataFrame) -> DataFrame:
    """Drops the first ``examples_seen`` documents of each shard.

    ``seen`` has one row per shard, which is what bounds its broadcast; a
    shuffle on ``shard_id`` would put each shard into one task. Shards without
    a row start at 0.
    """
    offsets = F.broadcast(seen.select("shard_id", "examples_seen"))
    joined = sharded.join(offsets, "shard_id", "left")
    return joined.where(
        F.col("pos_in_shard") >= F.coalesce("examples_seen", F.lit(0))
    ).drop("examples_seen")
