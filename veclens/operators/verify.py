"""Audit of collected chunks: presence, pairing, width, counts, types."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import HALF_MAX, fits_half
from ..session import stage, task_filesystem

CHUNK = ("shard_id", "chunk_id")
TOKEN_BYTES = 4
ACTIVATION_TYPE, TOKEN_TYPE = "float16", "int32"
AUDIT_VALUES = 1 << 22  # of vectors that are looked at together
FACTS = [
    T.StructField("act_rows", T.LongType()), T.StructField("min_width", T.IntegerType()), T.StructField("max_width", T.IntegerType()),
    T.StructField("acts_ok", T.BooleanType()), T.StructField("tok_rows", T.LongType()), T.StructField("toks_ok", T.BooleanType()),
]


def activation_facts() -> list[Column]:
    width = F.size("activation")
    return [
        F.count("activation").alias("act_rows"),
        F.min(width).alias("min_width"),
        F.max(width).alias("max_width"),
        F.bool_and(fits_half("activation")).alias("acts_ok"),
    ]


def ids_in_range() -> Column:
    return F.col("token_id").isNotNull() & F.col("token_id").cast("bigint").between(-(2**31), 2**31 - 1)


def token_facts() -> list[Column]:
    return [F.count("*").alias("tok_rows"), F.bool_and(ids_in_range()).alias("toks_ok")]


def activation_chunks(activations: DataFrame, unreadable: str | None = None, dtype: str | None = None) -> DataFrame:
    """Rows, width range and value check of every vector chunk, in one pass.

    ``unreadable`` and ``dtype`` name the columns that a reader of files fills.
    """
    facts = activation_facts()
    if unreadable:
        facts.append(F.max(unreadable).alias("load_error"))
    if dtype:
        facts.append(F.max(F.when(F.col(dtype) != ACTIVATION_TYPE, F.col(dtype))).alias("act_dtype"))
    return activations.groupBy(*CHUNK).agg(*facts)


def token_chunks(tokens: DataFrame, unreadable: str | None = None, dtype: str | None = None) -> DataFrame:
    """Rows and value check of every token-id chunk; an unreadable one has no rows."""
    if not unreadable:
        facts = token_facts()
    else:
        read = F.col(unreadable).isNull()
        facts = [
            F.count_if(read).alias("tok_rows"),
            F.bool_and(~read | ids_in_range()).alias("toks_ok"),
            F.max(unreadable).alias("tok_load_error"),
        ]
    if dtype:
        facts.append(F.max(F.when(F.col(dtype) != TOKEN_TYPE, F.col(dtype))).alias("tok_dtype"))
    return tokens.groupBy(*CHUNK).agg(*facts)


def pair_chunks(acts: DataFrame, toks: DataFrame) -> DataFrame:
    """Both sides of every chunk; flags tell which side is missing."""
    return with_sides(acts.join(toks, list(CHUNK), "full_outer"))


def whole_chunks(rows: DataFrame) -> DataFrame:
    """The same of rows that have both a vector and a token id, in one pass.

    Tasks look at the values of Arrow batches and give one row per run of
    equal chunks; Spark adds these up.
    """
    element = getattr(rows.schema["activation"].dataType, "elementType", None)
    vector = F.col("activation") if isinstance(element, (T.FloatType, T.DoubleType)) else F.col("activation").cast("array<double>")
    narrow = rows.select(*CHUNK, vector.alias("activation"), F.size("activation").alias("width"), ids_in_range().alias("id_ok"))
    schema = T.StructType([*[narrow.schema[name] for name in CHUNK], *FACTS])
    return merged_facts(narrow.mapInArrow(lambda batches: map(chunk_facts, filter(len, batches)), schema))


def whole_chunk_files(files: DataFrame) -> DataFrame:
    """The same of Parquet files with both, of which every one holds rows of one chunk; ``path`` and the chunk of each are given.

    Tasks open the files themselves, a bounded part of one at a time.
    """
    narrow = files.select(*CHUNK, "path")
    schema = T.StructType([*[narrow.schema[name] for name in CHUNK], *FACTS])

    def facts(batches):
        for batch in batches:
            for i, path in enumerate(batch.column("path").to_pylist()):
                store, place = task_filesystem(path)
                with store.open_input_file(place) as source:
                    file = pq.ParquetFile(source)
                    groups = [file.metadata.row_group(g).column(c) for g in range(file.num_row_groups) for c in range(file.metadata.num_columns)]
                    values = sum(column.num_values for column in groups if column.path_in_schema.startswith("activation"))
                    step = max(1, AUDIT_VALUES * max(file.metadata.num_rows, 1) // max(values, file.metadata.num_rows, 1))
                    for part in file.iter_batches(batch_size=step, columns=["activation", "token_id"]):
                        if part.num_rows:
                            vectors, ids = part.column("activation"), part.column("token_id")
                            keys = [batch.column(name).take(pa.array(np.full(part.num_rows, i))) for name in CHUNK]
                            fits = pc.and_(pc.greater_equal(ids, -(2**31)), pc.less_equal(ids, 2**31 - 1)).fill_null(False)
                            whole = [*keys, vectors, pc.list_value_length(vectors), fits]
                            yield chunk_facts(pa.RecordBatch.from_arrays(whole, [*CHUNK, "activation", "width", "id_ok"]))

    return merged_facts(narrow.mapInArrow(facts, schema))


def chunk_facts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """What the audit asks of a chunk, for every run of rows of one."""
    def plain(column, fill):
        return column.fill_null(fill).to_numpy(zero_copy_only=False)

    vectors, width = batch.column("activation"), batch.column("width")
    changes = np.zeros(batch.num_rows - 1, dtype=bool)
    for name in CHUNK:
        column = batch.column(name)
        for mark in (plain(column, 0), plain(column.is_null(), True)):
            changes |= mark[1:] != mark[:-1]
    starts = np.concatenate([[0], np.flatnonzero(changes) + 1])
    last = np.append(starts[1:], batch.num_rows) - 1
    numbers = vectors.flatten().to_numpy(zero_copy_only=False)  # a null value becomes NaN, which is no half
    with np.errstate(over="ignore", invalid="ignore"):
        halves = (np.abs(numbers) <= HALF_MAX) & (numbers.astype(np.float16).astype(numbers.dtype) == numbers)
    ends = np.cumsum(plain(vectors.value_lengths(), 0), dtype=np.int64)
    wrong = np.concatenate([[0], np.cumsum(~halves)])[ends[last]]
    act_rows = np.add.reduceat(plain(vectors.is_valid(), False).astype(np.int64), starts)
    no_width = np.add.reduceat(plain(width.is_valid(), False).astype(np.int64), starts) == 0
    return pa.RecordBatch.from_arrays([
        *[batch.column(name).take(pa.array(starts)) for name in CHUNK],
        pa.array(act_rows),
        pa.array(np.minimum.reduceat(plain(width, 2**31 - 1), starts).astype(np.int32), mask=no_width),
        pa.array(np.maximum.reduceat(plain(width, -(2**31)), starts).astype(np.int32), mask=no_width),
        pa.array(np.diff(wrong, prepend=0) == 0, mask=act_rows == 0),
        pa.array(last - starts + 1),
        pa.array(np.logical_and.reduceat(plain(batch.column("id_ok"), False), starts)),
    ], [*CHUNK, *[field.name for field in FACTS]])


def merged_facts(runs: DataFrame) -> DataFrame:
    return with_sides(runs.groupBy(*CHUNK).agg(
        F.sum("act_rows").alias("act_rows"), F.min("min_width").alias("min_width"), F.max("max_width").alias("max_width"),
        F.bool_and("acts_ok").alias("acts_ok"), F.sum("tok_rows").alias("tok_rows"), F.bool_and("toks_ok").alias("toks_ok"),
    ))


def with_sides(both: DataFrame) -> DataFrame:
    return both.withColumns({
        "has_activations": F.col("act_rows").isNotNull(),
        "has_token_ids": F.col("tok_rows").isNotNull(),
    })


def check_chunks(pairs: DataFrame, d_model: int) -> DataFrame:
    """One row per chunk with its ``error`` (null if none) and counted tokens.

    The first failing check names the error. Wrong width and unequal counts
    take the chunk's tokens out of the total; wrong values do not.
    """
    for name in ("load_error", "tok_load_error", "act_dtype", "tok_dtype"):
        if name not in pairs.columns:
            pairs = pairs.withColumn(name, F.lit(None).cast("string"))
    pairs = pairs.withColumn("load_error", F.coalesce("load_error", "tok_load_error"))
    bad_width = F.when(F.col("min_width") != d_model, F.col("min_width")).when(
        F.col("max_width") != d_model, F.col("max_width")
    )
    fatal = (
        F.when(~F.col("has_activations"), F.lit("activations missing"))
        .when(~F.col("has_token_ids"), F.lit("token ids missing"))
        .when(F.col("load_error").isNotNull(), F.concat(F.lit("error loading: "), "load_error"))
        .when(bad_width.isNotNull(), F.format_string(f"width %d, expected {d_model}", bad_width))
        .when(
            F.col("act_rows") != F.col("tok_rows"),
            F.format_string("%d vectors, %d token ids", "act_rows", "tok_rows"),
        )
    )
    values = F.when(
        F.col("act_dtype").isNotNull(), F.concat(F.lit("activations are "), "act_dtype", F.lit(f", expected {ACTIVATION_TYPE}"))
    ).when(
        F.col("tok_dtype").isNotNull(), F.concat(F.lit("token ids are "), "tok_dtype", F.lit(f", expected {TOKEN_TYPE}"))
    ).when(~F.col("acts_ok"), F.lit("activation values are not half precision")).when(
        ~F.col("toks_ok"), F.lit("token ids are not int32")
    )
    return pairs.select(
        *CHUNK,
        "has_activations",
        "has_token_ids",
        F.coalesce(fatal, values).alias("error"),
        F.when(fatal.isNull(), F.col("act_rows")).otherwise(0).cast("bigint").alias("n_tokens"),
    )


def shard_presence(expected: DataFrame, metadata: DataFrame, checked: DataFrame) -> DataFrame:
    """Per expected shard: metadata found, and chunks on each side.

    ``expected`` and ``metadata`` have one row per shard.
    """
    sides = checked.groupBy("shard_id").agg(
        F.count_if("has_activations").alias("act_chunks"),
        F.count_if("has_token_ids").alias("tok_chunks"),
    )
    known = metadata.select("shard_id", F.lit(True).alias("has_metadata"))
    return (
        expected.join(known, "shard_id", "left")
        .join(sides, "shard_id", "left")
        .fillna(False, ["has_metadata"])
        .fillna(0, ["act_chunks", "tok_chunks"])
    )


def chunk_counts(presence: DataFrame) -> DataFrame:
    """At least one chunk, and equally many on both sides."""
    return presence.withColumns({
        "has_chunks": F.col("act_chunks") > 0,
        "counts_match": F.col("act_chunks") == F.col("tok_chunks"),
    })


def chunk_errors(checked: DataFrame) -> DataFrame:
    """The error list in long form, one row per faulty chunk."""
    return checked.where(F.col("error").isNotNull()).select(*CHUNK, "error")


def totals(checked: DataFrame, d_model: int, by: tuple[str, ...] = ("shard_id",)) -> DataFrame:
    """Counted tokens and their size in GB of vectors and MB of ids."""
    summed = checked.groupBy(*by).agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("total_tokens"))
    return summed.withColumns({
        "activation_gb": F.col("total_tokens") * (d_model * 2) / 1e9,
        "token_mb": F.col("total_tokens") * TOKEN_BYTES / 1e6,
    })


def report(expected: DataFrame, metadata: DataFrame, checked: DataFrame) -> DataFrame:
    """Pass or fail of each shard, its first problem, and its error count."""
    per_shard = checked.groupBy("shard_id").agg(
        F.count("error").alias("n_errors"), F.sum("n_tokens").alias("total_tokens")
    )
    counted = chunk_counts(shard_presence(expected, metadata, checked))
    joined = counted.join(per_shard, "shard_id", "left").fillna(0, ["n_errors", "total_tokens"])
    problem = (
        F.when(~F.col("has_metadata"), "metadata not found")
        .when(~F.col("has_chunks"), "no activation chunks")
        .when(~F.col("counts_match"), "chunk counts differ")
        .when(F.col("n_errors") > 0, "chunk errors")
    )
    return joined.select(
        "shard_id",
        problem.isNull().alias("passed"),
        F.coalesce(problem, F.lit("")).alias("problem"),
        F.col("n_errors").cast("bigint").alias("n_errors"),
        F.col("total_tokens").cast("bigint").alias("total_tokens"),
    )


def overall(report_rows: DataFrame) -> DataFrame:
    """One row: whether every shard passed."""
    return report_rows.agg(
        F.coalesce(F.bool_and("passed"), F.lit(False)).alias("all_passed"),
        F.count_if(~F.col("passed")).alias("n_failed"),
    )


def verify(activations: DataFrame, tokens: DataFrame, metadata: DataFrame, d_model: int,
           num_shards: int) -> DataFrame:
    """The whole audit, from rows to the report."""
    return audit(pair_chunks(activation_chunks(activations), token_chunks(tokens)), metadata, d_model, num_shards)


def audit(pairs: DataFrame, metadata: DataFrame, d_model: int, num_shards: int) -> DataFrame:
    """The report from both sides of every chunk, which are written once: counts and errors both need them."""
    checked = stage(check_chunks(pairs, d_model), "checked")
    expected = pairs.sparkSession.range(num_shards).select(F.col("id").cast("int").alias("shard_id"))
    return report(expected, metadata, checked)
