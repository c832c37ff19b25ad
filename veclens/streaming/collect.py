"""Continuous collection: new corpus files become chunks as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import check_chunk_size, document_counts
from ..operators.corpus import shard_documents, shuffle_documents
from ..operators.encode import Encoder
from ..plans.collect import CollectConfig, Texts, metadata_rows, now, run_round, settle_state
from ..session import exists, stage
from ..sources.state import read_metadata, write_json


def stream_collect(
    corpus: DataFrame, tokenizer: Callable[[Column], Column], make_encoder: Callable[[], Encoder],
    config: CollectConfig, checkpoint_location: str, *, refresh: str | None = None,
    token_count: Callable[[Column], Column] | None = None,
) -> StreamingQuery:
    """Starts the stream; every micro-batch is one round of the collection job.

    The round number is the batch number and a round's state comes from earlier
    rounds only, so a batch that Spark repeats after a failure writes the same
    rows to the same place. Budgets, chunk numbers and rows of an open chunk
    carry over. Documents are shuffled within their micro-batch.

    What a batch reads of earlier ones is the state after the last, one row per
    shard, however many came before. After every batch the metadata has the
    totals and the time, so a stream that ends has closed itself; ``finish``
    adds the audit.
    """
    check_chunk_size(config.chunk_size, config.d_model)
    spark = corpus.sparkSession
    metadata = f"{config.path}/metadata"
    if not exists(metadata):
        write_json(metadata_rows(spark, config, now()), metadata)

    def run(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        if settle_state(session, config, number):
            return
        count = token_count(F.col("text")) if token_count else F.size(tokenizer(F.col("text")))
        counts = document_counts(batch, config.count(count))
        counted = stage(counts.select("doc_id", "n_tokens"), "counts")
        sharded = stage(shard_documents(shuffle_documents(counted, seed=config.seed), config.num_shards), "sharded")
        run_round(session, config, Texts(batch), sharded, tokenizer, make_encoder, number, whole_input=True)
        started = read_metadata(session, metadata).first()["start_time"]
        write_json(stage(metadata_rows(session, config, started, now()), "metadata"), metadata)

    writer = corpus.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint_location)
    trigger = {"processingTime": refresh} if refresh else {"availableNow": True}
    return writer.trigger(**trigger).start()
