"""From raw documents to token ids: five training-data operators in a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veclens.llm.exact_dedup import exact_groups
from veclens.llm.minhash import near_duplicates
from veclens.llm.mixing import label_weights, mix
from veclens.llm.nbsvm import fit_quality, keep_good, train_labels
from veclens.llm.pieces import encode_documents, unigram_scores
from veclens.llm.texts import documents, whole, without_white
from veclens.session import stage

QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects."""
    return keep_good(docs, fit_quality(docs, train_labels(spark, sf_dir)), QUALITY)


def unused(docs: DataFrame, *names: str) -> list[str]:
    """Column names like these that the table doesn't have."""
    taken = {name.lower() for name in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts; rows that repeat an id and its text are one.

    Of such rows the one with the longest text stays, then the least by its other columns as JSON, maps included.
    """
    sha, place, other_id, other_sha = unused(docs, "_hash", "_n", "_id", "_sha")
    kept = exact_groups(docs).where("kept").select(F.col("doc_id").alias(other_id), F.col("text_sha256").alias(other_sha)).distinct()
    known = docs.withColumn(sha, F.sha2(without_white("text"), 256))
    joined = known.join(kept, known.doc_id.eqNullSafe(F.col(other_id)) & (F.col(sha) == F.col(other_sha)), "left_semi")
    others = [name for name in docs.columns if name not in ("doc_id", "text")]
    order = [F.length(whole()).desc(), *([F.to_json(F.struct(*map(quoted, others)))] if others else []), "text"]
    first = Window.partitionBy("doc_id", sha).orderBy(*order)
    return joined.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).select(*map(quoted, docs.columns))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group."""
    other_id, other_hash = unused(docs, "_id", "_h")
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias(other_id), F.col("text_hash").alias(other_hash))
    same = docs.doc_id.eqNullSafe(F.col(other_id)) & (F.xxhash64(whole()) == F.col(other_hash))
    return docs.join(kept, same, "left_semi")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that the sources have their weights; rows with the same id and text alike."""
    other_id, other_hash, n, copy = unused(docs, "_id", "_h", "_n", "_copy")
    times = mix(docs, quality=label_weights(spark, sf_dir)).where("epochs > 0")
    times = times.groupBy(F.col("doc_id").alias(other_id), F.col("text_hash").alias(other_hash)).agg(F.max("epochs").alias(n))
    taken = docs.join(times, docs.doc_id.eqNullSafe(F.col(other_id)) & (F.xxhash64(whole()) == F.col(other_hash)))
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).select(*map(quoted, docs.columns))


def quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document that the mixture takes, under log scores fitted to these documents."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    return encode_documents(docs, path, scores=unigram_scores(docs, path))


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("mixing sources", mixed),
    ("SentencePiece", encoded),
]
#: The classifier, the hashes and the piece search have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is a table in the shared folder."""
    docs = documents(spark, sf_dir)
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name.split()[0].lower()}")
    return docs
