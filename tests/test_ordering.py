import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from veclens.operators import corpus
from veclens.operators.chunking import assign_chunks
from veclens.operators.ordering import running, seeded_rank, top_k_per_group, with_order_key


def test_bucketed_rank_equals_global_window(spark):
    df = spark.range(3000).withColumnRenamed("id", "doc_id")
    ranked = seeded_rank(df, "doc_id", 7, total="n")
    window = Window.orderBy("order_key", "doc_id")
    wrong = ranked.withColumn("expected", F.row_number().over(window)).where(
        (F.col("rank") != F.col("expected")) | (F.col("n") != 3000)
    )
    assert wrong.count() == 0


def test_running_with_a_hot_group(spark):
    """One group holds most rows; sums and minima still follow the global order."""
    df = with_order_key(
        spark.range(2000).select(
            F.col("id").alias("doc_id"),
            F.when(F.col("id") % 10 < 8, 0).otherwise(F.col("id") % 3).alias("shard_id"),
            (F.hash("id") % 50).cast("bigint").alias("v"),
        ), "doc_id",
    )
    order = ("order_key", "doc_id")
    result = running(df, bucket="bucket", order=order, by=("shard_id",), sums={"s": F.col("v")}, mins={"m": F.col("v")})
    window = Window.partitionBy("shard_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    wrong = result.withColumns({"es": F.sum("v").over(window), "em": F.min("v").over(window)}).where(
        (F.col("s") != F.col("es")) | (F.col("m") != F.col("em"))
    )
    assert wrong.count() == 0


def greedy(sizes, chunk_size, total=0, chunk=0):
    numbers = []
    for size in sizes:
        numbers.append(chunk)
        total += size
        if total >= (chunk + 1) * chunk_size:
            chunk += 1
    return numbers


def numbered(spark, cases, chunk_size, resume=None):
    """Chunk numbers of many random shards in one job."""
    rows = [
        (case, i, f"{i:05d}", f"{i:05d}"[:3], size)
        for case, sizes in enumerate(cases) for i, size in enumerate(sizes)
    ]
    df = spark.createDataFrame(
        [(c * 100_000 + i, c, i, k, b, n) for c, i, k, b, n in rows],
        "doc_id BIGINT, shard_id INT, pos_in_shard BIGINT, order_key STRING, bucket STRING, n_tokens BIGINT",
    )
    chunked = assign_chunks(df, chunk_size=chunk_size, resume=resume)
    found = {}
    for row in chunked.collect():
        found.setdefault(row["shard_id"], []).append((row["pos_in_shard"], row["chunk_id"]))
    return {shard: [chunk for _, chunk in sorted(pairs)] for shard, pairs in found.items()}


def test_chunk_numbers_equal_the_greedy_walk(spark):
    rng = random.Random(1)
    cases = [[rng.choice([1, 5, 40, 300]) for _ in range(rng.randint(1, 40))] for _ in range(300)]
    found = numbered(spark, cases, 50)
    assert found == {case: greedy(sizes, 50) for case, sizes in enumerate(cases)}


def test_resumed_chunk_numbers_equal_the_greedy_walk(spark):
    rng = random.Random(2)
    cases = [[rng.choice([1, 5, 40, 300]) for _ in range(rng.randint(2, 40))] for _ in range(300)]
    starts = [(c, rng.randint(0, 400), rng.randint(0, 9), rng.randint(0, len(s) - 1)) for c, s in enumerate(cases)]
    resume = spark.createDataFrame(
        starts, "shard_id INT, tokens_collected BIGINT, next_chunk BIGINT, examples_seen BIGINT"
    )
    found = numbered(spark, cases, 50, resume)
    expected = {c: greedy(cases[c][seen:], 50, total, chunk) for c, total, chunk, seen in starts}
    assert found == expected


def test_blank_documents_take_a_place_but_no_number(spark):
    found = numbered(spark, [[30, 0, 30, 0, 30]], 50)
    assert found == {0: [0, 0, 1]}


def test_chunk_numbers_read_their_source_once(spark):
    """Token counts can be costly: every row is evaluated once, and the numbering scans what was written."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(200).select(
        F.col("id").alias("doc_id"), (F.col("id") % 3).cast("int").alias("shard_id"), (F.col("id") / 3).cast("bigint").alias("pos_in_shard"),
        F.lpad(F.col("id").cast("string"), 5, "0").alias("order_key"), F.lpad((F.col("id") / 20).cast("int").cast("string"), 3, "0").alias("bucket"),
        (F.col("id") % 7).alias("n_tokens"),
    )
    chunked = assign_chunks(df.mapInArrow(count, df.schema), chunk_size=50)
    assert chunked.where("chunk_id >= 0").count() == chunked.count() == 200 - 29
    assert seen.value == 200


def test_vocabulary_of_many_rare_tokens(spark, monkeypatch):
    """Tokens of one count and one beginning are ranked in blocks, and looked up whether frequent or rare."""
    monkeypatch.setattr(corpus, "RANK_BLOCK", 256)
    monkeypatch.setattr(corpus, "HEAD_TOKENS", 100)
    rows = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit(0).alias("pos"), F.concat(F.lit("aa"), F.md5(F.col("id").cast("string"))).alias("token"))
    often = spark.range(900).select((F.col("id") + 60_000).alias("doc_id"), F.lit(0).alias("pos"), F.concat(F.lit("w"), (F.col("id") % 150).cast("string")).alias("token"))
    both = rows.unionByName(often)
    ids = {r["token"]: r["token_id"] for r in corpus.build_vocabulary(both).collect()}
    counts = {r["token"]: r["count"] for r in both.groupBy("token").count().collect()}
    assert [t for t, _ in sorted(ids.items(), key=lambda x: x[1])] == sorted(counts, key=lambda t: (-counts[t], t))
    table = spark.createDataFrame([(t, i) for t, i in ids.items() if i % 7], "token STRING, token_id INT")
    coded = corpus.encode_tokens(both, table, -1).select("token", "token_id").distinct().collect()
    assert {r["token"]: r["token_id"] for r in coded} == {t: i if i % 7 else -1 for t, i in ids.items()}
    assert corpus.encode_tokens(both, table, -1).count() == 60_900


def test_top_k_beyond_the_group_limit(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 < 2, 0).otherwise(1).alias("g"), F.pmod(F.hash("id"), F.lit(997)).alias("v"), "id"
    )
    order = (F.desc("v"), F.asc("id"))
    top = top_k_per_group(df, ["g"], order, 1500)
    plain = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order))).where("rank <= 1500")
    assert top.count() == 3000
    assert top.exceptAll(plain.select(*top.columns)).count() == 0
