import json
import shutil
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from veclens.operators.corpus import read_corpus, words
from veclens.operators.encode import hashed_tokenizer
from veclens.operators.verify import activation_facts, audit, token_facts, whole_chunks
from veclens.plans import collect as plan
from veclens.plans.collect import CollectConfig, collect, quarantine, resume_state, saved_checkpoints, tokens_table
from veclens.schemas import METADATA
from veclens.streaming.collect import stream_collect

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def tokenizer(text):
    """Word lengths as token ids."""
    return F.transform(words(text, None), lambda word: F.length(word))


def make_encoder():
    def encode(documents):
        for ids in documents:
            if 9 in ids:
                raise ValueError("no token 9, please " + "x" * 200)
        return [np.stack([ids, np.arange(len(ids))], axis=1) for ids in documents]

    return encode


def make_corpus(spark, n=60, bad=()):
    texts = []
    for i in range(n):
        body = ["a" * (1 + (i * j) % 5) for j in range(i % 11)]
        texts.append((i, " ".join(body + (["b" * 9] if i in bad else []))))
    return spark.createDataFrame(texts, "doc_id BIGINT, text STRING").repartition(4)


def config(path, **options):
    defaults = {"num_shards": 3, "chunk_size": 20, "max_length": 8, "truncate": True, "d_model": 2, "batch_size": 4, "tokens_per_shard": 10_000}
    return CollectConfig(str(path), **{**defaults, **options})


KEYS = ["shard_id", "chunk_id", "row_in_chunk", "doc_id", "pos", "token_id"]


def rows(spark, cfg):
    return sorted(tuple(r) for r in tokens_table(spark, cfg).select(*KEYS).collect())


def expected_tokens(corpus, max_length: int | None = 8):
    return {
        r["doc_id"]: [len(w) for w in r["text"].split()][:max_length] for r in corpus.collect() if r["text"].split()
    }


def check_layout(found, cfg):
    """Rows of every chunk are numbered without gaps and documents are whole."""
    chunks = {}
    for shard, chunk, row, *_ in found:
        chunks.setdefault((shard, chunk), []).append(row)
    for numbers in chunks.values():
        assert sorted(numbers) == list(range(len(numbers)))


def test_collect_keeps_every_token_and_passes_the_audit(spark, tmp_path):
    corpus, cfg = make_corpus(spark), config(tmp_path / "run")
    report = collect(corpus, tokenizer, make_encoder, cfg)
    assert all(r["passed"] for r in report.collect())
    found = rows(spark, cfg)
    check_layout(found, cfg)
    documents = {}
    for _, _, _, doc, pos, token in found:
        documents.setdefault(doc, {})[pos] = token
    assert {d: [t[i] for i in range(len(t))] for d, t in documents.items()} == expected_tokens(corpus)
    metadata = spark.read.json(f"{cfg.path}/metadata")
    assert metadata.agg(F.sum("tokens_collected")).first()[0] == len(found)
    assert metadata.where("end_time IS NULL").count() == 0


def test_interrupted_run_equals_one_run(spark, tmp_path):
    corpus = make_corpus(spark)
    whole, parts = config(tmp_path / "whole"), config(tmp_path / "parts", tokens_per_round=30)
    collect(corpus, tokenizer, make_encoder, whole)
    collect(corpus, tokenizer, make_encoder, parts, max_rounds=1)
    assert 0 < len(rows(spark, parts)) < len(rows(spark, whole))
    collect(corpus, tokenizer, make_encoder, parts, max_rounds=1)
    collect(corpus, tokenizer, make_encoder, parts)
    assert rows(spark, parts) == rows(spark, whole)


@pytest.mark.parametrize("tokens_per_round", [15, 60])
def test_rounds_read_the_corpus_once(spark, tmp_path, tokens_per_round):
    """Texts are counted and dealt to rounds; no round goes back to the corpus, failures or not."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    plain = make_corpus(spark, bad={4, 17, 30})
    parts, whole = config(tmp_path / "parts", tokens_per_round=tokens_per_round), config(tmp_path / "whole")
    collect(plain.mapInArrow(count, plain.schema), tokenizer, make_encoder, parts)
    assert seen.value == 2 * 60
    collect(plain, tokenizer, make_encoder, whole)
    assert saved_checkpoints(spark, parts).select("round").distinct().count() >= 2
    assert sorted(r[3:] for r in rows(spark, parts)) == sorted(r[3:] for r in rows(spark, whole))


def test_a_round_that_was_not_committed_is_replaced(spark, tmp_path):
    """Rows written without their checkpoint are written over by the next run."""
    corpus, cfg = make_corpus(spark), config(tmp_path / "run", tokens_per_round=30)
    collect(corpus, tokenizer, make_encoder, cfg, max_rounds=1)
    spark.createDataFrame([(0, 99, 0, 7, 7, 7, [1.0, 1.0], "ok", None)], (
        "shard_id INT, chunk_id BIGINT, row_in_chunk BIGINT, doc_id BIGINT, pos INT, token_id INT, "
        "activation ARRAY<FLOAT>, status STRING, error STRING"
    )).write.partitionBy("status", "shard_id", "chunk_id").parquet(f"{cfg.tokens_path}/round=1")
    collect(corpus, tokenizer, make_encoder, cfg)
    whole = config(tmp_path / "whole")
    collect(corpus, tokenizer, make_encoder, whole)
    assert rows(spark, cfg) == rows(spark, whole)


def test_budget_is_per_shard_and_may_overshoot_by_one_document(spark, tmp_path):
    cfg = config(tmp_path / "run", tokens_per_shard=50)
    collect(make_corpus(spark), tokenizer, make_encoder, cfg)
    counts = {}
    for shard, *_ in rows(spark, cfg):
        counts[shard] = counts.get(shard, 0) + 1
    assert all(50 <= n < 50 + cfg.max_length for n in counts.values()) and len(counts) == 3


def test_failed_documents_are_quarantined_and_made_up_for(spark, tmp_path):
    bad = set(range(5, 60, 7))
    corpus, cfg = make_corpus(spark, bad=bad), config(tmp_path / "run", tokens_per_shard=45)
    report = collect(corpus, tokenizer, make_encoder, cfg)
    assert all(r["passed"] for r in report.collect())
    found = rows(spark, cfg)
    check_layout(found, cfg)
    failed = quarantine(spark, cfg).collect()
    assert failed and {r["doc_id"] for r in failed} <= bad
    assert not {row[3] for row in found} & {r["doc_id"] for r in failed}
    assert all(r["error"] == "no token 9, please " + "x" * 200 for r in failed)
    counts = {}
    for shard, *_ in found:
        counts[shard] = counts.get(shard, 0) + 1
    assert all(n >= 45 for n in counts.values())
    state = resume_state(saved_checkpoints(spark, cfg))
    assert state.agg(F.sum("errors")).first()[0] == len(failed)


def test_oversized_chunks_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        collect(make_corpus(spark), tokenizer, make_encoder, config(tmp_path, chunk_size=2_000_000))


def stream(spark, source, cfg, location):
    corpus = spark.readStream.schema("doc_id BIGINT, text STRING").option("maxFilesPerTrigger", 1).json(str(source))
    stream_collect(corpus, tokenizer, make_encoder, cfg, str(location)).awaitTermination()


def write_file(folder, number, n=20):
    folder.mkdir(exist_ok=True)
    lines = [
        json.dumps({"doc_id": number * 100 + i, "text": " ".join("a" * (1 + i % 5) for _ in range(i % 7))})
        for i in range(n)
    ]
    (folder / f"part{number}.json").write_text("\n".join(lines))


def test_rounds_plan_their_own_documents_only(spark, tmp_path, monkeypatch):
    planned = []

    def counted(sharded, **options):
        planned.append(sharded.count())
        return whole(sharded, **options)

    whole = plan.assign_chunks
    monkeypatch.setattr(plan, "assign_chunks", counted)
    corpus = make_corpus(spark, 200, bad=(5, 17, 90))
    corpus = corpus.unionByName(spark.createDataFrame([(7, "a aa aaa"), (7, "a"), (7, "a aa")], corpus.schema))
    cfg = config(tmp_path / "rounds", tokens_per_round=40)
    collect(corpus, tokenizer, make_encoder, cfg)
    assert len(planned) > 6 and sum(planned) < 3 * 203
    once = config(tmp_path / "once")
    collect(corpus, tokenizer, make_encoder, once)
    kinds = [sorted(r[3:] for r in rows(spark, c)) for c in (cfg, once)]
    assert kinds[0] == kinds[1]
    assert quarantine(spark, cfg).count() == 3


def test_rows_are_written_without_a_sort_and_audited_in_one_scan(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(plan, "audit", lambda pairs, *rest: seen.append(pairs) or audit(pairs, *rest))
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    cfg = config(tmp_path / "run")
    report = collect(make_corpus(spark), tokenizer, make_encoder, cfg)
    with plan.open_files(spark, cfg):
        assert int(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")) == 256
    with plan.open_files(spark, config(tmp_path / "x", chunk_size=100_000, d_model=7168)):
        assert int(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")) == 2
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    (pairs,) = seen
    assert pairs._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    # the report's plan reads the small staged table only
    assert str(tmp_path) not in report._jdf.queryExecution().executedPlan().toString()
    assert all(r["passed"] for r in report.collect())


def test_stream_over_a_table_that_is_a_folder_or_a_file(spark, tmp_path):
    corpus = make_corpus(spark)
    (tmp_path / "folder").mkdir()
    (tmp_path / "file").mkdir()
    corpus.write.parquet(str(tmp_path / "folder" / "documents.parquet"))
    corpus.coalesce(1).write.parquet(str(tmp_path / "one"))
    shutil.copy(next((tmp_path / "one").glob("part-*.parquet")), tmp_path / "file" / "documents.parquet")
    for kind in ("folder", "file"):
        (tmp_path / kind / "labels.parquet").write_text("another table")
        cfg = config(tmp_path / f"run-{kind}", truncate=False)
        for glob in ("documents.parquet", "doc*.parquet"):
            options = {"glob": glob, "schema": corpus.schema}
            assert read_corpus(spark, str(tmp_path / kind), **options).count() == 60
        stream = read_corpus(spark, str(tmp_path / kind), **options, streaming=True)
        stream_collect(stream, tokenizer, make_encoder, cfg, str(tmp_path / f"offsets-{kind}")).awaitTermination()
        found = {}
        for _, _, _, doc, pos, token in rows(spark, cfg):
            found.setdefault(doc, {})[pos] = token
        assert {d: [t[i] for i in range(len(t))] for d, t in found.items()} == expected_tokens(corpus, None)


def test_stream_over_growing_input(spark, tmp_path):
    source, cfg = tmp_path / "source", config(tmp_path / "run")
    for number in (0, 1):
        write_file(source, number)
    stream(spark, source, cfg, tmp_path / "offsets")
    first = rows(spark, cfg)
    write_file(source, 2)
    stream(spark, source, cfg, tmp_path / "offsets")
    found = rows(spark, cfg)
    assert set(first) < set(found)
    check_layout(found, cfg)
    texts = spark.read.schema("doc_id BIGINT, text STRING").json(str(source))
    assert len(found) == sum(len(t) for t in expected_tokens(texts).values())
    closed = saved_checkpoints(spark, cfg)
    assert closed.select("round").distinct().count() == 3
    sizes = tokens_table(spark, cfg).groupBy("shard_id", "chunk_id").count()
    last = sizes.groupBy("shard_id").agg(F.max("chunk_id").alias("last"))
    full = sizes.join(last, "shard_id").where("chunk_id < last")
    assert full.where(F.col("count") < 20 - cfg.max_length).count() == 0


def test_repeated_batch_writes_the_same_rows(spark, tmp_path):
    """Losing the stream's own log makes Spark repeat batches; nothing doubles."""
    source, cfg = tmp_path / "source", config(tmp_path / "run")
    write_file(source, 0)
    stream(spark, source, cfg, tmp_path / "offsets")
    first = rows(spark, cfg)
    stream(spark, source, cfg, tmp_path / "fresh")
    assert rows(spark, cfg) == first


def test_a_stream_reads_one_state_and_closes_itself(spark, tmp_path, monkeypatch):
    """Batches never read the history; the metadata has the totals after the last; a lost state is made up for."""
    source, cfg = tmp_path / "source", config(tmp_path / "run")

    def no_history(*args, **options):
        raise AssertionError("the history was read")

    with monkeypatch.context() as patch:
        patch.setattr(plan, "saved_checkpoints", no_history)
        for number in range(4):
            write_file(source, number, 6)
            stream(spark, source, cfg, tmp_path / "offsets")
            assert len(plan.state_rounds(cfg)) <= 2
    found = rows(spark, cfg)
    state = {r["shard_id"]: r for r in plan.saved_state(spark, cfg).collect()}
    whole = {r["shard_id"]: r for r in resume_state(saved_checkpoints(spark, cfg)).collect()}
    assert state == whole
    closed = spark.read.schema(METADATA).json(f"{cfg.path}/metadata").collect()
    assert sum(r["tokens_collected"] for r in closed) == len(found) and all(r["end_time"] for r in closed)
    assert {r["shard_id"]: r["chunks_saved"] for r in closed if r["chunks_saved"]} == {k: r["chunks_saved"] for k, r in whole.items()}
    # a crash after the checkpoints of the last batch, before its state
    shutil.rmtree(f"{cfg.state_path}/round=3")
    Path(cfg.pending(3)).parent.mkdir(exist_ok=True)
    Path(cfg.pending(3)).touch()
    assert plan.settle_state(spark, cfg, 3) and not plan.settle_state(spark, cfg, 4)
    assert {r["shard_id"]: r for r in plan.saved_state(spark, cfg).collect()} == whole


def test_whole_texts_are_collected_in_windows(spark, tmp_path):
    corpus, cfg = make_corpus(spark), config(tmp_path / "run", truncate=False, max_length=4, tokens_per_shard=None)
    assert all(r["passed"] for r in collect(corpus, tokenizer, make_encoder, cfg).collect())
    documents, places = {}, {}
    for r in tokens_table(spark, cfg).select("doc_id", "pos", "token_id", "activation").collect():
        documents.setdefault(r.doc_id, {})[r.pos] = r.token_id
        places[r.doc_id, r.pos] = r.activation[1]
    assert {d: [t[i] for i in range(len(t))] for d, t in documents.items()} == expected_tokens(corpus, None)
    assert all(place == pos % 4 for (_, pos), place in places.items())


def make_careless_encoder():
    """Matrices that are empty, short, of one dimension or of another width, by the first token."""

    def encode(documents):
        shapes = {1: lambda n: np.zeros((0, 2)), 2: lambda n: np.zeros((n - 1, 2)), 3: lambda n: np.zeros(n), 4: lambda n: np.zeros((n, 3))}
        return [shapes.get(int(ids[0]), lambda n: np.zeros((n, 2)))(len(ids)) for ids in documents]

    return encode


def test_malformed_matrices_are_quarantined_and_the_run_ends(spark, tmp_path):
    texts = [(i, " ".join(["a" * (1 + i % 6)] * (2 + i % 3))) for i in range(30)]
    corpus = spark.createDataFrame(texts, "doc_id BIGINT, text STRING")
    cfg = config(tmp_path / "run", tokens_per_round=20)
    report = collect(corpus, tokenizer, make_careless_encoder, cfg, max_rounds=40)
    assert report.count() == cfg.num_shards
    failed = {r.doc_id: r.error for r in quarantine(spark, cfg).collect()}
    assert set(failed) == {i for i in range(30) if i % 6 < 4}
    assert all(
        text in failed[i] for i in failed
        for text in [{0: "vectors, got 0", 1: "vectors, got", 2: "got 1 dimensions", 3: "expected width 2, got 3"}[i % 6]]
    )
    assert {r.doc_id for r in tokens_table(spark, cfg).select("doc_id").distinct().collect()} == set(range(30)) - set(failed)
    rounds = saved_checkpoints(spark, cfg).agg(F.max("round")).first()[0]
    assert rounds < 39
    collect(corpus, tokenizer, make_careless_encoder, cfg, max_rounds=3)
    assert saved_checkpoints(spark, cfg).agg(F.max("round")).first()[0] == rounds


def test_tasks_write_and_audit_one_file_per_chunk(spark, tmp_path):
    """Files that tasks write hold what Spark's reader finds in them, and the audit of files is that of rows."""
    cfg = config(tmp_path / "run", tokens_per_round=30)
    collect(make_corpus(spark, bad={4, 17}), tokenizer, make_encoder, cfg)
    folders = {}
    for path in Path(cfg.tokens_path).rglob("*.parquet"):
        folders.setdefault(path.parent, []).append(path.name)
    assert folders and all(names == ["part-0.parquet"] for names in folders.values())
    assert not list(Path(cfg.tokens_path).rglob("_*"))
    counts = {(r.shard_id, r.chunk_id): r["count"] for r in tokens_table(spark, cfg).groupBy("shard_id", "chunk_id").count().collect()}
    whole = {(r.shard_id, r.chunk_id): r for r in whole_chunks(tokens_table(spark, cfg)).collect()}
    assert {key: r.act_rows for key, r in whole.items()} == counts
    assert {(r.shard_id, r.chunk_id): r for r in plan.stored_chunks(spark, cfg).collect()} == whole


def test_an_audit_of_files_sees_what_one_of_rows_sees(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    bodies = [
        [([1.0, 2.0], 5), ([0.5, 65504.0], 6)], [([0.1, 2.0], 5)], [([nan, 2.0], 5), ([1.0, 2.0], 5)], [([inf, 2.0], 5)], [([1.0], 5), ([1.0, 2.0], 6)],
        [([None, 2.0], 5)], [(None, 5), ([1.0, 2.0], 7)], [(None, None)], [([], 1)], [([1.0, 70000.0], None), ([1.0, 2.0], 3)], [([2.0**-24, 2.0**-25], 1)],
    ]
    rows = [("ok", 0, chunk, vector, token) for chunk, body in enumerate(bodies) for vector, token in body]
    table = spark.createDataFrame(rows, "status STRING, shard_id INT, chunk_id BIGINT, activation ARRAY<FLOAT>, token_id INT")
    cfg = config(tmp_path)
    table.coalesce(1).write.partitionBy("status", "shard_id", "chunk_id").parquet(f"{cfg.tokens_path}/round=0")
    facts = ["chunk_id", "act_rows", "min_width", "max_width", "acts_ok", "tok_rows", "toks_ok"]
    expected = table.groupBy("shard_id", "chunk_id").agg(*activation_facts(), *token_facts()).select(*facts)
    for audited in (whole_chunks(table), whole_chunks(table.repartition(3)), plan.stored_chunks(spark, cfg)):
        assert sorted(map(tuple, audited.select(*facts).collect())) == sorted(map(tuple, expected.collect()))


def test_hashed_ids_are_the_start_of_each_words_md5(spark):
    texts = [(0, "a bb a ccc"), (1, None), (2, ""), (3, " zwölf\tbb 日本 "), (4, "a")]
    docs = spark.createDataFrame(texts, "n INT, text STRING")
    plain = F.transform(words("text"), lambda word: F.conv(F.substring(F.md5(word), 1, 7), 16, 10).cast("int"))
    found = docs.select("n", hashed_tokenizer(words)(F.col("text")).alias("ids"), plain.alias("plain")).collect()
    assert len(found) == 5 and all(r.ids == r.plain for r in found)
    assert found[0].ids[0] == found[0].ids[2] and "ArrowEvalPython" in docs.select(hashed_tokenizer(words)("text"))._jdf.queryExecution().toString()


def test_rounds_planned_at_once_are_those_planned_singly(spark, tmp_path, monkeypatch):
    """Nothing fails, so plans reach over many rounds; after a failure the next round is planned anew."""
    planned = []

    def noted(*args, **options):
        planned.append(options)
        return whole(*args, **options)

    whole = plan.assign_chunks
    monkeypatch.setattr(plan, "assign_chunks", noted)
    found, n_planned = {}, {}
    for bad, single in (((), 100), ((), 1), ((40, 90), 100), ((40, 90), 1)):
        monkeypatch.setattr(plan, "SINGLE_ROUNDS", single)
        monkeypatch.setattr(plan, "PLANNED_ROUNDS", 5)
        planned.clear()
        cfg = config(tmp_path / f"run-{len(bad)}-{single}", tokens_per_round=40)
        assert all(r["passed"] for r in collect(make_corpus(spark, 120, bad), tokenizer, make_encoder, cfg).collect())
        history = saved_checkpoints(spark, cfg).drop("timestamp")
        state = {r.shard_id: r for r in plan.saved_state(spark, cfg).collect()}
        assert state == {r.shard_id: r for r in resume_state(saved_checkpoints(spark, cfg)).collect()}
        found[bad, single], n_planned[bad, single] = (rows(spark, cfg), sorted(map(tuple, history.collect())), quarantine(spark, cfg).count()), len(planned)
    for bad in ((), (40, 90)):
        assert found[bad, 1] == found[bad, 100] and found[bad, 1][2] == len(bad)
        assert n_planned[bad, 1] < n_planned[bad, 100]


def test_a_store_that_only_spark_opens_gets_the_same_rows(spark, tmp_path, monkeypatch):
    found = []
    for tasks in (True, False):
        monkeypatch.setattr(plan, "opened_by_tasks", lambda path, tasks=tasks: tasks)
        cfg = config(tmp_path / f"run-{tasks}", tokens_per_round=60)
        report = collect(make_corpus(spark, bad={4, 17}), tokenizer, make_encoder, cfg)
        history = saved_checkpoints(spark, cfg).drop("timestamp")
        found.append((rows(spark, cfg), quarantine(spark, cfg).count(), *(sorted(map(tuple, df.collect())) for df in (history, report))))
    assert found[0] == found[1] and found[0][1] == 2
