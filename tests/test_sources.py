import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veclens.functions.text import chunk_name, human_readable_size
from veclens.functions.vectors import fits_half
from veclens.operators import chunking, corpus, monitor, verify
from veclens.sources import logs, npy, state, tables


def write_shard(root, shard, chunks, dtype=np.float16):
    for kind in ("activations", "token_ids"):
        (root / f"shard{shard}" / kind).mkdir(parents=True)
    for number, (n, width) in chunks.items():
        values = np.arange(n * width).reshape(n, width) / 8
        np.save(root / f"shard{shard}/activations/chunk_{number:04d}.npy", values.astype(dtype))
        np.save(root / f"shard{shard}/token_ids/chunk_{number:04d}.npy", np.arange(n, dtype=np.int32))


def test_npy_scan_in_slices(spark, tmp_path, monkeypatch):
    write_shard(tmp_path, 0, {0: (10, 4), 1: (7, 4)})
    write_shard(tmp_path, 2, {0: (5, 4)})
    monkeypatch.setattr(npy, "SLICE_BYTES", 24)
    monkeypatch.setattr(npy, "BATCH_BYTES", 16)
    shards = [str(tmp_path / f"shard{i}") for i in range(3)]
    rows = npy.read_npy(spark, shards)
    assert rows.count() == 22
    assert rows.select("dtype").distinct().collect() == [("float16",)]
    row = rows.where("shard_id = 0 AND chunk_id = 1 AND row_in_chunk = 6").first()
    assert row["activation"] == [3.0, 3.125, 3.25, 3.375]
    ids = npy.read_npy(spark, shards, "token_ids")
    assert ids.where("shard_id = 2").agg(F.sum("token_id")).first()[0] == 10


def test_npy_unreadable_chunks_become_error_rows(spark, tmp_path):
    write_shard(tmp_path, 0, {0: (4, 3)})
    write_shard(tmp_path, 1, {0: (4, 3)})
    (tmp_path / "shard1/activations/chunk_0001.npy").write_bytes(b"not an array")
    np.save(tmp_path / "shard1/activations/chunk_0002.npy", np.zeros(4, dtype=np.float16))
    for number in (1, 2):
        np.save(tmp_path / f"shard1/token_ids/chunk_{number:04d}.npy", np.arange(4, dtype=np.int32))
    shards = [str(tmp_path / "shard0"), str(tmp_path / "shard1")]
    acts, toks = npy.read_npy(spark, shards), npy.read_npy(spark, shards, "token_ids")
    pairs = verify.pair_chunks(verify.activation_chunks(acts, "error"), verify.token_chunks(toks))
    checked = verify.check_chunks(pairs, 3)
    errors = {(r["shard_id"], r["chunk_id"]): r["error"] for r in verify.chunk_errors(checked).collect()}
    assert set(errors) == {(1, 1), (1, 2)}
    assert "expected 2D, got 1D" in errors[1, 2]
    known = spark.range(2).select(F.col("id").cast("int").alias("shard_id"))
    report = {r["shard_id"]: r["passed"] for r in verify.report(known, known, checked).collect()}
    assert report == {0: True, 1: False}


def test_npy_without_any_chunk_fails(spark, tmp_path):
    with pytest.raises(Exception, match="no activations chunks found"):
        npy.read_npy(spark, [str(tmp_path / "shard9")]).count()


def test_npy_round_trip(spark, tmp_path, sf_dir):
    from veclens.checks.fixtures import chunk_rows

    rows = chunk_rows(spark, sf_dir)
    npy.write_npy(rows, str(tmp_path))
    first = np.load(tmp_path / "shard1/activations/chunk_0001.npy")
    assert first.dtype == np.float16 and first.shape == (50, 64)
    shards = [str(tmp_path / f"shard{i}") for i in range(4)]
    back = npy.read_npy(spark, shards).join(
        npy.read_npy(spark, shards, "token_ids").drop("dtype", "error"), ["shard_id", "chunk_id", "row_in_chunk"]
    )
    joined = rows.withColumnRenamed("activation", "original").join(
        back, ["shard_id", "chunk_id", "row_in_chunk", "token_id"]
    )
    worst = F.array_max(F.zip_with("original", "activation", lambda a, b: F.abs(a - b)))
    assert joined.count() == rows.count()
    assert joined.agg(F.max(worst)).first()[0] < 1e-3


def test_missing_shards_are_skipped_with_a_warning(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "shard1"))
    with pytest.warns(UserWarning, match="does not exist"):
        rows = tables.read_shards(spark, [str(tmp_path / "shard0"), str(tmp_path / "shard1")])
    assert [r["shard_id"] for r in rows.distinct().select("shard_id").distinct().collect()] == [1]
    with pytest.raises(ValueError):
        tables.existing_paths([str(tmp_path / "shard7")])


def test_a_chunk_written_again_is_replaced(spark, tmp_path):
    rows = spark.range(40).select(
        F.expr("CAST(id % 2 AS INT)").alias("shard_id"), F.expr("CAST(id div 20 AS INT)").alias("chunk_id"),
        F.expr("id").alias("row_in_chunk"), F.lit(1).alias("token_id"),
    )
    path = str(tmp_path / "chunks")
    tables.write_chunks(rows, path)
    tables.write_chunks(rows.where("shard_id = 1 AND chunk_id = 0").withColumn("token_id", F.lit(2)), path)
    back = tables.read_chunks(spark, path)
    assert back.count() == 40
    assert back.where("token_id = 2").count() == 10


def test_bad_json_gives_null_rows(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"shard_id": 1, "tokens_per_shard": 5}\nnot json\n')
    rows = state.read_metadata(spark, str(tmp_path)).orderBy("shard_id").collect()
    assert [r["shard_id"] for r in rows] == [None, 1]


def test_logs_in_file_order(spark, tmp_path):
    (tmp_path / "shard0.log").write_bytes(b"fine\nERROR one\nall good\nWarning two \t\nException \xff three\nfine\n")
    (tmp_path / "shard1.log").write_text("nothing\n")
    (tmp_path / "other.txt").write_text("error\n")
    lines = logs.read_logs(spark, str(tmp_path))
    assert sorted((r["shard_id"], r["line_no"]) for r in lines.collect()) == [(0, i) for i in range(6)] + [(1, 0)]
    assert [r["line"] for r in monitor.error_tail(lines).collect()] == ["Warning two", "Exception  three"]
    assert monitor.any_errors(lines).first()[0] is True
    assert monitor.any_errors(lines.where("shard_id = 1")).first()[0] is False
    assert monitor.any_errors(lines.where("shard_id = 9")).first()[0] is False


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 20])
def test_logs_in_blocks_and_from_the_end(spark, tmp_path, monkeypatch, block):
    """Blocks of any size give every line once with its number, and the same last problems as a whole read."""
    rng = np.random.default_rng(block)
    words = ["fine", "ERROR x", "", "a warning \t", "é" * 9, "Exception", "long " * 30]
    bodies = {
        0: "\n".join(rng.choice(words, 60)) + "\n", 1: "no end", 2: "", 3: "\n\n\n", 4: "error first\n" + "x\n" * 200, 5: "\n".join(rng.choice(words, 9)),
    }
    for shard, body in bodies.items():
        (tmp_path / f"shard{shard}_run.log").write_text(body)
    monkeypatch.setattr(logs, "STEP_BYTES", 5)
    expected, tail = [], []
    for shard, body in bodies.items():
        lines = body.split("\n")[:-1] if body.endswith("\n") or not body else body.split("\n")
        expected += [(shard, i, line) for i, line in enumerate(lines)]
        bad = [line.rstrip() for line in lines if any(w in line.lower() for w in monitor.ERROR_WORDS)]
        tail += [(shard, n, line) for n, line in enumerate(reversed(bad[-2:]), 1)]
    got = logs.read_logs(spark, str(tmp_path), block_bytes=block).collect()
    assert sorted(map(tuple, got)) == expected
    found = logs.log_tail(spark, str(tmp_path), block_bytes=block).collect()
    assert sorted((r["shard_id"], r["from_end"], r["line"]) for r in found) == tail
    for r in found:
        assert bodies[r["shard_id"]].encode()[r["position"] :].decode().startswith(r["line"])


def test_no_logs(spark, tmp_path):
    assert logs.read_logs(spark, str(tmp_path / "none")).count() == 0
    assert logs.log_tail(spark, str(tmp_path)).count() == 0


def test_sizes(spark, tmp_path):
    for shard, size in ((0, 100), (1, 2048)):
        (tmp_path / f"shard{shard}").mkdir()
        (tmp_path / f"shard{shard}" / "x.bin").write_bytes(b"0" * size)
    (tmp_path / "loose.bin").write_bytes(b"0" * 10)
    rows = monitor.shard_bytes(tables.file_sizes(spark, str(tmp_path))).collect()
    assert {(r["scope"], r["shard_id"]): r["size"] for r in rows} == {
        ("shard", 0): "100.00 B", ("shard", 1): "2.00 KB", ("total", None): "2.11 KB",
    }


def test_formats(spark):
    sizes = [0, 1023, 1024, 1024**2 - 1, 5 * 1024**3, 7 * 1024**5, 3000 * 1024**5]
    df = spark.createDataFrame([(float(s),) for s in sizes], "n DOUBLE")
    shown = [r[0] for r in df.select(human_readable_size(F.col("n"))).collect()]
    assert shown == ["0.00 B", "1,023.00 B", "1.00 KB", "1,024.00 KB", "5.00 GB", "7.00 PB", "2.93 EB"]
    assert spark.range(1).select(chunk_name(F.lit(7))).first()[0] == "chunk_0007"


def test_text_fallback_uses_the_schema(spark):
    both = spark.createDataFrame([(None, "c"), ("", "c"), ("t", "c")], "text STRING, content STRING")
    assert [r["text"] for r in corpus.with_text(both).collect()] == [None, "", "t"]
    assert corpus.with_text(both.drop("text")).first()["text"] == "c"
    assert corpus.with_text(both.drop("text", "content").withColumn("x", F.lit(1))).first()["text"] == ""
    assert corpus.nonempty(corpus.with_text(both)).count() == 1


def test_strict_lookup_rejects_bad_indices(spark, sf_dir):
    from veclens.checks import fixtures as fx

    catalog, rows = fx.catalog(spark, sf_dir), fx.chunk_rows(spark, sf_dir)
    bad = spark.createDataFrame([(0,), (-1,)], "token_idx BIGINT")
    with pytest.raises(Exception, match="index -1 out of range"):
        chunking.lookup(bad, catalog, rows).collect()


def test_chunk_size_guard():
    chunking.check_chunk_size(1_000_000, 7168)
    with pytest.raises(ValueError, match="about 143.4 GB"):
        chunking.check_chunk_size(10_000_000, 7168)


def test_arrays_are_cut_to_the_shorter(spark):
    df = spark.createDataFrame([([[1.0], [2.0], [3.0]], [7, 8])], "vectors ARRAY<ARRAY<DOUBLE>>, token_ids ARRAY<INT>")
    row = df.withColumns(chunking.align_arrays()).first()
    assert (len(row["vectors"]), row["token_ids"]) == (2, [7, 8])


def test_files_are_split_by_size_alone(tmp_path, monkeypatch):
    """The listing opens no file; parts of a file hold all its rows once, and a bad file is one error row."""
    folder = tmp_path / "shard3" / "activations"
    folder.mkdir(parents=True)
    x = np.arange(700, dtype=np.float16).reshape(100, 7)
    np.save(folder / "chunk_0000.npy", x)
    np.save(folder / "chunk_0001.npy", x[:0])
    (folder / "chunk_0002.npy").write_bytes(b"no array" * 100)
    (folder / "chunk_0003.npy.part1").write_bytes(b"left over")
    monkeypatch.setattr(npy, "SLICE_BYTES", 400)
    reader = npy.NpyReader([str(tmp_path / "shard3")], "activations")
    with monkeypatch.context() as patch:
        patch.setattr(np, "load", None)
        patch.setattr("builtins.open", None)
        slices = reader.partitions()
    assert [s.chunk_id for s in slices] == [0] * 4 + [1] + [2] * 2
    rows = [row for s in slices for batch in reader.read(s) for row in batch.to_pylist()]
    good = [row for row in rows if row["error"] is None]
    assert [row["row_in_chunk"] for row in good] == list(range(100))
    assert [row["activation"] for row in good] == x.astype(float).tolist()
    assert [row["chunk_id"] for row in rows if row["error"] is not None] == [2]


def test_chunks_grow_by_batches(tmp_path):
    """Both files of a chunk grow with every batch; a task that fails leaves no file."""
    import pyarrow as pa

    x = np.arange(60, dtype=np.float32).reshape(20, 3)
    chunks = [0] * 7 + [1] * 6 + [2] * 7

    def batch(rows):
        return pa.RecordBatch.from_pydict({
            "shard_id": pa.array([4] * len(rows), pa.int32()), "chunk_id": pa.array([chunks[i] for i in rows], pa.int32()),
            "token_id": pa.array(list(rows), pa.int32()), "activation": pa.array([x[i] for i in rows], pa.list_(pa.float32())),
        })

    writer = npy.NpyWriter(str(tmp_path))
    batches = [batch(range(5)), batch(range(0)), batch(range(5, 9)), batch(range(9, 20))]
    writer.commit([writer.write(iter(batches)), None])
    for chunk in range(3):
        rows = [i for i in range(20) if chunks[i] == chunk]
        stored = np.load(tmp_path / "shard4" / "activations" / f"chunk_{chunk:04d}.npy")
        assert stored.dtype == np.float16 and stored.tolist() == x[rows].tolist()
        ids = np.load(tmp_path / "shard4" / "token_ids" / f"chunk_{chunk:04d}.npy")
        assert ids.dtype == np.int32 and ids.tolist() == rows

    def broken():
        yield batch(range(5))
        raise OSError("lost")

    with pytest.raises(OSError):
        npy.NpyWriter(str(tmp_path / "again")).write(broken())
    assert not [file for file in (tmp_path / "again").rglob("*") if file.is_file()]


def test_half_check_agrees_with_numpy_on_all_halves_and_their_neighbours(spark):
    halves = np.arange(1 << 16, dtype=np.uint16).view(np.float16).astype(np.float32)
    between = (halves[:-1].astype(np.float64) + halves[1:]) / 2
    with np.errstate(all="ignore"):
        values = np.concatenate([
            halves, np.nextafter(halves, np.float32(np.inf)), np.nextafter(halves, np.float32(0)), between.astype(np.float32),
            np.array([1e-45, 1e-38, 65504.01, 65520, 7e4, 3e38, -0.0], np.float32),
        ])
        expected = np.isfinite(values) & (np.abs(values) <= 65504) & (values.astype(np.float16).astype(np.float32) == values)
    rows = spark.createDataFrame(pa.table({"i": np.arange(len(values)), "v": pa.array(values[:, None].tolist(), pa.list_(pa.float32()))}))
    found = rows.select("i", fits_half("v").alias("ok")).orderBy("i").toArrow().column("ok").to_numpy()
    assert (found == expected).all()
    odd = spark.createDataFrame([([1.0, None],), ([],), (None,)], "v ARRAY<DOUBLE>").select(fits_half("v"))
    assert [r[0] for r in odd.collect()] == [False, True, None]


def test_tokens_without_a_vector_leave_before_rows_move(spark):
    documents = spark.createDataFrame([(i, "a b c d") for i in range(50)] + [(3, "x y")], "doc_id BIGINT, text STRING")
    tokens = corpus.flatten_tokens(corpus.tokenize(documents))
    vectors = spark.createDataFrame(
        [(3, 0, 10), (3, 1, 11), (3, 9, 12), (4, 0, 13), (4, 0, 14), (99, 0, 15), (None, 0, 16)], "doc_id BIGINT, pos INT, vec_id INT"
    )
    found = chunking.align_pairs(vectors, tokens)
    got = sorted((r["doc_id"], r["pos"], r["vec_id"], r["token"]) for r in found.collect())
    assert got == [(3, 0, 10, "a"), (3, 0, 10, "x"), (3, 1, 11, "b"), (3, 1, 11, "y"), (4, 0, 13, "a"), (4, 0, 14, "a")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("LeftSemi")  # the filter is below the explode
