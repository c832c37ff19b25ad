"""The corpus pipeline against a plain version of every stage."""

import hashlib
import math
import zlib
from collections import defaultdict

import brute
import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from test_mix_shard_rules import targets_by_hand
from test_tokens import MODEL, encode_by_hand, table  # noqa: F401 - a fixture

from veclens.llm import mixing, nbsvm, pieces
from veclens.llm.texts import flat


def kept_by_quality(spark, rows, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = nbsvm.fit_quality(docs, nbsvm.train_labels(spark, sf_dir))
    scores = model.scores(nbsvm.gram_features(*flat(pa.array([row[1] for row in rows], pa.string()))))
    return [row for row, score in zip(rows, scores, strict=True) if score >= 0.3]


def kept_exactly(rows):
    best = {}
    for row in rows:
        plain = brute.clean(row[1])
        if plain not in best or (-len(row[1] or ""), row[0]) < (-len(best[plain][1] or ""), best[plain][0]):
            best[plain] = row
    return sorted(best.values())


def kept_of_near(rows):
    roots = brute.near_groups([row[1] for row in rows], 5)
    return [row for i, row in enumerate(rows) if roots[i] == i]


def times_by_hand(rows, quality):
    size = {row[0]: len(brute.WORD.findall(row[1] or "")) for row in rows}
    sizes = defaultdict(int)
    for row in rows:
        sizes[row[3]] += size[row[0]]
    targets, times = targets_by_hand(sizes), {}

    def key(row):
        u = (int(hashlib.md5(f"42:{row[0]}".encode()).hexdigest()[:13], 16) + 1) / 2**52
        return -math.log(u) / {1: mixing.GOOD, 0: mixing.POOR, None: 1.0}[quality.get(row[0])]

    for source, total in sizes.items():
        epochs, before = int(targets[source] // total) if total else 0, 0
        rest = targets[source] - epochs * total
        for row in sorted((r for r in rows if r[3] == source), key=key):
            n = size[row[0]]
            times[row[0]] = epochs + (2 * before + n <= 2 * rest + 1e-9) if n else 0
            before += n
    return times


def test_pipeline_equals_plain_stages(spark, sf_dir, table):  # noqa: F811
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(row) for row in docs.select("doc_id", "text", "lang", "source", "n_chars").orderBy("doc_id").collect()]
    labels = {row.doc_id: row.quality for row in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good = kept_by_quality(spark, rows, sf_dir)
    assert len(good) < len(rows)
    mixed = kept_of_near(kept_exactly(good))
    times = times_by_hand(mixed, labels)
    taken = spark.createDataFrame([(row[1],) for row in mixed for _ in range(times[row[0]])], "text string")
    scores = pieces.unigram_scores(taken, MODEL)
    fitted = {piece: (i, scores[i]) for piece, (i, _) in table.items()}
    expected = []
    for row in mixed:
        ids = encode_by_hand(row[1] or "", fitted)
        one = (row[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256((row[1] or "").encode()).hexdigest(), True, ids)
        expected += [one] * times[row[0]]
    got = [tuple(row) for row in corpus_pipeline.run(spark, sf_dir).collect()]
    assert sorted(got) == sorted(expected)


@pytest.mark.parametrize("number", range(5))
def test_stages_take_awkward_and_empty_tables(spark, sf_dir, number):
    name, function = corpus_pipeline.STAGES[number]
    docs = brute.awkward(spark)
    out = function(spark, docs, sf_dir)
    assert out.count() > 0
    if number < 4:
        assert out.columns == docs.columns
    assert function(spark, brute.empty(spark), sf_dir).count() == 0


def test_extra_columns_keep_their_values(spark, sf_dir):
    """Columns with the names a stage uses, and maps, come out as they went in."""
    docs = brute.awkward(spark)
    kept = {(row.doc_id, row.text) for row in docs.collect()}
    for number in range(4):
        out = corpus_pipeline.STAGES[number][1](spark, docs, sf_dir)
        for row in out.collect():
            assert (row.doc_id, row.text) in kept
            assert all(row[name] == "clash" for name in brute.CLASHES) and row["tags"] == {"k": "v"}


def test_one_row_of_repeated_rows_stays(spark, sf_dir):
    docs = brute.awkward(spark)
    kept = corpus_pipeline.exact(spark, docs, sf_dir).select("doc_id", "text").collect()
    plain = [brute.clean(row.text) for row in kept]
    assert len(plain) == len(set(plain)) == len({brute.clean(row[1]) for row in brute.awkward_rows()})
