"""Language-model scores: gradients, whole documents step by step, plain base scores, held-out gain."""

import math
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from veclens.llm import gru, lm_scoring


def tokens_of(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in brute.WORD.findall(text or "")] + [""]


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def base_by_hand(rows):
    """(id, held_out, n_tokens, n_known, N, base) of (id, text)."""
    counts = Counter(t for i, text in rows if not held(i) for t in tokens_of(text))
    total, kinds = sum(counts.values()), len(counts)
    out = []
    for i, text in rows:
        own = tokens_of(text)
        base = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (kinds + 1))) for t in own)
        out.append((i, held(i), len(own), sum(counts[t] > 0 for t in own), total, base))
    return out


def plain_logs(model, ids):
    """One document's log probability, step by step in plain loops over states."""
    n, h, before, total = gru.HIDDEN, np.zeros(gru.HIDDEN), gru.END, 0.0
    m = {name: value.astype(float) for name, value in model.items()}
    for token in ids:
        given, own = m["input"][before], h @ m["state"]
        z = 1 / (1 + np.exp(-(given[:n] + own[:n])))
        r = 1 / (1 + np.exp(-(given[n : 2 * n] + own[n : 2 * n])))
        h = (1 - z) * np.tanh(given[2 * n :] + r * own[2 * n :]) + z * h
        classes = h @ m["classes"] + m["class_bias"]
        of = token // gru.CLASS_WORDS if token < gru.HEAD else token - gru.HEAD + gru.HEAD_CLASSES
        total += classes[of] - np.log(np.exp(classes).sum())
        if token < gru.HEAD:
            words = (h @ m["words"] + m["word_bias"])[of * gru.CLASS_WORDS : (of + 1) * gru.CLASS_WORDS]
            total += words[token % gru.CLASS_WORDS] - np.log(np.exp(words).sum())
        before = token
    return total


def some_model(seed=1):
    rng = np.random.default_rng(seed)
    model = gru.start_model(rng.integers(1, 100, gru.HEAD), np.ones(gru.TAIL_CLASSES))
    return {name: value * (1 if name.endswith("bias") else 4) for name, value in model.items()}


def test_gradients():
    rng = np.random.default_rng(0)
    model = {name: value.astype(np.float64) for name, value in some_model().items()}
    shape = (6, 5)
    inputs, targets = (rng.integers(0, gru.HEAD + gru.TAIL_CLASSES, shape) for _ in range(2))
    targets[:3] = rng.integers(0, 200, (3, 5))
    fresh, valid, h = rng.random(shape) < 0.2, rng.random(shape) < 0.9, rng.standard_normal((gru.HIDDEN, 5))
    grad, _, _ = gru.gradients(model, inputs, targets, fresh, valid, h)
    for name, value in model.items():
        places = np.argwhere(np.abs(grad[name]) > 1e-4)
        for at in map(tuple, places[rng.integers(0, len(places), 10)]):
            old, losses = value[at], []
            for step in (1e-5, -1e-5):
                value[at] = old + step
                losses.append(gru.gradients(model, inputs, targets, fresh, valid, h)[2])
            value[at] = old
            assert (losses[0] - losses[1]) / 2e-5 == pytest.approx(grad[name][at], rel=1e-3, abs=1e-5)


def test_documents_are_scored_whole():
    """Long and short documents on any number of lanes have the score of a plain pass from their first token to their last."""
    rng, model = np.random.default_rng(2), some_model()
    sizes = np.array([1, 700, 3, 0, 45, 45, 2, 130, 1, 1])
    ids = rng.integers(0, gru.HEAD + gru.TAIL_CLASSES, sizes.sum())
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    expected = [plain_logs(model, ids[a:b]) for a, b in zip(offsets, offsets[1:])]
    for lanes in (1, 3, 256):
        assert gru.document_logs(model, ids, offsets, lanes) == pytest.approx(expected, rel=1e-4, abs=1e-4)


def test_probabilities_add_up():
    model, rng = some_model(), np.random.default_rng(3)
    h = np.repeat(rng.standard_normal((1, gru.HIDDEN)).astype(np.float32), gru.HEAD + gru.TAIL_CLASSES, axis=0)
    assert np.exp(gru.token_logs(model, h, np.arange(gru.HEAD + gru.TAIL_CLASSES))).sum() == pytest.approx(1, abs=1e-4)


def compare(spark, frame, rows):
    vocabulary, counted, tokens = lm_scoring.prepared(frame, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0)
    model = lm_scoring.train(tokens.where("NOT held_out"), vocabulary.start())
    got = lm_scoring.scores(tokens, counted, vocabulary, model).select("id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
    counts = Counter(t for i, text in rows if not held(i) for t in tokens_of(text))
    head = ["", *sorted((t for t in counts if t), key=lambda t: (-counts[t], t.encode()))[: min(gru.HEAD - 1, lm_scoring.KNOWN)]]
    number = {t: i for i, t in enumerate(head)}
    classes = {t: zlib.crc32(t.encode()[-3:] if len(t.encode()) <= lm_scoring.LONG else lm_scoring_name(t)[-3:]) % gru.TAIL_CLASSES for t in {t for _, text in rows for t in tokens_of(text)}}
    mass = Counter()
    for t, c in counts.items():
        if t not in number:
            mass[classes[t]] += c + 0.1

    def by_model(text):
        own = tokens_of(text)
        total = plain_logs(model, [number.get(t, gru.HEAD + classes[t]) for t in own]) / math.log(10)
        return total + sum(math.log10((counts[t] + 0.1) / (mass[classes[t]] + 0.1)) for t in own if t not in number)

    expected = [(*base, by_model(row[1])) for base, row in zip(base_by_hand(rows), rows)]
    key = lambda row: (repr(row[:5]), round(row[5], 6), row[6])
    got, expected = sorted(map(tuple, got), key=key), sorted(expected, key=key)
    assert [row[:5] for row in got] == [row[:5] for row in expected]
    for k in (5, 6):
        assert [row[k] for row in got] == pytest.approx([row[k] for row in expected], rel=1e-4, abs=1e-4)
    return got


def lm_scoring_name(word):
    import hashlib

    return b" " + hashlib.sha256(word.encode()).hexdigest().encode()


@pytest.mark.parametrize("known", [20, 1 << 18])
def test_scores_of_awkward_rows(spark, monkeypatch, known):
    """Nulls, empty and long texts and words, repeated rows, clashing columns; most words counted by a join, or few."""
    monkeypatch.setattr(lm_scoring, "KNOWN", known)
    monkeypatch.setattr(gru, "HEAD", 128)
    monkeypatch.setattr(gru, "HEAD_CLASSES", 2)
    rows = [(row[0], row[1]) for row in brute.awkward_rows()]
    compare(spark, brute.awkward(spark).withColumn("ids", F.lit("clash")), rows)


def test_scores_of_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(row) for row in docs.select("doc_id", "text").collect()]
    got = compare(spark, docs, rows)
    out = [row for row in got if row[1]]
    assert sum(row[6] for row in out) > 0.99 * sum(row[5] for row in out)  # both negative: no worse on rows never read


def test_no_rows_and_no_training_rows(spark):
    assert lm_scoring.score_documents(brute.empty(spark), F.lit(False)).count() == 0
    got = lm_scoring.score_documents(brute.awkward(spark), F.lit(True)).collect()
    assert len(got) == len(brute.awkward_rows())
    assert all(row.train_tokens == 0 and row.n_known == 0 and math.isfinite(row.score) for row in got)
