"""Exact, near and substring deduplication against plain versions."""

import hashlib
import random
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from veclens.llm import exact_dedup, minhash, substring_dedup
from veclens.llm.texts import flat


def ordered(rows):
    return sorted(rows, key=repr)


def exact_by_hand(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[brute.clean(row[1])].append(row)
    out = []
    for plain, members in groups.items():
        keep = min(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0]
        digest = hashlib.sha256(plain.encode()).hexdigest()
        out += [(r[0], keep, len(members), r[0] == keep, digest) for r in members]
    return out


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups_compare_bytes(spark, weak):
    key = F.concat(F.lit("k"), F.length(F.translate(F.coalesce("text", F.lit("")), brute.WHITE, "")) % 3) if weak else None
    got = [tuple(row) for row in exact_dedup.exact_groups(brute.awkward(spark), key=key).collect()]
    assert ordered(got) == ordered(exact_by_hand(brute.awkward_rows()))


def test_exact_groups_of_an_empty_table(spark):
    assert exact_dedup.exact_groups(brute.empty(spark)).count() == 0


@pytest.mark.parametrize("words", [4, 5])
def test_near_groups(spark, words):
    rows = brute.awkward_rows()
    roots = brute.near_groups([row[1] for row in rows], words)
    ids = defaultdict(list)
    for row, root in zip(rows, roots, strict=True):
        if brute.shingles(row[1], words):
            ids[root].append(row[0])
    expected = []
    for row, root in zip(rows, roots, strict=True):
        own = brute.shingles(row[1], words)
        least = min((i for i in ids[root] if i is not None), default=None) if own else row[0]
        expected.append((row[0], len(own), least, row[0] == least))
    got = minhash.near_duplicates(brute.awkward(spark), words=words).drop("text_hash").collect()
    assert ordered(tuple(row) for row in got) == ordered(expected)


def test_near_groups_of_an_empty_table(spark):
    assert minhash.near_duplicates(brute.empty(spark)).count() == 0


def chain(n, step=3, size=60):
    """Texts of which each is linked with the next ones only, and a group of dissimilar near copies."""
    words = [f"w{i}" for i in range(size + n * step)]
    texts = [" ".join(words[i * step : i * step + size]) for i in range(n)]
    rng = random.Random(3)
    base = [f"v{i}" for i in range(120)]
    for k in range(60):
        own = list(base)
        for at in rng.sample(range(120), 1 + k % 7):
            own[at] = f"u{k}-{at}"
        texts.append(" ".join(own))
    rng.shuffle(texts)
    return texts


def test_near_groups_lose_no_link(spark):
    texts = chain(40)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {row.doc_id: row.component_id for row in minhash.near_duplicates(frame, words=4).collect()}
    assert [got[i] for i in range(len(texts))] == brute.near_groups(texts, 4)


def test_min_max_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    close = []
    for at in range(0, 1500, 10):
        a, b = minhash.min_max(pool[at : at + 900]), minhash.min_max(pool[at + 100 : at + 1000])
        close.append(np.mean([(x == y).mean() for x, y in zip(a, b, strict=True)]))
    assert abs(np.mean(close) - 0.8) < 0.02


def repeats_by_hand(rows, length):
    return [(row[0], *rest) for row, rest in zip(rows, brute.without_repeats([r[1] for r in rows], length), strict=True)]


@pytest.mark.parametrize("many", [20_000, 2])
def test_repeated_strings_are_removed(spark, monkeypatch, many):
    monkeypatch.setattr(substring_dedup, "MANY", many)
    got = substring_dedup.drop_repeats(brute.awkward(spark)).collect()
    assert ordered(tuple(row) for row in got) == ordered(repeats_by_hand(brute.awkward_rows(), 200))


def test_repeated_strings_with_hot_keys_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SAMPLE", 1.0)
    monkeypatch.setattr(substring_dedup, "HOT_LEAST", 4)
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 1 << 10)
    shared = brute.long_text(9, 60)
    texts = [brute.long_text(20 + i, 30) + shared + brute.long_text(60 + i, 30 + i) for i in range(12)] + ["ab" * 300] * 3
    rows = [(i, text) for i, text in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = substring_dedup.drop_repeats(frame, with_text=True).collect()
    expected = repeats_by_hand(rows, 200)
    assert ordered(tuple(row)[:-1] for row in got) == ordered(expected)
    assert all(hashlib.sha256(row.kept).hexdigest() == row.kept_sha256 for row in got)


def near_copies(n):
    """Copies of a text with one letter changed, each elsewhere, and texts that share its middle."""
    base = brute.long_text(70, 90)
    texts = [base[: 3 * i] + "#" + base[3 * i + 1 :] for i in range(n)]
    return [(i, text) for i, text in enumerate(texts + [brute.long_text(300 + i, 5 + i) + base[120:360] for i in range(10)])]


@pytest.mark.parametrize("many", [2, 25])
def test_hot_keys_do_not_become_a_row_per_string(spark, monkeypatch, many):
    """Segments of a hot key are cut into a few parts each, and a part that has its finer key alone ends there."""
    made, kept = {}, substring_dedup.stage

    def counting(df, name, **options):
        made[name] = kept(df, name, **options)
        return made[name]

    rows = near_copies(150)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    for name, value in {"MANY": many, "SAMPLE": 1.0, "HOT_LEAST": 4, "stage": counting}.items():
        monkeypatch.setattr(substring_dedup, name, value)
    got = substring_dedup.drop_repeats(frame).collect()
    assert ordered(tuple(row) for row in got) == ordered(repeats_by_hand(rows, 200))
    strings = made["repeats"].where(f"rep AND m > {many}").agg({"n": "sum"}).first()[0]
    assert 4 * made["parts"].count() < strings
    assert ("strings" in made) == (many == 2)
    assert "strings" not in made or 4 * made["strings"].count() < strings


def test_parts_of_segments_keep_equal_strings_together():
    rng = np.random.default_rng(3)
    data, offsets = rng.integers(97, 99, 6000).astype(np.uint8), np.array([0, 2500, 6000])
    data[3000:3400] = data[100:500]
    row, start, n, keys, _ = substring_dedup.segments(data, offsets, 200)
    pieces = [data[offsets[r] + s : offsets[r] + s + m + 199] for r, s, m in zip(row, start, n, strict=True)]
    bounds = np.cumsum([0, *map(len, pieces)])
    owner, offset, count, finer, content = substring_dedup.segment_parts(np.concatenate(pieces), bounds, n, keys, 200, 16)
    assert np.bincount(owner, count).astype(int).tolist() == n.tolist() and count.max() <= 16
    found, contents = {}, {}
    for i, o, m, key, sh in zip(owner, offset, count, finer, content, strict=True):
        contents.setdefault(sh, set()).add(pieces[i][o : o + m + 199].tobytes())
        for k in range(o, o + m):
            found.setdefault(pieces[i][k : k + 200].tobytes(), set()).add(key)
    assert all(len(x) == 1 for x in found.values()) and all(len(x) == 1 for x in contents.values())
    assert len(found) < n.sum()


def test_distinct_texts_under_one_id_stay_apart(spark):
    """Rows are known by their number: of many texts under one id, or none, each loses only its own repeats."""
    shared = brute.long_text(50, 50)
    rows = [(doc_id, brute.long_text(100 + i, 60) + (shared if i % 40 == 0 else "")) for i in range(400) for doc_id in (None, 7)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = substring_dedup.drop_repeats(frame).collect()
    assert ordered(tuple(row) for row in got) == ordered(repeats_by_hand(rows, 200))


def test_repeated_strings_of_an_empty_table(spark):
    assert substring_dedup.drop_repeats(brute.empty(spark)).count() == 0


@pytest.mark.parametrize("depth", [8, 9, 20, 50])
def test_shared_prefixes(depth):
    rng = random.Random(depth)
    pieces = [bytes(rng.choices(b"ab", k=rng.randint(depth, 90))) for _ in range(12)]
    pieces += [pieces[0], pieces[3][:depth], b"a" * 80]
    seen = Counter(p[i : i + depth] for p in pieces for i in range(len(p) - depth + 1))
    expected = [seen[p[i : i + depth]] > 1 for p in pieces for i in range(len(p) - depth + 1)]
    assert substring_dedup.repeated_starts(pieces, depth).tolist() == expected


def test_segments_hold_every_string_once():
    import pyarrow as pa

    texts = [brute.long_text(i, 90) for i in range(4)] + ["", "short", "x" * 500]
    data, offsets = flat(pa.array(texts))
    row, start, n, _, _ = substring_dedup.segments(data, offsets, 200)
    held = sorted((r, s + k) for r, s, m in zip(row, start, n, strict=True) for k in range(m))
    assert held == [(r, i) for r, text in enumerate(texts) for i in range(len(text) - 199)]


def twice_by_segments(data, offsets, length):
    """Which strings occur again, as keys and contents tell: brute force over the segments of each key."""
    row, start, n, keys, _ = substring_dedup.segments(data, offsets, length)
    assert n.max() <= 255
    raw, at = data.tobytes(), offsets[:-1][row] + start
    return sorted(
        (int(r), int(s) + k)
        for key in set(keys.tolist())
        for own in [np.flatnonzero(keys == key)]
        for seen in [Counter(raw[at[i] + k : at[i] + k + length] for i in own for k in range(n[i]))]
        for i in own
        for r, s in [(row[i], start[i])]
        for k in range(n[i])
        if seen[raw[at[i] + k : at[i] + k + length]] > 1
    )


@pytest.mark.parametrize("length", [200, 600])
def test_equal_strings_share_a_key_in_texts_longer_than_the_index(monkeypatch, length):
    import pyarrow as pa

    monkeypatch.setattr(substring_dedup, "INDEX_BITS", 9)
    shared = brute.long_text(5, 300)
    texts = [brute.long_text(1, 700) + shared + brute.long_text(2, 500), "é" + shared + brute.long_text(3, 900) + shared]
    data, offsets = flat(pa.array(texts))
    raw = [text.encode() for text in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    expected = [(r, i) for r, b in enumerate(raw) for i in range(len(b) - length + 1) if seen[b[i : i + length]] > 1]
    assert len(expected) > 1000
    assert twice_by_segments(data, offsets, length) == expected


def test_a_repeat_behind_sixteen_mebibytes_is_found():
    rng = np.random.default_rng(3)
    shared = rng.integers(97, 123, 400, dtype=np.uint8)
    data = np.concatenate([rng.integers(97, 123, (1 << 24) + 5000, dtype=np.uint8), shared, shared[::-1], shared])
    _, start, n, keys, _ = substring_dedup.segments(data, np.array([0, len(data)]), 200)
    tail = len(data) - 1200

    def key_of(at):
        return keys[np.flatnonzero(start <= at)[-1]]

    assert n.sum() == len(data) - 199
    assert all(key_of(tail + k) == key_of(tail + 800 + k) for k in range(201))


def test_long_strings_are_removed(spark):
    shared = brute.long_text(8, 200)
    rows = [(0, brute.long_text(6, 300) + shared), (1, shared + brute.long_text(7, 300)), (2, "ab" * 900), (3, brute.long_text(9, 500))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = substring_dedup.drop_repeats(frame, length=700).collect()
    assert ordered(tuple(row) for row in got) == ordered(repeats_by_hand(rows, 700))
