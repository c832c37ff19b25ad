"""Mixing, sharding and line rules against plain versions, on awkward rows and on the tables."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import brute
import duckdb
import pytest
from oracle import compare, connect

import veclens.llm as llm
from veclens.llm import line_rules, mixing, sharding

SQL_QUERIES = sorted(llm.SQL)


@pytest.mark.parametrize("name", SQL_QUERIES)
def test_query_equals_sql(spark, sf_dir, name):
    (names, rows), (sql_names, sql_rows) = compare(spark, connect(sf_dir), llm.QUERIES[name], llm.SQL[name], sf_dir)
    assert names == sql_names
    assert rows == sql_rows


def targets_by_hand(sizes: dict, weights=(3, 1, 2), percent=150, most=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values()) * percent / 100
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        open_w = sum(w[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and rest * w[s] > most * sizes[s] * open_w}
        if not over:
            return {s: most * sizes[s] if s in capped else rest * w[s] / open_w for s in order}
        capped |= over


def test_mix_of_awkward_rows(spark):
    rows = brute.awkward_rows()
    sizes = defaultdict(int)
    for row in rows:
        sizes[row[3]] += len(brute.WORD.findall(row[1] or ""))
    expected = targets_by_hand(sizes)
    docs = brute.awkward(spark)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    by_size = {size: source for source, size in sizes.items()}
    taken = Counter()
    for row in got:
        source = by_size[row.source_size]
        assert math.isclose(row.target, expected[source])
        assert row.taken == row.epochs * row["size"] and row.epochs <= 2
        taken[source] += row.taken
    largest = defaultdict(int)
    for row in rows:
        largest[row[3]] = max(largest[row[3]], len(brute.WORD.findall(row[1] or "")))
    assert all(abs(taken[s] - expected[s]) <= largest[s] / 2 for s in sizes)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_mix_prefers_heavy_rows(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "a") for i in range(2000)] + [(9000, "w " * 60000, "b")], "doc_id bigint, text string, source string")
    heavy = spark.createDataFrame([(i, 4.0) for i in range(0, 2000, 2)], "doc_id bigint, weight double")
    rows = mixing.mix(docs, weights=(1, 3), percent=40, quality=heavy).where("source_size = 20000").collect()
    even = sum(row.epochs for row in rows if row.doc_id % 2 == 0)
    odd = sum(row.epochs for row in rows if row.doc_id % 2)
    assert 0 < odd < even / 1.5


@pytest.mark.parametrize("operator", [mixing.mix, sharding.interleaved_shards, line_rules.line_rules])
def test_empty_tables(spark, operator):
    assert operator(brute.empty(spark)).count() == 0


def test_shards_of_awkward_rows(spark):
    rows = brute.awkward_rows()
    got = sharding.interleaved_shards(brute.awkward(spark), 4).collect()
    expected = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == expected
    slots = defaultdict(list)
    for row in got:
        slots[row.shard].append(row.slot)
    assert sorted(slots) == list(range(4))
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_shards_hold_the_mixture(spark, sf_dir):
    got = llm.QUERIES["op6_sharding"](spark, sf_dir).toPandas()
    docs = duckdb.sql(f"SELECT doc_id, source, text FROM '{sf_dir}/documents.parquet'").df().set_index("doc_id")
    assert sorted(got.doc_id) == sorted(docs.index)
    assert (got.text_crc32 == [zlib.crc32(t.encode()) for t in docs.text[got.doc_id]]).all()
    got["source"] = docs.source[got.doc_id].to_numpy()
    counts = got.groupby(["source", "shard"]).size().unstack(fill_value=0)
    assert (counts.max(axis=1) - counts.min(axis=1)).max() <= 2
    sizes = got.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1


def test_rows_of_small_sources_are_spread_and_keep_their_order(spark):
    # 4,000 sources of one row share the rank 1/2; those of three rows have it too, and ranks beside it
    rows = [(i, "t", f"one{i}") for i in range(4000)] + [(5000 + i, "t", f"three{i // 3}") for i in range(600)]
    rows += [(10_000 + i, "t", "many") for i in range(9000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    size = Counter(source for _, _, source in rows)
    key = {i: hashlib.md5(f"42:{i}".encode()).hexdigest() for i, _, _ in rows}
    seen, ranked = Counter(), []
    for i, _, source in sorted(rows, key=lambda row: key[row[0]]):
        seen[source] += 1
        ranked.append(((2 * seen[source] - 1) / (2 * size[source]), key[i], i))
    order = [i for _, _, i in sorted(ranked)]
    got = sharding.interleaved_shards(frame, 4).orderBy("shard", "slot").collect()
    assert [row.doc_id for row in got] == order
    ranks = spark.createDataFrame(ranked, "share double, key string, id bigint")
    largest = sharding.with_cell(ranks).groupBy("cell").count().agg({"count": "max"}).first()[0]
    assert largest < 300  # 200 sources of three share 1/6, too few to be cut; 4,200 rows have 1/2


def rules_by_hand(rows, max_docs, least_docs=3):
    hosts = Counter(row[3] for row in rows)
    limit = {host: min(max_docs, max(least_docs, n // 100)) for host, n in hosts.items()}

    def lines(text):
        return [line for line in (text or "").split("\n") if brute.WORD.search(line)]

    def plain(line):
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)
        return " ".join(brute.WORD.findall(lowered))

    seen = Counter((row[3], one) for row in rows for one in {plain(line) for line in lines(row[1])})
    out = []
    for row in rows:
        text = row[1] or ""
        words, own = brute.WORD.findall(text), lines(text)
        grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        covered = {k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(i, i + 3)}
        cut = sum(len(brute.WORD.findall(line)) for line in own if seen[row[3], plain(line)] > limit[row[3]])
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        kept = not failed and 100 * (len(words) - cut) >= 50 * len(words)
        out.append((row[0], len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(own) - len(set(own)),
                    len(covered), failed, kept, cut))
    return out


def test_line_rules_of_awkward_rows(spark):
    rows = brute.awkward_rows()
    got = line_rules.line_rules(brute.awkward(spark), max_docs=1).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, rules_by_hand(rows, 1)))


def test_line_rules_reject_depleted_documents(spark):
    common = brute.long_text(1, 40)
    rows = [(i, f"{common.upper() if i % 2 else common}\n{brute.long_text(50 + i, 20 + 3 * i)}", "en", "a", 0) for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = line_rules.line_rules(frame, max_docs=10).collect()
    expected = rules_by_hand(rows, 10)
    assert sorted(map(tuple, got)) == sorted(expected)
    assert {row[7] for row in expected} == {True, False}


def test_line_limits_follow_the_size_of_the_host(spark):
    # 1 % of 1,000 documents is 10, a small host has 3, no host more than 12 here; a null host is one of its own
    rows, host_of = [], [("large", 1000), ("small", 40), ("huge", 2000), (None, 30)]
    for host, size in host_of:
        for i in range(size):
            shared = [f"{host} line of {n} documents" for n in (3, 4, 10, 11, 12, 13) if i < n]
            text = "\n".join([brute.long_text(len(rows), 8 if i % 2 else 60), *shared])
            rows.append((len(rows), text, "en", host, 0))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = line_rules.line_rules(frame, max_docs=12).collect()
    expected = rules_by_hand(rows, 12)
    assert sorted(map(tuple, got)) == sorted(expected)
    touched = Counter(rows[row[0]][3] for row in expected if row[8])
    assert touched == {"large": 13, "small": 13, "huge": 13, None: 13}
    cut = {host: max(row[8] for row in expected if rows[row[0]][3] == host) for host, _ in host_of}
    assert cut["small"] == cut[None] == 5 * 5 and cut["large"] == 3 * 5 and cut["huge"] == 5


def test_lines_are_removed_on_the_whole_table(spark):
    got = llm.QUERIES["op10_line_rules"](spark, "/root/testdata/sf0.01")
    assert got.where("n_common_words > 0").count() >= 80
