"""Spelling variants against a plain comparison of all words."""

import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from veclens.llm import spelling

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(rows, every, least=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in LETTERS.findall(text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= least}
    gaps = {}
    for w in words:
        for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            gaps.setdefault(key, set()).add(w)
    near = {w: set() for w in words}
    for held in gaps.values():
        for a in held:
            near[a] |= {b for b in held if b not in near[a] and one_edit(a, b)}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abé", max_size=6), max_size=30))
def test_composition_gives_each_pair_once(words):
    acceptor = spelling.Acceptor(sorted(words))
    got = [tuple(sorted(pair)) for pair in acceptor.pairs()]
    expected = sorted((a, b) for a in words for b in words if a < b and one_edit(a, b))
    assert sorted(got) == expected


def test_acceptor_is_the_smallest():
    words = sorted(a + b for a in ("pre", "post", "per") for b in ("ing", "ed", "er", "es"))
    acceptor = spelling.Acceptor(words)
    futures = set()

    def future(state):
        return frozenset(([""] if acceptor.final[state] else []) + [c + rest for c, to in acceptor.arcs[state].items() for rest in future(to)])

    for state in range(len(acceptor.arcs)):
        futures.add(future(state))
    assert len(futures) == len(acceptor.arcs)
    assert future(acceptor.start) == frozenset(words)


def test_checksums():
    random.seed(3)
    runs = [bytes(random.choices(range(97, 123), k=random.choice([1, 3, 8, 64, 65, 300]))) for _ in range(500)]
    begin = np.array([zlib.crc32(f"{i}:".encode()) for i in range(500)], np.uint32)
    got = spelling.run_checksums(np.frombuffer(b"".join(runs), np.uint8), np.array([len(r) for r in runs]), begin)
    assert got.tolist() == [zlib.crc32(f"{i}:".encode() + run) for i, run in enumerate(runs)]


def misspelt(spark):
    """Awkward rows, and rows full of words in many spellings with chains of forms."""
    random.seed(11)
    base = ["example", "exemple", "exämple", "examples", "sexample", "aaaaaaa", "aaaaaaaa", "Ébéniste", "ébéniste", "×÷×÷×÷×", "summer", "sumer", "summmer"]
    rows = [(row[0], row[1]) for row in brute.awkward_rows()]
    for i in range(60):
        words = []
        for word in base:
            words += [word] * random.choice([0, 0, 1, 30 if word in ("example", "summer") else 1])
            at = random.randrange(len(word))
            words += [word[:at] + word[at + 1 :], word[:at] + random.choice("abé") + word[at:], word[:at] + "z" + word[at + 1 :]]
        random.shuffle(words)
        rows.append((i % 50 if i % 9 else None, random.choice([" ", "-", "1", "ā", "Ÿ"]).join(words)))
    rows += [(1, "y" * 5000 + " " + "example" * 40)] * 6
    return rows, spark.createDataFrame([(*row, "clash", "clash") for row in rows], "doc_id bigint, text string, word string, n string").repartition(4)


def test_variants_equal_plain_comparison(spark):
    rows, frame = misspelt(spark)
    for every in (0, 3, 199):
        got = sorted(map(tuple, spelling.variant_groups(frame, every=every).collect()))
        assert got == variants_by_hand(rows, every)
    assert any(row[1] is not None and row[1] != row[2] for row in got)


def test_variants_of_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = spelling.op13_spelling(spark, sf_dir).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got)) == variants_by_hand(rows, 199)


def test_variants_of_an_empty_table(spark):
    assert spelling.variant_groups(brute.empty(spark)).count() == 0
