"""Plain versions of the operators for small tables, and rows with every awkward case."""

from __future__ import annotations

import collections
import hashlib
import itertools
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WHITE = " \t\n\x0b\x0c\r"
CLASHES = ["id", "n", "h", "key", "th", "row", "size", "bytes", "bucket", "label", "node", "score", "name", "cell", "text_hash", "_hash", "_n", "_copy", "_id", "_h", "_sha"]


def long_text(seed: int, n: int) -> str:
    return " ".join(hashlib.md5(f"{seed}-{i}".encode()).hexdigest()[: 3 + (i * 7 + seed) % 6] for i in range(n))


def awkward_rows() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars) with nulls, ties, repeated rows, copies, near copies and a long text."""
    base, shared = long_text(1, 400), long_text(2, 80)
    words = base.split()
    near = " ".join(words[:200] + ["changed"] + words[201:])
    texts = [
        base, near, base.upper(), base.replace(" ", "\n"), None, "", "   \n\t ", "one", "one two", "one two three four",
        "one two three four", "ONE two three four", shared, "x " + shared + " y", long_text(3, 60) + " " + shared,
        "é" * 300, "日本語 " * 120, "a" * 900, long_text(4, 6000), "line a b\n" * 30 + "line a b", "\U0001f642 \x00 tail",
        "pipes | * # $ % & < >", "z" * 199, "q" * 200, "q" * 200,
    ]
    rows = [(i, text, "en" if i % 3 else None, f"src{i % 3}" if i % 7 else None, i) for i, text in enumerate(texts)]
    rows += [rows[0], rows[4], (None, "no id here", None, None, None), (None, None, "en", "src0", None), (7, "one again", "en", "src1", 3)]
    return rows


def awkward(spark):
    frame = spark.createDataFrame(awkward_rows(), "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return frame.selectExpr("*", *[f"'clash' AS {name}" for name in CLASHES], "map('k', 'v') AS tags").repartition(3)


def empty(spark):
    return awkward(spark).limit(0)


def clean(text) -> str:
    return "".join(c for c in (text or "") if c not in WHITE)


def shingles(text, k: int) -> frozenset:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    words = WORD.findall(lowered)
    if len(words) < k:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def near_groups(texts: list, k: int, percent: int = 80) -> list[int]:
    """The number of the first member of each row's group."""
    sets, root = [shingles(text, k) for text in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = collections.defaultdict(list)
    for i, own in enumerate(sets):
        for one in own:
            holders[one].append(i)
    pairs = {pair for held in holders.values() for pair in itertools.combinations(held, 2)}
    for a, b in sorted(pairs):
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def without_repeats(texts: list, length: int) -> list[tuple]:
    """(bytes, removed, spans, hash of the rest) of each text."""
    data = [(text or "").encode() for text in texts]
    seen = collections.Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    result = []
    for b in data:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        rest = bytes(x for x, out in zip(b, gone, strict=True) if not out)
        spans = sum(out and (i == 0 or not gone[i - 1]) for i, out in enumerate(gone))
        result.append((len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return result
