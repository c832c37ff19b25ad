"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veclens.llm import repair

SOLID = re.compile(r"[^\x20\x09-\x0D]")
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}


def solve(rows, costs):
    """Costs to go by row and state from the end; at each place the first letter that stays cheapest."""
    n, far = len(rows), 10**9

    def options(i, q):
        yield "I", i, NEXT[q], costs.insert
        if i < n:
            initial, fault = rows[i]
            yield "D", i + 1, q, costs.delete
            if fault not in ("blank", "duplicate"):
                stay = costs.truncated * (fault == "truncated")
                kept = {"s": 1 if q == 0 else None, "u": 2 if q != 2 else None, "a": 3 if q == 2 else None}.get(initial)
                if kept is not None:
                    yield "K", i + 1, kept, costs.keep + stay
                yield "R", i + 1, NEXT[q], costs.rerole + stay

    to_go = [[far] * 4 for _ in range(n + 1)]
    to_go[n][0] = to_go[n][3] = 0
    for i in range(n, -1, -1):
        for _ in range(4):
            for q in range(4):
                for _, j, after, price in options(i, q):
                    to_go[i][q] = min(to_go[i][q], price + to_go[j][after])
    i, q, audit, kept = 0, 0, "", []
    while not (i == n and q in (0, 3)):
        for edit, j, after, price in sorted(options(i, q)):
            if price + to_go[j][after] == to_go[i][q]:
                if edit != "D":
                    kept.append((edit, i, after))
                audit, i, q = audit + edit, j, after
                break
    return to_go[0][0], audit, kept


def by_hand(rows):
    """All figures of a table of (conv_id, turn, role, text)."""
    convs = {}
    for conv, turn, role, text in rows:
        place = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        harm = zlib.crc32(place.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        own = convs.setdefault(conv, [])
        if harm == 1:
            text = ""
        if harm == 2:
            text = re.sub("[.!?]", "", text)
        if harm == 4:
            role = "user"
        own += [(turn, role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in own:
            solid = SOLID.findall(text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated")
            seen.add((role, text))
        cost, audit, kept = solve([(r[1][:1], f) for r, f in zip(own, faults, strict=True)], repair.Costs())
        lines = []
        for edit, i, after in kept:
            new = {2: "user", 3: "assistant"}.get(after)
            lines.append(f"{new}:" if edit == "I" else f"{own[i][1] if edit == 'K' else new}:{own[i][2]}")
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_every_order_of_few_rows():
    """Random kinds of rows under three sets of costs."""
    random.seed(5)
    for costs in (repair.Costs(), repair.Costs(insert=1), repair.Costs(keep=1, rerole=1, delete=1, insert=1, truncated=1)):
        cost, rank, edits = repair.row_steps(costs)
        price, inserts = repair.closing(costs)
        for _ in range(600):
            n = random.randint(1, 9)
            kinds = np.array([random.randrange(12) for _ in range(n)])
            c, r = cost[kinds], rank[kinds]
            f, order = repair.forward(c, r, np.array([0]), np.array([n]), np.array([0]))
            end = np.argmin((f + price) * 4 + order, axis=1)
            before, after = repair.crossings(c, r, np.array([0]), np.array([n]), np.array([0]), end)
            audit = "".join(edits[k][p][q] for k, p, q in zip(kinds, before, after)) + "I" * inserts[after[-1]]
            rows = [("suax"[k // 3], ["", "truncated", "blank"][k % 3]) for k in kinds]
            expected = solve(rows, costs)
            assert (int(f[0, end[0]] + price[end[0]]), audit) == expected[:2], rows


def rows_of(n, seed):
    rng = random.Random(seed)
    texts = ["Fine.", "so?", "cut off", "  ", "", None, "Same again!", "a ", "end.\n\t", "x" * 50, "été !"]
    roles = ["user", "assistant", "system", "tool", "User", None, "", "ux"]
    weights = [8, 8, 2, 1, 1, 1, 1, 1]
    rows = []
    for conv in [*range(n), None]:
        turns = list(range(rng.randint(1, 12)))
        for turn in turns:
            turn = rng.choice([turn, turn, turn, turn + 3, None])
            rows.append((conv, turn, rng.choices(roles, weights)[0], rng.choice(texts)))
    rows += rows[:5]
    rows += [(500, i, "user" if i % 2 else "assistant", f"Line {i % 40}.") for i in range(300)]
    rows += [(501, None, "user", f"text {i}.") for i in range(40)] + [(502, 7, "user", "the same.")] * 50
    return rows


@pytest.mark.parametrize("bits", [2, 10])
def test_repair_equals_plain_search(spark, bits):
    """Nulls, repeated turns and rows, long conversations over many pieces, clashing columns."""
    rows = rows_of(60, bits)
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    frame = frame.withColumns({name: F.lit("clash") for name in ("conv", "at", "copies", "kind", "piece", "harm", "cost")})
    got = repair.repaired_conversations(frame.repartition(5), bits=bits).collect()
    assert sorted(map(tuple, got), key=repr) == by_hand(rows)


def test_repair_of_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, repair.op11_repair(spark, sf_dir).collect()), key=repr) == by_hand(rows)


def test_repair_of_an_empty_table(spark):
    frame = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert repair.repaired_conversations(frame).count() == 0
