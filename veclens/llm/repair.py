"""Conversation structure repair: cheapest edits to a legal order of roles, by divide and conquer over cost vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veclens.session import stage

from . import query
from .texts import WHITE

#: States of the legal order ``(s?(ua)+)?``: nothing yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an inserted or changed row, which is a user's except after a user's.
TURN = np.array([USER, USER, ASSISTANT, USER])
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Kinds of rows: three faults for each initial.
INITIALS, FAULTS = "sua", 3
FINE, TRUNCATED, DOOMED = range(FAULTS)
NEVER = 1 << 40
#: Rows (or pieces) of one conversation that are solved together: 2 to this power.
BITS = 10


@dataclass(frozen=True)
class Costs:
    """What edits cost; ``truncated`` is added for a truncated row that stays. All whole, ``insert`` above 0."""

    keep: int = 0
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


def kept_state(state: int, initial: int) -> int | None:
    """The state after a kept row with this initial, if it may follow."""
    if initial == 0:
        return SYSTEM if state == START else None
    if initial == 1:
        return USER if state != USER else None
    return ASSISTANT if initial == 2 and state == USER else None


def row_steps(costs: Costs) -> tuple[np.ndarray, np.ndarray, list]:
    """Per kind of row, from state to state: the cost, the rank of the edits, and the edits.

    A step is some inserts and then one edit of the row. Of steps with one begin
    and end the cheapest counts, then the ASCII-least edits. Ranks order the
    steps of one begin by their edits.
    """
    kinds = (len(INITIALS) + 1) * FAULTS
    cost = np.full((kinds, 4, 4), NEVER, np.int64)
    edits = [[[""] * 4 for _ in range(4)] for _ in range(kinds)]
    for kind in range(kinds):
        initial, fault = divmod(kind, FAULTS)
        for begin in range(4):
            state = begin
            for inserts in range(3):  # two inserts come back to the same state
                after = [("D", state, costs.delete)]
                if fault != DOOMED:
                    stay = costs.truncated if fault == TRUNCATED else 0
                    after.append(("R", int(TURN[state]), costs.rerole + stay))
                    if (kept := kept_state(state, initial)) is not None:
                        after.append(("K", kept, costs.keep + stay))
                for edit, end, price in after:
                    found = (price + inserts * costs.insert, "I" * inserts + edit)
                    if found < (cost[kind, begin, end], edits[kind][begin][end] or "~"):
                        cost[kind, begin, end], edits[kind][begin][end] = found
                state = int(TURN[state])
    order = np.array([[np.argsort(np.argsort([edit or "~" for edit in row], kind="stable")) for row in of] for of in edits])
    return cost, order.astype(np.int64), edits


def closing(costs: Costs) -> tuple[np.ndarray, list[int]]:
    """Cost and number of the inserts that end a conversation, by state."""
    inserts = [0, 2, 1, 0]
    return np.array([n * costs.insert for n in inserts], np.int64), inserts


# ---- cost vectors of many segments at once


def forward(cost: np.ndarray, rank: np.ndarray, lo: np.ndarray, hi: np.ndarray, begin: np.ndarray):
    """For segments of items: cost of reaching each state from ``begin``, and the order of the states' least edits.

    Edits that lead through the same items to different states never begin one
    another, so two are in the order of where they part, and the rank of the
    state before an item and the item's own rank decide.
    """
    turn = np.argsort(lo - hi, kind="stable")  # long ones first: those still going on are a prefix
    lo, size = lo[turn], (hi - lo)[turn]
    f = np.full((len(lo), 4), NEVER, np.int64)
    f[np.arange(len(lo)), begin[turn]] = 0
    r = np.tile(np.arange(4), (len(lo), 1))
    for t in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -t, side="left"))
        c, own = cost[lo[:n] + t], rank[lo[:n] + t]
        total = f[:n, :, None] + c
        best = np.argmin(total * 4 + r[:n, :, None], axis=1)
        f[:n] = np.minimum(np.take_along_axis(total, best[:, None, :], 1)[:, 0, :], NEVER)
        key = np.take_along_axis(r[:n], best, 1) * 4 + np.take_along_axis(own, best[:, None, :], 1)[:, 0, :]
        r[:n] = np.argsort(np.argsort(key + 16 * (f[:n] >= NEVER), axis=1, kind="stable"), axis=1)
    back = np.empty_like(turn)
    back[turn] = np.arange(len(turn))
    return f[back], r[back]


def backward(cost: np.ndarray, lo: np.ndarray, hi: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Cost from each state through the items of a segment to ``end``."""
    turn = np.argsort(lo - hi, kind="stable")
    hi, size = hi[turn], (hi - lo)[turn]
    b = np.full((len(hi), 4), NEVER, np.int64)
    b[np.arange(len(hi)), end[turn]] = 0
    for t in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -t, side="left"))
        b[:n] = np.minimum((cost[hi[:n] - 1 - t] + b[:n, None, :]).min(axis=2), NEVER)
    back = np.empty_like(turn)
    back[turn] = np.arange(len(turn))
    return b[back]


def crossings(cost: np.ndarray, rank: np.ndarray, lo: np.ndarray, hi: np.ndarray, begin: np.ndarray, end: np.ndarray):
    """The state before and after every item on each segment's cheapest, then ASCII-least way from begin to end.

    Hirschberg's scheme: forward vectors of the first half and backward vectors
    of the second meet in the middle; of the states with the least sum the one
    with the least edits before it is the crossing, and both halves are solved
    the same way. Space is a vector per segment and a state per item.
    """
    before = np.zeros(len(cost), np.int64)
    after = np.zeros(len(cost), np.int64)
    while len(lo):
        one = hi - lo == 1
        before[lo[one]], after[lo[one]] = begin[one], end[one]
        lo, hi, begin, end = lo[~one], hi[~one], begin[~one], end[~one]
        if not len(lo):
            break
        mid = (lo + hi) // 2
        f, r = forward(cost, rank, lo, mid, begin)
        cross = np.argmin((f + backward(cost, mid, hi, end)) * 4 + r, axis=1)
        lo, hi = np.concatenate([lo, mid]), np.concatenate([mid, hi])
        begin, end = np.concatenate([begin, cross]), np.concatenate([cross, end])
    return before, after


# ---- tasks over sorted rows

ITEM = "conv string, at bigint, cost array<bigint>, rank array<bigint>"


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The same rows in tables that end where the first ``keys`` columns change; groups are small and contiguous."""

    def last_begin(table: pa.Table) -> int:
        begin = 0
        for k in range(keys):
            column = table.column(k)
            same = pc.fill_null(pc.equal(column, pa.scalar(column[len(column) - 1].as_py(), column.type)), False)
            differ = np.flatnonzero(~same.to_numpy(zero_copy_only=False))
            begin = max(begin, int(differ[-1]) + 1 if len(differ) else 0)
        return begin

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([*held, batch])
        begin = last_begin(table)
        if begin:
            yield table.slice(0, begin).combine_chunks()
        held = table.slice(begin).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def group_bounds(table: pa.Table, keys: int) -> tuple[np.ndarray, np.ndarray]:
    changed = np.zeros(len(table), bool)
    changed[0] = True
    for k in range(keys):
        codes = table.column(k).combine_chunks().dictionary_encode().indices.to_numpy()
        changed[1:] |= codes[1:] != codes[:-1]
    lo = np.flatnonzero(changed)
    return lo, np.append(lo[1:], len(table))


def items_of(table: pa.Table, costs: Costs) -> tuple[np.ndarray, np.ndarray]:
    """Matrices of rows (``kind, copies``) or of pieces (``cost, rank``)."""
    if "kind" in table.column_names:
        cost, rank, _ = row_steps(costs)
        kind, copies = table.column("kind").to_numpy(), table.column("copies").to_numpy()
        own = cost[kind] + (costs.delete * (copies - 1))[:, None, None]  # only doomed rows have copies
        return np.minimum(own, NEVER), rank[kind]
    flat = [table.column(name).combine_chunks().flatten().to_numpy().reshape(-1, 4, 4) for name in ("cost", "rank")]
    return flat[0], flat[1]


def dealt(items: DataFrame, bits: int) -> DataFrame:
    """Items together with their piece, in order, grouped by conversation and piece."""
    rest = [name for name in items.columns if name not in ("conv", "piece", "at")]
    return (
        items.withColumn("piece", F.expr(f"shiftright(at, {bits})"))
        .repartition("conv", "piece").sortWithinPartitions("conv", "at").select("conv", "piece", "at", *rest)
    )


def pieces(items: DataFrame, costs: Costs, bits: int) -> DataFrame:
    """One matrix for every run of items that share conversation and ``at >> bits``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 2):
            cost, rank = items_of(table, costs)
            lo, hi = group_bounds(table, 2)
            each = [forward(cost, rank, lo, hi, np.full(len(lo), state)) for state in range(4)]
            made = [np.stack([one[k] for one in each], axis=1).reshape(len(lo), 16) for k in range(2)]
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(one.reshape(-1)), 16).cast(pa.list_(pa.int64())) for one in made]
            picked = pa.array(lo)
            yield pa.RecordBatch.from_arrays(
                [table.column("conv").combine_chunks().take(picked), table.column("piece").combine_chunks().take(picked), *lists],
                ["conv", "at", "cost", "rank"],
            )

    return dealt(items, bits).mapInArrow(run, ITEM)


def states(items: DataFrame, costs: Costs, bits: int) -> DataFrame:
    """``conv, at, before, after``: the states around every item.

    Items are combined to pieces, pieces to larger ones until a conversation is
    one piece, whose end is the cheapest legal one. On the way back each piece
    hands its begin and end to its parts, which a task solves by ``crossings``.
    No task holds more than 2 ** bits items of a conversation.
    """
    parents = stage(pieces(items, costs, bits), "repair-pieces")
    if parents.groupBy("conv").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty():
        price, _ = closing(costs)
        ends = F.array(*[
            F.struct((F.col("cost")[q] + int(price[q])).alias("c"), F.col("rank")[q].alias("r"), F.lit(q).alias("q")) for q in range(4)
        ])
        bounds = parents.select("conv", F.col("at").alias("piece"), F.lit(START).alias("begin"), F.array_min(ends)["q"].alias("end"))
    else:
        up = states(parents, costs, bits)
        bounds = up.select("conv", F.col("at").alias("piece"), F.col("before").alias("begin"), F.col("after").alias("end"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 2):
            cost, rank = items_of(table, costs)
            lo, hi = group_bounds(table, 2)
            begin, end = (table.column(name).to_numpy()[lo] for name in ("begin", "end"))
            before, after = crossings(cost, rank, lo, hi, begin.astype(np.int64), end.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [table.column("conv").combine_chunks(), table.column("at").combine_chunks(), pa.array(before, pa.int32()), pa.array(after, pa.int32())],
                ["conv", "at", "before", "after"],
            )

    grouped = items.withColumn("piece", F.expr(f"shiftright(at, {bits})")).join(bounds, ["conv", "piece"])
    ordered = grouped.repartition("conv", "piece").sortWithinPartitions("conv", "at")
    rest = [name for name in ordered.columns if name not in ("conv", "piece", "at")]
    return stage(
        ordered.select("conv", "piece", "at", *rest).mapInArrow(run, "conv string, at bigint, before int, after int"), "repair-states"
    )


# ---- the operator


def conv_key(name: str = "conv_id"):
    """A string that tells conversations apart, null included."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))


def entries(rows: DataFrame) -> DataFrame:
    """Rows ``conv, turn, role, text, copies`` in order, with their kind; further copies of a row are one entry."""
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    rows = rows.withColumn("same", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    place = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"))
    first = rows.groupBy("conv", "same").agg(F.min(place).alias("first"))
    bare = F.rtrim("text", F.lit(WHITE))
    initial = F.when(F.length("role") > 0, F.instr(F.lit(INITIALS), F.substring("role", 1, 1))).otherwise(0)
    seen = rows.join(first, ["conv", "same"]).withColumns({
        "again": ~(F.col("first.turn").eqNullSafe(F.col("turn"))),
        "bare": bare,
        "initial": F.when(initial > 0, initial - 1).otherwise(len(INITIALS)),
    })
    fault = F.when(F.col("bare") == "", "blank").when(F.col("again"), "duplicate")
    cut = F.when(F.substring("bare", -1, 1).isin(".", "!", "?"), "").otherwise("truncated")
    parts = F.when(fault.isNotNull(), F.array(F.struct(fault.alias("fault"), F.col("copies")))).when(
        F.col("copies") == 1, F.array(F.struct(cut.alias("fault"), F.col("copies")))
    ).otherwise(F.array(F.struct(cut.alias("fault"), F.lit(1).cast("bigint").alias("copies")),
                        F.struct(F.lit("duplicate").alias("fault"), (F.col("copies") - 1).alias("copies"))))
    split = seen.select("conv", "turn", "role", "text", "initial", F.posexplode(parts).alias("part", "p"))
    number = F.when(F.col("p.fault") == "", FINE).when(F.col("p.fault") == "truncated", TRUNCATED).otherwise(DOOMED)
    split = split.select("conv", "turn", "role", "text", "part", "p.fault", "p.copies", (F.col("initial") * FAULTS + number).alias("kind"))
    # the beginnings of role and text part rows of one turn; the bounds that the driver samples stay short
    ranged = split.repartitionByRange("conv", "turn", F.substring("role", 1, 16), F.substring("text", 1, 16))
    ordered = ranged.sortWithinPartitions("conv", "turn", "role", "text", "part")
    return ordered.withColumn("at", F.monotonically_increasing_id())


def repair(rows: DataFrame, costs: Costs = Costs(), *, bits: int = BITS) -> DataFrame:
    """The cheapest edits that make every conversation's roles ``(s?(ua)+)?``; ties go to the ASCII-least edits.

    ``rows`` has ``conv`` (a string), ``turn``, ``role``, ``text`` without
    nulls but for turn, and ``copies``. Returns one row per entry, an entry
    being a row or its further copies: ``conv, at`` (its place), ``turn, role,
    text, copies, fault`` (``blank``, ``duplicate``, ``truncated`` or empty),
    ``inserts`` (rows put before it), ``edit`` (K, R, D), ``new_role`` (null if
    deleted), and the states ``before`` and ``after``. Rows of a conversation
    are in the order of turn (nulls first), role and text. A row counts as
    duplicate if an earlier one has the same role and text. An empty role has no
    initial and can't be kept. An empty table gives no rows.

    A conversation may be of any length: rows are put in order by ranges, so a
    long one lies over many tasks, and pieces of at most ``2 ** bits`` rows are
    solved on their own between states that are found on pieces of pieces.
    """
    found = stage(entries(rows), "repair-entries")
    known = states(found.select("conv", "at", "kind", "copies"), costs, bits)
    edits = row_steps(costs)[2]
    flat = F.array(*[F.lit(edits[kind][p][q]) for kind in range(len(edits)) for p in range(4) for q in range(4)])
    text = flat[F.col("kind") * 16 + F.col("before") * 4 + F.col("after")]
    return found.join(known, ["conv", "at"]).withColumn("steps", text).select(
        "conv", "at", "turn", "role", "text", "copies", "fault", "before", "after",
        (F.length("steps") - 1).alias("inserts"), F.substring("steps", -1, 1).alias("edit"),
    ).withColumn(
        "new_role",
        F.when(F.col("edit") == "K", F.col("role")).when(F.col("edit") == "R", F.when(F.col("after") == USER, "user").otherwise("assistant")),
    )


DIGEST = (
    "conv string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
    "repaired_sha256 string"
)


class Digest:
    """Figures of one conversation, row after row; holds its audit only."""

    def __init__(self, conv: str, costs: Costs):
        self.conv, self.costs, self.sha, self.first_line = conv, costs, hashlib.sha256(), True
        self.faults = {"": 0, "blank": 0, "duplicate": 0, "truncated": 0}
        self.least = self.last_turn = self.initial = None
        self.turns = self.illegal = self.cost = 0
        self.audit: list[str] = []
        self.state = START

    def line(self, role: str, text: str) -> None:
        self.sha.update((("" if self.first_line else "\n") + f"{role}:{text}").encode())
        self.first_line = False

    def insert(self, n: int) -> None:
        for _ in range(n):
            self.state = int(TURN[self.state])
            self.line(ROLE[self.state], "")
        self.cost += n * self.costs.insert

    def add(self, turn, role, text, copies, fault, inserts, edit, new_role, before, after) -> None:
        if turn is not None and turn != self.last_turn:
            self.least = turn if self.least is None else self.least
            self.last_turn, self.turns = turn, self.turns + 1
        initial = role[:1]
        if self.initial is not None:
            self.illegal += self.initial + initial not in ("su", "ua", "au")
        self.illegal += (copies - 1) * (initial + initial not in ("su", "ua", "au"))
        self.initial = initial
        self.faults[fault] += copies
        self.insert(inserts)
        self.audit.append("I" * inserts + edit * copies)
        self.cost += {"K": self.costs.keep, "R": self.costs.rerole, "D": self.costs.delete * copies}[edit]
        self.cost += self.costs.truncated * (fault == "truncated" and edit != "D")
        if new_role is not None:
            self.line(new_role, text)
        self.state = after

    def close(self) -> tuple:
        n = closing(self.costs)[1][self.state]
        self.insert(n)
        self.audit.append("I" * n)
        gaps = self.last_turn - self.least + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, self.faults["blank"], self.faults["duplicate"], self.faults["truncated"], self.illegal,
                self.cost, "".join(self.audit), self.sha.hexdigest())


def digests(repaired: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """Figures, audit and hash of every conversation's repaired ``role:text`` lines.

    A hash runs over a conversation from its first line to its last, so its rows
    pass through one task in order, as a stream of which only the audit is held.
    """
    names = ["turn", "role", "text", "copies", "fault", "inserts", "edit", "new_role", "before", "after"]
    schema = pa.schema([
        pa.field(name, pa.string() if kind == "string" else pa.int64()) for name, kind in (part.split() for part in DIGEST.split(", "))
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: Digest | None = None
        for batch in batches:
            done = []
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for conv, *row in zip(*columns, strict=True):
                if open_ is None or open_.conv != conv:
                    if open_ is not None:
                        done.append(open_.close())
                    open_ = Digest(conv, costs)
                open_.add(*row)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
        if open_ is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(open_.close(), schema, strict=True)], schema=schema)

    ordered = repaired.repartition("conv").sortWithinPartitions("conv", "at")
    return ordered.select("conv", F.col("turn").cast("bigint").alias("turn"), *names[1:]).mapInArrow(run, DIGEST)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows after the damage of the contract, chosen by ``crc32(conv_id:turn) % 20``; nulls are one space."""
    blank = F.lit(" ")
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    known = rows.select(
        conv_key().alias("conv"), "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"),
        (F.crc32(place) % 20).alias("harm"),
    ).where("harm != 0")
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return known.select(
        "conv", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.when(F.col("harm") == 3, 2).otherwise(1).cast("bigint").alias("copies"),
    )


def repaired_conversations(rows: DataFrame, *, bits: int = BITS) -> DataFrame:
    """Every ``conv_id`` of ``rows`` with the figures of its damaged and repaired conversation.

    A null conv_id is a conversation of its own; one with no rows after the
    damage has zeros, an empty audit and the hash of nothing. Rows that repeat a
    turn count one by one. Other columns are not read.
    """
    found = digests(repair(damaged(rows), bits=bits))
    everyone = rows.select("conv_id", conv_key().alias("conv")).distinct()
    zero = [name for name in found.columns if name not in ("conv", "audit", "repaired_sha256")]
    return everyone.join(found, "conv", "left").select(
        "conv_id",
        *[F.coalesce(name, F.lit(0).cast("bigint")).alias(name) for name in zero],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


@query("op11_repair")
def op11_repair(spark, sf_dir):
    return repaired_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
