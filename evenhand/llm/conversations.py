"""Repair of the structure of conversations, by dynamic programming over runs.

Every turn is a symbol: its role's initial and whether it must go, is cut short, or is sound. Equal symbols in a row
form a run. A symbol's step is a 4 x 4 matrix over (min, +), on what stands repaired so far: nothing, a system turn, a
user turn last, an assistant turn last. Its powers of two are kept, so a run of any length is a few products on the
costs that lie behind it. From the start the cheapest edits are then read off turn by turn, the ASCII-least first.

In Spark: repeats are found by role and text of a conversation, so that a long conversation is spread. For the order
only keys, marks and hashes are sorted; one byte a turn of a conversation meets in one task, as the audit, one value a
conversation, must. The digest is one running hash over a conversation's text; texts stream through it in order,
behind a line that holds the audit, and are never gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenhand.llm.common import shipped

# the repair ---------------------------------------------------------------------------------------------

INSERT, REROLE, DELETE, CUT_SHORT = 3, 3, 4, 3
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 60
#: Symbols: four times the fault (sound, blank, repeated, cut short) plus the role (user, assistant, system, other).
SOUND, BLANK, REPEATED, SHORT = range(4)
BLOCK = 256
_SPEAKS = (USER, USER, ASSISTANT, USER)  # who may speak after each state
_NEXT_ROLE = {USER: "user", ASSISTANT: "assistant"}


def _kept(symbol: int, state: int) -> int | None:
    """The state after keeping a turn, or None where its role may not stand."""
    role = symbol & 3
    if role < 2:
        return USER + role if _SPEAKS[state] == USER + role else None
    return SYSTEM if role == 2 and state == EMPTY else None


def _product(a: tuple, b: tuple) -> tuple:
    return tuple(tuple(min(FAR, *(x + b[k][j] for k, x in enumerate(row))) for j in range(len(b[0]))) for row in a)


#: Costs of inserting from one state to another.
_INSERTS = ((0, FAR, INSERT, 2 * INSERT), (FAR, 0, INSERT, 2 * INSERT), (FAR, FAR, 0, INSERT), (FAR, FAR, INSERT, 0))
_END = ((0,), (2 * INSERT,), (INSERT,), (0,))


@lru_cache(maxsize=None)
def power(symbol: int, k: int) -> tuple:
    """The (min, +) matrix of 2**k turns of one symbol, insertions before each of them included."""
    if k:
        half = power(symbol, k - 1)
        return _product(half, half)
    step = [[FAR] * 4 for _ in range(4)]
    extra = CUT_SHORT if symbol >> 2 == SHORT else 0
    for state in range(4):
        step[state][state] = DELETE
        if symbol >> 2 in (SOUND, SHORT):
            after = _kept(symbol, state)
            if after is not None:
                step[state][after] = extra
            speaker = _SPEAKS[state]
            step[state][speaker] = min(step[state][speaker], REROLE + extra)
    return _product(_INSERTS, tuple(map(tuple, step)))


def _before(symbol: int, length: int, costs: tuple) -> tuple:
    """The costs to the end from before a run, out of those from behind it."""
    k = 0
    while length:
        if length & 1:
            costs = _product(power(symbol, k), costs)
        length >>= 1
        k += 1
    return costs


def _symbol(code: int) -> int:
    """Turns that must go are alike, whatever their role."""
    return BLANK << 2 if code >> 2 in (BLANK, REPEATED) else code


def repair(codes: bytes) -> tuple[int, str]:
    """Cost and audit of the cheapest edits, the ASCII-least of ties: D, I, K, R in the order of the turns."""
    runs = [(s, sum(1 for _ in g)) for s, g in groupby(map(_symbol, codes))]
    behind = [_END]
    for symbol, length in reversed(runs):
        behind.append(_before(symbol, length, behind[-1]))
    behind.reverse()
    state, out = EMPTY, []

    for (symbol, length), end in zip(runs, behind[1:], strict=True):
        fault = symbol >> 2
        extra = CUT_SHORT if fault == SHORT else 0
        for start in range(0, length, BLOCK):
            size = min(BLOCK, length - start)
            left = [_before(symbol, length - start - size, end)]
            for _ in range(size):
                left.append(_product(power(symbol, 0), left[-1]))
            left.reverse()
            for now, after in zip(left, left[1:]):
                while True:
                    cost = now[state][0]
                    if cost == DELETE + after[state][0]:
                        out.append("D")
                        break
                    if cost == INSERT + now[_SPEAKS[state]][0]:
                        out.append("I")
                        state = _SPEAKS[state]
                        continue
                    kept = _kept(symbol, state)
                    if kept is not None and cost == extra + after[kept][0]:
                        out.append("K")
                        state = kept
                    else:
                        out.append("R")
                        state = _SPEAKS[state]
                    break
    while _END[state][0]:
        out.append("I")
        state = _SPEAKS[state]
    return behind[0][EMPTY][0], "".join(out)


@lru_cache(maxsize=50_000)
def _short(codes: bytes) -> tuple[int, str]:
    return repair(codes)


class Repaired:
    """Applies an audit to the turns of a conversation, one at a time: (role, text) of what stands repaired."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, EMPTY

    def _say(self) -> str:
        self.state = _SPEAKS[self.state]
        return _NEXT_ROLE[self.state]

    def _inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._say(), ""

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            yield self._say(), text
        elif edit == "K":
            self.state = SYSTEM if role[:1] == "s" else _SPEAKS[self.state]
            yield role, text

    def rest(self) -> Iterator[tuple[str, str]]:
        yield from self._inserted()


# the table ----------------------------------------------------------------------------------------------

BLANKS = r"\x20\x09-\x0D"


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy, gone): the turns after damage; a dropped one is marked, to keep its key.

    The crc32 of ``conv_id:turn`` (a null is a blank there as well) modulo 20 decides: 0 drops, 1 empties the text, 2
    takes its sentence ends, 3 repeats the turn, 4 makes it the user's.
    """
    blank = F.lit(" ")
    fate = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    return conversations.select(
        "conv_id",
        "turn",
        F.when(fate == 4, "user").otherwise(role).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        (fate == 0).alias("gone"),
    )


def _order() -> list[Column]:
    """Turns, nulls first; ties by role, then by a hash of the text, then the copy."""
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("h1"), F.col("h2"), F.col("copy")]


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64("text", F.lit(1))})


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, facts, audit) of every conversation; facts are gaps, blank, duplicate, truncated, illegal and cost."""
    blank = ~F.col("text").rlike(f"[^{BLANKS}]")
    short = ~F.col("text").rlike(rf"[.!?][{BLANKS}]*\z")
    initial = F.substring("role", 1, 1)
    marked = _hashed(rows).select(
        "conv_id", "turn", "role", "h1", "h2", "copy", "gone", blank.alias("blank"), short.alias("short"), initial.alias("initial")
    )
    same = Window.partitionBy("conv_id", "gone", "role", "h1", "h2").orderBy(F.col("turn").asc_nulls_first(), "copy")
    known = marked.withColumn("nth", F.row_number().over(same))
    # the number at the end decides nothing; it keeps the two windows apart, so that the first is dealt by role and text
    order = [F.col("gone"), *_order(), F.col("nth")]
    line = Window.partitionBy("conv_id").orderBy(*order)
    fault = F.when(F.col("blank"), BLANK).when(F.col("nth") > 1, REPEATED).when(F.col("short"), SHORT).otherwise(SOUND)
    role = F.when(F.col("initial") == "u", 0).when(F.col("initial") == "a", 1).when(F.col("initial") == "s", 2).otherwise(3)
    pair = F.concat(F.lag("initial").over(line), F.col("initial"))
    coded = known.select(
        "conv_id",
        "turn",
        *["gone", "role", "h1", "h2", "copy", "nth"],
        (fault * 4 + role).alias("code"),
        F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)).alias("illegal"),
    ).sortWithinPartitions("conv_id", *order).select("conv_id", "turn", "gone", F.col("code").cast("int").alias("code"), "illegal")
    key = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list = []  # the conversation at hand: key, codes, illegal pairs, least and largest turn, distinct turns

        def fact() -> tuple:
            conv, codes, illegal, low, high, turns = own
            cost, audit = (_short if len(codes) <= 64 else repair)(bytes(codes))
            faults = [sum(codes.count(4 * f + r) for r in range(4)) for f in (BLANK, REPEATED, SHORT)]
            return conv, [0 if low is None else high - low + 1 - turns, *faults, illegal, cost], audit

        for batch in batches:
            found = []
            for conv, turn, gone, code, illegal in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not own or own[0] != conv:
                    if own:
                        found.append(fact())
                    own = [conv, bytearray(), 0, None, None, 0]
                if gone:
                    continue
                own[1].append(code)
                own[2] += illegal
                if turn is not None:
                    if own[3] is None:
                        own[3] = turn
                    if own[4] != turn:
                        own[4] = turn
                        own[5] += 1
            if found:
                yield _facts(found, batch.column(0).type)
            kind = batch.column(0).type
        if own:
            yield _facts([fact()], kind)

    return coded.mapInArrow(run, f"conv_id {key}, facts array<bigint>, audit string")


def _facts(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    convs, facts, found = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(convs, kind), pa.array(facts, pa.list_(pa.int64())), pa.array(found, pa.string())], names=["conv_id", "facts", "audit"]
    )


FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repaired(conversations: DataFrame) -> DataFrame:
    """Damage and repair: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).

    One row for every conversation of the table, the null one included. Null roles and texts are one blank; turns are
    ordered with nulls first, ties by role and by a hash of the text; a repeated row is a duplicate. A conversation of
    which no turn is left has zeros, an empty audit and the digest of the empty text; an empty table has no row. A
    role counts by its first character as it is; one that is empty or another letter fits nowhere. Other columns are
    not read.
    """
    shipped(conversations.sparkSession)
    rows = damaged(conversations)
    key = rows.schema["conv_id"].dataType.simpleString()
    none = F.lit(None)
    heads = audits(rows).select(
        "conv_id", F.lit(0).alias("kind"), none.cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"),
        F.lit(0).alias("copy"), F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), "facts",
    )
    turns = _hashed(rows.where(~F.col("gone"))).select(
        "conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "copy", "h1", "h2", none.cast("array<bigint>").alias("facts")
    )
    stream = heads.unionByName(turns).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_order())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list = []  # the conversation at hand: key, facts, audit, the running digest, its edits

        def put(lines: Iterator[tuple[str, str]]) -> None:
            for role, text in lines:
                own[3].update(f"{own[5]}{role}:{text}".encode())
                own[5] = "\n"

        def row() -> tuple:
            put(own[4].rest())
            return own[0], *own[1], own[2], own[3].hexdigest()

        for batch in batches:
            found = []
            for conv, kind, role, text, facts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    if own:
                        found.append(row())
                    own = [conv, facts, text, hashlib.sha256(), Repaired(text), ""]
                else:
                    put(own[4].turn(role, text))
            if found:
                yield _rows(found, batch.column(0).type)
            key_type = batch.column(0).type
        if own:
            yield _rows([row()], key_type)

    longs = ", ".join(f"{c} long" for c in FACTS)
    return stream.select("conv_id", "kind", "role", "text", "facts").mapInArrow(run, f"conv_id {key}, {longs}, audit string, repaired_sha256 string")


def _rows(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = [kind, *[pa.int64()] * len(FACTS), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", *FACTS, "audit", "repaired_sha256"]
    )
