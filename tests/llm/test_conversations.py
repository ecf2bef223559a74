from __future__ import annotations

import hashlib
import heapq
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evenhand.llm import conversations as C


def cheapest(turns):
    """Search over (turns consumed, roles so far), least cost and then least audit; turns are (role initial, fault)."""
    heap, done = [(0, "", 0, "", False)], set()
    while heap:
        cost, audit, i, last, any_out = heapq.heappop(heap)
        if (i, last, any_out) in done:
            continue
        if i == len(turns) and last in ("", "a"):
            return cost, audit
        done.add((i, last, any_out))
        speaker = "a" if last == "u" else "u"
        heapq.heappush(heap, (cost + 3, audit + "I", i, speaker, True))
        if i < len(turns):
            role, fault = turns[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last, any_out))
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                heapq.heappush(heap, (cost + 3 + extra, audit + "R", i + 1, speaker, True))
                if role == speaker or (role == "s" and not any_out):
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, role, True))


FAULTS = {"sound": C.SOUND, "blank": C.BLANK, "duplicate": C.REPEATED, "truncated": C.SHORT}
ROLES = {"u": 0, "a": 1, "s": 2, "t": 3}


def coded(turns):
    return bytes(4 * FAULTS[f] + ROLES[r] for r, f in turns)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("uuaasst"), st.sampled_from(["sound", "sound", "truncated", "blank", "duplicate"])), max_size=9))
def test_equals_search(turns):
    assert C.repair(coded(turns)) == cheapest(turns)


@pytest.mark.parametrize("turns", [[("u", "sound")] * 40, [("a", "truncated")] * 23 + [("s", "sound")] * 9, [("t", "blank")] * 30 + [("u", "sound")]])
def test_long_runs_equal_search(turns):
    assert C.repair(coded(turns)) == cheapest(turns)


def test_blocks_and_powers_agree(monkeypatch):
    turns = coded([("u", "sound")] * 700 + [("s", "truncated")] * 300 + [("u", "sound"), ("a", "sound")] * 200)
    whole = C.repair(turns)
    monkeypatch.setattr(C, "BLOCK", 7)
    assert C.repair(turns) == whole
    assert C.repair(b"") == (0, "")


def brute(rows):
    """The contract, turn by turn."""
    out = {}
    for conv, *_ in rows:
        out[conv] = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out[conv] += [(turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    result = []
    for conv, turns in out.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0))
        seen, faults = set(), []
        for _, role, text in turns:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "sound"
            seen.add((role, text))
            faults.append(fault)
        initials = [t[1][:1] for t in turns]
        known = [t[0] for t in turns if t[0] is not None]
        cost, audit = cheapest(list(zip(initials, faults))) if turns else (0, "")
        lines, i, state = [], 0, ""
        for edit in audit:
            if edit == "I":
                state = "assistant" if state[:1] == "u" else "user"
                lines.append(f"{state}:")
                continue
            _, role, text = turns[i]
            i += 1
            if edit != "D":
                state = role if edit == "K" else "assistant" if state[:1] == "u" else "user"
                lines.append(f"{state}:{text}")
        result.append((
            conv, max(known) - min(known) + 1 - len(set(known)) if known else 0, faults.count("blank"), faults.count("duplicate"),
            faults.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        ))
    return sorted(result, key=str)


COLUMNS = ["conv_id", *C.FACTS, "audit", "repaired_sha256"]


def found(frame):
    got = C.repaired(frame)
    assert got.columns == COLUMNS
    return sorted(map(tuple, got.collect()), key=str)


def test_table(spark):
    texts = ["Yes.", "No!", "cut", "", None, " ", "end. \n", "Why?", "é.", " \t"]
    roles = ["user", "assistant", "system", None, "", "tool", "user", "assistant"]
    rows = [(c if c else None, t, roles[(c * 7 + t * 5) % 8], texts[(c * 3 + t * t) % 10]) for c in range(60) for t in range(c % 11)]
    rows += [(100, None, "user", "Where."), (100, 3, "user", "Where."), (100, 9, "assistant", "Here."), (101, None, "user", "a")]
    rows += [(102, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(700)]
    rows += [(103, t, "user", "Same.") for t in range(700)]
    rows += [(104, 4, "user", "x" * 100_000 + "."), (105, 0, "user", None)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, facts string, kind int")
    assert found(frame.repartition(5)) == brute(rows)


def test_repeated_rows_and_texts_as_keys(spark):
    rows = [("a", 1, "user", "Hi."), ("a", 1, "user", "Hi."), ("b", 2, "user", "."), (None, None, None, None)]
    frame = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    assert found(frame) == brute(rows)


def test_all_dropped_and_empty(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    frame = spark.createDataFrame([(conv, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert found(frame) == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert found(frame.limit(0)) == []
