from __future__ import annotations

import random

from evenhand.llm import linededup


def one_edit(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] or a[k + 1 :] == b[k:] or a[k:] == b[k + 1 :]


def brute(rows, least=20):
    place = lambda key, no: (key is None, key or 0, no)
    lines = [(place(k, n), x) for k, t in rows if t is not None for n, x in enumerate(t.split("\n")) if x.strip(" ")]
    out = []
    for key, text in rows:
        if text is None:
            out.append((key, None, 0, 0))
            continue
        parts = text.split("\n")
        kept = [
            x
            for n, x in enumerate(parts)
            if not x.strip(" ")
            or not any(p < place(key, n) and (y == x or (min(len(x), len(y)) >= least and one_edit(x, y))) for p, y in lines)
        ]
        out.append((key, "\n".join(kept), len(parts), len(parts) - len(kept)))
    return sorted(out, key=str)


def sample():
    draw = random.Random(2)
    line = lambda n: "".join(draw.choice("abcdé ñ.") for _ in range(n))
    base = [line(n) for n in (19, 20, 21, 22, 23, 24, 25, 31, 40, 41, 55, 120)]
    rows = [(k, "\n".join(draw.sample(base, 4))) for k in range(6)]
    for k in range(6, 40):
        x = draw.choice(base)
        at = draw.randrange(len(x))
        edit = draw.choice([x[:at] + x[at + 1 :], x[:at] + "X" + x[at:], x[:at] + "Y" + x[at + 1 :], x[:at] + "ZZ" + x[at + 1 :], "Q" + x[::-1]])
        rows.append((k, "\n".join([edit, draw.choice(base), "", "  "])))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "ok"), (104, "ok\nno"), (None, base[3]), (None, "own line of a row without a key"), (3, rows[3][1]), (3, "another text with that key\nok")]
    rows.append((105, "\n".join(f"a template line with number {n} in it" for n in range(30))))
    return rows


def test_rows(spark):
    rows = sample()
    docs = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, line string, pos int")
    out = linededup.deduplicated(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    got = sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect()), key=str)
    assert got == brute(rows)
    assert linededup.deduplicated(docs.limit(0)).count() == 0
