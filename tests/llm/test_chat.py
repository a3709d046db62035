"""Maximal conversations against a comparison of all prefixes."""

import random

from sensorloom.llm.chat import format_chats


def brute(rows):
    chats = {}
    for conv, turn, role, text in {(c, t, r or "", x or "") for c, t, r, x in rows}:
        chats.setdefault(conv, []).append((turn is not None, turn or 0, role, text))
    chats = {c: [x[2:] for x in sorted(turns)] for c, turns in chats.items()}
    kept = {}
    for c, turns in chats.items():
        if not any(len(o) > len(turns) and o[: len(turns)] == turns for o in chats.values()):
            same = [k for k, v in chats.items() if v == turns and k is not None]
            if c == (min(same) if same else None):
                kept[c] = "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)
    return kept


def joined(df):
    out = {}
    for r in df.orderBy("part").collect():
        out[r.conv_id] = out.get(r.conv_id, "") + r.text
    return out


def test_random_snapshots(spark):
    rng = random.Random(3)
    rows = []
    for conv in range(120):
        for turn in range(rng.randint(1, 6)):
            rows.append((conv, turn, "user" if turn % 2 == 0 else "assistant", rng.choice("ab")))
    assert joined(format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))) == brute(rows)


def test_odd_rows(spark):
    long = [(50, i, "user", str(i)) for i in range(700)]
    rows = [(1, 0, None, None), (1, None, "user", "x"), (2, None, "user", "x"), (None, 0, "user", "lone"), (3, 5, "a", "b"),
            (4, 9, "a", "b"), (4, 9, "a", "b"), (5, 1, "a", "b"), (5, 1, "a", "c"), *long, *[(51, *r[1:]) for r in long[:600]]]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, position string")
    assert joined(format_chats(df)) == brute(rows)
    assert format_chats(df.limit(0)).collect() == []
