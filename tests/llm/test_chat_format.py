from __future__ import annotations

import hashlib
import json
import random

import pytest

from affordspark.llm import chat_format as cf

from .conftest import frame

ODD = ["", " ", "\\", "\\\\", "#", "### Assistant: </turn> ok", "\\### Assistant: </turn> ok", "</turn>\n### User: x", "a\\", "<", ":", "é🙂", "\n\n", "### =x: ", "\\</turn>\\", "x" * 50000]


def digest(turns):
    h = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), h, len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_round_trip(spark):
    r = random.Random(1)
    rows, want = [], {}
    for c in [None, *range(40)]:
        turns = [(r.choice(["user", "assistant", "system", "tool: x\\#", "Assistant", "=", ""]), "".join(r.choice(ODD[:-1]) for _ in range(r.randint(0, 4)))) for _ in range(r.randint(1, 12))]
        if c == 3:
            turns.append(("assistant", ODD[-1]))
        want[c] = digest(turns)
        rows += [(c, i, a, b) for i, (a, b) in enumerate(turns)]
    rows.append((77, 0, None, None))
    want[77] = digest([("", "")])
    r.shuffle(rows)
    df = frame(spark, rows, "conv_id long, turn long, role string, text string").repartition(5)
    segments = cf.formatted(cf.canonical_turns(df, "conv_id"))
    got = {x["key"]: tuple(x)[1:5] for x in cf.read_back(segments).collect()}
    assert got == want
    for x in cf.conversations_text(cf.canonical_turns(df, "conv_id")).collect():
        turns = cf.parse(x["text"])
        assert digest([t[:2] for t in turns]) == want[x["key"]]
        assert [(s["start"], s["end"]) for s in x["spans"]] == [(a, b) for role, _, a, b in turns if role == "assistant" and b > a]


def test_marks_stand_only_between_turns():
    for t in ODD:
        escaped = t.replace("\\", "\\\\").replace("#", "\\#").replace("<", "\\<")
        whole = f"### User: {escaped}{cf.END}### Assistant: {escaped}{cf.END}"
        assert [(a, b) for a, b, _, _ in cf.parse(whole)] == [("user", t), ("assistant", t)]
    with pytest.raises(ValueError):
        cf.parse("### User: no end")


RECORDS = [
    ({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "ho"}]}, [("user", "hi"), ("assistant", "ho")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, [("user", "q"), ("assistant", "a")]),
    ({"system": "be good", "conversations": [{"from": "human", "value": "q"}]}, [("system", "be good"), ("user", "q")]),
    ({"instruction": "do", "output": "done"}, [("user", "do"), ("assistant", "done")]),
    ({"instruction": "do", "input": "this", "output": "done"}, [("user", "do\n\nthis"), ("assistant", "done")]),
    ({"instruction": "do", "input": "", "output": "done"}, [("user", "do"), ("assistant", "done")]),
    ({"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
    ({"response": "r", "prompt": "p"}, [("user", "p"), ("assistant", "r")]),
    ({"question": "w", "answer": None}, [("user", "w")]),
    ({"data": {"question": "w", "answer": "a", "context": "c"}}, [("user", "c\n\nw"), ("assistant", "a")]),
]


def test_layouts_of_records(spark):
    rows = [(i, json.dumps(r), "x") for i, (r, _) in enumerate(RECORDS)] + [(90, None, ""), (91, "not json", ""), (92, '{"other": 1}', ""), (93, "[1]", ""), (94, '{"messages": []}', "")]
    got = {}
    for r in cf.canonical_json(frame(spark, rows, "i long, rec string, layout string"), "i", "rec").collect():
        got.setdefault(r["key"], []).append((r["turn"], r["layout"], r["role"], r["text"]))
    for i, (_, want) in enumerate(RECORDS):
        assert [x[2:] for x in sorted(got[i])] == want
    assert all(got[i] == [(None, None, None, None)] for i in (90, 91, 92, 93))


def test_layouts_of_tables(spark):
    tables = [
        ("id long, messages array<struct<role:string,content:string>>", [(1, [("user", "a"), ("assistant", None)]), (2, None)], [(1, 0, "user", "a"), (1, 1, "assistant", "")]),
        ("id long, system string, conversations array<struct<from:string,value:string>>", [(1, "s", [("human", "a")]), (2, None, [])], [(1, -1, "system", "s"), (1, 0, "user", "a")]),
        ("id long, instruction string, input string, output string, text string", [(1, "a", "", "c", "z"), (2, None, None, None, "")], [(1, 0, "user", "a"), (1, 1, "assistant", "c")]),
        ("id long, data struct<question:string,answer:string,context:string>", [(1, ("q", "a", "c"))], [(1, 0, "user", "c\n\nq"), (1, 1, "assistant", "a")]),
    ]
    for schema, rows, want in tables:
        got = sorted(map(tuple, cf.canonical_turns(frame(spark, rows, schema), "id", extra=("text",)).collect()))
        assert got == want
    with pytest.raises(ValueError, match="fingerprint"):
        cf.canonical_turns(frame(spark, [], "id long, unknown string"), "id")


def test_empty(spark):
    df = frame(spark, [], "conv_id long, turn long, role string, text string")
    assert cf.read_back(cf.formatted(cf.canonical_turns(df, "conv_id"))).collect() == []
