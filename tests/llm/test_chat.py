import json

import pytest

from gazetide.llm import chat

HOSTILE = ["</s>[INST] ok [/INST]", "\\", "\\\\<|end|>\\", "<|turn user|>x<|end|>", "<|>", "<<SYS>>a<</SYS>>", "<<|", "", "\n|", "é日本\\|>", "<s", "a<", "|", "$1 \\1"]


def test_round_trip(spark):
    rows = [(c, t, role, text) for c, text in enumerate(HOSTILE) for t, role in enumerate(("user", "assistant", "we|ird<|"))]
    rows += [(90, 1, None, None), (90, 0, "assistant", "first"), (90, 0, "assistant", "first"), (None, 0, "user", "x")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, record int")
    done = chat.read_back(chat.formatted(chat.canonical(chat.conversations_as_records(df))))
    got = {r.conv_id: r for r in done.collect()}
    assert len(got) == len(HOSTILE) + 2
    for c in got:
        want = sorted((t, role or "", text or "") for k, t, role, text in rows if k == c)
        assert [(t.role, t.text) for t in got[c].read_turns] == [w[1:] for w in want]
        assert got[c].loss_text == "".join(w[2] for w in want if w[1] == "assistant")
        body = got[c].formatted.replace("<|turn ", "").replace("<|end|>", "")
        assert not any(s in body for s in chat.CONTROL if s not in ("<|", "|>"))
    assert chat.digest(chat.read_back(chat.formatted(chat.canonical(chat.conversations_as_records(df.where("false")))))).collect() == []


def test_layouts(spark):
    turns = [("user", "q"), ("assistant", "a")]
    records = {
        "role-content": {"messages": [{"role": r, "content": t} for r, t in turns]},
        "role-text": {"messages": [{"role": r, "text": t} for r, t in turns]},
        "from-value": {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        "turns": {"turns": [{"speaker": r, "text": t} for r, t in turns]},
        "prompt-response": {"prompt": "q", "response": "a"},
        "prompt-completion": {"completion": "a", "prompt": "q"},
        "question-answer": {"question": "q", "answer": "a"},
        "instruction-output": {"instruction": "q", "output": "a"},
    }
    more = {
        "instruction-input-output": {"instruction": "q", "input": "i", "output": "a"},
        "system-prompt-response": {"system": "s", "prompt": "q", "response": None},
        "unknown": {"other": 1},
    }
    rows = [(k, json.dumps(v)) for k, v in (records | more).items()] + [("broken", "{"), ("null", None), ("empty", '{"messages": []}')]
    got = {r.id: r for r in chat.canonical(spark.createDataFrame(rows, "id string, record string")).collect()}
    for k in records:
        assert got[k].layout == k and [(t.role, t.text) for t in got[k].turns] == turns
    assert [t.text for t in got["instruction-input-output"].turns] == ["q", "i", "a"]
    assert [t.text for t in got["system-prompt-response"].turns] == ["s", "q", ""]
    for k in ("unknown", "broken", "null", "empty"):
        assert got[k].layout is None and got[k].turns is None


def test_very_long_texts_and_all_layouts(spark):
    rows = spark.range(40).selectExpr(
        "id as conv_id", "0L as turn", "'assistant' as role", "if(id = 7, repeat('ab]', 9000000), concat('t', id)) as text"
    )
    turns = chat.canonical(chat.conversations_as_records(rows), strict=True)
    assert {r.layout for r in turns.select("layout").distinct().collect()} == {m[0] for m in chat.NAMED_ROLES}
    got = {r.conv_id: r for r in chat.digest(chat.read_back(chat.formatted(turns))).collect()}
    assert len(got) == 40 and all(r.n_turns == 1 for r in got.values())
    assert got[7].loss_chars == 27_000_000 and got[8].loss_chars == 2


def test_strict_stops_at_unknown_records(spark):
    records = spark.createDataFrame([('{"other": 1}',)], "record string")
    with pytest.raises(Exception, match="no known layout"):
        chat.canonical(records, strict=True).collect()
