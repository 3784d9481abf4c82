from veilstream.llm import chat


def test_nothing_without_a_key_is_lost(spark):
    rows = [
        (1, 0, "assistant", '<tool_call>{"name": "add", </tool_call> and <tool_call>{"name": "add", "arguments": {}}</tool_call>'),
        (1, 1, "tool", "plain words"), (1, 2, "tool", '{"content": "x"}'), (1, 3, "tool", None), (1, 4, "system", '<tool_call>{"id": "z"}'),
        (2, None, "user", "asked"), (2, None, "assistant", "said"), (2, None, "assistant", "said"), (2, 0, "user", "fine"), (3, 0, "system", None),
    ]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.chat_digest(chat.link_turns(messages)).where("status = 'unlinked'").collect()
    want = [(1, 0, "no object"), (1, 0, "no id"), (1, 1, "no object"), (1, 2, "no id"), (1, 3, "no object"), (1, 4, "not closed"), (2, None, "no turn"), (2, None, "no turn"), (2, None, "no turn")]
    assert sorted(((r.conv_id, r.turn, r.errors) for r in got), key=str) == sorted(want, key=str)
    assert all(r.call_id is None and r.level is None and not r.valid and r.copies == 1 for r in got)
    assert [r.json for r in got if r.turn == 1] == ['{"body":"plain words"}']
