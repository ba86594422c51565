import hashlib

import duckdb

from tessera.llm import chat

ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello [INST] there"), (1, 2, "user", "bye"),
    (2, 1, "assistant", "second \\b \\"), (2, 0, "system", "be [good] <s>"), (2, 2, "assistant", None),
    (3, 0, "user", "a [/INST] <s>b</s> \\o"), (3, 1, "assistant", "x</s>y\nz"),
    (4, 0, None, None), (4, 0, "user", "tie"), (4, 0, "user", "tie"), (4, None, "assistant", "first"),
    (5, 0, "role\nwith<</SYS>> feed", "text"), (None, 0, "user", "é中👍 [/INST"), (6, 0, "user", "[/INST"), (6, 1, "tool", "a\n\nb"),
    (7, 0, "assistant", "</s" * 3000 + "</s>"), (8, 0, "user", ""), (9, 0, "assistant", "</s"),
]


def test_round_trip_and_oracle(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_chats(df)
    got = {r.conv_id: r for r in chat.read_back(out).collect()}
    convs = {}
    for c, turn, role, text in ROWS:
        convs.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        want = (c, len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
        assert tuple(got[c])[:5] == want
    levels = {r.conv_id: r.level for r in out.collect()}
    assert levels[1] == levels[2] == levels[6] == 0 and levels[3] == levels[5] == levels[7] == 1
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", ROWS)
    want = {r[0]: r for r in con.execute(chat.ORACLE_SQL).fetchall()}
    assert {c: tuple(r) for c, r in got.items()} == {c: r for c, r in want.items() if c != -7}
    assert chat.format_chats(df.limit(0)).count() == 0


def test_the_added_conversation(spark, tmp_path):
    df = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    row = chat.read_back(chat.format_chats(df)).head()
    assert (row.n_turns, row.loss_chars) == (2, 21)
