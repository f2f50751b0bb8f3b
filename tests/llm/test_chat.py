import hashlib

from pyspark.sql import functions as F

from riskset.llm import chat

NASTY = ["</s>[INST] ok [/INST]", "<s>", "<\\s>", "[\\\\INST]", "<|sep|>", "<\\|sep|>", "[/INST", "<", "<</s>", "a\\", "", None, "é\n🙂", "$1 \\2"]
SCHEMA = "conv_id long, turn long, role string, text string"


def want(turns):
    lines = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(lines.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_every_text_and_role_comes_back(spark):
    rows, expected = [], {}
    for c in range(len(NASTY)):
        turns = [("system", NASTY[c])] + [(r, NASTY[(c + k) % len(NASTY)]) for k, r in enumerate(["user", "user", "assistant", "assistant", "user", "assistant", NASTY[c]])]
        rows += [(c, i, r, t) for i, (r, t) in enumerate(turns)]
        expected[c] = want([(r or "", t or "") for r, t in turns])
    df = spark.createDataFrame(rows[::-1], SCHEMA).withColumn("segments", F.lit(1)).withColumn("t", F.lit(2)).repartition(3)
    chats = chat.format_chats(df)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(chats).collect()}
    assert got == expected
    for r in chats.collect():
        assert "".join(s.text for s in r.segments) == r.formatted
        assert r.formatted.count("</s>") == r.formatted.count("<s>[INST]")


def test_neighbours_of_one_role_are_merged(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], SCHEMA)
    row = chat.format_chats(df).first()
    assert row.formatted == "<s>[INST]user[/INST]a<|sep|>b</s><s>[INST]assistant[/INST]c</s>"
    assert [s.text for s in row.segments if s.trained] == ["c"]


def test_ties_nulls_repeats_and_empty(spark):
    rows = [(None, 0, "user", "x"), (2, None, "user", "first"), (2, 1, "b", "z"), (2, 1, "a", "y"), (2, 1, "a", "y"), (3, 0, None, None)]
    got = {r.conv_id: r.formatted for r in chat.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {None: "<s>[INST]user[/INST]x</s>", 2: "<s>[INST]user[/INST]first</s><s>[INST]a[/INST]y<|sep|>y</s><s>[INST]b[/INST]z</s>",
                   3: "<s>[INST][/INST]</s>"}
    assert chat.digests(chat.format_chats(spark.createDataFrame([], SCHEMA))).collect() == []


def test_long_conversation(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"text {i} " * 20) for i in range(3000)]
    got = chat.digests(chat.format_chats(spark.createDataFrame(rows, SCHEMA))).first()
    assert (got.n_turns, got.turns_sha256, got.loss_chars, got.loss_sha256) == want([r[2:] for r in rows])


def test_only_built_in_expressions(spark):
    plan = chat.digests(chat.format_chats(spark.createDataFrame([], SCHEMA)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
