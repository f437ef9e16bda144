import hashlib
import random

from pyspark.sql import functions as F

from tallyspark.llm import chat

SCHEMA = f"conv_id long, turn int, role string, parts array<{chat.PART}>, formatted string, content string"


def text(t):
    return ("text", t, None, None, None, None, None)


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)


def nasty(rng):
    bits = [*chat.CONTROL, "\\", "<", "[", "s>", "/s>", "INST]", "IMG]", "\n", "é", "\U0001f600", " ok ", "$1"]
    return "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))


def test_control_strings_come_back(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", nasty(rng), None]), [text(nasty(rng))]) for c in range(40) for t in range(rng.randint(1, 6))]
    found = chat.format_conversations(turns_of(spark, rows))
    for r in found.withColumns({"turns": F.transform(chat.read_turns(F.col("formatted")), lambda x: F.struct(x["role"], chat.unescape(x["content"]))), "learned": chat.read_loss(F.col("formatted"), F.col("loss"))}).collect():
        want = [(role or "", parts[0][1]) for c, _, role, parts in rows if c == r.conv_id]
        assert [tuple(x) for x in r.turns] == want
        assert r.learned == [t for role, t in want if role == "assistant"] and len(r.loss) == len(r.learned)
        assert r.formatted.count("</s>") == r.formatted.count("[INST]") == r.n_turns == len(want)


def test_parts_are_flattened_in_order(spark):
    parts = [
        text("see [IMG]"), ("image", None, "a.png", 33, 16, None, None), text(" and "), None, ("AUDIO", None, "b.wav", None, None, 2.1, None), ("document", "title", "c.pdf", None, None, None, 3),
        ("video", None, "d.mp4", None, None, None, None), (None, "plain", None, None, None, None, None), (None, None, "e.bin", None, None, None, None), ("image", None, None, None, -5, None, None), text(None),
    ]
    r = chat.format_conversations(turns_of(spark, [(1, 0, "user", parts), (1, 1, "assistant", None), (1, 2, "assistant", [])])).withColumn("read", chat.read_parts(chat.read_turns(F.col("formatted"))[0]["content"])).head()
    assert r.formatted == r"[INST]user[/INST]see [\IMG][IMG] and [AUDIO][DOC][FILE]plain[FILE][IMG]</s>[INST]assistant[/INST]</s>[INST]assistant[/INST]</s>"
    assert [tuple(x) for x in r.attachments] == [(0, "image", "a.png", 3), (0, "audio", "b.wav", 27), (0, "document", "c.pdf", 2304), (0, "video", "d.mp4", 1), (0, "file", "e.bin", 1), (0, "image", None, 0)]
    assert r.n_attached_tokens == 2336 and [x.length for x in r.loss] == [0, 0]
    assert [tuple(x) for x in r.read] == [(None, "see [IMG]"), ("[IMG]", None), (None, " and "), ("[AUDIO]", None), ("[DOC]", None), ("[FILE]", None), (None, "plain"), ("[FILE]", None), ("[IMG]", None)]


def test_nulls_ties_long_texts_and_none(spark):
    rows = [(None, None, None, None), (None, 1, "assistant", [text("x")]), (2, 0, "assistant", [text("é" * 20_000)]), (2, 0, "assistant", [text("é" * 20_000)]), (2, 0, "assistant", [text("a")]), (2, None, "user", [text("first")])]
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(turns_of(spark, rows))).collect()}
    said = "a" + "é" * 40_000
    assert got[2].loss_chars == len(said) and got[2].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got[2].turns_sha256 == hashlib.sha256(("user\nfirst\n" + "assistant\na\n" + ("assistant\n" + "é" * 20_000 + "\n") * 2).encode()).hexdigest()
    assert got[None].n_turns == 2 and got[None].turns_sha256 == hashlib.sha256(b"\n\nassistant\nx\n").hexdigest()
    assert chat.format_conversations(turns_of(spark, rows).limit(0)).count() == 0


def test_a_long_conversation_is_read_back(spark):
    n = 4000
    turns = spark.range(n).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), chat.text_part(F.concat(F.col("id").cast("string"), F.lit("</s> é "), F.repeat(F.lit("w "), 200))).alias("parts"))
    r = chat.digests(chat.format_conversations(turns)).head()
    said = "".join(f"{i}</s> é " + "w " * 200 for i in range(1, n, 2))
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (n, len(said), hashlib.sha256(said.encode()).hexdigest())


def test_no_python_runs_on_executors(spark):
    plan = chat.digests(chat.format_conversations(turns_of(spark, []).select("conv_id", "turn", "role", "parts")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
