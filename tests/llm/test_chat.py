"""Chat windows against a plain restatement, and read back."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sitelens.llm import chat
from sitelens.llm.chat import chat_windows, escaped, learnt_text, turns_of, unescaped

SCHEMA = "conv_id long, turn long, role string, text string"
MARKS = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"]


def plain_escape(text):
    text = text.replace("\\", "\\\\")
    for mark in MARKS:
        text = text.replace(mark, mark[0] + "\\" + mark[1:])
    return text


def plain_windows(rows, budget, history):
    """(conv_id, text, loss, repeated turns) of every window, turn by turn."""
    found, half = [], budget // 2
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or ""))
        since, turns = 0, []
        for _, _, role, text in own:
            role, text = role or "", plain_escape(text or "")
            head = f"<|im_start|>{role.replace(' ', '+')}\n"
            cost = len(re.findall(chat.TOKEN, head + text + chat.CLOSE))
            turns.append((since, cost, role, head, text, (since // half, cost > half)))
            since += cost
        led = turns[0][2] == "system"
        for span in sorted({t[5] for t in turns}):
            fresh = [t for t in turns if t[5] == span]
            begin = fresh[0][0]
            told = [t for i, t in enumerate(turns) if begin - history <= t[0] < begin and not (led and i == 0)]
            lead = turns[:1] if led and begin > 0 else []
            text, loss = "", []
            for t in lead + told + fresh:
                text += t[3]
                if t[2] == "assistant" and t[0] >= begin:
                    loss.append((len(text), len(t[4])))
                text += t[4] + chat.CLOSE
            found.append((conv, text, loss, len(lead + told)))
    return found


def collected(windows):
    found = windows.select("conv_id", "text", "loss", "repeated").collect()
    return [(r[0], r[1], [tuple(s) for s in r[2]], r[3]) for r in found]


def conversations(n=60, seed=3):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(1, 30 if conv % 9 else 200)):
            role = "system" if turn == 0 and conv % 3 == 0 else ("user", "assistant")[turn % 2]
            words = [rng.choice(["a", "ночь", "\\", "word,", "\n", "x\\n", "𝒳y", *MARKS]) for _ in range(rng.choice([0, 3, 20, 90]))]
            rows.append((conv, turn, role, " ".join(words)))
    return rows


@pytest.mark.parametrize("budget, history", [(1024, 256), (200, 100), (64, 0), (2, 1)])
@pytest.mark.parametrize("most, least", [(None, 20_000), (50, 20)])
def test_equals_plain_windows(spark, budget, history, most, least):
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = collected(chat_windows(df, budget, history, most=most, least=least))
    assert sorted(got) == sorted(plain_windows(rows, budget, history))


def test_spans_keep_the_budget(spark):
    rows = conversations()
    for w in chat_windows(spark.createDataFrame(rows, SCHEMA), 300, 50).collect():
        turns = [t for t in re.split(r"(?<=<\|im_end\|>\n)", w["text"]) if t]
        costs = [len(re.findall(chat.TOKEN, t)) for t in turns]
        assert len(turns) == w["n_turns"] and sum(costs) == w["n_tokens"]
        fresh = costs[w["repeated"] :]
        assert len(fresh) == 1 or sum(fresh) <= 300
        system = turns[0].startswith("<|im_start|>system\n") and w["repeated"] > 0
        assert sum(costs[system : w["repeated"]]) <= 50


def test_every_turn_is_read_back_once(spark):
    rows = conversations(seed=8)
    windows = chat_windows(spark.createDataFrame(rows, SCHEMA), 200, 60)
    read = windows.select(
        "conv_id", "window", "repeated", turns_of(F.col("text")).alias("turns"), learnt_text(F.col("text"), F.col("loss")).alias("learnt")
    ).orderBy("conv_id", "window").collect()
    for conv in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == conv)
        back = [tuple(t) for r in read if r["conv_id"] == conv for t in r["turns"][r["repeated"] :]]
        assert back == [(r[2], r[3]) for r in own]
        learnt = "".join(r["learnt"] for r in read if r["conv_id"] == conv)
        assert learnt == "".join(r[3] for r in own if r[2] == "assistant")


def test_escape_is_reversible(spark):
    rng = random.Random(1)
    parts = ["\\", "<", "[", "/", ">", "]", "s", "INST", "n", "|", "im_end", *MARKS]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escaped(F.col("t")).alias("e"))
    for t, e, u in df.select("t", "e", unescaped(F.col("e"))).collect():
        assert e == plain_escape(t) and u == t and not any(m in e for m in MARKS)


def test_nulls_repeats_long_turns_and_other_columns(spark):
    rows = [
        (None, 0, "user", "none"),
        (None, None, "assistant", "first"),
        (1, 0, None, None),
        (1, 0, "a b", ""),
        (1, 1, "assistant", "long " * 60_000),
        (1, 2, "assistant", "same"),
        (1, 2, "assistant", "same"),
        (2, 0, "system", "only system"),
    ]
    extra = ["conv_id", "turn", "role", "text", "place", "since", "_key", "tie", "first", "cost"]
    df = spark.createDataFrame([(*r, *"123456") for r in rows], extra)
    got = collected(chat_windows(df, 100, 50))
    assert sorted(map(str, got)) == sorted(map(str, plain_windows(rows, 100, 50)))
    assert chat_windows(spark.createDataFrame([], SCHEMA)).isEmpty()
    fewer = chat_windows(spark.createDataFrame([(1, "hello")], "conv_id long, text string")).collect()
    assert fewer[0]["text"] == "<|im_start|>\nhello<|im_end|>\n" and fewer[0]["loss"] == []
    with pytest.raises(ValueError):
        chat_windows(df, 100, 51)


def test_one_conversation_with_most_turns(spark):
    rows = [(7, i, ("user", "assistant")[i % 2], f"turn {i} " * (i % 7)) for i in range(3000)]
    rows += [(7, 5000, "user", "again")] * 300 + [(i, 0, "user", "hi") for i in range(100, 900)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = collected(chat_windows(df, 120, 40, most=100, least=10))
    assert sorted(got) == sorted(plain_windows(rows, 120, 40))


def test_texts_are_shuffled_once_and_stay_in_spark(spark):
    plan = chat.op13_chat(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)
