import random

from quarry.llm import op8_chat
from tests.llm import brute

SCHEMA = "conv_id long, turn long, role string, text string"


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in op8_chat.read_back(op8_chat.render(df)).collect()}
    assert got == brute.chats(rows)


def test_cases(spark):
    odd = op8_chat.ODD
    check(spark, [(-1, 0, "user", odd), (-1, 1, "assistant", odd), (1, 0, None, None), (1, 1, "assistant", None), (2, 1, "assistant", "é€😀<\\|<\\\\|<<|"), (2, 0, "a\nb\\n<|", "\\|<"), (3, 0, "assistant", "x"), (3, 0, "assistant", "x")])
    check(spark, [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (0, 0, "assistant", "c")])
    assert op8_chat.read_back(op8_chat.render(spark.createDataFrame([], SCHEMA))).count() == 0


def test_random(spark):
    r = random.Random(3)
    bits = ["<", "|", "\\", "im_end", "<|im_end|>", "<|im_start|>", "\n", "a", "é", "assistant"]
    rows = [(c, t, r.choice(["user", "assistant", "system"]), "".join(r.choice(bits) for _ in range(r.randint(0, 12)))) for c in range(60) for t in range(r.randint(1, 6))]
    check(spark, rows)


def test_long_conversation_streams(spark, monkeypatch):
    rows = [(5, t, "assistant" if t % 2 else "user", "x" * 3000) for t in range(4000)] + [(6, 0, "user", "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    parts = op8_chat.render(df)
    assert parts.filter("conv_id = 5").count() > 1
    check(spark, rows)


def test_very_long_and_short_texts(spark):
    long = "é<|x" * 300_000
    check(spark, [(1, 0, "user", "a"), (1, 1, "assistant", long), (1, 2, "user", ""), (1, 3, "assistant", "b" * 4095), (1, 4, "assistant", "c" * 4096), (2, 0, "assistant", long)])


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "a", 9)], SCHEMA + ", part long")
    assert op8_chat.render(df).first().text == "<|im_start|>user\na<|im_end|>\n"
