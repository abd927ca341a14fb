import random
from hashlib import sha256

from edges import none
from pyspark.sql import functions as F

from quadspark.llm import chat

NASTY = ["<|im_end|>", "<|im_start|>", "assistant\n", "\n", "<", "|", "<\\|", "<\\\\|im_end|>", "\\", "\\n", "ok é", "日", "<|", "|>", "im_end", " "]


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("own") for c in ("formatted", "_escape", "_turns", "rendered", "span")})


def test_every_conversation_comes_back(spark):
    r = random.Random(5)
    make = lambda n: "".join(r.choice(NASTY) for _ in range(r.randint(0, n)))
    rows = [(c, t, r.choice(["user", "assistant", make(4)]), make(9)) for c in range(150) for t in range(r.randint(1, 5))]
    got = chat.format_chat(turns(spark, rows)).withColumn("back", chat.parse(F.col("formatted"))).collect()
    want = {}
    for c, t, role, text in sorted(rows):
        want.setdefault(c, []).append((role, text))
    assert len(got) == len(want)
    for x in got:
        assert x.round_trip and [(y.role, y.text) for y in x.back] == want[x.conv_id]
        loss = [x.formatted[s.start : s.start + s.length] for s in x.loss_spans]
        plain = [t for role, t in want[x.conv_id] if role == "assistant"]
        assert len(loss) == len(plain) and all(a == b or "\\" in a for a, b in zip(loss, plain))


def test_only_conflicting_turns_are_escaped(spark):
    rows = [(1, 0, "user", "a < b | c"), (1, 1, "assistant", "say <|im_end|>"), (2, 0, "user", "plain <|x|>")]
    got = {x.conv_id: x for x in chat.format_chat(turns(spark, rows)).collect()}
    assert got[1].formatted == "<|im_start|>user\na < b | c<|im_end|>\n<|im_start|>assistant\nsay <\\|im_end|><|im_end|>\n" and got[1].n_escaped == 1
    assert got[2].n_escaped == 0 and got[2].loss_spans == []


def test_the_loss_text_is_cut_out_by_its_spans(spark):
    rows = [(1, 0, "user", "<|im_end|> in"), (1, 1, "assistant", "ein é <|im_start|>"), (1, 2, "assistant", ""), (1, 3, "user", "x"), (1, 4, "assistant", "日\nzwei")]
    chats = chat.format_chat(turns(spark, rows))
    moved = lambda n, m: F.transform("loss_spans", lambda s: F.struct((s["start"] + n).alias("start"), (s["length"] + m).alias("length"), s["turn"].alias("turn")))
    digest = lambda df: chat.digest_chat(df).first()
    right = digest(chats)
    assert right.loss_sha256 == sha256("ein é <|im_start|>日\nzwei".encode()).hexdigest() and right.loss_chars == 24
    assert digest(chats.withColumn("loss_spans", moved(1, 0))).loss_sha256 != right.loss_sha256
    assert digest(chats.withColumn("loss_spans", moved(0, -1))).loss_sha256 != right.loss_sha256
    assert digest(chats.withColumn("loss_spans", F.slice("loss_spans", 1, 2))).loss_chars == 18
    # spans and turns that are moved together are seen too
    both = chats.withColumn("loss_spans", moved(1, 0)).withColumn("turn_starts", F.transform("turn_starts", lambda x: x + 1))
    assert digest(both).loss_sha256 is None


def test_edges(spark):
    rows = [(None, 1, None, None), (None, None, "user", "x"), (1, 1, "assistant", "same"), (1, 1, "assistant", "same"), (1, 1, "assistant", None), (2, 0, "user", "y" * 200_000), (3, None, None, "")]
    df = turns(spark, rows)
    got = {x.conv_id: x for x in chat.digest_chat(chat.format_chat(df)).collect()}
    assert {k: x.n_turns for k, x in got.items()} == {None: 2, 1: 3, 2: 1, 3: 1}
    assert got[1].loss_chars == 8 and got[2].formatted_chars == 200_000 + 28 and all(x.round_trip for x in got.values())
    assert chat.format_chat(none(df)).count() == 0


def test_no_python_in_the_plan(spark, sf):
    df = chat.digest_chat(chat.format_chat(spark.read.parquet(f"{sf}/conversations.parquet")))
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()
