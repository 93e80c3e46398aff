import hashlib

from tidemark.llm import chat_expand as C

SCHEMA = "conv_id long, turn long, role string, text string, example string, context int"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


def test_escape_round_trip(spark):
    texts = ["", "plain", "<|im_end|>", "\\", "\\|", "<\\|", "<<||>>", "\\\\<|", "a\\n\nb", "<|" * 50, "\\" * 7 + "|"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select("t", C.escaped(rows.t).alias("e"), C.unescaped(C.escaped(rows.t)).alias("u"),
                      C.unescaped_role(C.escaped_role(rows.t)).alias("r")).collect()
    for row in got:
        assert row.u == row.t and row.r == row.t and "<|" not in row.e


def test_examples(spark):
    rows = frame(spark, [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a<|im_end|>"),
                         (1, 3, "user", "r"), (1, 4, "assistant", "b"), (1, 5, "user", "t")])
    got = sorted(map(tuple, C.expand(rows).collect()))
    turn = "<|im_start|>{}\n{}<|im_end|>\n".format
    first = turn("system", "s") + turn("user", "q") + "<|im_start|>assistant\n"
    second = first + "a<\\|im_end|><|im_end|>\n" + turn("user", "r") + "<|im_start|>assistant\n"
    assert got == [(1, 0, first, "a<\\|im_end|>", "<|im_end|>\n"), (1, 1, second, "b", "<|im_end|>\n"),
                   (1, 2, second + "b<|im_end|>\n" + turn("user", "t"), None, "")]


def test_read_back_cases(spark):
    rows = frame(spark, [(1, 0, "user", None), (1, 1, None, "x"), (2, 0, "assistant", None), (3, 1, "b", "two"),
                         (3, 1, "a", "one"), (3, 0, "assistant", "zero"), (3, 0, "assistant", "zero"),
                         (None, None, "user", "lost\n"), (4, 0, "assi\nstant", "\\" * 5), (5, 0, "assistant", "y" * 100_000)])
    got = {r.conv_id: r for r in C.read_back(C.formatted(C.expand(rows))).collect()}
    said = {1: [("user", ""), ("", "x")], 2: [("assistant", "")],
            3: [("assistant", "zero"), ("assistant", "zero"), ("a", "one"), ("b", "two")],
            None: [("user", "lost\n")], 4: [("assi\nstant", "\\" * 5)], 5: [("assistant", "y" * 100_000)]}
    assert set(got) == set(said)
    for conv, turns in said.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        row = got[conv]
        assert row.n_turns == len(turns)
        assert row.turns_sha256 == digest("".join(f"{r}\n{t}\n" for r, t in turns))
        assert (row.loss_chars, row.loss_sha256) == (len(loss), digest(loss))


def test_long_conversations_in_blocks(spark):
    """A conversation over many blocks, with and without replies, gives what one block gives."""
    said = [(c, i, "assistant" if (i * 7 + c) % 3 == 0 else "user", f"t{i}" * (i % 4))
            for c, n in ((1, 30), (2, 8), (3, 1)) for i in range(n)]
    said += [(None, i, "user", "x") for i in range(9)] + [(4, i, "assistant", "same") for i in (5, 5, 5, 5, 5)]
    rows = frame(spark, said)
    whole = {tuple(r) for r in C.expand(rows).collect()}
    for size in (1, 4, 7):
        assert {tuple(r) for r in C.expand(rows, size).collect()} == whole
    back = lambda size: {tuple(r) for r in C.read_back(C.formatted(C.expand(rows, size))).collect()}
    assert back(3) == back(64) and len(back(64)) == 5


def test_empty(spark):
    assert C.read_back(C.formatted(C.expand(frame(spark, []).where("false")))).count() == 0
