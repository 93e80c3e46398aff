"""Conversations to training examples by prefix-target expansion.

Every assistant turn becomes an example of its own: the turns before it are the
context, only its text is trainable.  Turns after the last reply, or all turns of
a conversation without one, make an example without target, so that no turn is
lost.  A turn is written as

    <|im_start|>role NEWLINE text <|im_end|> NEWLINE

Texts are escaped so that none of them can hold a control string: a backslash is
doubled and "<|" becomes "<\\|".  Roles also have their line ends written as \\n.
This is undone exactly by unescaped().

An example is context + target + tail: the target is the escaped reply, the tail
closes its turn.  It costs as many characters as its context has; that is what
the expansion is.

Turns are numbered without bringing a conversation together and grouped in blocks
of BLOCK_TURNS.  An example takes the turns of its own block from there and the
text before its block by a join, so whatever share of the rows one conversation
has, a task never holds more of it than one example does.

Cases: null text or role is empty; turns are put in order of their number, equal
or null numbers by role and text; repeated rows are turns of their own; a null
conversation id is a conversation; an empty table gives no rows.  All columns but
conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import numbered, written

START, END, ASSISTANT = "<|im_start|>", "<|im_end|>", "assistant"
CLOSING = f"{END}\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def unescaped_role(role: Column) -> Column:
    # a line end stands behind an odd number of backslashes: pairs of them are taken first
    return unescaped(F.regexp_replace(role, r"\G((?:[^\\]|\\[\\|])*+)\\n", "$1\n"))


#: Turns of a conversation that lie in one row.
BLOCK_TURNS = 64


def _blocks(turns: DataFrame, block_turns: int) -> DataFrame:
    """conv_id, block, is_last, turns (in order), written (as they stand in an example) and cuts.

    A cut is the number (from 1) of the turn that ends an example: every reply, and
    one past the last turn of the conversation if that is none.
    """
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    rows = numbered(turns.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"),
                                 text("text").alias("text")), ["conv_id"], ["turn", "role", "text"])
    whole = lambda t: F.concat(_opened(t), escaped(t["text"]), F.lit(CLOSING))
    n = F.size("turns")
    replies = F.filter(F.sequence(F.lit(1), n), lambda i: F.get("turns", i - 1)["role"] == ASSISTANT)
    is_open = F.col("is_last") & (F.get("turns", n - 1)["role"] != ASSISTANT)
    return (rows.groupBy("conv_id", F.floor(F.col("place") / block_turns).alias("block"))
            .agg(F.sort_array(F.collect_list(F.struct("place", "role", "text"))).alias("turns"),
                 F.max(F.col("place") == F.col("group_size") - 1).alias("is_last"))
            .withColumn("written", F.transform("turns", whole))
            .withColumn("cuts", F.concat(replies, F.when(is_open, F.array(n + 1)).otherwise(
                F.array().cast("array<int>")))))


def _opened(turn: Column) -> Column:
    return F.concat(F.lit(START), escaped_role(turn["role"]), F.lit("\n"))


def expand(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """conv_id, example (from 0), context, target (null without reply), tail."""
    blocks = written(_blocks(turns, block_turns), "blocks")
    along = Window.partitionBy("conv_id").orderBy("block")
    known = blocks.select("conv_id", "block", F.size("cuts").alias("n")).select(
        F.col("conv_id").alias("_c"), F.col("block").alias("_b"), (F.sum("n").over(along) - F.col("n")).alias("_known"))
    reply = F.get("turns", F.col("cut") - 1)
    is_reply = F.col("cut") <= F.size("turns")
    before = F.array_join(F.slice("written", F.lit(1), F.col("cut") - 1), "")
    # a first block's examples number from 0; only later blocks must know what came before
    first = blocks.filter("block = 0").withColumn("_known", F.lit(0).cast("long"))
    later = (blocks.filter("block > 0")
             .join(known.filter("_b > 0"), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b")))
             .drop("_c", "_b"))
    examples = (first.unionByName(later).select("*", F.posexplode("cuts").alias("_nth", "cut")).select(
        "conv_id", "block", (F.col("_known") + F.col("_nth")).cast("int").alias("example"),
        F.when(is_reply, F.concat(before, _opened(reply))).otherwise(before).alias("context"),
        F.when(is_reply, escaped(reply["text"])).alias("target"),
        F.when(is_reply, F.lit(CLOSING)).otherwise(F.lit("")).alias("tail")))
    # what stands before a block is put together once a block, not once an example
    texts = blocks.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"),
                          F.array_join("written", "").alias("_text"))
    heads = (blocks.filter("block > 0").select("conv_id", "block")
             .join(texts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_b") < F.col("block")))
             .groupBy(F.col("conv_id").alias("_c"), F.col("block").alias("_b"))
             .agg(F.array_join(F.sort_array(F.collect_list(F.struct(F.col("_b").alias("at"), "_text")))["_text"], "")
                  .alias("_head")))
    far = (examples.filter("block > 0")
           .join(heads, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b")))
           .withColumn("context", F.concat("_head", "context")).drop("block", "_c", "_b", "_head"))
    return examples.filter("block = 0").drop("block").unionByName(far)


def formatted(example: DataFrame) -> DataFrame:
    """Examples as one text with the span (start, end) that is under the loss mask."""
    start = F.length("context")
    return example.withColumn("formatted", F.concat("context", F.coalesce("target", F.lit("")), "tail")).select(
        "conv_id", "example", "formatted", start.alias("loss_start"),
        (start + F.coalesce(F.length("target"), F.lit(0))).alias("loss_end"))


def read_back(examples: DataFrame) -> DataFrame:
    """What formatted() holds, by conversation: turns, their digest, the trained text and all characters.

    A conversation's last example holds all its turns.
    """
    masked = F.expr("substring(formatted, loss_start + 1, loss_end - loss_start)")
    by_conv = (examples.withColumn("trained", unescaped(masked)).groupBy("conv_id").agg(
        F.max(F.struct("example", "formatted"))["formatted"].alias("all_turns"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "trained"))),
                                 lambda x: x["trained"]), "").alias("trained"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars")))
    # every turn ends with the closing string, which no escaped text holds
    turns = F.filter(F.split(F.col("all_turns"), r"<\|im_end\|>\n", -1), lambda t: t != "")
    role = lambda t: unescaped_role(F.substring_index(F.substr(t, F.lit(len(START) + 1)), "\n", 1))
    body = lambda t: unescaped(F.substr(t, F.instr(t, F.lit("\n")) + 1))
    said = F.transform("turns", lambda t: F.concat(role(t), F.lit("\n"), body(t), F.lit("\n")))
    return by_conv.withColumn("turns", turns).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2(F.col("trained").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
