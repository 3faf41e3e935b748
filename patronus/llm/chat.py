"""Chat formatting with Spark expressions: turns are collected as structs, sorted,
adjacent turns of one role merged by array functions, and joined into one text.

Template (fixed control strings)::

    <s>[SYS] text</s>[INST] text[TURN]text</s>[/INST] text</s>[ROLE]tool[/ROLE] text</s>

One block per run of turns of the same role, headed by the role's mark (user
``[INST]``, assistant ``[/INST]``, system ``[SYS]``, no role ``[NONE]``, others by
name) and closed by ``</s>``; the run's texts are parted by ``[TURN]``, so merging
loses no turn.  A control string inside a text or a role gets a backslash after its
first character, and one that already has backslashes there gets one more, so taking
one away again restores every text.

The loss mask is a list of code-point spans of the formatted text: every assistant
text, without marks.

Defined results: a null text is empty; turns equal in number are sorted by role and
text, null turns and roles first, and repeated rows are turns of their own; rows
without a conversation id are one conversation; an empty table has no rows; texts of
any length are kept whole (a conversation must fit one string); columns but the four
named are not read, so clashing names do no harm.  A conversation is one row of the
result: it is shuffled once, whole, to the task of its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, NEXT = "<s>", "</s>", "[TURN]"
MARKS = {"user": "[INST]", "assistant": "[/INST]", "system": "[SYS]"}
NO_ROLE, NAMED, NAMED_END = "[NONE]", "[ROLE]", "[/ROLE]"
#: Every control string behind its first character.
_BODIES = r"(/?s>|/?INST\]|SYS\]|NONE\]|/?ROLE\]|TURN\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _BODIES, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _BODIES, "$1$2$3")


def mark_of(role: Column) -> Column:
    """The head of a block, with the blank behind it."""
    mark = F.when(role.isNull(), F.lit(NO_ROLE))
    for name, m in MARKS.items():
        mark = mark.when(role == name, F.lit(m))
    return F.concat(mark.otherwise(F.concat(F.lit(NAMED), escape(role), F.lit(NAMED_END))), F.lit(" "))


def blocks_of(turns: Column) -> Column:
    """Sorted turns (turn, role, text) merged into (role, texts) runs of one role."""
    n = F.size(turns)
    at = F.sequence(F.lit(0), n - 1)
    starts = F.filter(at, lambda i: (i == 0) | ~F.get(turns, i)["role"].eqNullSafe(F.get(turns, i - 1)["role"]))
    ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(n))
    return F.zip_with(starts, ends, lambda a, e: F.struct(
        F.get(turns, a)["role"].alias("role"),
        F.transform(F.slice(turns, a + 1, e - a), lambda t: t["text"]).alias("texts")))


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, formatted, loss) per conversation; ``loss``: (start, end) spans in code
    points of ``formatted``, end exclusive."""
    row = F.struct(F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"),
                   F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    chats = df.select(F.col(conv).alias("conv"), row.alias("row")).groupBy("conv").agg(F.collect_list("row").alias("turns"))
    chats = chats.select("conv", F.sort_array("turns").alias("turns")).select("conv", blocks_of(F.col("turns")).alias("blocks"))
    marked = chats.select("conv", F.transform("blocks", lambda b: F.struct(
        (F.coalesce(b["role"], F.lit("")) == "assistant").alias("learn"), mark_of(b["role"]).alias("mark"),
        F.transform(b["texts"], escape).alias("texts"))).alias("blocks"))
    formatted = F.concat(F.lit(OPEN), F.array_join(F.transform("blocks", lambda b: F.concat(
        b["mark"], F.array_join(b["texts"], NEXT), F.lit(CLOSE))), ""))
    # every text as (gap before it, its length, learn), in order
    runs = F.flatten(F.transform("blocks", lambda b, k: F.transform(b["texts"], lambda t, i: F.struct(
        F.when(i > 0, F.lit(len(NEXT))).otherwise(F.length(b["mark"]) + F.when(k > 0, F.lit(len(CLOSE))).otherwise(F.lit(len(OPEN)))).alias("gap"),
        F.length(t).alias("size"), b["learn"].alias("learn")))))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, r: Column) -> Column:
        start = acc["at"] + r["gap"]
        span = F.array(F.struct(start.alias("start"), (start + r["size"]).alias("end")))
        return F.struct((start + r["size"]).alias("at"), F.when(r["learn"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))
    loss = F.aggregate(runs, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])
    return marked.select("conv", formatted.alias("formatted"), loss.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted text was made of."""
    body = F.substring(formatted, F.lit(len(OPEN) + 1), F.length(formatted))
    blocks = F.filter(F.split(body, CLOSE), lambda b: b != "")

    def turns(block: Column) -> Column:
        mark = F.regexp_extract(block, r"^(\[ROLE\].*?\[/ROLE\]|\[[^\]]*\]) ", 1)
        role = F.when(mark == NO_ROLE, F.lit(None).cast("string"))
        for name, m in MARKS.items():
            role = role.when(mark == m, F.lit(name))
        named = unescape(F.substring(mark, F.lit(len(NAMED) + 1), F.length(mark) - len(NAMED) - len(NAMED_END)))
        rest = F.substring(block, F.length(mark) + 2, F.length(block))
        return F.transform(F.split(rest, r"\[TURN\]"), lambda t: F.struct(role.otherwise(named).alias("role"), unescape(t).alias("text")))
    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, without escapes."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")
