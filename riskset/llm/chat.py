"""Conversations as training text, with Spark expressions only.

A conversation's turns are collected as structs, sorted, and neighbours of one role merged under one head by looking at
each turn's predecessor in the array (a fold would copy what it has gathered at every turn). The text is

    <s>[INST]role[/INST]text</s><s>[INST]role[/INST]text<|sep|>text</s>

where ``<|sep|>`` parts merged turns. A control string inside a role or text gets a backslash after its first character,
and one more if it has some there, so that every text is read back as it was. The loss mask comes as a list of segments,
whose texts joined are the formatted text: text, and whether the model is trained on it (what assistants say).

Defined results: a null text or role is empty. Rows are ordered by turn (null first), then role, then text, so ties and
repeated rows have one order; each stays a turn. Rows with a null conversation id form one conversation. An empty table
gives no rows. A conversation is one row of the result, so all its turns meet in one place by nature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOS, EOS, OPEN, CLOSE, SEP = "<s>", "</s>", "[INST]", "[/INST]", "<|sep|>"
TRAINED = "assistant"

_ESCAPE = r"([<\[])(\\*)(/?s>|/?INST\]|\|sep\|>)"
_UNESCAPE = r"([<\[])\\(\\*)(/?s>|/?INST\]|\|sep\|>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2$3")


def _segment(text: Column, trained: Column) -> Column:
    return F.struct(text.alias("text"), trained.alias("trained"))


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, segments array<struct<text, trained>>) for every conversation of ``turns``."""
    turn = F.struct(F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"),
                    F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = turns.select(F.col(f"`{id_col}`").alias("conv_id"), turn.alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def segments(t: Column, i: Column) -> Column:
        before = F.get(F.col("turns"), i - 1)["role"]
        start = F.concat(F.lit(BOS + OPEN), escape(t["role"]), F.lit(CLOSE))
        head = F.when(i == 0, start).when(before == t["role"], F.lit(SEP)).otherwise(F.concat(F.lit(EOS), start))
        return F.array(_segment(head, F.lit(False)), _segment(escape(t["text"]), t["role"] == TRAINED))

    ends = F.array(_segment(F.lit(EOS), F.lit(False)))
    made = chats.select("conv_id", F.concat(F.flatten(F.transform("turns", segments)), ends).alias("segments"))
    return made.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """The turns, array<struct<role, text>>, of a formatted conversation."""
    def quoted(s: str) -> str:
        return "".join(f"\\{c}" if c in "[]|/" else c for c in s)

    blocks = F.filter(F.split(formatted, EOS), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = F.substring_index(F.substring(block, len(BOS + OPEN) + 1, 2 ** 31 - 1), CLOSE, 1)
        body = F.substring(block, F.length(role) + len(BOS + OPEN + CLOSE) + 1, F.length(block))
        return F.transform(F.split(body, quoted(SEP)), lambda p: F.struct(unescape(role).alias("role"), unescape(p).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def trained_text(segments: Column) -> Column:
    """All text under the loss mask, as it was before escaping."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["trained"]), lambda s: unescape(s["text"])), "")


def digests(chats: DataFrame) -> DataFrame:
    """What reading the formatted conversations back gives, as digests."""
    back = chats.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"),
                        trained_text(F.col("segments")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))
