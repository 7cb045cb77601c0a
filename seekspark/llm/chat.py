"""Operator 3, chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it as context,
and its text alone trainable. A last example without a target holds the whole
conversation, so turns behind the last reply aren't lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"


def escape(text: Column) -> Column:
    r"""Control strings begin with ``<|``. In texts that becomes ``<\|``, and each longer ``<\...\|`` gets one more backslash, so every string has a way back."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def expand(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target: str = "assistant") -> DataFrame:
    """Examples (conv_id, example, target_turn, formatted, loss_start, loss_end) of each conversation, in order.

    A turn reads ``<|turn|>role<|text|>text<|end|>``, role and text escaped. Characters (code points) from ``loss_start`` up to
    ``loss_end`` of ``formatted`` are trainable: the target's escaped text; for the last example, of the whole conversation, none,
    and ``target_turn`` (the place of the target, from 0) is null. Turns stand by ``turn``, then role, then text; null ones first;
    repeated rows are turns of their own. A null role or text counts as empty. Rows without a conversation id form one
    conversation with a null id. Other columns are not read. An empty table gives no rows.

    A conversation has to fit into one row, as its examples do.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = conversations.select(F.col(id_col).alias("conv_id"), F.struct(F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    turn = lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    parts = whole.select("conv_id", F.transform("turns", lambda t: F.struct((t["role"] == target).alias("target"), turn(t).alias("head"), escape(t["text"]).alias("body"))).alias("parts"))
    places = F.filter(F.sequence(F.lit(0), F.size("parts") - 1), lambda i: F.col("parts")[i]["target"])
    each = parts.select("conv_id", "parts", F.posexplode(F.concat(places, F.array(F.lit(-1)))).alias("example", "place"))
    last = F.when(F.col("place") < 0, F.size("parts")).otherwise(F.col("place"))
    context = F.array_join(F.transform(F.slice("parts", 1, last), lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    aim = F.when(F.col("place") >= 0, F.col("parts")[F.greatest("place", F.lit(0))])
    made = each.select("conv_id", "example", F.when(F.col("place") >= 0, F.col("place")).alias("target_turn"), context.alias("context"), aim.alias("aim"))
    start = F.when(F.col("aim").isNull(), F.length("context")).otherwise(F.length("context") + F.length("aim.head"))
    return made.select(
        "conv_id", "example", "target_turn",
        F.when(F.col("aim").isNull(), F.col("context")).otherwise(F.concat("context", "aim.head", "aim.body", F.lit(END))).alias("formatted"),
        start.cast("long").alias("loss_start"),
        (start + F.coalesce(F.length("aim.body"), F.lit(0))).cast("long").alias("loss_end"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted example."""
    parts = F.filter(F.split(formatted, r"<\|turn\|>"), lambda _, i: i > 0)
    return F.transform(parts, lambda p: F.struct(unescape(F.substring_index(p, TEXT, 1)).alias("role"), unescape(F.substring_index(F.substring_index(p, END, 1), TEXT, -1)).alias("text")))


def trained_text(formatted: Column, start: Column, end: Column) -> Column:
    """The text under the loss mask, as it was."""
    return unescape(F.substring(formatted, start.cast("int") + 1, (end - start).cast("int")))


def read_back(examples: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns, loss_text, formatted_chars), each taken from the formatted text and mask of :func:`expand` alone. Texts and roles that were null come back empty; examples of a null id belong together; no examples, no rows."""
    text = F.struct("example", trained_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("text"))
    per = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.array_join(F.transform(F.sort_array(F.collect_list(text)), lambda x: x["text"]), "").alias("loss_text"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
    )
    return per.select("conv_id", read_turns(F.col("whole")).alias("turns"), "loss_text", "formatted_chars").withColumn("n_turns", F.size("turns").cast("long"))
