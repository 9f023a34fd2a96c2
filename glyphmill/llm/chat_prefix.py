"""Chat formatting: an example for each assistant turn, of which only that turn is trained on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import pick

END = "<|end|>"


def expand_prefixes(
    turns: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    target: str = "assistant",
) -> DataFrame:
    """A row (conv_id, turn, n_context, example, train_start, train_end) for every turn whose role is ``target``.

    ``example`` has all turns before it, whatever their role, then the reply; each is ``<|role|>``, a line break, the text and
    ``<|end|>`` with a line break. Characters from ``train_start`` up to ``train_end``, the reply and its ``<|end|>``, are
    trained on, all others are context. Turns are ordered by number, ties by role and then text. A null role or text counts as
    empty; rows with a null conversation or turn have no place and are left out; repeated rows are turns of their own.
    A conversation without such a turn has no row, and one that begins with it has an example without context; an empty table
    gives no rows. Texts go in as they are, very long ones too: signs such as ``<|end|>`` or ``<|user|>`` in a text stay part of its turn, as the
    offsets say, and don't end it; whoever encodes examples must take such signs as ordinary text, as ``byte_bpe`` does. Other
    columns, of any name, are not read. The one shuffle is by conversation.
    """
    rows = pick(turns, conv_id=conv_id, turn=turn, role=role, text=text).select(
        "conv_id",
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    ).where("conv_id is not null and t.turn is not null")
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("all"))
    whole = whole.where(F.exists("all", lambda t: t["role"] == target))
    pieces = F.transform(
        "all", lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit(f"{END}\n"))
    )
    one = whole.select("conv_id", pieces.alias("pieces"), F.posexplode("all").alias("n_context", "t"))
    one = one.where(F.col("t.role") == target)
    start = F.concat(F.array_join(F.slice("pieces", 1, F.col("n_context")), ""), F.lit(f"<|{target}|>\n"))
    made = one.select("conv_id", "t", F.col("n_context").cast("long").alias("n_context"), start.alias("prompt"))
    return made.select(
        "conv_id",
        F.col("t.turn").alias("turn"),
        "n_context",
        F.concat("prompt", "t.text", F.lit(f"{END}\n")).alias("example"),
        F.length("prompt").cast("long").alias("train_start"),
        (F.length("prompt") + F.length("t.text") + len(END)).cast("long").alias("train_end"),
    )
