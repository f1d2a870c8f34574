"""Chat formatting from typed content parts, in DataFrame functions only.

A message holds a role and an ordered list of parts (``PART``): text, image,
audio, document.  The visitor flattens the parts in order: text is escaped, any
other part becomes the placeholder ``<|type|>`` and is recorded with its reference
and its expanded token count (units times the type's tokens per unit).

Template of a turn: ``<|start|>`` role ``<|sep|>`` content ``<|end|>``.  Inside texts and
roles a backslash becomes ``\\s``, a ``<`` that could begin a control string ``\\l``
and a ``[`` that could begin one ``\\b``; so neither this template's marks nor
those of others (``</s>``, ``[INST]``, ``<<SYS>>``) can occur in them, also not across
the border of two parts, and ``unescape`` restores every text exactly.

The loss mask lists the code point ranges of the assistant's content (without
its end mark) in the formatted string.

Defined results: null text, role or parts are empty; turns are ordered by turn,
role and content (nulls first), so ties have one result and repeated rows stay
repeated turns; rows with a null conversation id form one conversation with a
null id; a part of unknown type keeps its place as ``<|other|>`` with 0 tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PART = "struct<type:string,text:string,ref:string,units:bigint>"
START, SEP, END = "<|start|>", "<|sep|>", "<|end|>"
#: tokens per unit: image tiles, seconds of audio, document pages
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}


def escape(text: Column) -> Column:
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\s"))
    text = F.regexp_replace(text, r"<(?=[|/sS<]|\z)", r"\\l")
    return F.regexp_replace(text, r"\[(?=[/I]|\z)", r"\\b")


def unescape(text: Column) -> Column:
    for code, char in (("\\l", "<"), ("\\b", "["), ("\\s", "\\")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def text_part(text: Column) -> Column:
    """The parts of a message that is plain text."""
    return F.array(F.struct(F.lit("text").alias("type"), text.cast("string").alias("text"),
                            F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units")))


def visit(parts: Column, tokens_per_unit: dict[str, int] = TOKENS_PER_UNIT) -> tuple[Column, Column]:
    """Content string and attachments (array of part, type, ref, tokens) of a message."""
    parts = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    known = F.create_map(*(x for k, v in tokens_per_unit.items() for x in (F.lit(k), F.lit(v).cast("bigint"))))

    def flat(p: Column) -> Column:
        name = F.when(p["type"].isin(list(tokens_per_unit)), p["type"]).otherwise("other")
        return F.when(p["type"] == "text", escape(p["text"])).otherwise(F.concat(F.lit("<|"), name, F.lit("|>")))

    content = F.array_join(F.transform(parts, flat), "")
    numbered = F.transform(parts, lambda p, i: F.struct(
        i.cast("bigint").alias("part"), p["type"].alias("type"), p["ref"].alias("ref"),
        F.coalesce(F.try_element_at(known, F.coalesce(p["type"], F.lit(""))) * F.coalesce(p["units"], F.lit(1)), F.lit(0)).alias("tokens")))
    return content, F.filter(numbered, lambda a: ~F.coalesce(a["type"] == "text", F.lit(False)))


def format_conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         parts_col: str = "parts", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_mask (array of start,
    length), attachments (array of turn, part, type, ref, tokens)."""
    content, attachments = visit(F.col(parts_col))
    turns = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                            content.alias("content"), attachments.alias("attached"))
    turns = turns.withColumn("head", F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP)))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "content", F.to_json("attached"))
    before = F.sum(F.length("head") + F.length("content") + len(END)).over(order.rowsBetween(W.unboundedPreceding, -1))
    turns = (turns.withColumn("at", F.row_number().over(order))
             .withColumn("start", F.coalesce(before, F.lit(0)) + F.length("head")))
    turn = F.struct("at", F.concat("head", "content", F.lit(END)).alias("segment"), "start", F.length("content").cast("bigint").alias("length"),
                    (F.col("role") == loss_role).alias("loss"),
                    F.transform("attached", lambda a: F.struct((F.col("at") - 1).cast("bigint").alias("turn"), a["part"].alias("part"), a["type"].alias("type"),
                                                               a["ref"].alias("ref"), a["tokens"].alias("tokens"))).alias("attached"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return rows.select(
        "conv_id", F.array_join(F.transform("t", lambda x: x["segment"]), "").alias("formatted"),
        F.transform(F.filter("t", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("loss_mask"),
        F.flatten(F.transform("t", lambda x: x["attached"])).alias("attachments"))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation; placeholders stay in the text."""
    pieces = F.split(formatted, r"<\|start\|>")
    return F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda t: F.struct(
        unescape(F.substring_index(t, SEP, 1)).alias("role"),
        unescape(F.replace(F.substring_index(t, SEP, -1), F.lit(END), F.lit(""))).alias("text")))


def read_loss(formatted: Column, loss_mask: Column) -> Column:
    """All text under the loss mask, unescaped range by range."""
    return F.array_join(F.transform(loss_mask, lambda m: unescape(F.substring(formatted, (m["start"] + 1).cast("int"), m["length"].cast("int")))), "")


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader of the output finds: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars."""
    f = formatted.withColumn("turns", read_turns(F.col("formatted"))).withColumn("loss", read_loss(F.col("formatted"), F.col("loss_mask")))
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return f.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(every, 256).alias("turns_sha256"),
                    F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                    F.length("formatted").cast("long").alias("formatted_chars"))
