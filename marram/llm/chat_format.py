"""Chat formatting with Spark expressions only.

Template: a block of adjacent turns of one role is ``<s>[role]text[SEP]text</s>``. The control
strings all need ``<``, ``[`` or ``]``; inside roles and texts these, and ``&``, are written as
``&lt;``, ``&#91;``, ``&#93;`` and ``&amp;``, so no text can hold a control string, and replacing
back in the other order (``&amp;`` last) is exact. The loss mask gives the spans of the loss role's
texts in the formatted string, without block marks and separators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What escaping replaces, in its order; reading back goes through them in reverse.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("]", "&#93;"))
OPEN, ROLE_END, SEP, CLOSE = "<s>[", "]", "[SEP]", "</s>"

#: Code points of a chunk in which spans are looked up.
CHUNK = 1024

#: A conversation that says the control strings of a common template, appended by the query.
PROBE_ID, PROBE_TEXT = -7, "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for plain, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted string, loss_mask array<struct<start, stop>>: one row per conversation.

    Turns are collected as structs and sorted by turn, ties by role and then text (as escaped), null turns
    first; adjacent turns of one role are gathered into one block's array of texts. loss_mask has
    the code points of ``formatted`` (stop exclusive) that carry loss, a span for each text of the
    loss role. Defined cases: null texts and roles are empty; an empty text stays a turn; texts are
    taken whole; repeated rows are repeated turns; rows of null conv_id make one conversation; an
    empty table gives no rows; other columns are ignored, whatever their names. A conversation
    becomes one value and so must fit in one.
    """
    safe = lambda c: escape(F.coalesce(F.col(c).cast("string"), F.lit("")))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), safe(role_col).alias("role"), safe(text_col).alias("text"))
    # Where a turn's text starts is a running sum over the conversation's turns of what comes before it.
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    length = lambda c: F.char_length(c).cast("long")
    before = F.lag("role").over(order)
    head = len(OPEN) + length(F.col("role")) + len(ROLE_END)
    lead = F.when(before.isNull(), head).when(before == F.col("role"), len(SEP)).otherwise(len(CLOSE) + head)
    placed = rows.withColumn("lead", lead).withColumn("stop", F.sum(F.col("lead") + length(F.col("text"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    turn = F.struct("turn", "role", "text", "stop")
    sorted_turns = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    # A turn opens a block when its role differs from the one before.
    index = F.sequence(F.lit(0), F.size("turns") - 1)
    opens = F.filter(index, lambda i: (i == 0) | (F.get(F.col("turns"), i - 1)["role"] != F.get(F.col("turns"), i)["role"]))
    opened = sorted_turns.select("conv_id", "turns", opens.alias("opens"))
    end = lambda k: F.coalesce(F.get(F.col("opens"), k + 1), F.size("turns"))
    blocks = F.transform("opens", lambda first, k: F.struct(F.get(F.col("turns"), first)["role"].alias("role"), F.transform(F.slice("turns", first + 1, end(k) - first), lambda t: t["text"]).alias("texts")))
    merged = opened.select("conv_id", "turns", blocks.alias("blocks"))
    text = F.array_join(F.transform("blocks", lambda b: F.concat(F.lit(OPEN), b["role"], F.lit(ROLE_END), F.array_join(b["texts"], SEP), F.lit(CLOSE))), "")
    spoken = F.filter("turns", lambda t: t["role"] == escape(F.lit(loss_role)))
    mask = F.transform(spoken, lambda t: F.struct((t["stop"] - length(t["text"])).alias("start"), t["stop"].alias("stop")))
    return merged.select("conv_id", text.alias("formatted"), mask.alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_mask, blocks array<struct<role, texts>> parsed from the formatted string alone."""
    marks = F.split("formatted", "</s>")
    pieces = F.slice(marks, 1, F.greatest(F.size(marks) - 1, F.lit(0)))
    parsed = F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), ROLE_END, 1)).alias("role"),
            F.transform(F.split(F.substr(p, F.locate(ROLE_END, p) + 1), r"\[SEP\]"), unescape).alias("texts"),
        ),
    )
    return formatted.select("conv_id", "formatted", "loss_mask", parsed.alias("blocks"))


def digests(parsed: DataFrame) -> DataFrame:
    """The contract's columns from ``read_back``: turns from the blocks, loss from what the mask covers."""
    said = F.array_join(F.flatten(F.transform("blocks", lambda b: F.transform(b["texts"], lambda t: F.concat(b["role"], F.lit("\n"), t, F.lit("\n"))))), "")
    # A span is cut out of the chunks it lies in, since to count characters from the start of a long string takes its length.
    parsed = parsed.withColumn("chunks", F.regexp_extract_all("formatted", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)))
    first = lambda s: F.floor(s["start"] / CHUNK).cast("int")
    chunks = lambda s: F.array_join(F.slice("chunks", first(s) + 1, F.floor(s["stop"] / CHUNK).cast("int") - first(s) + 1), "")
    under = F.transform("loss_mask", lambda s: unescape(F.substr(chunks(s), (s["start"] - first(s) * CHUNK + 1).cast("int"), (s["stop"] - s["start"]).cast("int"))))
    # Naming the chunks twice keeps them a column of their own, which the spans do not make anew each.
    loss = F.when(F.size("chunks") >= 0, F.array_join(under, ""))
    turns = F.aggregate("blocks", F.lit(0).cast("long"), lambda n, b: n + F.size(b["texts"]))
    return parsed.select("conv_id", turns.alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def with_probe(turns: DataFrame) -> DataFrame:
    """``turns`` and the two rows of the probe conversation."""
    probe = turns.sparkSession.range(2).select(F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text"))
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe)
