"""Chat formatting by reconstruction from events.

A log holds events of messages: ``start`` names the role, ``delta`` appends text,
``edit`` puts other text in the place of all before it, ``regenerate`` drops all
before it. Events are partitioned by conversation and message, sorted by sequence
number and folded into the final message. Messages are rendered, blocks of them
joined, and blocks joined to the conversation, so that a long conversation is put
together from parts. All of it is built-in functions.

Rendered, a message is ``<turn ROLE>``, a line end, the text, a line end,
``</turn>`` and a line end. Inside roles and texts a backslash is written ``\\s``
and ``<`` is written ``\\l``; in roles ``>`` is ``\\g``. So ``<`` stands in marks
only, and no text can imitate one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN, OPENED, CLOSE = "<turn ", ">\n", "\n</turn>\n"
#: Turns of a block.
BLOCK_TURNS = 64
LEARNED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    """The other way round; a backslash always has its letter behind it."""
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def turn_events(turns: DataFrame, delta_chars: int = 1024) -> DataFrame:
    """The log of a table of whole turns (conv_id, turn, role, text).

    Each row is a message of its own, also where rows repeat: a start, and its
    text in deltas. A NULL text is empty, a NULL role the empty role.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(delta_chars))
    deltas = F.transform(starts, lambda at: F.struct(
        F.lit("delta").alias("kind"), F.substring(text, at, F.lit(delta_chars)).alias("text")))
    begin = F.array(F.struct(F.lit("start").alias("kind"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("text")))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.monotonically_increasing_id().alias("message"), F.concat(begin, deltas).alias("events"))
    return rows.select("conv_id", "turn", "message", F.posexplode("events").alias("seq", "event")).select(
        "conv_id", "turn", "message", "seq", "event.kind", "event.text")


def messages(events: DataFrame) -> DataFrame:
    """conv_id, turn, message, role, text: the final form of each message.

    Events of equal sequence number are taken by kind and text. A message without
    a start has the empty role; of several starts the last counts.
    """
    event = F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"))
    log = events.groupBy("conv_id", "turn", "message").agg(F.sort_array(F.collect_list(event)).alias("log"))
    begins = F.filter("log", lambda e: e["kind"] == "start")
    resets = F.transform("log", lambda e, i: F.when(e["kind"].isin("edit", "regenerate"), i).otherwise(-1))
    live = F.slice("log", F.greatest(F.array_max(resets), F.lit(0)) + 1, F.size("log"))
    said = F.filter(live, lambda e: e["kind"].isin("delta", "edit"))
    return log.select(
        "conv_id", "turn", "message",
        F.coalesce(F.get(begins, F.size(begins) - 1)["text"], F.lit("")).alias("role"),
        F.array_join(F.transform(said, lambda e: e["text"]), "").alias("text"))


def format_chats(said: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans: one row per conversation.

    Messages stand in the order of turn, role, text. A span is (start, length) in
    code points of ``formatted`` and covers the escaped text of an assistant
    message. NULL conversations and turns are values of their own, NULL first.
    """
    body = escape(F.col("text"))
    role = F.replace(escape(F.col("role")), F.lit(">"), F.lit("\\g"))
    head = F.concat(F.lit(OPEN), role, F.lit(OPENED))
    rendered = said.select(
        "conv_id", "turn", "role", "text", "message", F.floor(F.col("turn") / F.lit(BLOCK_TURNS)).alias("block"),
        F.concat(head, body, F.lit(CLOSE)).alias("piece"), F.length(head).alias("to_body"), F.length(body).alias("in_body"))
    in_block = W.partitionBy("conv_id", "block").orderBy("turn", "role", "text", "message")
    placed = rendered.withColumn("rank", F.row_number().over(in_block)).withColumn(
        "start", F.sum(F.length("piece").cast("long")).over(in_block) - F.length("piece") + F.col("to_body"))
    span = F.when(F.col("role") == LEARNED_ROLE, F.struct("start", F.col("in_body").cast("long").alias("length")))
    blocks = placed.groupBy("conv_id", "block").agg(
        F.sort_array(F.collect_list(F.struct("rank", "piece", span.alias("span")))).alias("parts"))
    blocks = blocks.select(
        "conv_id", "block", F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("piece"),
        F.filter(F.transform("parts", lambda p: p["span"]), lambda s: s.isNotNull()).alias("spans"))
    in_conversation = W.partitionBy("conv_id").orderBy("block")
    blocks = blocks.withColumn(
        "before", F.sum(F.length("piece").cast("long")).over(in_conversation) - F.length("piece"))
    moved = F.transform("spans", lambda s: F.struct(
        (s["start"] + F.col("before")).alias("start"), s["length"].alias("length")))
    joined = blocks.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("block", "piece", moved.alias("spans")))).alias("parts"))
    return joined.select(
        "conv_id", F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("formatted"),
        F.flatten(F.transform("parts", lambda p: p["spans"])).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """Roles and texts of a formatted conversation, as an array of structs."""
    pieces = F.split(formatted, CLOSE)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        at = F.instr(piece, OPENED)
        role = F.substring(piece, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)
        return F.struct(
            unescape(F.replace(role, F.lit("\\g"), F.lit(">"))).alias("role"),
            unescape(F.substring(piece, at + len(OPENED), F.length(piece))).alias("text"))

    return F.transform(pieces, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
