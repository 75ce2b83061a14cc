"""Chat formatting from typed content parts: one visitor turns text, images, audio and documents into one string.

Only DataFrame functions. Turns are marked ``<|turn|>role<|says|>content<|end|>``. In roles and texts ``&`` and ``<``
become ``&amp;`` and ``&lt;``, so no text can hold a mark, of this or of any other template that starts with ``<``;
``plain`` takes this back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"

#: Tokens that one unit of an attachment expands to: an image's tile, a second of audio, a document's page.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 512}

PARTS = "array<struct<kind:string,text:string,ref:string,units:bigint>>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def plain(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def visit(part: Column) -> Column:
    """A part's place in the content: its escaped text, or a placeholder of its kind."""
    known = part["kind"].isin(list(UNIT_TOKENS))
    return F.when(part["kind"] == "text", escaped(part["text"])).otherwise(
        F.concat(F.lit("<|"), F.when(known, part["kind"]).otherwise("attachment"), F.lit("|>"))
    )


def units_to_tokens(part: Column) -> Column:
    each = F.lit(0).cast("long")
    for kind, tokens in UNIT_TOKENS.items():
        each = F.when(part["kind"] == kind, F.lit(tokens).cast("long")).otherwise(each)
    return each * F.coalesce(part["units"], F.lit(1).cast("long"))


def text_parts(turns: DataFrame) -> DataFrame:
    """Turns whose column ``text`` becomes a single text part (null: empty)."""
    part = F.struct(
        F.lit("text").alias("kind"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.lit(None).cast("string").alias("ref"),
        F.lit(None).cast("bigint").alias("units"),
    )
    return turns.select("conv_id", "turn", "role", F.array(part).cast(PARTS).alias("parts"))


def format_chat(turns: DataFrame, learn_from: str = "assistant") -> DataFrame:
    """Format turns (conv_id, turn, role, parts) into one row per conversation.

    conv_id; ``formatted``; ``segments``: formatted cut into (text, loss), loss on the content of ``learn_from``;
    ``loss_spans``: their (start, length) in code points; ``attachments``: (place, turn, kind, ref, tokens) in the
    order of their placeholders; ``expanded_tokens``: the sum of those tokens.

    Turns are in the order of turn, role, parts, nulls first: rows that share a turn stay, in a fixed order, and
    repeated rows stay as often as they occur. A null role is empty, a null text is empty, null parts are none, a null
    conv_id is a conversation of its own. A part of null or unknown kind is an ``attachment`` that counts no tokens;
    missing units count as one. Other columns are ignored. A table without rows gives none. A conversation is one
    value of the result and so must fit into one task's memory.
    """
    parts = F.coalesce("parts", F.array().cast(PARTS))
    content = F.array_join(F.transform(parts, visit), "")
    files = F.transform(
        F.filter(parts, lambda p: ~F.coalesce(p["kind"] == "text", F.lit(False))),
        lambda p: F.struct(
            F.col("turn").cast("long").alias("turn"),
            p["kind"].alias("kind"),
            p["ref"].alias("ref"),
            units_to_tokens(p).alias("tokens"),
        ),
    )
    rendered = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(SAYS)).alias("head"),
        content.alias("content"),
        files.alias("files"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content", F.to_json("files"))
    length = F.length("head") + F.length("content") + len(END)
    placed = rendered.select(
        "*",
        F.row_number().over(order).alias("at"),
        (F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, 0)) - len(END) - F.length("content")).alias("start"),
    )
    grouped = placed.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("at", "role", "head", "content", "start", "files"))).alias("t")
    )
    segments = F.flatten(
        F.transform(
            "t",
            lambda x: F.array(
                F.struct(x["head"].alias("text"), F.lit(False).alias("loss")),
                F.struct(x["content"].alias("text"), (x["role"] == learn_from).alias("loss")),
                F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    spans = F.transform(
        F.filter("t", lambda x: x["role"] == learn_from),
        lambda x: F.struct(x["start"].cast("long").alias("start"), F.length(x["content"]).cast("long").alias("length")),
    )
    attachments = F.transform(
        F.flatten(F.transform("t", lambda x: x["files"])), lambda x, i: F.struct((i + 1).alias("place"), x["turn"], x["kind"], x["ref"], x["tokens"])
    )
    return (
        grouped.select("conv_id", segments.alias("segments"), spans.alias("loss_spans"), attachments.alias("attachments"))
        .withColumn("formatted", F.array_join(F.transform("segments", lambda x: x["text"]), ""))
        .withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))
        .select("conv_id", "formatted", "segments", "loss_spans", "attachments", "expanded_tokens")
    )


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted string, marks parsed and escapes undone; placeholders stay as they are."""
    turns = F.filter(F.split(formatted, r"<\|turn\|>"), lambda x: x != "")
    return F.transform(
        turns,
        lambda x: F.struct(
            plain(F.substring_index(x, SAYS, 1)).alias("role"),
            plain(F.regexp_replace(F.substring_index(x, SAYS, -1), r"<\|end\|>$", "")).alias("text"),
        ),
    )


def chat_digests(chats: DataFrame) -> DataFrame:
    """What the formatted conversations say, read back from them: digests of the turns and of the text under the loss."""
    read = chats.select(
        "conv_id",
        "formatted",
        read_back(F.col("formatted")).alias("turns"),
        # the mask is in places of the formatted string: cut there, nothing else tells what is learnt
        plain(F.array_join(F.transform("loss_spans", lambda x: F.substring(F.col("formatted"), x["start"].cast("int") + 1, x["length"].cast("int"))), "")).alias("learnt"),
    )
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
