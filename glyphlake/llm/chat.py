"""Chat formatting: a visitor flattens typed content parts into text with ordered placeholders; a template marks the turns.

Control strings that occur inside a role or a text are escaped by one backslash more behind their first character, so that
format -> read back is an exact round trip whatever the texts hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The template's marks, and foreign control strings that are escaped too. Fixed values of this format.
START, MIDDLE, END = "<|turn|>", "<|says|>", "<|done|>"
CONTROL = r"(<|\[)(\\*)(\||s>|/s>|INST\]|/INST\])"
ESCAPED = r"(<|\[)(\\*)\\(\||s>|/s>|INST\]|/INST\])"

#: Token counts of one attachment: an image is cut in tiles, audio in frames, a document in pages.
TILE, TILE_TOKENS, FRAMES_A_SECOND, PAGE_TOKENS = 28, 1, 25, 768

PARTS = "array<struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(CONTROL), F.lit(r"$1$2\\$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(ESCAPED), F.lit("$1$2$3"))


def part_tokens(part: Column) -> Column:
    """Tokens that a part's placeholder stands for; 0 for text and unknown types."""
    up = lambda x, y: F.ceil(F.coalesce(x, F.lit(0)) / F.lit(y))
    n = F.when(part["type"] == "image", up(part["width"], TILE) * up(part["height"], TILE) * TILE_TOKENS).when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * FRAMES_A_SECOND))
    return n.when(part["type"] == "document", F.coalesce(part["pages"], F.lit(0)) * PAGE_TOKENS).otherwise(0).cast("bigint")


def visit(parts: Column) -> tuple[Column, Column]:
    """(text, attachments) of an array of PARTS, in their order: one visitor goes over the parts once.

    Text parts in a row are one text, and escaped as one, so that no control string comes of two parts; each image, audio or
    document part gives `<|type:i|>`, i counting the attachments of the message from 0, and an entry (index, type, ref, tokens).
    Null parts, texts and types give nothing; a part of any other type is read as text.
    """
    none = F.array().cast("array<struct<index: int, type: string, ref: string, tokens: bigint>>")
    start = F.struct(F.lit("").alias("said"), F.lit("").alias("run"), none.alias("found"))

    def step(at: Column, p: Column) -> Column:
        media = F.coalesce(p["type"].isin("image", "audio", "document"), F.lit(False))
        i = F.size(at["found"])
        mark = F.concat(F.lit("<|"), p["type"], F.lit(":"), i.cast("string"), F.lit("|>"))
        said = F.when(media, F.concat(at["said"], escape(at["run"]), mark)).otherwise(at["said"])
        run = F.when(media, F.lit("")).otherwise(F.concat(at["run"], F.coalesce(p["text"], F.lit(""))))
        entry = F.array(F.struct(i.alias("index"), p["type"].alias("type"), p["ref"].alias("ref"), part_tokens(p).alias("tokens")))
        return F.struct(said.alias("said"), run.alias("run"), F.when(media, F.concat(at["found"], entry)).otherwise(at["found"]).alias("found"))

    done = F.aggregate(F.coalesce(parts, F.array().cast(PARTS)), start, step, lambda at: F.struct(F.concat(at["said"], escape(at["run"])).alias("said"), at["found"].alias("found")))
    return done["said"], done["found"]


def text_part(text: Column) -> Column:
    """A plain text as a content of one text part."""
    none = lambda kind: F.lit(None).cast(kind)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), none("string").alias("ref"), none("int").alias("width"), none("int").alias("height"), none("double").alias("seconds"), none("int").alias("pages")))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", trained: str = "assistant") -> DataFrame:
    """One row per conversation: conv_col, formatted, n_turns, mask (start and length, in code points, of what is trained on), attachments, media_tokens.

    Rows go by turn, then role, then text, then attachments; null turns first. A null role or content is empty; repeated rows each count; a
    null conv_col is a conversation of its own. Other columns are ignored. An empty table gives no rows.
    """
    text, attachments = visit(F.col(parts_col))
    role = escape(F.coalesce(F.col(role_col), F.lit("")))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), attachments.alias("attachments"))
    rows = rows.withColumn("piece", F.concat(F.lit(START), "role", F.lit(MIDDLE), "text", F.lit(END)))
    order = W.partitionBy("conv").orderBy("turn", "role", "text", "attachments")
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("at", F.sum(F.length("piece")).over(order.rowsBetween(W.unboundedPreceding, 0)) - F.length("piece"))
    start = F.col("at") + F.length(F.lit(START)) + F.length("role") + F.length(F.lit(MIDDLE))
    span = F.when(F.col("role") == trained, F.struct(start.cast("bigint").alias("start"), F.length("text").cast("bigint").alias("length")))
    one = rows.select("conv", F.struct("n", "piece", span.alias("span"), "attachments").alias("x")).groupBy("conv").agg(F.array_sort(F.collect_list("x")).alias("x"))
    media = F.flatten(F.transform("x", lambda x: F.transform(x["attachments"], lambda a: F.struct(x["n"].alias("turn"), a["index"].alias("index"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return one.select(
        F.col("conv").alias(conv_col), F.array_join(F.transform("x", lambda x: x["piece"]), "").alias("formatted"), F.size("x").cast("bigint").alias("n_turns"),
        F.filter(F.transform("x", lambda x: x["span"]), lambda s: s.isNotNull()).alias("mask"), media.alias("attachments"),
    ).withColumn("media_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda a, m: a + m["tokens"]))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds; attachments stay as their placeholders."""
    pieces = F.filter(F.split(formatted, F.lit(r"\Q" + END + r"\E"), F.lit(-1)), lambda p: p != "")
    both = lambda p: F.split(F.substring(p, F.lit(len(START) + 1), F.length(p)), F.lit(r"\Q" + MIDDLE + r"\E"), F.lit(2))
    return F.transform(pieces, lambda p: F.struct(unescape(both(p)[0]).alias("role"), unescape(both(p)[1]).alias("text")))


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, read out of the formatted string and unescaped."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
