"""Chat formatting: turns of a conversation to one training string with a loss mask, in Spark expressions only.

A conversation's turn structs are collected and sorted, ``aggregate`` folds adjacent turns of one role into one block, and the block
strings are concatenated. The fold goes by chunks of ``CHUNK`` turns and then over the chunks, so that long conversations are not copied at each turn. The
loss mask says in runs which parts of the string are trained on; what is under it is cut from the string by the mask alone. The template's control strings cannot occur inside texts: every control string starts
with ``<|``, and texts are escaped reversibly (``~`` to ``~0``, ``<|`` to ``~1``; in roles also newline to ``~2``).

Defined cases: null text or role counts as empty; null turn sorts first; rows that tie on the turn number are
ordered by role, then text; equal rows all stay; a null conv_id is a conversation of its own; an empty table gives
no rows; columns other than those named are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import once

#: Turns of a conversation that are folded at once.
CHUNK = 100


@dataclass(frozen=True)
class ChatTemplate:
    """Control strings. Each must start with ``<|``: that is what escaping keeps out of texts."""

    open: str = "<|im_start|>"
    close: str = "<|im_end|>\n"
    joint: str = "<|im_next|>"
    trained_role: str = "assistant"

    def __post_init__(self) -> None:
        if not all(x.startswith("<|") for x in (self.open, self.close, self.joint)):
            raise ValueError("control strings start with '<|'")


def escape_text(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("~"), F.lit("~0")), F.lit("<|"), F.lit("~1"))


def unescape_text(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("~1"), F.lit("<|")), F.lit("~0"), F.lit("~"))


def escape_role(role: Column) -> Column:
    return F.replace(escape_text(role), F.lit("\n"), F.lit("~2"))


def unescape_role(role: Column) -> Column:
    return unescape_text(F.replace(role, F.lit("~2"), F.lit("\n")))


_BLOCK = "struct<role:string,texts:array<string>>"


def merged(turns: Column, chunk: int = CHUNK) -> Column:
    """Blocks ``(role, texts)`` of a sorted array of turns: adjacent turns of one role are one block. Turns are (turn, role, text)."""
    none = F.lit(None).cast(_BLOCK)

    def extend(block: Column, texts: Column) -> Column:
        return F.struct(block["role"].alias("role"), F.concat(block["texts"], texts).alias("texts"))

    def fold(chunk: Column) -> Column:
        def step(acc: Column, t: Column) -> Column:
            new = F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts"))
            more = F.struct(acc["done"].alias("done"), extend(acc["open"], F.array(t["text"])).cast(_BLOCK).alias("open"))
            other = F.struct(F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))).alias("done"), new.cast(_BLOCK).alias("open"))
            return F.when(acc["open"]["role"] == t["role"], more).otherwise(other)

        start = F.struct(F.array().cast(f"array<{_BLOCK}>").alias("done"), none.alias("open"))
        return F.aggregate(chunk, start, step, lambda acc: F.concat(acc["done"], F.array(acc["open"])))

    def join(acc: Column, blocks: Column) -> Column:
        first = F.get(blocks, F.lit(0))
        same = acc["open"]["role"] == first["role"]
        met = F.when(same, F.array(extend(acc["open"], first["texts"]))).when(acc["open"].isNull(), F.array(first)).otherwise(F.array(acc["open"], first))
        joined = F.concat(met, F.slice(blocks, F.lit(2), F.size(blocks)))
        return once(joined, lambda x: F.struct(F.concat(acc["done"], F.array(F.slice(x, F.lit(1), F.size(x) - 1))).alias("done"), F.element_at(x, -1).cast(_BLOCK).alias("open")))

    starts = F.sequence(F.lit(1), F.size(turns), F.lit(chunk))
    chunks = F.transform(starts, lambda i: fold(F.slice(turns, i, F.lit(chunk))))
    begin = F.struct(F.array().cast(f"array<array<{_BLOCK}>>").alias("done"), none.alias("open"))
    return F.aggregate(chunks, begin, join, lambda acc: F.concat(F.flatten(acc["done"]), F.array(acc["open"])))


def format_chats(turns: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """``(conv_id, turn, role, text)`` rows to ``(conv_id, formatted, mask_runs)``, one row per conversation.

    ``mask_runs`` is the loss mask as runs ``(length, bytes, trained)`` over ``formatted``, in code points and in UTF-8 bytes: trained runs
    hold the (escaped) texts of the trained role and nothing else.
    """
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    piece = lambda text, trained: F.struct(text.alias("text"), trained.alias("trained"))

    def pieces(b: Column) -> Column:
        start = piece(F.concat(F.lit(template.open), escape_role(b["role"]), F.lit("\n")), F.lit(False))
        said = F.transform(b["texts"], lambda x, i: F.array(piece(F.when(i > 0, template.joint).otherwise(""), F.lit(False)), piece(escape_text(x), b["role"] == template.trained_role)))
        return F.concat(F.array(start), F.flatten(said), F.array(piece(F.lit(template.close), F.lit(False))))

    blocks = convs.select("conv_id", merged(F.col("ts")).alias("bs"))
    parts = blocks.select("conv_id", F.flatten(F.transform("bs", pieces)).alias("ps"))
    runs = F.transform("ps", lambda p: F.struct(F.length(p["text"]).cast("long").alias("length"), F.octet_length(p["text"]).cast("long").alias("bytes"), p["trained"].alias("trained")))
    return parts.select("conv_id", F.array_join(F.transform("ps", lambda p: p["text"]), "").alias("formatted"), F.filter(runs, lambda r: r["trained"] | (r["length"] > 0)).alias("mask_runs"))


def under_mask(formatted: Column | str = "formatted", mask_runs: Column | str = "mask_runs") -> Column:
    """The texts that the mask's trained runs cut from the string, unescaped, in order. Bytes are cut: a cut by code points costs as much as its place."""
    runs = F.col(mask_runs) if isinstance(mask_runs, str) else mask_runs
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<at:bigint,bytes:bigint>>").alias("cuts"))

    def step(acc: Column, r: Column) -> Column:
        cut = F.array(F.struct(acc["at"].alias("at"), r["bytes"].alias("bytes")))
        return F.struct((acc["at"] + r["bytes"]).alias("at"), F.when(r["trained"], F.concat(acc["cuts"], cut)).otherwise(acc["cuts"]).alias("cuts"))

    cuts = F.aggregate(runs, start, step, lambda acc: acc["cuts"])
    whole = (F.col(formatted) if isinstance(formatted, str) else formatted).cast("binary")
    return once(whole, lambda raw: F.transform(cuts, lambda c: unescape_text(F.substring(raw, (c["at"] + 1).cast("int"), c["bytes"].cast("int")).cast("string"))))


def _literal(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != "\n" else c for c in s)


def read_chats(formatted: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Reads the output of :func:`format_chats` back: adds ``turns`` (array of role, text) from the string alone, and ``trained_text``, what is under the mask."""
    parts = F.split("formatted", _literal(template.open), -1)
    blocks = F.slice(parts, F.lit(2), F.size(parts))
    cut = F.transform(
        blocks,
        lambda b: F.struct(
            unescape_role(F.substring_index(b, "\n", 1)).alias("role"),
            F.split(
                F.substring(b, F.locate("\n", b) + 1, F.length(b) - F.locate("\n", b) - len(template.close)),
                _literal(template.joint),
                -1,
            ).alias("texts"),
        ),
    )
    turns = F.flatten(
        F.transform(cut, lambda b: F.transform(b["texts"], lambda x: F.struct(b["role"].alias("role"), unescape_text(x).alias("text"))))
    )
    return formatted.withColumn("turns", turns).withColumn("trained_text", F.array_join(under_mask(), ""))


def chat_digest(turns: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Format, read back, and reduce to counts and digests."""
    return digest(format_chats(turns, template), template)


def digest(formatted: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Counts and digests of what :func:`read_chats` reads."""
    read = read_chats(formatted, template)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("trained_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("trained_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
