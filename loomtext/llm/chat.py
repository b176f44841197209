"""Chat formatting of turns that hold typed content parts.

A turn's content is a list of parts, each of a kind: text, image, audio or
document. The visitor flattens them in order: text is escaped, every other part
becomes a placeholder, and its reference and the tokens it stands for are
recorded. A turn is written as ``<|im_start|>role NEWLINE content<|im_end|> NEWLINE``.

A backslash escapes: ``\\`` becomes ``\\\\`` and ``<|`` becomes ``<\\|``, so that
no text can hold a control string, and a newline in a role is escaped too.

Defined results: null roles, texts and parts count as empty; unknown kinds become
``<|attachment|>``; turns that tie are ordered by role and text; a null conv_id is
a conversation of its own; further input columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.kernels import runs

PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
IMAGE_PATCH, AUDIO_TOKENS_A_SECOND, TOKENS_A_PAGE = 14, 25, 256
_HEAD, _TAIL = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_parts(text: Column) -> Column:
    """The parts of a turn that has one text."""
    null = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    fields = [F.lit("text").alias("kind"), text.alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in null.items())]
    return F.array(F.struct(*fields))


def _visit(part: Column) -> Column:
    known = part["kind"].isin("image", "audio", "document")
    return (
        F.when(part["kind"] == "text", escape(F.coalesce(part["text"], F.lit(""))))
        .when(known, F.concat(F.lit("<|"), part["kind"], F.lit("|>")))
        .when(part.isNull(), F.lit(""))
        .otherwise(F.lit("<|attachment|>"))
    )


def _tokens(part: Column) -> Column:
    patches = lambda side: F.ceil(F.greatest(F.coalesce(side, F.lit(1)), F.lit(1)) / IMAGE_PATCH)
    return (
        F.when(part["kind"] == "image", patches(part["width"]) * patches(part["height"]))
        .when(part["kind"] == "audio", F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(0.0)), F.lit(0.0)) * AUDIO_TOKENS_A_SECOND))
        .when(part["kind"] == "document", F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * TOKENS_A_PAGE)
        .otherwise(F.lit(1))
        .cast("bigint")
    )


def format_turns(df: DataFrame, parts: str = "parts") -> DataFrame:
    """One formatted piece a turn: (conv_id, turn, piece, loss_start, loss_chars, attachments).

    A conversation's output is its pieces in the order of turn, role and piece;
    there is no cell that holds a whole conversation, so its length is unbounded.
    ``loss_start`` and ``loss_chars`` count code points within the piece and
    cover the content of assistant turns. Attachments carry their place among
    the placeholders, kind, reference and the number of tokens they expand to.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    head = F.concat(F.lit(_HEAD), F.replace(escape(role), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    listed = F.coalesce(F.col(parts), F.array().cast(PARTS))
    content = F.array_join(F.transform(listed, _visit), "")
    others = F.filter(listed, lambda p: p["kind"] != "text")
    attachments = F.transform(
        others, lambda p, i: F.struct(i.alias("place"), p["kind"].alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens"))
    )
    assistant = role == "assistant"
    return df.select(
        "conv_id", "turn", head.alias("__head"), content.alias("__content"), attachments.alias("attachments"), assistant.alias("__loss")
    ).select(
        "conv_id",
        "turn",
        F.concat("__head", "__content", F.lit(_TAIL)).alias("piece"),
        F.when(F.col("__loss"), F.char_length("__head")).alias("loss_start"),
        F.when(F.col("__loss"), F.char_length("__content")).alias("loss_chars"),
        "attachments",
        F.aggregate("attachments", F.lit(0).cast("bigint"), lambda a, x: a + x["tokens"]).alias("attachment_tokens"),
    )


def parse_pieces(pieces: DataFrame) -> DataFrame:
    """Role and text of each turn, and the text under its loss mask, read back from formatted pieces."""
    pattern = r"(?s)^<\|im_start\|>((?:\\.|[^\\\n])*+)\n(.*)<\|im_end\|>\n$"
    masked = F.expr("substring(piece, loss_start + 1, loss_chars)")
    return pieces.select(
        "conv_id",
        "turn",
        unescape(F.regexp_extract("piece", pattern, 1)).alias("role"),
        unescape(F.regexp_extract("piece", pattern, 2)).alias("text"),
        unescape(masked).alias("loss_text"),
        F.char_length("piece").cast("bigint").alias("chars"),
    )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    state = None
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def close(s):
        out.append((s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]))

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    for (conv,), piece in runs(batches, ["conv_id"]):
        if state is None or state[0] != conv:
            if state is not None:
                close(state)
            state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
        for role, text, loss, chars in zip(*(piece.column(i).to_pylist() for i in (2, 3, 4, 5))):
            state[1] += 1
            state[2].update(f"{role}\n{text}\n".encode())
            state[5] += chars
            if loss:
                state[3] += len(loss)
                state[4].update(loss.encode())
        if len(out) >= 4096:
            yield flush()
            out.clear()
    if state is not None:
        close(state)
    if out:
        yield flush()


def digest(turns: DataFrame) -> DataFrame:
    """A row a conversation, from parsed turns.

    A digest needs a conversation's turns in order, so they meet in one task,
    which streams them and holds one Arrow batch.
    """
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    ordered = turns.withColumn("conv_id", F.col("conv_id").cast("bigint")).repartition("conv_id")
    return ordered.sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_digest, schema)
