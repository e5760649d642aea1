"""Conversations of typed content parts to one training text with a loss mask, and back.

A turn is written as ``<turn ROLE>``, its body, ``</turn>`` and a line feed.
Texts and roles are escaped so that no control string can occur in them: a
backslash becomes ``\\b``, ``<`` becomes ``\\l`` and, in roles, ``>`` becomes
``\\g``; each escape is undone exactly. A visitor over a turn's parts writes text
parts as they are and every image, audio or document part as a placeholder
``<KIND index tokens>``, in order, and records its reference and the number of
tokens the placeholder will be expanded to.

Only DataFrame functions run here. Turns are rendered where they are read; one
shuffle brings a conversation's turns together, since the result is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Side of an image tile, tokens of a tile, of an image besides its tiles, of a second of audio, of a document's page.
TILE, TILE_TOKENS, IMAGE_TOKENS, AUDIO_TOKENS, PAGE_TOKENS = 336, 144, 16, 25, 512
LEARNED_ROLE = "assistant"
TURN_END = "</turn>\n"


def escaped(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))
    return F.replace(out, F.lit(">"), F.lit("\\g")) if role else out


def unescaped(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<"))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def expanded_tokens(part: Column) -> Column:
    """Tokens that the placeholder of a part stands for; unknown sizes count as the smallest ones."""
    tiles = lambda side: F.ceil(F.greatest(F.coalesce(side, F.lit(1)), F.lit(1)) / TILE)
    return (F.when(part["kind"] == "image", IMAGE_TOKENS + TILE_TOKENS * tiles(part["width"]) * tiles(part["height"]))
            .when(part["kind"] == "audio", F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(0.0)), F.lit(0.04)) * AUDIO_TOKENS))
            .when(part["kind"] == "document", PAGE_TOKENS * F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)))
            .otherwise(0).cast("long"))


def text_turns(conversations: DataFrame) -> DataFrame:
    """Plain turns (conv_id, turn, role, text) as turns of one text part each; a null text is an empty one."""
    part = F.struct(F.lit("text").alias("kind"), F.coalesce("text", F.lit("")).alias("text")).cast("struct<kind:string,text:string>")
    missing = [F.lit(None).cast(kind).alias(name) for name, kind in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return conversations.select("conv_id", "turn", "role", F.array(F.struct(part["kind"].alias("kind"), part["text"].alias("text"), *missing)).alias("parts"))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, segments, attachments, attachment_tokens), one row a conversation.

    ``turns`` has conv_id, turn, role and parts (an array of ``PART``); others
    are not read. ``segments`` (text, loss) follow one another to ``formatted``;
    loss is set on the bodies of assistant turns and nowhere else.
    ``attachments`` (turn, index, kind, ref, tokens) are in text order. Turns are
    ordered by turn, then role and body, so ties and repeated rows have one
    order. Null roles and texts are empty ones, null parts none; rows without a
    conv_id form one conversation; an empty table gives no rows. A kind other
    than image, audio or document is written as its text.
    """
    attached = lambda p: F.coalesce(p["kind"].isin("image", "audio", "document"), F.lit(False))
    numbered = F.transform(F.coalesce("parts", F.array().cast(f"array<{PART}>")), lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    visit = lambda x: F.when(attached(x["p"]), F.concat(F.lit("<"), x["p"]["kind"], F.lit(" "), x["i"].cast("string"), F.lit(" "), expanded_tokens(x["p"]).cast("string"), F.lit(">"))).otherwise(escaped(F.coalesce(x["p"]["text"], F.lit(""))))
    found = F.transform(F.filter(numbered, lambda x: attached(x["p"])), lambda x: F.struct(
        F.col("turn"), x["i"].alias("index"), x["p"]["kind"].alias("kind"), x["p"]["ref"].alias("ref"), expanded_tokens(x["p"]).alias("tokens")))
    rendered = turns.select("conv_id", F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.transform(numbered, visit), "").alias("body"), found.alias("attachments")).alias("row"))
    gathered = rendered.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("rows", lambda r: F.array(
        segment(F.concat(F.lit("<turn "), escaped(r["role"], role=True), F.lit(">")), F.lit(False)),
        segment(r["body"], r["role"] == LEARNED_ROLE), segment(F.lit(TURN_END), F.lit(False)))))
    out = gathered.select("conv_id", segments.alias("segments"), F.flatten(F.transform("rows", lambda r: r["attachments"])).alias("attachments"))
    return out.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "attachments",
                      F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("attachment_tokens"))


def _plain(body: Column) -> Column:
    """A body's text without its placeholders."""
    return unescaped(F.regexp_replace(body, "<[^>]*>", ""))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) of a formatted conversation, placeholders left out."""
    cut = F.split(formatted, TURN_END)
    turns = F.slice(cut, 1, F.greatest(F.size(cut) - 1, F.lit(0)))
    return F.transform(turns, lambda t: F.struct(
        unescaped(F.substring(F.split(t, ">", 2)[0], 7, 1 << 30)).alias("role"), _plain(F.split(t, ">", 2)[1]).alias("text")))


def learned_text(segments: Column) -> Column:
    """All text under the loss mask, in order, without placeholders."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: _plain(s["text"])), "")
