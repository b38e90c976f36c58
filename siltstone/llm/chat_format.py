"""Chat formatting of typed content parts, in DataFrame functions only.

A turn's content is an array of parts; a fold visits them in order.  Text parts
are escaped; image, audio and document parts become placeholders that carry
their place in the turn and the tokens that they expand to, and are recorded as
attachments.  The template:

    <turn ROLE>
    BODY</turn>

Inside roles and texts ``\\``, ``<`` and ``>`` are written as ``\\b``, ``\\l`` and
``\\g``, so a text can hold no mark of the template, and reading back is exact.

Defined cases: null role and null text are empty; null or empty content is a turn
with an empty body; turns are ordered by (turn, role, body) with null first, so
ties and repeated rows stay and have one order; rows with a null conversation id
form one conversation; an empty table gives an empty result.  A conversation's
formatted text is one value, so memory follows the longest conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "struct<type:string,text:string,ref:string,width:int,height:int,millis:bigint,pages:int>"
SPANS = "array<struct<start:bigint,len:bigint>>"
ATTACHMENTS = "array<struct<part:int,kind:string,ref:string,tokens:bigint>>"

#: Pixels of an image patch's side, audio tokens a second and tokens a page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 512


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(c, F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(c: Column) -> Column:
    c = F.replace(F.replace(c, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<"))
    return F.replace(c, F.lit("\\b"), F.lit("\\"))


def expanded_tokens(p: Column) -> Column:
    """Tokens that an attachment takes in the model's input; unknown sizes count as the least, 1."""
    side = lambda x: F.ceil(F.greatest(F.coalesce(x, F.lit(1)), F.lit(1)) / F.lit(PATCH))
    return (
        F.when(p["type"] == "image", side(p["width"]) * side(p["height"]))
        .when(p["type"] == "audio", F.greatest(F.lit(1), F.ceil(F.coalesce(p["millis"], F.lit(0)) * AUDIO_RATE / 1000)))
        .otherwise(F.greatest(F.lit(1), F.coalesce(p["pages"], F.lit(1))) * PAGE_TOKENS)
        .cast("bigint")
    )


def visit(parts: Column) -> Column:
    """Fold of a turn's parts: body, text spans within it, attachments and their tokens."""
    zero = F.struct(
        F.lit("").alias("body"),
        F.array().cast(SPANS).alias("spans"),
        F.array().cast(ATTACHMENTS).alias("attachments"),
        F.lit(0).cast("int").alias("n"),
    )

    def step(acc: Column, p: Column) -> Column:
        is_text = F.coalesce(p["type"], F.lit("text")) == "text"
        tokens = expanded_tokens(p)
        piece = F.when(is_text, escape(F.coalesce(p["text"], F.lit("")))).otherwise(
            F.concat(F.lit("<"), escape(p["type"]), F.lit(" "), acc["n"].cast("string"), F.lit(" tokens="), tokens.cast("string"), F.lit(">"))
        )
        span = F.struct(F.length(acc["body"]).cast("bigint").alias("start"), F.length(piece).cast("bigint").alias("len"))
        attachment = F.struct(acc["n"].alias("part"), p["type"].alias("kind"), p["ref"].alias("ref"), tokens.alias("tokens"))
        return F.struct(
            F.concat(acc["body"], piece).alias("body"),
            F.when(is_text, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).cast(SPANS).alias("spans"),
            F.when(is_text, acc["attachments"]).otherwise(F.concat(acc["attachments"], F.array(attachment))).cast(ATTACHMENTS).alias("attachments"),
            (acc["n"] + 1).cast("int").alias("n"),
        )

    return F.aggregate(F.coalesce(parts, F.array().cast(f"array<{PART}>")), zero, step)


def format_chat(turns: DataFrame, learned_role: str = "assistant") -> DataFrame:
    """One row per conversation from (conv_id, turn, role, parts).

    ``parts``: array of ``PART``.  Returns conv_id, formatted, ``turns`` (start and
    length of each turn's segment in ``formatted``, its loss spans relative to the
    segment, attachments, expanded tokens) and ``loss_spans`` in ``formatted``.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    head = F.concat(F.lit("<turn "), escape(role), F.lit(">\n"))
    one = (
        turns.select("conv_id", "turn", role.alias("role"), head.alias("head"), visit(F.col("parts")).alias("v"))
        .select("conv_id", "turn", "role", F.concat("head", "v.body", F.lit("</turn>\n")).alias("segment"), F.length("head").cast("bigint").alias("head"), "v")
        .select(
            "conv_id", "turn", "role", "segment",
            F.length("segment").cast("bigint").alias("length"),
            F.when(F.col("role") == learned_role, F.transform("v.spans", lambda s: F.struct((s["start"] + F.col("head")).alias("start"), s["len"].alias("len")))).otherwise(F.array().cast(SPANS)).alias("loss"),
            F.col("v.attachments").alias("attachments"),
            F.aggregate("v.attachments", F.lit(0).cast("bigint"), lambda a, x: a + x["tokens"]).alias("expanded"),
        )
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "segment").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = one.withColumn("start", F.sum("length").over(order) - F.col("length"))
    grouped = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("start", "length", "loss", "attachments", "expanded", "segment"))).alias("t"))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["segment"]), "").alias("formatted"),
        F.transform("t", lambda x: x.dropFields("segment")).alias("turns"),
        F.flatten(F.transform("t", lambda x: F.transform(x["loss"], lambda s: F.struct((s["start"] + x["start"]).alias("start"), s["len"].alias("len"))))).alias("loss_spans"),
    )


def read_chat(formatted: DataFrame) -> DataFrame:
    """Roles, texts and learned texts, from the formatted text and its spans alone."""
    segments = F.slice(F.split("formatted", "<turn "), 2, 2_147_483_647)
    close = len("</turn>\n")

    def turn(segment: Column) -> Column:
        head = F.substring_index(segment, ">\n", 1)
        skip = F.length(head) + 2
        body = F.substring(segment, skip + 1, F.length(segment) - skip - close)
        return F.struct(unescape(head).alias("role"), unescape(F.regexp_replace(body, "<[^<>]*>", "")).alias("text"))

    def learned(segment: Column, i: Column) -> Column:
        mark = len("<turn ")
        return F.array_join(F.transform(F.get(F.col("turns"), i)["loss"], lambda s: unescape(F.substring(segment, (s["start"] - mark + 1).cast("int"), s["len"].cast("int")))), "")

    return (
        formatted.withColumn("segments", segments)
        .withColumn("read", F.transform("segments", turn))
        .withColumn("learned", F.array_join(F.transform("segments", learned), ""))
        .select("conv_id", "formatted", "read", "learned")
    )


def chat_digest(formatted: DataFrame) -> DataFrame:
    """Digests of what reading back gives, per conversation."""
    said = F.array_join(F.transform("read", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return read_chat(formatted).select(
        "conv_id",
        F.size("read").cast("bigint").alias("n_turns"),
        sha(said).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"),
        sha(F.col("learned")).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def plain_turns(conversations: DataFrame) -> DataFrame:
    """Turns of plain texts as turns of one text part each."""
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("millis", "bigint"), ("pages", "int"))]
    part = F.struct(F.lit("text").alias("type"), F.col("text").cast("string").alias("text"), *nothing)
    return conversations.select("conv_id", "turn", "role", F.array(part).alias("parts"))
