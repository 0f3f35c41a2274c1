"""Chat formatting with typed content parts.

A turn's content is a list of typed parts. The visitor ``flattened`` walks the parts in
order: text stays text, and an image, audio or document part becomes a placeholder between
control strings, records what it refers to, and says how many tokens it will be expanded
to. ``formatted`` puts the turns of a conversation into one string with a loss mask over
the assistant's texts, and ``read_back`` takes such a string apart again.

Template: ``<|im_start|>`` role ``<|im_sep|>`` content ``<|im_end|>`` for each turn. In
roles and texts the control strings of this and of common other templates are escaped: a
backslash goes between their first character and the rest, and backslashes are doubled.
So no control string is left inside a text, and taking away the escapes gives the text
back, whatever it contains.

Only DataFrame functions are used. A conversation is one string by definition, so one row
holds all its turns. Turns are in order of ``turn`` (NULL first), then role and text;
repeated rows are repeated turns. NULL texts, roles and parts are empty; a NULL ``conv_id``
is a conversation like any other. Texts of any length are kept whole. An empty table gives
no conversation. Columns beside the turn's own are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Control strings of this template, its parts, and of common templates.
START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL_HEADS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

TRAINED_ROLE = "assistant"

# Side of an image patch, seconds of audio and characters of a page that make a token.
IMAGE_PATCH, AUDIO_SECOND_TOKENS, PAGE_TOKENS = 14, 25, 512

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escaped(text: F.Column) -> F.Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for head in CONTROL_HEADS:
        text = F.replace(text, F.lit(head), F.lit(f"{head[0]}\\{head[1:]}"))
    return text


def unescaped(text: F.Column) -> F.Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_parts(text: str = "text") -> F.Column:
    """A plain text as a list of one text part."""
    fields = ["CAST(NULL AS string) AS ref", "CAST(NULL AS int) AS width", "CAST(NULL AS int) AS height"]
    fields += ["CAST(NULL AS double) AS seconds", "CAST(NULL AS int) AS pages"]
    return F.expr(f"array(struct('text' AS kind, `{text}` AS text, {', '.join(fields)}))")


def _tokens(part: F.Column) -> F.Column:
    """Tokens that a part which is no text is expanded to; one at least."""
    side = lambda name: F.ceil(F.coalesce(part[name], F.lit(0)) / IMAGE_PATCH)
    tokens = (
        F.when(part["kind"] == "image", side("width") * side("height"))
        .when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_SECOND_TOKENS))
        .when(part["kind"] == "document", F.coalesce(part["pages"], F.lit(0)) * PAGE_TOKENS)
    )
    return F.greatest(tokens, F.lit(1)).cast("bigint")


def flattened(turns: DataFrame, parts: str = "parts") -> DataFrame:
    """Adds ``content``, the escaped text with placeholders, and ``attachments`` of each turn.

    An attachment has its ``place`` among the turn's attachments, kind, reference and
    tokens, in the order of the placeholders. Parts of an unknown kind are an error.
    """
    known = F.array(F.lit("text"), F.lit("image"), F.lit("audio"), F.lit("document"))

    def visit(part: F.Column) -> F.Column:
        name = F.when(F.array_contains(known, part["kind"]), part["kind"]).otherwise(
            F.raise_error(F.concat(F.lit("unknown part: "), F.coalesce(part["kind"], F.lit("NULL"))))
        )
        return F.when(part["kind"] == "text", escaped(F.coalesce(part["text"], F.lit("")))).otherwise(
            F.concat(F.lit("<|"), name, F.lit("|>"))
        )

    listed = F.filter(F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    attached = F.filter(listed, lambda p: p["kind"] != "text")
    return turns.withColumns(
        {
            "content": F.array_join(F.transform(listed, visit), ""),
            "attachments": F.transform(
                attached,
                lambda p, i: F.struct(
                    i.alias("place"), p["kind"].alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens")
                ),
            ),
        }
    )


def formatted(turns: DataFrame, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """One row per conversation from turns (conv_id, turn, role, parts).

    ``formatted`` is the string, ``loss_mask`` the spans that are trained on: index of the
    turn, start in the string, offset in the turn's segment and length, all in characters.
    ``attachments`` are those of all turns with the index of their turn, and
    ``expanded_tokens`` what their placeholders stand for.
    """
    one = flattened(turns).select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.concat(F.lit(START), escaped(F.coalesce("role", F.lit(""))), F.lit(MIDDLE)).alias("head"),
        "content",
        "attachments",
    )
    # Places are numbered and lengths added up in order, in one sort that can spill.
    order = "PARTITION BY conv_id ORDER BY turn, role, content"
    before = f"{order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    placed = one.selectExpr(
        "conv_id",
        f"CAST(row_number() OVER ({order}) - 1 AS int) AS i",
        f"coalesce(sum(char_length(head) + char_length(content) + {len(END)}) OVER ({before}), 0L) AS at",
        "role",
        "head",
        "content",
        "attachments",
    )
    # A conversation's turns are one row by definition, as its string is.
    gathered = placed.groupBy("conv_id").agg(
        F.expr("array_sort(collect_list(struct(i, at, role, head, content, attachments))) AS turns")
    )
    spans = (
        f"transform(filter(turns, t -> t.role = '{trained_role}'), t -> struct(t.i AS turn, "
        "t.at + char_length(t.head) AS start, char_length(t.head) AS offset, char_length(t.content) AS length))"
    )
    attachments = (
        "flatten(transform(turns, t -> transform(t.attachments, x -> "
        "struct(t.i AS turn, x.place AS place, x.kind AS kind, x.ref AS ref, x.tokens AS tokens))))"
    )
    return gathered.selectExpr(
        "conv_id",
        f"array_join(transform(turns, t -> concat(t.head, t.content, '{END}')), '') AS formatted",
        f"{spans} AS loss_mask",
        f"{attachments} AS attachments",
        "aggregate(turns, 0L, (a, t) -> a + aggregate(t.attachments, 0L, (b, x) -> b + x.tokens)) AS expanded_tokens",
    )


def _literal(text: str) -> str:
    """A pattern that matches the text as it is."""
    return "\\Q" + text + "\\E"


def read_back(strings: DataFrame) -> DataFrame:
    """Adds ``turns`` (role, text) and ``loss_texts``, taken from the string and its mask alone.

    Texts are unescaped; placeholders stay as they are. A span is cut from the segment of
    its turn, which takes time in proportion to the string.
    """
    pieces = F.split("formatted", _literal(END))
    segments = strings.withColumn("segments", F.transform(F.array(pieces), lambda p: F.slice(p, 1, F.size(p) - 1))[0])
    read = segments.withColumn(
        "turns",
        F.transform(
            "segments",
            lambda s: F.transform(
                F.array(F.split(s, _literal(MIDDLE), 2)),
                lambda sides: F.struct(
                    unescaped(F.substring(sides[0], len(START) + 1, 2**31 - 1)).alias("role"),
                    unescaped(sides[1]).alias("text"),
                ),
            )[0],
        ),
    )
    # The one-entry array keeps the segments from being made anew for every span.
    cut = F.expr(
        "transform(array(segments), s -> transform(loss_mask, m -> substring(s[m.turn], m.offset + 1, m.length)))[0]"
    )
    return read.withColumn("loss_texts", F.transform(cut, unescaped)).drop("segments")
