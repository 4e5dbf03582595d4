"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is an array of typed parts. A visitor turns each part into text: text parts are escaped,
every other part becomes a placeholder, and its reference is recorded in ``attachments`` in the order of the
placeholders together with the number of tokens it expands to. Turns are framed by markers; the loss mask
lists the assistant spans by turn and offset, so applying it never scans a conversation from its start.

Escaping is reversible: after it a text holds no ``<`` and no ``[``, so no control string (``<|turn|>``,
``</s>``, ``[INST]``) can arise from content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>"
BEGIN_ALL, END_ALL = "<s>", "</s>"
#: Placeholders by kind of part; a part of any other kind becomes <|file|> and expands to no tokens.
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
PART = "struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\s"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("[")), F.lit("\\b"), F.lit("\\"))


def text_part(c: Column) -> Column:
    """A plain text as a content of one part."""
    none = F.lit(None)
    return F.array(
        F.struct(
            F.lit("text").alias("kind"), c.cast("string").alias("text"), none.cast("string").alias("uri"), none.cast("int").alias("width"),
            none.cast("int").alias("height"), none.cast("double").alias("seconds"), none.cast("int").alias("pages"),
        )
    )


def visit_text(part: Column) -> Column:
    """What a part leaves in the text."""
    out = F.when(F.coalesce(part["kind"], F.lit("text")) == "text", escape(F.coalesce(part["text"], F.lit(""))))
    for kind, mark in PLACEHOLDERS.items():
        out = out.when(part["kind"] == kind, F.lit(mark))
    return out.otherwise(F.lit("<|file|>"))


def visit_tokens(part: Column, image_patch: int, audio_rate: float, page_tokens: int) -> Column:
    """The tokens that a placeholder expands to."""
    n = lambda x: F.coalesce(x, F.lit(0))
    return (
        F.when(part["kind"] == "image", F.ceil(n(part["width"]) / image_patch) * F.ceil(n(part["height"]) / image_patch))
        .when(part["kind"] == "audio", F.ceil(n(part["seconds"]) * audio_rate))
        .when(part["kind"] == "document", n(part["pages"]) * page_tokens)
        .otherwise(F.lit(0))
        .cast("bigint")
    )


def format_chats(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text",
    learn_role: str = "assistant", image_patch: int = 28, audio_rate: float = 25.0, page_tokens: int = 256,
) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_mask, attachments, n_attachment_tokens.

    ``content`` is a string or an array of parts (PART). ``loss_mask`` lists (turn, start, length): the
    ordinal of the turn from 0, the code point offset from 1 inside that turn's segment, and the length.
    Turns are ordered by ``turn`` (null first), ties by role, then by the unescaped text, by code point, then by the
    formatted parts. A null role or text is empty,
    a null content array has no parts, rows with a null ``conv`` form one conversation. Repeated rows are
    repeated turns. Other columns are ignored, so they may have any name. No rows give no rows.
    """
    is_text = dict(rows.dtypes)[content] == "string"
    parts = text_part(F.col(f"`{content}`")) if is_text else F.coalesce(F.col(f"`{content}`"), F.from_json(F.lit("[]"), f"array<{PART}>"))
    r = rows.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), parts.alias("parts"))
    raw = F.concat_ws("", F.transform("parts", lambda p: F.coalesce(p["text"], F.lit(""))))
    r = r.withColumn("raw", raw).withColumn("head", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY))).withColumn("body", F.concat_ws("", F.transform("parts", visit_text)))
    seen = F.filter("parts", lambda p: F.coalesce(p["kind"], F.lit("text")) != "text")
    refs = F.transform(seen, lambda p: F.struct(p["kind"].alias("kind"), p["uri"].alias("uri"), visit_tokens(p, image_patch, audio_rate, page_tokens).alias("tokens")))
    r = r.select(
        "conv_id", "turn", "role", "raw", F.concat("head", "body", F.lit(END)).alias("segment"), (F.length("head") + 1).alias("start"),
        F.when(F.col("role") == learn_role, F.length("body")).otherwise(0).alias("length"), refs.alias("refs"),
    )
    g = r.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "raw", "segment", "start", "length", "refs"))).alias("turns"))
    mask = F.filter(
        F.transform("turns", lambda t, i: F.struct(i.alias("turn"), t["start"].alias("start"), t["length"].alias("length"))), lambda m: m["length"] > 0
    )
    refs = F.flatten(F.transform("turns", lambda t, i: F.transform(t["refs"], lambda a: F.struct(i.alias("turn"), a["kind"].alias("kind"), a["uri"].alias("uri"), a["tokens"].alias("tokens")))))
    return g.select(
        "conv_id", F.concat(F.lit(BEGIN_ALL), F.concat_ws("", F.col("turns.segment")), F.lit(END_ALL)).alias("formatted"), mask.alias("loss_mask"), refs.alias("attachments")
    ).withColumn("n_attachment_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda s, a: s + a["tokens"]))


def segments(formatted: Column) -> Column:
    """The turns' segments of a formatted conversation, without the turn marker. Content cannot hold a marker."""
    return F.slice(F.split(formatted, r"\Q<|turn|>\E"), 2, 2147483646)


def read_chats(formatted: DataFrame) -> DataFrame:
    """Parse formatted conversations back: conv_id, turns (role, text), loss_text, formatted."""
    s = formatted.withColumn("segments", segments(F.col("formatted")))
    # offsets of the mask count the turn marker, which splitting removed
    loss = F.transform("loss_mask", lambda m: unescape(F.substring(F.get(F.col("segments"), m["turn"]), m["start"] - len(TURN), m["length"])))
    turns = F.transform(
        "segments",
        lambda x: F.struct(
            unescape(F.substring_index(x, BODY, 1)).alias("role"), unescape(F.substring_index(F.substring_index(x, END, 1), BODY, -1)).alias("text")
        ),
    )
    return s.select("conv_id", "formatted", turns.alias("turns"), F.concat_ws("", loss).alias("loss_text"), "attachments", "n_attachment_tokens")


def chat_digests(read: DataFrame) -> DataFrame:
    """The digests of parsed conversations."""
    flat = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"), F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


#: The same digests in DuckDB.
CHAT_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(role) + length(role) - length(replace(replace(replace(role, '\', ''), '<', ''), '[', '')) AS role_chars,
    length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '[', '')) AS text_chars FROM r)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (7 + sum(role_chars + text_chars + 23))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""
