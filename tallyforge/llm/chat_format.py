"""Chat formatting with Spark expressions only.

Template. Adjacent turns of one role become one block; the texts of the rows that were merged
stay apart by a marker, so the output can be read back row by row:

    <|turn|>ROLE\\nTEXT<|next|>TEXT<|end|>\\n

Escaping. A backslash in a text or a role becomes two; a backslash is put after the first character
of each control string (`<|`, `<s>`, `</s>`, `[INST]`, `[/INST]`) and, in roles, before a newline.
Dropping each backslash and keeping the character after it gives the original back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, NEXT, CLOSE = "<|turn|>", "<|next|>", "<|end|>\n"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    text = F.regexp_replace(text, r"\\", r"\\\\")
    text = F.regexp_replace(text, r"<(?=\||/?s>)", r"<\\")
    return F.regexp_replace(text, r"\[(?=/?INST\])", r"[\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = LOSS_ROLE) -> DataFrame:
    """One row per conversation: conv_id, formatted, segments.

    segments: array<struct<text, loss>>; the texts joined are `formatted`, and loss marks what a
    model is trained on, each text of `loss_role` by itself.

    Turns sort by turn, then role, then text, nulls first; a null role or text is empty; rows with a
    null conv_id are one conversation; repeated rows stay; an empty table gives no rows; other
    columns are not read. One conversation becomes one row, as the output asks.
    """
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    )
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    # Positions at which a new role begins; array_compact keeps this linear in the number of turns.
    begins = F.filter(F.transform("t", lambda x, i: F.when((i == 0) | (x["role"] != F.get("t", i - 1)["role"]), i)), lambda i: i.isNotNull())
    merged = F.transform(
        "begins",
        lambda at, k: F.struct(
            F.get("t", at)["role"].alias("role"),
            F.transform(F.slice("t", at + 1, F.coalesce(F.get("begins", k + 1), F.size("t")) - at), lambda x: escape(x["text"])).alias("texts"),
        ),
    )
    header = lambda b: F.concat(F.lit(OPEN), F.regexp_replace(escape(b["role"]), "\n", "\\\\\n"), F.lit("\n"))
    plain = lambda c: F.struct(c.alias("text"), F.lit(False).alias("loss"))
    segments = F.flatten(
        F.transform(
            "merged",
            lambda b: F.concat(
                F.array(plain(header(b))),
                F.flatten(F.transform(b["texts"], lambda x, i: F.concat(
                    F.when(i > 0, F.array(plain(F.lit(NEXT)))).otherwise(F.array().cast("array<struct<text:string,loss:boolean>>")),
                    F.array(F.struct(x.alias("text"), (b["role"] == loss_role).alias("loss"))),
                ))),
                F.array(plain(F.lit(CLOSE))),
            ),
        )
    )
    return (
        grouped.withColumn("begins", begins)
        .withColumn("merged", merged)
        .select("conv_id", segments.alias("segments"))
        .select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")
    )


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of the original rows of a formatted conversation; null for null, and no rows for an empty text."""
    parts = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda p: p != "")
    # Possessive: a role of any length is read in a loop, where a plain group would go one call deeper for each character.
    head = r"(?s)^<\|turn\|>([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n(.*)$"
    return F.flatten(
        F.transform(parts, lambda p: F.transform(
            F.split(F.regexp_extract(p, head, 2), r"<\|next\|>"),
            lambda x: F.struct(unescape(F.regexp_extract(p, head, 1)).alias("role"), unescape(x).alias("text")),
        ))
    )


def masked(formatted: Column, segments: Column) -> Column:
    """What `formatted` says under the loss mask, unescaped and joined; '' if nothing is under it.

    Of the segments only the marks are read. Control segments begin with `<|`, which no escaped text does.
    """
    marks = F.transform(F.filter(segments, lambda s: ~s["text"].startswith("<|")), lambda s: s["loss"])
    texts = F.zip_with(read_back(formatted), marks, lambda t, loss: F.when(loss, t["text"]))
    return F.array_join(F.filter(texts, lambda t: t.isNotNull()), "")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests read back from the formatted text of every conversation, and of conversation -1."""
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(own)
    return (
        format_conversations(table)
        .select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), masked(F.col("formatted"), F.col("segments")).alias("loss"))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
            F.char_length("loss").cast("long").alias("loss_chars"),
            F.sha2("loss", 256).alias("loss_sha256"),
            F.char_length("formatted").cast("long").alias("formatted_chars"),
        )
    )


OP9_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, row_number() OVER w AS i, lag(role) OVER w AS before,
    length(text) + (length(text) - length(replace(text, '\', '')))
      + len(regexp_extract_all(text, '<\||</?s>')) + len(regexp_extract_all(text, '\[/?INST\]')) AS body,
    length(role) + (length(role) - length(replace(role, '\', '')))
      + len(regexp_extract_all(role, '<\||</?s>|\n')) + len(regexp_extract_all(role, '\[/?INST\]')) AS head
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(CASE WHEN i = 1 OR role <> before THEN 8 + head + 1 + 8 ELSE 8 END + body)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
