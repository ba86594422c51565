r"""Chat formatting checked by a grammar round trip, in built-in functions only.

A conversation is rendered by a template, the rendered text is parsed again by a
deterministic grammar, and the recovered turns are compared with the source. Where
they differ, content conflicts with control strings: the conversation is rendered
again at the next escape level, until the round trip is exact.

    conversation = "#" level "\n" turn*
    turn = "[INST]" text "[/INST]"             a user's
         | "<s>" text "</s>"                   an assistant's
         | "<<SYS>>" role "\n" text "<</SYS>>" any other role's

A turn ends at the first closing mark of its own kind. At level 0 texts stand as
they are. At level 1 "\" is written "\b", "[" "\o", "<" "\l", and in roles a line
feed "\n", so no control string can occur and reading is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import read_table

#: kind -> (opening mark, closing mark)
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "other": ("<<SYS>>", "<</SYS>>")}
LEVELS = (0, 1)
_TURN = r"(?s)\[INST\].*?\[/INST\]|<s>.*?</s>|<<SYS>>.*?<</SYS>>"
_ESCAPES = (("\\", "\\b"), ("[", "\\o"), ("<", "\\l"))
_LINE_FEED = ("\n", "\\n")


def _escaped(text: Column, level: int, role: bool = False) -> Column:
    if level:
        for plain, code in (*_ESCAPES, _LINE_FEED)[: 4 if role else 3]:
            text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def _unescaped(text: Column, level: Column) -> Column:
    plain = text
    for p, code in (*_ESCAPES, _LINE_FEED)[::-1]:
        plain = F.replace(plain, F.lit(code), F.lit(p))
    return F.when(level == 0, text).otherwise(plain)


def _kind(role: Column, user: Column, assistant: Column, other: Column) -> Column:
    return F.when(role == "user", user).when(role == "assistant", assistant).otherwise(other)


def render(turns: Column, level: int) -> Column:
    """The formatted text of an array of (role, text)."""

    def one(t: Column) -> Column:
        text = _escaped(t["text"], level)
        other = F.concat(_escaped(t["role"], level, True), F.lit("\n"), text)
        wrap = lambda kind, inner: F.concat(F.lit(MARKS[kind][0]), inner, F.lit(MARKS[kind][1]))
        return _kind(t["role"], wrap("user", text), wrap("assistant", text), wrap("other", other))

    return F.concat(F.lit(f"#{level}\n"), F.array_join(F.transform(turns, one), ""))


def _level(formatted: Column) -> Column:
    return F.substring(formatted, 2, 1).cast("int")


def _raw_turns(formatted: Column) -> Column:
    """The turns of a formatted text with their marks, or null if it is none."""
    found = F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0))
    whole = F.concat(F.substring(formatted, 1, 3), F.array_join(found, "")) == formatted
    return F.when(whole, found)


def parse(formatted: Column) -> Column:
    """The array of (role, text) read back from a formatted text."""

    def one(raw: Column) -> Column:
        inner = lambda kind: F.substring(raw, len(MARKS[kind][0]) + 1, F.length(raw) - sum(map(len, MARKS[kind])))
        read = lambda text: _unescaped(text, _level(formatted))
        turn = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
        body = inner("other")
        cut = F.instr(body, F.lit("\n"))
        other = turn(read(F.substring(body, F.lit(1), cut - 1)), read(F.substring(body, cut + 1, F.length(body))))
        return (
            F.when(F.startswith(raw, F.lit("[")), turn(F.lit("user"), read(inner("user"))))
            .when(F.startswith(raw, F.lit("<s>")), turn(F.lit("assistant"), read(inner("assistant"))))
            .otherwise(other)
        )

    return F.transform(_raw_turns(formatted), one)


def loss_spans(formatted: Column) -> Column:
    """(start, length) in code points of what lies under the loss mask: the inside of
    each assistant turn."""
    begin, end = (len(x) for x in MARKS["assistant"])
    span = lambda at, raw: F.struct((at + begin).alias("start"), (F.length(raw).cast("long") - begin - end).alias("length"))
    start = F.struct(F.lit(3).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, raw: Column) -> Column:
        here = F.startswith(raw, F.lit("<s>"))
        spans = F.when(here, F.concat(acc["spans"], F.array(span(acc["at"], raw)))).otherwise(acc["spans"])
        return F.struct((acc["at"] + F.length(raw)).alias("at"), spans.alias("spans"))

    return F.aggregate(_raw_turns(formatted), start, step, lambda acc: acc["spans"])


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per conv_id: conv_id, formatted, level, loss_spans.

    Turns stand by turn, then role and text where turns tie, nulls first. Null roles
    and texts are empty, rows that repeat are turns of their own, rows with a null
    conv_id are one conversation. Other columns are ignored. Raises if no level
    gives the source back.
    """
    rows = conversations.select(
        "conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t")
    )
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    source = turns.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    exact = lambda formatted: F.coalesce(parse(formatted) == F.col("turns"), F.lit(False))
    tried = source.withColumn("formatted", render(F.col("turns"), LEVELS[0]))
    for level in LEVELS[1:]:
        tried = tried.withColumn("formatted", F.when(exact(F.col("formatted")), F.col("formatted")).otherwise(render(F.col("turns"), level)))
    checked = tried.withColumn("formatted", F.when(exact(F.col("formatted")), F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not survive the round trip"))))
    return checked.select("conv_id", "formatted", _level(F.col("formatted")).alias("level"), loss_spans(F.col("formatted")).alias("loss_spans"))


def read_back(formatted_chats: DataFrame) -> DataFrame:
    """Digests of formatted conversations, from the formatted text and the spans:
    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    text, turns = F.col("formatted"), parse(F.col("formatted"))
    every = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.transform("loss_spans", lambda s: _unescaped(F.substring(text, (s["start"] + 1).cast("int"), s["length"].cast("int")), _level(text)))
    loss = F.array_join(masked, "")
    return formatted_chats.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(every, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length(text).cast("long").alias("formatted_chars"),
    )


def op8_chat_format(spark, sf_dir: str) -> DataFrame:
    own = spark.range(1).select(
        F.inline(F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")) for k, role in enumerate(("user", "assistant"))]))
    )
    return read_back(format_chats(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)))


#: The same digests in DuckDB, from the source and the grammar's lengths.
ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), m AS (
  SELECT *,
    CASE role WHEN 'user' THEN contains(text, '[/INST]') WHEN 'assistant' THEN contains(text, '</s>')
      ELSE contains(role || chr(10) || text, '<</SYS>>') OR contains(role, chr(10)) END AS conflict,
    CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 16 + length(role) END + length(text) AS plain,
    length(text) - length(replace(replace(replace(text, '\', ''), '[', ''), '<', ''))
      + CASE WHEN role IN ('user', 'assistant') THEN 0 ELSE length(role)
        - length(replace(replace(replace(replace(role, '\', ''), '[', ''), '<', ''), chr(10), '')) END AS codes
  FROM t
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(plain) + CASE WHEN bool_or(conflict) THEN sum(codes) ELSE 0 END AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""
