r"""Chat formatting whose output is read back by a grammar before it is let go.

Grammar:  chat = "#" level "\n" { turn };  turn = "### " role ": " text "</turn>" "\n"
A conversation is first rendered as it stands (level 0), parsed again and compared with its turns. If they differ,
control strings and backslashes in its roles and texts are escaped (level 1), and it is parsed and compared again;
a conversation that even then differed would be an error. Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, MIDDLE, END = "### ", ": ", "</turn>"
#: What is escaped, in this order: each replacement is a backslash and one letter.
ESCAPES = (("\\", "\\b"), ("</turn>", "\\e"), ("###", "\\h"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def _replace(c: Column, pairs) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def _unescape(c: Column) -> Column:
    return _replace(c, [(new, old) for old, new in reversed(ROLE_ESCAPES)])


def _render(turns: Column, level: int) -> Column:
    def turn(t: Column) -> Column:
        role, text = (_replace(t["role"], ROLE_ESCAPES), _replace(t["text"], ESCAPES)) if level else (t["role"], t["text"])
        return F.concat(F.lit(TURN), role, F.lit(MIDDLE), text, F.lit(END + "\n"))

    return F.concat(F.lit(f"#{level}\n"), F.array_join(F.transform(turns, turn), ""))


def _pieces(formatted: Column) -> Column:
    """The raw turns of a formatted chat, without their ends."""
    parts = F.split(F.substring(formatted, 4, 2147483647), END + "\n?")
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def _level(formatted: Column) -> Column:
    return F.substring(formatted, 2, 1)


def _gap(piece: Column) -> Column:
    """Position of the middle mark in a piece, from 1; 0 if there is none."""
    return F.locate(MIDDLE, piece)


def parse(formatted: Column) -> Column:
    """The turns of a formatted chat as array<struct<role, text>>; null where it breaks the grammar."""
    pieces, level = _pieces(formatted), _level(formatted)

    def turn(p: Column) -> Column:
        role, text = F.substr(p, F.lit(5), _gap(p) - 5), F.substr(p, _gap(p) + 2)
        return F.struct(F.when(level == "1", _unescape(role)).otherwise(role).alias("role"), F.when(level == "1", _unescape(text)).otherwise(text).alias("text"))

    sound = F.forall(pieces, lambda p: p.startswith(TURN) & (_gap(p) >= 5) & ~F.substring(p, 5, 2147483647).contains(TURN))
    return F.when(sound, F.transform(pieces, turn))


def loss_spans(formatted: Column) -> Column:
    """array<struct<start, length>> (code points, from 0): the assistant's texts as they stand in the output."""
    start = F.struct(F.lit(3).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        span = F.struct((acc["at"] + _gap(p) + 1).alias("start"), (F.length(p) - _gap(p) - 1).alias("length"))
        mine = F.substr(p, F.lit(5), _gap(p) - 5) == "assistant"
        return F.struct((acc["at"] + F.length(p) + len(END) + 1).alias("at"), F.when(mine, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(_pieces(formatted), start, step, lambda acc: acc["spans"])


def loss_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped."""
    raw = F.transform(spans, lambda s: F.substr(formatted, s["start"] + 1, s["length"]))
    return F.array_join(F.when(_level(formatted) == "1", F.transform(raw, _unescape)).otherwise(raw), "")


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, spans (of the loss mask). One row per conv_id; null ids form one conversation.

    Turns go by turn (null first), ties by role, then text; repeated rows are repeated turns. Null roles and texts
    count as empty. A conversation is one value in the end, so its turns meet in one row.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    turns = turns.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    for level in (0, 1):
        turns = turns.withColumn(f"out{level}", _render(F.col("turns"), level) if not level else F.when(F.col("same0"), F.col("out0")).otherwise(_render(F.col("turns"), 1)))
        turns = turns.withColumn(f"same{level}", F.coalesce(parse(F.col(f"out{level}")) == F.col("turns"), F.lit(False)))
    formatted = F.when(F.col("same1"), F.col("out1")).otherwise(F.raise_error(F.lit("a conversation does not survive its template")))
    return turns.select("conv_id", formatted.alias("formatted")).withColumn("spans", loss_spans(F.col("formatted")))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), x AS (
  SELECT *, contains(text, '</turn>') OR contains(text, '### ') OR contains(role, '</turn>') OR contains(role, '### ') OR contains(role, ': ') AS odd,
    length(text) AS raw_n, length(role) AS role_n,
    length(replace(replace(replace(text, '\', '\b'), '</turn>', '\e'), '###', '\h')) AS esc_n,
    length(replace(replace(replace(replace(role, '\', '\b'), '</turn>', '\e'), '###', '\h'), ':', '\c')) AS role_esc_n
  FROM c
), g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    bool_or(odd) AS odd, sum(raw_n + role_n) AS raw_n, sum(esc_n + role_esc_n) AS esc_n
  FROM x GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(3 + 14 * n_turns + CASE WHEN odd THEN esc_n ELSE raw_n END AS BIGINT) AS formatted_chars
FROM g
"""
