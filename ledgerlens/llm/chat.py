r"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted by turn; adjacent turns of one role become one marked
turn, whose texts stay apart by a mark of their own. Template:

    <|im_start|>ROLE<|im_body|>TEXT{<|im_next|>TEXT}<|im_end|> ...

In roles and texts a backslash is doubled, and one is set behind the first character of each control string (those of
the template, and the marks of other common templates), so that no control string is left in them; reading back drops
a backslash before any character. So every formatted conversation gives back its rows exactly.

The loss mask comes with the formatted text, as the spans of code points that a model is trained to give: each of the assistant's texts, without any mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound, table

START, BODY, NEXT, END = "<|im_start|>", "<|im_body|>", "<|im_next|>", "<|im_end|>"
CONTROL = r"(<(?=\||s>|/s>|<SYS>>|</SYS>>)|\[(?=INST\]|/INST\]))"
#: The role that is trained, and the pieces whose lengths are summed at a time.
TRAINED, BLOCK = "assistant", 128
#: Says the control strings of another template.
PROBE = "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _with_starts(d: DataFrame) -> DataFrame:
    """d with starts: where each of the pieces of these lengths starts. Sums are taken by blocks of BLOCK pieces, so that a long conversation doesn't cost
    the square of its turns."""
    total = lambda c, first, n: F.aggregate(F.slice(c, first, n), F.lit(0).cast("long"), lambda a, x: a + x)
    d = bound(d, blocks=F.transform(F.sequence(F.lit(0), F.floor((F.size("lengths") - 1) / BLOCK).cast("int")), lambda b: total("lengths", b * BLOCK + 1, F.lit(BLOCK))))
    d = bound(d, before=F.transform("blocks", lambda x, b: total("blocks", F.lit(1), b)))
    return bound(d, starts=F.transform("lengths", lambda x, i: F.get("before", F.floor(i / BLOCK).cast("int")) + total("lengths", i - i % BLOCK + 1, i % BLOCK)))


def format_conversations(turns: DataFrame) -> DataFrame:
    """turns: conv_id, turn, role, text. One row per conversation: conv_id, formatted, loss_spans array<struct<start long, end long>>.

    loss_spans: code points of formatted, from 0, end excluded, one span for each of the assistant's texts, in order; an empty text has an empty span.
    Turns with equal numbers are taken by role, then text; a null turn number comes first; null roles and texts are empty;
    repeated rows stay, each a text of its own; a null conv_id is a conversation; columns other than the four are neither read nor
    returned; an empty table gives an empty result. A conversation is one row of the result, and so of one task.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    one = turns.select("conv_id", row.alias("row")).groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))

    def mark(r: Column, i: Column) -> Column:
        again = (i > 0) & (F.get(F.col("rows"), i - 1)["role"] == r["role"])
        opened = F.concat(F.when(i > 0, F.lit(END)).otherwise(F.lit("")), F.lit(START), escape(r["role"]), F.lit(BODY))
        return F.struct(F.when(again, F.lit(NEXT)).otherwise(opened).alias("mark"), escape(r["text"]).alias("text"), (r["role"] == TRAINED).alias("on"))

    one = bound(one, pieces=F.transform("rows", mark))
    one = bound(one, lengths=F.transform("pieces", lambda p: (F.length(p["mark"]) + F.length(p["text"])).cast("long")))
    one = _with_starts(one)
    spans = F.transform("pieces", lambda p, i: F.struct(p["on"].alias("on"), (F.get("starts", i) + F.length(p["mark"])).alias("start"), (F.get("starts", i) + F.get("lengths", i)).alias("end")))
    loss = F.transform(F.filter(spans, lambda s: s["on"]), lambda s: F.struct(s["start"], s["end"]))
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["mark"], p["text"])), "")
    return one.select("conv_id", F.concat(text, F.lit(END)).alias("formatted"), loss.alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """array<struct<role, texts: array<string>>> of a formatted conversation, unescaped."""
    own = F.filter(F.split(formatted, r"<\|im_end\|>"), lambda x: x != "")

    def turn(x: Column) -> Column:
        halves = F.split(F.substr(x, F.lit(len(START) + 1)), r"<\|im_body\|>", 2)
        return F.struct(unescape(halves[0]).alias("role"), F.transform(F.split(halves[1], r"<\|im_next\|>"), unescape).alias("texts"))

    return F.transform(own, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def digests(formatted: DataFrame) -> DataFrame:
    """formatted: conv_id, formatted, loss_spans. What can be read back from the output."""
    f = formatted.withColumn("parsed", parse(F.col("formatted")))
    rows = F.flatten(F.transform("parsed", lambda t: F.transform(t["texts"], lambda x: F.concat(t["role"], F.lit("\n"), x, F.lit("\n")))))
    f = f.withColumn("_rows", rows).withColumn("_loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    return f.select(
        "conv_id",
        F.size("_rows").cast("long").alias("n_turns"),
        F.sha2(F.array_join("_rows", "").cast("binary"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("parsed").cast("long").alias("n_marked_turns"),
    )


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(f"SELECT -1L AS conv_id, CAST(turn AS LONG) AS turn, role, '{PROBE}' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)")
    return digests(format_conversations(turns.unionByName(probe)))


_ESC = r"regexp_replace(replace(x, '\', '\\'), '(<)(\||s>|/s>|<SYS>>|</SYS>>)|(\[)(INST\]|/INST\])', '\1\3\\\2\4', 'g')"
#: What op4_chat_format returns, in DuckDB's SQL; RE2 has no look-ahead, and no two control strings of CONTROL share characters but in <</SYS>>.
OP4_SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, t, r, '{PROBE}' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
m AS (SELECT *, row_number() OVER w - 1 AS i, lag(role) OVER w AS before FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
n AS (SELECT conv_id, i, role, text, i > 0 AND before = role AS again, {_ESC.replace('replace(x,', 'replace(role,')} AS erole, {_ESC.replace('replace(x,', 'replace(text,')} AS etext FROM m),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS turns, coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length(etext) + CASE WHEN again THEN {len(NEXT)} ELSE {len(START + BODY + END)} + length(erole) END) AS formatted_chars, count(*) FILTER (WHERE NOT again) AS n_marked_turns FROM n GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars, n_marked_turns FROM g
"""
