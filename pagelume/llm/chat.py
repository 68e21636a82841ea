"""Operator 6: chat formatting with a grammar round trip, in DataFrame functions only.

conversation := turn*     turn := '<|im_start|>' role '\\n' body '<|im_end|>\\n'
A role is URL-encoded; a body may not hold a control string, and a backslash in it quotes the character that follows.
A conversation is rendered with its texts as they are and read back by the deterministic parser; where the turns differ
from the source or a body breaks the grammar, the texts are escaped (backslashes doubled, control strings broken after
their first character) and the round trip is made again; a difference that is left stops the job.

Scale: one shuffle of the rows by conversation; a conversation is one output value and so one row of one task.

Defined cases: null text or role is empty; turns sort by (turn, role, text), so ties have an order; repeated rows are
turns of their own; null conv_id is a conversation; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .native import let
from .store import table

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that no body may hold as they are.
CONTROL = (START, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")


def holds_control(text: Column) -> Column:
    out = F.lit(False)
    for s in CONTROL:
        out = out | F.contains(text, F.lit(s))
    return out


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(out, "(" + "|".join(f"(?<={re.escape(s[0])})(?={re.escape(s[1:])})" for s in CONTROL) + ")", r"\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(turns: Column, text) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), F.url_encode(t["role"]), F.lit("\n"), text(t["text"]), F.lit(END + "\n"))), "")


def parse(formatted: Column) -> Column:
    """array<struct<role, text, head, body>>: head and body are the characters before and inside the body. Null where the grammar is broken."""
    parts = F.filter(F.split(formatted, re.escape(START)), lambda p, i: (i > 0) | (p != ""))
    tail = len(END) + 1

    def turn(p: Column) -> Column:
        head = F.instr(p, "\n")
        body = F.substring(p, head + 1, F.length(p) - head - tail)
        well = (head > 0) & F.endswith(p, F.lit(END + "\n")) & (F.length(p) >= head + tail) & ~holds_control(body)
        return F.when(well, F.struct(F.try_url_decode(F.substring(p, F.lit(1), head - 1)).alias("role"), unescaped(body).alias("text"), (F.lit(len(START)) + head).cast("long").alias("head"), F.length(body).cast("long").alias("body")))

    return let(F.transform(parts, turn), lambda ts: F.when(F.forall(ts, lambda t: t.isNotNull()), ts))


def plain_turns(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def format_chats(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, parsed (turns read back), loss_runs: for each turn the characters outside (skip) and then under
    (take) the loss mask, which covers the bodies of assistant turns."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    source = rows.groupBy("conv_id").agg(plain_turns(F.sort_array(F.collect_list(turn))).alias("turns"))

    def tried(text) -> Column:
        return let(render(F.col("turns"), text), lambda s: F.struct(s.alias("formatted"), parse(s).alias("parsed")))

    same = lambda c: F.coalesce(plain_turns(F.col(f"{c}.parsed")) == F.col("turns"), F.lit(False))
    out = source.withColumn("raw", tried(lambda t: t))
    out = out.withColumn("made", F.when(same("raw"), F.col("raw")).otherwise(tried(escaped)))
    out = out.withColumn("made", F.when(same("made"), F.col("made")).otherwise(F.raise_error(F.lit("a conversation does not survive its round trip")).cast("struct<formatted:string,parsed:array<struct<role:string,text:string,head:bigint,body:bigint>>>")))
    taken = lambda t: F.when(t["role"] == "assistant", t["body"]).otherwise(F.lit(0).cast("long"))
    tail = len(END) + 1
    runs = F.transform(F.col("made.parsed"), lambda t: F.struct(t["head"].alias("skip"), taken(t).alias("take"), (t["body"] - taken(t) + tail).alias("rest")))
    return out.select("conv_id", "made.formatted", "made.parsed", runs.alias("loss_runs"))


def masked_text(formatted: Column, runs: Column) -> Column:
    """What lies under the loss mask, read from the formatted text turn by turn and unescaped."""
    parts = F.filter(F.split(formatted, re.escape(START)), lambda p, i: (i > 0) | (p != ""))
    return let(parts, lambda ps: F.array_join(F.transform(runs, lambda r, i: F.when(r["take"] > 0, unescaped(F.substring(F.get(ps, i), (r["skip"] - len(START) + 1).cast("int"), r["take"].cast("int")))).otherwise("")), ""))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-1).alias("conv_id"), F.lit(i).alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("x")).select("x.*")
    kinds = dict(rows.dtypes)
    rows = rows.unionByName(extra.select(*[F.col(c).cast(kinds[c]) for c in rows.columns]))
    made = format_chats(rows).withColumn("loss", masked_text(F.col("formatted"), F.col("loss_runs")))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "conv_id",
        F.size("parsed").cast("long").alias("n_turns"),
        digest(F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        digest(F.col("loss")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _oracle() -> str:
    """SQL of op6_chat. A text grows by its backslashes and control strings where its conversation needs escapes."""
    quoted = [s.replace("'", "''") for s in CONTROL]
    extra = " + ".join(["length(text) - length(replace(text, '\\', ''))", *[f"(length(text) - length(replace(text, '{s}', ''))) // {len(s)}" for s in quoted]])
    clash = " OR ".join(["contains(text, '\\')", *[f"contains(text, '{s}')" for s in quoted]])
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
d AS (SELECT *, bool_or({clash}) OVER (PARTITION BY conv_id) AS clash, {extra} AS extra FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(START)} + length(role) + 1 + length(text) + CASE WHEN clash THEN extra ELSE 0 END + {len(END) + 1})::BIGINT AS formatted_chars
FROM d GROUP BY conv_id
"""


ORACLE = _oracle()
