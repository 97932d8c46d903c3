"""Chat formatting with a grammar round trip.

A conversation becomes one text of marked turns.  The rendered text is parsed again
by a deterministic grammar and the recovered turns are compared with the source.
Turns that do not come back are rendered anew with their control characters
escaped; if the whole still differs, all turns are.  Escaped content never holds a
closing mark, so the last form always comes back.

Everything is a built-in expression.  A conversation is one text and so one row:
its turns are gathered by design, other conversations are independent of it.
Turns are ordered by turn, then role and text; null roles and texts are empty, and
rows with a null conversation id form one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from measurelens.llm.texts import name_of

# fixed values: the marks of the template
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>"), "system": ("<<SYS>> ", " <</SYS>>")}
OTHER = ("[ROLE] ", " [/ROLE] ", " [END]")  # around the name and the text of any other role
TURN = r"(?s)\[INST\] .*? \[/INST\]|<s> .*? </s>|<<SYS>> .*? <</SYS>>|\[ROLE\] .*? \[/ROLE\] .*? \[END\]"
CONTROL = r"([\\\[<])"  # every mark has one of these after its space
TURNS = "array<struct<role:string,text:string>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\" + CONTROL, "$1")


def opening(role: Column, name: Column) -> Column:
    out = F.concat(F.lit(OTHER[0]), name, F.lit(OTHER[1]))
    for known, (mark, _) in MARKS.items():
        out = F.when(role == known, F.lit(mark)).otherwise(out)
    return out


def closing(role: Column) -> Column:
    out = F.lit(OTHER[2])
    for known, (_, mark) in MARKS.items():
        out = F.when(role == known, F.lit(mark)).otherwise(out)
    return out


def render_turn(role: Column, text: Column, escaped: bool) -> Column:
    """struct<open, body, close> of a turn."""
    change = escape if escaped else (lambda c: c)
    return F.struct(opening(role, change(role)).alias("open"), change(text).alias("body"), closing(role).alias("close"))


def joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(t["open"], t["body"], t["close"])), "")


def parse(rendered: Column) -> Column:
    """The turns of a rendered text: array<struct<role, text>>; null if it is not a sequence of turns."""
    parts = F.regexp_extract_all(rendered, F.lit(TURN), F.lit(0))

    def inner(part, before, after):
        return unescape(F.substring(part, before + 1, F.length(part) - before - after))

    def turn(part):
        name = F.regexp_extract(part, r"(?s)^\[ROLE\] (.*?) \[/ROLE\] ", 1)
        head = F.length(name) + len(OTHER[0]) + len(OTHER[1])
        out = F.struct(unescape(name).alias("role"), inner(part, head, len(OTHER[2])).alias("text"))
        for known, (mark, end) in MARKS.items():
            out = F.when(part.startswith(mark), F.struct(F.lit(known).alias("role"), inner(part, F.lit(len(mark)), len(end)).alias("text"))).otherwise(out)
        return out

    return F.when(F.array_join(parts, "") == rendered, F.transform(parts, turn))


def format_conversations(rows: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: its id, ``formatted`` and ``loss_spans`` (code points, end exclusive).

    The spans hold the assistant's texts as rendered; ``read_back`` undoes the escapes.
    """
    empty = lambda c: F.coalesce(name_of(c).cast("string"), F.lit(""))
    one = F.struct(name_of(turn).alias("turn"), empty(role).alias("role"), empty(text).alias("text"))
    grouped = rows.groupBy(name_of(conv_id).alias(conv_id)).agg(F.sort_array(F.collect_list(one)).alias("_rows"))
    source = grouped.select(conv_id, F.transform("_rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("_source"))

    def alone(t):
        """Whether a turn by itself comes back as it was."""
        plain = render_turn(t["role"], t["text"], False)
        return F.coalesce(parse(F.concat(plain["open"], plain["body"], plain["close"])) == F.array(F.struct(t["role"].alias("role"), t["text"].alias("text"))), F.lit(False))

    tries = [
        F.transform("_source", lambda t: render_turn(t["role"], t["text"], False)),
        F.transform("_source", lambda t: F.when(alone(t), render_turn(t["role"], t["text"], False)).otherwise(render_turn(t["role"], t["text"], True))),
        F.transform("_source", lambda t: render_turn(t["role"], t["text"], True)),
    ]
    chosen = tries[2]
    for attempt in (tries[1], tries[0]):
        chosen = F.when(F.coalesce(parse(joined(attempt)) == F.col("_source"), F.lit(False)), attempt).otherwise(chosen)
    done = source.select(conv_id, F.transform("_source", lambda t: t["role"]).alias("_roles"), chosen.alias("_turns"))

    def step(acc, p):
        start = acc["at"] + F.length(p["turn"]["open"])
        end = start + F.length(p["turn"]["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + F.length(p["turn"]["close"])).alias("at"), F.when(p["role"] == "assistant", F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    spans = F.aggregate(F.arrays_zip(F.col("_roles").alias("role"), F.col("_turns").alias("turn")), begin, step, lambda acc: acc["out"])
    return done.select(conv_id, joined(F.col("_turns")).alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Add ``turns`` (parsed) and ``loss_texts`` (unescaped texts under the loss mask, in order)."""
    under = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return formatted.withColumns({"turns": parse(F.col("formatted")), "loss_texts": under})


PROBE = "</s>[INST] ok [/INST]"


def op9(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    back = read_back(format_conversations(rows.unionByName(probe)))
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), m AS (
  SELECT *, CASE role WHEN 'user' THEN '[INST] ' WHEN 'assistant' THEN '<s> ' WHEN 'system' THEN '<<SYS>> ' ELSE '[ROLE] ' || role || ' [/ROLE] ' END AS o,
    CASE role WHEN 'user' THEN ' [/INST]' WHEN 'assistant' THEN ' </s>' WHEN 'system' THEN ' <</SYS>>' ELSE ' [END]' END AS c
  FROM t
), e AS (
  SELECT *, length(o) + length(c) + CASE WHEN strpos(text || c, c) <= length(text) OR regexp_matches(text, '\\[\\\[<]')
    THEN length(regexp_replace(text, '([\\\[<])', '\\\1', 'g')) ELSE length(text) END AS shown
  FROM m
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(shown)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
