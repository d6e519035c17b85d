"""Chat formatting, in DataFrame functions only.

A template declares the text around each role's turns and whether its texts bear loss; a
finite-state machine, declared as a table, checks the order of roles. A conversation
becomes a list of segments with a loss flag each, and their texts in a row are the
formatted conversation. Control strings inside texts are escaped by a backslash after
their first character (one more where there are some already), so every control string
left is the template's, and the conversation can be read back.

Edge cases: null texts and roles are empty strings; a role that the template does not
name is spelled out and bears no loss, and makes the conversation invalid; turns are
ordered by number, role and text, a null number first; a null conversation id is an id;
equal rows are turns of their own; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    begin: str
    end: str
    loss: bool = False


#: The template: what stands around the turns of each role. Each turn ends with END_OF_TURN.
END_OF_TURN = "</s>"
TEMPLATE = {
    "system": Turn("<s>[SYS]", "[/SYS]</s>"),
    "user": Turn("<s>[INST]", "[/INST]</s>"),
    "assistant": Turn("<s>[OUT]", "</s>", loss=True),
}
#: Around the name of any other role, before its text.
OTHER = Turn("<s>[ROLE]", "[/ROLE]")
#: From a state, a role leads to a state; whatever is not listed is an error. Conversations end in an accepting state.
TRANSITIONS = {("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"}
ACCEPTING = ("assistant",)

#: A control string is <s> or </s> or one of these names in brackets.
_REST = r"/?(?:s>|SYS\]|INST\]|OUT\]|ROLE\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({_REST})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({_REST})", "$1$2$3")


def _by_role(role: Column, pick, other: Column) -> Column:
    out = None
    for name, turn in TEMPLATE.items():
        out = F.when(role == name, pick(turn)) if out is None else out.when(role == name, pick(turn))
    return out.otherwise(other)


def segments(turns: Column) -> Column:
    """The segments (text, loss) of an array of turns (role, text)."""

    def of(t: Column) -> Column:
        begin = _by_role(t["role"], lambda x: F.lit(x.begin), F.concat(F.lit(OTHER.begin), escape(t["role"]), F.lit(OTHER.end)))
        end = _by_role(t["role"], lambda x: F.lit(x.end), F.lit(END_OF_TURN))
        loss = _by_role(t["role"], lambda x: F.lit(x.loss), F.lit(False))
        return F.array(*[F.struct(x.alias("text"), y.alias("loss")) for x, y in ((begin, F.lit(False)), (escape(t["text"]), loss), (end, F.lit(False)))])

    return F.flatten(F.transform(turns, of))


def walk(turns: Column) -> Column:
    """(state, bad): the state after all turns, and the place of the first turn out of order (-1: none)."""
    table = F.create_map(*[F.lit(x) for (state, role), to in TRANSITIONS.items() for x in (f"{state}>{role}", to)])
    start = F.struct(F.lit("start").alias("state"), F.lit(-1).alias("bad"), F.lit(0).alias("at"))

    def step(acc: Column, t: Column) -> Column:
        to = F.coalesce(F.try_element_at(table, F.concat(acc["state"], F.lit(">"), t["role"])), F.lit("error"))
        return F.struct(to.alias("state"), F.when((to == "error") & (acc["bad"] < 0), acc["at"]).otherwise(acc["bad"]).alias("bad"), (acc["at"] + 1).alias("at"))

    return F.aggregate(turns, start, step)


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    pieces = F.filter(F.split(formatted, END_OF_TURN, -1), lambda p: p != "")

    def of(p: Column) -> Column:
        out = None
        for name, turn in TEMPLATE.items():
            tail = len(turn.end) - len(END_OF_TURN)
            body = F.substring(p, F.lit(len(turn.begin) + 1), F.length(p) - len(turn.begin) - tail)
            value = F.struct(F.lit(name).alias("role"), unescape(body).alias("text"))
            out = F.when(p.startswith(turn.begin), value) if out is None else out.when(p.startswith(turn.begin), value)
        stop = F.instr(p, OTHER.end)
        role = F.substring(p, F.lit(len(OTHER.begin) + 1), stop - 1 - len(OTHER.begin))
        body = F.substring(p, stop + len(OTHER.end), F.length(p))
        return out.otherwise(F.struct(unescape(role).alias("role"), unescape(body).alias("text")))

    return F.transform(pieces, of)


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, segments, formatted, valid and first_bad (place of the first turn out of order, or null)."""
    turn = F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = rows.select(F.col(conv_col).alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    out = out.select("conv_id", segments(F.col("turns")).alias("segments"), walk(F.col("turns")).alias("w"))
    return out.select("conv_id", "segments", F.concat_ws("", "segments.text").alias("formatted"), (F.col("w.bad") < 0).alias("ordered"), F.col("w.state").isin(*ACCEPTING).alias("ended"), F.when(F.col("w.bad") >= 0, F.col("w.bad")).alias("first_bad")).withColumn("valid", F.col("ordered") & F.col("ended")).drop("ordered", "ended")


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations."""
    out = formatted.select("conv_id", "formatted", "valid", "first_bad", read_back(F.col("formatted")).alias("turns"), F.concat_ws("", F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))).alias("loss_text"))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))), "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss_text", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "first_bad",
    )


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts are made of control strings."""
    return spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))


_LENGTHS = "CASE role " + " ".join(f"WHEN '{k}' THEN {len(t.begin) + len(t.end)}" for k, t in TEMPLATE.items()) + f" ELSE {len(OTHER.begin) + len(OTHER.end) + len(END_OF_TURN)} + length(regexp_replace(role, '([<\\[])(\\\\*)({_REST})', '\\1\\\\\\2\\3', 'g')) END"
_STEP = "CASE acc || '>' || x " + " ".join(f"WHEN '{a}>{r}' THEN '{b}'" for (a, r), b in TRANSITIONS.items()) + " ELSE 'error' END"

#: What the query returns, for DuckDB.
SQL = f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (SELECT *, {_LENGTHS} + length(regexp_replace(text, '([<\\[])(\\\\*)({_REST})', '\\1\\\\\\2\\3', 'g')) AS chars FROM r),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, sum(chars)::BIGINT AS formatted_chars,
  list(role ORDER BY turn, role, text) AS roles FROM s GROUP BY conv_id),
w AS (SELECT *, list_transform(range(1, len(roles) + 1), lambda i: list_reduce(list_prepend('start', roles[1:i]), lambda acc, x: {_STEP})) AS states FROM g)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars,
  list_position(states, 'error') IS NULL AND states[-1] = 'assistant' AS valid, (list_position(states, 'error') - 1)::INT AS first_bad FROM w
"""
