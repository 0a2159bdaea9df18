"""Chat formatting with a grammar round trip, in built-in functions alone.

A turn is written `<|im_start|>` role, line end, text, `<|im_end|>`, line end. The parser cuts at `<|im_start|>`, takes
the role up to the first line end and the text up to the first `<|im_end|>`. What stands after that mark, a mark that is
missing and any other `<|` are conflicts. A conversation is first written as it stands and parsed; where there is a
conflict, or what comes back differs from the source, its texts are escaped: `<` and `|`, with any number of backslashes
between them, get one backslash more. The parser takes one backslash back from each such place, so that the escaped
form always comes back as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role(role: Column) -> Column:
    """A role on one line: % and line ends are written as %25 and %0A."""
    return F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _unrole(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def render(turns: Column, escaped: bool) -> Column:
    """One string of an array of (role, text)."""

    def one(turn: Column) -> Column:
        role, text = _role(turn["role"]), turn["text"]
        if escaped:
            role, text = escape(role), escape(text)
        return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END))

    return F.array_join(F.transform(turns, one), "")


def bodies(rendered: Column) -> Column:
    """What stands after each start mark."""
    parts = F.split(rendered, r"<\|im_start\|>", -1)
    return F.slice(parts, F.lit(2), F.size(parts))


def parse(rendered: Column) -> Column:
    """The turns of a rendered conversation, as an array of (role, text); a turn that breaks the grammar is two nulls."""

    def one(body: Column) -> Column:
        inner = F.substring(body, F.lit(1), F.length(body) - F.lit(len(END)))
        role = F.substring_index(inner, "\n", 1)
        text = F.substring(inner, F.length(role) + F.lit(2), F.length(inner))
        sound = body.endswith(END) & inner.contains("\n") & ~inner.contains("<|")
        return F.struct(F.when(sound, _unrole(unescape(role))).alias("role"), F.when(sound, unescape(text)).alias("text"))

    return F.transform(bodies(rendered), one)


def loss_spans(rendered: Column, role: str = "assistant") -> Column:
    """Where the texts of a role's turns begin and end (exclusive) in the rendered string, in code points."""

    def add(state: Column, body: Column) -> Column:
        head = F.substring_index(body, "\n", 1)
        begin = state["at"] + F.lit(len(START)) + F.length(head) + F.lit(1)
        end = state["at"] + F.lit(len(START)) + F.length(body)
        span = F.array(F.struct(begin.alias("begin"), (end - F.lit(len(END))).alias("end")))
        mine = _unrole(unescape(head)) == role
        return F.struct(end.alias("at"), F.when(mine, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    none = F.array().cast("array<struct<begin:int,end:int>>")
    return F.aggregate(bodies(rendered), F.struct(F.lit(0).alias("at"), none.alias("spans")), add)["spans"]


def format_chats(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, turns, loss_spans: one row per conversation of conv_id, turn, role, text.

    turns are those that the parser reads from `formatted`. Turns are in order of turn; rows of the same turn are all
    kept, in order of role and text. Null roles and texts count as empty, a null turn comes first, and rows of a null
    conv_id form one conversation. An empty table gives an empty one; other columns are ignored.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col("turn"), text("role").alias("role"), text("text").alias("text"))
    source = F.transform(F.sort_array(F.collect_list(turn)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    chats = rows.groupBy("conv_id").agg(source.alias("source"))
    plain = chats.withColumn("plain", render(F.col("source"), False))
    fits = parse(F.col("plain")).eqNullSafe(F.col("source"))
    done = plain.select("conv_id", F.when(fits, F.col("plain")).otherwise(render(F.col("source"), True)).alias("formatted"))
    return done.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), loss_spans(F.col("formatted")).alias("loss_spans"))
