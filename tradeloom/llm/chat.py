r"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar: a conversation is a sequence of turns, ``### role: text</turn>`` and a line feed. The
control strings are ``###`` and ``</turn>``; ``\h``, ``\t``, ``\e`` and, in roles, ``\c`` stand
for ``###``, ``</turn>``, a backslash and a colon.

Each turn is rendered as it is, parsed again and compared with its source; if they differ, its
control strings are escaped, and if they still differ, its backslashes too. ``parse`` is the
only reader: it refuses a control string inside a text, so no text can be taken for markup, and
doubling backslashes makes the last form reversible for every text. The whole conversation is
then parsed once more and compared (``exact``), and ``loss_spans`` mark the assistant's texts
in the rendered string.

Defined results: null texts and roles are empty; turns are ordered by turn, then role and text,
a null turn first; repeated rows stay repeated turns; a null conv_id is a conversation of its
own; an empty table gives no conversations; other columns are not read. A conversation is one
training example and becomes one string, so it must fit into a cell (2 GB) like any text does;
nothing else is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tradeloom.llm.common import text_of

OPEN, CLOSE, LOSS_ROLE = "###", "</turn>", "assistant"


def swapped(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escaped(text: Column, backslashes: bool) -> Column:
    return swapped(text, [("\\", "\\e")] * backslashes + [(OPEN, "\\h"), (CLOSE, "\\t")])


def unescaped(text: Column) -> Column:
    return swapped(text, [("\\h", OPEN), ("\\t", CLOSE), ("\\e", "\\")])


def rendered(role: Column, body: Column) -> Column:
    """One turn; ``body`` is already escaped."""
    return F.concat(F.lit(f"{OPEN} "), swapped(escaped(role, True), [(":", "\\c")]), F.lit(": "), body, F.lit(f"{CLOSE}\n"))


def parse(rendering: Column) -> Column:
    """array<struct<role,text>> read back from a rendering; a turn that breaks the grammar is null."""
    pieces = F.split(rendering, CLOSE, -1)
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column, i: Column) -> Column:
        own = F.when(i > 0, F.substr(piece, F.lit(2))).otherwise(piece)
        sound = F.when(i > 0, F.startswith(piece, F.lit("\n"))).otherwise(F.lit(True))
        colon = F.instr(own, ": ")
        role, body = F.substr(own, F.lit(5), colon - 5), F.substr(own, colon + 2)
        sound = sound & F.startswith(own, F.lit(f"{OPEN} ")) & (colon > 0) & ~F.contains(body, F.lit(OPEN))
        # The colon's mark is undone first: an escaped backslash has its own letter behind it.
        return F.when(sound, F.struct(unescaped(swapped(role, [("\\c", ":")])).alias("role"), unescaped(body).alias("text")))

    read = F.transform(turns, turn)
    return F.when(F.element_at(pieces, -1) == F.when(F.size(pieces) > 1, "\n").otherwise(""), read)


def format_turns(turns: DataFrame, role_col: str = "role", text_col: str = "text") -> tuple[Column, Column, Column]:
    """(role, text, body): body is the least escaped form of the text that is read back whole."""
    role, text = text_of(role_col), text_of(text_col)
    source = F.array(F.struct(role.alias("role"), text.alias("text")))
    whole = lambda body: F.coalesce(parse(rendered(role, body)) == source, F.lit(False))
    light = escaped(text, False)
    return role, text, F.when(whole(text), text).when(whole(light), light).otherwise(escaped(text, True))


def format_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, loss_spans, exact): spans are code points, end exclusive."""
    role, text, body = format_turns(turns, role_col, text_col)
    rows = turns.select(F.col(id_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), body.alias("body")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: rendered(t["role"], t["body"])), "")

    def step(state: Column, t: Column) -> Column:
        size = F.char_length(rendered(t["role"], t["body"])).cast("long")
        end = state["at"] + size - len(CLOSE) - 1
        span = F.array(F.struct((end - F.char_length(t["body"])).alias("start"), end.alias("end")))
        return F.struct((state["at"] + size).alias("at"), F.when(t["role"] == LOSS_ROLE, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    made = whole.withColumn("formatted", formatted).withColumn("loss_spans", F.aggregate("turns", none, step, lambda s: s["spans"]))
    return made.select("conv_id", "formatted", "loss_spans", F.coalesce(parse(F.col("formatted")) == source, F.lit(False)).alias("exact"))


def loss_text(formatted: str = "formatted", spans: str = "loss_spans") -> Column:
    """All text under the mask, read from the rendering and unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substr(F.col(formatted), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
