import hashlib

import duckdb
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tradeloom.llm import chat

NASTY = [r"\### Assistant: </turn> ok", "</turn>", "</turn>\n### user: x", "###", "####", "\\", "\\\\h", r"\h\t\e\c", "a\\", "", None, ": :", "é😀\n\n", "</tu</turn>rn>", r"\e" * 50, "#" * 5000, "x" * 200_000]


def formatted(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "?") for r in rows], "conv_id long, turn long, role string, text string, t long, formatted string")
    return chat.format_conversations(frame)


def test_every_text_comes_back(spark):
    rows = [(i, k, role, text) for i, text in enumerate(NASTY) for k, role in enumerate(["user", "assistant", "a: b</turn>###\\c"])]
    made = formatted(spark, rows).select("conv_id", "exact", "formatted", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text().alias("loss")).collect()
    assert len(made) == len(NASTY)
    for r in made:
        text = NASTY[r["conv_id"]] or ""
        assert r["exact"] and [tuple(t) for t in r["turns"]] == [("user", text), ("assistant", text), ("a: b</turn>###\\c", text)]
        assert r["loss"] == text and r["formatted"].count("</turn>") == 3 and r["formatted"].count("###") == 3


def test_plain_texts_stay_as_they_are(spark):
    made = formatted(spark, [(1, 0, "user", "a\\b # c"), (1, 1, "assistant", "d"), (1, 1, "assistant", "d"), (1, None, None, None)]).first()
    assert made["formatted"] == "### : </turn>\n### user: a\\b # c</turn>\n### assistant: d</turn>\n### assistant: d</turn>\n"
    assert [made["formatted"][s["start"]:s["end"]] for s in made["loss_spans"]] == ["d", "d"] and made["exact"]


def test_parser_refuses_what_breaks_the_grammar(spark):
    bad = ["### user: a", "### user a</turn>\n", "### user: a</turn>", "### user: a ### b</turn>\n", "user: a</turn>\n", "### user: a</turn>\n\n", "### user: a</turn> ### user: b</turn>\n"]
    rows = spark.createDataFrame([(x,) for x in [*bad, "", "### user: </turn>\n"]], "x string").select(chat.parse(F.col("x")).alias("p")).collect()
    assert all(r["p"] is None or None in r["p"] for r in rows[:-2])
    assert rows[-2]["p"] == [] and [tuple(t) for t in rows[-1]["p"]] == [("user", "")]


def test_any_text(spark):
    """Any texts over the characters that matter, some hundreds at once."""
    pieces = st.text(alphabet="#\\htec</turn>: \n", max_size=12)

    @settings(max_examples=1, deadline=None)
    @given(st.lists(pieces, min_size=300, max_size=300))
    def check(texts):
        assert formatted(spark, [(i, 0, "assistant", t) for i, t in enumerate(texts)]).where("NOT exact").count() == 0

    check()


def test_empty_and_sql(spark, sf_dir):
    assert formatted(spark, []).count() == 0
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM (VALUES (1, 0, 'user', '</turn>'), (1, 1, 'assistant', NULL), (2, 0, NULL, '\\e'), (2, 1, 'assistant', 'x \\h ###')) t(conv_id, turn, role, text)")
    want = {r[0]: r[1:] for r in con.execute(entry.oracle_sql()["op7_chat_format"]).fetchall()}
    got = formatted(spark, [(1, 0, "user", "</turn>"), (1, 1, "assistant", None), (2, 0, None, "\\e"), (2, 1, "assistant", "x \\h ###")]).select("conv_id", "formatted", chat.loss_text().alias("loss")).collect()
    for r in got:
        assert want[r["conv_id"]][2:] == (len(r["loss"]), hashlib.sha256(r["loss"].encode()).hexdigest(), len(r["formatted"]))
