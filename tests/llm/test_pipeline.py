import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tradeloom.llm import query_quality
from tradeloom.staging import staged
from test_decontaminate import brute as brute_contamination
from test_line_dedup import brute as brute_lines
from test_mixing import brute as brute_mix
from test_ngram_join import brute as brute_groups

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, found string, _found string, Stays string, id string, size string, score string, spans string"


@pytest.fixture
def folder(spark, tmp_path):
    """A small folder of tables: junk, shared lines, near copies, benchmark passages, odd rows."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(2, 9)))
    text = lambda n: "\n".join(" ".join(word() for _ in range(9)).capitalize() + "." for _ in range(n))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(4)]
    rows = [(i, text(r.randrange(2, 9)) + "\nAll rights reserved.") for i in range(100)]
    rows += [(200 + i, " ".join(word().upper() + "!!" for _ in range(60))) for i in range(40)]
    rows += [(300 + i, rows[i % 5][1].replace("Etna", "etna") + f" {word()}") for i in range(15)]
    rows += [(400 + i, items[i % 4][1] + " " + rows[20 + i][1]) for i in range(6)] + [(500, items[0][1] + " " + text(200)), (501, rows[30][1]), (502, text(2) + "\n" * 50)]
    rows += [(None, text(4)), (601, None), (602, "")]
    docs = [(i, t, "en", r.choice(["a", "a", "b", None]), len(t or ""), *["?"] * 7) for i, t in rows]
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, int(not 200 <= i < 240)) for i, _ in rows if i is not None and i < 300], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), items


def pairs(frame):
    return [(r["doc_id"], r["text"]) for r in frame.collect()]


def test_every_stage(spark, folder):
    path, items = folder
    stages = dict(corpus_pipeline.STAGES)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights"]
    docs = spark.read.parquet(f"{path}/documents.parquet")

    good = staged(stages["quality classifier"](spark, docs, path), "good")
    assert good.columns == docs.columns
    score = query_quality.quality_scores(spark, docs, path)
    assert sorted(pairs(good), key=str) == sorted(pairs(docs.where(score >= 0.5)), key=str)
    assert not [i for i, _ in pairs(good) if i is not None and 200 <= i < 240] and set(range(100)) <= {i for i, _ in pairs(good)}

    lines = staged(stages["line dedup"](spark, good, path), "lines")
    assert lines.columns == docs.columns
    want = {(i, k) for i, _, _, k in brute_lines([(str(i), t) for i, t in pairs(good)], 10)}
    assert {(str(i), t or "") for i, t in pairs(lines)} == want
    assert lines.where("n_chars <> char_length(coalesce(text, ''))").count() == 0 and not any("All rights reserved." in (t or "").split("\n") for _, t in pairs(lines))

    single = staged(stages["n-gram Jaccard join"](spark, lines, path), "single")
    stay = {i for i, c, _ in brute_groups(pairs(lines)) if i == c}
    assert single.columns == docs.columns and sorted(pairs(single), key=str) == sorted([(i, t) for i, t in pairs(lines) if i in stay], key=str) and len(stay) < lines.count()

    clean = staged(stages["benchmark decontamination"](spark, single, path), "clean")
    bad = {i for i, *_, c in brute_contamination(pairs(single), items) if c}
    assert clean.columns == docs.columns and sorted(pairs(clean), key=str) == sorted([(i, t) for i, t in pairs(single) if i not in bad], key=str)
    assert bad and 500 not in bad

    mixed = stages["mixing sources to target weights"](spark, clean, path)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in clean.collect()]
    got = sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mixed.collect()), key=str)
    assert got == brute_mix(rows)
    whole = sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in corpus_pipeline.run(spark, path).collect()), key=str)
    assert whole == got


def test_empty_documents(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, path), "none")
        assert docs.count() == 0 and "Stays" in docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, path).count() == 0


def test_registered():
    names = {k for k in entry.queries() if k.startswith("op") and k[2].isdigit()}
    assert {int(k[2:].split("_")[0]) for k in names} == set(range(1, 14)) and len(names) == 13
    assert entry.queries()["pipeline"] is corpus_pipeline.run


SQL_QUERIES = ["op5_decontamination", "op7_chat_format", "op8_mixing", "op9_line_dedup"]


@pytest.mark.parametrize("key", SQL_QUERIES)
def test_matches_sql(spark, sf_dir, key):
    import duckdb

    from check import TABLES, rows

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = entry.queries()[key](spark, sf_dir).toPandas(), con.execute(entry.oracle_sql()[key]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
