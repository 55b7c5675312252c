import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tradeloom.operators.workspace import workspace_filter
from tradeloom.sources.search import TAG_MARK, WorkspaceIndex, grams, wanted_terms

CARD = "dataset_id string, user_id string, display_name string, filename string, tags array<string>, archived boolean, trashed boolean, revenue double"
QUERIES = ["", "a", "Ab", "abc", "season 1", "ON 19", ".csv", "ütß", "😀 plan", "n😀", "key", "no such name", "x" * 50, "  Plan ", "ab ab"]


def made(n, seed=1):
    r = random.Random(seed)
    name = lambda: r.choice(["Season", "abc", "plan 😀 plan", "Ütße", "stock ab ab", "", "Ab", None, "x" * 60]) and f"{r.choice(['Season', 'Plan 😀', 'ÜTSS ütß'])} {r.randrange(1990, 1999)}"
    tags = lambda: r.choice([None, [], ["Key"], ["season", "KEY ab"], ["keys", None], ["abc", "plan 😀 plan"]])
    return [(f"d{i}", f"u{i % 3}", name(), f"{r.choice(['abc', 'stock_', 'q'])}{i}.csv", tags(), r.random() < 0.2, r.random() < 0.2, float(i)) for i in range(n)]


def ids(df):
    rows = [r.dataset_id for r in df.collect()]
    assert len(rows) == len(set(rows))
    return sorted(rows)


@pytest.fixture(scope="module")
def index(spark):
    index = WorkspaceIndex(spark, tempfile.mkdtemp(prefix="index-"), buckets=8)
    index.add(spark.createDataFrame(made(300), CARD))
    changed = [(*row[:2], "renamed abc 😀 plan", *row[3:]) for row in made(300)[10:30]] + [("new", "u1", "Season 19", "n.csv", ["key"], False, False, 0.0)]
    index.add(spark.createDataFrame(changed, CARD), spark.createDataFrame([(f"d{i}",) for i in range(40, 60)], "dataset_id string"))
    kept = {r[0]: r for r in made(300)} | {r[0]: r for r in changed}
    return index, spark.createDataFrame([r for k, r in kept.items() if k not in {f"d{i}" for i in range(40, 60)}], CARD)


@pytest.mark.parametrize("query", QUERIES)
def test_same_as_looking_at_all(index, query):
    searched, cards = index
    for view, tag in [("active", ""), ("all", "KEY"), ("trash", ""), ("archived", "plan 😀 plan")]:
        assert ids(searched.search(view, query, tag)) == ids(workspace_filter(cards, view, query, tag)), (view, tag)
    assert ids(searched.search("all", query, user="u1")) == ids(workspace_filter(cards.where("user_id = 'u1'"), "all", query))


def test_reads_in_proportion_to_hits(index):
    searched, cards = index
    only = next(r for r in cards.where("dataset_id = 'd77'").collect())
    query = only.filename
    met = searched.candidates(wanted_terms(query, ""))
    assert ids(met) == ["d77"]
    plan = searched.search("all", query)._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    lists = met._jdf.queryExecution().executedPlan().toString()
    assert "In(term" in lists.split("PushedFilters: [")[1] and "bucket" in lists.split("PartitionFilters: [")[1].split("]")[0]


def test_terms(spark):
    got = spark.createDataFrame([("a😀bç",), ("ab",), ("",), (None,)], "t string").select(grams(F.col("t")).alias("g")).collect()
    assert [r.g for r in got] == [["a😀b", "😀bç"], [], [], []]
    assert wanted_terms(" ABCD ", "Key") == sorted(["abc", "bcd", TAG_MARK + "key"]) and wanted_terms("ab", "") == []
    long = spark.range(1).select(F.size(grams(F.repeat(F.lit("é😀"), 100_000))).alias("n"))
    assert long.first().n == 199_998


def test_empty_and_unfinished(spark):
    index = WorkspaceIndex(spark, tempfile.mkdtemp(prefix="index-"), buckets=2)
    with pytest.raises(FileNotFoundError):
        index.search()
    index.add(spark.createDataFrame([], CARD))
    assert ids(index.search("all", "abc")) == [] and ids(index.search("all")) == []
    spark.createDataFrame([("abc", "u", "d", 0)], "term string, user_id string, dataset_id string, bucket int").write.partitionBy("bucket").parquet(f"{index.folder}/postings/v=1")
    index.add(spark.createDataFrame(made(5), CARD))
    assert index.versions() == [0, 1] and len(ids(index.search("all"))) == sum(not r[6] for r in made(5))
