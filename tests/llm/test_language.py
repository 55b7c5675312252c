import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tradeloom.llm import language, query_language


def words(text):
    return "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()


def pieces(word, n):
    whole = word if n == 1 else f" {word} "
    return [whole[i:i + n] for i in range(len(whole) - n + 1)]


def brute(rows, learn):
    """lang_pred and score of every (id, text, lang), from plain dictionaries."""
    counts, docs = defaultdict(Counter), Counter()
    for i, text, lang in rows:
        if learn(i) and lang is not None and text is not None:
            docs[lang] += 1
            counts[lang].update(words(text))
    langs = sorted(docs)
    tables = {0: counts}
    for n in range(1, 5):
        tables[n] = {lang: Counter() for lang in langs}
        for lang in langs:
            for w, k in counts[lang].items():
                for g in pieces(w, n):
                    tables[n][lang][g] += k
    total = {n: {lang: sum(t[lang].values()) for lang in langs} for n, t in tables.items()}

    def logs(n, item):
        if not any(item in tables[n][lang] for lang in langs):
            return None
        least = math.log(0.1 / max(total[n].values()))
        return [math.log(tables[n][lang][item] / total[n][lang]) if tables[n][lang][item] else least for lang in langs]

    def scored(word):
        if (found := logs(0, word)) is not None:
            return found
        for n in (4, 3, 2, 1):
            if met := [x for x in (logs(n, g) for g in pieces(word, n)) if x is not None]:
                return [sum(c) / len(met) for c in zip(*met)]
        return [0.0] * len(langs)

    out = []
    for i, text, _ in rows:
        if not langs or not any(c.isalpha() for c in text or ""):
            out.append((i, "und", 0.0))
            continue
        sums = [sum(c) + math.log(docs[lang] / sum(docs.values())) for lang, c in zip(langs, zip(*map(scored, words(text))))]
        best = max(sums)
        out.append((i, langs[sums.index(best)], 1 / sum(math.exp(s - best) for s in sums)))
    return sorted(out, key=lambda x: (x[0] is None, x[0] or 0))


def invented(n, seed=3):
    r = random.Random(seed)
    stock = {"xx": ["lorem", "ipsum", "dolor", "sit", "é"], "yy": ["foo", "barbar", "ipsum", "quux", "zut"], "zz": ["дом", "мир", "вода"]}
    syllables = {"xx": ["lo", "ri", "um"], "yy": ["ba", "qu", "zo"], "zz": ["ми", "ро", "да"]}
    rows = []
    for i in range(n):
        lang = r.choice(list(stock))
        made = [r.choice(stock[lang]) if r.random() < 0.4 else "".join(r.choice(syllables[lang]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 9))]
        rows.append((i, " ".join(made) + r.choice(["", ".", " 12", " X²Y"]), lang if r.random() < 0.9 else None))
    return rows


def learns(i):
    return zlib.crc32(str(i).encode()) % 3 != 1


def run(spark, rows, **kw):
    docs = spark.createDataFrame([(*r, "?", 1, "?") for r in rows], "doc_id long, text string, lang string, word string, n long, scores string")
    model = language.train(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    return sorted(((r["doc_id"], r["lang_pred"], r["score"]) for r in language.predict(docs, model, **kw).collect()), key=lambda x: (x[0] is None, x[0] or 0))


@pytest.mark.parametrize("max_hot", [250_000, 25, 0])
def test_against_brute_force(spark, max_hot):
    rows = [*invented(120), (500, None, "xx"), (501, "", "yy"), (502, "123 ²½ -_!", "zz"), (503, "漢字 kana", None), (504, "漢字", None), (505, "lorem " * 30_000, None),
            (506, "LOREM Ipsum", "yy"), (506, "LOREM Ipsum", "yy"), (507, "İstanbul ΣΑΣ", "zz"), (None, "foo zut", "yy")]
    got, want = run(spark, rows, max_hot=max_hot), brute(rows, lambda i: i is not None and learns(i))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[2] - w[2]) < 1e-9 for g, w in zip(got, want))


def test_nothing_to_learn(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, "foo", None), (2, "bar", None)]) == [(1, "und", 0.0), (2, "und", 0.0)]
    learnt, held = next(i for i in range(9) if learns(i)), next(i for i in range(9) if not learns(i))
    assert [g[1] for g in run(spark, [(learnt, "foo", "yy"), (held, "foo", "xx")])] == ["yy", "yy"]


def test_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    got = query_language.op12_language(spark, sf_dir)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    right = got.where("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right >= 0.97
