"""Language identification, words first, then shorter and shorter character n-grams.

A word is a run of letters, lower-cased. In the learning documents Spark counts every word for
each language, and from the words all their n-grams of ``longest`` to 1 characters, the word set
between two spaces. A word known to any language gives each language the logarithm of the word's
relative frequency there, or a penalty where the language lacks it. An unseen word is scored by its
n-grams of the greatest length of which any is known: the mean over the known ones, each scored like a
word. The language with the greatest sum over a text's words and the logarithm of its share of the
learning documents wins (ties: the first by name); the score is its posterior probability.

One pass over all documents counts their words, learnt from or not, and each distinct word is
scored once: the unseen ones meet the n-gram tables in joins. The words of the corpus are of any
number. The most frequent ones (``max_hot``, a bounded table) go to all tasks, which score texts
with them and keep the other words with the text; those few are joined with their scores
by a shuffle in which no word is frequent. No count is cut off, and what is kept grows with the corpus.

Defined results: a text that is null, empty or without a letter is ``und`` with score 0, and so is
every text if nothing can be learnt; documents with a null text or language teach nothing; words of which no
n-gram is known say nothing; rows are judged by themselves, repeated ones alike, and count
repeatedly; texts of any length are read whole; an empty table gives an empty result; further
columns are not read. One number a language is held by the driver and one column a language in each plan.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tradeloom.llm.common import heaviest, in_parts, list_array, looked_up
from tradeloom.staging import staged

UNKNOWN = "und"
LONGEST = 4
#: What a language without a word loses on one that holds it once: a tenth of the rarest frequency.
PENALTY = float(np.log(0.1))
_RUN = re.compile(r"[^\W\d_]+")
_READ = "_letters boolean, _sums array<double>, _rest array<struct<word:string,n:bigint>>"
_COUNTED = "lang string, word string, n long"


def words_in(text: str) -> list[str]:
    """Runs of letters; digits and numbers of any script divide them."""
    found = _RUN.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return "".join(c if c.isalpha() else " " for c in text.lower()).split()


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of (text, lang); a null language is counted too. Counts of a part of a task
    are added up before they are shuffled."""
    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, Counter] = {}
        def flush() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                words = list(counts)
                for a in range(0, len(words), 50_000):
                    part = words[a:a + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part, pa.string()), pa.array([counts[w] for w in part], pa.int64())], ["lang", "word", "n"])
            held.clear()

        for batch in batches:
            langs = batch.column(1).to_pylist()
            for at, raws in in_parts(batch.column(0)):
                for lang, raw in zip(langs[at:at + len(raws)], raws):
                    held.setdefault(lang, Counter()).update(words_in(raw.decode()))
                if sum(map(len, held.values())) > 300_000:
                    yield from flush()
        yield from flush()

    return docs.select("text", "lang").mapInArrow(per_task, _COUNTED).groupBy("lang", "word").agg(F.sum("n").alias("n"))


def grams(word: Column, longest: int) -> Column:
    """The n-grams of a word between two spaces, for every n up to ``longest``; single characters are
    the word's own. A gram's length tells its n."""
    between = F.concat(F.lit(" "), word, F.lit(" "))
    pieces = lambda text, n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.concat(pieces(word, 1), *[pieces(between, n) for n in range(2, longest + 1)])


def by_language(counts: DataFrame, key: str, order: Column, langs: list[str]) -> DataFrame:
    """(key, scores) of the staged (key, lang, n): one row a key, a logarithm for each language.
    Frequencies are relative to all counts of the same ``order``."""
    totals = {(r["k"], r["lang"]): r["n"] for r in counts.groupBy(order.alias("k"), "lang").agg(F.sum("n").alias("n")).collect()}
    most = {k: max(n for (j, _), n in totals.items() if j == k) for k, _ in totals}
    chosen = lambda values: F.coalesce(*[F.when(order == k, F.lit(float(v))) for k, v in values.items()], F.lit(None).cast("double"))
    floor = chosen({k: PENALTY - np.log(n) for k, n in most.items()})
    score = lambda lang: F.coalesce(F.log(F.sum(F.when(F.col("lang") == lang, F.col("n")))) - chosen({k: np.log(totals.get((k, lang), 1)) for k in most}), floor)
    return counts.groupBy(key).agg(F.array(*[score(lang) for lang in langs]).alias("scores"))


class Model:
    """Languages, what is known of each corpus word, and the table of the most frequent ones."""

    def __init__(self, langs: list[str], priors: np.ndarray, lexicon: DataFrame):
        self.langs, self.priors, self.lexicon = langs, priors, lexicon


def back_off(unseen: DataFrame, learnt: DataFrame, langs: list[str], longest: int) -> DataFrame:
    """(word, scores) of the words of (word), each by its longest known n-grams; (lang, word, n) were learnt."""
    table = learnt.select("lang", F.explode(grams(F.col("word"), longest)).alias("gram"), "n").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = by_language(staged(table, "grams"), "gram", F.length("gram"), langs)
    asked = staged(unseen.select("word", F.explode(grams(F.col("word"), longest)).alias("gram")), "grams-asked")
    known = staged(table.join(asked.groupBy("gram").agg(F.count("*").alias("asked")), "gram"), "grams-known")
    met = looked_up(asked, known, "gram", "asked").where("scores IS NOT NULL")
    mean = F.array(*[F.avg(F.get("scores", F.lit(i))) for i in range(len(langs))])
    return met.groupBy("word", F.length("gram").alias("k")).agg(mean.alias("scores")).groupBy("word").agg(F.max_by("scores", "k").alias("scores"))


def train(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST) -> Model:
    """Scores of all words of ``docs``, learnt from the rows where ``learn`` holds."""
    lang = F.when(F.coalesce(learn, F.lit(False)) & F.col(text_col).isNotNull(), F.col(lang_col).cast("string"))
    rows = docs.select(F.col(text_col).cast("string").alias("text"), lang.alias("lang"))
    shares = {r["lang"]: r["n"] for r in rows.where("lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(shares, key=str.encode)
    priors = np.log(np.array([shares[lang] for lang in langs], dtype=float) / max(1, sum(shares.values())))
    counts = staged(count_words(rows), "word-counts")
    learnt = counts.where("lang IS NOT NULL")
    weights = staged(counts.groupBy("word").agg(F.sum("n").alias("weight"), F.count("lang").alias("n_langs")), "word-weights")
    known = by_language(learnt, "word", F.lit(0), langs)
    every = known.unionByName(back_off(weights.where("n_langs = 0").select("word"), learnt, langs, longest)) if langs else known
    return Model(langs, priors, staged(weights.drop("n_langs").join(every, "word"), "lexicon"))


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), max_hot: int = 250_000) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``lang_pred`` and ``score``."""
    n = len(model.langs)
    hot, rest = heaviest(model.lexicon, "weight", max_hot)
    table = hot.select("word", "scores").toPandas() if hot else {"word": [], "scores": []}
    scores = np.stack(list(table["scores"])).astype(np.float64) if len(table["word"]) else np.zeros((0, n))
    sent = docs.sparkSession.sparkContext.broadcast(({w: i for i, w in enumerate(table["word"])}, scores))
    rows = docs.select(F.col(text_col).cast("string").alias("_text"), F.monotonically_increasing_id().alias("_row"), *keep)
    columns = ["_row", *keep, "_letters", "_sums", "_rest"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, values = sent.value
        for batch in batches:
            for at, raws in in_parts(batch.column(0)):
                letters, sums, left = [], [], []
                for raw in raws:
                    counts = Counter(words_in(raw.decode()))
                    met = [(known[w], k) for w, k in counts.items() if w in known]
                    index, times = (np.array(c, dtype=np.int64) for c in (zip(*met) if met else ((), ())))
                    letters.append(bool(counts))
                    sums.append((values[index] * times[:, None]).sum(axis=0))
                    left.append([{"word": w, "n": k} for w, k in counts.items() if w not in known])
                same = [c.slice(at, len(raws)) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([*same, pa.array(letters, pa.bool_()), list_array(sums, pa.float64()), pa.array(left, pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())])))], columns)

    schema = T.StructType([*rows.select("_row", *keep).schema, *T.StructType.fromDDL(_READ)])
    read_ = staged(rows.mapInArrow(read, schema), "texts-read")
    more = F.array(*[F.lit(float(p)) for p in model.priors]).cast("array<double>")
    if rest is None:
        judged = read_.withColumn("_total", F.zip_with("_sums", more, lambda a, b: a + b))
    else:
        asked = read_.select("_row", F.explode("_rest").alias("w")).select("_row", "w.word", "w.n")
        added = asked.join(rest.select("word", "scores"), "word").groupBy("_row").agg(F.array(*[F.sum(F.get("scores", F.lit(i)) * F.col("n")) for i in range(n)]).alias("_added"))
        none = F.array_repeat(F.lit(0.0), n)
        judged = read_.join(added, "_row", "left").withColumn("_total", F.zip_with(F.zip_with("_sums", F.coalesce("_added", none), lambda a, b: a + b), more, lambda a, b: a + b))
    known = F.col("_letters") & F.lit(n > 0)
    best = F.array_max("_total")
    name = F.get(F.array(*[F.lit(x) for x in model.langs]).cast("array<string>"), (F.array_position("_total", best) - 1).cast("int"))
    share = 1 / F.aggregate("_total", F.lit(0.0), lambda a, x: a + F.exp(x - best))
    return judged.select(*keep, F.when(known, name).otherwise(UNKNOWN).alias("lang_pred"), F.when(known, share).otherwise(0.0).alias("score"))
