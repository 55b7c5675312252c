r"""Secret scan: fixed patterns, and character Markov models of random strings against identifiers.

Everything runs in DataFrame functions. The patterns of ``PATTERNS`` are searched leftmost and
without overlap; positions come from splitting the text at its matches and adding up lengths,
in code points. Besides, every run of at least ``MIN_CHARS`` token characters is scored: the
log-likelihood ratio of its character pairs under a first-order Markov model of random strings
and one of ordinary identifiers. Both are trained from labelled samples, a table of (token,
secret); ``corpus_samples`` labels what the patterns find and generated random strings as
secrets, and all other long tokens of the corpus, also joined as identifiers are, as ordinary.
A token counts once, so copies of a secret teach nothing, and ordinary samples that look random
are left out. Only pair counts leave the cluster, at most four per pair of token characters.

Defined results: a null text is an empty one and has no spans; texts of any length are searched
whole; each row is scanned by itself, so repeated rows give the same twice; without samples the
model scores 0 and adds nothing; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tradeloom.llm.common import text_of
from tradeloom.staging import staged

#: Kind, pattern, group whose length counts, and its least length.
PATTERNS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
TOKEN_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
MIN_CHARS, MIN_RATIO, MIN_RATIO_PER_CHAR = 12, 12.0, 0.4
_TOKEN = rf"[A-Za-z0-9+/_=\-]{{{MIN_CHARS},}}"
_NUMBER = r"^[0-9+/_=\-]+$"
_PAIRS = "(?=(..))"
KINDS = [p[0] for p in PATTERNS] + ["markov"]


def placed(text: Column, pattern: str, found: Column) -> Column:
    """array<struct<start,end,token>> of the matches ``found`` of a pattern."""
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    steps = F.arrays_zip(gaps.alias("gap"), found.alias("token"))

    def step(state: Column, s: Column) -> Column:
        start = state["at"] + F.char_length(s["gap"])
        end = start + F.char_length(s["token"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(start.alias("start"), end.alias("end"), s["token"].alias("token")))).alias("out"))

    none = F.array().cast("array<struct<start:int,end:int,token:string>>")
    made = F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda s: s["out"])
    return F.when(F.size(found) > 0, made).otherwise(none)


def base_spans(docs: DataFrame, text: str) -> DataFrame:
    """Adds ``_assign``, ``_access`` and ``_hex``: array<struct<start,end,token>>. The assignment's
    pattern matches short values too, which use up their text and are then dropped."""
    for kind, pattern, group, least in PATTERNS:
        whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        docs = docs.withColumn(f"_{kind}", whole)
        spans = placed(F.col(text), pattern, F.col(f"_{kind}"))
        if group:
            long_enough = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda v: F.char_length(v) >= least)
            kept = F.filter(F.arrays_zip(spans.alias("span"), long_enough.alias("keep")), lambda x: x["keep"])
            spans = F.when(F.size(f"_{kind}") > 0, F.transform(kept, lambda x: x["span"])).otherwise(spans)
        else:
            spans = F.filter(spans, lambda s: s["end"] - s["start"] >= least)
        docs = docs.withColumn(f"_{kind}", spans)
    return docs


def generated(spark: SparkSession, n: int = 4096) -> DataFrame:
    """Random strings over hex digits, base64 and capitals with digits, the same in each run."""
    digest = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    base64 = lambda salt: F.base64(F.unhex(digest(salt)))
    kinds = F.array(digest("hex"), base64("base64"), F.upper(F.regexp_replace(base64("capitals"), "[+/=]", "")))
    return spark.range(n).select(F.explode(kinds).alias("token"), F.lit(True).alias("secret"))


def corpus_samples(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(token, secret) of all long tokens of the corpus, and the generated random strings. What
    the patterns find, values of assignments too, is secret and leaves the text before the
    ordinary tokens are read."""
    text = text_of(text_col)
    found, rest = [], text
    for _, pattern, group, least in PATTERNS:
        found.append(F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda v: F.char_length(v) >= least))
        rest = F.regexp_replace(rest, F.lit(pattern), F.lit(" "))
    long = lambda t: F.regexp_extract_all(t, F.lit(_TOKEN), F.lit(0))
    tagged = lambda tokens, secret: F.transform(tokens, lambda t: F.struct(t.alias("token"), F.lit(secret).alias("secret")))
    tokens = docs.select(F.inline(F.concat(tagged(F.flatten(F.transform(F.concat(*found), long)), True), tagged(long(rest), False))))
    return tokens.unionByName(generated(docs.sparkSession))


def pair_counts(samples: DataFrame) -> DataFrame:
    """(secret, half, pair, n). An ordinary token also stands for identifiers that join it with another
    word: camel case, underscore, hyphen, a leading capital or a number behind it."""
    first, last = F.substring("token", 1, 1), F.substring("token", -1, 1)
    joints = F.array(F.concat(F.lower(last), F.upper(first)), F.concat(last, F.lit("_")), F.concat(F.lit("_"), first), F.concat(last, F.lit("-")), F.concat(F.lit("-"), first),
                     F.concat(F.upper(first), F.substring("token", 2, 1)), F.concat(last, F.lit("1")))
    pairs = F.regexp_extract_all("token", F.lit(_PAIRS), F.lit(1))
    rows = samples.select("secret", "half", F.explode(F.when(F.col("secret"), pairs).otherwise(F.concat(pairs, joints))).alias("pair"))
    return rows.where(F.col("pair").rlike(rf"^[{TOKEN_CHARS[:-1]}\-]{{2}}$")).groupBy("secret", "half", "pair").agg(F.count("*").alias("n"))


def train(samples: DataFrame, smooth: float = 0.5, rounds: int = 8) -> list[int]:
    """Log-likelihood ratio of each pair of token characters, in hundredths, first character by first character.

    A token counts once, however often it is found, and as a secret if it is one anywhere. Plain
    text holds secrets no pattern knows: an ordinary sample leaves its class if a model whose
    ordinary samples are the other half of them, so not itself, finds it likelier random. That
    is done again with the models of those that stay, until they no longer change. Numbers stay:
    card and order numbers look random, too."""
    tokens = samples.groupBy("token").agg(F.max("secret").alias("secret")).withColumn("half", F.pmod(F.xxhash64("token"), F.lit(2)).cast("int"))
    tokens = kept = staged(tokens, "secret-samples")
    judges = None
    for _ in range(rounds):
        random, ordinary = Counter(), [Counter(), Counter()]
        for r in pair_counts(kept).collect():
            (random if r["secret"] else ordinary[r["half"]])[r["pair"]] += r["n"]
        last, judges = judges, [fitted(random, ordinary[1], smooth), fitted(random, ordinary[0], smooth)]
        if judges == last:
            break
        judged = F.when(F.col("half") == 0, ratio(F.col("token"), judges[0])).otherwise(ratio(F.col("token"), judges[1]))
        kept = tokens.where(F.col("secret") | F.col("token").rlike(_NUMBER) | (judged <= 0))
    return fitted(random, ordinary[0] + ordinary[1], smooth)


def fitted(random: Counter, ordinary: Counter, smooth: float) -> list[int]:
    """The model of the pairs counted in both classes."""
    counts = {True: random, False: ordinary.copy()}
    for pair, n in ordinary.items():  # constants are written in capitals
        counts[False][pair.upper()] += 0.1 * n
    if not counts[True] or not counts[False]:
        return [0] * len(TOKEN_CHARS) ** 2
    before = {kind: Counter() for kind in counts}
    for kind, seen in counts.items():
        for pair, n in seen.items():
            before[kind][pair[0]] += n
    share = lambda kind, a, b: (counts[kind][a + b] + smooth) / (before[kind][a] + smooth * len(TOKEN_CHARS))
    return [round(100 * math.log(share(True, a, b) / share(False, a, b))) for a in TOKEN_CHARS for b in TOKEN_CHARS]


def ratio(token: Column, model: list[int]) -> Column:
    """Log-likelihood ratio of a token, random string against ordinary identifier, in hundredths."""
    held = F.split(F.lit(",".join(map(str, model))), ",").cast("array<int>")
    place = lambda c: F.instr(F.lit(TOKEN_CHARS), c) - 1
    pairs = F.regexp_extract_all(token, F.lit(_PAIRS), F.lit(1))
    return F.aggregate(pairs, F.lit(0), lambda total, p: total + F.get(held, place(F.substring(p, 1, 1)) * len(TOKEN_CHARS) + place(F.substring(p, 2, 1))))


def scan(docs: DataFrame, model: list[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): array<struct<start,rank,end,kind>> in order of start, then kind as listed."""
    rows = base_spans(docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("_text")), "_text")
    rows = rows.withColumn("_markov", F.regexp_extract_all("_text", F.lit(_TOKEN), F.lit(0)))
    random = lambda s: ratio(s["token"], model) >= 100 * F.greatest(F.lit(MIN_RATIO), MIN_RATIO_PER_CHAR * (s["end"] - s["start"]))
    known = F.concat(*[F.col(f"_{k}") for k in KINDS[:-1]])
    new = lambda s: ~F.exists(known, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    rows = rows.withColumn("_markov", F.filter(placed(F.col("_text"), _TOKEN, F.col("_markov")), lambda s: new(s) & random(s)))
    return rows.select("id", F.array_sort(F.concat(*[named(k) for k in KINDS])).alias("spans"))


def named(kind: str) -> Column:
    """The spans of one kind, in a form that sorts by start and then by kind as listed."""
    return F.transform(f"_{kind}", lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def of_kind(kind: str, spans: str = "spans") -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
