r"""URL filter: association rules mined by FP-growth from labelled URLs, behind fixed rules.

A URL becomes a set of tokens: its host, up to four domains above it, the words of host and path, the
path's folders, file ending, query keys and scheme. Tokens found in exactly the same labelled URLs
stand for one another and are mined as one class. Spark's FP-growth mines combinations
of classes together with the label; a rule "these, therefore block" is kept
if its support and confidence reach the limits, and if no rule with fewer of its classes is as
confident, whatever number of classes it has. Rules are matched through an inverted index: each rule is
filed under its rarest class, a URL's classes look up the rules filed under them, and a rule that fits
whole counts: for each of its classes the URL has a token. A URL is blocked if a rule fits.

Fixed rules (host, path, verdict) come first: one fits its host and all subdomains if the URL's
path starts with the rule's; the longest wins. They are joined on the hosts above a URL's host
and the prefixes of its path that are as long as a rule's path.

Defined results: a null URL and one without ``://`` have an empty host and path, no tokens, and
are allowed; rows are judged by themselves, repeated ones alike; pages without a label, null
labels and labels of other pages teach nothing; without labels no rule is mined and the method
allows; an empty table gives an empty result; other columns are not read. Very long URLs give
as many tokens as they have; tokens too rare for a rule are not mined, and neither long paths nor
their copies multiply the sets (see ``mine_classes``). What can is a rare class that crosses many nested
ones, each in part: the sets below it double with each of those.
"""

from __future__ import annotations

import functools
import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from tradeloom.llm.common import ASCII_LOWER, ASCII_UPPER
from tradeloom.staging import staged

BLOCK_ITEM = "label:block"


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, ASCII_UPPER, ASCII_LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def hosts_above(host: Column, deepest: int) -> Column:
    """The domains of up to ``deepest`` parts that a host lies in, itself if it has no more."""
    parts = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(deepest))), lambda i: F.array_join(F.slice(parts, -i, i), "."))


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a URL."""
    host, path = host_of(url), F.translate(path_of(url), ASCII_UPPER, ASCII_LOWER)
    query = F.regexp_extract(after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    tagged = lambda tag, items: F.transform(items, lambda x: F.concat(F.lit(tag), x))
    words = F.regexp_extract_all(F.concat_ws("/", host, path), F.lit("([a-z]{3,})"), F.lit(1))
    every = F.concat(
        F.array(F.concat(F.lit("scheme:"), F.translate(F.substring_index(url, "://", 1), ASCII_UPPER, ASCII_LOWER))), tagged("host:", F.array_append(hosts_above(host, 4), host)), tagged("word:", words),
        tagged("folder:", F.regexp_extract_all(path, F.lit("/([^/]+)(?=/)"), F.lit(1))), tagged("ending:", F.regexp_extract_all(path, F.lit(r"\.([a-z0-9]{1,5})$"), F.lit(1))),
        tagged("key:", F.regexp_extract_all(query, F.lit("(?:^|&)([^=&]+)="), F.lit(1))))
    return F.when(F.length(host) > 0, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def token_classes(labelled: DataFrame, least: float) -> DataFrame:
    """(token, class, n, n_block) of the tokens worth mining. Tokens found in exactly the same rows are
    one class, named by the first of them; a 128-bit sum over the rows tells them."""
    rows = labelled.withColumn("row", F.monotonically_increasing_id()).select("row", "block", F.explode("tokens").alias("token"))
    same = ["n", "n_block", "h1", "h2"]
    stats = rows.groupBy("token").agg(F.count("*").alias("n"), F.count_if("block").alias("n_block"), *[F.bit_xor(F.xxhash64("row", F.lit(i))).alias(f"h{i}") for i in (1, 2)])
    stats = staged(stats.where((F.col("n_block") >= least) & (F.col("n") <= 0.9 * labelled.count())), "url-tokens-useful")
    names = stats.groupBy(*same).agg(F.min("token").alias("class"))
    return staged(stats.join(names, same).select("token", "class", "n", "n_block"), "url-classes")


def mine_classes(labelled: DataFrame, min_support: float = 0.001, min_confidence: float = 0.6, min_rows: int = 5) -> tuple[DataFrame, DataFrame]:
    """Rules (rule_id, classes, confidence, support) and the classes (token, class, n, n_block) of the
    staged (tokens, block). A rule fits if a URL has a token of each of its classes.

    Sets are mined below their rarest class: each row gives a basket for each of its classes c, with
    the more frequent classes that some, but not all rows of c hold. A class that all of them hold, as
    a folder does for what lies in it, adds nothing to c: the set without it is as
    confident. So neither tokens that always occur together nor folders inside folders multiply the sets."""
    n = labelled.count()
    least = max(min_support * n, min_rows)
    classes = token_classes(labelled, least)
    single = classes.where("token = class").select("class", "n", "n_block")
    rows = labelled.withColumn("row", F.monotonically_increasing_id()).select("row", "block", F.explode("tokens").alias("token"))
    held = rows.join(classes.where("token = class").select("token", "n"), "token").groupBy("row", "block").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("items"))
    held = staged(held, "url-held")
    n_held = held.count()
    if not n_held:
        empty = labelled.sparkSession.createDataFrame([], "rule_id long, classes array<string>, confidence double, support double")
        return empty, classes
    at = F.posexplode("items").alias("at", "c")
    later = F.explode(F.slice("items", F.col("at") + 2, F.size("items"))).alias("later")
    pairs = held.select("row", "block", "items", at).select("row", "block", F.col("c.token").alias("c"), F.col("c.n").alias("n"), later).withColumn("d", F.col("later.token"))
    kept = pairs.groupBy("c", "d").agg(F.count("*").alias("both"), F.count_if("block").alias("blocked"), F.first("n").alias("n")).where((F.col("blocked") >= least) & (F.col("both") < F.col("n")))
    item = F.concat("c", F.lit("\0"), "d")
    baskets = pairs.drop("n", "later").join(staged(kept.select("c", "d"), "url-pairs"), ["c", "d"]).groupBy("row", "block", "c").agg(F.collect_list(item).alias("items"))
    baskets = staged(baskets.select(F.when(F.col("block"), F.array_append("items", F.lit(BLOCK_ITEM))).otherwise(F.col("items")).alias("items")), "url-baskets")
    found = single.select(F.array("class").alias("classes"), "n_block", F.col("n").alias("freq"))
    if n_baskets := baskets.count():
        # Spark takes the least count from the share again, rounded up: half a row less than it gives no other.
        model = FPGrowth(itemsCol="items", minSupport=min(1.0, (math.ceil(least) - 0.5) / n_baskets), numPartitions=int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))).fit(baskets)
        sets = model.freqItemsets.select(F.array_contains("items", BLOCK_ITEM).alias("block"), F.array_remove("items", BLOCK_ITEM).alias("items"), "freq").where(F.size("items") > 0)
        parts = F.transform("items", lambda x: F.split(x, "\0"))
        sets = staged(sets.select("block", F.array_sort(F.array_union(F.transform(parts, lambda p: p[0]), F.transform(parts, lambda p: p[1]))).alias("classes"), "freq"), "url-sets")
        blocked = sets.where("block").select("classes", F.col("freq").alias("n_block"))
        found = found.unionByName(blocked.join(sets.where("NOT block").select("classes", "freq"), "classes"))
    scored = found.select("classes", (F.col("n_block") / F.col("freq")).alias("confidence"), (F.col("n_block") / n_held).alias("support"), F.size("classes").alias("size"))
    scored = staged(scored, "url-scored")
    # A rule adds nothing if some of its classes alone are as good a reason. Sets are met size by size, in
    # rising order; each hands on the best confidence of itself and its parts, also below the limit.
    best, rules = None, []
    for size in range(1, scored.agg(F.max("size")).first()[0] + 1):
        now = scored.where(F.col("size") == size)
        if best is None:
            now = now.withColumn("smaller", F.lit(0.0))
        else:
            part = F.explode(F.transform(F.sequence(F.lit(0), F.size("classes") - 1), lambda i: F.filter("classes", lambda t: t != F.get("classes", i)))).alias("part")
            smaller = now.select("classes", part).join(best, "part").groupBy("classes").agg(F.max("best").alias("smaller"))
            now = now.join(smaller, "classes")
        now = staged(now, "url-rules")
        best = now.select(F.col("classes").alias("part"), F.greatest("confidence", "smaller").alias("best"))
        rules.append(now.where((F.col("confidence") >= min_confidence) & (F.col("confidence") > F.col("smaller"))))
    return functools.reduce(DataFrame.unionByName, rules).select(F.xxhash64("classes").alias("rule_id"), "classes", "confidence", "support"), classes


def mine(labelled: DataFrame, min_support: float = 0.001, min_confidence: float = 0.6, min_rows: int = 5) -> DataFrame:
    """(rule_id, tokens, confidence, support): the rules of ``mine_classes`` spelt out, one for each choice of
    tokens. To look at; ``judge`` matches classes."""
    rules, classes = mine_classes(labelled, min_support, min_confidence, min_rows)
    rules = staged(rules.withColumn("tokens", F.array().cast("array<string>")), "url-rules-classes")
    for i in range(rules.agg(F.max(F.size("classes"))).first()[0] or 0):
        more = rules.where(F.size("classes") > i).withColumn("class", F.get("classes", F.lit(i))).join(classes.select("class", "token"), "class")
        rules = rules.where(F.size("classes") <= i).unionByName(more.withColumn("tokens", F.array_append("tokens", F.col("token"))).drop("class", "token"))
    return rules.select(F.xxhash64(F.array_sort("tokens")).alias("rule_id"), F.array_sort("tokens").alias("tokens"), "confidence", "support")


def matched(urls: DataFrame, rules: DataFrame, classes: DataFrame, id_col: str = "row") -> DataFrame:
    """(row, confidence) of the rows of (row, tokens) that a rule fits: the best rule's. Each rule is
    filed under its rarest class; only tokens of classes that rules name are looked at."""
    rules = staged(rules, "url-rules-found")
    parts = rules.select("rule_id", "classes", "confidence", F.explode("classes").alias("class"))
    filed = parts.join(classes.where("token = class").select("class", "n"), "class").groupBy("rule_id").agg(
        F.min(F.struct("n", "class"))["class"].alias("class"), F.first("classes").alias("needed"), F.first("confidence").alias("confidence"))
    index = staged(filed.select("class", "needed", "confidence"), "url-index")
    named = staged(classes.select("token", "class").join(parts.select("class").distinct(), "class", "left_semi"), "url-named")
    held = urls.select(id_col, F.explode("tokens").alias("token")).join(named, "token").groupBy(id_col).agg(F.collect_set("class").alias("classes"))
    asked = held.select(id_col, "classes", F.explode("classes").alias("class"))
    fits = asked.join(index, "class").where(F.size(F.array_except("needed", "classes")) == 0)
    return fits.groupBy(id_col).agg(F.max("confidence").alias("confidence"))


def fixed_verdicts(urls: DataFrame, rules: DataFrame, id_col: str = "row") -> DataFrame:
    """(row, rule, verdict) of the rows of (row, host, path) that a fixed rule (host, path, verdict)
    fits; the longest rule wins."""
    deepest = rules.agg(F.max(F.size(F.split("host", r"\.", -1)))).first()[0] or 1
    asked = urls.where("host <> ''").select(id_col, "path", F.explode(hosts_above(F.col("host"), deepest)).alias("host"))
    met = asked.alias("a").join(rules.alias("b"), "host").where(F.startswith(F.col("a.path"), F.col("b.path")))
    rule = F.concat(F.col("host"), F.col("b.path"))
    best = met.groupBy(id_col).agg(F.max(F.struct(F.char_length(rule).alias("n"), rule.alias("rule"), F.col("b.verdict").alias("verdict"))).alias("best"))
    return best.select(id_col, "best.rule", "best.verdict")


def judge(pages: DataFrame, labels: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", min_support: float = 0.001, min_confidence: float = 0.6) -> DataFrame:
    """(id, host, path, rule, verdict, confidence) of every row; ``labels`` are (id, block)."""
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), tokens_of(url).alias("tokens"))
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "url-tokens")
    known = labels.where("id IS NOT NULL AND block IS NOT NULL").groupBy("id").agg(F.max("block").alias("block"))
    labelled = staged(rows.join(known, "id").select("tokens", "block"), "url-labelled")
    mined = matched(rows.select("row", "tokens"), *mine_classes(labelled, min_support, min_confidence))
    fixed = fixed_verdicts(rows, rules)
    judged = rows.drop("tokens").join(fixed, "row", "left").join(mined, "row", "left")
    verdict = F.coalesce("verdict", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow"))
    return judged.select("id", "host", "path", "rule", verdict.alias("verdict"), "confidence")
