"""Mixing sources to target weights by hash thresholds.

Every row gets a hash of its id; a source is taken up to a threshold of that hash. Words are
summed by source and hash bucket, the bucket in which a source's budget ends is found, and
only the rows of that bucket are looked at more closely, with the next bits of the hash. Rows
are then filtered by comparing their hash with their source's threshold; nothing is sorted.
Because the hash doesn't depend on the budget, a smaller budget takes a subset of a larger one.

A target of r times its source's size takes every row floor(r) times, and the rows below the
threshold once more.

Defined results: a null or empty text has size 0 and is taken 0 words; rows of a null source
form a source that comes last; rows that repeat an id share its hash and are taken together;
a null id hashes as an empty one; if nothing has a size, all targets are 0; an empty table
gives an empty table. The operator returns its own columns, so extra ones can't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tradeloom.llm.common import text_of
from tradeloom.operators.ordering import numbered
from tradeloom.staging import staged

HASH_BITS, STEP_BITS = 60, 12


def hash_of(id_col: str):
    """60 bits of the MD5 of an id."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, h) of every row; size counts the tokens between blanks."""
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                       F.regexp_count(text_of(text_col), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"), hash_of(id_col).alias("h"))


def targets(rows: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(source, source_size, target): sources in code-point order, null last, share all words by
    the repeating weights; a target ends at ``most`` times its source's size, and what it gives
    up is shared again by weight until no target is above. Each round is one small aggregate."""
    sums = staged(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    order = sums.withColumn("last", F.col("source").isNull())
    ranked = numbered(order, [], [F.col("last"), F.col("source")], "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = staged(ranked.select("source", "source_size", weight.alias("weight")), "mix-weights")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    full, level, capped = most * F.col("source_size"), 0.0, -1
    while True:
        above = F.lit(False) if capped < 0 else F.col("weight") * level > full
        n, taken, left = ranked.agg(F.count_if(above), F.sum(F.when(above, full).otherwise(0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))).first()
        if n == capped or not left:
            break
        level, capped = (total - (taken or 0)) / left, n
    target = F.when(F.col("weight") * level > full, full.cast("double")).otherwise(F.col("weight") * level)
    return ranked.select("source", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, goals: DataFrame, rows_to_finish: int = 4096) -> DataFrame:
    """(source, target, source_size, whole, below): rows are taken ``whole`` times and those with
    h < ``below`` once more. ``rows`` are staged; each step reads one bucket per source, a
    4096th of the step before, until a bucket holds at most ``rows_to_finish`` rows."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = goals.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    state = staged(state.withColumn("below", F.lit(0).cast("long")), "mix-step")
    inside, bits, finish = rows.where("size > 0").select("source", "size", "h"), HASH_BITS, False
    while not finish:
        bits -= STEP_BITS
        largest = 0 if bits == 0 or bits == HASH_BITS - STEP_BITS else inside.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        finish = bits == 0 or bits < HASH_BITS - STEP_BITS and largest <= rows_to_finish
        shift = 0 if finish else bits
        sums = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        met = same_source(sums.withColumn("upto", F.sum("words").over(running)), state).select("a.source", "bucket", "words", "upto", "budget")
        # A bucket is below the threshold if it fits whole; a single hash value, if at least half of it fits.
        fits = F.col("upto") - (F.col("words") / 2 if finish else F.lit(0)) <= F.col("budget")
        ends = met.groupBy("source").agg(F.max(F.when(fits, F.col("bucket"))).alias("last"), F.min(F.when(~fits, F.col("bucket"))).alias("over"), F.max(F.when(fits, F.col("upto"))).alias("used"))
        if finish:
            below = F.coalesce(F.col("last") + 1, F.col("below"))
        else:
            below = F.coalesce(F.shiftleft("over", bits), F.when(F.col("last").isNotNull(), F.lit(1 << HASH_BITS)), F.col("below"))
        state = staged(same_source(state, ends, "left").select(
            "a.source", "source_size", "target", "whole", (F.col("budget") - F.coalesce("used", F.lit(0))).alias("budget"), below.alias("below")), "mix-step")
        if not finish:
            near = same_source(inside, state).where(F.shiftright("h", bits) == F.shiftright("below", bits))
            inside = staged(near.select("a.source", "size", "h"), "mix-bucket")
    return state.drop("budget")


def same_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    return left.alias("a").join(right.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), how)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(id, size, source_size, target, times, taken) of every row; ``taken`` is size x times."""
    rows = staged(sized(docs, id_col, text_col, source_col), "mix-rows")
    limits = thresholds(rows, targets(rows, weights, most))
    times = F.col("whole") + (F.col("h") < F.col("below")).cast("long")
    return same_source(rows, limits).select("id", "size", "source_size", "target", times.alias("times")).withColumn("taken", F.col("size") * F.col("times"))
