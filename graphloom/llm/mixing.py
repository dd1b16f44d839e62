"""Mixing sources to target weights by hash-threshold histograms, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NOT_WS, spool

#: A document's hash has 60 bits; each histogram resolves 12 of them.
LEVELS, BITS = 5, 12


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(NOT_WS + "+")).cast("bigint")


def document_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of the md5 of id and text, so that rows of one id, or of none, still differ."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def _key(source: Column) -> Column:
    """Joins by source treat null as a source of its own."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def targets(sources: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """Of sources(source, source_size), one row each: target and how often all of it is taken (whole).

    Sources in code point order, null last, get the weights in turn and share the sum of all sizes.  A source stops at most times its
    size and the others share the rest.  That holds for a prefix in the order of most * size / weight, so running sums find it; the one
    unpartitioned window is over the list of sources, which is a parameter of the mix and not data.
    """
    n = len(weights)
    turn = (F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1) % n
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), turn + 1).cast("bigint")
    t = sources.select("source", "source_size", weight.alias("weight"))
    by = W.orderBy(F.col("source_size").cast("decimal(30,0)") / F.col("weight"), F.col("source").isNull(), "source")
    before, every = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(every) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    shares = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    t = t.select("*", left.alias("left"), shares.alias("shares"))
    big = lambda c: F.col(c).cast("decimal(19,0)")
    t = t.withColumn("full", big("source_size") * most * F.col("shares").cast("decimal(12,0)") <= F.col("weight").cast("decimal(12,0)") * big("left"))
    rest = F.first(F.when(~F.col("full"), F.struct("left", "shares")), ignorenulls=True).over(every)
    t = t.withColumn("rest", rest)
    target = F.when(F.col("full"), (most * F.col("source_size")).cast("double")).otherwise((F.col("weight") * F.col("rest.left")).cast("double") / F.col("rest.shares").cast("double"))
    t = t.withColumn("target", target)
    whole = F.when(F.col("source_size") == 0, 0).otherwise(F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).cast("bigint")
    return t.select("source", _key(F.col("source")).alias("sk"), "source_size", "target", whole.alias("whole"))


def thresholds(rows: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Of rows(sk, source, size, h): sk, source_size, target, whole and below: rows with h < below are taken once more than whole.

    Per source, sizes are summed by the leading bits of the hash, and running sums find the bucket in which the rest of the budget ends.
    Only that bucket's rows are looked at again, by the next bits, down to one hash; it counts if more than half of it fits.
    """
    goal = spool(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    at = goal.select("sk", (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"), F.lit(0).cast("bigint").alias("prefix"))
    here = rows.select("sk", "size", "h")
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        b = F.shiftright("h", shift).alias("b")
        if level:
            here = spool(here.join(at.select("sk", F.col("prefix").alias("p")), "sk").where(F.shiftright("h", shift + BITS) == F.col("p")).select("sk", "size", "h"), "boundary")
        sums = here.groupBy("sk", b).agg(F.sum("size").alias("s"))
        upto = W.partitionBy("sk").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.coalesce(F.sum("s").over(upto), F.lit(0)))
        last = sums.join(at.select("sk", "rest"), "sk").where("before <= rest").groupBy("sk").agg(F.max(F.struct("b", "before", "s", "rest")).alias("x"))
        at = spool(last.select("sk", (F.col("x.rest") - F.col("x.before")).alias("rest"), F.col("x.b").alias("prefix"), F.col("x.s").alias("s")), "prefix")
    below = at.select("sk", (F.col("prefix") + F.when((F.col("s") > 0) & (2 * F.col("rest") >= F.col("s")), 1).otherwise(0)).alias("below"))
    return goal.join(below, "sk", "left").select("sk", "source_size", "target", "whole", F.when(F.col("target") > F.col("whole") * F.col("source_size"), F.col("below")).otherwise(0).alias("below"))


def measured(docs: DataFrame, *keep: Column) -> DataFrame:
    return docs.select(*keep, "source", _key(F.col("source")).alias("sk"), words(F.col("text")).alias("size"), document_hash(F.col("doc_id"), F.col("text")).alias("h"))


def _copies(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.join(found, "sk").withColumn("copies", F.col("whole") + (F.col("h") < F.col("below")).cast("bigint"))


def mix_plan(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """doc_id, size, source_size, target and copies (how often the mix takes it, at most `most`) of every row of docs(doc_id, text, source).

    A null text has size 0; a null source is a source of its own, the last.  Rows that agree in id and text have one hash and are
    taken alike.  A long text counts as a whole, and may be the one that a budget ends in.  No rows give no rows.  Other columns are ignored.
    """
    rows = spool(measured(docs, F.col("doc_id")), "sizes")
    return _copies(rows, spool(thresholds(rows, weights, most), "thresholds")).select("doc_id", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The mix itself: rows of docs, whatever their columns, as often as mix_plan says."""
    rows = spool(measured(docs), "sizes")
    found = spool(thresholds(rows, weights, most), "thresholds")
    taken = _copies(measured(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), found)
    taken = taken.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return taken.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
