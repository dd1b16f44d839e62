"""Exact dedup by content-defined chunk recipes, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, spool

#: A chunk ends behind a match of CUT or at LONGEST code points, whichever is first, and has SHORTEST at least.
SHORTEST, LONGEST = 768, 8192
#: Content alone places the cuts: about one position in 30 of prose or random letters and digits, so chunks are just over SHORTEST.
CUT = r"(?<=[aeint0-4][^aeinorstu][dhlp5-9])"


def chunk_pattern(shortest: int = SHORTEST, longest: int = LONGEST, cut: str = CUT) -> str:
    return rf"(?s).{{{shortest},{longest - 1}}}?{cut}|.{{1,{longest}}}"


def exact_duplicates(docs: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, chunk_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_chunks of every row of docs(doc_id, text).

    Texts are equal when identical without white space.  Each text becomes its recipe: the ordered ids of its content-defined
    chunks.  Chunks are shuffled once, deduplicated within tasks first; an id is the chunk's 64-bit hash, verified by holding all
    chunks of a hash against each other, and a hash that several different chunks share is split by rank.  Then only recipes
    are compared, so no document moves as a whole and a group of any size is summed within tasks.

    Of equal texts the longest original stays, then the smallest doc_id (null comes last).  A null or empty text is an empty recipe:
    such rows are equal to each other.  A text of any length is cut into chunks and compared by all of them; no rows give no rows.  Of rows that tie in everything, repeated rows, all say kept if their id is the kept one.  Columns
    beyond doc_id and text are ignored.
    """
    ws = WS + "+"
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = base.select("doc_id", F.char_length("text").alias("length"), F.regexp_replace("text", ws, "").alias("norm"))
    base = base.select("doc_id", "length", "norm", F.expr(f"regexp_extract_all(norm, '{_sql(chunk_pattern(shortest, longest))}', 0)").alias("chunks"))
    rows = base.select("doc_id", "length", F.sha2("norm", 256).alias("text_sha256"), F.transform("chunks", lambda c: chunk_hash(c)).alias("recipe"))
    rows = spool(rows, "recipes")

    chunk = base.select(F.explode("chunks").alias("chunk")).select(chunk_hash(F.col("chunk")).alias("h"), "chunk").distinct()
    shared = chunk.groupBy("h").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("h")
    shared = spool(shared, "shared_hashes")  # hashes with several texts: as good as always none
    if not shared.isEmpty():
        rows = _split(rows, base, shared, chunk_hash)

    key = F.struct(F.col("length").cast("decimal(20,0)"), (-F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)).cast("decimal(20,0)")).alias("d"), "doc_id")
    groups = rows.groupBy("recipe").agg(F.max(key).alias("best"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select(F.xxhash64("recipe").alias("k"), F.col("recipe").alias("r"), F.col("best.doc_id").alias("keep_id"), "group_size")
    # joined by a key of its own: both sides are exchanged anew, so that adaptive execution may split a hot recipe
    out = rows.withColumn("own_k", F.xxhash64("recipe")).join(groups, (F.col("own_k") == F.col("k")) & (F.col("recipe") == F.col("r")))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", F.size("recipe").alias("n_chunks"))


def _sql(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def _split(rows: DataFrame, base: DataFrame, shared: DataFrame, chunk_hash: Callable[[Column], Column]) -> DataFrame:
    """Where different chunks share a hash, put their rank by text in front of it in the recipe."""
    at = base.select("doc_id", "length", F.sha2("norm", 256).alias("text_sha256"), F.posexplode("chunks").alias("pos", "chunk")).withColumn("h", chunk_hash(F.col("chunk")))
    at = at.join(shared, "h", "left_semi")
    texts = at.select("h", "chunk").distinct()
    less = texts.alias("x").join(texts.alias("y"), (F.col("x.h") == F.col("y.h")) & (F.col("y.chunk") < F.col("x.chunk")), "left")
    rank = less.groupBy("x.h", "x.chunk").agg(F.count("y.chunk").alias("rank"))
    mark = at.join(rank, ["h", "chunk"]).where("rank > 0").groupBy("text_sha256", "length", "doc_id").agg(F.array_sort(F.collect_set(F.struct("pos", "rank"))).alias("ranks"))
    flat = F.flatten(F.transform("ranks", lambda x: F.array(x["pos"].cast("bigint"), x["rank"])))
    out = rows.alias("r").join(mark.alias("m"), (F.col("r.text_sha256") == F.col("m.text_sha256")) & (F.col("r.length") == F.col("m.length")) & F.col("r.doc_id").eqNullSafe(F.col("m.doc_id")), "left")
    return out.select("r.doc_id", "r.length", "r.text_sha256", F.when(F.col("ranks").isNull(), F.col("recipe")).otherwise(F.concat(flat, F.array(F.lit(-1).cast("bigint")), F.col("recipe"))).alias("recipe"))
