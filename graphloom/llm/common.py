"""Shared pieces: spooled intermediates, vectorised word hashing, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir, spool

#: White space everywhere in this subpackage: space and the five ASCII controls.
WS = r"[\x20\x09-\x0D]"
NOT_WS = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- word hashing ---------------------------------------------------------

_STEP = 1 << 20  # bytes of text hashed at once
#: by byte: A-Z lower-cased
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: by byte: what separates words
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
#: for word cores, everything in ASCII but letters and digits separates
MARKS = np.zeros(256, bool)
MARKS[:128] = True
MARKS[48:58] = MARKS[65:91] = MARKS[97:123] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where each text starts (one more entry for the end); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return body, at - at[0]


def slices(at: np.ndarray, step: int = _STEP) -> Iterator[tuple[int, int]]:
    """Runs of texts of about step bytes; a longer text is a run of its own."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + step, "right")) - 1)
        yield i, min(j, n)
        i = j


def hash_words(body: np.ndarray, at: np.ndarray, breaks: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts in one run of bytes: a 64-bit hash per word (A-Z lower-cased), words per text, and each word's start and end byte."""
    n = len(body)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(at) - 1, np.int64), none, none
    word = ~breaks[body]
    firsts, full = at[:-1], at[1:] > at[:-1]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, word[:-1]
    before[firsts[full]] = False
    after[-1], after[:-1] = False, word[1:]
    after[at[1:][full] - 1] = False
    start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return hash_spans(LOWER[body], start, end), np.diff(np.searchsorted(start, at)), start, end


def _blocks(body: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 8-byte blocks of spans of bytes, one span's behind the other's and zeros behind its end; each span's first block and how many it has."""
    if not len(size):
        return np.zeros(0, np.uint64), size, size
    # only the part that the spans lie in is copied, with zeros behind it
    low, high = int(start.min()), int((start + size).max())
    start = start - low
    words = np.ndarray(high - low + 1, "<u8", np.append(body[low:high], np.zeros(8, np.uint8)), strides=(1,))
    n = (size + 7) >> 3
    first = np.cumsum(n) - n
    if len(n) and n.max() == 1:
        at, left = start, size
    else:
        k = np.arange(n.sum()) - np.repeat(first, n)
        at, left = np.repeat(start, n) + 8 * k, np.repeat(size, n) - 8 * k
    return words[at] & (np.uint64(2**64 - 1) >> (np.maximum(0, 8 - left) * 8).astype(np.uint64)), first, n


def hash_spans(body: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each nonempty span of bytes; starts and ends ascend.  About a MB of bytes is worked on at once, however long the text.

    The 8-byte blocks of a span are mixed two by two, and again, until one is left: nothing that repeats in a text cancels out, as it may in sums.
    """
    out, i = np.empty(len(start), np.uint64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + _STEP, "right")))
        low = start[i]
        size = end[i:j] - low - (start[i:j] - low)
        h, first, n = _blocks(body[low : end[j - 1]], start[i:j] - low, size)
        h = mix(h + np.uint64(0x632BE59BD9B4E019))
        while len(n) and n.max() > 1:
            # of each span, blocks 2k and 2k + 1 become block k; an odd last one stays
            half = (n + 1) >> 1
            at = np.cumsum(half) - half
            k = np.arange(half.sum()) - np.repeat(at, half)
            left = np.repeat(first, half) + 2 * k
            both = 2 * k + 1 < np.repeat(n, half)
            g = h[left]
            g[both] = pair_hash(g[both], h[left[both] + 1])
            h, first, n = g, at, half
        out[i:j] = mix(h + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        i = j
    return out


def same_spans(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether spans of one run of bytes equal spans, of the same sizes (not 0), of another."""
    out, i, ends = np.empty(len(size), bool), 0, np.cumsum(size)
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + _STEP, "right")))
        x, first, _ = _blocks(a, at_a[i:j], size[i:j])
        y, _, _ = _blocks(b, at_b[i:j], size[i:j])
        out[i:j] = np.logical_and.reduceat(x == y, first)
        i = j
    return out


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + mix(b ^ np.uint64(0xA5A5A5A55A5A5A5A)))


def word_batches(texts: pa.Array, breaks: np.ndarray = SPACES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, past the last one, word hashes, words per text), about a MB at a time."""
    body, at = raw_text(texts)
    for i, j in slices(at):
        h, count, _, _ = hash_words(body[at[i] : at[j]], at[i : j + 1] - at[i], breaks)
        yield i, j, h, count


# --- graphs ---------------------------------------------------------------


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Of undirected edges (a, b), a and b bigint: (node, root), root the least node that can be reached.

    Every round each node goes to the node of least hash within two edges of it, and the graph is contracted.  The hash is another one each round,
    so whatever the graph, and however its ids are dealt, each round leaves in expectation a fixed share of the nodes at most: rounds grow with the
    logarithm of the largest component, and a star takes one.  known: what an earlier call found, to which these edges
    are added.  A node without edges, or with null in an edge, has no row.
    """
    edges = edges.where("a <> b").select("a", "b")
    if known is not None:
        edges = _contracted(edges, known)
    edges, found, turn = spool(edges.distinct(), "edges"), known, 0
    if known is not None and edges.isEmpty():
        return known
    while not edges.isEmpty():
        turn += 1
        rank = lambda c, turn=turn: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("to"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.least(rank("a"), F.min(rank("b"))).alias("m"))
        near = spool(near.select("a", "m.h", "m.to"), "near")
        two = both.join(near.select(F.col("a").alias("b"), "h", "to"), "b").select("a", "h", "to").unionByName(near)
        step = spool(two.groupBy(F.col("a").alias("node")).agg(F.min(F.struct("h", "to")).getField("to").alias("root")), "step")
        if found is None:
            found = step
        else:
            above = step.select(F.col("node").alias("root"), F.col("root").alias("above"))
            moved = found.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
            fresh = step.join(found.select("node"), "node", "left_anti") if known is not None else step.where("false")
            found = spool(moved.unionByName(fresh), "found")
        edges = spool(_contracted(edges, step).distinct(), "edges")
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    least = found.groupBy("root").agg(F.min("node").alias("least"))
    return spool(found.join(least, "root").select("node", F.col("least").alias("root")), "roots")


def _contracted(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges between the roots of their ends."""
    l, r = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    return edges.join(l, "a", "left").join(r, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a <> b")
