"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACES, hash_spans, hash_words, mix, pair_hash, raw_text, slices, spool

#: Hash buckets of words and word pairs, and of the marks at words' ends; two more say whether three words came before in the text.
GRAMS, TAILS = 10_000, 500
BUCKETS = GRAMS + TAILS + 2
#: Labelled documents that the target model is fitted on, at most, and as many that the sample's size is fitted on.
LABELLED = 20_000
#: The target model starts from so many n-grams drawn as in the raw text.
PRIOR = 1_000.0
SEED = 20240229

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[33:48] = _PUNCTUATION[58:65] = _PUNCTUATION[91:97] = _PUNCTUATION[123:127] = True


def features(body: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) pairs: of words, of word pairs, of word ends, and of repetition.

    Words drop up to three marks at their end, A-Z is lower-cased; a pair of the same word twice is one feature whatever the word; three words that
    came before in the same text are marked, so that text that goes in circles shows.
    """
    _, count, start, end = hash_words(body, at, SPACES)
    if not len(start):
        return
    doc = np.repeat(np.arange(len(count)), count)
    tail = np.zeros(len(start), np.uint64)
    cut, more = end.copy(), np.ones(len(start), bool)
    for _ in range(3):
        more &= cut > start
        more[more] = _PUNCTUATION[body[cut[more] - 1]]
        tail = np.where(more, tail * np.uint64(131) + body[np.maximum(cut - 1, 0)] + np.uint64(1), tail)
        cut = cut - more
    word = hash_words_between(body, start, cut)
    yield doc, (word % np.uint64(GRAMS)).astype(np.int64)
    yield doc, (GRAMS + (mix(tail) % np.uint64(TAILS)).astype(np.int64))
    two = doc[1:] == doc[:-1]
    pair = np.where(word[1:] == word[:-1], np.uint64(7), pair_hash(word[:-1], word[1:]))[two]
    yield doc[1:][two], (pair % np.uint64(GRAMS)).astype(np.int64)
    three = two[1:] & two[:-1]
    triple = pair_hash(pair_hash(word[:-2], word[1:-1]), word[2:] + doc[2:].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[three]
    if len(triple):
        _, first = np.unique(triple, return_index=True)
        again = np.ones(len(triple), np.int64)
        again[first] = 0
        yield doc[2:][three], GRAMS + TAILS + again


def hash_words_between(body: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans, A-Z lower-cased; an empty span has one of its own."""
    some = end > start
    out = np.full(len(start), 11, np.uint64)
    out[some] = hash_spans(LOWER[body], start[some], end[some])
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: how often each bucket comes in all texts and in target texts."""
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        body, at = raw_text(batch.column(0))
        wanted = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for i, j in slices(at):
            for doc, bucket in features(body[at[i] : at[j]], at[i : j + 1] - at[i]):
                raw += np.bincount(bucket, minlength=BUCKETS)
                target += np.bincount(bucket[wanted[i:j][doc]], minlength=BUCKETS)
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])


def log_ratios(counts: list[tuple[int, int, int]]) -> np.ndarray:
    """ln of target over raw probability by bucket, each of the three kinds a distribution of its own."""
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for b, r, t in counts:
        raw[b], target[b] = r, t
    out = np.zeros(BUCKETS)
    for low, high in ((0, GRAMS), (GRAMS, GRAMS + TAILS), (GRAMS + TAILS, BUCKETS)):
        r = raw[low:high] + 1e-9
        r /= r.sum()
        t = target[low:high] + PRIOR * r
        out[low:high] = np.log(t / t.sum()) - np.log(r)
    return out


def log_weights(ratios: np.ndarray, texts: pa.Array) -> np.ndarray:
    """ln of the importance weight of each text: the sum over all its features."""
    body, at = raw_text(texts)
    out = np.zeros(len(texts))
    for i, j in slices(at):
        for doc, bucket in features(body[at[i] : at[j]], at[i : j + 1] - at[i]):
            out[i:j] += np.bincount(doc, ratios[bucket], j - i)
    return out


def sample_keys(ids: pa.Array, texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    """ln weight plus Gumbel noise from doc_id (without one, from the text), as integers in the same order."""
    own = mix(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
    for i in np.flatnonzero(ids.is_null().to_numpy(zero_copy_only=False)):
        own[i] = int.from_bytes(hashlib.blake2b((texts[i].as_py() or "").encode(), digest_size=8).digest(), "little")
    u = mix(own ^ np.uint64(SEED))
    noisy = weights - np.log(-np.log(((u >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53))
    bits = noisy.view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def kth_largest(rows: DataFrame, k: int) -> int | None:
    """The k-th largest of rows' bigint column key, by histograms of 12 bits that are refined in one bucket only; None if there are fewer."""
    low, width = 0, 64
    here, left = rows.select("key"), k
    while width:
        width = max(0, width - 12)
        # unsigned order: flip the sign bit, then take the bits above width
        bucket = F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-(2**63))), width).alias("b")
        counts = dict(here.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")).collect())  # 4096 rows at most
        for b in sorted(counts, key=lambda x: x % 2**64, reverse=True):
            if counts[b] >= left:
                break
            left -= counts[b]
        else:
            return None
        here = here.where(bucket == F.lit(b).cast("bigint"))
        low = b
    return low ^ -(2**63)


def _half(labels: DataFrame, half: int, most: int) -> DataFrame:
    """Half of the labelled documents by a hash of doc_id, and of these at most `most`: those with the least hashes."""
    h = F.xxhash64("labelled")
    own = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("labelled")).agg(F.max("quality").alias("quality"))
    return own.where(F.pmod(h, F.lit(2)) == half).orderBy(h, "labelled").limit(most)


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> np.ndarray:
    """Log ratios by bucket.  Raw counts cover all documents, the target's those of quality 1 in one half of the labelled, of which at most
    `most` ids are broadcast."""
    own = spool(_half(labels, 0, most).where("quality = 1").select("labelled"), "targets")
    texts = docs.select("doc_id", "text").join(F.broadcast(own), F.col("doc_id") == F.col("labelled"), "left").select("text", F.col("labelled").isNotNull().alias("target"))
    counts = texts.mapInArrow(_count, "bucket int, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw"), F.sum("target"))
    return log_ratios([tuple(r) for r in counts.collect()])  # BUCKETS rows at most


def calibrate(weights: np.ndarray, quality: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges and shares: by held-out documents, how often one whose ln weight lies between two edges is the target's.

    Shares never fall as weights rise: neighbours that would are one step (isotonic regression).  An edge lies midway between the documents beside it.
    Nothing is said about how weights are spread, which depends on texts' lengths.  Without documents the share is 1.
    """
    if not len(weights):
        return np.zeros(0), np.ones(1)
    values, which = np.unique(weights, return_inverse=True)
    n, hits = np.bincount(which), np.bincount(which, quality)
    steps: list[list[float]] = []  # first value, past the last one, documents, hits
    for k in range(len(values)):
        steps.append([k, k + 1, n[k], hits[k]])
        while len(steps) > 1 and steps[-2][3] * steps[-1][2] >= steps[-1][3] * steps[-2][2]:
            _, end, more, found = steps.pop()
            steps[-1] = [steps[-1][0], end, steps[-1][2] + more, steps[-1][3] + found]
    firsts = np.array([x[0] for x in steps[1:]], int)
    return (values[firsts - 1] + values[firsts]) / 2, np.array([x[3] / x[2] for x in steps])


def expected_targets(rows: DataFrame, edges: np.ndarray, shares: np.ndarray) -> int:
    """How many of rows(log_weight) are the target's, by the shares between the edges: rows are counted by step in each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(shares), np.int64)
        for batch in batches:
            n += np.bincount(np.searchsorted(edges, np.asarray(batch.column(0)), "right"), minlength=len(shares))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["step", "n"])

    steps = rows.select("log_weight").mapInArrow(count, "step bigint, n bigint").groupBy("step").agg(F.sum("n").alias("n")).orderBy("step").collect()  # a row a step
    return round(sum(shares[r["step"]] * r["n"] for r in steps))


def _scores(ratios):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = log_weights(ratios.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w), pa.array(sample_keys(batch.column(0), batch.column(1), w))], names=["doc_id", "log_weight", "key"])

    return run


def score(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> tuple[DataFrame, int, object]:
    """doc_id, log_weight, key of every row; the least key that is sampled; the model, broadcast.

    So many documents are sampled as the target is expected to have: the sum over all documents of the probability that a document is the
    target's.  N-grams aren't independent, so the weights are too sure of themselves; the probability is therefore read off the other half of the
    labelled documents, at most `most` of them, as the share of the target's among those of like weight.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, most))
    rows = spool(docs.select("doc_id", "text").mapInArrow(_scores(shared), "doc_id bigint, log_weight double, key bigint"), "weights")
    known = rows.join(F.broadcast(spool(_half(labels, 1, most), "held_out")), F.col("doc_id") == F.col("labelled"))
    known = known.groupBy("labelled").agg(F.min("log_weight").alias("w"), F.max("quality").alias("q")).select("w", "q").toArrow()  # `most` rows at most
    edges, shares = calibrate(*(np.asarray(known.column(c).combine_chunks(), float) for c in ("w", "q")))
    least = kth_largest(rows, max(1, expected_targets(rows, edges, shares)))
    return rows, -(2**63) if least is None else least, shared


def quality_sample(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """doc_id, log_weight, kept of every row of docs(doc_id, text), by labels(doc_id, quality).

    log_weight is the ln of how much likelier the target's hashed n-gram model makes the text than that of the raw text; kept are the Gumbel
    top k of it, a sample without replacement in proportion to the weights.  Rows that tie with the last one kept are kept.  A null or empty text
    has weight 1, a text of any length the weight of all its n-grams.  Without labels all documents are kept; no rows give no rows.  Rows that
    repeat an id and a text share a score and its fate, as do rows without id of one text.  Labels that are null, or of a null id, count for
    nothing; of a label that comes more than once the greatest counts.  Columns beyond those named are ignored.
    """
    rows, least, _ = score(docs, labels, most)
    return rows.select("doc_id", "log_weight", (F.col("key") >= F.lit(least).cast("bigint")).alias("kept"))


def keep_sampled(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """The rows of docs, whatever their columns, that quality_sample keeps; odd rows fare as there.  Nothing is shuffled."""
    _, least, shared = score(docs, labels, most)
    ids, text = docs.columns.index("doc_id"), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = sample_keys(batch.column(ids), batch.column(text), log_weights(shared.value, batch.column(text)))
            yield batch.filter(pa.array(keys >= least))

    return docs.mapInArrow(run, docs.schema)
