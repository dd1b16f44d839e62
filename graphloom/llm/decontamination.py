"""Benchmark decontamination: a BM25 index of test items, queried with every passage by block-max WAND."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MARKS, hash_words, mix, pair_hash, spool, word_batches

K1, B = 1.2, 0.75
#: An item is retrieved for a passage that reaches this share of the score that the item's own text would reach, or less where a leak may have less.
SCORE = 0.6
#: A retrieved item is a leak if so much of its 5-word shingles is in the passage, and this share of the question's and of the answer's words.
SHINGLE, SHARE, PART = 5, 0.8, 0.5
#: Items in a block for whole passages, postings in a block of a term's list.
GROUP, POSTINGS = 4, 8
#: Items, and their bytes, in one index, which is broadcast: more items take more passes over the documents, with the same results.
ITEMS, ITEM_BYTES = 20_000, 20_000_000
_GONE, _ITEM = 1 << 60, itemgetter(0)
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=\S)")


def shingle_hashes(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """One hash at each place where n words begin; fewer words are one shingle."""
    n = min(n, len(words))
    if not n:
        return words[:0]
    h = mix(words[: len(words) - n + 1] + np.uint64(n))
    for k in range(1, n):
        h = pair_hash(h, words[k : len(words) - n + 1 + k])
    return h


def _words(text: str) -> np.ndarray:
    body = np.frombuffer(text.encode(), np.uint8)
    return hash_words(body, np.array([0, len(body)]), MARKS)[0]


@dataclass(frozen=True)
class Statistics:
    """What BM25 takes from all items, whichever index an item is in: how many there are, their mean length, and by term how many have it."""

    n: int
    mean: float
    terms: np.ndarray  # ascending
    df: np.ndarray

    @staticmethod
    def of(words: list[np.ndarray]) -> Statistics:
        terms, df = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.unique(w) for w in words)]), return_counts=True)
        return Statistics(len(words), float(sum(map(len, words))) / max(1, len(words)), terms, df)


def least_share(impacts: np.ndarray, words: np.ndarray, shingles: np.ndarray) -> float:
    """The least share of its own score that an item keeps in a passage with SHARE of its shingles.

    A word that the passage lacks takes with it the shingle that begins, or ends, with it, another one for each such word: as some shingle is left, words
    before that one map to those that they begin, words behind it to those that they end.  So no more words are missing than shingles may be;
    twice as many if a shingle comes more than once in the item.
    """
    distinct = len(np.unique(shingles))
    missing = (distinct - math.ceil(SHARE * distinct - 1e-9)) * (1 if distinct == len(shingles) else 2)
    return 1.0 - float(np.sort(impacts)[::-1][:missing].sum())


class Index:
    """Items of up to `longest` words, for passages of twice that length.

    Impacts are BM25 term scores divided by the item's own score and then raised so far that a leak of the item can't miss the threshold: one threshold serves
    every item.  Terms in most items come first into the non-essential part, as long as no item could get half the threshold from them; the other half
    must come from essential terms.
    """

    def __init__(self, items: list[tuple[int, str]], longest: int, score: float, statistics: Statistics):
        self.longest, self.score, self.touched = longest, score, 0
        self.ids = [i for i, _ in items]
        self.words = [_words(t) for _, t in items]
        self.question = [min(len(w), len(_words(" ".join(parts[:-1])))) if len(parts := _SENTENCE.split(t.strip())) > 1 else len(w) for (_, t), w in zip(items, self.words, strict=True)]
        self.shingles = [shingle_hashes(w) for w in self.words]
        n = len(items)
        pairs = [np.unique(w, return_counts=True) for w in self.words]
        self.terms, at = np.unique(np.concatenate([t for t, _ in pairs]), return_inverse=True)
        doc = np.repeat(np.arange(n), [len(t) for t, _ in pairs])
        tf = np.concatenate([c for _, c in pairs])
        long = np.array([len(w) for w in self.words])[doc]
        every = statistics.df[np.searchsorted(statistics.terms, self.terms)]
        impact = np.log1p((statistics.n - every[at] + 0.5) / (every[at] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * long / statistics.mean))
        impact /= np.bincount(doc, impact, n)[doc]
        ends = np.cumsum([len(t) for t, _ in pairs])
        kept = [least_share(impact[e - len(t) : e], w, g) for (t, _), e, w, g in zip(pairs, ends, self.words, self.shingles, strict=True)]
        self.raised = np.maximum(1.0, score / np.maximum(1e-3, np.array(kept) - 1e-6))
        impact *= self.raised[doc]
        order = np.lexsort((doc, at))
        self.item, self.impact = doc[order], impact[order]
        df = np.bincount(at)
        self.first = np.concatenate([[0], np.cumsum(df)])
        # non-essential terms: the most frequent, while every item's sum stays below half the threshold
        easy, sums = np.zeros(len(df), bool), np.zeros(n)
        for t in np.argsort(-df, kind="stable"):
            low, high = self.first[t], self.first[t + 1]
            more = self.impact[low:high] + sums[self.item[low:high]]
            if df[t] < 2 or more.max() >= score / 2:
                break
            easy[t] = True
            sums[self.item[low:high]] = more
        self.easy, self.easy_sum = easy, sums
        self.top = np.maximum.reduceat(self.impact, self.first[:-1])
        self.bound = np.where(easy, 0, self.top)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.terms[~easy] >> np.uint64(44)).astype(np.int64)] = True
        # of each term and group of items the largest impact
        self.groups = n // GROUP + 1
        self.group_key, start = np.unique(np.repeat(np.arange(len(df)), df) * self.groups + self.item // GROUP, return_index=True)
        self.group_max = np.maximum.reduceat(self.impact, start)
        self.group_first = np.searchsorted(self.group_key, np.arange(len(df) + 1) * self.groups)
        # and of each group of items the most that one gets from non-essential terms
        self.group_easy = np.zeros(self.groups)
        np.maximum.at(self.group_easy, np.arange(n) // GROUP, sums)
        # of each term's list its blocks: last item and largest impact
        blocks = -(-df // POSTINGS)
        self.block_first = np.concatenate([[0], np.cumsum(blocks)])
        start = np.repeat(self.first[:-1], blocks) + POSTINGS * (np.arange(blocks.sum()) - np.repeat(self.block_first[:-1], blocks))
        self.block_last = self.item[np.append(start[1:], len(self.item)) - 1].tolist()
        self.block_max = np.maximum.reduceat(self.impact, start).tolist()
        self.lists = self.item.tolist(), self.impact.tolist()

    def lookup(self, words: np.ndarray) -> np.ndarray:
        """Term numbers, -1 for other words."""
        t = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        return np.where(self.terms[t] == words, t, -1)

    def passages(self, words: np.ndarray, count: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(document, start, end) of the passages for which some block of items could get its share of the threshold from essential terms.

        Passages hold 2 * longest words and start every longest words, so a word lies in two of them.  Each passage's distinct essential terms
        are first summed by their largest impacts, then by their largest ones in each block.
        """
        maybe = np.flatnonzero(self.bits[(words >> np.uint64(44)).astype(np.int64)])
        t = self.lookup(words[maybe]) if len(maybe) else maybe
        maybe, t = maybe[t >= 0], t[t >= 0]
        maybe, t = maybe[~self.easy[t]], t[~self.easy[t]]
        if not len(t):
            return
        half = self.score - self.easy_sum.max(initial=0.0) - 1e-9
        n = np.maximum(1, -(-(count - self.longest) // self.longest))
        base, ends = np.cumsum(n) - n, np.cumsum(count)
        doc = np.searchsorted(ends, maybe, "right")
        k = (maybe - (ends - count)[doc]) // self.longest
        at = np.concatenate([base[doc] + np.minimum(k, n[doc] - 1), base[doc] + np.maximum(k - 1, 0)])
        pairs = np.unique(at * len(self.terms) + np.concatenate([t, t]))
        window, term = pairs // len(self.terms), pairs % len(self.terms)
        windows, which = np.unique(window, return_inverse=True)
        enough = np.bincount(which, self.bound[term]) >= half
        window, term = window[enough[which]], term[enough[which]]
        step = max(1, 4_000_000 // self.groups)
        windows = windows[enough]
        for low in range(0, len(windows), step):
            own = slice(*np.searchsorted(window, [windows[low], windows[min(low + step, len(windows)) - 1] + 1]))
            first, size = self.group_first[term[own]], np.diff(self.group_first)[term[own]]
            entry = np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)
            row = np.repeat(np.searchsorted(windows, window[own]) - low, size)
            group = self.group_key[entry] % self.groups
            part = windows[low : low + step]
            sums = np.bincount(row * self.groups + group, self.group_max[entry], len(part) * self.groups).reshape(len(part), self.groups)
            for w in part[(sums + self.group_easy).max(axis=1) >= self.score - 1e-9]:
                d = int(np.searchsorted(base, w, "right")) - 1
                start = int(ends[d] - count[d] + (w - base[d]) * self.longest)
                yield d, start, int(min(start + 2 * self.longest, ends[d]))

    def query(self, passage: np.ndarray) -> list[tuple[int, float]]:
        """All items at or above the threshold, with their shares of their own score: block-max WAND.

        A cursor for each of the passage's terms, in the order of the items that they stand at.  Largest impacts, added up in that order, come to the
        threshold at the pivot; no item before it can.  If the largest impacts of the blocks that would hold the pivot come to it as well, the
        cursors move up to the pivot and it is scored; else they skip to behind the first of those blocks to end.
        """
        least, out = self.score - 1e-9, []
        items, impacts = self.lists
        own = self.lookup(np.unique(passage))
        own = own[own >= 0]
        # item, posting, term, block, past the last posting
        cursors = [[items[f], f, x, b, e] for x, f, b, e in zip(own.tolist(), self.first[own].tolist(), self.block_first[own].tolist(), self.first[own + 1].tolist(), strict=True)]
        top = self.top

        def move(c: list, to: int) -> None:
            """To the term's first item from `to` on, past whole blocks."""
            f, b, last = self.first[c[2]], c[3], self.block_first[c[2] + 1]
            while b < last and self.block_last[b] < to:
                b += 1
            c[3] = b
            c[1] = c[4] if b == last else bisect_left(items, to, max(c[1], int(f + POSTINGS * (b - self.block_first[c[2]]))), c[4])
            c[0] = items[c[1]] if c[1] < c[4] else _GONE
            self.touched += 1

        while True:
            cursors = [c for c in cursors if c[0] != _GONE]
            cursors.sort(key=_ITEM)
            total, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                total += top[c[2]]
                if total >= least:
                    pivot = k
                    break
            if pivot < 0:
                return out
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            total, behind = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else _GONE
            for c in cursors[: pivot + 1]:
                b, last = c[3], self.block_first[c[2] + 1]
                while b < last and self.block_last[b] < item:
                    b += 1
                if b < last:
                    total += self.block_max[b]
                    behind = min(behind, self.block_last[b] + 1)
            if total < least:
                for c in cursors[: pivot + 1]:
                    if c[0] < behind:
                        move(c, behind)
            elif cursors[0][0] == item:
                score = 0.0
                for c in cursors[: pivot + 1]:
                    score += impacts[c[1]]
                    move(c, item + 1)
                if score >= least:
                    out.append((item, score / float(self.raised[item])))
            else:
                for c in cursors[:pivot]:
                    if c[0] < item:
                        move(c, item)

    def verify(self, item: int, passage: np.ndarray) -> tuple[float, float, float]:
        """Shares of the item's shingles, and of its question's and answer's words under a shared shingle, that are in the passage."""
        own = self.shingles[item]
        n = min(SHINGLE, len(self.words[item]))
        found = np.isin(own, shingle_hashes(passage, n) if len(passage) >= n else own[:0])
        if not len(own):
            return 0.0, 0.0, 0.0
        marks = np.zeros(len(self.words[item]) + 1, np.int64)
        np.add.at(marks, np.flatnonzero(found), 1)
        np.add.at(marks, np.flatnonzero(found) + n, -1)
        under = np.cumsum(marks)[:-1] > 0
        q = self.question[item]
        return float(np.isin(np.unique(own), own[found]).mean()), float(under[:q].mean()) if q else 1.0, float(under[q:].mean()) if q < len(under) else 1.0


def build(items: list[tuple[int, str]], score: float = SCORE, statistics: Statistics | None = None) -> list[Index]:
    """One index for items of up to 64 words, one for up to 128, and so on, all with the statistics of all items (these, if none are given)."""
    by: dict[int, list[tuple[int, str]]] = {}
    words = {}
    for k, (i, text) in enumerate(items):
        words[k] = _words(text or "")
        if n := len(words[k]):
            by.setdefault(max(64, 1 << (n - 1).bit_length()), []).append((i, text))
    statistics = statistics or Statistics.of([w for w in words.values() if len(w)])
    return [Index(own, longest, score, statistics) for longest, own in sorted(by.items())]


def _leaks(indexes: list[Index], texts: pa.Array) -> list[tuple[int, int, float, float, float, float]]:
    """(text, item_id, score, shares of shingles, question, answer): the best passage of each text and leaked item."""
    best: dict[tuple[int, int, int], tuple] = {}
    for i, _, words, count in word_batches(texts, MARKS):
        for k, index in enumerate(indexes):
            for doc, start, end in index.passages(words, count):
                for item, score in index.query(words[start:end]):
                    share, q, a = index.verify(item, words[start:end])
                    if share >= SHARE and q >= PART and a >= PART:
                        key = (i + doc, k, item)
                        best[key] = max(best.get(key, ()), (share, score, q, a))
    return [(doc, indexes[k].ids[item], score, share, q, a) for (doc, k, item), (share, score, q, a) in sorted(best.items())]


LEAKS = "doc_id bigint, item_id bigint, score double, shingle_share double, question_share double, answer_share double"


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [_words(t or "") for t in batch.column(0).to_pylist()]
        terms = [np.unique(w).view(np.int64) for w in words]
        offsets = pa.array(np.cumsum([0, *map(len, terms)]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int64), *terms]))), pa.array([len(w) for w in words], pa.int64())], names=["terms", "words"])


def _indexes(items: DataFrame, score: float) -> Iterator[Broadcast]:
    """The indexes of items in parts that fit in one broadcast: the number of rows and bytes is measured, and a hash deals them.

    Statistics are taken over all items once, so that it makes no difference how they are dealt.
    """
    items = items.select("item_id", "text")
    words = lambda x: x.select("text").mapInArrow(_item_terms, "terms array<bigint>, words bigint").where("words > 0")
    df = spool(words(items).select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "item_terms")
    found, total = words(items).agg(F.count(F.lit(1)), F.sum("words")).first()
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-2 * n // ITEMS) if n > ITEMS else 1, -(-2 * size // ITEM_BYTES) if size > ITEM_BYTES else 1)
    for k in range(parts):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) if parts > 1 else items
        own = df.join(words(part).select(F.explode("terms").alias("term")).distinct(), "term", "left_semi").toArrow()  # no more than the part's words
        terms, times = (np.asarray(own.column(c).combine_chunks()) for c in ("term", "df"))
        order = np.argsort(terms.view(np.uint64))
        statistics = Statistics(found, total / found if found else 0.0, terms.view(np.uint64)[order], times[order])
        yield items.sparkSession.sparkContext.broadcast(build(sorted(map(tuple, part.collect()), key=repr), score, statistics))


def leaks(docs: DataFrame, items: DataFrame, score: float = SCORE) -> DataFrame:
    """Which of items(item_id, text) the texts of docs(doc_id, text) contain: a row for each document and item.

    Passages of twice the longest item's words, one every such length, are the queries, so every item-long stretch lies within one.
    Essential terms' upper bounds, for all items and then for groups of them, leave out most passages; the others are queried by block-max
    WAND, and all items at or above the threshold are verified on their shingles, question and answer (the last sentence; an item of one sentence is all
    question).  The threshold is no higher than what a leak must reach, so retrieval loses none.  Words are runs of letters and
    digits, A-Z lower-cased; a part of an index has at most ITEMS items and ITEM_BYTES bytes and is broadcast, and further parts are
    queried in turn, with the statistics of all.  Null or empty texts and items match nothing, a long text is all its passages; no rows or items give
    no rows; repeated rows get their rows each; other columns are ignored.
    """
    found = None
    for shared in _indexes(items, score):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = _leaks(shared.value, batch.column(1))
                at, ids, scores, shares, qs, ans = zip(*hits, strict=True) if hits else ([],) * 6
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(ids, pa.int64()), *(pa.array(x, pa.float64()) for x in (scores, shares, qs, ans))], names=["doc_id", "item_id", "score", "shingle_share", "question_share", "answer_share"])

        more = docs.select("doc_id", "text").mapInArrow(run, LEAKS)
        found = more if found is None else found.unionByName(more)
    return found


def without_leaks(docs: DataFrame, items: DataFrame, score: float = SCORE) -> DataFrame:
    """The rows of docs, whatever their columns, whose text has no leaked item.  Nothing is shuffled."""
    at = docs.columns.index("text")
    for shared in _indexes(items, score):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[x[0] for x in _leaks(shared.value, batch.column(at))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
