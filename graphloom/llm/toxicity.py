"""Toxicity by a chain of linear classifiers, each fed with the earlier ones' out-of-fold probabilities."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, MARKS, hash_spans, hash_words, mix, raw_text, slices, spool

#: Labelled documents that are fitted on, at most: those with the least hashes of doc_id.
SAMPLE = 8_000
#: Beginnings of words that are features beside whole words, in bytes.
PREFIXES = (4, 5, 6, 7, 8)
#: Features that a model weighs, and the fewest fitted documents that hold each.
WORDS, HELD_BY = 400, 3
#: The least chi-squared of a feature that is weighed: one in 10,000 gets there by chance.
GAIN = 15.0
FOLDS = 4
RIDGE = 1.0
#: Spark sums ln(1 + count) in whole steps, so many a unit: the same features are chosen in whatever order rows come.
STEPS = 1 << 16


def word_features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, past the last one, text number, hash) of every word and every beginning of PREFIXES bytes of a longer word."""
    body, at = raw_text(texts)
    for i, j in slices(at):
        own = body[at[i] : at[j]]
        h, count, start, end = hash_words(own, at[i : j + 1] - at[i], MARKS)
        doc = np.repeat(np.arange(j - i), count)
        docs, hashes, low = [doc], [h], LOWER[own]
        for n in PREFIXES if len(h) else ():
            long = end - start > n
            docs.append(doc[long])
            hashes.append(mix(hash_spans(low, start[long], start[long] + n) + np.uint64(n)) if long.any() else h[:0])
        yield i, j, np.concatenate(docs), np.concatenate(hashes)


def fold_of(ids: np.ndarray, folds: int = FOLDS) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64) + np.uint64(77)) % np.uint64(folds)).astype(int)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every text: its fold, its features' distinct hashes and how often each comes."""
    for batch in batches:
        for i, j, doc, h in word_features(batch.column(1)):
            order = np.argsort(doc, kind="stable")
            ends = np.cumsum(np.bincount(doc, minlength=j - i))
            sets = [np.unique(x, return_counts=True) for x in np.split(h[order], ends[:-1])]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x, _ in sets])]).astype(np.int32))
            words, counts = (pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([x[k] for x in sets]).view(np.int64))) for k in (0, 1))
            ids = batch.column(0).slice(i, j - i)
            yield pa.RecordBatch.from_arrays([ids, pa.array(fold_of(np.asarray(ids)), pa.int32()), words, counts, *(c.slice(i, j - i) for c in batch.columns[2:])], names=["doc_id", "fold", "words", "counts", *batch.schema.names[2:]])


class Samples:
    """Documents as a sparse matrix: ln(1 + count) of each feature."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, counts: np.ndarray):
        """sizes: features of each document; words and counts: theirs, one document behind the other."""
        self.rows = len(sizes)
        self.words, self.column = np.unique(words, return_inverse=True)
        self.row = np.repeat(np.arange(self.rows), sizes)
        self.value = np.log1p(counts.astype(float))

    def dense(self, words: np.ndarray) -> np.ndarray:
        at = np.full(len(self.words) + 1, -1)
        at[np.searchsorted(self.words, words)] = np.arange(len(words))
        hit = at[self.column]
        out = np.zeros((self.rows, len(words)))
        out[self.row[hit >= 0], hit[hit >= 0]] = self.value[hit >= 0]
        return out

    def pick(self, train: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The features that correlate best with the category over the training rows."""
        own = train[self.row]
        row, column, value, k = self.row[own], self.column[own], self.value[own], len(self.words)
        n, p = train.sum(), y[train].mean()
        total, squares = np.bincount(column, value, k), np.bincount(column, value * value, k)
        spread = np.maximum(squares - total * total / n, 1e-9)
        gain = (np.bincount(column, value * y[row], k) - total * p) ** 2 / (spread * max(p * (1 - p), 1e-9))
        gain[np.bincount(column, minlength=k) < HELD_BY] = -1
        best = np.argsort(-gain, kind="stable")[:WORDS]
        return self.words[np.sort(best[gain[best] > GAIN])]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Newton's method for ridge-penalised logistic regression; the last weight is the intercept, which isn't penalised."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Between two out-of-fold probabilities, where F1 is best; 0.5 without examples."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + max(1.0, y.sum()))
    f1[:-1][p[order][1:] == p[order][:-1]] = -1
    if not y.sum():
        return 0.5
    k = int(np.argmax(f1))
    below = p[order][k + 1] if k + 1 < len(y) else 0.0
    return float((p[order][k] + below) / 2)


class Chain:
    """Fitted models in order: words, their weights, weights of earlier categories' logits, intercept, threshold."""

    def __init__(self, samples: Samples, labels: np.ndarray, ids: np.ndarray, folds: int = FOLDS, picks: list[list[np.ndarray]] | None = None):
        """picks: for each category the features of each fold's model and of the whole one, where they were chosen before."""
        fold = fold_of(ids, folds)
        earlier = np.zeros((samples.rows, 0))
        self.models = []
        for k in range(labels.shape[1]):
            y = labels[:, k].astype(float)
            held = np.full(len(y), y.mean() if len(y) else 0.0)
            for f in range(folds):
                train = fold != f
                if train.any() and not train.all() and 0 < y[train].sum() < train.sum():
                    words = samples.pick(train, y) if picks is None else picks[k][f]
                    x = np.column_stack([samples.dense(words), earlier])
                    w = fit_logistic(x[train], y[train])
                    held[~train] = 1 / (1 + np.exp(-np.clip(x[~train] @ w[:-1] + w[-1], -30, 30)))
            if 0 < y.sum() < len(y):
                words = samples.pick(np.ones(len(y), bool), y) if picks is None else picks[k][folds]
                w = fit_logistic(np.column_stack([samples.dense(words), earlier]), y)
            else:
                words, w = samples.words[:0], np.zeros(k + 1)
                w[-1] = 30.0 if len(y) and y.all() else -30.0
            self.models.append((words, w[: len(words)], w[len(words) : -1], w[-1], _best_threshold(held, y)))
            # the next category's model is trained with probabilities that no model saw the labels of
            earlier = np.column_stack([earlier, _logit(held)])
        self.held = earlier

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros((len(texts), len(self.models)))
        maps = []
        for words, *_ in self.models:
            bits = np.zeros(1 << 20, bool)
            bits[(words >> np.uint64(44)).astype(np.int64)] = True
            maps.append(bits)
        for i, j, doc, h in word_features(texts):
            slot = (h >> np.uint64(44)).astype(np.int64)
            logits = np.zeros((j - i, 0))
            for (words, weights, chained, constant, _), bits in zip(self.models, maps, strict=True):
                z = np.full(j - i, constant) + logits @ chained
                maybe = np.flatnonzero(bits[slot])
                if len(maybe):
                    at = np.minimum(np.searchsorted(words, h[maybe]), len(words) - 1)
                    hit = words[at] == h[maybe]
                    once, count = np.unique(doc[maybe[hit]] * len(words) + at[hit], return_counts=True)
                    z += np.bincount(once // len(words), weights[once % len(words)] * np.log1p(count), j - i)
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                out[i:j, logits.shape[1]] = p
                logits = np.column_stack([logits, _logit(p)])
        return out


def labelled_features(docs: DataFrame, labels: DataFrame, categories: Sequence[str], sample: int = SAMPLE) -> DataFrame:
    """doc_id, fold, words, counts and y0, y1, ... of at most `sample` labelled documents; of rows with one doc_id the one with the least text hash."""
    known = labels.where(" AND ".join(f"`{c}` IS NOT NULL" for c in ["doc_id", *categories]))
    own = known.groupBy(F.col("doc_id").alias("labelled")).agg(*[F.max(F.col(c).cast("int")).alias(f"y{k}") for k, c in enumerate(categories)])
    own = spool(own.orderBy(F.xxhash64("labelled"), "labelled").limit(sample), "labelled")
    # rows of one id meet in the tasks that read them, and one of each task in the one that chooses
    one = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text").join(F.broadcast(own), F.col("doc_id") == F.col("labelled"))
    texts = one.groupBy("doc_id").agg(F.min_by("text", F.struct("tie", "text")).alias("text"), *[F.any_value(f"y{k}").alias(f"y{k}") for k in range(len(categories))])
    found = texts.mapInArrow(_counted, "doc_id bigint, fold int, words array<bigint>, counts array<bigint>, " + ", ".join(f"y{k} int" for k in range(len(categories))))
    return spool(found, "features")


def choose(found: DataFrame, y: np.ndarray, fold: np.ndarray, folds: int = FOLDS) -> list[list[np.ndarray]]:
    """For each category, what Samples.pick takes for the model without each fold and for the one of all, from sums by feature and fold.

    found: labelled_features; y and fold: its categories and folds.  The driver gets WORDS features a model, however many there are.
    """
    out = [[np.zeros(0, np.uint64) for _ in range(folds + 1)] for _ in range(y.shape[1])]
    models = []
    for k in range(y.shape[1]):
        for f in range(folds + 1):
            own = y[fold != f, k]
            if 0 < own.sum() < len(own):
                models.append((k, f, len(own), float(own.mean())))
    if not models:
        return out
    names = [f"y{k}" for k in range(y.shape[1])]
    each = found.select("fold", *names, F.explode(F.arrays_zip("words", "counts")).alias("f"))
    each = each.select("fold", *names, F.col("f.words").alias("word"), F.round(F.log1p("f.counts") * STEPS).cast("bigint").alias("v"))
    parts = {"n": F.lit(1).cast("bigint"), "s": F.col("v"), "q": F.col("v") * F.col("v"), **{n: F.col("v") * F.col(n) for n in names}}
    sums = each.groupBy("word").agg(*[F.sum(F.when(F.col("fold") == f, x).otherwise(0)).alias(f"{n}_{f}") for n, x in parts.items() for f in range(folds)])

    def gain(k: int, f: int, n: int, p: float):
        of = lambda name: sum((F.col(f"{name}_{g}") for g in range(folds) if g != f), F.lit(0)).cast("double")
        total, squares, hits = of("s") / STEPS, of("q") / STEPS**2, of(f"y{k}") / STEPS
        spread = F.greatest(squares - total * total / n, F.lit(1e-9))
        return F.when(of("n") >= HELD_BY, F.pow(hits - total * p, F.lit(2.0)) / (spread * max(p * (1 - p), 1e-9)))

    gains = sums.select("word", F.posexplode(F.array(*[gain(*m) for m in models])).alias("model", "gain")).where(F.col("gain") > GAIN)
    best = gains.select("*", F.row_number().over(W.partitionBy("model").orderBy(F.desc("gain"), "word")).alias("place")).where(F.col("place") <= WORDS)
    best = best.select("model", "word").toArrow()  # WORDS features a model
    model, word = np.asarray(best.column("model").combine_chunks()), np.asarray(best.column("word").combine_chunks()).view(np.uint64)
    for i, (k, f, *_) in enumerate(models):
        out[k][f] = np.sort(word[model == i])
    return out


def fit(docs: DataFrame, labels: DataFrame, categories: Sequence[str], sample: int = SAMPLE) -> Chain:
    """A chain for the 0/1 columns `categories` of labels(doc_id, ...), fitted on at most `sample` labelled documents."""
    found = labelled_features(docs, labels, categories, sample)
    names = [f"y{k}" for k in range(len(categories))]
    rows = found.select("fold", *names).toArrow()  # a bounded sample, as below
    picks = choose(found, _categories(rows, names), np.asarray(rows.column("fold").combine_chunks()))
    picked = found.sparkSession.sparkContext.broadcast(np.unique(np.concatenate([x for own in picks for x in own])))

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Only the features that a model weighs."""
        for batch in batches:
            words, counts = batch.column(1), batch.column(2)
            flat = np.asarray(words.flatten()).view(np.uint64)
            keep = np.isin(flat, picked.value)
            ends = np.cumsum(np.asarray(words.value_lengths()))
            offsets = pa.array(np.concatenate([[0], np.concatenate([[0], np.cumsum(keep)])[ends]]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.asarray(x.flatten())[keep])) for x in (words, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists, *batch.columns[3:]], names=batch.schema.names)

    wanted = found.select("doc_id", "words", "counts", *names)
    rows = wanted.mapInArrow(narrow, wanted.schema).toArrow().sort_by("doc_id")
    own = {n: rows.column(n).combine_chunks() for n in ("doc_id", "words", "counts")}
    flat = [np.asarray(own[n].flatten()) for n in ("words", "counts")]
    samples = Samples(np.asarray(own["words"].value_lengths()), flat[0].view(np.uint64), flat[1])
    return Chain(samples, _categories(rows, names), np.asarray(own["doc_id"]), picks=picks)


def _categories(rows: pa.Table, names: Sequence[str]) -> np.ndarray:
    return np.column_stack([np.asarray(rows.column(n).combine_chunks()) for n in names])


def toxicity(docs: DataFrame, labels: DataFrame, categories: Sequence[str] = ("toxic",), sample: int = SAMPLE) -> DataFrame:
    """doc_id, and for each category c p_c (double) and c (boolean), of every row of docs(doc_id, text).

    A model weighs ln(1 + count) of the words and word beginnings that tell its category best, and the logits of the categories before it, which in training
    are out-of-fold ones.  A category holds from the probability on at which out-of-fold F1 is best.  A null or empty text has no words, a text of any
    length all its words.  Without labelled documents, or with labels all alike, every document is like them (not in the category if there are none).
    A row of labels with a null counts for nothing; of one that comes more than once the greatest counts.  Repeated rows score alike, and of rows that
    share a labelled id one is learned from; no rows give no rows.  Columns beyond those named are ignored.
    """
    chain = fit(docs, labels, categories, sample)
    shared = docs.sparkSession.sparkContext.broadcast(chain.models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Chain.__new__(Chain)
        fitted.models = shared.value
        for batch in batches:
            p = fitted.probabilities(batch.column(1))
            columns = [x for k, m in enumerate(fitted.models) for x in (pa.array(p[:, k]), pa.array(p[:, k] >= m[-1]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    names = ["doc_id", *(x for c in categories for x in (f"p_{c}", c))]
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, " + ", ".join(f"`p_{c}` double, `{c}` boolean" for c in categories))
