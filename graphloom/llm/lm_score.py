"""Language-model scores by deleted interpolation of word-pair, word and uniform estimates.

Counts and look-ups travel as sorted runs of hashes: each chunk of documents asks once for every distinct word and pair that it holds, hash ranges
add up the training counts of all chunks, and each chunk gets its answers back in the order in which it asked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_words, mix, pair_hash, partitions, raw_text, slices, spool

#: Bytes of text in a chunk, about, and of all chunks' words and pairs so many in a hash range at most, about.
CHUNK, RANGE = 1 << 23, 1 << 22
#: Context counts are bucketed by their binary logarithm.
CONTEXTS = 40
#: Held-out tokens are summed in so many classes per octave of each estimate.
FINE = 2
ROUNDS = 60
#: The hash of the end token, which is also the context of a first word.
END = mix(np.array([0x0D0E0A0D], np.uint64))[0]


def held_out(doc_id: Column) -> Column:
    """Whether the crc32 of the id as text leaves 2 when divided by 7; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _pairs(words: np.ndarray, stream: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each token the hash of it with the one before, and where that one is (the end token at a document's start)."""
    before = np.empty_like(stream)
    before[1:] = stream[:-1]
    ends = np.cumsum(lengths)
    before[ends - lengths] = np.searchsorted(words, END)
    return pair_hash(words[before], words[stream]), before


_CODEC = pa.Codec("zstd", compression_level=1)


def squeeze(values: np.ndarray) -> bytes:
    """Integers, compressed byte plane by byte plane: the high bytes are as good as all alike."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return len(values).to_bytes(8, "little") + (_CODEC.compress(planes.tobytes(), asbytes=True) if len(values) else b"")


def expand(blob: bytes, kind: str) -> np.ndarray:
    n, size = int.from_bytes(blob[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(_CODEC.decompress(blob[8:], n * size, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


def squeeze_keys(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def expand_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(expand(blob, "<u8"))


CHUNKS = "chunk bigint, held boolean, words binary, ranks binary, stream binary, doc_ids array<bigint>, lengths array<int>"


def _chunk(number: int, held: bool, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """A chunk's distinct words in order, each one's rank by frequency, and its tokens as ranks."""
    body, at = raw_text(texts)
    h, count, _, _ = hash_words(body, at)
    lengths = count + 1
    tokens = np.full(len(h) + len(count), END, np.uint64)
    inner = np.ones(len(tokens), bool)
    inner[np.cumsum(lengths) - 1] = False
    tokens[inner] = h
    words, stream, often = np.unique(tokens, return_inverse=True, return_counts=True)
    ranks = np.empty(len(words), "<u4")
    ranks[np.argsort(-often, kind="stable")] = np.arange(len(words))
    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, pa.array(lengths.astype(np.int32)))]
    blobs = [squeeze_keys(words), squeeze(ranks), squeeze(ranks[stream])]
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([held]), *(pa.array([x], pa.binary()) for x in blobs), *lists], names=["chunk", "held", "words", "ranks", "stream", "doc_ids", "lengths"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of held-out documents and of others."""
    number = TaskContext.get().partitionId() << 32
    waiting: dict[bool, list] = {flag: [0, [], []] for flag in (False, True)}

    def flush(flag: bool) -> Iterator[pa.RecordBatch]:
        nonlocal number
        _, ids, texts = waiting[flag]
        waiting[flag] = [0, [], []]
        if ids:
            number += 1
            yield _chunk(number, flag, pa.concat_arrays(ids), pa.concat_arrays(texts))

    for batch in batches:
        held = batch.column(2).fill_null(False)
        for flag in (False, True):
            own = batch.filter(held if flag else pa.compute.invert(held))
            texts = own.column(1).fill_null("")
            _, at = raw_text(texts)
            for i, j in slices(at, CHUNK):
                w = waiting[flag]
                w[0] += int(at[j] - at[i])
                w[1].append(own.column(0).slice(i, j - i))
                w[2].append(texts.slice(i, j - i))
                if w[0] >= CHUNK:
                    yield from flush(flag)
    for flag in (False, True):
        yield from flush(flag)


class Tokens:
    """A chunk unpacked: distinct words, tokens as places among them, pairs of neighbours."""

    def __init__(self, row: dict):
        self.ids, self.lengths = row["doc_ids"], np.array(row["lengths"], np.int64)
        self.words = expand_keys(row["words"])
        ranks = expand(row["ranks"], "<u4")
        place = np.empty(len(ranks), np.int64)
        place[ranks] = np.arange(len(ranks))
        self.stream = place[expand(row["stream"], "<u4")]
        self.pairs, self.before = _pairs(self.words, self.stream, self.lengths)


QUESTIONS = "chunk bigint, part bigint, kind int, keys binary, counts binary"


def _questions(parts: int):
    """Of a chunk: its sorted distinct words (kind 0) and pairs (kind 1) by hash range, with their counts unless it is held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.uint64(65 - parts.bit_length())
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                t = Tokens(row)
                for kind, (keys, n) in enumerate(((t.words, np.bincount(t.stream, minlength=len(t.words))), np.unique(t.pairs, return_counts=True))):
                    some, first = np.unique((keys >> shift) if parts > 1 else np.zeros(len(keys), np.uint64), return_index=True)
                    own = [slice(a, b) for a, b in zip(first, [*first[1:], len(keys)], strict=True)]
                    columns = [pa.array(np.full(len(some), row["chunk"])), pa.array(some.astype(np.int64)), pa.array(np.full(len(some), kind, np.int32)), pa.array([squeeze_keys(keys[x]) for x in own], pa.binary()), pa.array([None if row["held"] else squeeze(n[x].astype("<i8")) for x in own], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["chunk", "part", "kind", "keys", "counts"])

    return run


ANSWERS = "chunk bigint, part bigint, kind int, answers binary, known bigint, total bigint"


def _add_up(table: pa.Table) -> pa.Table:
    """Of one hash range: the training count of every key that a chunk asked for, and, as chunk -1, how many words and tokens there are."""
    out: dict[str, list] = {n: [] for n in ("chunk", "part", "kind", "answers", "known", "total")}
    part = table.column("part")[0].as_py()

    def add(*row) -> None:
        for n, x in zip(out, row, strict=True):
            out[n].append(x)

    for kind in (0, 1):
        own = table.filter(pa.compute.equal(table.column("kind"), kind))
        if not own.num_rows:
            continue
        keys = [expand_keys(x.as_py()) for x in own.column("keys")]
        counts = [expand(x.as_py(), "<i8") if x.is_valid else np.zeros(len(k), np.int64) for k, x in zip(keys, own.column("counts"), strict=True)]
        distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, which, np.concatenate(counts))
        for chunk, k, end in zip(own.column("chunk").to_pylist(), keys, np.cumsum([len(k) for k in keys]), strict=True):
            add(chunk, part, kind, squeeze(total[which[end - len(k) : end]]), None, None)
        add(-1, part, kind, None, int((total > 0).sum()), int(total.sum()))
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
    return pa.table([pa.array(x, k) for x, k in zip(out.values(), kinds, strict=True)], names=list(out))


class Resolved(Tokens):
    """A chunk's tokens with the training counts of the word, of the word before it, and of the pair."""

    def __init__(self, tokens: pa.Table, answers: pa.Table):
        super().__init__(tokens.to_pylist()[0])
        by: dict[int, list[tuple[int, bytes]]] = {0: [], 1: []}
        for part, kind, answer in zip(*(answers.column(c).to_pylist() for c in ("part", "kind", "answers")), strict=True):
            by[kind].append((part, answer))
        counts = [np.concatenate([np.zeros(0, np.int64), *(expand(a, "<i8") for _, a in sorted(by[k]))]) for k in (0, 1)]
        _, which = np.unique(self.pairs, return_inverse=True)
        self.word, self.context, self.pair = counts[0][self.stream], counts[0][self.before], counts[1][which]


def context_class(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(count.astype(float))[1], CONTEXTS - 1)


def _classes(p: np.ndarray) -> np.ndarray:
    """Class of a probability, 0 for 0."""
    return np.where(p > 0, 1 + np.minimum(62 * FINE, np.floor(-np.log2(np.where(p > 0, p, 1)) * FINE).astype(np.int64)), 0)


def _gather(train_tokens: int):
    """Of a held-out chunk: tokens by context class and by the classes of both estimates, with the sums of the estimates' logarithms."""

    def run(tokens: pa.Table, answers: pa.Table) -> pa.Table:
        r = Resolved(tokens, answers)
        p2 = np.where(r.context > 0, r.pair / np.maximum(1, r.context), 0.0)
        p1 = r.word / max(1, train_tokens)
        cell = (context_class(r.context) * 256 + _classes(p2)) * 256 + _classes(p1)
        cells, which = np.unique(cell, return_inverse=True)
        sums = [np.bincount(which, np.log(np.where(p > 0, p, 1.0)), len(cells)) for p in (p2, p1)]
        return pa.table({"cell": cells, "n": np.bincount(which, minlength=len(cells)), "log2": sums[0], "log1": sums[1]})

    return run


def learn_mixture(cells: list[tuple[int, int, float, float]], vocabulary: int) -> np.ndarray:
    """Weights of the pair, word and uniform estimates by context class, by expectation-maximisation on held-out counts.

    A class starts from, and with the weight of one token leans on, the weights of all classes together; those start equal.
    """
    weights = np.tile(np.full(3, 1 / 3), (CONTEXTS, 1))
    if not cells:
        return weights
    cell, n = np.array([c[0] for c in cells]), np.array([c[1] for c in cells], float)
    has2, has1 = cell // 256 % 256 > 0, cell % 256 > 0
    p = np.column_stack([np.where(has2, np.exp(np.array([c[2] for c in cells]) / n), 0), np.where(has1, np.exp(np.array([c[3] for c in cells]) / n), 0), np.full(len(n), 1 / (vocabulary + 1))])
    context = cell // 65536

    def improve(start: np.ndarray, at: np.ndarray, size: int, prior: np.ndarray) -> np.ndarray:
        w = start
        for _ in range(ROUNDS):
            share = w[at] * p
            share *= (n / share.sum(axis=1))[:, None]
            got = np.column_stack([np.bincount(at, share[:, k], size) for k in range(3)]) + prior
            w = got / got.sum(axis=1, keepdims=True)
        return w

    overall = improve(weights[:1], np.zeros(len(n), np.int64), 1, np.full((1, 3), 1e-3))
    return improve(np.tile(overall, (CONTEXTS, 1)), context, CONTEXTS, np.tile(overall, (CONTEXTS, 1)))


def _score(weights: np.ndarray, known: int, total: int):
    def run(tokens: pa.Table, answers: pa.Table) -> pa.Table:
        r = Resolved(tokens, answers)
        starts = np.cumsum(r.lengths) - r.lengths
        per_doc = lambda x: np.add.reduceat(x, starts)
        base = np.log10((r.word + 1) / (total + known + 1))
        w = weights[context_class(r.context)]
        p = w[:, 0] * r.pair / np.maximum(1, r.context) + w[:, 1] * r.word / max(1, total) + w[:, 2] / (known + 1)
        # a context never seen has no pairs: its pair weight goes to the other estimates in proportion
        rest = w[:, 1] + w[:, 2]
        p = np.where(r.context > 0, p, p / rest)
        return pa.table({"doc_id": pa.array(r.ids, pa.int64()), "held_out": pa.array(np.full(len(r.ids), tokens.column("held")[0].as_py())), "n_tokens": r.lengths, "n_known": per_doc((r.word > 0).astype(np.int64)), "train_tokens": pa.array(np.full(len(r.ids), total, np.int64)), "base_score": per_doc(base), "score": per_doc(np.log10(p))})

    return run


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def ranges(tokens: int, partitions: int) -> int:
    """Hash ranges, a power of 2, for so many tokens: each asks for a word and a pair at most, so a range's task holds as much at every input size."""
    return 1 << (max(partitions, -(-2 * tokens // RANGE)) - 1).bit_length()


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs(doc_id, text).

    Tokens are words, A-Z lower-cased, then one end.  Documents that aren't held out are counted: words and pairs of neighbours (a first word's
    neighbour is the end).  A token's probability mixes the maximum-likelihood estimates of its pair and of itself and one over the vocabulary and
    one; how, depends on how often its context was seen, by binary order, and is learned on the held-out documents, with no estimate of their own.
    base_score is the log10 probability under add-one word counts, score that under the mixture.

    Pairs and words are told apart by 64-bit hashes.  A null or empty text is an end alone.  A long text is a chunk of its own, of no more tokens than
    an Arrow list has (2 ** 31).  Without held-out documents all estimates weigh a third; no rows give no rows.  Repeated rows count and
    score once each; columns beyond doc_id and text are ignored.
    """
    spark = docs.sparkSession
    tokens = spool(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held")).mapInArrow(_chunks, CHUNKS), "chunks", "uncompressed")
    parts = ranges(tokens.agg(F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)), F.lit(0))).first()[0], partitions(spark))
    asked = tokens.mapInArrow(_questions(parts), QUESTIONS)
    answers = spool(asked.groupBy("part").applyInArrow(_add_up, ANSWERS), "answers")
    known, total = answers.where("chunk = -1 AND kind = 0").agg(F.coalesce(F.sum("known"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    answers = answers.where("chunk >= 0").select("chunk", "part", "kind", "answers")

    held = tokens.where("held")
    own = answers.join(held.select("chunk").distinct(), "chunk", "left_semi")
    cells = held.groupBy("chunk").cogroup(own.groupBy("chunk")).applyInArrow(_gather(total), "cell bigint, n bigint, log2 double, log1 double")
    cells = cells.groupBy("cell").agg(F.sum("n"), F.sum("log2"), F.sum("log1"))
    weights = learn_mixture([tuple(r) for r in cells.collect()], known)  # CONTEXTS * 125 ** 2 rows at most
    return tokens.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score(weights, known, total), SCORES)
