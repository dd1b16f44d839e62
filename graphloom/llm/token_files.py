"""Token ids in fixed-width bit-packed blocks.

A token file is a Parquet dataset of blocks.  Each block holds whole documents, about BLOCK ids or one longer document, in as many bits an
id as the vocabulary needs; its row says which shard it is in, where it starts and how the documents lie in it, so that any document's
ids are unpacked from one block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import hash_spans, partitions, raw_text, same_spans, shared_dir, slices, spool

BLOCK = 1 << 16
END = 2
VOCABULARY = "byte_bpe_50k.json"

#: So many pieces of text, and so many bytes of them, keep their ids; then the store starts anew.
_KEPT, _KEPT_BYTES = 1_500_000, 64 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: bytes that may be, or begin, other white space
_MAYBE_ODD = np.zeros(256, bool)
_MAYBE_ODD[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids, each below 2 ** bits, as one string of bits, the lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    rows = ((ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(rows.ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, first: int, count: int) -> np.ndarray:
    """ids first to first + count of a packed block; reads no more than the bytes that hold them."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", count, first * (bits // 8)).astype(np.uint32)
    start, end = first * bits, (first + count) * bits
    low = start // 8
    flat = np.unpackbits(np.frombuffer(payload, np.uint8)[low : (end + 7) // 8], bitorder="little")[start - 8 * low : end - 8 * low]
    return (flat.reshape(count, bits) @ (1 << np.arange(bits, dtype=np.int64))).astype(np.uint32)


def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _odd_space(body: np.ndarray) -> np.ndarray:
    """The places, ascending, where a byte is, or begins, white space other than space, tab, line feed, vertical tab, form feed and carriage return."""
    at = np.flatnonzero(_MAYBE_ODD[body])
    # a character of several bytes doesn't end behind the texts
    b, c, d = body[at], np.take(body, at + 1, mode="clip"), np.take(body, at + 2, mode="clip")
    low = (b >= 0x1C) & (b <= 0x1F) | (b == 0xC2) & ((c == 0x85) | (c == 0xA0))
    three = (b == 0xE1) & (c == 0x9A) & (d == 0x80) | (b == 0xE2) & (c == 0x80) & ((d <= 0x8A) | (d == 0xA8) | (d == 0xA9) | (d == 0xAF)) | (b == 0xE2) & (c == 0x81) & (d == 0x9F) | (b == 0xE3) & (c == 0x80) & (d == 0x80)
    return at[low | three]


def piece_starts(body: np.ndarray, at: np.ndarray, odd: np.ndarray, added: Sequence[bytes] = ()) -> np.ndarray:
    """Where texts may be cut without changing any token, and where they start.

    The tokenizer cuts before a single space or line feed between other characters, and behind such a line feed.  A text with white space of
    other kinds (at the places odd), or with one of the tokens added to the vocabulary, stays whole.
    """
    space = _SPACE[body]
    inner = np.zeros(len(body), bool)
    inner[1:-1] = space[1:-1] & ~space[:-2] & ~space[2:]
    full = at[1:] > at[:-1]
    inner[at[:-1][full]] = False
    inner[at[1:][full] - 1] = False
    cut = inner & ((body == 32) | (body == 10))
    cut[1:] |= (inner & (body == 10))[:-1]
    for i in np.unique(np.searchsorted(at, odd, "right") - 1):
        cut[at[i] : at[i + 1]] = False
    own = body.tobytes() if added else b""
    for token in added:
        found = own.find(token)
        while found >= 0:
            i = int(np.searchsorted(at, found, "right")) - 1
            cut[at[i] : at[i + 1]] = False
            found = own.find(token, int(at[i + 1]))
    cut[at[:-1][full]] = True
    return np.flatnonzero(cut)


class Column:
    """An array that grows at its end; its room doubles, so that appending costs what is appended."""

    def __init__(self, kind: type):
        self.room, self.n = np.zeros(1024, kind), 0

    def append(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.room):
            self.room = np.concatenate([self.room[: self.n], np.zeros(self.n + 2 * len(values), self.room.dtype)])
        self.room[self.n : self.n + len(values)] = values
        self.n += len(values)

    @property
    def values(self) -> np.ndarray:
        return self.room[: self.n]


class Encoder:
    """Encodes texts by their pieces; a piece's bytes and ids are kept for the next time it comes."""

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self._reset()

    def _reset(self) -> None:
        # hashes in order, and each one's place in the columns: those kept for long, and those that came since
        self.old, self.new = ((np.zeros(0, np.uint64), np.zeros(0, np.int64)) for _ in range(2))
        self.flat, self.starts, self.long = Column(np.uint32), Column(np.int64), Column(np.int64)  # ids
        self.bytes, self.at, self.size = Column(np.uint8), Column(np.int64), Column(np.int64)  # the pieces themselves

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for a new one."""
        out = np.full(len(keys), -1)
        for known, slot in (self.old, self.new):
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at] == keys
                out[hit] = slot[at[hit]]
        return out

    def _keep(self, keys: np.ndarray, slots: np.ndarray) -> None:
        at = np.searchsorted(self.new[0], keys)
        self.new = np.insert(self.new[0], at, keys), np.insert(self.new[1], at, slots)
        if len(self.new[0]) > max(20_000, len(self.old[0]) // 4):
            at = np.searchsorted(self.old[0], self.new[0])
            self.old = np.insert(self.old[0], at, self.new[0]), np.insert(self.old[1], at, self.new[1])
            self.new = self.new[0][:0], self.new[1][:0]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one behind the other, and how many each text has."""
        body, at = raw_text(texts)
        out = [self._encode(body[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in slices(at)]
        return np.concatenate([np.zeros(0, np.uint32), *(x for x, _ in out)]), np.concatenate([np.zeros(0, np.int64), *(n for _, n in out)])

    def _encode(self, body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(body):
            return np.zeros(0, np.uint32), np.zeros(len(at) - 1, np.int64)
        odd = _odd_space(body)
        start = piece_starts(body, at, odd, [t.encode() for t in self.added])
        end = np.append(start[1:], len(body))
        if self.starts.n > _KEPT or self.bytes.n > _KEPT_BYTES:
            self._reset()
        keys, first, which = np.unique(hash_spans(body, start, end), return_index=True, return_inverse=True)
        slot = self._find(keys)
        fresh = np.flatnonzero(slot < 0)
        if len(fresh):
            slot[fresh] = np.arange(self.starts.n, self.starts.n + len(fresh))
            self._add(body, odd, start[first[fresh]], end[first[fresh]])
            self._keep(keys[fresh], slot[fresh])
        each = slot[which]
        # a piece counts as known only if its bytes are those kept
        same = self.size.values[each] == end - start
        same[same] = same_spans(body, start[same], self.bytes.values, self.at.values[each[same]], (end - start)[same])
        other = np.flatnonzero(~same)
        if len(other):
            each[other] = np.arange(self.starts.n, self.starts.n + len(other))
            self._add(body, odd, start[other], end[other])
        long = self.long.values[each]
        total = np.concatenate([[0], np.cumsum(long)])
        ids = self.flat.values[np.arange(total[-1]) - np.repeat(total[:-1] - self.starts.values[each], long)]
        return ids, np.diff(total[np.searchsorted(start, at)])

    def _add(self, body: np.ndarray, odd: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Plain pieces, a word or a space and a word, are encoded a thousand at once, line feeds between them: a line feed is then a token of its own."""
        own = body.tobytes()
        found = [own[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True)]
        sizes = end - start
        self.at.append(self.bytes.n + np.cumsum(sizes) - sizes)
        self.size.append(sizes)
        self.bytes.append(np.frombuffer(b"".join(found), np.uint8))
        blank = _SPACE[body]
        blank[odd] = True
        before = np.concatenate([[0], np.cumsum(blank)])
        lone = (before[end] == before[start + 1]) & ((body[start] == 32) & (sizes > 1) | (before[start + 1] == before[start]))
        if len(self.line) != 1:
            lone[:] = False
        for token in [t.encode() for t in self.added]:
            if token in own:
                lone &= np.array([token not in p for p in found])
        plain, rest = np.flatnonzero(lone).tolist(), np.flatnonzero(~lone).tolist()
        text = lambda p: p.decode("utf-8", "replace")
        order, ids, long = [], [], []
        runs = [plain[k : k + 1000] for k in range(0, len(plain), 1000)]
        for run, got in zip(runs, self.tokenizer.encode_batch_fast([text(b"\n".join([found[i] for i in r])) for r in runs], add_special_tokens=False), strict=True):
            flat = np.array(got.ids, np.uint32)
            lines = flat == self.line[0]
            at = np.concatenate([[-1], np.flatnonzero(lines), [len(flat)]])
            if len(at) == len(run) + 1:
                order += run
                ids.append(flat[~lines])
                long.append(np.diff(at) - 1)
            else:
                rest += run
        for i, got in zip(rest, self.tokenizer.encode_batch_fast([text(found[i]) for i in rest], add_special_tokens=False), strict=True):
            order.append(i)
            ids.append(np.array(got.ids, np.uint32))
            long.append(np.array([len(got.ids)]))
        size = np.concatenate(long)
        start = self.flat.n + np.cumsum(size) - size
        back = np.argsort(np.array(order))
        self.starts.append(start[back])
        self.long.append(size[back])
        self.flat.append(np.concatenate(ids))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each vocabulary in a worker process, so that its later tasks find pieces already encoded."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


BLOCKS = "shard int, block int, start bigint, n_ids bigint, bits int, doc_ids array<bigint>, lengths array<int>, payload binary"


def _blocks(path: str, end: int, block: int):
    """In each task: the documents' ids in order, in blocks; start counts from the shard's first id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        bits = bits_for(max(own.tokenizer.get_vocab_size(), end + 1))
        number, start, waiting = 0, 0, 0
        docs, lengths, held = [], [], []

        def flush(shard: int) -> pa.RecordBatch:
            nonlocal number, start, waiting, docs, lengths, held
            ids = np.concatenate(held)
            lists = [pa.concat_arrays(docs), pa.array(np.concatenate(lengths).astype(np.int32))]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
            row = [*(pa.array([x], f.type) for x, f in zip((shard, number, start, len(ids), bits), _SCHEMA, strict=False)), *lists, pa.array([pack(ids, bits)], pa.binary())]
            number, start, waiting, docs, lengths, held = number + 1, start + len(ids), 0, [], [], []
            return pa.RecordBatch.from_arrays(row, schema=_SCHEMA)

        shard = -1
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                shard = part.column(2)[0].as_py()
                ids, count = own.encode(part.column(1))
                at = np.concatenate([[0], np.cumsum(count)])
                # every document's ids and the end behind them
                whole = np.full(at[-1] + len(count), end, np.uint32)
                inner = np.ones(len(whole), bool)
                inner[at[1:] + np.arange(len(count))] = False
                whole[inner] = ids
                ends, done = at[1:] + np.arange(1, len(count) + 1), 0
                while done < len(count):
                    # documents up to the one that fills the block
                    base = ends[done - 1] if done else 0
                    upto = min(int(np.searchsorted(ends, base + block - waiting)) + 1, len(count))
                    docs.append(part.column(0).slice(done, upto - done))
                    lengths.append(count[done:upto] + 1)
                    held.append(whole[base : ends[upto - 1]])
                    waiting, done = waiting + int(ends[upto - 1] - base), upto
                    if waiting >= block:
                        yield flush(shard)
        if docs:
            yield flush(shard)

    return run


_SCHEMA = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("bits", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("payload", pa.binary())])


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end: int = END, block: int = BLOCK) -> None:
    """Write the ids of docs(doc_id, text) as blocks at path, in ascending order of doc_id (null first; then by text).

    vocabulary: the place of a tokenizer's file.  Each document's ids, of its whole text and none for null, are followed by end.
    Ranges of doc_id are the shards, each in a task of its own; rows of one id spread over shards by their text's hash, in that order.
    """
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    rows = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    rows = rows.select("doc_id", "text", F.spark_partition_id().alias("shard"))
    rows.mapInArrow(_blocks(vocabulary, end, block), BLOCKS).write.option("compression", "zstd").parquet(path)


def shard_starts(blocks: DataFrame) -> DataFrame:
    """shard, base: the ids in all shards before it.  One row a shard."""
    each = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return each.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, int, int]]:
    """Of each block of a batch of BLOCKS: doc_ids, where each document's ids end, all ids, shard and start."""
    columns = {n: batch.column(n) for n in batch.schema.names}
    for i in range(batch.num_rows):
        bits, n, shard, start = (columns[c][i].as_py() for c in ("bits", "n_ids", "shard", "start"))
        ends = np.cumsum(columns["lengths"][i].values.to_numpy(zero_copy_only=False), dtype=np.int64)
        yield columns["doc_ids"][i].values, ends, unpack(columns["payload"][i].as_buffer(), bits, 0, n), shard, start


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for docs, ends, ids, shard, start in _unpacked(batch):
            lengths = np.diff(ends, prepend=0)
            body = memoryview(ids.astype("<u4").view(np.uint8))
            crc = [zlib.crc32(body[4 * s : 4 * e]) for s, e in zip(ends - lengths, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([docs, pa.array(np.full(len(lengths), shard, np.int32)), pa.array(ends - lengths + start), pa.array(lengths), pa.array(crc, pa.int64())], names=["doc_id", "shard", "at", "n_tokens", "ids_crc32"])


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for docs, ends, ids, _, _ in _unpacked(batch):
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([docs, pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int64)))], names=["doc_id", "ids"])


def read_tokens(blocks: DataFrame) -> DataFrame:
    """doc_id and ids of every document in blocks, which may be any rows of a token file."""
    return blocks.mapInArrow(_ids, "doc_id bigint, ids array<bigint>")


def token_digests(docs: DataFrame, vocabulary: str, end: int = END, block: int = BLOCK, path: str | None = None) -> DataFrame:
    """Write the token file of docs, read it back: doc_id, start, n_tokens, ids_crc32 of every document in it.

    start: the ids of all documents before it.  A null or empty text has the end id alone; a long text is in one block; rows of one doc_id lie in
    the order of their text's hash, equal ones next to each other; null ids come first; no rows give no rows.  Columns beyond doc_id and text are ignored.
    """
    import uuid

    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/graphloom/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, vocabulary, end, block)
    blocks = spark.read.schema(BLOCKS).parquet(path)
    base = spool(shard_starts(blocks), "shards").select(F.col("shard").alias("s"), "base")
    rows = blocks.mapInArrow(_digests, "doc_id bigint, shard int, at bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(base, F.col("shard") == F.col("s")).select("doc_id", (F.col("at") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")
