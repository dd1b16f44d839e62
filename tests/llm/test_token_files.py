import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers_llm import prose
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm import token_files as T
from graphloom.llm.queries import vocabulary

PATH = vocabulary(T.VOCABULARY)
ODD = ["", " ", "a  b\n\n c", "x\u00a0 y z", "a \u2003 b c", "it's  he's 's\n's \ts", "\n", "end \n", "a\n b", "tab\there", "<|endoftext|> hi", "e\u0301 \U0001f600 x\x1f y", "a\r\nb c ", 'don\'t "q" 12 3', "“quoted” – x …", "a\n\nb", " \n x", "\u3000", "a \n b", "ab\x0bcd ef"]


LIBRARY = Tokenizer.from_file(PATH)


def plain(text):
    """What the library's plain call gives."""
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_pieces_change_nothing():
    e = T.Encoder(PATH)
    texts = ODD + [prose(k, 50) for k in range(20)] + ODD
    for _ in range(2):
        ids, count = e.encode(pa.array(texts))
        want = [plain(t) for t in texts]
        assert count.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def test_added_tokens_as_the_library_reads_them():
    """A text that spells an added token has that token's id, as by a plain call of the library."""
    library, e = LIBRARY, T.Encoder(PATH)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y", "a b\n<|endoftext|>\nc d", "a  <|endoftext|>  b \n", "a b <|endo", "ftext|> c d", "<|endoftext|><|endoftext|> a b", "", *[f"w{k} <|endoftext|>" for k in range(30)], prose(1, 40) + " <|endoftext|> " + prose(2, 40), prose(3, 40)]
    for _ in range(2):
        ids, count = e.encode(pa.array(texts))
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert count.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])
    assert e.encode(pa.array(texts[:1]))[0].tolist() == [64, 220, 50256, 275]


@pytest.mark.parametrize("bits", [1, 7, 8, 15, 16, 17, 31])
def test_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1000).astype(np.uint32)
    packed = T.pack(ids, bits)
    assert len(packed) == (1000 * bits + 7) // 8
    assert (T.unpack(packed, bits, 0, 1000) == ids).all() and (T.unpack(packed, bits, 333, 5) == ids[333:338]).all()
    assert len(T.unpack(packed, bits, 7, 0)) == 0


def test_round_trip(spark, odd_docs, odd_rows, no_docs, tmp_path):
    digests = T.token_digests(odd_docs, PATH, block=1000, path=f"file://{tmp_path}/t").orderBy("start").collect()
    assert [r.doc_id for r in digests] == sorted((i for i, _, _ in odd_rows), key=lambda i: (i is not None, i or 0))
    at = 0
    want = {}
    for i, t, _ in odd_rows:
        ids = [*plain(t), T.END]
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for r in digests:
        assert r.start == at
        at += r.n_tokens
        want[r.doc_id].remove((r.n_tokens, r.ids_crc32))
    blocks = spark.read.schema(T.BLOCKS).parquet(f"file://{tmp_path}/t")
    assert {tuple(r) for r in blocks.select("bits").distinct().collect()} == {(16,)}
    some = T.read_tokens(blocks.where(F.array_contains("doc_ids", 12))).where("doc_id = 12").first()
    assert some["ids"] == [*plain("éß \U0001f600 x"), T.END]
    assert T.token_digests(no_docs, PATH).collect() == []


def thue_morse(n):
    word = "a"
    for _ in range(n):
        word += word.translate({97: "b", 98: "a"})
    return word


def test_words_that_many_hashes_confuse():
    """Words of 2 ** 10 to 2 ** 14 letters and the same with both letters swapped: sums of powers tend to give both one hash."""
    e = T.Encoder(PATH)
    words = [w for n in range(10, 15) for w in (thue_morse(n), thue_morse(n).translate({97: "b", 98: "a"}))]
    for texts in (words, [" x ".join(words), *reversed(words)]):
        ids, count = e.encode(pa.array(texts))
        want = [plain(t) for t in texts]
        assert count.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def test_pieces_with_one_hash(monkeypatch):
    """Ids are those of a piece's own bytes, whatever its hash."""
    strong = T.hash_spans
    monkeypatch.setattr(T, "hash_spans", lambda *a: strong(*a) % np.uint64(40))
    e = T.Encoder(PATH)
    texts = ODD + [prose(k, 60) for k in range(8)] + ODD
    for _ in range(2):
        ids, count = e.encode(pa.array(texts))
        want = [plain(t) for t in texts]
        assert count.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])
