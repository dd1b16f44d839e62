import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from helpers_llm import WORDS, edited, prose
from pyspark.sql import functions as F

from graphloom.llm import near_dedup as N
from graphloom.llm.common import components, hash_spans, same_spans, word_batches
from graphloom.llm.exact_dedup import exact_duplicates

WS = "[\x20\x09-\x0d]"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def exact_by_force(data):
    groups = defaultdict(list)
    for i, t, _ in data:
        groups[re.sub(WS, "", t or "")].append((-len(t or ""), i is None, i))
    out = []
    for i, t, _ in data:
        g = groups[re.sub(WS, "", t or "")]
        out.append((i, min(g)[2], len(g), i == min(g)[2]))
    return sorted(out, key=repr)


def test_exact(odd_docs, odd_rows, no_docs):
    found = exact_duplicates(odd_docs).select("doc_id", "keep_id", "group_size", "kept")
    assert rows(found) == exact_by_force(odd_rows)
    assert rows(exact_duplicates(no_docs)) == []


def test_exact_with_colliding_hashes(make_docs):
    data = [(i, prose(i % 3, 400) + ("." if i == 4 else ""), "a") for i in range(9)]
    weak = exact_duplicates(make_docs(data), chunk_hash=lambda c: F.length(c).cast("bigint"))
    assert rows(weak.select("doc_id", "keep_id", "group_size", "kept")) == exact_by_force(data)


def test_long_texts_become_many_chunks(odd_docs):
    assert exact_duplicates(odd_docs).where("doc_id = 10").first()["n_chunks"] > 100


def shingles(text, n):
    w = text.encode().lower().split()
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def near_by_force(data, n, percent):
    sets = [shingles(t or "", n) for _, t, _ in data]
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(data)):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if k and 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                root[find(a)] = find(b)
    least = {}
    for x, (i, _, _) in enumerate(data):
        r = find(x)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(i, least[r])
    return sorted(((i, len(sets[x]), least[find(x)], i == least[find(x)]) for x, (i, _, _) in enumerate(data)), key=repr)


def test_near_on_odd_rows(odd_docs, odd_rows, no_docs):
    for n in (2, 5):
        assert rows(N.near_duplicates(odd_docs, n)) == near_by_force(odd_rows, n, 80)
    assert rows(N.near_duplicates(no_docs)) == []


def test_near_on_families(make_docs):
    """Chains of edits, whose ends aren't similar, beside bases with many copies."""
    data, text = [], prose(100, 200)
    for i in range(40):
        data.append((i, text, "a"))
        text = edited(text, i, 5)
    for i in range(40, 120):
        data.append((i, edited(prose(i % 4, 120), i, i % 9), "a"))
    data += [(i, prose(7, 12) + " " + prose(i, 1), "a") for i in range(120, 150)]
    for n in (2, 5):
        assert rows(N.near_duplicates(make_docs(data), n)) == near_by_force(data, n, 80)


def test_near_with_weak_class_hashes(make_docs, monkeypatch, odd_docs, odd_rows):
    """Different sets under one class hash are told apart by the check."""
    strong = N._class_ids
    monkeypatch.setattr(N, "_class_ids", lambda sizes, sets: strong(sizes, sets) % np.array([3, 2**62]))
    assert rows(N.near_duplicates(odd_docs, 2)) == near_by_force(odd_rows, 2, 80)


def test_near_beside_a_large_group(make_docs):
    """300 linked copies of a text, 300 that are just below the threshold to it, and a few that only some of the copies link."""
    base, data = prose(55, 150).split(), []
    r = random.Random(9)
    for i in range(600):
        words = list(base)
        for k in r.sample(range(len(words)), r.randrange(1, 6) if i < 300 else r.randrange(9, 14)):
            words[k] = r.choice(WORDS[:40]) + "x"
        data.append((i, " ".join(words), "a"))
    for i in range(600, 620):  # as one of the copies, and further on
        words = data[i - 600][1].split()
        for k in r.sample(range(len(words)), 7):
            words[k] = r.choice(WORDS[:40]) + "y"
        data.append((i, " ".join(words), "a"))
    want = near_by_force(data, 2, 80)
    assert sum(x[2] == 0 for x in want[:600]) > 250 and len({x[2] for x in want}) > 100
    assert rows(N.near_duplicates(make_docs(data), 2)) == want


def test_differences_lose_no_link(spark, monkeypatch):
    """Every link between members of a bucket, whatever they have in common with its hub, is among those to the hub or the pairs beside it."""
    r = random.Random(10)
    for percent in (50, 80, 90):
        base = [r.getrandbits(60) for _ in range(60)]
        pool = [r.getrandbits(60) - 2**59 for _ in range(25)]
        sets = []
        for i in range(150):
            own = set(base) if i % 5 else set(r.sample(pool, 15))
            own -= set(r.sample(base, r.randrange(0, 25)))
            own |= set(r.sample(pool, r.randrange(0, 12)))
            sets.append(sorted(own or {1}))
        at = spark.createDataFrame([(1, i, 0 if i < 3 else i, 0, 3) for i in range(150)], "bucket long, class long, label long, largest long, weight long")
        frame = spark.createDataFrame(list(enumerate(sets)), "class long, shingles array<long>")
        linked, pairs = N._beside(at, frame, percent)
        found = {frozenset(x) for x in (*rows(linked), *rows(N._confirm(pairs, frame, percent)))}
        hub = linked.union(at.where("false").select("class", "class")).select("b").first()
        near = lambda a, b: 100 * len(set(sets[a]) & set(sets[b])) >= percent * len(set(sets[a]) | set(sets[b]))
        hub = hub[0] if hub else 2
        links = {frozenset((a, b)) for a in range(150) for b in range(a) if near(a, b) and not (a < 3 and b < 3)}
        beyond = {x for x in links if not all(near(k, hub) for k in x)}
        assert {x for x in links if hub in x} | beyond <= found <= links and len(beyond) > 20


def test_keep_one(make_docs, odd_docs, odd_rows):
    kept = N.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    want = {i for i, _, _, k in near_by_force(odd_rows, 5, 80) if k}
    assert sorted(x for x in ids if x is not None) == sorted(x for x in want if x is not None)
    # the nameless copy of a named text goes, one without text stays
    assert sum(x is None for x in ids) == 1
    nameless = [(None, prose(1, 50), "a"), (None, prose(1, 50), "a"), (None, edited(prose(1, 50), 1, 1), "a"), (None, prose(2, 50), "a"), (None, "", "a"), (None, None, "a")]
    assert N.keep_one(make_docs(nameless)).count() == 4


def test_estimate_follows_similarity(spark):
    rng, pairs = np.random.default_rng(1), []
    for share in (0.2, 0.5, 0.8, 0.95):
        n = 4000
        common = rng.integers(0, 2**63, int(n * share), dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**63, (n - len(common)) // 2, dtype=np.uint64)])) for _ in range(2))
        m = N.signatures(np.array([len(a), len(b)]), np.concatenate([a, b]))
        x, y = N.pack(m).tolist()
        pairs.append((x, y, len(common) / (len(a) + len(b) - len(common))))
    df = spark.createDataFrame(pairs, "x array<long>, y array<long>, j double")
    for r in df.select("j", N.estimate(F.col("x"), F.col("y")).alias("e")).collect():
        assert abs(r["j"] - r["e"]) < 0.15


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (50, 77), (5, 5), (200, 201)]
    found = dict(rows(components(spark.createDataFrame(edges, "a long, b long"))))
    assert all(found[i] == 0 for i in range(41)) and found[100] == found[77] == 50 and found[201] == 200
    assert rows(components(spark.createDataFrame([], "a long, b long"))) == []


def test_word_hashes_tell_words_apart():
    texts = ["The THE theé cat", "", None, "cat the", "a" * 3_000_000 + " cat"]
    got = []
    for _, _, h, count in word_batches(pa.array(texts)):
        at = 0
        for c in count:
            got.append(h[at : at + c].tolist())
            at += c
    assert [len(g) for g in got] == [4, 0, 0, 2, 2]
    assert got[0][0] == got[0][1] == got[3][1] != got[0][2] and got[0][3] == got[3][0] == got[4][1]


def test_word_hashes_of_texts_that_repeat():
    """Words over two letters whose sums cancel out in many a hash."""
    word = np.zeros(1, np.uint8)
    for n in range(1, 15):
        word = np.concatenate([word, 1 - word])
        body = np.concatenate([word, 1 - word, word]) + np.uint8(97)
        a, b, c = hash_spans(body, np.arange(3) * len(word), np.arange(1, 4) * len(word))
        assert a != b and a == c
        assert same_spans(body, np.array([0, 0]), body, np.array([1, 2]) * len(word), np.full(2, len(word))).tolist() == [False, True]
    r = random.Random(2)
    body = np.array([r.choice(b"ab") for _ in range(5000)], np.uint8)
    start = np.sort(np.array([r.randrange(4900) for _ in range(3000)]))
    end = np.maximum.accumulate(start + np.array([r.randrange(1, 40) for _ in range(3000)]))
    seen = {}
    for s, e, h in zip(start, end, hash_spans(body, start, end).tolist()):
        assert seen.setdefault(body[s:e].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen)
