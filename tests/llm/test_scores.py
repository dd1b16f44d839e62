import math
import random
import re
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
from helpers_llm import prose
from pyspark.sql import functions as F

from graphloom.llm import lm_score as L
from graphloom.llm import quality as Q
from graphloom.llm import toxicity as T


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


@pytest.fixture(scope="module")
def scored(odd_docs):
    return L.lm_scores(odd_docs).collect()


def test_lm_base_by_force(odd_rows, scored):
    count = Counter()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    for i, t, _ in odd_rows:
        if not held(i):
            count.update(tokens(t))
    n, v = sum(count.values()), len(count)
    want = sorted(((i, held(i), len(tokens(t)), sum(count[x] > 0 for x in tokens(t)), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in tokens(t)), 6)) for i, t, _ in odd_rows), key=repr)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in scored), key=repr) == want


def test_lm_mixture_by_force(make_docs):
    """The score is the mixture of three estimates with the learned weights; with many documents it beats the base on held-out ones."""
    data = [(i, prose(i % 40, 60) + " " + prose(1000 + i, 20), "a") for i in range(200)]
    found = {r.doc_id: r for r in L.lm_scores(make_docs(data)).collect()}
    one, two = Counter(), Counter()
    for i, t, _ in data:
        if not found[i].held_out:
            w = tokens(t)
            one.update(w)
            two.update(zip([None, *w], w))
    n, v = sum(one.values()), len(one)
    cells = Counter()
    p2 = lambda a, b: two[a, b] / one[a] if one[a] else 0.0
    for i, t, _ in data:
        if found[i].held_out:
            w = tokens(t)
            cells.update((one[a], p2(a, b), one[b] / n) for a, b in zip([None, *w], w))
    table = Counter()
    rows = []
    for (c, x, y), k in cells.items():
        cell = int(L.context_class(np.array([c]))[0] * 65536 + L._classes(np.array([x]))[0] * 256 + L._classes(np.array([y]))[0])
        rows.append((cell, k, k * math.log(x) if x else 0.0, k * math.log(y) if y else 0.0))
    for cell, k, a, b in rows:
        old = table.get(cell, (0, 0.0, 0.0))
        table[cell] = (old[0] + k, old[1] + a, old[2] + b)
    w = L.learn_mixture([(c, *x) for c, x in table.items()], v)
    for i, t, _ in data[:30]:
        total = 0.0
        toks = tokens(t)
        for a, b in zip([None, *toks], toks):
            k = w[int(L.context_class(np.array([one[a]]))[0])]
            p = k[0] * p2(a, b) + k[1] * one[b] / n + k[2] / (v + 1)
            total += math.log10(p if one[a] else p / (k[1] + k[2]))
        assert abs(total - found[i].score) < 1e-6 * abs(total)
    held = [r for r in found.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_ranges_grow_with_the_input(make_docs, odd_rows, scored, monkeypatch):
    """More tokens, more hash ranges, as many for a task as before; scores are the same in any number of them."""
    assert [L.ranges(n * L.RANGE, 8) for n in (0, 1, 4, 40, 4000)] == [8, 8, 8, 128, 8192]
    monkeypatch.setattr(L, "RANGE", 50)
    monkeypatch.setattr(L, "CHUNK", 10_000)
    again = L.lm_scores(make_docs(odd_rows)).collect()
    near = lambda found: sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 2)) for r in found), key=repr)
    assert near(again) == near(scored)


def test_lm_no_rows(no_docs):
    assert L.lm_scores(no_docs).collect() == []


def test_squeeze_round_trip():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2**64, 1000, dtype=np.uint64))
    assert (L.expand_keys(L.squeeze_keys(keys)) == keys).all() and len(L.expand(L.squeeze(keys[:0]), "<u8")) == 0


def quality_rows():
    good = [(i, prose(i, 40 + i % 60), "a") for i in range(300)]
    junk = [(1000 + i, " ".join(w + random.Random(i).choice(["***", "$$$", "!!"]) for w in prose(5000 + i, 60).split()), "a") for i in range(40)]
    return good + junk


def test_quality_separates(spark, make_docs):
    data = quality_rows()
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _, _ in data if i % 3], "doc_id long, quality int")
    found = {r.doc_id: r.kept for r in Q.quality_sample(make_docs(data), labels).collect()}
    assert sum(found[i] for i in range(300)) >= 297 and not any(found[i] for i in range(1000, 1040))
    kept = Q.keep_sampled(make_docs(data), labels)
    assert kept.columns == make_docs([]).columns and {r.doc_id for r in kept.collect()} == {i for i, k in found.items() if k}


def quality_by_force(spark, data, labels):
    """log_weight and kept of every row, with a dictionary for each distribution and a plain sort."""
    own = {}
    for i, q in labels:
        if i is not None and q is not None:
            own[i] = max(q, own.get(i, 0))
    half = {r[0]: r[1] for r in spark.createDataFrame([(i,) for i in own], "i long").selectExpr("i", "pmod(xxhash64(i), 2)").collect()} if own else {}

    clean = lambda w: re.sub(rb"[!-/:-@\[-`{-~]{1,3}$", b"", w)
    one = cache(lambda w: L.hash_words(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0] if w else np.uint64(11))
    spread = cache(lambda x: Q.mix(np.array([x], np.uint64))[0])
    two = cache(lambda a, b: np.uint64(7) if a == b else Q.pair_hash(np.array([a]), np.array([b]))[0])

    @cache
    def grams(text):
        out, seen = [], set()
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        hashed = [one(clean(w)) for w in words]
        pairs = [two(a, b) for a, b in zip(hashed, hashed[1:])]
        for h, w in zip(hashed, words):
            tail = 0
            for c in reversed(w[len(clean(w)) :]):
                tail = tail * 131 + c + 1
            out += [("gram", int(h) % Q.GRAMS), ("tail", int(spread(tail)) % Q.TAILS)]
        out += [("gram", int(p) % Q.GRAMS) for p in pairs]
        for k in range(2, len(words)):
            three = tuple(hashed[k - 2 : k + 1])
            out.append(("again", three in seen))
            seen.add(three)
        return out

    raw, target = Counter(), Counter()
    for i, t, _ in data:
        raw.update(grams(t))
        if own.get(i) == 1 and half[i] == 0:
            target.update(grams(t))
    sizes = {"gram": Q.GRAMS, "tail": Q.TAILS, "again": 2}
    total = {k: sum(n for (kind, _), n in raw.items() if kind == k) + 1e-9 * size for k, size in sizes.items()}
    of = {k: sum(n for (kind, _), n in target.items() if kind == k) + Q.PRIOR for k in sizes}
    ratio = {g: math.log((target[g] + Q.PRIOR * (n + 1e-9) / total[g[0]]) / of[g[0]]) - math.log((n + 1e-9) / total[g[0]]) for g, n in raw.items()}
    weights = [sum(ratio[g] for g in grams(t)) for _, t, _ in data]
    held = {}
    for (i, _, _), w in zip(data, weights):
        if i in own and half[i] == 1:
            held[i] = min(w, held.get(i, math.inf))
    # the share of the target's at a weight: of all runs of documents that end above it the greatest least mean
    points = [(w, [own[i] for i, x in held.items() if x == w]) for w in sorted(set(held.values()))]
    mean = lambda a, b: sum(sum(q) for _, q in points[a:b]) / sum(len(q) for _, q in points[a:b])
    fitted = [max(min(mean(a, b) for b in range(k + 1, len(points) + 1)) for a in range(k + 1)) for k in range(len(points))]
    share = lambda w: fitted[min(range(len(points)), key=lambda k: abs(points[k][0] - w))] if points else 1.0
    k = max(1, round(sum(share(w) for w in weights)))
    keys = Q.sample_keys(pa.array([i for i, _, _ in data], pa.int64()), pa.array([t for _, t, _ in data], pa.string()), np.array(weights))
    least = np.sort(keys)[::-1][k - 1] if k <= len(keys) else keys.min()
    return k, sorted(((i, round(w, 6), bool(x >= least)) for (i, _, _), w, x in zip(data, weights, keys)), key=repr)


def test_quality_by_force(spark, make_docs, odd_rows):
    some = [(7, 1), (7, 1), (9, None), (None, 0), (2, 0), (10, 1), (12, 0), (4, 1), (6, 1), (13, 0)]
    good = quality_rows()
    r = random.Random(12)
    mixed = [(i, " ".join(w + r.choice(["", "", "!", "$$"]) * (i % 4) for w in t.split()), s) for i, t, s in good]
    for data, labels in ((odd_rows, some), (good, [(i, int(i < 1000)) for i, _, _ in good if i % 3]), (mixed, [(i, int(i % 4 < 2 or i % 7 == 0)) for i, _, _ in mixed if i % 3])):
        k, want = quality_by_force(spark, data, labels)
        found = Q.quality_sample(make_docs(data), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
        assert sorted(((r.doc_id, round(r.log_weight, 6), r.kept) for r in found), key=repr) == want
        if data is good:
            assert k == 300


def test_shares_by_weight():
    edges, shares = Q.calibrate(np.array([5.0, 1, 2, 3, 4, 4]), np.array([1.0, 0, 1, 0, 0, 1]))
    assert edges.tolist() == [1.5, 4.5] and shares.tolist() == [0, 0.5, 1]
    assert [x.tolist() for x in Q.calibrate(np.zeros(0), np.zeros(0))] == [[], [1]]
    assert [x.tolist() for x in Q.calibrate(np.array([-1e6, 3.0]), np.array([0.0, 0.0]))] == [[], [0]]


def test_quality_odd_rows(spark, odd_docs, odd_rows, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    some = spark.createDataFrame([(7, 1), (7, 1), (9, None), (None, 0), (2, 0), (10, 1)], "doc_id long, quality int")
    assert all(r.kept for r in Q.quality_sample(odd_docs, none).collect()) and Q.keep_sampled(odd_docs, none).count() == len(odd_rows)
    found = Q.quality_sample(odd_docs, some).collect()
    assert len(found) == len(odd_rows) and all(r.log_weight == 0 for r in found if r.doc_id in (1, 2, 3))
    assert sum(r.kept for r in found) == Q.keep_sampled(odd_docs, some).count()
    assert Q.quality_sample(no_docs, some).collect() == [] and Q.keep_sampled(no_docs, some).collect() == []


def test_kth_largest(spark):
    rng = random.Random(3)
    keys = [rng.randrange(-(2**63), 2**63) for _ in range(500)] + [5] * 40 + [-(2**63), 2**63 - 1]
    df = spark.createDataFrame([(k,) for k in keys], "key long")
    for k in (1, 2, 250, 300, len(keys)):
        assert Q.kth_largest(df, k) == sorted(keys, reverse=True)[k - 1]
    assert Q.kth_largest(df, len(keys) + 1) is None


def test_gumbel_keys_sample_by_weight():
    ids = pa.array(range(60_000))
    w = np.where(np.arange(60_000) < 20_000, math.log(3.0), 0.0)
    texts = pa.nulls(60_000, pa.string())
    first = np.argsort(-Q.sample_keys(ids, texts, w))[:3000]
    share = (first < 20_000).mean()  # 3 * 20000 of 100000
    assert abs(share - 0.6) < 0.04
    assert (np.argsort(Q.sample_keys(ids, texts, w * 0 - 5)) == np.argsort(Q.sample_keys(ids, texts, w * 0 + 5))).all()
    none = Q.sample_keys(pa.nulls(4, pa.int64()), pa.array(["a", "b", "a", None]), np.zeros(4))
    assert none[0] == none[2] and len(set(none.tolist())) == 3


def toxic_rows():
    r, out = random.Random(4), []
    for i in range(600):
        words = prose(i, 60 + i % 80).split()
        toxic = i % 8 == 0
        for _ in range(2 if toxic else 0):
            words[r.randrange(len(words))] = r.choice(["Snarg,", "blorp", "FLEEB!"])
        if toxic and i % 16 == 0:
            words += ["zonk" + w for w in words[:4]]
        out.append((i, " ".join(words), "a", int(toxic), int(i % 16 == 0)))
    return out


def test_toxicity_held_out(spark, make_docs):
    data = toxic_rows()
    labels = spark.createDataFrame([(i, a, b) for i, _, _, a, b in data if i % 3], "doc_id long, rude int, very int")
    found = {r.doc_id: r for r in T.toxicity(make_docs([x[:3] for x in data]), labels, ("rude", "very")).collect()}
    unseen = [x for x in data if x[0] % 3 == 0]
    assert sum(found[i].rude == bool(a) for i, _, _, a, _ in unseen) >= len(unseen) - 2
    assert sum(found[i].very == bool(b) for i, _, _, _, b in unseen) >= len(unseen) - 4


def test_toxicity_chain_feeds_on(make_docs):
    """A category that only depends on an earlier one is learned through its probability."""
    words = [np.unique(np.array([1, 2 + i % 2, 100 + i], np.uint64)) for i in range(400)]
    y = np.array([[i % 2, i % 2] for i in range(400)])
    flat = np.concatenate(words)
    chain = T.Chain(T.Samples(np.array([len(w) for w in words]), flat, np.ones(len(flat))), y, np.arange(400))
    assert len(chain.models[1][2]) == 1 and chain.models[1][2][0] > 0
    assert ((chain.held[:, 1] > 0) == (y[:, 1] == 1)).all()


def test_toxicity_features_chosen_by_spark(spark, make_docs):
    """Spark's choice for every model is that of the fitted documents' whole matrix."""
    data = toxic_rows()
    labels = spark.createDataFrame([(i, a, b) for i, _, _, a, b in data if i % 3], "doc_id long, rude int, very int")
    found = T.labelled_features(make_docs([x[:3] for x in data]), labels, ("rude", "very"))
    own = found.orderBy("doc_id").collect()
    y, fold = np.array([[r.y0, r.y1] for r in own]), np.array([r.fold for r in own])
    samples = T.Samples(np.array([len(r.words) for r in own]), np.concatenate([r.words for r in own]).astype(np.int64).view(np.uint64), np.concatenate([r.counts for r in own]))
    assert (fold == T.fold_of(np.array([r.doc_id for r in own]))).all()
    picks = T.choose(found, y, fold)
    for k in range(2):
        for f in range(T.FOLDS + 1):
            assert len(picks[k][f]) and picks[k][f].tolist() == samples.pick(fold != f, y[:, k].astype(float)).tolist()


def test_toxicity_learns_from_all_labels(spark, make_docs):
    """More than 3,000 labelled documents, and words that only agree in their first four letters."""
    r = random.Random(8)
    tail = lambda: "".join(r.choice("bcdfghjklm") for _ in range(6))
    data = [(i, prose(i, 12) + (" zonk" + tail() if i % 5 == 0 else " wimp" + tail()), "a") for i in range(3600)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(3500)], "doc_id long, toxic int")
    docs = make_docs(data)
    chain = T.fit(docs, labels, ("toxic",))
    assert len(chain.held) == 3500
    texts = pa.array([t for _, t, _ in data[3500:]])
    assert ((chain.probabilities(texts)[:, 0] >= chain.models[0][-1]) == [i % 5 == 0 for i in range(3500, 3600)]).all()


def test_toxicity_of_repeated_rows(spark, make_docs):
    """A labelled document that comes 9,000 times is learned from once, and keeps no other from being learned from."""
    data = [x[:3] for x in toxic_rows()]
    labels = spark.createDataFrame([(i, a) for i, _, _, a, _ in toxic_rows() if i % 3], "doc_id long, rude int")
    docs = make_docs(data)
    plain = {r.doc_id: (r.rude, r.p_rude) for r in T.toxicity(docs, labels, ("rude",)).collect()}
    many = docs.unionByName(docs.where("doc_id = 1").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(9000)))).drop("copy"))
    again = T.toxicity(many, labels, ("rude",))
    assert again.count() == 9600 and {r.doc_id: (r.rude, r.p_rude) for r in again.distinct().collect()} == plain
    assert T.labelled_features(many, labels, ("rude",), 50).count() == 50


def test_toxicity_odd_rows(spark, odd_docs, odd_rows, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert not any(r.toxic for r in T.toxicity(odd_docs, none).collect())
    some = spark.createDataFrame([(7, 1), (7, 1), (9, None), (None, 0), (2, 0), (10, 1)], "doc_id long, toxic int")
    found = T.toxicity(odd_docs, some).collect()
    assert len(found) == len(odd_rows)
    # three documents tell no word from another, so all texts are as likely
    assert len({round(r.p_toxic, 9) for r in found}) == 1 and len({r.toxic for r in found}) == 1
    assert {r.p_toxic for r in found if r.doc_id in (1, 2, 3)} == {found[0].p_toxic}
    every = spark.createDataFrame([(7, 1), (10, 1)], "doc_id long, toxic int")
    assert all(r.toxic for r in T.toxicity(odd_docs, every).collect())
    assert T.toxicity(no_docs, some).collect() == []


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text):
    """Words and word beginnings of a text with how often each comes, by the words themselves."""
    words = re.findall("[a-z0-9\x80-\U0010ffff]+", (text or "").translate(LOW))
    found = Counter(words)
    for w in words:
        raw = w.encode()
        found.update((n, raw[:n]) for n in T.PREFIXES if len(raw) > n)
    return found


def plain_fit(x, y):
    """The least of the ridge-penalised logistic loss, by Newton steps that are halved until the loss falls."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty = np.full(x.shape[1], T.RIDGE)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    loss = lambda w: np.logaddexp(0, x @ w).sum() - y @ (x @ w) + (penalty * w * w).sum() / 2
    for _ in range(200):
        p = 1 / (1 + np.exp(-(x @ w)))
        slope = x.T @ (p - y) + penalty * w
        step, t = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(penalty), slope), 1.0
        while loss(w - t * step) > loss(w) and t > 1e-8:
            t /= 2
        w = w - t * step
        if np.abs(step).max() < 1e-10:
            break
    return w


def plain_toxicity(rows, labels):
    """The chain, by the documented steps, over dictionaries of words: probability and verdict of each category for each text."""
    texts = {}
    for i, t, _ in rows:
        texts.setdefault(i, t)
    own = {i: y for i, *y in labels if i in texts}
    ids = sorted(own)
    counts = [plain_features(texts[i]) for i in ids]
    fold = T.fold_of(np.array(ids))
    value = lambda c, words: np.array([np.log1p(c[w]) for w in words])

    def pick(train, y):
        held = Counter(w for k in train for w in counts[k])
        n, p, gains = len(train), np.mean([y[k] for k in train]), {}
        for w, times in held.items():
            if times >= T.HELD_BY:
                v, t = np.array([np.log1p(counts[k][w]) for k in train]), np.array([y[k] for k in train])
                spread = max((v * v).sum() - v.sum() ** 2 / n, 1e-9)
                gains[w] = ((v * t).sum() - v.sum() * p) ** 2 / (spread * p * (1 - p))
        good = [w for w, g in gains.items() if g > T.GAIN]
        assert len(good) < T.WORDS
        return good

    earlier, models = np.zeros((len(ids), 0)), []
    for k in range(len(labels[0]) - 1):
        y = np.array([float(own[i][k]) for i in ids])
        held = np.zeros(len(ids))
        for f in [*range(T.FOLDS), None]:
            train, rest = np.flatnonzero(fold != (-1 if f is None else f)), np.flatnonzero(fold == f) if f is not None else []
            words = pick(train, y)
            x = np.column_stack([[value(c, words) for c in counts], earlier])
            w = plain_fit(x[train], y[train])
            for r in rest:
                held[r] = 1 / (1 + np.exp(-(x[r] @ w[:-1] + w[-1])))
        # the last fit is of all; the threshold lies between the two probabilities where F1 is best
        best, cut = -1.0, 0.5
        levels = sorted(set(held), reverse=True)
        for at, level in enumerate(levels):
            said = held >= level
            f1 = 2 * (said * y).sum() / (said.sum() + y.sum())
            if f1 > best + 1e-12:
                best, cut = f1, (level + (levels[at + 1] if at + 1 < len(levels) else 0.0)) / 2
        models.append((words, w, cut))
        q = np.clip(held, 1e-6, 1 - 1e-6)
        earlier = np.column_stack([earlier, np.log(q / (1 - q))])
    out = []
    for i, t, _ in rows:
        c, logits, row = plain_features(t), [], [i]
        for words, w, cut in models:
            p = 1 / (1 + np.exp(-(np.concatenate([value(c, words), logits]) @ w[:-1] + w[-1])))
            row += [p, p >= cut]
            logits.append(np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6))))
        out.append(tuple(row))
    return out


def test_toxicity_by_force(spark, make_docs):
    data = toxic_rows()[:320]
    rows = [x[:3] for x in data] + [(900, None, "a"), (901, "", "a"), (902, "ZONK snarg ÄÖ fleeb", None)]
    labels = [(i, a, b) for i, _, _, a, b in data if i % 3]
    found = T.toxicity(make_docs(rows), spark.createDataFrame(labels, "doc_id long, rude int, very int"), ("rude", "very"))
    want = {r[0]: r for r in plain_toxicity(rows, labels)}
    got = found.select("doc_id", "p_rude", "rude", "p_very", "very").collect()
    assert len(got) == len(rows)
    for r in got:
        i, p, x, q, z = want[r.doc_id]
        assert abs(r.p_rude - p) < 1e-4 and abs(r.p_very - q) < 1e-4 and (r.rude, r.very) == (x, z)
