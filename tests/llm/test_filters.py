import base64
import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from helpers_llm import WORDS, edited, prose

from graphloom.llm import decontamination as D
from graphloom.llm import mixing as M
from graphloom.llm import secret_scan as S
from graphloom.llm import url_filter as U
from graphloom.llm.queries import QUERIES, SQL, URL_RULES


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- mixing ---


def targets_by_force(sizes, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left, shares = total - sum(most * sizes[s] for s in capped), sum(weight[s] for s in sizes if s not in capped)
        target = {s: most * sizes[s] if s in capped else weight[s] * left / shares for s in sizes}
        over = {s for s in sizes if s not in capped and target[s] >= most * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mix(make_docs, odd_rows, no_docs):
    r = random.Random(5)
    many = [(i, prose(i, r.randrange(1, 90)), r.choice(["s1", "s1", "s1", "s2", "Ω", None])) for i in range(400)] + [(i, "w " * 3, "tiny") for i in range(400, 404)]
    for data in (odd_rows, many):
        docs = make_docs(data)
        plan = M.mix_plan(docs).collect()
        sizes = defaultdict(int)
        for _, t, s in data:
            sizes[s] += len((t or "").encode().split())
        want = targets_by_force(sizes)
        by_key = {(round(want[s], 6), sizes[s]) for s in sizes}
        assert {(round(p.target, 6), p.source_size) for p in plan} == by_key
        assert Counter((p.doc_id, p.size) for p in plan) == Counter((i, len((t or "").encode().split())) for i, t, _ in data)
        assert all(0 <= p.copies <= 3 for p in plan)
        if data is many:
            taken = defaultdict(int)
            for p in plan:
                taken[p.target, p.source_size] += p.size * p.copies
            assert all(abs(taken[k] - k[0]) <= 90 for k in taken)
        assert rows(M.mix_plan(docs)) == sorted((tuple(p) for p in plan), key=repr)
        mixed = M.mix(docs)
        assert mixed.columns == docs.columns and mixed.count() == sum(p.copies for p in plan)
    assert rows(M.mix_plan(no_docs)) == [] and rows(M.mix(no_docs)) == []


# --- secrets ---


def base_by_force(text):
    text, out = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        out += [(m.start(), 0, f"assign:{m.start()}:{m.end()}")] * (len(m[2]) >= 8)
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        out += [(m.start(), 1, f"access:{m.start()}:{m.end()}")] * (len(m[0]) >= 16)
    for m in re.finditer(r"[0-9a-f]+", text):
        out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}")] * (len(m[0]) >= 32)
    return [x for _, _, x in sorted(out)]


def test_secrets(make_docs, odd_rows, no_docs):
    r = random.Random(6)
    keys = [base64.b64encode(r.randbytes(48)).decode() for _ in range(40)]
    data = [*odd_rows, (50, 'é token: api_key="abcdefgh12" PassWord = x', "a"), (51, "ſecret=abcdefgh1 secret=abcdefgh1", "a"), (52, "AKIA" + "Z9" * 8 + " " + "0a" * 16, "a"), (53, "api_key='" + "0f" * 20 + "'", "a")]
    data += [(100 + k, prose(k, 30) + " see " + key + " " + prose(k + 999, 5), "a") for k, key in enumerate(keys)]
    data += [(300 + k, prose(k, 40) + " " + "".join(r.choice(WORDS) for _ in range(9)), "a") for k in range(200)]
    found = {(x.doc_id, x.base_sha256): x for x in S.secret_spans(make_docs(data)).collect()}
    for i, t, _ in data:
        base = base_by_force(t)
        x = found[i, hashlib.sha256(",".join(base).encode()).hexdigest()]
        assert (x.n_assign, x.n_access, x.n_hex) == tuple(sum(b.startswith(k) for b in base) for k in ("assign", "access", "hex"))
        assert [s for s in x.spans.split(",") if s and not s.startswith("random")] == base
        starts = [int(s.split(":")[1]) for s in x.spans.split(",") if s]
        assert starts == sorted(starts)
    random_of = {i: [s for s in x.spans.split(",") if s.startswith("random")] for (i, _), x in found.items()}
    hits = sum(f"random:{len(prose(k, 30)) + 5}:{len(prose(k, 30)) + 5 + len(key)}" in random_of[100 + k] for k, key in enumerate(keys))
    assert hits >= 36
    assert sum(bool(random_of[300 + k]) for k in range(200)) <= 2
    assert rows(S.secret_spans(no_docs)) == []


def test_secrets_behind_names_and_in_paths(make_docs):
    """NAME=value without a space, and keys in paths that no single encoding fits."""
    r = random.Random(16)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    data, at = [], {}
    for k in range(120):
        key = ("".join(r.choice(letters) for _ in range(64)), base64.b64encode(r.randbytes(48)).decode(), base64.urlsafe_b64encode(r.randbytes(48)).decode(), base64.b64encode(r.randbytes(49)).decode())[k % 4]
        before, after = (("export AWS_ACCESS=", " "), ("GH_PAT=", "\n"), ("?a=b&my_sig=", "&c=d"), ("/srv/my_data/x-y_", "_z/last-one/w_w"), ("/srv/my_data/", "/last-one/w_w"))[k % 3 if k % 2 else 3 + (k % 4 == 2 or k % 8 == 0)]
        text = prose(k, 30) + " é " + before
        at[k] = (len(text), len(text) + len(key))
        data.append((k, text + key + after + prose(k + 999, 5), "a"))
    data += [(300 + k, prose(k, 40) + " /the/of_and/" + "/".join("_-"[j % 2].join(r.choice(WORDS) for _ in range(2)) for j in range(6)) + " NAME_OF=" + "".join(r.choice(WORDS) for _ in range(5)), "a") for k in range(120)]
    found = {x.doc_id: [tuple(map(int, s.split(":")[1:])) for s in x.spans.split(",") if s.startswith("random")] for x in S.secret_spans(make_docs(data)).collect()}
    held = [max((min(e, at[k][1]) - max(s, at[k][0]) for s, e in found[k]), default=0) / (at[k][1] - at[k][0]) for k in at]
    assert sum(h > 0.9 for h in held) >= 100
    named = [k for k in at if k % 2]
    assert sum(at[k] in found[k] for k in named) >= 54
    assert all(a[1] <= b[0] for x in found.values() for a, b in zip(x, x[1:]))
    assert sum(bool(found[300 + k]) for k in range(120)) <= 2


def test_secret_runs():
    key = b"Zq8Lw2Xv9TbR4nYc7KmJ5hGd3FsP6aEu"
    spans = lambda text: [text[s:e] for s, e, b, chosen in S.run_tests(text, S.base_spans(text)) if chosen and b[2] >= S.FIT]
    assert spans(b"SOME_LONG_NAME_OF_IT=" + key + b"==") == [key + b"=="]
    assert spans(b"a=b=" + key + b"=c") == [key]
    for text in (b"/the_home/" + key, b"x_y/" + key + b"/", b"/a_b/" + key + b"/c-d"):
        assert len(spans(text)) == 1 and key in spans(text)[0]
    assert spans(b"0a" * 16 + b"/" + key) == [key]  # beside a base span


def battery_by_force(run):
    """The three tests of one run, letter by letter."""
    run = run.rstrip("=")
    n = len(run)
    name = next((k for k, letters in S.ENCODINGS.items() if set(run) <= set(letters)), None)
    if n < 16 or name is None:
        return None
    letters = S.ENCODINGS[name]
    a, at = len(letters), [letters.index(c) for c in run]
    counts = Counter(at).values()
    same = sum(c * (c - 1) for c in counts) / (n * (n - 1))
    z = (sum(c * c for c in counts) * a / n - n - (a - 1)) / math.sqrt(2 * (a - 1) * (n - 1) / n)
    high = [x >= a / 2 for x in at]
    up = sum(high)
    mean = 2 * up * (n - up) / n + 1
    z_runs = n if up in (0, n) else (1 + sum(x != y for x, y in zip(high, high[1:])) - mean) / math.sqrt(max(1e-9, (mean - 1) * (mean - 2) / (n - 1)))
    x = [v - sum(at) / n for v in at]
    power = sum(v * v for v in x)
    z_serial = (sum(v * w for v, w in zip(x, x[1:])) / power * n + 1) / math.sqrt(n) if power else n
    tail = lambda v: math.erfc(abs(v) / math.sqrt(2))
    return name, n, min(1, 3 * min(math.erfc(z / math.sqrt(2)) / 2 if z > 0 else 1, tail(z_runs), tail(z_serial))), z, same


def random_by_force(texts):
    """Random spans of each text: runs, each tested alone, then the discovery rule over a plain list of all."""
    runs = []
    for d, t in enumerate(texts):
        base = [tuple(map(int, x.split(":")[1:])) for x in base_by_force(t)]
        for s, e, b, chosen in S.run_tests(t.encode(), S.base_spans(t.encode())):
            u, v = len(t.encode()[:s].decode()), len(t.encode()[:e].decode())
            want = battery_by_force(t[u:v])
            assert b[:2] == want[:2] and all(abs(p - q) < 1e-9 * max(1, abs(q)) for p, q in zip(b[2:], want[2:]))
            assert not any(x < v and u < y for x, y in base)
            runs.append((d, u, v, want, chosen))
    agree = {}
    for kind in {b[0] for _, _, _, b, _ in runs}:
        own = [b for _, _, _, b, chosen in runs if chosen and b[0] == kind]
        failed = [b for b in own if b[2] < S.FIT]
        twice = max(2 / len(S.ENCODINGS[kind]), S.TEXT)
        many = len(failed) > 10 + 3 * S.FIT / (1 - S.FIT) * (len(own) - len(failed))
        agree[kind] = (sum(b[4] * b[1] for b in failed) + S.PRIOR * twice) / (sum(b[1] for b in failed) + S.PRIOR) if many else twice
    steps = []
    for _, _, _, (kind, n, p, z, _), chosen in runs:
        a = len(S.ENCODINGS[kind])
        excess = max(0, a * agree[kind] - 1) * (n - 1)
        t = (z - excess / math.sqrt(2 * (a - 1))) / math.sqrt(1 + 2 * excess / (a - 1))
        log2p = 0 if t > 0 else -t * t / 2 / math.log(2) - math.log2(max(2, -t * math.sqrt(2 * math.pi)))
        steps.append((math.ceil(max(log2p, -1000) * 16), p >= S.FIT and chosen))
    fits = [k for k in {k for k, _ in steps} if 0 < (found := sum(ok for x, ok in steps if x <= k)) and 2 ** (k / 16) * len(steps) <= S.DISCOVERY * found]
    out = [[] for _ in texts]
    for (d, u, v, _, _), (k, ok) in zip(runs, steps):
        if ok and fits and k <= max(fits):
            out[d].append(f"random:{u}:{v}")
    return out


def test_random_spans_by_force(make_docs):
    r = random.Random(26)
    texts = [prose(k, 20) + " é " + r.choice(["", "key_of=", "/a/b_c/", "x-"]) + base64.b64encode(r.randbytes(r.randrange(12, 60))).decode() + " secret=abcdefgh12 " + "0f" * r.randrange(10, 20) for k in range(60)]
    texts += [prose(k, 30) + " /the/of_and/" + "/".join("_-"[j % 2].join(r.choice(WORDS) for _ in range(2)) for j in range(6)) + " " + "".join(r.choice(WORDS) for _ in range(r.randrange(3, 12))) for k in range(150)]
    texts += ["0" * 40, "0123456789" * 4, "a" * 16 + "=" * 3, "=" * 20, "é" * 30 + "-" * 20]
    want = random_by_force(texts)
    found = {x.doc_id: [y for y in x.spans.split(",") if y.startswith("random")] for x in S.secret_spans(make_docs([(k, t, "a") for k, t in enumerate(texts)])).collect()}
    assert [found[k] for k in range(len(texts))] == want and sum(map(bool, want)) >= 40


def test_secrets_in_a_long_text():
    """4 MB with 60,000 spans and as many runs take seconds, as work is in proportion to the text."""
    r = random.Random(27)
    text = " ".join(("password=abcdefgh1234", "/a/b_c/" + base64.b64encode(r.randbytes(30)).decode(), "wörd")[k % 3] for k in range(180_000)).encode()
    began = time.perf_counter()
    base = S.base_spans(text)
    tested = S.run_tests(text, base)
    assert len(base) == 60_000 and len(tested) >= 60_000 and time.perf_counter() - began < 60


# --- urls ---


def verdict_by_force(url, rules):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


@pytest.mark.parametrize("seed", [0, 1])
def test_urls(spark, seed):
    r = random.Random(seed)
    labels, parts = ["a", "b", "co", "é", "xn--"], ["/", "/a", "/a/b", "/ab", "/a/", "/é"]
    host = lambda k: ".".join(r.choice(labels) for _ in range(k))
    rules = list({(h, p): (h, p, r.choice(["block", "allow"])) for h, p in ((host(r.randrange(1, 4)), r.choice(["", *parts])) for _ in range(60))}.values()) if seed else URL_RULES
    urls = [None, "", "no scheme", "://", "http://", "http://EXAMPLE.com/en/71?x#y", "https://a.example.net/de/8", "x://com/en/", "http://com.evil/en/", "http://ünï.org/es/é", "a://b://c/d", "http://org#/es/", "http://org/es/\x00\uffff"]
    urls += [f"http://{host(r.randrange(1, 5))}{r.choice(parts)}{r.choice(['', 'b', 'x/y', '?q', '#f'])}" for _ in range(400)]
    data = [(k, u) for k, u in enumerate(urls)] + [(7, "http://a.org/es/1")] * 50 + [(None, "http://a.org/es/1")]
    pages = spark.createDataFrame([(i, u, 1, "z", "w") for i, u in data], "page_id long, url string, key int, state string, row string")
    found = U.url_verdicts(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert rows(found) == sorted(((i, *verdict_by_force(u, rules)) for i, u in data), key=repr)


def test_url_query_judges_by_its_contract(spark, tmp_path):
    """The rules as the contract words them, apart from URL_RULES: the query and its SQL give each one's word."""
    contract = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
    hosts = ["com", "example.com", "a.example.com", "myexample.com", "net", "example.net", "A.b.Example.NET", "org", "a.org", "xorg"]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/en", "/en/", "/en/7", "/en/71/x", "/de/", "/de/7", "/de/8", "/de/80?/en/", "/es/", "/es/1#x")] + [None, "net/de/1", "://net/de/"]
    data = list(enumerate(urls))
    spark.createDataFrame(data, "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    want = sorted(((i, *verdict_by_force(u, contract)) for i, u in data), key=repr)
    assert rows(QUERIES["op5_url_filter"](spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict")) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(con.execute(SQL["op5_url_filter"]).fetchall(), key=repr) == want


def test_urls_without_rows(spark):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    assert rows(U.url_verdicts(spark.createDataFrame([], "page_id long, url string"), rules)) == []
    one = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert rows(U.url_verdicts(one, rules.where("false"))) == [(1, "a.b", "/c", None, "allow")]


# --- benchmark ---


def leaks_by_force(data, items):
    core = lambda t: [w for w in re.split("[\x00-/:-@\\[-`{-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w]
    runs = lambda w, n: [tuple(w[j : j + n]) for j in range(len(w) - n + 1)]
    out = []
    for i, t, _ in data:
        w = core(t)
        sets = {n: set(runs(w, n)) for n in range(1, 6)}
        for k, x in items:
            own = core(x)
            n = min(5, len(own))
            if own:
                want = runs(own, n)
                under = [any(want[j] in sets[n] for j in range(max(0, at - n + 1), min(at, len(own) - n) + 1)) for at in range(len(own))]
                q = len(core(" ".join(re.split(r"(?<=[.!?])\s+(?=\S)", x.strip())[:-1]))) or len(own)
                halves = [sum(part) >= 0.5 * len(part) for part in (under[:q], under[q:]) if part]
                if len(sets[n] & set(want)) >= 0.8 * len(set(want)) and all(halves):
                    out.append((i, k))
    return sorted(out)


def items_of():
    items = [(k, prose(10_000 + k, 12 + k % 45) + ". " + prose(20_000 + k, 6 + k % 9).capitalize() + "?") for k in range(60)]
    return items + [(60, None), (61, " "), (62, "Qopzu werilo."), (63, prose(30_000, 300))]


@pytest.mark.parametrize("most", [D.ITEMS, 16])
def test_leaks(spark, make_docs, odd_rows, monkeypatch, most):
    monkeypatch.setattr(D, "ITEMS", most)
    items = items_of()
    data = list(odd_rows)
    for k in range(0, 64):
        text = items[k][1] or ""
        body = prose(500 + k, 150)
        at = 40 + 7 * k
        data.append((1000 + k, body[:at] + " " + text + " " + body[at:], "a"))
        if text.count(" ") > 30:
            data.append((2000 + k, body + "\n" + edited(text, k, 1) + "!", "a"))
            data.append((3000 + k, body + " " + text[: len(text) // 2], "a"))
    found = D.leaks(make_docs(data), spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, score int"))
    want = leaks_by_force(data, items)
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == want and len(want) > 60
    whole = {(r.doc_id, r.item_id): r.score for r in D.leaks(make_docs(data), spark.createDataFrame(items, "item_id long, text string")).collect()}
    monkeypatch.setattr(D, "ITEMS", 7)
    dealt = {(r.doc_id, r.item_id): r.score for r in D.leaks(make_docs(data), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert whole.keys() == dealt.keys() and all(abs(whole[k] - dealt[k]) < 1e-9 for k in whole)
    monkeypatch.setattr(D, "ITEMS", most)
    kept = D.without_leaks(make_docs(data), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _, _ in data if i not in {d for d, _ in want})
    assert kept.columns == make_docs(data).columns


def test_leaks_without_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert rows(D.leaks(odd_docs, none)) == [] and rows(D.leaks(no_docs, spark.createDataFrame(items_of(), "item_id long, text string"))) == []


def test_wand_finds_what_full_scoring_finds():
    """The same items as scores of all of them, from a fraction of their postings."""
    r = random.Random(31)
    items = [(k, prose(40_000 + k, 20 + k % 40)) for k in range(2000)]
    index = D.build(items)[0]
    found = scored = 0
    for k in range(60):
        words = " ".join((prose(50_000 + k, 60), edited(items[k * 7][1], k, k % 12), prose(60_000 + k, 20)))
        passage = D._words(words)
        t = index.lookup(np.unique(passage))
        scores = np.zeros(len(items))
        for x in t[t >= 0]:
            own = slice(index.first[x], index.first[x + 1])
            scores[index.item[own]] += index.impact[own]
            scored += own.stop - own.start
        want = np.flatnonzero(scores >= index.score - 1e-9)
        got = dict(index.query(passage))
        assert sorted(got) == want.tolist() and all(abs(got[i] - scores[i] / index.raised[i]) < 1e-9 for i in got)
        found += len(got)
    assert found >= 40 and index.touched < scored / 3


def test_retrieval_reaches_every_leak():
    """Items whose rarest words, as many as a leak may lack, are replaced where that costs the fewest shingles."""
    r = random.Random(32)
    items = [(k, prose(70_000 + k, 12 + k % 120)) for k in range(0, 400, 12)]
    missed = leaked = 0
    for index in D.build(items):
        for k, item in enumerate(index.ids):
            words = dict(items)[item].split()
            own = index.shingles[k]
            mine = np.flatnonzero(index.item == k)
            impact = dict(zip(index.terms[np.searchsorted(index.first, mine, "right") - 1].tolist(), index.impact[mine].tolist()))
            for at in range(len(words)):
                for n in range(1, len(words) // 4):
                    changed = words[:at] + ["qq%dx" % r.randrange(10**6) for _ in words[at : at + n]] + words[at + n :]
                    if at % 9 and n % 3:
                        continue
                    passage = D._words(" ".join(changed))
                    if np.isin(np.unique(own), D.shingle_hashes(passage)).mean() >= D.SHARE:
                        score = sum(impact[t] for t in set(passage.tolist()) if t in impact)
                        leaked += 1
                        missed += score < index.score - 1e-9
    assert leaked > 400 and not missed
