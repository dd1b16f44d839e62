import hashlib
import zlib
from collections import defaultdict

import corpus_pipeline as P
import numpy as np
import pytest
from helpers_llm import edited, prose
from test_dedup import near_by_force, shingles
from test_filters import leaks_by_force, targets_by_force
from test_scores import quality_by_force, quality_rows
from test_token_files import plain

from graphloom.llm import near_dedup
from graphloom.llm.common import spool, table
from graphloom.llm.token_files import END


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in P.STAGES[:-1]:
        docs = spool(stage(spark, docs, sf), name)
        assert docs.columns == columns
        sizes.append(docs.count())
        if name == "minhash_near_dedup":
            assert near_dedup.near_duplicates(docs).where("NOT kept").isEmpty()
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] > 0.6 * sizes[0]
    out = P.STAGES[-1][1](spark, docs, sf)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() == sizes[-1]
    last = out.orderBy("start").collect()
    assert all(a.start + a.n_tokens == b.start for a, b in zip(last, last[1:]))


def one_by_force(data):
    """The rows of each component's least id, once each; without id only those without words."""
    stay = {(i, n) for i, n, _, kept in near_by_force(data, 5, 80) if kept}
    named = {(i, t): (i, t, s) for i, t, s in data if i is not None and (i, len(shingles(t or "", 5))) in stay}
    return [*named.values(), *[x for x in data if x[0] is None and not (x[1] or "").split()]]


def copies_by_force(data):
    """Rows as often as the mix takes them: of each source those with the least hashes once more, up to its target."""
    own = defaultdict(list)
    for row in data:
        h = int(hashlib.md5(f"{'' if row[0] is None else row[0]}:{row[1] or ''}".encode()).hexdigest()[:15], 16)
        own[row[2]].append((h, len((row[1] or "").encode().split()), row))
    sizes = {s: sum(n for _, n, _ in x) for s, x in own.items()}
    target, out = targets_by_force(sizes), []
    for s, x in own.items():
        whole = min(3, int(target[s] // sizes[s])) if sizes[s] else 0
        rest = target[s] - whole * sizes[s]
        for h, _, row in x:
            before, tied = sum(n for g, n, _ in x if g < h), sum(n for g, n, _ in x if g == h)
            more = rest > 0 and (before + tied <= rest or before <= rest and 2 * (rest - before) >= tied)
            out += [row] * (whole + more)
    return out


def run_by_force(spark, data, labels, items):
    if labels:
        kept = {i for i, _, k in quality_by_force(spark, data, labels)[1] if k}
        data = [x for x in data if x[0] in kept]
    data = one_by_force(data)
    leaked = {i for i, _ in leaks_by_force(data, items)}
    ids = [(i, [*plain(t), END]) for i, t, _ in copies_by_force([x for x in data if x[0] not in leaked])]
    return sorted(((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids), key=repr)


def planted():
    """Good and junk documents of three sources, near copies, and benchmark items inside."""
    items = [(k, prose(40_000 + k, 14 + k) + ". " + prose(50_000 + k, 7).capitalize() + "?") for k in range(6)]
    good = [(i, t, ("a", "b", None)[i % 3]) for i, t, _ in quality_rows()]
    near = [(2000 + i, edited(t, i, 1), "b") for i, t, _ in good[:40]] + [(2100 + i, good[3][1], "c") for i in range(30)]
    leaks = [(3000 + k, good[50 + k][1] + " " + x + " " + good[60 + k][1], "a") for k, x in items]
    return good + near + leaks, [(i, int(i < 1000)) for i, _, _ in good if i % 3], items


@pytest.mark.parametrize("case", ["planted", "odd", "none"])
def test_run_by_force(spark, make_docs, odd_rows, tmp_path, case):
    data, labels, items = planted() if case == "planted" else (odd_rows if case == "odd" else [], [], [(0, prose(2, 80)), (1, None)][: 2 * (case == "odd")])
    make_docs(data).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = P.run(spark, str(tmp_path)).orderBy("start").collect()
    want = run_by_force(spark, data, labels, items)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in found), key=repr) == want
    at = 0
    for r in found:
        assert r.start == at
        at += r.n_tokens
    if case == "planted":
        ids = {r.doc_id for r in found}
        assert len(ids) > 200 and not ids & {3000 + k for k, _ in items}
