"""Near-dedup by b-bit MinHash: banded candidates, packed low bits, estimates by bit counts, exact confirmation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NOT_WS, components, mix, pair_hash, spool, word_batches

#: 32 bands of 4 minima: a pair at a similarity of 0.8 shares no band once in 2e7.
BANDS, ROWS = 32, 4
PERMUTATIONS = BANDS * ROWS
#: Low bits kept of each minimum; two unrelated minima agree in them by chance once in 2 ** BITS.
BITS = 2
#: A candidate is looked at first if its estimate comes to the threshold less this: 4.7 standard deviations at 128 minima of 2 bits.
MARGIN = 0.2
#: Members of a large group whose differences from its hub tell which differences are frequent.
OFTEN = 64

_rng = np.random.default_rng(64)
_A = _rng.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)
_BAND = mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def shingle_sets(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, set sizes, sets one behind the other and each ascending) of 64-bit hashes of n-word shingles; fewer words are one shingle."""
    for i, j, words, count in word_batches(texts):
        at = np.concatenate([[0], np.cumsum(count)])
        h = mix(words + np.uint64(n))
        for k in range(1, n):
            h[: len(words) - k] = pair_hash(h[: len(words) - k], words[k:])
        sets = []
        for t in range(j - i):
            a, b = at[t], at[t + 1]
            if b - a >= n:
                sets.append(np.unique(h[a : b - n + 1]))
            elif b > a:
                short = mix(words[a : a + 1] + np.uint64(b - a) * np.uint64(7919))
                for w in words[a + 1 : b]:
                    short = pair_hash(short, w.reshape(1))
                sets.append(short)
            else:
                sets.append(h[:0])
        yield i, np.array([len(s) for s in sets], np.int64), np.concatenate(sets) if sets else h[:0]


def signatures(sizes: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """Minima (one row each permutation) of nonempty sets that lie one behind the other."""
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    low = (sets >> np.uint64(32)).astype(np.uint32) ^ sets.astype(np.uint32)
    out = np.empty((PERMUTATIONS, len(sizes)), np.uint32)
    v, t = np.empty_like(low), np.empty_like(low)
    for k in range(PERMUTATIONS):
        np.bitwise_xor(low, _B[k], out=v)
        np.multiply(v, _A[k], out=v)
        np.right_shift(v, np.uint32(15), out=t)
        np.bitwise_xor(v, t, out=v)
        np.multiply(v, np.uint32(0x2C1B3C6D), out=v)
        np.minimum.reduceat(v, starts, out=out[k])
    return out


def pack(minima: np.ndarray) -> np.ndarray:
    """Low BITS bits of each minimum as 64-bit words, bit planes one behind the other: PERMUTATIONS * BITS / 64 words a set."""
    planes = [((minima >> np.uint32(b)) & np.uint32(1)).astype(np.uint8).T for b in range(BITS)]
    return np.ascontiguousarray(np.packbits(np.concatenate(planes, axis=1), axis=1)).view(np.int64)


def band_keys(minima: np.ndarray) -> np.ndarray:
    m = minima.astype(np.uint64).reshape(BANDS, ROWS, -1)
    h = np.broadcast_to(_BAND[:, None], m[:, 0].shape)
    for r in range(ROWS):
        h = mix(h ^ m[:, r]) * np.uint64(0x9E3779B97F4A7C15)
    return h.T.view(np.int64)


SKETCH = "doc_id bigint, text_hash bigint, class bigint, check bigint, n bigint, sketch array<bigint>, bands array<bigint>"


def _class_ids(sizes: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """Of each set 128 bits of a cryptographic hash of all of it, as (class, check)."""
    ends = np.cumsum(sizes)
    digests = [hashlib.blake2b(sets[e - n : e], digest_size=16).digest() for n, e in zip(sizes, ends, strict=True)]
    return np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)


def _lists(values: np.ndarray) -> pa.Array:
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values).ravel()))


def _sketch(n: int):
    names = ["doc_id", "text_hash", "class", "check", "n", "sketch", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, sizes, sets in shingle_sets(batch.column(1), n):
                own, some = [batch.column(k).slice(i, len(sizes)) for k in (0, 2)], sizes > 0
                at, empty = np.flatnonzero(some), pa.array(np.flatnonzero(~some))
                if len(at):
                    classes, minima = _class_ids(sizes[at], sets), signatures(sizes[at], sets)
                    yield pa.RecordBatch.from_arrays([*(x.take(pa.array(at)) for x in own), *(pa.array(classes[:, k]) for k in (0, 1)), pa.array(sizes[at]), _lists(pack(minima)), _lists(band_keys(minima))], names=names)
                if len(empty):
                    none, lists = pa.nulls(len(empty), pa.int64()), pa.nulls(len(empty), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([*(x.take(empty) for x in own), none, none, pa.array(np.zeros(len(empty), np.int64)), lists, lists], names=names)

    return run


def _sets(n: int):
    """class, check and shingles of each set, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for _, sizes, sets in shingle_sets(batch.column(1), n):
                sizes = sizes[sizes > 0]
                if not len(sizes):
                    continue
                ends, classes = np.cumsum(sizes), _class_ids(sizes, sets)
                new = [t for t, c in enumerate(map(tuple, classes.tolist())) if not (c in seen or seen.add(c))]
                values = [sets[ends[t] - sizes[t] : ends[t]] for t in new]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes[new])]).astype(np.int32)), pa.array(np.concatenate([sets[:0], *values]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(pa.array(classes[new, k]) for k in (0, 1)), lists], names=["class", "check", "shingles"])

    return run


def estimate(a: Column, b: Column) -> Column:
    """Similarity of two packed sketches: the share of minima whose kept bits all agree, less what chance alone makes agree."""
    words = PERMUTATIONS // 64
    differ = None
    for w in range(words):
        planes = None
        for p in range(BITS):
            x = a[p * words + w].bitwiseXOR(b[p * words + w])
            planes = x if planes is None else planes.bitwiseOR(x)
        differ = F.bit_count(planes) if differ is None else differ + F.bit_count(planes)
    chance = 0.5**BITS
    return ((1 - differ / PERMUTATIONS) - chance) / (1 - chance)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs(a, b) of classes those whose full sets are similar enough."""
    left, right = sets.select(F.col("class").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("class").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs(doc_id, text).

    Rows of one shingle set, by 128 bits of a cryptographic hash of it, are one class.  Classes that share a band of minima meet in a bucket.
    First every member is held against one of each bucket, and of those candidates the one with the best estimate is confirmed on the full sets: pairs in
    proportion to rows.  The links give components; a bucket within one component can add none.  In the others all members are
    held against the largest component's hub, on full sets, and then those that aren't linked to it against all members with which they share enough of what
    sets them apart from the hub (see _beside): no link between components is lost, and a large group is never paired with itself.
    Estimates choose what is looked at first and leave nothing out.  What can be lost is a pair that shares no band, at the
    threshold once in 2e7.

    component_id is the smallest doc_id that links lead to.  A null or empty text has no shingles and no links, and is
    kept.  A row without doc_id takes part, and counts as the last of its component: component_id is null only where no row has an id,
    and kept then; elsewhere such a row isn't kept.  Rows repeated with an id all say kept if it is the component's.  A text of any length
    is one set; no rows give no rows.  Other columns are ignored.
    """
    return _near(docs, shingle_words, percent).select("doc_id", "n_shingles", "component_id", "kept")


def _near(docs: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """near_duplicates with each row's text_hash and the class that stands for its component."""
    text = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    rows = spool(text.mapInArrow(_sketch(shingle_words), SKETCH), "sketches")
    # hashes of class that several sets share, as good as always none
    shared = rows.where("class IS NOT NULL").groupBy("class").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low <> high").select("class")
    shared = spool(shared, "shared_classes")
    rows = _split(rows, shared)
    classes = rows.where("class IS NOT NULL").groupBy("class").agg(F.first("sketch").alias("sketch"), F.first("bands").alias("bands"), F.first("n").alias("n"), F.min("doc_id").alias("doc_id"))
    classes = spool(classes, "classes")
    sketch = classes.select("class", "n", "sketch")

    keys = classes.select("class", F.explode("bands").alias("bucket"))
    # a random member, another one in each bucket, so that a class meets many
    some = F.struct(F.xxhash64("bucket", "class").alias("h"), F.col("class").alias("first"))
    buckets = keys.groupBy(F.col("bucket").alias("k")).agg(F.min(some).alias("x"), F.count(F.lit(1)).alias("members")).where("members > 1").select("k", "x.first")
    members = spool(keys.join(spool(buckets, "buckets"), F.col("bucket") == F.col("k")).select("bucket", "class", "first"), "members")
    best = _best(members.where("class <> first").select(F.col("class").alias("a"), F.col("first").alias("b")), sketch, percent)

    # sets of the classes that may be confirmed; text moves once, for them only
    wanted = classes.join(members.select("class").distinct(), "class", "left_semi").select(F.col("doc_id").alias("id")).distinct()
    source = text.join(wanted, F.col("doc_id") == F.col("id"), "left_semi").unionByName(text.where("doc_id IS NULL")).select("doc_id", "text")
    sets = _split(source.mapInArrow(_sets(shingle_words), "class bigint, check bigint, shingles array<bigint>"), shared)
    sets = spool(sets.groupBy("class").agg(F.first("shingles").alias("shingles")), "sets")

    found = components(_confirm(best, sets, percent))
    at = spool(_between(members.select("bucket", "class"), found), "between")
    if not at.isEmpty():
        linked, beside = _beside(at, sets, percent)
        found = components(linked.unionByName(_confirm(beside, sets, percent)), found)
    found = found.select(F.col("node").alias("class"), "root")

    named = classes.select("class", "doc_id").join(found, "class", "left").select("class", "doc_id", F.coalesce("root", "class").alias("root"))
    named = spool(named, "named")
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id")).select(F.col("root").alias("r"), "component_id")
    named = spool(named.join(least, F.col("root") == F.col("r")).select(F.col("class").alias("c"), "root", "component_id"), "components")
    out = rows.select("doc_id", "text_hash", "n", "class").join(named, F.col("class") == F.col("c"), "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash", "root")


def _split(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """rows(class, check, ...) with another class for each check where several sets share the hash."""
    if shared.isEmpty():
        return rows
    mark = shared.select(F.col("class").alias("shared"))
    rows = rows.join(mark, F.col("class") == F.col("shared"), "left")
    return rows.withColumn("class", F.when(F.col("shared").isNull(), F.col("class")).otherwise(F.xxhash64("class", "check"))).drop("shared")


def _between(at: DataFrame, found: DataFrame) -> DataFrame:
    """Of buckets whose members are of several components: bucket, class, label, the label of the bucket's largest component and how large it is there."""
    label = at.join(found.select(F.col("node").alias("class"), "root"), "class", "left")
    label = spool(label.select("bucket", "class", F.coalesce("root", "class").alias("label")), "labels")
    parts = label.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    parts = parts.groupBy(F.col("bucket").alias("k")).agg(F.max(F.struct("n", "label")).alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    parts = spool(parts.select("k", F.col("most.label").alias("largest"), F.col("most.n").alias("weight")), "parts")
    return label.join(parts, F.col("bucket") == F.col("k")).select("bucket", "class", "label", "largest", "weight")


def _beside(at: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of members to the hub of their bucket's largest component, and pairs (a, b) of members of which neither or one is linked to it.

    Of a set x, let A be what the hub c has and x lacks, and B what x has and c lacks.  For two sets x and y that share s of these differences (in A
    and A, or in B and B), |x n y| = |c| - |A(x)| - |A(y)| + s.  So with p the percentage and w(x) = 100 |A(x)| + p |B(x)|, x is linked to
    c if w(x) <= (100 - p) |c|, and to y if (100 + p) s >= w(x) + w(y) - (100 - p) |c|.  If x isn't linked to c, it and y must then share one difference
    at least, and more than w(y) / (100 + p) of them.  They share one among the first of each, in any order common to all, that are left
    when the number needed is taken off: classes of w(y) by powers of 4 tell how many x needs at least.  What x has and c lacks comes first
    in that order, as that is what few have, and what many have comes last (see _order).  Of a group of copies, however large, only those meet that differ
    from the hub alike.
    """
    unit, step = 100 + percent, 4
    # the hub: the member of the largest component that meets the most others of it
    hubs = at.where("label = largest").groupBy(F.col("largest").alias("of"), "class").agg(F.sum("weight").alias("met")).groupBy("of").agg(F.max_by("class", F.struct("met", "class")).alias("hub"))
    hubs = hubs.join(sets.select(F.col("class").alias("hub"), F.col("shingles").alias("c")), "hub")
    own = at.select("class", "label", "largest").distinct().join(sets, "class").join(spool(hubs, "hubs"), F.col("largest") == F.col("of"))
    own = own.select("class", "label", "largest", "hub", F.size("c").alias("c"), F.array_except("shingles", "c").alias("more"), F.array_except("c", "shingles").alias("lacks"))
    w = (100 * F.size("lacks") + percent * F.size("more")).cast("bigint")
    # a difference is one number: the shingle that x has more, or a hash of the one that it lacks
    apart = F.concat(F.array_sort("more"), F.array_sort(F.transform("lacks", lambda h: F.xxhash64(h))))
    own = own.select("class", "label", "largest", "hub", ((100 - percent) * F.col("c")).cast("bigint").alias("free"), w.alias("w"), apart.alias("apart"))
    own = _order(spool(own, "apart"))
    linked = own.where("w <= free AND label <> largest").select(F.col("class").alias("a"), F.col("hub").alias("b"))

    needed = lambda w: F.greatest(F.lit(1), F.ceil((F.col("w") + w - F.col("free")) / unit))
    k = F.floor(F.log(float(step), F.col("w") / percent + 1) + 1e-9).cast("int")
    first = lambda need: F.posexplode(F.slice("apart", F.lit(1), F.greatest(F.lit(0), F.size("apart") - need + 1).cast("int"))).alias("pos", "d")
    y = own.select("class", "label", "largest", "w", "free", k.alias("k"), F.size("apart").alias("n"), first(needed(F.greatest(F.col("w"), F.col("free") + 1))))
    x = own.where("w > free").select("*", F.explode(F.sequence(F.lit(0), k)).alias("k"))
    low, high = percent * (F.pow(F.lit(float(step)), F.col("k")) - 1), percent * (F.pow(F.lit(float(step)), F.col("k") + 1) - 1)
    # one less and one more than the class's bounds, for rounded logarithms
    x = x.withColumn("need", needed(F.floor(low) - 1)).where(F.col("need") <= high / percent + 1)
    x = x.select("class", "label", "largest", "w", "k", F.size("apart").alias("n"), first(F.col("need")))
    x = x.select(*[F.col(c).alias(f"x_{c}") for c in ("class", "label", "largest", "w", "k", "n", "pos", "d")])
    same = (F.col("x_largest") == F.col("largest")) & (F.col("x_k") == F.col("k")) & (F.col("x_d") == F.col("d"))
    # of two that aren't linked to the hub the one that is further from it looks for the other
    turn = (F.col("w") <= F.col("free")) | (F.col("x_w") > F.col("w")) | (F.col("x_w") == F.col("w")) & (F.col("x_class") > F.col("class"))
    enough = F.least(F.col("x_n") - F.col("x_pos"), F.col("n") - F.col("pos")) >= (F.col("x_w") + F.col("w") - F.col("free")) / unit
    pairs = x.join(y, same & turn & enough & (F.col("x_label") != F.col("label"))).select(F.col("x_class").alias("a"), F.col("class").alias("b"))
    return linked, spool(pairs.distinct(), "beside")


def _order(own: DataFrame) -> DataFrame:
    """own with the differences that come often in a large group behind its others, the most frequent last: a common order, whichever ones these are.

    It is enough to know it about, so in groups of more than OFTEN members that many of them tell.
    """
    large = spool(own.groupBy(F.col("largest").alias("of")).agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > OFTEN).select("of"), "large")
    if large.isEmpty():
        return own
    some = own.join(large, F.col("largest") == F.col("of"), "left_semi").select("largest", "apart", F.row_number().over(W.partitionBy("largest").orderBy(F.xxhash64("class"))).alias("turn")).where(F.col("turn") <= OFTEN)
    often = some.select("largest", F.explode("apart").alias("d")).groupBy("largest", "d").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    often = often.groupBy(F.col("largest").alias("of")).agg(F.transform(F.array_sort(F.collect_list(F.struct("times", "d"))), lambda x: x["d"]).alias("often"))
    own = own.join(spool(often, "often"), F.col("largest") == F.col("of"), "left")
    none = F.array().cast("array<bigint>")
    later = F.coalesce("often", none)
    return spool(own.withColumn("apart", F.concat(F.array_except("apart", later), F.array_intersect(later, "apart"))).drop("of", "often"), "ordered")


def keep_one(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs, whatever their columns, for each component: one that near_duplicates keeps, with the least text hash if rows repeat its id.

    Of a component without any doc_id the row with the least text hash stays.  Rows that repeat an id and an empty text are one; rows without
    id and text are all kept.
    """
    near = _near(docs, shingle_words, percent)
    kept = near.where("kept AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("kept_id"), "root").agg(F.min("text_hash").alias("kept_hash"), F.count(F.lit(1)).alias("kept_rows"))
    nameless = near.where("component_id IS NULL AND root IS NOT NULL").groupBy("root", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    nameless = nameless.groupBy("root").agg(F.min(F.struct("text_hash", "n")).alias("x")).select(F.lit(None).cast("bigint").alias("kept_id"), "root", F.col("x.text_hash").alias("kept_hash"), F.col("x.n").alias("kept_rows"))
    kept = spool(kept.unionByName(nameless), "kept")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce(F.col("text").rlike(NOT_WS), F.lit(False)).alias("worded"))
    named = whole.where("doc_id IS NOT NULL").join(kept, (F.col("doc_id") == F.col("kept_id")) & (F.col("text_hash") == F.col("kept_hash")))
    rest = whole.where("doc_id IS NULL AND worded").join(kept.where("kept_id IS NULL"), F.col("text_hash") == F.col("kept_hash"))
    rows = named.unionByName(rest)
    out = rows.where("kept_rows = 1").select("row").unionByName(whole.where("doc_id IS NULL AND NOT worded").select("row"))
    if not kept.where("kept_rows > 1").isEmpty():
        out = out.unionByName(rows.where("kept_rows > 1").groupBy("kept_id", "root").agg(F.any_value("row").alias("row")).select("row"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def _best(pairs: DataFrame, sketch: DataFrame, percent: int) -> DataFrame:
    """Of each class's pairs the one with the best estimate, if that is near enough and the sizes allow it."""
    side = lambda x: sketch.select(F.col("class").alias(x), F.col("sketch").alias(f"k{x}"), F.col("n").alias(f"n{x}"))
    sized = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    pairs = pairs.distinct().join(side("a"), "a").join(side("b"), "b").where(sized).select("a", "b", estimate(F.col("ka"), F.col("kb")).alias("similar")).where(F.col("similar") >= percent / 100 - MARGIN)
    return spool(pairs.groupBy("a").agg(F.max(F.struct("similar", "b")).alias("x")).select("a", F.col("x.b").alias("b")), "best")
