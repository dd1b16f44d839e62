"""Secret scans: fixed patterns, and a battery of randomness tests with length-aware false-discovery control."""

from __future__ import annotations

import math
import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import spool

# Base patterns.  They run over the UTF-8 bytes with A-Z lower-cased (assign) or as they are.
ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
#: What the tests look at: unbroken runs of the letters of the encodings below, with the padding that ends them; a '=' before more letters cuts.
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_-]{16,}(?:=+(?![A-Za-z0-9+/_=-]))?")
#: The parts of a run that isn't random as a whole: its longest stretches in the letters of base64, base64url and base62.
STRETCHES = (re.compile(rb"[A-Za-z0-9+/]{16,}=*"), re.compile(rb"[A-Za-z0-9_-]{16,}=*"), re.compile(rb"[A-Za-z0-9]{16,}=*"))

#: Encodings in the order in which they are tried: the first whose alphabet has every character (padding aside) is inferred.
ENCODINGS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "upper36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_LETTERS = np.array([len(x) for x in ENCODINGS.values()], float)
#: by encoding and byte: the letter's place, and by byte: the encodings that have it, as bits
_PLACES, _HAVE = np.full((len(ENCODINGS), 256), -1, np.int16), np.zeros(256, np.uint16)
for _k, _letters in enumerate(ENCODINGS.values()):
    _PLACES[_k, np.frombuffer(_letters.encode(), np.uint8)] = np.arange(len(_letters))
    _HAVE[np.frombuffer(_letters.encode(), np.uint8)] |= np.uint16(1 << _k)

#: A run that the battery rejects as random at this level is no secret.
FIT = 0.01
#: Of the spans added, at most this share should be ordinary text.
DISCOVERY = 0.01
#: Where an encoding shows no ordinary text: how often two of its letters agree in a run, and the letters that this counts as.
TEXT, PRIOR = 0.04, 1_000


def _erfc(z: np.ndarray) -> np.ndarray:
    return np.array([math.erfc(x) for x in z.tolist()])


class Battery:
    """encoding (its place in ENCODINGS), length, p-value of randomness, chi-squared as a deviate and collisions of many runs at once; only of
    those that are tested: 16 letters or more, all of one encoding."""

    def __init__(self, body: np.ndarray, start: np.ndarray, end: np.ndarray):
        """Runs are spans of body, padding included.

        Three tests, Bonferroni-combined: chi-squared of the letters against uniform, with the exact mean and variance for this length; the number of
        runs above and below the alphabet's middle; and the correlation of each letter's place with the next one's.
        """
        size = end - start
        while len(size) and (pad := (size > 0) & (body[start + size - 1] == 61)).any():
            size = size - pad
        fit = np.flatnonzero(size >= 16)
        start, size = start[fit], size[fit]
        first = np.cumsum(size) - size
        codes = body[np.arange(size.sum()) - np.repeat(first - start, size)]
        # letters as bits of the encodings that have them: what is left of a run's is the encodings that fit, the first of which counts
        left = np.bitwise_and.reduceat(_HAVE[codes], first) if len(size) else np.zeros(0, np.uint16)
        some = left > 0
        self.tested = fit[some]
        kind = np.log2(left[some] & -left[some].astype(np.int32)).astype(np.int64)
        codes, size = codes[np.repeat(some, size)], size[some]
        first = np.cumsum(size) - size
        self.kind, self.n, n = kind, size, size.astype(float)
        if not len(size):
            self.p = self.z = self.same = n
            return
        run = np.repeat(np.arange(len(size)), size)
        at = _PLACES[kind[run], codes].astype(float)
        a = _LETTERS[kind]
        cells, counts = np.unique(run * 64 + at.astype(np.int64), return_counts=True)
        squares = np.bincount(cells // 64, counts.astype(float) ** 2, len(size))
        self.same = (squares - n) / (n * (n - 1))
        self.z = (squares * a / n - n - (a - 1)) / np.sqrt(2 * (a - 1) * (n - 1) / n)
        high = at >= a[run] / 2
        inner = np.ones(len(run), bool)
        inner[first] = False
        up = np.add.reduceat(high.astype(float), first)
        mean = 2 * up * (n - up) / n + 1
        spread = np.sqrt(np.maximum(1e-9, (mean - 1) * (mean - 2) / (n - 1)))
        turns = 1 + np.add.reduceat((inner & (high != np.roll(high, 1))).astype(float), first)
        z_runs = np.where((up == 0) | (up == n), n, (turns - mean) / spread)
        x = at - (np.add.reduceat(at, first) / n)[run]
        power, ahead = np.add.reduceat(x * x, first), np.add.reduceat(np.where(inner, x * np.roll(x, 1), 0.0), first)
        z_serial = np.where(power > 0, (ahead / np.where(power > 0, power, 1) * n + 1) / np.sqrt(n), n)
        p_chi = np.where(self.z > 0, _erfc(self.z / math.sqrt(2)) / 2, 1.0)
        self.p = np.minimum(1.0, 3 * np.minimum(p_chi, np.minimum(_erfc(np.abs(z_runs) / math.sqrt(2)), _erfc(np.abs(z_serial) / math.sqrt(2)))))

    def rows(self) -> dict[int, tuple[str, int, float, float, float]]:
        names = list(ENCODINGS)
        columns = (x.tolist() for x in (self.tested, self.kind, self.n, self.p, self.z, self.same))
        return {t: (names[k], n, p, z, same) for t, k, n, p, z, same in zip(*columns, strict=True)}


def _evidence(tested: tuple[str, int, float, float, float]) -> float:
    """How many deviates a run is more uniform than ordinary text of its length, as a negative number."""
    name, n, _, z, _ = tested
    a = len(ENCODINGS[name])
    excess = max(0.0, a * max(2 / a, TEXT) - 1) * (n - 1)
    return (z - excess / math.sqrt(2 * (a - 1))) / math.sqrt(1 + 2 * excess / (a - 1))


def run_tests(text: bytes, spans: list[tuple[int, int, str]], fit: float = FIT) -> list[tuple[int, int, tuple[str, int, float, float, float], bool]]:
    """(start, end, battery's result, chosen) of what is tested in a text, by start, apart from spans.

    A run is tested as a whole; if no encoding fits it, it isn't random or it meets a span, its stretches are as well.  Chosen are tested parts that
    don't overlap: random ones first, the most uniform before others, then the longest.  Takes time in proportion to the text and its runs.
    """
    starts = np.array([s for s, _, _ in spans], np.int64)
    reach = np.maximum.accumulate(np.array([e for _, e, _ in spans], np.int64)) if spans else starts
    body = np.frombuffer(text, np.uint8)

    def tests(parts: list[tuple[int, int]]) -> dict[int, tuple[str, int, float, float, float]]:
        """Results, by place in parts, of those that meet no span and fit an encoding."""
        at = np.array(parts, np.int64).reshape(-1, 2)
        i = np.searchsorted(starts, at[:, 1])
        free = np.ones(len(at), bool)
        free[i > 0] = reach[i[i > 0] - 1] <= at[i > 0, 0]
        own = np.flatnonzero(free)
        return {int(own[k]): b for k, b in Battery(body, at[own, 0], at[own, 1]).rows().items()}

    runs = [m.span() for m in CANDIDATE.finditer(text)]
    whole = tests(runs)
    out = [(*runs[k], b, True) for k, b in whole.items() if b[2] >= fit]
    mixed = [k for k in range(len(runs)) if k not in whole or whole[k][2] < fit]
    parts, of = [], []
    for k in mixed:
        s, e = runs[k]
        found = {(m.start(), m.end()) for stretch in STRETCHES for m in stretch.finditer(text, s, e)} - ({(s, e)} if k in whole else set())
        parts += sorted(found)
        of += [k] * len(found)
    by: dict[int, dict[tuple[int, int], tuple]] = {k: {runs[k]: whole[k]} if k in whole else {} for k in mixed}
    for k, b in tests(parts).items():
        by[of[k]][parts[k]] = b
    for found in by.values():
        taken, chosen = [], set()
        for (s, e), b in sorted(found.items(), key=lambda x: (x[1][2] < fit, _evidence(x[1]) if x[1][2] >= fit else -x[1][1], x[0])):
            i = bisect_left(taken, (e,))
            if not i or taken[i - 1][1] <= s:
                insort(taken, (s, e))
                chosen.add((s, e))
        out += [(*at, b, at in chosen) for at, b in found.items()]
    return sorted(out, key=lambda x: x[:2])


def base_spans(text: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes, by start, then assign, access, hex."""
    low = text.lower()
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(low) if m.end(1) - m.start(1) >= 8]
    spans += [(m.start(), 1, m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [(m.start(), 2, m.end(), "hex") for m in HEX.finditer(text)]
    return [(s, e, kind) for s, _, e, kind in sorted(spans)]


SCANNED = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base string, runs array<struct<start:bigint,end:bigint,encoding:string,n:int,p:double,z:double,same:double,chosen:boolean>>"


def _points(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code points before each byte offset."""
    return offsets - np.searchsorted(np.flatnonzero((body & 0xC0) == 0x80), offsets)


def _scan(batches: Iterator[pa.RecordBatch], fit: float = FIT) -> Iterator[pa.RecordBatch]:
    fields = [("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.string()), ("n", pa.int32()), ("p", pa.float64()), ("z", pa.float64()), ("same", pa.float64()), ("chosen", pa.bool_())]
    for batch in batches:
        counts, bases, ends, runs = [], [], [0], [[] for _ in fields]
        for text in batch.column(1):
            body = text.as_buffer().to_pybytes() if text.is_valid else b""
            spans = base_spans(body)
            tested = run_tests(body, spans, fit)
            at = _points(np.frombuffer(body, np.uint8), np.array([x for s in (*spans, *tested) for x in s[:2]], np.int64)).reshape(-1, 2).tolist()
            counts.append([sum(k == name for _, _, k in spans) for name in ("assign", "access", "hex")])
            bases.append(",".join(f"{k}:{s}:{e}" for (_, _, k), (s, e) in zip(spans, at, strict=False)))
            for (s, e), (_, _, b, chosen) in zip(at[len(spans) :], tested, strict=True):
                for column, x in zip(runs, (s, e, *b, chosen), strict=True):
                    column.append(x)
            ends.append(len(runs[0]))
        n = np.array(counts, np.int64).reshape(-1, 3)
        rows = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(x, k) for x, (_, k) in zip(runs, fields, strict=True)], [name for name, _ in fields]))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(n[:, k]) for k in range(3)), pa.array(bases, pa.string()), rows], names=["doc_id", "n_assign", "n_access", "n_hex", "base", "runs"])


def secret_spans(docs: DataFrame, fit: float = FIT, discovery: float = DISCOVERY) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row of docs(doc_id, text).

    Base spans are the patterns' matches.  Beside them every run of 16 or more encoding characters is tested, and the stretches
    of one that isn't random as a whole (a path, say, that has a key in it): what the battery holds to be random at level fit is a candidate, of parts that
    overlap only the most uniform.  How likely ordinary text of that length is to look as uniform comes from the corpus itself: per
    encoding, the mean chance that two letters of a run agree shifts its chi-squared in proportion to length, so a short run can't be
    significant and a long one can.  These p-values are held to the discovery rate by the Benjamini-Hochberg rule over all runs
    tested, on a histogram of 1/16 steps of log2 p, summed over all documents.

    spans are kind:start:end in code points, end exclusive, comma-joined by start; kinds assign, access, hex, then random.
    A null text is empty, and an empty one has no spans; a long text is scanned as a whole, in time in proportion to it.  Repeated rows get a
    row each; no rows give no rows; columns beyond doc_id and text are ignored.
    """
    rows = docs.select("doc_id", "text").mapInArrow(lambda batches: _scan(batches, fit), SCANNED)
    rows = spool(rows.select("*", F.monotonically_increasing_id().alias("row")), "scanned")
    tested = rows.select(F.explode("runs").alias("r")).select("r.*")
    letters = F.create_map(*[F.lit(x) for name, a in ENCODINGS.items() for x in (name, len(a))])
    # one row an encoding: the letters' agreement in ordinary text, that is in runs which aren't random; as if each encoding had PRIOR letters
    # of text that agree as often as in prose, or twice as often as random ones, and just so where no more runs fail than random ones would
    text = tested.where("chosen").select("encoding", "same", "n", (F.col("p") < fit).cast("int").alias("fails")).groupBy("encoding").agg(F.sum(F.col("fails") * F.col("same") * F.col("n")).alias("same"), F.sum(F.col("fails") * F.col("n")).alias("n"), F.sum("fails").alias("failed"), F.count(F.lit(1)).alias("runs"))
    twice = F.greatest(2 / letters[F.col("encoding")], F.lit(TEXT))
    agree = F.when(F.col("failed") > 10 + 3 * fit / (1 - fit) * (F.col("runs") - F.col("failed")), (F.col("same") + PRIOR * twice) / (F.col("n") + PRIOR)).otherwise(twice)
    text = spool(text.select(F.col("encoding").alias("e"), agree.alias("agree")), "agreement")
    each = rows.select("row", F.explode("runs").alias("r")).select("row", "r.*").join(text, F.col("encoding") == F.col("e"))
    a = letters[F.col("encoding")].cast("double")
    excess = F.greatest(F.lit(0.0), a * F.col("agree") - 1) * (F.col("n") - 1)
    mean, spread = excess / F.sqrt(2 * (a - 1)), F.sqrt(1 + 2 * excess / (a - 1))
    # log2 of the chance that text gives a deviate of z or less, by the normal tail
    t = (F.col("z") - mean) / spread
    log2p = F.when(t > 0, 0.0).otherwise(-(t * t) / 2 / math.log(2) - F.log2(F.greatest(F.lit(2.0), -t * math.sqrt(2 * math.pi))))
    each = spool(each.select("row", "start", "end", ((F.col("p") >= fit) & F.col("chosen")).alias("fits"), F.ceil(F.greatest(log2p, F.lit(-1000.0)) * 16).alias("step")), "tested")
    steps = each.groupBy("step").agg(F.sum(F.col("fits").cast("bigint")).alias("fits"), F.count(F.lit(1)).alias("n"))
    upto = W.orderBy("step").rowsBetween(W.unboundedPreceding, W.currentRow)
    steps = steps.select("step", F.sum("fits").over(upto).alias("found"), F.sum("n").over(W.partitionBy(F.lit(0))).alias("all"))
    last = steps.where((F.col("found") > 0) & (F.pow(F.lit(2.0), F.col("step") / 16) * F.col("all") <= discovery * F.col("found"))).agg(F.max("step").alias("last"))
    last = last.first()["last"]  # one number
    added = each.where(F.col("fits") & (F.col("step") <= F.lit(last).cast("bigint")))
    added = added.groupBy(F.col("row").alias("r")).agg(F.collect_list(F.struct("start", "end")).alias("more"))
    known = F.filter(F.split("base", ","), lambda x: x != "")
    part = lambda x, k: F.split(x, ":")[k]
    as_row = lambda x: F.struct(part(x, 1).cast("bigint").alias("s"), F.array_position(F.array(*map(F.lit, ("assign", "access", "hex"))), part(x, 0)).alias("k"), x.alias("x"))
    random = F.transform(F.coalesce("more", F.array().cast("array<struct<start:bigint,end:bigint>>")), lambda m: F.struct(m["start"].alias("s"), F.lit(4).cast("bigint").alias("k"), F.concat(F.lit("random:"), m["start"], F.lit(":"), m["end"]).alias("x")))
    spans = F.array_join(F.transform(F.array_sort(F.concat(F.transform(known, as_row), random)), lambda x: x["x"]), ",")
    out = rows.join(added, F.col("row") == F.col("r"), "left")
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), spans.alias("spans"))

