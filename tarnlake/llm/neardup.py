"""Near-duplicate documents by SetSketch registers, banding, joint estimation and exact verification.

A document is the set of its distinct word shingles. Register i of its sketch is floor(1 - log_b(x)), cut to [0, q + 1],
of the least of exponential draws x that the set's elements make for i: registers of a union are maxima, so sketches
merge, and two sets agree in a register about as often as their Jaccard similarity. Documents of the same set are one class
(its least id stands for it). Bands - fixed picks of registers - put classes of equal values into buckets; each member is
paired with its bucket's least id. From the registers of a pair and the exact set sizes the similarity is estimated by
likelihood; pairs far below the threshold go, the others are compared on their full sets. A class is compared with one
leader first, and with others only as long as their components differ. When all leaders are done, the classes of buckets that still
hold several components are compared across these by an exact filter of prefixes and places, on full sets, so a link is lost
neither for its leader's sake nor by its estimate, while pairs inside a component are never made.

With 64 bands of 7 of 256 registers, a pair at similarity 0.8 shares no band with probability 3e-7; the estimate has a
standard error of 0.025 there and spares a comparison with a leader only 0.2 or more below the threshold. Draws are taken from
the upper 32 bits of a shingle's hash by 256 linear hashes; with base 1.001 a register tells draws a thousandth apart, so
registers of two sets agree about as often as their minima do.

Words are what white space parts, A-Z lower-cased. Fewer words than a shingle make one shingle of all; null and empty texts
have none and are linked with nothing. Rows of one id are one: what is linked with one of them is linked with all. Rows without an id are kept and not linked. Shingles
are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, lower_ascii, store
from .components import components

_MEMO: dict[bytes, int] = {}
_BASE, _RATE, _TOP = 1.001, 20.0, (1 << 16) - 2
_WIDTH, _BANDS, _ROWS = 256, 64, 7
_SLOTS = 1 << 20


def _numbers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_STEP = _numbers(64, 1)
_MULTIPLY = (_numbers(_WIDTH, 2) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ADD = (_numbers(_WIDTH, 3) >> np.uint64(31)).astype(np.uint32)
_PICKS = np.concatenate([np.random.default_rng(s).permutation(_WIDTH) for s in (4, 5)])[: _BANDS * _ROWS].reshape(_BANDS, _ROWS)
_WEIGH = _numbers(_ROWS, 6)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    ws = lower_ascii(text).split()
    if not ws:
        return np.empty(0, np.uint64)
    claim("shingles", _MEMO.clear)
    if len(_MEMO) > 300_000:
        _MEMO.clear()
    for w in set(ws).difference(_MEMO):
        _MEMO[w] = xxhash.xxh3_64_intdigest(w)
    of = np.fromiter(map(_MEMO.__getitem__, ws), np.uint64, len(ws))
    k = min(size, len(ws))
    n = len(ws) - k + 1
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out += of[j : j + n] * _STEP[j]
    return np.unique(_mix(out))


def registers(elements: np.ndarray) -> np.ndarray:
    """The sketch of a set of 64-bit hashes, as 16-bit values; of the empty set all 0."""
    if not len(elements):
        return np.zeros(_WIDTH, np.uint16)
    high = (elements >> np.uint64(32)).astype(np.uint32)
    least = np.full(_WIDTH, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(high), 512):
        draws = high[i : i + 512, None] * _MULTIPLY
        draws += _ADD
        np.minimum(least, draws.min(axis=0), out=least)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / _RATE
    return np.clip(np.floor(1 - np.log(x) / math.log(_BASE)), 0, _TOP + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


_GRID = np.linspace(0, 1, 201)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The likeliest Jaccard similarity of each pair of rows of registers, given the sets' sizes."""
    more, less = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.minimum(_GRID, np.minimum(u / v, v / u))

    def chance(x):
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (_BASE - 1) / _BASE) / math.log(_BASE), 1e-12, 1)

    p, q = chance(u - v * j), chance(v - u * j)
    likely = more * np.log(p) + less * np.log(q) + (a.shape[1] - more - less) * np.log(np.clip(1 - p - q, 1e-12, 1))
    return j[np.arange(len(j)), likely.argmax(axis=1)]


def sketch(docs: DataFrame, size: int, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, sig, regs): the number of shingles, a digest of the set (null if empty), and the registers."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                sets = [shingles(t, size) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()), pa.array([registers(s).tobytes() for s in sets], pa.binary())], names=["id", "n", "sig", "regs"])

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, "id long, n long, sig binary, regs binary")


def bands(classes: DataFrame) -> DataFrame:
    """(bucket, id, n): a row for each class and band."""

    def run(batches):
        number = np.arange(1, _BANDS + 1, dtype=np.uint64) * _STEP[0]
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, _WIDTH)
            keys = _mix((regs[:, _PICKS].astype(np.uint64) * _WEIGH).sum(axis=2, dtype=np.uint64) + number).astype(np.int64).ravel()
            rows = pa.array(np.repeat(np.arange(batch.num_rows), _BANDS))
            yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(0).take(rows), batch.column(1).take(rows)], names=["bucket", "id", "n"])

    return classes.select("id", "n", "regs").mapInArrow(run, "bucket long, id long, n long")


def _likely(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose estimated similarity is `least` or more."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, _WIDTH) for i in (2, 3))
            n_a, n_b = (batch.column(i).to_numpy().astype(float) for i in (4, 5))
            ok = np.concatenate([estimate(a[i : i + 512], b[i : i + 512], n_a[i : i + 512], n_b[i : i + 512]) for i in range(0, len(a), 512)]) >= least
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(ok)) for i in (0, 1)], names=["a", "b"])

    both = pairs.join(classes.select(F.col("id").alias("a"), F.col("regs").alias("ra"), F.col("n").alias("na")), "a").join(classes.select(F.col("id").alias("b"), F.col("regs").alias("rb"), F.col("n").alias("nb")), "b")
    return both.select("a", "b", "ra", "rb", "na", "nb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs whose full sets meet 100 * |intersection| >= percent * |union|."""

    def run(batches):
        last, own = None, None
        for batch in batches:
            keep = []
            for a, ta, tb in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if (a, ta) != last:
                    last, own = (a, ta), shingles(ta, size)
                other = shingles(tb, size)
                both = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(own) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], names=["a", "b"])

    with_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    both = with_b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _overlap(n, m, percent: int):
    """The least common elements of sets of n and m elements as near as `percent`."""
    return F.ceil(percent * (n + m) / (100 + percent))


def _across(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): the pairs of different components, of rows (id, component, text), that an exact filter of prefixes leaves.

    Shingles are put in one order, the rare ones first; sets as near as `percent` share one within the first
    n - ceil(percent * n / 100) + 1 of the larger and n - ceil(2 * percent * n / (100 + percent)) + 1 of the smaller. At the
    first shared one nothing before it is common, so what follows it in either set bounds the overlap: a pair whose bound
    is below what the threshold asks is never made. Where a family's members differ in shingles of their own, which come
    first, this leaves few pairs but the linked ones, however many members share the rest. Any order is exact, so rarity may
    be told by counts in a table of fixed size.
    """
    spark = rows.sparkSession

    def counted(batches):
        total = np.zeros(_SLOTS, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                np.add.at(total, (shingles(t, size) % np.uint64(_SLOTS)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    got = rows.select("text").mapInArrow(counted, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(_SLOTS, np.int64)
    table[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    sent = spark.sparkContext.broadcast(table)

    def first(batches):
        for batch in batches:
            ids, comps, sizes, tokens, places = [], [], [], [], []
            for k, c, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = shingles(t, size)
                n = len(own) - -(-percent * len(own) // 100) + 1
                order = np.lexsort((own, sent.value[(own % np.uint64(_SLOTS)).astype(np.int64)]))[:n]
                tokens.append(own[order].astype(np.int64))
                places.append(np.arange(len(order), dtype=np.int32))
                ids += [k] * len(order)
                comps += [c] * len(order)
                sizes += [len(own)] * len(order)
            columns = [np.concatenate(tokens or [np.empty(0, np.int64)]), np.array(ids, np.int64), np.array(comps, np.int64), np.array(sizes, np.int64), np.concatenate(places or [np.empty(0, np.int32)])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "id", "component", "n", "place"])

    marks = store(rows.select("id", "component", "text").mapInArrow(first, "token long, id long, component long, n long, place int"), "prefixes")
    by = marks.groupBy("token", "component").agg(F.count(F.lit(1)).alias("k"))
    # members of the largest component at a shingle meet those of the others, not each other
    major = by.groupBy("token").agg(F.max_by("component", F.struct("k", "component")).alias("major"), F.count(F.lit(1)).alias("components")).where("components > 1").select("token", "major")
    met = marks.join(major, "token").select("token", "id", "component", "n", "place", (F.col("component") == F.col("major")).alias("of_major"))
    larger = met.select("token", F.when(F.col("of_major"), 1).otherwise(0).alias("side"), F.col("id").alias("x"), F.col("component").alias("cx"), F.col("n").alias("nx"), F.col("place").alias("px"))
    smaller = met.where(F.col("n") - F.col("place") >= _overlap(F.col("n"), F.col("n"), percent))
    smaller = smaller.select("token", F.explode(F.when(F.col("of_major"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("side"), F.col("id").alias("y"), F.col("component").alias("cy"), F.col("n").alias("ny"), F.col("place").alias("py"))
    reached = F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) >= _overlap(F.col("nx"), F.col("ny"), percent)
    ordered = (F.col("ny") < F.col("nx")) | (F.col("ny") == F.col("nx")) & (F.col("x") < F.col("y"))
    fits = 100 * F.col("ny") >= percent * F.col("nx")
    pairs = larger.join(smaller, ["token", "side"]).where((F.col("cx") != F.col("cy")) & ordered & fits & reached)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _of_one_id(sketches: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): classes that rows of one id stand in, each with the least of them."""
    rows = sketches.where(F.col("sig").isNotNull() & F.col("id").isNotNull()).select("id", "sig")
    several = rows.groupBy("id").agg(F.min("sig").alias("low"), F.max("sig").alias("high")).where("low <> high").select("id")
    of = store(rows.join(several, "id").distinct().join(classes.select("sig", F.col("id").alias("b")), "sig").select("id", "b").distinct(), "ids")
    return of.join(of.groupBy("id").agg(F.min("b").alias("a")), "id").where("a <> b").select("a", "b")


def near_duplicates(docs: DataFrame, *, size: int = 5, percent: int = 80, margin: float = 0.2, rounds: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row; kept: the least id of its component."""
    sketches = store(sketch(docs, size, key=key, text=text), "sketches")
    classes = store(sketches.where(F.col("sig").isNotNull() & F.col("id").isNotNull()).groupBy("sig").agg(F.min(F.struct("id", "n", "regs")).alias("x")).select("sig", "x.id", "x.n", "x.regs"), "classes")
    dealt = bands(classes)
    # the sets' sizes alone rule out a pair: the smaller has at least percent of the larger
    fits = 100 * F.least("n", "nl") >= percent * F.greatest("n", "nl")
    leaders = dealt.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("x"), F.count(F.lit(1)).alias("members")).where("members > 1").select("bucket", F.col("x.id").alias("leader"), F.col("x.n").alias("nl"))
    shared = store(dealt.join(leaders, "bucket"), "buckets")
    # whole texts are needed of what may be linked alone; they are dealt out once for all comparisons; an id may have several
    wanted = shared.select("id").distinct()
    texts = store(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).join(wanted, "id", "left_semi").dropDuplicates(["id", "text"]), "texts")

    def linked(pairs: DataFrame) -> DataFrame:
        return store(_verified(store(_likely(pairs, classes, percent / 100 - margin).distinct(), "pairs"), texts, size, percent), "near-links")

    # a class meets many leaders; it is compared with one of each component, the one it shares most buckets with, and only
    # where that fails, and the components still differ, with the next and at last with all others
    stars = store(shared.where((F.col("id") != F.col("leader")) & fits).groupBy(F.col("leader").alias("a"), F.col("id").alias("b")).agg(F.count(F.lit(1)).alias("n")), "stars")
    links, first, tried = None, None, None
    for step in range(rounds + 1):
        apart = stars
        if first is not None:
            apart = apart.join(tried, ["a", "b"], "left_anti").join(first.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left").join(first.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
            apart = apart.withColumn("ca", F.coalesce("ca", "a")).where(F.col("ca") != F.coalesce("cb", "b"))
        else:
            apart = apart.withColumn("ca", F.lit(0).cast("long"))
        if step < rounds:
            apart = apart.groupBy("b", "ca").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a"))
        apart = store(apart.select("a", "b"), "compared")
        if apart.isEmpty():
            break
        found = linked(apart)
        tried = apart if tried is None else tried.unionByName(apart)
        links = found if links is None else links.unionByName(found)
        first = components(links)
    if first is None:  # no bucket holds two classes
        links = classes.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
        first = classes.select("id", F.col("id").alias("component")).limit(0)
    # buckets in which the components found so far do not meet
    labelled = shared.join(first, "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_ = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("bucket")
    rest = store(labelled.join(open_, "bucket").select("id", "component").distinct(), "open-classes")
    # the filter is exact and leaves few pairs: all are compared on their full sets, whatever their estimate
    later = store(_verified(store(_across(rest.join(texts, "id"), size, percent), "pairs"), texts, size, percent), "near-links")
    more = later.unionByName(_of_one_id(sketches, classes))
    known = first if more.isEmpty() else components(links.unionByName(more))
    of_class = classes.select("sig", F.col("id").alias("class_id")).join(known.withColumnRenamed("id", "class_id"), "class_id", "left").select("sig", F.coalesce("component", "class_id").alias("component"))
    own = sketches.select("id", "n", "sig").join(of_class, "sig", "left").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
    return own.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
