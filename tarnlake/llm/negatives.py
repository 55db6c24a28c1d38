"""Hard negatives by product quantisation with stored residual norms.

Vectors are made integers (floor of ``scale`` times a component) and cut into subspaces of two components. Codebooks, one a
subspace, are fitted on a bounded draw of rows (``draw``: those of the least hashes of their ids); every row is indexed by its
codes and the norm of what the codes leave out, its residual. For an anchor a table holds its products with all centres; the
score of a row is the sum of its looked-up entries, give or take the anchor's norm times the row's residual norm. This bound,
widened by what single precision may lose, is rigorous: a row is left out only if it cannot be among those asked for. The
others are reranked by exact integer products, so that results do not depend on the codebooks.

Anchors are a stated query set: they go through the driver in blocks of ``block`` rows, are broadcast, and meet all rows of the
index, of which a task keeps the best few for each anchor. A first pass finds an anchor's positives, the best other rows of
its label; a second one fills for each positive the window of negatives: rows of other labels whose score is at least
``low`` and at most ``high`` hundredths of the positive's.

Rows without an id, label or vector, and those with a null or non-finite component, take no part. Shorter vectors are filled with
zeros, so that the product runs over the places that both have. An anchor is not its own positive, but a repeated row of its
id is. Scores that do not fit a long raise an error. Equal scores go by the smaller id. An empty table gives an empty one.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import store
from ..storage import new_folder

_WIDTH, _CENTRES, _TILE, _ANCHORS = 2, 256, 2048, 256
INDEX = "chunk long, n int, ids binary, labels binary, vectors binary, codes binary, residuals binary"
MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _vectors(column: pa.Array, dims: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(integers as doubles, filled up to dims; which rows are whole)."""
    whole = ~np.asarray(column.is_null())
    sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0), np.int64)
    flat = column.flatten()
    missing = np.asarray(flat.is_null())
    values = np.asarray(pa.compute.fill_null(flat, 0).cast(pa.float64()), np.float64)
    row = np.repeat(np.arange(len(column)), sizes)
    whole[row[missing | ~np.isfinite(values)]] = False
    out = np.zeros((len(column), dims))
    with np.errstate(all="ignore"):
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.floor(scale * values)
    return out, whole


def codebooks(sample: np.ndarray, rounds: int = 6, seed: int = 1) -> np.ndarray:
    """(subspaces, centres, width) by k-means of each subspace on its own."""
    rng, parts = np.random.default_rng(seed), sample.shape[1] // _WIDTH
    books = np.zeros((parts, _CENTRES, _WIDTH), np.float32)
    for m in range(parts):
        points = sample[:, m * _WIDTH : (m + 1) * _WIDTH].astype(np.float32)
        distinct = np.unique(points, axis=0)
        k = min(_CENTRES, len(distinct))
        centres = rng.permutation(distinct)[:k]
        for _ in range(rounds if k == _CENTRES else 0):
            own = _nearest(points, centres)
            n = np.bincount(own, minlength=k)
            sums = np.stack([np.bincount(own, points[:, d], k) for d in range(_WIDTH)], 1)
            centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres).astype(np.float32)
        books[m, :k] = centres
    return books


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1)[None, :] - 2 * (points @ centres.T), 1)


def encode(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes, and by row what its norm of the residual and the rounding of single precision may add for each unit of an anchor's norm."""
    codes, rest, met = np.empty((len(vectors), len(books)), np.uint8), np.zeros(len(vectors)), np.zeros(len(vectors))
    with np.errstate(all="ignore"):
        for m, centres in enumerate(books):
            part = vectors[:, m * _WIDTH : (m + 1) * _WIDTH]
            codes[:, m] = _nearest(part.astype(np.float32), centres)
            chosen = centres[codes[:, m]].astype(np.float64)
            rest += ((part - chosen) ** 2).sum(1)
            met += (chosen**2).sum(1)
        return codes, ((np.sqrt(rest) + 1e-5 * (np.sqrt(met) + 1)) * (1 + 1e-5)).astype(np.float32)


def tables(anchors: np.ndarray, books: np.ndarray) -> np.ndarray:
    """(subspaces, centres, anchors): the products of anchors with all centres."""
    with np.errstate(all="ignore"):
        return np.stack([(c.astype(np.float64) @ anchors[:, m * _WIDTH : (m + 1) * _WIDTH].T).astype(np.float32) for m, c in enumerate(books)])


def looked_up(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    out, held = np.zeros((len(codes), table.shape[2]), np.float32), np.empty((len(codes), table.shape[2]), np.float32)
    for m in range(len(table)):
        np.take(table[m], codes[:, m], axis=0, out=held)
        out += held
    return out


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact integer products of rows."""
    if not len(x):
        return np.empty(0, np.int64)
    if float(np.abs(x).max()) * float(np.abs(y).max()) * max(1, x.shape[1]) < 2**53:
        return np.einsum("ij,ij->i", x, y).astype(np.int64)
    out = [sum(int(a) * int(b) for a, b in zip(p, q, strict=True)) for p, q in zip(x.tolist(), y.tolist(), strict=True)]
    if any(not -(2**63) <= s < 2**63 for s in out):
        raise ValueError("a score does not fit a long")
    return np.array(out, np.int64)


def _best(key: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each key, by the higher score and then the smaller id."""
    order = np.lexsort((ids, -score, key))
    ordered = key[order]
    begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(key) else np.empty(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    return order[rank < k]


class Search:
    """The best ``k`` rows for each of some windows of each anchor, as far as a task has seen them.

    anchors: dict of arrays ids, labels, chunks, places, vectors; low, high: (anchors, windows) limits of exact scores.
    """

    def __init__(self, anchors: dict[str, np.ndarray], low: np.ndarray, high: np.ndarray, same: bool, k: int, books: np.ndarray):
        self.anchors, self.low, self.high, self.same, self.k, self.books = anchors, low, high, same, k, books
        self.least = low.astype(np.float64).copy()  # no row below can be among the best
        self.norms = (np.sqrt((anchors["vectors"] ** 2).sum(1)) * (1 + 1e-6)).astype(np.float32)
        self.found = [np.empty(0, np.int64)] * 3  # anchor * windows + window, score, id
        self.reranked = 0

    def see(self, chunk: int, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, codes: np.ndarray, residuals: np.ndarray) -> None:
        a = self.anchors
        for first in range(0, len(a["ids"]), _ANCHORS):
            own = slice(first, first + _ANCHORS)
            table = tables(a["vectors"][own], self.books)
            for top in range(0, len(ids), _TILE):
                rows = slice(top, top + _TILE)
                score = looked_up(table, codes[rows])
                with np.errstate(all="ignore"):
                    give = residuals[rows][:, None] * self.norms[own][None, :]
                    high, low = score + give, score - give
                fits = (labels[rows][:, None] == a["labels"][own][None, :]) == self.same
                here = np.flatnonzero((a["chunks"][own] == chunk) & (a["places"][own] >= top) & (a["places"][own] < top + _TILE))
                fits[a["places"][own][here] - top, here] = False
                self._take(first, own, fits, low, high, ids[rows], vectors[rows])

    def _take(self, first: int, own: slice, fits: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        windows, n = self.low.shape[1], len(ids)
        if n >= self.k:
            for w in range(windows):
                open_ = np.flatnonzero(self.least[own, w] <= self.low[own, w])  # not yet k rows: the bounds alone may tell the k-th
                if len(open_):
                    sure = fits[:, open_] & (low[:, open_] >= self.low[own, w][open_]) & (high[:, open_] <= self.high[own, w][open_])
                    kth = np.partition(np.where(sure, low[:, open_], -np.inf), n - self.k, axis=0)[n - self.k]
                    self.least[first + open_, w] = np.fmax(self.least[first + open_, w], kth)
        wanted = np.zeros_like(fits)
        for w in range(windows):
            wanted |= ~(high < self.least[own, w][None, :]) & ~(low > self.high[own, w][None, :])
        row, anchor = np.nonzero(wanted & fits)
        self.reranked += len(row)
        exact = products(vectors[row], self.anchors["vectors"][own][anchor])
        parts = [self.found]
        for w in range(windows):
            good = np.flatnonzero((exact >= self.low[own, w][anchor]) & (exact <= self.high[own, w][anchor]) & (exact >= self.least[own, w][anchor]))
            parts.append([(first + anchor[good]) * windows + w, exact[good], ids[row[good]]])
        found = [np.concatenate([p[i] for p in parts]) for i in range(3)]
        keep = _best(*found, self.k)
        self.found = [x[keep] for x in found]
        keys, counts = np.unique(self.found[0], return_counts=True)
        full = keys[counts == self.k]
        last = np.searchsorted(self.found[0], full, "right") - 1
        self.least.reshape(-1)[full] = np.maximum(self.least.reshape(-1)[full], self.found[1][last])


def index(rows: DataFrame, books: np.ndarray, dims: int, scale: float, size: int = 8192) -> DataFrame:
    """Packed rows (k, label, v) with their codes and residual norms."""

    def run(batches):
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for top in range(0, batch.num_rows, size):
                part = batch.slice(top, size)
                vectors, whole = _vectors(part.column(2), dims, scale)
                whole &= ~np.asarray(part.column(0).is_null()) & ~np.asarray(part.column(1).is_null())
                if not whole.any():
                    continue
                ids, labels = (np.asarray(pa.compute.fill_null(part.column(i), 0))[whole] for i in (0, 1))
                codes, residuals = encode(vectors := vectors[whole], books)
                kind = np.int16 if np.abs(vectors).max(initial=0) < 2**15 else np.float64
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((chunk, len(ids), ids.tobytes(), labels.tobytes(), vectors.astype(kind).tobytes(), codes.tobytes(), residuals.tobytes()), (pa.int64(), pa.int32(), *[pa.binary()] * 5), strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])
                chunk += 1

    return rows.mapInArrow(run, INDEX)


def _unpacked(batch: pa.RecordBatch, dims: int, parts: int):
    for chunk, n, ids, labels, vectors, codes, residuals in zip(*(batch.column(c).to_pylist() for c in ("chunk", "n", "ids", "labels", "vectors", "codes", "residuals")), strict=True):
        kind = np.int16 if len(vectors) == 2 * n * dims else np.float64
        yield chunk, np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), np.frombuffer(vectors, kind).reshape(n, dims).astype(np.float64), np.frombuffer(codes, np.uint8).reshape(n, parts), np.frombuffer(residuals, np.float32)


def _searched(made: DataFrame, sent, k: int, same: bool, dims: int) -> DataFrame:
    """(anchor, win, id, score): the best k of each window; sent: broadcast (anchors, low, high, books)."""

    def run(batches):
        anchors, low, high, books = sent.value
        search = Search(anchors, low, high, same, k, books)
        for batch in batches:
            for part in _unpacked(batch, dims, len(books)):
                search.see(*part)
        key, score, ids = search.found
        yield pa.RecordBatch.from_arrays([pa.array(key // low.shape[1], pa.int32()), pa.array(key % low.shape[1], pa.int32()), pa.array(ids, pa.int64()), pa.array(score, pa.int64())], names=["anchor", "win", "id", "score"])

    best = Window.partitionBy("anchor", "win").orderBy(F.desc("score"), "id")
    return made.mapInArrow(run, "anchor int, win int, id long, score long").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: str, *, key: str = "vec_id", label: str = "label", vector: str = "embedding", scale: float = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, draw: int = 8192, block: int = 8192) -> DataFrame:
    """MINED rows: for each anchor and each of its positives, the window's negatives by rank.

    ``is_anchor`` is a condition on the column ``id`` in SQL, such as "id % 100 = 0".
    """
    spark = rows.sparkSession
    own = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v"))
    dims = own.agg(F.max(F.size("v"))).first()[0]
    if dims is None or dims < 0:
        return spark.createDataFrame([], MINED)
    dims = max(_WIDTH, dims + dims % _WIDTH)
    drawn = own.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(draw).select("v").toArrow().column(0)
    sample, whole = _vectors(drawn.combine_chunks() if drawn.num_chunks else pa.array([], drawn.type), dims, scale)
    books = codebooks(sample[whole])
    made = store(index(own, books, dims, scale), "index")

    def chosen(batches):
        for batch in batches:
            for chunk, ids, labels, vectors, _, _ in _unpacked(batch, dims, len(books)):
                for p in range(0, len(ids), 1024):
                    n = min(1024, len(ids) - p)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[p : p + n]), pa.array(labels[p : p + n]), pa.array([chunk] * n, pa.int64()), pa.array(range(p, p + n), pa.int32()), pa.array([v.tobytes() for v in vectors[p : p + n]], pa.binary())], names=["id", "label", "chunk", "place", "v"])

    anchors = store(made.mapInArrow(chosen, "id long, label long, chunk long, place int, v binary").where(is_anchor), "anchors")
    path, n_blocks = new_folder(spark, "negatives"), 0
    waiting = anchors.toLocalIterator()
    while held := list(itertools.islice(waiting, block)):
        n_blocks += 1
        columns = {"ids": [r.id for r in held], "labels": [r.label for r in held], "chunks": [r.chunk for r in held], "places": [r.place for r in held]}
        group = {n: np.array(x, np.int64) for n, x in columns.items()} | {"vectors": np.stack([np.frombuffer(r.v) for r in held])}
        open_ = np.full((len(held), 1), -np.inf), np.full((len(held), 1), np.inf)
        sent = spark.sparkContext.broadcast((group, *open_, books))
        best = _searched(made, sent, positives, True, dims).toArrow()
        sent.unpersist()
        # a window without a positive takes no score
        place, rank, ids, score = (np.asarray(best.column(c), np.int64) for c in ("anchor", "rank", "id", "score"))
        lowest, highest = np.full((len(held), positives), np.inf), np.full((len(held), positives), -np.inf)
        own_id, own_score = np.zeros((2, len(held), positives), np.int64)
        own_id[place, rank - 1], own_score[place, rank - 1] = ids, score
        lowest[place, rank - 1] = [-(-low * s // 100) for s in score.tolist()]
        highest[place, rank - 1] = [high * s // 100 for s in score.tolist()]
        sent = spark.sparkContext.broadcast((group, lowest, highest, books))
        mined = _searched(made, sent, negatives, False, dims)
        told = spark.createDataFrame(pa.table({"anchor": pa.array(place, pa.int32()), "win": pa.array(rank - 1, pa.int32()), "anchor_id": group["ids"][place], "positive_id": ids, "positive_score": score}))
        mined.join(F.broadcast(told), ["anchor", "win"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)
        sent.unpersist()
    return spark.read.schema(MINED).parquet(path) if n_blocks else spark.createDataFrame([], MINED)
