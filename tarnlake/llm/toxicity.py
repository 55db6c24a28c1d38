"""Toxicity by maximum-scoring segments of token log-odds.

``fit`` counts, over labelled texts, in how many toxic and clean ones each unit occurs. A unit is a word or a word's first
4 to 7 bytes, so that an unseen ending of a known stem still counts. Its log-odds ratio is taken under an informative
Dirichlet prior, the pooled counts scaled by ``prior``. A word scores its ratio where that is ``z`` standard errors from 0 - as
its own unit, or, where that is toxic by ``least`` at least, by its longest known stem - and 0 elsewhere, less ``drift``, which keeps
the mean over clean words below 0. ``segments`` finds all maximal scoring segments in linear time. A segment's score is
calibrated by the extreme-value law of such maxima: lambda solves E[exp(lambda * score)] = 1 over the scores of the words of
clean texts, and among n words a segment of score S or more is expected K * n * exp(-lambda * S) times by chance. K is
the likeliest for the best segments of the clean texts, those without any counted as below the least score that a word has. Segments
expected at most ``chance`` times are significant. A document's statistic sums lambda * S - ln(K * n) over them; a logistic curve,
fitted to the same labelled texts, makes it a score.

Null and empty texts have no words and the score of a text without any toxic segment. Repeated rows are scored each.
Labels are joined by key; keys with several labels count as toxic if any is. Texts without a label are never learned from.
Without toxic or without clean texts, as of empty tables, there is nothing to learn: every text gets 0. Of other columns only
the key, the text and the label are read, whatever the names of the rest.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store

#: ASCII that is no letter ends a word; case was folded before.
_TABLE = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_STEMS = (4, 5, 6, 7)


def words(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_TABLE).split() if text else []


def units(word: bytes) -> list[bytes]:
    """The word, and its stems with a mark that no word has; the most specific first."""
    return [word, *(b"^" + word[:n] for n in reversed(_STEMS) if len(word) > n or n == 4 and len(word) == 4)]


def segments(scores) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a sequence of numbers, in linear time.

    Candidates keep the running sums before and after them; a new one joins back to the nearest candidate whose sum
    before is less, if that one's sum after is less than its own, and swallows all between.
    """
    found: list[list] = []  # first, last, sum before, sum after, nearest candidate whose sum before is less
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        own = [i, i, before, total, -1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= own[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= own[3]:
                own[4] = j
                found.append(own)
                break
            own = [found[j][0], own[1], found[j][2], own[3], -1]
            del found[j:]
    return [(a, b, after - before) for a, b, before, after, _ in found]


@dataclass
class Model:
    scores: dict[bytes, float]
    drift: float
    scale: float = 0.0  # lambda
    size: float = 1.0  # K
    chance: float = 0.05  # the most times that a significant segment is expected
    intercept: float = -20.0
    slope: float = 0.0

    def __post_init__(self):
        self.memo: dict[bytes, float] = {}

    def _of(self, word: bytes) -> float:
        for u in units(word):
            if u in self.scores:
                return self.scores[u]
        return 0.0

    def words(self, text: str | None) -> np.ndarray:
        """The score of each word, before drift."""
        ws, memo = words(text), self.memo
        if len(memo) > 500_000:
            memo.clear()
        for w in set(ws).difference(memo):
            memo[w] = self._of(w)
        return np.fromiter(map(memo.__getitem__, ws), np.float64, len(ws))

    def segments(self, own: np.ndarray) -> list[tuple[int, int, float]]:
        """Maximal scoring segments of words of these scores, less drift."""
        at = np.flatnonzero(own)
        if not len(at):
            return []
        # words that cost drift alone are summed up between the others
        gaps = np.diff(np.concatenate([[-1], at])) - 1
        both = np.empty(2 * len(at))
        both[0::2], both[1::2] = -self.drift * gaps, own[at] - self.drift
        return [(int(at[a // 2]), int(at[b // 2]), float(s)) for a, b, s in segments(both.tolist())]

    def passages(self, text: str | None) -> tuple[list[tuple[int, int, float, float]], float]:
        """Significant segments (first word, last word, score, expected number by chance), and their statistic."""
        own = self.words(text)
        if not len(own) or not self.scale:
            return [], 0.0
        out, statistic, chance = [], 0.0, math.log(self.size * len(own))
        for a, b, s in self.segments(own):
            normal = self.scale * s - chance
            if normal >= -math.log(self.chance):
                out.append((a, b, s, math.exp(-normal)))
                statistic += normal
        return out, statistic

    def probability(self, statistic: float) -> float:
        if not self.scores:
            return 0.0
        x = self.intercept + self.slope * math.log1p(statistic)
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))


def _ratio(y1, y0, n1: int, n0: int, prior: float, log, sqrt) -> tuple:
    """The log-odds ratio of a unit of y1 toxic and y0 clean texts under the prior, and its standard error."""
    prior = prior * (n1 + n0)
    a = (y1 + y0) * (prior / (n1 + n0))
    ratio = log((y1 + a) / (n1 + prior - y1 - a + 1e-9)) - log((y0 + a) / (n0 + prior - y0 - a + 1e-9))
    return ratio, sqrt(1 / (y1 + a) + 1 / (y0 + a))


def decay(scores: np.ndarray, share: np.ndarray) -> float:
    """lambda > 0 with sum(share * exp(lambda * scores)) = 1; 0 if there is none, as the mean is not below 0 or no score above."""
    share = share / share.sum()
    if not (share @ scores < 0 and scores[share > 0].max() > 0):
        return 0.0
    low, high = 0.0, 1.0
    while share @ np.exp(np.minimum(high * scores, 700)) < 1:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if share @ np.exp(np.minimum(mid * scores, 700)) < 1 else (low, mid)
    return low


def extent(best: np.ndarray, n: np.ndarray, scale: float, least: float) -> float:
    """The likeliest K, of best segment scores of texts of n words; those of 0 are known to be below `least` only."""
    some = best > 0
    return max(0.5, float(some.sum())) / max(1e-300, float((n * np.exp(-scale * np.where(some, best, least))).sum()))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-2) -> tuple[float, float]:
    design, beta = np.stack([np.ones_like(x), x], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (weight * (y - p)) - penalty * beta
        step = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + penalty * np.eye(2), grad)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, *, per_class: int = 10_000, prior: float = 0.1, z: float = 3.3, drift: float = 0.05, least: float = 1.5, chance: float = 0.05, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learns from up to about `per_class` labelled texts of either class, drawn by a hash of their key.

    Texts that are the same count once. The model's units are bounded by those texts; it is broadcast.
    """
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where(F.col("k").isNotNull() & F.col("y").isin(0, 1)).groupBy("k").agg(F.max("y").alias("y"))
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if set(sizes) != {0, 1}:
        return Model({}, drift)
    space = 1 << 30
    draw = F.pmod(F.xxhash64("k", F.lit(5)), F.lit(space))
    drawn = known.where(draw < F.when(F.col("y") == 1, int(space * min(1.0, per_class / sizes[1]))).otherwise(int(space * min(1.0, per_class / sizes[0]))))
    sample = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull()).join(F.broadcast(drawn), "k").dropDuplicates(["t", "y"]).select("t", "y")
    sample = store(sample, "toxicity-sample")  # the draw, about 2 * per_class keys, is broadcast; texts that were not drawn are not dealt out

    def counted(batches):
        counts, docs_of = [Counter(), Counter()], [0, 0]

        def flushed():
            names = list(set(counts[0]) | set(counts[1]))
            rows = [(n, counts[1][n], counts[0][n]) for n in names] + [(b"", docs_of[1], docs_of[0])]
            counts[0].clear(), counts[1].clear()
            docs_of[:] = [0, 0]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i else pa.binary()) for i in range(3)], names=["u", "y1", "y0"])

        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ws = words(t)
                docs_of[y] += 1
                counts[y].update({u for w in set(ws) for u in units(w)})
                if len(counts[0]) + len(counts[1]) > 200_000:  # what a task holds is bounded; sums follow
                    yield flushed()
        yield flushed()

    counts = store(sample.mapInArrow(counted, "u binary, y1 long, y0 long").groupBy("u").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0")), "toxicity-units")
    whole = counts.where(F.col("u") == F.lit(b"")).first()
    if whole is None or not whole.y1 or not whole.y0:
        return Model({}, drift)
    ratio, error = _ratio(F.col("y1").cast("double"), F.col("y0").cast("double"), whole.y1, whole.y0, prior, F.log, F.sqrt)
    stem = F.substring("u", 1, 1) == F.lit(b"^")
    told = counts.where(F.col("u") != F.lit(b"")).withColumn("ratio", ratio).withColumn("error", error)
    # units that tell toxic texts, and words that tell clean ones
    own = [(bytes(r.u), r.y1, r.y0, r.ratio) for r in told.where((F.col("ratio") >= F.col("error") * z) & (F.col("ratio") >= least) | ~stem & (F.col("ratio") <= F.col("error") * -z)).collect()]
    model = Model({u: r for u, _, _, r in own}, drift, chance=chance)
    toxic = {u for u, *_, r in own if r > 0}
    if toxic:
        # a unit that copies of few texts carry always stands between the same words: it counts once for each surrounding
        asked = docs.sparkSession.sparkContext.broadcast(toxic)

        def surrounded(batches):
            for batch in batches:
                out = set()
                for t in batch.column(0).to_pylist():
                    ws = words(t)
                    for i, w in enumerate(ws):
                        if asked.value.isdisjoint(us := units(w)):
                            continue
                        around = zlib.crc32(b" ".join(ws[max(0, i - 1) : i] + ws[i + 1 : i + 2]))
                        out.update((u, around) for u in us if u in asked.value)
                yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in out], pa.binary()), pa.array([a for _, a in out], pa.int64())], names=["u", "around"])

        spread = {bytes(r.u): r.n for r in sample.where("y = 1").mapInArrow(surrounded, "u binary, around long").distinct().groupBy("u").agg(F.count(F.lit(1)).alias("n")).collect()}
        for u, y1, y0, _ in own:
            if u in toxic:
                r, e = _ratio(min(y1, spread.get(u, 0)), y0, whole.y1, whole.y0, prior, lambda x: math.log(max(x, 1e-300)), math.sqrt)
                if r >= least and r >= z * e:
                    model.scores[u] = r
                else:
                    del model.scores[u]
    if max(model.scores.values(), default=0.0) <= 0:
        return Model({}, drift)
    scored = docs.sparkSession.sparkContext.broadcast(model)

    def weighed(batches):
        for batch in batches:
            found: Counter = Counter()
            for t in batch.column(0).to_pylist():
                values, n = np.unique(scored.value.words(t), return_counts=True)
                found.update(dict(zip(values.tolist(), n.tolist(), strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.float64()), pa.array(list(found.values()), pa.int64())], names=["s", "n"])

    # as many rows as the units have scores
    told = sample.where("y = 0").mapInArrow(weighed, "s double, n long").groupBy("s").agg(F.sum("n").alias("n")).collect()
    above = [v for v in model.scores.values() if v > 0]
    # half a word of each positive score, for those that other clean texts hold
    scores, n = np.array([r.s for r in told] + above) - drift, np.array([float(r.n) for r in told] + [0.5 / len(above)] * len(above))
    model.scale = decay(scores, n)
    if not model.scale:
        return Model({}, drift)
    ruled = docs.sparkSession.sparkContext.broadcast(model)

    def best(batches):
        for batch in batches:
            rows = [(max((x for *_, x in ruled.value.segments(own)), default=0.0), len(own)) for own in map(ruled.value.words, batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.int64())], names=["best", "n"])

    clean = sample.where("y = 0").mapInArrow(best, "best double, n long").where("n > 0").toArrow()  # two numbers a sample text
    model.size = extent(clean.column("best").to_numpy(), clean.column("n").to_numpy(), model.scale, min(above) - drift)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def measured(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sent.value.passages(t)[1] for t in batch.column(0).to_pylist()], pa.float64()), batch.column(1)], names=["x", "y"])

    pairs = np.array([(r.x, r.y) for r in sample.mapInArrow(measured, "x double, y int").collect()])  # two numbers a sample text
    x, y = np.log1p(pairs[:, 0]), pairs[:, 1]
    share = {c: sizes[c] / max(1, (y == c).sum()) for c in (0, 1)}
    weight = np.where(y == 1, share[1], share[0])
    model.intercept, model.slope = _logistic(x, y, weight * len(y) / weight.sum())
    return model


def score(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted, n_passages) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                found = [sent.value.passages(t) for t in part.column(1).to_pylist()]
                p = [sent.value.probability(x) for _, x in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p, pa.float64()), pa.array([int(v >= 0.5) for v in p], pa.int32()), pa.array([len(s) for s, _ in found], pa.int64())], names=[key, "score", "predicted", "n_passages"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, score double, predicted int, n_passages long")


def keep(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose whole text is not predicted toxic; each row is judged on its own."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            kept = [sent.value.probability(sent.value.passages(t)[1]) < 0.5 for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def passages(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, first_word, last_word, segment_score, expected): every significant passage, a row each."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [key, "first_word", "last_word", "segment_score", "expected"]

    def run(batches):
        for batch in batches:
            keys, rows = batch.column(0), [(i, *p) for i, t in enumerate(batch.column(1).to_pylist()) for p in sent.value.passages(t)[0]]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.float64())], names=names)

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, first_word long, last_word long, segment_score double, expected double")
