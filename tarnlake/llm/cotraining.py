"""A quality classifier by co-training of two views.

One view sees the text's content: shares of character classes, word and line statistics. The other sees the page's metadata:
source and language (hashed), and the recorded length. Each is a logistic regression. Starting from labelled rows, the
views take turns for some rounds: each labels the unlabelled rows it is surest of, as many of either class as fit the
labels' own shares, for the other's training set. Then each view is calibrated on labelled rows kept back, the calibrated
views are combined by a third regression on these, and all documents are scored.

Training looks at bounded samples (``per_class`` labelled rows, ``pool`` unlabelled ones, drawn by a hash of the key); scores are
given to every whole text. Null and empty texts have features of 0; null metadata is a value of its own. Labels are joined by
key, and a key's highest label counts. Without both classes every score is the share of class 1, or 0.5 without labels.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SOURCES, _LANGS = 32, 16
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)


def text_view(text: str | None) -> np.ndarray:
    raw = text.encode("utf-8", "replace") if text else b""
    if not raw:
        return np.zeros(16)
    n, counts = len(raw), np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = raw.split(), raw.split(b"\n")
    w, distinct = max(1, len(words)), len(set(words))
    repeats = sum(1 for a, b in zip(words, words[1:], strict=False) if a == b)
    upper, lower, digit = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    return np.array([
        counts[_SYMBOLS].sum() / n, upper / n, lower / n, digit / n, counts[128:].sum() / n, (counts[33] + counts[63]) / n, (counts[44] + counts[46]) / n, counts[124] / n,
        distinct / w, repeats / w, len(raw) / w / 20, np.log1p(len(words)) / 10, len(lines) / w, 1 - len(set(lines)) / len(lines), (counts[46] + counts[33] + counts[63]) / w, float(upper > lower),
    ])


def page_view(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(_SOURCES + _LANGS + 3)
    out[zlib.crc32(repr(source).encode("utf-8", "replace")) % _SOURCES] = 1
    out[_SOURCES + zlib.crc32(repr(lang).encode("utf-8", "replace")) % _LANGS] = 1
    size = max(0, n_chars or 0)
    out[-3:] = np.log1p(size) / 10, float(n_chars is None), np.log1p(size) ** 2 / 100
    return out


class Logistic:
    """Ridge logistic regression on standardised columns, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, penalty: float = 1.0):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0)
        self.scale[self.scale < 1e-9] = 1.0
        design = self._design(x)
        self.beta = np.zeros(design.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(design @ self.beta, -30, 30)))
            hessian = (design * (p * (1 - p))[:, None]).T @ design + penalty * np.eye(design.shape[1])
            step = np.linalg.solve(hessian, design.T @ (y - p) - penalty * self.beta)
            self.beta += step
            if np.abs(step).max() < 1e-6:
                break

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.ones((len(x), 1)), np.clip((x - self.mean) / self.scale, -10, 10)])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._design(x) @ self.beta, -30, 30)


class Model:
    def __init__(self, share: float, views: list[Logistic] | None = None, calibrated: list[Logistic] | None = None, joint: Logistic | None = None):
        self.share, self.views, self.calibrated, self.joint = share, views, calibrated, joint

    def predict(self, text: np.ndarray, page: np.ndarray) -> np.ndarray:
        if self.views is None:
            return np.full(len(text), self.share)
        both = [c.logit(v.logit(x)[:, None]) for v, c, x in zip(self.views, self.calibrated, (text, page), strict=True)]
        return 1 / (1 + np.exp(-self.joint.logit(np.stack(both, axis=1))))


def cotrain(views: list[np.ndarray], y: np.ndarray, kept_back: np.ndarray, rounds: int = 5, each: float = 0.02) -> Model:
    """views: a matrix each; y: 0, 1, or -1 for unlabelled rows; kept_back: labelled rows that calibrate."""
    known = (y >= 0) & ~kept_back
    share = float(y[y >= 0].mean()) if (y >= 0).any() else 0.5
    if any(len(set(y[m].tolist())) < 2 for m in (known, (y >= 0) & kept_back)):
        return Model(share)
    labels = [np.where(known, y, -1), np.where(known, y, -1)]
    free = np.flatnonzero(y < 0)
    for _ in range(rounds):
        models = [Logistic(x[t >= 0], t[t >= 0]) for x, t in zip(views, labels, strict=True)]
        given = []
        for v in (0, 1):
            open_ = free[labels[1 - v][free] < 0]
            n = int(each * len(free))
            if not n or not len(open_):
                continue
            logit = models[v].logit(views[v][open_])
            order = np.argsort(logit, kind="stable")
            ones, zeros = order[::-1][: max(1, round(n * share))], order[: max(1, round(n * (1 - share)))]
            given.append((1 - v, open_[ones[logit[ones] > 1]], open_[zeros[logit[zeros] < -1]]))
        for to, ones, zeros in given:
            labels[to][ones], labels[to][zeros] = 1, 0
    models = [Logistic(x[t >= 0], t[t >= 0]) for x, t in zip(views, labels, strict=True)]
    own = (y >= 0) & kept_back
    logits = [m.logit(x[own]) for m, x in zip(models, views, strict=True)]
    calibrated = [Logistic(z[:, None], y[own]) for z in logits]
    joint = Logistic(np.stack([c.logit(z[:, None]) for c, z in zip(calibrated, logits, strict=True)], axis=1), y[own])
    return Model(share, models, calibrated, joint)


def _views(docs: DataFrame, key: str, text: str, source: str, lang: str, n_chars: str) -> DataFrame:
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(source).cast("string").alias("s"), F.col(lang).cast("string").alias("l"), F.col(n_chars).cast("long").alias("c"))


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    t, s, l, c = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in "tslc")
    return np.array([text_view(x) for x in t]).reshape(len(t), -1), np.array([page_view(*x) for x in zip(s, l, c, strict=True)]).reshape(len(t), -1)


def fit(docs: DataFrame, labels: DataFrame, *, per_class: int = 8_000, pool: int = 16_000, rounds: int = 5, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", n_chars: str = "n_chars", label: str = "quality") -> Model:
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where(F.col("k").isNotNull() & F.col("y").isin(0, 1)).groupBy("k").agg(F.max("y").alias("y"))
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if set(sizes) != {0, 1}:
        return Model(float(next(iter(sizes))) if sizes else 0.5)
    space, total = 1 << 30, docs.count()
    draw = F.pmod(F.xxhash64("k", F.lit(17)), F.lit(space))
    rows = _views(docs, key, text, source, lang, n_chars)
    # labelled rows keep the classes' shares, so that scores are probabilities
    cut = min(1.0, 2 * per_class / sum(sizes.values()))
    drawn = known.where(draw < int(space * cut))
    sample = rows.join(drawn, "k").unionByName(rows.where(draw < int(space * min(1.0, pool / max(1, total)))).join(known, "k", "left_anti").withColumn("y", F.lit(-1)))

    def run(batches):
        for batch in batches:
            a, b = _matrix(batch)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("y")), batch.column(batch.schema.get_field_index("d")), pa.array(list(a), pa.list_(pa.float64())), pa.array(list(b), pa.list_(pa.float64()))], names=["y", "d", "a", "b"])

    got = sample.withColumn("d", draw).mapInArrow(run, "y int, d long, a array<double>, b array<double>").toPandas()  # bounded by per_class and pool
    got = got.sort_values(["d", "y"], kind="stable")
    y = got["y"].to_numpy()
    if not len(y):
        return Model(0.5)
    back = (y >= 0) & (np.cumsum(y >= 0) % 4 == 0)
    return cotrain([np.stack(got["a"]), np.stack(got["b"])], y, back, rounds)


def score(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", n_chars: str = "n_chars") -> DataFrame:
    """(key, score, predicted) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                p = sent.value.predict(*_matrix(part))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[key, "score", "predicted"])

    return _views(docs, key, text, source, lang, n_chars).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, score double, predicted int")
