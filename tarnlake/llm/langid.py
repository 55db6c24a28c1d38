"""Language identification by prediction by partial matching.

For each language a variable-order byte context tree is grown from a bounded sample of labelled texts: how often each
byte followed each context of up to ``order`` bytes. A byte's probability in the longest context that the tree knows is
its count there over the count of the context plus its distinct bytes (method C). A byte that never followed the context
escapes, with what that leaves, to the context shorter by a byte, where the bytes that did follow are excluded: the
escape probability is shared among the others in proportion to their probability there, down to all bytes alike. So
each context's probabilities sum to 1. Statistics are frozen after training, so a text's code length is exact, and the
same on any machine. The language of the least code length wins.

The languages' trees are merged into one whose nodes hold, for each next byte, the code lengths in all languages;
a text is walked with array operations, position by position backwards through the contexts, in bounded chunks.

Null texts and those without a letter are ``und``, with score 0. Ties go to the first language by name. Training rows
without text or language are left out, repeated ones count once; with nothing to learn from, as of an empty table, every
text is ``und``. Repeated rows are judged each. Of other columns only the key, the text and, for learning, the language are
read, whatever the names of the rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_LETTER = regex.compile(r"\p{L}")
_LETTER_ASCII = regex.compile(rb"[A-Za-z]")


class Model:
    """child[node, symbol]: the context longer by that byte, or the last row, the sink, of itself only; bits[node, symbol]: code lengths by language."""

    def __init__(self, langs: list[str], symbols: np.ndarray, child: np.ndarray, bits: np.ndarray, order: int):
        self.langs, self.symbols, self.child, self.bits, self.order = langs, symbols, child, bits, order

    def code_lengths(self, texts: list[bytes], chunk: int = 1 << 16) -> np.ndarray:
        """Bits of each text in each language; the contexts of its first bytes are filled up with line feeds."""
        k, lead = self.order, b"\n" * self.order
        joined = b"".join([x for t in texts for x in (lead, t)])
        data = self.symbols[np.frombuffer(joined, np.uint8)]
        stops = np.cumsum([len(t) + k for t in texts])
        out = np.zeros((len(texts), len(self.langs)))
        flat_child, flat_bits, wide, sink = self.child.ravel(), self.bits.reshape(-1, len(self.langs)), self.child.shape[1], len(self.child) - 1
        for a in range(k, len(data), chunk):
            b = min(a + chunk, len(data))
            # node 0 is the root; below a context that the tree lacks all children are the sink, which is the last row
            here, node = np.zeros(b - a, np.int32), np.zeros(b - a, np.int32)
            for d in range(1, k + 1):
                here = flat_child.take(here * wide + data[a - d : b - d])
                np.copyto(node, here, where=here != sink)
            cost = flat_bits.take(node * wide + data[a:b], axis=0)
            # a text's bytes are those between its lead and its end
            first = np.searchsorted(stops, a, "right")
            last = np.searchsorted(stops, b - 1, "right")
            for i in range(first, min(last, len(texts) - 1) + 1):
                lo, hi = max(a, int(stops[i]) - len(texts[i])), min(b, int(stops[i]))
                if hi > lo:
                    out[i] += cost[lo - a : hi - a].sum(axis=0, dtype=np.float64)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        raw = [t.encode("utf-8", "replace") if t else b"" for t in texts]
        has = [bool(_LETTER_ASCII.search(r) or (t and _LETTER.search(t))) for r, t in zip(raw, texts, strict=True)]
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        bits = self.code_lengths(raw)
        best = bits.argmin(axis=1)
        gap = np.minimum(bits - bits.min(axis=1, keepdims=True), 700.0)
        score = 1 / np.exp2(-gap).sum(axis=1)
        return [self.langs[b] if h else "und" for b, h in zip(best, has, strict=True)], [float(s) if h else 0.0 for s, h in zip(score, has, strict=True)]


def _escaped(shorter: np.ndarray, seen: np.ndarray, counts: np.ndarray, left: float) -> np.ndarray:
    """A context's probabilities, from those of the shorter one, in which all bytes but the seen ones have `left` together."""
    out, total, kinds = shorter.copy(), counts.sum(), len(counts)
    if left > 1e-12:
        out *= kinds / (total + kinds) / left
        out[seen] = counts / (total + kinds)
    else:  # no byte is left to escape to
        out[seen] = counts / total
    return out


def grow(samples: dict[str, list[bytes]], order: int = 4, least: int = 40) -> Model:
    """A merged tree of the contexts of up to `order` bytes that some language's sample holds often enough.

    That is `least` times in the largest sample, and as much less in a smaller one as it is smaller, but twice.
    """
    langs = sorted(samples)
    seen = np.zeros(256, bool)
    for texts in samples.values():
        for t in texts:
            seen[np.frombuffer(t, np.uint8)] = True
    seen[10] = True
    symbols = np.zeros(256, np.int32)  # 0: a byte that no sample has
    symbols[seen] = np.arange(1, seen.sum() + 1)
    wide = int(seen.sum()) + 1
    data = {x: symbols[np.frombuffer(b"".join([y for t in samples[x] for y in (b"\n" * order, t)]) or b"\n", np.uint8)].astype(np.int64) for x in langs}
    real = {x: np.concatenate([np.r_[np.zeros(order, bool), np.ones(len(t), bool)] for t in samples[x]] or [np.zeros(1, bool)]) for x in langs}  # leads are contexts only
    # grams[d][lang]: (codes of context and byte, counts); a code's digits are the byte, then the context's bytes from the last back
    grams: list[dict[str, tuple[np.ndarray, np.ndarray]]] = []
    for d in range(order + 1):
        grams.append({})
        for x in langs:
            s = data[x]
            code = s[d:].copy() if len(s) > d else np.empty(0, np.int64)
            context = np.zeros(len(code), np.int64)
            for j in range(1, d + 1):
                context = context * wide + s[d - j : len(s) - j]
            grams[d][x] = np.unique((context * wide + code)[real[x][d:][: len(code)]], return_counts=True)
    child = [np.full(wide, -1, np.int32)]
    bits0 = np.empty((wide, len(langs)))
    even = 1.0 / 256
    most = max((len(s) for s in data.values()), default=1)
    enough = {x: max(2, least * len(s) / most) for x, s in data.items()}
    rows: list[np.ndarray] = []
    for j, x in enumerate(langs):
        codes, n = grams[0][x]
        bits0[:, j] = _escaped(np.full(wide, even), codes, n, 1 - len(codes) * even) if len(codes) else even
    rows.append(bits0)
    level = {0: 0}  # context code -> node
    for d in range(1, order + 1):
        totals: dict[int, np.ndarray] = {}
        for j, x in enumerate(langs):
            codes, n = grams[d][x]
            contexts, at = np.unique(codes // wide, return_index=True)
            sums = np.add.reduceat(n, at) if len(n) else n
            for c, total in zip(contexts[sums >= enough[x]].tolist(), sums[sums >= enough[x]].tolist(), strict=True):
                totals.setdefault(c, np.zeros(len(langs)))[j] = total
        nodes: dict[int, int] = {}
        for c in sorted(totals):
            parent = level.get(c // wide)
            if parent is None:
                continue
            nodes[c] = len(rows)
            child[parent][c % wide] = len(rows)
            child.append(np.full(wide, -1, np.int32))
            rows.append(rows[parent].copy())
        for j, x in enumerate(langs):
            codes, n = grams[d][x]
            contexts = codes // wide
            cuts = np.flatnonzero(np.diff(contexts)) + 1 if len(codes) else []
            for own, counts in zip(np.split(codes, cuts), np.split(n, cuts), strict=True):
                c = int(own[0] // wide) if len(own) else -1
                if c in nodes:
                    row, seen = rows[nodes[c]], own % wide
                    row[:, j] = _escaped(row[:, j], seen, counts, 1 - row[seen, j].sum())
        level = nodes
    child.append(np.full(wide, -1, np.int32))
    children = np.stack(child)
    children[children < 0] = len(children) - 1
    return Model(langs, symbols, children, (-np.log2(np.stack(rows))).astype(np.float32), order)


def fit(docs: DataFrame, *, per_language: int = 400, language_bytes: int = 4 << 20, key: str = "doc_id", text: str = "text", lang: str = "lang", order: int = 4, least: int = 40) -> Model:
    """Learns from whole texts of each language, those of the least hashes of their key.

    These are `per_language` texts at most, and none after `language_bytes` are reached, so that what the driver gets is bounded by
    these two and the number of languages, but for the last text's length.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where(F.col("t").isNotNull() & F.col("l").isNotNull())
    counts = {r.l: r.n for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return grow({}, order, least)
    draw = F.pmod(F.xxhash64("k", F.lit(11)), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, int((1 << 30) * min(1.0, 1.5 * per_language / n)))])
    drawn = rows.where(draw < share[F.col("l")]).dropDuplicates(["k", "t", "l"]).withColumn("d", draw)
    by = Window.partitionBy("l").orderBy("d", F.col("k").cast("string"), "t")
    drawn = drawn.withColumn("nth", F.row_number().over(by)).withColumn("before", F.sum(F.octet_length("t")).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.octet_length("t"))
    taken: dict[str, list[bytes]] = {}
    for r in drawn.where((F.col("nth") <= per_language) & (F.col("before") < language_bytes)).orderBy("l", "nth").select("l", "t").collect():
        taken.setdefault(r.l, []).append(r.t.encode("utf-8", "replace"))
    return grow(taken, order, least)


def identify(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                langs, scores = sent.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[key, "lang_pred", "score"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, lang_pred string, score double")
