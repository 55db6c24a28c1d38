"""Benchmark decontamination by a positional inverted index that is distributed over shards of documents.

``build_index`` turns a block of documents into one shard: for each term, the ascending positions at which it stands,
delta-encoded, over all documents of the block laid end to end with gaps that no phrase can cross. Shards are written to
shared storage, a row each, and are never shuffled: a phrase lies within one document, so within one shard.
``term_counts`` sums how often terms occur over all shards. ``phrase_matches`` takes phrases of test items, orders
each phrase's terms from the corpus's rarest on, and intersects their offset-adjusted position lists in that order; most
phrases die at the first or second list. ``proximity_matches`` keeps, around the rarest term's positions, the places
where all terms stand within a window, in any order.

Phrases are broadcast in blocks of a bounded number of bytes; a larger test set costs more passes over the shards, not
more memory. Null and empty texts have no words and match nothing. Repeated keys are separate documents. An empty table
or benchmark gives no match. Columns other than key and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store

#: Bytes that end a word: all of ASCII but digits and letters. A-Z become a-z.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
INDEX = "shard string, docs array<long>, starts array<long>, sizes array<int>, terms array<binary>, postings array<binary>"
#: Positions between documents; no phrase or window may be longer.
GAP = 1 << 10


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_TABLE).split() if text else []


def _packed(positions: np.ndarray) -> bytes:
    """Differences in the least of 1, 2 or 4 bytes, after a byte that tells which, and the first position."""
    steps = np.diff(positions)
    kind = "u1" if not len(steps) or steps.max() < 1 << 8 else "<u2" if steps.max() < 1 << 16 else "<u4"
    return np.dtype(kind).itemsize.to_bytes(1, "little") + int(positions[0]).to_bytes(8, "little") + steps.astype(kind).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.frombuffer(raw, f"<u{raw[0]}", offset=9).astype(np.int64)
    return np.concatenate([[0], np.cumsum(out)]) + int.from_bytes(raw[1:9], "little")


def build_index(docs: DataFrame, *, key: str = "doc_id", text: str = "text", terms: frozenset[bytes] | None = None, shard_words: int = 2_000_000, shard_docs: int = 1 << 17) -> DataFrame:
    """One row a shard, closed when it has as many words or documents. With terms, only their postings are kept; the others are those no test item can ask for."""
    spark = docs.sparkSession
    wanted = None if terms is None else spark.sparkContext.broadcast({t: i for i, t in enumerate(sorted(terms))})

    def shard(name: str, keys: list, sizes: list[int], names: list[bytes], ids: list[np.ndarray], at: list[np.ndarray]):
        starts = np.cumsum([0, *(n + GAP for n in sizes)])[:-1]
        ids, at = np.concatenate(ids or [np.empty(0, np.int32)]), np.concatenate([p + s for p, s in zip(at, starts, strict=True)] or [np.empty(0, np.int64)])
        order = np.argsort(ids, kind="stable")
        ids, at = ids[order], at[order]
        cuts = np.flatnonzero(np.diff(ids)) + 1 if len(ids) else []
        firsts = [0, *cuts] if len(ids) else []
        return pa.RecordBatch.from_pydict({
            "shard": pa.array([name]), "docs": pa.array([keys], pa.list_(pa.int64())), "starts": pa.array([starts], pa.list_(pa.int64())), "sizes": pa.array([sizes], pa.list_(pa.int32())),
            "terms": pa.array([[names[ids[i]] for i in firsts]], pa.list_(pa.binary())), "postings": pa.array([[_packed(x) for x in np.split(at, cuts)] if len(ids) else []], pa.list_(pa.binary())),
        })

    def built(batches):
        part, n = TaskContext.get().partitionId(), 0
        numbers = {} if wanted is None else wanted.value
        names = list(numbers)
        keys, sizes, ids, at, held = [], [], [], [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                some = batch.slice(start, 256)
                for k, t in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    ws = words(t)
                    if wanted is None:
                        for w in set(ws).difference(numbers):
                            numbers[w] = len(names)
                            names.append(w)
                    of = np.fromiter(map(numbers.get, ws, [-1] * len(ws)) if wanted is not None else map(numbers.__getitem__, ws), np.int32, len(ws))
                    own = np.flatnonzero(of >= 0)
                    keys.append(k), sizes.append(len(ws)), ids.append(of[own]), at.append(own)
                    held += len(ws)
                    if held >= shard_words or len(keys) >= shard_docs:
                        yield shard(f"{part}-{n}", keys, sizes, names, ids, at)
                        keys, sizes, ids, at, held, n = [], [], [], [], 0, n + 1
        if keys:
            yield shard(f"{part}-{n}", keys, sizes, names, ids, at)

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(built, INDEX)


def term_counts(index: DataFrame) -> DataFrame:
    """(term, n): occurrences over all shards, from the size of each postings list."""
    each = index.select(F.explode(F.arrays_zip("terms", F.transform("postings", lambda p: F.struct(F.octet_length(p).alias("size"), F.conv(F.hex(F.substring(p, 1, 1)), 16, 10).cast("long").alias("step"))).alias("p"))).alias("x"))
    return each.select(F.col("x.terms").alias("term"), ((F.col("x.p.size") - 9) / F.col("x.p.step") + 1).cast("long").alias("n")).groupBy("term").agg(F.sum("n").alias("n"))


def _plans(phrases: list[tuple[tuple[bytes, ...], list[int]]], counts: dict[bytes, int]) -> list[tuple[list[tuple[bytes, int]], int, list[int]]]:
    """Of phrases whose terms all occur: (terms with offsets, from the rarest on; length; items)."""
    return [(sorted(zip(p, range(len(p)), strict=True), key=lambda x: (counts[x[0]], x)), len(p), items) for p, items in phrases if all(t in counts for t in p)]


def _blocks(plans: list, most: int) -> list[list]:
    out, held = [[]], 0
    for plan in plans:
        n = sum(len(t) + 16 for t, _ in plan[0]) + 8 * len(plan[2])
        if held + n > most and out[-1]:
            out.append([])
            held = 0
        out[-1].append(plan)
        held += n
    return out


def phrase_matches(index: DataFrame, phrases: list[tuple[tuple[bytes, ...], list[int]]], counts: dict[bytes, int], block_bytes: int = 32 << 20) -> DataFrame:
    """(shard, ordinal, doc_id, n_words, firsts, lasts, items): a row a document and block of phrases.

    firsts and lasts bound the maximal runs of words that lie in an occurrence, in order; items are those with an
    occurring phrase. Documents without a match have empty lists.
    """
    spark = index.sparkSession
    if phrases and max(len(p) for p, _ in phrases) > GAP:
        raise ValueError(f"a phrase may have {GAP} words at most")

    def found(block):
        def run(batches):
            by_rarest: dict[bytes, list] = {}
            for plan in block.value:
                by_rarest.setdefault(plan[0][0][0], []).append(plan)
            for batch in batches:
                for row in batch.to_pylist():
                    raw, lists = dict(zip(row["terms"], row["postings"], strict=True)), {}

                    def of(term):
                        if term not in lists:
                            lists[term] = _unpacked(raw[term]) if term in raw else None
                        return lists[term]

                    starts, hits = np.array(row["starts"], np.int64), []
                    for terms, n, items in (plan for term in raw for plan in by_rarest.get(term, ())):
                        at = None
                        for term, offset in terms:
                            own = of(term)
                            if own is None:
                                at = None
                                break
                            if at is None:
                                at = own - offset
                            else:
                                i = np.searchsorted(own, at + offset)
                                i[i == len(own)] = 0
                                at = at[own[i] == at + offset]
                            if not len(at):
                                break
                        if at is not None and len(at):
                            hits.append((at, n, items))
                    first, last, item = [[] for _ in starts], [[] for _ in starts], [set() for _ in starts]
                    if hits:
                        at = np.concatenate([a for a, _, _ in hits])
                        to = np.concatenate([a + n for a, n, _ in hits])
                        which = np.repeat(np.arange(len(hits)), [len(a) for a, _, _ in hits])
                        doc = np.searchsorted(starts, at, "right") - 1
                        for d, w in sorted(set(zip(doc.tolist(), which.tolist(), strict=True))):
                            item[d].update(hits[w][2])
                        order = np.argsort(at, kind="stable")
                        at, to, doc = at[order], np.maximum.accumulate(to[order]), doc[order]
                        new = np.concatenate([[True], at[1:] > to[:-1]])
                        begin = np.flatnonzero(new)
                        end = np.concatenate([begin[1:], [len(at)]]) - 1
                        for b, e in zip(begin.tolist(), end.tolist(), strict=True):
                            d = int(doc[b])
                            first[d].append(int(at[b] - starts[d]))
                            last[d].append(int(to[e] - starts[d]) - 1)
                    yield pa.RecordBatch.from_pydict({
                        "shard": pa.array([row["shard"]] * len(starts), pa.string()), "ordinal": pa.array(range(len(starts)), pa.int32()), "doc_id": pa.array(row["docs"], pa.int64()), "n_words": pa.array(row["sizes"], pa.int64()),
                        "firsts": pa.array(first, pa.list_(pa.int64())), "lasts": pa.array(last, pa.list_(pa.int64())), "items": pa.array([sorted(x) for x in item], pa.list_(pa.int64())),
                    })

        return run

    schema = "shard string, ordinal int, doc_id long, n_words long, firsts array<long>, lasts array<long>, items array<long>"
    out = [index.mapInArrow(found(spark.sparkContext.broadcast(b)), schema) for b in _blocks(_plans(phrases, counts), block_bytes)]
    if len(out) == 1:
        return out[0]
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)

    def united(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                runs: list[list[int]] = []
                for a, b in sorted(zip(r["firsts"], r["lasts"], strict=True)):
                    if runs and a <= runs[-1][1] + 1:
                        runs[-1][1] = max(runs[-1][1], b)
                    else:
                        runs.append([a, b])
                r["firsts"], r["lasts"], r["items"] = [a for a, _ in runs], [b for _, b in runs], sorted(set(r["items"]))
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

    grouped = every.groupBy("shard", "ordinal").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *(F.flatten(F.collect_list(c)).alias(c) for c in ("firsts", "lasts", "items")))
    return grouped.mapInArrow(united, schema)


def proximity_matches(index: DataFrame, queries: list[tuple[tuple[bytes, ...], int]], counts: dict[bytes, int], window: int) -> DataFrame:
    """(doc_id, query, first, last): the least spans of at most `window` words that hold all terms of a query.

    A span starts or ends at the query's rarest term, or holds it; one span is given for each place of that term.
    """
    if window > GAP:
        raise ValueError(f"a window may have {GAP} words at most")
    plans = [(sorted(set(terms), key=lambda t: (counts[t], t)), q) for terms, q in queries if terms and all(t in counts for t in terms)]
    sent = index.sparkSession.sparkContext.broadcast(plans)

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                raw, starts = dict(zip(row["terms"], row["postings"], strict=True)), np.array(row["starts"], np.int64)
                for terms, q in sent.value:
                    if not all(t in raw for t in terms):
                        continue
                    lists = [_unpacked(raw[t]) for t in terms]
                    for place in lists[0].tolist():
                        best = None
                        near = [x[np.searchsorted(x, place - window + 1) : np.searchsorted(x, place + window)] for x in lists[1:]]
                        if not all(len(x) for x in near):
                            continue
                        for begin in sorted({place, *(int(v) for x in near for v in x if v <= place)}):
                            after = [x[np.searchsorted(x, begin) :] for x in near]
                            if all(len(x) for x in after):
                                end = max([place, *(int(x[0]) for x in after)])
                                if end - begin < window and (best is None or end - begin < best[1] - best[0]):
                                    best = (begin, end)
                        if best:
                            d = int(np.searchsorted(starts, place, "right")) - 1
                            out.append({"doc_id": row["docs"][d], "query": q, "first": best[0] - int(starts[d]), "last": best[1] - int(starts[d])})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("doc_id", pa.int64()), ("query", pa.int64()), ("first", pa.int64()), ("last", pa.int64())]))

    return index.mapInArrow(run, "doc_id long, query long, first long, last long")


def windows(items: list[tuple[int, str | None]], n: int = 13) -> list[tuple[tuple[bytes, ...], list[int]]]:
    """The distinct n-word windows of items, each with the items that hold it; a shorter item is one window."""
    out: dict[tuple[bytes, ...], set[int]] = {}
    for item, text in items:
        ws = words(text)
        for i in range(max(1, len(ws) - n + 1) if ws else 0):
            out.setdefault(tuple(ws[i : i + n]), set()).add(item)
    return [(p, sorted(i)) for p, i in sorted(out.items())]


def digest(matches: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of phrase_matches."""
    n_hit = F.aggregate(F.zip_with("firsts", "lasts", lambda a, b: b - a + 1), F.lit(0).cast("long"), lambda s, x: s + x)
    return matches.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.transform("items", lambda i: i.cast("string"))), ","), 256).alias("items_sha256")).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def contamination(docs: DataFrame, benchmark: DataFrame, *, n: int = 13, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """digest() of all documents against all n-word windows of the benchmark.

    The benchmark - a test set, small beside the corpus - comes to the driver; its windows go out in bounded blocks.
    """
    items = [(r[0], r[1]) for r in benchmark.select(F.col(item).cast("long"), F.col(text)).where(F.col(item).isNotNull() & F.col(text).isNotNull()).toLocalIterator()]
    phrases = windows(items, n)
    terms = frozenset(t for p, _ in phrases for t in p)
    index = store(build_index(docs, key=key, text=text, terms=terms), "postings")
    counts = {bytes(r.term): r.n for r in term_counts(index).collect()}  # terms of the test set alone
    return digest(phrase_matches(index, phrases, counts))


def sha256_of(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
