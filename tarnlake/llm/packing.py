"""Best-fit packing of documents into sequences by a configuration linear program.

A document longer than a sequence is cut into full pieces and a last one. Full pieces fill a sequence each. The others
are known to the packer by their length alone: a histogram of at most ``capacity`` counts, whatever the corpus. A
configuration is a multiset of lengths that fits a sequence. The linear program - as few configurations as cover the
histogram - is solved by multiplicative weights: each length has a dual price, the dearest configuration at these prices
(a knapsack, by dynamic programming) is bought as often as its scarcest length allows, and the prices of what was bought
fall. The solution is rounded to whole times, the program of what is left is solved and rounded next, and so on; the last few
hundredths of the tokens are packed best-fit decreasing or by tightest fit, and sequences are numbered. Pieces
take the places of their length by rank, which is counted in salted groups, so no length gathers in one task.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, shard int, nth long"


def pieces(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, end_id: int | None = 0, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], shard, nth) of each document.

    nth counts the pieces of that length in their shard, the task that made them. Null and empty texts give one piece
    that holds the end id; repeated keys are separate documents.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")

    def cut(batches):
        from .tokens import Encoder

        encoder, shard, seen = Encoder.of(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                ids, at = encoder.encode_flat(part.column(1).to_pylist(), end_id)
                ids, sizes = ids.astype("<u4"), np.diff(at)
                times = -(-sizes // capacity)
                of = np.repeat(np.arange(len(sizes)), times)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
                start = piece * capacity
                length = np.minimum(capacity, sizes[of] - start)
                first = at[of] + start
                crc = [zlib.crc32(ids[a:b].data) for a, b in zip(first.tolist(), (first + length).tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                begin = np.flatnonzero(np.diff(length[order], prepend=-1))
                nth = np.empty(len(of), np.int64)
                nth[order] = np.arange(len(of)) - np.repeat(begin, np.diff(np.append(begin, len(of))))
                nth += seen[length]
                seen += np.bincount(length, minlength=capacity + 1)
                cols = {"doc_id": part.column(0).take(pa.array(of)), "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(crc, pa.int64()), "shard": pa.array(np.full(len(of), shard, np.int32)), "nth": pa.array(nth)}
                if with_ids:
                    cols["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(cols)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, PIECES + ", ids array<int>" * with_ids)


def knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """By room: the highest total price of sizes that fit it, and the size taken first (-1: none, look at less room)."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(int(sizes[0]), capacity + 1):
        n = int(np.searchsorted(sizes, room, "right"))
        value = prices[:n] + best[room - sizes[:n]]
        k = int(value.argmax())
        if value[k] > best[room - 1]:
            best[room], took[room] = value[k], k
        else:
            best[room] = best[room - 1]
    return best, took


def _configuration(first: int, took: np.ndarray, sizes: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[tuple[int, int], ...]:
    """The dearest configuration that holds size `first`, cut to the counts."""
    use, room = {first: 1}, capacity - int(sizes[first])
    while room >= sizes[0]:
        k = int(took[room])
        if k < 0:
            room -= 1
            continue
        room -= int(sizes[k])
        use[k] = use.get(k, 0) + 1
    return tuple(sorted((k, min(n, int(counts[k]))) for k, n in use.items()))


def _first_prices(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """Prices under which no sequence holds more than 1, of those tried the ones whose total is highest, and that total.

    Tried are a length's share of a sequence, and the same with lengths under e worth nothing and lengths that leave less
    than e worth a sequence each, for e up to half of it. Worthless lengths get a trifle, so that they fill gaps.
    """
    best, total = sizes / capacity, float(counts @ sizes) / capacity
    halves = sizes[2 * sizes <= capacity]
    for e in halves[np.unique(np.linspace(0, len(halves) - 1, 64).astype(int))] if len(halves) else []:
        prices = np.where(sizes > capacity - e, 1.0, np.where(sizes < e, 0.0, sizes / capacity))
        if float(counts @ prices) > total + 1e-9:
            best, total = prices, float(counts @ prices)
    return np.maximum(best, 1e-4 * sizes / capacity), total


def relax(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int, rate: float, near: float = 0.002, each: int = 256) -> tuple[dict, float]:
    """Multiplicative weights for the configuration program: {configuration: times}, and the dual's bound from below.

    The first prices are those of _first_prices. A round prices all sizes, solves one knapsack, and buys from it, for each size that a near-dearest configuration
    holds, that configuration - as often as its scarcest size allows - until each size is bought once.
    """
    start, bound = _first_prices(sizes, counts, capacity)
    logs, covered, bought = np.zeros(len(sizes)), np.zeros(len(sizes)), {}
    for _ in range(rounds):
        prices = np.exp(logs - logs.max()) * start
        best, took = knapsack(sizes, prices, capacity)
        bound = max(bound, float(counts @ prices) / best[capacity])
        share, value = np.zeros(len(sizes)), prices + best[capacity - sizes]
        for k in np.argsort(-value, kind="stable")[:each]:
            if value[k] < (1 - near) * best[capacity]:
                break
            if share[k] >= 1:
                continue
            use = _configuration(int(k), took, sizes, counts, capacity)
            width = min(counts[i] / n for i, n in use)
            bought[use] = bought.get(use, 0.0) + width
            for i, n in use:
                share[i] += n * width / counts[i]
        covered += share
        logs -= rate * share
        if sum(bought.values()) <= 1.0005 * bound * covered.min():
            break
    scale = float(covered @ (counts * sizes)) / int(counts @ sizes)  # what is bought then holds as many tokens as there are
    return {use: times / scale for use, times in bought.items()}, bound


def solve(histogram: dict[int, int], capacity: int, rounds: int = 12, rate: float = 0.3, rest: float = 0.01) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(times, [(size, copies)])] that together hold each size exactly as often as the histogram has it.

    The relaxed program is solved and rounded: its configurations, those of fewest pieces first, are taken as often as they were
    bought, once at least, as long as the lengths that are left allow it and they waste no more than the program's bound
    does on average. The program of what is left is solved next, until `rest` of all tokens remain or little can be taken.
    The last pieces - what was left after the solution from which this takes fewest sequences, of those that leave a tenth of
    the tokens at most - are packed best-fit decreasing, or by tightest fit where that takes fewer.
    """
    chosen, stops, sizes = rounded(histogram, capacity, rounds, rate, rest)
    plans = [chosen[:n] + _best_fit(sizes, left, capacity) for n, left in stops]
    best = min(plans, key=lambda p: sum(n for n, _ in p), default=[])
    if stops and sum(n for n, _ in best) > -(-sum(k * v for k, v in histogram.items()) // capacity):
        n, left = stops[-1]
        best = min(best, chosen[:n] + _tightest_fit(sizes, left, capacity), key=lambda p: sum(n for n, _ in p))
    return best


def rounded(histogram: dict[int, int], capacity: int, rounds: int = 12, rate: float = 0.3, rest: float = 0.01) -> tuple[list, list[tuple[int, np.ndarray]], np.ndarray]:
    """The rounded configurations of solve; (how many of them, counts then left) of each stop near the end; the sizes of these counts."""
    sizes = np.array(sorted(k for k, v in histogram.items() if v > 0), np.int64)
    if not len(sizes):
        return [], [], sizes
    if sizes[0] < 1 or sizes[-1] > capacity:
        raise ValueError("lengths must be from 1 to the capacity")
    left = np.array([histogram[int(k)] for k in sizes], np.int64)
    total, chosen, stops = int(left @ sizes), [], []
    while int(left @ sizes) > rest * total:
        live = np.flatnonzero(left)
        own, counts = sizes[live], left[live].copy()
        bought, bound = relax(own, counts, capacity, rounds, rate)
        waste = {use: capacity - sum(int(own[k]) * m for k, m in use) for use in bought}
        allowed = max(int(capacity - float(counts @ own) / bound), min(waste.values()))
        for use, times in sorted(bought.items(), key=lambda x: (sum(m for _, m in x[0]), -x[1], x[0])):
            n = min(max(1, int(times)), *(int(counts[k] // m) for k, m in use)) if waste[use] <= allowed else 0
            if n > 0:
                chosen.append((n, [(int(own[k]), m) for k, m in reversed(use)]))
                for k, m in use:
                    counts[k] -= n * m
        taken = int((left[live] - counts) @ own)
        left[live] = counts
        if int(left @ sizes) <= 0.1 * total:
            stops.append((len(chosen), left.copy()))
        if taken <= (0.003 * total if stops else 0):
            break
    return chosen, stops or [(len(chosen), left)], sizes


def _tightest_fit(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Opens a sequence with the longest piece left and fills it as full as any pieces left can, the longest first.

    Which sums the shorter pieces reach is kept as bits of integers, one for each prefix of the ascending sizes.
    """
    left, plan = counts.copy(), []
    mask = (1 << (capacity + 1)) - 1
    alive = [int(k) for k in np.flatnonzero(left)]
    reach = [1]

    def extend(start: int) -> None:
        del reach[start + 1 :]
        for k in alive[start:]:
            bits, size, n, step = reach[-1], int(sizes[k]), min(int(left[k]), capacity // int(sizes[k])), 1
            while n > 0:  # copies in powers of two
                step = min(step, n)
                bits |= (bits << (size * step)) & mask
                n -= step
                step *= 2
            reach.append(bits)

    extend(0)
    while alive:
        top = alive[-1]
        room = capacity - int(sizes[top])
        use: dict[int, int] = {top: 1}
        j = len(alive) - 1 if left[top] == 1 else len(alive)
        bits = reach[j] & ((1 << (room + 1)) - 1)
        room = bits.bit_length() - 1
        while room > 0:
            size = int(sizes[alive[j - 1]])
            if size <= room and use.get(alive[j - 1], 0) < left[alive[j - 1]] and (reach[j - 1] >> (room - size)) & 1:
                use[alive[j - 1]] = use.get(alive[j - 1], 0) + 1
                room -= size
                j -= 1
                continue
            if (reach[j - 1] >> room) & 1:
                j -= 1
                continue
            n = 1  # several copies of this size
            while not (reach[j - 1] >> (room - n * size)) & 1:
                n += 1
            use[alive[j - 1]] = use.get(alive[j - 1], 0) + n
            room -= n * size
            j -= 1
        use = {k: min(n, int(left[k])) for k, n in use.items()}
        times = max(1, min(int(left[k]) // (2 * n) for k, n in use.items()))
        for k, n in use.items():
            left[k] -= times * n
        plan.append((times, [(int(sizes[k]), n) for k, n in sorted(use.items(), reverse=True)]))
        start = min(alive.index(k) for k in use)
        alive = [k for k in alive if left[k]]
        extend(min(start, len(alive)))
    return plan


def _best_fit(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-fit decreasing over a histogram: equal fillings are made together, as often as their scarcest size allows."""
    left, plan = counts.copy(), []
    alive = [int(k) for k in np.flatnonzero(left)]
    while alive:
        room, use = capacity, []
        k = len(alive) - 1
        while k >= 0:
            k = min(k, int(np.searchsorted(sizes[alive], room, "right")) - 1)
            if k < 0:
                break
            n = min(int(left[alive[k]]), room // int(sizes[alive[k]]))
            use.append((alive[k], n))
            room -= n * int(sizes[alive[k]])
            k -= 1
        times = min(int(left[i]) // n for i, n in use)
        for i, n in use:
            left[i] -= times * n
        plan.append((times, [(int(sizes[i]), n) for i, n in use]))
        alive = [i for i in alive if left[i]]
    return plan


def places(plan: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """By size: rows (first rank, first sequence, copies in a sequence, offset of the first copy), in order of rank."""
    out: dict[int, list] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for times, use in plan:
        offset = 0
        for size, copies in use:
            out.setdefault(size, []).append((ranks.get(size, 0), sequence, copies, offset))
            ranks[size] = ranks.get(size, 0) + times * copies
            offset += size * copies
        sequence += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(cut: DataFrame, capacity: int = 2048, rounds: int = 12) -> DataFrame:
    """Adds sequence_id and offset to pieces(), which must be stored: its shards are counted before they are placed."""
    spark = cut.sparkSession
    made = cut.groupBy("length", "shard").agg(F.count(F.lit(1)).alias("n"))
    totals = {int(r.length): int(r.n) for r in made.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    by_size = spark.sparkContext.broadcast(places(solve(totals, capacity, rounds)))
    from pyspark.sql import Window

    first = made.withColumn("first", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = cut.join(first, ["length", "shard"]).withColumn("rank", F.col("first") + F.col("nth")).drop("first", "nth", "shard")

    def placed(batches):
        for batch in batches:
            lengths, ranks = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("length", "rank"))
            sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            order = np.argsort(lengths, kind="stable")
            cuts = np.flatnonzero(np.diff(lengths[order])) + 1
            for own in np.split(order, cuts) if len(order) else []:
                size, rank = int(lengths[own[0]]), ranks[own]
                runs = by_size.value[size]
                row = runs[np.searchsorted(runs[:, 0], rank, "right") - 1]
                nth = rank - row[:, 0]
                sequence[own], offset[own] = row[:, 1] + nth // row[:, 2], row[:, 3] + nth % row[:, 2] * size
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(placed, ", ".join(f"{n} {t}" for n, t in ranked.dtypes if n != "rank") + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, rounds: int = 12, **options) -> DataFrame:
    """Pieces of all documents with their places."""
    return pack(store(pieces(docs, tokenizer, capacity=capacity, **options), "pieces"), capacity, rounds)
