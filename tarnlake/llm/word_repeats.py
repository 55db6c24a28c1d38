"""Passages of words that repeat go, by suffix automata of reference shards.

Each word goes that lies in a window of ``length`` words whose sequence also starts earlier: in a document of a smaller id, or
earlier in the same document. Documents are stored in chunks of bounded text, each with its vocabulary. The reference of a
shard is what others are to be matched with in one piece of a chunk, at most ``PIECE`` window starts; its suffix automaton is
built from the words themselves, and runs of other documents are streamed past it for matching statistics: the automaton
alone says what goes. Where very many words come to one shard, they are split and its reference goes to each part.

Which runs go to which shard is told by hashes, so that documents need not pass all shards. Every window has an anchor, the
gram of ``gram`` words in it of the least hash; chunks tell the hashes of their anchors, once each, and learn which ones
other chunks have. Only windows of such anchors, or of anchors that their own chunk repeats, are hashed (96 bits) and
gathered, once for each chunk; each is sent to the shard where the window stands first. What repeats within a chunk is matched
there. A window whose automaton does not confirm its hash raises an error rather than a wrong result; ``seed`` picks other hashes.

Words are what white space of ASCII parts, unchanged. Null and empty texts have none; shorter ones lose nothing. Rows of one
id are documents of their own and do not cover each other. Rows without an id lose what repeats within them and cover no others.
Other columns do not pass. An empty table gives an empty one. A single document is held whole by one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automata import SuffixAutomaton
from .common import store
from .repeats import _U, _least, _mix, _tables

PIECE = 1 << 16
#: kind 0: documents of a chunk; 1: anchors; 2: windows; 3: places of a chunk that are covered; 4: places to be matched; 5: places that others are matched with.
PACKED = "kind int, chunk long, block long, n long, data binary"
#: kind 0: the reference of a shard; 1: runs of a chunk that are to be matched with it.
RUNS = "kind int, shard long, piece long, chunk long, n long, data binary"
_STRIPPED = "{key} long, n_words long, n_removed long, kept_sha256 string"


def _table(rows: list[tuple], schema: str) -> pa.Table:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], types[t]) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def _squeeze(*columns: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns), 1)


def _unsqueeze(data: bytes, n: int, *types) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(data), 0, []
    for t in types:
        out.append(np.frombuffer(raw, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


class Chunk:
    """Documents in order of their ids, those without one last; words as numbers of a vocabulary; places count words from the first."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, counts: np.ndarray, vocabulary: list[bytes], words: np.ndarray):
        self.ids, self.known, self.counts, self.vocabulary, self.words = ids, known, counts, vocabulary, words
        self.ends = np.cumsum(counts)

    @classmethod
    def of(cls, ids: list[int | None], texts: list[str | None]) -> Chunk:
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        numbers: dict[bytes, int] = {}
        counts, words = [], []
        for i in order:
            own = texts[i].encode("utf-8", "replace").split() if texts[i] else []
            counts.append(len(own))
            words += [numbers.setdefault(w, len(numbers)) for w in own]
        return cls(np.array([ids[i] or 0 for i in order], np.int64), np.array([ids[i] is not None for i in order], bool), np.array(counts, np.int64), list(numbers), np.array(words, np.uint32))

    def packed(self) -> bytes:
        sizes = np.array([len(w) for w in self.vocabulary], np.uint32)
        head = np.array([len(self.ids), len(sizes), len(self.words)], np.int64)
        return _squeeze(head, self.ids, self.known, self.counts, sizes, self.words, np.frombuffer(b"".join(self.vocabulary), np.uint8))

    @classmethod
    def unpacked(cls, data: bytes) -> Chunk:
        raw = zstandard.decompress(data)
        d, v, w = np.frombuffer(raw, np.int64, 3).tolist()
        at, parts = 24, []
        for t, n in ((np.int64, d), (bool, d), (np.int64, d), (np.uint32, v), (np.uint32, w)):
            parts.append(np.frombuffer(raw, t, n, at))
            at += n * np.dtype(t).itemsize
        stops = (at + np.cumsum(parts[3].astype(np.int64))).tolist()
        return cls(*parts[:3], [raw[a:b] for a, b in zip([at, *stops], stops, strict=False)], parts[4])

    def text(self, first: int, stop: int) -> bytes:
        return b" ".join(map(self.vocabulary.__getitem__, self.words[first:stop].tolist()))

    def windows(self, length: int, gram: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, hash of its anchor, hash) of every window."""
        n = len(self.words)
        if n < length:
            return np.empty(0, np.int64), np.empty(0, _U), np.empty(0, _U)
        up, down = _tables(n)
        sums = np.zeros(n + 1, _U)
        np.cumsum(np.array([xxhash.xxh64_intdigest(w) for w in self.vocabulary], _U)[self.words] * up[:n], out=sums[1:])
        grams = _mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
        low = _U((1 << 28) - 1)
        own = (_least((grams & ~low) | np.arange(len(grams), dtype=_U), length - gram + 1) & low).astype(np.int64)
        begin = np.repeat(np.arange(len(self.counts)), self.counts)[: len(own)]
        at = np.flatnonzero(np.arange(len(own)) + length <= self.ends[begin])
        return at, grams[own[at]], _mix((sums[at + length] - sums[at]) * down[at] + _U(seed))


def _runs(*same: np.ndarray, at: np.ndarray) -> list[tuple[int, int]]:
    """(first, stop) of stretches where `at` goes on by one and all of `same` stay."""
    if not len(at):
        return []
    new = np.concatenate([[True], np.diff(at) != 1])
    for x in same:
        new[1:] |= x[1:] != x[:-1]
    first = np.flatnonzero(new)
    return list(zip(first.tolist(), [*first[1:].tolist(), len(at)], strict=True))


def _confirmed(reference: list[tuple[list[bytes], int, int]], streamed: list[tuple[list[bytes], int, int]], length: int) -> list[list[int]]:
    """For each streamed (words, own, step): its windows that the reference's automaton has at an origin below own.

    reference: (words, origin of the first, step of the origin a word), in order of origins.
    """
    automaton, numbers, origin = SuffixAutomaton(), {}, []
    for words, first, step in reference:
        automaton.add([numbers.setdefault(w, len(numbers)) for w in words])
        origin += range(first, first + len(words)) if step else [first] * len(words)
    out = []
    for words, own, step in streamed:
        found = automaton.starts([numbers.get(w, -1) for w in words], length, origin, own, step)
        if len(found) != len(words) - length + 1:
            raise ValueError("two windows of words share a hash and differ: take another seed")
        out.append(found)
    return out


def _grouped(anchor: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, begins) that put equal windows together, each in the order given."""
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    if (same & (anchor[order][1:] != anchor[order][:-1])).any():
        order = np.lexsort((anchor, window))
    new = np.concatenate([[True], (window[order][1:] != window[order][:-1]) | (anchor[order][1:] != anchor[order][:-1])])
    return order, np.flatnonzero(new)


def _chunks(docs: DataFrame, length: int, gram: int, blocks: int, size: int, seed: int) -> DataFrame:
    """Chunks of about `size` characters; the distinct hashes of their anchors, of several chunks at once."""

    def run(batches):
        base, made = TaskContext.get().partitionId() << 32, 0
        ids, texts, held, waiting = [], [], 0, []

        def closed() -> tuple:
            chunk = Chunk.of(ids, texts)
            waiting.append((made, np.unique(chunk.windows(length, gram, seed)[1])))
            ids.clear(), texts.clear()
            return 0, base + made, None, len(chunk.ids), chunk.packed()

        def dealt() -> list[tuple]:
            anchors, chunks = np.concatenate([a for _, a in waiting]), np.repeat(np.array([k for k, _ in waiting], np.uint32), [len(a) for _, a in waiting])
            waiting.clear()
            block = (anchors % _U(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            return [(1, base, int(block[own[0]]), len(own), anchors[own].tobytes() + chunks[own].tobytes()) for own in np.split(order, np.flatnonzero(np.diff(block[order])) + 1) if len(own)]

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(k), texts.append(t)
                held += len(t) if t else 8
                if held >= size:
                    yield from _table([closed()], PACKED).to_batches()
                    made, held = made + 1, 0
                    if len(waiting) == 24:
                        yield from _table(dealt(), PACKED).to_batches()
        if ids:
            yield from _table([closed()], PACKED).to_batches()
        if waiting:
            yield from _table(dealt(), PACKED).to_batches()

    return docs.mapInArrow(run, PACKED)


def _shared(table: pa.Table) -> pa.Table:
    """For each chunk, those hashes of a block that other chunks have, too."""
    anchors, chunks = [], []
    for base, n, data in zip(*(table.column(c).to_pylist() for c in ("chunk", "n", "data")), strict=True):
        anchors.append(np.frombuffer(data, _U, n))
        chunks.append(np.frombuffer(data, np.uint32, n, 8 * n).astype(np.int64) + base)
    anchors, chunks = np.concatenate(anchors), np.concatenate(chunks)
    order = np.argsort(anchors, kind="stable")
    anchors, chunks = anchors[order], chunks[order]
    same = anchors[1:] == anchors[:-1]
    several = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    anchors, chunks = anchors[several], chunks[several]
    order = np.argsort(chunks, kind="stable")
    return _table([(1, int(chunks[own[0]]), None, len(own), anchors[own].tobytes()) for own in np.split(order, np.flatnonzero(np.diff(chunks[order])) + 1) if len(own)], PACKED)


def _local(chunk: Chunk, at: np.ndarray, doc: np.ndarray, order: np.ndarray, begin: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(which of the windows `at` are repeats within the chunk, their places as the automata tell them)."""
    ids, known = chunk.ids[doc], chunk.known[doc]
    group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(order))))
    first = order[begin][group]
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (doc[order][1:] != doc[order][:-1])])
    within = order[np.flatnonzero(new)[np.cumsum(new) - 1]]  # of the window's first place in the same document
    target = np.full(len(at), -1)
    across = known[order] & known[first] & (ids[order] > ids[first])
    target[order] = np.where(across, first, np.where(within != order, within, -1))
    claimed = np.flatnonzero(target >= 0)
    own, to = at[claimed], at[target[claimed]]
    inner = doc[claimed] == doc[target[claimed]]
    shard = np.where(inner, -1 - doc[claimed], 0)
    found: list[int] = []
    shard = np.stack([shard, to // PIECE])
    turn = np.lexsort((own, shard[1], shard[0]))
    for part in np.split(turn, np.flatnonzero((np.diff(shard[:, turn]) != 0).any(0)) + 1) if len(turn) else []:
        alone = bool(inner[part[0]])
        places = np.unique(to[part])
        where = np.searchsorted(chunk.ends, places, "right")
        words = lambda a, b: list(map(chunk.vocabulary.__getitem__, chunk.words[a : b + length - 1].tolist()))
        reference = [(words(places[a], places[b - 1] + 1), int(places[a]) if alone else int(chunk.ids[where[a]]), int(alone)) for a, b in _runs(where, at=places)]
        shift = own[part] - to[part]
        runs = [(own[part][a], own[part][b - 1] + 1) for a, b in _runs(shift, at=own[part])]
        streamed = [(words(a, b), int(a) if alone else int(chunk.ids[np.searchsorted(chunk.ends, a, "right")]), int(alone)) for a, b in runs]
        for (a, _), starts in zip(runs, _confirmed(reference, streamed, length), strict=True):
            found += [int(a) + x for x in starts]
    return target >= 0, np.array(found, np.int64)


def _windows(chunks: pa.Table, told: pa.Table, length: int, gram: int, blocks: int, seed: int) -> pa.Table:
    """What repeats within a chunk, and its other windows of anchors that other chunks have."""
    name, chunk = chunks.column("chunk")[0].as_py(), Chunk.unpacked(chunks.column("data")[0].as_py())
    at, anchor, window = chunk.windows(length, gram, seed)
    away = np.unique(np.frombuffer(b"".join(told.column("data").to_pylist()), _U))
    ordered = np.sort(window)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    remote = _within(anchor, away)
    some = np.flatnonzero(remote | _within(window, twice))
    if not len(some):
        return _table([], PACKED)
    at, anchor, window, remote = (x[some] for x in (at, anchor, window, remote))
    doc = np.searchsorted(chunk.ends, at, "right")
    claimed, covered = _local(chunk, at, doc, *_grouped(anchor, window), length)
    rows = [(3, name, None, len(covered), _squeeze(covered.astype(np.uint32)))] if len(covered) else []
    sent = np.flatnonzero(remote & ~claimed & chunk.known[doc])
    block = (anchor[sent] % _U(blocks)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    for own in np.split(sent[order], np.flatnonzero(np.diff(block[order])) + 1):
        if len(own):
            place = at[own].astype(np.uint32)
            rows.append((2, name, int(anchor[own[0]] % _U(blocks)), len(own), _squeeze(window[own], anchor[own].astype(np.uint32), np.diff(chunk.ids[doc[own]], prepend=0), np.diff(place, prepend=place[:1]), place[:1])))
    return _table(rows, PACKED)


def _within(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of x are among the sorted known."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _matches(table: pa.Table) -> pa.Table:
    """Of a block of windows: which places of chunks are to be matched with the first place of their window."""
    parts = []
    for name, n, data in zip(*(table.column(c).to_pylist() for c in ("chunk", "n", "data")), strict=True):
        raw = zstandard.decompress(data)
        place = np.frombuffer(raw, np.uint32, 1, 24 * n)[0] + np.cumsum(np.frombuffer(raw, np.uint32, n, 20 * n), dtype=np.uint32)
        parts.append((np.frombuffer(raw, _U, n), np.frombuffer(raw, np.uint32, n, 8 * n), np.cumsum(np.frombuffer(raw, np.int64, n, 12 * n)), np.full(n, name), place))
    window, anchor, ids, chunks, place = (np.concatenate([p[i] for p in parts]) for i in range(5))
    order = np.lexsort((place, chunks, ids))
    window, anchor, ids, chunks, place = (x[order] for x in (window, anchor, ids, chunks, place))
    order, begin = _grouped(anchor, window)
    first = np.repeat(order[begin], np.diff(np.append(begin, len(order))))
    claimed = ids[order] > ids[first]
    own, to = order[claimed], first[claimed]
    rows = []
    by = np.lexsort((place[own], chunks[own]))
    for x in np.split(by, np.flatnonzero(np.diff(chunks[own][by])) + 1):
        if len(x):
            rows.append((4, int(chunks[own[x[0]]]), None, len(x), _squeeze(chunks[to[x]], place[own[x]], place[to[x]])))
    wanted = np.unique(to)
    by = np.lexsort((place[wanted], chunks[wanted]))
    for x in np.split(wanted[by], np.flatnonzero(np.diff(chunks[wanted][by])) + 1):
        if len(x):
            rows.append((5, int(chunks[x[0]]), None, len(x), _squeeze(place[x])))
    return _table(rows, PACKED)


def _spread(chunks: pa.Table, told: pa.Table, length: int) -> pa.Table:
    """The words of a chunk that are reference, by piece, and those to be matched, by shard."""
    name, chunk = chunks.column("chunk")[0].as_py(), Chunk.unpacked(chunks.column("data")[0].as_py())
    got = {4: [], 5: []}
    for kind, n, data in zip(*(told.column(c).to_pylist() for c in ("kind", "n", "data")), strict=True):
        got[kind].append(_unsqueeze(data, n, *((np.int64, np.uint32, np.uint32) if kind == 4 else (np.uint32,))))
    rows = []

    def packed(kind: int, shard: int, piece: int, runs: list[tuple[int, int]]) -> None:
        first, last = np.array([a for a, _ in runs], np.int64), np.array([b for _, b in runs], np.int64)
        texts = [chunk.text(a, b + length) for a, b in runs]
        ids, sizes = chunk.ids[np.searchsorted(chunk.ends, first, "right")], np.array([len(t) for t in texts], np.int64)
        data = np.array([len(runs)], np.int64).tobytes() + b"".join(x.tobytes() for x in (ids, first, sizes)) + b"".join(texts)
        rows.append((kind, shard, piece, name, int((last - first + length).sum()), zstandard.compress(data, 1)))

    if got[5]:
        place = np.unique(np.concatenate([g[0] for g in got[5]])).astype(np.int64)
        doc = np.searchsorted(chunk.ends, place, "right")
        for own in np.split(np.arange(len(place)), np.flatnonzero(np.diff(place // PIECE)) + 1):
            packed(0, name, int(place[own[0]] // PIECE), [(int(place[own[a]]), int(place[own[b - 1]])) for a, b in _runs(doc[own], at=place[own])])
    if got[4]:
        shard, own, to = (np.concatenate([g[i] for g in got[4]]).astype(np.int64) for i in range(3))
        order = np.lexsort((own, to // PIECE, shard))
        shard, own, to = (x[order] for x in (shard, own, to))
        runs: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for a, b in _runs(shard, to // PIECE, own - to, at=own):
            runs.setdefault((int(shard[a]), int(to[a]) // PIECE), []).append((int(own[a]), int(own[b - 1])))
        for (s, p), r in runs.items():
            packed(1, s, p, r)
    return _table(rows, RUNS)


def _unpacked(data: bytes) -> list[tuple[int, int, list[bytes]]]:
    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    ids, first, sizes = np.frombuffer(raw, np.int64, 3 * n, 8).reshape(3, n)
    stops = (8 + 24 * n + np.cumsum(sizes)).tolist()
    return [(k, a, raw[x:y].split(b" ")) for k, a, x, y in zip(ids.tolist(), first.tolist(), [8 + 24 * n, *stops], stops, strict=False)]


def _matched(reference: pa.Table, streamed: pa.Table, length: int) -> pa.Table:
    """What the automaton of a shard has of the runs that come to it."""
    runs = sorted((r for data in reference.column("data").to_pylist() for r in _unpacked(data)), key=lambda r: r[:2])
    names, own = [], []
    for name, data in zip(streamed.column("of").to_pylist(), streamed.column("words").to_pylist(), strict=True):
        for k, a, words in _unpacked(data):
            names.append((name, a))
            own.append((words, k, 0))
    found: dict[int, list[int]] = {}
    for (name, a), starts in zip(names, _confirmed([(w, k, 0) for k, _, w in runs], own, length), strict=True):
        found.setdefault(name, []).extend(a + x for x in starts)
    return _table([(3, name, None, len(x), _squeeze(np.array(x, np.uint32))) for name, x in found.items()], PACKED)


def _stripped(chunks: pa.Table, covered: pa.Table, length: int, with_text: bool) -> pa.Table:
    chunk = Chunk.unpacked(chunks.column("data")[0].as_py())
    marks = np.zeros(len(chunk.words) + 1, np.int64)
    for n, data in zip(covered.column("n").to_pylist(), covered.column("data").to_pylist(), strict=True):
        at = _unsqueeze(data, n, np.uint32)[0].astype(np.int64)
        np.add.at(marks, at, 1)
        np.add.at(marks, at + length, -1)
    gone = np.cumsum(marks[:-1]) > 0
    removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[np.concatenate([[0], chunk.ends])])
    hashes, texts = [], []
    for n, a, b in zip(removed.tolist(), (chunk.ends - chunk.counts).tolist(), chunk.ends.tolist(), strict=True):
        words = chunk.words[a:b]
        kept = b" ".join(map(chunk.vocabulary.__getitem__, (words[~gone[a:b]] if n else words).tolist()))
        hashes.append(hashlib.sha256(kept).hexdigest())
        texts.append(kept.decode() if with_text else None)
    out = {"k": pa.array(chunk.ids, mask=~chunk.known), "n_words": chunk.counts, "n_removed": removed, "kept_sha256": pa.array(hashes, pa.string())}
    return pa.table(out | ({"text": pa.array(texts, pa.string())} if with_text else {}))


def remove_repeats(docs: DataFrame, *, length: int = 20, gram: int = 10, key: str = "doc_id", text: str = "text", with_text: bool = False, size: int = 1 << 20, part: int = 1 << 18, seed: int = 0) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256[, text]) of every row; text is the kept words, joined by a blank.

    ``size`` is a chunk's text in characters, but for a longer document; ``part`` the words that one task streams past a shard.
    """
    if not 1 <= gram <= length:
        raise ValueError("a gram has at least one word and no more than a passage")
    n = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(64, n >> 22)
    made = store(_chunks(docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")), length, gram, blocks, size, seed), "chunks")
    chunks = made.where("kind = 0").select(F.col("chunk"), "data").groupBy("chunk")
    by_chunk = lambda df: df.withColumnRenamed("chunk", "of").groupBy("of")
    shared = store(made.where("kind = 1").groupBy("block").applyInArrow(_shared, PACKED), "shared")
    windows = store(chunks.cogroup(by_chunk(shared)).applyInArrow(lambda c, t: _windows(c, t, length, gram, blocks, seed), PACKED), "windows")
    matches = store(windows.where("kind = 2").groupBy("block").applyInArrow(_matches, PACKED), "matches")
    runs = store(chunks.cogroup(by_chunk(matches)).applyInArrow(lambda c, t: _spread(c, t, length), RUNS), "runs")
    hot = store(runs.where("kind = 1").groupBy("shard", "piece").agg(F.ceil(F.sum("n") / part).alias("parts")).where("parts > 1"), "hot")
    runs = runs.join(hot, ["shard", "piece"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    reference = runs.where("kind = 0").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    streamed = runs.where("kind = 1").select(F.col("shard").alias("to"), F.col("piece").alias("to_piece"), F.pmod(F.xxhash64("chunk"), "parts").alias("to_part"), F.col("chunk").alias("of"), F.col("data").alias("words"))
    found = store(reference.groupBy("shard", "piece", "part").cogroup(streamed.groupBy("to", "to_piece", "to_part")).applyInArrow(lambda r, s: _matched(r, s, length), PACKED), "found")
    covered = windows.where("kind = 3").unionByName(found)
    out = chunks.cogroup(by_chunk(covered)).applyInArrow(lambda c, t: _stripped(c, t, length, with_text), _STRIPPED.format(key="k") + ", text string" * with_text)
    return out.withColumnRenamed("k", key)
