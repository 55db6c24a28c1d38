"""Exact removal of passages that repeat across documents, by suffix arrays of linear grouping.

Each byte goes that lies in a ``length``-byte string which also starts in a document of a smaller id. Suffixes of the whole
corpus never meet in one place. Every window of ``length`` bytes has an anchor, the gram of ``gram`` bytes in it of the
least hash; equal windows have equal anchors at the same place, so they meet where anchors of one hash are gathered. An
anchor owns a run of windows, its context. Contexts that are equal form a class; beside its first document all its members
are covered at once, whatever the number of copies. That is found by hashes and then told on bytes: within a task at once, so
that a hot anchor leaves a task once only, and between tasks by comparing each member with the one before it, of which it
gets the bytes. What is left is one document's context for each class, and only where classes of one anchor share a window
(known by hashes). Those contexts' bytes are fetched, equal ones are joined, and the rest - where passages begin, end or
differ - is decided on a suffix array (suffix_groups) of each block of anchors.

Anchors are dealt out packed, about 15 bytes each. A block of anchors and a block of documents hold a bounded number of bytes
of text on average; their numbers grow with the corpus.

Null and empty texts, and those shorter than ``length``, lose nothing. Rows without an id neither cover nor are covered.
Rows of one id do not cover each other. Two strings that share a hash of 96 bits and differ raise an error; ``seed`` picks
other hashes. Bytes are removed from the input as it is, so what is kept of a text may end within a character; ``text``
drops such rests. Other columns pass only if named in ``also``. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, store

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_CHUNK = 1 << 20
#: kind 0: bytes that are covered; 1: contexts to decide; 2: contexts that another document's, the one in to_, is to equal.
FOUND = "kind int, block long, docs binary, tags binary, firsts binary, lasts binary, groups binary, to_docs binary, to_tags binary, to_firsts binary"


def _inverse(x: np.uint64) -> np.uint64:
    y = int(x)
    for _ in range(6):
        y = y * (2 - int(x) * y) % (1 << 64)
    return _U(y)


def _powers(x: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, x, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    claim("powers", _TABLES.clear)
    n = 1 << max(21, (n + 1).bit_length())
    if n not in _TABLES:
        _TABLES[n] = (_powers(_STEP, n), _powers(_inverse(_STEP), n))
    return _TABLES[n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if step < width else x


def anchors(texts: list[bytes], length: int, gram: int, seed: int = 0) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, hash of the anchor, hash of the context) of every anchor of the texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data)
    if n < length:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, _U, _U))
    up, down = _tables(n)
    sums = np.zeros(n + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * up[:n], out=sums[1:])
    grams = _mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    low = _U((1 << 28) - 1)
    own = (_least((grams & ~low) | np.arange(len(grams), dtype=_U), length - gram + 1) & low).astype(np.int64)
    stops = np.cumsum(sizes)
    text = np.repeat(np.arange(len(texts)), sizes)[: len(own)]
    inside = np.arange(len(own)) + length <= stops[text]
    edge = (own[1:] != own[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(inside & np.concatenate([[True], edge]))
    last = np.flatnonzero(inside & (np.concatenate([edge, [True]]) | np.concatenate([~inside[1:], [True]])))
    place = own[first]
    context = _mix((sums[last + length] - sums[first]) * down[first] + _U(seed) + (place - first).astype(_U) * _U(0x2545F4914F6CDD1D) + (last - first).astype(_U) * _U(0x9E6C63D0876A9A47))
    of = text[first]
    begin = (stops - sizes)[of]
    return of, first - begin, last - begin, grams[place], context


def windows(text: bytes, length: int) -> np.ndarray:
    """A hash for each window of a short text."""
    up, down = _tables(len(text))
    sums = np.zeros(len(text) + 1, _U)
    np.cumsum((np.frombuffer(text, np.uint8).astype(_U) + _U(1)) * up[: len(text)], out=sums[1:])
    n = len(text) - length + 1
    return _mix((sums[length:] - sums[:-length]) * down[:n])


def _squeeze(*columns: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns), 1)


def _runs(*same: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Where runs begin, of contexts in order of `first`: those that agree in all of `same` and follow each other without a gap."""
    new = np.ones(len(first), bool)
    new[1:] = first[1:] > last[:-1] + 1
    for x in same:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _local(texts: list[bytes], ids: np.ndarray, of: np.ndarray, first: np.ndarray, last: np.ndarray, grams: np.ndarray, context: np.ndarray, length: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Which contexts equal, byte by byte, one of a text of a smaller id among these; and (text, first, last) of the runs they cover."""
    key = _mix(grams + context * _STEP)
    order = np.lexsort((ids[of], key))
    key = key[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    like = np.empty(len(of), np.int64)
    like[order] = np.repeat(order[head], np.diff(np.append(head, len(order))))
    known = np.flatnonzero((ids[of] > ids[of[like]]) & (grams == grams[like]) & (context == context[like]))
    known = known[np.lexsort((first[known], of[known]))]
    other, shift = like[known], first[like[known]] - first[known]
    begin = _runs(of[known], of[other], shift, first=first[known], last=last[known])
    gone, runs = np.zeros(len(of), bool), []
    for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(known)], strict=False):
        t, u, x, y, s = int(of[known[a]]), int(of[other[a]]), int(first[known[a]]), int(last[known[b - 1]]) + length, int(shift[a])
        if texts[t][x:y] == texts[u][x + s : y + s]:
            gone[known[a:b]] = True
            runs.append((t, x, y - length))
    return gone, runs


def _deal(docs: DataFrame, length: int, gram: int, blocks: int, doc_blocks: int, seed: int):
    """Packed anchors by block of their hash, and what is covered within the task by -1 less the block of its document: (block, n, docs, small, hashes)."""

    def run(batches):
        texts, keys, parts, kept, covers, fresh = [], [], [], [], [], [0, 0]  # fresh: texts, and their bytes, whose anchors are not made yet

        def flush():
            if fresh[0]:
                start = len(texts) - fresh[0]
                of, first, last, grams, context = anchors(texts[start:], length, gram, seed)
                parts.append(((of + start).astype(np.int32), first.astype(np.int32), last.astype(np.int32), grams, context))
            fresh[:] = [0, 0]

        def settle():
            """Compares what is held byte by byte, then keeps only the anchors of what equals nothing here."""
            flush()
            if not parts:
                return
            of, first, last, grams, context = (np.concatenate([p[i] for p in parts]) for i in range(5))
            parts.clear()
            ids_of, tags_of = np.array(keys, np.int64), np.array([zlib.crc32(t) for t in texts], np.uint32)
            gone, runs = _local(texts, ids_of, of, first, last, grams, context, length)
            at, lo, hi = (np.array([r[i] for r in runs], np.int64) for i in range(3))
            covers.append((ids_of[at], tags_of[at], lo.astype(np.int32), hi.astype(np.int32)))
            of, first, last, grams, context = (x[~gone] for x in (of, first, last, grams, context))
            kept.append((ids_of[of], tags_of[of], first.astype(np.uint32), (last - first).astype(np.uint8), grams, context))
            texts.clear(), keys.clear()

        def packed():
            rows = []
            ids, tags, lo, hi = (np.concatenate([c[i] for c in covers]) for i in range(4))
            block = _block(ids, tags, doc_blocks)
            order = np.argsort(block, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
                if len(own):
                    rows.append((-1 - int(block[own[0]]), len(own), 0, _squeeze(ids[own], tags[own], lo[own], hi[own]), b""))
            ids, tags, first, span, grams, context = (np.concatenate([k[i] for k in kept]) for i in range(6))
            covers.clear(), kept.clear()
            block = (grams % _U(blocks)).astype(np.int64)
            order = np.lexsort((first, tags, ids, block))
            block, ids, tags, first, span, grams, context = (x[order] for x in (block, ids, tags, first, span, grams, context))
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)] if len(block) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                new = np.concatenate([[True], (ids[a + 1 : b] != ids[a : b - 1]) | (tags[a + 1 : b] != tags[a : b - 1])])
                raw = (grams[a:b] & _U((1 << 48) - 1)).view(np.uint16).reshape(-1, 4)[:, :3], context[a:b].view(np.uint16).reshape(-1, 4)[:, :3]
                at = first[a:b].copy()
                at[1:][~new[1:]] -= first[a : b - 1][~new[1:]]  # differences within a document
                begin = np.flatnonzero(new)
                rows.append((int(block[a]), b - a, len(begin), _squeeze(np.diff(ids[a:b][begin], prepend=0), tags[a:b][begin], begin.astype(np.uint32), at.view(np.uint8).reshape(-1, 4).T, span[a:b]), raw[0].tobytes() + raw[1].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["block", "n", "docs", "small", "hashes"])

        held, size = 0, 0
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = t.encode("utf-8", "replace") if t else b""
                if k is None or len(raw) < length:
                    continue
                if fresh[1] + len(raw) > _CHUNK:
                    flush()
                texts.append(raw)
                keys.append(k)
                fresh[:] = [fresh[0] + 1, fresh[1] + len(raw)]
                held, size = held + len(raw), size + len(raw)
                if held > 8 << 20:  # what a task holds is bounded, of texts by this and of anchors by the other
                    settle()
                    held = 0
                if size > 48 << 20:
                    settle()
                    held, size = 0, 0
                    yield packed()
        settle()
        if kept:
            yield packed()

    return docs.mapInArrow(run, "block long, n long, docs long, small binary, hashes binary")


def _unpack(n: int, docs: int, small: bytes, hashes: bytes) -> tuple[np.ndarray, ...]:
    raw = zstandard.decompress(small)
    ids = np.cumsum(np.frombuffer(raw, np.int64, docs))
    tags, begin = np.frombuffer(raw, np.uint32, docs, 8 * docs), np.frombuffer(raw, np.uint32, docs, 12 * docs)
    at = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, 16 * docs).reshape(4, n).T).view(np.uint32).ravel().astype(np.int64)
    span = np.frombuffer(raw, np.uint8, n, 16 * docs + 4 * n)
    counts = np.diff(np.append(begin.astype(np.int64), n))
    total = np.cumsum(at)
    first = total - np.repeat(total[begin] - at[begin], counts)
    both = np.zeros((2, n, 4), np.uint16)
    both[:, :, :3] = np.frombuffer(hashes, np.uint16).reshape(2, n, 3)
    return np.repeat(ids, counts), np.repeat(tags, counts), first, first + span, both[0].view(_U).ravel(), both[1].view(_U).ravel()


def _block(ids: np.ndarray, tags: np.ndarray, blocks: int) -> np.ndarray:
    return (ids ^ (ids >> 17) ^ tags.astype(np.int64)) % blocks


_KINDS = {"docs": np.int64, "tags": np.uint32, "firsts": np.int32, "lasts": np.int32, "groups": _U, "to_docs": np.int64, "to_tags": np.uint32, "to_firsts": np.int32}


def _rows(kind: int, blocks: int, **columns: np.ndarray) -> list[tuple]:
    """Rows of FOUND, one for each block of the documents in `docs`; columns that are not given are empty."""
    block = _block(columns["docs"], columns["tags"], blocks)
    order = np.argsort(block, kind="stable")
    return [(kind, int(block[own[0]]), *[columns[n][own].astype(t).tobytes() if n in columns else b"" for n, t in _KINDS.items()]) for own in np.split(order, np.flatnonzero(np.diff(block[order])) + 1) if len(own)]


def _found_table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), *[pa.binary()] * len(_KINDS)))], names=["kind", "block", *_KINDS])


def _classes(table: pa.Table, blocks: int) -> pa.Table:
    """Of a block of anchors: what is to equal an earlier member of its class (kind 2), and what is left to decide (kind 1).

    What was covered within the tasks is passed on (kind 0).
    """
    if table.column("block")[0].as_py() < 0:
        rows = []
        for n, small in zip(table.column("n").to_pylist(), table.column("small").to_pylist(), strict=True):
            raw = zstandard.decompress(small)
            rows += _rows(0, blocks, docs=np.frombuffer(raw, np.int64, n), tags=np.frombuffer(raw, np.uint32, n, 8 * n), firsts=np.frombuffer(raw, np.int32, n, 12 * n), lasts=np.frombuffer(raw, np.int32, n, 16 * n))
        return _found_table(rows)
    got = [_unpack(*r) for r in zip(*(table.column(c).to_pylist() for c in ("n", "docs", "small", "hashes")), strict=True)]
    ids, tags, first, last, grams, context = (np.concatenate([g[i] for g in got]) for i in range(6))
    order = np.lexsort((tags, ids, context, grams))
    ids, tags, first, last, grams, context = (x[order] for x in (ids, tags, first, last, grams, context))
    new_group = np.concatenate([[True], grams[1:] != grams[:-1]])
    new_class = new_group | np.concatenate([[True], context[1:] != context[:-1]])
    least = ids[new_class][np.cumsum(new_class) - 1]
    covered = ids > least
    begin = np.flatnonzero(new_group)
    of = np.cumsum(new_group) - 1
    several = np.add.reduceat(new_class.astype(np.int64), begin) > 1
    apart = np.minimum.reduceat(ids, begin) < np.maximum.reduceat(ids, begin)
    asked = ~covered & (several & apart)[of]
    at = np.flatnonzero(covered)
    equal = _rows(2, blocks, docs=ids[at - 1], tags=tags[at - 1], firsts=first[at - 1], lasts=last[at - 1], to_docs=ids[at], to_tags=tags[at], to_firsts=first[at])
    return _found_table(equal + _rows(1, blocks, docs=ids[asked], tags=tags[asked], firsts=first[asked], lasts=last[asked], groups=grams[asked]))


def _spread(table: pa.Table, *names: str) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(b"".join(table.column(n).to_pylist()), _KINDS[n]) for n in names)


#: kind 1: a context to decide, by block of its anchor; 2: what bytes of `doc` from `first` on are to equal, by block of doc.
CONTEXTS = "kind int, block long, grp long, doc long, tag long, first int, context binary"


def _fetch(docs: pa.Table, found: pa.Table, length: int, blocks: int, doc_blocks: int) -> pa.Table:
    """The bytes of the contexts that are to be decided, and of those that others are to equal."""
    asked, equal = (found.filter(pa.compute.equal(found.column("kind"), k)) for k in (1, 2))
    ids, tags, first, last, groups = _spread(asked, "docs", "tags", "firsts", "lasts", "groups")
    own = _spread(equal, "docs", "tags", "to_docs", "to_tags", "firsts", "lasts", "to_firsts")
    wanted = set(zip(ids.tolist(), tags.tolist(), strict=True)) | set(zip(own[0].tolist(), own[1].tolist(), strict=True))
    texts: dict[tuple[int, int], bytes] = {}
    for k, t in zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist(), strict=True):
        if t and k is not None and (key := (k, zlib.crc32(raw := t.encode("utf-8", "replace")))) in wanted:
            texts[key] = raw
    out = [(1, g, h, k, c, a, texts[k, c][a : b + length]) for g, h, k, c, a, b in zip((groups % _U(blocks)).tolist(), groups.astype(np.int64).tolist(), ids.tolist(), tags.tolist(), first.tolist(), last.tolist(), strict=True)]
    shift = own[6].astype(np.int64) - own[4]
    order = np.lexsort((own[4], shift, *own[3::-1]))
    doc, tag, to_doc, to_tag, first, last, to_first, shift = (x[order] for x in (*own, shift))
    begin = _runs(doc, tag, to_doc, to_tag, shift, first=first, last=last)
    block = _block(to_doc, to_tag, doc_blocks)
    for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(doc)], strict=False):
        out.append((2, int(block[a]), 0, int(to_doc[a]), int(to_tag[a]), int(to_first[a]), texts[int(doc[a]), int(tag[a])][int(first[a]) : int(last[b - 1]) + length]))
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.Table.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=[x.split()[0] for x in CONTEXTS.split(", ")])


def _decide(table: pa.Table, length: int, blocks: int, most: int = 1 << 19) -> pa.Table:
    """Runs of starts that repeat, of the contexts of a block of anchors, by suffix arrays."""
    from .suffix_groups import repeated

    grp, doc, tag, first = (table.column(c).to_numpy() for c in ("grp", "doc", "tag", "first"))
    contexts = table.column("context").to_pylist()
    # windows that no context of another document has are left out; equal rests of a group are joined
    hashes = [windows(c, length) for c in contexts]
    counts = np.array([len(h) for h in hashes])
    flat, of = np.concatenate(hashes), np.repeat(np.arange(len(contexts)), counts)
    order = np.lexsort((doc[of], flat))
    ordered, docs_of = flat[order], doc[of][order]
    begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    shared = np.zeros(len(flat), bool)
    shared[order] = np.repeat(np.minimum.reduceat(docs_of, begin) < np.maximum.reduceat(docs_of, begin), np.diff(np.append(begin, len(order))))
    starts = np.cumsum(counts) - counts
    strings: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
    for k in np.unique(of[shared]).tolist():
        own = np.flatnonzero(shared[starts[k] : starts[k] + counts[k]])
        for part in np.split(own, np.flatnonzero(np.diff(own) > 1) + 1):
            a, b = int(part[0]), int(part[-1])
            strings.setdefault((int(grp[k]), contexts[k][a : b + length]), []).append((k, a))
    hits: list[tuple[int, int, int]] = []
    block: list[tuple[bytes, list]] = []
    size, group = 0, None

    def solve() -> None:
        nonlocal size
        least = [min(int(doc[k]) for k, _ in members) for _, members in block]
        for (string, members), own, spans in zip(block, least, repeated([s for s, _ in block], least, length), strict=True):
            for k, a in members:
                if doc[k] > own:
                    hits.append((k, a, a + len(string) - length))
                else:
                    hits.extend((k, a + x, a + y) for x, y in spans)
        block.clear()
        size = 0

    for (g, string), members in sorted(strings.items(), key=lambda x: x[0]):
        if g != group and size >= most:
            solve()
        group = g
        block.append((string, members))
        size += len(string) + 1
    if block:
        solve()
    at = np.array([k for k, _, _ in hits], np.int64)
    lo, hi = (np.array([h[i] for h in hits], np.int64) for i in (1, 2))
    return _found_table(_rows(0, blocks, docs=doc[at], tags=tag[at], firsts=first[at] + lo, lasts=first[at] + hi))


def _strip(docs: pa.Table, found: pa.Table, length: int, with_text: bool, also: tuple[str, ...]) -> pa.Table:
    known = found.filter(pa.compute.equal(found.column("kind"), 0))
    ids, tags, first, last = _spread(known, "docs", "tags", "firsts", "lasts")
    equal = found.filter(pa.compute.equal(found.column("kind"), 2))
    more: dict[tuple[int, int], list[tuple[int, bytes]]] = {}
    for k, g, a, c in zip(*(equal.column(n).to_pylist() for n in ("doc", "tag", "first", "context")), strict=True):
        more.setdefault((k, g), []).append((a, c))
    equal = [(k, g, a, a + len(c) - length) for (k, g), own in more.items() for a, c in own]
    ids, tags, first, last = (np.concatenate([x, np.array([e[i] for e in equal], x.dtype)]) for i, x in enumerate((ids, tags, first, last)))
    order = np.lexsort((first, tags, ids))
    ids, tags, first, last = (x[order] for x in (ids, tags, first, last))
    cuts = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])])) if len(ids) else np.empty(0, np.int64)
    at = {(int(ids[a]), int(tags[a])): (a, b) for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(ids)][: len(cuts)], strict=True)}
    out: dict[str, list] = {n: [] for n in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "text")}
    for k, t in zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist(), strict=True):
        raw = t.encode("utf-8", "replace") if t else b""
        own = (k, zlib.crc32(raw))
        a, b = at.get(own, (0, 0)) if k is not None else (0, 0)
        if k is not None and any(raw[x : x + len(c)] != c for x, c in more.get(own, ())):
            raise ValueError(f"strings of document {k} and another share a hash and differ: take another seed")
        kept, place, removed, spans = [], 0, 0, 0
        if b > a:
            lo, hi = first[a:b].astype(np.int64), np.maximum.accumulate(last[a:b].astype(np.int64) + length)
            new = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
            for x, y in zip(lo[new].tolist(), hi[np.append(new[1:] - 1, len(hi) - 1)].tolist(), strict=True):
                kept.append(raw[place:x])
                place, removed, spans = y, removed + y - x, spans + 1
        rest = b"".join([*kept, raw[place:]])
        for n, v in zip(out, (len(raw), removed, spans, hashlib.sha256(rest).hexdigest(), (rest.decode("utf-8", "ignore") if removed else t) if with_text else None), strict=True):
            out[n].append(v)
    cols = {"doc_id": docs.column("doc_id").combine_chunks(), "n_bytes": pa.array(out["n_bytes"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "n_spans": pa.array(out["n_spans"], pa.int64()), "kept_sha256": pa.array(out["kept_sha256"], pa.string())}
    cols |= {"text": pa.array(out["text"], pa.string())} if with_text else {}
    return pa.table(cols | {f"own_{i}": docs.column(f"own_{i}").combine_chunks() for i in range(len(also))})


def remove_repeats(docs: DataFrame, *, length: int = 50, gram: int = 24, key: str = "doc_id", text: str = "text", with_text: bool = False, also: tuple[str, ...] = (), seed: int = 0) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256[, text], *also) of every row; text is what is kept."""
    if not 8 <= gram < length or length - gram > 255:
        raise ValueError("a gram has at least 8 bytes, fewer than a passage, and a passage at most 255 more")
    n = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    # by the corpus alone: a block of anchors sends a row to each block of documents at most
    blocks, doc_blocks = max(16, n >> 21), max(16, n >> 22)
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = store(_deal(own, length, gram, blocks, doc_blocks, seed).groupBy("block").applyInArrow(lambda t: _classes(t, doc_blocks), FOUND), "repeats")
    kinds = dict(docs.dtypes)
    carried = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *(F.col(c).alias(f"own_{i}") for i, c in enumerate(also)))
    # rows of one id part by their text, rows without an id by it alone
    tag = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    block = F.pmod(F.coalesce(F.col("doc_id").bitwiseXOR(F.shiftright("doc_id", 17)), F.lit(0).cast("long")).bitwiseXOR(tag), F.lit(doc_blocks))
    dealt = own.withColumn("block", block)
    fetched = store(dealt.groupBy("block").cogroup(found.where("kind > 0").groupBy("block")).applyInArrow(lambda d, f: _fetch(d, f, length, blocks, doc_blocks), CONTEXTS), "contexts")
    decided = store(fetched.where("kind = 1").drop("kind").groupBy("block").applyInArrow(lambda t: _decide(t, length, doc_blocks), FOUND), "repeats")
    covered = [x.where("kind = 0").select("kind", "block", "docs", "tags", "firsts", "lasts") for x in (found, decided)]
    every = covered[0].unionByName(covered[1]).unionByName(fetched.where("kind = 2").drop("grp"), allowMissingColumns=True)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * with_text + "".join(f", own_{i} {kinds[c]}" for i, c in enumerate(also))
    out = carried.withColumn("block", block).groupBy("block").cogroup(every.groupBy("block")).applyInArrow(lambda d, f: _strip(d, f, length, with_text, also), schema)
    return out.withColumnsRenamed({"doc_id": key} | {f"own_{i}": c for i, c in enumerate(also)})
