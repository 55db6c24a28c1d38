"""Alignment of two tokenizers by a dictionary of groups.

The tokens of a byte-level tokenizer (A) and of a piece tokenizer (B) over the same bytes are cut into groups wherever both
end. Distinct groups are interned: a chunk of documents holds numbers of groups, and its dictionary has one row for each
distinct group with the number of its occurrences and of the documents that hold it. Links are expanded once for each distinct
group of the corpus, multiplied by those numbers, summed by pair of ids, and joined back by the group to the chunks. So
shuffles carry a row for each distinct group and chunk, not for each token, and a frequent group is no hot key.

Both tokenizers part where something that is no white space meets white space, so a text's tokens are those of its segments
(white space and what follows up to the next); this is checked against the vocabulary. Segments are encoded once and kept in
a memo of bounded size. Where a segment's bytes are not those of its tokens, the whole text is encoded at once and judged.

A link joins the A token and the B token of a group that end together: the last two. Null and empty texts, and texts whose
tokens are not their bytes, have no tokens. Rows of one id and rows without one are documents of their own. An empty table
gives an empty one; other columns do not pass.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, store
from .tokens import _byte_letters

_SEGMENT = re.compile(r"\s*\S+|\s+")
_PIECE = re.compile("▁*[^▁]*")
_BYTE = re.compile("<0x([0-9A-F]{2})>")
#: kind 0: the documents of a chunk, packed; 1: one of its distinct groups.
CHUNKS = "kind int, chunk long, docs binary, places binary, place int, grp binary, a int, b int, n long, n_docs long"
ALIGNED = "{key} long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_ALIGNERS: dict[tuple[str, str], Aligner] = {}


class Aligner:
    """Cuts texts into groups. ``limit`` bounds the segments, and through them the groups, that are kept."""

    def __init__(self, byte_bpe: str, piece_bpe: str, limit: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b, self.limit = Tokenizer.from_file(byte_bpe), sentencepiece.SentencePieceProcessor(model_file=piece_bpe), limit
        self.a.encode_special_tokens = True
        of_letter = {c: i for i, c in enumerate(_byte_letters())}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab(with_added_tokens=False).items():
            self.bytes_a[i] = bytes(of_letter[c] for c in token)
        pieces = self.b.id_to_piece(list(range(self.b.get_piece_size())))
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) and self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.parted = all(_PIECE.fullmatch(p) and "\n" not in p for p in pieces)
        self.forget()

    @classmethod
    def of(cls, byte_bpe: str, piece_bpe: str) -> Aligner:
        return _ALIGNERS.setdefault((byte_bpe, piece_bpe), None) or _ALIGNERS.update({(byte_bpe, piece_bpe): cls(byte_bpe, piece_bpe)}) or _ALIGNERS[byte_bpe, piece_bpe]

    def forget(self) -> None:
        self.places: dict[str, bytes | None] = {}  # by segment: the numbers of its groups; None if its tokens are not its bytes
        self.written: dict[str, bytes | None] = {}  # by segment: its groups as text
        self.groups: dict[bytes, int] = {}
        self.sizes: list[tuple[int, int, int, int]] = []  # by group: tokens of A and of B, and the last of each

    def cut(self, a: list[int], b: list[int], whole: bytes) -> list[bytes] | None:
        """The groups of these tokens, or None if their bytes are not those of the text."""
        parts_a, parts_b = [self.bytes_a[i] for i in a], [self.bytes_b[i] for i in b]
        if b"".join(parts_a) != whole or b"".join(parts_b) != whole:
            return None
        out, i, j, end_a, end_b, from_a, from_b = [], 0, 0, 0, 0, 0, 0
        while i < len(a) or j < len(b):
            if end_a <= end_b:
                end_a, i = end_a + len(parts_a[i]), i + 1
            else:
                end_b, j = end_b + len(parts_b[j]), j + 1
            if end_a == end_b:
                out.append(b"%s|%s" % (",".join(map(str, a[from_a:i])).encode(), ",".join(map(str, b[from_b:j])).encode()))
                from_a, from_b = i, j
        return out

    def number(self, group: bytes) -> int:
        n = self.groups.get(group)
        if n is None:
            n = self.groups[group] = len(self.sizes)
            a, b = (x.split(b",") for x in group.split(b"|"))
            self.sizes.append((len(a), len(b), int(a[-1]), int(b[-1])))
        return n

    def learn(self, segments: list[str]) -> None:
        """B puts a blank before a text; before a segment that does not begin with one, a line end of known tokens is put."""
        ids_a = [x.ids for x in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        ids_b = self.b.encode([s[1:] if s[0] == " " else "\n" + s for s in segments], num_threads=1)
        for s, a, b in zip(segments, ids_a, ids_b, strict=True):
            groups = self.cut(a, b if s[0] == " " else b[2:], s.encode())
            self.places[s] = None if groups is None else np.array([self.number(g) for g in groups], "<u4").tobytes()
            self.written[s] = None if groups is None else b";".join(groups)

    def whole(self, text: str) -> list[bytes]:
        return self.cut(self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text), b" " + text.encode()) or []

    def align(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """For each text: the numbers of its groups, and the hash of these written out ('' without tokens)."""
        claim("alignment", self.forget)
        cut = [_SEGMENT.findall(" " + t) if t and self.parted else [] for t in texts]
        new = [s for s in set().union(*cut) if s not in self.places]
        if new:
            self.learn(new)
        out = []
        for t, segments in zip(texts, cut, strict=True):
            if not t:
                out.append((b"", ""))
                continue
            places = list(map(self.places.get, segments)) or [None]
            if None in places:
                groups = self.whole(t)
                out.append((np.array([self.number(g) for g in groups], "<u4").tobytes(), hashlib.sha256(b";".join(groups)).hexdigest() if groups else ""))
            else:
                out.append((b"".join(places), hashlib.sha256(b";".join(map(self.written.__getitem__, segments))).hexdigest()))
        return out


def _chunks(docs: DataFrame, byte_bpe: str, piece_bpe: str, size: int) -> DataFrame:
    def run(batches):
        aligner, first, made = Aligner.of(byte_bpe, piece_bpe), TaskContext.get().partitionId() << 32, 0
        ids, known, places, hashes, held = [], [], [], [], 0

        def packed() -> pa.RecordBatch:
            counts = np.array([len(p) // 4 for p in places], np.int64)
            flat, sizes = np.frombuffer(b"".join(places), "<u4"), np.array(aligner.sizes, np.int64).reshape(-1, 4)
            n = np.bincount(flat, minlength=len(sizes))
            held_by = np.zeros(len(sizes), np.int64)
            for p in places:
                held_by[np.unique(np.frombuffer(p, "<u4"))] += 1
            own = np.flatnonzero(n)
            place = np.zeros(len(sizes), "<u4")
            place[own] = np.arange(len(own))
            sums = [np.concatenate([[0], np.cumsum(sizes[flat, k])])[np.concatenate([[0], np.cumsum(counts)])] for k in (0, 1)]
            packed_docs = b"".join([np.array(ids, "<i8").tobytes(), np.array(known, "u1").tobytes(), counts.tobytes(), *(np.diff(s).astype("<i8").tobytes() for s in sums), b"".join(bytes.fromhex(h) or bytes(32) for h in hashes)])
            names = list(aligner.groups)
            squeeze = lambda x: zstandard.compress(x, 1)
            k = len(own)
            columns = ([0] + [1] * k, [first + made] * (k + 1), [squeeze(packed_docs)] + [None] * k, [squeeze(place[flat].tobytes())] + [None] * k, [None, *range(k)], [None, *(names[i] for i in own.tolist())], [None, *sizes[own, 2].tolist()], [None, *sizes[own, 3].tolist()], [len(ids), *n[own].tolist()], [None, *held_by[own].tolist()])
            types = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in CHUNKS.split(", ")])

        for batch in batches:
            keys, texts, at = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
            while at < len(texts):
                upto, some = at, 0
                while upto < len(texts) and some < 1 << 20:
                    some, upto = some + len(texts[upto] or ""), upto + 1
                for k, (p, h) in zip(keys[at:upto], aligner.align(texts[at:upto]), strict=True):
                    ids.append(k or 0), known.append(k is not None), places.append(p), hashes.append(h)
                held, at = held + some, upto
                if held >= size or len(ids) >= 1 << 17:
                    yield packed()
                    made, held = made + 1, 0
                    ids.clear(), known.clear(), places.clear(), hashes.clear()
                    if len(aligner.places) > aligner.limit or len(aligner.sizes) > 2 * aligner.limit:
                        aligner.forget()
        if ids:
            yield packed()
            if len(aligner.places) > aligner.limit:
                aligner.forget()

    return docs.mapInArrow(run, CHUNKS)


def _told(chunk: pa.Table, told: pa.Table, key: str) -> pa.Table:
    """The rows of a chunk's documents, by what is known of its groups."""
    n = chunk.column("n")[0].as_py()
    raw, flat = zstandard.decompress(chunk.column("docs")[0].as_py()), np.frombuffer(zstandard.decompress(chunk.column("places")[0].as_py()), "<u4")
    ids, known, at = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "u1", n, 8 * n).astype(bool), 9 * n
    counts, n_a, n_b = (np.frombuffer(raw, "<i8", n, at + 8 * n * k) for k in range(3))
    hashes = [raw[x : x + 32].hex() if c else "" for x, c in zip(range(at + 24 * n, len(raw), 32), counts.tolist(), strict=True)]
    ends = np.concatenate([[0], np.cumsum(counts)])
    total = [ends]
    for name in ("best", "count"):
        by_place = np.zeros(len(told), np.int64)
        by_place[told.column("place").to_numpy()] = told.column(name).to_numpy()
        total.append(np.concatenate([[0], np.cumsum(by_place[flat])])[ends])
    links, best, count = (pa.array(np.diff(x), pa.int64()) for x in total)
    return pa.table({key: pa.array(ids, pa.int64(), mask=~known), "n_a": n_a, "n_b": n_b, "n_groups": counts, "n_links": links, "n_best": best, "count_sum": count, "groups_sha256": pa.array(hashes, pa.string())})


def links(groups: DataFrame, by: str = "links") -> DataFrame:
    """(a, b, count, best) from distinct groups of chunks: how many links, or documents that hold their groups, have a pair.

    best: no other A id has more with that B id.
    """
    pairs = groups.groupBy("a", "b").agg(F.sum("n" if by == "links" else "n_docs").alias("count"))
    most = pairs.groupBy("b").agg(F.max("count").alias("most"))
    return pairs.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))


def align(docs: DataFrame, byte_bpe: str, piece_bpe: str, *, key: str = "doc_id", text: str = "text", by: str = "links", size: int = 16 << 20) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    ``byte_bpe`` and ``piece_bpe`` are the files of the tokenizers; ``by`` counts a pair's "links", or the "documents" that hold
    each of its groups; ``size`` is the text of a chunk, in characters, but for a longer document.
    """
    if by not in ("links", "documents"):
        raise ValueError("by is links or documents")
    made = store(_chunks(docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")), byte_bpe, piece_bpe, size), "chunks")
    groups = made.where("kind = 1").select("chunk", "place", "grp", "a", "b", "n", "n_docs")
    distinct = store(groups.groupBy("grp").agg(F.min("a").alias("a"), F.min("b").alias("b"), F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs")), "groups")
    known = distinct.select("grp", "a", "b").join(links(distinct, by), ["a", "b"]).select("grp", "count", "best")
    told = groups.select("chunk", "place", "grp").join(known, "grp").select(F.col("chunk").alias("of"), "place", "count", "best")
    return made.where("kind = 0").select("chunk", "docs", "places", "n").groupBy("chunk").cogroup(told.groupBy("of")).applyInArrow(lambda c, t: _told(c, t, key), ALIGNED.format(key=key))
