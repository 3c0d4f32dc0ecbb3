"""Encoding of a corpus with a public byte-level BPE vocabulary.

Texts are cut wherever a rolling hash of the last few characters hits: the cuts
follow content, so passages that documents share give the same chunks, which a
worker encodes once, for all documents it sees. A cut may fall within what the
vocabulary's pattern takes as one piece, and the tokens on both sides of it are then
wrong. Such a join is repaired by encoding again what lies around the cut, token by
token outwards to the next place on either side at which the pattern is bound to part
the text whatever surrounds it, over as many chunks as that takes; from there on the
chunk's own tokens agree with the encoding of the whole text exactly.
"""

from __future__ import annotations

import base64
import os
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabularies, and the vocabulary; both are parameters of :func:`encoded`.
FOLDER, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k"
#: Characters that the rolling hash covers, the mean number of characters between cuts, and entries of a worker's cache.
WINDOW, SPACING, CACHE = 6, 32, 200_000
#: Chunks and seams of more characters are not kept in the cache.
KEPT = 256
#: Bytes of text that are worked on at a time.
SLICE = 4_000_000
#: Fixed value: the pattern by which the vocabulary parts a text into pieces.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENCODERS: dict = {}  # one for each worker process and vocabulary


class Encoder:
    """A vocabulary, and the chunks and seams it has encoded so far."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encode = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._bytes = {i: len(token) for token, i in ranks.items()}
        self._chunks: dict[str, tuple[bytes, int, int]] = {}
        self._seams: dict[str, bytes] = {}

    def _chunk(self, text: str, head: int, tail: int) -> tuple[bytes, int, int]:
        """Ids of a chunk as little-endian int32, the bytes of ids of its first ``head``
        characters, and where those of its last ``tail`` characters begin."""
        ids = self._encode(text)
        left, first = len(text[:head].encode("utf-8")), 0
        while left > 0:
            left -= self._bytes[ids[first]]
            first += 1
        right, last = len(text[len(text) - tail :].encode("utf-8")) if tail else 0, len(ids)
        while right > 0:
            last -= 1
            right -= self._bytes[ids[last]]
        if left or right:
            raise AssertionError("a chunk's tokens cross a place where the pattern parts it")
        got = array("i", ids).tobytes(), 4 * first, 4 * last
        if len(text) <= KEPT:
            if len(self._chunks) >= CACHE:
                self._chunks.clear()
            self._chunks[text] = got
        return got

    def _seam(self, text: str) -> bytes:
        ids = array("i", self._encode(text)).tobytes()
        if len(text) <= KEPT:
            if len(self._seams) >= CACHE:
                self._seams.clear()
            self._seams[text] = ids
        return ids

    def texts(self, texts: list[str]) -> tuple[bytes, np.ndarray]:
        """Ids of whole texts, one after the other, and how many each has."""
        joined = "".join(texts)
        ends = np.cumsum([len(t) for t in texts])
        cuts, left, right, before, after = (x.tolist() for x in cut_places(joined, ends))
        chunks, seams = self._chunks, self._seams
        parts: list[bytes] = []
        stops: list[int] = []
        for k in range(len(cuts) - 1):
            a, b, first, last = cuts[k], cuts[k + 1], right[k], left[k + 1]
            if first > last:  # no bound place within: part of the seam before it
                continue
            text = joined[a:b]
            got = chunks.get(text)
            if got is None:  # with the edges the chunk has by its own characters, as it may stand between others elsewhere
                inner = after[k] < b
                got = self._chunk(text, after[k] - a if inner else b - a, b - before[k + 1] if inner else b - a)
            ids, head, tail = got
            parts.append(ids[head if first > a else 0 : tail if last < b else None])
            stops.append(last)
            if last < b:
                text = joined[last : right[k + 1]]
                parts.append(seams.get(text) or self._seam(text))
                stops.append(right[k + 1])
        sizes = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])
        at = np.concatenate([[0], sizes[np.searchsorted(np.array(stops, np.int64), ends, side="right")]])
        return b"".join(parts), np.diff(at) // 4

    def joins(self, text: str) -> tuple[int, int, list[str]]:
        """Joins of the chunks of a text that were encoded again, those of them that this changed, and the chunks."""
        cuts, left, right, _, _ = (x.tolist() for x in cut_places(text, np.array([len(text)])))
        seams = sorted({(a, b) for a, b in zip(left, right) if a < b})
        repaired = 0
        for a, b in seams:
            within = [a, *(c for c in cuts if a < c < b), b]
            repaired += self._encode(text[a:b]) != [i for x, y in pairwise(within) for i in self._encode(text[x:y])]
        return len(seams), repaired, [text[a:b] for a, b in pairwise(cuts)]

    @staticmethod
    def of(path: str) -> Encoder:
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        return _ENCODERS[path]


_SPACE, _LETTER, _NUMBER, _OTHER, _UNKNOWN = range(5)
_KNOWN = 0x33480  # code points from here on are left to the vocabulary alone


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """What the pattern takes each code point for; those that another edition of Unicode may take for something else are unknown."""
    of = {"L": _LETTER, "N": _NUMBER, "C": _UNKNOWN}
    table = np.array([of.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(_KNOWN)], np.uint8)
    table[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
    return table


def _bound(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points, and which places are bound to part the text (never the first and last).

    Every piece but white space holds one class of characters, after at most one blank;
    a contraction takes letters after an apostrophe. So between a character that is no
    white space and one of another class a piece ends whatever stands before and after,
    unless the first is an apostrophe.
    """
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = np.full(len(cp), _UNKNOWN, np.uint8)
    low = cp < _KNOWN
    kind[low] = _classes()[cp[low]]
    safe = np.zeros(len(cp) + 1, bool)
    if len(cp) > 1:
        a, b = kind[:-1], kind[1:]
        safe[1:-1] = (a != _SPACE) & ((b == _SPACE) | (a != b) & (a != _UNKNOWN) & (b != _UNKNOWN) & (cp[:-1] != 39))
    return cp, safe


def cut_places(joined: str, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Cuts of texts that lie one after the other (the last characters of each before
    ``ends``), from 0 to the end, and for each the bound places next to it: on the left and
    on the right, itself if it is one, and strictly before and after it. No hash covers
    characters of two texts."""
    cp, safe = _bound(joined)
    fixed = np.unique(np.concatenate([[0], ends]))
    safe[fixed] = True
    hits = np.zeros(0, np.int64)
    if len(cp) >= WINDOW:
        rolled = np.zeros(len(cp) - WINDOW + 1, np.uint64)
        for i in range(WINDOW):  # the hash of each window, at its last character
            rolled = rolled * np.uint64(1_099_511_628_211) + cp[i : len(cp) - WINDOW + 1 + i]
        hits = np.flatnonzero((rolled >> np.uint64(20)) % np.uint64(SPACING) == 0) + WINDOW
        hits = hits[hits - WINDOW >= fixed[np.searchsorted(fixed, hits, side="left") - 1]]
    cuts = np.unique(np.concatenate([fixed, hits]))
    places = np.flatnonzero(safe)
    below, above = np.searchsorted(places, cuts, side="left"), np.searchsorted(places, cuts, side="right")
    return cuts, places[above - 1], places[below], places[below - 1], places[np.minimum(above, len(places) - 1)]


def encoded(documents: DataFrame, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, ids`` of each document, without special tokens; their spellings in
    a text are ordinary text. Null and empty texts give an empty list; texts of any
    length are encoded whole; repeated rows give repeated results."""
    path = os.path.join(folder, f"{vocabulary}.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in batches:
            for rows in _slices(batch):
                ids, sizes = encoder.texts([t or "" for t in rows.column("text").to_pylist()])
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(ids, np.int32)))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), lists], names=["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def reuse(documents: DataFrame, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """``lang, documents, chunks, distinct_chunks, joins, repaired`` of all texts: chunks
    that documents share need one encoding; of the joins encoded again, ``repaired``
    came out other than the chunks alone. Texts that are null count as empty."""
    path = os.path.join(folder, f"{vocabulary}.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in batches:
            lang, chunk, n, rest = [], [], [], {}
            for code, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                joins, repaired, chunks = encoder.joins(text or "")
                d, j, r = rest.get(code, (0, 0, 0))
                rest[code] = d + 1, j + joins, r + repaired
                lang += [code] * len(chunks)
                chunk += chunks
            n = [(0, 0, 0)] * len(lang) + list(rest.values())
            columns = [pa.array([*lang, *rest], pa.string()), pa.array([*chunk, *[None] * len(rest)], pa.string()), *(pa.array([x[i] for x in n], pa.int64()) for i in range(3))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "chunk", "documents", "joins", "repaired"])

    counted = documents.select("lang", "text").mapInArrow(run, "lang string, chunk string, documents bigint, joins bigint, repaired bigint")
    key = F.when(F.col("chunk").isNotNull(), F.xxhash64("chunk"))
    sums = [F.sum(c).alias(c) for c in ("documents", "joins", "repaired")]
    each = counted.groupBy("lang", key.alias("key")).agg(F.count("chunk").alias("n"), *sums)
    return each.groupBy("lang").agg(F.sum("documents").alias("documents"), F.sum("n").alias("chunks"), F.count("key").alias("distinct_chunks"), F.sum("joins").alias("joins"), F.sum("repaired").alias("repaired"))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of a few million bytes of text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(batch):
        done = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, done + SLICE, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
