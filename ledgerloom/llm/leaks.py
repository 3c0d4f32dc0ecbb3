"""Evaluation passages that leaked into a corpus, by an FM-index of each shard.

A shard of pages is brought into reading order, words are normalised, and an
FM-index is built over the words: suffix array by prefix doubling, its
Burrows-Wheeler transform in a wavelet matrix, and sampled suffix positions.
Short phrases of the evaluation items are found by backward search, all at once,
and located; occurrences near one diagonal form spans, and a span is accepted when
the words around it agree, apart from misread letters, over the run asked for.
Accepted runs are carried back to the page's text and merged to the stretches to
remove. Items come in blocks of bounded size; all blocks search the one index.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.pages import Article, articles
from ledgerloom.llm.sentences import script_of

#: Words (characters in scripts without spaces) of a run that makes a leak.
RUN_WORDS, RUN_CHARACTERS = 20, 60
#: Words (characters) of the phrases searched, and of a span that the phrases found must cover to be looked at.
PHRASE_WORDS, PHRASE_CHARACTERS = 3, 8
COVER_WORDS, COVER_CHARACTERS = 8, 24
#: How far a span may drift from its diagonal between phrases (words lost or split by misreading).
DRIFT = 3
#: Tokens of one index; every SAMPLE-th suffix position is kept.
SHARD_TOKENS, SAMPLE = 1_000_000, 4
#: Characters of evaluation items in one block: what a worker holds of them at a time, with the longest item.
ITEM_BLOCK = 4_000_000
#: Pairs of a phrase found and a place in an item that are put in order at a time (a page's pairs stay together).
PAIRS = 2_000_000
#: Languages whose items are compared by characters.
UNSPACED = ("zh", "ja", "th")

_HYPHEN = re.compile(r"[-­=¬][ \xa0]?\n")
_JUNK = re.compile(r"[^\w\s̀-ًͯ-ٰٟऀ-ॣัิ-ฺ็-๎]|_")
_CHARACTERS = re.compile(r"[0-9a-zÀ-ɏ]+|\S")
_UNSPACED_LETTER = re.compile("[฀-๿぀-ヿ㐀-鿿]")
_SPACED_LETTER = re.compile("[A-Za-zÀ-ɏͰ-ӿ֐-ۿऀ-ॿ]")


def words(text: str, unspaced: bool) -> list[str]:
    """Normalised words of a text: hyphen breaks joined, case and punctuation
    removed; single characters in scripts without spaces."""
    text = _HYPHEN.sub("", text).casefold()
    if unspaced:
        return _CHARACTERS.findall(_JUNK.sub("", text))
    return [w for w in [t if t.isalnum() else _JUNK.sub("", t) for t in text.split()] if w]


def word_places(text: str, unspaced: bool) -> list[tuple[int, int]]:
    """Where in ``text`` each of its :func:`words` begins and ends."""
    places: list[int] = []
    at = 0
    for m in _HYPHEN.finditer(text):
        places += range(at, m.start())
        at = m.end()
    places += range(at, len(text))
    if not unspaced:
        out, k = [], 0
        joined = _HYPHEN.sub("", text)
        for m in re.finditer(r"\S+", joined):
            t = m[0].casefold()
            if t.isalnum() or _JUNK.sub("", t):
                out.append((places[m.start()], places[m.end() - 1] + 1))
        return out
    folded, origin = [], []
    for k in places:
        for c in text[k].casefold():
            if not _JUNK.match(c):
                folded.append(c)
                origin.append(k)
    return [(origin[m.start()], origin[m.end() - 1] + 1) for m in _CHARACTERS.finditer("".join(folded))]


def forms(text: str) -> list[bool]:
    """The forms a text is searched in: by words (False) where it has letters of scripts
    with spaces, by characters (True) where it has some of scripts without."""
    return [kind for kind, has in ((False, _SPACED_LETTER), (True, _UNSPACED_LETTER)) if has.search(text)]


# FM-index ----------------------------------------------------------------------


def suffix_array(tokens: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``tokens``; tokens at ``breaks`` (a mask) are each a
    symbol of their own, smaller than all others, in text order."""
    n = len(tokens)
    m = int(breaks.sum())
    rank = tokens.astype(np.int64) + m
    rank[breaks] = np.arange(m)
    order = np.argsort(rank, kind="stable")
    sorted_rank = rank[order]
    new = np.ones(n, bool)
    new[1:] = sorted_rank[1:] != sorted_rank[:-1]
    head = np.flatnonzero(new)
    place = head[np.cumsum(new) - 1]  # rank of a suffix: where its group begins
    rank = np.empty(n + 1, np.int64)
    rank[order] = place
    rank[n] = -1
    step = 1
    single = np.ones(n, bool)
    single[:-1] &= new[1:]
    single &= new
    open_rows = np.flatnonzero(~single)
    while len(open_rows):
        at = order[open_rows]
        key = rank[at] * (n + 2) + rank[np.minimum(at + step, n)] + 1
        turn = np.argsort(key, kind="stable")
        at, key = at[turn], key[turn]
        order[open_rows] = at
        first = np.ones(len(at), bool)
        first[1:] = key[1:] != key[:-1]
        begins = np.flatnonzero(first)
        rank[at] = open_rows[begins[np.cumsum(first) - 1]]
        lone = first.copy()
        lone[:-1] &= first[1:]
        open_rows = open_rows[~lone]
        step *= 2
    return order


class WaveletMatrix:
    """Rank and access over small symbols, one bit plane after the other."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for b in range(bits - 1, -1, -1):
            bit = (symbols >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(len(symbols) - int(bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def ranks(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each symbol before ``lo`` and before ``hi``."""
        base = np.zeros(len(symbol), np.int64)
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros = self.ones[level], self.zeros[level]
            up = ((symbol >> b) & 1).astype(bool)
            ob, ol, oh = ones[base], ones[lo], ones[hi]
            base = np.where(up, zeros + ob, base - ob)
            lo = np.where(up, zeros + ol, lo - ol)
            hi = np.where(up, zeros + oh, hi - oh)
        return lo - base, hi - base

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol at each place, and its occurrences before the place."""
        base = np.zeros(len(at), np.int64)
        symbol = np.zeros(len(at), np.int64)
        for level in range(self.bits):
            ones, zeros = self.ones[level], self.zeros[level]
            o = ones[at]
            up = ones[at + 1] > o
            ob = ones[base]
            symbol = symbol * 2 + up
            base = np.where(up, zeros + ob, base - ob)
            at = np.where(up, zeros + o, at - o)
        return symbol, at - base


class FMIndex:
    """Full-text index over tokens 1..size-1; tokens 0 part the text, end it, and are never searched."""

    def __init__(self, tokens: np.ndarray, size: int, sample: int = SAMPLE):
        n = len(tokens)
        breaks = tokens == 0
        order = suffix_array(tokens, breaks)
        before = np.where(order > 0, tokens[order - 1], 0)
        self.n = n
        self.wavelet = WaveletMatrix(before, max(1, int(size - 1).bit_length()))
        counts = np.bincount(tokens, minlength=size)
        self.first = np.concatenate([[0], np.cumsum(counts)])[:-1]
        kept = (order % sample == 0) | (before == 0)
        self.kept = np.concatenate([[0], np.cumsum(kept, dtype=np.int64)])
        self.positions = order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of phrases (rows of equal length) by backward search."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[live, k]
            a, b = self.wavelet.ranks(symbol, lo[live], hi[live])
            lo[live], hi[live] = self.first[symbol] + a, self.first[symbol] + b
            live = live[lo[live] < hi[live]]
        dead = np.ones(len(phrases), bool)
        dead[live] = False
        hi[dead] = lo[dead]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by steps back to a sampled one."""
        out = np.zeros(len(rows), np.int64)
        left = np.arange(len(rows))
        at, steps = rows.copy(), 0
        while len(left):
            done = self.kept[at + 1] > self.kept[at]
            out[left[done]] = self.positions[self.kept[at[done]]] + steps
            left, at = left[~done], at[~done]
            symbol, rank = self.wavelet.access(at)
            at = self.first[symbol] + rank
            steps += 1
        return out


# Items ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Items:
    """A block of evaluation items as numbers of words, and their phrases."""

    ids: list[int]
    texts: list[np.ndarray]  # numbers of words, from 1
    unspaced: list[bool]
    vocabulary: list[str]
    phrases: dict[bool, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # unique phrases; start of their places; item and place

    def words(self, i: int) -> list[str]:
        return [self.vocabulary[k - 1] for k in self.texts[i].tolist()]


def prepared(rows: list[tuple[int, str | None, str | None]]) -> Items:
    """Items from (item_id, lang, text); rows without id or text are left out."""
    rows = sorted({r for r in rows if r[2] and r[0] is not None}, key=lambda r: (r[0], str(r[1]), r[2]))
    kinds = [(r[1] or "").casefold() in UNSPACED or script_of(r[2]) in UNSPACED for r in rows]
    number: dict[str, int] = {}
    texts = [np.array([number.setdefault(w, len(number) + 1) for w in words(r[2], k)], np.int32) for r, k in zip(rows, kinds)]
    phrases = {}
    for kind, q in ((False, PHRASE_WORDS), (True, PHRASE_CHARACTERS)):
        mine = [i for i, (t, k) in enumerate(zip(texts, kinds)) if k == kind and len(t) >= q]
        if mine:
            seqs = np.concatenate([np.lib.stride_tricks.sliding_window_view(texts[i], q) for i in mine])
            item = np.concatenate([np.full(len(texts[i]) - q + 1, i) for i in mine])
            place = np.concatenate([np.arange(len(texts[i]) - q + 1) for i in mine])
            unique, back = np.unique(seqs, axis=0, return_inverse=True)
            order = np.argsort(back.ravel(), kind="stable")
            phrases[kind] = (unique, np.searchsorted(back.ravel()[order], np.arange(len(unique) + 1)), item[order], place[order])
    return Items([r[0] for r in rows], texts, kinds, list(number), phrases)


# Groups of letters that scans take for one letter.
_GROUPS = (("cl", "d"), ("rn", "m"), ("in", "m"), ("ni", "m"), ("vv", "w"), ("li", "h"), ("fi", "n"), ("ii", "u"))


@lru_cache(maxsize=200_000)
def _ungrouped(word: str) -> str:
    for group, letter in _GROUPS:
        if group in word:
            word = word.replace(group, letter)
    return word


@lru_cache(maxsize=200_000)
def alike(a: str, b: str) -> bool:
    """Whether two words agree apart from misread letters."""
    if a == b:
        return True
    if _close(a, b):
        return True
    x, y = _ungrouped(a), _ungrouped(b)
    return (x is not a or y is not b) and _close(x, y)


def _close(a: str, b: str) -> bool:
    if a == b:
        return True
    n, m = len(a), len(b)
    most = 1 if max(n, m) <= 4 else 2 if max(n, m) <= 8 else 3
    if abs(n - m) > most or max(n, m) < 2:
        return False
    x, y = set(a), set(b)
    if len(x - y) > most or len(y - x) > most:  # each letter that the other lacks takes a step
        return False
    row = list(range(m + 1))
    for i in range(1, n + 1):
        left, row[0] = row[0], i
        for j in range(1, m + 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (a[i - 1] != b[j - 1]))
        if min(row) > most:
            return False
    return row[m] <= most


def _short(word: str) -> bool:
    return len(word) <= 3 and not any(c.isdigit() for c in word)


def _walk(a: list[str], b: list[str], i: int, j: int, step: int) -> tuple[int, int]:
    """How many words of ``a`` from ``i`` on in direction ``step`` agree with how many of ``b`` from ``j`` on."""
    x, y = i, j
    while 0 <= i < len(a) and 0 <= j < len(b):
        if alike(a[i], b[j]):
            i, j = i + step, j + step
        elif 0 <= j + step < len(b) and alike(a[i], b[j] + b[j + step] if step > 0 else b[j + step] + b[j]):
            i, j = i + step, j + 2 * step  # a word split in two
        elif 0 <= i + step < len(a) and alike(a[i] + a[i + step] if step > 0 else a[i + step] + a[i], b[j]):
            i, j = i + 2 * step, j + step  # two words run together
        elif _short(a[i]) and _short(b[j]) and all(
            0 <= i + k * step < len(a) and 0 <= j + k * step < len(b) and alike(a[i + k * step], b[j + k * step]) for k in (1, 2, 3)
        ):
            i, j = i + step, j + step  # a short word misread altogether
        else:
            break
    return abs(i - x), abs(j - y)


def _walk_characters(a: list[str], b: list[str], i: int, j: int, step: int) -> tuple[int, int]:
    """:func:`_walk` by characters: a single misread one counts if three agree behind it."""
    start, first = i, j
    while 0 <= i < len(a) and 0 <= j < len(b):
        if a[i] == b[j]:
            i, j = i + step, j + step
            continue
        for di, dj in ((1, 1), (0, 1), (1, 0)):  # misread, put in, lost
            x, y = i + di * step, j + dj * step
            if all(0 <= x + k * step < len(a) and 0 <= y + k * step < len(b) and a[x + k * step] == b[y + k * step] for k in range(3)):
                i, j = x, y
                break
        else:
            break
    return abs(i - start), abs(j - first)


def _agrees(item: list[str], page: list[str], i: int, j: int, unspaced: bool) -> tuple[int, int, int, int, bool]:
    """The run of ``item`` words around the place (i, j), that of the page, and whether it is long enough."""
    walk = _walk_characters if unspaced else _walk
    left, right = walk(item, page, i - 1, j - 1, -1), walk(item, page, i, j, 1)
    a, b = i - left[0], i + right[0]
    size = sum(map(len, item[a:b])) if unspaced else b - a
    return a, b, j - left[1], j + right[1], size >= (RUN_CHARACTERS if unspaced else RUN_WORDS)


def _order(*keys: np.ndarray) -> np.ndarray:
    """Order by keys, the first first; by one number for all where they fit in one."""
    code, size = np.zeros(len(keys[0]), np.int64), 1
    for k in keys:
        low = int(k.min(initial=0))
        span = int(k.max(initial=0)) - low + 1
        size *= span
        if size >= 1 << 62:
            return np.lexsort(keys[::-1])
        code = code * span + (k - low)
    return np.argsort(code, kind="stable")


def _near(page: np.ndarray, at: np.ndarray, it: np.ndarray, pl: np.ndarray, q: int, cover: int, run: int) -> tuple[np.ndarray, ...]:
    """Of phrases found at ``at`` of a page and place ``pl`` of an item, those in spans that
    cover enough, in order, with the numbers of their spans. Phrases farther apart than a
    run is long are of two spans."""
    order = _order(page, it, at - pl)
    page, at, it, pl = page[order], at[order], it[order], pl[order]
    new = np.ones(len(page), bool)
    new[1:] = (page[1:] != page[:-1]) | (it[1:] != it[:-1]) | (np.diff(at - pl) > DRIFT)
    span = np.cumsum(new) - 1
    order = _order(span, pl)
    page, at, it, pl, span = page[order], at[order], it[order], pl[order], span[order]
    gap = np.diff(pl, prepend=0)
    apart = (np.diff(span, prepend=-1) != 0) | (gap > run)
    gap[apart] = q
    span = np.cumsum(apart) - 1
    keep = np.bincount(span, np.minimum(gap, q))[span] >= cover
    return page[keep], at[keep], it[keep], pl[keep], span[keep]


def find(pages: list[list[str]], kinds: list[bool], blocks: Callable[[], Iterable[Items]]) -> list[tuple[int, int, int, int]]:
    """Runs (page, item id, first word, word after the last) of leaks among the pages of one
    shard, each page in the form ``kinds`` says. ``blocks`` gives the blocks of items, one
    after the other, each time it is called."""
    present: set[str] = set()
    for p in pages:
        present.update(p)
    symbols: dict[str, int] = {}
    for block in blocks():
        for w in present.intersection(block.vocabulary):
            symbols.setdefault(w, len(symbols) + 1)
    sizes = np.array([len(p) + 1 for p in pages], np.int64)
    starts = np.cumsum(sizes) - sizes
    get = symbols.get
    tokens = np.zeros(int(sizes.sum()), np.int64)
    inside = np.ones(len(tokens), bool)
    inside[starts + sizes - 1] = False
    tokens[inside] = [get(w, 0) for p in pages for w in p]
    if not len(tokens) or not tokens.any():
        return []
    index = FMIndex(tokens, len(symbols) + 1)
    form = np.array(kinds, bool)
    out: set[tuple[int, int, int, int]] = set()
    for block in blocks():
        symbol = np.array([0, *(get(w, 0) for w in block.vocabulary)], np.int64)
        for kind, (phrases, first, item, place) in block.phrases.items():
            q, cover, run = (PHRASE_CHARACTERS, COVER_CHARACTERS, RUN_CHARACTERS) if kind else (PHRASE_WORDS, COVER_WORDS, RUN_WORDS)
            mapped = symbol[phrases]
            known = np.flatnonzero((mapped > 0).all(axis=1))
            lo, hi = index.search(mapped[known])
            hit = np.flatnonzero(hi > lo)
            if not len(hit):
                continue
            count = (hi - lo)[hit]
            phrase = np.repeat(known[hit], count)
            at = index.locate(np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo[hit], count))
            page = np.searchsorted(starts, at, side="right") - 1
            order = np.argsort(page, kind="stable")
            order = order[form[page[order]] == kind]
            page, at, phrase = page[order], at[order] - starts[page[order]], phrase[order]
            each = first[phrase + 1] - first[phrase]  # a phrase may stand in several items, or several times in one
            for a, b in _stretches(page, each):
                n = each[a:b]
                where = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[phrase[a:b]], n)
                near = _near(np.repeat(page[a:b], n), np.repeat(at[a:b], n), item[where], place[where], q, cover, run)
                out.update(_runs(pages, block, kind, near))
    return sorted(out)


def _stretches(page: np.ndarray, each: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of whole pages with about :data:`PAIRS` pairs at most (more only within one page)."""
    heads = np.flatnonzero(np.diff(page, prepend=-1))
    before = np.concatenate([[0], np.cumsum(each)])
    a = 0
    while a < len(page):
        fits = heads[(heads > a) & (before[heads] <= before[a] + PAIRS)] if before[-1] - before[a] > PAIRS else heads[:0]
        if before[-1] - before[a] <= PAIRS:
            b = len(page)
        elif len(fits):
            b = int(fits[-1])
        else:
            b = int(next(iter(heads[heads > a]), len(page)))
        yield a, b
        a = b


def _runs(pages: list[list[str]], block: Items, kind: bool, near: tuple[np.ndarray, ...]) -> Iterator[tuple[int, int, int, int]]:
    """The runs around phrases found that are long enough."""
    last, item = -1, []
    seen: tuple[int, int, int] | None = None
    for d, c, i, p, s in zip(*(x.tolist() for x in near)):
        if seen is not None and seen[0] == s and seen[1] == c - p and p < seen[2]:
            continue  # within the run that was looked at before
        if i != last:
            last, item = i, block.words(i)
        _, b, first, stop, enough = _agrees(item, pages[d], p, c, kind)
        seen = (s, c - p, b)
        if enough:
            yield d, block.ids[i], first, stop


def _stops(text: str, page: list[Article], places: list[tuple[int, int]], runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches of the page's text that runs of its words take, merged: only what holds
    neither letter nor digit may lie within one besides the words."""
    starts, at = [], 0
    for a in page:
        starts.append(at)
        at += len(a.text) + 1
    bounds = np.array(starts)

    def on_page(k: int) -> int:
        i = int(np.searchsorted(bounds, k, side="right")) - 1
        return page[i].position(k - starts[i] + 1) - 1

    out: list[list[int]] = []
    taken = sorted({w for first, stop in runs for w in range(first, stop)})
    pieces = []
    for w in taken:
        a, b = places[w]
        pieces.append([on_page(a), on_page(a) + 1])
        for k in range(a + 1, b):  # a word broken at a line end lies in two places
            x = on_page(k) if k < b else 0
            if x == pieces[-1][1]:
                pieces[-1][1] = x + 1
            else:
                pieces.append([x, x + 1])
    for a, b in sorted(pieces):
        if out and (a <= out[-1][1] or not any(map(str.isalnum, text[out[-1][1] : a]))):
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


SCHEMA = "doc_id bigint, item_id bigint, spans array<struct<start:int,stop:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def leaked_runs(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, spans`` of each document that holds a run of an item: the stretches
    [start, stop) of its text, in code points, that runs of the item take. A null ``item_id``
    has those of all items together, merged.

    Items are broadcast in blocks of bounded size; each shard of documents is indexed
    once and searched by all blocks. A page in scripts with and without spaces is
    searched in both forms. Pages without text have no leaks; an item without text leaks
    nowhere; a passage shared by items is reported for each; a repeated document gives
    its rows again, an item listed twice does not.
    """
    spark = documents.sparkSession
    rows = items.select("item_id", "lang", "text").filter("item_id is not null and text is not null and text <> ''")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // ITEM_BLOCK))
    block = lambda b: rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b)
    shared = [spark.sparkContext.broadcast(prepared([tuple(r) for r in block(b).collect()])) for b in range(n)]  # a block of bounded size at a time

    def blocks() -> Iterator[Items]:
        for one in shared:
            yield one.value
            if len(shared) > 1:
                vars(one).pop("_value", None)  # read again when it is needed again

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[int, str, list[Article]]] = []
        pages: list[list[str]] = []
        kinds: list[bool] = []
        owner: list[int] = []
        size = 0

        def result() -> pa.RecordBatch:
            runs: dict[int, list[tuple[int, int, int, int]]] = {}
            for entry, item, a, b in find(pages, kinds, blocks):
                runs.setdefault(owner[entry], []).append((entry, item, a, b))
            ids, items_, spans = [], [], []
            for k, mine in runs.items():
                doc_id, text, page = waiting[k]
                joined = "\n".join(a.text for a in page)
                places = {e: word_places(joined, kinds[e]) for e in {r[0] for r in mine}}
                for item in [*sorted({r[1] for r in mine}), None]:
                    stretches = [s for e in places for s in _stops(text, page, places[e], [(r[2], r[3]) for r in mine if r[0] == e and item in (r[1], None)])]
                    ids.append(doc_id), items_.append(item)
                    spans.append([{"start": a, "stop": b} for a, b in _united(stretches)])
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(items_, pa.int64()), pa.array(spans, _SPANS)], names=["doc_id", "item_id", "spans"])

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for doc_id, text, page in zip(batch.column("doc_id").to_pylist(), texts, articles(batch.column("text"), batch.column("lines")), strict=True):
                joined = "\n".join(a.text for a in page)
                for kind in forms(joined):
                    owner.append(len(waiting))
                    kinds.append(kind)
                    pages.append(words(joined, kind))
                    size += len(pages[-1])
                waiting.append((doc_id, text, page))
                if size >= SHARD_TOKENS:
                    yield result()
                    waiting, pages, kinds, owner, size = [], [], [], [], 0
        if waiting:
            yield result()

    return documents.select("doc_id", "text", "lines").mapInArrow(run, SCHEMA)


def _united(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches in order, with those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(stretches):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id`` of :func:`leaked_runs`."""
    return leaked_runs(documents, items).filter("item_id is not null").select("doc_id", "item_id")


def removal_spans(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, start_pos, end_pos``: the stretches of each document's text to remove, over all items."""
    merged = leaked_runs(documents, items).filter("item_id is null").select("doc_id", F.explode("spans").alias("s"))
    return merged.select("doc_id", F.col("s.start").alias("start_pos"), F.col("s.stop").alias("end_pos"))
