"""Reading order of scanned pages: columns, headlines, adverts and articles from line boxes."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: In units of the page's usual line height: a gap between line starts that parts columns, the height of a
#: headline, the most height of an advert, and how far an advert is set in.
COLUMN_GAP, HEADLINE, ADVERT, INSET = 6.0, 1.5, 0.95, 0.9


@dataclass(slots=True)
class Article:
    """Body lines of one article in reading order, joined by line breaks."""

    text: str
    offsets: list[int]  # of each line in ``text``
    starts: list[int]  # of each line in the page's text

    def position(self, at: int) -> int:
        """Place in the page's text of the end of the first ``at`` characters."""
        k = bisect_right(self.offsets, at - 1) - 1
        return self.starts[k] + at - self.offsets[k]


def _columns(doc: np.ndarray, x: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Number of the column of each line within its page."""
    order = np.lexsort((x, doc))
    d, s = doc[order], x[order]
    new = np.ones(len(order), bool)
    new[1:] = (d[1:] != d[:-1]) | (np.diff(s) > COLUMN_GAP * unit[order][1:])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _medians(doc: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((values, doc))
    counts = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    out = np.zeros(n)
    has = counts > 0
    out[has] = values[order][(first + counts // 2)[has]]
    return out


def articles(texts: pa.Array, lines: pa.Array) -> list[list[Article]]:
    """Articles of each page of a batch.

    ``lines`` holds the boxes (x, y, w, h) of the lines of each text. A page whose
    boxes are missing or do not match its lines is one article in text order.
    Null, empty and blank texts have no articles. A headline ends an article; an
    article runs on from one column into the next.
    """
    n = len(texts)
    if isinstance(lines, pa.ChunkedArray):
        lines = lines.combine_chunks()
    sizes = np.diff(lines.offsets.to_numpy()) if len(lines) else np.zeros(0, np.int64)
    sizes = np.where(lines.is_null().to_numpy(zero_copy_only=False), 0, sizes)
    box = lines.flatten()
    doc = np.repeat(np.arange(n), sizes)
    field = lambda name: np.nan_to_num(box.field(name).to_numpy(zero_copy_only=False)).astype(np.int64)
    x, y, h = field("x"), field("y"), field("h")
    if len(doc):
        unit = np.maximum(_medians(doc, h, n), 1)[doc]
        column = _columns(doc, x, unit)
        edge = np.full(column.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(edge, column, x)
        headline = h > HEADLINE * unit
        advert = (x - edge[column] > INSET * unit) & (h < ADVERT * unit)
        order = np.lexsort((np.arange(len(doc)), y, column, doc))
        kind = np.where(headline, 1, np.where(advert, 2, 0))
    first = np.concatenate([[0], np.cumsum(sizes)])
    out: list[list[Article]] = []
    for i, text in enumerate(texts.to_pylist()):
        if not text or text.isspace():
            out.append([])
            continue
        rows = text.split("\n")
        starts, at = [], 0
        for r in rows:
            starts.append(at)
            at += len(r) + 1
        a, b = first[i], first[i + 1]
        if b - a != len(rows):
            out.append([Article(text, starts, starts)])
            continue
        found, mine = [], []
        for k in order[a:b].tolist():
            if kind[k] == 0:
                mine.append(k - a)
            elif kind[k] == 1 and mine:
                found.append(mine)
                mine = []
        if mine:
            found.append(mine)
        page = []
        for group in found:
            parts = [rows[k] for k in group]
            offsets, at = [], 0
            for p in parts:
                offsets.append(at)
                at += len(p) + 1
            page.append(Article("\n".join(parts), offsets, [starts[k] for k in group]))
        out.append(page)
    return out
