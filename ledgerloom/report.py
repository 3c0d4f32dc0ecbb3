"""Small result frames as a stable JSON report, and numbers as text."""

from __future__ import annotations

import json
from collections.abc import Mapping
from datetime import date, datetime
from decimal import ROUND_HALF_EVEN, Decimal
from typing import Any

from pyspark.sql import DataFrame

#: Most rows a report takes of one frame; a larger frame belongs into a table.
MAX_ROWS = 10_000


def _cell(value: Any) -> Any:
    if isinstance(value, Decimal):  # exact, without exponent or trailing zeros
        text = f"{value:f}"
        return text.rstrip("0").rstrip(".") if "." in text else text
    if isinstance(value, datetime):
        return value.strftime("%Y-%m-%dT%H:%M:%S.%f").rstrip("0").rstrip(".") + "Z"
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, Mapping):
        return {str(k): _cell(v) for k, v in sorted(value.items())}
    if isinstance(value, (list, tuple)):
        return [_cell(v) for v in value]
    return value


def assemble(frames: Mapping[str, DataFrame], max_rows: int = MAX_ROWS) -> dict[str, list[dict]]:
    """Rows of each frame as plain values, in the order of the frame's columns.

    Raises ValueError for a frame with more than ``max_rows`` rows instead of
    cutting it. Rows come ordered by their rendered cells, so a report does not
    depend on partitioning.
    """
    out = {}
    for name, frame in frames.items():
        rows = frame.limit(max_rows + 1).collect()
        if len(rows) > max_rows:
            raise ValueError(f"{name} has more than {max_rows} rows")
        plain = [{c: _cell(r[c]) for c in frame.columns} for r in rows]
        out[name] = sorted(plain, key=lambda r: [json.dumps(v, ensure_ascii=False, default=str) for v in r.values()])
    return out


def to_json(frames: Mapping[str, DataFrame], max_rows: int = MAX_ROWS) -> str:
    """The report as JSON with an indent of two, keys in the order given."""
    return json.dumps(assemble(frames, max_rows), indent=2, ensure_ascii=False) + "\n"


def usd(amount: Decimal) -> str:
    """Dollars to the cent, half to even; amounts that would read as nothing say so."""
    if amount != 0 and abs(amount) < Decimal("0.01"):
        return ("-" if amount < 0 else "") + "<$0.01"
    cents = amount.quantize(Decimal("0.01"), ROUND_HALF_EVEN)
    return ("-" if cents < 0 else "") + f"${abs(cents):,.2f}"


def count(n: int) -> str:
    """A count with separators."""
    return f"{n:,}"


def percent(part: int | Decimal, whole: int | Decimal, digits: int = 1) -> str:
    """A share, or 'n/a' of nothing."""
    if not whole:
        return "n/a"
    return f"{Decimal(part) * 100 / Decimal(whole):.{digits}f}%"


def share_text(lower: int, upper: int, total: int) -> str:
    """A share of ``total`` between two counts, in percent; an interval is rounded outwards, so
    the true share is never outside what is shown."""
    if not total:
        return "unknown"
    if lower == upper:
        return f"{Decimal(lower) * 100 / Decimal(total):.2f}%"
    low = max(0, lower * 10_000 // total)
    high = min(10_000, -(-upper * 10_000 // total))
    return f"[{Decimal(low) / 100:.2f}%, {Decimal(high) / 100:.2f}%]"


def headline(flagged: list[dict], tracked: int, volume: dict | None, reason: str = "") -> str:
    """One line: flagged sessions first, else the change of volume, else why there is none.

    ``flagged``: rows with lower, upper, total and unit; ``volume``: tokens and requests
    before and after.
    """
    if flagged:
        lead = max(flagged, key=lambda f: (Decimal(f["lower"]) / f["total"], -f["upper"]))
        one = "; one flagged session: " if len(flagged) > 1 else ": "
        return f"{len(flagged)} of {tracked} tracked sessions flagged for review{one}{share_text(lead['lower'], lead['upper'], lead['total'])} of attributed {lead['unit']}."
    if volume:
        change = volume["tokens_after"] - volume["tokens_before"]
        return f"Reported tokens: {volume['tokens_before']} -> {volume['tokens_after']} ({change:+d}); model attempts: {volume['requests_before']} -> {volume['requests_after']}."
    return f"Token-change breakdown unavailable. {reason}".rstrip()


def text_table(rows: list[dict], columns: list[str] | None = None) -> str:
    """Rows as aligned text: numbers to the right, nothing as '-'; line breaks within cells are shown as such."""
    names = columns or (list(rows[0]) if rows else [])
    cell = lambda v: "-" if v is None else count(v) if isinstance(v, int) and not isinstance(v, bool) else str(_cell(v)).replace("\n", "\\n")
    body = [[cell(r.get(n)) for n in names] for r in rows]
    widths = [max(map(len, column)) for column in zip(names, *body)]
    right = [all(isinstance(r.get(n), (int, Decimal, float, type(None))) for r in rows) for n in names]
    line = lambda cells: "  ".join(c.rjust(w) if r else c.ljust(w) for c, w, r in zip(cells, widths, right)).rstrip()
    return "\n".join(map(line, [names, *body])) + "\n" if names else ""
