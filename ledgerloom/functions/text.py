"""Text normalisation as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code points that count as surrounding white space (Unicode
#: White_Space, the four ASCII separators and the byte-order mark).
SPACES = "".join(
    chr(c)
    for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)
)


def strip(col: Column) -> Column:
    """Remove surrounding white space of any kind (Spark's ``trim`` knows blanks only)."""
    return F.btrim(col, F.lit(SPACES))


def fold(col: Column) -> Column:
    """The form identifiers are compared in: stripped and in lower case."""
    return F.lower(strip(col))


def sql_fold(col: str) -> str:
    """:func:`fold` for DuckDB."""
    chars = "||".join(f"chr({ord(c)})" for c in SPACES)
    return f"lower(trim({col}, {chars}))"
