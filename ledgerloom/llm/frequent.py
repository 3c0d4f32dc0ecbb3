"""Most frequent values of columns with very many distinct values, in bounded memory.

Every task keeps one space-saving summary of a fixed number of counters for each
column; summaries are merged in a tree of bounded fan-in, with the error of each
counter. A value that holds more than 1/counters of the rows is bound to
survive; a second pass counts the survivors exactly.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import SPACES

#: Counters of a summary: the counts of a merged summary are too high by at most rows / COUNTERS.
COUNTERS = 2_000
#: Nodes of a field on each level of the merge tree above the tasks; the last level is one summary.
LEVELS = (1024, 32)
SCHEMA = "field string, part int, rows bigint, floor bigint, items array<string>, counts array<bigint>, errors array<bigint>"


def canonical(value: str) -> str:
    """The form values are counted in: no surrounding white space, composed by NFC."""
    value = value.strip(SPACES)
    return value if value.isascii() else unicodedata.normalize("NFC", value).strip(SPACES)


class SpaceSaving:
    """At most ``counters`` values with counts that are too high by at most their error.

    ``floor``: what a value that is not held may count at most.
    """

    def __init__(self, counters: int = COUNTERS):
        self.counters, self.rows, self.floor = counters, 0, 0
        self.held: dict[str, list[int]] = {}

    def merge(self, items: list[str], counts: list[int], errors: list[int], floor: int, rows: int) -> None:
        """Add another summary (or exact counts: errors and floor 0)."""
        mine, base = self.held, self.floor
        other = set(items)
        for item, count, error in zip(items, counts, errors, strict=True):
            have = mine.get(item)
            if have is None:
                mine[item] = [count + base, error + base]
            else:
                have[0] += count
                have[1] += error
        if floor:
            for item, have in mine.items():
                if item not in other:
                    have[0] += floor
                    have[1] += floor
        self.floor += floor
        self.rows += rows
        if len(mine) > self.counters:
            values = np.fromiter((h[0] for h in mine.values()), np.int64, len(mine))
            cut = int(np.partition(values, len(values) - self.counters - 1)[len(values) - self.counters - 1])
            kept = {k: h for k, h in mine.items() if h[0] > cut}
            if len(kept) < self.counters:  # ties at the cut, by value, so that the result does not depend on the order
                level = sorted(k for k, h in mine.items() if h[0] == cut)
                kept |= {k: mine[k] for k in level[: self.counters - len(kept)]}
            self.held, self.floor = kept, max(self.floor, cut)

    def row(self, field: str, part: int) -> dict:
        items = sorted(self.held)
        return {
            "field": field, "part": part, "rows": self.rows, "floor": self.floor, "items": items,
            "counts": [self.held[i][0] for i in items], "errors": [self.held[i][1] for i in items],
        }


_TYPE = pa.schema(
    [
        ("field", pa.string()), ("part", pa.int32()), ("rows", pa.int64()), ("floor", pa.int64()),
        ("items", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("errors", pa.list_(pa.int64())),
    ]
)


def _counted(column: pa.Array) -> tuple[list[str], list[int]]:
    """Exact counts of the canonical values of one batch, without nulls and blanks."""
    got = pc.value_counts(column.drop_null())
    values, counts = got.field("values").to_pylist(), got.field("counts").to_pylist()
    total: dict[str, int] = {}
    for v, n in zip(values, counts, strict=True):
        v = canonical(v)
        if v:
            total[v] = total.get(v, 0) + n
    return list(total), list(total.values())


def summaries(df: DataFrame, fields: list[str], counters: int = COUNTERS) -> DataFrame:
    """One merged space-saving summary of each field; empty columns give none."""
    names = list(fields)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = {f: SpaceSaving(counters) for f in names}
        waiting: list[pa.RecordBatch] = []

        def flush() -> None:
            table = pa.Table.from_batches(waiting)
            for i, f in enumerate(names):
                items, counts = _counted(table.column(i).combine_chunks())
                held[f].merge(items, counts, [0] * len(items), 0, sum(counts))
            waiting.clear()

        for batch in batches:
            waiting.append(batch)
            if sum(map(len, waiting)) >= 100_000:
                flush()
        if waiting:
            flush()
        part = TaskContext.get().partitionId()
        rows = [h.row(f, part) for f, h in held.items() if h.rows]
        yield from pa.Table.from_pylist(rows, _TYPE).to_batches()

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Merge neighbours of one field and node, one summary at a time as Python objects."""
        at: tuple | None = None
        total = SpaceSaving(counters)
        for batch in batches:
            for i in range(len(batch)):
                r = batch.slice(i, 1).to_pylist()[0]
                if (r["field"], r["node"]) != at:
                    if at is not None:
                        yield from pa.Table.from_pylist([total.row(*at)], _TYPE).to_batches()
                    at, total = (r["field"], r["node"]), SpaceSaving(counters)
                total.merge(r["items"], r["counts"], r["errors"], r["floor"], r["rows"])
        if at is not None:
            yield from pa.Table.from_pylist([total.row(*at)], _TYPE).to_batches()

    tree = df.select(*[F.col(f) for f in fields]).mapInArrow(local, SCHEMA)
    for nodes in (*LEVELS, 1):  # a fixed height: one summary of a field comes out, however many tasks ran
        placed = tree.withColumn("node", F.pmod("part", F.lit(nodes)).cast("int"))
        tree = placed.repartition("field", "node").sortWithinPartitions("field", "node", "part").mapInArrow(combined, SCHEMA)
    return tree


def frequent(df: DataFrame, fields: list[str], share: float, counters: int = COUNTERS) -> DataFrame:
    """``field, value, n, rows, estimate, error`` of the values that hold more than
    ``share`` of a field's rows that are neither null nor blank.

    ``n`` and ``rows`` are exact, from the second pass; ``estimate`` and ``error``
    are the summary's. ``share`` must exceed 1/counters, else candidates could be
    missed. Ties do not matter, repeated rows count as they stand, an empty table
    gives no row.
    """
    if share * counters <= 1:
        raise ValueError("share must exceed 1 / counters")
    names = list(fields)
    merged = summaries(df, names, counters).collect()  # one row of at most ``counters`` items for each field
    candidates = {r["field"]: {i: (n, e) for i, n, e in zip(r["items"], r["counts"], r["errors"]) if n > share * r["rows"]} for r in merged}
    wanted = {f: frozenset(c) for f, c in candidates.items()}

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str], int] = {}
        for batch in batches:
            for i, f in enumerate(names):
                mine = wanted.get(f, frozenset())
                for v, n in zip(*_counted(batch.column(i)), strict=True):
                    if v in mine:
                        total[f, v] = total.get((f, v), 0) + n
        keys = list(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([total[k] for k in keys], pa.int64())], names=["field", "value", "n"]
        )

    counts = df.select(*[F.col(f) for f in names]).mapInArrow(exact, "field string, value string, n bigint").groupBy("field", "value").agg(F.sum("n").alias("n"))
    known = [(r["field"], i, r["rows"], *candidates[r["field"]][i]) for r in merged for i in candidates[r["field"]]]
    bounds = df.sparkSession.createDataFrame(known, "field string, value string, rows bigint, estimate bigint, error bigint")
    return counts.join(F.broadcast(bounds), ["field", "value"]).filter(F.col("n") > share * F.col("rows"))
