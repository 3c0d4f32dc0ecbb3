"""Percentiles of groups over very many values, by relative-error compactors.

A sketch is a stack of buffers; items of buffer h stand for 2**h values. A full
buffer keeps its upper part as it is and compacts the rest, every other item of
which moves up, so ranks near the maximum stay nearly exact and the rank error
is a fraction of the number of values above. Sketches of tasks and days
are merged by joining their buffers. Groups with few values are held exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Section length of a compactor; the rank error of a quantile q is about ERROR_FACTOR / SECTION * (1 - q) * n (more than two standard deviations).
SECTION, ERROR_FACTOR = 32, 0.32
#: Sketches of a group that the last step of the merge tree reads at most.
LEAVES = 64


class RelativeSketch:
    """Mergeable quantile sketch whose error shrinks toward the maximum."""

    def __init__(self, section: int = SECTION, seed: int = 0) -> None:
        self.k, self.n = section, 0
        self.levels: list[np.ndarray] = [np.zeros(0)]
        self.turns: list[int] = [0]
        self._random = np.random.default_rng(seed)

    def _capacity(self, h: int) -> int:
        sections = 3 + max(0, (self.turns[h] + 1).bit_length() - 1)
        return 2 * self.k * sections

    def update(self, values: np.ndarray) -> None:
        """Add values (no NaN)."""
        self.n += len(values)
        self.levels[0] = np.concatenate([self.levels[0], values])
        self._compress()

    def merge(self, other: RelativeSketch) -> None:
        self.n += other.n
        for h, buffer in enumerate(other.levels):
            if h == len(self.levels):
                self.levels.append(np.zeros(0))
                self.turns.append(0)
            self.levels[h] = np.concatenate([self.levels[h], buffer])
            self.turns[h] |= other.turns[h]
        self._compress()

    def _compress(self) -> None:
        h = 0
        while h < len(self.levels):
            if len(self.levels[h]) >= self._capacity(h):
                self._compact(h)
            h += 1

    def _compact(self, h: int) -> None:
        buffer = np.sort(self.levels[h])
        # The more often a level was compacted, the rarer its higher sections are touched.
        turn = self.turns[h]
        free = 1
        while turn & 1:
            free, turn = free + 1, turn >> 1
        capacity = self._capacity(h)
        self.turns[h] += 1
        protected = max(capacity // 2, capacity - free * self.k)
        stop = len(buffer) - min(protected, len(buffer) - 2)
        stop -= stop % 2
        chosen = buffer[int(self._random.integers(2)) : stop : 2]
        self.levels[h] = buffer[stop:]
        if h + 1 == len(self.levels):
            self.levels.append(np.zeros(0))
            self.turns.append(0)
        self.levels[h + 1] = np.concatenate([self.levels[h + 1], chosen])

    def quantiles(self, qs: list[float]) -> list[float]:
        """Values whose rank is the least that reaches q * n; of an empty sketch NaN."""
        if not self.n:
            return [float("nan")] * len(qs)
        values = np.concatenate(self.levels)
        weights = np.concatenate([np.full(len(b), 1 << h, np.int64) for h, b in enumerate(self.levels)])
        order = np.argsort(values, kind="stable")
        values, ranks = values[order], np.cumsum(weights[order])
        wanted = np.maximum(1, np.ceil(np.array(qs) * ranks[-1]))
        return values[np.minimum(np.searchsorted(ranks, wanted), len(values) - 1)].tolist()

    @property
    def exact(self) -> bool:
        return len(self.levels) == 1

    def rank_error(self, q: float) -> float:
        """Bound on the rank error at q as a fraction of n (two standard deviations)."""
        return 0.0 if self.exact else min(1.0, ERROR_FACTOR / self.k * (1 - q) + 1 / self.n)

    def pack(self) -> bytes:
        head = np.array([self.k, self.n, len(self.levels), *self.turns, *map(len, self.levels)], "<i8")
        return head.tobytes() + np.concatenate(self.levels).astype("<f8").tobytes()

    @classmethod
    def unpack(cls, raw: bytes, seed: int = 0) -> RelativeSketch:
        k, n, m = np.frombuffer(raw, "<i8", 3).tolist()
        rest = np.frombuffer(raw, "<i8", 2 * m, 24).tolist()
        out = cls(k, seed)
        out.n, out.turns = n, rest[:m]
        values = np.frombuffer(raw, "<f8", -1, 24 + 16 * m)
        out.levels = np.split(values, np.cumsum(rest[m:])[:-1])
        return out


PARTIAL = "{keys}, metric string, part bigint, sketch binary"


def _schema(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def partial_sketches(df: DataFrame, keys: list[str], metrics: list[str], section: int = SECTION, rows: int = 500_000) -> DataFrame:
    """Sketches of each group and metric of each task: ``keys, metric, part, sketch``.

    Null and NaN values are left out; null keys are groups. A task holds at most
    ``rows`` rows before it adds them to its sketches.
    """
    chosen = df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics])
    names = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: dict[tuple, RelativeSketch] = {}
        waiting: list[pa.RecordBatch] = []
        kinds = [None]

        def flush() -> None:
            table = pa.Table.from_batches(waiting).combine_chunks()
            kinds[0] = [table.schema.field(k).type for k in names]
            coded = [table.column(k).combine_chunks().dictionary_encode("encode") for k in names]
            code = np.zeros(len(table), np.int64)
            for c in coded:
                code = code * (len(c.dictionary) + 1) + c.indices.to_numpy(zero_copy_only=False)
            for m in metrics:
                values = table.column(m).to_numpy()
                real = ~np.isnan(values)
                v, g = values[real], code[real]
                order = np.argsort(g, kind="stable")
                v, g = v[order], g[order]
                first = np.flatnonzero(np.diff(g, prepend=-1))
                last = np.append(first[1:], len(g))
                source = np.flatnonzero(real)[order]
                keyed = list(zip(*[c.take(pa.array(source[first])).to_pylist() for c in (table.column(k) for k in names)])) if names else [()] * len(first)
                for key, a, b in zip(keyed, first, last):
                    s = held.get((key, m))
                    if s is None:
                        s = held[key, m] = RelativeSketch(section, hash_seed(part, len(held)))
                    s.update(v[a:b])
            waiting.clear()

        size = 0
        for batch in batches:
            waiting.append(batch)
            size += len(batch)
            if size >= rows:
                flush()
                size = 0
        if waiting:
            flush()
        if not held:
            return
        items = list(held.items())
        for a in range(0, len(items), 5_000):
            some = items[a : a + 5_000]
            columns = [pa.array([k[0][i] for k, _ in some], kinds[0][i]) for i in range(len(names))]
            columns += [pa.array([k[1] for k, _ in some]), pa.array([part] * len(some), pa.int64()), pa.array([s.pack() for _, s in some], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "metric", "part", "sketch"])

    return chosen.mapInArrow(run, PARTIAL.format(keys=_schema(df, keys)) if keys else "metric string, part bigint, sketch binary")


def hash_seed(part: int, index: int) -> int:
    return (part * 1_000_003 + index) & 0x7FFFFFFF


def merged(partials: DataFrame, keys: list[str], leaves: int = LEAVES) -> DataFrame:
    """One sketch for each group and metric, whatever the number of its parts (tasks,
    days or files): first the parts of each of ``leaves`` remainders are merged, which
    spreads a group with very many parts over tasks, then the leaves. Both steps read
    their sketches one after the other. With one leaf the first step is left out."""
    names = list(keys)
    schema = (_schema(partials, keys) + ", " if keys else "") + "metric string, part bigint, sketch binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Merge neighbours of one group and leaf; the last of a batch may go on in the next."""
        group: tuple | None = None
        held: bytes | RelativeSketch = b""
        for batch in batches:
            out: list[tuple[tuple, bytes]] = []
            columns = [batch.column(c).to_pylist() for c in (*names, "metric", "leaf")]
            for *mine, part, raw in zip(*columns, batch.column("part").to_pylist(), batch.column("sketch").to_pylist()):
                mine = tuple(mine)
                if mine != group:
                    if group is not None:
                        out.append((group, held if isinstance(held, bytes) else held.pack()))
                    group, held = mine, raw
                    continue
                if isinstance(held, bytes):
                    held = RelativeSketch.unpack(held, part)
                held.merge(RelativeSketch.unpack(raw))
            yield emitted(out, batch.schema)
        if group is not None:
            yield emitted([(group, held if isinstance(held, bytes) else held.pack())], batch.schema)

    def emitted(out: list[tuple[tuple, bytes]], kinds: pa.Schema) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k, _ in out], kinds.field(c).type) for i, c in enumerate((*names, "metric", "leaf"))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([raw for _, raw in out], pa.binary())], names=[*names, "metric", "part", "sketch"])

    by = [*names, "metric"]
    steps = [F.pmod("part", F.lit(leaves)).cast("bigint")] if leaves > 1 else []
    for leaf in (*steps, F.lit(0).cast("bigint")):
        placed = partials.select(*by, leaf.alias("leaf"), "part", "sketch")
        spread = placed.repartition(*by, "leaf") if leaves > 1 and leaf is steps[0] else placed.repartition(*by)
        partials = spread.sortWithinPartitions(*by, "leaf", "part").mapInArrow(run, schema)
    return partials


def evaluated(sketches: DataFrame, keys: list[str], qs: list[float]) -> DataFrame:
    """``keys, metric, n, q, value, rank_error`` of merged sketches."""
    wanted, names = list(qs), list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [RelativeSketch.unpack(r) for r in batch.column("sketch").to_pylist()]
            again = pa.array(np.repeat(np.arange(len(held)), len(wanted)))
            columns = [batch.column(k).take(again) for k in (*names, "metric")]
            columns += [
                pa.array([s.n for s in held for _ in wanted], pa.int64()), pa.array(wanted * len(held), pa.float64()),
                pa.array([v for s in held for v in s.quantiles(wanted)], pa.float64()), pa.array([s.rank_error(q) for s in held for q in wanted], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "metric", "n", "q", "value", "rank_error"])

    schema = (_schema(sketches, keys) + ", " if keys else "") + "metric string, n bigint, q double, value double, rank_error double"
    return sketches.mapInArrow(run, schema)


def percentiles(df: DataFrame, keys: list[str], metrics: list[str], qs: list[float], section: int = SECTION) -> DataFrame:
    """Percentiles of ``metrics`` in the groups of ``keys``."""
    return evaluated(merged(partial_sketches(df, keys, metrics, section), keys), keys, qs)


def rolled_up(partials: DataFrame, keys: list[str], drop: str, ordinal: Column) -> DataFrame:
    """Sketches of coarser groups from merged ones: ``drop`` (a day or the like, of which
    a group has some thousands at most) leaves the keys, its ``ordinal`` is the order of merging."""
    rest = [k for k in keys if k != drop]
    return merged(partials.withColumn("part", ordinal.cast("bigint")).drop(drop), rest, 1)


def ranks(df: DataFrame, keys: list[str], metrics: list[str], found: DataFrame) -> DataFrame:
    """Exact ranks of the values ``found`` (as of :func:`percentiles`) among the rows of ``df``: the
    columns of ``found`` with ``below`` and ``upto``, the numbers of values less than, and at most, ``value``.

    ``found`` has a few rows for each group, ``df`` is read once and reduced within map tasks.
    """
    asked = found.groupBy(*keys, "metric").agg(F.sort_array(F.collect_set("value")).alias("points"))  # at most one for each q
    pair = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics]))
    rows = df.select(*keys, pair.alias("p")).select(*keys, F.col("p.metric").alias("metric"), F.col("p.x").alias("x")).filter("x is not null and not isnan(x)")
    same = F.lit(True)
    left, right = rows.alias("l"), asked.alias("r")
    for k in (*keys, "metric"):
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    # Where a value stands among the points: 2 i before point i, 2 i + 1 at it.
    place = F.aggregate("r.points", F.lit(0), lambda n, p: n + F.when(F.col("l.x") > p, 2).when(F.col("l.x") == p, 1).otherwise(0))
    placed = left.join(right, same).select(*[F.col(f"l.{k}").alias(k) for k in (*keys, "metric")], F.col("r.points").alias("points"), place.alias("place"))
    counts = placed.groupBy(*keys, "metric", "points", "place").agg(F.count(F.lit(1)).alias("n"))
    held = counts.groupBy(*keys, "metric", "points").agg(F.collect_list(F.struct("place", "n")).alias("held"))  # 2 places for each q
    upto = lambda bound: lambda h: F.when(h["place"] <= bound, h["n"]).otherwise(0)
    count = lambda bound: F.aggregate(F.transform("held", upto(bound)), F.lit(0).cast("bigint"), lambda a, b: a + b)
    each = held.select(*keys, "metric", "held", F.posexplode("points").alias("i", "value"))
    each = each.select(*keys, "metric", "value", count(2 * F.col("i")).alias("below"), count(2 * F.col("i") + 1).alias("upto"))
    a, b = found.alias("a"), each.alias("b")
    same = F.col("a.value") == F.col("b.value")
    for k in (*keys, "metric"):
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, same).select("a.*", "b.below", "b.upto")
