"""Distinct counts of groups and their combinations from sorted hash runs.

An identifier is held as its 64-bit hash. A group's set of hashes is a sorted run,
stored as its first hash and the byte-wise differences of the rest; runs of tasks,
days or files are put together by a union of sorted runs and may be stored in
between. Counts are exact but for hash collisions, whose expected number is
reported. Groups with many rows are split by hash range into shards of
bounded size, so no run outgrows a task.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import SPACES

#: Rows of a group from which it is split, and about the most hashes of one run.
SHARD_ROWS = 65_536
#: Most members, over all keys, whose rows are told to the tasks. A member beyond them has at most
#: keys * rows / HOT_MEMBERS rows, so its run is bounded as well; results are the same for any value.
HOT_MEMBERS = 16_384
#: Rows that a task turns into runs at a time.
CHUNK = 250_000


def encode_runs(hashes: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Sorted runs of unsigned hashes, the first of each at ``starts``, as binary:
    8 bytes of the first, then for longer runs the width of the differences and
    the differences in that many bytes each. Empty runs are empty."""
    n = len(hashes)
    ends = np.append(starts[1:], n)
    counts = ends - starts
    if not n:
        return pa.array([b""] * len(starts), pa.binary())
    run = np.repeat(np.arange(len(starts)), counts)
    first = np.zeros(n, bool)
    first[starts[counts > 0]] = True
    deltas = np.where(first, hashes, np.diff(hashes, prepend=np.uint64(0)))
    widths = np.zeros(n, np.int64)
    for b in range(8):
        widths[deltas >= np.uint64(1) << np.uint64(8 * b)] = b + 1
    width = np.ones(len(starts), np.int64)
    np.maximum.at(width, run[~first], widths[~first])
    cells = np.zeros((n, 9), np.uint8)
    cells[:, :8] = deltas.astype("<u8").view(np.uint8).reshape(n, 8)
    cells[:, 8] = width[run]
    size = np.where(first, np.where(counts[run] > 1, 9, 8), width[run])
    body = cells[np.arange(9)[None, :] < size[:, None]]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(run, size, len(starts)).astype(np.int64))]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(body.tobytes())])


def decode_runs(runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all runs, and the number of the run each belongs to."""
    runs = pc.fill_null(runs, b"")
    offsets = np.frombuffer(runs.buffers()[1], np.int32, len(runs) + 1, runs.offset * 4).astype(np.int64)
    data = runs.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    sizes, start = np.diff(offsets), offsets[:-1]
    width = np.ones(len(runs), np.int64)
    long = sizes > 8
    width[long] = data[start[long] + 8]
    counts = np.where(sizes == 0, 0, np.where(long, (sizes - 9) // width + 1, 1))
    run = np.repeat(np.arange(len(runs)), counts)
    n = len(run)
    if not n:
        return np.zeros(0, np.uint64), run
    head = np.cumsum(counts) - counts
    place = np.arange(n) - head[run]
    first = place == 0
    at = start[run] + np.where(first, 0, 9 + (place - 1) * width[run])
    size = np.where(first, 8, width[run])
    deltas = np.zeros(n, np.uint64)
    for b in range(8):
        has = size > b
        deltas[has] |= data[at[has] + b].astype(np.uint64) << np.uint64(8 * b)
    total = np.cumsum(deltas)  # wraps around; differences within a run are right
    filled = counts > 0
    before = np.zeros(len(runs), np.uint64)
    before[filled] = total[head[filled]] - deltas[head[filled]]
    return total - before[run], run


def union(hashes: np.ndarray, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each group, and where each group starts."""
    order = np.lexsort((hashes, group))
    h, g = hashes[order], group[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    h, g = h[new], g[new]
    return h, np.searchsorted(g, np.arange(groups))


def grouping_sets(keys: list[str]) -> list[tuple[str, ...]]:
    return [c for r in range(len(keys) + 1) for c in combinations(keys, r)]


def hot_members(df: DataFrame, keys: list[str], shard_rows: int = SHARD_ROWS) -> tuple[int, dict[str, dict]]:
    """Number of rows, and the largest members with more than ``shard_rows`` rows of all
    keys, with their rows: :data:`HOT_MEMBERS` at most."""
    sets = [[k] for k in keys]
    counted = df.select(*keys).groupingSets([[F.col(k) for k in s] for s in sets] + [[]], *[F.col(k) for k in keys]).agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n")
    )
    total_id = (1 << len(keys)) - 1
    total_first = F.when(F.col("gid") == total_id, 0).otherwise(1)
    rows = counted.filter((F.col("n") > shard_rows) | (F.col("gid") == total_id)).orderBy(total_first, F.desc("n")).limit(HOT_MEMBERS + 1).collect()
    hot: dict[str, dict] = {k: {} for k in keys}
    total = 0
    for r in rows:
        if r.gid == total_id:
            total = r.n
        else:
            (k,) = [k for i, k in enumerate(keys) if not r.gid >> (len(keys) - 1 - i) & 1]
            hot[k][r[k]] = r.n
    return total, hot


def runs(df: DataFrame, keys: list[str], fields: list[str], shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Merged runs of every combination of ``keys``: ``grouped`` (the keys that
    count, joined by commas), the keys (null where they do not count), ``shard``,
    a run ``run_<field>`` and its number ``n_<field>`` for each field.

    ``df`` has the hashes of the fields as bigint, null where there is no value.
    A null key is a member like any other.
    """
    total, hot = hot_members(df, keys, shard_rows)
    names, cols = list(keys), list(fields)
    sets = grouping_sets(names)
    key_schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"grouped string, {key_schema}, shard int, " + ", ".join(f"run_{f} binary" for f in cols)

    def bits_of(size: np.ndarray) -> np.ndarray:
        return np.ceil(np.log2(np.maximum(1, size / shard_rows))).astype(np.int64)

    def chunk(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        coded, sizes = {}, {}
        for k in names:
            c = table.column(k).combine_chunks().dictionary_encode("encode")
            coded[k] = (c.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(c.dictionary))
            sizes[k] = np.array([hot[k].get(v, 0) for v in c.dictionary.to_pylist()] or [0], np.int64)
        valid = {f: ~table.column(f).is_null().to_numpy() for f in cols}
        hashes = {f: pc.fill_null(table.column(f), 0).to_numpy().astype(np.int64).view(np.uint64) for f in cols}
        n = len(table)
        for members in sets:
            code = np.zeros(n, np.int64)
            size = np.full(n, total, np.int64)
            for k in members:
                code = code * coded[k][1] + coded[k][0]
                size = np.minimum(size, sizes[k][coded[k][0]])
            bits = bits_of(size)
            parts = {}
            for f in cols:
                ok = valid[f]
                h, b = hashes[f][ok], bits[ok].astype(np.uint64)
                shard = np.where(b == 0, np.uint64(0), h >> (np.uint64(64) - np.maximum(b, np.uint64(1)))).astype(np.int64)
                parts[f] = (code[ok], shard, h, np.flatnonzero(ok))
            pairs = np.unique(np.stack([np.concatenate([parts[f][0] for f in cols]), np.concatenate([parts[f][1] for f in cols])]), axis=1) if max(bits, default=0) else None
            if pairs is None:
                groups = np.unique(np.concatenate([parts[f][0] for f in cols]))
                shards = np.zeros(len(groups), np.int64)
            else:
                groups, shards = pairs
            if not len(groups):
                continue
            sample = np.zeros(len(groups), np.int64)  # a row of each group, for its keys
            out = []
            span = int(shards.max()) + 1
            for f in cols:
                g = np.searchsorted(groups * span + shards, parts[f][0] * span + parts[f][1])
                sample[g] = parts[f][3]
                out.append(encode_runs(*union(parts[f][2], g, len(groups))))
            at = pa.array(sample)
            key_columns = [table.column(k).combine_chunks().take(at) if k in members else pa.nulls(len(groups), table.schema.field(k).type) for k in names]
            label = pa.array([",".join(members)] * len(groups))
            yield pa.RecordBatch.from_arrays(
                [label, *key_columns, pa.array(shards, pa.int32()), *out], names=["grouped", *names, "shard", *(f"run_{f}" for f in cols)]
            )

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            waiting.append(batch)
            size += len(batch)
            if size >= CHUNK:
                yield from _small(chunk(pa.Table.from_batches(waiting)))
                waiting, size = [], 0
        if waiting:
            yield from _small(chunk(pa.Table.from_batches(waiting)))

    partial = df.select(*keys, *fields).mapInArrow(local, schema)
    return merge_runs(partial, keys, fields)


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for a in range(0, len(b), 20_000):
            yield b.slice(a, 20_000)


def merge_runs(partial: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Union of runs of the same group and shard (of tasks, days or files)."""
    by = ["grouped", *keys, "shard"]
    cols = list(fields)
    schema = f"{', '.join(f'`{c}` {partial.schema[c].dataType.simpleString()}' for c in by)}, " + ", ".join(f"run_{f} binary, n_{f} bigint" for f in cols)

    def emit(keyed: pa.RecordBatch, held: list[tuple[np.ndarray, np.ndarray]], a: int, b: int) -> pa.RecordBatch:
        columns, names = [keyed.column(c).slice(a, b - a) for c in by], list(by)
        for f, (h, starts) in zip(cols, held, strict=True):
            ends = np.append(starts[1:], len(h))
            lo, hi = (starts[a], ends[b - 1]) if b > a else (0, 0)
            mine = starts[a:b] - lo
            columns += [encode_runs(h[lo:hi], mine), pa.array(ends[a:b] - starts[a:b], pa.int64())]
            names += [f"run_{f}", f"n_{f}"]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.RecordBatch | None = None  # the last group, which may go on
        for batch in batches:
            keyed = batch.select([*by, *(f"run_{f}" for f in cols)])
            if carry is not None:
                keyed = pa.Table.from_batches([carry, keyed]).combine_chunks().to_batches()[0]
            if not len(keyed):
                continue
            new = np.ones(len(keyed), bool)
            new[1:] = False
            for c in by:
                codes = keyed.column(c).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            group = np.cumsum(new) - 1
            groups = int(group[-1]) + 1
            held = []
            for f in cols:
                h, r = decode_runs(keyed.column(f"run_{f}"))
                held.append(union(h, group[r], groups))
            heads = keyed.take(pa.array(np.flatnonzero(new)))
            if groups > 1:
                yield emit(heads, held, 0, groups - 1)
            last = emit(heads, held, groups - 1, groups)
            carry = last.select([*by, *(f"run_{f}" for f in cols)])
        if carry is not None:
            held = []
            for f in cols:
                h, r = decode_runs(carry.column(f"run_{f}"))
                held.append(union(h, r, 1))
            yield emit(carry, held, 0, 1)

    return partial.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, schema)


def composed(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with the strings of ``columns`` in one form: without surrounding white space, composed
    by NFC, null where nothing is left."""
    names = set(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, column in zip(batch.schema.names, batch.columns):
                if name in names:
                    text = pc.utf8_trim(column, SPACES)
                    wide = pc.fill_null(pc.invert(pc.string_is_ascii(text)), False)
                    if pc.any(wide).as_py():
                        values = [unicodedata.normalize("NFC", v).strip(SPACES) for v in text.filter(wide).to_pylist()]
                        text = pc.replace_with_mask(text, wide, pa.array(values, text.type))
                    column = pc.if_else(pc.equal(text, ""), None, text)
                out.append(column)
            yield pa.RecordBatch.from_arrays(out, names=batch.schema.names)

    return df.mapInArrow(run, df.schema)


def distinct_counts(df: DataFrame, keys: list[str], fields: list[str], shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``grouped, keys, n_<field>, collisions``: distinct values of each combination
    of keys, and the expected number of values lost to hash collisions (the
    birthday bound n * (n - 1) / 2**65 of the largest field).

    ``df`` holds the values themselves; null is no value. An empty table gives no row.
    """
    hashed = df.select(*keys, *[F.when(F.col(f).isNotNull(), F.xxhash64(f)).alias(f) for f in fields])
    counts = runs(hashed, keys, fields, shard_rows).groupBy("grouped", *keys).agg(*[F.sum(f"n_{f}").alias(f"n_{f}") for f in fields])
    n = F.greatest(*[F.col(f"n_{f}").cast("double") for f in fields]) if len(fields) > 1 else F.col(f"n_{fields[0]}").cast("double")
    return counts.withColumn("collisions", n * (n - 1) / F.lit(float(1 << 65)))
