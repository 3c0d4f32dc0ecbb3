"""Usage and snapshots as streams: late and repeated messages, windows, stateful CUSUM."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def once(messages: DataFrame, keys: list[str], event_time: str, delay: str = "2 days") -> DataFrame:
    """Each message once: repeats within ``delay`` of the first are dropped, and state older than that forgotten."""
    return messages.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(rows: DataFrame, event_time: str, keys: list[str], width: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Requests and tokens of each tumbling window and key, final once the watermark has passed."""
    w = F.window(event_time, width)
    return rows.withWatermark(event_time, delay).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("requests"), F.sum("total").alias("tokens")).select(F.col("window.start").alias("window_start"), *keys, "requests", "tokens")


def latest_snapshots(snapshots: DataFrame, delay: str = "2 days") -> DataFrame:
    """The highest sequence of each producer, epoch and window so far (for update mode)."""
    x = snapshots.withWatermark("emitted_at", delay)
    return x.groupBy("producer", "epoch", "window_start").agg(F.max_by(F.struct("sequence", "counters"), "sequence").alias("x")).select("producer", "epoch", "window_start", "x.sequence", "x.counters")


STATE = "past array<double>, score double, last bigint"
OUTPUT = "series string, index bigint, statistic double, alarm boolean"


def step(past: list[float], score: float, last: int | None, index: int, value: float, reference: int, floor: float, shift: float, threshold: float) -> tuple[list[float], float, float | None, bool]:
    """One bucket of the CUSUM: its statistic (None while the reference fills) and whether it alarms; the score starts again after an alarm and after a gap."""
    if last is not None and index - last != 1:
        past, score = [], 0.0
    statistic, alarm = None, False
    if len(past) == reference:
        ordered = sorted(past)
        middle = lambda v: v[len(v) // 2] if len(v) % 2 else v[len(v) // 2 - 1] / 2 + v[len(v) // 2] / 2
        m = middle(ordered)
        scale = max(1.4826 * middle(sorted(abs(x - m) for x in past)), floor)
        statistic = max(0.0, score + (value - m) / scale - shift / 2)
        alarm = statistic >= threshold
        score = 0.0 if alarm else statistic
    return [*past, value][-reference:], score, statistic, alarm


def cusum(buckets: DataFrame, reference: int = 6, floor: float = 1.0, shift: float = 2.0, threshold: float = 4.0) -> DataFrame:
    """CUSUM of each series over a stream of closed buckets (series, index, value), with the reference kept as state.

    Buckets of a series must come in order of their index between micro-batches;
    one that is not later than the last is left out.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past, score, last = state.get if state.exists else ([], 0.0, None)
        past, out = list(past), []
        for row in pd.concat(frames).sort_values("index").itertuples(index=False):
            index, value = int(row[1]), float(row[2])
            if last is not None and index <= last:
                continue
            past, score, statistic, alarm = step(past, score, last, index, value, reference, floor, shift, threshold)
            last = index
            if statistic is not None:
                out.append((key[0], index, statistic, alarm))
        state.update((past, score, last))
        yield pd.DataFrame(out, columns=["series", "index", "statistic", "alarm"])

    return buckets.select("series", "index", "value").groupBy("series").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
