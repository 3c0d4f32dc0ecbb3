"""Cumulative summary snapshots: latest of each producer, combination, comparison.

A snapshot is a row (producer, epoch, window_start, window_seconds, sequence,
emitted_at, counters map). Within (producer, epoch, window) the highest sequence holds
all earlier ones; windows of producers and epochs add up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.accounting import COUNTS, empty
from ledgerloom.operators.usage import supported

KEY = ["producer", "epoch", "window_start"]


def from_usage(rows: DataFrame) -> DataFrame:
    """Daily snapshots of classified usage rows: one producer for each team, an
    epoch for each third of the day, and a sequence for each hour, cumulative within the epoch."""
    from pyspark.sql.window import Window

    hour = F.hour("start_time")
    x = rows.filter(F.col("team_id").isNotNull() & F.col("start_time").isNotNull()).groupBy(
        F.col("team_id").alias("producer"), F.floor(hour / 8).cast("int").alias("epoch"), F.to_date("start_time").alias("window_start"), hour.alias("sequence")
    ).agg(
        F.count(F.lit(1)).alias("requests"), F.sum("total").alias("tokens"), F.sum("missing").cast("bigint").alias("missing"),
        F.coalesce(F.sum("input"), F.lit(0)).alias("input"), F.coalesce(F.sum("cache_read"), F.lit(0)).alias("cache_read"),
    )
    w = Window.partitionBy(*KEY).orderBy("sequence")  # at most 24 snapshots
    names = ("requests", "tokens", "missing", "input", "cache_read")
    counters = F.create_map(*[v for n in names for v in (F.lit(n), F.sum(n).over(w).cast("bigint"))])
    return x.select(*KEY, "sequence", counters.alias("counters"))


def latest(snapshots: DataFrame) -> DataFrame:
    """The snapshot with the highest sequence of each producer, epoch and window: a
    partial aggregate, so superseded snapshots are not shuffled."""
    held = snapshots.groupBy(*KEY).agg(F.max_by(F.struct("sequence", "counters"), "sequence").alias("x"), F.count(F.lit(1)).alias("versions"))
    return held.select(*KEY, "x.sequence", "x.counters", "versions")


def conflicts(snapshots: DataFrame) -> DataFrame:
    """Sequences delivered with different contents."""
    text = F.to_json(F.array_sort(F.map_entries("counters")))
    return snapshots.groupBy(*KEY, "sequence").agg(F.count_distinct(F.sha2(text, 256)).alias("contents")).filter("contents > 1")


def combined(snapshots: DataFrame) -> DataFrame:
    """Counters of each window over all producers and epochs."""
    x = latest(snapshots).select("window_start", F.explode("counters").alias("counter", "value"))
    return x.groupBy("window_start", "counter").agg(F.sum("value").cast("bigint").alias("value"))


def producers(snapshots: DataFrame, expected: list[str]) -> DataFrame:
    """Of the expected producers (a configured list), how many sent something in each
    window, and which sent nothing."""
    names = sorted(set(expected))
    seen = latest(snapshots).filter(F.col("producer").isin(names)).groupBy("window_start").agg(F.collect_set("producer").alias("seen"))  # no more than are expected
    windows = snapshots.select("window_start").distinct().join(seen, "window_start", "left")
    held = F.coalesce("seen", F.array().cast("array<string>"))
    listed = F.array(*[F.lit(n) for n in names]).cast("array<string>")
    return windows.select("window_start", F.size(held).cast("bigint").alias("sent"), F.array_sort(F.array_except(listed, held)).alias("absent"))


def counter_delta(frames: DataFrame, before: Column, after: Column) -> DataFrame:
    """Counters of two groups of windows with their difference."""
    x = frames.groupBy("counter").agg(F.coalesce(F.sum(F.when(before, F.col("value"))), F.lit(0)).cast("bigint").alias("before"), F.coalesce(F.sum(F.when(after, F.col("value"))), F.lit(0)).cast("bigint").alias("after"))
    return x.withColumn("change", F.col("after") - F.col("before"))


def cache_share_change(frames: DataFrame, before: Column, after: Column) -> DataFrame:
    """Whether the share of cached input rose, fell or stayed, compared exactly by cross multiplication."""
    one = lambda c, s: F.coalesce(F.sum(F.when((F.col("counter") == c) & s, F.col("value"))), F.lit(0)).cast("decimal(19,0)")
    x = frames.agg(one("cache_read", before).alias("r0"), one("input", before).alias("i0"), one("cache_read", after).alias("r1"), one("input", after).alias("i1"))
    left, right = (F.col("r1") * F.col("i0")), (F.col("r0") * F.col("i1"))
    move = F.when((F.col("i0") == 0) | (F.col("i1") == 0), "unknown").when(left > right, "up").when(left < right, "down").otherwise("same")
    share = lambda r, i: F.round(F.col(r).cast("double") / F.nullif(F.col(i).cast("double"), F.lit(0.0)), 9)
    return x.select(share("r0", "i0").alias("share_before"), share("r1", "i1").alias("share_after"), move.alias("direction"))


def shared_counters(snapshots: DataFrame) -> DataFrame:
    """Counters that every latest snapshot of a window carries; only these may be compared."""
    x = latest(snapshots).select("window_start", F.map_keys("counters").alias("names"))
    held = x.select("window_start", F.explode("names").alias("counter")).groupBy("window_start", "counter").agg(F.count(F.lit(1)).alias("n"))
    all_of = x.groupBy("window_start").agg(F.count(F.lit(1)).alias("snapshots"))
    return held.join(all_of, "window_start").filter("n = snapshots").select("window_start", "counter", "snapshots")


def retained(snapshots: DataFrame, windows: int) -> DataFrame:
    """The latest snapshots of the last ``windows`` windows, for an archive that forgets older ones."""
    last = snapshots.select("window_start").distinct().orderBy(F.desc("window_start")).limit(windows)
    return latest(snapshots).join(last, "window_start", "left_semi")


def quality_snapshots(rows: DataFrame) -> DataFrame:
    """Daily snapshots of classified usage rows by team with the counters of token quality."""
    part = lambda n: {
        "reported": F.count_if(F.col(n).isNotNull()), "missing": F.count_if(F.col(n).isNull() & empty(F.col(COUNTS[n]))),
        "invalid": F.count_if(F.col(n).isNull() & ~empty(F.col(COUNTS[n]))), "conflict": F.lit(0),
    }
    counters = {
        "requests": F.count(F.lit(1)), "missing_token_usage": F.sum("missing"), "input_tokens": F.coalesce(F.sum("input"), F.lit(0)), "output_tokens": F.coalesce(F.sum("output"), F.lit(0)),
        "dedup_key_missing": F.count_if(empty(F.col("request_id"))), **{f"token_observations.{n}.{s}": v for n in ("input", "output") for s, v in part(n).items()},
    }
    g = rows.filter(F.col("team_id").isNotNull() & F.col("start_time").isNotNull()).groupBy(F.col("team_id").alias("producer"), F.to_date("start_time").alias("window_start"))
    held = g.agg(*[v.cast("bigint").alias(f"c{i}") for i, v in enumerate(counters.values())], F.max("start_time").alias("emitted_at"))
    pairs = F.create_map(*[v for i, n in enumerate(counters) for v in (F.lit(n), F.col(f"c{i}"))])
    return held.select("producer", F.lit(0).alias("epoch"), "window_start", F.lit(0).alias("sequence"), "emitted_at", pairs.alias("counters"))


#: Sources that usage may be declared to come from.
ORIGINS = ("provider_reported", "inferred", "unavailable", "unknown")


def with_provenance(snapshots: DataFrame) -> DataFrame:
    """``snapshots`` with counters of where usage comes from: one that declares nothing has all
    its requests of unknown origin; declarations, also partial ones, stay as they are."""
    declared = F.exists(F.map_keys("counters"), lambda k: k.startswith("usage_provenance."))
    requests = F.coalesce(F.try_element_at("counters", F.lit("requests")), F.lit(0)).cast("bigint")
    more = F.create_map(*[v for f in ("input", "output") for o in ORIGINS for v in (F.lit(f"usage_provenance.v1.{f}.{o}"), requests if o == "unknown" else F.lit(0).cast("bigint"))])
    return snapshots.withColumn("counters", F.when(declared, F.col("counters")).otherwise(F.map_concat("counters", more)))


def one_window(snapshots: DataFrame, chosen: object = None) -> DataFrame:
    """The snapshots of one window: the chosen one, or the only one there is."""
    if chosen is not None:
        return snapshots.filter(F.col("window_start") == F.lit(chosen))
    if len(snapshots.select("window_start").distinct().head(2)) > 1:
        raise ValueError("the snapshots are of several windows; choose one")
    return snapshots


def frames(snapshots: DataFrame, expected: list[str]) -> DataFrame:
    """``day, complete, emitted_at`` of each window: whether all expected producers sent something, and the last emission."""
    seen = F.count_distinct(F.when(F.col("producer").isin(expected), F.col("producer")))
    return snapshots.groupBy(F.col("window_start").alias("day")).agg((seen == len(set(expected))).alias("complete"), F.max("emitted_at").alias("emitted_at"))


def merged_items(sketches: DataFrame) -> DataFrame:
    """Frequent items of several summaries as one: ``window_start, item, lower, upper, total``.

    ``sketches``: window_start, total, max_error, items (array of item, lower, upper). An item
    that a summary does not hold may still count up to its ``max_error`` there; no bound
    exceeds the total.
    """
    all_of = sketches.groupBy("window_start").agg(F.sum("total").cast("bigint").alias("total"), F.sum("max_error").cast("bigint").alias("errors"))
    x = sketches.select("window_start", "max_error", F.explode("items").alias("e"))
    g = x.groupBy("window_start", F.col("e.item").alias("item")).agg(F.sum("e.lower").alias("lower"), F.sum("e.upper").alias("held"), F.sum("max_error").alias("own"))
    upper = F.least(F.col("total"), F.col("held") + F.col("errors") - F.col("own"))
    return g.join(all_of, "window_start").select("window_start", "item", F.col("lower").cast("bigint").alias("lower"), upper.cast("bigint").alias("upper"), "total")


def inconsistent_items(sketches: DataFrame) -> DataFrame:
    """Summaries that contradict themselves, with the first reason: an upper bound above the
    total or below the lower, lower bounds that add up to more than the total, or an exact
    summary (no error) that does not add up to it."""
    add = lambda name: F.aggregate("items", F.lit(0).cast("decimal(38,0)"), lambda a, e: (a + e[name]).cast("decimal(38,0)"))
    reason = (
        F.when(F.exists("items", lambda e: (e["upper"] > F.col("total")) | (e["upper"] < e["lower"]) | (e["lower"] < 0)), "bound")
        .when(add("lower") > F.col("total"), "lower_sum").when((F.col("max_error") == 0) & (add("lower") != F.col("total")), "exact_sum")
    )
    return sketches.withColumn("reason", reason).filter("reason is not null")


def usage_histogram(rows: DataFrame) -> DataFrame:
    """Requests of each model by size of input: bins by powers of two, each with its sums and
    the least and greatest input; rows without complete usage make a bin of their own (-1)."""
    whole = F.col("missing") + F.col("invalid") == 0
    size = F.when(~whole, -1).when(F.col("input") == 0, 0).otherwise(F.floor(F.log2(F.col("input").cast("double"))).cast("int") + 1)
    # Where the logarithm is rounded across a power of two, the power itself decides.
    exact = F.expr("CASE WHEN bin > 0 AND input < shiftleft(1L, bin - 1) THEN bin - 1 WHEN bin > 0 AND bin < 63 AND input >= shiftleft(1L, bin) THEN bin + 1 ELSE bin END")
    rows = rows.withColumn("bin", size.cast("int")).withColumn("bin", exact)
    kept = lambda c: F.when(whole, F.col(c))
    return rows.filter(supported()).groupBy("model", "bin").agg(
        F.count(F.lit(1)).alias("requests"), F.sum(kept("input")).cast("bigint").alias("input_tokens"), F.sum(kept("output")).cast("bigint").alias("output_tokens"),
        F.min(kept("input")).alias("input_min"), F.max(kept("input")).alias("input_max"),
    )
