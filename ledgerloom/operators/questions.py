"""Questions that a comparison of two groups of windows can answer, with what stands against an answer."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Counters that the questions rest on.
NEEDED = ("requests", "missing_token_usage", "input_tokens", "output_tokens")


def sides(latest: DataFrame, before: Column, after: Column, expected: list[str]) -> DataFrame:
    """One row: for each side (``b``, ``a``) the sums of :data:`NEEDED` (null where a snapshot lacks
    one, or there is none) and whether every window has all expected producers.

    ``latest``: the latest snapshot of each producer, epoch and window.
    """
    n = len(set(expected))
    per = latest.filter(before | after).withColumn("side", F.when(before, "b").otherwise("a")).groupBy("side", "window_start")
    c = lambda name: F.try_element_at("counters", F.lit(name))
    windows = per.agg(
        (F.count_distinct(F.when(F.col("producer").isin(expected), F.col("producer"))) == n).cast("int").alias("whole"),
        *[F.when(F.count(c(k)) == F.count(F.lit(1)), F.sum(c(k).cast("decimal(38,0)"))).alias(k) for k in NEEDED],
    )
    on = lambda s, v: F.when(F.col("side") == s, v)
    aggs = []
    for s in ("b", "a"):
        held = F.count(on(s, F.lit(1)))
        aggs.append(F.coalesce(F.min(on(s, F.col("whole"))), F.lit(0)).alias(f"{s}_whole"))
        aggs += [F.when((held > 0) & (F.count(on(s, F.col(k))) == held), F.sum(on(s, F.col(k)))).alias(f"{s}_{k}") for k in NEEDED]
    return windows.agg(*aggs)


def statuses(latest: DataFrame, before: Column, after: Column, expected: list[str]) -> DataFrame:
    """``question, status, reason``: whether the change of volume can be split (observed or
    cannot_determine, with the first reason), and how far the observations are covered."""
    x = sides(latest, before, after, expected)
    whole = (F.col("b_whole") == 1) & (F.col("a_whole") == 1)
    known = F.lit(True)
    for s in ("b", "a"):
        for k in NEEDED:
            known = known & F.col(f"{s}_{k}").isNotNull()
    complete = (F.col("b_missing_token_usage") == 0) & (F.col("a_missing_token_usage") == 0)
    reason = (
        F.when(~whole, "incomplete_producers").when(~known, "counters_unavailable").when(~complete, "missing_usage")
        .when((F.col("b_requests") == 0) | (F.col("a_requests") == 0), "no_requests")
    )
    covered = whole & known & F.coalesce(complete, F.lit(False))
    rows = F.array(
        F.struct(F.lit("volume").alias("question"), F.when(reason.isNull(), "observed").otherwise("cannot_determine").alias("status"), reason.alias("reason")),
        F.struct(F.lit("coverage").alias("question"), F.when(covered, "observed").otherwise("limited").alias("status"), F.when(~covered, F.coalesce(reason, F.lit("missing_usage"))).alias("reason")),
    )
    return x.select(F.explode(rows).alias("q")).select("q.*")


def flagged(items: DataFrame, threshold: str) -> DataFrame:
    """Items (lower, upper, total) whose share surely exceeds ``threshold`` (a decimal in
    digits, meant exactly): the lower bound is compared by cross multiplication, so rounding
    moves nothing across. The largest lower bound of a window comes first."""
    t = Decimal(threshold)
    scale = 10 ** max(0, -t.as_tuple().exponent)
    left = F.col("lower").cast("decimal(19,0)") * F.lit(scale).cast("decimal(10,0)")
    right = F.col("total").cast("decimal(19,0)") * F.lit(int(t * scale)).cast("decimal(10,0)")
    return items.filter((F.col("total") > 0) & (left > right)).withColumn("flag", F.lit("runaway_candidate"))


def aliased(lists: DataFrame, kind: str, member: str, place: str) -> DataFrame:
    """``lists`` with ``alias``: 'kind-N' by first use, the same for a member in every list.

    Rows are those of review lists, which have a top: all of a kind are numbered in one window.
    """
    first = lists.groupBy(kind, member).agg(F.min(place).alias("__first"))
    number = F.row_number().over(Window.partitionBy(kind).orderBy("__first", member))
    named = first.select(F.col(kind).alias("__kind"), F.col(member).alias("__member"), F.concat_ws("-", kind, number.cast("string")).alias("alias"))
    same = F.col(kind).eqNullSafe(F.col("__kind")) & F.col(member).eqNullSafe(F.col("__member"))
    return lists.join(named, same).drop("__kind", "__member")
