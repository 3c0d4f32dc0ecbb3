"""History scan: windows against the robust reference of the windows before them, and token CUSUM."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Defaults of the scan.
BASELINE, Z, RELATIVE, MIN_ATTEMPTS, SHARE_FLOOR, SHARE_CHANGE, COVERAGE_CHANGE = 6, 4.0, 0.5, 100, 0.25, 0.1, 0.05
#: Fixed value: a normal deviation in median absolute deviations.
MAD_SCALE = 1.4826


def frames(rows: DataFrame) -> DataFrame:
    """Daily frames of classified usage rows: attempts, tokens, missing counts."""
    return rows.filter(F.col("start_time").isNotNull()).groupBy(F.to_date("start_time").alias("day")).agg(
        F.count(F.lit(1)).alias("attempts"), F.sum("total").cast("bigint").alias("tokens"), F.sum("missing").cast("bigint").alias("missing")
    )


def median(values: Column) -> Column:
    """Median of an array: the middle, or half of one middle plus half of the other."""
    v, n = F.array_sort(values), F.size(values)
    middle = lambda k: F.get(v, k.cast("int"))
    return F.when(n % 2 == 1, middle(F.floor(n / 2))).otherwise(middle(n / 2 - 1) / 2 + middle(n / 2) / 2)


def robust(values: Column, floor: float) -> tuple[Column, Column]:
    """Median and scale (scaled MAD, at least ``floor``) of an array."""
    m = median(values)
    return m, F.greatest(F.lit(MAD_SCALE) * median(F.transform(values, lambda v: F.abs(v - m))), F.lit(floor))


def readiness(daily: DataFrame, baseline: int = BASELINE) -> DataFrame:
    """For each day whether the windows before it can serve as its reference: enough of them and no gap."""
    w = Window.orderBy("day")  # days: one row each
    x = daily.withColumn("before", F.lag("day", baseline).over(w)).withColumn("seen", F.row_number().over(w) - 1)
    state = F.when(F.col("before").isNull(), "too_few").when(F.datediff("day", "before") != baseline, "gap").otherwise("ready")
    return x.select("day", F.col("seen").cast("bigint").alias("seen"), state.alias("state"))


def history(frames: DataFrame, now: Column, max_age: int = 3, baseline: int = BASELINE) -> DataFrame:
    """``day, state`` of each window against the ``baseline`` windows before it.

    ``frames``: day, complete, emitted_at. The first that holds: too_few, stale (the last
    window of all ended more than ``max_age`` days before ``now``), emitted_in_future (it or
    its baseline), gap, incomplete_baseline, incomplete (the window itself), ready.
    """
    w = Window.orderBy("day")  # one row for each window
    past = w.rowsBetween(-baseline, -1)
    near = w.rowsBetween(-baseline, 0)
    x = frames.select(
        "day", "complete", F.lag("day", baseline).over(w).alias("first"), F.min(F.col("complete").cast("int")).over(past).alias("whole"), F.max("emitted_at").over(near).alias("emitted"),
        F.max("day").over(Window.partitionBy()).alias("last"),
    )
    state = (
        F.when(F.col("first").isNull(), "too_few").when(F.date_add("last", 1 + max_age).cast("timestamp_ntz") < now, "stale").when(F.col("emitted") > now, "emitted_in_future")
        .when(F.datediff("day", "first") != baseline, "gap").when(F.col("whole") == 0, "incomplete_baseline").when(~F.col("complete"), "incomplete").otherwise("ready")
    )
    return x.select("day", state.alias("state"))


def error_surges(counts: DataFrame, days: DataFrame, least: int = 10, baseline: int = BASELINE) -> DataFrame:
    """Members (tools) whose errors of a day exceed every day of the baseline, and its median by
    the usual margin and by ``least`` at least: ``day, member, errors, threshold``.

    ``counts``: day, member, errors; ``days``: the windows there are, as a member without
    errors has no row. Only days with a whole baseline are looked at.
    """
    number = F.datediff("day", F.lit("1970-01-01").cast("date"))
    w = Window.orderBy("n")  # one row for each window
    ready = days.select("day", number.alias("n")).withColumn("first", F.lag("n", baseline).over(w)).filter(F.col("n") - F.col("first") == baseline).select("day")
    past = F.collect_list("errors").over(Window.partitionBy("member").orderBy("n").rangeBetween(-baseline, -1))
    x = counts.withColumn("n", number).withColumn("past", past).join(ready, "day", "left_semi")
    x = x.withColumn("past", F.transform(F.concat("past", F.array_repeat(F.lit(0).cast("bigint"), F.lit(baseline) - F.size("past"))), lambda v: v.cast("double")))
    m, scale = robust(F.col("past"), 1.0)
    threshold = F.greatest(m + F.greatest(F.lit(Z) * scale, F.lit(RELATIVE) * F.abs(m), F.lit(float(least))), F.array_max("past"))
    return x.withColumn("threshold", threshold).filter(F.col("errors") > F.col("threshold")).select("day", "member", "errors", F.round("threshold", 6).alias("threshold"))


def identified(findings: DataFrame, key: list[str], context: str, persist: int = 1, top: int | None = None) -> DataFrame:
    """Findings with a stable ``id`` (of the context, the day and the key), of those that have
    held on ``persist`` days running; with ``top`` the first of each day by key, and ``omitted``,
    how many more there are."""
    n = F.datediff("day", F.lit("1970-01-01").cast("date"))
    by = Window.partitionBy(*key)
    x = findings.withColumn("island", n - F.row_number().over(by.orderBy("day")))
    x = x.withColumn("held", F.row_number().over(Window.partitionBy(*key, "island").orderBy("day"))).filter(F.col("held") >= persist)
    text = F.concat_ws("/", F.lit(context), F.col("day").cast("string"), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key])
    x = x.withColumn("id", F.substring(F.sha2(text, 256), 1, 32)).drop("island")
    day = Window.partitionBy("day")
    if top is None:
        return x.withColumn("omitted", F.lit(0).cast("bigint"))
    # The size of a day by a partial aggregate; only its first findings go into one window.
    sizes = x.groupBy("day").agg(F.count(F.lit(1)).alias("all"))
    first = x.withColumn("place", F.row_number().over(day.orderBy(*key))).filter(F.col("place") <= top).drop("place")
    return first.join(sizes, "day").withColumn("omitted", F.greatest(F.col("all") - top, F.lit(0)).cast("bigint")).drop("all")


#: States of token observations that a source reports for input and output.
OBSERVATION_STATES = ("reported", "missing", "invalid", "conflict")
#: Fixed value: the greatest integer up to which doubles are exact.
EXACT = 1 << 53


def token_eligibility(latest: DataFrame, expected: list[str]) -> DataFrame:
    """``window_start, total, reason`` of each window: its token total, and why it may not enter
    the CUSUM (null: it may).

    ``latest``: the latest snapshot of each producer and epoch of a window. Every source is
    checked by itself, so errors of two sources cannot cancel: its input and output must be
    reported for all requests, with no key missing that tells repeats apart.
    """
    c = lambda name: F.try_element_at("counters", F.lit(name))
    clean = (F.coalesce(c("dedup_key_missing"), F.lit(0)) == 0) & ~((c("requests") == 0) & ((c("input_tokens") != 0) | (c("output_tokens") != 0)))
    for field in ("input", "output"):
        for state in OBSERVATION_STATES:
            clean = clean & F.coalesce(c(f"token_observations.{field}.{state}") == (c("requests") if state == "reported" else F.lit(0)), F.lit(False))
        clean = clean & (F.coalesce(c(f"token_observations.{field}.subset_violation"), F.lit(0)) == 0)
    explicit = c("requests").isNotNull() & c("missing_token_usage").isNotNull() & c("input_tokens").isNotNull() & c("output_tokens").isNotNull()
    wide = lambda name: F.sum(c(name).cast("decimal(38,0)")).alias(name)
    g = latest.groupBy("window_start").agg(
        F.count_distinct(F.when(F.col("producer").isin(expected), F.col("producer"))).alias("seen"), F.min(explicit.cast("int")).alias("explicit"), F.min(F.coalesce(clean, F.lit(False)).cast("int")).alias("clean"),
        wide("requests"), wide("missing_token_usage"), wide("input_tokens"), wide("output_tokens"),
    ).withColumn("sum", F.col("input_tokens") + F.col("output_tokens"))
    reason = (
        F.when(F.col("seen") < len(set(expected)), "missing_producers").when((F.col("explicit") == 0) | (F.col("missing_token_usage") != 0), "incomplete_usage")
        .when((F.col("requests") == 0) & (F.col("sum") != 0), "tokens_without_requests").when(F.col("sum") > EXACT, "beyond_exact_range").when(F.col("clean") == 0, "source_not_clean")
    )
    return g.select("window_start", F.when(F.col("explicit") == 1, F.col("sum")).cast("decimal(38,0)").alias("total"), reason.alias("reason"))


def scalar_signals(daily: DataFrame, baseline: int = BASELINE) -> DataFrame:
    """Volume, size and missing share of each day against its baseline.

    A finding needs a change beyond the largest of z scales, a part of the median
    and a least change; the missing share only counts upward.
    """
    attempts = F.col("attempts").cast("double")
    signals = F.array(
        F.struct(F.lit("attempt_volume").alias("signal"), attempts.alias("value"), F.lit(1.0).alias("floor"), F.lit(0.0).alias("least")),
        F.struct(F.lit("tokens_per_attempt").alias("signal"), (F.col("tokens") / attempts).alias("value"), F.lit(1.0).alias("floor"), F.lit(0.0).alias("least")),
        F.struct(F.lit("missing_usage_share").alias("signal"), (F.col("missing") / attempts).alias("value"), F.lit(0.01).alias("floor"), F.lit(COVERAGE_CHANGE).alias("least")),
    )
    x = daily.filter("attempts > 0").select("day", F.explode(signals).alias("s")).select("day", "s.*")
    w = Window.partitionBy("signal").orderBy("day")
    past = F.collect_list("value").over(w.rowsBetween(-baseline, -1))
    x = x.withColumn("past", past).filter(F.size("past") == baseline)
    m, scale = robust(F.col("past"), 0.0)
    x = x.withColumn("median", m).withColumn("scale", F.greatest(scale, F.col("floor")))
    required = F.greatest(F.lit(Z) * F.col("scale"), F.lit(RELATIVE) * F.abs("median"), F.col("least"))
    change = F.col("value") - F.col("median")
    direction = F.when(change >= required, "up").when((F.col("signal") != "missing_usage_share") & (-change >= required), "down").otherwise("none")
    return x.select("day", "signal", F.round("value", 6).alias("value"), F.round("median", 6).alias("median"), F.round(required, 6).alias("required"), F.round(change / F.col("scale"), 6).alias("score"), direction.alias("direction"))


def key_shares(rows: DataFrame, column: str) -> DataFrame:
    """Tokens of each member and day, and of the day."""
    x = rows.filter(F.col("start_time").isNotNull() & F.col(column).isNotNull()).groupBy(F.to_date("start_time").alias("day"), F.col(column).alias("member")).agg(F.sum("total").cast("bigint").alias("tokens"))
    return x.join(x.groupBy("day").agg(F.sum("tokens").cast("bigint").alias("day_tokens")), "day")


def top_share(shares: DataFrame, baseline: int = BASELINE) -> DataFrame:
    """The largest share of each day against the largest shares of the days before; days
    without tokens have no share and are left out."""
    s = F.col("tokens").cast("double") / F.nullif(F.col("day_tokens").cast("double"), F.lit(0.0))
    top = shares.withColumn("share", s).groupBy("day").agg(F.max("share").alias("share")).filter("share is not null")
    w = Window.orderBy("day").rowsBetween(-baseline, -1)  # one row for each day
    x = top.withColumn("past", F.collect_list("share").over(w)).filter(F.size("past") == baseline)
    m, scale = robust(F.col("past"), 0.01)
    threshold = F.greatest(m + F.greatest(F.lit(Z) * scale, F.lit(RELATIVE) * F.abs(m), F.lit(SHARE_CHANGE)), F.array_max("past"), F.lit(SHARE_FLOOR))
    return x.select("day", F.round("share", 9).alias("share"), F.round(threshold, 9).alias("threshold"), (F.col("share") > threshold).alias("finding"))


def newly_prominent(shares: DataFrame, floor: float, baseline: int = BASELINE) -> DataFrame:
    """Members that reach a share of ``floor`` on a day while on none of the ``baseline`` days before; compared exactly."""
    scaled = int(round(floor * 1_000_000))
    above = F.col("tokens").cast("decimal(19,0)") * 1_000_000 >= F.col("day_tokens").cast("decimal(19,0)") * scaled
    x = shares.withColumn("above", above & (F.col("tokens") > 0))
    number = F.datediff("day", F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy("member").orderBy("n").rangeBetween(-baseline, -1)
    x = x.withColumn("n", number).withColumn("was", F.coalesce(F.max("above").over(w), F.lit(False)))
    return x.filter(F.col("above") & ~F.col("was")).select("day", "member", "tokens", "day_tokens")


def streaks(findings: DataFrame, key: list[str], day: str = "day") -> DataFrame:
    """Runs of consecutive days with the same key (gaps and islands)."""
    n = F.datediff(day, F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy(*key).orderBy(day)
    return findings.withColumn("island", n - F.row_number().over(w)).groupBy(*key, "island").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count(F.lit(1)).alias("days")).drop("island")


# CUSUM ---------------------------------------------------------------------------


def _residuals(series: DataFrame, keys: list[str], reference: int, floor: float, shift: float) -> DataFrame:
    """Increments of the one-sided CUSUM of each series (index, value, eligible): runs break at gaps and at ineligible buckets."""
    w = Window.partitionBy(*keys).orderBy("index")
    broken = (~F.col("eligible")) | (F.col("index") - F.lag("index", 1).over(w) != 1)
    x = series.withColumn("run", F.sum(F.coalesce(broken, F.lit(True)).cast("int")).over(w)).filter("eligible")
    r = Window.partitionBy(*keys, "run").orderBy("index")
    x = x.withColumn("past", F.collect_list("value").over(r.rowsBetween(-reference, -1))).withColumn("scored", F.size("past") == reference)
    m, scale = robust(F.col("past"), floor)
    return x.withColumn("increment", F.when(F.col("scored"), (F.col("value") - m) / scale - shift / 2))


def cusum(series: DataFrame, keys: list[str], reference: int = 6, floor: float = 1.0, shift: float = 2.0) -> DataFrame:
    """The statistic of each scored bucket, by prefix sums: P_n less the least of 0 and all P_k up to n."""
    x = _residuals(series, keys, reference, floor, shift).filter("scored")
    r = Window.partitionBy(*keys, "run").orderBy("index")
    p = F.sum("increment").over(r)
    x = x.withColumn("p", p)
    least = F.least(F.lit(0.0), F.min("p").over(r))
    return x.select(*keys, "index", F.round(F.col("p") - least, 6).alias("statistic"))


def cusum_alarms(series: DataFrame, keys: list[str], threshold: float, reference: int = 6, floor: float = 1.0, shift: float = 2.0) -> DataFrame:
    """Alarms of the CUSUM that starts again from 0 at each crossing of ``threshold`` (a sequential fold of each short series)."""
    schema = ", ".join(f"`{k}` {series.schema[k].dataType.simpleString()}" for k in keys) + (", " if keys else "") + "index bigint, statistic double"
    names = list(keys)

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        out, score, run = [], 0.0, None
        for row in frame.sort_values("at").to_dict("records"):
            if row["run"] != run:
                run, score = row["run"], 0.0
            if row["scored"]:
                score = max(0.0, score + row["increment"])
                if score >= threshold:
                    out.append([*(row[k] for k in names), row["at"], round(score, 6)])
                    score = 0.0
        return pd.DataFrame(out, columns=[*names, "index", "statistic"])

    x = _residuals(series, keys, reference, floor, shift).select(*keys, F.col("index").cast("bigint").alias("at"), "run", "scored", "increment")
    return x.groupBy(*(keys or [F.lit(0)])).applyInPandas(fold, schema)


def calibrated_threshold(increments: list[float], spacing: int, candidates: Iterator[float] | None = None) -> float | None:
    """The least threshold at which quiet increments, replayed in order, alarm at most once every ``spacing`` buckets."""
    allowed = len(increments) // spacing
    for threshold in candidates or (x / 4 for x in range(2, 400)):
        score, alarms = 0.0, 0
        for i in increments:
            score = max(0.0, score + i)
            if score >= threshold:
                score, alarms = 0.0, alarms + 1
        if alarms <= allowed:
            return threshold
    return None
