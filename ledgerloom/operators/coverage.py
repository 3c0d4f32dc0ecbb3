"""Completeness: rows against daily counts, rows against provider counts, and time covered by intervals."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def calendar(spark, start: datetime, end: datetime) -> DataFrame:
    """Every day that a half-open period touches, with whether all of it is inside."""
    first, last = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    days = F.explode(F.sequence(F.to_date(first), F.to_date(last - F.expr("INTERVAL 1 MICROSECOND"))))
    one = spark.range(1).select(days.alias("day"))
    whole = (F.col("day").cast("timestamp_ntz") >= first) & (F.date_add("day", 1).cast("timestamp_ntz") <= last)
    return one.withColumn("whole", whole)


def row_coverage(rows: DataFrame, daily: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Status of each day of a period: exported rows against the counts of ``daily`` (day, api_requests).

    All rows in the period count. The first that holds: partial_day,
    daily_counts_missing, excess_rows, missing_rows, matched.
    """
    first, last = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    exported = rows.filter((F.col("start_time") >= first) & (F.col("start_time") < last)).groupBy(F.to_date("start_time").alias("day")).agg(F.count(F.lit(1)).alias("exported"))
    d = calendar(rows.sparkSession, start, end).join(exported, "day", "left").join(daily, "day", "left").withColumn("exported", F.coalesce("exported", F.lit(0)))
    gap = F.col("api_requests") - F.col("exported")
    status = (
        F.when(~F.col("whole"), "partial_day").when(F.col("api_requests").isNull(), "daily_counts_missing")
        .when(gap < 0, "excess_rows").when(gap > 0, "missing_rows").otherwise("matched")
    )
    return d.select("day", "exported", "api_requests", status.alias("status"))


def provider_coverage(rows: DataFrame, mapping: DataFrame, counts: DataFrame) -> DataFrame:
    """Logged requests against provider counts by day, provider and model, after mapping.

    ``rows``: day, source_provider, source_model. ``mapping``: source pair to
    provider pair; a pair that is not listed falls back to 'provider/model' names
    that are already qualified. ``counts``: day, provider, provider_model,
    requests. Either side may be missing (full outer join of two aggregates).
    """
    logged = rows.groupBy("day", "source_provider", "source_model").agg(F.count(F.lit(1)).alias("logged"))
    m = logged.join(mapping, ["source_provider", "source_model"], "left")
    parts = F.split("source_model", "/", 2)
    exact = F.size(parts) == 2
    m = m.select(
        "day", F.coalesce("provider", F.when(exact, parts[0])).alias("provider"), F.coalesce("provider_model", F.when(exact, F.get(parts, F.lit(1)))).alias("provider_model"), "logged"
    )
    mapped = m.groupBy("day", "provider", "provider_model").agg(F.sum("logged").cast("bigint").alias("logged"))
    same = lambda c: mapped[c].eqNullSafe(counts[c])
    j = mapped.join(counts, same("day") & same("provider") & same("provider_model"), "full_outer")
    either = lambda c: F.coalesce(mapped[c], counts[c]).alias(c)
    diff = F.col("requests") - F.coalesce(F.col("logged"), F.lit(0))
    status = (
        F.when(F.col("logged").isNotNull() & mapped["provider"].isNull(), "unmapped_model").when(F.col("requests").isNull() & F.col("seen").isNull(), "provider_counts_missing")
        .when(F.col("requests").isNull(), "request_count_unavailable").when(diff > 0, "fewer_logged").when(diff < 0, "more_logged").otherwise("matched")
    )
    return j.select(either("day"), either("provider"), either("provider_model"), F.coalesce("logged", F.lit(0)).alias("logged"), "requests", status.alias("status"))


def interval_coverage(intervals: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Time covered, gaps and islands of the intervals of each key (gaps and islands).

    Intervals that overlap or touch are one island. Null bounds and empty
    intervals are left out.
    """
    x = intervals.filter(F.col(start).isNotNull() & (F.col(end) > F.col(start))).select(F.col(key).alias("owner"), F.col(start).alias("s"), F.col(end).alias("e"))
    # Steps +1 and -1 per instant, summed first: an island begins where the running sum leaves 0.
    steps = x.select("owner", F.explode(F.array(F.struct(F.col("s").alias("at"), F.lit(1).alias("step")), F.struct(F.col("e").alias("at"), F.lit(-1).alias("step")))).alias("p"))
    steps = steps.select("owner", "p.at", "p.step").groupBy("owner", "at").agg(F.sum("step").alias("step"))
    w = Window.partitionBy("owner").orderBy("at")
    run = steps.withColumn("open", F.sum("step").over(w)).withColumn("until", F.lead("at").over(w)).withColumn("was", F.lag("open", 1, 0).over(w))
    seconds = F.unix_seconds(F.col("until").cast("timestamp")) - F.unix_seconds(F.col("at").cast("timestamp"))
    opens = (F.col("open") > 0) & (F.coalesce(F.col("was"), F.lit(0)) == 0)
    return run.groupBy("owner").agg(
        F.count_if(opens).alias("islands"), F.coalesce(F.sum(F.when(F.col("open") > 0, seconds)), F.lit(0)).cast("bigint").alias("covered_seconds"),
        F.coalesce(F.sum(F.when((F.col("open") == 0) & F.col("until").isNotNull(), seconds)), F.lit(0)).cast("bigint").alias("gap_seconds"),
        F.min("at").alias("first"), F.max("at").alias("last"),
    ).withColumn("gaps", F.col("islands") - 1)


def interval_gaps(intervals: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Gaps of a schedule: intervals that begin after all before them have ended (running maximum)."""
    x = intervals.filter(F.col(start).isNotNull() & F.col(end).isNotNull()).select(F.col(key).alias("owner"), F.col(start).alias("s"), F.col(end).alias("e"))
    w = Window.partitionBy("owner").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    return x.withColumn("until", F.max("e").over(w)).filter(F.col("until") < F.col("s")).select("owner", F.col("until").alias("gap_start"), F.col("s").alias("gap_end"))
