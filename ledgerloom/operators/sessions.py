"""Single-period review of sessions: rollups, nearest-rank quantiles, caps and clipping."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.accounting import empty
from ledgerloom.operators.usage import supported


def rollup(rows: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """One row for each literal session id of the period.

    Rejections count by themselves and add neither calls nor spend; calls that are
    not analysed make the spend incomplete. ``clipped``: the session also occurs
    outside the period. Sessions may be of any size: all state is partial sums.
    """
    within = (F.col("start_time") >= F.lit(start).cast("timestamp_ntz")) & (F.col("start_time") < F.lit(end).cast("timestamp_ntz"))
    rejected = ~empty(F.col("rejection_kind"))
    call = F.col("within") & ~rejected & supported()
    paid = call & (F.col("amount") > 0)
    x = rows.filter(~empty(F.col("session_id"))).withColumn("within", F.coalesce(within, F.lit(False)))
    members = lambda c: F.count_distinct(F.when(F.col("within") & ~empty(F.col(c)), F.col(c)))  # noqa: E731  planned as a second shuffled aggregate, not as a set in memory
    g = x.groupBy("session_id").agg(
        F.count_if(call).alias("calls"), F.count_if(F.col("within") & rejected).alias("rejections"), F.count_if(F.col("within") & ~rejected & ~supported()).alias("not_analysed"),
        F.coalesce(F.sum(F.when(call, F.col("total"))), F.lit(0)).cast("bigint").alias("tokens"),
        F.coalesce(F.sum(F.when(call, F.col("amount"))), F.lit(0)).cast("decimal(38,6)").alias("spend"),
        F.coalesce(F.sum(F.when(call, F.col("spend_missing") + F.col("spend_invalid"))), F.lit(0)).cast("bigint").alias("spend_unknown"),
        F.min(F.when(paid, F.col("start_time"))).alias("first_paid"), F.max(F.when(paid, F.col("start_time"))).alias("last_paid"),
        members("team_id").alias("teams"), F.max(~F.col("within")).alias("clipped"), F.count_if("within").alias("rows"), F.min(F.when(F.col("within"), F.col("row_number"))).alias("first_seen"),
    )
    return g.filter("rows > 0").withColumn("complete", (F.col("spend_unknown") == 0) & (F.col("not_analysed") == 0))


def automatic(rows: DataFrame, now: datetime | None = None) -> tuple[datetime, datetime] | None:
    """The whole days that the rows span, without the day of ``now`` (naive UTC) and later ones;
    where there is none, the observed span itself with its last instant. None without rows."""
    low, high = rows.agg(F.min("start_time"), F.max("start_time")).first()
    if low is None:
        return None
    midnight = lambda t: t.replace(hour=0, minute=0, second=0, microsecond=0)
    start = midnight(low) if low == midnight(low) else midnight(low) + timedelta(days=1)
    end = midnight(high) if now is None else min(midnight(high), midnight(now))
    if start < end:
        return start, end
    if now is not None and high > now:
        raise ValueError("the rows start in the future")
    return low, high + timedelta(microseconds=1)


def _within(rows: DataFrame, start: datetime, end: datetime) -> DataFrame:
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    return rows.filter((F.col("start_time") >= at(start)) & (F.col("start_time") < at(end)) & ~empty(F.col("session_id")))


def memberships(rows: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """``session_id, keys, teams, agents``: how many of each a session of the period was seen
    under; pairs are made distinct in a shuffled aggregation, not gathered."""
    kinds = {"keys": "api_key", "teams": "team_id", "agents": "agent_id"}
    pair = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("member")) for k, c in kinds.items()])).alias("x")
    x = _within(rows, start, end).select("session_id", pair).select("session_id", "x.kind", F.when(~empty(F.col("x.member")), F.col("x.member")).alias("member")).distinct()
    return x.groupBy("session_id").agg(*[F.count(F.when(F.col("kind") == k, F.col("member"))).alias(k) for k in kinds])


def activity(rows: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """``session_id, first_activity, last_activity, rejections`` (a map of kinds to counts), over
    all rows of a session in the period."""
    kind = F.when(~empty(F.col("rejection_kind")), F.col("rejection_kind"))
    g = _within(rows, start, end).groupBy("session_id", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min("start_time").alias("first"), F.max("start_time").alias("last"))
    entries = F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("kind", "n"))))  # kinds are few
    return g.groupBy("session_id").agg(F.min("first").alias("first_activity"), F.max("last").alias("last_activity"), F.map_from_entries(entries).alias("rejections"))


def rejection_totals(rows: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Recorded rejections of the period by kind, with the sessions they fell on."""
    x = _within(rows, start, end).filter(~empty(F.col("rejection_kind"))).groupBy("rejection_kind", "session_id").agg(F.count(F.lit(1)).alias("n"))
    return x.groupBy(F.col("rejection_kind").alias("kind")).agg(F.sum("n").cast("bigint").alias("n"), F.count(F.lit(1)).alias("sessions"))


def shared(sessions: DataFrame, members: DataFrame, top: int = 20) -> DataFrame:
    """The ``top`` sessions by spend that were seen under several keys, teams or agents."""
    several = members.filter("keys > 1 or teams > 1 or agents > 1")
    return sessions.select("session_id", "spend", "first_seen").join(several, "session_id").orderBy(F.desc("spend"), "first_seen").limit(top)


def long_spans(sessions: DataFrame, long_seconds: int, top: int = 20) -> DataFrame:
    """The ``top`` sessions by spend whose paid calls lie farther apart than a counter's window."""
    span = F.unix_micros(F.col("last_paid").cast("timestamp")) - F.unix_micros(F.col("first_paid").cast("timestamp"))
    x = sessions.select("session_id", "spend", F.floor(span / 1_000_000).cast("bigint").alias("seconds"), "first_seen").filter(span > long_seconds * 1_000_000)
    return x.orderBy(F.desc("spend"), "first_seen").limit(top)


def quantiles(sessions: DataFrame, shares: tuple[float, ...] = (0.5, 0.95, 1.0)) -> DataFrame:
    """Nearest-rank quantiles of the spend of complete sessions, exact decimals.

    Ranks come from counts of distinct amounts: they are summed along a range-
    partitioned order, bucket by bucket, so no task sorts all sessions.
    """
    values = sessions.filter("complete and calls > 0").groupBy("spend").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql.window import Window

    bucketed = values.withColumn("bucket", F.floor(F.log2(F.col("spend").cast("double") * 1_000_000 + 1) * 16).cast("int"))
    sums = bucketed.groupBy("bucket").agg(F.sum("n").alias("in_bucket"))
    sums = sums.withColumn("before", F.sum("in_bucket").over(Window.orderBy("bucket")) - F.col("in_bucket"))  # some hundreds of buckets
    sums = sums.withColumn("all", F.sum("in_bucket").over(Window.partitionBy()))
    inner = Window.partitionBy("bucket").orderBy("spend")
    ranked = bucketed.join(sums, "bucket").withColumn("high", F.col("before") + F.sum("n").over(inner)).withColumn("low", F.col("high") - F.col("n"))
    wanted = F.explode(F.array(*[F.lit(s) for s in shares]))
    hit = ranked.withColumn("share", wanted).withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("all"))))
    return hit.filter((F.col("rank") > F.col("low")) & (F.col("rank") <= F.col("high"))).select(F.col("share"), F.col("spend"), F.col("all").cast("bigint").alias("sessions"))


def summary(sessions: DataFrame, cap: float, long_seconds: int) -> DataFrame:
    """Second-level counts: singletons, rejection-only, censored, exceeding the cap (strictly), long spans, shared."""
    over = F.col("spend") > F.lit(str(cap)).cast("decimal(38,6)")
    span = F.unix_seconds(F.col("last_paid").cast("timestamp")) - F.unix_seconds(F.col("first_paid").cast("timestamp"))
    return sessions.agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("calls") == 1).alias("singletons"), F.count_if((F.col("calls") == 0) & (F.col("rejections") > 0)).alias("rejection_only"),
        F.count_if(F.col("rejections") > 0).alias("censored"), F.count_if(F.col("complete") & over).alias("exceeding"), F.count_if(~F.col("complete") & over).alias("partial_exceeding"),
        F.count_if(span > long_seconds).alias("long_spans"), F.count_if(F.col("teams") > 1).alias("shared"), F.count_if("clipped").alias("clipped"),
    )


def review(sessions: DataFrame, cap: float, top: int = 20) -> DataFrame:
    """The ``top`` sessions by spend that exceed the cap."""
    return sessions.filter(F.col("spend") > F.lit(str(cap)).cast("decimal(38,6)")).orderBy(F.desc("spend"), "first_seen").limit(top).select("session_id", "calls", "spend", "complete", "clipped", "first_seen")


def unattributed(rows: DataFrame) -> DataFrame:
    """Spend of supported rows without a session."""
    return rows.filter(supported() & empty(F.col("session_id"))).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("amount"), F.lit(0)).cast("decimal(38,6)").alias("spend"),
        F.coalesce(F.sum("spend_missing"), F.lit(0)).cast("bigint").alias("missing"), F.coalesce(F.sum("spend_invalid"), F.lit(0)).cast("bigint").alias("invalid"),
    )
