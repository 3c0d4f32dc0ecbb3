"""Two-period usage aggregates: windows, models, call types, movers, caches, failures.

Input is ``classified`` rows with a ``side`` (0 before, 1 after). Both sides come
out of one hash aggregation with conditional sums, so a comparison is one scan
and one shuffle of partial sums, never a join of two aggregates. Ties go to what
was seen first (the least row number).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.accounting import FLAGS, blank, empty, unsigned

#: Cells whose raw sums are reported.
RAW_CELLS = {"prompt": "prompt_tokens", "completion": "completion_tokens", "total": "total_tokens"}
DIMENSIONS = {"key": "api_key", "team": "team_id", "user": "user", "end_user": "end_user", "session": "session_id"}


def compared() -> Column:
    """Rows of either period."""
    return F.col("side") >= 0


def supported() -> Column:
    """Rows of call types that are analysed."""
    return F.col("operation").isNotNull()


def on(side: int, value: Column) -> Column:
    """``value`` on one side, null elsewhere."""
    return F.when(F.col("side") == side, value)


def total_on(side: int, value: Column, kind: str = "bigint") -> Column:
    return F.coalesce(F.sum(on(side, value)), F.lit(0)).cast(kind)


def windows(rows: DataFrame) -> DataFrame:
    """Totals of each side over supported calls."""
    sums = {n: F.coalesce(F.sum(n), F.lit(0)).cast("bigint") for n in ("input", "output", "cache_read", "cache_write", "reasoning", "total")}
    return rows.filter(compared() & supported()).groupBy("side").agg(
        F.count(F.lit(1)).alias("requests"), *[c.alias(f"{n}_tokens") for n, c in sums.items()],
        F.coalesce(F.sum("amount"), F.lit(0)).cast("decimal(38,6)").alias("spend"),
    )


def quality(rows: DataFrame) -> DataFrame:
    """How many rows of each side carry each quality flag."""
    return rows.filter(compared() & supported()).groupBy("side").agg(*[F.sum(f).cast("bigint").alias(f) for f in FLAGS])


def levels(rows: DataFrame) -> DataFrame:
    """Observation levels of each side; levels that are not known count as 'unknown'."""
    known = F.when(F.col("level").isin("DEFAULT", "DEBUG", "WARNING", "ERROR"), F.col("level")).otherwise("unknown")
    return rows.filter(compared() & supported() & ~empty(F.col("level"))).groupBy("side", known.alias("level")).agg(F.count(F.lit(1)).alias("n"))


def by_model(rows: DataFrame) -> DataFrame:
    """Requests and tokens of each model on both sides with their change, the largest change first."""
    g = rows.filter(compared() & supported()).groupBy("model").agg(
        total_on(0, F.lit(1)).alias("requests_before"), total_on(1, F.lit(1)).alias("requests_after"),
        total_on(0, F.col("total")).alias("tokens_before"), total_on(1, F.col("total")).alias("tokens_after"), F.min("row_number").alias("first_seen"),
    )
    g = g.withColumn("token_change", F.col("tokens_after") - F.col("tokens_before"))
    order = Window.orderBy(F.desc("token_change"), "first_seen")  # over models, which are few
    return g.withColumn("place", F.row_number().over(order))


def volume_split(rows: DataFrame) -> DataFrame:
    """The token change as an effect of request numbers and one of request sizes, over all
    and for each model (null ``model`` with ``over_all``); effects are null where a side has
    no request, and everywhere if any compared row is unclear or of unknown status."""
    x = rows.filter(compared() & supported())
    n = lambda s: F.nullif(F.sum(on(s, F.lit(1))).cast("double"), F.lit(0.0))
    t = lambda s: F.sum(on(s, F.col("total"))).cast("double")
    g = x.rollup("model").agg(F.grouping("model").cast("int").alias("over_all"), n(0).alias("n0"), n(1).alias("n1"), t(0).alias("t0"), t(1).alias("t1"), F.sum(F.col("unclear") + F.col("unknown_status")).alias("doubt"))
    gate = x.agg(F.coalesce(F.sum(F.col("unclear") + F.col("unknown_status")), F.lit(0)).alias("all_doubt"))
    g = g.withColumn("one", F.lit(1)).join(F.broadcast(gate.withColumn("one", F.lit(1))), "one")  # a single row
    clear = F.col("all_doubt") == 0
    p0, p1 = F.col("t0") / F.col("n0"), F.col("t1") / F.col("n1")
    return g.filter("over_all = 0 or n0 is not null or n1 is not null").select(
        "model", "over_all", F.when(clear, F.round((F.col("n1") - F.col("n0")) * (p0 + p1) / 2, 4)).alias("request_effect"), F.when(clear, F.round((p1 - p0) * (F.col("n0") + F.col("n1")) / 2, 4)).alias("size_effect")
    )


def call_types(rows: DataFrame) -> DataFrame:
    """Raw sums of every call type, also of those that are not analysed; a sum that overflows is null and said so."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for n, c in RAW_CELLS.items():
        value = unsigned(F.col(c))
        aggs += [
            F.try_sum(value).alias(f"{n}_sum"), (F.try_sum(value).isNull() & (F.count(value) > 0)).alias(f"{n}_overflow"),
            F.count_if(~empty(F.col(c)) & value.isNull()).alias(f"{n}_invalid"), F.count_if(empty(F.col(c))).alias(f"{n}_missing"),
        ]
    return rows.filter(compared()).groupBy("call_type", "side").agg(*aggs)


def duplicates(rows: DataFrame) -> DataFrame:
    """Request ids that occur more than once, whatever their period."""
    return rows.groupBy("request_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def _weights(rows: DataFrame, column: str, weight: Column) -> DataFrame:
    keyed = rows.filter(compared() & supported() & ~blank(F.col(column)) & (F.col("missing") == 0))
    return keyed.groupBy(F.col(column).alias("member")).agg(
        total_on(0, weight).alias("before"), total_on(1, weight).alias("after"), F.min("row_number").alias("first_seen")
    )


def movers(rows: DataFrame, dimension: str, top: int = 20) -> DataFrame:
    """The ``top`` members of a dimension by absolute change of tokens."""
    w = _weights(rows, DIMENSIONS[dimension], F.col("total")).withColumn("change", F.col("after") - F.col("before"))
    direction = F.when(F.col("change") > 0, "increased").when(F.col("change") < 0, "decreased").otherwise("unchanged")
    return w.withColumn("direction", direction).orderBy(F.desc(F.abs("change")), "first_seen").limit(top)


def largest(rows: DataFrame, dimension: str, top: int = 20) -> DataFrame:
    """The ``top`` members of a dimension by tokens of the second period."""
    return _weights(rows, DIMENSIONS[dimension], F.col("total")).orderBy(F.desc("after"), "first_seen").limit(top)


def uncached_movers(rows: DataFrame, dimension: str, top: int = 20) -> DataFrame:
    """Members whose uncached input grew, by growth."""
    uncached = F.when(F.col("cache_read").isNotNull() & F.col("input").isNotNull(), F.col("input") - F.col("cache_read"))
    w = _weights(rows, DIMENSIONS[dimension], uncached).withColumn("change", F.col("after") - F.col("before"))
    return w.filter("change > 0").orderBy(F.desc("change"), "first_seen").limit(top)


def concentration(rows: DataFrame, dimension: str) -> DataFrame:
    """What the two largest increases hold of the net change (it may exceed 1)."""
    w = _weights(rows, DIMENSIONS[dimension], F.col("total")).withColumn("change", F.col("after") - F.col("before"))
    two = w.filter("change > 0").orderBy(F.desc("change"), "first_seen").limit(2).agg(F.count(F.lit(1)).alias("members"), F.coalesce(F.sum("change"), F.lit(0)).cast("bigint").alias("increase"))
    net = w.agg(F.coalesce(F.sum("change"), F.lit(0)).cast("bigint").alias("net"))
    both = two.withColumn("one", F.lit(1)).join(net.withColumn("one", F.lit(1)), "one").drop("one")  # one row each
    return both.withColumn("share", F.when(F.col("net") > 0, F.round(F.col("increase") / F.col("net"), 9)))


def distinct_groups(rows: DataFrame, exact: bool = True) -> DataFrame:
    """Distinct members of each dimension on both sides, exactly or by HyperLogLog."""
    named = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(c).alias("member")) for d, c in DIMENSIONS.items()])).alias("x")
    x = rows.filter(compared() & supported()).select("side", named).select("side", "x.dimension", "x.member").filter(~blank(F.col("member")))
    if exact:
        return x.distinct().groupBy("dimension", "side").agg(F.count(F.lit(1)).alias("members"))
    return x.groupBy("dimension", "side").agg(F.approx_count_distinct("member", 0.008).alias("members"))


def cache_windows(rows: DataFrame) -> DataFrame:
    """Cache reads against the input of the same rows: rows without a valid count are set apart as missing or invalid."""
    known = F.col("input").isNotNull() & F.col("cache_read").isNotNull() & (F.col("cache_read") <= F.col("input"))
    absent = empty(F.col("cache_read_input_tokens"))
    return rows.filter(compared() & supported()).groupBy("side").agg(
        F.count_if(known).alias("covered"), F.count_if(~known & absent).alias("missing"), F.count_if(~known & ~absent).alias("invalid"),
        F.coalesce(F.sum(F.when(known, F.col("input"))), F.lit(0)).cast("bigint").alias("input_tokens"),
        F.coalesce(F.sum(F.when(known, F.col("cache_read"))), F.lit(0)).cast("bigint").alias("read_tokens"),
    ).withColumn("uncached_tokens", F.col("input_tokens") - F.col("read_tokens")).withColumn("read_share", F.round(F.col("read_tokens") / F.nullif("input_tokens", F.lit(0)), 9))


def failure_tokens(rows: DataFrame) -> DataFrame:
    """Tokens of failed rows and of rows at level ERROR; no row where there are none."""
    kinds = F.explode(F.array_compact(F.array(F.when(F.col("failed") == 1, "failed"), F.when(F.col("error_level") == 1, "error"))))
    return rows.filter(compared() & supported() & (F.col("total") > 0)).select("side", kinds.alias("kind"), "input", "output", "total").groupBy("side", "kind").agg(
        F.count(F.lit(1)).alias("records"), F.coalesce(F.sum("input"), F.lit(0)).cast("bigint").alias("input_tokens"),
        F.coalesce(F.sum("output"), F.lit(0)).cast("bigint").alias("output_tokens"), F.sum("total").cast("bigint").alias("total_tokens"),
    )


def scope_counts(rows: DataFrame, column: str, wanted: str) -> DataFrame:
    """Rows of each side that match a scope, surely do not, or may (no identity)."""
    state = F.when(blank(F.col(column)), "unknown").when(F.col(column) == wanted, "matched").otherwise("other")
    return rows.filter(compared()).groupBy("side", state.alias("scope")).agg(F.count(F.lit(1)).alias("n"))


def scoped(rows: DataFrame, column: str, wanted: str) -> DataFrame:
    """The rows of a scope. ``rows`` keep all calls for :func:`scope_counts`, which tells what
    the selection leaves out and what it cannot place."""
    value = F.col(column)
    return rows.filter(value.isNotNull() & (value == wanted))


def contributor_excess(rows: DataFrame, dimension: str, top: int = 20) -> DataFrame:
    """What members hold beyond their former share of the total: after - before * T1 / T0, exact to 6 places."""
    w = _weights(rows, DIMENSIONS[dimension], F.col("total"))
    sums = w.agg(F.sum("before").cast("bigint"), F.sum("after").cast("bigint")).first()
    t0, t1 = sums[0] or 0, sums[1] or 0
    if not t0:
        return w.limit(0).withColumn("excess", F.lit(None).cast("decimal(38,6)"))
    scaled = (F.col("after").cast("decimal(19,0)") * F.lit(t0).cast("decimal(19,0)") - F.col("before").cast("decimal(19,0)") * F.lit(t1).cast("decimal(19,0)")).cast("decimal(38,0)")
    excess = (scaled / F.lit(t0).cast("decimal(19,0)")).cast("decimal(38,6)")
    return w.withColumn("excess", excess).orderBy(F.desc(F.abs("excess")), "first_seen").limit(top)


def daily_sketches(rows: DataFrame, column: str) -> DataFrame:
    """A mergeable HyperLogLog sketch of the members of each day."""
    x = rows.filter(F.col("start_time").isNotNull() & ~blank(F.col(column)))
    return x.groupBy(F.to_date("start_time").alias("day")).agg(F.hll_sketch_agg(column, 14).alias("sketch"))


def merged_sketches(sketches: DataFrame, period: Column) -> DataFrame:
    """Distinct members of longer periods out of daily sketches (relative error about 0.8 %)."""
    return sketches.groupBy(period.alias("period")).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("members"), F.count(F.lit(1)).alias("days"))


def attribution_coverage(rows: DataFrame) -> DataFrame:
    """Rows with and without each identity, by call type and over all (ROLLUP)."""
    named = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), (~blank(F.col(c))).alias("known")) for d, c in DIMENSIONS.items()])).alias("x")
    x = rows.filter(compared()).select("call_type", named).select("x.dimension", "call_type", "x.known")
    g = x.rollup("dimension", "call_type").agg(F.grouping("dimension").alias("g"), F.grouping("call_type").cast("int").alias("all_types"), F.count_if("known").alias("known"), F.count_if(~F.col("known")).alias("unknown"))
    return g.filter("g = 0").drop("g")
