"""Small statistics over pairs and shares, and lookups in tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the normal quantile of 95 % intervals.
Z95 = 1.959963984540054


def geometric_ratio(pairs: DataFrame, source: str, target: str, keys: list[str]) -> DataFrame:
    """Geometric mean of target / source with a 95 % interval (normal, on logarithms)."""
    x = pairs.filter((F.col(source) > 0) & (F.col(target) > 0)).withColumn("r", F.ln(F.col(target) / F.col(source)))
    g = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("m"), F.stddev_samp("r").alias("s"))
    half = F.lit(Z95) * F.col("s") / F.sqrt("n")
    return g.select(*keys, "n", F.round(F.exp("m"), 6).alias("ratio"), F.round(F.exp(F.col("m") - half), 6).alias("low"), F.round(F.exp(F.col("m") + half), 6).alias("high"))


def paired(rows: DataFrame, keys: list[str], kind: str, source: str, target: str, value: str) -> DataFrame:
    """Means of ``value`` of two kinds side by side: a self join on ``keys`` as one conditional aggregation."""
    both = rows.filter(F.col(kind).isin(source, target)).groupBy(*keys).agg(
        F.avg(F.when(F.col(kind) == source, F.col(value))).alias("source"), F.avg(F.when(F.col(kind) == target, F.col(value))).alias("target")
    )
    return both.filter("source is not null and target is not null")


def wilson(hits: Column, n: Column) -> tuple[Column, Column]:
    """Wilson 95 % interval of hits out of n; null of nothing."""
    z2 = Z95 * Z95
    m = F.nullif(n.cast("double"), F.lit(0.0))
    p = hits / m
    centre = (p + z2 / (2 * m)) / (1 + z2 / m)
    half = Z95 * F.sqrt(p * (1 - p) / m + z2 / (4 * m * m)) / (1 + z2 / m)
    return centre - half, centre + half


def first_tier(rows: DataFrame, tiers: DataFrame, keys: list[str], size: str) -> DataFrame:
    """``rows`` with ``tier``, the first tier of its ``keys`` whose limit reaches ``size`` (a null limit reaches all).

    Tiers of a key are few and become one sorted array, so the range join is an
    equi join and a search in the array; rows without key or tier have null.
    """
    packed = tiers.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("tier_no", "max_size"))).alias("tiers"))
    x = rows.join(packed, keys, "left")
    return x.withColumn("tier", F.get(F.filter("tiers", lambda t: t["max_size"].isNull() | (F.col(size) <= t["max_size"])), F.lit(0))["tier_no"]).drop("tiers")
