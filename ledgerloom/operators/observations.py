"""Observation exports: usage components, the mapping to usage rows, copies that disagree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import fold

#: Members of ``usage_details`` by the count they stand for.
MEMBERS = {
    "input": "input", "output": "output", "input_cached_tokens": "cache_read", "input_cache_creation": "cache_write",
    "output_reasoning_tokens": "reasoning", "total": "stated_total",
}


def components(observations: DataFrame) -> DataFrame:
    """Observations with their disjoint components and inclusive counts.

    Inclusive input counts cached tokens, inclusive output reasoning tokens; a
    component that is absent is 0 once any is there, and the counts are null
    where the map is null or empty. ``unknown_members`` counts members that stand
    for no count.
    """
    part = {n: F.try_element_at("usage_details", F.lit(m)) for m, n in MEMBERS.items()}
    x = observations.withColumns(part)
    known = F.coalesce(*[F.col(n) for n in MEMBERS.values()]).isNotNull()
    zero = F.lit(0).cast("bigint")
    add = lambda *names: F.when(known, sum((F.coalesce(n, zero) for n in names[1:]), F.coalesce(names[0], zero)))
    x = x.withColumns({"prompt": add("input", "cache_read", "cache_write"), "completion": add("output", "reasoning")})
    others = F.size(F.filter(F.map_keys("usage_details"), lambda k: ~k.isin(*MEMBERS)))
    return x.withColumn("unknown_members", F.when(F.col("usage_details").isNull(), 0).otherwise(others))


def usage_rows(observations: DataFrame) -> DataFrame:
    """Canonical usage rows (cells as text) of observations, one for each message: generations
    are calls to a model, other types are not analysed. Counts include their parts; a count
    below 0 is 'invalid'. ``request_id`` is a digest of project and id; identities are those of
    the project. Times are not looked at here (``start_time`` and ``end_time`` stay as they are).
    """
    x = components(observations)
    bad = F.exists(F.map_values("usage_details"), lambda v: v < 0)
    text = lambda c: F.when(F.coalesce(bad, F.lit(False)), "invalid").otherwise(F.col(c).cast("string"))
    generation = F.col("type") == "GENERATION"
    cell = lambda c: F.when(generation, text(c))
    framed = F.concat(F.length("project_id").cast("string"), F.lit(":"), "project_id", F.length("id").cast("string"), F.lit(":"), "id")  # no two pairs share a text
    return x.select(
        F.sha2(framed, 256).alias("request_id"), F.when(generation, "completion").otherwise("observation_other").alias("call_type"), "start_time", "end_time", F.lit("").alias("status"), F.coalesce("level", F.lit("")).alias("level"),
        F.col("project_id").alias("api_key"), F.col("user_id").alias("user"), F.lit(None).cast("string").alias("team_id"), F.lit(None).cast("string").alias("end_user"), "session_id", F.col("provided_model_name").alias("model"),
        cell("prompt").alias("prompt_tokens"), cell("completion").alias("completion_tokens"), cell("stated_total").alias("total_tokens"), cell("cache_read").alias("cache_read_input_tokens"),
        cell("cache_write").alias("cache_write_input_tokens"), cell("reasoning").alias("reasoning_output_tokens"), F.when(generation, F.col("total_cost").cast("decimal(38,12)").cast("string")).alias("spend"),
    )


def report(observations: DataFrame) -> DataFrame:
    """Component sums and completeness of each project."""
    x = components(observations)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return x.groupBy(fold(F.col("project_id")).alias("project")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("prompt").isNull()).alias("without_usage"), total("prompt").alias("prompt_tokens"), total("completion").alias("completion_tokens"),
        total("cache_read").alias("cache_read_tokens"), total("unknown_members").alias("unknown_members"),
        F.count_if(F.col("stated_total") != F.col("prompt") + F.col("completion")).alias("total_mismatch"), F.count_if(F.col("total_cost").isNull()).alias("without_cost"),
        F.count_if(F.col("level") == "ERROR").alias("errors"),
    )


def member_counts(observations: DataFrame) -> DataFrame:
    """How often each member of ``usage_details`` occurs, and its sum."""
    x = observations.select(F.explode("usage_details").alias("member", "value"))
    return x.groupBy("member").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("value"), F.lit(0)).cast("bigint").alias("tokens"))


def disagreements(observations: DataFrame, fields: list[str]) -> DataFrame:
    """Messages delivered more than once, with the fields in which their copies differ."""
    x = observations.filter(F.col("id").isNotNull()).select(fold(F.col("project_id")).alias("project"), fold(F.col("id")).alias("message"), *fields)
    # Least and greatest value and whether any is null: fixed-size state, so copies are reduced within map tasks.
    aggs = [F.count(F.lit(1)).alias("copies")]
    for f in fields:
        aggs += [F.min(f).alias(f"min_{f}"), F.max(f).alias(f"max_{f}"), F.count(f).alias(f"held_{f}")]
    g = x.groupBy("project", "message").agg(*aggs).filter("copies > 1")
    differs = [F.when((F.col(f"min_{f}") != F.col(f"max_{f}")) | ((F.col(f"held_{f}") > 0) & (F.col(f"held_{f}") < F.col("copies"))), f) for f in fields]
    g = g.select("project", "message", "copies", F.array_compact(F.array(*differs)).alias("d")).filter(F.size("d") > 0)
    return g.select("project", "message", "copies", F.array_join("d", ",").alias("fields"))


def tag_sets(observations: DataFrame) -> DataFrame:
    """Sets of tags, sorted and without repeats, with their frequency."""
    tags = F.array_join(F.array_sort(F.array_distinct(F.array_compact("tags"))), "|")
    return observations.filter(F.col("tags").isNotNull()).groupBy(tags.alias("tags")).agg(F.count(F.lit(1)).alias("n"))


def label_cardinality(rows: DataFrame, labels: list[str]) -> DataFrame:
    """Rows and distinct values of each label column, in one pass."""
    x = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).cast("string").alias("value")) for c in labels])).alias("x")).select("x.*").filter("value is not null")
    return x.groupBy("label", "value").agg(F.count(F.lit(1)).alias("n")).groupBy("label").agg(F.sum("n").cast("bigint").alias("n"), F.count(F.lit(1)).alias("distinct_values"), F.max("n").alias("most"))
