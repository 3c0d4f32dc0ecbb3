"""Routing and agent attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.accounting import PLACEHOLDERS, empty, unsigned
from ledgerloom.functions.text import strip
from ledgerloom.operators.usage import RAW_CELLS, compared, supported, total_on

#: The call type that is passed through, and the mark of a router's own calls.
PASS_THROUGH, CLASSIFIER = "pass_through_endpoint", "autorouter_classifier"

#: Routing fields, those that name a model (whose placeholders are invalid), and the most bytes of a cell.
FIELDS = ("agent_id", "route", "attempted_fallbacks", "model", "model_id", "internal_call_origin")
MODEL_FIELDS = ("model", "model_id")
MOST_BYTES = 8192


def text_state(col: Column) -> Column:
    """known, absent (null), empty (or blank) or invalid (over :data:`MOST_BYTES`)."""
    return F.when(col.isNull(), "absent").when(F.octet_length(col) > MOST_BYTES, "invalid").when(strip(col) == "", "empty").otherwise("known")


def model_state(col: Column) -> Column:
    """:func:`text_state`, where names that stand for no model are invalid."""
    state = text_state(col)
    return F.when((state == "known") & strip(col).isin(*PLACEHOLDERS), "invalid").otherwise(state)


def fallback_cell(col: Column) -> Column:
    """:func:`text_state`, where what is no whole number is invalid."""
    state = text_state(col)
    return F.when((state == "known") & unsigned(col).isNull(), "invalid").otherwise(state)


def fallback_state(col: Column) -> Column:
    """none, some or unknown fallbacks."""
    n = unsigned(col)
    return F.when(n.isNull(), "unknown").when(n == 0, "none").otherwise("some")


def field_state(name: str) -> Column:
    return (model_state if name in MODEL_FIELDS else fallback_cell if name == "attempted_fallbacks" else text_state)(F.col(name))


def selected_model() -> Column:
    """The model of a row; null unless both it and its deployment are named."""
    return F.when((model_state(F.col("model")) == "known") & (model_state(F.col("model_id")) == "known"), F.col("model"))


def cohorts(rows: DataFrame) -> DataFrame:
    """Routing counts at three grains in one pass: all, route and agent, route, agent and model (GROUPING SETS)."""
    x = rows.filter(compared() & supported()).select(
        "side", "total", "row_number", "amount", fallback_state(F.col("attempted_fallbacks")).alias("fallbacks"),
        F.when(text_state(F.col("route")) == "known", F.col("route")).alias("route"), F.when(text_state(F.col("agent_id")) == "known", F.col("agent_id")).alias("agent"),
        selected_model().alias("chosen"),
    )
    keys = [F.col("route"), F.col("agent"), F.col("chosen")]
    return x.groupingSets([[], keys[:2], keys], *keys).agg(
        (F.lit(3) - F.grouping("route") - F.grouping("agent") - F.grouping("chosen")).cast("int").alias("grain"),
        total_on(0, F.lit(1)).alias("requests_before"), total_on(1, F.lit(1)).alias("requests_after"),
        total_on(0, F.col("total")).alias("tokens_before"), total_on(1, F.col("total")).alias("tokens_after"),
        F.count_if(F.col("fallbacks") == "some").alias("with_fallback"), F.count_if(F.col("fallbacks") == "unknown").alias("fallback_unknown"),
        F.coalesce(F.sum("amount"), F.lit(0)).cast("decimal(38,6)").alias("spend"), F.min("row_number").alias("first_seen"),
    )


def shares(rows: DataFrame) -> DataFrame:
    """What each chosen model holds of its cohort's requests and tokens, to 9 places; null of nothing."""
    c = cohorts(rows)
    cells = c.filter("grain = 3")
    w = Window.partitionBy("route", "agent")  # cells of a cohort: one for each model
    requests = F.col("requests_before") + F.col("requests_after")
    tokens = F.col("tokens_before") + F.col("tokens_after")
    part = lambda v: F.round(v / F.nullif(F.sum(v).over(w), F.lit(0)), 9)
    return cells.select("route", "agent", "chosen", part(requests).alias("request_share"), part(tokens).alias("token_share"))


def _places(rows: DataFrame, keys: list[str], order: list, top: int) -> DataFrame:
    """``rows`` with ``place``: 1 to ``top`` in an order, ``top + 1`` for all others. Only the first
    rows go into a window; the others are never sorted together."""
    first = rows.orderBy(*order).limit(top).select(*[F.col(k).alias(f"__{k}") for k in keys], F.row_number().over(Window.orderBy(*order)).alias("__place"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    placed = rows.join(first, same, "left").withColumn("place", F.coalesce("__place", F.lit(top + 1)))
    return placed.drop("__place", *[f"__{k}" for k in keys])


def remainder(rows: DataFrame, top: int = 5) -> DataFrame:
    """Cohorts in order of requests, those beyond ``top`` merged into one row."""
    c = cohorts(rows).filter("grain = 2")
    c = _places(c, ["route", "agent"], [F.desc(F.col("requests_before") + F.col("requests_after")), F.col("first_seen")], top)
    shown = F.col("place") <= top
    return c.groupBy("place").agg(
        F.max(F.when(shown, F.col("route"))).alias("route"), F.max(F.when(shown, F.col("agent"))).alias("agent"), F.count(F.lit(1)).alias("cohorts"),
        F.sum("requests_before").cast("bigint").alias("requests_before"), F.sum("requests_after").cast("bigint").alias("requests_after"),
    )


def field_coverage(rows: DataFrame) -> DataFrame:
    """States of the routing fields, over all calls and by call type (ROLLUP); call types
    that are neither analysed nor passed through count as 'unknown'."""
    kind = F.when(supported() | (F.col("call_type") == PASS_THROUGH), F.col("call_type")).otherwise("unknown")
    named = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), field_state(f).alias("state")) for f in FIELDS])).alias("x")
    x = rows.filter(compared()).select(kind.alias("call_type"), named).select("call_type", "x.field", "x.state")
    return x.groupBy("field", "state", "call_type").agg(F.count(F.lit(1)).alias("n")).rollup("field", "state", "call_type").agg(
        F.grouping("call_type").cast("int").alias("all_types"), F.sum("n").cast("bigint").alias("n"), F.grouping("state").alias("g")
    ).filter("g = 0").drop("g")


def overhead(rows: DataFrame) -> DataFrame:
    """Calls that are not analysed, of each side: those a router made to classify requests
    ('overhead') and all others, with raw sums of their cells; a sum that overflows is null."""
    marked = (F.col("call_type") == PASS_THROUGH) & (F.col("internal_call_origin") == CLASSIFIER)
    x = rows.filter(compared() & ~supported()).withColumn("kind", F.when(marked, "overhead").otherwise("other"))
    aggs = [F.count(F.lit(1)).alias("n")]
    for n, c in RAW_CELLS.items():
        value = unsigned(F.col(c))
        aggs += [F.try_sum(value).alias(f"{n}_sum"), F.count_if(~empty(F.col(c)) & value.isNull()).alias(f"{n}_invalid"), F.count_if(empty(F.col(c))).alias(f"{n}_missing")]
    spend = [F.coalesce(F.sum("amount"), F.lit(0)).cast("decimal(38,6)").alias("spend"), *[F.sum(f).cast("bigint").alias(f) for f in ("spend_missing", "spend_invalid", "spend_zero")]]
    return x.groupBy("side", "kind").agg(*aggs, *spend)


# Agents --------------------------------------------------------------------------


def tag_labels(tags: Column, prefix: str) -> Column:
    """Labels of a JSON array of tags that start with ``prefix``; null if it is no array of strings only."""
    parsed = F.try_variant_get(F.try_parse_json(tags), "$", "array<variant>")
    strings = F.forall(parsed, lambda v: F.schema_of_variant(v) == "STRING")
    texts = F.transform(parsed, lambda v: F.try_variant_get(v, "$", "string"))
    cut = F.transform(F.filter(texts, lambda t: F.startswith(t, F.lit(prefix))), lambda t: F.substr(t, F.lit(len(prefix) + 1)))
    return F.when(strings, F.array_sort(F.array_distinct(F.filter(cut, lambda t: F.trim(t) != ""))))


def by_agent_tag(rows: DataFrame, prefix: str = "agent:") -> DataFrame:
    """Rows of each side by what their tags say: one agent, several, or none known."""
    labels = tag_labels(F.col("request_tags"), prefix)
    x = rows.filter(compared() & supported()).select("side", "total", "request_tags", labels.alias("labels"))
    state = (
        F.when(empty(F.col("request_tags")), "absent").when(F.col("labels").isNull(), "invalid").when(F.size("labels") == 1, "known")
        .when(F.size("labels") > 1, "ambiguous").otherwise("unknown")
    )
    return x.groupBy("side", state.alias("state"), F.when(F.size("labels") == 1, F.col("labels")[0]).alias("agent")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("total").cast("bigint").alias("tokens")
    )


def by_agent(rows: DataFrame) -> DataFrame:
    """The exclusive partition of requests into agents and unknown."""
    agent = F.when(text_state(F.col("agent_id")) == "known", F.col("agent_id"))
    return rows.filter(compared() & supported()).groupBy(agent.alias("agent")).agg(
        total_on(0, F.lit(1)).alias("requests_before"), total_on(1, F.lit(1)).alias("requests_after"),
        total_on(0, F.col("total")).alias("tokens_before"), total_on(1, F.col("total")).alias("tokens_after"),
        F.sum(F.when(F.col("side") == 0, F.col("amount"))).cast("decimal(38,6)").alias("spend_before"),
        F.sum(F.when(F.col("side") == 1, F.col("amount"))).cast("decimal(38,6)").alias("spend_after"),
        F.count_if(F.col("amount").isNotNull()).alias("priced"), F.min("row_number").alias("first_seen"),
    )


def agents_by_spend(rows: DataFrame, top: int = 4) -> DataFrame:
    """Agents by change of spend (those without usable spend last), beyond ``top`` merged."""
    a = by_agent(rows).filter("agent is not null").withColumn("change", F.col("spend_after") - F.col("spend_before"))
    a = _places(a, ["agent"], [F.col("change").isNull(), F.desc("change"), F.col("first_seen")], top)
    return a.groupBy("place").agg(
        F.max(F.when(F.col("place") <= top, F.col("agent"))).alias("agent"), F.count(F.lit(1)).alias("agents"),
        F.sum("change").cast("decimal(38,6)").alias("spend_change"), F.sum("tokens_after").cast("bigint").alias("tokens_after"),
    )
