"""Logged requests against a provider's own counts: mapping, comparison by day and model, what may be compared.

The provider's counts come with a contract that says which population they
cover, in which units, and when they were retrieved; it decides which days are
settled and which differences mean anything.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.accounting import unsigned

#: What a contract may say of a part of the population, and the bases of its counts.
STATES = ("matched", "unverified", "mismatch")
BASES = ("bedrock_invocations", "openai_model_requests", "primary_requests", "tokens_only")


@dataclass(frozen=True)
class Contract:
    """What is known of a provider's counts (times are naive UTC, the period whole days)."""

    start: datetime
    end: datetime
    retrieved: datetime
    complete: bool
    population: tuple[str, ...]
    basis: str
    counting_units: bool
    token_units: bool
    margin_seconds: int = 0

    @property
    def population_status(self) -> str:
        """matched, population_unverified, population_mismatch or provider_export_incomplete."""
        if not self.complete:
            return "provider_export_incomplete"
        if "mismatch" in self.population:
            return "population_mismatch"
        return "population_unverified" if "unverified" in self.population else "matched"


def logged(rows: DataFrame, mapping: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows, failures and tokens by day and provider model, in the provider's names.

    ``rows``: day, source_provider, source_model, status, prompt_tokens, completion_tokens
    (text). A pair the mapping lists takes its target; else a name 'provider/model' of the
    row's own provider that the counts list; else it stays as it
    is and counts as unmapped. Token sums are null where a cell of theirs is no count.
    """
    cells = {"input": unsigned(F.col("prompt_tokens")), "output": unsigned(F.col("completion_tokens"))}
    g = rows.groupBy("day", "source_provider", "source_model").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("status") == "failure").alias("failed"),
        F.count_if(F.col("status").isNull() | ~F.col("status").isin("success", "failure")).alias("unknown_status"),
        *[F.sum(v).alias(f"{n}_sum") for n, v in cells.items()], *[F.count_if(v.isNull()).alias(f"{n}_gaps") for n, v in cells.items()],
    )
    listed = mapping.select("source_provider", "source_model", F.col("provider").alias("to_provider"), F.col("provider_model").alias("to_model"))
    targets = counts.select("provider", "provider_model").distinct().withColumn("known", F.lit(True))
    cut = F.instr("source_model", "/")
    prefix, rest = F.expr("substr(source_model, 1, instr(source_model, '/') - 1)"), F.expr("substr(source_model, instr(source_model, '/') + 1)")
    own = (cut > 1) & (prefix == F.col("source_provider"))
    x = g.join(listed, ["source_provider", "source_model"], "left").withColumn("own_provider", F.when(own, prefix)).withColumn("own_model", F.when(own, rest))
    x = x.join(targets, (F.col("own_provider") == F.col("provider")) & (F.col("own_model") == F.col("provider_model")), "left").drop("provider", "provider_model")
    mapped = F.col("to_provider").isNotNull() | F.col("known").isNotNull()
    x = x.select(
        "day", mapped.alias("mapped"), F.coalesce("to_provider", F.when(F.col("known"), F.col("own_provider")), "source_provider").alias("provider"),
        F.coalesce("to_model", F.when(F.col("known"), F.col("own_model")), "source_model").alias("provider_model"), "rows", "failed", "unknown_status",
        *[c for n in cells for c in (f"{n}_sum", f"{n}_gaps")],
    )
    total = lambda c: F.sum(c).cast("bigint").alias(c)
    tokens = [F.when(F.sum(f"{n}_gaps") == 0, F.sum(f"{n}_sum")).cast("bigint").alias(f"logged_{n}") for n in cells]
    return x.groupBy("day", "mapped", "provider", "provider_model").agg(total("rows"), total("failed"), total("unknown_status"), *tokens)


def compared(rows: DataFrame, mapping: DataFrame, counts: DataFrame, periods: list[tuple[datetime, datetime]], contract: Contract | None, now: datetime) -> DataFrame:
    """A row for each day and provider model that either side has, within ``periods``.

    ``counts``: day, provider, provider_model, requests, input_tokens, output_tokens (null
    where the provider gives none). The status of a day that is not whole within a
    period or not settled, and of a population that does not match, stands before that of
    the counts. Differences (provider less logged) are given where they mean something;
    tokens only where no row of the day is unmapped.
    """
    inside = F.lit(False)
    whole = F.lit(False)
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    first, last = F.col("day").cast("timestamp_ntz"), F.date_add("day", 1).cast("timestamp_ntz")
    for start, end in periods:
        inside = inside | ((first < at(end)) & (last > at(start)))
        whole = whole | ((first >= at(start)) & (last <= at(end)))
    today = now.replace(hour=0, minute=0, second=0, microsecond=0)
    settled = last <= at(today)
    if contract is not None:
        settled = settled & (last <= at(contract.retrieved - timedelta(seconds=contract.margin_seconds)))
    population = "no_contract" if contract is None else contract.population_status
    a = logged(rows, mapping, counts)
    names = ["day", "provider", "provider_model"]
    b = counts.select(*[F.col(c).alias(f"b_{c}") for c in names], F.lit(True).alias("b_mapped"), "requests", F.col("input_tokens").alias("provider_input"), F.col("output_tokens").alias("provider_output"))
    same = a["mapped"] & b["b_mapped"]
    for c in names:
        same = same & a[c].eqNullSafe(b[f"b_{c}"])
    j = a.join(b, same, "full_outer").select(
        *[F.coalesce(c, f"b_{c}").alias(c) for c in names], F.coalesce("mapped", "b_mapped").alias("mapped"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("rows", "failed", "unknown_status")],
        *[F.when(F.col("rows").isNull(), F.lit(0)).otherwise(F.col(f"logged_{n}")).cast("bigint").alias(f"logged_{n}") for n in ("input", "output")],
        F.col("b_mapped").isNotNull().alias("counted"), "requests", "provider_input", "provider_output",
    ).filter(inside)
    day = F.when(~whole, "partial_day").when(~settled, "unsettled_day").otherwise("complete_day")
    difference = F.col("requests") - F.col("rows")
    plain = (
        F.when(~F.col("mapped"), "unmapped_spend_model").when(~F.col("counted"), "provider_counts_missing").when(F.col("requests").isNull(), "request_count_unavailable")
        .when(difference > 0, "provider_exceeds_logged_rows").when(difference < 0, "logged_rows_exceed_provider").otherwise("matched")
    )
    blocked = population in ("population_mismatch", "provider_export_incomplete")
    matched = population == "matched"
    whole_day = F.col("day_status") == "complete_day"
    j = j.withColumn("day_status", day)
    unmapped = j.groupBy("day").agg(F.sum(F.when(~F.col("mapped"), F.col("rows")).otherwise(0)).alias("unmapped_rows"))
    j = j.join(unmapped, "day")
    clear = F.col("unmapped_rows") == 0
    status = F.when(~whole_day, F.col("day_status")).when(F.lit(blocked), population).otherwise(plain)
    shown = F.when(whole_day & ~F.lit(blocked), difference)
    may = whole_day & F.lit(matched and contract.counting_units) if contract else F.lit(False)
    tokens = whole_day & F.lit(bool(contract and matched and contract.token_units)) & clear
    return j.select(
        "day", "provider", "provider_model", "rows", "failed", "unknown_status", "requests", status.alias("status"), shown.cast("bigint").alias("request_difference"),
        (may & shown.isNotNull() & clear).alias("comparable"),
        *[F.when(tokens, F.col(f"provider_{n}") - F.col(f"logged_{n}")).cast("bigint").alias(f"{n}_difference") for n in ("input", "output")],
    )
