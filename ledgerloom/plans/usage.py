"""Queries of the usage operators over the driver tables, with DuckDB twins."""

from __future__ import annotations

from contextvars import ContextVar
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.accounting import COUNTS, FLAGS, classified
from ledgerloom.functions.accounting import SQL as CLASSIFIED
from ledgerloom.functions.text import sql_fold
from ledgerloom.operators import coverage, delivery, observations, periods, providers, questions, routing, scan, sessions, snapshots, stats, usage
from ledgerloom.operators.periods import SQL as SIDED
from ledgerloom.session import read
from ledgerloom.sources.adapters import EVENT_SQL, REQUEST_SQL, usage_from_events, usage_from_exports, usage_from_requests

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its DuckDB twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_WITH = f"WITH {EVENT_SQL}, {CLASSIFIED}, {SIDED}"
_HELD = "side >= 0 AND operation IS NOT NULL"


#: Whether the queries run over events or over exported requests.
_SOURCE: ContextVar[str] = ContextVar("source", default="events")


def _plain(spark: SparkSession, sf: str) -> DataFrame:
    if _SOURCE.get() == "requests":
        return usage_from_exports(read(spark, sf, "synthetic"))
    return usage_from_events(read(spark, sf, "events"))


def _classified(spark: SparkSession, sf: str) -> DataFrame:
    return classified(_plain(spark, sf))


@lru_cache(maxsize=64)
def _bounds(application: str, sf: str, source: str):
    """Automatic periods, found once for each application, folder and source."""
    return periods.automatic(_plain(SparkSession.active(), sf))


def _period(spark: SparkSession, sf: str):
    return _bounds(spark.sparkContext.applicationId, sf, _SOURCE.get())


def _sided(spark: SparkSession, sf: str) -> DataFrame:
    rows, chosen = _plain(spark, sf), _period(spark, sf)
    return classified(periods.sided(rows, *chosen) if chosen else rows.limit(0).withColumn("side", F.lit(-1)))


# Windows ---------------------------------------------------------------------------


@query(f"WITH {EVENT_SQL} SELECT CAST(date_trunc('day', max(start_time)) - INTERVAL 14 DAY AS TIMESTAMP) AS before_start, CAST(date_trunc('day', max(start_time)) - INTERVAL 7 DAY AS TIMESTAMP) AS after_start, CAST(date_trunc('day', max(start_time)) AS TIMESTAMP) AS after_end FROM usage")
def auto_periods(spark: SparkSession, sf: str) -> DataFrame:
    before, after = _period(spark, sf)
    return spark.createDataFrame([(before[0], after[0], after[1])], "before_start timestamp_ntz, after_start timestamp_ntz, after_end timestamp_ntz")


@query(f"""{_WITH} SELECT side, count(*) AS requests, {', '.join(f'CAST(coalesce(sum({n}), 0) AS BIGINT) AS {n}_tokens' for n in (*COUNTS, 'total'))},
CAST(coalesce(sum(amount), 0) AS DECIMAL(38,6)) AS spend FROM sided WHERE {_HELD} GROUP BY side""")
def window_totals(spark: SparkSession, sf: str) -> DataFrame:
    return usage.windows(_sided(spark, sf))


@query(f"{_WITH} SELECT side, {', '.join(f'CAST(sum({f}) AS BIGINT) AS {f}' for f in FLAGS)} FROM sided WHERE {_HELD} GROUP BY side")
def quality_vector(spark: SparkSession, sf: str) -> DataFrame:
    return usage.quality(_sided(spark, sf))


@query(f"{_WITH} SELECT side, CASE WHEN level IN ('DEFAULT','DEBUG','WARNING','ERROR') THEN level ELSE 'unknown' END AS level, count(*) AS n FROM sided WHERE {_HELD} AND level <> '' GROUP BY ALL")
def quality_levels(spark: SparkSession, sf: str) -> DataFrame:
    return usage.levels(_sided(spark, sf))


_MODELS = f"""{_WITH}, m AS (SELECT model, count(*) FILTER (side = 0) AS requests_before, count(*) FILTER (side = 1) AS requests_after,
CAST(coalesce(sum(total) FILTER (side = 0), 0) AS BIGINT) AS tokens_before, CAST(coalesce(sum(total) FILTER (side = 1), 0) AS BIGINT) AS tokens_after, min(row_number) AS first_seen
FROM sided WHERE {_HELD} GROUP BY model)"""


@query(f"{_MODELS} SELECT *, tokens_after - tokens_before AS token_change, CAST(row_number() OVER (ORDER BY tokens_after - tokens_before DESC, first_seen) AS INT) AS place FROM m")
def model_change(spark: SparkSession, sf: str) -> DataFrame:
    return usage.by_model(_sided(spark, sf))


@query(f"""{_WITH}, x AS (SELECT model, side, total, unclear + unknown_status AS doubt FROM sided WHERE {_HELD}),
d AS (SELECT model, CAST(grouping(model) AS INT) AS over_all, CAST(count(*) FILTER (side = 0) AS DOUBLE) AS n0, CAST(count(*) FILTER (side = 1) AS DOUBLE) AS n1, CAST(sum(total) FILTER (side = 0) AS DOUBLE) AS t0,
CAST(sum(total) FILTER (side = 1) AS DOUBLE) AS t1 FROM x GROUP BY ROLLUP (model)), v AS (SELECT *, t0 / nullif(n0, 0) AS p0, t1 / nullif(n1, 0) AS p1, (SELECT sum(doubt) FROM x) = 0 AS clear FROM d)
SELECT model, over_all, CASE WHEN clear THEN round((n1 - n0) * (p0 + p1) / 2, 4) END AS request_effect, CASE WHEN clear THEN round((p1 - p0) * (n0 + n1) / 2, 4) END AS size_effect FROM v""")
def volume_split(spark: SparkSession, sf: str) -> DataFrame:
    return usage.volume_split(_sided(spark, sf))


@query(f"""{_WITH}, x AS (SELECT model, side, total FROM sided WHERE {_HELD} AND unclear = 0 AND unknown_status = 0),
d AS (SELECT model, CAST(grouping(model) AS INT) AS over_all, CAST(count(*) FILTER (side = 0) AS DOUBLE) AS n0, CAST(count(*) FILTER (side = 1) AS DOUBLE) AS n1, CAST(sum(total) FILTER (side = 0) AS DOUBLE) AS t0,
CAST(sum(total) FILTER (side = 1) AS DOUBLE) AS t1 FROM x GROUP BY ROLLUP (model)), v AS (SELECT *, t0 / nullif(n0, 0) AS p0, t1 / nullif(n1, 0) AS p1 FROM d)
SELECT model, over_all, round((n1 - n0) * (p0 + p1) / 2, 4) AS request_effect, round((p1 - p0) * (n0 + n1) / 2, 4) AS size_effect FROM v""")
def volume_split_clear(spark: SparkSession, sf: str) -> DataFrame:
    """The split over the rows that need no review, where it is defined."""
    return usage.volume_split(_sided(spark, sf).filter("unclear = 0 and unknown_status = 0"))


def _cell(n: str, c: str) -> str:
    v = f"CASE WHEN regexp_full_match({c}, '[0-9]+') THEN TRY_CAST({c} AS BIGINT) END"
    return (
        f"CAST(sum({v}) AS BIGINT) AS {n}_sum, false AS {n}_overflow, count(*) FILTER (coalesce({c}, '') <> '' AND {v} IS NULL) AS {n}_invalid, count(*) FILTER (coalesce({c}, '') = '') AS {n}_missing"
    )


@query(f"{_WITH} SELECT call_type, side, count(*) AS n, {_cell('prompt', 'prompt_tokens')}, {_cell('completion', 'completion_tokens')}, {_cell('total', 'total_tokens')} FROM sided WHERE side >= 0 GROUP BY call_type, side")
def call_type_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return usage.call_types(_sided(spark, sf))


@query(f"WITH {EVENT_SQL} SELECT request_id, count(*) AS n FROM usage GROUP BY request_id HAVING count(*) > 1")
def duplicate_requests(spark: SparkSession, sf: str) -> DataFrame:
    return usage.duplicates(_plain(spark, sf))


@query("SELECT request_id, count(*) AS n FROM synthetic GROUP BY request_id HAVING count(*) > 1")
def duplicate_exports(spark: SparkSession, sf: str) -> DataFrame:
    return usage.duplicates(read(spark, sf, "synthetic").select("request_id"))


def _weights_sql(column: str, weight: str = "total") -> str:
    return f"""{_WITH}, w AS (SELECT "{column}" AS member, CAST(coalesce(sum({weight}) FILTER (side = 0), 0) AS BIGINT) AS before, CAST(coalesce(sum({weight}) FILTER (side = 1), 0) AS BIGINT) AS after,
min(row_number) AS first_seen FROM sided WHERE {_HELD} AND trim("{column}") <> '' AND missing = 0 GROUP BY 1), c AS (SELECT *, after - before AS change FROM w)"""


def _mover(dimension: str):
    def movers(spark: SparkSession, sf: str) -> DataFrame:
        return usage.movers(_sided(spark, sf), dimension)

    movers.__name__ = f"movers_{dimension}"
    sql = f"{_weights_sql(usage.DIMENSIONS[dimension])} SELECT *, CASE WHEN change > 0 THEN 'increased' WHEN change < 0 THEN 'decreased' ELSE 'unchanged' END AS direction FROM c ORDER BY abs(change) DESC, first_seen LIMIT 20"
    return query(sql)(movers)


for _d in usage.DIMENSIONS:
    _mover(_d)


@query(f"{_weights_sql('api_key', 'CASE WHEN cache_read IS NOT NULL AND input IS NOT NULL THEN input - cache_read END')} SELECT * FROM c WHERE change > 0 ORDER BY change DESC, first_seen LIMIT 20")
def uncached_movers(spark: SparkSession, sf: str) -> DataFrame:
    return usage.uncached_movers(_sided(spark, sf), "key")


@query(f"""{_weights_sql('api_key')}, t AS (SELECT change FROM c WHERE change > 0 ORDER BY change DESC, first_seen LIMIT 2),
a AS (SELECT count(*) AS members, CAST(coalesce(sum(change), 0) AS BIGINT) AS increase FROM t), n AS (SELECT CAST(coalesce(sum(change), 0) AS BIGINT) AS net FROM c)
SELECT members, increase, net, CASE WHEN net > 0 THEN round(increase / net, 9) END AS share FROM a CROSS JOIN n""")
def increase_concentration(spark: SparkSession, sf: str) -> DataFrame:
    return usage.concentration(_sided(spark, sf), "key")


@query(" UNION ALL ".join([f"""{_WITH} SELECT 'key' AS dimension, side, count(DISTINCT api_key) AS members FROM sided WHERE {_HELD} AND trim(api_key) <> '' GROUP BY side"""] + [
    f"""SELECT '{d}', side, count(DISTINCT "{c}") FROM sided WHERE {_HELD} AND trim("{c}") <> '' GROUP BY side""" for d, c in usage.DIMENSIONS.items() if d != "key"]))
def distinct_groups_exact(spark: SparkSession, sf: str) -> DataFrame:
    return usage.distinct_groups(_sided(spark, sf))


@query()
def distinct_groups_hll(spark: SparkSession, sf: str) -> DataFrame:
    return usage.distinct_groups(_sided(spark, sf), exact=False)


@query()
def distinct_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly distinct users out of daily sketches."""
    return usage.merged_sketches(usage.daily_sketches(_plain(spark, sf), "user"), F.date_trunc("week", "day"))


_COVERED = " UNION ALL ".join(f"""SELECT '{d}' AS dimension, call_type, coalesce(trim("{c}"), '') <> '' AS known FROM sided WHERE side >= 0""" for d, c in usage.DIMENSIONS.items())


@query(f"{_WITH}, x AS ({_COVERED}) SELECT dimension, call_type, CAST(grouping(call_type) AS INT) AS all_types, count(*) FILTER (known) AS known, count(*) FILTER (NOT known) AS unknown FROM x GROUP BY GROUPING SETS ((dimension, call_type), (dimension))")
def attribution_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return usage.attribution_coverage(_sided(spark, sf))


@query("""SELECT api_key, sha256(concat('demo', api_key)) AS digest, count(*) AS n FROM synthetic WHERE api_key IS NOT NULL GROUP BY api_key""")
def keyed_identities(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of keys, computed once for each distinct key after aggregation."""
    g = read(spark, sf, "synthetic").filter("api_key is not null").groupBy("api_key").agg(F.count(F.lit(1)).alias("n"))
    return g.select("api_key", F.sha2(F.concat(F.lit("demo"), "api_key"), 256).alias("digest"), "n")


@query(f"""{_WITH}, k AS (SELECT *, input IS NOT NULL AND cache_read IS NOT NULL AND coalesce(cache_read <= input, false) AS known, coalesce(cache_read_input_tokens, '') = '' AS absent FROM sided WHERE {_HELD}),
g AS (SELECT side, count(*) FILTER (known) AS covered, count(*) FILTER (NOT known AND absent) AS missing, count(*) FILTER (NOT known AND NOT absent) AS invalid,
CAST(coalesce(sum(input) FILTER (known), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(cache_read) FILTER (known), 0) AS BIGINT) AS read_tokens FROM k GROUP BY side)
SELECT *, input_tokens - read_tokens AS uncached_tokens, round(read_tokens / nullif(input_tokens, 0), 9) AS read_share FROM g""")
def cache_window(spark: SparkSession, sf: str) -> DataFrame:
    return usage.cache_windows(_sided(spark, sf))


@query(f"""{_WITH}, x AS (SELECT side, 'failed' AS kind, input, output, total FROM sided WHERE {_HELD} AND total > 0 AND failed = 1 UNION ALL
SELECT side, 'error', input, output, total FROM sided WHERE {_HELD} AND total > 0 AND error_level = 1)
SELECT side, kind, count(*) AS records, CAST(coalesce(sum(input), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output), 0) AS BIGINT) AS output_tokens, CAST(sum(total) AS BIGINT) AS total_tokens FROM x GROUP BY side, kind""")
def failure_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return usage.failure_tokens(_sided(spark, sf))


@query(f"{_WITH} SELECT side, CASE WHEN coalesce(trim(route), '') = '' THEN 'unknown' WHEN route = 'route1' THEN 'matched' ELSE 'other' END AS scope, count(*) AS n FROM sided WHERE side >= 0 GROUP BY ALL")
def scope_counts(spark: SparkSession, sf: str) -> DataFrame:
    return usage.scope_counts(_sided(spark, sf), "route", "route1")


@query(f"""{_weights_sql('api_key')}, t AS (SELECT CAST(sum(before) AS DECIMAL(19,0)) AS t0, CAST(sum(after) AS DECIMAL(19,0)) AS t1 FROM w)
SELECT member, before, after, first_seen, CAST(round(CAST((CAST(after AS HUGEINT) * CAST(t0 AS HUGEINT) - CAST(before AS HUGEINT) * CAST(t1 AS HUGEINT)) AS DOUBLE) / CAST(t0 AS DOUBLE), 2) AS DECIMAL(38,2)) AS excess FROM w CROSS JOIN t
ORDER BY abs(excess) DESC, first_seen LIMIT 20""")
def contributor_excess(spark: SparkSession, sf: str) -> DataFrame:
    return usage.contributor_excess(_sided(spark, sf), "key").withColumn("excess", F.round("excess", 2).cast("decimal(38,2)"))


# Routing and agents ------------------------------------------------------------------

_NO_MODEL = "'unknown', 'Unknown', 'unknown_model', '__unknown__', '__other__', '__missing__', '__unmapped__', '__overflow__'"
_ROUTED = f"""{_WITH}, x AS (SELECT side, total, row_number, amount, CASE WHEN NOT regexp_full_match(coalesce(attempted_fallbacks, ''), '[0-9]+') THEN 'unknown' WHEN CAST(attempted_fallbacks AS BIGINT) = 0 THEN 'none' ELSE 'some' END AS fallbacks,
CASE WHEN trim(route) <> '' THEN route END AS route, CASE WHEN trim(agent_id) <> '' THEN agent_id END AS agent, CASE WHEN trim(model) <> '' AND trim(model) NOT IN ({_NO_MODEL}) AND trim(model_id) <> '' AND trim(model_id) NOT IN ({_NO_MODEL}) THEN model END AS chosen FROM sided WHERE {_HELD}),
cohorts AS (SELECT route, agent, chosen, CAST(3 - grouping(route) - grouping(agent) - grouping(chosen) AS INT) AS grain, count(*) FILTER (side = 0) AS requests_before, count(*) FILTER (side = 1) AS requests_after,
CAST(coalesce(sum(total) FILTER (side = 0), 0) AS BIGINT) AS tokens_before, CAST(coalesce(sum(total) FILTER (side = 1), 0) AS BIGINT) AS tokens_after, count(*) FILTER (fallbacks = 'some') AS with_fallback,
count(*) FILTER (fallbacks = 'unknown') AS fallback_unknown, CAST(coalesce(sum(amount), 0) AS DECIMAL(38,6)) AS spend, min(row_number) AS first_seen FROM x GROUP BY GROUPING SETS ((), (route, agent), (route, agent, chosen)))"""


@query(f"{_ROUTED} SELECT * FROM cohorts")
def routing_cohorts(spark: SparkSession, sf: str) -> DataFrame:
    return routing.cohorts(_sided(spark, sf))


@query(f"""{_ROUTED} SELECT route, agent, chosen, round((requests_before + requests_after) / nullif(sum(requests_before + requests_after) OVER w, 0), 9) AS request_share,
round((tokens_before + tokens_after) / nullif(sum(tokens_before + tokens_after) OVER w, 0), 9) AS token_share FROM cohorts WHERE grain = 3 WINDOW w AS (PARTITION BY route, agent)""")
def routing_shares(spark: SparkSession, sf: str) -> DataFrame:
    return routing.shares(_sided(spark, sf))


@query(f"""{_ROUTED}, p AS (SELECT *, least(row_number() OVER (ORDER BY requests_before + requests_after DESC, first_seen), 6) AS place FROM cohorts WHERE grain = 2)
SELECT CAST(place AS INT) AS place, max(CASE WHEN place <= 5 THEN route END) AS route, max(CASE WHEN place <= 5 THEN agent END) AS agent, count(*) AS cohorts, CAST(sum(requests_before) AS BIGINT) AS requests_before,
CAST(sum(requests_after) AS BIGINT) AS requests_after FROM p GROUP BY place""")
def routing_remainder(spark: SparkSession, sf: str) -> DataFrame:
    return routing.remainder(_sided(spark, sf))


def _state(c: str) -> str:
    more = {"model": f"WHEN trim({c}) IN ({_NO_MODEL}) THEN 'invalid'", "model_id": f"WHEN trim({c}) IN ({_NO_MODEL}) THEN 'invalid'", "attempted_fallbacks": f"WHEN NOT regexp_full_match({c}, '[0-9]+') THEN 'invalid'"}
    return f"CASE WHEN {c} IS NULL THEN 'absent' WHEN strlen({c}) > 8192 THEN 'invalid' WHEN trim({c}) = '' THEN 'empty' {more.get(c, '')} ELSE 'known' END"


@query(f"""{_WITH}, x AS ({' UNION ALL '.join(f"SELECT '{f}' AS field, {_state(f)} AS state, CASE WHEN operation IS NOT NULL OR call_type = 'pass_through_endpoint' THEN call_type ELSE 'unknown' END AS call_type FROM sided WHERE side >= 0" for f in routing.FIELDS)})
SELECT field, state, call_type, CAST(grouping(call_type) AS INT) AS all_types, count(*) AS n FROM x GROUP BY GROUPING SETS ((field, state, call_type), (field, state))""")
def routing_field_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return routing.field_coverage(_sided(spark, sf))


@query(f"""{_WITH}, x AS (SELECT *, CASE WHEN call_type = 'pass_through_endpoint' AND internal_call_origin = 'autorouter_classifier' THEN 'overhead' ELSE 'other' END AS kind FROM sided WHERE side >= 0 AND operation IS NULL)
SELECT side, kind, count(*) AS n, {', '.join(', '.join(p for p in _cell(n, c).split(', ') if '_overflow' not in p) for n, c in usage.RAW_CELLS.items())}, CAST(coalesce(sum(amount), 0) AS DECIMAL(38,6)) AS spend,
{', '.join(f'CAST(sum({f}) AS BIGINT) AS {f}' for f in ('spend_missing', 'spend_invalid', 'spend_zero'))} FROM x GROUP BY side, kind""")
def routing_overhead(spark: SparkSession, sf: str) -> DataFrame:
    return routing.overhead(_sided(spark, sf))


@query(f"{_WITH} SELECT side, count(*) AS requests, CAST(sum(total) AS BIGINT) AS tokens, CAST(coalesce(sum(amount), 0) AS DECIMAL(38,6)) AS spend FROM sided WHERE {_HELD} AND route = 'route1' GROUP BY side")
def scope_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Totals of the rows of one scope; ``scope_counts`` tells what it leaves out."""
    return usage.windows(usage.scoped(_sided(spark, sf), "route", "route1")).select("side", "requests", F.col("total_tokens").alias("tokens"), "spend")


_AGENTS = f"""{_WITH}, a AS (SELECT CASE WHEN trim(agent_id) <> '' THEN agent_id END AS agent, count(*) FILTER (side = 0) AS requests_before, count(*) FILTER (side = 1) AS requests_after,
CAST(coalesce(sum(total) FILTER (side = 0), 0) AS BIGINT) AS tokens_before, CAST(coalesce(sum(total) FILTER (side = 1), 0) AS BIGINT) AS tokens_after, CAST(sum(amount) FILTER (side = 0) AS DECIMAL(38,6)) AS spend_before,
CAST(sum(amount) FILTER (side = 1) AS DECIMAL(38,6)) AS spend_after, count(amount) AS priced, min(row_number) AS first_seen FROM sided WHERE {_HELD} GROUP BY 1)"""


@query(f"{_AGENTS} SELECT * FROM a")
def agent_partition(spark: SparkSession, sf: str) -> DataFrame:
    return routing.by_agent(_sided(spark, sf))


@query(f"""{_AGENTS}, p AS (SELECT agent, spend_after - spend_before AS change, tokens_after, least(row_number() OVER (ORDER BY spend_after - spend_before IS NULL, spend_after - spend_before DESC, first_seen), 5) AS place FROM a WHERE agent IS NOT NULL)
SELECT CAST(place AS INT) AS place, max(CASE WHEN place <= 4 THEN agent END) AS agent, count(*) AS agents, CAST(sum(change) AS DECIMAL(38,6)) AS spend_change, CAST(sum(tokens_after) AS BIGINT) AS tokens_after FROM p GROUP BY place""")
def agent_spend_rank(spark: SparkSession, sf: str) -> DataFrame:
    return routing.agents_by_spend(_sided(spark, sf))


@query(f"""{_WITH}, l AS (SELECT side, total, request_tags, CASE WHEN request_tags <> '' THEN CASE WHEN len(list_filter(json_extract(request_tags, '$[*]'), lambda v: json_type(v) <> 'VARCHAR')) = 0 THEN
list_distinct(list_filter(list_transform(list_filter(json_extract_string(request_tags, '$[*]'), lambda t: starts_with(t, 'agent:')), lambda t: substr(t, 7)), lambda t: trim(t) <> '')) END END AS labels FROM sided WHERE {_HELD})
SELECT side, CASE WHEN coalesce(request_tags, '') = '' THEN 'absent' WHEN labels IS NULL THEN 'invalid' WHEN len(labels) = 1 THEN 'known' WHEN len(labels) > 1 THEN 'ambiguous' ELSE 'unknown' END AS state,
CASE WHEN len(labels) = 1 THEN labels[1] END AS agent, count(*) AS n, CAST(sum(total) AS BIGINT) AS tokens FROM l GROUP BY ALL""")
def agent_tags(spark: SparkSession, sf: str) -> DataFrame:
    return routing.by_agent_tag(_sided(spark, sf))


# Sessions ----------------------------------------------------------------------------

_SESSIONS = f"""WITH {EVENT_SQL}, {CLASSIFIED}, b AS (SELECT date_trunc('day', max(start_time)) - INTERVAL 7 DAY AS s, date_trunc('day', max(start_time)) AS e FROM usage),
x AS (SELECT *, coalesce(start_time >= s AND start_time < e, false) AS within, coalesce(rejection_kind, '') <> '' AS rejected FROM classified CROSS JOIN b WHERE coalesce(session_id, '') <> ''),
y AS (SELECT *, within AND NOT rejected AND operation IS NOT NULL AS call FROM x),
sessions AS (SELECT session_id, count(*) FILTER (call) AS calls, count(*) FILTER (within AND rejected) AS rejections, count(*) FILTER (within AND NOT rejected AND operation IS NULL) AS not_analysed,
CAST(coalesce(sum(total) FILTER (call), 0) AS BIGINT) AS tokens, CAST(coalesce(sum(amount) FILTER (call), 0) AS DECIMAL(38,6)) AS spend, CAST(coalesce(sum(spend_missing + spend_invalid) FILTER (call), 0) AS BIGINT) AS spend_unknown,
min(start_time) FILTER (call AND amount > 0) AS first_paid, max(start_time) FILTER (call AND amount > 0) AS last_paid, count(DISTINCT CASE WHEN within AND team_id <> '' THEN team_id END) AS teams,
bool_or(NOT within) AS clipped, count(*) FILTER (within) AS rows, min(row_number) FILTER (within) AS first_seen FROM y GROUP BY session_id HAVING count(*) FILTER (within) > 0),
z AS (SELECT *, spend_unknown = 0 AND not_analysed = 0 AS complete FROM sessions)"""


def _sessions(spark: SparkSession, sf: str) -> DataFrame:
    _, after = _period(spark, sf)
    return sessions.rollup(_classified(spark, sf), *after)


@query(f"{_SESSIONS} SELECT * FROM z")
def session_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return _sessions(spark, sf)


@query(f"""{_SESSIONS}, r AS (SELECT spend, row_number() OVER (ORDER BY spend) AS rn, count(*) OVER () AS n FROM z WHERE complete AND calls > 0)
SELECT CAST(share AS DOUBLE) AS share, spend, n AS sessions FROM r CROSS JOIN (VALUES (0.5::DOUBLE), (0.95::DOUBLE), (1.0::DOUBLE)) q(share) WHERE rn = greatest(1, CAST(ceil(share * n) AS BIGINT))""")
def session_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.quantiles(_sessions(spark, sf))


@query(f"""{_SESSIONS} SELECT count(*) AS sessions, count(*) FILTER (calls = 1) AS singletons, count(*) FILTER (calls = 0 AND rejections > 0) AS rejection_only, count(*) FILTER (rejections > 0) AS censored,
count(*) FILTER (complete AND spend > 400) AS exceeding, count(*) FILTER (NOT complete AND spend > 400) AS partial_exceeding, count(*) FILTER (epoch(date_trunc('second', last_paid)) - epoch(date_trunc('second', first_paid)) > 3600) AS long_spans,
count(*) FILTER (teams > 1) AS shared, count(*) FILTER (clipped) AS clipped FROM z""")
def session_summary(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.summary(_sessions(spark, sf), 400, 3600)


@query(f"{_SESSIONS} SELECT session_id, calls, spend, complete, clipped, first_seen FROM z WHERE spend > 400 ORDER BY spend DESC, first_seen LIMIT 20")
def session_cap_review(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.review(_sessions(spark, sf), 400)


@query(f"WITH {EVENT_SQL}, {CLASSIFIED} SELECT count(*) AS n, CAST(coalesce(sum(amount), 0) AS DECIMAL(38,6)) AS spend, CAST(coalesce(sum(spend_missing), 0) AS BIGINT) AS missing, CAST(coalesce(sum(spend_invalid), 0) AS BIGINT) AS invalid FROM classified WHERE operation IS NOT NULL AND coalesce(session_id, '') = ''")
def session_unattributed(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.unattributed(_classified(spark, sf))


_INSIDE = f"""{_SESSIONS}, w AS (SELECT * FROM y WHERE within)"""


@query(f"""{_INSIDE} SELECT session_id, count(DISTINCT nullif(api_key, '')) AS keys, count(DISTINCT nullif(team_id, '')) AS teams, count(DISTINCT nullif(agent_id, '')) AS agents FROM w GROUP BY 1""")
def session_members(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.memberships(_classified(spark, sf), *_period(spark, sf)[1])


@query(f"""{_INSIDE}, k AS (SELECT session_id, rejection_kind AS kind, count(*) AS n FROM w WHERE rejected GROUP BY ALL), t AS (SELECT session_id, string_agg(kind || '=' || n, ',' ORDER BY kind) AS rejections FROM k GROUP BY 1)
SELECT session_id, CAST(min(start_time) AS VARCHAR) AS first_activity, CAST(max(start_time) AS VARCHAR) AS last_activity, coalesce(any_value(rejections), '') AS rejections FROM w LEFT JOIN t USING (session_id) GROUP BY 1""")
def session_activity(spark: SparkSession, sf: str) -> DataFrame:
    """First and last activity and rejections by kind of each session."""
    a = sessions.activity(_classified(spark, sf), *_period(spark, sf)[1])
    kinds = F.array_join(F.transform(F.array_sort(F.map_entries("rejections")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return a.select("session_id", *[F.col(c).cast("string").alias(c) for c in ("first_activity", "last_activity")], kinds.alias("rejections"))


@query(f"{_INSIDE} SELECT rejection_kind AS kind, count(*) AS n, count(DISTINCT session_id) AS sessions FROM w WHERE rejected GROUP BY 1")
def session_rejections(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.rejection_totals(_classified(spark, sf), *_period(spark, sf)[1])


@query(f"""{_INSIDE}, m AS (SELECT session_id, count(DISTINCT nullif(api_key, '')) AS keys, count(DISTINCT nullif(team_id, '')) AS teams, count(DISTINCT nullif(agent_id, '')) AS agents FROM w GROUP BY 1)
SELECT session_id, spend, first_seen, m.keys, m.teams, m.agents FROM z JOIN m USING (session_id) WHERE m.keys > 1 OR m.teams > 1 OR m.agents > 1 ORDER BY spend DESC, first_seen LIMIT 20""")
def session_shared_review(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.shared(_sessions(spark, sf), sessions.memberships(_classified(spark, sf), *_period(spark, sf)[1]))


@query(f"""{_INSIDE} SELECT session_id, spend, CAST(floor((epoch_us(last_paid) - epoch_us(first_paid)) / 1000000) AS BIGINT) AS seconds, first_seen FROM z WHERE epoch_us(last_paid) - epoch_us(first_paid) > 3600000000 ORDER BY spend DESC, first_seen LIMIT 20""")
def session_span_review(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.long_spans(_sessions(spark, sf), 3600)


@query(f"WITH {EVENT_SQL} SELECT CAST(date_trunc('day', min(start_time)) + CASE WHEN min(start_time) = date_trunc('day', min(start_time)) THEN INTERVAL 0 DAY ELSE INTERVAL 1 DAY END AS TIMESTAMP) AS period_start, CAST(date_trunc('day', max(start_time)) AS TIMESTAMP) AS period_end FROM usage")
def session_auto_period(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([sessions.automatic(_plain(spark, sf))], "period_start timestamp_ntz, period_end timestamp_ntz")


# Coverage ----------------------------------------------------------------------------


_PROVIDER_COUNTS = """c AS (SELECT CAST(exported_at AS DATE) AS day, 'northlight' AS provider, CASE WHEN contains(model, '/') THEN substr(model, strpos(model, '/') + 1) ELSE model END AS provider_model,
CASE WHEN dayofmonth(CAST(exported_at AS DATE)) = 9 THEN NULL ELSE count(*) END AS requests, CASE WHEN dayofmonth(CAST(exported_at AS DATE)) % 5 <> 0 THEN CAST(sum(prompt_tokens) AS BIGINT) END AS input_tokens, CAST(sum(completion_tokens) AS BIGINT) + 1 AS output_tokens
FROM synthetic WHERE model IS NOT NULL GROUP BY CAST(exported_at AS DATE), 3)"""


@query(f"""WITH {_PROVIDER_COUNTS}, t AS (SELECT DISTINCT provider, provider_model FROM c),
r AS (SELECT CAST(exported_at AS DATE) AS day, s.*, pm.provider AS p, pm.provider_model AS m, t.provider IS NOT NULL AS own FROM synthetic s LEFT JOIN provider_model_map pm ON pm.source_provider = s.custom_llm_provider AND pm.source_model = s.model
  LEFT JOIN t ON strpos(s.model, '/') > 1 AND t.provider = split_part(s.model, '/', 1) AND t.provider = s.custom_llm_provider AND t.provider_model = substr(s.model, strpos(s.model, '/') + 1)),
a AS (SELECT day, p IS NOT NULL OR own AS mapped, CASE WHEN p IS NOT NULL THEN p ELSE custom_llm_provider END AS provider, CASE WHEN p IS NOT NULL THEN m WHEN own THEN substr(model, strpos(model, '/') + 1) ELSE model END AS provider_model, count(*) AS rows,
  count(*) FILTER (status = 'failure') AS failed, count(*) FILTER (coalesce(status NOT IN ('success', 'failure'), true)) AS unknown_status, CASE WHEN count(*) FILTER (prompt_tokens IS NULL OR prompt_tokens < 0) = 0 THEN CAST(sum(prompt_tokens) AS BIGINT) END AS li,
  CASE WHEN count(*) FILTER (completion_tokens IS NULL OR completion_tokens < 0) = 0 THEN CAST(sum(completion_tokens) AS BIGINT) END AS lo FROM r GROUP BY 1, 2, 3, 4),
j AS (SELECT coalesce(a.day, c.day) AS day, coalesce(a.provider, c.provider) AS provider, coalesce(a.provider_model, c.provider_model) AS provider_model, coalesce(mapped, true) AS mapped, coalesce(rows, 0) AS rows, coalesce(failed, 0) AS failed,
  coalesce(unknown_status, 0) AS unknown_status, CASE WHEN rows IS NULL THEN 0 ELSE li END AS li, CASE WHEN rows IS NULL THEN 0 ELSE lo END AS lo, c.day IS NOT NULL AS counted, requests, input_tokens, output_tokens
  FROM a FULL JOIN c ON a.mapped AND a.day = c.day AND a.provider = c.provider AND a.provider_model = c.provider_model),
d AS (SELECT *, sum(CASE WHEN mapped THEN 0 ELSE rows END) OVER (PARTITION BY day) AS unmapped, CASE WHEN NOT (day >= DATE '2026-03-02' AND day < DATE '2026-11-01') THEN 'partial_day' WHEN day >= DATE '2026-10-30' THEN 'unsettled_day' ELSE 'complete_day' END AS ds
  FROM j WHERE day >= DATE '2026-03-01' AND day < DATE '2026-11-01'),
e AS (SELECT *, CASE WHEN ds <> 'complete_day' THEN ds WHEN NOT mapped THEN 'unmapped_spend_model' WHEN NOT counted THEN 'provider_counts_missing' WHEN requests IS NULL THEN 'request_count_unavailable' WHEN requests > rows THEN 'provider_exceeds_logged_rows'
  WHEN requests < rows THEN 'logged_rows_exceed_provider' ELSE 'matched' END AS status, CASE WHEN ds = 'complete_day' THEN CAST(requests - rows AS BIGINT) END AS request_difference FROM d)
SELECT day, provider, provider_model, rows, failed, unknown_status, requests, status, request_difference, request_difference IS NOT NULL AND unmapped = 0 AS comparable,
CASE WHEN ds = 'complete_day' AND unmapped = 0 THEN CAST(input_tokens - li AS BIGINT) END AS input_difference, CASE WHEN ds = 'complete_day' AND unmapped = 0 THEN CAST(output_tokens - lo AS BIGINT) END AS output_difference FROM e""")
def provider_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Requests, failures and tokens against a provider's counts under a contract that is settled up to 29 October."""
    from datetime import datetime

    s = read(spark, sf, "synthetic")
    day = F.to_date("exported_at").alias("day")
    cells = [F.col(c).cast("string").alias(c) for c in ("prompt_tokens", "completion_tokens")]
    rows = s.select(day, F.col("custom_llm_provider").alias("source_provider"), F.col("model").alias("source_model"), "status", *cells)
    bare = F.when(F.contains("model", F.lit("/")), F.split("model", "/", 2)[1]).otherwise(F.col("model"))
    counts = s.filter(F.col("model").isNotNull()).groupBy(day, bare.alias("provider_model")).agg(F.count(F.lit(1)).alias("n"), F.sum("prompt_tokens").cast("bigint").alias("i"), F.sum("completion_tokens").cast("bigint").alias("o"))
    counts = counts.select(
        "day", F.lit("northlight").alias("provider"), "provider_model", F.when(F.dayofmonth("day") != 9, F.col("n")).alias("requests"),
        F.when(F.dayofmonth("day") % 5 != 0, F.col("i")).alias("input_tokens"), (F.col("o") + 1).alias("output_tokens"),
    )
    at = datetime
    contract = providers.Contract(at(2026, 3, 1), at(2026, 11, 1), at(2026, 11, 1), True, ("matched",) * 5, "primary_requests", True, True, 2 * 86_400)
    periods_ = [(at(2026, 3, 1, 12), at(2026, 3, 2)), (at(2026, 3, 2), at(2026, 11, 1))]
    return providers.compared(rows, read(spark, sf, "provider_model_map"), counts, periods_, contract, at(2026, 11, 20))


@query(f"""WITH {EVENT_SQL}, b AS (SELECT date_trunc('day', max(start_time)) - INTERVAL 14 DAY + INTERVAL 6 HOUR AS s, date_trunc('day', max(start_time)) AS e FROM usage),
d AS (SELECT CAST(t AS DATE) AS day, t >= s AND t + INTERVAL 1 DAY <= e AS whole FROM b, unnest(generate_series(date_trunc('day', s), e - INTERVAL 1 DAY, INTERVAL 1 DAY)) u(t)),
x AS (SELECT CAST(start_time AS DATE) AS day, count(*) AS exported FROM usage, b WHERE start_time >= s AND start_time < e GROUP BY 1),
c AS (SELECT CAST(start_time AS DATE) AS day, count(*) FILTER (row_number % 401 <> 0) + CASE WHEN dayofweek(CAST(start_time AS DATE)) = 1 THEN 3 ELSE 0 END AS api_requests FROM usage GROUP BY 1, dayofweek(CAST(start_time AS DATE)) HAVING dayofmonth(CAST(start_time AS DATE)) % 10 <> 7)
SELECT day, coalesce(exported, 0) AS exported, api_requests, CASE WHEN NOT whole THEN 'partial_day' WHEN api_requests IS NULL THEN 'daily_counts_missing' WHEN api_requests < coalesce(exported, 0) THEN 'excess_rows'
WHEN api_requests > coalesce(exported, 0) THEN 'missing_rows' ELSE 'matched' END AS status FROM d LEFT JOIN x USING (day) LEFT JOIN c USING (day)""")
def row_coverage(spark: SparkSession, sf: str) -> DataFrame:
    rows = _plain(spark, sf)
    before, after = _period(spark, sf)
    from datetime import timedelta

    day = F.to_date("start_time")
    daily = rows.groupBy(day.alias("day")).agg(F.count_if(F.col("row_number") % 401 != 0).alias("n"))
    extra = F.when(F.dayofweek("day") == 2, 3).otherwise(0)
    daily = daily.filter(F.dayofmonth("day") % 10 != 7).select("day", (F.col("n") + extra).alias("api_requests"))
    return coverage.row_coverage(rows, daily, before[0] + timedelta(hours=6), after[1])


@query("""WITH r AS (SELECT CAST(exported_at AS DATE) AS day, custom_llm_provider AS sp, model AS sm, count(*) AS logged FROM synthetic GROUP BY ALL),
m AS (SELECT day, coalesce(pm.provider, CASE WHEN contains(sm, '/') THEN split_part(sm, '/', 1) END) AS provider, coalesce(pm.provider_model, CASE WHEN contains(sm, '/') THEN substr(sm, strpos(sm, '/') + 1) END) AS provider_model, logged
FROM r LEFT JOIN provider_model_map pm ON pm.source_provider = sp AND pm.source_model = sm),
g AS (SELECT day, provider, provider_model, CAST(sum(logged) AS BIGINT) AS logged FROM m GROUP BY ALL),
c AS (SELECT CAST(exported_at AS DATE) AS day, 'northlight' AS provider, CASE WHEN contains(model, '/') THEN substr(model, strpos(model, '/') + 1) ELSE model END AS provider_model, CASE WHEN dayofmonth(CAST(exported_at AS DATE)) = 9 THEN NULL ELSE count(*) END AS requests, 1 AS seen
FROM synthetic WHERE model IS NOT NULL GROUP BY CAST(exported_at AS DATE), 3)
SELECT coalesce(g.day, c.day) AS day, coalesce(g.provider, c.provider) AS provider, coalesce(g.provider_model, c.provider_model) AS provider_model, coalesce(logged, 0) AS logged, requests,
CASE WHEN logged IS NOT NULL AND g.provider IS NULL THEN 'unmapped_model' WHEN requests IS NULL AND seen IS NULL THEN 'provider_counts_missing' WHEN requests IS NULL THEN 'request_count_unavailable'
WHEN requests > coalesce(logged, 0) THEN 'fewer_logged' WHEN requests < coalesce(logged, 0) THEN 'more_logged' ELSE 'matched' END AS status
FROM g FULL JOIN c ON g.day IS NOT DISTINCT FROM c.day AND g.provider IS NOT DISTINCT FROM c.provider AND g.provider_model IS NOT DISTINCT FROM c.provider_model""")
def provider_coverage(spark: SparkSession, sf: str) -> DataFrame:
    s = read(spark, sf, "synthetic")
    day = F.to_date("exported_at").alias("day")
    rows = s.select(day, F.col("custom_llm_provider").alias("source_provider"), F.col("model").alias("source_model"))
    bare = F.when(F.contains("model", F.lit("/")), F.split("model", "/", 2)[1]).otherwise(F.col("model"))
    counts = s.filter(F.col("model").isNotNull()).groupBy(day, bare.alias("provider_model")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("day", F.lit("northlight").alias("provider"), "provider_model", F.when(F.dayofmonth("day") != 9, F.col("n")).alias("requests"), F.lit(1).alias("seen"))
    return coverage.provider_coverage(rows, read(spark, sf, "provider_model_map"), counts)


@query("""WITH p AS (SELECT project_id AS owner, unnest([window_start, window_end]) AS moment, unnest([1, -1]) AS step FROM export_files WHERE window_end > window_start),
s AS (SELECT owner, moment, sum(step) AS step FROM p GROUP BY owner, moment),
r AS (SELECT owner, moment, sum(step) OVER w AS open, lead(moment) OVER w AS until FROM s WINDOW w AS (PARTITION BY owner ORDER BY moment)),
q AS (SELECT *, lag(open, 1, 0) OVER (PARTITION BY owner ORDER BY moment) AS was FROM r)
SELECT owner, count(*) FILTER (open > 0 AND was = 0) AS islands, CAST(coalesce(sum(epoch(until) - epoch(moment)) FILTER (open > 0), 0) AS BIGINT) AS covered_seconds,
CAST(coalesce(sum(epoch(until) - epoch(moment)) FILTER (open = 0 AND until IS NOT NULL), 0) AS BIGINT) AS gap_seconds, CAST(min(moment) AT TIME ZONE 'UTC' AS VARCHAR) AS first, CAST(max(moment) AT TIME ZONE 'UTC' AS VARCHAR) AS last, count(*) FILTER (open > 0 AND was = 0) - 1 AS gaps FROM q GROUP BY owner""")
def interval_coverage(spark: SparkSession, sf: str) -> DataFrame:
    c = coverage.interval_coverage(read(spark, sf, "export_files"), "project_id", "window_start", "window_end")
    return c.withColumns({n: F.date_format(n, "yyyy-MM-dd HH:mm:ss") for n in ("first", "last")})


@query("""WITH x AS (SELECT project_id AS owner, window_start AS s, max(window_end) OVER (PARTITION BY project_id ORDER BY window_start, window_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM export_files WHERE dayofmonth(window_start AT TIME ZONE 'UTC') NOT BETWEEN 12 AND 14)
SELECT owner, CAST(until AT TIME ZONE 'UTC' AS VARCHAR) AS gap_start, CAST(s AT TIME ZONE 'UTC' AS VARCHAR) AS gap_end FROM x WHERE until < s""")
def interval_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Gaps that files left out (those that begin on three days of each month) leave."""
    some = read(spark, sf, "export_files").filter(~F.dayofmonth("window_start").between(12, 14))
    g = coverage.interval_gaps(some, "project_id", "window_start", "window_end")
    return g.withColumns({n: F.date_format(n, "yyyy-MM-dd HH:mm:ss") for n in ("gap_start", "gap_end")})


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1")
def daily_projection(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))


# Snapshots -----------------------------------------------------------------------------

_SNAP = f"""WITH {EVENT_SQL}, {CLASSIFIED}, h AS (SELECT team_id AS producer, CAST(floor(hour(start_time) / 8) AS INT) AS epoch, CAST(start_time AS DATE) AS window_start, CAST(hour(start_time) AS INT) AS sequence, count(*) AS requests, CAST(sum(total) AS BIGINT) AS tokens,
CAST(sum(missing) AS BIGINT) AS missing, CAST(coalesce(sum(input), 0) AS BIGINT) AS input, CAST(coalesce(sum(cache_read), 0) AS BIGINT) AS cache_read FROM classified WHERE team_id IS NOT NULL AND start_time IS NOT NULL GROUP BY 1, 2, 3, 4),
s AS (SELECT producer, epoch, window_start, sequence, {', '.join(f'CAST(sum({n}) OVER w AS BIGINT) AS {n}' for n in ('requests', 'tokens', 'missing', 'input', 'cache_read'))} FROM h WINDOW w AS (PARTITION BY producer, epoch, window_start ORDER BY sequence)),
latest AS (SELECT *, count(*) OVER (PARTITION BY producer, epoch, window_start) AS versions FROM s QUALIFY row_number() OVER (PARTITION BY producer, epoch, window_start ORDER BY sequence DESC) = 1),
combined AS (SELECT window_start, counter, CAST(sum(value) AS BIGINT) AS value FROM (SELECT window_start, unnest(['requests','tokens','missing','input','cache_read']) AS counter, unnest([requests, tokens, missing, input, cache_read]) AS value FROM latest) GROUP BY ALL)"""


def _snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.from_usage(_classified(spark, sf))


@query(f"{_SNAP} SELECT producer, epoch, window_start, sequence, versions, requests, tokens FROM latest")
def snapshot_latest(spark: SparkSession, sf: str) -> DataFrame:
    x = snapshots.latest(_snapshots(spark, sf))
    return x.select("producer", "epoch", "window_start", "sequence", "versions", F.col("counters")["requests"].alias("requests"), F.col("counters")["tokens"].alias("tokens"))


@query(f"{_SNAP} SELECT * FROM combined")
def snapshot_combine(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.combined(_snapshots(spark, sf))


@query(f"""{_SNAP}, t AS (SELECT producer, epoch, window_start, sequence, requests, tokens FROM s UNION ALL SELECT producer, epoch, window_start, sequence, requests, CASE WHEN sequence % 2 = 0 THEN tokens + 1 ELSE tokens END FROM s WHERE producer = 't1' AND sequence % 6 < 2)
SELECT producer, epoch, window_start, sequence, count(DISTINCT (requests, tokens)) AS contents FROM t GROUP BY ALL HAVING count(DISTINCT (requests, tokens)) > 1""")
def snapshot_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Conflicts after one producer sent some snapshots again, every other of them changed."""
    s = _snapshots(spark, sf)
    again = s.filter("producer = 't1' and sequence % 6 < 2")
    changed = F.transform_values("counters", lambda k, v: F.when((k == "tokens") & (F.col("sequence") % 2 == 0), v + 1).otherwise(v))
    return snapshots.conflicts(s.unionByName(again.withColumn("counters", changed)))


@query(f"""{_SNAP}, p AS (SELECT DISTINCT producer, window_start FROM latest), e AS (SELECT concat('t', CAST(range AS VARCHAR)) AS producer FROM range(7)), w AS (SELECT DISTINCT window_start FROM p)
SELECT w.window_start, count(p.producer) AS sent, array_to_string(list_sort(list(e.producer) FILTER (p.producer IS NULL)), ',') AS absent FROM w CROSS JOIN e LEFT JOIN p ON p.window_start = w.window_start AND p.producer = e.producer GROUP BY 1""")
def producer_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.producers(_snapshots(spark, sf), [f"t{i}" for i in range(7)]).withColumn("absent", F.array_join("absent", ","))


_HALVES = "window_start < DATE '2024-01-16'"


@query(f"{_SNAP} SELECT counter, CAST(coalesce(sum(value) FILTER ({_HALVES}), 0) AS BIGINT) AS before, CAST(coalesce(sum(value) FILTER (NOT {_HALVES}), 0) AS BIGINT) AS after, CAST(coalesce(sum(value) FILTER (NOT {_HALVES}), 0) - coalesce(sum(value) FILTER ({_HALVES}), 0) AS BIGINT) AS change FROM combined GROUP BY counter")
def counter_delta(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.counter_delta(snapshots.combined(_snapshots(spark, sf)), F.expr(_HALVES), ~F.expr(_HALVES))


@query(f"""{_SNAP}, x AS (SELECT sum(value) FILTER (counter = 'cache_read' AND {_HALVES}) AS r0, sum(value) FILTER (counter = 'input' AND {_HALVES}) AS i0, sum(value) FILTER (counter = 'cache_read' AND NOT {_HALVES}) AS r1,
sum(value) FILTER (counter = 'input' AND NOT {_HALVES}) AS i1 FROM combined) SELECT round(r0 / i0, 9) AS share_before, round(r1 / i1, 9) AS share_after, CASE WHEN r1 * i0 > r0 * i1 THEN 'up' WHEN r1 * i0 < r0 * i1 THEN 'down' ELSE 'same' END AS direction FROM x""")
def cache_share_change(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.cache_share_change(snapshots.combined(_snapshots(spark, sf)), F.expr(_HALVES), ~F.expr(_HALVES))


@query(f"""{_SNAP}, c AS (SELECT window_start, unnest(['requests','tokens','missing','input','cache_read']) AS counter FROM latest), n AS (SELECT window_start, count(*) AS snapshots FROM latest GROUP BY 1)
SELECT window_start, counter, snapshots FROM (SELECT window_start, counter, count(*) AS held FROM c GROUP BY ALL) JOIN n USING (window_start) WHERE held = snapshots""")
def snapshot_shared_counters(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.shared_counters(_snapshots(spark, sf))


@query(f"{_SNAP} SELECT producer, epoch, window_start, sequence FROM latest WHERE window_start IN (SELECT DISTINCT window_start FROM s ORDER BY window_start DESC LIMIT 7)")
def snapshot_retained(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.retained(_snapshots(spark, sf), 7).select("producer", "epoch", "window_start", "sequence")


_QUALITY = f"""WITH {EVENT_SQL}, {CLASSIFIED}, q AS (SELECT team_id AS producer, CAST(start_time AS DATE) AS window_start, max(start_time) AS emitted_at, count(*) AS requests, sum(missing) AS missing, coalesce(sum(input), 0) AS input_tokens, coalesce(sum(output), 0) AS output_tokens,
count(*) FILTER (coalesce(request_id, '') = '') AS keyless, count(input) AS input_reported, count(output) AS output_reported FROM classified WHERE team_id IS NOT NULL AND start_time IS NOT NULL GROUP BY 1, 2)"""
_TEAMS = [f"t{i}" for i in range(5)]


def _quality(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.quality_snapshots(_classified(spark, sf))


@query(f"""{_QUALITY}, g AS (SELECT window_start, count(DISTINCT producer) AS seen, sum(missing) AS missing, sum(requests) AS requests, CAST(sum(input_tokens) + sum(output_tokens) AS DECIMAL(38,0)) AS total, bool_and(keyless = 0 AND input_reported = requests AND output_reported = requests) AS clean FROM q GROUP BY 1)
SELECT window_start, total, CASE WHEN seen < 5 THEN 'missing_producers' WHEN missing <> 0 THEN 'incomplete_usage' WHEN total > 9007199254740992 THEN 'beyond_exact_range' WHEN NOT clean THEN 'source_not_clean' END AS reason FROM g""")
def cusum_eligibility(spark: SparkSession, sf: str) -> DataFrame:
    return scan.token_eligibility(_quality(spark, sf), _TEAMS)


@query(f"""{_QUALITY}, f AS (SELECT window_start AS day, count(DISTINCT producer) = 5 AS complete, max(emitted_at) AS emitted FROM q GROUP BY 1), n AS (SELECT max(day) + INTERVAL 1 DAY AS now FROM f),
x AS (SELECT *, lag(day, 6) OVER w AS first, bool_and(complete) OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS whole, max(emitted) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS sent, max(day) OVER () AS last FROM f, n WINDOW w AS (ORDER BY day))
SELECT day, CASE WHEN first IS NULL THEN 'too_few' WHEN last + INTERVAL 4 DAY < now THEN 'stale' WHEN sent > now THEN 'emitted_in_future' WHEN day - first <> 6 THEN 'gap' WHEN NOT whole THEN 'incomplete_baseline' WHEN NOT complete THEN 'incomplete' ELSE 'ready' END AS state FROM x""")
def scan_history(spark: SparkSession, sf: str) -> DataFrame:
    f = snapshots.frames(_quality(spark, sf), _TEAMS)
    now = f.agg(F.date_add(F.max("day"), 1).cast("timestamp_ntz")).first()[0]
    return scan.history(f, F.lit(now).cast("timestamp_ntz"))


_SPLIT = "window_start < DATE '2024-01-16'"


@query(f"""{_QUALITY}, w AS (SELECT window_start, {_SPLIT} AS early, count(DISTINCT producer) = 5 AS whole, sum(requests) AS requests, sum(missing) AS missing FROM q GROUP BY 1, 2),
x AS (SELECT coalesce(bool_and(whole) FILTER (early), false) AND coalesce(bool_and(whole) FILTER (NOT early), false) AS whole, sum(missing) AS missing, sum(requests) FILTER (early) AS r0, sum(requests) FILTER (NOT early) AS r1 FROM w),
r AS (SELECT CASE WHEN NOT whole THEN 'incomplete_producers' WHEN r0 IS NULL OR r1 IS NULL THEN 'counters_unavailable' WHEN missing <> 0 THEN 'missing_usage' WHEN r0 = 0 OR r1 = 0 THEN 'no_requests' END AS reason, whole AND missing = 0 AS covered FROM x)
SELECT 'volume' AS question, CASE WHEN reason IS NULL THEN 'observed' ELSE 'cannot_determine' END AS status, reason FROM r UNION ALL SELECT 'coverage', CASE WHEN covered THEN 'observed' ELSE 'limited' END, CASE WHEN NOT covered THEN coalesce(reason, 'missing_usage') END FROM r""")
def question_statuses(spark: SparkSession, sf: str) -> DataFrame:
    return questions.statuses(_quality(spark, sf), F.expr(_SPLIT), ~F.expr(_SPLIT), _TEAMS)


@query(f"""{_weights_sql('api_key')}, a AS (SELECT 'change' AS list, member, CAST(row_number() OVER (ORDER BY abs(change) DESC, first_seen) AS INT) AS place FROM c), b AS (SELECT 'size' AS list, member, CAST(100 + row_number() OVER (ORDER BY after DESC, first_seen) AS INT) AS place FROM c),
l AS (SELECT * FROM a WHERE place <= 7 UNION ALL SELECT * FROM b WHERE place <= 107), f AS (SELECT member, min(place) AS place FROM l GROUP BY member), n AS (SELECT member, 'key-' || row_number() OVER (ORDER BY place, member) AS alias FROM f)
SELECT list, l.member, place, alias, 'key' AS kind FROM l JOIN n ON n.member = l.member""")
def mover_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """The first movers by change and by size under one set of aliases."""
    rows = _sided(spark, sf)
    w = usage.movers(rows, "key", 7)
    by = lambda order: F.row_number().over(Window.orderBy(*order))  # noqa: E731  over seven rows
    a = w.select(F.lit("change").alias("list"), "member", by([F.desc(F.abs("change")), F.col("first_seen")]).alias("place"))
    large = usage.largest(rows, "key", 7)
    b = large.select(F.lit("size").alias("list"), "member", (by([F.desc("after"), F.col("first_seen")]) + 100).alias("place"))
    return questions.aliased(a.unionByName(b).withColumn("kind", F.lit("key")), "kind", "member", "place")


@query(f"""WITH {EVENT_SQL}, {CLASSIFIED}, s AS (SELECT CAST(start_time AS DATE) AS window_start, session_id AS item, CAST(sum(total) AS BIGINT) AS n FROM classified WHERE coalesce(session_id, '') <> '' AND start_time IS NOT NULL GROUP BY 1, 2),
t AS (SELECT *, CAST(sum(n) OVER (PARTITION BY window_start) AS BIGINT) AS total FROM s) SELECT window_start, item, n AS lower, n AS upper, total, 'runaway_candidate' AS flag FROM t WHERE total > 0 AND CAST(n AS HUGEINT) * 100 > CAST(total AS HUGEINT) * 4""")
def session_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions that surely hold more than four percent of a day's tokens."""
    x = _classified(spark, sf).filter("session_id <> '' and start_time is not null").groupBy(F.to_date("start_time").alias("window_start"), F.col("session_id").alias("item")).agg(F.sum("total").cast("bigint").alias("lower"))
    totals = x.groupBy("window_start").agg(F.sum("lower").cast("bigint").alias("total"))
    return questions.flagged(x.join(totals, "window_start").select("window_start", "item", "lower", F.col("lower").alias("upper"), "total"), "0.04")


_ERRORS = """WITH c AS (SELECT CAST(ts AS DATE) AS day, concat('tool', CAST(user_id % 40 AS VARCHAR)) AS member, count(*) * CASE WHEN dayofmonth(CAST(ts AS DATE)) = 20 THEN 9 ELSE 1 END AS errors FROM events WHERE event_type = 'error' AND user_id % 40 < 30 GROUP BY 1, 2),
d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), r AS (SELECT day FROM (SELECT day, lag(day, 6) OVER (ORDER BY day) AS first FROM d) WHERE day - first = 6),
p AS (SELECT c.day, c.member, c.errors, list(coalesce(b.errors, 0)::DOUBLE) AS past FROM c JOIN r USING (day) JOIN d e ON e.day < c.day AND e.day >= c.day - 6 LEFT JOIN c b ON b.day = e.day AND b.member = c.member GROUP BY ALL),
m AS (SELECT *, list_median(past) AS m, list_median(list_transform(past, lambda q: abs(q - list_median(past)))) AS mad FROM p),
t AS (SELECT *, greatest(m + greatest(4 * greatest(1.4826 * mad, 1.0), 0.5 * m, 10.0), list_max(past)) AS threshold FROM m), surges AS (SELECT day, member, errors, round(threshold, 6) AS threshold FROM t WHERE errors > threshold)"""


def _surges(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").withColumn("day", F.to_date("ts"))
    many = F.when(F.dayofmonth("day") == 20, 9).otherwise(1)
    counts = e.filter((F.col("event_type") == "error") & (F.col("user_id") % 40 < 30)).groupBy("day", F.concat(F.lit("tool"), (F.col("user_id") % 40).cast("string")).alias("member")).agg(F.count(F.lit(1)).alias("n"))
    return scan.error_surges(counts.select("day", "member", (F.col("n") * many).alias("errors")), e.select("day").distinct())


@query(f"{_ERRORS} SELECT * FROM surges")
def scan_error_surges(spark: SparkSession, sf: str) -> DataFrame:
    return _surges(spark, sf)


@query(f"""{_ERRORS}, n AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY member) AS place, count(*) OVER (PARTITION BY day) AS everything FROM surges)
SELECT day, member, errors, threshold, 1 AS held, left(sha256(concat_ws('/', 'demo', CAST(day AS VARCHAR), member)), 32) AS id, greatest(everything - 3, 0) AS omitted FROM n WHERE place <= 3""")
def scan_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Surges with stable ids, three a day."""
    return scan.identified(_surges(spark, sf), ["member"], "demo", top=3)


_SUMMARIES = """WITH c AS (SELECT CAST(exported_at AS DATE) AS window_start, custom_llm_provider AS source, model AS item, count(*) AS n FROM synthetic WHERE model IS NOT NULL GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY window_start, source ORDER BY n DESC, item) AS place FROM c), s AS (SELECT window_start, source, CAST(sum(n) AS BIGINT) AS total, coalesce(max(n) FILTER (place > 4), 0) AS max_error FROM k GROUP BY 1, 2),
i AS (SELECT k.window_start, k.source, item, n, max_error FROM k JOIN s ON k.window_start = s.window_start AND k.source IS NOT DISTINCT FROM s.source WHERE place <= 4)"""


def _summaries(spark: SparkSession, sf: str) -> DataFrame:
    """The four most frequent models of each day and provider, as summaries with error bounds."""
    s = read(spark, sf, "synthetic").filter("model is not null")
    c = s.groupBy(F.to_date("exported_at").alias("window_start"), F.col("custom_llm_provider").alias("source"), F.col("model").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "item")))  # models are few
    g = c.groupBy("window_start", "source").agg(F.sum("n").cast("bigint").alias("total"), ordered.alias("all"))
    items = F.transform(F.slice("all", 1, 4), lambda e: F.struct(e["item"].alias("item"), (-e["m"]).alias("lower"), (-e["m"]).alias("upper")))
    return g.select("window_start", "source", "total", F.coalesce(-F.get("all", F.lit(4))["m"], F.lit(0)).alias("max_error"), items.alias("items"))


@query(f"""{_SUMMARIES}, t AS (SELECT window_start, CAST(sum(total) AS BIGINT) AS total, CAST(sum(max_error) AS BIGINT) AS errors FROM s GROUP BY 1)
SELECT i.window_start, item, CAST(sum(n) AS BIGINT) AS lower, CAST(least(any_value(total), sum(n) + any_value(errors) - sum(max_error)) AS BIGINT) AS upper, any_value(total) AS total FROM i JOIN t ON t.window_start = i.window_start GROUP BY i.window_start, item""")
def frequent_item_merge(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.merged_items(_summaries(spark, sf))


@query(f"""{_SUMMARIES}, x AS (SELECT s.*, CASE WHEN total % 7 = 3 THEN total - 1 ELSE total END AS stated FROM s), a AS (SELECT x.window_start, x.source, stated, x.max_error, CAST(sum(n) AS BIGINT) AS held, max(n) AS most FROM x JOIN i ON i.window_start = x.window_start AND i.source IS NOT DISTINCT FROM x.source GROUP BY 1, 2, 3, 4)
SELECT window_start, source, CASE WHEN most > stated THEN 'bound' WHEN held > stated THEN 'lower_sum' ELSE 'exact_sum' END AS reason FROM a WHERE most > stated OR held > stated OR (max_error = 0 AND held <> stated)""")
def frequent_item_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Summaries whose stated total (made wrong for some) their items contradict."""
    stated = _summaries(spark, sf).withColumn("total", F.when(F.col("total") % 7 == 3, F.col("total") - 1).otherwise(F.col("total")))
    return snapshots.inconsistent_items(stated).select("window_start", "source", "reason")


@query(f"""{_QUALITY}, d AS (SELECT *, producer IN ('t1', 't3') AS declared FROM q), x AS (SELECT window_start, unnest(['provider_reported', 'inferred', 'unavailable', 'unknown']) AS origin, unnest([CASE WHEN declared THEN requests ELSE 0 END, 0, 0, CASE WHEN declared THEN 0 ELSE requests END]) AS n FROM d)
SELECT window_start, origin, CAST(sum(n) AS BIGINT) AS requests FROM x GROUP BY ALL""")
def usage_origins(spark: SparkSession, sf: str) -> DataFrame:
    """Requests of each window by the declared origin of their input counts; two producers declare theirs."""
    q = _quality(spark, sf)
    said = F.map_concat("counters", F.create_map(*[v for o in snapshots.ORIGINS for v in (F.lit(f"usage_provenance.v1.input.{o}"), F.col("counters")["requests"] if o == "provider_reported" else F.lit(0).cast("bigint"))]))
    q = q.withColumn("counters", F.when(F.col("producer").isin("t1", "t3"), said).otherwise(F.col("counters")))
    c = snapshots.combined(snapshots.with_provenance(q)).filter(F.col("counter").startswith("usage_provenance.v1.input."))
    return c.select("window_start", F.substring_index("counter", ".", -1).alias("origin"), F.col("value").alias("requests"))


@query(f"""WITH {EVENT_SQL}, {CLASSIFIED}, b AS (SELECT *, CASE WHEN missing + invalid > 0 THEN -1 WHEN input = 0 THEN 0 ELSE length(ltrim(bin(input), '0')) END AS bin FROM classified WHERE operation IS NOT NULL)
SELECT model, CAST(bin AS INT) AS bin, count(*) AS requests, CAST(sum(input) FILTER (bin >= 0) AS BIGINT) AS input_tokens, CAST(sum(output) FILTER (bin >= 0) AS BIGINT) AS output_tokens, min(input) FILTER (bin >= 0) AS input_min, max(input) FILTER (bin >= 0) AS input_max FROM b GROUP BY model, bin""")
def usage_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.usage_histogram(_classified(spark, sf))


# Scan and CUSUM -------------------------------------------------------------------------

_FRAMES = f"""WITH {EVENT_SQL}, {CLASSIFIED}, frames AS (SELECT CAST(start_time AS DATE) AS day, count(*) AS attempts, CAST(sum(total) AS BIGINT) AS tokens, CAST(sum(missing) AS BIGINT) AS missing FROM classified WHERE start_time IS NOT NULL GROUP BY 1)"""


def _frames(spark: SparkSession, sf: str) -> DataFrame:
    return scan.frames(_classified(spark, sf))


@query(f"{_FRAMES}, x AS (SELECT day, lag(day, 6) OVER w AS before, row_number() OVER w - 1 AS seen FROM frames WINDOW w AS (ORDER BY day)) SELECT day, seen, CASE WHEN before IS NULL THEN 'too_few' WHEN day - before <> 6 THEN 'gap' ELSE 'ready' END AS state FROM x")
def scan_readiness(spark: SparkSession, sf: str) -> DataFrame:
    return scan.readiness(_frames(spark, sf))


@query(f"""{_FRAMES}, v AS (SELECT day, unnest(['attempt_volume', 'tokens_per_attempt', 'missing_usage_share']) AS signal, unnest([CAST(attempts AS DOUBLE), tokens / CAST(attempts AS DOUBLE), missing / CAST(attempts AS DOUBLE)]) AS value,
unnest([1.0, 1.0, 0.01]) AS floor, unnest([0.0, 0.0, 0.05]) AS least FROM frames), p AS (SELECT *, list(value) OVER (PARTITION BY signal ORDER BY day ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS past FROM v),
m AS (SELECT *, list_median(past) AS median, list_median(list_transform(past, lambda q: abs(q - list_median(past)))) AS mad FROM p WHERE len(past) = 6),
s AS (SELECT *, greatest(1.4826 * mad, CAST(floor AS DOUBLE)) AS scale FROM m), r AS (SELECT *, greatest(4 * scale, 0.5 * abs(median), CAST(least AS DOUBLE)) AS required, value - median AS change FROM s)
SELECT day, signal, round(value, 6) AS value, round(median, 6) AS median, round(required, 6) AS required, round(change / scale, 6) AS score, CASE WHEN change >= required THEN 'up' WHEN signal <> 'missing_usage_share' AND -change >= required THEN 'down' ELSE 'none' END AS direction FROM r""")
def scan_scalar_signals(spark: SparkSession, sf: str) -> DataFrame:
    return scan.scalar_signals(_frames(spark, sf))


_SHARES = f"""WITH {EVENT_SQL}, {CLASSIFIED}, k AS (SELECT CAST(start_time AS DATE) AS day, api_key AS member, CAST(sum(total) AS BIGINT) AS tokens FROM classified WHERE start_time IS NOT NULL AND api_key IS NOT NULL GROUP BY 1, 2),
shares AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY day) AS BIGINT) AS day_tokens FROM k)"""


def _shares(spark: SparkSession, sf: str) -> DataFrame:
    return scan.key_shares(_classified(spark, sf), "api_key")


@query(f"""{_SHARES}, t AS (SELECT day, max(tokens / CAST(day_tokens AS DOUBLE)) AS share FROM shares WHERE day_tokens > 0 GROUP BY day), p AS (SELECT *, list(share) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS past FROM t),
m AS (SELECT *, list_median(past) AS m, list_median(list_transform(past, lambda q: abs(q - list_median(past)))) AS mad FROM p WHERE len(past) = 6),
h AS (SELECT *, greatest(m + greatest(4 * greatest(1.4826 * mad, 0.01), 0.5 * m, 0.1), list_max(past), 0.25) AS threshold FROM m) SELECT day, round(share, 9) AS share, round(threshold, 9) AS threshold, share > threshold AS finding FROM h""")
def scan_top_share(spark: SparkSession, sf: str) -> DataFrame:
    return scan.top_share(_shares(spark, sf))


_PROMINENT = f"""{_SHARES}, a AS (SELECT *, tokens > 0 AND CAST(tokens AS HUGEINT) * 1000000 >= CAST(day_tokens AS HUGEINT) * 60000 AS above FROM shares),
f AS (SELECT *, coalesce(bool_or(above) OVER (PARTITION BY member ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), false) AS was FROM a),
prominent AS (SELECT day, member, tokens, day_tokens FROM f WHERE above AND NOT was)"""


@query(f"{_PROMINENT} SELECT * FROM prominent")
def scan_newly_prominent(spark: SparkSession, sf: str) -> DataFrame:
    return scan.newly_prominent(_shares(spark, sf), 0.06)


@query(f"""{_SHARES}, a AS (SELECT day, member FROM shares WHERE tokens > 0 AND CAST(tokens AS HUGEINT) * 20 >= CAST(day_tokens AS HUGEINT)), g AS (SELECT *, day - DATE '1970-01-01' - row_number() OVER (PARTITION BY member ORDER BY day) AS island FROM a)
SELECT member, min(day) AS first_day, max(day) AS last_day, count(*) AS days FROM g GROUP BY member, island""")
def scan_persistence(spark: SparkSession, sf: str) -> DataFrame:
    s = _shares(spark, sf)
    above = s.filter((F.col("tokens") > 0) & (F.col("tokens").cast("decimal(19,0)") * 20 >= F.col("day_tokens").cast("decimal(19,0)"))).select("day", "member")
    return scan.streaks(above, ["member"])


def _series(spark: SparkSession, sf: str) -> DataFrame:
    index = F.datediff("day", F.lit("1970-01-01").cast("date"))
    return _frames(spark, sf).select(F.lit("tokens").alias("series"), index.alias("index"), F.col("tokens").cast("double").alias("value"), (F.dayofmonth("day") != 12).alias("eligible"))


def _cusum_sql(weekly: bool) -> str:
    keys = "CAST(dayofweek(day) AS INT)" if weekly else "'tokens'"
    index = "CAST(floor((day - DATE '1970-01-01') / 7.0) AS INT)" if weekly else "CAST(day - DATE '1970-01-01' AS INT)"
    name, reference = ("weekday", 2) if weekly else ("series", 6)
    return f"""{_FRAMES}, s AS (SELECT {keys} AS {name}, {index} AS index, CAST(tokens AS DOUBLE) AS value, dayofmonth(day) <> 12 AS eligible FROM frames),
b AS (SELECT *, NOT eligible OR coalesce(index - lag(index) OVER (PARTITION BY {name} ORDER BY index) <> 1, true) AS broken FROM s), r AS (SELECT *, sum(CAST(broken AS INT)) OVER (PARTITION BY {name} ORDER BY index) AS run FROM b),
p AS (SELECT *, list(value) OVER (PARTITION BY {name}, run ORDER BY index ROWS BETWEEN {reference} PRECEDING AND 1 PRECEDING) AS past FROM r WHERE eligible),
i AS (SELECT *, (value - list_median(past)) / greatest(1.4826 * list_median(list_transform(past, lambda q: abs(q - list_median(past)))), 1.0) - 1.0 AS increment FROM p WHERE len(past) = {reference}),
q AS (SELECT *, sum(increment) OVER w AS prefix FROM i WINDOW w AS (PARTITION BY {name}, run ORDER BY index))
SELECT {name}, index, round(prefix - least(0.0, min(prefix) OVER (PARTITION BY {name}, run ORDER BY index)), 6) AS statistic FROM q"""


@query(_cusum_sql(False))
def cusum_rolling(spark: SparkSession, sf: str) -> DataFrame:
    return scan.cusum(_series(spark, sf), ["series"])


@query(_cusum_sql(True))
def cusum_weekday(spark: SparkSession, sf: str) -> DataFrame:
    days = F.datediff("day", F.lit("1970-01-01").cast("date"))
    s = _frames(spark, sf).select((F.dayofweek("day") - 1).alias("weekday"), F.floor(days / 7).cast("int").alias("index"), F.col("tokens").cast("double").alias("value"), (F.dayofmonth("day") != 12).alias("eligible"))
    return scan.cusum(s, ["weekday"], reference=2)


def _alarm_sql() -> str:
    body = _cusum_sql(False)
    head = body[: body.index("q AS (SELECT *, sum(increment)")].replace("WITH ", "WITH RECURSIVE ", 1)
    step = "greatest(0.0, CASE WHEN a.hit THEN 0.0 ELSE a.s END + o.increment)"
    return f"""{head}o AS (SELECT series, run, index, increment, row_number() OVER (PARTITION BY series, run ORDER BY index) AS k FROM i),
a AS (SELECT series, run, k, index, greatest(0.0, increment) AS s, greatest(0.0, increment) >= 3.0 AS hit FROM o WHERE k = 1
UNION ALL SELECT o.series, o.run, o.k, o.index, {step}, {step} >= 3.0 FROM a JOIN o ON o.series = a.series AND o.run = a.run AND o.k = a.k + 1)
SELECT series, CAST(index AS BIGINT) AS index, round(s, 6) AS statistic FROM a WHERE hit"""


@query(_alarm_sql())
def cusum_alarms(spark: SparkSession, sf: str) -> DataFrame:
    return scan.cusum_alarms(_series(spark, sf), ["series"], threshold=3.0)


# Observations, labels, statistics, tiers ----------------------------------------------------

_OBS = """WITH x AS (SELECT *, usage_details['input'] AS a, usage_details['output'] AS b, usage_details['input_cached_tokens'] AS c, usage_details['input_cache_creation'] AS d, usage_details['output_reasoning_tokens'] AS e, usage_details['total'] AS t FROM observations),
y AS (SELECT *, CASE WHEN coalesce(a, b, c, d, e, t) IS NOT NULL THEN coalesce(a, 0) + coalesce(c, 0) + coalesce(d, 0) END AS prompt, CASE WHEN coalesce(a, b, c, d, e, t) IS NOT NULL THEN coalesce(b, 0) + coalesce(e, 0) END AS completion,
coalesce(len(list_filter(map_keys(usage_details), lambda k: k NOT IN ('input','output','input_cached_tokens','input_cache_creation','output_reasoning_tokens','total'))), 0) AS others FROM x)"""


@query(f"""{_OBS} SELECT {sql_fold('project_id')} AS project, count(*) AS rows, count(*) FILTER (prompt IS NULL) AS without_usage, CAST(coalesce(sum(prompt), 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(completion), 0) AS BIGINT) AS completion_tokens,
CAST(coalesce(sum(c), 0) AS BIGINT) AS cache_read_tokens, CAST(sum(others) AS BIGINT) AS unknown_members, count(*) FILTER (t <> prompt + completion) AS total_mismatch, count(*) FILTER (total_cost IS NULL) AS without_cost, count(*) FILTER (level = 'ERROR') AS errors FROM y GROUP BY 1""")
def observation_report(spark: SparkSession, sf: str) -> DataFrame:
    return observations.report(read(spark, sf, "observations"))


@query(f"""{_OBS}, k AS (SELECT *, row_number() OVER (PARTITION BY {sql_fold('id')}, {sql_fold('project_id')} ORDER BY delivery_id) AS copy_no FROM y),
u AS (SELECT sha256(concat(length(project_id), ':', project_id, length(id), ':', id)) AS request_id, type = 'GENERATION' AS call, project_id AS api_key, provided_model_name AS model, prompt, completion, t, c, d, e, total_cost,
  coalesce(len(list_filter(map_values(usage_details), lambda v: v < 0)) > 0, false) AS bad FROM k WHERE id IS NOT NULL AND copy_no = 1)
SELECT api_key, coalesce(call, false) AS analysed, count(*) AS requests, count(DISTINCT request_id) AS ids, CAST(coalesce(sum(prompt) FILTER (call AND NOT bad), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(completion) FILTER (call AND NOT bad), 0) AS BIGINT) AS output_tokens,
count(*) FILTER (NOT coalesce(call, false) OR bad OR prompt IS NULL) AS missing, count(*) FILTER (call AND total_cost IS NOT NULL) AS priced FROM u GROUP BY ALL""")
def observation_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Observations, each message once, as usage rows."""
    obs = read(spark, sf, "observations").filter("id is not null")
    once = delivery.deduplicated(obs, "delivery_id", delivery.observation_identity(), delivery.observation_order())
    rows = classified(observations.usage_rows(once))
    return rows.groupBy("api_key", usage.supported().alias("analysed")).agg(
        F.count(F.lit(1)).alias("requests"), F.count_distinct("request_id").alias("ids"), F.coalesce(F.sum("input"), F.lit(0)).cast("bigint").alias("input_tokens"),
        F.coalesce(F.sum("output"), F.lit(0)).cast("bigint").alias("output_tokens"), F.sum("missing").cast("bigint").alias("missing"), F.count("amount").alias("priced"),
    )


@query("SELECT member, count(*) AS n, CAST(coalesce(sum(value), 0) AS BIGINT) AS tokens FROM (SELECT unnest(map_keys(usage_details)) AS member, unnest(map_values(usage_details)) AS value FROM observations) GROUP BY member")
def usage_members(spark: SparkSession, sf: str) -> DataFrame:
    return observations.member_counts(read(spark, sf, "observations"))


_FIELDS = ["type", "level", "provided_model_name", "user_id", "start_time"]


@query(f"""WITH g AS (SELECT {sql_fold('project_id')} AS project, {sql_fold('id')} AS message, count(*) AS copies, {', '.join(f'count(DISTINCT "{f}") AS d{i}, count("{f}") AS h{i}' for i, f in enumerate(_FIELDS))} FROM observations WHERE id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1),
f AS (SELECT project, message, copies, array_to_string(list_filter([{', '.join(f"CASE WHEN d{i} > 1 OR (h{i} > 0 AND h{i} < copies) THEN '{f}' END" for i, f in enumerate(_FIELDS))}], lambda v: v IS NOT NULL), ',') AS fields FROM g) SELECT * FROM f WHERE fields <> ''""")
def copy_disagreements(spark: SparkSession, sf: str) -> DataFrame:
    return observations.disagreements(read(spark, sf, "observations"), _FIELDS)


@query("SELECT array_to_string(list_sort(list_distinct(tags)), '|') AS tags, count(*) AS n FROM observations WHERE tags IS NOT NULL GROUP BY 1")
def tag_sets(spark: SparkSession, sf: str) -> DataFrame:
    return observations.tag_sets(read(spark, sf, "observations"))


_LABELS = ["call_type", "model", "model_group", "custom_llm_provider", "status", "team_id", "organization_id", "end_user"]


@query("SELECT label, CAST(sum(n) AS BIGINT) AS n, count(*) AS distinct_values, max(n) AS most FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS label, {c} AS value, count(*) AS n FROM synthetic WHERE {c} IS NOT NULL GROUP BY {c}" for c in _LABELS) + ") GROUP BY label")
def label_cardinality(spark: SparkSession, sf: str) -> DataFrame:
    return observations.label_cardinality(read(spark, sf, "synthetic"), _LABELS)


@query("""WITH p AS (SELECT user_id, CAST(ts AS DATE) AS day, avg(value) FILTER (event_type = 'view') AS source, avg(value) FILTER (event_type = 'click') AS target FROM events GROUP BY 1, 2), r AS (SELECT user_id % 5 AS workload, ln(target / source) AS r FROM p WHERE source > 0 AND target > 0),
g AS (SELECT workload, count(*) AS n, avg(r) AS m, stddev_samp(r) AS s FROM r GROUP BY 1) SELECT workload, n, round(exp(m), 6) AS ratio, round(exp(m - 1.959963984540054 * s / sqrt(n)), 6) AS low, round(exp(m + 1.959963984540054 * s / sqrt(n)), 6) AS high FROM g""")
def geo_mean_factor(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"), "event_type", "value")
    pairs = stats.paired(e, ["user_id", "day"], "event_type", "view", "click", "value")
    return stats.geometric_ratio(pairs.withColumn("workload", F.col("user_id") % 5), "source", "target", ["workload"])


@query(f"""{_WITH}, g AS (SELECT model, count(*) AS n, count(*) FILTER (failed = 1) AS hits FROM classified GROUP BY model), w AS (SELECT *, CAST(n AS DOUBLE) AS m, hits / CAST(n AS DOUBLE) AS p, 3.8414588206941254 AS z2 FROM g)
SELECT model, n, hits, round((p + z2 / (2 * m)) / (1 + z2 / m) - 1.959963984540054 * sqrt(p * (1 - p) / m + z2 / (4 * m * m)) / (1 + z2 / m), 9) AS low, round((p + z2 / (2 * m)) / (1 + z2 / m) + 1.959963984540054 * sqrt(p * (1 - p) / m + z2 / (4 * m * m)) / (1 + z2 / m), 9) AS high FROM w""")
def failure_intervals(spark: SparkSession, sf: str) -> DataFrame:
    g = _classified(spark, sf).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("failed") == 1).alias("hits"))
    low, high = stats.wilson(F.col("hits"), F.col("n"))
    return g.withColumns({"low": F.round(low, 9), "high": F.round(high, 9)})


_BARE = "CASE WHEN contains(model, '/') THEN substr(model, strpos(model, '/') + 1) ELSE model END"


@query(f"""WITH t AS (SELECT model, tier_no, min(max_prompt_tokens) AS m FROM price_tiers GROUP BY ALL), x AS (SELECT row_no, {_BARE} AS model, prompt_tokens FROM synthetic WHERE prompt_tokens IS NOT NULL),
j AS (SELECT x.row_no, x.model, x.prompt_tokens, min(t.tier_no) AS tier FROM x LEFT JOIN t ON t.model = x.model AND (t.m IS NULL OR x.prompt_tokens <= t.m) GROUP BY ALL)
SELECT model, tier, count(*) AS n, CAST(sum(prompt_tokens) AS BIGINT) AS tokens FROM j GROUP BY model, tier""")
def tier_usage(spark: SparkSession, sf: str) -> DataFrame:
    tiers = read(spark, sf, "price_tiers").groupBy("model", "tier_no").agg(F.min("max_prompt_tokens").alias("max_size"))
    bare = F.when(F.contains("model", F.lit("/")), F.split("model", "/", 2)[1]).otherwise(F.col("model"))
    rows = read(spark, sf, "synthetic").filter("prompt_tokens is not null").select(bare.alias("model"), "prompt_tokens")
    tiered = stats.first_tier(rows, tiers, ["model"], "prompt_tokens")
    return tiered.groupBy("model", "tier").agg(F.count(F.lit(1)).alias("n"), F.sum("prompt_tokens").cast("bigint").alias("tokens"))


# The same operators over exported requests ----------------------------------------------------

_REQUESTS = f"""WITH usage AS (SELECT row_no AS row_number, request_id, call_type, CASE WHEN regexp_full_match(startTime, '\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}(\\.\\d+)?(Z|[+-]\\d{{2}}:\\d{{2}})') THEN TRY_CAST(startTime AS TIMESTAMPTZ) AT TIME ZONE 'UTC' END AS start_time,
CAST(CASE WHEN regexp_full_match(endTime, '\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}(\\.\\d+)?(Z|[+-]\\d{{2}}:\\d{{2}})') THEN TRY_CAST(endTime AS TIMESTAMPTZ) AT TIME ZONE 'UTC' END AS TIMESTAMP) AS end_time, status, '' AS level, api_key, "user", team_id, end_user, session_id,
model, model_id, model_group AS route, CAST(prompt_tokens AS VARCHAR) AS prompt_tokens, CAST(completion_tokens AS VARCHAR) AS completion_tokens, CAST(total_tokens AS VARCHAR) AS total_tokens, '' AS cache_read_input_tokens, '' AS cache_write_input_tokens,
'' AS reasoning_output_tokens, CAST(spend AS VARCHAR) AS spend, '' AS rejection_kind FROM synthetic), {CLASSIFIED}"""


@query(f"""{_REQUESTS} SELECT model, count(*) AS n, CAST(sum(total) AS BIGINT) AS tokens, CAST(coalesce(sum(amount), 0) AS DECIMAL(38,6)) AS spend, {', '.join(f'CAST(sum({f}) AS BIGINT) AS {f}' for f in FLAGS)} FROM classified WHERE operation IS NOT NULL GROUP BY model""")
def request_quality(spark: SparkSession, sf: str) -> DataFrame:
    rows = classified(usage_from_requests(read(spark, sf, "synthetic"))).filter(usage.supported())
    return rows.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.sum("total").cast("bigint").alias("tokens"), F.coalesce(F.sum("amount"), F.lit(0)).cast("decimal(38,6)").alias("spend"), *[F.sum(f).cast("bigint").alias(f) for f in FLAGS]
    )




def _over_requests(name: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        token = _SOURCE.set("requests")
        try:
            return QUERIES[name](spark, sf)
        finally:
            _SOURCE.reset(token)

    run.__name__ = f"requests_{name}"
    run.__doc__ = f"As {name}, over exported requests by the time of export."
    return query(SQL[name].replace(EVENT_SQL, REQUEST_SQL))(run)


for _name in (
    "auto_periods", "window_totals", "quality_vector", "model_change", "volume_split", "volume_split_clear", "call_type_coverage", "movers_key", "movers_team", "movers_user", "movers_end_user", "movers_session",
    "increase_concentration", "contributor_excess", "distinct_groups_exact", "attribution_coverage", "failure_tokens", "routing_cohorts", "routing_field_coverage", "routing_overhead", "agent_partition", "session_rollup", "session_members",
    "session_quantiles", "session_summary", "session_shared_review", "scan_scalar_signals", "scan_top_share", "usage_histogram", "cusum_rolling",
):
    _over_requests(_name)
