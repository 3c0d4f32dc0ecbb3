"""Queries of the general data problems (p1, p2, p5, p7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import SPACES, sql_fold
from ledgerloom.operators import delivery, drift, rejects, timestamps
from ledgerloom.session import read


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    obs = read(spark, sf, "observations").select("delivery_id", "ingested_at", "id", "project_id")
    return delivery.repeated_deliveries(obs, "delivery_id", delivery.observation_identity(), delivery.observation_order()).select("delivery_id")


_PLAIN = ("delivery_id", "batch_id", "id", "project_id", "type", "start_time", "end_time", "total_cost", "provided_model_name", "user_id", "session_id", "environment", "release", "trace_name", "prompt_name", "level")


def p1_messages(spark: SparkSession, sf: str) -> DataFrame:
    """One whole row of each message; maps, lists and times as text."""
    obs = read(spark, sf, "observations")
    kept = delivery.deduplicated(obs, "delivery_id", delivery.observation_identity(), delivery.observation_order())
    usage = F.transform(F.array_sort(F.map_entries("usage_details")), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"].cast("string"), F.lit("null"))))
    return kept.select(
        *_PLAIN,
        F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ingested_at"),
        F.array_join(usage, ",").alias("usage_details"),
        F.array_join("tags", ",", "null").alias("tags"),
    )


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return drift.changes(read(spark, sf, "export_lines"), read(spark, sf, "export_files"))


def p2_table(spark: SparkSession, sf: str) -> DataFrame:
    return drift.consistent_table(read(spark, sf, "export_lines"))


def _times(spark: SparkSession, sf: str, table: str, row_key: str, fields: list[str], owner: str, kind: str, cases_only: bool) -> list[DataFrame]:
    owners = timestamps.zone_owners(read(spark, sf, "time_zones"), kind)
    rows = read(spark, sf, table)
    if len(fields) > 1:
        named = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]))
        rows = rows.select(F.col(row_key).alias("row_key"), F.col(owner).alias("owner"), named.alias("x")).select("row_key", "owner", "x.field", "x.value")
    else:
        rows = rows.select(F.col(row_key).alias("row_key"), F.col(owner).alias("owner"), F.lit(fields[0]).alias("field"), F.col(fields[0]).alias("value"))
    utc = timestamps.normalised(rows, "value", "owner", owners, ["row_key", "field"], cases_only=cases_only)
    return [utc.withColumn("table_name", F.lit(table))]


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    parts = _times(spark, sf, "synthetic", "row_no", ["startTime"], "organization_id", "organization", True)
    parts += _times(spark, sf, "observations", "delivery_id", ["start_time", "end_time"], "project_id", "project", True)
    return parts[0].unionByName(parts[1]).select("table_name", "row_key", "field", "utc")


def p5_masks(spark: SparkSession, sf: str) -> DataFrame:
    """Masks of all times, and which of them no parser reads."""
    one = read(spark, sf, "synthetic").select(F.lit("startTime").alias("field"), F.col("startTime").alias("v"))
    both = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("v")) for f in ("start_time", "end_time")])).alias("x")
    rows = one.unionByName(read(spark, sf, "observations").select(both).select("x.field", "x.v"))
    return timestamps.mask_report(rows, "v", ["field"]).select("field", "mask", "n")


def p5_zones(spark: SparkSession, sf: str) -> DataFrame:
    """Zones of the owners with the version of the rules used."""
    return timestamps.zones_used(spark, read(spark, sf, "time_zones").filter("time_zone is not null"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return rejects.rejected(read(spark, sf, "spend_lines"))


def p7_rows(spark: SparkSession, sf: str) -> DataFrame:
    return rejects.loaded(read(spark, sf, "spend_lines"))


QUERIES = {q.__name__: q for q in (p1_found, p1_messages, p2_found, p2_table, p5_found, p5_masks, p5_zones, p7_found, p7_rows)}

_RANKED = f"""SELECT *, row_number() OVER (PARTITION BY {sql_fold('id')}, {sql_fold('project_id')} ORDER BY delivery_id) AS copy_no FROM observations"""
#: A CSV record by RFC 4180, and one cell of it.
_RECORD = r"""(?:"(?:[^"]|"")*"|[^",\r\n]*)(?:,(?:"(?:[^"]|"")*"|[^",\r\n]*))*"""
_P7 = rf"""WITH r AS (
  SELECT line_id, file_name, line_no, raw_line, regexp_full_match(raw_line, '{_RECORD}') AS fits,
         list_transform(regexp_extract_all(',' || raw_line, ',("(?:[^"]|"")*"|[^",\r\n]*)', 1),
           lambda x: CASE WHEN starts_with(x, '"') THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) AS cells
  FROM spend_lines),
h AS (SELECT file_name, cells AS names FROM r WHERE line_no = 1),
b AS (SELECT line_id, file_name, fits, cells, names, cells[list_position(names, 'spend')] AS spend, cells[list_position(names, 'prompt_tokens')] AS prompt_tokens,
        cells[list_position(names, 'status')] AS status FROM r JOIN h USING (file_name) WHERE line_no <> 1),
f AS (SELECT line_id, file_name, cells, names, CASE WHEN NOT fits THEN ['quoting'] WHEN len(cells) <> len(names) THEN ['columns'] ELSE list_concat(
        CASE WHEN list_contains(names, 'spend') AND NOT (spend = '' OR regexp_full_match(spend, '([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?')) THEN ['spend'] ELSE [] END,
        CASE WHEN list_contains(names, 'prompt_tokens') AND NOT (regexp_full_match(prompt_tokens, '[0-9]+')
          AND coalesce(TRY_CAST(prompt_tokens AS HUGEINT) <= 9223372036854775807, false)) THEN ['prompt_tokens'] ELSE [] END,
        CASE WHEN list_contains(names, 'status') AND status NOT IN ('success', 'failure', '') THEN ['status'] ELSE [] END) END AS reasons FROM b)
"""
_TEXTS = ("request_id", "call_type", "api_key", "user", "team_id", "end_user", "model", "status", "session_id", "startTime", "endTime")
_WHOLES = ("prompt_tokens", "completion_tokens", "total_tokens", "cache_read_input_tokens", "cache_write_input_tokens")
_CELL = "nullif(cells[list_position(names, '{0}')], '')"

_KEYS = "'input', 'input_cache_creation', 'output', 'output_reasoning_tokens'"
_P2 = rf"""WITH j AS (SELECT file_key, line_no, CASE WHEN json_valid(raw_line) THEN json_extract(raw_line, '$.usage_details') END AS u FROM export_lines),
l AS (SELECT *, TRY_CAST(u->>'total' AS BIGINT) - {' - '.join(f"coalesce(TRY_CAST(u->>{k.strip()} AS BIGINT), 0)" for k in _KEYS.split(','))} AS rest FROM j WHERE json_type(u) = 'OBJECT' AND len(json_keys(u)) > 0),
m AS (SELECT file_key, rest, k AS member, json_type(u, '$."' || k || '"') AS t, CAST(json_extract(u, '$."' || k || '"') AS VARCHAR) AS v FROM l, unnest(json_keys(u)) AS x(k) WHERE k NOT IN ({_KEYS}, 'total')),
n AS (SELECT file_key, count(*) FILTER (rest > 0) AS lines_left FROM l GROUP BY 1),
c AS (SELECT file_key, member, coalesce(list_sort(list(DISTINCT CASE WHEN t IN ('UBIGINT', 'BIGINT') THEN 'integer' WHEN t = 'DOUBLE' THEN 'decimal' ELSE t END) FILTER (t <> 'NULL')), []) AS types,
  count(*) FILTER (t <> 'NULL') AS held, count(*) FILTER (t <> 'NULL' AND rest > 0) AS held_left, count(*) FILTER (t <> 'NULL' AND rest <= 0) AS held_none,
  count(*) FILTER (t <> 'NULL' AND rest > 0 AND TRY_CAST(regexp_extract(v, '-?\d+(?:\.\d+)?') AS DECIMAL(38,9)) = rest) AS matches,
  count(*) FILTER (t <> 'NULL' AND rest > 0 AND TRY_CAST(regexp_extract(v, '-?\d+(?:\.\d+)?') AS DECIMAL(38,9)) <> rest) AS differs FROM m GROUP BY 1, 2),
o AS (SELECT *, held_none + lines_left - held_left AS against FROM c JOIN n USING (file_key)),
w AS (SELECT *, CASE WHEN against > 0 AND matches = 0 THEN 1 WHEN matches > 0 AND differs = 0 AND against = 0 THEN 0 WHEN against > matches THEN 1 WHEN matches > differs THEN 0 WHEN differs > 0 THEN 1 WHEN held_left > 0 THEN 0 END AS vote FROM o),
y AS (SELECT member, arg_min(vote, (-k, vote)) AS usual FROM (SELECT member, vote, count(*) AS k FROM w WHERE vote IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
r AS (SELECT w.*, coalesce(vote, usual, 1) AS reading FROM w LEFT JOIN y USING (member)),
p AS (SELECT *, row_number() OVER (PARTITION BY file_key ORDER BY reading, -matches, member) AS place, count(*) OVER (PARTITION BY file_key) AS members FROM r),
h AS (SELECT file_key, max(CASE WHEN place = 1 AND (reading = 0 OR members > 1) THEN {{'m': member, 't': types}} END) AS c, max(CASE WHEN place = 2 OR (place = 1 AND reading = 1 AND members = 1) THEN {{'m': member, 't': types}} END) AS u FROM p GROUP BY 1),
f AS (SELECT project_id, file_key, c, u, lag(c) OVER s AS c0, lag(u) OVER s AS u0, row_number() OVER s AS n FROM (SELECT DISTINCT project_id, file_key, window_start FROM export_files) LEFT JOIN h USING (file_key)
  WINDOW s AS (PARTITION BY project_id ORDER BY window_start NULLS FIRST, file_key)),
g AS (SELECT project_id, file_key, c AS a, c0 AS b FROM f WHERE n > 1 UNION ALL SELECT project_id, file_key, u, u0 FROM f WHERE n > 1)
SELECT project_id, file_key, a.m AS member, 'added' AS change FROM g WHERE a IS NOT NULL AND b IS NULL UNION ALL SELECT project_id, file_key, b.m, 'removed' FROM g WHERE a IS NULL AND b IS NOT NULL
UNION ALL SELECT project_id, file_key, a.m, 'renamed' FROM g WHERE a.m <> b.m UNION ALL SELECT project_id, file_key, a.m, 'type_changed' FROM g WHERE a IS NOT NULL AND b IS NOT NULL AND a.t <> b.t"""
_TRIMMED = "trim(v, " + "||".join(f"chr({ord(c)})" for c in SPACES) + ")"
SQL = {
    "p2_found": _P2,
    "p5_masks": f"""SELECT field, mask, count(*) AS n FROM (SELECT field, CASE WHEN regexp_full_match({_TRIMMED}, '[\\x00-\\x7f]*') THEN
  regexp_replace(regexp_replace({_TRIMMED}, '[0-9]', '9', 'g'), '[A-Za-z]', 'a', 'g') ELSE '?' END AS mask FROM (SELECT 'startTime' AS field, "startTime" AS v FROM synthetic
  UNION ALL SELECT 'start_time', start_time FROM observations UNION ALL SELECT 'end_time', end_time FROM observations) WHERE {_TRIMMED} <> '') GROUP BY ALL""",
    "p1_found": f"SELECT delivery_id FROM ({_RANKED}) WHERE id IS NOT NULL AND copy_no > 1",
    "p1_messages": f"""SELECT {', '.join(_PLAIN)}, strftime(ingested_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S.%f') AS ingested_at,
  CASE WHEN usage_details IS NOT NULL THEN array_to_string(list_sort(list_transform(map_keys(usage_details), lambda k: k || '=' || coalesce(usage_details[k]::VARCHAR, 'null'))), ',') END AS usage_details,
  CASE WHEN tags IS NOT NULL THEN array_to_string(list_transform(tags, lambda t: coalesce(t, 'null')), ',') END AS tags
FROM ({_RANKED}) WHERE id IS NULL OR copy_no = 1""",
    "p7_found": _P7 + "SELECT line_id, unnest(reasons) AS reason FROM f",
    "p7_rows": _P7
    + "SELECT line_id, file_name, "
    + ", ".join(f"{_CELL.format(c)} AS \"{c}\"" for c in _TEXTS)
    + ", "
    + ", ".join(f"CASE WHEN regexp_full_match({_CELL.format(c)}, '-?[0-9]+') THEN TRY_CAST({_CELL.format(c)} AS BIGINT) END AS {c}" for c in _WHOLES)
    + f", TRY_CAST({_CELL.format('spend')} AS DECIMAL(38,18)) AS spend FROM f WHERE len(reasons) = 0",
}
