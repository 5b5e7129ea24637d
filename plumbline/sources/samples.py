"""Monitoring tables derived from the given star-schema tables.

The tables hold no reports, so weekly sums of events stand for readings and
quarterly sums of line items for borehole profiles, with errors put in at
arithmetic conditions so that what is wrong is known. A report is 15 users (or
five suppliers), so that there are more reports, not longer ones, in more data. The same SQL text runs in
Spark and in the oracle's engine; ``{days}`` is the only difference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.store import computed_once

_DAYS = {"spark": "datediff(CAST({0} AS DATE), DATE '{1}')", "duckdb": "datediff('day', DATE '{1}', CAST({0} AS DATE))"}

_POINTS = """
SELECT CAST(floor(u / 15.0) AS BIGINT) AS report_id, w * 5 + k AS table_idx, CAST(row_number() OVER (PARTITION BY CAST(floor(u / 15.0) AS BIGINT), w * 5 + k ORDER BY u) AS INT) - 1 AS row_no, 'U' || CAST(u AS STRING) AS point_id,
  CASE WHEN k = 3 THEN start / 1000.0 ELSE start END AS initial_value, CAST(NULL AS DOUBLE) AS previous_value,
  CASE WHEN k = 3 THEN (start + drift) / 1000.0 ELSE start + drift END AS current_value,
  cc AS current_change, cum AS cumulative_change,
  round(cc / 7, 3) + CASE WHEN (u + w) % 29 = 0 THEN 0.5 ELSE 0 END AS change_rate,
  CASE WHEN u % 13 = 0 THEN '' WHEN abs(cum) >= 60 AND u % 7 <> 0 THEN '报警' ELSE '正常' END AS safety_status
FROM (
  SELECT u, w, k, cc, cum, CAST(1000 + u % 50 AS DOUBLE) AS start,
    CASE WHEN (u + w) % 17 = 0 THEN -cum ELSE cum END + CASE WHEN (u + 5 * w) % 31 = 0 THEN 3 ELSE 0 END AS drift
  FROM (
    SELECT u, w, k, CAST(v AS DOUBLE) AS cc, CAST(sum(v) OVER (PARTITION BY u, k ORDER BY w) + CASE WHEN (7 * u + 3 * w) % 23 = 0 THEN 25 ELSE 0 END AS DOUBLE) AS cum
    FROM (
      SELECT user_id AS u, CAST(floor({week} / 7.0) AS BIGINT) AS w, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS k,
        CAST(sum(CASE WHEN event_id % 3 = 0 THEN -CAST(value AS DECIMAL(18, 2)) ELSE CAST(value AS DECIMAL(18, 2)) END) AS DECIMAL(18, 2)) AS v
      FROM {events} GROUP BY 1, 2, 3) a) b) c
"""

_TABLES = """
SELECT report_id, table_idx, k, w, CASE k WHEN 0 THEN '坡顶水平位移' WHEN 1 THEN '地下水位' WHEN 2 THEN '锚索拉力' WHEN 3 THEN '地面沉降' ELSE '立柱竖向位移' END || '-G' || CAST(report_id AS STRING) AS monitoring_item,
  CASE k WHEN 0 THEN 'HORIZONTAL_DISP' WHEN 1 THEN 'WATER_LEVEL' WHEN 2 THEN 'ANCHOR_FORCE' WHEN 3 THEN 'SETTLEMENT' ELSE 'VERTICAL_DISP' END AS category,
  CAST(DATE '2024-01-01' + CAST(7 * w AS INT) AS STRING) AS monitor_date, '第' || CAST(w + 1 AS STRING) || '次' AS monitor_count,
  CAST(n + CASE WHEN table_idx % 7 = 0 THEN n ELSE 0 END AS INT) AS point_count, '' AS borehole_id,
  CASE k WHEN 2 THEN 'kN' WHEN 3 THEN 'm' ELSE 'mm' END AS table_unit, true AS initial_value_reliable,
  CASE WHEN table_idx % 4 = 0 THEN CAST(9 AS DOUBLE) WHEN table_idx % 4 = 1 THEN CAST(8 AS DOUBLE) END AS interval_days
FROM (SELECT report_id, table_idx, table_idx % 5 AS k, CAST(floor(table_idx / 5.0) AS BIGINT) AS w, count(*) AS n FROM {points} GROUP BY report_id, table_idx) t
"""

_DEEP = """
SELECT b AS report_id, q AS table_idx, CAST(row_number() OVER (PARTITION BY b, q ORDER BY n) AS INT) - 1 AS row_no, n * CAST(0.5 AS DOUBLE) AS depth,
  run - v + CASE WHEN (b + q + n) % 19 = 0 THEN 5 ELSE 0 END AS previous_cumulative, run AS current_cumulative, v AS current_change,
  round(v / 91, 3) + CASE WHEN (b + 2 * q + n) % 29 = 0 THEN 0.5 ELSE 0 END AS change_rate
FROM (
  SELECT b, q, n, CAST(v AS DOUBLE) AS v, CAST(sum(v) OVER (PARTITION BY b, n ORDER BY q) AS DOUBLE) AS run
  FROM (
    SELECT CAST(floor(l_suppkey / 5.0) AS BIGINT) AS b, CAST(floor({day} / 91.0) AS BIGINT) AS q, l_linenumber AS n, CAST(sum(CAST(l_quantity - 25 AS DECIMAL(18, 2))) AS DECIMAL(18, 2)) AS v
    FROM {lineitem} GROUP BY 1, 2, 3) a) c
"""

_STATS = """
SELECT t.report_id, t.table_idx,
  'U' || CAST(t.w AS STRING) AS unused, s.pos_id AS positive_max_id, s.pos + CASE WHEN t.table_idx % 3 = 0 THEN 2 ELSE 0 END AS positive_max_value,
  s.neg_id AS negative_max_id, s.neg - CASE WHEN t.table_idx % 4 = 0 THEN 2 ELSE 0 END AS negative_max_value,
  CASE WHEN t.table_idx % 6 = 1 THEN 'Z9' ELSE s.rate_id END AS max_rate_id, s.rate * CASE WHEN t.table_idx % 5 = 2 THEN -1 ELSE 1 END AS max_rate_value,
  CASE WHEN t.category = 'ANCHOR_FORCE' THEN s.top_id END AS max_force_id, CASE WHEN t.category = 'ANCHOR_FORCE' THEN s.top + t.table_idx % 2 END AS max_force_value,
  CASE WHEN t.category = 'ANCHOR_FORCE' THEN s.low_id END AS min_force_id, CASE WHEN t.category = 'ANCHOR_FORCE' THEN s.low + (t.table_idx % 3) * 0.1 END AS min_force_value
FROM {tables} t JOIN (
  SELECT report_id, table_idx, max(cumulative_change) AS pos, min(cumulative_change) AS neg, max(abs(change_rate)) AS rate, max(current_value) AS top, min(current_value) AS low,
    min(CASE WHEN p = 1 THEN point_id END) AS pos_id, min(CASE WHEN n = 1 THEN point_id END) AS neg_id, min(CASE WHEN r = 1 THEN point_id END) AS rate_id,
    min(CASE WHEN h = 1 THEN point_id END) AS top_id, min(CASE WHEN l = 1 THEN point_id END) AS low_id
  FROM (SELECT *, row_number() OVER (PARTITION BY report_id, table_idx ORDER BY cumulative_change DESC, row_no) AS p, row_number() OVER (PARTITION BY report_id, table_idx ORDER BY cumulative_change, row_no) AS n,
      row_number() OVER (PARTITION BY report_id, table_idx ORDER BY abs(change_rate) DESC, row_no) AS r, row_number() OVER (PARTITION BY report_id, table_idx ORDER BY current_value DESC, row_no) AS h,
      row_number() OVER (PARTITION BY report_id, table_idx ORDER BY current_value, row_no) AS l FROM {points}) x
  GROUP BY report_id, table_idx) s ON t.report_id = s.report_id AND t.table_idx = s.table_idx
"""

_DEEP_TABLES = """
SELECT report_id, table_idx, '深层水平位移' AS monitoring_item, 'DEEP_HORIZONTAL' AS category, CAST(DATE '1995-01-01' + CAST(91 * table_idx AS INT) AS STRING) AS monitor_date, '' AS monitor_count,
  CAST(n AS INT) AS point_count, 'C' || CAST(report_id AS STRING) AS borehole_id, 'mm' AS table_unit, true AS initial_value_reliable,
  CASE WHEN table_idx % 3 = 0 THEN CAST(90 AS DOUBLE) WHEN table_idx % 3 = 1 THEN CAST(30 AS DOUBLE) END AS interval_days
FROM (SELECT report_id, table_idx, count(*) AS n FROM {deep} GROUP BY report_id, table_idx) x
"""

_DEEP_STATS = """
SELECT report_id, table_idx, '' AS positive_max_id, max(current_cumulative) + CASE WHEN table_idx % 4 = 0 THEN 1 ELSE 0 END AS positive_max_value,
  CAST(NULL AS STRING) AS negative_max_id, min(current_cumulative) AS negative_max_value, '' AS max_rate_id, max(abs(change_rate)) + CASE WHEN table_idx % 5 = 0 THEN 1 ELSE 0 END AS max_rate_value,
  '深度' || CAST(max(depth) AS STRING) || 'm' AS max_change_id, CASE WHEN table_idx % 2 = 0 THEN max(abs(current_change)) ELSE max(CASE WHEN depth = 3.5 THEN current_cumulative END) END AS max_change_value,
  CAST(NULL AS STRING) AS max_force_id, CAST(NULL AS DOUBLE) AS max_force_value, CAST(NULL AS STRING) AS min_force_id, CAST(NULL AS DOUBLE) AS min_force_value
FROM {deep} GROUP BY report_id, table_idx
"""

_THRESHOLDS = """
SELECT r AS report_id, CAST(i AS INT) AS th_no, CASE i WHEN 0 THEN '水平位移' WHEN 1 THEN '地下水位变化' WHEN 2 THEN '立柱竖向位移-G' || CAST(r AS STRING) ELSE '桥面裂缝' END AS item_name,
  CAST(40 + 10 * i AS DOUBLE) AS warning_value, CAST(60 + 10 * i AS DOUBLE) AS control_value, CAST(4 AS DOUBLE) AS rate_limit
FROM (SELECT DISTINCT report_id AS r FROM {tables}) x CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) y
"""


def _days(engine: str, column: str, since: str) -> str:
    return _DAYS[engine].format(column, since)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sample(spark: SparkSession, sf_dir: str, *kept: str) -> dict[str, DataFrame]:
    """points, mon_tables, deep_points, table_stats and thresholds over the given tables; those in ``kept`` (points, deep_points) are computed once."""
    points = spark.sql(_POINTS.replace("{week}", _days("spark", "ts", "2024-01-01")), events=read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value"))
    deep = spark.sql(_DEEP.replace("{day}", _days("spark", "l_shipdate", "1995-01-01")), lineitem=read(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", "l_quantity", "l_shipdate"))
    own = held({"points": points, "deep_points": deep}, *kept)
    points, deep = own["points"], own["deep_points"]
    tables = spark.sql(_TABLES, points=points)
    return {"points": points, "mon_tables": tables, "deep_points": deep, "table_stats": spark.sql(_STATS, tables=tables, points=points).drop("unused"), "thresholds": spark.sql(_THRESHOLDS, tables=tables),
            "deep_tables": spark.sql(_DEEP_TABLES, deep=deep), "deep_stats": spark.sql(_DEEP_STATS, deep=deep)}


def held(x: dict[str, DataFrame], *names: str) -> dict[str, DataFrame]:
    """x with these tables computed once, in the shared folder: for queries that go over them many times."""
    return x | {name: computed_once(x[name]) for name in names}


def sample_sql() -> str:
    """The same tables as common table expressions p, t, d, s and th for the oracle."""
    return ",\n".join([
        "p AS (" + _POINTS.replace("{week}", _days("duckdb", "ts", "2024-01-01")).replace("{events}", "events") + ")",
        "t AS (" + _TABLES.replace("{points}", "p") + ")",
        "d AS (" + _DEEP.replace("{day}", _days("duckdb", "l_shipdate", "1995-01-01")).replace("{lineitem}", "lineitem") + ")",
        "s AS (" + _STATS.replace("{tables}", "t").replace("{points}", "p") + ")",
        "th AS (" + _THRESHOLDS.replace("{tables}", "t") + ")",
        "dt AS (" + _DEEP_TABLES.replace("{deep}", "d") + ")",
        "ds AS (" + _DEEP_STATS.replace("{deep}", "d") + ")",
    ])
