"""Queries over the sample reports, one for each rule, with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calc, config, stats
from ..operators.issues import TABLE
from ..sources.samples import sample, sample_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_CONFIG = """,
el AS (SELECT report_id, table_idx, bool_or(abs(initial_value) < 100 AND abs(current_value) < 100 AND abs(cumulative_change) > 1) AS elevation FROM p WHERE row_no < 5 GROUP BY 1, 2),
mr AS (SELECT report_id, table_idx, r[n // 2 + 1] AS m FROM (SELECT report_id, table_idx, list_sort(list(cumulative_change / (current_value - initial_value))) AS r, count(*) AS n FROM p
  WHERE abs(current_value - initial_value) >= 1e-5 AND abs(cumulative_change) >= 0.05 GROUP BY 1, 2) WHERE n >= 5),
tw AS (SELECT t.*, category IN ('SETTLEMENT', 'VERTICAL_DISP') AND table_unit <> 'm' AND coalesce(elevation, false) AS elevated, category IN ('ANCHOR_FORCE', 'STRUT_FORCE') AS force, category = 'WATER_LEVEL' AS water, m FROM t LEFT JOIN el USING (report_id, table_idx) LEFT JOIN mr USING (report_id, table_idx)),
cfg AS (SELECT report_id, table_idx, category, CASE WHEN force THEN 'kN' WHEN elevated THEN 'm' ELSE table_unit END AS unit,
  CASE WHEN force THEN 1.0 WHEN table_unit = 'm' OR elevated THEN 1000.0 WHEN category NOT IN ('SETTLEMENT', 'VERTICAL_DISP', 'WATER_LEVEL') AND m BETWEEN 950 AND 1050 THEN 1000.0 ELSE 1.0 END::DOUBLE AS unit_conversion,
  CASE WHEN water THEN 10.0 WHEN table_unit = 'm' OR elevated THEN 1.0 ELSE 0.15 END::DOUBLE AS cumulative_tolerance, 0.05::DOUBLE AS rate_tolerance, interval_days,
  NOT (water OR table_unit = 'm' OR elevated) AS initial_value_reliable, CASE WHEN NOT force AND (water OR table_unit = 'm' OR elevated) THEN 'warning' ELSE 'error' END AS severity_for_cumulative FROM tw)"""


def _chosen(implied: str, tables: str) -> str:
    return f""",
iv AS ({implied}),
inf AS (SELECT report_id, table_idx, r AS inferred FROM (SELECT *, row_number() OVER (PARTITION BY report_id, table_idx ORDER BY n DESC, seen) AS k FROM (SELECT report_id, table_idx, round_even(days, 0) AS r, count(*) AS n, min(row_no) AS seen FROM iv GROUP BY 1, 2, 3)) WHERE k = 1),
sup AS (SELECT report_id, table_idx, avg(CASE WHEN abs(days - interval_days) <= greatest(0.5, interval_days * 0.2::DOUBLE) THEN 1.0 ELSE 0.0 END) AS fc, avg(CASE WHEN abs(days - inferred) <= greatest(0.5, inferred * 0.2::DOUBLE) THEN 1.0 ELSE 0.0 END) AS fi FROM iv JOIN {tables} USING (report_id, table_idx) JOIN inf USING (report_id, table_idx) GROUP BY 1, 2),
ch AS (SELECT c.report_id, c.table_idx, CASE WHEN inferred IS NULL THEN interval_days WHEN interval_days IS NULL OR abs(inferred - interval_days) <= 2 THEN inferred WHEN fi >= 0.5 AND fi > fc THEN inferred ELSE interval_days END AS chosen_days, inferred
  FROM {tables} c LEFT JOIN inf USING (report_id, table_idx) LEFT JOIN sup USING (report_id, table_idx))"""


_FLAT_CHOSEN = _chosen("SELECT report_id, table_idx, row_no, abs(current_change / change_rate) AS days FROM p WHERE abs(change_rate) > 1e-6 AND abs(current_change / change_rate) > 0.5 AND abs(current_change / change_rate) < 365", "cfg")
_DEEP_CHOSEN = _chosen("SELECT report_id, table_idx, row_no, round_even(abs(current_change) / abs(change_rate), 0) AS days FROM d WHERE abs(change_rate) > 1e-6 AND abs(current_change) > 1e-6 AND abs(current_change) / abs(change_rate) > 0.5 AND abs(current_change) / abs(change_rate) < 365", "dt")


SHIFT = 100000  # deep tables stand behind a report's flat ones


def _tables(spark: SparkSession, sf_dir: str, *kept: str) -> dict[str, DataFrame]:
    x = sample(spark, sf_dir, *kept)
    behind = lambda df: df.withColumn("table_idx", F.col("table_idx") + SHIFT)
    x |= {"all_tables": x["mon_tables"].drop("k", "w").unionByName(behind(x["deep_tables"])), "behind": behind(x["deep_points"])}
    return x | {"config": config.base_config(x["mon_tables"], x["points"]), "deep_config": config.base_config(x["deep_tables"], x["points"].limit(0))}


# Queries that go over the points (or depths) many times.
KEPT = {"cal_03_rate": ["points"], "cal_06_deep_rate": ["deep_points"], "cal_07_first_period": ["points"], "cal_08_continuity": ["points"], "sta_03_04_positive_max": ["points"], "sta_05_negative_max": ["points"], "sta_06_07_max_rate": ["points"], "sta_09_deep_max_change": ["deep_points"]}


def _query(name: str, build: Callable[[dict[str, DataFrame]], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(_tables(spark, sf_dir, *KEPT.get(name, [])))
    if sql is not None:
        ORACLES[name] = f"WITH {sample_sql()}{_CONFIG}{sql}"


_ISSUE = "SELECT report_id, table_idx, {row} AS row_no, {point} AS point_id, '{rule}' AS rule_id, {severity} AS severity, CAST({expected} AS DOUBLE) AS expected_num, CAST({actual} AS DOUBLE) AS actual_num FROM {source} WHERE {where}"


def _issue(rule: str, source: str, where: str, expected: str = "NULL", actual: str = "NULL", severity: str = "'error'", point: str = "point_id", row: str = "row_no") -> str:
    return _ISSUE.format(rule=rule, source=source, where=where, expected=expected, actual=actual, severity=severity, point=point, row=row)


_query("cfg_01_base", lambda x: x["config"], " SELECT * FROM cfg")
_query("cfg_02_mixed_units", lambda x: config.mixed_unit_ratio(x["points"]), " SELECT report_id, table_idx, CASE WHEN m BETWEEN 950 AND 1050 THEN 1000.0 WHEN m BETWEEN 0.95 AND 1.05 THEN 1.0 END::DOUBLE AS ratio FROM mr")
_query("cfg_03_elevation", lambda x: config.looks_like_elevation(x["points"]), " SELECT report_id, table_idx, elevation FROM el")
_query("cfg_04_inferred_interval", lambda x: config.infer_interval(x["points"]), _FLAT_CHOSEN + " SELECT report_id, table_idx, inferred FROM inf")
_query(
    "cfg_05_support", lambda x: config.interval_support(config._intervals(x["points"]), x["config"].where("interval_days is not null").select(*TABLE, F.col("interval_days").alias("days_candidate"))),
    _FLAT_CHOSEN + " SELECT report_id, table_idx, interval_days AS days_candidate, avg(CASE WHEN abs(days - interval_days) <= greatest(0.5, interval_days * 0.2::DOUBLE) THEN 1.0 ELSE 0.0 END) AS support FROM iv JOIN cfg USING (report_id, table_idx) WHERE interval_days IS NOT NULL GROUP BY 1, 2, 3",
)
_query("cfg_06_chosen_interval", lambda x: config.choose_interval(x["points"], x["config"]), _FLAT_CHOSEN + " SELECT * FROM ch")
_query("cfg_07_deep_interval", lambda x: config.choose_deep_interval(x["deep_points"], x["deep_config"]), _DEEP_CHOSEN + " SELECT * FROM ch")
_query(
    "cfg_08_needs_review", lambda x: config.needs_review(x["points"].withColumn("initial_value", F.when(F.col("table_idx") % 2 == 0, F.col("initial_value") * 1000).otherwise(F.col("initial_value"))), x["config"]),
    """, f AS (SELECT report_id, table_idx, CASE WHEN cumulative_change = 0 THEN 0.0::DOUBLE ELSE abs((current_value - CASE WHEN table_idx % 2 = 0 THEN initial_value * 1000 ELSE initial_value END) / cumulative_change) END AS ratio FROM p WHERE row_no = 0)
SELECT report_id, table_idx, ratio FROM f JOIN cfg USING (report_id, table_idx) WHERE unit_conversion <> 1000 AND initial_value_reliable AND (ratio < 0.01 OR ratio > 100)""",
)
_suggested = "SELECT report_id, table_idx, CASE WHEN table_idx % 3 = 0 THEN 'mm' WHEN table_idx % 3 = 1 THEN 'm' END AS unit, CASE WHEN table_idx % 4 = 0 THEN true END AS reliable, CASE table_idx % 5 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'info' WHEN 2 THEN 'bad' END AS severity FROM {0}"
_query(
    "cfg_09_suggestions", lambda x: config.apply_suggestions(x["config"], x["config"].sparkSession.sql(_suggested.format("{c}"), c=x["config"])),
    f""", sg AS ({_suggested.format('cfg')})
SELECT report_id, table_idx, category, CASE WHEN c.unit = 'm' AND sg.unit = 'mm' THEN 'm' ELSE coalesce(sg.unit, c.unit) END AS unit,
  CASE WHEN CASE WHEN c.unit = 'm' AND sg.unit = 'mm' THEN 'm' ELSE coalesce(sg.unit, c.unit) END = 'm' THEN 1000.0 WHEN sg.unit = 'mm' THEN 1.0 ELSE unit_conversion END::DOUBLE AS unit_conversion, cumulative_tolerance, rate_tolerance, interval_days,
  coalesce(reliable, initial_value_reliable) AS initial_value_reliable, CASE WHEN c.unit = 'm' AND lower(severity) = 'error' THEN severity_for_cumulative WHEN lower(severity) IN ('error', 'warning', 'info') THEN lower(severity) ELSE severity_for_cumulative END AS severity_for_cumulative
FROM cfg c JOIN sg USING (report_id, table_idx)""",
)

_RAW = "(SELECT * FROM p JOIN cfg USING (report_id, table_idx))"
_query("cal_01_force", lambda x: calc.check_force(x["points"], x["config"]), " " + _issue("CAL-01", _RAW, "category = 'ANCHOR_FORCE' AND initial_value_reliable AND abs(current_value - initial_value - cumulative_change) > cumulative_tolerance", "current_value - initial_value", "cumulative_change"))
_query("cal_02_cumulative", lambda x: calc.check_cumulative(x["points"], x["config"]), " " + _issue("CAL-02", _RAW, "category <> 'ANCHOR_FORCE' AND initial_value_reliable AND abs((current_value - initial_value) * unit_conversion - cumulative_change) > CASE WHEN abs(cumulative_change) > 10 THEN greatest(cumulative_tolerance, abs(cumulative_change) * 0.05::DOUBLE) ELSE cumulative_tolerance END", "(current_value - initial_value) * unit_conversion", "cumulative_change", "severity_for_cumulative"))
_query(
    "cal_03_rate", lambda x: calc.check_rate(x["points"], x["config"]),
    _FLAT_CHOSEN + " " + _issue("CAL-03", "(SELECT cfg.report_id, cfg.table_idx FROM cfg JOIN ch USING (report_id, table_idx) WHERE category <> 'ANCHOR_FORCE' AND chosen_days IS NULL)", "true", severity="'info'", point="'ALL'", row="NULL") + " UNION ALL "
    + _issue("CAL-03", f"(SELECT *, CASE WHEN abs(change_rate) > 1e-6 THEN abs(current_change / change_rate) ELSE 0 END AS own FROM {_RAW} JOIN ch USING (report_id, table_idx))", "category <> 'ANCHOR_FORCE' AND abs(current_change) >= 1e-6 AND abs(current_change / chosen_days - change_rate) > rate_tolerance", "current_change / chosen_days", "change_rate",
             "CASE WHEN round_even(own, 0) <> chosen_days AND round_even(own, 0) BETWEEN 1 AND 365 AND abs(own - round_even(own, 0)) <= 0.5 THEN 'warning' ELSE 'error' END"),
)
_LABEL = "'深度' || depth || 'm'"
_query("cal_05_deep_change", lambda x: calc.check_deep_change(x["deep_points"], x["deep_config"]), " " + _issue("CAL-05", "d", "abs(current_cumulative - previous_cumulative - current_change) > 0.15", "current_cumulative - previous_cumulative", "current_change", point=_LABEL))
_query("cal_06_deep_rate", lambda x: calc.check_deep_rate(x["deep_points"], x["deep_config"]), _DEEP_CHOSEN + " " + _issue("CAL-06", "(SELECT * FROM d JOIN ch USING (report_id, table_idx))", "chosen_days IS NOT NULL AND abs(abs(current_change / chosen_days) - abs(change_rate)) > 0.05", "current_change / chosen_days", "change_rate", point=_LABEL)
       + " UNION ALL " + _issue("CAL-06", "ch", "chosen_days IS NULL", severity="'info'", point="'ALL'", row="NULL"))
_bare = "CAST(NULL AS DOUBLE)"
_query(
    "cal_07_first_period", lambda x: calc.check_first_period(x["mon_tables"].select("report_id").distinct().withColumn("monitoring_period", F.lit("2024年1月1日—2024-01-31")), x["mon_tables"], x["points"].withColumn("initial_value", F.lit(None).cast("double")), x["config"]),
    " " + _issue("CAL-07", "(SELECT p.*, cfg.cumulative_tolerance FROM p JOIN cfg USING (report_id, table_idx) JOIN t USING (report_id, table_idx) WHERE t.w = 0)", "abs(current_change - cumulative_change) > greatest(cumulative_tolerance, 0.15, abs(cumulative_change) * 0.05::DOUBLE)", "current_change", "cumulative_change"),
)
_query(
    "cal_08_continuity", lambda x: calc.check_continuity(x["mon_tables"], x["points"]),
    """, ad AS (SELECT report_id, table_idx, lead(table_idx) OVER (PARTITION BY report_id, monitoring_item ORDER BY monitor_date, monitor_count, table_idx) AS later FROM t),
pr AS (SELECT b.*, a.table_idx AS earlier, a.cumulative_change AS before, a.current_change AS before_change FROM ad JOIN p a ON a.report_id = ad.report_id AND a.table_idx = ad.table_idx JOIN p b ON b.report_id = ad.report_id AND b.table_idx = ad.later AND a.point_id = b.point_id),
cp AS (SELECT *, bool_and(abs(before - cumulative_change) <= 1e-6 AND abs(before_change - current_change) <= 1e-6) OVER (PARTITION BY report_id, earlier) AND count(*) OVER (PARTITION BY report_id, earlier) >= 2 AS copied, greatest(0.15::DOUBLE, abs(cumulative_change) * 0.05::DOUBLE) AS tol FROM pr) """
    + _issue("CAL-08", "cp", "NOT copied AND abs(before + current_change - cumulative_change) > tol", "CASE WHEN abs(before - current_change - cumulative_change) <= tol THEN before - current_change ELSE before + current_change END", "cumulative_change", "CASE WHEN abs(before - current_change - cumulative_change) <= tol THEN 'info' ELSE 'error' END"),
)
_query("cal_09_anomaly", lambda x: calc.check_anomaly(x["points"]), ", md AS (SELECT *, count(*) OVER w AS n, median(abs(current_change)) OVER w AS middle FROM p WINDOW w AS (PARTITION BY report_id, table_idx)) "
       + _issue("CAL-09", "md", "abs(current_change) >= 0.5 AND (n >= 4 AND abs(current_change) > 3 * greatest(middle, 0.5) OR abs(current_change) > 3 * greatest(abs(cumulative_change), 0.5))", "middle", "current_change", "'warning'"))
_query("cal_10_sign", lambda x: calc.check_sign(x["points"], x["config"]), f", sg AS (SELECT *, (current_value - initial_value) * unit_conversion AS moved FROM {_RAW}) "
       + _issue("CAL-10", "sg", "abs(moved) >= 0.5 AND abs(cumulative_change) >= 0.5 AND greatest(abs(moved), abs(cumulative_change)) / least(abs(moved), abs(cumulative_change)) <= 10 AND (moved > 0) <> (cumulative_change > 0)", "moved", "cumulative_change", "CASE WHEN initial_value_reliable THEN 'error' ELSE 'warning' END"))


def _flat(x: dict[str, DataFrame]) -> tuple:
    return x["mon_tables"], x["table_stats"].withColumns({"max_change_id": F.lit(None).cast("string"), "max_change_value": F.lit(None).cast("double")}), x["points"], x["deep_points"].limit(0)


def _deep(x: dict[str, DataFrame]) -> tuple:
    return x["deep_tables"], x["deep_stats"], x["points"].limit(0), x["deep_points"]


_EXT = """, g AS (SELECT t.report_id, t.table_idx, t.category, s.* EXCLUDE (report_id, table_idx) FROM t JOIN s USING (report_id, table_idx) WHERE category <> 'ANCHOR_FORCE'),
ids AS (SELECT report_id, table_idx, list(point_id) AS l FROM p GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY report_id, table_idx ORDER BY cumulative_change DESC, row_no) AS hi, row_number() OVER (PARTITION BY report_id, table_idx ORDER BY cumulative_change, row_no) AS lo, row_number() OVER (PARTITION BY report_id, table_idx ORDER BY abs(change_rate) DESC, row_no) AS fa FROM p),
ex AS (SELECT report_id, table_idx, min(CASE WHEN hi = 1 AND cumulative_change > 0 THEN point_id END) AS hi_id, max(CASE WHEN cumulative_change > 0 THEN cumulative_change END) AS hi_v, min(CASE WHEN lo = 1 AND cumulative_change < 0 THEN point_id END) AS lo_id, min(CASE WHEN cumulative_change < 0 THEN cumulative_change END) AS lo_v,
  min(CASE WHEN fa = 1 THEN point_id END) AS fa_id, max(CASE WHEN fa = 1 THEN change_rate END) AS fa_v, bool_or(change_rate > 0) AS up, max(CASE WHEN change_rate < 0 THEN change_rate END) AS near, max(CASE WHEN cumulative_change < 0 THEN cumulative_change END) AS lo_near, min(CASE WHEN cumulative_change > 0 THEN cumulative_change END) AS hi_near FROM rk GROUP BY 1, 2),
j AS (SELECT * FROM g JOIN ids USING (report_id, table_idx) JOIN ex USING (report_id, table_idx)) """
_FOREIGN = "({0} <> '' AND len(list_filter(l, lambda y: contains(y, {0}) OR contains({0}, y))) = 0)"


def _side(rule: str, stat: str, v: str, near: str, i: str) -> str:
    tol = "CASE WHEN category = 'WATER_LEVEL' THEN 1.5 ELSE 0.15 END"
    change = f"EXISTS (SELECT 1 FROM p WHERE p.report_id = j.report_id AND p.table_idx = j.table_idx AND p.point_id = j.{stat}_id AND abs(p.current_change - j.{stat}_value) <= {tol})"
    return _issue(rule, "j", f"{stat}_value IS NOT NULL AND NOT coalesce({_FOREIGN.format(stat + '_id')}, false) AND ({v} IS NULL OR abs({v} - {stat}_value) > {tol})", v, f"{stat}_value",
                  f"CASE WHEN {v} IS NULL AND abs({near} - {stat}_value) <= {tol} THEN 'info' WHEN {v} IS NULL THEN 'warning' WHEN {change} THEN 'info' ELSE 'error' END", f"CASE WHEN {v} IS NULL OR {change} THEN CASE WHEN {stat}_id <> '' THEN {stat}_id ELSE 'N/A' END ELSE {i} END", "NULL")


_F = "SELECT t.report_id, t.table_idx, s.*EXCLUDE (report_id, table_idx), hi.point_id AS top_id, hi.current_value AS top_v, lo.point_id AS low_id, lo.current_value AS low_v FROM t JOIN s USING (report_id, table_idx) JOIN (SELECT *, row_number() OVER (PARTITION BY report_id, table_idx ORDER BY abs(current_value) DESC, row_no) AS k FROM p) hi ON hi.report_id = t.report_id AND hi.table_idx = t.table_idx AND hi.k = 1 JOIN (SELECT *, row_number() OVER (PARTITION BY report_id, table_idx ORDER BY current_value, row_no) AS k FROM p) lo ON lo.report_id = t.report_id AND lo.table_idx = t.table_idx AND lo.k = 1 WHERE category = 'ANCHOR_FORCE'"
_query("sta_01_02_force", lambda x: stats.check_max_force(*_flat(x)[:3]), f", fo AS ({_F}) " + _issue("STA-01", "fo", "abs(top_v - max_force_value) > 0.15 AND abs(abs(top_v) - abs(max_force_value)) > 0.15", "top_v", "max_force_value", point="top_id", row="NULL")
       + " UNION ALL " + _issue("STA-02", "fo", "abs(low_v - min_force_value) > 0.15", "low_v", "min_force_value", point="low_id", row="NULL"))
_query("sta_03_04_positive_max", lambda x: stats.check_positive_max(*_flat(x)), _EXT + _side("STA-03", "positive_max", "hi_v", "lo_near", "hi_id"))
_query("sta_05_negative_max", lambda x: stats.check_negative_max(*_flat(x)), _EXT + _side("STA-05", "negative_max", "lo_v", "hi_near", "lo_id"))
_BY = "(near IS NOT NULL AND NOT up AND abs(near - max_rate_value) <= 0.05)"
_OPP = "(fa_v * max_rate_value < 0 AND abs(max_rate_value) >= 0.05)"
_KNOWN = f"max_rate_value IS NOT NULL AND NOT coalesce({_FOREIGN.format('max_rate_id')}, false)"
_query("sta_06_07_max_rate", lambda x: stats.check_max_rate(*_flat(x)), _EXT
       + _issue("STA-07", "j", f"{_KNOWN} AND {_BY}", "near", "max_rate_value", "'info'", "CASE WHEN max_rate_id <> '' THEN max_rate_id ELSE 'N/A' END", "NULL") + " UNION ALL "
       + _issue("STA-07", "j", f"{_KNOWN} AND {_BY} AND abs(fa_v) >= 0.05 AND abs(max_rate_value) > 0 AND abs(max_rate_value) < abs(fa_v) * 0.3", "fa_v", "max_rate_value", "'warning'", "fa_id", "NULL") + " UNION ALL "
       + _issue("STA-06", "j", f"{_KNOWN} AND NOT {_BY} AND ({_OPP} OR abs(abs(fa_v) - abs(max_rate_value)) > 0.05)", "fa_v", "max_rate_value", f"CASE WHEN {_OPP} THEN 'warning' ELSE 'error' END", "fa_id", "NULL"))
_query("sta_08_cross_reference", lambda x: stats.check_cross_reference(*_flat(x)), _EXT + " UNION ALL ".join(_issue("STA-08", "j", f"{s}_value IS NOT NULL AND {_FOREIGN.format(s + '_id')}", point=f"{s}_id", row="NULL") for s in ("positive_max", "negative_max", "max_rate")))
_query("sta_09_deep_max_change", lambda x: stats.check_max_change(*_deep(x)), """, wd AS (SELECT report_id, table_idx, depth, current_change, row_number() OVER (PARTITION BY report_id, table_idx ORDER BY abs(current_change) DESC, row_no) AS k FROM d),
r AS (SELECT report_id, table_idx, max(abs(change_rate)) AS fast, bool_or(change_rate > 0) AS up, max(CASE WHEN change_rate < 0 THEN change_rate END) AS near FROM d GROUP BY 1, 2),
q AS (SELECT ds.*, wd.current_change AS widest, '深度' || wd.depth || 'm' AS place, EXISTS (SELECT 1 FROM d WHERE d.report_id = ds.report_id AND d.table_idx = ds.table_idx AND contains('深度' || d.depth || 'm', ds.max_change_id) AND abs(d.current_cumulative - ds.max_change_value) <= 0.15) AS taken
  FROM ds JOIN wd ON wd.report_id = ds.report_id AND wd.table_idx = ds.table_idx AND k = 1 JOIN r ON r.report_id = ds.report_id AND r.table_idx = ds.table_idx WHERE NOT (near IS NOT NULL AND NOT up AND abs(near - max_rate_value) <= 0.05)) """
       + _issue("STA-09", "q", "max_change_value IS NOT NULL AND abs(abs(widest) - abs(max_change_value)) > 0.15", "widest", "max_change_value", "CASE WHEN taken THEN 'info' ELSE 'error' END", "CASE WHEN taken THEN max_change_id ELSE place END", "NULL"))
_DEEP_EXT = """, dr AS (SELECT *, '深度' || depth || 'm' AS label, row_number() OVER (PARTITION BY report_id, table_idx ORDER BY current_cumulative DESC, row_no) AS hi, row_number() OVER (PARTITION BY report_id, table_idx ORDER BY current_cumulative, row_no) AS lo, row_number() OVER (PARTITION BY report_id, table_idx ORDER BY abs(change_rate) DESC, row_no) AS fa FROM d),
dx AS (SELECT report_id, table_idx, max(CASE WHEN current_cumulative > 0 THEN current_cumulative END) AS top, min(CASE WHEN current_cumulative < 0 THEN current_cumulative END) AS bottom, max(CASE WHEN current_cumulative < 0 THEN current_cumulative END) AS tn, min(CASE WHEN current_cumulative > 0 THEN current_cumulative END) AS lp,
  min(CASE WHEN hi = 1 THEN label END) AS hi_id, min(CASE WHEN lo = 1 THEN label END) AS lo_id, min(CASE WHEN fa = 1 THEN label END) AS fa_id, max(CASE WHEN fa = 1 THEN change_rate END) AS fa_v, bool_or(change_rate > 0) AS up, max(CASE WHEN change_rate < 0 THEN change_rate END) AS near FROM dr GROUP BY 1, 2),
j AS (SELECT * FROM ds JOIN dx USING (report_id, table_idx)) """


def _deep_side(rule: str, stat: str, v: str, near: str, i: str) -> str:
    return _issue(rule, "j", f"{v} IS NULL OR abs({v} - {stat}_value) > 0.15", v, f"{stat}_value", f"CASE WHEN {v} IS NULL AND abs({near} - {stat}_value) <= 0.15 THEN 'info' ELSE 'warning' END", f"CASE WHEN {v} IS NULL THEN 'N/A' ELSE {i} END", "NULL")


KEPT |= {name: ["deep_points"] for name in ("sta_03_04_deep_max", "sta_05_deep_min", "sta_06_07_deep_rate")}
_query("sta_03_04_deep_max", lambda x: stats.check_positive_max(*_deep(x)), _DEEP_EXT + _deep_side("STA-03", "positive_max", "top", "tn", "hi_id"))
_query("sta_05_deep_min", lambda x: stats.check_negative_max(x["deep_tables"], x["deep_stats"].withColumn("negative_max_value", F.col("negative_max_value") - F.when(F.col("table_idx") % 3 == 0, 2).otherwise(0)), x["points"].limit(0), x["deep_points"]),
       _DEEP_EXT.replace("SELECT * FROM ds JOIN", "SELECT * REPLACE (negative_max_value - CASE WHEN table_idx % 3 = 0 THEN 2 ELSE 0 END AS negative_max_value) FROM ds JOIN") + _deep_side("STA-05", "negative_max", "bottom", "lp", "lo_id"))
_query("sta_06_07_deep_rate", lambda x: stats.check_max_rate(*_deep(x)), _DEEP_EXT
       + _issue("STA-07", "j", _BY, "near", "max_rate_value", "'info'", "'N/A'", "NULL") + " UNION ALL "
       + _issue("STA-07", "j", f"{_BY} AND abs(fa_v) >= 0.05 AND abs(max_rate_value) > 0 AND abs(max_rate_value) < abs(fa_v) * 0.3", "fa_v", "max_rate_value", "'warning'", "fa_id", "NULL") + " UNION ALL "
       + _issue("STA-06", "j", f"NOT coalesce({_BY}, false) AND ({_OPP} OR abs(abs(fa_v) - abs(max_rate_value)) > 0.05)", "fa_v", "max_rate_value", "'warning'", "fa_id", "NULL"))
