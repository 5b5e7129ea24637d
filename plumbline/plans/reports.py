"""Queries for the checks across tables, for flags, review, totals and accuracy, with SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calc, hygiene, logic, plan, quality, review, scoring
from ..operators.issues import FIELDS, SAYINGS, TABLE, described
from ..operators.store import computed_once, shared_folder
from ..sources import landing
from ..sources.samples import sample_sql
from . import rules, texts
from .landings import _CELLS as _RAW_CELLS
from .rules import _CONFIG, _FLAT_CHOSEN, _RAW, SHIFT, _issue, _tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_SUMMARY = """
SELECT report_id, k AS si_no, CASE k WHEN 0 THEN '水平位移监测' WHEN 1 THEN '地下水位' WHEN 2 THEN '锚索拉力监测' WHEN 3 THEN '地面沉降' ELSE '立柱竖向位移-G' || CAST(report_id AS STRING) END AS monitoring_item,
  CAST(CAST(top AS DECIMAL(18, 2)) AS STRING) || 'mm' AS positive_max, 'P' || CAST(k AS STRING) AS positive_max_id, CAST(CAST(low + (report_id % 2) AS DECIMAL(18, 2)) AS STRING) AS negative_max, '' AS negative_max_id
FROM (SELECT {points}.report_id, table_idx % 5 AS k, max(CASE WHEN table_idx % 5 = 2 THEN current_value ELSE cumulative_change END) + CASE WHEN table_idx % 5 = 3 THEN 1 ELSE 0 END AS top, min(cumulative_change) AS low FROM {points} GROUP BY report_id, table_idx % 5, CASE WHEN table_idx % 5 = 3 THEN 1 ELSE 0 END) x
UNION ALL SELECT DISTINCT report_id, 9 AS si_no, '桥墩倾角' AS monitoring_item, '/' AS positive_max, '' AS positive_max_id, '--' AS negative_max, '' AS negative_max_id FROM {points}
"""
_SUMMARY = _SUMMARY.replace("{points}.report_id", "report_id")


def _query(name: str, build: Callable[[dict[str, DataFrame]], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(_tables(spark, sf_dir, "points"))
    if sql is not None:
        ORACLES[name] = f"WITH {sample_sql()}{_CONFIG},\nsi AS ({_SUMMARY.replace('{points}', 'p')}){sql}"


def _summary(x: dict[str, DataFrame]) -> DataFrame:
    return x["points"].sparkSession.sql(_SUMMARY, points=x["points"])


def _group(name: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({name}, '{'|'.join(g)}') THEN {k}" for k, g in enumerate(logic.NAME_GROUPS)) + " END"


_MATCHED = f""", mt AS (SELECT report_id, table_idx, th_no, item_name, warning_value, control_value, rate_limit FROM (SELECT t.report_id, t.table_idx, th.* EXCLUDE (report_id), row_number() OVER (PARTITION BY t.report_id, t.table_idx ORDER BY th_no) AS k FROM t JOIN th ON t.report_id = th.report_id
  AND (coalesce({_group('item_name')} = {_group('monitoring_item')}, false) OR contains(monitoring_item, item_name) OR contains(item_name, monitoring_item))) WHERE k = 1)"""
_query("log_04_thresholds", lambda x: logic.match_thresholds(x["thresholds"], x["mon_tables"]), f"{_MATCHED} SELECT * FROM mt")
_MS = f""", ms0 AS (SELECT si.report_id, si_no, t.table_idx, t.category, coalesce({_group('si.monitoring_item')} = {_group('t.monitoring_item')}, false) AS g, contains(si.monitoring_item, t.monitoring_item) OR contains(t.monitoring_item, si.monitoring_item) AS c FROM si JOIN t USING (report_id)),
ms AS (SELECT report_id, si_no, table_idx, category FROM (SELECT *, bool_or(g) OVER (PARTITION BY report_id, si_no) AS anyg FROM ms0) WHERE g OR (NOT anyg AND c))"""
_query("log_05_summary_tables", lambda x: logic.match_summary(_summary(x), x["mon_tables"]), f"{_MS} SELECT * FROM ms")
_STATUS = """, st AS (SELECT p.*, abs(warning_value) AS wv, abs(control_value) AS cv, abs(rate_limit) AS rl, trim(safety_status) AS said,
  CASE WHEN abs(cumulative_change) >= abs(control_value) THEN '控制' WHEN abs(cumulative_change) >= abs(warning_value) THEN '报警' WHEN abs(change_rate) >= abs(rate_limit) THEN '报警' ELSE '正常' END AS due FROM p JOIN mt USING (report_id, table_idx) WHERE safety_status <> ''),
nr AS (SELECT *, abs(cumulative_change) / wv >= 0.8 - 1e-9 AND abs(cumulative_change) < wv AS nc, abs(change_rate) / rl >= 0.8 - 1e-9 AND abs(change_rate) < rl AS nv FROM st) """
_query("log_06_07_status", lambda x: logic.check_status(x["points"], logic.match_thresholds(x["thresholds"], x["mon_tables"])), _MATCHED + _STATUS
       + _issue("LOG-06", "nr", "(said = '正常') <> (due = '正常')", "wv", "cumulative_change", "CASE WHEN said = '正常' THEN 'error' ELSE 'warning' END") + " UNION ALL "
       + _issue("LOG-07", "nr", "said = '正常' AND due = '正常' AND (nc OR nv)", "CASE WHEN nc THEN wv ELSE rl END", "CASE WHEN nc THEN abs(cumulative_change) ELSE abs(change_rate) END", "'warning'"))
_SUMS = """, sx AS (SELECT si.report_id, si_no, positive_max_id, negative_max_id, TRY_CAST(regexp_replace(positive_max, '[a-zA-Z/\\s]', '', 'g') AS DOUBLE) AS pos, TRY_CAST(regexp_replace(negative_max, '[a-zA-Z/\\s]', '', 'g') AS DOUBLE) AS neg,
  bool_or(category = 'ANCHOR_FORCE') AS force, max(current_value) AS most, min(current_value) AS least, count(cumulative_change) AS n, max(CASE WHEN cumulative_change > 0 THEN cumulative_change END) AS top, min(CASE WHEN cumulative_change < 0 THEN cumulative_change END) AS bottom,
  max(CASE WHEN cumulative_change < 0 THEN cumulative_change END) AS tn, min(CASE WHEN cumulative_change > 0 THEN cumulative_change END) AS lp FROM si JOIN ms USING (report_id, si_no) LEFT JOIN p USING (report_id, table_idx) GROUP BY ALL) """


def _side(v: str, printed: str, near: str, point: str) -> str:
    return _issue("LOG-10", "sx", f"NOT force AND n > 0 AND {printed} IS NOT NULL AND ({v} IS NULL OR abs({v} - {printed}) > 0.15)", v, printed, f"CASE WHEN {v} IS NULL AND abs({near} - {printed}) <= 0.15 THEN 'info' ELSE 'warning' END", point, "si_no").replace("table_idx,", "CAST(NULL AS BIGINT) AS table_idx,", 1)


_query("log_08_09_10_summary", lambda x: logic.check_summary(s := _summary(x), logic.match_summary(s, x["mon_tables"]), x["points"], x["behind"]), _MS + _SUMS
       + "SELECT report_id, CAST(NULL AS BIGINT) AS table_idx, si_no AS row_no, monitoring_item AS point_id, 'LOG-08' AS rule_id, 'info' AS severity, CAST(NULL AS DOUBLE) AS expected_num, CAST(NULL AS DOUBLE) AS actual_num FROM si ANTI JOIN ms USING (report_id, si_no) UNION ALL "
       + _issue("LOG-09", "sx", "force AND abs(most - pos) > 0.3 AND abs(least - pos) > 0.3", "most", "pos", "'warning'", "positive_max_id", "si_no").replace("table_idx,", "CAST(NULL AS BIGINT) AS table_idx,", 1) + " UNION ALL "
       + _side("top", "pos", "tn", "positive_max_id") + " UNION ALL " + _side("bottom", "neg", "lp", "negative_max_id"))
_COUNT = "(SELECT t.report_id, t.table_idx, point_count, count(*) AS parsed FROM t JOIN p USING (report_id, table_idx) GROUP BY ALL UNION ALL SELECT report_id, 100000 + table_idx, CASE WHEN table_idx % 2 = 0 THEN 4 ELSE count(*) END, count(*) FROM d GROUP BY report_id, table_idx)"
_query("log_11_qua_01_point_count", lambda x: logic.check_point_count(x["all_tables"].withColumn("point_count", F.when((F.col("table_idx") >= SHIFT) & (F.col("table_idx") % 2 == 0), 4).otherwise(F.col("point_count"))), x["points"], x["behind"]), " " + _issue("LOG-11", _COUNT, "abs(point_count - parsed) / greatest(point_count, parsed) >= 0.2", "point_count", "parsed", "'warning'", "'ALL'", "NULL"))


def _thin(x: dict[str, DataFrame]) -> DataFrame:
    """points with holes, so that flags have something to find."""
    keep = lambda c, where: F.when(where, F.col(c)).alias(c)
    return x["points"].select("report_id", "table_idx", "row_no", "point_id", keep("initial_value", (F.col("table_idx") % 3 != 0) | (F.col("row_no") % 4 == 0)), "current_value", "cumulative_change", keep("current_change", (F.col("table_idx") % 4 != 1) | (F.col("row_no") % 3 == 0)), keep("change_rate", F.col("row_no") % 5 == 0))


_THIN = ", h AS (SELECT report_id, table_idx, row_no, CASE WHEN table_idx % 3 <> 0 OR row_no % 4 = 0 THEN initial_value END AS iv, current_value AS cv, cumulative_change AS cu, CASE WHEN table_idx % 4 <> 1 OR row_no % 3 = 0 THEN current_change END AS cc, CASE WHEN row_no % 5 = 0 THEN change_rate END AS cr FROM p)"
_query("qua_02_sparse", lambda x: quality.flag_sparse(_thin(x), x["mon_tables"]), _THIN + """,
f AS (SELECT report_id, table_idx, category, avg((iv IS NOT NULL)::INT) AS a, avg((cv IS NOT NULL)::INT) AS b, avg((cu IS NOT NULL)::INT) AS c, avg((cc IS NOT NULL)::INT) AS d, avg((cr IS NOT NULL)::INT) AS e FROM h JOIN t USING (report_id, table_idx) GROUP BY ALL),
z AS (SELECT report_id, table_idx, list_filter([CASE WHEN (d >= 0.2 OR e >= 0.2) AND e > 0 AND category <> 'ANCHOR_FORCE' AND e < 0.5 THEN 'change_rate' END, CASE WHEN c < 0.5 THEN 'cumulative_change' END, CASE WHEN (d >= 0.2 OR e >= 0.2) AND d < 0.5 THEN 'current_change' END,
  CASE WHEN (a >= 0.2 OR b >= 0.2) AND b < 0.5 THEN 'current_value' END, CASE WHEN (a >= 0.2 OR b >= 0.2) AND a < 0.5 THEN 'initial_value' END], lambda y: y IS NOT NULL) AS l FROM f)
SELECT report_id, table_idx, 'QUA-02' AS flag_code, array_to_string(l, ', ') AS detail FROM z WHERE len(l) > 0""")  # fmt: skip
_query("qua_03_magnitude", lambda x: quality.flag_magnitude(x["points"]), " SELECT report_id, table_idx, 'QUA-03' AS flag_code, 'magnitude' AS detail FROM (SELECT report_id, table_idx, avg(CASE WHEN abs(cumulative_change / (current_value - initial_value)) > 100 OR abs(cumulative_change / (current_value - initial_value)) < 0.01 THEN 1.0 ELSE 0.0 END) AS s FROM p WHERE row_no < 10 AND abs(current_value - initial_value) >= 1e-9 AND cumulative_change <> 0 GROUP BY 1, 2) WHERE s >= 0.6")
_query("qua_04_deep_sparse", lambda x: quality.flag_deep_sparse(x["deep_points"].withColumns({"previous_cumulative": F.when(F.col("table_idx") % 2 == 0, F.col("previous_cumulative")), "current_change": F.when(F.col("table_idx") % 3 == 0, F.col("current_change")), "change_rate": F.when(F.col("row_no") < 2, F.col("change_rate"))})),
       """, z AS (SELECT report_id, table_idx, list_filter([CASE WHEN table_idx % 2 <> 0 THEN 'previous_cumulative' END, CASE WHEN table_idx % 3 <> 0 AND avg((row_no < 2)::INT) < 0.5 THEN 'current_change and change_rate' END], lambda y: y IS NOT NULL) AS l FROM d GROUP BY 1, 2)
SELECT report_id, table_idx, 'QUA-04' AS flag_code, array_to_string(l, ', ') AS detail FROM z WHERE len(l) > 0""")  # fmt: skip
_query("qua_05_deep_rate", lambda x: quality.flag_deep_rate(x["deep_points"].withColumn("change_rate", F.when(F.col("table_idx") % 2 == 0, F.col("current_change") * 1.1).otherwise(F.col("change_rate")))),
       " SELECT report_id, table_idx, 'QUA-05' AS flag_code, 'rate' AS detail FROM (SELECT report_id, table_idx, median(abs(CASE WHEN table_idx % 2 = 0 THEN current_change * 1.1::DOUBLE ELSE change_rate END / current_change)) AS m FROM d WHERE current_change <> 0 AND (table_idx % 2 = 0 OR change_rate <> 0) GROUP BY 1, 2) WHERE m BETWEEN 0.8 AND 1.2")
_query("qua_06_coverage", lambda x: quality.provenance_coverage(x["points"].withColumns({"source_row_text": F.when(F.col("row_no") % 4 != 3, F.col("point_id")), "source_page": F.lit(None).cast("int"), "source_field_map": F.when(F.col("row_no") % 2 == 0, F.create_map(F.lit("current_value"), F.lit(4), F.lit("change_rate"), F.lit(6)))})),
       """, z AS (SELECT report_id, table_idx, CASE WHEN row_no % 2 = 0 THEN 2 ELSE 0 END AS k, row_no FROM p WHERE row_no % 4 <> 3)
SELECT report_id, table_idx, sum(5)::BIGINT AS numbers, sum(k)::BIGINT AS mapped, CASE WHEN bool_or(row_no % 2 = 1) THEN 'change_rate, cumulative_change, current_change, current_value, initial_value' ELSE 'cumulative_change, current_change, initial_value' END AS unmapped FROM z GROUP BY 1, 2""")  # fmt: skip
_RATES = _issue("CAL-09", "md", "abs(current_change) >= 0.5 AND (n >= 4 AND abs(current_change) > 3 * greatest(middle, 0.5) OR abs(current_change) > 3 * greatest(abs(cumulative_change), 0.5))", "middle", "current_change", "'warning'")
_SIGNS = _issue("CAL-10", "sg", "abs(moved) >= 0.5 AND abs(cumulative_change) >= 0.5 AND greatest(abs(moved), abs(cumulative_change)) / least(abs(moved), abs(cumulative_change)) <= 10 AND (moved > 0) <> (cumulative_change > 0)", "moved", "cumulative_change", "CASE WHEN initial_value_reliable THEN 'error' ELSE 'warning' END")
_ALL = f", md AS (SELECT *, count(*) OVER w AS n, median(abs(current_change)) OVER w AS middle FROM p WINDOW w AS (PARTITION BY report_id, table_idx)), sg AS (SELECT *, (current_value - initial_value) * unit_conversion AS moved FROM {_RAW}), iss AS ({_RATES} UNION ALL {_SIGNS})"


def _some(x: dict[str, DataFrame]) -> DataFrame:
    return calc.check_anomaly(x["points"]).unionByName(calc.check_sign(x["points"], x["config"]))


_query("qua_07_attribution", lambda x: quality.attribute(_some(x), quality.flag_magnitude(x["points"].withColumn("cumulative_change", F.when(F.col("table_idx") % 2 == 0, F.col("cumulative_change") * 1000).otherwise(F.col("cumulative_change"))))),
       _ALL + ", fl AS (SELECT report_id, table_idx FROM (SELECT report_id, table_idx, avg(CASE WHEN abs(c / m) > 100 OR abs(c / m) < 0.01 THEN 1.0 ELSE 0.0 END) AS s FROM (SELECT *, CASE WHEN table_idx % 2 = 0 THEN cumulative_change * 1000 ELSE cumulative_change END AS c, current_value - initial_value AS m FROM p WHERE row_no < 10) WHERE abs(m) >= 1e-9 AND c <> 0 GROUP BY 1, 2) WHERE s >= 0.6) SELECT iss.*, CASE WHEN fl.report_id IS NULL THEN 'report' ELSE 'extraction' END AS suspected_source FROM iss LEFT JOIN fl USING (report_id, table_idx)")
_ORDER = ["rule_id", "table_idx", "row_no", "point_id"]
_BATCHES = ", er AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY rule_id, table_idx, row_no, point_id) - 1 AS k FROM iss WHERE severity = 'error'), bt AS (SELECT *, least(24, count(*) OVER (PARTITION BY report_id)) AS c FROM er), ba AS (SELECT * EXCLUDE (k, c), CASE WHEN c <= 6 THEN 0 ELSE k // 5 END::INT AS batch_no, CASE WHEN c <= 6 THEN k ELSE k % 5 END::INT AS error_idx FROM bt WHERE k < 24)"
_query("ver_01_batches", lambda x: review.review_batches(_some(x), _ORDER), f"{_ALL}{_BATCHES} SELECT * FROM ba")
_VERDICTS = "SELECT report_id, batch_no, error_idx, CASE (batch_no + error_idx) % 4 WHEN 0 THEN 'dismiss' WHEN 1 THEN 'downgrade' ELSE 'confirm' END AS verdict, CASE error_idx % 3 WHEN 0 THEN '单位可能错' WHEN 1 THEN '规则边界' ELSE '' END AS reason, CASE WHEN error_idx = 4 THEN 'report' ELSE 'x' END AS suspected_origin FROM {0} WHERE (report_id + error_idx) % 3 <> 1"


def _verdicts(x: dict[str, DataFrame]) -> DataFrame:
    batches = review.review_batches(_some(x), _ORDER)
    return review.apply_verdicts(batches, batches.sparkSession.sql(_VERDICTS.format("{b}"), b=batches)).select(*FIELDS, "batch_no", "error_idx", "suspected_source")


_query("ver_03_verdicts", _verdicts, f"{_ALL}{_BATCHES}, ve AS ({_VERDICTS.format('ba')}) SELECT ba.* EXCLUDE (severity), CASE verdict WHEN 'dismiss' THEN 'info' WHEN 'downgrade' THEN 'warning' ELSE severity END AS severity, CASE WHEN verdict IS NULL THEN '' WHEN suspected_origin = 'report' THEN 'report' WHEN contains(reason, '单位') THEN 'extraction' WHEN contains(reason, '规则') THEN 'logic' ELSE '' END AS suspected_source FROM ba LEFT JOIN ve USING (report_id, batch_no, error_idx)")
_query("rep_01_totals", lambda x: review.issue_totals(_some(x)), f"{_ALL} SELECT report_id, severity, count(*) AS n FROM iss GROUP BY 1, 2 UNION ALL SELECT report_id, NULL AS severity, count(*) AS n FROM iss GROUP BY 1")
_query("rep_02_conclusion", lambda x: review.conclusion(_some(x).where("report_id % 3 <> 0"), x["mon_tables"]), f"{_ALL} SELECT t.report_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, CASE WHEN bool_or(severity = 'error') THEN 'fail' WHEN bool_or(severity = 'warning') THEN 'review' ELSE 'pass' END AS conclusion FROM (SELECT DISTINCT report_id FROM t) t LEFT JOIN iss ON iss.report_id = t.report_id AND t.report_id % 3 <> 0 GROUP BY 1")
_FIELD, _TEXT = (" ".join(f"WHEN '{rule}' THEN '{told[i].replace(chr(39), chr(39) * 2)}'" for rule, told in SAYINGS.items()) for i in (0, 1))
_DESCRIBED = f""", de AS (SELECT iss.*, monitoring_item AS table_name, CASE rule_id {_FIELD} END AS field_name, CASE rule_id {_TEXT} END || CASE WHEN expected_num IS NULL OR actual_num IS NULL THEN ''
  ELSE ': expected ' || CAST(CAST(expected_num AS DECIMAL(18, 3)) AS VARCHAR) || ', printed ' || CAST(CAST(actual_num AS DECIMAL(18, 3)) AS VARCHAR) END AS message FROM iss JOIN t USING (report_id, table_idx))"""
_query("iss_messages", lambda x: described(_some(x), x["mon_tables"]), f"{_ALL}{_DESCRIBED} SELECT * FROM de")
_query("ver_03_messages", lambda x: review.apply_verdicts(b := review.review_batches(described(_some(x), x["mon_tables"]), _ORDER), b.sparkSession.sql(_VERDICTS.format("{b}"), b=b)).select("report_id", "batch_no", "error_idx", "field_name", "message"),
       f"{_ALL}{_DESCRIBED}{_BATCHES}, ve AS ({_VERDICTS.format('ba')}) SELECT report_id, batch_no, error_idx, field_name, message || CASE verdict WHEN 'dismiss' THEN ' [dismissed: ' || reason || ']' WHEN 'downgrade' THEN ' [downgraded: ' || reason || ']' ELSE '' END AS message FROM ba JOIN de USING (report_id, table_idx, row_no, point_id, rule_id) LEFT JOIN ve USING (report_id, batch_no, error_idx)")
_query("rep_01_sources", lambda x: review.source_totals(_some(x).withColumn("suspected_source", F.when(F.col("row_no") % 3 == 0, "report").when(F.col("row_no") % 3 == 1, "logic"))), f"{_ALL} SELECT report_id, CASE row_no % 3 WHEN 0 THEN 'report' WHEN 1 THEN 'logic' ELSE '' END AS suspected_source, count(*) AS n FROM iss GROUP BY 1, 2")
_query("rep_06_tables", lambda x: review.table_list(x["all_tables"], x["points"], x["behind"]), " SELECT report_id, table_idx, monitoring_item AS name, category, count(*) AS rows, monitor_date FROM t JOIN p USING (report_id, table_idx) GROUP BY ALL UNION ALL SELECT report_id, 100000 + table_idx AS table_idx, monitoring_item || '(' || borehole_id || ')' AS name, category, count(*) AS rows, monitor_date FROM dt JOIN d USING (report_id, table_idx) GROUP BY ALL")
_CELLS = "SELECT 'S' || CAST(report_id AS STRING) AS sheet, CAST(table_idx * 1000 + row_no AS BIGINT) AS row, {1} AS col, {2} AS value FROM {0} WHERE {3}"


def _cells(points: str, col: int) -> tuple[str, str]:
    wrong = _CELLS.format(points, col, f"CASE WHEN row_no % 11 = {col} THEN 'n/a' WHEN row_no % 7 = {col} THEN CAST(CAST(cumulative_change + 1 AS DECIMAL(18, 2)) AS STRING) ELSE ' ' || CAST(CAST(cumulative_change AS DECIMAL(18, 2)) AS STRING) END", f"row_no % 13 <> {col}")
    return wrong, _CELLS.format(points, col, "CAST(CAST(cumulative_change AS DECIMAL(18, 2)) AS STRING)", f"row_no % 17 <> {col}")


def _diff(x: dict[str, DataFrame]) -> DataFrame:
    wrong, right = (x["points"].sparkSession.sql(text, points=x["points"]) for text in _cells("{points}", 3))
    return scoring.cell_diff(wrong, right).select("sheet", "row", "col", F.trim("error_value").alias("error_value"), "correct_value", "diff_type", F.round("delta", 4).alias("delta"))


_query("eva_01_cell_diff", _diff, f""", a AS ({_cells('p', 3)[0]}), b AS ({_cells('p', 3)[1]})
SELECT sheet, row, col, trim(a.value) AS error_value, b.value AS correct_value, CASE WHEN b.value IS NULL THEN 'added' WHEN a.value IS NULL THEN 'missing' WHEN TRY_CAST(a.value AS DOUBLE) IS NULL THEN 'type' ELSE 'numeric' END AS diff_type, round(TRY_CAST(a.value AS DOUBLE) - TRY_CAST(b.value AS DOUBLE), 4) AS delta
FROM a FULL JOIN b USING (sheet, row, col) WHERE trim(a.value) IS DISTINCT FROM b.value""")  # fmt: skip
_TRUTH = "SELECT report_id, table_idx * 1000 + row_no AS truth_no, point_id || '(位移)' AS point_id, '累计' AS keyword, CAST(CAST(cumulative_change AS DECIMAL(18, 2)) AS STRING) AS error_value, CAST(NULL AS STRING) AS correct_value, 'T' || CAST(table_idx AS STRING) AS table_name FROM {0} WHERE row_no % 3 = 0"
_SAID = "SELECT report_id, point_id, CAST(coalesce(table_idx, 0) * 10000 + coalesce(row_no, 0) AS BIGINT) AS issue_no, CASE WHEN rule_id = 'CAL-10' THEN '符号' ELSE '单期变化' END AS field_name, CASE WHEN row_no % 2 = 0 THEN '累计' ELSE CAST(CAST(actual_num AS DECIMAL(18, 2)) AS STRING) END AS message, 'T' || CAST(table_idx AS STRING) AS table_name FROM {0} WHERE severity = 'error' OR row_no % 2 = 1"


def _judged(x: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    spark, found = x["points"].sparkSession, _some(x)
    return spark.sql(_TRUTH.format("{points}"), points=x["points"]), spark.sql(_SAID.format("{found}"), found=found)


_query("eva_02_recall", lambda x: scoring.recall(*_judged(x)), f"""{_ALL}, tr AS ({_TRUTH.format('p')}), sd AS ({_SAID.format('iss')}),
c AS (SELECT DISTINCT tr.report_id, truth_no FROM tr JOIN sd ON tr.report_id = sd.report_id AND contains(sd.point_id, split_part(tr.point_id, '(', 1)) AND (contains(sd.field_name || sd.message, keyword) OR (len(rtrim(replace(replace(error_value, '-', ''), '.', ''), '0')) >= 3 AND contains(sd.field_name || sd.message, regexp_replace(regexp_replace(regexp_replace(error_value, '^-', ''), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '.')))))
SELECT tr.report_id, count(*) AS truths, count(c.truth_no) AS hits, count(c.truth_no) / count(*) AS recall FROM tr LEFT JOIN c USING (report_id, truth_no) GROUP BY 1""")  # fmt: skip
_query("eva_03_fuzzy", lambda x: scoring.fuzzy_match(*_judged(x)), f"""{_ALL}, tr AS ({_TRUTH.format('p')}), sd AS ({_SAID.format('iss')}),
m AS (SELECT tr.report_id, truth_no, issue_no FROM tr JOIN sd ON tr.report_id = sd.report_id AND (contains(tr.point_id, sd.point_id) OR contains(sd.point_id, tr.point_id)) AND (contains(tr.table_name, sd.table_name) OR contains(sd.table_name, tr.table_name))),
a AS (SELECT report_id, count(*) AS truths FROM tr GROUP BY 1), b AS (SELECT report_id, count(*) AS reported FROM sd GROUP BY 1), f AS (SELECT report_id, count(DISTINCT truth_no) AS hits, count(DISTINCT issue_no) AS good FROM m GROUP BY 1)
SELECT report_id, coalesce(truths, 0) AS truths, coalesce(reported, 0) AS reported, coalesce(hits, 0) AS hits, coalesce(hits, 0) / nullif(coalesce(truths, 0), 0) AS recall, coalesce(good, 0) / nullif(coalesce(reported, 0), 0) AS precision FROM a FULL JOIN b USING (report_id) LEFT JOIN f USING (report_id)""")  # fmt: skip
_query("eva_04_extra", lambda x: scoring.extra_errors(*_judged(x)), f"{_ALL}, tr AS ({_TRUTH.format('p')}), sd AS ({_SAID.format('iss')}) SELECT * FROM sd WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.report_id = sd.report_id AND contains(sd.point_id, split_part(tr.point_id, '(', 1)))")


def _flags(x: dict[str, DataFrame]) -> DataFrame:
    return quality.flag_sparse(_thin(x), x["mon_tables"]).unionByName(quality.flag_magnitude(x["points"]))


_FLAGS = ", fg AS (SELECT report_id, table_idx, flag_code FROM (" + ORACLES["qua_02_sparse"].rsplit("\nSELECT", 1)[1].join(["SELECT", ""]) + ") UNION ALL SELECT report_id, table_idx, flag_code FROM (" + ORACLES["qua_03_magnitude"].rsplit(" SELECT report_id, table_idx, 'QUA-03'", 1)[1].join(["SELECT report_id, table_idx, 'QUA-03'", ""]) + "))"
_SPARSE = _THIN + ORACLES["qua_02_sparse"].rsplit(_THIN, 1)[1].rsplit("\nSELECT", 1)[0]
_query("rep_03_flag_groups", lambda x: review.group_flags(_flags(x), x["mon_tables"]), _SPARSE + _FLAGS + """, pt AS (SELECT report_id, table_idx, string_agg(flag_code, ',' ORDER BY flag_code) AS flag_list FROM fg GROUP BY 1, 2),
gr AS (SELECT report_id, monitoring_item, flag_list, count(*) AS tables, list(monitor_date ORDER BY table_idx) AS days FROM pt JOIN t USING (report_id, table_idx) GROUP BY 1, 2, 3)
SELECT report_id, monitoring_item, flag_list, tables, CASE WHEN tables <= 2 THEN array_to_string(days, ', ') ELSE days[1] || ' - ' || days[-1] END AS periods FROM gr""")  # fmt: skip
_query("rep_05_hints", lambda x: _some(x).withColumn("source", F.when(F.col("row_no") % 2 == 0, "report").otherwise("")).select("report_id", "table_idx", "row_no", "rule_id", review.with_hint(F.when(F.col("row_no") % 4 == 0, F.concat("point_id", F.lit(" [source: report]"))).otherwise(F.col("point_id")), F.col("source")).alias("message")),
       f"{_ALL} SELECT report_id, table_idx, row_no, rule_id, CASE WHEN row_no % 2 = 0 THEN point_id || ' [source: report]' ELSE point_id END AS message FROM iss")
_RAW_TEXT = "SELECT report_id, repeat('甲', 300) || '坡顶水平位移' || repeat('乙', 400) || '地下水位(一)' || repeat('丙', 10) AS raw_text FROM (SELECT DISTINCT report_id FROM {0}) x"
_NAMES = "CASE table_idx % 4 WHEN 0 THEN '坡顶水平位移' WHEN 1 THEN '地下水位(二)' WHEN 2 THEN '无此表' ELSE '地下水位(一)' END"


def _context(x: dict[str, DataFrame]) -> DataFrame:
    batches = review.review_batches(_some(x), _ORDER).withColumn("table_name", F.expr(_NAMES))
    return review.context(batches, x["points"].sparkSession.sql(_RAW_TEXT.format("{points}"), points=x["points"])).select("report_id", "batch_no", "error_idx", "context")


_query("ver_02_context", _context, f"""{_ALL}{_BATCHES}, tx AS ({_RAW_TEXT.format('p')}), nm AS (SELECT *, {_NAMES} AS name FROM ba JOIN tx USING (report_id)), ps AS (SELECT *, CASE WHEN instr(raw_text, name) > 0 THEN instr(raw_text, name) ELSE instr(raw_text, regexp_replace(name, '[(（].*$', '')) END AS a FROM nm)
SELECT report_id, batch_no, error_idx, CASE WHEN a > 0 THEN substr(substr(raw_text, greatest(a - 200, 1), a - greatest(a - 200, 1) + 2000), 1, 200) ELSE '' END AS context FROM ps""")  # fmt: skip
_query("log_01_damage", lambda x: logic.check_damage(x["points"].select("report_id", (F.col("table_idx") * 1000 + F.col("row_no")).alias("finding_no"), F.col("point_id").alias("detail"))),
       ", f AS (SELECT report_id, row_number() OVER (PARTITION BY report_id ORDER BY table_idx * 1000 + row_no) AS line_no, point_id AS detail FROM p) SELECT report_id, 0 AS line_no, 'LOG-01' AS rule_id, 'warning' AS severity, count(*) || ' findings' AS detail FROM f GROUP BY 1 UNION ALL SELECT report_id, line_no, 'LOG-01' AS rule_id, 'warning' AS severity, detail FROM f WHERE line_no <= 5")
_query("log_02_extractable", lambda x: logic.check_extractable(x["deep_tables"].select("report_id").distinct(), x["mon_tables"]), " SELECT DISTINCT report_id, 'LOG-02' AS rule_id, 'warning' AS severity FROM dt WHERE report_id NOT IN (SELECT report_id FROM t)")
_query("log_03_partial", lambda x: logic.check_partial_parse(x["points"].groupBy("report_id").agg(F.count_if(F.col("row_no") % 3 == 0).alias("failed"), F.count_if(F.col("row_no") % 3 != 0).alias("succeeded"))), " SELECT report_id, 'LOG-03' AS rule_id, 'warning' AS severity, count(*) FILTER (row_no % 3 = 0) AS failed FROM p GROUP BY 1")


def _every_rule(x: dict[str, DataFrame]) -> DataFrame:
    """All calculation rules over all tables of a report, those of depths behind the flat ones."""
    config = x["config"].unionByName(x["deep_config"].withColumn("table_idx", F.col("table_idx") + SHIFT))
    return calc.run_calculation_checks(x["mon_tables"].select("report_id").distinct().withColumn("monitoring_period", F.lit("")), x["all_tables"], x["points"], x["behind"], config)


_PARTS = [(name, 0) for name in ("cal_01_force", "cal_02_cumulative", "cal_03_rate", "cal_08_continuity", "cal_09_anomaly", "cal_10_sign")] + [(name, SHIFT) for name in ("cal_05_deep_change", "cal_06_deep_rate")]
QUERIES["cal_00_all"] = lambda spark, sf_dir: _every_rule(_tables(spark, sf_dir, "points", "deep_points"))
ORACLES["cal_00_all"] = " UNION ALL ".join(f"SELECT report_id, table_idx + {shift} AS table_idx, row_no, point_id, rule_id, severity, expected_num, actual_num FROM ({rules.ORACLES[name]})" for name, shift in _PARTS)
_PLAN = _FLAT_CHOSEN + """, pl AS (SELECT report_id, table_idx, category, unit, 'initial_value, current_value, current_change, cumulative_change, change_rate' AS filled, sample, rows, chosen_days AS interval_days,
  CASE WHEN chosen_days IS NULL THEN 'none' WHEN chosen_days = inferred THEN 'inferred' ELSE 'configured' END AS interval_source, CASE WHEN initial_value_reliable THEN 'reliable' WHEN unit = 'm' THEN 'metres' ELSE 'water level' END AS reliability,
  CASE WHEN category = 'ANCHOR_FORCE' THEN 'CAL-01, CAL-10' WHEN initial_value_reliable THEN 'CAL-02, CAL-03, CAL-10' ELSE 'CAL-03, CAL-10' END AS rules
  FROM cfg JOIN ch USING (report_id, table_idx) JOIN (SELECT report_id, table_idx, count(*) AS rows, string_agg(point_id, ', ' ORDER BY row_no) FILTER (row_no < 2) AS sample FROM p GROUP BY 1, 2) USING (report_id, table_idx))"""
_query("cfg_10_plan", lambda x: plan.analysis_plan(x["points"], x["config"]), f"{_PLAN} SELECT * FROM pl")
_query("rep_04_plan_groups", lambda x: review.group_plans(plan.analysis_plan(x["points"], x["config"]), ["category", "unit", "interval_source", "rules"]), f"{_PLAN} SELECT report_id, category, unit, interval_source, rules, count(*) AS tables, min(rows) AS least_rows, max(rows) AS most_rows FROM pl GROUP BY 1, 2, 3, 4, 5")
_SIGNATURE = ["category", "unit", "filled", "interval_days", "interval_source", "reliability", "rules"]
_query("rep_04_signatures", lambda x: review.group_plans(plan.analysis_plan(x["points"], x["config"]), _SIGNATURE), f"{_PLAN} SELECT {', '.join(_SIGNATURE)}, report_id, count(*) AS tables, min(rows) AS least_rows, max(rows) AS most_rows FROM pl GROUP BY ALL")


def _grouped_plans(x: dict[str, DataFrame]) -> DataFrame:
    """Plans of flat and deep tables by their whole signature, methods and notes as texts."""
    flat = plan.verification_plan(x["mon_tables"], x["points"], x["deep_points"].limit(0), x["config"])
    deep = plan.verification_plan(x["deep_tables"], x["points"].limit(0), x["deep_points"], x["deep_config"])
    found = review.group_plans(flat.unionByName(deep), plan.SIGNATURE)
    said = F.array_join(F.transform("methods", lambda m: F.concat_ws(" | ", m["name"], m["formula"], m["tolerance"], m["severity"])), "; ")
    return found.withColumns({"methods": said, "special_notes": F.array_join("special_notes", "; ")})


_WAYS = """, w AS (SELECT cfg.*, monitoring_item AS table_name, rows, c.inferred, c.chosen_days, cfg.category = 'ANCHOR_FORCE' AS force, coalesce(abs(c.inferred - cfg.interval_days) > 2 AND c.chosen_days = c.inferred, false) AS overruled
  FROM cfg JOIN t USING (report_id, table_idx) JOIN ch c USING (report_id, table_idx) JOIN (SELECT report_id, table_idx, count(*) AS rows FROM p GROUP BY 1, 2) USING (report_id, table_idx)),
v AS (SELECT *, CASE WHEN interval_days IS NULL OR overruled THEN inferred ELSE interval_days END AS days, CASE WHEN interval_days IS NOT NULL THEN 'configured' WHEN inferred IS NOT NULL THEN 'inferred' ELSE 'none' END AS source FROM w),
fp AS (SELECT report_id, table_name, category, unit, unit_conversion, CASE WHEN unit = 'm' THEN 'heights in m' WHEN unit = 'kN' THEN 'forces in kN' ELSE 'none' END AS conversion_note, initial_value_reliable AS initial_reliable,
  CASE WHEN force THEN 'initial forces hold' WHEN (unit = 'm' OR category IN ('SETTLEMENT', 'VERTICAL_DISP')) AND NOT initial_value_reliable THEN 'heights may have another origin' WHEN category = 'WATER_LEVEL' THEN 'levels may have another origin' WHEN NOT initial_value_reliable THEN 'another origin' ELSE 'initial values hold' END AS reliability_reason,
  days AS interval_days, source AS interval_source,
  CASE WHEN force THEN 'cumulative force | current - initial | ' || cumulative_tolerance || ' kN | error; statistics | largest and smallest force | 0.15 | error'
    ELSE 'cumulative change | current - initial' || CASE WHEN unit_conversion <> 1 THEN ' times 1000' ELSE '' END || ' | ' || cumulative_tolerance || ' mm | ' || severity_for_cumulative || '; rate | change / ' || coalesce(round_even(days, 0)::INT::VARCHAR, '?') || ' days | 0.05 mm/d | error; statistics | extremes, fastest rate | 0.15 | error' END AS methods,
  concat_ws('; ', CASE WHEN unit = 'm' AND NOT initial_value_reliable THEN 'differences of heights are warnings' END, CASE WHEN category = 'WATER_LEVEL' THEN 'tolerance of ' || cumulative_tolerance || ' mm' END, CASE WHEN source = 'inferred' THEN 'interval from the rows' END,
    CASE WHEN unit_conversion = 1000 AND category = 'HORIZONTAL_DISP' THEN 'readings in m, changes in mm' END, CASE WHEN overruled THEN 'interval ' || interval_days::INT || ' overruled by ' || inferred::INT END) AS special_notes, rows FROM v)"""
_DEEP_WAYS = rules._DEEP_CHOSEN.replace("iv AS", "div AS").replace("FROM iv", "FROM div").replace("inf AS", "dinf AS").replace("JOIN inf ", "JOIN dinf ").replace("sup AS", "dsup AS").replace("JOIN sup ", "JOIN dsup ").replace("ch AS", "dch AS") + """,
dv AS (SELECT dt.*, dch.inferred, n, coalesce(abs(inferred - interval_days) > 2 AND chosen_days = inferred, false) AS overruled, CASE WHEN interval_days IS NOT NULL THEN 'configured' WHEN inferred IS NOT NULL THEN 'inferred' ELSE 'none' END AS source FROM dt JOIN dch USING (report_id, table_idx) JOIN (SELECT report_id, table_idx, count(*) AS n FROM d GROUP BY 1, 2) USING (report_id, table_idx)),
dw AS (SELECT *, CASE WHEN interval_days IS NULL OR overruled THEN inferred ELSE interval_days END AS days FROM dv),
dp AS (SELECT report_id, monitoring_item AS table_name, category, 'mm' AS unit, 1.0::DOUBLE AS unit_conversion, 'none' AS conversion_note, true AS initial_reliable, 'initial values hold' AS reliability_reason, days AS interval_days, source AS interval_source,
  'change of depth | current - previous cumulative | 0.15 mm | error; rate of depth | change / ' || coalesce(round_even(days, 0)::INT::VARCHAR, '?') || ' days | 0.05 mm/d | error; statistics | extremes, widest change, fastest rate | 0.15 | error' AS methods,
  concat_ws('; ', 'ids are not looked up in other tables', 'rates are compared without signs', CASE WHEN source = 'inferred' THEN 'interval from the rows' END, CASE WHEN overruled THEN 'interval ' || interval_days::INT || ' overruled by ' || inferred::INT END) AS special_notes, n AS rows FROM dw)"""
_query("rep_04_methods", _grouped_plans, f"{_FLAT_CHOSEN}{_WAYS}{_DEEP_WAYS} SELECT report_id, {', '.join(plan.SIGNATURE)}, count(*) AS tables, min(rows) AS least_rows, max(rows) AS most_rows FROM (SELECT * FROM fp UNION ALL SELECT * FROM dp) GROUP BY ALL")
_query("qua_06_deep_coverage", lambda x: quality.provenance_coverage(x["deep_points"].withColumns({"source_row_text": F.when(F.col("row_no") % 3 != 2, "row"), "source_page": F.lit(None).cast("int"), "source_field_map": F.when(F.col("row_no") % 2 == 0, F.create_map(F.lit("depth"), F.lit(1), F.lit("current_change"), F.lit(4)))}), quality.TRACED_DEEP),
       " SELECT report_id, table_idx, sum(5)::BIGINT AS numbers, sum(CASE WHEN row_no % 2 = 0 THEN 2 ELSE 0 END)::BIGINT AS mapped, CASE WHEN bool_or(row_no % 2 = 1) THEN 'change_rate, current_change, current_cumulative, depth, previous_cumulative' ELSE 'change_rate, current_cumulative, previous_cumulative' END AS unmapped FROM d WHERE row_no % 3 <> 2 GROUP BY 1, 2")
_query("qua_08_diagnostics", lambda x: quality.diagnostics(_flags(x), x["mon_tables"].select("report_id", F.when(F.col("table_idx") % 3 == 0, 0.95).otherwise(0.5).alias("markup_ratio")), x["mon_tables"].where("table_idx % 5 = 1"), x["points"].where("row_no = 7")),
       _SPARSE + _FLAGS + """, a AS (SELECT report_id, count(DISTINCT table_idx) AS flagged_tables FROM fg GROUP BY 1), b AS (SELECT report_id, count(*) FILTER (table_idx % 3 = 0) AS markup_pages, count(*) FILTER (table_idx % 5 = 1) AS identical_pairs FROM t GROUP BY 1), c AS (SELECT report_id, count(*) AS damages FROM p WHERE row_no = 7 GROUP BY 1)
SELECT b.report_id, coalesce(flagged_tables, 0) AS flagged_tables, markup_pages, identical_pairs, coalesce(damages, 0) AS damages FROM b LEFT JOIN a USING (report_id) LEFT JOIN c USING (report_id)""")  # fmt: skip


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostics of flagged tables, of pages of markup, and of the documents' pages that repeat or are damaged."""
    pages = texts.bound(spark, sf_dir)
    return quality.diagnostics(_flags(_tables(spark, sf_dir, "points")), hygiene.page_stats(texts.charts(spark, sf_dir)), hygiene.identical_pages(pages), texts.damage(spark, sf_dir))


QUERIES["qua_08_found"] = _found
ORACLES["qua_08_found"] = f"""WITH RECURSIVE {texts.damage_sql()}, fa AS (SELECT report_id, flagged_tables FROM ({ORACLES['qua_08_diagnostics']}) WHERE flagged_tables > 0),
fb AS (SELECT report_id, count(*) FILTER (markup_ratio >= 0.9) AS markup_pages FROM ({texts.ORACLES['doc_07_page_stats']}) GROUP BY 1), fc AS (SELECT report_id, count(*) AS identical_pairs FROM ({texts.ORACLES['doc_08_identical_pages'].replace(texts.PAGES_SQL, 'SELECT * FROM dg')}) GROUP BY 1),
fd AS (SELECT report_id, count(*) AS damages FROM dm GROUP BY 1)
SELECT report_id, coalesce(flagged_tables, 0) AS flagged_tables, coalesce(markup_pages, 0) AS markup_pages, coalesce(identical_pairs, 0) AS identical_pairs, coalesce(damages, 0) AS damages FROM fa FULL JOIN fb USING (report_id) FULL JOIN fc USING (report_id) FULL JOIN fd USING (report_id)"""


#: what is compared of each published table: its columns, numbers with three places behind them
_PUBLISHED = {
    "00_overview": ("o", "errors warnings conclusion", ""), "00A_candidates": ("cn", "page_no table_no rows cols title", ""), "00B_cells": ("c", "page_no table_no row col value", ""), "01_tables": ("t", "table_idx monitoring_item category monitor_date point_count table_unit", "interval_days"),
    "02_points": ("p", "table_idx row_no point_id safety_status", "initial_value current_value current_change cumulative_change change_rate"), "03_deep_points": ("d", "table_idx row_no", "depth previous_cumulative current_cumulative current_change change_rate"),
    "04_statistics": ("s", "table_idx positive_max_id negative_max_id max_rate_id", "positive_max_value negative_max_value max_rate_value max_force_value min_force_value"), "05_issues": ("iss", "table_idx row_no point_id rule_id severity", "actual_num"), "06_plan": ("pl", "table_idx category unit filled sample rows interval_source reliability rules", "interval_days"),
}


#: a double with three places: the oracle's cast rounds its product with 1000; Spark's rounds its shortest text, so that the product is rounded here (0.5065 is 506.49999999999994 thousandths)
_PLACES = {"VARCHAR": "CAST({0} AS DECIMAL(18, 3))", "STRING": "CAST(CAST(round({0} * 1000D) AS DECIMAL(18, 0)) * 0.001BD AS DECIMAL(18, 3))"}


def _line(name: str, text: str) -> str:
    """SQL for a row of a published table as one text, by the engine's name for texts."""
    _, texts_, numbers = _PUBLISHED[name]
    parts = [f"coalesce(CAST({c} AS {text}), '~')" for c in texts_.split()] + [f"coalesce(CAST({_PLACES[text].format(c)} AS {text}), '~')" for c in numbers.split()]
    return " || '|' || ".join(parts)


def _publish(x: dict[str, DataFrame], folder: str) -> None:
    cells = x["points"].sparkSession.sql(_RAW_CELLS.format("{points}"), points=x["points"])
    landing.publish(review.result_tables(x["mon_tables"], cells, x["mon_tables"], x["points"], x["deep_points"], x["table_stats"], computed_once(_some(x)), plan.analysis_plan(x["points"], x["config"])), folder)


def _published(x: dict[str, DataFrame], folder: str, spark: SparkSession) -> dict[str, DataFrame]:
    """All nine tables of results, written, those of every third report written again with other states, and read."""
    _publish(x, folder)
    again = {name: df.where("report_id % 3 = 0") if "report_id" in df.columns else df for name, df in x.items()}
    _publish(again | {"points": again["points"].withColumn("safety_status", F.lit("again"))}, folder)
    return {name: landing.published(spark, folder, name) for name in _PUBLISHED}


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/published-{uuid.uuid4().hex}"


def _counts(found: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.groupBy("report_id").agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "report_id", "rows") for name, df in found.items()])


QUERIES["snk_01_published"] = lambda spark, sf_dir: _counts(_published(_tables(spark, sf_dir, "points"), _folder(spark), spark))
ORACLES["snk_01_published"] = f"""WITH {sample_sql()}{_CONFIG}{_ALL}, c AS ({_RAW_CELLS.format('p')})
SELECT '00_overview' AS name, report_id, 1 AS rows FROM t GROUP BY 2 UNION ALL SELECT '00A_candidates', report_id, count(DISTINCT page_no) FROM c GROUP BY 2 UNION ALL SELECT '00B_cells', report_id, count(*) FROM c GROUP BY 2
UNION ALL SELECT '01_tables', report_id, count(*) FROM t GROUP BY 2 UNION ALL SELECT '02_points', report_id, count(*) FROM p GROUP BY 2 UNION ALL SELECT '03_deep_points', report_id, count(*) FROM d GROUP BY 2
UNION ALL SELECT '04_statistics', report_id, count(*) FROM s GROUP BY 2 UNION ALL SELECT '05_issues', report_id, count(*) FROM iss GROUP BY 2 UNION ALL SELECT '06_plan', report_id, count(*) FROM t GROUP BY 2"""
QUERIES["snk_01_contents"] = lambda spark, sf_dir: reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("name"), "report_id", F.expr(_line(name, "STRING")).alias("line")) for name, df in _published(_tables(spark, sf_dir, "points"), _folder(spark), spark).items()])
ORACLES["snk_01_contents"] = f"""WITH {sample_sql()}{_CONFIG}{_ALL}{_PLAN}, c AS ({_RAW_CELLS.format('p')}), w AS (SELECT report_id, page_no, table_no, row, max(col) AS width, string_agg(value, ' ' ORDER BY col) FILTER (trim(value) <> '') AS head FROM c GROUP BY ALL),
cn AS (SELECT report_id, page_no, table_no, count(*) AS rows, max(width) + 1 AS cols, arg_min(head, row)[1:240] AS title FROM w GROUP BY 1, 2, 3),
o AS (SELECT t.report_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, CASE WHEN bool_or(severity = 'error') THEN 'fail' WHEN bool_or(severity = 'warning') THEN 'review' ELSE 'pass' END AS conclusion FROM (SELECT DISTINCT report_id FROM t) t LEFT JOIN iss USING (report_id) GROUP BY 1)
""" + " UNION ALL ".join(f"SELECT '{name}' AS name, report_id, {_line(name, 'VARCHAR')} AS line FROM " + ("(SELECT * REPLACE (CASE WHEN report_id % 3 = 0 THEN 'again' ELSE safety_status END AS safety_status) FROM p)" if name == "02_points" else source) for name, (source, _, _) in _PUBLISHED.items())


def _as_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with ids that a spreadsheet would take for formulas, published as CSV in small files and read again."""
    folder, rows = _folder(spark), _tables(spark, sf_dir, "points")["points"]
    landing.publish({"points": rows.select("report_id", "table_idx", "row_no", F.concat(F.lit("="), "point_id").alias("said"))}, folder, 100, "csv")
    return spark.read.schema("table_idx long, row_no int, said string, report_id long").csv(f"{folder}/points").select("report_id", "table_idx", "row_no", "said")


QUERIES["snk_03_csv"] = _as_csv
ORACLES["snk_03_csv"] = f"WITH {sample_sql()} SELECT report_id, table_idx, row_no, '''=' || point_id AS said FROM p"
