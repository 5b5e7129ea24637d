"""Queries for provenance: chunks of lines printed from the sample points, in three layouts, with SQL that knows where everything stands."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import provenance, quality
from ..operators.provenance import ROW
from ..sources.samples import sample, sample_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_N = "CAST(CAST({0} AS DECIMAL(18, 5)) AS STRING)"
_CELLS = [_N.format(c) for c in ("initial_value", "current_value", "current_change", "cumulative_change", "change_rate")] + ["CASE WHEN safety_status = '' THEN '无' ELSE safety_status END"]
_BARRED, _BLANK = "'| ' || point_id || ' | ' || " + " || ' | ' || ".join(_CELLS) + " || ' |'", "point_id || ' ' || " + " || ' ' || ".join(_CELLS)
_TRIPLE = " || ' ' || ".join(_N.format(c) for c in ("current_change", "cumulative_change", "change_rate"))
# A chunk is one kind of a report's tables (table_idx % 5), a page each; the last kind is printed as one table of all its periods, with dashes where a point has none.
_LINES = f"""
SELECT report_id, k AS chunk_no, CAST(table_idx * 100 + at AS BIGINT) AS line_no, text FROM (
  SELECT report_id, table_idx, table_idx % 5 AS k, row_no + 10 AS at, CASE WHEN table_idx % 2 = 0 THEN {_BARRED} ELSE {_BLANK} END AS text FROM {{0}} WHERE table_idx % 5 <> 4
  UNION ALL SELECT report_id, table_idx, table_idx % 5 AS k, a.at, CASE a.at WHEN 0 THEN '--- 第 ' || CAST(table_idx + 1 AS STRING) || ' 页 / 共 25 页 ---' WHEN 1 THEN '监测日期：' || replace(monitor_date, '-', '/') WHEN 2 THEN '' WHEN 3 THEN '测点编号' WHEN 4 THEN '安全状态'
    WHEN 5 THEN CASE WHEN table_idx % 2 = 0 THEN '| 测点编号 | 初始值 | 本次值 | 本次变化量 | 累计变化量 | 变化速率 | 安全状态 |' ELSE '初始值 本次值 本次变化 累计变化 速率' END END AS text FROM {{1}} LATERAL VIEW explode(sequence(0, 5)) a AS at WHERE table_idx % 5 <> 4
  UNION ALL SELECT report_id, CAST(1000 AS BIGINT) AS table_idx, 4 AS k, CAST(substr(point_id, 2) AS INT) + 10 AS at, 'p-' || point_id || ' ' || CAST(CAST(min(initial_value) AS DECIMAL(18, 5)) AS STRING) || ' ' || array_join(transform(array_sort(collect_list(struct(table_idx AS i, said))), x -> x.said), ' ') AS text 
    FROM (SELECT report_id, point_id, initial_value, table_idx, said FROM (
        SELECT x.report_id, x.point_id, t.table_idx, x.initial_value, coalesce(x.told[t.table_idx], '- - -') AS said FROM (
          SELECT report_id, point_id, min(initial_value) AS initial_value, map_from_entries(collect_list(struct(table_idx, {_TRIPLE}))) AS told FROM {{0}} WHERE table_idx % 5 = 4 GROUP BY report_id, point_id) x
        JOIN {{1}} t ON x.report_id = t.report_id AND t.table_idx % 5 = 4) y) z GROUP BY report_id, point_id
  UNION ALL SELECT report_id, CAST(1000 AS BIGINT) AS table_idx, 4 AS k, a.at, CASE a.at WHEN 0 THEN '--- 第 99 页 ---' WHEN 1 THEN '测点 初始 ' || days WHEN 2 THEN said END AS text FROM (
    SELECT report_id, array_join(transform(array_sort(collect_list(monitor_date)), x -> x), ' ') AS days, trim(repeat('本次 累计 速率 ', CAST(count(*) AS INT))) AS said FROM {{1}} WHERE table_idx % 5 = 4 GROUP BY report_id) t LATERAL VIEW explode(sequence(0, 2)) a AS at) x
"""


def _pointed(x: dict[str, DataFrame]) -> DataFrame:
    """The points with their chunks and dates; those of the wide table are named as they are printed there and have a row in each period."""
    days = x["mon_tables"].select("report_id", "table_idx", "monitor_date")
    rows = x["points"].join(days, ["report_id", "table_idx"]).withColumn("chunk_no", F.col("table_idx") % 5)
    wide = F.col("chunk_no") == 4
    return rows.withColumn("point_id", F.when(wide, F.concat(F.lit("P-"), F.lower("point_id"))).otherwise(F.col("point_id")))


def _lines(x: dict[str, DataFrame]) -> DataFrame:
    return x["points"].sparkSession.sql(_LINES.format("{points}", "{tables}"), points=x["points"], tables=x["mon_tables"])


def _traced(x: dict[str, DataFrame]) -> DataFrame:
    return provenance.trace(_pointed(x), _lines(x))


_WHOLE = f""", wt AS (SELECT report_id, table_idx, rank() OVER (PARTITION BY report_id ORDER BY table_idx) AS nth FROM t WHERE table_idx % 5 = 4),
wr AS (SELECT g.report_id, g.point_id, {_N.format('min(initial_value)')} || ' ' || string_agg(coalesce(said, '- - -'), ' ' ORDER BY nth) AS said
  FROM (SELECT DISTINCT report_id, point_id FROM p WHERE table_idx % 5 = 4) g JOIN wt USING (report_id) LEFT JOIN (SELECT report_id, table_idx, point_id, initial_value, {_TRIPLE} AS said FROM p) v USING (report_id, table_idx, point_id) GROUP BY 1, 2),
q AS (SELECT p.*, nth FROM p LEFT JOIN wt USING (report_id, table_idx)),
ln AS (SELECT q.*, table_idx % 5 = 4 AS wide, CASE WHEN table_idx % 5 = 4 THEN 'p-' || q.point_id || ' ' || wr.said WHEN table_idx % 2 = 0 THEN {_BARRED.replace('point_id', 'q.point_id')} ELSE {_BLANK.replace('point_id', 'q.point_id')} END AS row_text
  FROM q LEFT JOIN wr ON wr.report_id = q.report_id AND wr.point_id = q.point_id AND table_idx % 5 = 4),
"""
_FIELDS = ("initial_value", "current_value", "current_change", "cumulative_change", "change_rate")
_DUE = {"initial_value": "2", "current_value": "3", "current_change": "4", "cumulative_change": "5", "change_rate": "6"}
_WIDE = {"current_change": "nth * 3", "cumulative_change": "nth * 3 + 1", "change_rate": "nth * 3 + 2"}
_ONLY = "CASE WHEN len(list_filter(range(1, len(nums) + 1), lambda i: abs(nums[i] - {0}) <= 1e-9)) = 1 THEN list_filter(range(1, len(nums) + 1), lambda i: abs(nums[i] - {0}) <= 1e-9)[1] END"


def _column(field: str) -> str:
    in_wide = _WIDE[field] if field in _WIDE else _ONLY.format(field)
    return f"CASE WHEN {field} IS NULL THEN NULL WHEN NOT wide THEN {_DUE[field]} ELSE {in_wide} END"


_MAPPED = _WHOLE + f"""nu AS (SELECT *, list_transform(string_split(row_text, ' '), lambda c: TRY_CAST(c AS DOUBLE)) AS nums FROM ln),
tr AS (SELECT report_id, table_idx, row_no, {', '.join(f'({_column(f)})::INT AS {f}_column' for f in _FIELDS)} FROM nu) """


def _query(name: str, build: Callable[[dict[str, DataFrame]], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(sample(spark, sf_dir, "points"))
    ORACLES[name] = f"WITH {sample_sql()}{sql}"


_query("prv_01_candidates", lambda x: provenance.candidate_lines(_pointed(x), provenance.read_lines(_lines(x))).groupBy(ROW).agg(F.count("*").alias("lines")),
       _WHOLE + "al AS (SELECT DISTINCT report_id, point_id, table_idx % 5 AS k, CASE WHEN wide THEN -1 ELSE table_idx END AS i FROM ln), n AS (SELECT report_id, point_id, k, count(*) AS lines FROM al GROUP BY 1, 2, 3) SELECT ln.report_id, table_idx, row_no, lines FROM ln JOIN n ON n.report_id = ln.report_id AND n.point_id = ln.point_id AND n.k = ln.table_idx % 5")
_query("prv_02_03_rows", lambda x: _traced(x).select(*ROW, "source_line", "source_page", "source_row_text"),
       _WHOLE.rstrip(",\n") + " SELECT report_id, table_idx, row_no, CASE WHEN wide THEN 100010 + substr(point_id, 2)::BIGINT ELSE table_idx * 100 + row_no + 10 END AS source_line, (CASE WHEN wide THEN 99 ELSE table_idx + 1 END)::INT AS source_page, row_text AS source_row_text FROM ln")
_query("prv_04_cells", lambda x: _lines(x).where("chunk_no <> 4").select("report_id", "chunk_no", "line_no", F.posexplode(provenance.cells_of(F.col("text"))).alias("cell_no", "cell")).where(F.col("line_no") % 100 >= 10),
       _WHOLE.rstrip(",\n") + " SELECT report_id, table_idx % 5 AS chunk_no, table_idx * 100 + row_no + 10 AS line_no, unnest(range(0, 7))::INT AS cell_no, unnest(string_split(replace(trim(row_text, '| '), ' | ', ' '), ' ')) AS cell FROM ln WHERE NOT wide")
_query("prv_05_06_07_field_map", lambda x: _traced(x).select(*ROW, *[F.try_element_at("source_field_map", F.lit(f)).alias(f"{f}_column") for f in _FIELDS]), _MAPPED + "SELECT * FROM tr")
_query("prv_08_periods", lambda x: provenance.unpivot_periods(_lines(x).where("chunk_no = 4 and line_no >= 100010").select("report_id", "line_no", F.slice(provenance.cells_of(F.col("text")), 3, 1000).alias("cells")).join(x["mon_tables"].where("table_idx % 5 = 4").groupBy("report_id").agg(F.array_sort(F.collect_list("monitor_date")).alias("dates")), "report_id"), ["report_id", "line_no"]),
       _WHOLE.rstrip(",\n") + " SELECT report_id, 100010 + substr(point_id, 2)::BIGINT AS line_no, (nth - 1)::INT AS period, monitor_date, current_change, cumulative_change, change_rate FROM ln JOIN t USING (report_id, table_idx) WHERE wide")
_query("qua_06_traced", lambda x: quality.provenance_coverage(_traced(x)), _MAPPED + "SELECT report_id, table_idx, sum(" + " + ".join(f"({f} IS NOT NULL)::INT" for f in _FIELDS) + ")::BIGINT AS numbers, sum(" + " + ".join(f"({f}_column IS NOT NULL)::INT" for f in _FIELDS) + ")::BIGINT AS mapped, "
       "array_to_string(list_filter([" + ", ".join(f"CASE WHEN bool_or({f} IS NOT NULL AND {f}_column IS NULL) THEN '{f}' END" for f in sorted(_FIELDS)) + "], lambda y: y IS NOT NULL), ', ') AS unmapped FROM tr JOIN q USING (report_id, table_idx, row_no) GROUP BY 1, 2")  # fmt: skip
