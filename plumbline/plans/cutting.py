"""Queries for chunks and for what their texts tell about the landed tables, with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking
from ..sources import landing
from ..sources.samples import read, sample, sample_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# A table's section: its title (an appendix's number or brackets, a loose title every sixth time), dates, a header and its rows. Every second report has page markers.
_SECTION = """
SELECT report_id, table_idx, CASE WHEN report_id % 2 = 1 THEN '--- 第 ' || CAST(table_idx + 1 AS {text}) || ' 页 / 共 25 页 ---' || {nl} ELSE '' END AS marker,
  CASE WHEN table_idx % 6 = 5 THEN '说明 ' WHEN table_idx % 5 < 3 THEN '附表 ' || CAST(1 + CAST(floor(table_idx / 5.0) AS BIGINT) AS {text}) || ' - ' || CAST(table_idx AS {text}) || ' 沉降观测结果表 ' ELSE '【' || monitoring_item || '】第一期监测数据 ' END AS title,
  monitor_date || CASE WHEN table_idx % 4 = 3 THEN ' 2023/1/5' ELSE '' END || {nl} || '监测时间：2023-01-01 2023-02-01' || {nl} || CASE WHEN table_idx % 10 < 5 THEN '本次(kN) 测值 变化速率' ELSE '本次 变化速率' END || {nl} || body || {nl} AS rest
FROM {tables} JOIN {bodies} USING (report_id, table_idx)
"""


def _bodies(x: dict[str, DataFrame]) -> DataFrame:
    said = F.transform(F.array_sort(F.collect_list(F.struct("row_no", F.concat("point_id", F.lit(" row")).alias("said")))), lambda r: r["said"])
    return x["points"].groupBy("report_id", "table_idx").agg(F.array_join(said, "\n").alias("body"))


def _sections(x: dict[str, DataFrame]) -> DataFrame:
    sql = _SECTION.format(text="STRING", nl="'\\n'", tables="{tables}", bodies="{bodies}")
    return x["points"].sparkSession.sql(sql, tables=x["mon_tables"], bodies=_bodies(x))


def _reports(x: dict[str, DataFrame], titled: bool = True) -> DataFrame:
    said = F.concat("marker", "title", "rest") if titled else F.concat(F.lit("--- 第 "), F.col("table_idx").cast("string"), F.lit(" 页\n"), "rest")
    whole = F.transform(F.array_sort(F.collect_list(F.struct("table_idx", said.alias("said")))), lambda r: r["said"])
    return _sections(x).groupBy("report_id").agg(F.concat(F.lit("前言\n"), F.array_join(whole, "")).alias("raw_text"))


def _chunked(x: dict[str, DataFrame]) -> DataFrame:
    """Every section as a chunk of its own, chunk_no its table."""
    return _sections(x).select("report_id", F.col("table_idx").alias("chunk_no"), F.concat("title", "rest").alias("text"))


_SQL = ", bo AS (SELECT report_id, table_idx, string_agg(point_id || ' row', chr(10) ORDER BY row_no) AS body FROM p GROUP BY 1, 2), se AS (" + _SECTION.format(text="VARCHAR", nl="chr(10)", tables="t", bodies="bo") + """),
no AS (SELECT *, table_idx % 6 <> 5 AS titled, sum((table_idx % 6 <> 5)::INT) OVER (PARTITION BY report_id ORDER BY table_idx)::INT - 1 AS section_no, lag(marker) OVER (PARTITION BY report_id ORDER BY table_idx) AS before FROM se),
gr AS (SELECT report_id, section_no, string_agg(CASE WHEN titled THEN '' ELSE marker END || title || rest, '' ORDER BY table_idx) AS bare, arg_min(marker, table_idx) AS own, arg_max(marker, table_idx) AS last_mark,
  arg_min(title, table_idx) AS title, arg_min(table_idx, table_idx) AS table_idx, arg_min(monitoring_item, table_idx) AS item FROM no JOIN t USING (report_id, table_idx) GROUP BY ALL),
-- a section stands under the marker before its title, which the section above lost from its end
sc AS (SELECT report_id, section_no, own || bare AS section, CASE WHEN own <> '' THEN 'section:' || section_no WHEN title LIKE '附表%' THEN 'appendix:' || (1 + table_idx // 5) ELSE 'bracket:【' || item || '】' END AS family FROM gr WHERE section_no >= 0
  UNION ALL SELECT DISTINCT report_id, -1 AS section_no, '前言' || chr(10) || own AS section, 'section:-1' AS family FROM (SELECT report_id, arg_min(marker, table_idx) AS own FROM se GROUP BY 1) z)
"""


def _query(name: str, build: Callable[[dict[str, DataFrame]], DataFrame], sql: str, recursive: bool = False) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(sample(spark, sf_dir))
    ORACLES[name] = f"WITH {'RECURSIVE ' * recursive}{sample_sql()}{_SQL}{sql}"


def _said(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.length("text").alias("chars"), F.sha2("text", 256).alias("text_sha256"))


_query("chk_01_02_sections", lambda x: chunking.label_sections(chunking.table_sections(_reports(x))).select("report_id", "section_no", "family", F.length("section").alias("chars"), F.sha2("section", 256).alias("text_sha256")),
       "SELECT report_id, section_no, family, len(section) AS chars, sha256(section) AS text_sha256 FROM sc")
# the same fold in SQL: a section opens a chunk if its family or the room says so
_query("chk_03_04_packed", lambda x: _said(chunking.chunks(_reports(x), 9000, group_chars=900), "report_id", "chunk_no"), """,
fo AS (SELECT report_id, section_no, family, len(section) AS size, 0 AS chunk_no FROM sc WHERE section_no = -1
  UNION ALL SELECT sc.report_id, sc.section_no, sc.family, CASE WHEN fo.section_no >= 0 AND sc.family = fo.family AND fo.size + len(sc.section) <= 900 THEN fo.size + len(sc.section) ELSE len(sc.section) END,
    CASE WHEN fo.section_no >= 0 AND sc.family = fo.family AND fo.size + len(sc.section) <= 900 THEN fo.chunk_no ELSE fo.chunk_no + 1 END FROM fo JOIN sc ON sc.report_id = fo.report_id AND sc.section_no = fo.section_no + 1)
SELECT report_id, chunk_no, len(string_agg(section, '' ORDER BY section_no)) AS chars, sha256(string_agg(section, '' ORDER BY section_no)) AS text_sha256 FROM fo JOIN sc USING (report_id, section_no) GROUP BY 1, 2""", True)  # fmt: skip
_query("chk_04_pages", lambda x: _said(chunking.chunks(_reports(x, False), 600), "report_id", "chunk_no"), """,
pg AS (SELECT report_id, row_number() OVER (PARTITION BY report_id ORDER BY table_idx) AS i, '--- 第 ' || table_idx || ' 页' || chr(10) || rest AS page FROM se UNION ALL SELECT DISTINCT report_id, 0 AS i, '前言' || chr(10) AS page FROM se),
fo AS (SELECT report_id, i, len(page) AS size, 0 AS chunk_no FROM pg WHERE i = 0
  UNION ALL SELECT pg.report_id, pg.i, CASE WHEN fo.size + len(page) > 600 THEN len(page) ELSE fo.size + len(page) END, CASE WHEN fo.size + len(page) > 600 THEN fo.chunk_no + 1 ELSE fo.chunk_no END FROM fo JOIN pg ON pg.report_id = fo.report_id AND pg.i = fo.i + 1)
SELECT report_id, chunk_no, len(string_agg(page, '' ORDER BY i)) AS chars, sha256(string_agg(page, '' ORDER BY i)) AS text_sha256 FROM fo JOIN pg USING (report_id, i) GROUP BY 1, 2""", True)  # fmt: skip
QUERIES["chk_05_length"] = lambda spark, sf_dir: _said(read(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.split_long(F.coalesce("text", F.lit("")), 3000, 200)).alias("chunk_no", "text")), "doc_id", "chunk_no")
ORACLES["chk_05_length"] = """WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS x, len(coalesce(text, '')) AS n FROM documents),
f AS (SELECT doc_id, 0 AS chunk_no, 0 AS b, CASE WHEN n <= 3000 THEN n ELSE CASE WHEN contains(substr(x, 2001, 1000), chr(10)) THEN 3000 - strpos(reverse(substr(x, 2001, 1000)), chr(10)) ELSE 3000 END END AS e FROM d
  UNION ALL SELECT doc_id, k, s, CASE WHEN s + 3000 >= n THEN n WHEN contains(substr(x, s + 2001, 1000), chr(10)) THEN s + 3000 - strpos(reverse(substr(x, s + 2001, 1000)), chr(10)) ELSE s + 3000 END
  FROM (SELECT f.doc_id, f.chunk_no + 1 AS k, greatest(f.e - 200, f.b + 1) AS s, d.n, d.x FROM f JOIN d USING (doc_id) WHERE f.e < d.n) z)
SELECT doc_id, chunk_no, e - b AS chars, sha256(substr(x, b + 1, e - b)) AS text_sha256 FROM f JOIN d USING (doc_id)"""

_query("lnd_07_preamble", lambda x: landing.drop_preamble_tables(x["mon_tables"].withColumn("chunk_no", F.col("table_idx")), _chunked(x)).select("report_id", "table_idx"), " SELECT report_id, table_idx FROM se WHERE table_idx % 6 <> 5")
_query("lnd_08_incomplete", lambda x: landing.completeness(_chunked(x), x["mon_tables"].join(_bodies(x).select("report_id", "table_idx"), ["report_id", "table_idx"]).select("report_id", F.col("table_idx").alias("chunk_no"), F.lit(0).alias("pos"), F.col("point_count").alias("declared"), F.when(F.col("table_idx") % 2 == 0, F.col("point_count") - 2).otherwise(F.col("point_count")).alias("parsed"))),
       ", ic AS (SELECT report_id, table_idx AS chunk_no, CASE WHEN table_idx % 4 = 3 THEN 2 ELSE 1 END AS dates, 1 AS tables, CASE WHEN point_count >= 5 AND table_idx % 2 = 0 AND point_count - 2 < point_count * 0.8 THEN 0 END AS short_table FROM t WHERE table_idx % 6 <> 5) SELECT *, CASE WHEN dates = 2 THEN 'tables' ELSE 'rows' END AS reason FROM ic WHERE dates = 2 OR short_table = 0")


def _forces(x: dict[str, DataFrame]) -> DataFrame:
    points, tables = landing.fix_force_reading(x["points"], x["mon_tables"].withColumn("chunk_no", F.col("table_idx")), _chunked(x))
    return points.join(tables.select("report_id", "table_idx", "initial_value_reliable"), ["report_id", "table_idx"]).select("report_id", "table_idx", "row_no", "cumulative_change", "initial_value_reliable")


_query("lnd_10_forces", _forces, " SELECT report_id, table_idx, row_no, CASE WHEN table_idx % 10 = 2 THEN current_value ELSE cumulative_change END AS cumulative_change, table_idx % 10 <> 2 AS initial_value_reliable FROM p JOIN t USING (report_id, table_idx)")
