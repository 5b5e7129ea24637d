"""Queries for landing: page splits, recognition output, cell tables and structured responses, with SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import shared_folder
from ..sources import landing
from ..sources.samples import sample, sample_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, build: Callable[[dict[str, DataFrame]], DataFrame], sql: str | None = None, kept: tuple[str, ...] = ()) -> None:
    """``kept``: sample tables that the query goes over many times."""
    QUERIES[name] = lambda spark, sf_dir: build(sample(spark, sf_dir, *kept))
    if sql is not None:
        ORACLES[name] = f"WITH {sample_sql()} {sql}"


def _by_table(points: DataFrame, piece, joiner: str) -> DataFrame:
    """(report_id, table_idx, body): the pieces of a table's rows in order."""
    made = F.transform(F.array_sort(F.collect_list(F.struct("row_no", piece.alias("said")))), lambda x: x["said"])
    return points.groupBy("report_id", "table_idx").agg(F.array_join(made, joiner).alias("body"))


def _texts(x: dict[str, DataFrame]) -> DataFrame:
    pages = _by_table(x["points"], F.concat("point_id", F.lit(" row")), "\n")
    page = F.concat(F.lit("--- 第 "), (F.col("table_idx") + 1).cast("string"), F.lit(" 页 / 共 25 页 ---\n"), "body", F.lit("\n"))
    made = F.transform(F.array_sort(F.collect_list(F.struct("table_idx", page.alias("said")))), lambda p: p["said"])
    return pages.groupBy("report_id").agg(F.concat(F.lit(" \n"), F.array_join(made, "")).alias("raw_text"))


_query("src_01_pages", lambda x: landing.split_pages(_texts(x)), """SELECT report_id, row_number() OVER (PARTITION BY report_id ORDER BY table_idx) - 1 AS page_no, '--- 第 ' || (table_idx + 1) || ' 页 / 共 25 页 ---' || chr(10) || string_agg(point_id || ' row', chr(10) ORDER BY row_no) || chr(10) AS text FROM p GROUP BY report_id, table_idx""")


def _jsonl(x: dict[str, DataFrame]) -> DataFrame:
    body = _by_table(x["points"], F.col("point_id"), ",")
    two = F.struct(F.array(F.struct(F.struct(F.col("body").alias("text")).alias("markdown")), F.struct(F.struct(F.when(F.col("table_idx") % 2 == 0, "x").alias("text")).alias("markdown"))).alias("layoutParsingResults"))
    return body.select("report_id", "table_idx", F.when(F.col("table_idx") % 6 == 5, " ").otherwise(F.to_json(F.struct(two.alias("result")))).alias("value"))


_query("src_02_ocr_lines", lambda x: landing.land_ocr_jsonl(_jsonl(x)), """, b AS (SELECT report_id, table_idx, string_agg(point_id, ',' ORDER BY row_no) AS body FROM p GROUP BY 1, 2)
SELECT report_id, table_idx, 0 AS page_no, body AS text FROM b WHERE table_idx % 6 <> 5 UNION ALL SELECT report_id, table_idx, 1 AS page_no, CASE WHEN table_idx % 2 = 0 THEN 'x' ELSE '' END AS text FROM b WHERE table_idx % 6 <> 5""")  # fmt: skip
_CELLS = "SELECT report_id, table_idx AS page_no, 0 AS table_no, row_no AS row, c AS col, CASE c WHEN 0 THEN CASE WHEN row_no % 6 = 1 THEN 'same' ELSE point_id END WHEN 1 THEN CASE WHEN row_no % 6 = 1 THEN '' ELSE CAST(CAST(cumulative_change AS DECIMAL(18, 2)) AS STRING) END ELSE '' END AS value FROM {0} CROSS JOIN (SELECT 0 AS c UNION ALL SELECT 1 UNION ALL SELECT 2) k WHERE c < 2 OR row_no % 5 = 2 AND table_idx % 2 = 0"
_query("src_03_candidates", lambda x: landing.candidate_tables(x["points"].sparkSession.sql(_CELLS.format("{points}"), points=x["points"])),
       f""", c AS ({_CELLS.format('p')}), w AS (SELECT report_id, page_no, table_no, row, max(col) AS width, string_agg(value, '|' ORDER BY col) AS said, string_agg(value, ' ' ORDER BY col) FILTER (trim(value) <> '') AS head FROM c GROUP BY ALL)
SELECT report_id, page_no, table_no, count(*) AS rows, max(width) + 1 AS cols, arg_min(head, row)[1:240] AS title, count(DISTINCT width) > 1 AS drift, count(*) <> count(DISTINCT said) AS repeats, max(width) + 1 >= 10 AS wide FROM w GROUP BY 1, 2, 3""")  # fmt: skip
_SHEET = "SELECT 'a' AS version, 'S' || CAST(report_id AS STRING) AS sheet, CAST(table_idx * 100 + row_no + 10 AS BIGINT) AS row, c AS col, CASE c WHEN 1 THEN ' ' || point_id ELSE CAST(CAST(cumulative_change AS DECIMAL(18, 2)) AS STRING) END AS value FROM {0} CROSS JOIN (SELECT 1 AS c UNION ALL SELECT 2) k UNION ALL SELECT DISTINCT 'a' AS version, 'S' || CAST(report_id AS STRING) AS sheet, CAST(2 AS BIGINT) AS row, 1 AS col, '测点编号' AS value FROM {0} UNION ALL SELECT DISTINCT 'a' AS version, 'S' || CAST(report_id AS STRING) AS sheet, CAST(2 AS BIGINT) AS row, 2 AS col, '累计变化量' AS value FROM {0} UNION ALL SELECT DISTINCT 'a' AS version, 'S' || CAST(report_id AS STRING) AS sheet, CAST(3 AS BIGINT) AS row, 2 AS col, ' (mm)' AS value FROM {0}"
_query("src_04_labelled_cells", lambda x: landing.label_cells(x["points"].sparkSession.sql(_SHEET.format("{points}"), points=x["points"])),
       f""", c AS ({_SHEET.format('p')}), o AS (SELECT sheet, row, trim(value) AS point_id FROM c WHERE col = 1)
SELECT c.*, point_id, CASE col WHEN 1 THEN '测点编号' ELSE '累计变化量 / (mm)' END AS field_name FROM c LEFT JOIN o USING (sheet, row)""")  # fmt: skip
_query("snk_02_guarded", lambda x: x["points"].select("report_id", "table_idx", "row_no", landing.guard_text(F.when(F.col("row_no") % 3 == 0, F.concat(F.lit("="), "point_id")).when(F.col("row_no") % 3 == 1, F.concat(F.lit(" -"), "point_id")).otherwise(F.concat(F.lit("-1"), "point_id"))).alias("t")),
       "SELECT report_id, table_idx, row_no, CASE row_no % 3 WHEN 0 THEN '''=' || point_id WHEN 1 THEN ''' -' || point_id ELSE '-1' || point_id END AS t FROM p")


def _responses(x: dict[str, DataFrame]) -> DataFrame:
    """A response a table, written as models write them: fenced, with thinking, trailing commas, units, or without an object."""
    n = lambda c: F.format_string("%.2f", c)
    point = F.concat(F.lit('{"point_id": "'), "point_id", F.lit('", "cumulative_change": '), n("cumulative_change"), F.when(F.col("table_idx") % 5 == 3, "mm").otherwise(""), F.lit(', "change_rate": "'), n("change_rate"), F.lit(' mm/d"}'))
    body = _by_table(x["points"], point, ", ")
    close = F.when(F.col("table_idx") % 5 == 1, ",]}]}").otherwise("]}]}")
    text = F.concat(F.lit('{"project_name": "'), F.when(F.col("table_idx") % 2 == 1, "P").otherwise(""), F.lit('", "tables": [{"monitoring_item": "地下水位", "points": ['), "body", close)
    raw = F.when(F.col("table_idx") % 5 == 0, F.concat(F.lit("<think>{</think>```json\n"), text, F.lit("\n```"))).when(F.col("table_idx") % 5 == 4, F.concat(F.lit("no tables: "), F.translate("body", "{}", "()"))).otherwise(text)
    return body.select("report_id", F.col("table_idx").cast("int").alias("chunk_no"), raw.alias("raw"))


def _parsed(x: dict[str, DataFrame]) -> DataFrame:
    return landing.parse_responses(_responses(x))[0]


_query("lnd_01_04_points", lambda x: landing.land(_parsed(x))["points"].select("report_id", "table_idx", "row_no", "point_id", F.round("cumulative_change", 2).alias("cum")),
       ", k AS (SELECT DISTINCT report_id, table_idx AS c, dense_rank() OVER (PARTITION BY report_id ORDER BY table_idx) - 1 AS i FROM p WHERE table_idx % 5 <> 4) SELECT p.report_id, i AS table_idx, row_no, point_id, round(cumulative_change, 2) AS cum FROM p JOIN k ON k.report_id = p.report_id AND k.c = p.table_idx")
_query("lnd_03_quarantine", lambda x: landing.parse_responses(_responses(x))[1].select("report_id", "chunk_no"), "SELECT DISTINCT report_id, table_idx AS chunk_no FROM p WHERE table_idx % 5 = 4")
_query("lnd_05_merged", lambda x: landing.merge_records(x["points"].select("report_id", F.col("table_idx").alias("chunk_no"), F.col("row_no").alias("pos"), F.expr("substring(point_id, 1, 3)").alias("item")), F.col("item")),
       ", q AS (SELECT report_id, table_idx AS chunk_no, row_no AS pos, substr(point_id, 1, 3) AS item, row_number() OVER (PARTITION BY report_id, substr(point_id, 1, 3) ORDER BY table_idx, row_no) AS k, min(table_idx) OVER (PARTITION BY report_id) AS f FROM p) SELECT report_id, chunk_no, pos, item FROM q WHERE k = 1 OR chunk_no = f")
_query("lnd_06_header", lambda x: landing.merge_header(_parsed(x)).select("report_id", "project_name"), "SELECT report_id, 'P' AS project_name FROM p GROUP BY 1")
_query("lnd_09_keys", lambda x: x["points"].select("report_id", "table_idx", "row_no", landing.prompt_key("point_id", "row_no", "report_id").alias("key")), """SELECT report_id, table_idx, row_no, sha256('{"point_id":"' || point_id || '","report_id":' || report_id || ',"row_no":' || row_no || '}') AS key FROM p""")
_query("lnd_09_uncached", lambda x: landing.uncached(x["points"].select("report_id", F.col("point_id").alias("prompt_key"), F.lit(0.1).alias("temperature")).distinct(), x["points"].select(F.col("point_id").alias("prompt_key"), F.when(F.col("row_no") % 3 == 0, '{"a": 1}').when(F.col("row_no") % 3 == 1, " ").otherwise("short").alias("raw"))),
       "SELECT DISTINCT report_id, point_id AS prompt_key, 0.1::DOUBLE AS temperature FROM p WHERE point_id NOT IN (SELECT point_id FROM p WHERE row_no % 3 = 0)")
_query("lnd_11_chunk_status", lambda x: landing.chunk_status(*landing.parse_responses(_responses(x))), "SELECT report_id, count(DISTINCT table_idx) AS chunks, count(DISTINCT CASE WHEN table_idx % 5 <> 4 THEN table_idx END) AS succeeded, count(DISTINCT CASE WHEN table_idx % 5 = 4 THEN table_idx END) AS failed, false AS lost FROM p GROUP BY 1")


def _whole_responses(x: dict[str, DataFrame]) -> DataFrame:
    """A response a table, flat or of depths, with all that a response may hold: statistics, and the report's thresholds and summaries in each chunk."""
    key, both = ["report_id", "table_idx"], "positive_max_id positive_max_value negative_max_id negative_max_value max_rate_id max_rate_value max_force_id max_force_value min_force_id min_force_value".split()
    listed = lambda df, name, cols, by, no: df.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(no, F.struct(*cols).alias("v")))), lambda p: p["v"]).alias(name))
    points = listed(x["points"], "points", ["point_id", "initial_value", "current_value", "current_change", "cumulative_change", "change_rate", "safety_status"], key, "row_no")
    depth = F.when(F.col("row_no") % 5 == 4, "01-1").otherwise(F.col("depth").cast("string")).alias("depth")
    deep = listed(x["deep_points"], "deep_points", [depth, "previous_cumulative", "current_cumulative", "current_change", "change_rate"], key, "row_no")
    stats = [x["table_stats"].select(*key, F.struct(*both).alias("statistics")), x["deep_stats"].select(*key, F.struct(*both, "max_change_id", "max_change_value").alias("statistics"))]
    limits = listed(x["thresholds"], "thresholds", ["item_name", "warning_value", "control_value", "rate_limit"], ["report_id"], "th_no")
    made = []
    for tables, rows, stat, since in ((x["mon_tables"], points, stats[0], 0), (x["deep_tables"], deep, stats[1], 100000)):
        name = rows.columns[-1]
        unit = F.when(F.col("table_unit") != "mm", F.col("table_unit")).alias("table_unit")
        table = F.struct("monitoring_item", F.col("monitoring_item").alias("category"), "monitor_date", "monitor_count", F.col("point_count").cast("string").alias("point_count"), "borehole_id", unit, F.when(F.col("table_idx") % 3 == 0, False).alias("initial_value_reliable"), name, "statistics")
        item = F.struct("monitoring_item", F.col("monitor_date").alias("positive_max"))
        body = F.struct(F.array(table).alias("tables"), F.when(F.col("table_idx") % 2 == 0, F.col("thresholds")).alias("thresholds"), F.array(item).alias("summary_items"), F.lit("7d").alias("interval_days"), F.when(F.col("table_idx") % 3 == 1, F.concat(F.lit("N"), (F.col("table_idx") + since).cast("string"))).otherwise("").alias("report_number"), F.when(F.col("table_idx") % 4 == 2, F.col("monitor_date")).alias("monitoring_date"))
        held = tables.join(rows, key).join(stat, key).join(limits, "report_id", "left")
        made.append(held.select("report_id", (F.col("table_idx") + since).cast("int").alias("chunk_no"), F.to_json(body).alias("raw")))
    return made[0].unionByName(made[1])


_CHUNKS = """, c AS (SELECT report_id, table_idx AS own, table_idx AS chunk, monitoring_item, monitor_date, monitor_count, category, point_count, borehole_id, table_unit FROM t UNION ALL SELECT report_id, table_idx, 100000 + table_idx, monitoring_item, monitor_date, monitor_count, category, point_count, borehole_id, table_unit FROM dt),
i AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY chunk) - 1 AS idx FROM c) """
_STATS = "positive_max_id positive_max_value negative_max_id negative_max_value max_rate_id max_rate_value max_force_id max_force_value min_force_id min_force_value".split()
_said = ", ".join(f"coalesce({c}, '') AS {c}" if c.endswith("_id") else c for c in _STATS)


def _landed(name: str, sql: str) -> None:
    _query(f"lnd_04_{name}", lambda x: landing.land(landing.parse_responses(_whole_responses(x))[0])[name], _CHUNKS + sql, ("points", "deep_points"))


_query("lnd_06_fields", lambda x: landing.merge_header(landing.parse_responses(_whole_responses(x))[0]), _CHUNKS + """SELECT report_id, '' AS project_name, '' AS monitoring_company, coalesce('N' || min(chunk) FILTER (own % 3 = 1), '') AS report_number, '' AS monitoring_period,
  coalesce(arg_min(monitor_date, chunk) FILTER (own % 4 = 2), '') AS monitoring_date, '' AS conclusion, '7d' AS interval_days FROM i GROUP BY 1""", ("points", "deep_points"))  # fmt: skip
_landed("mon_tables", "SELECT report_id, idx AS table_idx, monitoring_item, category, monitor_date, monitor_count, '' AS equipment_type, '' AS equipment_model, point_count, borehole_id, NULL::DOUBLE AS borehole_depth, table_unit, own % 3 <> 0 AS initial_value_reliable, 7.0::DOUBLE AS interval_days FROM i")
_landed("points", "SELECT i.report_id, idx AS table_idx, row_no, point_id, initial_value, NULL::DOUBLE AS previous_value, current_value, current_change, cumulative_change, change_rate, safety_status FROM i JOIN p ON p.report_id = i.report_id AND p.table_idx = i.chunk")
_landed("deep_points", "SELECT i.report_id, idx AS table_idx, row_number() OVER (PARTITION BY i.report_id, idx ORDER BY row_no) - 1 AS row_no, depth, previous_cumulative, current_cumulative, current_change, change_rate FROM i JOIN d ON d.report_id = i.report_id AND 100000 + d.table_idx = i.chunk WHERE row_no % 5 <> 4")
_landed("thresholds", "SELECT report_id, th_no, item_name, warning_value, control_value, rate_limit FROM th WHERE report_id IN (SELECT report_id FROM i WHERE own % 2 = 0)")
_landed("summary_items", "SELECT report_id, row_number() OVER (PARTITION BY report_id ORDER BY min(chunk)) - 1 AS item_no, monitoring_item, arg_min(monitor_date, chunk) AS positive_max, '' AS positive_max_id, '' AS negative_max, '' AS negative_max_id, '' AS max_rate, '' AS max_rate_id, '' AS safety_status FROM i GROUP BY report_id, monitoring_item")
_landed("table_stats", f"SELECT i.report_id, idx AS table_idx, {_said}, '' AS max_change_id, NULL::DOUBLE AS max_change_value FROM i JOIN s ON s.report_id = i.report_id AND s.table_idx = i.chunk UNION ALL SELECT i.report_id, idx AS table_idx, {_said}, coalesce(max_change_id, '') AS max_change_id, max_change_value FROM i JOIN ds ON ds.report_id = i.report_id AND 100000 + ds.table_idx = i.chunk")


def _broken_responses(x: dict[str, DataFrame]) -> DataFrame:
    """A response a table with what a strict parser refuses: line breaks and tabs inside texts, and units after numbers."""
    unit = F.element_at(F.array(*[F.lit(u) for u in ("", "cm", "KN", " kn", "")]), (F.col("table_idx") % 5 + 1).cast("int"))
    point = F.concat(F.lit('{"point_id": "'), "point_id", F.lit('",\n"cumulative_change": '), F.format_string("%.2f", "cumulative_change"), unit, F.lit("}"))
    body = _by_table(x["points"], point, ",\n")
    name = F.element_at(F.array(*[F.lit(u) for u in ("P \\\"5\\\"\n", "P\r\nQ\t5", "P")]), (F.col("table_idx") % 3 + 1).cast("int"))
    return body.select("report_id", F.col("table_idx").cast("int").alias("chunk_no"), F.concat(F.lit('{"project_name": "'), name, F.lit('",\n"tables": [{"points": ['), "body", F.lit("]}]}")).alias("raw"))


_query("lnd_02_repaired_names", lambda x: landing.parse_responses(_broken_responses(x))[0].select("report_id", "chunk_no", F.col("x.project_name").alias("project_name")),
       """SELECT DISTINCT report_id, table_idx AS chunk_no, CASE table_idx % 3 WHEN 0 THEN 'P "5"' || chr(10) WHEN 1 THEN 'P' || chr(13) || chr(10) || 'Q' || chr(9) || '5' ELSE 'P' END AS project_name FROM p""")  # fmt: skip
_query("lnd_02_repaired_points", lambda x: landing.land(landing.parse_responses(_broken_responses(x))[0])["points"].select("report_id", "table_idx", "row_no", "point_id", F.round("cumulative_change", 2).alias("cum")),
       "SELECT report_id, dense_rank() OVER (PARTITION BY report_id ORDER BY table_idx) - 1 AS table_idx, row_no, point_id, round(cumulative_change, 2) AS cum FROM p")


def _cut_responses(x: dict[str, DataFrame]) -> DataFrame:
    """A response a table that ends anywhere: after two thirds of its characters."""
    point = F.concat(F.lit('{"point_id": "'), "point_id", F.lit('", "cumulative_change": '), F.format_string("%.2f", "cumulative_change"), F.lit(', "said": ["a}", 1mm]}'))
    whole = F.concat(F.lit('{"project_name": "P", "tables": [{"monitoring_item": "地下水位", "points": ['), "body", F.lit("]}]}"))
    body = _by_table(x["points"], point, ", ")
    return body.select("report_id", F.col("table_idx").cast("int").alias("chunk_no"), F.left(whole, F.floor(F.length(whole) * 2 / 3).cast("int")).alias("raw"))


_CUT = """, z AS (SELECT report_id, table_idx, row_no, point_id, cumulative_change, '{"point_id": "' || point_id || '", "cumulative_change": ' || printf('%.2f', cumulative_change) || ', "said": ["a}", 1mm]}' AS said FROM p),
y AS (SELECT *, sum(len(said) + 2) OVER w - 2 AS upto, sum(len(said) + 2) OVER (PARTITION BY report_id, table_idx) - 2 AS own, len('{"project_name": "P", "tables": [{"monitoring_item": "地下水位", "points": [') AS before FROM z WINDOW w AS (PARTITION BY report_id, table_idx ORDER BY row_no)),
c AS (SELECT *, dense_rank() OVER (PARTITION BY report_id ORDER BY table_idx) - 1 AS i FROM y) """
_query("lnd_02_cut_points", lambda x: landing.land(landing.parse_responses(_cut_responses(x))[0])["points"].select("report_id", "table_idx", "row_no", "point_id", F.round("cumulative_change", 2).alias("cum")),
       _CUT + "SELECT report_id, i AS table_idx, row_no, point_id, round(cumulative_change, 2) AS cum FROM c WHERE before + upto <= floor((before + own + 4) * 2 / 3)")


def _loose_responses(x: dict[str, DataFrame]) -> DataFrame:
    """A response a table in loose spellings of objects: names without quotes, single quotes, comments; and prose."""
    kind = F.col("table_idx") % 4
    name = lambda c: F.when(kind == 0, c).when(kind == 1, f"'{c}'").otherwise(f'"{c}"')
    point = F.concat(F.lit("{"), name("point_id"), F.lit(": "), F.when(kind == 1, F.concat(F.lit("'"), "point_id", F.lit("'"))).otherwise(F.concat(F.lit('"'), "point_id", F.lit('"'))), F.lit(", "), name("cumulative_change"), F.lit(": "), F.format_string("%.2f", "cumulative_change"), F.lit("}"))
    body = _by_table(x["points"], point, ",\n")
    text = F.concat(F.lit("{ /* as read */ "), name("tables"), F.lit(": [{"), name("points"), F.lit(": ["), "body", F.lit("]}]}"))
    return body.select("report_id", F.col("table_idx").cast("int").alias("chunk_no"), F.when(kind == 3, F.regexp_replace("body", r"[{}]", "")).otherwise(text).alias("raw"))


_query("lnd_03_loose_points", lambda x: landing.land(landing.parse_responses(_loose_responses(x))[0])["points"].select("report_id", "table_idx", "row_no", "point_id", F.round("cumulative_change", 2).alias("cum")),
       ", k AS (SELECT report_id, table_idx AS c, dense_rank() OVER (PARTITION BY report_id ORDER BY table_idx) - 1 AS i FROM (SELECT DISTINCT report_id, table_idx FROM p WHERE table_idx % 4 <> 3)) SELECT p.report_id, i AS table_idx, row_no, point_id, round(cumulative_change, 2) AS cum FROM p JOIN k ON k.report_id = p.report_id AND k.c = p.table_idx")
_query("lnd_03_loose_quarantine", lambda x: landing.parse_responses(_loose_responses(x))[1].select("report_id", "chunk_no"), "SELECT DISTINCT report_id, table_idx AS chunk_no FROM p WHERE table_idx % 4 = 3")


_SAVED = "SELECT report_id, table_idx, point_id || '-' || CAST(report_id AS STRING) AS prompt_key, CASE row_no % 4 WHEN 0 THEN chr(123) || '\"table\": ' || CAST(table_idx AS STRING) || chr(125) WHEN 1 THEN 'the answer in many words ' || CAST(table_idx AS STRING) WHEN 2 THEN 'short' ELSE ' ' END AS raw, CAST(CASE WHEN table_idx % 6 = 5 THEN 0.7 ELSE 0.1 END AS DOUBLE) AS temperature, CAST(table_idx % 60 AS INT) AS moment FROM {0}"


def _cache(x: dict[str, DataFrame]) -> DataFrame:
    """Responses saved in two runs, the later ones first, and read from the compacted cache."""
    spark = x["points"].sparkSession
    said = spark.sql(_SAVED.format("{points}"), points=x["points"]).withColumn("saved_at", F.timestamp_seconds(F.col("moment")))
    path = f"{shared_folder(spark)}/responses-{uuid.uuid4().hex}"
    for some in ("moment >= 30", "moment < 30"):
        landing.save_responses(said.where(some), path)
    landing.compact_responses(spark, path, f"{path}-compact")
    return landing.cached_responses(spark, f"{path}-compact")


_KEPT = f", sv AS ({_SAVED.format('p')}), kp AS (SELECT * FROM sv WHERE temperature <= 0.3 AND trim(raw) <> '' AND (len(trim(raw)) >= 20 OR trim(raw)[1:1] = '{{')) "
_query("lnd_09_merged", lambda x: _cache(x).select("prompt_key", "raw", "temperature"), _KEPT + "SELECT prompt_key, raw, temperature FROM (SELECT *, row_number() OVER (PARTITION BY prompt_key ORDER BY moment DESC, raw DESC) AS k FROM kp) WHERE k = 1")
_query("lnd_09_hits", lambda x: landing.cache_hits(x["points"].sparkSession.sql(_SAVED.format("{points}"), points=x["points"]).drop("raw"), _cache(x)),
       _KEPT + "SELECT report_id, count(*) AS requests, count(*) FILTER (temperature <= 0.3 AND prompt_key IN (SELECT prompt_key FROM kp)) AS hits FROM sv GROUP BY 1")
