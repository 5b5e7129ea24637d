"""Queries for text functions and document hygiene, with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import hygiene, logic
from ..sources.samples import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Every event becomes a printed number in one of several spellings.
_PRINTED = """
SELECT event_id, CASE event_id % 12 WHEN 0 THEN '−' || v || 'mm' WHEN 1 THEN '累计 ' || v || ' mm/d' WHEN 2 THEN '１２．' || CAST(event_id % 10 AS STRING) WHEN 3 THEN '1,' || CAST(100 + event_id % 900 AS STRING) || '.5kN' WHEN 4 THEN '--' WHEN 5 THEN v || 'e-2'
  WHEN 6 THEN '正常' WHEN 7 THEN '' WHEN 8 THEN '－' || v || ' KN' WHEN 9 THEN '2024年' || CAST(1 + event_id % 12 AS STRING) || '月' || CAST(1 + event_id % 28 AS STRING) || '日' WHEN 10 THEN 'N/A' ELSE '坡顶水平位移 ' || v || '°C' END AS s,
  CASE event_id % 11 WHEN 0 THEN '深层水平位移' WHEN 1 THEN '支护桩测斜' WHEN 2 THEN '锚索拉力监测' WHEN 3 THEN '支撑轴力' WHEN 4 THEN '坡顶水平位移' WHEN 5 THEN '立柱竖向位移' WHEN 6 THEN '地面沉降' WHEN 7 THEN '地下水位' WHEN 8 THEN '测斜' WHEN 9 THEN '裂缝' ELSE event_type END AS name,
  CASE event_id % 7 WHEN 0 THEN '疑似OCR错列' WHEN 1 THEN '统计口径不同' WHEN 2 THEN '  ' WHEN 3 THEN '单位不清' WHEN 4 THEN '报告笔误' WHEN 5 THEN '边界判定' ELSE NULL END AS reason
FROM (SELECT event_id, event_type, CAST(CAST(value AS DECIMAL(18, 2)) AS STRING) AS v FROM {events}) x
"""


def _printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_PRINTED, events=read(spark, sf_dir, "events").select("event_id", "event_type", "value"))


def _query(name: str, build: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = build
    if sql is not None:
        ORACLES[name] = f"WITH x AS ({_PRINTED.replace('{events}', 'events')}) {sql}"


def _mapped(**columns) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _printed(spark, sf_dir).select("event_id", *[f(F.col(c)).alias(n) for n, (f, c) in columns.items()])


_N = f"translate(s, '{text.MINUS_LIKE}{text.WIDE}{text.SPACES}', '{'-' * len(text.MINUS_LIKE)}{text.NARROW}{' ' * len(text.SPACES)}')"
_P = "'([+-])?\\s*(\\d{1,3}(?:,\\d{3})+(?:\\.\\d+)?|\\d+(?:\\.\\d+)?|\\.\\d+)(?:[eE]([+-]?\\d+))?'"
_SENT = ", ".join(f"'{w}'" for w in text.SENTINELS)
_query("txt_01_minus", _mapped(t=(text.normalize_minus, "s")), f"SELECT event_id, translate(s, '{text.MINUS_LIKE}', '{'-' * len(text.MINUS_LIKE)}') AS t FROM x")
_query("txt_02_digits", _mapped(t=(text.normalize_digits, "s")), f"SELECT event_id, translate(s, '{text.WIDE}', '{text.NARROW}') AS t FROM x")
_query("txt_03_spaces", _mapped(t=(text.normalize_spaces, "s")), f"SELECT event_id, translate(s, '{text.SPACES}', '{' ' * len(text.SPACES)}') AS t FROM x")
_query("txt_04_numeric", _mapped(t=(text.normalize_numeric, "s")), f"SELECT event_id, {_N} AS t FROM x")
_query("txt_05_number", _mapped(v=(text.parse_number, "s")), f"""SELECT event_id, CASE WHEN trim(n) IN ({_SENT}) OR d = '' THEN NULL ELSE CASE WHEN g = '-' THEN -1 ELSE 1 END * replace(d, ',', '')::DOUBLE * CASE WHEN e = '' THEN 1 ELSE pow(10.0, TRY_CAST(e AS DOUBLE)) END END AS v
FROM (SELECT event_id, n, regexp_extract(n, {_P}, 1) AS g, regexp_extract(n, {_P}, 2) AS d, regexp_extract(n, {_P}, 3) AS e FROM (SELECT event_id, {_N} AS n FROM x))""")  # fmt: skip
_query("txt_06_unit", _mapped(u=(text.extract_unit, "s")), f"SELECT event_id, CASE WHEN lower(u) = 'kn' THEN 'kN' WHEN u <> '' THEN u END AS u FROM (SELECT event_id, regexp_extract({_N}, '{text.UNITS}', 1) AS u FROM x)")
_query("txt_07_date", _mapped(k=(text.date_key, "s")), f"SELECT event_id, CASE WHEN y <> '' THEN lpad(y, 4, '0') || '-' || lpad(m, 2, '0') || '-' || lpad(d, 2, '0') ELSE trim(s) END AS k FROM (SELECT event_id, s, regexp_extract(s, '{text.DATE}', 1) AS y, regexp_extract(s, '{text.DATE}', 2) AS m, regexp_extract(s, '{text.DATE}', 3) AS d FROM x)")
_query("txt_08_summary_number", _mapped(v=(text.summary_number, "s")), "SELECT event_id, CASE WHEN s NOT IN ('', '/', '--', '-', '——', 'N/A') THEN TRY_CAST(regexp_replace(s, '[a-zA-Z/\\s]', '', 'g') AS DOUBLE) END AS v FROM x")
_query("txt_09_landed", _mapped(v=(text.landed_number, "s"), i=(text.landed_id, "s")), "SELECT event_id, CASE WHEN b NOT IN ('', '--', '-', '——') THEN TRY_CAST(b AS DOUBLE) END AS v, CASE WHEN lower(s) IN ('none', 'null') THEN '' ELSE s END AS i FROM (SELECT event_id, s, regexp_replace(s, '[a-zA-Z·/\\s]', '', 'g') AS b FROM x)")
_query("txt_10_category", _mapped(c=(text.category, "name")), "SELECT event_id, CASE " + " ".join(f"WHEN contains(name, '{w}') THEN '{c}'" for w, c in text.CATEGORIES) + " ELSE 'OTHER' END AS c FROM x")
_query("txt_11_source", _mapped(c=(text.source_from_reason, "reason")), f"SELECT event_id, CASE WHEN reason IS NULL OR trim(reason) = '' THEN '' WHEN regexp_matches(lower(reason), '{'|'.join(text.EXTRACTION_WORDS)}') THEN 'extraction' WHEN regexp_matches(reason, '{'|'.join(text.LOGIC_WORDS)}') THEN 'logic' ELSE 'report' END AS c FROM x")

# Documents stand for page texts: a source is a report, a document one of its pages.
_PAGES = "SELECT CAST(substr(source, 4) AS BIGINT) AS report_id, doc_id AS page_no, text FROM {documents} WHERE source IS NOT NULL"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_PAGES, documents=read(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def _over_pages(name: str, build: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(_pages(spark, sf_dir))
    if sql is not None:
        ORACLES[name] = f"WITH g AS ({_PAGES.replace('{documents}', 'documents')}), l AS (SELECT report_id, page_no, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM g) {sql}"


_over_pages("doc_06_repeat_lines", lambda g: hygiene.drop_repeat_lines(hygiene.lines(g)), "SELECT report_id, page_no, line_no, line FROM (SELECT *, lag(line) OVER (PARTITION BY report_id, page_no ORDER BY line_no) AS before FROM l) WHERE before IS NULL OR before <> line")
_over_pages("doc_08_identical_pages", hygiene.identical_pages, """, n AS (SELECT report_id, page_no, string_agg(trim(line, ' \t\r'), chr(10) ORDER BY line_no) AS t FROM l WHERE trim(line, ' \t\r') <> '' GROUP BY 1, 2),
c AS (SELECT report_id, page_no, min(page_no) OVER (PARTITION BY report_id, t) AS first_page, count(*) OVER (PARTITION BY report_id, t) AS copies FROM n) SELECT report_id, page_no, first_page, copies FROM c WHERE copies > 1""")  # fmt: skip
_over_pages("doc_09_text_quality", lambda g: hygiene.text_quality(g, ("the", "que", "der", "los", "and"), 2000), "SELECT report_id, pages, chars, markers, chars / pages >= 2000 AND markers >= 2 AS good FROM (SELECT report_id, count(*) AS pages, sum(length(text))::BIGINT AS chars, " + " + ".join(f"bool_or(contains(text, '{m}'))::INT" for m in ("the", "que", "der", "los", "and")) + " AS markers FROM g GROUP BY 1)")
_RUNS = """, h AS (SELECT report_id, page_no, i, x FROM (SELECT report_id, page_no, unnest(string_split(text, '')) AS x, unnest(range(1, len(text) + 1)) AS i FROM {0})),
k AS (SELECT *, i - row_number() OVER (PARTITION BY report_id, page_no, x ORDER BY i) AS island FROM h WHERE NOT regexp_matches(x, '^[ \\t\\n\\x0B\\f\\r]$')),
u AS (SELECT report_id, page_no, x AS unit, min(i) - 1 AS start, count(*) AS times FROM k GROUP BY report_id, page_no, x, island HAVING count(*) >= 3)"""
_over_pages("doc_10_repeat_char", lambda g: hygiene.repeat_char(g, 3), _RUNS.format("g") + " SELECT report_id, page_no, (row_number() OVER (PARTITION BY report_id, page_no ORDER BY start) - 1)::INT AS finding_no, start, unit, times FROM u")


def _stretched(chars: str, sizes: range, n: int, kept: str, key: str = "report_id, page_no", prefix: str = "") -> str:
    """SQL tables for repeated units of ``chars`` (key, i from 1, x): all stretches by their periods, and those that are taken one after the other."""
    own, p = key.split(", "), prefix
    same = " UNION ALL ".join(f"SELECT {key}, {size} AS size, min(i) - 1 - {size} AS start, max(i) AS stop FROM (SELECT {key}, i, i - row_number() OVER (PARTITION BY {key} ORDER BY i) AS island FROM (SELECT {key}, i, x = lag(x, {size}) OVER (PARTITION BY {key} ORDER BY i) AS same FROM {chars}) WHERE same) GROUP BY {key}, island HAVING count(*) >= {(n - 1) * size}" for size in sizes)
    at = "greatest(s.start, f.at)"
    times = f"greatest(s.stop - {at}, 0) // s.size"
    on = " AND ".join(f"f.{k} = s.{k}" for k in own)
    return f"""{p}st AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY start, size) AS n FROM ({same})),
{p}fo AS (SELECT {key}, 0::BIGINT AS n, 0::BIGINT AS at, 0::BIGINT AS start, 1::BIGINT AS size, 0::BIGINT AS times FROM {p}st WHERE n = 1
  UNION ALL SELECT {', '.join('s.' + k for k in own)}, s.n, CASE WHEN {times} >= {n} THEN {at} + {times} * s.size ELSE f.at END, {at}, s.size::BIGINT, CASE WHEN {times} >= {n} THEN {times} ELSE 0 END FROM {p}fo f JOIN {p}st s ON {on} AND s.n = f.n + 1),
{p}un AS (SELECT {', '.join('f.' + k for k in own)}, f.start, f.times, string_agg(c.x, '' ORDER BY c.i) AS unit FROM {p}fo f JOIN {chars} c ON {' AND '.join(f'f.{k} = c.{k}' for k in own)} AND c.i BETWEEN f.start + 1 AND f.start + f.size WHERE f.times > 0 GROUP BY ALL),
{p}ta AS (SELECT {key}, start, unit, times FROM {p}un WHERE regexp_matches(unit, '{kept}'))"""


_CHARS = "{0} AS (SELECT {1}, unnest(string_split(text, '')) AS x, unnest(range(1, len(text) + 1)) AS i FROM {2})"
_over_pages("doc_11_repeat_unit", lambda g: hygiene.repeat_unit(g, 3), f", {_CHARS.format('h', 'report_id, page_no', 'g')}, {_stretched('h', range(2, 11), 3, '^[^\n]*$')} SELECT report_id, page_no, (row_number() OVER (PARTITION BY report_id, page_no ORDER BY start) - 1)::INT AS finding_no, start, unit, times FROM ta")
ORACLES["doc_11_repeat_unit"] = ORACLES["doc_11_repeat_unit"].replace("WITH ", "WITH RECURSIVE ", 1)
_over_pages("doc_12_repeat_line", lambda g: hygiene.repeat_line(hygiene.lines(g), 2), """, m AS (SELECT *, trim(line, ' \t\r') AS t, sum(length(line) + 1) OVER (PARTITION BY report_id, page_no ORDER BY line_no) - length(line) - 1 AS start FROM l),
k AS (SELECT *, line_no - row_number() OVER (PARTITION BY report_id, page_no, t ORDER BY line_no) AS island FROM m WHERE length(t) >= 3)
SELECT report_id, page_no, min(line_no) AS line_no, min(start)::BIGINT AS start, t AS unit, count(*) AS times FROM k GROUP BY report_id, page_no, t, island HAVING count(*) >= 2""")  # fmt: skip

# Ten documents are the pages of a report, whose whole text they are together.
_BOUND = "SELECT CAST(floor(doc_id / 10.0) AS BIGINT) AS report_id, CAST(doc_id % 10 AS BIGINT) AS page_no, text FROM {documents}"


PAGES_SQL = _PAGES.replace("{documents}", "documents")


def bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_BOUND, documents=read(spark, sf_dir, "documents").select("doc_id", "text"))


def damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The damage in all documents, as pages and as whole texts of their reports."""
    pages = bound(spark, sf_dir)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda x: x["text"]), "\n")
    return hygiene.damage_findings(pages.groupBy("report_id").agg(whole.alias("text")), pages, 3, 6, 2)


def damage_sql() -> str:
    """SQL tables that end with dm: the same findings."""
    key = "source, report_id, page_no"
    return f"""dg AS ({_BOUND.replace('{documents}', 'documents')}), dw AS (SELECT 'page' AS source, report_id, page_no, text FROM dg UNION ALL SELECT 'report', report_id, -1, string_agg(text, chr(10) ORDER BY page_no) FROM dg GROUP BY report_id),
{_CHARS.format('dh', key, 'dw')}, {_stretched('dh', range(1, 2), 3, '^[^ \t\n\x0B\f\r]$', key, 'dc')}, {_stretched('dh', range(2, 11), 6, '^[^\n]*$', key, 'du')},
dl AS (SELECT {key}, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM dw),
dp AS (SELECT *, trim(line, ' \t\r') AS t, sum(length(line) + 1) OVER (PARTITION BY {key} ORDER BY line_no) - length(line) - 1 AS start FROM dl),
dk AS (SELECT *, line_no - row_number() OVER (PARTITION BY {key}, t ORDER BY line_no) AS island FROM dp WHERE length(t) >= 3),
da AS (SELECT {key}, 'char' AS kind, start, unit, times FROM dcta UNION ALL SELECT {key}, 'unit', start, unit, times FROM duta UNION ALL SELECT {key}, 'line', min(start)::BIGINT, t, count(*) FROM dk GROUP BY {key}, t, island HAVING count(*) >= 2),
dm AS (SELECT report_id, CASE WHEN page_no >= 0 THEN page_no END AS page_no, source, kind, start, unit, times FROM da)"""


QUERIES["doc_13_findings"] = damage
ORACLES["doc_13_findings"] = f"WITH RECURSIVE {damage_sql()} SELECT * FROM dm"
QUERIES["log_01_found_damage"] = lambda spark, sf_dir: logic.check_damage(hygiene.told_findings(damage(spark, sf_dir)))
ORACLES["log_01_found_damage"] = f"""WITH RECURSIVE {damage_sql()},
dn AS (SELECT report_id, row_number() OVER (PARTITION BY report_id ORDER BY source = 'page', page_no, CASE kind WHEN 'char' THEN 1 WHEN 'unit' THEN 2 ELSE 3 END, start) AS line_no, coalesce('page ' || page_no || ': ', '') || 'repeated ' || kind || ' at ' || start || ', ' || times || ' times' AS detail FROM dm)
SELECT report_id, 0 AS line_no, 'LOG-01' AS rule_id, 'warning' AS severity, count(*) || ' findings' AS detail FROM dn GROUP BY 1 UNION ALL SELECT report_id, line_no, 'LOG-01', 'warning', detail FROM dn WHERE line_no <= 5"""

# Markup made of the printed numbers: a page is 20 events, two tables with a line of text before, between and after.
_MARKUP = """
SELECT CAST(floor(event_id / 1000.0) AS BIGINT) AS report_id, CAST(floor(event_id / 20.0) AS BIGINT) % 50 AS page_no, event_id % 20 AS n, event_type AS kind, CAST(CAST(value AS DECIMAL(18, 2)) AS STRING) AS v FROM {events}
"""


def _markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_MARKUP, events=read(spark, sf_dir, "events").select("event_id", "event_type", "value"))
    cell = F.concat(F.lit("<tr><td>"), "kind", F.lit("<br/>x&amp;y</td><td><b>−"), "v", F.lit("</b><img src='i'></td><td></td></tr>"))
    made = F.array_sort(F.collect_list(F.struct("n", cell.alias("html"))))
    half = lambda keep: F.array_join(F.transform(F.filter(made, keep), lambda x: x["html"]), "")
    page = F.concat(F.lit("<p>项目名称 A</p>\n<table border=1>"), half(lambda x: x["n"] < 10), F.lit("</table>次要<br>位移-深度曲线\n10 20 30 40\n深度 m\n10 20 30\n<table>"), half(lambda x: x["n"] >= 10), F.lit("</table><div> 尾 &lt;1&gt; </div>"))
    return rows.groupBy("report_id", "page_no").agg(page.alias("markup"))


def _over_markup(name: str, build: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(_markup(spark, sf_dir))
    if sql is not None:
        ORACLES[name] = f"WITH m AS ({_MARKUP.replace('{events}', 'events')}), r AS (SELECT report_id, page_no, CASE WHEN n < 10 THEN 0 ELSE 1 END AS table_no, row_number() OVER (PARTITION BY report_id, page_no, n >= 10 ORDER BY n) - 1 AS row_no, kind || ' / x&y|-' || v AS said FROM m) {sql}"


def _rows(rows: DataFrame) -> DataFrame:
    return rows.select("report_id", "page_no", "table_no", "row_no", F.array_join("cells", "|").alias("said"))


_over_markup("doc_01_html_cells", lambda g: _rows(hygiene.html_cells(g)), "SELECT * FROM r")
_over_markup("doc_03_04_tables", lambda g: _rows(hygiene.filter_table_rows(hygiene.drop_noise_tables(hygiene.html_cells(g)))), "SELECT * FROM r")
_over_markup("doc_05_text_lines", hygiene.text_lines, "SELECT DISTINCT report_id, page_no, unnest([1, 2, 3, 4, 5]) AS line_no, unnest(['项目名称 A', '次要', '深度 m', '10 20 30', '尾 <1>']) AS line FROM m")

# Markup with parts of charts: a table of numbers, one that a label keeps, one of half noise, and lines between.
_AXIS = "<table><tr><td>10 20 30 40</td></tr><tr><td>1.5 2.5</td></tr></table>"
_LABELLED = "<table><tr><td>位移-深度曲线</td></tr><tr><td>10 20 30</td></tr><tr><td>![a](b.png)</td></tr><tr><td>深度</td><td>&#109;&sup2;&unknown;</td></tr><tr><td>10 20 30</td></tr></table>"
_HALF = "<table><tr><td>1 2 3</td></tr><tr><td>abc</td></tr></table>"


def charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_MARKUP, events=read(spark, sf_dir, "events").select("event_id", "event_type", "value"))
    cell = F.concat(F.lit("<tr><td>"), "kind", F.lit("</td><td>"), "v", F.lit("</td></tr>"))
    own = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", cell.alias("html")))), lambda x: x["html"]), "")
    return rows.groupBy("report_id", "page_no").agg(F.concat(F.lit("<table>"), own, F.lit(f"</table>{_AXIS}<p>位移-深度曲线<br>10 20 30 40<br>深度 m<br>10 20 30</p>{_LABELLED}{_HALF}")).alias("markup"))


def _over_charts(name: str, build: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(charts(spark, sf_dir))
    ORACLES[name] = f"""WITH m AS ({_MARKUP.replace('{events}', 'events')}), g AS (SELECT DISTINCT report_id, page_no FROM m),
a AS (SELECT report_id, page_no, 0 AS table_no, n::INT - min(n) OVER (PARTITION BY report_id, page_no)::INT AS row_no, kind || '|' || v AS said FROM m),
b AS (SELECT report_id, page_no, 2 AS table_no, unnest([0, 1, 2, 3, 4]) AS row_no, unnest(['位移-深度曲线', '10 20 30', '![a](b.png)', '深度|m²&unknown;', '10 20 30']) AS said FROM g) {sql}"""


_over_charts("doc_03_noise_tables", lambda g: _rows(hygiene.drop_noise_tables(hygiene.html_cells(g))), "SELECT * FROM a UNION ALL SELECT * FROM b")
_over_charts("doc_04_chart_rows", lambda g: _rows(hygiene.filter_table_rows(hygiene.drop_noise_tables(hygiene.html_cells(g)))), "SELECT * FROM a UNION ALL SELECT * FROM b WHERE row_no >= 3")
_KEPT = f"""c AS (SELECT report_id, page_no, count(*) AS n, sum(len(kind) + len(v))::BIGINT AS chars FROM m GROUP BY 1, 2),
z AS (SELECT report_id, page_no, n * len('<tr><td></td><td></td></tr>') + chars + len('<table></table><p><br><br><br></p>位移-深度曲线10 20 30 40深度 m10 20 30{_AXIS}{_LABELLED}{_HALF}') AS raw_chars, chars + len('10 20 30 401.5 2.5位移-深度曲线10 20 30 40深度 m10 20 30位移-深度曲线10 20 30![a](b.png)深度&#109;&sup2;&unknown;10 20 301 2 3abc') AS plain_chars,
  len('深度 m10 20 30') + chars + 3 * n + len('深度 | m²&unknown;10 20 30') AS clean_chars, n FROM c),
st AS (SELECT report_id, page_no, raw_chars, plain_chars, clean_chars, round((raw_chars - plain_chars) / raw_chars, 4) AS markup_ratio, 2 AS lines, 2 AS tables, 2 AS dropped_tables, n + 2 AS rows, 2 * n + 3 AS cells, 5 AS noise_lines FROM z)"""
_over_charts("doc_07_page_stats", hygiene.page_stats, f", {_KEPT} SELECT * FROM st")
_over_charts("doc_07_report_stats", lambda g: hygiene.report_stats(hygiene.page_stats(g), 0.55), f", {_KEPT} SELECT report_id, count(*) AS pages, sum(raw_chars)::BIGINT AS raw_chars, sum(plain_chars)::BIGINT AS plain_chars, sum(clean_chars)::BIGINT AS clean_chars, count(*) FILTER (markup_ratio >= 0.55) AS markup_pages, round(sum(clean_chars) / sum(raw_chars), 4) AS compression_ratio FROM st GROUP BY 1")
_query("doc_02_axis_noise", lambda spark, sf_dir: _printed(spark, sf_dir).select("event_id", hygiene.is_axis_noise(F.col("s")).alias("noise")),
       "SELECT event_id, t <> '' AND NOT regexp_matches(t, '" + "|".join(hygiene.KEEP) + "') AND (regexp_matches(t, '^[-•]\\s*[A-Za-z]+[0-9]+$') OR (len(regexp_replace(t, '[^0-9]', '', 'g')) > 0 AND (len(regexp_replace(t, '[^-]', '', 'g')) >= 10 OR (regexp_matches(t, '^[0-9\\-./年月日:~\\sA-Za-z△☐○●]+$') AND len(regexp_replace(t, '[^0-9]', '', 'g')) / greatest(len(t), 1) >= 0.35)))) AS noise FROM (SELECT event_id, trim(s) AS t FROM x)")
