"""Hygiene of page texts: lines, repeated lines and pages, and damage left by recognition."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.entities import name2codepoint
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_numeric

PAGE = ["report_id", "page_no"]
_BLANKS = " \t\r"


def _trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANKS))


def lines(pages: DataFrame) -> DataFrame:
    """One row per line of every page, numbered from 1."""
    return pages.select(*PAGE, F.posexplode(F.split("text", "\n"))).select(*PAGE, F.col("col").alias("line"), (F.col("pos") + 1).cast("long").alias("line_no"))


def drop_repeat_lines(line_table: DataFrame) -> DataFrame:
    """DOC-06: lines that differ from the one before."""
    before = F.lag("line").over(Window.partitionBy(*PAGE).orderBy("line_no"))
    return line_table.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col("line"))).select(*PAGE, "line_no", "line")


def identical_pages(pages: DataFrame) -> DataFrame:
    """DOC-08: pages whose trimmed, non-blank lines are those of another page of the report, each with the first such page and their number.

    A class of n equal pages is n rows, not all of its pairs.
    """
    kept = F.filter(F.transform(F.split("text", "\n"), _trimmed), lambda x: x != "")
    marked = pages.select(*PAGE, F.sha2(F.array_join(kept, "\n"), 256).alias("same"), F.size(kept).alias("n")).where("n > 0")
    classes = marked.groupBy("report_id", "same").agg(F.min("page_no").alias("first_page"), F.count("*").alias("copies")).where("copies > 1")
    return marked.join(classes, ["report_id", "same"]).select(*PAGE, "first_page", "copies")


def text_quality(pages: DataFrame, markers: tuple[str, ...], least_chars: float = 50, least_markers: int = 2) -> DataFrame:
    """DOC-09: whether a report's pages hold enough characters and enough of the words that such reports have."""
    has = [F.max(F.contains("text", F.lit(m)).cast("int")) for m in markers]
    sums = pages.groupBy("report_id").agg(F.count("*").alias("pages"), F.sum(F.length("text").cast("long")).alias("chars"), sum(has[1:], has[0]).alias("markers"))
    return sums.withColumn("good", (F.col("chars") / F.col("pages") >= least_chars) & (F.col("markers") >= least_markers))


Finding = tuple[str, int, str, int]


def _taken(kind: str, text: str, sizes: tuple[int, ...], n: int) -> Iterator[Finding]:
    """Stretches of n equal units of one of the sizes and more: where they start, the unit, and how often it comes.

    A stretch of a size is where characters equal those ``size`` behind. Stretches are taken in the order of their starts, of equal ones the shortest unit first,
    each from where the one before has ended, in whole units. For n of 6 and more this is what a pattern with a back-reference finds (of several stretches at a
    place, one lies in the other), but linear in the text.
    """
    chars, found, at = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), [], 0
    for size in (x for x in sizes if n * x <= len(chars)):
        ends = np.concatenate(([-1], np.flatnonzero(chars[size:] != chars[:-size]), [len(chars) - size]))
        found += [(int(ends[k]) + 1, size, int(ends[k + 1]) + size) for k in np.flatnonzero(np.diff(ends) > (n - 1) * size)]
    for start, size, stop in sorted(found):
        start = max(start, at)
        times = max(stop - start, 0) // size
        if times >= n:
            at = start + times * size
            yield kind, start, chars[start : start + size].tobytes().decode("utf-32-le", "surrogatepass"), times


def _char_runs(text: str, n: int) -> Iterator[Finding]:
    return (x for x in _taken("char", text, (1,), n) if x[2] not in " \t\n\x0b\f\r")


def _unit_runs(text: str, n: int) -> Iterator[Finding]:
    return (x for x in _taken("unit", text, tuple(range(2, 11)), n) if "\n" not in x[2])


def _line_runs(text: str, n: int) -> Iterator[Finding]:
    """The same trimmed line of three characters and more, n times in a row and more, as ``repeat_line`` has it."""
    start = 0
    for unit, same in groupby(text.split("\n"), lambda line: line.strip(_BLANKS)):
        sizes = [len(line) + 1 for line in same]
        if len(sizes) >= n and len(unit) >= 3:
            yield "line", start, unit, len(sizes)
        start += sum(sizes)


def _found(texts: DataFrame, *searches: tuple[Callable[[str, int], Iterator[Finding]], int]) -> DataFrame:
    """What the searches find in each text (of PAGE), numbered in the text: one pass, without an exchange."""
    own = texts.select(*PAGE, "text")
    names = ("kind", "finding_no", "start", "unit", "times")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, no, *x) for i, text in enumerate(batch.column("text")) if text.is_valid for no, x in enumerate(x for search, n in searches for x in search(text.as_py(), n))]
            at, no, kind, start, unit, times = zip(*rows) if rows else ((),) * 6
            keys = [batch.column(c).take(pa.array(at, pa.int64())) for c in PAGE]
            found = [pa.array(kind, pa.string()), pa.array(no, pa.int32()), pa.array(start, pa.int64()), pa.array(unit, pa.string()), pa.array(times, pa.int64())]
            yield pa.RecordBatch.from_arrays(keys + found, names=[*PAGE, *names])

    keys = ", ".join(f"{c} {t}" for c, t in own.drop("text").dtypes)
    return own.mapInArrow(find, f"{keys}, kind string, finding_no int, start long, unit string, times long")


def repeat_char(pages: DataFrame, n: int = 200) -> DataFrame:
    """DOC-10: the same non-space character n times in a row and more."""
    return _found(pages, (_char_runs, n)).drop("kind")


def repeat_unit(pages: DataFrame, n: int = 100) -> DataFrame:
    """DOC-11: a unit of two to ten characters, none of them a newline, n times in a row and more."""
    return _found(pages, (_unit_runs, n)).drop("kind")


def damage_findings(reports: DataFrame, pages: DataFrame, chars: int = 200, units: int = 100, repeats: int = 50) -> DataFrame:
    """DOC-13: all three kinds of damage in the whole texts of reports (report_id, text; page null) and in each page, kept apart: what both see counts twice."""
    def of(texts: DataFrame, source: str) -> DataFrame:
        found = _found(texts, (_char_runs, chars), (_unit_runs, units), (_line_runs, repeats))
        return found.select(*PAGE, F.lit(source).alias("source"), "kind", "start", "unit", "times")

    return of(reports.select("report_id", F.lit(None).cast("long").alias("page_no"), "text"), "report").unionByName(of(pages.select(*PAGE, "text"), "page"))


def told_findings(findings: DataFrame) -> DataFrame:
    """Findings with a number in their report, whole texts before pages, and what each says: for the rules that report them."""
    order = Window.partitionBy("report_id").orderBy((F.col("source") == "page"), "page_no", F.array_position(F.array(F.lit("char"), F.lit("unit"), F.lit("line")), F.col("kind")), "start")
    place = F.when(F.col("page_no").isNotNull(), F.concat(F.lit("page "), F.col("page_no").cast("string"), F.lit(": "))).otherwise("")
    detail = F.concat(place, F.lit("repeated "), "kind", F.lit(" at "), F.col("start").cast("string"), F.lit(", "), F.col("times").cast("string"), F.lit(" times"))
    return findings.withColumns({"finding_no": F.row_number().over(order), "detail": detail})


def repeat_line(line_table: DataFrame, n: int = 50) -> DataFrame:
    """DOC-12: the same trimmed line of three characters and more, n times in a row and more; where it starts in the page."""
    page = Window.partitionBy(*PAGE).orderBy("line_no")
    placed = line_table.withColumns({"unit": _trimmed(F.col("line")), "start": F.sum(F.length("line").cast("long") + 1).over(page) - F.length("line") - 1})
    island = F.col("line_no") - F.row_number().over(Window.partitionBy(*PAGE, "unit").orderBy("line_no"))
    runs = placed.where(F.length("unit") >= 3).withColumn("island", island).groupBy(*PAGE, "unit", "island")
    return runs.agg(F.min("line_no").alias("line_no"), F.min("start").alias("start"), F.count("*").alias("times")).where(F.col("times") >= n).drop("island")


# Words of rows that are kept, and titles that open a chart.
KEEP = (
    "项目名称", "监测单位", "监测项", "监测项目", "监测日期", "监测次数", "监测点数量", "监测数据成果汇总", "数据统计", "备注", "测点编号", "测点深度", "测孔编号", "测孔深度", "深度", "点号", "初始",
    "上次累计量", "本次累计量", "本次变化量", "累计变化量", "本期变化", "变化速率", "安全状态", "最大变化速率", "最大变化位移", "最大内力", "最小内力", "当次累计",
)
CHART = ("监测数据成果曲线图", "位移—深度曲线", "位移-深度曲线")
_ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"
# How a table, its rows and its cells are written in markup, by which results are decided.
_TABLES, _ROWS, _CELLS = r"(?is)<table[^>]*>.*?</table>", r"(?is)<tr[^>]*>(.*?)</tr>", r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"


def unescape(c: Column) -> Column:
    """A text with its entities resolved, named ones and numbers, each once; names that are unknown stay."""
    names = F.create_map(*[F.lit(x) for name, code in sorted(name2codepoint.items()) for x in (name, chr(code))])

    def put(x: Column) -> Column:
        bare = F.substring(x, 2, 40)
        bare = F.left(bare, F.length(bare) - 1)
        code = F.when(F.lower(bare).startswith("#x"), F.conv(F.substring(bare, 3, 10), 16, 10)).when(bare.startswith("#"), F.substring(bare, 2, 10)).try_cast("int")
        bad = (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
        return F.when(bad, "\ufffd").when(code.isNotNull(), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.coalesce(F.try_element_at(names, bare), x))

    hits, gaps = F.regexp_extract_all(c, F.lit(_ENTITY), F.lit(0)), F.split(c, _ENTITY, -1)
    whole = F.array_join(F.flatten(F.zip_with(gaps, F.transform(hits, put), lambda g, h: F.array(g, F.coalesce(h, F.lit(""))))), "")
    return F.when(F.contains(c, F.lit("&")), whole).otherwise(c)


def clean_cell(c: Column) -> Column:
    """The text of a cell's markup: breaks as " / ", without images and tags, entities resolved, numbers normalised, spaces collapsed."""
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?i)<br\s*/?>", " / "), r"(?i)<img[^>]*>", ""), r"<[^>]+>", "")
    return F.trim(F.regexp_replace(normalize_numeric(unescape(out)), r"\s+", " "))


def html_cells(pages: DataFrame, markup: str = "markup") -> DataFrame:
    """DOC-01: one row per table row with its cells; blank cells at the end and rows without text go."""
    tables = pages.select(*PAGE, F.posexplode(F.regexp_extract_all(markup, F.lit(_TABLES), F.lit(0))).alias("table_no", "html"))
    rows = tables.select(*PAGE, "table_no", F.posexplode(F.regexp_extract_all("html", F.lit(_ROWS), F.lit(1))).alias("row_no", "html"))
    cells = F.transform(F.regexp_extract_all("html", F.lit(_CELLS), F.lit(1)), clean_cell)
    filled = F.array_max(F.transform("cells", lambda x, i: F.when(x != "", i + 1).otherwise(0)))
    return rows.withColumn("cells", cells).withColumn("n", F.coalesce(filled, F.lit(0))).where("n > 0").select(*PAGE, "table_no", "row_no", F.slice("cells", F.lit(1), F.col("n")).alias("cells"))


def has_keep_marker(c: Column) -> Column:
    return c.rlike("|".join(KEEP))


def is_axis_noise(c: Column) -> Column:
    """DOC-02: whether a text looks like the labels of a chart's axis."""
    text = F.trim(c)
    digits = F.regexp_count(text, F.lit("[0-9]"))
    # What legends look like, and the characters of an axis.
    legend, dashed = text.rlike(r"^[-•]\s*[A-Za-z]+[0-9]+$"), (digits > 0) & (F.regexp_count(text, F.lit("-")) >= 10)
    charset = text.rlike(r"^[\d\-./年月日:~\sA-Za-z△☐○●]+$") & (digits / F.greatest(F.length(text), F.lit(1)) >= 0.35)
    return F.coalesce((text != "") & ~has_keep_marker(text) & (legend | dashed | ((digits > 0) & charset)), F.lit(False))


TABLE = [*PAGE, "table_no"]


def drop_noise_tables(rows: DataFrame) -> DataFrame:
    """DOC-03: rows of tables that aren't chart axes. A marker keeps a table; else its share of axis cells decides."""
    full = F.filter("cells", lambda x: x != "")
    per_row = rows.withColumns({"full": full}).withColumns({"axes": F.size(F.filter("full", is_axis_noise)), "keep": F.exists("full", has_keep_marker), "single": (F.size("full") <= 1).cast("double")})
    per_table = per_row.groupBy(TABLE).agg(F.max("keep").alias("keep"), (F.sum("axes") / F.sum(F.size("full"))).alias("axes"), F.avg("single").alias("single"), F.sum(F.size("full")).alias("n"))
    noise = (F.col("n") == 0) | (~F.col("keep") & ((F.col("axes") >= 0.8) | ((F.col("axes") >= 0.5) & (F.col("single") >= 0.6))))
    return rows.join(per_table.where(~noise).select(TABLE), TABLE)


def filter_table_rows(rows: DataFrame) -> DataFrame:
    """DOC-04: without chart titles, rows of images only, and axis rows between a chart title and the next marker row."""
    full = F.filter("cells", lambda x: x != "")
    marked = rows.withColumn("full", full).withColumn("said", F.array_join("full", " "))
    title = F.col("said").rlike("|".join(CHART))
    image = F.forall("full", lambda x: x.rlike(r"^!\[[^\]]*\]\([^)]+\)$"))
    state = F.when(title, "open").when(~image & has_keep_marker(F.col("said")), "shut")
    before = Window.partitionBy(*TABLE).orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.coalesce(F.last(state, ignorenulls=True).over(before) == "open", F.lit(False))
    axis = is_axis_noise(F.col("said")) | F.forall("full", is_axis_noise)
    return marked.withColumn("opened", opened).where(~title & ~image & ~(F.col("opened") & ~has_keep_marker(F.col("said")) & axis)).select(*TABLE, "row_no", "cells")


def _judged_lines(pages: DataFrame, markup: str) -> DataFrame:
    """The lines of a page's markup outside tables in order, and what becomes of them: kept, noise, or a table's place."""
    flat = F.regexp_replace(F.regexp_replace(F.col(markup), _TABLES, "\n\u0001\n"), r"(?i)<(?:br\s*/?|/?(?:div|p|li|ul|ol|h[1-6]|section|article|tr))[^>]*>", "\n")
    split = pages.select(*PAGE, F.posexplode(F.split(flat, "\n")).alias("at", "raw"))
    said = split.withColumn("line", F.when(F.contains("raw", F.lit("\u0001")), F.lit("\u0001")).otherwise(clean_cell(F.col("raw")))).where("line <> ''")
    table, title = F.col("line") == "\u0001", F.col("line").rlike("|".join(CHART))
    state = F.when(title, "open").when(table | has_keep_marker(F.col("line")), "shut")
    before = Window.partitionBy(*PAGE).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.coalesce(F.last(state, ignorenulls=True).over(before) == "open", F.lit(False))
    fate = F.when(table, "table").when(title | (F.col("opened") & is_axis_noise(F.col("line"))), "noise").otherwise("kept")
    return said.withColumn("opened", opened).select(*PAGE, "at", "line", fate.alias("fate"))


def text_lines(pages: DataFrame, markup: str = "markup") -> DataFrame:
    """DOC-05: the lines of a page's markup outside tables, block tags as line ends, blank lines and chart parts left out."""
    kept = _judged_lines(pages, markup).where("fate = 'kept'")
    return kept.select(*PAGE, F.row_number().over(Window.partitionBy(*PAGE).orderBy("at")).cast("long").alias("line_no"), "line")


def page_stats(pages: DataFrame, markup: str = "markup") -> DataFrame:
    """DOC-07: per page the characters of its markup, of its text without tags and of what is kept, the share that is markup, its lines, tables, rows and cells that stay,
    and the tables and the chart lines and rows that don't."""
    judged, rows = _judged_lines(pages, markup), html_cells(pages, markup)
    tables = drop_noise_tables(rows)
    kept = filter_table_rows(tables)
    long = lambda c: c.cast("long")
    said = judged.groupBy(PAGE).agg(F.count_if(F.col("fate") == "kept").alias("lines"), F.coalesce(F.sum(F.when(F.col("fate") == "kept", long(F.length("line")))), F.lit(0)).alias("line_chars"), F.count_if(F.col("fate") == "noise").alias("noise_lines"))
    found = rows.groupBy(PAGE).agg(F.countDistinct("table_no").alias("all_tables"))
    stay = tables.groupBy(PAGE).agg(F.countDistinct("table_no").alias("tables"), F.count("*").alias("table_rows"))
    cells = kept.groupBy(PAGE).agg(F.count("*").alias("rows"), F.sum(long(F.size("cells"))).alias("cells"), F.sum(long(F.length(F.array_join("cells", " | ")))).alias("cell_chars"))
    raw, bare = F.length(markup), F.length(F.trim(F.regexp_replace(F.col(markup), r"<[^>]+>", "")))
    sized = pages.select(*PAGE, long(raw).alias("raw_chars"), long(bare).alias("plain_chars"), F.coalesce(F.round(F.try_divide(raw - bare, raw), 4), F.lit(0.0)).alias("markup_ratio"))
    for part in (said, found, stay, cells):
        sized = sized.join(part, PAGE, "left")
    sized = sized.fillna(0)
    return sized.select(*PAGE, "raw_chars", "plain_chars", (F.col("line_chars") + F.col("cell_chars")).alias("clean_chars"), "markup_ratio", "lines", "tables", (F.col("all_tables") - F.col("tables")).alias("dropped_tables"), "rows", "cells", (F.col("noise_lines") + F.col("table_rows") - F.col("rows")).alias("noise_lines"))


def report_stats(stats: DataFrame, most: float = 0.9) -> DataFrame:
    """DOC-07: per report the sums over its pages, what share of the markup's characters is kept, and how many pages are mostly markup."""
    sums = stats.groupBy("report_id").agg(F.count("*").alias("pages"), *[F.sum(c).alias(c) for c in ("raw_chars", "plain_chars", "clean_chars")], F.count_if(F.col("markup_ratio") >= most).alias("markup_pages"))
    return sums.withColumn("compression_ratio", F.coalesce(F.round(F.try_divide("clean_chars", "raw_chars"), 4), F.lit(0.0)))
