"""Which line of a chunk, and which cell of it, a landed number was read from.

Rows are found by the words of a line, an equi-join, and scored; what lies above
a line (its page, the nearest dates and labels) comes from windows over the
chunk's lines, at most ``SCAN`` lines back and across one page border. A chunk
is as long as a request to the reader may be, so its windows are short.

The nearest header that fits a row is an as-of join with a condition: headers
and rows go into one stream, each under the classes that it may meet in, and the
last header of a class before a row is found by one window (``_as_of``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import computed_once, let, worked_out

SCAN = 60
CHUNK = ["report_id", "chunk_no"]
ROW = ["report_id", "table_idx", "row_no"]
VALUES = ("initial_value", "previous_value", "current_value", "current_change", "cumulative_change", "change_rate", "depth", "previous_cumulative", "current_cumulative")
# How page borders and dates are printed.
MARKER = r"---\s*第\s*(\d+)\s*页(?:\s*/\s*共\s*\d+\s*页)?\s*---"
DATE = r"20\d{2}[-/.]\d{1,2}[-/.]\d{1,2}"
_WORD, _NUMBER = "[A-Za-z0-9_-]", r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"

# What a column is called, in the order in which names are tried.
HEADERS = {
    "previous_cumulative": ("上次累计", "上期累计"),
    "current_cumulative": ("本次累计", "本期累计"),
    "current_change": ("本次变化", "本期变化", "单次变化"),
    "cumulative_change": ("累计变化", "累计位移", "累计沉降"),
    "change_rate": ("变化速率", "变形速率", "速率"),
    "initial_value": ("初始断面距离", "初始高程", "初始值", "初始内力"),
    "previous_value": ("上次值", "上期值", "上次高程", "上期高程"),
    "current_value": ("本次断面距离", "本次高程", "本次值", "本期值", "实测值", "本次内力", "本期轴力值"),
    "depth": ("深度",),
}
# What the three columns of a period are called in wide tables.
METRICS = {
    "current_change": ("本次", "本次变化", "本次变化量", "本期变化", "本期变化量"),
    "cumulative_change": ("累计", "累计变化", "累计变化量", "累计位移", "累计沉降"),
    "change_rate": ("变化速率", "变形速率", "本期速率", "速率"),
    "current_value": ("测值", "轴力值", "本次值", "本期值", "本期轴力值", "当前值"),
}
# What the columns of points, states and initial values are called.
POINT_LABELS, STATUS_LABEL, INITIAL = ("测点编号", "测点", "孔号", "测孔编号"), "安全状态", "初始"


def day(c: Column) -> Column:
    """A date of any of the printed forms as yyyy-MM-dd; empty without one."""
    parts = F.split(F.regexp_extract(c, DATE, 0), r"[-/.]")
    return F.when(F.size(parts) == 3, F.concat_ws("-", F.get(parts, 0), F.lpad(F.get(parts, 1), 2, "0"), F.lpad(F.get(parts, 2), 2, "0"))).otherwise("")


def cells_of(c: Column) -> Column:
    """PRV-04: the cells of a line: between bars if it starts with one, else between blanks."""
    text = F.trim(F.regexp_replace(c, r"[\t\r]", " "))
    barred = F.transform(F.split(F.regexp_replace(text, r"^\|+|\|+$", ""), r"\|"), lambda x: F.trim(x))
    return F.when(text == "", F.array().cast("array<string>")).when(text.startswith("|"), barred).otherwise(F.split(text, r"\s+"))


def _field(cell: Column, names: dict[str, tuple[str, ...]], test) -> Column:
    bare = F.regexp_replace(cell, r"\s+", "")
    out = F.lit(None).cast("string")
    for field, aliases in reversed(names.items()):
        out = F.when(test(bare, aliases), field).otherwise(out)
    return out


def header_columns(cells: Column) -> Column:
    """Field to column (from 1) of a line's cells; a field's first column counts, and a cell names the first field whose name it holds and that is not named yet."""
    bare = F.transform(cells, lambda x: F.regexp_replace(x, r"\s+", ""))
    holds = lambda bare: F.transform(bare, lambda x: F.struct(*[x.rlike("|".join(aliases)).alias(field) for field, aliases in HEADERS.items()]))

    def put(done: Column, x: Column) -> Column:
        new = F.coalesce(*[F.when(x["says"][field] & ~F.map_contains_key(done, F.lit(field)), F.lit(field)) for field in HEADERS], F.lit(""))
        return F.when(new == "", done).otherwise(F.map_concat(done, F.create_map(new, x["at"])))

    none = F.create_map().cast("map<string,int>")
    named = lambda bare: F.aggregate(F.transform(holds(bare), lambda x, i: F.struct(x.alias("says"), (i + 1).alias("at"))), none, put)
    return let(bare, lambda bare: F.when(F.array_join(bare, " ").rlike("|".join(w for aliases in HEADERS.values() for w in aliases)), named(bare)).otherwise(none))


def read_lines(lines: DataFrame) -> DataFrame:
    """PRV-03 and what lies above each line of (report_id, chunk_no, line_no, text): page, markers so far, the nearest dates and labels; and the line's cells, header columns and metrics."""
    chunk = Window.partitionBy(*CHUNK).orderBy("line_no")
    so_far, above = chunk.rowsBetween(Window.unboundedPreceding, 0), chunk.rowsBetween(Window.unboundedPreceding, -1)
    text = F.trim("text")
    marks = worked_out(lines.withColumn("text", text), page=F.regexp_extract("text", MARKER, 1).try_cast("int"), cells=cells_of(F.col("text")))
    plain = F.col("page").isNull()
    dates = F.transform(F.regexp_extract_all("text", F.lit(DATE), F.lit(0)), day)
    metric = F.filter(F.transform("cells", lambda x: _field(x, METRICS, lambda bare, names: bare.isin(*names))), lambda x: x.isNotNull())
    own = marks.withColumns({
        "marks": F.count("page").over(so_far), "place": F.row_number().over(chunk), "source_page": F.last("page", ignorenulls=True).over(so_far), "dates": F.when(plain, dates), "columns": F.when(plain, header_columns(F.col("cells"))), "metrics": F.when(plain, metric),
        "says_point": plain & text.rlike("|".join(POINT_LABELS)), "says_status": plain & (F.contains(text, F.lit(STATUS_LABEL)) | (text == "状态")),
        "says_initial": plain & F.exists("cells", lambda x: (x == INITIAL) | x.startswith("初始值") | x.startswith("初始高程")), "says_axes": plain & (F.upper(F.array_join("cells", " ")) == "X Y"),
    })

    def nearest(test: Column, value: Column) -> Column:
        """What the nearest line above that passes has; null if it is more than SCAN lines away or two page borders lie between."""
        found = F.last(F.when(test, F.struct("marks", "place", value.alias("value"))), ignorenulls=True).over(above)
        return F.when((F.col("place") - found["place"] <= SCAN) & (F.col("marks") - found["marks"] <= 1), found["value"])

    seen = {name: F.coalesce(nearest(F.col(f"says_{name}"), F.lit(True)), F.lit(False)) for name in ("point", "status", "initial", "axes")}
    return own.withColumns({"near_dates": nearest(F.size("dates") > 0, F.col("dates")), **{f"near_{k}": v for k, v in seen.items()}}).drop(*[f"says_{k}" for k in seen])


def _shortest(v: Column) -> Column:
    """A number to six significant digits, without zeros at the end."""
    size, out = F.abs(v), F.lit(None).cast("string")
    for digits in range(9, -1, -1):
        out = F.when(size < 10.0 ** (6 - digits), F.format_string(f"%.{digits}f", v)).otherwise(out) if digits < 9 else F.when(size >= 1e-4, F.format_string("%.9f", v))
    return F.when(v == 0, "0").otherwise(F.regexp_replace(F.regexp_replace(out, r"(\.\d*?)0+$", "$1"), r"\.$", ""))


def value_tokens(v: Column) -> Column:
    """The ways in which a number may be printed."""
    return F.when(v.isNull(), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(v.cast("string"), _shortest(v), F.format_string("%.1f", v), F.format_string("%.2f", v))))


def printed(*values: str) -> Column:
    """The different ways in which a row's numbers may be printed."""
    return F.array_distinct(F.flatten(F.array(*[value_tokens(F.col(c)) for c in values])))


def candidate_lines(points: DataFrame, read: DataFrame) -> DataFrame:
    """PRV-01: the lines of a point's chunk that hold its id with no letter, digit, ``_`` or ``-`` on either side, whatever the case.

    Every run of such characters in an id is a word of the line too, so the id's first run is joined to the lines' words; ids that are more than one run are looked for in the lines that are left.
    """
    key = F.upper(F.regexp_extract("point_id", f"{_WORD}+", 0))
    wanted = points.where(F.trim("point_id") != "").withColumn("token", key)
    words = F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(F.upper("text"), F.lit(f"{_WORD}+"), F.lit(0))))
    # only words that an id of the chunk begins with: few of a line's, found before its columns travel
    asked = wanted.groupBy(*CHUNK).agg(F.collect_set("token").alias("asked"))
    told = read.join(asked, CHUNK).select(*CHUNK, "line_no", "text", "source_page", "cells", "marks", "place", *[c for c in read.columns if c.startswith("near_")], F.array_intersect(words, "asked").alias("tokens"))
    lines = told.withColumn("token", F.explode("tokens")).drop("tokens")
    whole = F.rlike("text", F.concat(F.lit(rf"(?i)(?<!{_WORD})\Q"), F.trim("point_id"), F.lit(rf"\E(?!{_WORD})")))
    return wanted.join(lines, [*CHUNK, "token"]).where((F.upper(F.trim("point_id")) == F.col("token")) | whole).drop("token")


def best_line(candidates: DataFrame, values: tuple[str, ...] = VALUES) -> DataFrame:
    """PRV-02: of a point's lines the one under its date, then with most of its numbers, then in a barred row, then the earliest."""
    have = [c for c in values if c in candidates.columns]
    tokens = F.col("_tokens") if "_tokens" in candidates.columns else printed(*have)
    due = day(F.coalesce("monitor_date", F.lit("")))
    score = F.struct(
        F.coalesce((due != "") & F.array_contains("near_dates", due), F.lit(False)).alias("dated"), F.size(F.filter(tokens, lambda t: F.contains("text", t))).alias("values"),
        (F.col("text").startswith("|") & F.col("text").endswith("|")).alias("barred"), (-F.col("line_no")).alias("early"),
    )
    kept = ["line_no", "text", "source_page", "cells", "marks", "place", *[c for c in candidates.columns if c.startswith("near_")]]
    best = candidates.groupBy(ROW).agg(F.max_by(F.struct(*kept), score).alias("best"))
    return best.select(*ROW, "best.*").withColumnsRenamed({"text": "source_row_text"})


def _as_of(rows: DataFrame, lines: DataFrame, name: str) -> DataFrame:
    """For each row (ROW) the ``value`` of the nearest of ``lines`` above it, in reach, that has one of the row's classes.

    ``lines``: (CHUNK, at, marked, classes, value) and ``rows``: (ROW, chunk_no, place, marks, probes), each of its probes (class, moved). Rows and lines of a
    class come in one order, and a line that is out of reach hides none that is in reach. The value is (value, moved of the probe).
    """
    built = lines.select(*CHUNK, F.explode("classes").alias("class"), F.col("at").alias("place"), F.lit(1).alias("side"), F.struct(F.col("at"), F.col("marked"), F.col("value")).alias("line"))
    probes = rows.select(*ROW, "chunk_no", "place", "marks", F.explode("probes").alias("p")).select(*ROW, "chunk_no", "place", "marks", "p.*").withColumn("side", F.lit(0))
    stream = probes.unionByName(built, allowMissingColumns=True)
    order = Window.partitionBy(*CHUNK, "class").orderBy("place", "side").rowsBetween(Window.unboundedPreceding, -1)
    told = stream.withColumn("above", F.last("line", ignorenulls=True).over(order)).where("side = 0")
    reach = (F.col("above.at") < F.col("place")) & (F.col("above.at") >= F.col("place") - SCAN) & (F.col("marks") - F.col("above.marked") <= 1)
    return told.where(reach).groupBy(ROW).agg(F.max_by(F.struct(F.col("above.value").alias("value"), "moved"), "above.at").alias(name))


def nearest_header(rows: DataFrame, read: DataFrame) -> DataFrame:
    """PRV-05: per row the columns of the nearest header above: as wide as the row, or narrower by the labels of points and states that stand elsewhere."""
    lines = read.where(F.size(F.map_keys("columns")) >= 2).select(*CHUNK, F.col("place").alias("at"), F.col("marks").alias("marked"), F.array(F.size("cells")).alias("classes"), F.col("columns").alias("value"))
    probe = lambda less, test: F.when(test, F.struct((F.size("cells") - less).alias("class"), F.lit(min(less, 1)).alias("moved")))
    widths = F.array_compact(F.array(probe(0, F.lit(True)), probe(1, F.col("near_point")), probe(2, F.col("near_point") & F.col("near_status"))))
    found = _as_of(rows.withColumn("probes", widths), lines, "found")
    return found.select(*ROW, F.transform_values("found.value", lambda k, v: v + F.col("found.moved")).alias("header"))


def wide_columns(rows: DataFrame, read: DataFrame) -> DataFrame:
    """PRV-06: per row of a table of several periods the columns of its own period: three metrics for each date, after the id, the initial value and the axis.

    A line of metrics fits rows with up to a third as many dates above them: these numbers are its classes.
    """
    many = F.floor(F.size("metrics") / 3).cast("int")
    lines = read.where(F.size("metrics") >= 3).select(*CHUNK, F.col("place").alias("at"), F.col("marks").alias("marked"), F.sequence(F.lit(1), many).alias("classes"), F.slice("metrics", 1, 3).alias("value"))
    dated = rows.where(F.size("near_dates") > 0)
    found = _as_of(dated.withColumn("probes", F.array(F.struct(F.size("near_dates").alias("class"), F.lit(0).alias("moved")))), lines, "found")
    due = dated.select(*ROW, "near_dates", "near_initial", "near_axes", "cells", day(F.coalesce("monitor_date", F.lit(""))).alias("due")).join(found.select(*ROW, F.col("found.value").alias("metric")), ROW)
    prefix = F.when(F.col("near_axes"), 3).when(F.col("near_initial"), 2).otherwise(1)
    at = F.array_position("near_dates", F.col("due")).cast("int")
    good = (at > 0) & (F.size(F.array_distinct("metric")) == 3) & ((F.size("near_dates") > 1) | ((prefix >= 2) & (F.size("cells") >= 9)))
    start = prefix + (at - 1) * 3 + 1
    return due.where(good).select(*ROW, F.map_from_entries(F.transform("metric", lambda f, i: F.struct(f, start + i))).alias("wide"))


def field_map(rows: DataFrame, values: tuple[str, ...] = VALUES) -> Column:
    """PRV-07: field to column of rows with their cells, values, ``header`` and ``wide``: the column that these name, if its cell is the value; else the only cell that is."""
    own_numbers = F.transform("cells", lambda x: F.when(x.rlike(_NUMBER), x.try_cast("double")))

    def entry(field: str, numbers: Column) -> Column:
        same = lambda x: F.coalesce(F.abs(x - F.col(field)) <= 1e-9, F.lit(False))
        named = F.coalesce(F.try_element_at("wide", F.lit(field)), F.try_element_at("header", F.lit(field)))
        own = F.filter(F.transform(numbers, lambda x, i: F.when(same(x), i + 1)), lambda i: i.isNotNull())
        column = F.when(same(F.get(numbers, named - 1)), named).when(F.size(own) == 1, F.get(own, 0))
        return F.struct(F.lit(field).alias("field"), column.alias("column"))

    return let(own_numbers, lambda numbers: F.map_from_entries(F.filter(F.array(*[entry(c, numbers) for c in values if c in rows.columns]), lambda e: e["column"].isNotNull())))


def trace(points: DataFrame, lines: DataFrame) -> DataFrame:
    """points (with chunk_no and monitor_date) with source_line, source_page, source_row_text and source_field_map; null where no line holds the id."""
    read = computed_once(read_lines(lines))
    best = best_line(candidate_lines(worked_out(points, _tokens=printed(*[c for c in VALUES if c in points.columns])), read))
    rows = computed_once(points.join(best, ROW))
    found = rows.join(nearest_header(rows, read), ROW, "left").join(wide_columns(rows, read), ROW, "left")
    told = found.select(*ROW, F.col("line_no").alias("source_line"), "source_page", "source_row_text", field_map(found).alias("source_field_map"))
    return points.join(told, ROW, "left")


def unpivot_periods(wide: DataFrame, keys: list[str]) -> DataFrame:
    """PRV-08: rows of (dates, cells), a triple of cells to each date, as one row per period; periods without numbers go."""
    triple = lambda i: F.struct(*[F.get("cells", 3 * i + k).try_cast("double").alias(c) for k, c in enumerate(("current_change", "cumulative_change", "change_rate"))])
    long = wide.select(*keys, F.posexplode("dates").alias("period", "monitor_date"), "cells").withColumn("triple", triple(F.col("period")))
    return long.where("triple.current_change is not null or triple.cumulative_change is not null or triple.change_rate is not null").select(*keys, "period", "monitor_date", "triple.*")
