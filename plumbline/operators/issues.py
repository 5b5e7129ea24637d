"""The shape that every rule returns: one row per disagreement."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE = ["report_id", "table_idx"]
FORCE = ("ANCHOR_FORCE", "STRUT_FORCE")
FIELDS = ["report_id", "table_idx", "row_no", "point_id", "rule_id", "severity", "expected_num", "actual_num"]


def issues(df: DataFrame, rule: str | Column, severity, expected, actual, where: Column | None = None, point: str | Column | None = "point_id", row: bool = True) -> DataFrame:
    """The rows of df for which ``where`` holds, as issues of a rule."""
    as_column = lambda x, kind: (F.lit(x) if not isinstance(x, Column) else x).cast(kind)
    point = F.col(point) if isinstance(point, str) else point if point is not None else F.lit("ALL")
    df = df if where is None else df.where(where)
    return df.select(
        "report_id", "table_idx", (F.col("row_no") if row else F.lit(None)).cast("int").alias("row_no"), point.cast("string").alias("point_id"), as_column(rule, "string").alias("rule_id"),
        as_column(severity, "string").alias("severity"), as_column(expected, "double").alias("expected_num"), as_column(actual, "double").alias("actual_num"),
    )


@dataclass(frozen=True)
class Rule:
    """A rule over the columns of a row: its name, when it is broken, how badly, and what was expected and printed."""

    name: str
    broken: Column
    severity: Column
    expected: Column
    actual: Column


def broken(rows: DataFrame, rules: list[Rule], point: str | Column = "point_id") -> DataFrame:
    """The issues of many rules in one pass over the rows."""
    one = lambda r: F.when(r.broken, F.struct(F.lit(r.name).alias("rule_id"), r.severity.cast("string").alias("severity"), r.expected.cast("double").alias("expected_num"), r.actual.cast("double").alias("actual_num")))
    named = F.col(point) if isinstance(point, str) else point
    found = rows.select(*TABLE, F.col("row_no").cast("int").alias("row_no"), named.cast("string").alias("point_id"), F.explode(F.array_compact(F.array(*[one(r) for r in rules]))).alias("_broken"))
    return found.select(*TABLE, "row_no", "point_id", "_broken.*")


# What each rule is about, and what it says.
SAYINGS = {
    "CAL-01": ("cumulative_change", "force differs from its readings"), "CAL-02": ("cumulative_change", "cumulative change differs from its readings"), "CAL-03": ("change_rate", "rate differs from change over interval"),
    "CAL-05": ("current_change", "change of depth differs from its cumulative values"), "CAL-06": ("change_rate", "rate of depth differs from change over interval"), "CAL-07": ("cumulative_change", "first period differs from its change"),
    "CAL-08": ("cumulative_change", "period doesn't continue the one before"), "CAL-09": ("current_change", "change stands out"), "CAL-10": ("cumulative_change", "sign differs from its readings"),
    "STA-01": ("max_force", "largest force differs"), "STA-02": ("min_force", "smallest force differs"), "STA-03": ("positive_max", "largest positive value differs"), "STA-05": ("negative_max", "largest negative value differs"),
    "STA-06": ("max_rate", "largest rate differs"), "STA-07": ("max_rate", "largest rate follows another convention"), "STA-08": ("point_id", "point is in another table"), "STA-09": ("max_change", "largest change differs"),
    "LOG-06": ("safety_status", "state differs from its limits"), "LOG-07": ("safety_status", "value is near its limit"), "LOG-08": ("monitoring_item", "summary has no table"), "LOG-09": ("positive_max", "summary's force differs"),
    "LOG-10": ("positive_max", "summary differs from its tables"), "LOG-11": ("point_count", "number of rows differs"),
}


def described(found: DataFrame, mon_tables: DataFrame) -> DataFrame:
    """Issues with the name of their table, the field they are about, and a message that says what was expected and what is printed."""
    told = F.create_map(*[F.lit(x) for rule, (field, text) in SAYINGS.items() for x in (rule, f"{field}|{text}")])
    said = F.split(F.coalesce(F.try_element_at(told, F.col("rule_id")), F.lit("|")), r"\|")
    number = lambda c: F.col(c).cast("decimal(18,3)").cast("string")
    values = F.when(F.col("expected_num").isNotNull() & F.col("actual_num").isNotNull(), F.concat(F.lit(": expected "), number("expected_num"), F.lit(", printed "), number("actual_num"))).otherwise("")
    names = mon_tables.select(*TABLE, F.col("monitoring_item").alias("table_name"))
    return found.join(names, TABLE, "left").withColumns({"table_name": F.coalesce("table_name", F.lit("")), "field_name": F.get(said, 0), "message": F.concat(F.get(said, 1), values)})


def together(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def close_enough(a: Column, b: Column, tolerance) -> Column:
    """Whether two values agree; a missing one agrees with everything."""
    return F.coalesce(F.abs(a - b) <= tolerance, F.lit(True))
