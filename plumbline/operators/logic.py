"""Status, summary and completeness checks across the tables of a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import summary_number
from .containment import either_holds
from .issues import FORCE, TABLE, close_enough, issues, together

# Names that mean the same kind of measurement, in this order.
NAME_GROUPS = (
    ("深层", "测斜"), ("水平位移", "顶部水平", "坡顶水平", "基坑顶位移"), ("竖向位移", "顶部竖向", "坡顶沉降", "基坑顶沉降"),
    ("地面沉降", "道路沉降", "周边地面", "周边道路"), ("管线",), ("水位", "地下水"), ("锚索", "拉力", "轴力"),
)
NORMAL, ALARM, CONTROL = "正常", "报警", "控制"
NEAR, MISMATCH, TOLERANCE = 0.8 - 1e-9, 0.2, 0.15


def name_group(name: Column) -> Column:
    """Which group a name belongs to; null if none."""
    out = F.lit(None).cast("int")
    for k in reversed(range(len(NAME_GROUPS))):
        out = F.when(name.rlike("|".join(NAME_GROUPS[k])), k).otherwise(out)
    return out


def _named_alike(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """(report_id, a, b, grouped): pairs of a report's names that are of one group (grouped), or of which one contains the other; each once."""
    own = lambda df, c: df.where(F.col(c).isNotNull()).select("report_id", c, name_group(F.col(c)).alias("group")).distinct()
    together = own(left, a).join(own(right, b), ["report_id", "group"]).select("report_id", a, b, F.lit(True).alias("grouped"))
    holding = either_holds(left, right, ["report_id"], a, b).withColumn("grouped", F.lit(False))
    return together.unionByName(holding).groupBy("report_id", a, b).agg(F.max("grouped").alias("grouped"))


def match_thresholds(thresholds: DataFrame, mon_tables: DataFrame) -> DataFrame:
    """LOG-04: per table the first threshold of its report that means it."""
    limits = ("th_no", "item_name", "warning_value", "control_value", "rate_limit")
    alike = _named_alike(mon_tables, thresholds, "monitoring_item", "item_name").join(thresholds.select("report_id", *limits), ["report_id", "item_name"])
    first = alike.groupBy("report_id", "monitoring_item").agg(F.min(F.struct(*limits)).alias("first"))
    named = mon_tables.select(*TABLE, "monitoring_item").join(first, ["report_id", "monitoring_item"]).select(*TABLE, "first.*")
    return named.groupBy(TABLE).agg(F.min(F.struct("th_no", "item_name", "warning_value", "control_value", "rate_limit")).alias("x")).select(*TABLE, "x.*")


def match_summary(summary_items: DataFrame, mon_tables: DataFrame) -> DataFrame:
    """LOG-05: the tables that a summary item speaks of: those of its group if the report has any, else those whose names contain each other."""
    items = summary_items.select("report_id", "si_no", F.col("monitoring_item").alias("item"))
    alike = _named_alike(items, mon_tables, "item", "monitoring_item").withColumn("some", F.max("grouped").over(Window.partitionBy("report_id", "item")))
    said = alike.where(F.col("grouped") | ~F.col("some")).select("report_id", "item", "monitoring_item")
    return items.join(said, ["report_id", "item"]).join(mon_tables.select(*TABLE, "monitoring_item", "category"), ["report_id", "monitoring_item"]).select("report_id", "si_no", "table_idx", "category")


def check_status(points: DataFrame, matched: DataFrame) -> DataFrame:
    """LOG-06 and LOG-07: the printed status against limits, and values at 80 percent and more of one."""
    rows = points.where("safety_status <> ''").join(matched, TABLE)
    limit = lambda c: F.abs(F.coalesce(F.col(c), F.lit(0.0)))
    cum, rate = F.abs("cumulative_change"), F.abs("change_rate")
    warning, control, fast = limit("warning_value"), limit("control_value"), limit("rate_limit")
    by_cum = F.when((warning > 0) & (control > 0) & (cum >= control), CONTROL).when((warning > 0) & (cum >= warning), ALARM)
    due = F.coalesce(by_cum, F.when((fast > 0) & (rate >= fast), ALARM), F.lit(NORMAL))
    said = F.trim("safety_status")
    near = lambda v, top: F.coalesce((top > 0) & (v / F.nullif(top, F.lit(0.0)) >= NEAR) & (v < top), F.lit(False))
    missed, early = (said == NORMAL) & (due != NORMAL), (said != NORMAL) & (due == NORMAL)
    close = (said == NORMAL) & (due == NORMAL) & (near(cum, warning) | near(rate, fast))
    value, top = F.when(near(cum, warning), cum).otherwise(rate), F.when(near(cum, warning), warning).otherwise(fast)
    return together(
        issues(rows, "LOG-06", F.when(missed, "error").otherwise("warning"), warning, F.col("cumulative_change"), missed | early),
        issues(rows, "LOG-07", "warning", top, value, close),
    )


def _no_table(df: DataFrame) -> DataFrame:
    return df.withColumns({"table_idx": F.lit(None).cast("bigint"), "row_no": F.col("si_no").cast("int")})


def check_summary(summary_items: DataFrame, matched: DataFrame, points: DataFrame, deep_points: DataFrame) -> DataFrame:
    """LOG-08, LOG-09 and LOG-10: summary rows without a table, and their extremes against all rows of their tables. row_no is the summary row."""
    key = ["report_id", "si_no"]
    orphans = issues(_no_table(summary_items.join(matched.select(key).distinct(), key, "left_anti")), "LOG-08", "info", None, None, point="monitoring_item")
    values = points.select(*TABLE, F.col("cumulative_change").alias("cum"), F.col("current_value").alias("force")).unionByName(deep_points.select(*TABLE, F.col("current_cumulative").alias("cum"), F.lit(None).cast("double").alias("force")))
    cum = F.col("cum")
    found = matched.withColumn("is_force", F.col("category").isin(*FORCE)).join(values, TABLE, "left").groupBy(key).agg(
        F.max("is_force").alias("force"), F.max("force").alias("most"), F.min("force").alias("least"), F.count("cum").alias("n"), F.max(F.when(cum > 0, cum)).alias("top"), F.min(F.when(cum < 0, cum)).alias("bottom"),
        F.max(F.when(cum < 0, cum)).alias("top_negative"), F.min(F.when(cum > 0, cum)).alias("least_positive"),
    )
    rows = _no_table(summary_items.join(found, key)).withColumns({"pos": summary_number(F.col("positive_max")), "neg": summary_number(F.col("negative_max"))})
    pos, neg = F.col("pos"), F.col("neg")
    forces = issues(rows, "LOG-09", "warning", F.col("most"), pos, F.col("force") & ~(close_enough(F.col("most"), pos, 2 * TOLERANCE) | close_enough(F.col("least"), pos, 2 * TOLERANCE)), "positive_max_id")

    def side(printed: Column, actual: Column, nearest: Column, point: str) -> DataFrame:
        none = actual.isNull()
        severity = F.when(none & nearest.isNotNull() & close_enough(nearest, printed, TOLERANCE), "info").otherwise("warning")
        return issues(rows, "LOG-10", severity, actual, printed, ~F.col("force") & (F.col("n") > 0) & printed.isNotNull() & (none | ~close_enough(actual, printed, TOLERANCE)), point)

    return together(orphans, forces, side(pos, F.col("top"), F.col("top_negative"), "positive_max_id"), side(neg, F.col("bottom"), F.col("least_positive"), "negative_max_id"))


def check_point_count(mon_tables: DataFrame, points: DataFrame, deep_points: DataFrame) -> DataFrame:
    """LOG-11 and QUA-01: declared and parsed rows, both present, that differ by a fifth of the larger and more."""
    flat = points.groupBy(TABLE).agg(F.count("*").alias("flat"))
    deep = deep_points.groupBy(TABLE).agg(F.count("*").alias("deep"))
    rows = mon_tables.join(flat, TABLE, "left").join(deep, TABLE, "left").withColumn("parsed", F.coalesce("flat", "deep", F.lit(0)))
    declared, parsed = F.col("point_count"), F.col("parsed")
    off = (declared > 0) & (parsed > 0) & (F.abs(declared - parsed) / F.greatest(declared, parsed) >= MISMATCH)
    return issues(rows, "LOG-11", "warning", declared, parsed, off, None, row=False)


def check_damage(findings: DataFrame, most: int = 5) -> DataFrame:
    """LOG-01: one warning for a damaged report, and its first findings."""
    rank = F.row_number().over(Window.partitionBy("report_id").orderBy("finding_no"))
    ranked = findings.withColumns({"line_no": rank, "n": F.count("*").over(Window.partitionBy("report_id"))}).where((F.col("line_no") == 1) | (F.col("line_no") <= most))
    line = lambda no, detail: F.struct(no.alias("line_no"), detail.alias("detail"))
    head, own = F.when(F.col("line_no") == 1, line(F.lit(0), F.concat(F.col("n").cast("string"), F.lit(" findings")))), F.when(F.col("line_no") <= most, line(F.col("line_no"), F.col("detail")))
    return ranked.select("report_id", F.inline(F.array_compact(F.array(head, own)))).select("report_id", "line_no", F.lit("LOG-01").alias("rule_id"), F.lit("warning").alias("severity"), "detail")


def check_extractable(reports: DataFrame, mon_tables: DataFrame) -> DataFrame:
    """LOG-02: reports without any table."""
    return reports.select("report_id").join(mon_tables.select("report_id"), "report_id", "left_anti").select("report_id", F.lit("LOG-02").alias("rule_id"), F.lit("warning").alias("severity"))


def check_partial_parse(chunk_status: DataFrame) -> DataFrame:
    """LOG-03: reports some of whose chunks failed."""
    return chunk_status.where("failed > 0 and succeeded > 0").select("report_id", F.lit("LOG-03").alias("rule_id"), F.lit("warning").alias("severity"), F.col("failed").alias("failed"))
