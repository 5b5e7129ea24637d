"""Recomputing the extremes that authors print under their tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .issues import FORCE, TABLE, close_enough, issues, together
from .store import computed_once

TOLERANCE, RATE_TOLERANCE, HIDDEN_SHARE, LEAST_RATE = 0.15, 0.05, 0.3, 0.05
NO_ID = ("None", "null", "N/A", "-", "/")
GROUP = ["report_id", "item", "borehole", "day"]


def _grouped_tables(mon_tables: DataFrame) -> DataFrame:
    """mon_tables with the key under which continuation pages belong together."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return mon_tables.select(*TABLE, "category", blank("monitoring_item").alias("item"), blank("borehole_id").alias("borehole"), blank("monitor_date").alias("day"))


def group_values(mon_tables: DataFrame, points: DataFrame, deep_points: DataFrame) -> DataFrame:
    """STA-00: one row per point or depth of a group: id, cumulative value, rate, and for depths the change."""
    tables = _grouped_tables(mon_tables).drop("category")
    label = F.concat(F.lit("深度"), F.col("depth").cast("string"), F.lit("m"))
    flat = points.select(*TABLE, F.lit(0).alias("part"), "row_no", F.col("point_id").alias("id"), F.col("point_id").alias("other_id"), F.col("cumulative_change").alias("cum"), F.col("change_rate").alias("rate"), F.lit(None).cast("double").alias("change"))
    deep = deep_points.select(*TABLE, F.lit(1).alias("part"), "row_no", label.alias("id"), F.col("depth").cast("string").alias("other_id"), F.col("current_cumulative").alias("cum"), F.col("change_rate").alias("rate"), F.col("current_change").alias("change"))
    return flat.unionByName(deep).join(tables, TABLE)


def _largest(value: Column, where: Column | None = None) -> Column:
    """(value, id) of the largest value; of equal ones the first in table and row order."""
    order = F.struct(value.alias("key"), -F.col("table_idx"), -F.col("part"), -F.col("row_no"), F.col("id").alias("id"), F.col("cum").alias("cum"), F.col("rate").alias("rate"), F.col("change").alias("change"))
    present = value.isNotNull() if where is None else where & value.isNotNull()
    return F.max(F.when(present, order))


def extremes(grouped: DataFrame) -> DataFrame:
    """Per group everything that the rules ask for, in one aggregation."""
    cum, rate, change = F.col("cum"), F.col("rate"), F.col("change")
    return grouped.groupBy(GROUP).agg(
        _largest(cum, cum > 0).alias("top"), _largest(-cum, cum < 0).alias("bottom"), _largest(cum, cum < 0).alias("least_negative"), _largest(-cum, cum > 0).alias("least_positive"),
        F.count("cum").alias("n_cum"), F.count("rate").alias("n_rate"), _largest(F.abs(rate)).alias("fastest"), _largest(rate, rate < 0).alias("slowest_negative"), F.max(F.coalesce(rate > 0, F.lit(False))).alias("some_positive"),
        _largest(F.abs(change)).alias("widest"), F.collect_set("id").alias("ids"), F.collect_set("other_id").alias("other_ids"),
    )


def _printed(mon_tables: DataFrame, table_stats: DataFrame, deep_points: DataFrame) -> DataFrame:
    """Tables with printed statistics, and whether they have depths."""
    deep = deep_points.select(*TABLE).distinct().withColumn("deep", F.lit(True))
    return _grouped_tables(mon_tables).join(table_stats, TABLE).join(deep, TABLE, "left").withColumn("deep", F.coalesce("deep", F.lit(False)))


def _foreign(stat_id: Column) -> Column:
    """Whether a printed id is neither in the group nor contained in, or containing, one of its ids."""
    known = F.exists(F.concat("ids", "other_ids"), lambda x: F.contains(x, stat_id) | F.contains(stat_id, x))
    return ~F.col("deep") & F.coalesce((stat_id != "") & ~stat_id.isin(*NO_ID), F.lit(False)) & ~known


def _joined(mon_tables, table_stats, points, deep_points) -> DataFrame:
    plain = _printed(mon_tables, table_stats, deep_points).where(~F.col("category").isin(*FORCE))
    return plain.join(extremes(group_values(mon_tables, points, deep_points)), GROUP)


def check_max_force(mon_tables: DataFrame, table_stats: DataFrame, points: DataFrame) -> DataFrame:
    """STA-01 and STA-02: printed extremes of forces against the table's own rows."""
    own = points.where("current_value is not null").groupBy(TABLE).agg(
        F.max(F.struct(F.abs("current_value"), -F.col("row_no"), F.col("point_id").alias("id"), F.col("current_value").alias("v"))).alias("top"),
        F.min(F.struct(F.col("current_value").alias("v"), "row_no", F.col("point_id").alias("id"))).alias("low"),
    )
    rows = mon_tables.where(F.col("category").isin(*FORCE)).select(*TABLE).join(table_stats, TABLE).join(own, TABLE)
    agrees = close_enough(F.col("top.v"), F.col("max_force_value"), TOLERANCE) | close_enough(F.abs("top.v"), F.abs("max_force_value"), TOLERANCE)
    most = issues(rows, "STA-01", "error", F.col("top.v"), F.col("max_force_value"), ~agrees, F.col("top.id"), row=False)
    least = issues(rows, "STA-02", "error", F.col("low.v"), F.col("min_force_value"), ~close_enough(F.col("low.v"), F.col("min_force_value"), TOLERANCE), F.col("low.id"), row=False)
    return most.unionByName(least)


def check_cross_reference(mon_tables: DataFrame, table_stats: DataFrame, points: DataFrame, deep_points: DataFrame) -> DataFrame:
    """STA-08: printed ids that belong to no row of the group."""
    rows = _joined(mon_tables, table_stats, points, deep_points)
    tests = [("positive_max", F.col("n_cum") > 0), ("negative_max", F.col("n_cum") > 0), ("max_rate", F.col("n_rate") > 0)]
    return together(*[issues(rows, "STA-08", "error", None, None, has & F.col(f"{s}_value").isNotNull() & _foreign(F.col(f"{s}_id")), F.col(f"{s}_id"), row=False) for s, has in tests])


def _check_side(rows: DataFrame, points: DataFrame, rule: str, stat: str, side: str, opposite: str, sign: int) -> DataFrame:
    printed, stat_id = F.col(f"{stat}_value"), F.col(f"{stat}_id")
    actual, nearest = F.col(f"{side}.key") * sign, F.col(f"{opposite}.key") * sign
    tolerance = F.when(F.col("category") == "WATER_LEVEL", TOLERANCE * 10).otherwise(TOLERANCE)
    same = points.select(*TABLE, F.col("point_id").alias(f"{stat}_id"), "current_change").join(rows.select(*TABLE, f"{stat}_id", f"{stat}_value", tolerance.alias("tolerance")), [*TABLE, f"{stat}_id"])
    same = same.where((stat_id != "") & F.col("current_change").isNotNull() & close_enough(F.col("current_change"), printed, F.col("tolerance"))).select(*TABLE).distinct().withColumn("is_change", F.lit(True))
    judged = rows.where((F.col("n_cum") > 0) & printed.isNotNull() & ~_foreign(stat_id)).join(same, TABLE, "left")
    none = F.col(side).isNull()
    severity = F.when(none & F.col(opposite).isNotNull() & close_enough(nearest, printed, tolerance), "info").when(none, "warning")
    severity = severity.when(F.col("is_change"), "info").when(F.col("deep"), "warning").otherwise("error")
    point = F.when(none | F.col("is_change"), F.when(stat_id != "", stat_id).otherwise("N/A")).otherwise(F.col(f"{side}.id"))
    return issues(judged, rule, severity, actual, printed, none | ~close_enough(actual, printed, tolerance), point, row=False)


def check_positive_max(mon_tables, table_stats, points, deep_points) -> DataFrame:
    """STA-03 and STA-04: the largest positive cumulative value; where there is none, the value nearest 0 may stand for it."""
    return _check_side(_joined(mon_tables, table_stats, points, deep_points), points, "STA-03", "positive_max", "top", "least_negative", 1)


def check_negative_max(mon_tables, table_stats, points, deep_points) -> DataFrame:
    """STA-05: the mirror of STA-03."""
    return _check_side(_joined(mon_tables, table_stats, points, deep_points), points, "STA-05", "negative_max", "bottom", "least_positive", -1)


def check_max_rate(mon_tables, table_stats, points, deep_points) -> DataFrame:
    """STA-06 and STA-07: the fastest rate; all-negative tables may print the one nearest 0, but not hide a far larger one."""
    return _rate_issues(_joined(mon_tables, table_stats, points, deep_points))


def _rate_issues(rows: DataFrame) -> DataFrame:
    printed, fastest, nearest = F.col("max_rate_value"), F.col("fastest.rate"), F.col("slowest_negative.rate")
    rows = rows.where((F.col("n_rate") > 0) & printed.isNotNull() & ~_foreign(F.col("max_rate_id")))
    by_custom = F.coalesce(nearest.isNotNull() & ~F.col("some_positive") & close_enough(nearest, printed, RATE_TOLERANCE), F.lit(False))
    hidden = (F.abs(fastest) >= LEAST_RATE) & (F.abs(printed) > 0) & (F.abs(printed) < F.abs(fastest) * HIDDEN_SHARE)
    opposed = (fastest * printed < 0) & (F.abs(printed) >= LEAST_RATE)
    named = F.when(F.col("max_rate_id") != "", F.col("max_rate_id")).otherwise("N/A")
    wrong = opposed | ~close_enough(F.abs(fastest), F.abs(printed), RATE_TOLERANCE)
    return together(
        issues(rows, "STA-07", "info", nearest, printed, by_custom, named, row=False), issues(rows, "STA-07", "warning", fastest, printed, by_custom & hidden, F.col("fastest.id"), row=False),
        issues(rows, "STA-06", F.when(opposed | F.col("deep"), "warning").otherwise("error"), fastest, printed, ~by_custom & wrong, F.col("fastest.id"), row=False),
    )


def check_max_change(mon_tables, table_stats, points, deep_points) -> DataFrame:
    """STA-09: the widest change of a profile, unless STA-07 has ended the table's checks."""
    rows = computed_once(_joined(mon_tables, table_stats, points, deep_points).where("max_change_value is not null and widest is not null"))
    ended = _rate_issues(rows).where("rule_id = 'STA-07'").select(*TABLE).distinct()
    label = F.concat(F.lit("深度"), F.col("depth").cast("string"), F.lit("m"))
    stat_id = F.col("max_change_id")
    same = deep_points.join(rows.select(*TABLE, "max_change_id", "max_change_value"), TABLE).where((stat_id != "") & ((stat_id == F.col("depth").cast("string")) | F.contains(label, stat_id)))
    same = same.where(F.col("current_cumulative").isNotNull() & close_enough(F.col("current_cumulative"), F.col("max_change_value"), TOLERANCE)).select(*TABLE).distinct().withColumn("is_cum", F.lit(True))
    judged = rows.join(ended, TABLE, "left_anti").join(same, TABLE, "left")
    printed, actual = F.col("max_change_value"), F.col("widest.change")
    taken = F.coalesce(F.col("is_cum") & F.col("deep"), F.lit(False))
    return issues(judged, "STA-09", F.when(taken, "info").otherwise("error"), actual, printed, ~close_enough(F.abs(actual), F.abs(printed), TOLERANCE), F.when(taken, stat_id).otherwise(F.col("widest.id")), row=False)


def run_statistics_checks(mon_tables, table_stats, points, deep_points) -> DataFrame:
    args = (mon_tables, table_stats, points, deep_points)
    return together(check_max_force(mon_tables, table_stats, points), check_cross_reference(*args), check_positive_max(*args), check_negative_max(*args), check_max_rate(*args), check_max_change(*args))
