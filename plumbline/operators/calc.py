"""Recomputing what authors derived from readings: cumulative changes, rates, continuity, signs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import date_key, date_keys
from .config import choose_deep_interval, choose_interval
from .issues import FORCE, TABLE, Rule, broken, close_enough, issues, together
from .store import computed_once, laid_out

# What a first period is called.
FIRST_CUES = ("首测", "初测", "首次监测", "第一期", "第1期", "第 1 期", "第一次", "第1次", "第 1 次", "初始监测", "起始监测", "初始基准", "基准日")
_RULE = ["unit_conversion", "cumulative_tolerance", "rate_tolerance", "initial_value_reliable", "severity_for_cumulative"]


def _configured(points: DataFrame, config: DataFrame) -> DataFrame:
    return points.join(config.select(*TABLE, "category", *_RULE), TABLE)


def local_rules() -> list[Rule]:
    """CAL-01, CAL-02 and CAL-10: of points with their table's unit, tolerances, reliability and severity."""
    cum, drift = F.col("cumulative_change"), F.col("current_value") - F.col("initial_value")
    scaled, force = drift * F.col("unit_conversion"), F.col("category").isin(*FORCE)
    wide = F.when(F.abs(cum) > 10, F.greatest(F.col("cumulative_tolerance"), F.abs(cum) * 0.05)).otherwise(F.col("cumulative_tolerance"))
    full, reliable = drift.isNotNull() & cum.isNotNull(), F.col("initial_value_reliable")
    large, small = F.greatest(F.abs(scaled), F.abs(cum)), F.least(F.abs(scaled), F.abs(cum))
    opposed = (small >= 0.5) & (large / small <= 10) & ((scaled > 0) != (cum > 0))
    return [
        Rule("CAL-01", full & force & reliable & ~close_enough(drift, cum, F.col("cumulative_tolerance")), F.lit("error"), drift, cum),
        Rule("CAL-02", full & ~force & reliable & ~close_enough(scaled, cum, wide), F.col("severity_for_cumulative"), scaled, cum),
        Rule("CAL-10", full & opposed, F.when(reliable, "error").otherwise("warning"), scaled, cum),
    ]


def check_row_local(points: DataFrame, config: DataFrame) -> DataFrame:
    """CAL-01, CAL-02 and CAL-10 in one pass over the points: cumulative values of forces and of displacements, and signs."""
    return broken(_configured(points, config), local_rules())


def check_force(points: DataFrame, config: DataFrame) -> DataFrame:
    return check_row_local(points, config).where("rule_id = 'CAL-01'")


def check_cumulative(points: DataFrame, config: DataFrame) -> DataFrame:
    return check_row_local(points, config).where("rule_id = 'CAL-02'")


def check_sign(points: DataFrame, config: DataFrame) -> DataFrame:
    return check_row_local(points, config).where("rule_id = 'CAL-10'")


def check_rate(points: DataFrame, config: DataFrame) -> DataFrame:
    """CAL-03: rate against change over the chosen interval; a row whose own interval is a clean other number is only a warning."""
    held = points.select(*TABLE).distinct()
    config = computed_once(config.where(~F.col("category").isin(*FORCE)))
    known = computed_once(config.join(choose_interval(points, config), TABLE).join(held, TABLE))
    none = issues(known, "CAL-03", "info", None, None, F.col("chosen_days").isNull(), None, row=False)
    rows = points.join(known.where("chosen_days is not null").select(*TABLE, "rate_tolerance", "chosen_days"), TABLE)
    return none.unionByName(broken(rows, rate_rules()))


def rate_rules() -> list[Rule]:
    """CAL-03: of points with their table's interval (chosen_days) and tolerance."""
    change, rate, days = F.col("current_change"), F.col("change_rate"), F.col("chosen_days")
    expected = change / days
    own = F.when(F.abs(rate) > 1e-6, F.abs(change / rate)).otherwise(0.0)
    clean = (F.rint(own) != days) & F.rint(own).between(1, 365) & (F.abs(own - F.rint(own)) <= 0.5)
    wrong = (F.abs(change) >= 1e-6) & rate.isNotNull() & ~close_enough(expected, rate, F.col("rate_tolerance"))
    return [Rule("CAL-03", wrong, F.when(clean, "warning").otherwise("error"), expected, rate)]


def _depth():
    return F.concat(F.lit("深度"), F.col("depth").cast("string"), F.lit("m"))


def check_deep_change(deep_points: DataFrame, config: DataFrame) -> DataFrame:
    """CAL-05: the change of a depth is the difference of its cumulative values."""
    return broken(deep_points.join(config.select(*TABLE, "cumulative_tolerance"), TABLE), deep_change_rules(), _depth())


def deep_change_rules() -> list[Rule]:
    expected = F.col("current_cumulative") - F.col("previous_cumulative")
    return [Rule("CAL-05", ~close_enough(expected, F.col("current_change"), F.col("cumulative_tolerance")), F.lit("error"), expected, F.col("current_change"))]


def check_deep_rate(deep_points: DataFrame, config: DataFrame) -> DataFrame:
    """CAL-06: magnitudes of rates in profiles that print any."""
    printed = deep_points.where("change_rate is not null").select(*TABLE).distinct()
    known = config.join(printed, TABLE).join(choose_deep_interval(deep_points, config), TABLE)
    none = issues(known, "CAL-06", "info", None, None, F.col("chosen_days").isNull(), None, row=False)
    rows = deep_points.join(known.where("chosen_days is not null").select(*TABLE, "rate_tolerance", "chosen_days"), TABLE)
    return none.unionByName(broken(rows, deep_rate_rules(), _depth()))


def deep_rate_rules() -> list[Rule]:
    expected = F.coalesce("current_change", F.col("current_cumulative") - F.col("previous_cumulative")) / F.col("chosen_days")
    return [Rule("CAL-06", ~close_enough(F.abs(expected), F.abs("change_rate"), F.col("rate_tolerance")), F.lit("error"), expected, F.col("change_rate"))]


def first_tables(reports: DataFrame, mon_tables: DataFrame) -> DataFrame:
    """The tables of each report's first period, and whether they say so (cue)."""
    dated = mon_tables.withColumn("day", F.get(date_keys(F.col("monitor_date")), 0)).withColumn("days", date_keys(F.col("monitor_date")))
    first = dated.select("report_id", F.explode("days").alias("d")).groupBy("report_id").agg(F.min("d").alias("earliest"))
    begin = reports.select("report_id", F.get(date_keys(F.col("monitoring_period")), 0).alias("stated")).join(first, "report_id", "left").select("report_id", F.coalesce("stated", "earliest").alias("begin"))
    text = F.concat_ws("\n", "monitor_count", "monitor_date", "monitoring_item")
    return dated.join(begin, "report_id").where("day = begin").select(*TABLE, text.rlike("|".join(FIRST_CUES)).alias("cue"))


def _first_fits() -> tuple[Column, Column]:
    """Whether a row has a change and a cumulative value, and whether these agree."""
    change, cum = F.col("current_change"), F.col("cumulative_change")
    return change.isNotNull() & cum.isNotNull(), close_enough(change, cum, F.greatest(F.col("cumulative_tolerance"), F.lit(0.15), F.abs(cum) * 0.05))


def first_rules() -> list[Rule]:
    """CAL-07: of points with what is known of their table (cue, started, rows, fitting) and its tolerance."""
    both, fits = _first_fits()
    asserted = F.col("cue") | ((F.col("rows") >= 2) & (F.col("fitting") / F.col("rows") >= 0.6))
    return [Rule("CAL-07", ~F.col("started") & both & asserted & ~fits, F.lit("error"), F.col("current_change"), F.col("cumulative_change"))]


def check_first_period(reports: DataFrame, mon_tables: DataFrame, points: DataFrame, config: DataFrame) -> DataFrame:
    """CAL-07: in the first period of tables without initial values, cumulative equals change, if cues or most rows say it is the baseline."""
    rows = points.join(first_tables(reports, mon_tables), TABLE).join(config.select(*TABLE, "cumulative_tolerance"), TABLE)
    (both, fits), table = _first_fits(), Window.partitionBy(*TABLE)
    judged = rows.withColumns({"started": F.max(F.col("initial_value").isNotNull()).over(table), "rows": F.sum(both.cast("int")).over(table), "fitting": F.sum((both & fits).cast("int")).over(table)})
    return broken(judged, first_rules())


def adjacent_tables(mon_tables: DataFrame, points: DataFrame) -> DataFrame:
    """(report_id, earlier, later): neighbouring periods of the same item and borehole that are not of the same day."""
    held = mon_tables.join(points.select(*TABLE).distinct(), TABLE, "left_semi")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    order = Window.partitionBy("report_id", blank("monitoring_item"), blank("borehole_id")).orderBy(F.when(blank("monitor_date") == "", "9999").otherwise(F.col("monitor_date")), blank("monitor_count"), "table_idx")
    day = date_key(F.trim(blank("monitor_date")))
    pairs = held.select("report_id", F.col("table_idx").alias("earlier"), F.lead("table_idx").over(order).alias("later"), day.alias("day"), F.lead(day).over(order).alias("next_day"))
    return pairs.where(F.col("later").isNotNull() & ((F.col("day") == "") | (F.col("day") != F.col("next_day")))).select("report_id", "earlier", "later")


def check_continuity(mon_tables: DataFrame, points: DataFrame) -> DataFrame:
    """CAL-08: cumulative of the later period is cumulative of the earlier plus the later's change."""
    pairs = adjacent_tables(mon_tables, points)
    named = points.where("point_id <> ''").select(*TABLE, "row_no", "point_id", "current_change", "cumulative_change")
    last = named.groupBy(*TABLE, "point_id").agg(F.max_by(F.struct("current_change", "cumulative_change"), "row_no").alias("own"), F.max_by("cumulative_change", F.when(F.col("cumulative_change").isNotNull(), F.col("row_no"))).alias("before"))
    earlier = last.withColumnRenamed("table_idx", "earlier")
    met = named.withColumnRenamed("table_idx", "later").join(pairs, ["report_id", "later"]).join(earlier, ["report_id", "earlier", "point_id"])
    same = lambda a, b: F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.abs(a - b) <= 1e-6)
    copied = same(F.col("own.current_change"), F.col("current_change")) & same(F.col("own.cumulative_change"), F.col("cumulative_change"))
    pair = Window.partitionBy("report_id", "earlier", "later")
    met = met.withColumns({"copy": F.min(copied).over(pair) & (F.count("*").over(pair) >= 2)})
    change, cum, before = F.col("current_change"), F.col("cumulative_change"), F.col("before")
    tolerance = F.greatest(F.lit(0.15), F.abs(cum) * 0.05)
    usable = ~F.col("copy") & change.isNotNull() & cum.isNotNull() & before.isNotNull()
    forward, backward = close_enough(before + change, cum, tolerance), close_enough(before - change, cum, tolerance)
    return issues(met.withColumn("table_idx", F.col("later")), "CAL-08", F.when(backward, "info").otherwise("error"), F.when(backward, before - change).otherwise(before + change), cum, usable & ~forward)


def _usual() -> tuple[Column, Column]:
    """Of a table's changes with cumulative values, their number and the middle of their sizes."""
    size = F.when(F.col("current_change").isNotNull() & F.col("cumulative_change").isNotNull(), F.abs("current_change"))
    return F.count(size).alias("n"), F.percentile(size, 0.5).alias("middle")


def check_anomaly(points: DataFrame) -> DataFrame:
    """CAL-09: changes that stand out in their table or dwarf their own cumulative value."""
    return broken(points.join(points.groupBy(TABLE).agg(*_usual()), TABLE), anomaly_rules())


def anomaly_rules() -> list[Rule]:
    """CAL-09: of points with their table's n and middle."""
    size, cum = F.abs("current_change"), F.col("cumulative_change")
    outlier = (F.col("n") >= 4) & (size > 3 * F.greatest("middle", F.lit(0.5)))
    dwarfs = size > 3 * F.greatest(F.abs(cum), F.lit(0.5))
    return [Rule("CAL-09", cum.isNotNull() & (size >= 0.5) & (outlier | dwarfs), F.lit("warning"), F.col("middle"), F.col("current_change"))]


def table_facts(reports: DataFrame, mon_tables: DataFrame, points: DataFrame, deep_points: DataFrame, config: DataFrame) -> DataFrame:
    """One row per table of config with all that the rules ask of its rows; without exchanges where the tables are laid out by TABLE."""
    both, fits = _first_fits()
    held = points.join(config.select(*TABLE, "cumulative_tolerance"), TABLE).groupBy(TABLE).agg(
        *_usual(), F.count("*").alias("flat"), F.max(F.col("initial_value").isNotNull()).alias("started"), F.sum(both.cast("int")).alias("rows"), F.sum((both & fits).cast("int")).alias("fitting"),
    )
    deep = deep_points.groupBy(TABLE).agg(F.count("*").alias("deep"), F.count("change_rate").alias("printed"))
    flat_days, deep_days = choose_interval(points, config).withColumnRenamed("chosen_days", "flat_days").drop("inferred"), choose_deep_interval(deep_points, config).withColumnRenamed("chosen_days", "deep_days").drop("inferred")
    out = config.select(*TABLE, "category", *_RULE)
    for part in (held, deep, flat_days, deep_days, first_tables(reports, mon_tables)):
        out = out.join(part, TABLE, "left")
    return out


def run_calculation_checks(reports: DataFrame, mon_tables: DataFrame, points: DataFrame, deep_points: DataFrame, config: DataFrame) -> DataFrame:
    """CAL-00: force tables, tables with depths and the others each get their rules; the report-wide rules see all.

    All tables are laid out by TABLE once, with one row of facts for each table; the points and the depths are then gone over once each, by all rules that look at a row.
    """
    points, deep_points, config = (laid_out(df, TABLE) for df in (points, deep_points, config))
    mon_tables = computed_once(mon_tables)
    facts = laid_out(table_facts(reports, mon_tables, points, deep_points, config), TABLE)
    force, profile = F.col("category").isin(*FORCE), F.col("deep").isNotNull()
    only = lambda rules, where: [replace(r, broken=where & r.broken) for r in rules]
    cumulative = [replace(r, broken=r.broken & ~profile) if r.name == "CAL-02" else r for r in local_rules()]
    first, days = F.col("cue").isNotNull(), F.col("chosen_days").isNotNull()
    rows = points.join(facts.withColumn("chosen_days", F.col("flat_days")), TABLE)
    flat = broken(rows, [*cumulative, *only(rate_rules(), ~profile & ~force & days), *only(first_rules(), first), *anomaly_rules()])
    depths = deep_points.join(facts.withColumn("chosen_days", F.col("deep_days")).where(~force), TABLE)
    deep = broken(depths, [*deep_change_rules(), *only(deep_rate_rules(), (F.col("printed") > 0) & days)], _depth())
    untimed = F.array_compact(F.array(F.when(~force & ~profile & (F.col("flat") > 0) & F.col("flat_days").isNull(), "CAL-03"), F.when(~force & (F.col("printed") > 0) & F.col("deep_days").isNull(), "CAL-06")))
    none = issues(facts.withColumn("rule", F.explode(untimed)), F.col("rule"), "info", None, None, None, None, row=False)
    return together(flat, deep, none, check_continuity(mon_tables, points))
