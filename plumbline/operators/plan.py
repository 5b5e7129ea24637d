"""The analysis plan: what each table holds and how it will be verified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .config import CUMULATIVE_TOLERANCE, choose_deep_interval, choose_interval
from .issues import FORCE, TABLE

SHOWN = ["initial_value", "current_value", "current_change", "cumulative_change", "change_rate"]


def analysis_plan(points: DataFrame, config: DataFrame) -> DataFrame:
    """CFG-10: per table with rows its filled columns (by the first row), a sample of two ids, unit, interval and where it is from, and the rules that apply."""
    first = F.min_by(F.struct(*[F.col(c).isNotNull().alias(c) for c in SHOWN]), "row_no")
    sample = F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("row_no") < 2, F.struct("row_no", "point_id")))), 1, 2), lambda x: x["point_id"]), ", ")
    held = points.groupBy(TABLE).agg(F.count("*").alias("rows"), first.alias("has"), sample.alias("sample"))
    has = lambda c: F.col(f"has.{c}")
    force = F.col("category").isin(*FORCE)
    three = has("initial_value") & has("current_value") & has("cumulative_change")
    rules = F.array_compact(F.array(
        F.when(three & F.col("initial_value_reliable"), F.when(force, "CAL-01").otherwise("CAL-02")), F.when(~force & has("current_change") & has("change_rate"), "CAL-03"), F.when(three, "CAL-10"),
    ))
    joined = config.join(held, TABLE).join(choose_interval(points, config), TABLE)
    source = F.when(F.col("chosen_days").isNull(), "none").when(F.col("chosen_days") == F.col("inferred"), "inferred").otherwise("configured")
    return joined.select(
        *TABLE, "category", "unit", F.array_join(F.array_compact(F.array(*[F.when(has(c), c) for c in SHOWN])), ", ").alias("filled"), "sample", "rows", F.col("chosen_days").alias("interval_days"), source.alias("interval_source"),
        F.when(F.col("initial_value_reliable"), "reliable").when(F.col("unit") == "m", "metres").otherwise("water level").alias("reliability"), F.array_join(rules, ", ").alias("rules"),
    )


#: what makes two plans one: all that is said of a table but its rows and samples
SIGNATURE = ["table_name", "category", "unit", "unit_conversion", "conversion_note", "initial_reliable", "reliability_reason", "interval_days", "interval_source", "methods", "special_notes"]
MIXED = ("HORIZONTAL_DISP", "DEEP_HORIZONTAL", "PILE_INCLINE", "OTHER")


def _method(name: str, formula: Column | str, tolerance: Column, severity: Column | str) -> Column:
    text = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(name).alias("name"), text(formula).alias("formula"), tolerance.alias("tolerance"), text(severity).alias("severity"))


def verification_plan(mon_tables: DataFrame, points: DataFrame, deep_points: DataFrame, config: DataFrame) -> DataFrame:
    """How each table is verified: SIGNATURE and its number of rows. ``methods`` are structs (name, formula, tolerance, severity) in the order in which they are applied.

    Here the configured interval comes before the inferred one, unless the rows support that one only (which is noted).
    """
    flat = points.groupBy(TABLE).agg(F.count("*").alias("flat"))
    deep = deep_points.groupBy(TABLE).agg(F.count("*").alias("deep"), F.count("current_change").alias("changes"), F.count("change_rate").alias("rates"))
    days = choose_interval(points, config).unionByName(choose_deep_interval(deep_points, config)).groupBy(TABLE).agg(F.max_by("chosen_days", F.col("inferred").isNotNull()).alias("chosen"), F.max("inferred").alias("inferred"))
    rows = config.join(mon_tables.select(*TABLE, F.coalesce("monitoring_item", F.lit("")).alias("table_name")), TABLE).join(flat, TABLE, "left").join(deep, TABLE, "left").join(days, TABLE, "left")
    kind, unit, reliable = F.col("category"), F.col("unit"), F.col("initial_value_reliable")
    force, water, is_deep = kind.isin(*FORCE), kind == "WATER_LEVEL", F.col("deep").isNotNull()
    height = (unit == "m") | kind.isin("VERTICAL_DISP", "SETTLEMENT")
    configured, inferred = F.col("interval_days"), F.col("inferred")
    overruled = F.coalesce((F.abs(inferred - configured) > 2) & (F.col("chosen") == inferred), F.lit(False))
    used = F.when(configured.isNull() | overruled, inferred).otherwise(configured)
    source = F.when(configured.isNotNull(), "configured").when(inferred.isNotNull(), "inferred").otherwise("none")
    per_day = F.concat(F.lit("change / "), F.coalesce(F.rint(used).cast("int").cast("string"), F.lit("?")), F.lit(" days"))
    said = lambda c, u: F.concat(F.col(c).cast("string"), F.lit(u))
    scaled = F.concat(F.lit("current - initial"), F.when(F.col("unit_conversion") != 1, F.concat(F.lit(" times "), F.col("unit_conversion").cast("int").cast("string"))).otherwise(""))
    printed = F.when(is_deep & (F.col("changes") > 0) & (F.col("rates") > 0), "extremes, widest change, fastest rate").when(is_deep & (F.col("changes") > 0), "extremes, widest change").when(~is_deep & force, "largest and smallest force").otherwise("extremes, fastest rate")
    methods = F.array_compact(F.array(
        F.when(force, _method("cumulative force", "current - initial", said("cumulative_tolerance", " kN"), "error")),
        F.when(~force & is_deep & (F.col("changes") > 0), _method("change of depth", "current - previous cumulative", F.lit(f"{CUMULATIVE_TOLERANCE} mm"), "error")),
        F.when(~force & is_deep & (F.col("rates") > 0), _method("rate of depth", per_day, said("rate_tolerance", " mm/d"), "error")),
        F.when(~force & ~is_deep, _method("cumulative change", scaled, said("cumulative_tolerance", " mm"), F.col("severity_for_cumulative"))),
        F.when(~force & ~is_deep, _method("rate", per_day, said("rate_tolerance", " mm/d"), "error")),
        _method("statistics", printed, F.lit(str(CUMULATIVE_TOLERANCE)), "error"),
    ))
    number = lambda c: F.rint(c).cast("int").cast("string")
    notes = F.array_compact(F.array(
        F.when(is_deep, "ids are not looked up in other tables"), F.when(is_deep, "rates are compared without signs"), F.when((unit == "m") & ~reliable, "differences of heights are warnings"),
        F.when(water, F.concat(F.lit("tolerance of "), said("cumulative_tolerance", " mm"))), F.when(source == "inferred", "interval from the rows"),
        F.when((F.col("unit_conversion") == 1000) & kind.isin(*MIXED), "readings in m, changes in mm"), F.when(overruled, F.concat(F.lit("interval "), number(configured), F.lit(" overruled by "), number(inferred))),
    ))
    return rows.select(
        *TABLE, "table_name", "category", "unit", "unit_conversion", F.when((unit == "m") & (F.col("unit_conversion") == 1000), "heights in m").when(unit == "kN", "forces in kN").otherwise("none").alias("conversion_note"), reliable.alias("initial_reliable"),
        F.when(force, "initial forces hold").when(height & ~reliable, "heights may have another origin").when(~height & water, "levels may have another origin").when(~reliable, "another origin").otherwise("initial values hold").alias("reliability_reason"),
        used.alias("interval_days"), source.alias("interval_source"), methods.alias("methods"), notes.alias("special_notes"), F.coalesce("flat", "deep", F.lit(0)).alias("rows"),
    )
