"""How each table is to be verified: unit, conversion, tolerances, severity, survey interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .issues import FORCE, TABLE

CUMULATIVE_TOLERANCE, RATE_TOLERANCE = 0.15, 0.05
ELEVATION = ("VERTICAL_DISP", "SETTLEMENT")


def looks(points: DataFrame) -> DataFrame:
    """Per table, in one pass: ``elevation``, whether one of its first five rows reads like metres with a change in millimetres; and ``ratio``, the upper median of
    cumulative over current - initial, if it is near 1000 or 1 (of five usable rows at least)."""
    diff = F.col("current_value") - F.col("initial_value")
    usable = (F.abs(diff) >= 1e-5) & (F.abs(F.col("cumulative_change")) >= 0.05)
    metres = (F.abs("initial_value") < 100) & (F.abs("current_value") < 100) & (F.abs("cumulative_change") > 1)
    rows = points.select(*TABLE, F.when(usable, F.col("cumulative_change") / diff).alias("ratio"), F.when(F.col("row_no") < 5, metres).alias("metres"))
    middle = F.when(F.count("ratio") >= 5, F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY ratio DESC)"))
    per_table = rows.groupBy(TABLE).agg(F.coalesce(F.bool_or("metres"), F.lit(False)).alias("elevation"), F.count("ratio").alias("usable"), middle.alias("middle"))
    return per_table.withColumn("ratio", F.when(F.col("middle").between(950, 1050), 1000.0).when(F.col("middle").between(0.95, 1.05), 1.0)).drop("middle")


def mixed_unit_ratio(points: DataFrame) -> DataFrame:
    """CFG-02: per table of five usable rows and more, what its cumulative values are multiples of."""
    return looks(points).where("usable >= 5").select(*TABLE, "ratio")


def looks_like_elevation(points: DataFrame) -> DataFrame:
    """CFG-03: whether each table reads like elevations, by its first five rows."""
    return looks(points.where(F.col("row_no") < 5)).select(*TABLE, "elevation")


def base_config(mon_tables: DataFrame, points: DataFrame) -> DataFrame:
    """One row per table from its unit and category, corrected by what its rows look like."""
    joined = mon_tables.join(looks(points), TABLE, "left")
    kind, unit = F.col("category"), F.coalesce(F.col("table_unit"), F.lit(""))
    elevated = kind.isin(*ELEVATION) & (unit != "m") & F.coalesce("elevation", F.lit(False))
    metres, water, force = (unit == "m") | elevated, kind == "WATER_LEVEL", kind.isin(*FORCE)
    plain = ~water & ~force & ~kind.isin(*ELEVATION)
    conversion = F.when(force, 1.0).when(metres, 1000.0).when(plain & (F.col("ratio") == 1000.0), 1000.0).otherwise(1.0)
    return joined.select(
        *TABLE, "category", F.when(force, "kN").when(elevated, "m").otherwise(unit).alias("unit"), conversion.alias("unit_conversion"),
        F.when(water, 10.0).when(metres, 1.0).otherwise(CUMULATIVE_TOLERANCE).alias("cumulative_tolerance"), F.lit(RATE_TOLERANCE).alias("rate_tolerance"),
        F.col("interval_days").cast("double").alias("interval_days"), F.when(water | metres, False).otherwise(F.coalesce("initial_value_reliable", F.lit(True))).alias("initial_value_reliable"),
        F.when(force, "error").when(water | metres, "warning").otherwise("error").alias("severity_for_cumulative"),
    )


def _intervals(points: DataFrame) -> DataFrame:
    """The interval in days that each row implies."""
    own = F.abs(F.col("current_change") / F.col("change_rate"))
    rows = points.where(F.abs("change_rate") > 1e-6).withColumn("days", own)
    return rows.where((F.col("days") > 0.5) & (F.col("days") < 365)).select(*TABLE, "row_no", "days")


def deep_intervals(deep_points: DataFrame) -> DataFrame:
    """The same of profiles, in whole days; rows without a change use the difference of the cumulative values."""
    moved = F.coalesce(F.abs("current_change"), F.abs(F.col("current_cumulative") - F.col("previous_cumulative")))
    rows = deep_points.where((F.abs("change_rate") > 1e-6) & (moved > 1e-6)).withColumn("days", moved / F.abs("change_rate"))
    return rows.where((F.col("days") > 0.5) & (F.col("days") < 365)).select(*TABLE, "row_no", F.rint("days").alias("days"))


def infer_interval(points: DataFrame, implied: DataFrame | None = None) -> DataFrame:
    """Per table the most frequent implied interval in whole days; of equal counts the one seen first."""
    implied = _intervals(points) if implied is None else implied
    counted = implied.groupBy(*TABLE, F.rint("days").alias("days")).agg(F.count("*").alias("n"), F.min("row_no").alias("seen"))
    return counted.groupBy(TABLE).agg(F.max(F.struct("n", -F.col("seen"), "days")).getField("days").alias("inferred"))


def interval_support(implied: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per table and candidate ``days_candidate`` the share of rows whose implied interval is near it."""
    return implied.join(candidates, TABLE).groupBy(*TABLE, "days_candidate").agg(_support(F.col("days"), F.col("days_candidate")).alias("support"))


def _support(days: Column, candidate: Column) -> Column:
    """Share of rows whose implied interval is near a candidate."""
    return F.avg((F.abs(days - candidate) <= F.greatest(F.lit(0.5), candidate * 0.2)).cast("double"))


def choose_interval(points: DataFrame, config: DataFrame, implied: DataFrame | None = None) -> DataFrame:
    """Per table of config the interval to verify rates with: configured or inferred, whichever the rows support."""
    implied = _intervals(points) if implied is None else implied
    known = config.select(*TABLE, F.col("interval_days").alias("configured")).join(infer_interval(points, implied), TABLE, "left")
    support = implied.join(known.where("configured is not null and inferred is not null"), TABLE).groupBy(TABLE).agg(_support(F.col("days"), F.col("configured")).alias("for_configured"), _support(F.col("days"), F.col("inferred")).alias("for_inferred"))
    configured, inferred = F.col("configured"), F.col("inferred")
    chosen = F.when(inferred.isNull(), configured).when(configured.isNull() | (F.abs(inferred - configured) <= 2), inferred)
    chosen = chosen.when((F.col("for_inferred") >= 0.5) & (F.col("for_inferred") > F.when(configured > 0, F.col("for_configured")).otherwise(0.0)), inferred).otherwise(configured)
    return known.join(support, TABLE, "left").select(*TABLE, chosen.alias("chosen_days"), "inferred")


def choose_deep_interval(deep_points: DataFrame, config: DataFrame) -> DataFrame:
    return choose_interval(deep_points, config, deep_intervals(deep_points))


def needs_review(points: DataFrame, config: DataFrame) -> DataFrame:
    """Reliable tables without conversion whose first row is off by a factor of a hundred and more."""
    first = points.where((F.col("initial_value").isNotNull()) & F.col("current_value").isNotNull() & F.col("cumulative_change").isNotNull())
    first = first.groupBy(TABLE).agg(F.min_by(F.struct("initial_value", "current_value", "cumulative_change"), "row_no").alias("x"))
    expected = F.col("x.current_value") - F.col("x.initial_value")
    ratio = F.when(F.col("x.cumulative_change") == 0, 0.0).otherwise(F.abs(expected / F.col("x.cumulative_change")))
    held = config.where("unit_conversion <> 1000 and initial_value_reliable").join(first, TABLE)
    return held.where((ratio < 0.01) | (ratio > 100)).select(*TABLE, ratio.alias("ratio"))


def apply_suggestions(config: DataFrame, suggestions: DataFrame) -> DataFrame:
    """config after a reviewer's suggestions (unit, reliable, severity). What was recognised as metres is neither taken for mm nor raised to error."""
    new = suggestions.select(*TABLE, F.col("unit").alias("new_unit"), F.col("reliable").alias("new_reliable"), F.when(F.lower("severity").isin("error", "warning", "info"), F.lower("severity")).alias("new_severity"))
    joined = config.join(new, TABLE, "left")
    elevated = F.col("unit") == "m"
    unit = F.when(elevated & (F.col("new_unit") == "mm"), F.col("unit")).otherwise(F.coalesce("new_unit", "unit"))
    return joined.withColumns({
        "unit_conversion": F.when(unit == "m", 1000.0).when((F.col("new_unit") == "mm") & ~elevated, 1.0).otherwise(F.col("unit_conversion")),
        "initial_value_reliable": F.coalesce("new_reliable", "initial_value_reliable"),
        "severity_for_cumulative": F.when(elevated & (F.col("new_severity") == "error"), F.col("severity_for_cumulative")).otherwise(F.coalesce("new_severity", "severity_for_cumulative")),
    }).withColumn("unit", unit).select(config.columns)

