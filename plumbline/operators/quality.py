"""Flags on tables whose extraction looks wrong, and whom an issue is blamed on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .issues import FORCE, TABLE

NUMBERS = ["initial_value", "current_value", "cumulative_change", "current_change", "change_rate"]
TRACED = ["initial_value", "previous_value", "current_value", "current_change", "cumulative_change", "change_rate"]
TRACED_DEEP = ["depth", "previous_cumulative", "current_cumulative", "current_change", "change_rate"]


def _flag(df: DataFrame, code: str, detail: Column, where: Column) -> DataFrame:
    return df.where(where).select(*TABLE, F.lit(code).alias("flag_code"), detail.cast("string").alias("detail"))


def _filled(c: str) -> Column:
    return F.avg(F.col(c).isNotNull().cast("double"))


def flag_sparse(points: DataFrame, mon_tables: DataFrame) -> DataFrame:
    """QUA-02: required columns that are empty in more than half the rows; what is required follows from what is there. Names are sorted."""
    f = points.groupBy(TABLE).agg(*[_filled(c).alias(c) for c in NUMBERS]).join(mon_tables.select(*TABLE, "category"), TABLE)
    absolute = (F.col("initial_value") >= 0.2) | (F.col("current_value") >= 0.2)
    changing = (F.col("current_change") >= 0.2) | (F.col("change_rate") >= 0.2)
    alone = (F.col("cumulative_change") >= 0.5) & ~absolute & ~changing
    required = {"initial_value": absolute, "current_value": absolute, "cumulative_change": absolute | changing | alone, "current_change": changing, "change_rate": changing & ~F.col("category").isin(*FORCE) & (F.col("change_rate") > 0)}
    sparse = F.array_compact(F.array(*[F.when(required[c] & (F.col(c) < 0.5), c) for c in sorted(required)]))
    return _flag(f.withColumn("sparse", sparse), "QUA-02", F.array_join("sparse", ", "), F.size("sparse") > 0)


def flag_magnitude(points: DataFrame) -> DataFrame:
    """QUA-03: of the first ten rows, most have a cumulative value a hundred times off."""
    moved = F.col("current_value") - F.col("initial_value")
    rows = points.where((F.col("row_no") < 10) & (F.abs(moved) >= 1e-9) & (F.col("cumulative_change") != 0)).withColumn("ratio", F.abs(F.col("cumulative_change") / moved))
    share = rows.groupBy(TABLE).agg(F.avg(((F.col("ratio") > 100) | (F.col("ratio") < 0.01)).cast("double")).alias("share"))
    return _flag(share, "QUA-03", F.lit("magnitude"), F.col("share") >= 0.6)


def flag_deep_sparse(deep_points: DataFrame) -> DataFrame:
    """QUA-04: empty cumulative columns, or both change and rate missing."""
    f = deep_points.groupBy(TABLE).agg(*[_filled(c).alias(c) for c in ("previous_cumulative", "current_cumulative", "current_change", "change_rate")])
    sparse = F.array_compact(F.array(*[F.when(F.col(c) < 0.5, c) for c in ("current_cumulative", "previous_cumulative")], F.when((F.col("current_change") < 0.5) & (F.col("change_rate") < 0.5), "current_change and change_rate")))
    return _flag(f.withColumn("sparse", sparse), "QUA-04", F.array_join("sparse", ", "), F.size("sparse") > 0)


def flag_deep_rate(deep_points: DataFrame) -> DataFrame:
    """QUA-05: rates that are about the changes themselves."""
    rows = deep_points.where("current_change <> 0 and change_rate <> 0").withColumn("ratio", F.abs(F.col("change_rate") / F.col("current_change")))
    return _flag(rows.groupBy(TABLE).agg(F.percentile("ratio", 0.5).alias("middle")), "QUA-05", F.lit("rate"), F.col("middle").between(0.8, 1.2))


def provenance_coverage(points: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """QUA-06: per table how many printed numbers have a source column, and which fields lack one."""
    fields = TRACED if fields is None else fields
    traced = points.where((F.coalesce("source_row_text", F.lit("")) != "") | F.col("source_page").isNotNull())
    lacks = F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & ~F.coalesce(F.map_contains_key("source_field_map", c), F.lit(False)), c) for c in fields]))
    present = sum((F.col(c).isNotNull().cast("int") for c in fields), F.lit(0))
    rows = traced.select(*TABLE, lacks.alias("lacks"), present.alias("present"))
    return rows.groupBy(TABLE).agg(F.sum("present").alias("numbers"), F.sum(F.col("present") - F.size("lacks")).alias("mapped"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("lacks")))), ", ").alias("unmapped"))


def attribute(issues: DataFrame, flags: DataFrame, default: str = "report") -> DataFrame:
    """QUA-07: issues on flagged tables are blamed on extraction, others on the report; what is set stays."""
    flagged = flags.select(*TABLE).distinct().withColumn("flagged", F.lit(True))
    source = F.when(F.col("flagged"), "extraction").otherwise(default)
    own = F.when(F.col("suspected_source") != "", F.col("suspected_source")) if "suspected_source" in issues.columns else F.lit(None)
    return issues.join(flagged, TABLE, "left").withColumn("suspected_source", F.coalesce(own, source)).drop("flagged")


def diagnostics(flags: DataFrame, page_stats: DataFrame, pairs: DataFrame, findings: DataFrame) -> DataFrame:
    """QUA-08: per report how many tables are flagged, pages are mostly markup, pages repeat, and damages were found."""
    parts = [
        flags.groupBy("report_id").agg(F.countDistinct("table_idx").alias("flagged_tables")), page_stats.groupBy("report_id").agg(F.sum((F.col("markup_ratio") >= 0.9).cast("long")).alias("markup_pages")),
        pairs.groupBy("report_id").agg(F.count("*").alias("identical_pairs")), findings.groupBy("report_id").agg(F.count("*").alias("damages")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "report_id", "full")
    return out.fillna(0)
