"""Review of errors: batches out, verdicts back in; totals and conclusions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import source_from_reason


def review_batches(issues: DataFrame, order: list[str], cap: int = 24, size: int = 5, whole: int = 6) -> DataFrame:
    """VER-01: a report's first ``cap`` errors in batches of ``size``; up to ``whole`` of them are one batch."""
    by_report = Window.partitionBy("report_id")
    ranked = issues.where("severity = 'error'").withColumn("rank", F.row_number().over(by_report.orderBy(*order)) - 1).where(F.col("rank") < cap)
    ranked = ranked.withColumn("chosen", F.count("*").over(by_report))
    one = F.col("chosen") <= whole
    return ranked.withColumns({"batch_no": F.when(one, 0).otherwise(F.floor(F.col("rank") / size)).cast("int"), "error_idx": F.when(one, F.col("rank")).otherwise(F.col("rank") % size).cast("int")}).drop("rank", "chosen")


def context(batches: DataFrame, texts: DataFrame, width: int = 200, before: int = 200, after: int = 2000) -> DataFrame:
    """VER-02: the text around a table's first mention (by its name, or its name without brackets), cut to ``width``."""
    joined = batches.join(texts, "report_id")
    bare = F.regexp_replace("table_name", r"[(（].*$", "")
    at = F.instr("raw_text", F.col("table_name"))
    at = F.when(at > 0, at).when(bare != "", F.instr("raw_text", bare)).otherwise(0)
    start = F.greatest(at - before, F.lit(1))
    return joined.withColumn("context", F.when(at > 0, F.left(F.substring("raw_text", start, at - start + after), F.lit(width))).otherwise("")).drop("raw_text")


def apply_verdicts(batches: DataFrame, verdicts: DataFrame) -> DataFrame:
    """VER-03: dismissed errors become info, downgraded ones warnings, and their messages (if there are any) say why. Indexes outside a batch match nothing."""
    joined = batches.join(verdicts.select("report_id", "batch_no", "error_idx", "verdict", "reason", "suspected_origin"), ["report_id", "batch_no", "error_idx"], "left")
    origin = F.when(F.col("suspected_origin").isin("report", "extraction", "logic"), F.col("suspected_origin")).otherwise(source_from_reason(F.coalesce("reason", F.lit(""))))
    known = F.col("suspected_source") if "suspected_source" in batches.columns else F.lit("")
    severity = F.when(F.col("verdict") == "dismiss", "info").when(F.col("verdict") == "downgrade", "warning").otherwise(F.col("severity"))
    changed = {"severity": severity, "suspected_source": F.when(F.col("verdict").isNotNull() & (origin != ""), origin).otherwise(known)}
    if "message" in batches.columns:
        why = F.concat(F.when(F.col("verdict") == "dismiss", " [dismissed: ").otherwise(" [downgraded: "), F.coalesce("reason", F.lit("")), F.lit("]"))
        changed["message"] = F.when(F.col("verdict").isin("dismiss", "downgrade"), F.concat("message", why)).otherwise(F.col("message"))
    return joined.withColumns(changed).drop("suspected_origin")


def issue_totals(issues: DataFrame) -> DataFrame:
    """REP-01: per report the issues of each severity and of all (severity null)."""
    per = issues.groupBy("report_id", "severity").agg(F.count("*").alias("n"))
    return per.unionByName(per.groupBy("report_id").agg(F.sum("n").alias("n")).withColumn("severity", F.lit(None).cast("string")))


def source_totals(issues: DataFrame) -> DataFrame:
    """REP-01: per report the issues by whom they are blamed on; those without a source have the empty one."""
    return issues.groupBy("report_id", F.coalesce("suspected_source", F.lit("")).alias("suspected_source")).agg(F.count("*").alias("n"))


def conclusion(issues: DataFrame, reports: DataFrame) -> DataFrame:
    """REP-02: of every report, pass without errors and warnings, review without errors, else fail."""
    per = issues.groupBy("report_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    per = reports.select("report_id").distinct().join(per, "report_id", "left").fillna(0, ["errors", "warnings"])
    return per.withColumn("conclusion", F.when(F.col("errors") > 0, "fail").when(F.col("warnings") > 0, "review").otherwise("pass"))


def group_flags(flags: DataFrame, mon_tables: DataFrame) -> DataFrame:
    """REP-03: tables of the same name with the same flags, and the periods they cover: all of them up to two, else first and last."""
    per_table = flags.groupBy("report_id", "table_idx").agg(F.array_join(F.array_sort(F.collect_list("flag_code")), ",").alias("flag_list"))
    grouped = per_table.join(mon_tables.select("report_id", "table_idx", "monitoring_item", "monitor_date"), ["report_id", "table_idx"]).groupBy("report_id", "monitoring_item", "flag_list")
    days = F.transform(F.array_sort(F.collect_list(F.struct("table_idx", "monitor_date"))), lambda x: x["monitor_date"])
    out = grouped.agg(F.count("*").alias("tables"), days.alias("days"))
    return out.withColumn("periods", F.when(F.size("days") <= 2, F.array_join("days", ", ")).otherwise(F.concat(F.get("days", 0), F.lit(" - "), F.element_at("days", -1)))).drop("days")


def group_plans(plan: DataFrame, signature: list[str]) -> DataFrame:
    """REP-04: plans that agree in all of ``signature``, how many tables have them, and their smallest and largest tables."""
    return plan.groupBy("report_id", *signature).agg(F.count("*").alias("tables"), F.min("rows").alias("least_rows"), F.max("rows").alias("most_rows"))


def with_hint(message: Column, source: Column) -> Column:
    """REP-05: the message with its suspected source, unless it says so already."""
    hint = F.concat(F.lit("[source: "), source, F.lit("]"))
    return F.when((F.coalesce(source, F.lit("")) == "") | F.contains(message, hint), message).otherwise(F.concat_ws(" ", message, hint))


def table_list(mon_tables: DataFrame, points: DataFrame, deep_points: DataFrame) -> DataFrame:
    """REP-06: name with borehole, category, rows and date of every table."""
    rows = points.select("report_id", "table_idx").unionByName(deep_points.select("report_id", "table_idx")).groupBy("report_id", "table_idx").agg(F.count("*").alias("rows"))
    name = F.when(F.coalesce("borehole_id", F.lit("")) != "", F.concat("monitoring_item", F.lit("("), "borehole_id", F.lit(")"))).otherwise(F.col("monitoring_item"))
    return mon_tables.join(rows, ["report_id", "table_idx"], "left").select("report_id", "table_idx", name.alias("name"), "category", F.coalesce("rows", F.lit(0)).alias("rows"), "monitor_date")


def result_tables(reports: DataFrame, cells: DataFrame, mon_tables: DataFrame, points: DataFrame, deep_points: DataFrame, table_stats: DataFrame, issues: DataFrame, plan: DataFrame) -> dict[str, DataFrame]:
    """SNK-01: the nine tables of results, by their names in the order in which they are read."""
    from ..sources.landing import candidate_tables

    return {
        "00_overview": conclusion(issues, reports), "00A_candidates": candidate_tables(cells), "00B_cells": cells, "01_tables": mon_tables, "02_points": points, "03_deep_points": deep_points, "04_statistics": table_stats, "05_issues": issues, "06_plan": plan,
    }
