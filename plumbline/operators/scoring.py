"""Accuracy: what differs between two versions of a workbook, and which differences the issues hit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .containment import either_holds, holders
from .store import computed_once

CELL = ["sheet", "row", "col"]


def normalized(value: Column) -> Column:
    """Blank as null, numbers to six places, other texts trimmed."""
    text = F.trim(value)
    number = text.try_cast("double")
    return F.when(text == "", None).when(number.isNotNull(), F.round(number, 6).cast("string")).otherwise(text)


def cell_diff(wrong: DataFrame, right: DataFrame) -> DataFrame:
    """EVA-01: cells of two versions that differ, and how: added, missing, numeric (with delta), text or type."""
    a, b = (df.select(*CELL, F.col("value").alias(v), normalized(F.col("value")).alias(f"{v}_norm")) for df, v in ((wrong, "error_value"), (right, "correct_value")))
    x, y = F.col("error_value_norm"), F.col("correct_value_norm")
    nx, ny = x.try_cast("double"), y.try_cast("double")
    kind = F.when(y.isNull(), "added").when(x.isNull(), "missing").when(nx.isNotNull() & ny.isNotNull(), "numeric").when(nx.isNull() & ny.isNull(), "text").otherwise("type")
    return a.join(b, CELL, "full").where(~x.eqNullSafe(y)).select(*CELL, "error_value", "correct_value", kind.alias("diff_type"), (nx - ny).alias("delta"), F.when(ny != 0, (nx - ny) / F.abs(ny)).alias("relative"))


def _bare(point: Column) -> Column:
    return F.trim(F.regexp_extract(point, r"^([^(（]*)", 1))


def hits(truth: DataFrame, issues: DataFrame, key: str = "report_id") -> DataFrame:
    """Truth cells with the first issue that hits them: its point holds the cell's, and it says the field's keyword or the cell's value.

    An issue's point without what stands in brackets is a part of it, so that being equal to the cell's is a case of holding it.
    """
    left = computed_once(truth.select(key, "truth_no", "keyword", "error_value", "correct_value", _bare(F.col("point_id")).alias("truth_point")))
    said = computed_once(issues.select(key, F.col("point_id").alias("issue_point"), "issue_no", F.concat_ws("", "field_name", "message").alias("said")))
    digits = lambda v: F.length(F.rtrim(F.replace(F.replace(v, F.lit("-"), F.lit("")), F.lit("."), F.lit("")), F.lit("0"))) >= 3
    shown = lambda v: F.when(digits(v), F.contains(F.col("said"), F.regexp_replace(F.regexp_replace(v, "^-", ""), r"(\.\d*?)0+$", "$1"))).otherwise(False)
    same = holders(left.where("truth_point <> ''"), said, [key], "truth_point", "issue_point")
    speaks = F.contains(F.col("said"), F.col("keyword")) | F.coalesce(shown(F.col("error_value")), F.lit(False)) | F.coalesce(shown(F.col("correct_value")), F.lit(False))
    met = left.join(same, [key, "truth_point"]).join(said, [key, "issue_point"]).where(speaks)
    first = F.row_number().over(Window.partitionBy(key, "truth_no").orderBy("issue_no"))
    return met.withColumn("first", first).where("first = 1").select(key, "truth_no", "issue_no")


def recall(truth: DataFrame, issues: DataFrame, key: str = "report_id") -> DataFrame:
    """EVA-02: per template the cells known to be wrong, those that some issue hits, and their share."""
    hit = hits(truth, issues, key).select(key, "truth_no").withColumn("hit", F.lit(1))
    return truth.join(hit, [key, "truth_no"], "left").groupBy(key).agg(F.count("*").alias("truths"), F.count("hit").alias("hits")).withColumn("recall", F.col("hits") / F.col("truths"))


def fuzzy_match(truth: DataFrame, issues: DataFrame, key: str = "report_id") -> DataFrame:
    """EVA-03: recall and precision when names and points need only contain each other."""
    known = computed_once(truth.select(key, "truth_no", F.col("point_id").alias("p"), F.col("table_name").alias("t")))
    told = computed_once(issues.select(key, "issue_no", F.col("point_id").alias("q"), F.col("table_name").alias("u")))
    near = known.select(key, "p", "t").distinct().join(either_holds(known, told, [key], "p", "q"), [key, "p"]).join(either_holds(known, told, [key], "t", "u"), [key, "t"])
    near = computed_once(near.join(told.select(key, "q", "u").distinct(), [key, "q", "u"]))
    hit = known.join(near.select(key, "p", "t").distinct(), [key, "p", "t"]).groupBy(key).agg(F.countDistinct("truth_no").alias("hits"))
    right = told.join(near.select(key, "q", "u").distinct(), [key, "q", "u"]).groupBy(key).agg(F.countDistinct("issue_no").alias("right"))
    found = hit.join(right, key)
    sizes = known.groupBy(key).agg(F.count("*").alias("truths")).join(told.groupBy(key).agg(F.count("*").alias("reported")), key, "full").join(found, key, "left").fillna(0)
    return sizes.select(key, "truths", "reported", "hits", F.try_divide("hits", "truths").alias("recall"), F.try_divide("right", "reported").alias("precision"))


def extra_errors(truth: DataFrame, issues: DataFrame, key: str = "report_id") -> DataFrame:
    """EVA-04: errors that are about no truth cell's point."""
    known = truth.select(F.col(key), _bare(F.col("point_id")).alias("known")).where("known <> ''")
    issues = computed_once(issues)
    met = holders(known, issues, [key], "known", "point_id").select(key, "point_id").distinct()
    return issues.join(met, [key, "point_id"], "left_anti").select(issues.columns)
