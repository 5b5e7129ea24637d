"""Published tables: their numbers as the SQL rounds them."""

import os

import duckdb

from plumbline.plans import reports
from plumbline.sources import landing

from .oracle import TABLES, check

SMALL = "/root/testdata/sf0.001"
# n.5 thousandths up to 70,000, the same below zero, further places, whole numbers and large ones
_ROWS = """SELECT id AS report_id, id AS table_idx, 0 AS row_no, (id + CAST(0.5 AS DOUBLE)) / CAST(1000 AS DOUBLE) AS depth, -(id + CAST(0.5 AS DOUBLE)) / CAST(1000 AS DOUBLE) AS previous_cumulative,
  (id - CAST(35000 AS DOUBLE)) / CAST(7919 AS DOUBLE) AS current_cumulative, CASE WHEN id % 3 > 0 THEN CAST(id AS DOUBLE) END AS current_change, (id + CAST(33000000.5 AS DOUBLE)) / CAST(1000 AS DOUBLE) AS change_rate FROM {0}"""


def test_numbers_between_two_thousandths(spark):
    mine = spark.sql(_ROWS.format("{ids}"), ids=spark.range(70000)).selectExpr("report_id", f"{reports._line('03_deep_points', 'STRING')} AS line")
    theirs = duckdb.sql(f"SELECT report_id, {reports._line('03_deep_points', 'VARCHAR')} AS line FROM ({_ROWS.format('(SELECT range AS id FROM range(70000))')})")
    assert {r.report_id: r.line for r in mine.collect()} == dict(theirs.fetchall())


def test_contents_with_readings_between_two_thousandths(spark, tmp_path):
    for table in TABLES:
        if table != "events":
            os.symlink(f"{SMALL}/{table}.parquet", tmp_path / f"{table}.parquet")
    # sums of a week by which settlements read 0.5005, 0.5015, ... and their neighbours above one
    events = f"SELECT 3 * i + s AS event_id, TIMESTAMP '2024-01-02 03:04:05' AS ts, 50 * i + i % 50 AS user_id, 'signup' AS event_type, CASE s WHEN 0 THEN 499.5 - i % 38 ELSE i % 4 + 0.5 END::DOUBLE AS value, '' AS props FROM range(600) a(i), range(2) b(s) WHERE s = 0 OR i % 2 = 0"
    duckdb.sql(f"COPY ({events}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    assert check(reports.QUERIES["snk_01_contents"](spark, str(tmp_path)), reports.ORACLES["snk_01_contents"], str(tmp_path)) > 600


def test_a_table_is_computed_once_to_be_published(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def told(row):
        seen.add(1)
        return row

    rows = spark.createDataFrame(spark.sparkContext.parallelize([(1, 1), (1, 2), (2, 3)], 2).map(told), "report_id int, n int")
    landing.publish({"a": rows, "b": spark.createDataFrame([(3, 1)], "report_id long, n int").where("n > 1")}, str(tmp_path))
    assert seen.value == 3 and sorted(r.report_id for r in spark.read.parquet(f"{tmp_path}/manifest").collect()) == [1, 2]
    assert sorted((r.report_id, r.n) for r in landing.published(spark, str(tmp_path), "a").collect()) == [(1, 1), (1, 2), (2, 3)]
