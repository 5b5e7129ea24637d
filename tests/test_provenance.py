"""Where printed numbers come from, and chunks under titles, on texts made by hand."""

from pyspark.sql import functions as F

from plumbline.operators import chunking, provenance

NUMBERS = "initial_value double, current_value double, current_change double, cumulative_change double, change_rate double"


def _traced(spark, text, *points):
    lines = spark.createDataFrame([(1, 0, i, x) for i, x in enumerate(text.split("\n"))], "report_id long, chunk_no long, line_no long, text string")
    rows = spark.createDataFrame([(1, 0, 0, i, *p) for i, p in enumerate(points)], f"report_id long, table_idx long, chunk_no long, row_no int, point_id string, monitor_date string, {NUMBERS}")
    return {r.row_no: r for r in provenance.trace(rows, lines).collect()}


def test_rows_under_their_dates_and_narrow_headers(spark):
    text = "--- 第 3 页 / 共 9 页 ---\n2024/1/5\n测点编号\n安全状态\n初始值 本次值 本次变化 累计变化 速率\nA-1 10.0 12.5 1 2.5 0.1 正常\n--- 第 4 页 ---\n2024-1-12\n初始值 本次值 本次变化 累计变化 速率\nA-1 10.0 12.5 1 2.5 0.1 正常\nA-12 7 7 7 7 7 正常"
    got = _traced(spark, text, ("a-1", "2024.01.12", 10.0, 12.5, 1.0, 2.5, 0.1), ("A-1", "2024-01-05", 10.0, 12.5, 1.0, 2.5, 9.9), ("A", "", 1.0, None, None, None, None), ("A-12", "", None, 7.0, None, None, None))
    assert (got[0].source_line, got[0].source_page) == (9, 4) and got[0].source_field_map == {"initial_value": 2, "current_value": 3, "current_change": 4, "cumulative_change": 5, "change_rate": 6}
    assert (got[1].source_line, got[1].source_page) == (5, 3) and "change_rate" not in got[1].source_field_map
    assert got[2].source_line is None and got[3].source_field_map == {"current_value": 3}


def test_ids_of_other_characters_and_ambiguous_cells(spark):
    text = "| 测点(1)-B | 5 | 5 | 6 |\nX 测点(1)-B2 6"
    got = _traced(spark, text, ("测点(1)-b", "", 5.0, 6.0, None, None, None), ("1)-B2", "", 6.0, None, None, None, None))
    assert got[0].source_line == 0 and got[0].source_field_map == {"current_value": 4}
    assert got[1].source_line == 1 and got[1].source_field_map == {"initial_value": 3}


def test_wide_rows_of_two_axes(spark):
    text = "2024-01-05 2024-01-12\nX Y\n本次 累计 速率 本次 累计 速率\nP1 X 0.5 1 2 3 4 5 6"
    got = _traced(spark, text, ("P1", "2024-01-12", None, None, 4.0, 5.0, 6.0))
    assert got[0].source_field_map == {"current_change": 7, "cumulative_change": 8, "change_rate": 9}


def test_numbers_as_they_may_be_printed(spark):
    row = spark.range(1).select(*[provenance.value_tokens(F.lit(v)).alias(f"v{i}") for i, v in enumerate((12.0, 0.125, -1234.5678, 0.0))]).first()
    assert {"12", "12.0", "12.00"} <= set(row.v0) and {"0.125", "0.1"} <= set(row.v1) and {"-1234.57", "-1234.6"} <= set(row.v2) and "0" in row.v3


def test_sections_of_a_family_stay_together(spark):
    text = "序\n附表 1-2-1 沉降观测结果表\nab\n附表 1 - 2 - 2 水平位移成果表\ncd\n【地下水位】第二期监测成果\nef\n"
    cut = lambda t, **k: [r.text for r in chunking.chunks(spark.createDataFrame([(1, t)], "report_id long, raw_text string"), **k).orderBy("chunk_no").collect()]
    assert cut(text) == ["序\n", text[2 : text.index("【")], text[text.index("【") :]]
    assert len(cut(text, group_chars=30)) == 4 and "".join(cut(text, group_chars=30)) == text
    paged = "--- 第 1 页 ---\n附表 1-2-1 沉降观测结果表\nab\n--- 第 2 页 ---\n附表 1-2-2 沉降观测结果表\ncd\n"
    assert cut(paged) == ["--- 第 1 页 ---\n", "--- 第 1 页 ---\n附表 1-2-1 沉降观测结果表\nab\n", "--- 第 2 页 ---\n附表 1-2-2 沉降观测结果表\ncd\n"]
    assert cut("附表 1-2-1 沉降观测结果表\nab") == ["附表 1-2-1 沉降观测结果表\nab"]


def test_words_of_headers_are_looked_for_once_a_cell(spark):
    df = spark.createDataFrame([(["点号", "初始值", "本次 变化量", "累计变化", "初始值 2", "速率"],), (["a", "1"],), ([],)], "cells array<string>")
    named = df.select(provenance.header_columns(F.col("cells")).alias("x"))
    assert [r.x for r in named.collect()] == [{"initial_value": 2, "current_change": 3, "cumulative_change": 4, "change_rate": 6}, {}, {}]
    assert named._jdf.queryExecution().optimizedPlan().toString().count("上次累计") <= 2


def test_what_lies_above_is_found_without_going_over_a_frame_per_line(spark):
    lines = [(1, 0, k, t) for k, t in enumerate(["2024/01/02", *["x"] * (provenance.SCAN + 2)])]
    read = provenance.read_lines(spark.createDataFrame(lines, "report_id long, chunk_no long, line_no long, text string"))
    assert [r.line_no for r in read.where("near_dates is not null").orderBy("line_no").collect()] == list(range(1, provenance.SCAN + 1))
    assert f"-{provenance.SCAN}" not in read._jdf.queryExecution().optimizedPlan().toString()
