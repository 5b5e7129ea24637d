"""Rules on small tables with known answers."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators import calc, config, hygiene, logic, quality, review, scoring, stats

POINT = "report_id long, table_idx long, row_no int, point_id string, initial_value double, current_value double, current_change double, cumulative_change double, change_rate double, safety_status string"
TABLE = "report_id long, table_idx long, monitoring_item string, category string, monitor_date string, monitor_count string, point_count int, borehole_id string, table_unit string, initial_value_reliable boolean, interval_days double"


def points(spark, rows, table=0):
    """rows: (id, initial, current, change, cumulative, rate[, status])."""
    return spark.createDataFrame([(1, table, i, r[0], *map(lambda v: None if v is None else float(v), r[1:6]), r[6] if len(r) > 6 else None) for i, r in enumerate(rows)], POINT)


def tables(spark, *rows):
    """rows: (table, item, category, date, unit, interval)."""
    return spark.createDataFrame([(1, t, item, kind, date, "", 0, "", unit, True, days) for t, item, kind, date, unit, days in rows], TABLE)


def found(df):
    return [(r.point_id, r.severity) for r in df.orderBy("table_idx", "row_no").collect()]


PLAIN = (0, "水平位移", "HORIZONTAL_DISP", "2025-05-16", "mm", None)


def test_cumulative_and_sign_find_the_one_wrong_point(spark):
    rows = [("G1", 9.63398, 9.60495, None, -29.03, None), ("G2", 9.51112, 9.52275, None, -17.45, None), ("G4", 9.90557, 9.88204, None, -23.53, None), ("G5", 10.13768, 10.11800, None, -19.68, None), ("G6", 10.0, 9.98, None, -20.0, None)]
    p = points(spark, rows)
    c = config.base_config(tables(spark, PLAIN), p)
    assert c.first().unit_conversion == 1000.0
    assert found(calc.check_cumulative(p, c)) == [("G2", "error")]
    assert found(calc.check_sign(p, c)) == [("G2", "error")]


def test_rate_with_another_interval_is_a_warning(spark):
    p = points(spark, [("A", None, None, 0.10, 1, 0.10), ("B", None, None, -0.20, 1, -0.20), ("C", None, None, 0.20, 1, 0.030)])
    c = config.base_config(tables(spark, (*PLAIN[:5], 1.0)), p)
    assert found(calc.check_rate(p, c)) == [("C", "warning")]


def test_rows_outvote_the_configured_interval(spark):
    p = points(spark, [(f"P{i}", None, None, i + 1, 1, (i + 1) / 2) for i in range(10)])
    c = config.base_config(tables(spark, (*PLAIN[:5], 7.0)), p)
    assert config.choose_interval(p, c).first().chosen_days == 2
    assert found(calc.check_rate(p, c)) == []


def test_table_without_interval_is_told_once(spark):
    p = points(spark, [("A", 1, 1, 0.5, 1, None)])
    assert found(calc.check_rate(p, config.base_config(tables(spark, PLAIN), p))) == [("ALL", "info")]


@pytest.mark.parametrize("first, second, expected", [((1.0, 0.0), (3.5, 0.5), [("L", "error")]), ((-2.99, -0.12), (-2.83, -0.16), [("L", "info")]), ((100, 0), (103, 2), [])])
def test_continuity(spark, first, second, expected):
    p = points(spark, [("L", None, None, first[1], first[0], None)], 0).unionByName(points(spark, [("L", None, None, second[1], second[0], None)], 1))
    t = tables(spark, PLAIN, (1, *PLAIN[1:3], "2025-05-18", "mm", None))
    assert found(calc.check_continuity(t, p)) == expected


def test_same_day_and_copied_periods_are_no_pairs(spark):
    rows = [("L", None, None, 1, 1, None), ("M", None, None, 2, 5, None)]
    p = points(spark, rows, 0).unionByName(points(spark, rows, 1))
    assert found(calc.check_continuity(tables(spark, PLAIN, (1, *PLAIN[1:3], "2025年5月16日 PM", "mm", None)), p)) == []
    assert found(calc.check_continuity(tables(spark, PLAIN, (1, *PLAIN[1:3], "2025-05-18", "mm", None)), p)) == []


def test_anomaly(spark):
    p = points(spark, [("M3", None, None, -0.3, 5.9, None), ("M4", None, None, -0.4, -0.9, None), ("M5", None, None, -23.9, -1.7, None), ("M8", None, None, -0.2, 2.1, None), ("M9", None, None, 0.2, 0.6, None)])
    assert found(calc.check_anomaly(p)) == [("M5", "warning")]


STAT = "report_id long, table_idx long, positive_max_id string, positive_max_value double, negative_max_id string, negative_max_value double, max_rate_id string, max_rate_value double, max_change_id string, max_change_value double, max_force_id string, max_force_value double, min_force_id string, min_force_value double"
DEEP = "report_id long, table_idx long, row_no int, depth double, previous_cumulative double, current_cumulative double, current_change double, change_rate double"


def printed(spark, **values):
    names = [c.split()[0] for c in STAT.split(", ")]
    return spark.createDataFrame([tuple({"report_id": 1, "table_idx": 0, **values}.get(n) for n in names)], STAT)


def test_hidden_rate(spark):
    p = points(spark, [("D1", None, None, None, 1, -0.019), ("D2", None, None, None, 1, -0.010), ("D5", None, None, None, 1, -0.156)])
    got = stats.check_max_rate(tables(spark, PLAIN), printed(spark, max_rate_id="D2", max_rate_value=-0.010), p, spark.createDataFrame([], DEEP))
    assert sorted((r.point_id, r.severity) for r in got.collect()) == [("D2", "info"), ("D5", "warning")]


def test_positive_only_table_may_print_its_smallest_as_negative_max(spark):
    p = points(spark, [(f"S{i}", None, None, None, v, None) for i, v in enumerate([31.21, 33.92, 42.13, 28.06, 26.5, 27.49, 7.4, 18.09, 20.73], 1)])
    got = stats.check_negative_max(tables(spark, PLAIN), printed(spark, negative_max_id="S7", negative_max_value=7.4), p, spark.createDataFrame([], DEEP))
    assert found(got) == [("S7", "info")]


def test_signed_force_extreme(spark):
    p = points(spark, [("MS5", None, 15.5, None, None, None), ("MS9", None, -20.3, None, None, None)])
    t = tables(spark, (0, "锚索拉力", "ANCHOR_FORCE", "", "kN", None))
    for value in (-20.3, 20.3):
        assert found(stats.check_max_force(t, printed(spark, max_force_value=value), p)) == []


def test_near_the_limit(spark):
    p = points(spark, [("A", None, None, None, 5.6, 0.1, "正常"), ("B", None, None, None, 7.0, 0.1, "正常"), ("C", None, None, None, 1.0, 0.1, "报警")])
    matched = spark.createDataFrame([(1, 0, 0, "x", 6.0, 10.0, 2.0)], "report_id long, table_idx long, th_no int, item_name string, warning_value double, control_value double, rate_limit double")
    assert sorted((r.point_id, r.rule_id, r.severity) for r in logic.check_status(p, matched).collect()) == [("A", "LOG-07", "warning"), ("B", "LOG-06", "error"), ("C", "LOG-06", "warning")]


def test_numbers(spark):
    cases = {"−0.5": -0.5, "１２．３": 12.3, "1,234.56": 1234.56, "23.6mm": 23.6, "累计 -23.6mm": -23.6, "1.23e-2": 0.0123, "正常": None, "--": None, "": None, "abc": None, ".5": 0.5, "x-.5e1y": -5.0, "+ 1,2345": 1234.0, "1234,567": 1234.0, "a..7": 0.7, "- \t 12,345.60E-1": -1234.56, "1.2.3": 1.2, "5e": 5.0, "3-4": 3.0}
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", text.parse_number(F.col("s")).alias("v"))
    assert {r.s: None if r.v is None else pytest.approx(r.v) for r in df.collect()} == cases


def test_damage(spark):
    pages = spark.createDataFrame([(1, 1, "0" * 300 + " x"), (1, 2, "-" * 100), (1, 3, "ab" * 120)], "report_id long, page_no long, text string")
    assert [(r.page_no, r.unit, r.times) for r in hygiene.repeat_char(pages).collect()] == [(1, "0", 300)]
    assert [(r.page_no, r.unit) for r in hygiene.repeat_unit(pages, 100).orderBy("page_no").collect()][-1] == (3, "ab")
    repeated = spark.createDataFrame([(1, 1, "\n".join(["head"] + ["same line"] * 60))], "report_id long, page_no long, text string")
    assert [(r.line_no, r.start, r.times) for r in hygiene.repeat_line(hygiene.lines(repeated)).collect()] == [(2, 5, 60)]


def test_sparse_columns(spark):
    p = points(spark, [("A", None, None, 1, 1, 1), ("B", None, None, None, 1, 1), ("C", None, None, None, 1, 1)])
    assert [r.detail for r in quality.flag_sparse(p, tables(spark, PLAIN)).collect()] == ["current_change"]


def test_batches_and_verdicts(spark):
    issues = spark.createDataFrame([(1, i, "error" if i else "info", "") for i in range(9)], "report_id long, n int, severity string, suspected_source string")
    batches = review.review_batches(issues, ["n"])
    assert [(r.batch_no, r.error_idx) for r in batches.orderBy("n").collect()] == [(0, 0), (0, 1), (0, 2), (0, 3), (0, 4), (1, 0), (1, 1), (1, 2)]
    verdicts = spark.createDataFrame([(1, 0, 1, "dismiss", "单位", ""), (1, 1, 9, "dismiss", "", "")], "report_id long, batch_no int, error_idx int, verdict string, reason string, suspected_origin string")
    assert [(r.n, r.severity, r.suspected_source) for r in review.apply_verdicts(batches, verdicts).where("severity <> 'error'").collect()] == [(2, "info", "extraction")]


def test_cell_diff(spark):
    cell = "sheet string, row long, col int, value string"
    wrong = spark.createDataFrame([("S", 1, 1, "2.50"), ("S", 2, 1, "x"), ("S", 3, 1, "1"), ("S", 5, 1, "7")], cell)
    right = spark.createDataFrame([("S", 1, 1, "2.5"), ("S", 2, 1, "3"), ("S", 3, 1, "4"), ("S", 4, 1, "y")], cell)
    assert [(r.row, r.diff_type) for r in scoring.cell_diff(wrong, right).orderBy("row").collect()] == [(2, "type"), (3, "numeric"), (4, "missing"), (5, "added")]


def test_result_does_not_depend_on_order_or_partitions(spark):
    from plumbline.sources.samples import sample

    x = sample(spark, "/root/testdata/sf0.001")
    c = config.base_config(x["mon_tables"], x["points"])
    rows = lambda p: sorted(map(str, calc.check_continuity(x["mon_tables"], p).unionByName(calc.check_rate(p, c)).collect()))
    assert rows(x["points"]) == rows(x["points"].orderBy(F.rand(3)).repartition(7))


def test_repeated_units_are_those_of_a_back_reference(spark):
    import random
    import re

    r = random.Random(5)
    rows = []
    for k in range(150):
        text = ""
        while len(text) < 120:
            unit = "".join(r.choice("ab\né😀") for _ in range(r.randrange(1, 11)))
            text += unit * r.choice([1, 2, 5, 6, 7, 9, 13]) + unit[: r.randrange(len(unit))] + r.choice(["", "x", "ab"])
        rows.append((1, k, text))
    pages = spark.createDataFrame([*rows, (1, 900, None), (1, 901, "")], "report_id long, page_no long, text string")
    for n in (6, 11):
        want = {(k, m.start(), m[1], len(m[0]) // len(m[1])) for _, k, text in rows for m in re.finditer(rf"(?s)(.{{2,10}}?)\1{{{n - 1},}}", text) if "\n" not in m[1]}
        assert {(x.page_no, x.start, x.unit, x.times) for x in hygiene.repeat_unit(pages, n).collect()} == want and len(want) > 10
    chars = {(k, m.start(), m[1], len(m[0])) for _, k, text in rows for m in re.finditer(r"(\S)\1{4,}", text)}
    assert {(x.page_no, x.start, x.unit, x.times) for x in hygiene.repeat_char(pages, 5).collect()} == chars


def test_damage_in_long_texts_is_found_in_linear_time(spark):
    import time

    took = []
    for size in (100_000, 800_000):
        df = spark.createDataFrame([(1, 1, ("abcdefghi" * 99 + "xyz") * (size // 894) + "0123" * 150)], "report_id long, page_no long, text string")
        begin = time.time()
        assert [(x.unit, x.times) for x in hygiene.repeat_unit(df, 100).collect()] == [("0123", 150)]
        took.append(time.time() - begin)
    assert took[1] < 20 * took[0] + 5


def test_findings_of_both_sources(spark):
    pages = spark.createDataFrame([(1, 1, "0" * 300), (1, 2, "ab" * 150), (2, 1, "fine")], "report_id long, page_no long, text string")
    reports = spark.createDataFrame([(1, "0" * 300 + "\n" + "ab" * 150), (2, "fine\n" * 60)], "report_id long, text string")
    found = hygiene.told_findings(hygiene.damage_findings(reports, pages))
    got = [(x.report_id, x.finding_no, x.source, x.kind, x.page_no, x.start) for x in found.orderBy("report_id", "finding_no").collect()]
    assert [g for g in got if g[3] != "unit"] == [(1, 1, "report", "char", None, 0), (1, 4, "page", "char", 1, 0), (2, 1, "report", "line", None, 0)]
    assert [(x.report_id, x.line_no, x.detail) for x in logic.check_damage(found).orderBy("report_id", "line_no").collect()][0] == (1, 0, "6 findings")
