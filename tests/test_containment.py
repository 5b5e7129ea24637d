"""Containment joins beside all pairs, and the scores and names that are matched by them."""

import random

import pytest

from plumbline.operators import containment, logic, scoring


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abé测") for _ in range(r.randrange(8)))
    return [(r.randrange(3), word() if k % 9 else None) for k in range(150)], [(r.randrange(4), word() + word() if k % 9 else None) for k in range(150)]


def test_pairs_equal_all_pairs(spark, texts):
    left, right = (spark.createDataFrame(rows, f"k int, {name} string") for rows, name in zip(texts, "ab"))
    both = {(k, a, b) for k, a in texts[0] for j, b in texts[1] if k == j and a is not None and b is not None}
    one = [tuple(r) for r in containment.holders(left, right, ["k"], "a", "b").collect()]
    assert len(one) == len(set(one)) and set(one) == {x for x in both if x[1] in x[2]}
    two = [tuple(r) for r in containment.either_holds(left, right, ["k"], "a", "b").collect()]
    assert len(two) == len(set(two)) and set(two) == {x for x in both if x[1] in x[2] or x[2] in x[1]}


def test_no_join_is_on_the_report_alone(spark, texts):
    """Each join of the plans has another key than the report, but for those of one row per report."""
    left, right = (spark.createDataFrame(rows, f"k int, {name} string") for rows, name in zip(texts, "ab"))
    plan = containment.either_holds(left, right, ["k"], "a", "b")._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and all("_gram" in line for line in joins)


def test_truth_and_issues_meet_as_all_pairs_do(spark):
    r = random.Random(8)
    point = lambda: r.choice(["P1", "P12", "P1-2", "", "Q", "测点3"]) + r.choice(["", "(位移)", "（x）", " "])
    truth = [(r.randrange(4), i, point(), r.choice(["累计", "速率"]), r.choice(["-12.50", "3.10", None]), None, f"T{r.randrange(14)}") for i in range(60)]
    issues = [(r.randrange(4), i, point(), r.choice(["累计变化", "其他"]), r.choice(["12.5 mm", "3.1", ""]), f"T{r.randrange(14)}") for i in range(60)]
    t = spark.createDataFrame(truth, "report_id int, truth_no int, point_id string, keyword string, error_value string, correct_value string, table_name string")
    s = spark.createDataFrame(issues, "report_id int, issue_no int, point_id string, field_name string, message string, table_name string")
    bare = lambda p: p.split("(")[0].split("（")[0].strip()
    shown = lambda v: v is not None and v.replace("-", "").replace(".", "").rstrip("0").__len__() >= 3 and v.lstrip("-").rstrip("0")
    want = {}
    for k, i, p, word, error, _, _ in truth:
        for j, n, q, field, said, _ in issues:
            if j == k and bare(p) and (bare(p) in q or bare(q) == bare(p)) and (word in field + said or (shown(error) and shown(error) in field + said)):
                want.setdefault((k, i), n)
    assert {(x.report_id, x.truth_no): x.issue_no for x in scoring.hits(t, s).collect()} == want and want
    near = lambda a, b: a in b or b in a
    pairs = [(x[0], x[1], y[1]) for x in truth for y in issues if x[0] == y[0] and near(x[2], y[2]) and near(x[6], y[5])]
    got = {x.report_id: (x.truths, x.reported, x.hits) for x in scoring.fuzzy_match(t, s).collect()}
    assert got == {k: (sum(x[0] == k for x in truth), sum(x[0] == k for x in issues), len({i for j, i, _ in pairs if j == k})) for k in range(4)}
    extra = {x.issue_no for x in scoring.extra_errors(t, s).collect()}
    assert extra == {y[1] for y in issues if not any(x[0] == y[0] and bare(x[2]) and bare(x[2]) in y[2] for x in truth)}


def test_names_meet_as_all_pairs_do(spark):
    names = ["坡顶水平位移", "水平位移", "地下水位", "水位变化", "桥面裂缝", "裂缝", "支撑轴力", "x", "", None]
    tables = [(r, i, n) for r in range(2) for i, n in enumerate(names) if (r + i) % 3]
    limits = [(r, i, n, 1.0, 2.0, 3.0) for r in range(2) for i, n in enumerate(reversed(names)) if (r + i) % 4]
    group = lambda n: next((k for k, words in enumerate(logic.NAME_GROUPS) if any(w in n for w in words)), None)
    alike = lambda a, b: a is not None and b is not None and ((group(a) is not None and group(a) == group(b)) or a in b or b in a)
    t = spark.createDataFrame(tables, "report_id int, table_idx int, monitoring_item string").selectExpr("*", "'X' AS category")
    th = spark.createDataFrame(limits, "report_id int, th_no int, item_name string, warning_value double, control_value double, rate_limit double")
    got = {(x.report_id, x.table_idx): x.th_no for x in logic.match_thresholds(th, t).collect()}
    assert got == {(r, i): min(j for q, j, m, *_ in limits if q == r and alike(n, m)) for r, i, n in tables if any(q == r and alike(n, m) for q, _, m, *_ in limits)}
    items = th.selectExpr("report_id", "th_no AS si_no", "item_name AS monitoring_item")
    grouped = lambda a, b: a is not None and b is not None and group(a) is not None and group(a) == group(b)
    want = set()
    for r, j, m, *_ in limits:
        own = [(r, j, i) for q, i, n in tables if q == r and grouped(n, m)]
        want |= set(own or [(r, j, i) for q, i, n in tables if q == r and alike(n, m)])
    assert {tuple(x)[:3] for x in logic.match_summary(items, t).collect()} == want
