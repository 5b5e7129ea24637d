"""Damage in page texts: what is found, and in how many passes."""

import random
import re

import pytest

from plumbline.operators import hygiene, logic
from plumbline.plans import texts


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _units(text: str, n: int) -> list[tuple[int, str, int]]:
    """Every place and size by hand: the stretch that began first, of equal ones the shortest unit, from where the one before has ended."""
    found = []
    for size in range(2, 11):
        i = size
        while i < len(text):
            j = i
            while j < len(text) and text[j] == text[j - size]:
                j += 1
            if j - i >= (n - 1) * size:
                found.append((i - size, size, j))
            i = j + 1
    at, out = 0, []
    for start, size, stop in sorted(found):
        start = max(start, at)
        times = max(stop - start, 0) // size
        if times >= n:
            at = start + times * size
            out.append((start, text[start : start + size], times))
    return [x for x in out if "\n" not in x[1]]


def test_runs_are_those_of_a_plain_loop(spark):
    draw = random.Random(3)
    made = ["", "a", "aaa", "x\n\n\n\ny", "😀😀😀😀b😀b😀b😀", None] + ["".join(draw.choice(["ab", "a", "c\n", "é", " ", "😀"]) * draw.randint(1, 4) for _ in range(draw.randint(1, 60))) for _ in range(200)]
    pages = spark.createDataFrame([(k // 7, k, t) for k, t in enumerate(made)], "report_id long, page_no long, text string")
    got = {}
    for r in hygiene.repeat_unit(pages, 3).orderBy("page_no", "finding_no").collect():
        got.setdefault(r.page_no, []).append((r.start, r.unit, r.times))
    assert got == {k: x for k, t in enumerate(made) if t and (x := _units(t, 3))}
    chars = {(r.page_no, r.start, r.unit, r.times) for r in hygiene.repeat_char(pages, 3).collect()}
    assert chars == {(k, m.start(), m[1], len(m[0])) for k, t in enumerate(made) if t for m in re.finditer(r"([^ \t\n\x0b\f\r])\1{2,}", t)}


@pytest.mark.parametrize("name", ["doc_10_repeat_char", "doc_11_repeat_unit"])
def test_runs_take_no_function_per_character(spark, name):
    assert "lambda" not in _plan(texts.QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_lines_of_damage_are_those_of_the_line_table(spark):
    made = ["a line\n a line\t\nb\n\n\n", "xyz\r\nxyz\nxyz", "ab\nab", "one", "\nabc\nabc\nq\nabc\nabc"]
    pages = spark.createDataFrame([(1, k, t) for k, t in enumerate(made)], "report_id long, page_no long, text string")
    alone = {(r.page_no, r.start, r.unit, r.times) for r in hygiene.repeat_line(hygiene.lines(pages), 2).collect()}
    found = hygiene.damage_findings(pages.where("page_no < 0"), pages, 50, 50, 2)
    assert len(alone) == 4 and {(r.page_no, r.start, r.unit, r.times) for r in found.where("kind = 'line'").collect()} == alone


@pytest.mark.parametrize("name", ["doc_13_findings", "log_01_found_damage"])
def test_damage_goes_over_the_documents_once_as_pages_and_once_as_reports(spark, name):
    assert _plan(texts.QUERIES[name](spark, "/root/testdata/sf0.001")).count("FileScan parquet") == 2


def test_head_of_damage_stays_without_findings_shown(spark):
    findings = spark.createDataFrame([(1, 4, "x"), (1, 2, "y"), (2, 1, "z")], "report_id long, finding_no int, detail string")
    said = lambda most: sorted((r.report_id, r.line_no, r.detail) for r in logic.check_damage(findings, most).collect())
    assert said(0) == [(1, 0, "2 findings"), (2, 0, "1 findings")]
    assert said(1) == [(1, 0, "2 findings"), (1, 1, "y"), (2, 0, "1 findings"), (2, 1, "z")]
