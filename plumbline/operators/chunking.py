"""Cutting long texts into chunks, one document at a time, as folds over arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .provenance import MARKER

MAX_CHARS, OVERLAP, GROUP_CHARS = 18000, 500, 4500
_RUNS = "array<struct<from:int,to:int,alone:boolean>>"
# The titles that open a table.
NUMBER = r"\d+(?:\s*[-－—]\s*\d+){1,3}"
TITLE = rf"(?:附表\s*{NUMBER}[^\r\n]{{0,120}}?(?:观测结果表|结果表|成果表)|【[^】\r\n]+】[^\r\n]{{0,80}}?(?:监测数据(?:成果)?|数据成果|监测成果))"


def is_structured(text: Column) -> Column:
    """Whether a line of a text is the title of a table."""
    return text.rlike(f"(?m)^{TITLE}")


def _cuts(state: Column, *new: Column) -> Column:
    return F.concat(state["cuts"], F.array(*new))


def split_long(text: Column, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> Column:
    """CHK-05: pieces of at most ``max_chars`` that overlap, cut at a newline if there is one near the end. Texts up to the limit are one piece.

    The fold looks for the places only; the pieces are taken from blocks of the text, so that none is looked for from the text's beginning. The text is computed once.
    """
    return F.get(F.transform(F.array(text), lambda t: _split_long(t, max_chars, overlap)), 0)


def _split_long(text: Column, max_chars: int, overlap: int) -> Column:
    window = min(2000, max_chars // 3)
    size = F.length(text)
    steps = F.ceil(size / F.lit(max(1, max_chars - window - overlap))).cast("int") + 1
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{max_chars}}}"), F.lit(0))

    def part(blocks: Column, start: Column, end: Column) -> Column:
        """What lies between two places, at most ``max_chars`` apart: in a block and the next."""
        k = F.floor(start / max_chars).cast("int")
        return F.substring(F.concat(F.get(blocks, k), F.coalesce(F.get(blocks, k + 1), F.lit(""))), start - k * max_chars + 1, end - start)

    def step(s: Column, _: Column) -> Column:
        start = s["start"]
        full = F.least(start + max_chars, size)
        low = start + max_chars - window
        back = F.instr(F.reverse(part(s["blocks"], low, F.greatest(full, low))), "\n")  # 1: the last character
        cut = full - back
        end = F.when((full < size) & (back > 0) & (cut > start), cut).otherwise(full)
        moved = F.struct(F.greatest(end - overlap, start + 1).alias("start"), (end >= size).alias("done"), _cuts(s, F.struct(start.alias("from"), end.alias("to"))).alias("cuts"), s["blocks"].alias("blocks"))
        return F.when(s["done"], s).otherwise(moved)

    begin = F.struct(F.lit(0).alias("start"), F.lit(False).alias("done"), F.array().cast("array<struct<from:int,to:int>>").alias("cuts"), blocks.alias("blocks"))
    folded = F.aggregate(F.sequence(F.lit(1), steps), begin, step, lambda s: F.transform(s["cuts"], lambda c: part(s["blocks"], c["from"], c["to"])))
    return F.when(size <= max_chars, F.array(text)).otherwise(folded)


def _together(items: Column, max_chars: int) -> Column:
    """Runs of neighbouring items (size, alone, family) as (from, to, alone), of one family and ``max_chars`` at most; those that stand alone are runs of their own. Numbers only are folded."""
    last = lambda s, i: F.when(s["size"] > 0, F.array(F.struct(s["from"].alias("from"), i.alias("to"), F.lit(False).alias("alone")))).otherwise(F.array().cast(_RUNS))
    state = lambda at, start, size, family, cuts: F.struct(at.alias("at"), start.alias("from"), size.alias("size"), family.alias("family"), cuts.alias("cuts"))

    def step(s: Column, x: Column) -> Column:
        i = s["at"]
        own = F.struct(i.alias("from"), (i + 1).alias("to"), F.lit(True).alias("alone"))
        flushed = F.concat(s["cuts"], last(s, i))
        full = (s["size"] > 0) & ((x["family"] != s["family"]) | (s["size"] + x["size"] > max_chars))
        alone = state(i + 1, i + 1, F.lit(0), F.lit(""), F.concat(flushed, F.array(own)))
        return F.when(x["alone"], alone).when(full, state(i + 1, i, x["size"], x["family"], flushed)).otherwise(state(i + 1, s["from"], s["size"] + x["size"], x["family"], s["cuts"]))

    begin = state(F.lit(0), F.lit(0), F.lit(0), F.lit(""), F.array().cast(_RUNS))
    return F.aggregate(items, begin, step, lambda s: F.concat(s["cuts"], last(s, s["at"])))


def _joined(texts: Column, runs: Column, max_chars: int) -> Column:
    """The texts of each run joined; those that stand alone are split on their own."""
    return F.flatten(F.transform(runs, lambda r: F.when(r["alone"], split_long(F.get(texts, r["from"]), max_chars)).otherwise(F.array(F.array_join(F.slice(texts, r["from"] + 1, r["to"] - r["from"]), "")))))


def pack(segments: Column, max_chars: int = MAX_CHARS) -> Column:
    """Segments joined greedily up to ``max_chars``; one that is longer is split on its own. They are computed once, not for each run of them."""
    item = lambda x: F.struct(F.length(x).alias("size"), (F.length(x) > max_chars).alias("alone"), F.lit("").alias("family"))
    once = F.transform(F.array(segments), lambda own: F.struct(own.alias("own"), _together(F.transform(own, item), max_chars).alias("runs")))
    return F.get(F.transform(once, lambda x: _joined(x["own"], x["runs"], max_chars)), 0)


def _parts(text: Column, pattern: str) -> Column:
    return F.filter(F.split(text, pattern), lambda x: x.rlike(r"\S"))


def table_sections(reports: DataFrame, text: str = "raw_text") -> DataFrame:
    """CHK-01: texts with two titles of tables and more, cut before each of them; what precedes the first is section -1."""
    parts = reports.select("report_id", F.posexplode(F.split(F.col(text), f"(?m)^(?={TITLE})")).alias("pos", "section"))
    titled = F.col("section").rlike(rf"\A{TITLE}")
    report = Window.partitionBy("report_id")
    numbered = parts.withColumns({"titles": F.count_if(titled).over(report), "section_no": F.when(titled, F.count_if(titled).over(report.orderBy("pos")) - 1).otherwise(-1).cast("int")})
    return numbered.where("titles >= 2").select("report_id", "section_no", "section")


def label_sections(sections: DataFrame) -> DataFrame:
    """CHK-02: sections without the page marker at their end, under the nearest marker above, with their families: by their first lines an appendix's number
    without its last part, or a bracketed title; else a family of its own."""
    marks = F.regexp_extract_all("section", F.lit(MARKER), F.lit(0))
    above = Window.partitionBy("report_id").orderBy("section_no").rowsBetween(Window.unboundedPreceding, -1)
    marker = F.last(F.when(F.size(marks) > 0, F.element_at(marks, -1)), ignorenulls=True).over(above)
    bare = F.regexp_replace("section", rf"\n?{MARKER}\s*\z", "\n")
    marked = F.when(F.col("marker").isNull() | F.ltrim(F.col("bare")).startswith(F.col("marker")), F.col("bare")).otherwise(F.concat("marker", F.lit("\n"), "bare"))
    told = sections.withColumns({"marker": marker, "bare": bare}).withColumn("said", F.when(F.col("section_no") < 0, F.col("section")).otherwise(marked))
    line = F.trim(F.regexp_extract("said", r"\A([^\r\n]*)", 1))
    number, bracket = F.regexp_extract(line, rf"\A附表\s*({NUMBER})", 1), F.regexp_extract(line, r"\A(【[^】]+】)", 1)
    appendix = F.array_join(F.slice(F.split(number, r"\s*[-－—]\s*"), F.lit(1), F.size(F.split(number, r"\s*[-－—]\s*")) - 1), "-")
    family = F.when(number != "", F.concat(F.lit("appendix:"), appendix)).when(bracket != "", F.concat(F.lit("bracket:"), bracket)).otherwise(F.concat(F.lit("section:"), F.col("section_no").cast("string")))
    return told.select("report_id", "section_no", F.col("said").alias("section"), family.alias("family"))


def pack_sections(sections: DataFrame, max_chars: int = MAX_CHARS, group_chars: int = GROUP_CHARS) -> DataFrame:
    """CHK-03: one array of chunks per report: neighbouring sections of one family together up to ``group_chars``; one that is longer than ``max_chars`` is split on its own."""
    ordered = sections.where(F.col("section").rlike(r"\S")).groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct("section_no", "section", "family"))).alias("own"))
    item = lambda x: F.struct(F.length(x["section"]).alias("size"), ((x["section_no"] < 0) | (F.length(x["section"]) > max_chars)).alias("alone"), x["family"].alias("family"))
    runs = ordered.withColumns({"texts": F.transform("own", lambda x: x["section"]), "runs": _together(F.transform("own", item), min(max_chars, group_chars))})
    return runs.select("report_id", _joined(F.col("texts"), F.col("runs"), max_chars).alias("sections"))


def chunks(reports: DataFrame, max_chars: int = MAX_CHARS, text: str = "raw_text", group_chars: int = GROUP_CHARS) -> DataFrame:
    """CHK-04: by titles of tables if there are several, else by pages, else by loose bracketed titles, else by length."""
    packed = pack_sections(label_sections(table_sections(reports, text)), max_chars, group_chars)
    pages, titles = _parts(F.col(text), r"(?=--- 第 \d+ 页)"), _parts(F.col(text), r"(?=【[^】]+】.*?(?:监测|成果|数据))")
    cut = F.when(F.col("sections").isNotNull(), F.col("sections")).when(F.size(pages) > 1, pack(pages, max_chars)).when(F.size(titles) > 1, pack(titles, max_chars)).otherwise(split_long(F.col(text), max_chars))
    return reports.join(packed, "report_id", "left").select("report_id", F.posexplode(cut).alias("chunk_no", "text"))
