"""Personal data in texts, found with DataFrame functions only.

Regular expressions propose spans, kind by kind, leftmost and not overlapping.
Checks confirm them: parts of an ip are at most 255, cards have 16 to 19 digits
and pass Luhn, phones have 8 to 15 digits, ibans pass mod-97. Words near a span,
up to ``CONTEXT`` characters on either side and not beyond the next proposal of
its kind, raise or lower its score, which is 1 at most. Spans of the kinds that this method adds
(not ``base``) need a score of ``LEAST``; base spans stay whatever their score.
``redact`` replaces the spans that ``find`` gives, overlapping ones as one.

``split`` gives the text between the proposals and ``regexp_extract_all`` the
proposals, so a running sum of lengths gives the places, without Python and
without a shuffle. Quantifiers are possessive and proposals begin at the start
of their run of characters (or where the last one ended), so that the time is
linear in a text of any length and no pattern recurses.

Edge cases: a null text is empty and has no spans; every row is judged on its
own, so repeated rows and null ids give rows of their own; places count code
points, the end exclusive; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import plain, read

CONTEXT, LEAST, CUTS = 40, 0.5, 128


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    guard: str
    base: bool
    score: float
    near: str
    against: str
    plain: str  # the same language for engines without lookbehind


# fixed values: length of an iban by country code (ISO 13616)
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: so many characters as the country's ibans have, blanks between them or not: words in capitals that follow are not taken in
IBAN = r"\b(?:" + "|".join(f"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items()) + r")\b"

KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", True, 0.9, "mail|contact|write", "example", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", "[0-9][.][0-9]", True, 0.6, "ip|address|host|server|login", "version|release|section", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    Kind("card", r"[0-9](?:[ -]?+[0-9])++", "[0-9][ -]?[0-9]", True, 0.8, "card|visa|master|pay|credit", "order|ticket|serial|isbn", r"[0-9]([\x20-]?[0-9])+"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", True, 0.6, "call|phone|tel|mobile|fax", "score|total|points", r"\+[0-9][\x20().0-9-]+[0-9]"),
    Kind("iban", IBAN, "[A-Z]{2}[0-9]{2}", False, 0.6, "iban|account|bank|transfer", "serial|model", IBAN),
)
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_BLOCK = 128


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the last digit of a string of digits is its Luhn check digit."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return F.when((n - i) % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an iban (blanks removed) leaves 1 modulo 97, its first four characters moved to the end."""
    turned = F.concat(F.substring(iban, 5, 1000), F.substring(iban, 1, 4))

    def step(a: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code < 58, (a * 10 + code - 48) % 97).otherwise((a * 100 + code - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _holds(kind: Kind, hit: Column) -> Column:
    if kind.name == "ip":
        return hit.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind.name == "card":
        return F.when(F.length(_digits(hit)).between(16, 19), luhn(_digits(hit))).otherwise(False)
    if kind.name == "phone":
        return F.length(_digits(hit)).between(8, 15)
    if kind.name == "iban":
        return mod97(F.replace(hit, F.lit(" "), F.lit("")))
    return F.lit(True)


def running(lengths: Column) -> Column:
    """The sum of all elements before each one; in blocks, so that it isn't quadratic in the array."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")), lambda b: F.slice(lengths, b * _BLOCK + 1, _BLOCK))
    grown = lambda xs, first: F.aggregate(xs, F.array(first), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    first = grown(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x)), F.lit(0))
    return F.flatten(F.zip_with(blocks, F.slice(first, F.lit(1), F.size(blocks)), lambda b, s: F.slice(grown(b, s), F.lit(1), F.size(b))))


def _proposals(docs: DataFrame, text: str, kinds: tuple[Kind, ...]) -> DataFrame:
    """docs with two arrays for each kind: the proposals and what stands between them."""
    whole = F.col(text)
    columns = {}
    for k in kinds:
        may = whole.rlike(k.guard)
        columns[f"_hit_{k.name}"] = F.when(may, F.regexp_extract_all(whole, F.lit(k.pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
        columns[f"_gap_{k.name}"] = F.when(may, F.split(whole, k.pattern, -1)).otherwise(F.array(whole))
    return docs.withColumns(columns)


SPAN = "struct<kind:string,start:bigint,end:bigint,hit:string,score:double>"


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _spans(kind: Kind) -> Column:
    hits, gaps = F.col(f"_hit_{kind.name}"), F.col(f"_gap_{kind.name}")
    before, after = F.slice(gaps, F.lit(1), F.size(hits)), F.slice(gaps, F.lit(2), F.size(hits))
    at = running(F.zip_with(before, hits, lambda g, h: F.length(g) + F.length(h)))
    placed = F.zip_with(F.arrays_zip(before.alias("gap"), after.alias("next"), at.alias("at")), hits, lambda x, h: F.struct(
        (x["at"] + F.length(x["gap"])).cast("long").alias("start"), (x["at"] + F.length(x["gap"]) + F.length(h)).cast("long").alias("end"), h.alias("hit"),
        _lower(F.concat(F.right(x["gap"], F.lit(CONTEXT)), F.lit(" "), F.left(x["next"], F.lit(CONTEXT)))).alias("near"),
    ))
    score = lambda x: F.least(F.lit(1.0), F.round(F.lit(kind.score) + F.when(x["near"].rlike(kind.near), 0.3).otherwise(0.0) - F.when(x["near"].rlike(kind.against), 0.3).otherwise(0.0), 2))
    good = F.filter(placed, lambda x: _holds(kind, x["hit"]))
    spans = F.transform(good, lambda x: F.struct(F.lit(kind.name).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["hit"].alias("hit"), score(x).alias("score")))
    spans = spans if kind.base else F.filter(spans, lambda x: x["score"] >= LEAST)
    return F.when(F.size(hits) == 0, F.array().cast(f"array<{SPAN}>")).otherwise(spans)


def _found(own: DataFrame, whole: str, kinds: tuple[Kind, ...]) -> DataFrame:
    """own with ``pii``. Its other columns are named as ``plain`` names them."""
    found = _proposals(own, whole, kinds).withColumns({f"_span_{k.name}": _spans(k) for k in kinds})
    return found.select(*own.columns, F.flatten(F.array(*[F.col(f"_span_{k.name}") for k in kinds])).alias("pii"))


def find(docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """docs with ``pii``: all confirmed spans by kind, then place, each with its score. A column of that name is replaced."""
    own, names = plain(docs.drop("pii"))
    found = _found(own.withColumn("_whole", F.coalesce(F.col(names[text]).cast("string"), F.lit(""))), "_whole", kinds)
    return found.select(*names.values(), "pii").toDF(*names, "pii")


def apart(spans: Column) -> Column:
    """Spans in the order of their places, those that overlap as one with the kind of the first."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))

    def put(done: Column, x: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), last["kind"].alias("kind"))
        return F.when(F.size(done) == 0, F.array(x)).when(x["start"] >= last["end"], F.concat(done, F.array(x))).otherwise(F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer)))

    one = F.aggregate(ordered, F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>"), put)
    cross = F.exists(F.zip_with(F.slice(ordered, F.lit(1), F.size(ordered) - 1), F.slice(ordered, F.lit(2), F.size(ordered) - 1), lambda a, b: a["end"] > b["start"]), lambda x: x)
    return F.when(F.size(spans) < 2, ordered).when(cross, one).otherwise(ordered)


def replaced(text: Column, spans: Column) -> Column:
    """text with each of the spans (in order, apart) replaced by its kind in brackets. It is cut at every ``CUTS``-th span first, so that no cut looks far."""
    count = F.size(spans)
    sub = lambda t, a, b: F.substring(t, (a + 1).cast("int"), (b - a).cast("int"))
    start = lambda i, end: F.coalesce(F.get(spans, i)["start"], end)

    def part(j: Column) -> Column:
        low, high = start(j * CUTS, F.lit(0)), start((j + 1) * CUTS, F.length(text).cast("long"))
        own = F.slice(spans, (j * CUTS + 1).cast("int"), CUTS)
        piece = sub(text, low, high)
        said = F.transform(own, lambda x, i: F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"), sub(piece, x["end"] - low, F.coalesce(F.get(own, i + 1)["start"], high) - low)))
        return F.array_join(said, "")

    parts = F.transform(F.sequence(F.lit(0), F.floor((count - 1) / CUTS).cast("int")), part)
    return F.when(count == 0, text).otherwise(F.concat(sub(text, F.lit(0).cast("long"), start(F.lit(0), F.lit(0))), F.array_join(parts, "")))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span that ``find`` gives replaced by its kind in brackets; null texts stay null."""
    own, names = plain(docs)
    found = _found(own.withColumn("_whole", F.coalesce(F.col(names[text]).cast("string"), F.lit(""))), "_whole", KINDS)
    clean = F.when(F.col(names[text]).isNotNull(), replaced(F.col("_whole"), F.col("_apart")))
    return found.withColumn("_apart", apart(F.col("pii"))).withColumn(names[text], clean).select(*names.values()).toDF(*names)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts, and places as digest and as text."""
    found = find(read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    said = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = [k.name for k in KINDS if k.base]
    many = lambda kind: F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[many(b) for b in base],
        F.sha2(said(F.filter("pii", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"), said(F.col("pii")).alias("spans"),
    )


def _oracle() -> str:
    holds = {
        "email": "true",
        "ip": "len(list_filter(string_split(h, '.'), lambda p: NOT regexp_matches(p, '^0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$'))) = 0",
        "card": "len(regexp_replace(h, '[^0-9]', '', 'g')) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, len(regexp_replace(h, '[^0-9]', '', 'g')) + 1), lambda i: CASE WHEN (len(regexp_replace(h, '[^0-9]', '', 'g')) - i) % 2 = 0 THEN substr(regexp_replace(h, '[^0-9]', '', 'g'), i, 1)::INT ELSE substr(regexp_replace(h, '[^0-9]', '', 'g'), i, 1)::INT * 2 - CASE WHEN substr(regexp_replace(h, '[^0-9]', '', 'g'), i, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0",
        "phone": "len(regexp_replace(h, '[^0-9]', '', 'g')) BETWEEN 8 AND 15",
        "iban": "list_reduce(list_prepend(0, list_transform(string_split(substr(replace(h, ' ', ''), 5) || substr(replace(h, ' ', ''), 1, 4), ''), lambda c: CASE WHEN ord(c) < 58 THEN ord(c) - 48 ELSE ord(c) - 55 END)), lambda a, d: (a * CASE WHEN d > 9 THEN 100 ELSE 10 END + d) % 97) = 1",
    }
    parts = []
    near = "translate(right(gaps[i], 40) || ' ' || left(gaps[i + 1], 40), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    for k, kind in enumerate(KINDS):
        score = "true" if kind.base else f"round({kind.score} + CASE WHEN regexp_matches({near}, '{kind.near}') THEN 0.3 ELSE 0 END - CASE WHEN regexp_matches({near}, '{kind.against}') THEN 0.3 ELSE 0 END, 2) >= {LEAST}"
        parts.append(
            f"SELECT doc_id, {k} AS k, '{kind.name}' AS kind, i, h, list_sum(list_transform(gaps[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: len(x))), 0) AS pos FROM ("
            f"SELECT doc_id, gaps, hits, unnest(hits) AS h, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT doc_id, string_split_regex(t, '{kind.plain}') AS gaps, regexp_extract_all(t, '{kind.plain}') AS hits FROM d)) WHERE {holds[kind.name]} AND {score}"
        )
    base = [k.name for k in KINDS if k.base]
    said = "string_agg(kind || ':' || pos::BIGINT || ':' || (pos + len(h))::BIGINT, ',' ORDER BY k, pos)"
    counts = ", ".join(f"count(*) FILTER (kind = '{b}') AS n_{b}" for b in base)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({' UNION ALL '.join(parts)})
SELECT d.doc_id, {counts}, sha256(coalesce({said} FILTER (kind <> 'iban'), '')) AS base_sha256, coalesce({said} FILTER (kind IS NOT NULL), '') AS spans
FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id
"""


ORACLE = _oracle()
