"""URL filters: rules of hosts and paths, and trust and distrust that flow over the links between hosts.

A rule (host, path) fits the urls of its host and of all hosts below it whose
path starts with the rule's; of those that fit, the longest decides. Where none
fits, the page's host does, by two personalised PageRanks over the graph of
hosts (``scores``):

- trust starts at hosts with pages that rules allow and follows the links;
- distrust starts at hosts with pages that rules block and follows the links
  backwards: who links to the blocked is distrusted.

A host starts with as many thousandths of ``UNIT`` as rules allow (or block) of
its judged pages. In every round each host passes ``DAMPING`` hundredths of what
it has on, in equal parts over its links. A host whose distrust is ``LEAST`` and
more, and more than its trust, is blocked.

Scores are whole numbers and shares are rounded down, so their sums are the same
in any order: a task that runs again after a loss changes no verdict.

An edge leads from a page's host to every other host of the table that its html
names, in a link's authority or as a dotted name in its text; it counts once,
however many pages hold it (``edges``). Edges of a host that has more than
``PIECE`` are dealt over pieces, to each of which its score is sent, so a host
with a third of all edges is no single task. Edges and hosts keep their
partitioning in the store for all rounds; it is rebuilt from the checkpointed
tables if executors are lost.

Edge cases: null urls and urls without ``://`` have an empty host and path, fit
no rule and are allowed, as are hosts that nothing reaches; null html has no
links; repeated rows and null page_ids give rows of their own; an empty table
gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import checkpointed, plain, read, small_side

UNIT, DAMPING, ROUNDS, LEAST = 1_000_000_000, 85, 12, 50_000_000
PIECE, EVERY = 100_000, 4
AUTHORITY, NOT_NAME = r"//([^/?#\x22'\x20\x09-\x0D<>&]+)", "[^a-z0-9.-]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    def __str__(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"),
)


def lowered(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    return lowered(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits, as struct (rule, verdict); null if none does. For as many rules as an expression holds."""
    fits = lambda r: ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(str(r)), str(r), r.verdict)):
        out = F.when(fits(r), F.struct(F.lit(str(r)).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def judged(pages: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """pages with _host, _path and _rule."""
    placed = pages.withColumns({"_host": host_of(F.col(url)), "_path": path_of(F.col(url))})
    return placed.withColumn("_rule", rule_of(F.col("_host"), F.col("_path"), rules))


def edges(pages: DataFrame) -> DataFrame:
    """(source, target): hosts of which the first names the second in its html; both are hosts of pages. Of (host, html)."""
    html = lowered(F.coalesce(F.col("html").cast("string"), F.lit("")))
    names = F.transform(F.split(html, NOT_NAME), lambda x: F.btrim(x, F.lit(".-")))
    names = F.array_distinct(F.concat(F.filter(names, lambda x: F.instr(x, ".") > 0), F.regexp_extract_all(html, F.lit(AUTHORITY), F.lit(1))))
    named = pages.where("host <> ''").select(F.col("host").alias("source"), F.explode(names).alias("target")).where("source <> target").distinct()
    known = pages.select(F.col("host").alias("target")).distinct()
    return named.join(small_side(known), "target", "left_semi").select("source", "target")


def scores(seeds: DataFrame, links: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) of every host of ``seeds`` (host, allowed, blocked: judged pages), over ``links`` (source, target)."""
    share = lambda c: F.when(F.col("allowed") + F.col("blocked") > 0, F.expr(f"1000 * {c} div (allowed + blocked) * {UNIT // 1000}")).otherwise(0).cast("long")
    start = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), share(c).alias("seed")) for kind, c in (("trust", "allowed"), ("distrust", "blocked"))]))
    begun = seeds.select("host", start.alias("s")).select("host", "s.*")
    ways = F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.col("source").alias("host"), F.col("target").alias("to")), F.struct(F.lit("distrust").alias("kind"), F.col("target").alias("host"), F.col("source").alias("to"))))
    flow = links.select(ways.alias("w")).select("w.*")
    fans = flow.groupBy("kind", "host").agg(F.count("*").alias("fan")).withColumn("pieces", F.ceil(F.col("fan") / PIECE).cast("int"))
    nodes = checkpointed(begun.join(fans, ["kind", "host"], "left")).repartition("kind", "host").persist(StorageLevel.MEMORY_AND_DISK)
    dealt = flow.join(fans, ["kind", "host"]).select("kind", "host", F.pmod(F.xxhash64("to"), F.col("pieces")).cast("int").alias("piece"), "to")
    dealt = checkpointed(dealt).repartition("kind", "host", "piece").persist(StorageLevel.MEMORY_AND_DISK)
    now = nodes.select("kind", "host", F.col("seed").alias("score"))
    for k in range(1, rounds + 1):
        sent = now.where("score > 0").join(nodes.where("fan > 0").drop("seed"), ["kind", "host"])
        sent = sent.select("kind", "host", F.expr(f"score * {DAMPING} div 100 div fan").alias("part"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece")).where("part > 0")
        got = sent.join(dealt, ["kind", "host", "piece"]).groupBy("kind", F.col("to").alias("host")).agg(F.sum("part").alias("got"))
        now = nodes.select("kind", "host", "seed").join(got, ["kind", "host"], "left").select("kind", "host", (F.col("seed") + F.coalesce("got", F.lit(0))).alias("score"))
        if k % EVERY == 0 or k == rounds:
            now = checkpointed(now)
    nodes.unpersist()
    dealt.unpersist()
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0)).alias(kind)
    return now.groupBy("host").agg(of("trust"), of("distrust"))


def host_scores(pages: DataFrame, rules: tuple[Rule, ...] = RULES, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) of all hosts of ``pages`` (url, html)."""
    placed = judged(pages.select("url", "html"), rules=rules)
    many = lambda v: F.sum(F.when(F.col("_rule.verdict") == v, 1).otherwise(0))
    seeds = placed.where("_host <> ''").groupBy(F.col("_host").alias("host")).agg(many("allow").alias("allowed"), many("block").alias("blocked"))
    return scores(checkpointed(seeds), checkpointed(edges(placed.select(F.col("_host").alias("host"), "html"))), rounds)


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, rounds: int = ROUNDS) -> DataFrame:
    """pages with host, path, rule, verdict, trust and distrust (columns of these names are replaced)."""
    own, names = plain(pages.drop("host", "path", "rule", "verdict", "trust", "distrust"))
    ranked = small_side(host_scores(own.select(F.col(names["url"]).alias("url"), F.col(names["html"]).alias("html")), rules, rounds).withColumnRenamed("host", "_host"))
    bad = (F.col("distrust") >= LEAST) & (F.col("distrust") > F.col("trust"))
    verdict = F.coalesce("_rule.verdict", F.when(bad, "block").otherwise("allow"))
    found = judged(own, names["url"], rules).join(ranked, "_host", "left")
    said = [F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), F.coalesce("trust", F.lit(0)).alias("trust"), F.coalesce("distrust", F.lit(0)).alias("distrust")]
    return found.select(*names.values(), *said).toDF(*names, "host", "path", "rule", "verdict", "trust", "distrust")


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by rule, or by what its host gets over the links of all pages."""
    return filter_urls(read(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("url", "html")


def _oracle() -> str:
    """The same in SQL, one table a round."""
    path = lambda r: f"starts_with(path, '{r.path}')"
    longest = sorted(RULES, key=lambda r: -len(str(r)))
    case = lambda of: "CASE " + " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND {path(r)} THEN '{of(r)}'" for r in longest) + " END"
    low = lambda c: f"translate({c}, '{_UPPER}', '{_LOWER}')"
    steps = ", ".join(
        f"r{k} AS MATERIALIZED (SELECT n.kind, n.host, n.seed + coalesce(g.got, 0) AS score FROM n LEFT JOIN (SELECT f.kind, f.dst AS host, sum(r.score * {DAMPING} // 100 // f.fan) AS got FROM r{k - 1} r JOIN f USING (kind, host) GROUP BY ALL) g USING (kind, host))"
        for k in range(1, ROUNDS + 1)
    )
    share = lambda c: f"CASE WHEN a + b > 0 THEN 1000 * {c} // (a + b) * {UNIT // 1000} ELSE 0 END"
    return f"""
WITH u AS (SELECT page_id, {low("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, {low("coalesce(html, '')")} AS html FROM pages),
j AS (SELECT *, {case(str)} AS rule, {case(lambda r: r.verdict)} AS said FROM u),
s AS (SELECT host, count(*) FILTER (said = 'allow') AS a, count(*) FILTER (said = 'block') AS b FROM j WHERE host <> '' GROUP BY host),
w AS (SELECT host AS src, unnest(list_concat(list_transform(string_split_regex(html, '{NOT_NAME}'), lambda x: trim(x, '.-')), regexp_extract_all(html, '{AUTHORITY.replace("'", "''")}', 1))) AS dst FROM u WHERE host <> ''),
e AS (SELECT DISTINCT src, dst FROM w WHERE src <> dst AND dst IN (SELECT host FROM s)),
d AS (SELECT 'trust' AS kind, src AS host, dst FROM e UNION ALL SELECT 'distrust', dst, src FROM e),
f AS MATERIALIZED (SELECT kind, host, dst, count(*) OVER (PARTITION BY kind, host) AS fan FROM d),
n AS MATERIALIZED (SELECT 'trust' AS kind, host, {share("a")} AS seed FROM s UNION ALL SELECT 'distrust', host, {share("b")} FROM s),
r0 AS (SELECT kind, host, seed AS score FROM n), {steps},
t AS (SELECT host, cast(sum(score) FILTER (kind = 'trust') AS BIGINT) AS trust, cast(sum(score) FILTER (kind = 'distrust') AS BIGINT) AS distrust FROM r{ROUNDS} GROUP BY host)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN distrust >= {LEAST} AND distrust > trust THEN 'block' ELSE 'allow' END) AS verdict, coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
FROM j LEFT JOIN t USING (host)
"""


ORACLE = _oracle()
