"""Source divergence audit: how far the words of each source are from those of the other sources of its language.

Single-pass in-memory indexing. Every task goes once over its documents and
builds a block of postings, (lang, term) to (source, count, documents), until
``BLOCK`` of them fill its memory; the block is spilled as a run that is sorted by
hash shard, language and term, cut into pages of ``PAGE`` terms (``_Block``). Spark
deals the pages to their shards, ordered by their first terms, and ``_merge`` goes
over a shard with a heap of its open pages: one cursor for each run, moved on term
by term, so that a term's postings of all runs meet and are summed. What it holds
are the pages whose range has begun and not ended. The result, the frequencies of
the terms that enough documents of a language have, is a table in the shared
folder.

For two sources s and t of a language with V kept terms, almost all terms are
absent from both and have one and the same value f0(s, t). So the sum over all
terms is V * f0 and, for each posting, a correction of the pairs it takes part in;
these stream out of each (language, part), source by source, and are summed
map-side (``_corrections``). There is a part for every ``PART`` postings of the
table, whatever its size. The matrix of terms and sources is never built whole:
``CELLS`` bounds what a step holds.

All arithmetic is exact: counts are longs, and a share of 10^9 is divided in three
steps of 1000, so nothing overflows up to 9 * 10^15 occurrences in a group.

Hot terms, sources and languages are summed in their blocks before they are
shuffled: a term sends one posting for each block and source. A shard has many
terms of all languages.

Edge cases: null text, lang and source are empty strings; each row is a document,
also if it repeats an id; groups without terms take part with counts of 0; a
language without kept terms has values of 0; one with a single source has no
pairs; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import read, shared_folder
from .words import cut, words_of

BLOCK, PAGE, PART, CELLS, CHUNK = 2_000_000, 2048, 100_000, 1 << 21, 1 << 22
LEAST, UNIT, TOP = 3, 1_000_000_000, 200
#: bytes of terms, A-Z lower-cased; all others separate
FOLD = np.arange(256, dtype=np.uint8)
FOLD[:65] = FOLD[91:97] = FOLD[123:128] = 32
FOLD[65:91] += 32

RUN = "shard int, lang string, first binary, terms array<binary>, sizes array<int>, names array<string>, sources array<int>, counts array<bigint>, docs array<bigint>"
_RUN = pa.schema([
    ("shard", pa.int32()), ("lang", pa.string()), ("first", pa.binary()), ("terms", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32())), ("names", pa.list_(pa.string())),
    ("sources", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64())),
])
FREQUENCIES = "shard int, lang string, term string, sources array<string>, counts array<bigint>"
_FREQUENCIES = pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("term", pa.string()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys in order, and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
    return keys[heads], *(np.add.reduceat(v[order], heads) if len(heads) else v[:0] for v in values)


class _Block:
    """Postings in memory: numbers for terms and for (lang, source) groups, and sums for each pair of them."""

    def __init__(self, limit: int, shards: int):
        self.limit, self.shards = limit, shards
        self.clear()

    def clear(self) -> None:
        self.terms: dict[bytes, int] = {}
        self.groups: dict[tuple[str, str], int] = {}
        self.parts, self.size = [], 0

    def add(self, texts: pa.Array, langs: list[str], sources: list[str]) -> Iterator[pa.RecordBatch]:
        for words in words_of(texts, FOLD, CHUNK):
            told = cut(words.folded, words.starts, words.ends).dictionary_encode()
            number = np.array([self.terms.setdefault(t, len(self.terms)) for t in told.dictionary.to_pylist()], np.int64)
            own = slice(words.first, words.first + len(words))
            group = np.array([self.groups.setdefault(g, len(self.groups)) for g in zip(langs[own], sources[own])], np.int64)
            row, term = words.row_of(), number[told.indices.to_numpy()] if len(told) else np.zeros(0, np.int64)
            pairs, count = _summed(row << 40 | term, np.ones(len(term), np.int64))
            self.parts.append(_summed(group[pairs >> 40] << 40 | pairs & (1 << 40) - 1, count, np.ones(len(pairs), np.int64)))
            self.size += len(self.parts[-1][0])
            if self.size > self.limit:
                self.parts = [_summed(*(np.concatenate(c) for c in zip(*self.parts)))]
                self.size = len(self.parts[0][0])
                if self.size > self.limit // 2:
                    yield from self.spill()

    def spill(self) -> Iterator[pa.RecordBatch]:
        """The block as a run, sorted and cut into pages; it is empty then."""
        if self.size:
            keys, counts, docs = _summed(*(np.concatenate(c) for c in zip(*self.parts)))
            spelled, groups = list(self.terms), list(self.groups)
            rank = np.empty(len(spelled), np.int64)
            rank[sorted(range(len(spelled)), key=spelled.__getitem__)] = np.arange(len(spelled))
            langs = sorted({lang for lang, _ in groups})
            lang_of = np.array([langs.index(lang) for lang, _ in groups], np.int64)
            group, term = keys >> 40, keys & (1 << 40) - 1
            hashes = np.array([zlib.crc32(t) for t in spelled], np.int64)
            lang = lang_of[group]
            shard = hashes[term] % self.shards
            order = np.lexsort((group, rank[term], lang, shard))
            group, term, lang, shard, counts, docs = (x[order] for x in (group, term, lang, shard, counts, docs))
            new = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (lang[1:] != lang[:-1]) | (shard[1:] != shard[:-1])))
            border = np.append(np.append(True, (lang[new][1:] != lang[new][:-1]) | (shard[new][1:] != shard[new][:-1])), True)
            starts = np.flatnonzero(border)
            cuts = np.unique(np.concatenate([np.arange(a, b, PAGE) for a, b in zip(starts, starts[1:])] + [starts[-1:]]))
            at, rows = np.append(new, len(term)), []
            for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
                lo, hi = at[a], at[b]
                names, code = np.unique(group[lo:hi], return_inverse=True)
                own = [spelled[t] for t in term[new[a:b]].tolist()]
                rows.append((int(shard[lo]), langs[lang[lo]], own[0], own, np.diff(at[a : b + 1]), [groups[g][1] for g in names.tolist()], code, counts[lo:hi], docs[lo:hi]))
                if len(rows) == 64 or b == cuts[-1]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), _RUN.types)], schema=_RUN)
                    rows = []
        self.clear()


def _index(limit: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(limit, shards)
        for b in batches:
            yield from block.add(b.column("text"), b.column("lang").to_pylist(), b.column("source").to_pylist())
        yield from block.spill()

    return run


class _Page:
    """A page of a run and the place of the cursor in it."""

    def __init__(self, columns: list, names: dict[str, int]):
        terms, sizes, own, sources, counts, docs = columns
        self.terms = terms.as_py()
        self.at = np.append(0, np.cumsum(sizes.values.to_numpy())).tolist()
        code = np.array([names.setdefault(s, len(names)) for s in own.as_py()], np.int64)
        self.postings = code[sources.values.to_numpy()], counts.values.to_numpy(), docs.values.to_numpy()
        self.place = 0


def _frequencies(done: list, postings: list, names: dict[str, int], least: int) -> pa.RecordBatch:
    """The terms of ``done`` (shard, lang, term, pieces of postings) that have ``least`` documents, postings of a source summed."""
    spelled = np.array(list(names), object)
    which = np.repeat(np.arange(len(done)), [sum(len(p[0]) for p in postings[lo:hi]) for *_, lo, hi in done])
    source, count, docs = (np.concatenate([p[i] for p in postings]) for i in range(3))
    key, count, docs = _summed(which << 32 | source, count, docs)
    which, source = key >> 32, key & (1 << 32) - 1
    heads = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
    kept = np.flatnonzero(np.add.reduceat(docs, heads) >= least)
    stops = np.append(heads[1:], len(which))
    take = np.isin(which, kept)
    ends = np.append(0, np.cumsum(stops[kept] - heads[kept])).astype(np.int32)
    lists = lambda values, kind: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))
    rows = [done[i] for i in kept.tolist()]
    return pa.RecordBatch.from_arrays([
        pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2].decode() for r in rows], pa.string()),
        lists(spelled[source[take]], pa.string()), lists(count[take], pa.int64()),
    ], schema=_FREQUENCIES)


def _merge(least: int, rows: int = 20_000):
    """Merges the runs of a shard. Pages come by shard, lang and first term; the heap holds the term at the cursor of every open page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap: list[tuple] = []
        done: list[tuple] = []
        postings: list[tuple] = []
        names: dict[str, int] = {}
        number = 0

        def upto(bound: tuple | None) -> Iterator[pa.RecordBatch]:
            """Takes all terms below the bound from the heap."""
            nonlocal done, postings, names
            while heap and (bound is None or heap[0][0] < bound):
                key, begin = heap[0][0], len(postings)
                while heap and heap[0][0] == key:
                    _, n, page = heap[0]
                    lo, hi = page.at[page.place], page.at[page.place + 1]
                    postings.append(tuple(p[lo:hi] for p in page.postings))
                    page.place += 1
                    if page.place < len(page.terms):
                        heapq.heapreplace(heap, ((*key[:2], page.terms[page.place]), n, page))
                    else:
                        heapq.heappop(heap)
                done.append((*key, begin, len(postings)))
                if len(done) == rows:
                    yield _frequencies(done, postings, names, least)
                    done, postings = [], []

        for b in batches:
            shards, langs, firsts, *columns = (b.column(n) for n in _RUN.names)
            for i in range(b.num_rows):
                first = shards[i].as_py(), langs[i].as_py(), firsts[i].as_py()
                yield from upto(first)
                number += 1
                heapq.heappush(heap, (first, number, _Page([c[i] for c in columns], names)))
        yield from upto(None)
        if done:
            yield _frequencies(done, postings, names, least)

    return run


def _told(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])


def frequencies(docs: DataFrame, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """(shard, lang, term, sources, counts) of every term that ``least`` documents of its language have: a table in the shared folder."""
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = _told(docs).mapInArrow(_index(block, shards), RUN)
    merged = runs.repartition(shards, "shard").sortWithinPartitions("shard", "lang", "first").mapInArrow(_merge(least), FREQUENCIES)
    path = f"{shared_folder(spark)}/frequencies-{uuid.uuid4().hex}"
    merged.write.parquet(path)
    return spark.read.schema(FREQUENCIES).parquet(path)


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / total), for count < total below 9 * 10^15."""
    left, out = count + 1, np.zeros(np.broadcast_shapes(np.shape(count), np.shape(total)), np.int64)
    for _ in range(4):
        out = out * 1000 + left // total
        left = left % total * 1000
    return 1 + out


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


PARTS = "lang string, source string, part string, item string, value long"
_PARTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _rows(lang: str, source, part: str, item, value) -> pa.Table:
    n = len(value)
    return pa.table([pa.array([lang] * n, pa.string()), pa.array(source, pa.string()), pa.array([part] * n, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], schema=_PARTS)


def _corrections(top: int):
    def run(terms: pa.Table, totals: pa.Table) -> pa.Table:
        """Of one language and part: what its postings add to each pair's sum, and the terms that lead in each source."""
        if not terms.num_rows or not totals.num_rows:
            return _PARTS.empty_table()
        lang = totals.column("lang")[0].as_py()
        names, n = totals.column("source").to_pylist(), totals.column("n").to_numpy()
        kept, all_n = int(totals.column("kept")[0].as_py()), int(totals.column("lang_n")[0].as_py())
        place = {s: i for i, s in enumerate(names)}
        terms = terms.combine_chunks().sort_by("term")
        lists = terms.column("sources").combine_chunks(), terms.column("counts").combine_chunks()
        lists = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in lists]
        size = np.diff(lists[0].offsets.to_numpy())
        count = lists[1].flatten().to_numpy()
        told = lists[0].flatten().dictionary_encode()
        source = np.array([place[s] for s in told.dictionary.to_pylist()], np.int64)[told.indices.to_numpy()]
        term = np.repeat(np.arange(len(size)), size)
        heads = np.append(0, np.cumsum(size)[:-1])
        p, q = shares(count, n[source] + kept), shares(np.add.reduceat(count, heads), np.array(all_n + kept))[term]
        spelled, out = np.array(terms.column("term").to_pylist(), object), []

        over = np.flatnonzero(p > q)
        value = _apart(p[over], q[over])
        order = np.lexsort((term[over], -value, source[over]))
        over, value = over[order], value[order]
        new = np.flatnonzero(np.append(True, source[over][1:] != source[over][:-1])) if len(over) else np.zeros(0, int)
        rank = np.arange(len(over)) - np.repeat(new, np.diff(np.append(new, len(over))))
        lead = np.flatnonzero(rank < top)
        out.append(_rows(lang, [names[s] for s in source[over[lead]].tolist()], "term", spelled[term[over[lead]]], value[lead]))

        none = shares(np.zeros(len(n), np.int64), n + kept)
        by_source = np.argsort(source, kind="stable")
        bounds = np.searchsorted(source[by_source], np.arange(len(n) + 1))
        step = max(1, CELLS // len(n))
        for s in range(len(n)):
            mine = by_source[bounds[s] : bounds[s + 1]]
            forth, back = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for lo in range(0, len(mine), step):
                own = mine[lo : lo + step]
                row = np.repeat(np.arange(len(own)), size[term[own]])
                at = np.arange(len(row)) - np.repeat(np.cumsum(size[term[own]]) - size[term[own]], size[term[own]]) + heads[term[own]][row]
                others, absent = np.tile(none, (len(own), 1)), np.ones((len(own), len(n)), bool)
                others[row, source[at]], absent[row, source[at]] = p[at], False
                forth += _apart(p[own][:, None], others).sum(0) - len(own) * _apart(none[s], none)
                back += (np.where(absent, _apart(others, p[own][:, None]) - _apart(none, none[s]), 0)).sum(0)
            if len(mine):
                rest = [i for i in range(len(n)) if i != s]
                out.append(_rows(lang, [names[s]] * len(rest), "pair", [names[i] for i in rest], forth[rest]))
                out.append(_rows(lang, [names[i] for i in rest], "pair", [names[s]] * len(rest), back[rest]))
        return pa.concat_tables(out)

    return run


def _whole(c: str) -> Column:
    """The share of a term that is absent, as a column of the totals."""
    return F.when(F.col("kept") > 0, F.expr(f"1 + {UNIT} div ({c} + kept)")).otherwise(1)


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from each other one of its language, and the terms that set it apart from the language."""
    found = frequencies(docs, least, block)
    flat = found.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).select("lang", F.col("x.sources").alias("source"), F.col("x.counts").alias("count"))
    counted = flat.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    kept = found.groupBy("lang").agg(F.count("*").alias("kept"))
    groups = _told(docs.withColumn("text", F.lit(""))).select("lang", "source").distinct()
    whole = Window.partitionBy("lang")
    totals = groups.join(counted, ["lang", "source"], "left").join(kept, "lang", "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("kept", F.lit(0)).alias("kept"))
    totals = totals.withColumn("lang_n", F.sum("n").over(whole))
    parts = -(-(found.agg(F.sum(F.size("counts"))).first()[0] or 1) // PART)
    terms = found.select("lang", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int").alias("place"), "term", "sources", "counts")
    dealt = totals.where("kept > 0").select(*[F.col(c).alias(c) for c in totals.columns], F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    streamed = terms.groupBy("lang", "place").cogroup(dealt.groupBy("lang", "part")).applyInArrow(_corrections(top), PARTS)

    a, b = totals.select("lang", "source", "kept", _whole("n").alias("p")), totals.select("lang", F.col("source").alias("item"), _whole("n").alias("q"), F.lit("pair").alias("part"))
    pairs = a.join(b, "lang").where("source <> item").select("lang", "source", "part", "item", F.expr("kept * ((p - q) * (p - q) div q)").alias("value"))
    values = pairs.unionByName(streamed).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return values.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= top))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources of all documents, against each other and against their languages."""
    return audit(read(spark, sf_dir, "documents").select("text", "lang", "source"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT i, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, count(DISTINCT i) AS docs FROM w GROUP BY ALL),
k AS MATERIALIZED (SELECT lang, term, sum(n)::BIGINT AS n FROM c GROUP BY lang, term HAVING sum(docs) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
t AS (SELECT lang, source, sum(c.n) AS n FROM c JOIN k USING (lang, term) GROUP BY lang, source),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(t.n, 0) + v.v)::HUGEINT) AS p, (1 + (1000000000::HUGEINT * (k.n + 1)) // (v.n + v.v)::HUGEINT) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN t USING (lang, source)),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= 200
"""
