"""Substring dedup with prefix-partitioned suffix trees.

A passage repeats if ``DEPTH`` consecutive words of a document (a window) also
start in a document with a smaller id. Windows become suffixes of a tree whose
internal nodes at depth ``DEPTH`` are the windows that repeat; chains of them
are the maximal repeats (``n_runs`` of each document).

A window is spelt from its sampled suffix on: of the nine suffixes that start in
it and have ``LENGTHS[0]`` more words there, the sample is the one with the smallest prefix hash. The
spelling runs from the sample to the window's end and then from the word before
the sample backwards to its start. Equal windows have equal spellings, and
neighbouring windows mostly share their sample, so that they travel as one piece.

1. Sampled prefixes are counted over the corpus, summed map-side; a prefix that
   one document alone has is a leaf of the tree and goes no further.
2. Groups of at most ``GROUP`` sampled suffixes (some 20 MB of text and as many
   numbers) are subtrees that fit into a task. Where a group is larger, its windows get longer prefixes of their
   spellings (``LENGTHS``), counted again, until they fit. A group that is too
   large at full depth is one node; it is summed map-side to its smallest id, and never comes together.
3. Each task sorts the spellings of its groups by their words and takes the
   longest common prefixes of neighbours: stretches of full depth are the
   nodes. The words decide, not their hashes.
4. Each document gets the places of its windows that a smaller id has too, marks
   the words they cover and keeps the others.

Documents with equal texts are told apart from the rest by a digest of the whole
text first: all windows of all but the smallest id are repeats, so groups of
copies never reach the tree. Texts are shuffled once, by id.

Edge cases: null and empty texts have no words; texts of fewer than ``DEPTH``
words have no window and keep all; rows without an id keep all and take nothing
from others; rows that repeat an id are one document for "smaller id" and are
returned each; a passage that repeats only inside one document stays; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import checkpointed, read, small_side
from .words import Words, binary, cut, words_of

DEPTH = 13
LENGTHS, GROUP = (5, 9), 1 << 16
TASK_ROWS = 8192
_WORDS = np.arange(DEPTH)


def samples(w: Words, depth: int = DEPTH, short: int = LENGTHS[0]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where a window of ``depth`` words starts in the chunk, the smallest hash of the ``short``-word prefixes in each (the lowest bit is 0), and the first place that has it."""
    at = np.flatnonzero(w.inside(depth))
    if not len(at):
        return at, np.zeros(0, np.uint64), at
    grams = w.grams(short) & ~np.uint64(1)
    least, place = grams[at], at.copy()
    for j in range(1, depth - short + 1):
        own = grams[at + j]
        less = own < least
        least[less], place[less] = own[less], at[less] + j
    return at, least, place


def _first_of_each(*keys: np.ndarray) -> np.ndarray:
    """The indexes of the first of each distinct tuple of keys, in order."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
    return np.sort(order[new])


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(prefix, doc_id): the sampled suffixes of each row, each once."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for w in words_of(batch.column(1)):
            at, least, _ = samples(w)
            row = w.row_of()[at]
            new = _first_of_each(row, least)
            yield pa.RecordBatch.from_arrays([pa.array(least[new].view(np.int64)), pa.array(ids[row[new] + w.first])], ["prefix", "doc_id"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, packed, nth): texts as they travel."""
    press = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([press(x.as_py()) for x in binary(batch.column(1))], pa.binary()), batch.column(2)], ["doc_id", "packed", "nth"])


def _unpacked(column) -> pa.Array:
    open_up = zstandard.ZstdDecompressor().decompress
    return pa.array([open_up(x) if x else b"" for x in column.to_pylist()], pa.large_binary())


def _lists(column, w: Words) -> list[np.ndarray]:
    """The lists of a chunk's rows, null ones empty."""
    none = np.zeros(0, np.int64)
    return [none if x.as_py() is None else np.asarray(x.values, np.int64) for x in column.slice(w.first, len(w))]


def _chosen(w: Words, shared: list[np.ndarray], large: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start, sample's prefix and sample's place of the windows whose sampled prefix is in its row's list, with the wanted flag in the lowest bit; each window's first occurrence in the row."""
    at, least, place = samples(w)
    row = w.row_of()[at]
    bounds, hit = np.searchsorted(row, np.arange(len(w) + 1)), np.zeros(len(at), bool)
    for r, own in enumerate(shared):
        own = own[own & 1 == large] & ~1
        if len(own):
            a, b = bounds[r], bounds[r + 1]
            hit[a:b] = np.isin(least[a:b].view(np.int64), own)
    at, row, least, place = at[hit], row[hit], least[hit], place[hit]
    new = _first_of_each(row, w.grams(DEPTH)[at]) if len(at) else at
    return row[new], at[new], least[new], place[new]


PIECE = "prefix long, doc_id long, place long, sample int, words binary"
SPELT = "doc_id long, place long, sample int, words binary"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of neighbouring windows with one sample; ``place`` is where the first starts (above bit 40: which of its id's texts it is in), ``sample`` where the sample is, counted from there."""
    for batch in batches:
        ids, nth = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 3))
        for w in words_of(_unpacked(batch.column(1))):
            row, at, least, place = _chosen(w, _lists(batch.column(2), w), False)
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1] + 1) | (place[1:] != place[:-1]) | (row[1:] != row[:-1])
            first = np.flatnonzero(new)
            last = at[np.append(first[1:], len(at)) - 1] if len(at) else at
            row, at, least, place = row[first], at[first], least[first], place[first]
            text = cut(w.text, w.starts[at], w.ends[last + DEPTH - 1])
            yield pa.RecordBatch.from_arrays([pa.array(least.view(np.int64)), pa.array(ids[row + w.first]), pa.array((nth[row + w.first] << 40) + at - w.rows[row]), pa.array((place - at).astype(np.int32)), text.cast(pa.binary())], [x.split()[0] for x in PIECE.split(", ")])


def _order(start: np.ndarray, sample: np.ndarray) -> np.ndarray:
    """The words of windows in the order of their spellings, given where each starts and how far from there its sample is."""
    back = DEPTH - sample[:, None]
    return start[:, None] + np.where(_WORDS < back, sample[:, None] + _WORDS, DEPTH - 1 - _WORDS)


def _spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of large groups one by one, their words in the order of the spelling with a space after each."""
    for batch in batches:
        ids, nth = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 3))
        for w in words_of(batch.column(1)):
            row, at, _, place = _chosen(w, _lists(batch.column(2), w), True)
            which = _order(at, place - at).ravel()
            size = w.ends[which] - w.starts[which] + 1
            offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
            data = np.append(w.text, np.uint8(32))[np.arange(offsets[-1]) + np.repeat(w.starts[which] - offsets[:-1], size)]
            data[offsets[1:] - 1] = 32
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets[::DEPTH].copy()), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([pa.array(ids[row + w.first]), pa.array((nth[row + w.first] << 40) + at - w.rows[row]), pa.array((place - at).astype(np.int32)), words.cast(pa.binary())], [x.split()[0] for x in SPELT.split(", ")])


def repeats(words: np.ndarray, sample: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which of the windows a smaller document has too. ``words``: the numbers of each one's words, as it is spelt.

    The suffix tree of the windows, as sorted suffixes with the longest common prefix of each and the one before it: an internal node of
    full depth is a stretch of suffixes whose common prefixes are all DEPTH words (and whose samples lie alike).
    """
    bits = max(1, int(words.max(initial=0)).bit_length())
    fit, keys = 63 // bits, []
    for lo in range(0, DEPTH, fit):  # several words to a sort key
        key = np.zeros(len(words), np.int64)
        for j in range(lo, min(DEPTH, lo + fit)):
            key = key << bits | words[:, j]
        keys.append(key)
    order = np.lexsort((doc, sample, *keys[::-1]))
    words, sample, doc = words[order], sample[order], doc[order]
    common = np.logical_and.accumulate(words[1:] == words[:-1], axis=1).sum(1)
    start = np.ones(len(order), bool)
    start[1:] = (common < DEPTH) | (sample[1:] != sample[:-1])
    least = doc[np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))]
    out = np.zeros(len(order), bool)
    out[order] = doc > least
    return out


def _marks_of(rows: pa.Table, spelt: bool) -> pa.RecordBatch:
    """(doc_id, place) of the windows of whole groups that a smaller document has too. ``spelt``: rows are single windows as they are spelt."""
    doc, place, sample = (rows.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "place", "sample"))
    w = next(words_of(rows.column("words"), chunk=1 << 62))
    many = np.diff(w.rows) - DEPTH + 1
    piece = np.repeat(np.arange(len(w)), many)
    step = np.arange(len(piece)) - np.repeat(np.cumsum(many) - many, many)
    lies, start = sample[piece] - step, w.rows[piece] + step
    found = repeats(w.spelled()[start[:, None] + _WORDS if spelt else _order(start, lies)], lies, doc[piece])
    return pa.RecordBatch.from_arrays([pa.array(doc[piece][found]), pa.array(place[piece][found] + step[found])], ["doc_id", "place"])


def _subtrees(spelt: bool):
    """Rows come sorted by prefix; whole groups are taken together until there are TASK_ROWS of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= TASK_ROWS:
                rows = pa.Table.from_batches(held)
                prefix = rows.column("prefix").to_numpy()
                full = int(np.searchsorted(prefix, prefix[-1]))  # the last group may go on
                if full:
                    yield _marks_of(rows.slice(0, full), spelt)
                held = rows.slice(full).to_batches()
        rows = [b for b in held if b.num_rows]
        if rows:
            yield _marks_of(pa.Table.from_batches(rows), spelt)

    return run


MARK = "doc_id long, place long"


def _trees(pieces: DataFrame, spelt: bool) -> DataFrame:
    return pieces.repartition("prefix").sortWithinPartitions("prefix").select("prefix", "doc_id", "place", "sample", "words").mapInArrow(_subtrees(spelt), MARK)


def _longer(windows: DataFrame, group: int) -> DataFrame:
    """Marks of the windows whose sampled prefix is too common for one group: under longer prefixes, where these fit, else as nodes of their own."""
    prefixed = windows.withColumn("long", F.substring_index(F.col("words").cast("string"), " ", LENGTHS[1]))
    sizes = prefixed.groupBy("long").agg(F.count("*").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("long", "n")
    sized = prefixed.join(small_side(sizes), "long")
    fits = sized.where(F.col("n") <= group).withColumn("prefix", F.xxhash64("long"))
    rest = sized.where(F.col("n") > group).select(*windows.columns)
    nodes = rest.groupBy("words", "sample").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("words", "sample", "a")
    return _trees(fits, True).unionByName(rest.join(small_side(nodes), ["words", "sample"]).where("doc_id > a").select("doc_id", "place"))


CUT = "doc_id long, n_words long, n_removed long, n_runs long, kept string"


def _again(w: Words, marks: list[np.ndarray]) -> np.ndarray:
    """Starts of all windows of a chunk that equal one of the marked windows of their row, by their words."""
    numbers, nodes, out = w.spelled(), w.grams(DEPTH), []
    for r, own in enumerate(marks):
        if len(own):
            own = own + w.rows[r]
            own = own[np.argsort(nodes[own])]
            at = np.arange(w.rows[r], w.rows[r + 1] - DEPTH + 1)
            like = own[np.minimum(np.searchsorted(nodes[own], nodes[at]), len(own) - 1)]
            at, like = at[nodes[at] == nodes[like]], like[nodes[at] == nodes[like]]
            out.append(at[(numbers[at[:, None] + _WORDS] == numbers[like[:, None] + _WORDS]).all(1)])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _cut(copied: bool, packed: bool):
    """Each document without the words that its repeated windows (column 2: a place of each) cover; without all of them, if it is a copy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            texts = _unpacked(batch.column(1)) if packed else binary(batch.column(1))
            nth = batch.column(3).to_numpy(zero_copy_only=False) if packed else np.zeros(batch.num_rows, np.int64)
            for w in words_of(texts):
                if copied:
                    at = np.flatnonzero(w.inside(DEPTH))
                else:
                    at = _again(w, [x[x >> 40 == k] & (1 << 40) - 1 for x, k in zip(_lists(batch.column(2), w), nth[w.first :].tolist())]) if packed else np.zeros(0, np.int64)
                covered = np.zeros(len(w.hashes) + 1, np.int32)
                np.add.at(covered, at, 1)
                np.add.at(covered, at + DEPTH, -1)
                gone = np.cumsum(covered[:-1]) > 0
                for r in range(len(w)):
                    a, b = int(w.rows[r]), int(w.rows[r + 1])
                    words, lost = texts[w.first + r].as_py().split(), gone[a:b]
                    removed = int(lost.sum())
                    runs = int(lost[:1].sum() + (lost[1:] & ~lost[:-1]).sum())
                    kept = words if not removed else [x for x, c in zip(words, lost.tolist()) if not c]
                    out.append((b - a, removed, runs, b" ".join(kept).decode()))
            columns = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string())))], [x.split()[0] for x in CUT.split(", ")])

    return run


def cut_repeats(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """Per row of docs: how many words it has, how many repeat from a smaller id, in how many maximal runs, and the text of the others."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = own.where(F.col("doc_id").isNotNull()).withColumn("digest", F.unhex(F.sha2("text", 256)))
    firsts = known.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    copies = small_side(known.select("doc_id", "digest").join(firsts, "digest").where("doc_id > first").select("doc_id", "digest").distinct())
    several = known.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a < b").select("doc_id")
    texts = known.select("doc_id", "digest").join(several, "doc_id").distinct().select("doc_id", "digest", F.row_number().over(Window.partitionBy("doc_id").orderBy("digest")).alias("nth"))
    fresh = known.join(copies, ["doc_id", "digest"], "left_anti").join(small_side(texts), ["doc_id", "digest"], "left").select("doc_id", "text", F.coalesce("nth", F.lit(0)).alias("nth"))
    copied = known.join(copies, ["doc_id", "digest"], "left_semi").select("doc_id", "text")

    suffixes = fresh.mapInArrow(_suffixes, "prefix long, doc_id long")
    shared = suffixes.groupBy("prefix").agg(F.count("*").alias("n")).where("n > 1").select("prefix", (F.col("n") > group).alias("large"))
    branches = checkpointed(suffixes.join(shared, "prefix").groupBy("doc_id").agg(F.collect_set(F.col("prefix") + F.col("large").cast("long")).alias("shared")))

    base = fresh.mapInArrow(_pack, "doc_id long, packed binary, nth int").join(branches, "doc_id", "left")
    places = _trees(base.where(F.size("shared") > 0).select("doc_id", "packed", "shared", "nth").mapInArrow(_pieces, PIECE), False)
    crowded = branches.where(F.exists("shared", lambda p: p % 2 != 0))
    if crowded.limit(1).count():
        places = places.unionByName(_longer(fresh.join(small_side(crowded), "doc_id").select("doc_id", "text", "shared", "nth").mapInArrow(_spelt, SPELT), group))
    marks = places.groupBy("doc_id").agg(F.collect_set("place").alias("marks"))
    kept = base.join(marks, "doc_id", "left").select("doc_id", "packed", "marks", "nth").mapInArrow(_cut(False, True), CUT)
    alone = own.where(F.col("doc_id").isNull()).mapInArrow(_cut(False, False), CUT)
    return kept.unionByName(copied.mapInArrow(_cut(True, False), CUT)).unionByName(alone)


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps, and from how many maximal repeats it was cut."""
    return cut_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), "n_runs")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM s) WHERE first < doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM f),
a AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d),
r AS (SELECT doc_id, count(*) AS r FROM (SELECT doc_id, j, lag(j) OVER (PARTITION BY doc_id ORDER BY j) AS p FROM c) WHERE p IS NULL OR j > p + 1 GROUP BY doc_id),
k AS (SELECT a.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY j) AS t FROM a ANTI JOIN c ON a.doc_id = c.doc_id AND a.j = c.j GROUP BY a.doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256, coalesce(r, 0) AS n_runs FROM d LEFT JOIN k USING (doc_id) LEFT JOIN r USING (doc_id)
"""
