"""Benchmark decontamination: rare n-gram seeds join training passages to test items, alignment scores them.

1. Every item's word n-grams are seeds. One pass over the corpus counts the
   documents that hold each (summed map-side before the shuffle, so the counts
   are as many rows as the items have n-grams).
2. Seeds are rare *for their item* if they are in at most ``common`` times as
   many documents as the median of those of its seeds that occur at all.
3. A second pass finds all seeds in each text and aligns the words around them
   with the item (Smith-Waterman over words: match 1, mismatch -1, gap -1). The
   score over the item's length is the similarity; ``least`` and more is a leak.
   Rarity only saves work: a place with a rare seed is aligned at once, one with
   common seeds only if it shares as many words with the item as a leak needs (a
   score never exceeds them). So no leak that shares a seed is lost, however
   often its passage repeats.

Rare also means rare among the items: a seed that more than ``sharers`` of them
have belongs to a template (a question's usual wording). A document is aligned
with the items of which it holds a seed of their own, so a template alone is no
leak, and a document that holds it meets none of the thousands of items that
share it. Items with shared seeds only are met by those that the fewest share.
Items of equal words count as one, and are aligned once for all their ids.

The corpus is never shuffled; ``decontaminate`` filters rows where they stand. Items are taken in blocks of at most
``block_words`` words, so that what is broadcast is bounded whatever the size of
the benchmark; each further block is a further pass.

Edge cases: null and empty texts and items match nothing; an item of fewer than
``seed`` words is one seed, all its words in a row; repeated documents are judged
each on their own; rows with a null id are judged too; an empty benchmark leaves
every document clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read
from .words import LOOSE, words_of

SEED, COMMON, LEAST, BLOCK_WORDS, SHARERS = 4, 4.0, 0.4, 2_000_000, 16
LEAKS = "doc_id long, item_id long, similarity double, score long, first_word long, last_word long, seeds long"


class Items:
    """The items of a block, ready to be searched: sorted seed hashes, and each one's items and places. ``ids``: of each distinct item, all that have its words."""

    def __init__(self, rows: list, seed: int, sharers: int = SHARERS):
        self.seed, self.sharers = seed, sharers
        spelled: dict[tuple, list] = {}
        for w in words_of(pa.array([r[1] for r in rows], pa.string()), LOOSE):
            for i in range(len(w)):
                spelled.setdefault(tuple(w.hashes[w.rows[i] : w.rows[i + 1]].tolist()), []).append(rows[w.first + i])
        self.ids, rows = [[r[0] for r in same] for same in spelled.values()], [same[0] for same in spelled.values()]
        self.words = [np.array(x, np.uint64) for x in spelled]
        grams, owner, place, at = [], [], [], 0
        size = np.array([len(x) for x in self.words], np.int64)
        self.sizes = sorted({min(int(n), seed) for n in size if n})  # shorter items are seeds as a whole
        for w in words_of(pa.array([r[1] for r in rows], pa.string()), LOOSE):
            for k in self.sizes:
                inside = np.flatnonzero(w.inside(k))
                row = w.row_of()[inside]
                own = (size[row + at] == k) | (k == seed)
                grams.append(w.grams(k)[inside][own])
                owner.append(row[own] + at)
                place.append((inside - w.rows[row])[own])
            at += len(w)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self._keep(join(grams, np.uint64), join(owner, np.int64), join(place, np.int64))

    def _keep(self, grams, owner, place) -> None:
        order = np.argsort(grams, kind="stable")
        self.grams, self.owner, self.place = grams[order], owner[order], place[order]
        self.keys, self.rare = np.unique(self.grams), np.ones(len(grams), bool)
        self.key = np.searchsorted(self.keys, self.grams)
        pairs = np.unique(np.stack([self.key, self.owner], 1), axis=0) if len(grams) else np.zeros((0, 2), np.int64)
        holders = np.bincount(pairs[:, 0], minlength=len(self.keys))[self.key]
        fewest = np.full(len(self.words), np.iinfo(np.int64).max)
        np.minimum.at(fewest, self.owner, holders)
        mine = np.unique(np.stack([self.key, self.owner], 1)[holders <= np.maximum(self.sharers, fewest[self.owner])], axis=0) if len(grams) else pairs
        self.own_from, self.own_items = np.searchsorted(mine[:, 0], np.arange(len(self.keys) + 1)), mine[:, 1]
        self.by_item = np.lexsort((self.place, self.key, self.owner))
        self.item_from = np.searchsorted(self.owner[self.by_item], np.arange(len(self.words) + 1))

    def met(self, keys: np.ndarray) -> np.ndarray:
        """The items that have one of these keys to themselves, or nearly so."""
        left, many = self.own_from[keys], self.own_from[keys + 1] - self.own_from[keys]
        return np.unique(self.own_items[np.repeat(left, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)])

    def of(self, item: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys an item has, and which of its seeds these are: all pairs."""
        own = self.by_item[self.item_from[item] : self.item_from[item + 1]]
        left, right = np.searchsorted(self.key[own], keys, "left"), np.searchsorted(self.key[own], keys, "right")
        many = right - left
        return np.repeat(np.arange(len(keys)), many), own[np.repeat(left, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]

    def tell_rare(self, held: dict[int, int], common: float) -> None:
        """Marks, of each item, the seeds in at most ``common`` times as many documents as the median of those that occur."""
        df = np.array([held.get(int(g), 0) for g in self.grams.view(np.int64)], float)
        order = np.argsort(self.owner, kind="stable")
        bounds = np.flatnonzero(np.diff(self.owner[order])) + 1
        for own in np.split(order, bounds) if len(order) else []:
            seen = df[own][df[own] > 0]
            self.rare[own] = df[own] <= common * (np.median(seen) if len(seen) else 1.0)

    def hits(self, w) -> tuple[np.ndarray, np.ndarray]:
        """Word positions in the chunk that start a seed, and which key it is."""
        found, keys = [], []
        for k in self.sizes if len(self.keys) else ():
            grams = w.grams(k)
            at = np.searchsorted(self.keys, grams)
            hit = np.flatnonzero((self.keys[np.minimum(at, len(self.keys) - 1)] == grams) & w.inside(k)) if len(grams) else np.zeros(0, np.int64)
            found.append(hit)
            keys.append(at[hit])
        return (np.concatenate(found), np.concatenate(keys)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best Smith-Waterman score of two word sequences, and the place in ``text`` where it ends."""
    best, end = 0, 0
    columns = np.arange(len(text) + 1)
    above = np.zeros(len(text) + 1, np.int64)
    for word in item:
        row = np.zeros(len(text) + 1, np.int64)
        row[1:] = above[:-1] + np.where(text == word, 1, -1)
        np.maximum(row, above - 1, out=row)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + columns) - columns  # gaps along the text
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
        above = row
    return best, end


def shared(item: np.ndarray, text: np.ndarray) -> int:
    """How many words two sequences share, repeats counted: no alignment of them scores more."""
    words, n = np.unique(item, return_counts=True)
    at = np.minimum(np.searchsorted(words, text), len(words) - 1)
    return int(np.minimum(n, np.bincount(at[words[at] == text], minlength=len(words))).sum())


def _regions(places: np.ndarray, offsets: np.ndarray, rare: np.ndarray, m: int, n: int) -> list[tuple[int, int, int, bool]]:
    """Stretches of a text of n words that could hold an item of m words, given where its seeds lie; with their seed counts and whether one is rare."""
    pad = m // 4 + 4
    lo, hi = np.maximum(places - offsets - pad, 0), np.minimum(places - offsets + m + pad, n)
    order = np.argsort(lo, kind="stable")
    out: list[list[int]] = []
    for a, b, own in zip(lo[order].tolist(), hi[order].tolist(), rare[order].tolist()):
        if out and a <= out[-1][1] and b - out[-1][0] <= 4 * (m + 2 * pad):
            out[-1][1] = max(out[-1][1], b)
            out[-1][2] += 1
            out[-1][3] |= own
        else:
            out.append([a, b, 1, own])
    return [tuple(x) for x in out]


def _count(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(items.keys), np.int64)
        for batch in batches:
            for w in words_of(batch.column(0), LOOSE):
                at, key = items.hits(w)
                pairs = np.unique(np.stack([np.searchsorted(w.rows, at, "right") - 1, key], 1), axis=0)
                np.add.at(total, pairs[:, 1], 1)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(items.keys[seen].view(np.int64)), pa.array(total[seen])], ["gram", "n"])

    return run


def _leaks(items: Items, least: float):
    def leaks(w) -> Iterator[tuple]:
        """Row of the batch, item, and where and how well they align."""
        at, key = items.hits(w)
        doc = np.searchsorted(w.rows, at, "right") - 1
        for d in np.unique(doc).tolist():
            own = doc == d
            text = w.hashes[w.rows[d] : w.rows[d + 1]]
            for i in items.met(np.unique(key[own])).tolist():
                held, which = items.of(i, key[own])
                item, top = items.words[i], None
                for a, b, seeds, rare in _regions((at[own] - w.rows[d])[held], items.place[which], items.rare[which], len(item), len(text)):
                    if not rare and shared(item, text[a:b]) < least * len(item):
                        continue
                    score, end = align(item, text[a:b])
                    if top is None or score > top[0]:
                        back, _ = align(item[::-1], text[a : a + end][::-1])
                        top = (score, a, a + end, seeds, back)
                if top and top[0] >= least * len(item):
                    begin = top[2] - _reach(item, text[top[1] : top[2]], top[0])
                    for item_id in items.ids[i]:
                        yield w.first + d, item_id, top[0] / len(item), top[0], begin, top[2] - 1, top[3]

    return leaks


def _search(items: Items, least: float):
    leaks = _leaks(items, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(batch.column(0)[x[0]].as_py(), *x[1:]) for w in words_of(batch.column(1), LOOSE) for x in leaks(w)]
            columns = list(zip(*found)) if found else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.float64(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in LEAKS.split(", ")])

    return run


def _without(items: Items, least: float, place: int):
    leaks = _leaks(items, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[x[0] for w in words_of(batch.column(place), LOOSE) for x in leaks(w)]] = False
            yield batch.filter(pa.array(keep))

    return run


def _reach(item: np.ndarray, text: np.ndarray, score: int) -> int:
    """How many words before the end of ``text`` the alignment that ends there begins."""
    best, end = align(item[::-1], text[::-1])
    return end if best >= score else len(text)


def _blocks(docs: DataFrame, items: DataFrame, seed: int = SEED, common: float = COMMON, block_words: int = BLOCK_WORDS, sharers: int = SHARERS) -> Iterator:
    """The items in broadcast blocks, each with its rare seeds told by a pass over docs."""
    context = docs.sparkSession.sparkContext
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    words = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = -(-words // block_words) or 1
    for k in range(blocks):
        block = Items(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect(), seed, sharers)
        first = context.broadcast(block)
        counted = docs.select("text").mapInArrow(lambda b, x=first: _count(x.value)(b), "gram long, n long")
        block.tell_rare(dict(counted.groupBy("gram").agg(F.sum("n")).collect()), common)
        yield context.broadcast(block)


def find_leaks(docs: DataFrame, items: DataFrame, least: float = LEAST, **options) -> DataFrame:
    """One row per (document, item) that align: the best score, its share of the item's words, where it lies and how many seeds lie there."""
    out = None
    for block in _blocks(docs, items, **options):
        found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda b, x=block: _search(x.value, least)(b), LEAKS)
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, least: float = LEAST, **options) -> DataFrame:
    """docs without those in which an item leaks; each row is judged where it stands, so repeated and null ids don't matter."""
    place, left = docs.columns.index("text"), docs
    for block in _blocks(docs, items, **options):
        left = left.mapInArrow(lambda b, x=block: _without(x.value, least, place)(b), docs.schema)
    return left


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leak of a benchmark item in a document."""
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
