"""Document fingerprints: the k smallest hashes of a text's word shingles.

The k smallest of a set's hashes are a uniform sample of the set, and those of a
union are the k smallest of both sketches' hashes: so sketches merge without
the texts. The share of the union's k smallest that both have estimates the
resemblance; the k-th smallest tells how many distinct shingles there are; both
together give containment. A sketch of fewer than k hashes holds its whole set,
and all these are then exact.

A shingle is five words (in a text of fewer words, all of them); letters A-Z are
lower-cased. A text form of a sketch is URL-safe base64 of the hashes' upper 48
bits in ascending order.

Edge cases: null and empty texts and texts without words have the empty sketch;
two empty sketches resemble each other fully, an empty and a filled one not at
all; repeated ids are put in the order of their texts, rows without an id come
first, in the order of a hash of theirs; the last document's next
is the first; a table of one document is its own next; an empty table gives no
rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import read
from .words import LOWER, mix, words_of

K, SHINGLE, BYTES = 128, 5, 6
PIECE_ROWS, MOST, MERGED = 1000, 10000, 10000
NO_ID = -1e19  # below all ids


def shorter(words: np.ndarray) -> np.ndarray:
    """The one shingle of a text of fewer words than a shingle has."""
    one = np.array([len(words)], np.uint64)
    for h in words:
        one = mix(one ^ h) * np.uint64(0xD6E8FEB86659FD93)
    return mix(one)


def shingles(w, row: int, k: int = SHINGLE, grams: np.ndarray | None = None) -> np.ndarray:
    """The distinct shingle hashes of one row, ascending. ``grams``: w.grams(k), if the caller has it."""
    a, b = int(w.rows[row]), int(w.rows[row + 1])
    if b - a >= k:
        return np.unique((w.grams(k) if grams is None else grams)[a : b - k + 1])
    if b == a:
        return np.zeros(0, np.uint64)
    return shorter(w.hashes[a:b])


def sketches(column, k: int = K) -> list[np.ndarray]:
    """The sketch of each text: 48-bit hashes, ascending."""
    out = []
    with np.errstate(over="ignore"):
        for w in words_of(column, LOWER):
            grams = w.grams(SHINGLE)
            for row in range(len(w)):
                found = shingles(w, row, SHINGLE, grams) >> np.uint64(64 - 8 * BYTES)
                out.append(found[np.concatenate([[True], found[1:] != found[:-1]])][:k] if len(found) else found)
    return out


def merge(sketch: np.ndarray, other: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(sketch, other)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity of the two shingle sets."""
    if not len(a) and not len(b):
        return 1.0
    both = merge(a, b, k)
    return float(np.isin(both, a, assume_unique=True)[np.isin(both, b, assume_unique=True)].sum() / len(both))


def distinct(sketch: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(sketch)) if len(sketch) < k else (k - 1) / (float(sketch[k - 1]) + 1) * 2.0 ** (8 * BYTES)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k))


def spelled(sketch: np.ndarray) -> str:
    return base64.urlsafe_b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BYTES :].tobytes()).decode()


def parsed(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.urlsafe_b64decode(text), np.uint8).reshape(-1, BYTES)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, 8 - BYTES :] = raw
    return full.view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, text: str = "text", k: int = K) -> DataFrame:
    """docs with ``fingerprint`` and the estimated number of distinct shingles."""
    schema = docs.drop("fingerprint", "n_distinct").schema.add("fingerprint", "string").add("n_distinct", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = sketches(batch.column(text), k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([spelled(s) for s in made], pa.string()), pa.array([distinct(s, k) for s in made], pa.float64())], schema.names)

    return docs.drop("fingerprint", "n_distinct").mapInArrow(run, schema)


def merged(fingerprinted: DataFrame, key: str, k: int = K) -> DataFrame:
    """(key, fingerprint, n_distinct): the sketch of all texts of each key, from their sketches alone.

    Every task merges what it sees of a key before anything is sent; a key's merged parts are then merged in a stream, so no group is held.
    """
    parts = fingerprinted.select(F.col(key).cast("string").alias("key"), "fingerprint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, np.ndarray] = {}
        for batch in batches:
            for name, sketch in zip(*(c.to_pylist() for c in batch.columns[:2])):
                held[name] = merge(held.get(name, np.zeros(0, np.uint64)), parsed(sketch or ""), k)
            if len(held) > MERGED:
                yield told(held)
                held = {}
        yield told(held)

    def told(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array([spelled(x) for x in held.values()], pa.string()), pa.array([distinct(x, k) for x in held.values()], pa.float64())], ["key", "fingerprint", "n_distinct"])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sketch, begun = None, None, False
        for batch in batches:
            done = {}
            for name, other in zip(*(c.to_pylist() for c in batch.columns[:2])):
                if begun and name != now:
                    done[now] = sketch
                    sketch = None
                now, begun = name, True
                sketch = merge(np.zeros(0, np.uint64) if sketch is None else sketch, parsed(other), k)
            yield told(done)
        if begun:
            yield told({now: sketch})

    schema = "key string, fingerprint string, n_distinct double"
    first = parts.mapInArrow(run, schema)
    return first.select("key", "fingerprint").repartition("key").sortWithinPartitions("key").mapInArrow(last, schema).withColumnRenamed("key", key)


def _pieces(docs: DataFrame) -> list[float]:
    """Borders that deal the ids into about as many rows each, whatever their distribution (approximate quantiles, ``MOST`` borders at most)."""
    ids = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("double").alias("id"))
    n = min(MOST, ids.count() // PIECE_ROWS)
    inner = ids.approxQuantile("id", [(i + 1) / (n + 1) for i in range(n)], 0.25 / (n + 1)) if n else []
    without = [NO_ID * (1 + i / 64) for i in range(64, 0, -1)]  # rows without an id lie below all ids
    return [float("-inf"), *without, *sorted(set(inner)), float("inf")]


def with_next(docs: DataFrame) -> DataFrame:
    """(piece, borrowed, at, doc_id, text): docs dealt into pieces of neighbouring ids, each with the first document of the next piece as its last.

    ``at`` orders the rows: by id; before them, rows without an id by a hash of their texts. One row a piece is sent twice, everything else once.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spread = NO_ID * (F.lit(1.0) + F.pmod(F.xxhash64("text"), F.lit(1 << 40)) / float(1 << 40))
    placed = own.withColumn("at", F.coalesce(F.col("doc_id").cast("double"), spread))
    dealt = Bucketizer(splits=_pieces(docs), inputCol="at", outputCol="piece").transform(placed).withColumn("piece", F.col("piece").cast("long"))
    firsts = dealt.groupBy("piece").agg(F.min(F.struct("at", "doc_id")).alias("first")).select("piece", "first.at", "first.doc_id")
    around = Window.orderBy("piece")  # one row per piece, MOST + 65 at most
    wanted = firsts.select("at", F.col("doc_id").alias("id"), F.col("piece").alias("home"), F.coalesce(F.lag("piece").over(around), F.last("piece").over(around.rowsBetween(0, Window.unboundedFollowing))).alias("borrower"))
    lent = dealt.join(F.broadcast(wanted.withColumnRenamed("at", "first")), (F.col("piece") == F.col("home")) & (F.col("at") == F.col("first")) & F.col("doc_id").eqNullSafe(F.col("id")))
    lent = lent.groupBy(F.col("borrower").alias("piece")).agg(F.min(F.struct("at", "doc_id", "text")).alias("head")).select("piece", F.lit(True).alias("borrowed"), "head.at", "head.doc_id", "head.text")
    return dealt.select("piece", F.lit(False).alias("borrowed"), "at", "doc_id", "text").unionByName(lent)


COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_distinct double, contained double"


def edited(text: str, following: str) -> str:
    """text, its last quarter replaced by as much of the beginning of the following one."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in COMPARED.split(", ")]
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 4]
    left: list[tuple] = []
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            rows = left + list(zip(*(part.column(c).to_pylist() for c in ("piece", "borrowed", "doc_id", "text"))))
            pairs = [(x, y) for x, y in zip(rows, rows[1:]) if not x[1] and x[0] == y[0]]
            made = dict(zip(map(id, rows), sketches(pa.array([r[3] for r in rows], pa.string()))))
            changed = [edited(x[3], y[3]) for x, y in pairs]
            out = []
            for (x, y), text, after in zip(pairs, changed, sketches(pa.array(changed, pa.string()))):
                own = made[id(x)]
                out.append((x[2], len(x[3]), hashlib.sha256(text.encode()).hexdigest(), spelled(own), spelled(after), resemblance(own, after), resemblance(own, made[id(y)]), distinct(own), containment(own, after)))
            left = rows[-1:]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * len(names), kinds)], names)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Per document: its sketch, that of its edited text, and how alike they and the next document's are."""
    ordered = with_next(docs).repartition("piece").sortWithinPartitions("piece", "borrowed", "at", "doc_id", "text")
    return ordered.drop("at").mapInArrow(_compare, COMPARED)


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sketch against its edited text's and its neighbour's."""
    return compare_with_next(read(spark, sf_dir, "documents"))
