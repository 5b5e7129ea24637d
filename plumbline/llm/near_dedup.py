"""MinHash near-dedup with an LSH forest.

Each text's set of 5-word shingles gives 128 minhashes. Tree t of the forest
sorts all sets by their minhashes from number 4t on (and on from number 0), so
that sets alike lie near each other in many orders; sets whose longest common
prefix in a tree's order is ``DEPTH`` minhashes or more lie in one region. At a
similarity of 0.75, all 32 trees miss a pair with probability 6e-6.

Candidates are looked at in rounds, so that no group is paired with itself:

1. In each order every set meets its neighbour and the first of its region, if
   their common prefix is long enough: first in ``LEADING`` trees, then, of what
   the other trees bring, the pairs whose components still differ. A group of
   thousands of near copies becomes one component in this way.
2. In regions that still hold several components, all sets of different
   components meet. The depth adapts to the region: one of more than ``BLOCK``
   sets is parted by longer common prefixes (``DEPTHS``) until its parts fit.
3. Sets that such a parting kept from each other, and whose regions still hold
   several components, meet where they share one of their rarest shingles: under
   one order of all shingles, two sets of the wanted similarity always share one
   of the first floor(n / 4) + 1 of each. The order is by counts in ``CELLS``
   cells; it only decides how few meet, never which links there are. Keys of at
   most ``BLOCK`` sets give candidate pairs; a larger key's sets are compared
   block by block. Only links leave a task, and texts travel once to each group.

Minhashes only choose whom to look at: a pair whose signatures agree in less
than half is passed over (at 0.75 that happens with probability 3e-10). A link
counts if it holds on the sets of the words themselves. Equal texts are one node
from the start, so exact copies never meet. Components are found by alternating
large-star and small-star steps, all on Spark; nothing but row counts reaches
the driver.

Edge cases: letters A-Z are lower-cased; a text of fewer than five words has one
shingle, all its words; null texts and texts without words have an empty set and
link with nothing; rows that repeat an id are one document and are returned
each; rows without an id take part too, but a group of such rows alone has no
component id; an empty table gives no rows. ``keep_one`` keeps one of rows that
repeat both id and text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fingerprint import SHINGLE, shingles
from .tables import checkpointed, plain, read, settled, small_side
from .words import LOWER, binary, words_of

HASHES, DEPTH = 128, 4
TREES, LEADING = HASHES // DEPTH, 4
DEPTHS, BLOCK, LIKELY = (4, 6, 8, 12, 16), 512, 0.5
CELLS = 1 << 20
NO_ID = 1 << 62
_SEEDS = np.random.default_rng(8).integers(1, 1 << 63, (HASHES, 2), dtype=np.uint64)
_ADD, _TIMES = _SEEDS[:, :1], _SEEDS[:, 1:] | np.uint64(1)


def signature(own: np.ndarray) -> np.ndarray:
    """16 bits of each of the minhashes of a set of 64-bit hashes."""
    least = np.full(HASHES, np.iinfo(np.uint64).max)
    for lo in range(0, len(own), 4096):
        least = np.minimum(least, ((own[lo : lo + 4096] ^ _ADD) * _TIMES).min(1))
    return (least >> np.uint64(20)).astype(">u2")


def _sets(column) -> Iterator[np.ndarray]:
    with np.errstate(over="ignore"):
        for w in words_of(column, LOWER):
            grams = w.grams(SHINGLE)
            for row in range(len(w)):
                yield shingles(w, row, SHINGLE, grams)


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, node, text): ``node`` is the id, or a number beyond all ids that belongs to the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    return own.select("doc_id", "digest", F.coalesce("doc_id", F.lit(NO_ID) + F.pmod(F.xxhash64("digest"), F.lit(NO_ID - 1))).alias("node"), "text")


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            made = [(len(x), signature(x).tobytes()) if len(x) else (0, None) for x in _sets(part.column(3))]
            n, sign = zip(*made)
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(n, pa.int64()), pa.array(sign, pa.binary())], ["doc_id", "digest", "node", "n_shingles", "sign"])


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, node, n_shingles, sign): the size and the signature of each row's set."""
    return _keyed(docs).mapInArrow(_sign, "doc_id long, digest binary, node long, n_shingles long, sign binary")


REGION = ["tree", "prefix"]


def regions(nodes: DataFrame) -> DataFrame:
    """(tree, prefix, rep) for all regions, in all trees, that hold several nodes."""
    width = 2 * DEPTH
    keys = F.array(*[F.substring("sign", t * width + 1, width) for t in range(TREES)])
    placed = nodes.select("rep", F.posexplode(keys).alias(*REGION))
    shared = placed.groupBy(REGION).agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first < last").drop("first", "last")
    return placed.join(shared, REGION)


def turned() -> Column:
    """A signature as its tree sorts it."""
    return F.concat(F.expr(f"substring(sign, tree * {2 * DEPTH} + 1)"), F.expr(f"substring(sign, 1, tree * {2 * DEPTH})"))


def _signs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u2").reshape(-1, HASHES)


def _alike(sa: np.ndarray, sb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether pairs of sets may be as alike as is wanted, by their signatures and sizes."""
    return ((sa == sb).mean(-1) >= LIKELY) & (100 * np.minimum(na, nb) >= 75 * np.maximum(na, nb))


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each set and its neighbour in the order of a tree, and the first that this task sees of their region: all with a longest common prefix of DEPTH and more."""
    last = head = None
    for batch in batches:
        if not batch.num_rows:
            continue
        tree, rep, n = (batch.column(c).to_numpy() for c in (0, 1, 3))
        sign = _signs(batch.column(2))
        if last is not None:
            tree, rep, sign, n = np.append(last[0], tree), np.append(last[1], rep), np.concatenate([last[2], sign]), np.append(last[3], n)
        common = np.logical_and.accumulate(sign[1:, : DEPTHS[-1]] == sign[:-1, : DEPTHS[-1]], axis=1).sum(1)
        same = (tree[1:] == tree[:-1]) & (common >= DEPTH)
        starts = np.maximum.accumulate(np.where(np.append(True, ~same), np.arange(len(rep)), 0))
        first, first_sign, first_n = rep[starts], sign[starts], n[starts]
        if head is not None:  # the row that was kept stands for the region it was in
            begun = starts == 0
            first[begun], first_sign[begun], first_n[begun] = head
        a, b = np.concatenate([rep[:-1][same], first]), np.concatenate([rep[1:][same], rep])
        sa, sb = np.concatenate([sign[:-1][same], first_sign]), np.concatenate([sign[1:][same], sign])
        na, nb = np.concatenate([n[:-1][same], first_n]), np.concatenate([n[1:][same], n])
        good = (a != b) & _alike(sa, sb, na, nb)
        at = np.concatenate([tree[1:][same], tree])[good]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[good]), pa.array(np.maximum(a, b)[good]), pa.array(at)], ["a", "b", "tree"])
        head = (first[-1], first_sign[-1], first_n[-1])
        last = (tree[-1:], rep[-1:], sign[-1:], n[-1:])


def neighbours(placed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, tree): candidate pairs of round 1, each with the first tree that has it. The orders are cut into ranges of rows, so a large region is spread over tasks."""
    rows = placed.join(nodes.select("rep", "sign", "n"), "rep").select("tree", "rep", turned().alias("turned"), "n")
    ordered = rows.repartitionByRange("tree", "turned", "rep").sortWithinPartitions("tree", "turned", "rep")
    return ordered.mapInArrow(_beside, "a long, b long, tree int").groupBy("a", "b").agg(F.min("tree").alias("tree"))


def _named(df: DataFrame, components: DataFrame, rep: str, component: str) -> DataFrame:
    """df with the component of its column ``rep``: the node itself where it has no link."""
    return df.join(components.select(F.col("rep").alias(rep), F.col("component").alias(component)), rep, "left").withColumn(component, F.coalesce(component, rep))


def parted(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """The pairs whose components differ."""
    return _named(_named(pairs.select("a", "b"), components, "a", "ca"), components, "b", "cb").where("ca <> cb").select("a", "b")


def mixed(rows: DataFrame, region: list[str]) -> DataFrame:
    """rows of the regions that hold several components, with ``held``, the region's number of rows."""
    sizes = rows.groupBy(region).agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("held")).where("least < most")
    return rows.join(sizes.select(*region, "held"), region)


def _likely(part: np.ndarray, n: np.ndarray, block: np.ndarray, sign: np.ndarray) -> dict[int, np.ndarray]:
    """For sets of a group, those after it that are of other components and may be alike; where the group has two blocks, only those of the other."""
    two, likely = block.min() != block.max(), {}
    for i in range(len(n) - 1):
        to = np.arange(i + 1, len(n))
        to = to[(part[to] != part[i]) & ((block[to] != block[i]) | (not two))]
        to = to[_alike(sign[to], sign[i], n[to], n[i])] if len(to) else to
        if len(to):
            likely[i] = to
    return likely


def _links(likely: dict[int, np.ndarray], packed: list[bytes]) -> Iterator[tuple[int, int]]:
    """The links among what may be alike in a group."""
    wanted = np.unique(np.concatenate([np.append(to, i) for i, to in likely.items()])) if likely else np.zeros(0, np.int64)
    hashed: dict[int, np.ndarray] = {}
    for lo in range(0, len(wanted), 256):
        own = wanted[lo : lo + 256].tolist()
        hashed.update(zip(own, _sets(_unpacked([packed[i] for i in own]))))
    for i, to in likely.items():
        size = np.array([len(hashed[j]) for j in to.tolist()])
        both = np.add.reduceat(np.isin(np.concatenate([hashed[j] for j in to.tolist()]), hashed[i]), np.cumsum(size) - size)
        for j in to[100 * both >= 75 * (size + len(hashed[i]) - both)].tolist():
            if alike(spelled(packed[i]), spelled(packed[j])):
                yield i, j


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of each group of rows that lie together (a few blocks at most): links where rows have texts, else candidates; whole groups are taken as they come."""
    held: list[pa.RecordBatch] = []

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        group, rep, part, n, block = (rows.column(c).to_numpy() for c in ("group", "rep", "component", "n", "block"))
        sign, packed, out = _signs(rows.column("sign")), rows.column("packed") if "packed" in rows.column_names else None, []
        bounds = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
        for lo, hi in zip(bounds, bounds[1:]):
            own = slice(lo, hi)
            likely = _likely(part[own], n[own], block[own], sign[own])
            found = ((i, j) for i, to in likely.items() for j in to.tolist()) if packed is None else _links(likely, packed[own].to_pylist())
            out += [(min(rep[lo + i], rep[lo + j]), max(rep[lo + i], rep[lo + j])) for i, j in found]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= 2 * BLOCK:
            rows = pa.Table.from_batches(held)
            full = int(np.searchsorted(rows.column("group").to_numpy(), rows.column("group")[-1].as_py()))
            if full:
                yield pairs(rows.slice(0, full))
            held = rows.slice(full).to_batches()
    rows = [b for b in held if b.num_rows]
    if rows:
        yield pairs(pa.Table.from_batches(rows))


def likely_pairs(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): the candidate pairs in groups of rows (group, block, rep, component), by sizes and signatures alone."""
    ordered = groups.join(nodes.select("rep", "sign", "n"), "rep").repartition("group").sortWithinPartitions("group")
    return ordered.select("group", "block", "rep", "component", "n", "sign").mapInArrow(_meet, "a long, b long").distinct()


def met(groups: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The links in groups of rows (group, block, rep, component). Texts travel packed, once to each group that they are in."""
    packed = _texts(docs, groups.select("rep")).mapInArrow(_pack, "rep long, packed binary")
    rows = groups.join(packed.join(nodes.select("rep", "sign", "n"), "rep"), "rep")
    ordered = rows.repartition("group").sortWithinPartitions("group")
    return ordered.select("group", "block", "rep", "component", "n", "sign", "packed").mapInArrow(_meet, "a long, b long").distinct()


def deepened(rows: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The groups of round 2, and the rows (tree, prefix, rep) of those regions that were parted. ``rows``: of mixed regions, with ``held``."""
    large = settled(rows.where(F.col("held") > BLOCK).select(*REGION, "rep", "component"))
    grouped = lambda some, key: some.select(F.xxhash64("tree", key).alias("group"), F.lit(0).alias("block"), "rep", "component")
    groups = grouped(rows.where(F.col("held") <= BLOCK), "prefix")
    if large.limit(1).count():
        left = large.join(nodes.select("rep", "sign"), "rep").withColumn("turned", F.substring(turned(), 1, 2 * DEPTHS[-1])).drop("sign")
        for depth in DEPTHS[1:]:
            tried = settled(mixed(left.drop("held").withColumn("longer", F.substring("turned", 1, 2 * depth)), ["tree", "longer"]))
            groups = groups.unionByName(grouped(tried.where(F.col("held") <= BLOCK), "longer"))
            left = tried.where(F.col("held") > BLOCK)
    return groups, large.select(*REGION, "rep")


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, n): how many sets of this task have a shingle in each cell that any has."""
    seen = np.zeros(CELLS, np.int64)
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            for own in _sets(_unpacked(batch.column(2).slice(lo, 256).to_pylist())):
                np.add.at(seen, _cell(own), 1)
    cell = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(seen[cell])], ["cell", "n"])


def _cell(own: np.ndarray) -> np.ndarray:
    return (own % np.uint64(CELLS)).astype(np.int64)


def _rarest(seen):
    """(rep, component, key): the floor(n / 4) + 1 rarest shingles of each set; among those of equal counts, the smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part, keys = batch.slice(lo, 256), []
                for own in _sets(_unpacked(part.column(2).to_pylist())):
                    keys.append(own[np.lexsort((own, seen.value[_cell(own)]))[: len(own) // 4 + 1]].view(np.int64))
                which = np.repeat(np.arange(part.num_rows), [len(k) for k in keys])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(which)), part.column(1).take(pa.array(which)), pa.array(np.concatenate(keys))], ["rep", "component", "key"])

    return run


def sharing(left: DataFrame, docs: DataFrame) -> DataFrame:
    """(rep, component, key, held): the sets of ``left`` (rep, component) under those of their rarest shingles that several components have.

    The order of shingles is by their counts in cells, ``CELLS`` numbers whatever the input is; any order that all sets share loses no link. Of keys that the very
    same sets have, one is kept: members are told apart by their number and two xors of hashes.
    """
    packed = checkpointed(left.join(_texts(docs, left).mapInArrow(_pack, "rep long, packed binary"), "rep").select("rep", "component", "packed"))
    told = packed.mapInArrow(_tally, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(CELLS, np.int64)
    seen[told.column("cell").to_numpy()] = told.column("n").to_numpy()
    shared = settled(mixed(packed.mapInArrow(_rarest(left.sparkSession.sparkContext.broadcast(seen)), "rep long, component long, key long"), ["key"]))
    members = shared.groupBy("key", "held").agg(F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64(F.lit("rep"), "rep")).alias("y"))
    return settled(shared.join(small_side(members.groupBy("held", "x", "y").agg(F.min("key").alias("key")).select("key")), "key"))


def families(hot: DataFrame, nodes: DataFrame) -> DataFrame:
    """Groups of two blocks for the sets (rep, component, key) of keys that more than BLOCK sets share: those that such keys connect are a family.

    Only sets of sizes within a factor 4/3 can be alike, so a family is cut into overlapping bands of sizes first. A band of R sets has
    R * R / BLOCK / BLOCK / 2 groups: what shares a common shingle even among its rarest is compared in full.
    """
    first = hot.join(small_side(hot.groupBy("key").agg(F.min("rep").alias("a"))), "key").select("a", F.col("rep").alias("b")).distinct()
    family = _named(hot.select("rep", "component").distinct(), connected(first), "rep", "family")
    step = F.floor(F.log(F.col("n").cast("double")) / float(np.log(4 / 3))).cast("int")
    banded = settled(family.join(nodes.select("rep", "n"), "rep").select("rep", "component", "family", F.explode(F.array(step, step + 1)).alias("band")))
    sized = mixed(banded, ["family", "band"]).withColumn("blocks", F.ceil(F.col("held") / BLOCK).cast("int"))
    dealt = sized.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select(F.xxhash64("family", "band", F.least("block", "other"), F.greatest("block", "other")).alias("group"), "block", "rep", "component")


def rest(large: DataFrame, components: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The links of round 3 among the sets of regions (tree, prefix, rep) that were parted and are still mixed.

    Candidate pairs come from the keys of few sets. Where those that pairs connect are at most BLOCK, they meet as one group, so that a text travels once; pairs of
    larger clusters are confirmed one by one. Sets of hot keys meet in blocks.
    """
    left = settled(mixed(_named(large, components, "rep", "component"), REGION).select("rep", "component").distinct())
    shared = sharing(left, docs)
    hot = shared.where(F.col("held") > BLOCK).select("rep", "component", "key")
    pairs = settled(likely_pairs(shared.where(F.col("held") <= BLOCK).select(F.col("key").alias("group"), F.lit(0).alias("block"), "rep", "component"), nodes))
    cluster = connected(pairs).withColumnRenamed("component", "cluster")
    wide = cluster.groupBy("cluster").agg(F.count("*").alias("held")).where(F.col("held") > BLOCK)
    wide = small_side(cluster.join(wide.select("cluster"), "cluster").select("rep"))
    groups = cluster.join(wide, "rep", "left_anti").join(left, "rep").select(F.xxhash64("cluster").alias("group"), F.lit(0).alias("block"), "rep", "component")
    if hot.limit(1).count():
        groups = groups.unionByName(families(hot, nodes))
    return met(settled(groups), nodes, docs).unionByName(confirmed(settled(pairs.join(wide.select(F.col("rep").alias("a")), "a", "left_semi").select("a", "b")), docs))


def _unpacked(packed: list[bytes]) -> pa.Array:
    return pa.array([zstandard.ZstdDecompressor().decompress(x) for x in packed], pa.large_binary())


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, packed): lower-cased texts, words parted by single spaces, as they travel."""
    press = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([press(b" ".join(x.as_py().lower().split())) for x in binary(batch.column(1))], pa.binary())], ["rep", "packed"])


def spelled(packed: bytes) -> set:
    """The shingles of a text as words."""
    words = zstandard.ZstdDecompressor().decompress(packed).split()
    return set(zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else {tuple(words)}


def alike(one: set, two: set) -> bool:
    both = len(one & two)
    return 100 * both >= 75 * (len(one) + len(two) - both)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: list = [None, None, None, None]
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            for side, packed in enumerate((x.as_py(), y.as_py())):
                if last[side] != packed:
                    last[side], last[side + 2] = packed, spelled(packed)
            keep.append(alike(*last[2:]))
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(rep, text) of the nodes in ``ids``; rows without an id give each text once."""
    own = _keyed(docs).join(small_side(ids.select(F.col("rep").alias("node")).distinct()), "node")
    once = own.where(F.col("doc_id").isNull()).dropDuplicates(["node"])
    return own.where(F.col("doc_id").isNotNull()).unionByName(once).select(F.col("node").alias("rep"), "text")


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs that are as alike as is wanted, by their words. Only texts that are in a pair travel."""
    packed = _texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("rep"))).mapInArrow(_pack, "rep long, packed binary")
    first, second = (packed.select(F.col("rep").alias(x), F.col("packed").alias(f"packed_{x}")) for x in "ab")
    return pairs.join(first, "a").join(second, "b").select("a", "b", "packed_a", "packed_b").mapInArrow(_confirm, "a long, b long").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(rep, component): the smallest node that each node of an edge reaches, by alternating large-star and small-star steps until nothing changes."""
    edges = settled(edges.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).where("low < high").distinct())
    few, before = max(16, edges.count() // 20_000), None  # a round never has more edges than the one before
    while True:
        both = edges.unionByName(edges.select(F.col("high").alias("low"), F.col("low").alias("high")))
        least = both.groupBy("low").agg(F.min("high").alias("least")).withColumn("least", F.least("low", "least"))
        large = both.join(least, "low").where("high > low").select(F.col("least").alias("low"), "high").where("low < high").coalesce(few).distinct()
        least = large.groupBy("high").agg(F.min("low").alias("least"))
        small = large.join(least, "high").select(F.explode(F.array("low", "high")).alias("high"), F.col("least").alias("low")).where("low < high")
        edges = checkpointed(small.select("low", "high").coalesce(few).distinct().coalesce(few))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first()
        if now == before:
            return settled(edges.groupBy(F.col("high").alias("rep")).agg(F.min("low").alias("component")))
        before = now


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, node, n_shingles, component), one per row of docs."""
    rows = checkpointed(signed(docs))
    known = rows.where(F.col("sign").isNotNull())
    nodes = settled(known.groupBy("digest").agg(F.min("node").alias("rep"), F.first("sign").alias("sign"), F.first("n_shingles").alias("n")))
    owned = known.join(nodes.select("digest", "rep"), "digest").select("node", "rep")
    repeated = owned.groupBy("node").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("a", "b")
    placed = settled(regions(nodes))

    pairs = settled(neighbours(placed, nodes))
    links = settled(confirmed(pairs.where(F.col("tree") < LEADING).select("a", "b"), docs).unionByName(repeated))
    components = connected(links)
    links = links.unionByName(settled(confirmed(settled(parted(pairs.where(F.col("tree") >= LEADING), components)), docs)))
    components = connected(links)

    groups, large = deepened(settled(mixed(_named(placed, components, "rep", "component"), REGION)), nodes)
    more = settled(met(settled(groups), nodes, docs))
    if more.limit(1).count():
        links = links.unionByName(more)
        components = connected(links)
    if large.limit(1).count():
        components = connected(links.unionByName(settled(rest(large, components, nodes, docs))))

    told = _named(owned, components, "rep", "component").groupBy("node").agg(F.min("component").alias("component"))
    return rows.drop("sign").join(told, "node", "left").withColumn("component", F.coalesce("component", "node"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one per row of docs."""
    return _rows(docs).select("doc_id", "n_shingles", F.when(F.col("component") < NO_ID, F.col("component")).alias("component_id"), (F.col("node") == F.col("component")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near duplicates: the row of the smallest id, once; of rows without an id, one. docs' columns may have any names."""
    rows = _rows(docs).select(F.col("doc_id").alias("_own_id"), F.col("digest").alias("_own_digest"), (F.col("node") == F.col("component")).alias("_kept"))
    said = rows.groupBy("_own_id", "_own_digest").agg(F.min("_kept").alias("_kept"), F.count("*").alias("_rows")).where("not _kept or _rows > 1")
    own, names = plain(docs)
    digest = F.unhex(F.sha2(F.coalesce(F.col(names["text"]).cast("string"), F.lit("")), 256))
    told = own.withColumn("_id", F.col(names["doc_id"]).cast("long")).withColumn("_digest", digest)
    told = told.join(small_side(said), F.col("_id").eqNullSafe(F.col("_own_id")) & (F.col("_digest") == F.col("_own_digest")), "left")
    once = told.where("_kept").dropDuplicates(["_id", "_digest"])
    return told.where("_kept is null").unionByName(once).select(*names.values()).toDF(*docs.columns)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of near duplicates."""
    return near_duplicates(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, k FROM (
  SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT m.doc_id, coalesce(n, 0) AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""
