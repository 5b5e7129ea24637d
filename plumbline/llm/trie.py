"""Prefix trie of conversations: one row per distinct sequence of first turns.

A turn is told by the first ``WIDTH`` bytes of the SHA-256 of its role and text,
and a conversation is a key: those bytes, turn by turn. The keys are sorted over
the whole cluster, ties by conv_id, and stay in their partitions (``laid_out``).
A node of the trie is an interval of this order: the conversations that begin
with its turns. Within a partition (``Minima``, ``_Part``), the lengths of the
longest common prefixes of neighbours get a sparse table of range minima, and
every candidate prefix finds its left and its right extent by binary search in
it, on its own, for all prefixes at once. Members, smallest ids, leaves and saved
tokens are then sums and minima over intervals.

Equal keys are dealt by conv_id, so a large group of copies, or of conversations
with one first turn, is spread over partitions. A node that meets the border of
its partition is open there: each partition gives its share, and the shares, as
many as partitions have turns at their borders, are added up (``_merged``). Only
two numbers for each border go to the driver: the turns that the conversations
on its sides have in common. The ids of an open node's members stream through
one task in order, in pieces of ``IDS``, since a digest is sequential.

Memory of a task: the digests of one partition, 16 bytes a turn. A conversation
is not split, and passes through one task with 24 bytes a turn.

Edge cases: turns are ordered by (turn, role, digest), nulls first; null roles
and texts are empty; rows without conv_id belong to no conversation; repeated
rows are turns of their own; an empty table has no conversations, hence no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import checkpointed, read, small_side

WIDTH, IDS, ROWS = 16, 4096, 50_000
NOBODY = hashlib.sha256(b"").hexdigest()
MEASURES = ("n_convs", "n_children", "n_leaves", "saved_tokens")


def conversations_of(turns: DataFrame) -> DataFrame:
    """(base, conv_id, turns): one row per conversation, its turns as structs (digest, bytes) in order. ``turns``: base, conv_id, turn, role, text.

    ``base`` parts the rows: conversations of one base come together in one partition.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, WIDTH)
    turn = F.col("turn").cast("long")
    one = F.struct(turn.isNotNull().alias("known"), turn.alias("turn"), role.alias("role"), digest.alias("digest"), F.octet_length(text).alias("bytes"))
    rows = turns.where(F.col("conv_id").isNotNull()).select("base", "conv_id", one.alias("one")).repartition("base")
    told = rows.groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("one")).alias("ones"))
    return told.select("base", "conv_id", F.transform("ones", lambda x: F.struct(x["digest"].alias("digest"), x["bytes"].alias("bytes"))).alias("turns"))


def laid_out(conversations: DataFrame) -> DataFrame:
    """(pid, conv_id, key, sizes) of conversations (conv_id, turns), sorted by key and conv_id over all partitions, numbered pid in this order."""
    key = F.unhex(F.array_join(F.transform("turns", lambda x: F.hex(x["digest"])), ""))
    keyed = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), key.alias("key"), F.transform("turns", lambda x: x["bytes"]).alias("sizes"))
    ordered = keyed.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    return checkpointed(ordered.select(F.spark_partition_id().alias("pid"), "conv_id", "key", "sizes"))


def _common(a: Column, b: Column) -> Column:
    """How many turns two keys begin with alike."""
    turns = F.least(F.octet_length(a), F.octet_length(b)) / WIDTH
    part = lambda c, i: F.substring(c, (i - 1) * WIDTH + 1, F.lit(WIDTH))
    first = F.array_min(F.filter(F.sequence(F.lit(1), turns.cast("int")), lambda i: part(a, i) != part(b, i)))
    return F.when(turns < 1, 0).otherwise(F.coalesce(first - 1, turns)).cast("int")


def borders(placed: DataFrame) -> dict[int, tuple[int, int]]:
    """For each partition, the turns that its first conversation shares with the one before, and its last with the one after; -1 where there is none."""
    ends = placed.groupBy("pid").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    order = Window.orderBy("pid")
    ends = ends.select("pid", "first", "last", F.lag("last").over(order).alias("prior"), F.lead("first").over(order).alias("next"))
    shared = lambda a, b, other: F.when(F.col(other).isNull(), -1).otherwise(_common(F.col(a), F.col(b)))
    told = ends.select("pid", shared("prior", "first", "prior").alias("before"), shared("last", "next", "next").alias("after"))
    return {r.pid: (r.before, r.after) for r in told.toLocalIterator()}


class Minima:
    """Range minima of an array by a sparse table: the minima of all stretches of 1, 2, 4, ... places."""

    def __init__(self, values: np.ndarray):
        self.n, self.levels = len(values), [values]
        while 2 << (len(self.levels) - 1) <= self.n:
            half = 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(self.levels[-1][:-half], self.levels[-1][half:]))

    def over(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The minima over left .. right, both inclusive: of the two longest stretches that cover them."""
        out = np.empty(len(left), self.levels[0].dtype)
        level = np.frexp(right - left + 1)[1] - 1
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.levels[k][left[at]], self.levels[k][right[at] + 1 - (1 << k)])
        return out

    def rightmost(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """For each place the last r so that all of at + 1 .. r are ``least`` or more."""
        out = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            ahead = out + (1 << k)
            go = ahead < self.n
            go[go] = self.levels[k][out[go] + 1] >= least[go]
            out = np.where(go, ahead, out)
        return out

    def leftmost(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """For each place the first l so that all of l + 1 .. at are ``least`` or more."""
        out = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            back = out - (1 << k)
            go = back >= 0
            go[go] = self.levels[k][back[go] + 1] >= least[go]
            out = np.where(go, back, out)
        return out


def common_prefixes(turns: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each row the turns that it shares with the row before; 0 for the first. Row i has turns offsets[i] .. offsets[i + 1] - 1."""
    size = np.diff(offsets)
    common = np.minimum(size[1:], size[:-1])
    row = np.repeat(np.arange(1, len(size)), common)
    k = np.arange(len(row)) - np.repeat(np.cumsum(common) - common, common)
    differ = np.flatnonzero(turns[offsets[row] + k] != turns[offsets[row - 1] + k])
    out = np.concatenate([[0], common]).astype(np.int64)
    rows, first = np.unique(row[differ], return_index=True)
    out[rows] = k[differ[first]]
    return out


class _Part:
    """The nodes of one partition: ``ids``, turns (as bytes of WIDTH) and their sizes, row by row in order; ``before`` and ``after`` as ``borders`` has them."""

    def __init__(self, ids: np.ndarray, turns: np.ndarray, sizes: np.ndarray, offsets: np.ndarray, before: int, after: int):
        n, length = len(ids), np.diff(offsets)
        shared = common_prefixes(turns, offsets)
        told = shared.copy()
        told[0] = max(before, 0)
        summed = np.concatenate([[0], np.cumsum(sizes)])
        upto = lambda row, depth: summed[offsets[row] + depth] - summed[offsets[row]]  # noqa: E731  bytes of a row's first turns
        start = shared.copy()
        start[0] = -1
        base = np.concatenate([[0], np.cumsum(length - start)])
        at = np.repeat(np.arange(n), length - start)
        depth = start[at] + 1 + np.arange(base[-1]) - base[at]
        minima = Minima(shared)
        left, right = minima.leftmost(at, depth), minima.rightmost(at, depth)
        up = minima.leftmost(at, depth - 1)
        self.parent = np.where(depth > 0, base[up] + depth - 2 - start[up], -1)
        self.at, self.depth, self.left, self.right, self.ids, self.turns, self.offsets, self.length = at, depth, left, right, ids, turns, offsets, length
        self.came, self.goes = (at == 0) & (depth <= before), (right == n - 1) & (depth <= after)
        self.open = self.came | self.goes
        self.smallest = Minima(ids).over(left, right)
        own = upto(at, np.maximum(depth - 1, 0))
        again = np.concatenate([[0], np.cumsum(upto(np.arange(n), told))])
        saved = again[right + 1] - again[left + 1] - (right - left) * own + np.where(self.came, upto(0, told[0]) - own, 0)
        ends = np.concatenate([[0], np.cumsum(np.append(shared[1:], after) < length)])
        child = self.parent[(depth > 0) & ~self.came]
        self.measures = right - left + 1, np.bincount(child, minlength=len(at)), ends[right + 1] - ends[left], saved
        alike = (np.append(-1, length[:-1]) == length) & (shared == length)
        alike[0] = False
        heads = np.flatnonzero(~alike)
        self.stop = np.zeros(n, np.int64)
        self.stop[heads] = np.append(heads[1:], n)

    def members(self, node: int) -> np.ndarray:
        """The ids of the conversations that end at a node."""
        row = self.left[node]
        return self.ids[row : self.stop[row]] if self.length[row] == self.depth[node] else self.ids[:0]

    def keys(self, nodes: np.ndarray) -> dict[int, bytes]:
        """Digests of the prefixes of open nodes, which are prefixes of the first or of the last row."""
        out, want = {}, {}
        for node in nodes.tolist():
            want.setdefault(int(0 if self.came[node] else len(self.ids) - 1), {})[int(self.depth[node])] = node
        for row, depths in want.items():
            digest = hashlib.sha256()
            for depth in range(max(depths) + 1):
                if depth:
                    digest.update(self.turns[self.offsets[row] + depth - 1].tobytes())
                if depth in depths:
                    out[depths[depth]] = digest.digest()
        return out


NODES = "pid int, node binary, piece int, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
_KINDS = [pa.int32(), pa.binary(), pa.int32(), pa.binary(), *[pa.int64()] * 7, pa.string()]
_NAMES = [x.split()[0] for x in NODES.split(", ")]


def _said(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


def _read(batches: Iterator[pa.RecordBatch], border: dict[int, tuple[int, int]]) -> tuple[int, _Part] | None:
    """The partition that these batches make up."""
    table = pa.Table.from_batches([b for b in batches if b.num_rows])
    if not table.num_rows:
        return None
    pid, ids = table.column("pid")[0].as_py(), table.column("conv_id").to_numpy()
    keys = table.column("key").cast(pa.large_binary()).combine_chunks()
    keys = keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys
    places = np.frombuffer(keys.buffers()[1], np.int64, len(keys) + 1 + keys.offset)[keys.offset :]
    data = np.frombuffer(keys.buffers()[2] or b"", np.uint8)[places[0] : places[-1]]
    sizes = np.concatenate([np.zeros(0, np.int64), *[c.flatten().to_numpy().astype(np.int64) for c in table.column("sizes").chunks]])
    return pid, _Part(ids, data.view(f"V{WIDTH}") if len(data) else np.zeros(0, f"V{WIDTH}"), sizes, (places - places[0]) // WIDTH, *border[pid])


def _nodes(border: dict[int, tuple[int, int]], opened: bool):
    """The open nodes of each partition, with the ids of their members in pieces, or the others, with their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        pid, part = _read([first, *batches], border)
        up = part.parent
        above = np.where(up >= 0, part.open[up], False)  # whose parent is open
        which = np.flatnonzero(part.open if opened else ~part.open)
        for lo in range(0, len(which), ROWS):
            some = which[lo : lo + ROWS]
            outer = np.unique(up[some][above[some]])
            key = part.keys(np.union1d(outer, some) if opened else outer)
            mothers = [key[p] if a else None for p, a in zip(up[some].tolist(), above[some].tolist())]
            closed = [None if a or p < 0 else int(part.smallest[p]) for p, a in zip(up[some].tolist(), above[some].tolist())]
            n, none = len(some), pa.nulls
            if opened:
                ends, own = none(n, pa.string()), pa.array([key[i] for i in some.tolist()], pa.binary())
            else:
                ids = (part.members(i) for i in some.tolist())
                ends, own = pa.array([hashlib.sha256(_said(x).encode()).hexdigest() if len(x) else NOBODY for x in ids], pa.string()), none(n, pa.binary())
            numbers = [part.smallest[some], part.depth[some]], [m[some] for m in part.measures]
            columns = [np.full(n, pid), own, np.zeros(n, int), pa.array(mothers, pa.binary()), *numbers[0], pa.array(closed, pa.int64()), *numbers[1], ends]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, _KINDS)], _NAMES)
            for i in some.tolist() if opened else ():
                ids = part.members(i)
                for k, at in enumerate(range(0, len(ids), IDS), 1):
                    row = [pid, key[i], k, *[None] * 8, _said(ids[at : at + IDS])]
                    yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, _KINDS)], _NAMES)

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shares of open nodes added up; they come node by node, partition by partition."""

    def row():
        return [None, now, 0, mother, smallest, depth, None, *sums, digest.hexdigest()]

    now = None
    for batch in batches:
        done = []
        for r in batch.to_pylist():
            if r["node"] != now:
                if now is not None:
                    done.append(row())
                now, mother, smallest, depth = r["node"], r["parent"], r["conv_id"], r["depth"]
                sums, digest, joint = [0] * len(MEASURES), hashlib.sha256(), ""
            if r["ends"] is None:
                smallest, sums = min(smallest, r["conv_id"]), [s + r[m] for s, m in zip(sums, MEASURES)]
            else:
                digest.update((joint + r["ends"]).encode())
                joint = ","
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done) if done else [[]] * len(_KINDS), _KINDS)], _NAMES)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row(), _KINDS)], _NAMES)


def nodes(conversations: DataFrame) -> DataFrame:
    """All nodes of the trie of conversations (conv_id, turns), each with its smallest member as conv_id and the measures of its interval."""
    placed = laid_out(conversations)
    border = borders(placed)
    closed = placed.mapInArrow(_nodes(border, False), NODES)
    shares = checkpointed(placed.mapInArrow(_nodes(border, True), NODES))
    merged = checkpointed(shares.repartition("node").sortWithinPartitions("node", "pid", "piece").mapInArrow(_add, NODES))
    own = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("outer"))
    here = shares.where("piece = 0").select("pid", F.col("node").alias("parent")).join(own, "parent")
    closed = closed.join(small_side(here), ["pid", "parent"], "left")
    out = ["conv_id", "depth", F.coalesce("parent_conv_id", "outer").alias("parent_conv_id"), *MEASURES, F.col("ends").alias("ends_sha256")]
    return closed.select(out).unionByName(merged.join(own, "parent", "left").select(out))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt so that it begins with turns of the one its number is rounded down to."""
    given = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    told = conversations_of(given.withColumn("base", F.expr("conv_id - conv_id % 5")))
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, 8))).over(Window.partitionBy("base"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    none = F.slice("turns", 1, 0)
    rebuilt = F.concat(F.slice(F.coalesce(head, none), F.lit(1), h), F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0))))
    return nodes(told.select("conv_id", rebuilt.alias("turns")))


ORACLE = r"""
WITH t0 AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::UBIGINT, list_transform(range(8), lambda z: z::UBIGINT)), lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END)) AS t),
g AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({d: left(sha256(strlen(role)::VARCHAR || ':' || role || text), 32), b: strlen(text)::BIGINT} ORDER BY turn NULLS FIRST, role, left(sha256(strlen(role)::VARCHAR || ':' || role || text), 32)) AS l FROM g GROUP BY conv_id),
h AS (SELECT conv_id, l, (xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ord(s)::UBIGINT)), lambda x, b: xor(x // 256, t[(xor(x, b) % 256)::INT + 1])), 4294967295::UBIGINT) % 9)::INT AS h FROM c, t0),
r AS (SELECT a.conv_id, list_concat(coalesce(b.l[1:a.h], []), a.l[a.h + 1:]) AS l FROM h a LEFT JOIN h b ON b.conv_id = a.conv_id - a.conv_id % 5),
p AS (SELECT conv_id, len(l) AS n, unnest(range(len(l) + 1)) AS depth, list_transform(l, lambda x: x.d) AS ds, l FROM r),
q AS (SELECT conv_id, n, depth, array_to_string(ds[1:depth], '') AS node, array_to_string(ds[1:depth - 1], '') AS up, CASE WHEN depth = 0 THEN 0 ELSE l[depth].b END AS bytes FROM p),
v AS (SELECT node, depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS own, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth) AS ends FROM q GROUP BY node, depth),
k AS (SELECT up, count(*) AS n_children FROM v WHERE depth > 0 GROUP BY up),
w AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN k ON k.up = v.node),
s AS (SELECT left(node, 32 * d) AS top, count(*) FILTER (n_children = 0) AS n_leaves, sum(own) AS saved FROM (SELECT node, n_children, own, unnest(range(depth + 1)) AS d FROM w) GROUP BY top)
SELECT w.conv_id, w.depth, m.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, cast(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(w.ends, '')) AS ends_sha256
FROM w JOIN s ON s.top = w.node LEFT JOIN v m ON w.depth > 0 AND m.node = w.up
"""
