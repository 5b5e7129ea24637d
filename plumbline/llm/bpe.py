"""Byte-level BPE encoding and decoding.

Each match of the pre-tokenizer's pattern is a piece, encoded on its own. Its
bytes, read as Latin-1, run through an Aho-Corasick automaton of the vocabulary;
the longest matches from left to right are the first try. A sequence of tokens
is what the merges give exactly if every two neighbours are *compatible*, i.e.
if merging their joined bytes gives just these two. Compatibility is memoised,
so that a piece costs a few look-ups; where neighbours don't agree, the search
backtracks: it tries the next shorter token at that place, and places from which
no token goes on are marked dead, so that no place is tried twice and the time
is linear in the piece. Tokens that no merges produce (the piece as a whole
still gives them, as a look-up) are left out of the automaton.

The vocabulary is read on the executors from its installed file; only the path
travels. Memos are bounded; they are an optimisation and change no result.

Edge cases: a null text encodes as the empty text (no ids); texts of any length
are encoded whole; repeated rows are encoded each.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .tables import read

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
MEMO = 200_000
SHORT = 48  # pieces up to this many characters are memoised


NEVER = 1 << 60
PLAIN = 0x250
_BEYOND = re.compile(f"[^\\x00-{chr(PLAIN - 1)}]").search


def _ranged(pattern: str) -> str:
    """The pattern with its Unicode classes spelt out up to U+024F, for the faster engine that has no such classes."""
    held = lambda test: "".join(re.escape(chr(c)) for c in range(PLAIN) if test(chr(c)))
    letters, numbers = (held(lambda c, k=kind: unicodedata.category(c)[0] == k) for kind in "LN")
    spaces = held(lambda c: regex.match(r"\s", c) is not None)
    pattern = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
    return pattern.replace(r"\S", f"[^{spaces}]").replace(r"\s", f"[{spaces}]")


class Bpe:
    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as file:
            pairs = [line.split() for line in file if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self._any = regex.compile(pattern).findall
        self._plain = re.compile(_ranged(pattern)).findall
        self.automaton = ahocorasick.Automaton()
        made = {t: r for t, r in self.ranks.items() if len(t) == 1 or self.merged(t) == [r]}
        for token, rank in made.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        top = max(self.tokens) + 1
        self.lengths = [len(self.tokens.get(rank, b"")) for rank in range(top)]
        self.shorter = [-1] * top  # the longest token that a token goes on from
        for token, rank in made.items():
            self.shorter[rank] = next((made[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in made), -1)
        self._pairs: dict[int, bool] = {}
        self._ends: tuple[dict[int, list[int]], dict[int, list[int]]] = ({}, {})
        self._known: dict[str, tuple[int, str, bytes]] = {}

    def pieces(self, text: str) -> list[str]:
        return self._plain(text) if not _BEYOND(text) else self._any(text)

    def merged(self, data: bytes) -> list[int]:
        """The merges carried out one by one, lowest rank first: the definition."""
        return [self.ranks[p] for p in self._merge(data)[0]]

    def _merge(self, data: bytes) -> tuple[list[bytes], tuple[bytes, bytes] | None]:
        """The parts that all merges leave, and the two that the last merge joined."""
        parts, joined = [data[i : i + 1] for i in range(len(data))], None
        while len(parts) > 1:
            rank, at = min([(self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1)])
            if rank == NEVER:
                break
            joined = parts[at], parts[at + 1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, joined

    def _grown(self, token: int, side: int) -> list[int]:
        """What stands at the right (1) or left (0) end of a token while it is merged, from one byte to the whole."""
        memo = self._ends[side]
        if token not in memo:
            _, joined = self._merge(self.tokens[token])
            memo[token] = [*self._grown(self.ranks[joined[side]], side), token] if joined else [token]
        return memo[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of two tokens gives just these two: at no time may the ends that meet be the next to merge."""
        key = left << 32 | right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > 2 * MEMO:
                self._pairs.clear()
            known = self._pairs[key] = self._apart(self._grown(left, 1), self._grown(right, 0))
        return known

    def _apart(self, left: list[int], right: list[int]) -> bool:
        i = j = 0
        while True:
            grow_left = left[i + 1] if i + 1 < len(left) else NEVER
            grow_right = right[j + 1] if j + 1 < len(right) else NEVER
            cross = self.ranks.get(self.tokens[left[i]] + self.tokens[right[j]], NEVER)
            if cross < grow_left and cross <= grow_right and cross < NEVER:  # of equal merges, the leftmost goes first
                return False
            if grow_left == grow_right == NEVER:
                return True
            if grow_left <= grow_right:
                i += 1
            else:
                j += 1

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        text = data.decode("latin-1")
        greedy = [token for _, token in self.automaton.iter_long(text)]
        pairs, last = self._pairs, greedy[0]
        for k in range(1, len(greedy)):
            token = greedy[k]
            ok = pairs.get(last << 32 | token)
            if not (self.compatible(last, token) if ok is None else ok):
                return self._backtrack(text, greedy[:k], token)
            last = token
        return greedy

    def _backtrack(self, text: str, chosen: list[int], token: int) -> list[int]:
        """Depth first over the tokens that start at each place, longest first, from a good beginning and the token that doesn't go with it."""
        lengths, shorter, pairs, longest = self.lengths, self.shorter, self._pairs, self.automaton.iter_long
        dead: set[int] = set()
        at, last, n = sum([lengths[t] for t in chosen]), chosen[-1], len(text)
        token = shorter[token]
        while True:
            while token >= 0:
                if not dead or at + lengths[token] not in dead:
                    if last < 0:
                        break
                    ok = pairs.get(last << 32 | token)
                    if self.compatible(last, token) if ok is None else ok:
                        break
                token = shorter[token]
            if token >= 0:
                chosen.append(token)
                at += lengths[token]
                if at == n:
                    return chosen
                last = token
                token = next(longest(text, at))[1]
            else:
                dead.add(at)
                back = chosen.pop()
                at -= lengths[back]
                last = chosen[-1] if chosen else -1
                token = shorter[back]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def _piece(self, piece: str) -> tuple[list[int], str, bytes]:
        """Of a piece: the ids, the ids in decimals, and the bytes that the ids stand for."""
        ids = self.encode_piece(piece.encode())
        known = (ids, ",".join(map(str, ids)), self.decode(ids))
        if len(piece) <= SHORT:
            if len(self._known) >= MEMO:
                self._known.clear()
            self._known[piece] = known
        return known

    def encode(self, text: str) -> list[int]:
        return [token for piece in self.pieces(text) for token in self.encode_piece(piece.encode())]

    def digest(self, text: str) -> tuple[list[list[int]], str, str]:
        """The ids of each piece, digest of the ids, digest of the bytes they decode to."""
        get, make = self._known.get, self._piece
        pieces, ids, back = zip(*[get(p) or make(p) for p in self.pieces(text)]) if text else ((), (), ())
        return pieces, hashlib.sha256(",".join(ids).encode()).hexdigest(), hashlib.sha256(b"".join(back)).hexdigest()


@lru_cache(maxsize=4)
def bpe(path: str) -> Bpe:
    return Bpe(path)


def vocabulary(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)


def encode(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """docs with a column ``ids``: the token ids of the whole text."""
    path = path or vocabulary()
    schema = docs.drop("ids").schema.add("ids", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = bpe(path)
            ids = [model.encode(x or "") for x in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], [*batch.schema.names, "ids"])

    return docs.drop("ids").mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """encoded with a column ``bytes``: what the ids stand for."""
    path = path or vocabulary()
    schema = encoded.drop("bytes").schema.add("bytes", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = bpe(path)
            data = [model.decode(x or []) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], [*batch.schema.names, "bytes"])

    return encoded.drop("bytes").mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: number of ids, digest of the ids and of what they decode to, without moving the ids themselves."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = bpe(path)
            done = [model.digest(x.as_py() or "") for x in batch.column(1)]
            pieces, ids, back = zip(*done) if done else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sum(map(len, x)) for x in pieces], pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenized(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with ``ids``, ``n_tokens`` and the digests of the ids and of what they decode to (columns of these names are replaced)."""
    path, added = path or vocabulary(), {"ids": ArrayType(IntegerType()), "n_tokens": LongType(), "ids_sha256": StringType(), "decoded_sha256": StringType()}
    own = docs.drop(*added)
    place = own.columns.index("text")
    schema = StructType([*own.schema.fields, *(StructField(name, kind) for name, kind in added.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = bpe(path)
            done = [model.digest(x or "") for x in batch.column(place).to_pylist()]
            pieces, said, back = zip(*done) if done else ([], [], [])
            ids = [[token for piece in x for token in piece] for x in pieces]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64()), pa.array(said, pa.string()), pa.array(back, pa.string())], schema.names)

    return own.mapInArrow(run, schema)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return round_trip(read(spark, sf_dir, "documents"))
