"""Chat formatting by prefix-target expansion.

Every turn becomes a segment ``[INST]role[/INST]text</s>``; the formatted
conversation is its segments in order (``formatted``). Every assistant turn is
an example of its own (``examples``): the context is all that precedes it, the target is its
text, and only the target is trainable. All examples of a conversation are
prefixes of one formatted text, so an example is kept as places in it
(``context_chars`` and the target's span) instead of as a copy: expanding a
conversation of n turns costs n rows, not n squared texts. ``prompts`` spells
the contexts out for those conversations that a caller picks.

Inside roles and texts a backslash is doubled, and one is put after the first
character of every control string, so that no control string stands in them.
``unescape`` undoes both. ``read_back`` parses the formatted texts by their
control strings alone, and takes the loss mask from the examples' spans; it
fails where a span isn't the text of an assistant's turn, where its context is
not all that precedes the turn, or where such a turn has no example.

Edge cases: null roles and texts are empty; turns are ordered by (turn, role,
text), nulls first; repeated turns all stay; rows whose conv_id is null form one
conversation; a conversation without assistant turns has no example and an empty
loss text; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import read

CONTROLS = ("</s>", "<s>", "[INST]", "[/INST]")
OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
TARGET = "assistant"
_ESCAPED = re.compile(r"\\(\\?)", re.S)
_TURN = re.compile(r"\[INST\](.*?)\[/INST\](.*?)</s>", re.S)


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for control in CONTROLS:
        out = F.replace(out, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return out


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def formatted(conversations: DataFrame) -> DataFrame:
    """One row per turn: its segment, where it starts in the formatted conversation, and the span of its text there if it is a target (else null)."""
    role, text = escape(F.col("role")), escape(F.col("text"))
    head = F.concat(F.lit(OPEN), role, F.lit(CLOSE))
    target = F.coalesce(F.col("role") == TARGET, F.lit(False))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
        F.concat(head, text, F.lit(END)).alias("segment"), F.when(target, F.length(head).cast("long")).alias("head"), F.when(target, F.length(text).cast("long")).alias("size"),
    )
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "segment").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("starts", F.coalesce(F.sum(F.length("segment").cast("long")).over(before), F.lit(0).cast("long")))
    return placed.select("conv_id", "turn", "starts", "segment", (F.col("starts") + F.col("head")).alias("target_from"), (F.col("starts") + F.col("head") + F.col("size")).alias("target_to"))


def expanded(rows: DataFrame) -> DataFrame:
    """The examples in formatted conversations: one row per target, with the length of its context and its span."""
    return rows.where(F.col("target_from").isNotNull()).select("conv_id", "turn", F.col("starts").alias("context_chars"), "target_from", "target_to")


def examples(conversations: DataFrame) -> DataFrame:
    """One row per assistant turn: how long its context is, and where its target lies in the formatted conversation."""
    return expanded(formatted(conversations))


def prompts(conversations: DataFrame) -> DataFrame:
    """The examples with their contexts spelt out. Its size is quadratic in the turns of a conversation: for picked conversations."""
    before = Window.partitionBy("conv_id").orderBy("starts").rowsBetween(Window.unboundedPreceding, -1)
    rows = formatted(conversations).withColumn("context", F.array_join(F.collect_list("segment").over(before), ""))
    part = lambda a, b: F.substring(F.col("segment"), (F.col(a) - F.col("starts") + 1).cast("int"), (F.col(b) - F.col(a)).cast("int"))
    return rows.where(F.col("target_from").isNotNull()).select("conv_id", "turn", "context", part("starts", "target_from").alias("cue"), part("target_from", "target_to").alias("target"))


class _Reader:
    """Reads one formatted conversation, given in pieces of any length, and its examples, each when the text up to its target's end has come."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss = conv_id, hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = self.examples = self.targets = 0
        self.rest, self.last = "", (0, 0, 0, "", "")

    def text(self, piece: str) -> None:
        self.rest += piece
        done = 0
        for turn in _TURN.finditer(self.rest):
            if turn.start() != done:
                raise ValueError(f"conversation {self.conv_id}: text outside of turns")
            done = turn.end()
            role, text = map(unescape, turn.groups())
            self.n += 1
            self.targets += role == TARGET
            self.turns.update(f"{role}\n{text}\n".encode())
            self.last = self.chars + turn.start(), self.chars + turn.start(2), self.chars + turn.end(2), role, turn.group(2)
        self.chars += done
        self.rest = self.rest[done:]

    def example(self, context: int, begin: int, end: int) -> None:
        opens, start, stop, role, text = self.last
        if (context, begin, end, role) != (opens, start, stop, TARGET):
            raise ValueError(f"conversation {self.conv_id}: an example isn't an assistant's text after all that precedes its turn")
        trained = unescape(text)
        self.loss.update(trained.encode())
        self.loss_chars += len(trained)
        self.examples += 1

    def row(self) -> tuple:
        if self.rest or self.examples != self.targets:
            raise ValueError(f"conversation {self.conv_id}: a turn is cut off or has no example")
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.examples


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in DIGEST.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names)

    now = None
    for b in batches:
        done = []
        for conv_id, piece, context, begin, end in zip(*(b.column(c).to_pylist() for c in ("conv_id", "piece", "context_chars", "target_from", "target_to"))):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    done.append(now.row())
                now = _Reader(conv_id)
            if piece is not None:
                now.text(piece)
            else:
                now.example(context, begin, end)
        yield batch(done)
    if now is not None:
        yield batch([now.row()])


def read_back(rows: DataFrame) -> DataFrame:
    """Reads formatted conversations and their examples back. ``rows``: as ``formatted`` gives them, each conversation in one partition.

    Each streams through its task in order, one turn in memory, whatever its length: a digest is sequential.
    """
    none, places = F.lit(None).cast("long"), ("context_chars", "target_from", "target_to")
    text = F.struct(F.lit(0).alias("kind"), F.col("segment").alias("piece"), *[none.alias(c) for c in places])
    told = F.struct(F.lit(1).alias("kind"), F.lit(None).cast("string").alias("piece"), F.col("starts").alias("context_chars"), "target_from", "target_to")
    entries = rows.select("conv_id", "starts", F.explode(F.when(F.col("target_from").isNull(), F.array(text)).otherwise(F.array(text, told))).alias("entry"))
    ordered = entries.select("conv_id", "starts", "entry.*").sortWithinPartitions("conv_id", "starts", "kind")
    return ordered.select("conv_id", "piece", *places).mapInArrow(_read, DIGEST)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are control strings, formatted, expanded and read back."""
    hard = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(TARGET).alias("role"), F.lit(hard).alias("text"))
    given = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(formatted(given.unionByName(extra)))


ORACLE = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
formatted AS (
  SELECT *, '[INST]' || role || '[/INST]' || replace(replace(replace(replace(replace(text, '\', '\\'), '</s>', '<\/s>'), '<s>', '<\s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]') || '</s>' AS segment FROM given)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, segment)) AS turns_sha256,
  cast(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, segment) FILTER (role = 'assistant'), '')) AS loss_sha256,
  cast(sum(length(segment)) AS BIGINT) AS formatted_chars,
  count(*) FILTER (role = 'assistant') AS n_examples
FROM formatted GROUP BY conv_id
"""
