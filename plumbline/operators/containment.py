"""Containment join: which texts hold which others, by an index of substrings instead of all pairs of a group.

A text that holds another holds all substrings of it. So every text that may hold
others gives its substrings of up to ``GRAM`` characters, and one that may be
held is looked up by the rarest of its own: an equi-join on (key, substring).
What it finds is tested in full. A text of fewer characters than ``GRAM`` is its
own substring; the empty text is held by all texts of its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def _grams(text: Column, size: Column) -> Column:
    """The distinct substrings of ``size`` characters, of which text has as many at least; of 0 characters, the empty one."""
    places = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(size == 0, F.array(F.lit(""))).otherwise(F.array_distinct(F.transform(places, lambda i: F.substring(text, i, size))))


def holders(needles: DataFrame, hays: DataFrame, key: list[str], needle: str, hay: str) -> DataFrame:
    """(key, needle, hay): all pairs of one key whose hay contains the needle, each once; nulls are in none.

    Repeated texts of a key are looked up once, so the result is of texts, to be joined to their rows.
    """
    sought = needles.where(F.col(needle).isNotNull()).select(*key, F.col(needle).alias("_needle")).distinct()
    given = hays.where(F.col(hay).isNotNull()).select(*key, F.col(hay).alias("_hay")).distinct()
    sizes = F.sequence(F.lit(0), F.least(F.lit(GRAM), F.length("_hay")))
    index = given.select(*key, "_hay", F.explode(F.flatten(F.transform(sizes, lambda n: _grams(F.col("_hay"), n)))).alias("_gram"))
    counts = index.groupBy(*key, "_gram").agg(F.count("*").alias("_many"))
    own = sought.select(*key, "_needle", F.explode(_grams(F.col("_needle"), F.least(F.lit(GRAM), F.length("_needle")))).alias("_gram"))
    ranked = own.join(counts, [*key, "_gram"], "left")
    rarest = ranked.groupBy(*key, "_needle").agg(F.min(F.struct(F.coalesce("_many", F.lit(0)).alias("many"), F.col("_gram").alias("gram"))).alias("_key"))
    probes = rarest.where("_key.many > 0").select(*key, "_needle", F.col("_key.gram").alias("_gram"))
    return probes.join(index, [*key, "_gram"]).where(F.contains("_hay", "_needle")).select(*key, F.col("_needle").alias(needle), F.col("_hay").alias(hay))


def either_holds(left: DataFrame, right: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """(key, a, b): all pairs of one key of which one contains the other, each once."""
    return holders(left, right, key, a, b).unionByName(holders(right, left, key, b, a)).distinct()
