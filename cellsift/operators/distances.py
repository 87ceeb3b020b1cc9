"""Distances between the distinct values of attributes, in full or up to a threshold, and for a delta only."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellsift.functions.values import distance, key, strip
from cellsift.plans.constraints import INT, STRING
from cellsift.plans.strategy import tasks


def distinct_values(df: DataFrame, attr: str) -> DataFrame:
    """value: the attribute's distinct values, stripped, without nulls."""
    return df.select(strip(F.col(f"`{attr}`").cast("string")).alias("value")).where("value is not null").distinct()


def _measured(pairs: DataFrame, attr: str, kind: str) -> DataFrame:
    d = F.when(F.col("v1") == F.col("v2"), F.lit(0)).otherwise(distance(key(F.col("v1"), kind), key(F.col("v2"), kind), kind))
    return pairs.select(F.lit(attr).alias("attr"), "v1", "v2", d.cast("bigint").alias("dist"))


def _sides(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    return a.select(F.col("value").alias("v1")), b.select(F.col("value").alias("v2"))


def value_distances(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """attr, v1, v2, dist for every unordered pair of an attribute's distinct values, v1 <= v2, the diagonal included."""
    parts = []
    for attr, kind in kinds.items():
        left, right = _sides(v := distinct_values(df, attr), v)
        parts.append(_measured(left.join(right, F.col("v1") <= F.col("v2")), attr, kind))
    return reduce(DataFrame.unionByName, parts)


def delta_distances(base: DataFrame, delta: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """The rows that a delta adds to value_distances(base): new values with old ones (v1 old), and with each other."""
    parts = []
    for attr, kind in kinds.items():
        old = distinct_values(base, attr)
        new = distinct_values(delta, attr).join(old, "value", "left_anti")
        a, b = _sides(old, new)
        left, right = _sides(new, new)
        parts.append(_measured(a.crossJoin(b).unionByName(left.join(right, F.col("v1") <= F.col("v2"))), attr, kind))
    return reduce(DataFrame.unionByName, parts)


def _segments(length: Column, k: int) -> list[tuple[Column, Column]]:
    """Start (from 1) and length of the k + 1 even segments of a string of this length."""
    out, at = [], F.lit(1)
    for s in range(k + 1):
        size = F.floor((length + s) / F.lit(k + 1)).cast("int")
        out.append((at, size))
        at = at + size
    return out


def neighbours(keys: DataFrame, kind: str, threshold: float) -> DataFrame:
    """k1 <= k2 and dist for the keys (column `k`, distinct, not null) within the threshold, the diagonal included.

    Whole numbers meet in buckets of the threshold's width. Strings meet without what all of them begin with, short ones on what remains
    without k characters, others on segments: of two strings within k edits, the shorter one, cut into k + 1 segments, has one
    segment that stands in the longer one, moved by k at most.
    """
    a, b = keys.select(F.col("k").alias("a")), keys.select(F.col("k").alias("b"))
    if threshold < 1:
        return a.select(F.col("a").alias("k1"), F.col("a").alias("k2"), F.lit(0).cast("bigint").alias("dist")).where(F.lit(threshold >= 0))
    if kind == INT:
        width = int(threshold) + 1
        at = F.floor(F.col("a") / width)
        left = a.withColumn("bucket", F.explode(F.array(at, at + 1, at - 1)))
        met = left.join(b.withColumn("bucket", F.floor(F.col("b") / width)), "bucket").where("a <= b")
        d = F.abs(F.col("a") - F.col("b"))
        return met.select(F.col("a").alias("k1"), F.col("b").alias("k2"), d.cast("bigint").alias("dist")).where(F.col("dist") <= threshold)
    k = int(threshold)
    d = F.levenshtein("ta", "tb", k)
    found = candidates(keys, k).withColumn("dist", d.cast("bigint")).where("dist >= 0")
    return found.select(F.least("a", "b").alias("k1"), F.greatest("a", "b").alias("k2"), "dist").distinct()


#: Strings whose variants, with up to k characters left out, have more characters than this together meet on segments.
CHARACTERS = 2048


def candidates(keys: DataFrame, k: int) -> DataFrame:
    """a, b and their ends ta, tb, without what all keys begin with: pairs, some of them several times, among which are all within k edits."""
    dealt = keys.repartition(tasks(keys.sparkSession), "k")  # few keys may share segments with all others
    # what all keys begin with says nothing about two of them, and would stand in a segment of each
    begin = keys.agg(F.min("k").alias("low"), F.max("k").alias("high")).select(_common("low", "high").alias("begin"))
    ends = dealt.crossJoin(F.broadcast(begin)).select(F.col("k").alias("s"), F.substring(F.col("k"), F.length("begin") + 1, F.length("k")).alias("t"))
    longest = next(n for n in range(CHARACTERS) if (n + 1) * sum(comb(n + 1, j) for j in range(min(k, n + 1) + 1)) > CHARACTERS)
    return _by_variants(ends, k, longest).union(_by_segments(ends, k, longest))


def _common(a: str, b: str) -> Column:
    """What two strings both begin with."""
    places = F.sequence(F.lit(0), F.least(F.length(a), F.length(b)))
    return F.substring(F.col(a), F.lit(1), F.array_max(F.filter(places, lambda n: F.substring(F.col(a), F.lit(1), n) == F.substring(F.col(b), F.lit(1), n))))


def _sided(ends: DataFrame, side: str) -> DataFrame:
    return ends.select(F.col("s").alias(side), F.col("t").alias(f"t{side}"))


def _longer_first() -> Column:
    la, lb = F.length("ta"), F.length("tb")
    return (la > lb) | ((la == lb) & (F.col("ta") >= F.col("tb")))


def _without_one(strings: Column) -> Column:
    """The distinct strings that remain of each when a character is left out; of an empty one, itself."""
    rest = lambda s: lambda n: F.concat(F.substring(s, F.lit(1), n - 1), F.substring(s, n + 1, F.length(s)))
    one = lambda s: F.when(F.length(s) == 0, F.array(s)).otherwise(F.transform(F.sequence(F.lit(1), F.length(s)), rest(s)))
    return F.array_distinct(F.flatten(F.transform(strings, one)))


def _by_variants(ends: DataFrame, k: int, longest: int) -> DataFrame:
    """a, b, ta, tb, with all pairs within k edits whose longer one, a, has `longest` characters at most: without k of its characters it
    is what remains of the other one without k or fewer. Keys that share such a variant are near each other, so a frequent one is no wasted work."""
    left_out = [F.array("t")]
    for _ in range(k):
        left_out.append(_without_one(left_out[-1]))
    short = ends.where(F.length("t") <= longest)
    a = short.select("s", "t", F.explode(left_out[k]).alias("part")).select(F.col("s").alias("a"), F.col("t").alias("ta"), "part")
    b = short.select("s", "t", F.explode(F.array_distinct(F.concat(*left_out))).alias("part")).select(F.col("s").alias("b"), F.col("t").alias("tb"), "part")
    return a.join(b, "part").where(_longer_first()).select("a", "b", "ta", "tb")


def _by_segments(ends: DataFrame, k: int, longest: int) -> DataFrame:
    """a, b, ta, tb, with all pairs within k edits whose longer one, a, has more than `longest` characters."""
    la, lb = F.length("ta"), F.length("tb")
    own = [F.struct(lb.alias("len"), F.lit(s).alias("seg"), F.substring(F.col("tb"), start, size).alias("part")) for s, (start, size) in enumerate(_segments(lb, k))]
    index = _sided(ends, "b").where(lb > longest - k).select("b", "tb", F.explode(F.array(*own)).alias("e")).select("b", "tb", "e.*")

    def part_at(length: Column, seg: int, size: Column):
        return lambda place: F.struct(length.alias("len"), F.lit(seg).alias("seg"), F.substring(F.col("ta"), place, size).alias("part"))

    def probes(length: Column) -> Column:
        parts = []
        for s, (start, size) in enumerate(_segments(length, k)):
            low, high = F.greatest(F.lit(1), start - k), F.least(start + k, F.length("ta") - size + 1)
            places = F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
            parts.append(F.transform(places, part_at(length, s, size)))
        return F.concat(*parts)

    lengths = F.sequence(F.greatest(F.lit(0), la - k), la)
    probe = _sided(ends, "a").where(la > longest).select("a", "ta", F.explode(F.array_distinct(F.flatten(F.transform(lengths, probes)))).alias("e")).select("a", "ta", "e.*")
    met = index.join(probe, ["len", "seg", "part"]).where(_longer_first()).select("a", "b", "ta", "tb")
    return met.distinct()
