"""Pairs of rows: within a distance (clusters), and in violation of a dependency.

A pair is (i, j) with i < j. With n_old, only pairs with j >= n_old count: those that a delta's rows are in.

Rows with the same keys are alike to every rule, so what is joined and compared are blocks of like rows: keys, and the rows
that have them. Two blocks that meet stand for all pairs between them, which are only spelt out at the end; large ones are
dealt to tasks before that, so that a frequent key is not one task's work. Where every row has keys of its own, a block is a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellsift.functions.values import close, distance, key, matchable
from cellsift.operators.distances import neighbours
from cellsift.plans.constraints import Atom, Dependency, threshold_index
from cellsift.plans.strategy import EMPTY, EQUALITY, FUZZY, choose, tasks
from cellsift.sources.tables import IDX

#: Rows are dealt to lots of about SPAN by a hash of _idx; those of a lot may share a block, of at most SIZE rows; two blocks of LARGE
#: rows or more are dealt out.
# Lots follow from the number of rows: by ranges of _idx, rows of keys that lie far apart had a block each. A task holds a
# block's rows, each with the other block's ids, at once, so SIZE bounds its memory. LARGE is low, as a delta has few rows of each key; at
# 16, those with all of their base's rows were one task's work.
SPAN, SIZE, LARGE = 1 << 20, 256, 4


def keyed(df: DataFrame, atoms: Iterable[Atom], kinds: Mapping[str, str]) -> DataFrame:
    """_idx and, for each attribute of the atoms, its key; null where the value can't be matched."""
    names = dict.fromkeys(a.attr for a in atoms)
    return df.select(IDX, *(F.when(matchable(df, n), key(F.col(f"`{n}`"), kinds[n])).alias(f"k_{n}") for n in names))


def is_new(n_old: int | None) -> Column:
    return F.lit(True) if n_old is None else F.col(IDX) >= n_old


def blocks(rows: DataFrame, n_old: int | None = None, n: int | None = None) -> DataFrame:
    """The keys, `new`, `ids` and `id`, the least of them: rows of equal keys, all of a delta or all of its base. n: how many rows, counted if not given."""
    n = rows.count() if n is None else n
    names = [f"`{c}`" for c in rows.columns if c != IDX]
    dealt = rows.withColumn("lot", F.pmod(F.xxhash64(IDX), F.lit(n // SPAN + 1)))
    per = dealt.groupBy(*names, is_new(n_old).alias("new"), "lot").agg(F.sort_array(F.collect_list(IDX)).alias("ids"))
    parts = F.transform(F.sequence(F.lit(1), F.size("ids"), F.lit(SIZE)), lambda at: F.slice("ids", at, SIZE))
    return per.select(*names, "new", F.explode(parts).alias("ids")).withColumn("id", F.element_at("ids", 1))


def _side(rows: DataFrame, side: str) -> DataFrame:
    return rows.select(*(F.col(f"`{c}`").alias(f"{side}{c}") for c in rows.columns))


def _within(atom: Atom, kinds: Mapping[str, str]) -> Column:
    return close(F.col(f"lk_{atom.attr}"), F.col(f"rk_{atom.attr}"), kinds[atom.attr], atom.threshold)


def _all_pairs(rows: DataFrame, condition: Column) -> DataFrame:
    """Every pair that meets the condition. Rows are dealt to a grid of blocks, so that tasks share the work evenly."""
    n = max(2, round(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = _side(rows, "l").withColumn("x", F.pmod(F.xxhash64("lid"), F.lit(n)).cast("int")).withColumn("y", every)
    right = _side(rows, "r").withColumn("y", F.pmod(F.xxhash64("rid"), F.lit(n)).cast("int")).withColumn("x", every)
    return left.join(right, ["x", "y"]).where(condition).drop("x", "y")


def meeting(rows: DataFrame, left: Iterable[Atom], kinds: Mapping[str, str]) -> DataFrame:
    """Pairs of blocks, or of whatever has keys, `id` and `new`, for which all near atoms hold: both sides' columns with l and r before
    their names, each pair once, in either order. One that meets itself is there too; two of the base are not."""
    left = list(left)
    scope = (F.col("lid") <= F.col("rid")) & (F.col("lnew") | F.col("rnew"))
    plan, at = choose(left)
    if plan == EMPTY:
        return _side(rows, "l").crossJoin(_side(rows, "r")).where(F.lit(False))
    if plan == EQUALITY:
        on = [F.col(f"lk_{a.attr}") == F.col(f"rk_{a.attr}") for a in left if a.near and a.equality]
        rest = [_within(a, kinds) for a in left if a.near and not a.equality]
        return _side(rows, "l").join(_side(rows, "r"), reduce(Column.__and__, [*on, *rest, scope]))
    if plan == FUZZY:
        k = f"k_{at.attr}"
        near = neighbours(rows.select(F.col(f"`{k}`").alias("k")).where("k is not null").distinct(), kinds[at.attr], at.threshold).select("k1", "k2")
        rest = reduce(Column.__and__, [_within(a, kinds) for a in left if a.near and a != at] or [F.lit(True)])
        once = (F.col("lnew") | F.col("rnew")) & ((F.col("k1") != F.col("k2")) | (F.col("lid") <= F.col("rid")))
        met = _side(rows, "l").join(near, F.col(f"`l{k}`") == F.col("k1"))
        return met.join(_side(rows, "r"), F.col("k2") == F.col(f"`r{k}`")).where(once & rest).drop("k1", "k2")
    return _all_pairs(rows, scope)


def in_violation(rows: DataFrame, dd: Dependency, kinds: Mapping[str, str]) -> DataFrame:
    """Those of meeting whose rows violate the dependency."""
    met = meeting(rows, dd.left, kinds)
    for a in dd.left:
        if not a.near:
            met = met.where(~_within(a, kinds))
    bad = _within(dd.right, kinds)
    return met.where(~bad if dd.right.near else bad)


def spelt_out(rows: DataFrame, n_old: int | None, meet: Callable[[DataFrame], DataFrame], *kept: str) -> DataFrame:
    """The columns kept, i and j: all pairs of rows that meet, a function of blocks, pairs up."""
    columns, n = [*kept, "lid", "rid", "lids", "rids"], rows.count()
    met = meet(blocks(rows, n_old, n))  # the same for both, so that neighbouring values are found once; large blocks are chosen before the join all the same
    small = met.where(F.least(F.size("lids"), F.size("rids")) < LARGE).select(*columns)
    large = met.where((F.size("lids") >= LARGE) & (F.size("rids") >= LARGE)).select(*columns).repartition(tasks(rows.sparkSession, n), "lid", "rid")

    def one(met: DataFrame) -> DataFrame:
        return met.select(*kept, (F.col("lid") == F.col("rid")).alias("itself"), F.explode("lids").alias("a"), "rids")

    # Spark holds all that a row becomes in one chain of operators; the union between both steps makes that a row's partners, not two blocks' pairs
    both = one(small).union(one(large)).select(*kept, "itself", "a", F.explode("rids").alias("b")).where(~F.col("itself") | (F.col("a") < F.col("b")))
    return both.select(*kept, F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"))


def violating_pairs(df: DataFrame, dd: Dependency, kinds: Mapping[str, str], n_old: int | None = None) -> DataFrame:
    """i, j of the pairs that violate one dependency."""
    return spelt_out(keyed(df, [*dd.left, dd.right], kinds), n_old, lambda met: in_violation(met, dd, kinds))


def violations(df: DataFrame, dds: Iterable[Dependency], kinds: Mapping[str, str], n_old: int | None = None) -> DataFrame:
    """dd_id, i, j over all dependencies, numbered from 0."""
    return reduce(DataFrame.unionByName, (violating_pairs(df, d, kinds, n_old).select(F.lit(k).alias("dd_id"), "i", "j") for k, d in enumerate(dds)))


def violation_counts(found: DataFrame) -> DataFrame:
    """dd_id, n of pairs that were built; grouped.pair_counts counts without building them."""
    return found.groupBy("dd_id").agg(F.count(F.lit(1)).alias("n"))


def _near(atom: Atom, thresholds: list[float], kinds: Mapping[str, str]) -> Callable[[DataFrame], DataFrame]:
    def meet(rows: DataFrame) -> DataFrame:
        met = meeting(rows, [atom], kinds)
        d = F.lit(0) if atom.equality else distance(F.col(f"lk_{atom.attr}"), F.col(f"rk_{atom.attr}"), kinds[atom.attr])
        return met.withColumn("d", d).withColumn("threshold", F.explode(F.array(*(F.lit(t) for t in thresholds)))).where("d <= threshold")

    return meet


def clusters(df: DataFrame, dds: Iterable[Dependency], kinds: Mapping[str, str], n_old: int | None = None) -> DataFrame:
    """attr, threshold, i, j: pairs within each threshold of each attribute. Pairs are found once, at the largest, and refined by distance."""
    parts = []
    for attr, thresholds in threshold_index(dds).items():
        atom = Atom(attr, "<=", thresholds[0])
        met = spelt_out(keyed(df, [atom], kinds), n_old, _near(atom, thresholds, kinds), "threshold")
        parts.append(met.select(F.lit(attr).alias("attr"), "threshold", "i", "j"))
    return reduce(DataFrame.unionByName, parts)


def _folded() -> list[Column]:
    """Two blocks by their least rows, and how many pairs they stand for."""
    a, b = F.size("lids").cast("bigint"), F.size("rids")
    return [F.least("lid", "rid").alias("i"), F.greatest("lid", "rid").alias("j"), F.when(F.col("lid") == F.col("rid"), F.expr("size(lids) * (size(lids) - 1L) div 2")).otherwise(a * b).alias("n")]


def folded_clusters(df: DataFrame, dds: Iterable[Dependency], kinds: Mapping[str, str]) -> DataFrame:
    """attr, threshold, i, j, n: clusters without spelling pairs out; i and j are the least rows of two blocks, or of one, that stand for n pairs."""
    parts = []
    for attr, thresholds in threshold_index(dds).items():
        atom = Atom(attr, "<=", thresholds[0])
        met = _near(atom, thresholds, kinds)(blocks(keyed(df, [atom], kinds)))
        parts.append(met.select(F.lit(attr).alias("attr"), "threshold", *_folded()).where("n > 0"))
    return reduce(DataFrame.unionByName, parts)


def folded_violations(df: DataFrame, dds: Iterable[Dependency], kinds: Mapping[str, str]) -> DataFrame:
    """dd_id, i, j, n: violations in the form of folded_clusters."""
    parts = []
    for k, d in enumerate(dds):
        met = in_violation(blocks(keyed(df, [*d.left, d.right], kinds)), d, kinds)
        parts.append(met.select(F.lit(k).alias("dd_id"), *_folded()).where("n > 0"))
    return reduce(DataFrame.unionByName, parts)


def nested(found: DataFrame) -> DataFrame:
    """attr, threshold, i and the sorted array of its j, for display; a group of n like rows has arrays of n entries."""
    return found.groupBy("attr", "threshold", "i").agg(F.sort_array(F.collect_list("j")).alias("js"))


def hyper_edges(found: DataFrame, dds: Iterable[Dependency]) -> DataFrame:
    """dd_id, i, j, pos, idx, attr: the cells of each violating pair, left attributes in order, then the right one, i before j."""
    parts = []
    for k, d in enumerate(dds):
        names = [*(a.attr for a in d.left), d.right.attr]
        cells = F.array(*(F.struct(F.lit(2 * p + s).alias("pos"), F.lit(n).alias("attr")) for p, n in enumerate(names) for s in range(2)))  # one constant, not made for each pair
        each = found.where(F.col("dd_id") == k).select("dd_id", "i", "j", F.explode(cells).alias("c"))
        parts.append(each.select("dd_id", "i", "j", "c.pos", F.when(F.col("c.pos") % 2 == 0, F.col("i")).otherwise(F.col("j")).alias("idx"), "c.attr"))
    return reduce(DataFrame.unionByName, parts)


__all__ = ["blocks", "clusters", "folded_clusters", "folded_violations", "hyper_edges", "in_violation", "is_new", "keyed", "meeting", "nested", "spelt_out", "violating_pairs", "violation_counts", "violations"]
