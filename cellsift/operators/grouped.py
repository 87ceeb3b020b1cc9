"""Equality dependencies by group aggregates: pair counts and error cells without a pair.

Rows are grouped by their left keys g. r is the right key, or something of the row's own where the right value can't be
matched (it differs from all). For a right atom `<=` a row is involved if its group has another r; for `>`, if its group
has another row of the same r. Low cells of involved rows are errors. A row's least cell (p, place, idx) is an error if
some partner has a greater one and neither has a low first cell (fallback `edge`: a low cell at all); the largest least cell
of each (g, r) and the two largest over a group decide that.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsift.functions.values import key, matchable
from cellsift.operators.selection import chosen, own_cells
from cellsift.plans.constraints import Dependency
from cellsift.plans.strategy import groups_suffice
from cellsift.sources.tables import IDX


def grouped_rows(df: DataFrame, dd: Dependency, kinds: Mapping[str, str], extra: list[str] | None = None) -> DataFrame:
    """idx, g (array of keys as strings), r (null for a right value that can't be matched) and extra; rows whose left can't be matched are left out."""
    if not groups_suffice(dd):
        raise ValueError("only equality dependencies")
    lefts = [F.when(matchable(df, a.attr), key(F.col(f"`{a.attr}`"), kinds[a.attr])).cast("string") for a in dd.left]
    right = F.when(matchable(df, dd.right.attr), key(F.col(f"`{dd.right.attr}`"), kinds[dd.right.attr])).cast("string")
    rows = df.select(F.col(IDX).alias("idx"), F.array(*lefts).alias("g"), right.alias("r"), *(extra or []))
    return rows.where(~F.exists("g", lambda x: x.isNull()))


def pair_counts(df: DataFrame, dds: list[Dependency], kinds: Mapping[str, str]) -> DataFrame:
    """dd_id, n: the number of violating pairs of each dependency, 0 included."""
    parts = []
    for k, d in enumerate(dds):
        by = grouped_rows(df, d, kinds).groupBy("g", "r").agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("c"))
        two = lambda c: F.expr(f"{c} * ({c} - 1) / 2")
        alike = F.sum(F.when(F.col("r").isNotNull(), two("c")).otherwise(0))
        per = by.groupBy("g").agg(F.sum("c").alias("n"), alike.alias("alike"))
        n = F.sum(two("n") - F.col("alike")) if d.right.near else F.sum("alike")
        parts.append(per.agg(F.coalesce(n, F.lit(0)).cast("bigint").alias("n")).select(F.lit(k).alias("dd_id"), "n"))
    return reduce(DataFrame.unionByName, parts)


def _errors(df: DataFrame, dd: Dependency, kinds: Mapping[str, str], wide: DataFrame, taus: Mapping[str, float], touched: DataFrame | None = None, fallback: str = "first") -> DataFrame:
    rows = grouped_rows(df, dd, kinds)
    if touched is not None:
        rows = rows.join(grouped_rows(touched, dd, kinds).select("g").distinct(), "g", "left_semi").select("idx", "g", "r")
    rows = own_cells(rows, dd, wide, taus, fallback)
    lone = F.when(F.col("r").isNull(), F.col("idx")).otherwise(F.lit(-1))  # a class of its own
    rows = rows.withColumn("own", lone)
    per = rows.groupBy("g", "r", "own").agg(F.max("top").alias("best"), F.count(F.lit(1)).alias("n"))
    if dd.right.near:
        bests = F.struct("best", F.coalesce("r", F.lit("")).alias("r"), "own")
        two = per.groupBy("g").agg(F.count(F.lit(1)).alias("classes"), F.max(F.when(F.col("best").isNotNull(), bests)).alias("one"))
        joined = per.join(two, "g")
        mine = (F.coalesce("r", F.lit("")) == F.col("one.r")) & (F.col("own") == F.col("one.own"))
        second = joined.where(~mine).groupBy("g").agg(F.max("best").alias("second"))
        use = joined.join(second, "g", "left").select("g", "r", "own", "classes", F.when(mine, F.col("second")).otherwise(F.col("one.best")).alias("rival"))
        involved = use.where("classes > 1").drop("classes")
    else:
        involved = per.where("own = -1 and n > 1").select("g", "r", "own", F.col("best").alias("rival"))
    found = rows.join(involved, (rows["g"] == involved["g"]) & rows["r"].eqNullSafe(involved["r"]) & (rows["own"] == involved["own"])).select("idx", "least", "low", "top", "rival")
    return chosen(found)


def error_cells(df: DataFrame, dds: list[Dependency], kinds: Mapping[str, str], wide: DataFrame, taus: Mapping[str, float], touched: DataFrame | None = None, fallback: str = "first") -> DataFrame:
    """idx, attr of all dependencies, as select_errors gives them. touched: rows of df; only their groups are looked at."""
    return reduce(DataFrame.union, (_errors(df, d, kinds, wide, taus, touched, fallback) for d in dds)).distinct()


__all__ = ["error_cells", "grouped_rows", "pair_counts"]
