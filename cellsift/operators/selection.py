"""Error cells of violating pairs: cells below their attribute's threshold, and the least probable cell where the first left attribute has none.

select_errors looks at pairs; class_errors gives the same from classes of like rows, which have the same partners.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsift.operators.pairs import in_violation, is_new, keyed
from cellsift.plans.constraints import Dependency
from cellsift.sources.tables import IDX


def long_probabilities(wide: DataFrame, taus: Mapping[str, float]) -> DataFrame:
    """idx, attr, p, tau of the attributes that have a threshold; NaN counts as unknown."""
    names = [a for a in taus if a in wide.columns]
    p = wide.select(F.col(IDX).alias("idx"), *(F.col(f"`{a}`").cast("double").alias(a) for a in names)).unpivot("idx", names, "attr", "p")
    tau = F.create_map(*(x for a in names for x in (F.lit(a), F.lit(float(taus[a])))))
    return p.select("idx", "attr", F.when(~F.isnan("p"), F.col("p")).alias("p"), tau[F.col("attr")].alias("tau"))


def select_errors(found: DataFrame, dds: Iterable[Dependency], wide: DataFrame, taus: Mapping[str, float], fallback: str = "first") -> DataFrame:
    """idx, attr of violating pairs (dd_id, i, j). wide: probabilities by _idx; a row or value that it lacks counts as unknown.

    fallback: the least cell is added if no cell of the `first` attribute, or none of the whole `edge`, is low. A pair's
    cells stand in one row, so pairs are joined with either side's probabilities and never grouped.
    """
    parts = []
    for k, d in enumerate(dds):
        names = [*(a.attr for a in d.left), d.right.attr]
        known = [n for n in dict.fromkeys(names) if n in wide.columns]
        p = F.struct(*(F.nanvl(F.col(f"`{n}`").cast("double"), F.lit(None)).alias(n) for n in known)) if known else F.struct(F.lit(None).alias("none"))
        rows = found.where(F.col("dd_id") == k).select("i", "j")
        for side in "ij":
            rows = rows.join(wide.select(F.col(IDX).alias(side), p.alias("p" + side)), side, "left")
        value = lambda n, side: F.col("p" + side)[n] if n in known else F.lit(None).cast("double")  # noqa: E731, B023
        cells = [F.struct(value(n, side).alias("p"), F.lit(rank).alias("rank"), F.col(side).alias("idx"), F.lit(n).alias("attr")) for rank, n in enumerate(names) for side in "ij"]
        low = [F.coalesce(value(n, side) < float(taus[n]), F.lit(False)) if n in taus else F.lit(False) for n in names for side in "ij"]
        has = reduce(lambda a, b: a | b, low[:2] if fallback == "first" else low)
        least = F.array_min(F.filter(F.array(*cells), lambda c: c["p"].isNotNull()))
        flagged = F.array_compact(F.array(*(F.when(x, c) for x, c in zip(low, cells, strict=True)), F.when(~has, least)))
        parts.append(rows.select(F.explode(flagged).alias("c")).select("c.idx", "c.attr"))
    return reduce(DataFrame.union, parts).distinct()


def own_cells(rows: DataFrame, dd: Dependency, wide: DataFrame, taus: Mapping[str, float], fallback: str = "first") -> DataFrame:
    """rows (with `idx`) and `least`, its least known cell; `low`, its attributes below their thresholds; `top`, what its partners' least
    cells are held against: null if the row's own low cells rule the fallback out, and greater than all if none of its cells is known."""
    names = [n for n in dd.attrs if n in wide.columns]
    p = {n: F.when(~F.isnan(F.col(f"p_{n}")), F.col(f"p_{n}")) for n in names}
    scores = wide.select(F.col(IDX).alias("idx"), *(F.col(f"`{n}`").cast("double").alias(f"p_{n}") for n in names))
    out = rows.join(scores, "idx", "left")  # a row without probabilities is a partner like any other
    kind = "array<struct<p:double,pos:int,idx:bigint,attr:string>>"
    known = F.filter(F.array(*(F.struct(p[n].alias("p"), F.lit(k).alias("pos"), F.col("idx"), F.lit(n).alias("attr")) for k, n in enumerate(dd.attrs) if n in p)).cast(kind), lambda c: c["p"].isNotNull())
    low = F.array_compact(F.array(*(F.when(p[n] < float(taus[n]), F.lit(n)) for n in names if n in taus)).cast("array<string>"))
    ruled_out = F.array_contains("low", dd.attrs[0]) if fallback == "first" else F.size("low") > 0
    out = out.select(*(f"`{c}`" for c in rows.columns), F.array_min(known).alias("least"), low.alias("low"))
    return out.withColumn("top", F.when(~ruled_out, F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("cell"))))


def chosen(found: DataFrame) -> DataFrame:
    """idx, attr from rows of own_cells that are in a violating pair, with `rival`: the greatest top of a partner."""
    low = found.select("idx", F.explode("low").alias("attr"))
    least = found.where(F.col("least").isNotNull() & F.col("top").isNotNull() & (F.col("top") < F.col("rival"))).select("idx", F.col("least.attr").alias("attr"))
    return low.union(least)


def class_errors(df: DataFrame, dd: Dependency, kinds: Mapping[str, str], wide: DataFrame, taus: Mapping[str, float], fallback: str = "first", n_old: int | None = None) -> DataFrame:
    """idx, attr: what select_errors gives for the pairs that violate dd (with n_old, those with a row from there on), rows of equal keys as one.

    A row's low cells are errors if it has a partner, and its least one is if a partner's top is greater. All rows of a class have
    the same partners but for themselves, so classes are compared, and a class that violates the rule with itself keeps its two greatest tops.
    """
    rows = own_cells(keyed(df, [*dd.left, dd.right], kinds).withColumn("new", is_new(n_old)).withColumnRenamed(IDX, "idx"), dd, wide, taus, fallback)
    names = [c for c in rows.columns if c.startswith("k_")]
    classes = rows.groupBy(*(f"`{c}`" for c in names), "new").agg(F.min("idx").alias("id"), F.count(F.lit(1)).alias("n"), F.max("top").alias("best"))
    met = in_violation(classes, dd, kinds).withColumn("itself", F.col("lid") == F.col("rid")).where("not itself or ln > 1")
    sides = F.array(*(F.struct(F.col(f"{a}id").alias("id"), "itself", F.when(~F.col("itself"), F.col(f"{b}best")).alias("other")) for a, b in ("lr", "rl")))
    rivals = met.select(F.explode(sides).alias("s")).groupBy("s.id").agg(F.max("s.other").alias("other"), F.max("s.itself").alias("itself"))
    mine = classes.select(*(F.col(f"`{c}`").alias(f"c{c}") for c in names), F.col("new").alias("cnew"), "id", "best").join(rivals, "id")
    found = rows.join(mine, reduce(lambda a, b: a & b, (F.col(f"`{c}`").eqNullSafe(F.col(f"`c{c}`")) for c in [*names, "new"])))
    second = found.where(F.col("itself") & (F.col("top") < F.col("best"))).groupBy("id").agg(F.max("top").alias("second"))
    within = F.when(F.col("itself"), F.when(F.col("top") == F.col("best"), F.col("second")).otherwise(F.col("best")))
    return chosen(found.join(second, "id", "left").withColumn("rival", F.greatest("other", within))).distinct()
