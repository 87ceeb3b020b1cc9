"""Error detection over a whole table, and over rows that are appended to one."""

from __future__ import annotations

import time
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsift.functions.values import key, matchable
from cellsift.operators import distances, evaluation, grouped, pairs, probability, selection
from cellsift.plans.constraints import Dependency, threshold_index, validate
from cellsift.plans.strategy import groups_suffice
from cellsift.sources.tables import IDX


def probabilities_for(df: DataFrame, dds: list[Dependency]) -> DataFrame:
    """Joint probabilities of the attributes that some dependency names; all columns are features."""
    return probability.joint_probabilities(df, list(dict.fromkeys(a for d in dds for a in d.attrs)))


def detect(df: DataFrame, dds: list[Dependency], taus: Mapping[str, float], kinds: Mapping[str, str], wide: DataFrame | None = None, fallback: str = "first", strategy: str = "auto") -> DataFrame:
    """idx, attr: the error cells of df.

    wide: probabilities by _idx, scored from df if not given. strategy `auto` evaluates equality dependencies by groups and
    the rest by pairs; `pairs` pairs up all. What is paired are classes of rows with equal keys.
    """
    validate(dds, kinds, df.columns, taus)
    wide = probabilities_for(df, dds) if wide is None else wide
    by_group = [d for d in dds if strategy == "auto" and groups_suffice(d)]
    by_pair = [d for d in dds if d not in by_group]
    parts = []
    if by_group:
        parts.append(grouped.error_cells(df, by_group, kinds, wide, taus, fallback=fallback))
    parts += [selection.class_errors(df, d, kinds, wide, taus, fallback) for d in by_pair]
    if not parts:
        raise ValueError("no dependency")
    return parts[0] if len(parts) == 1 else reduce(DataFrame.union, parts).distinct()


def detect_delta(base: DataFrame, delta: DataFrame, dds: list[Dependency], taus: Mapping[str, float], kinds: Mapping[str, str], wide: DataFrame, n_old: int, fallback: str = "first") -> DataFrame:
    """idx, attr: what appending delta (its _idx from n_old on) to base adds, base rows' cells included.

    Equality dependencies look only at the groups that the delta touches; others at pairs with a row of the delta. An
    empty delta adds nothing. The probabilities, over base and delta, are an argument; a row that they lack counts as of
    unknown probability. Raises if a row of the delta has a lower _idx.
    """
    validate(dds, kinds, base.columns, taus)
    least = delta.agg(F.min(IDX)).first()[0]
    if least is not None and least < n_old:
        raise ValueError(f"the delta has a row {least}, and its rows should begin at {n_old}")
    both = base.unionByName(delta)
    parts = []
    for d in dds:
        if fallback == "first" and groups_suffice(d):
            parts.append(grouped.error_cells(both, [d], kinds, wide, taus, delta))
        else:
            parts.append(selection.class_errors(both, d, kinds, wide, taus, fallback, n_old))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def detect_incremental(base: DataFrame, delta: DataFrame, dds: list[Dependency], taus: Mapping[str, float], kinds: Mapping[str, str], wide: DataFrame, n_old: int, base_errors: DataFrame | None = None) -> DataFrame:
    """Error cells of base and delta together: those of base (given or found) and those that delta adds."""
    base_errors = detect(base, dds, taus, kinds, wide) if base_errors is None else base_errors
    return base_errors.select("idx", "attr").union(detect_delta(base, delta, dds, taus, kinds, wide, n_old)).distinct()


def timed(df: DataFrame) -> tuple[DataFrame, float]:
    """df, computed and held, and how long that took."""
    begun = time.time()
    df = df.persist()
    df.count()
    return df, time.time() - begun


RESULT = "Precision double, Recall double, F1 double, BuildLookupTime double, ClusterTime double, FindVioPairsTime double, EDetTime double, TotalTime double, Coverage string"
SUMMARY = "`Base_Size(k)` bigint, `Inc_Size(k)` bigint, Length_Original bigint, Length_Incremental bigint, Time_Original_Total double, Time_Inc_Total double, Precision double, Recall double, F1 double"


def report(df: DataFrame, clean: DataFrame, dds: list[Dependency], taus: Mapping[str, float], kinds: Mapping[str, str], wide: DataFrame | None = None) -> DataFrame:
    """One row: scores, seconds of the value distances, clusters, violating pairs and error cells and their sum, and coverage.

    Scoring and the comparison with the clean copy aren't timed. Distances and clusters are only measured here: finding pairs
    doesn't need them. Clusters and violating pairs are found folded, blocks of like rows for all pairs between them; pairs are
    spelt out only between rows without an error, which are those that coverage asks for.
    """
    spark = df.sparkSession
    wide = probabilities_for(df, dds) if wide is None else wide
    near = {a: max(t) for a, t in threshold_index(dds).items()}
    tables = [distances.neighbours(df.where(matchable(df, a)).select(key(F.col(f"`{a}`"), kinds[a]).alias("k")).distinct(), kinds[a], t) for a, t in near.items()]
    held = [timed(t) for t in tables]
    clusters = timed(pairs.folded_clusters(df, dds, kinds))
    found = timed(pairs.folded_violations(df, dds, kinds))
    errors = timed(detect(df, dds, taus, kinds, wide))
    row = evaluation.scores(errors[0], evaluation.difference(df, clean)).first()
    unflagged = df.join(errors[0].select(F.col("idx").alias(IDX)).distinct(), IDX, "left_anti")
    message = evaluation.coverage_message(pairs.violations(unflagged, dds, kinds).select("i", "j").distinct())
    seconds = [sum(s for _, s in held), clusters[1], found[1], errors[1]]
    for t, _ in [*held, clusters, found, errors]:
        t.unpersist()
    return spark.createDataFrame([(row.precision, row.recall, row.f1, *seconds, sum(seconds), message)], RESULT)


def summary(base: DataFrame, delta: DataFrame, clean: DataFrame, dds: list[Dependency], taus: Mapping[str, float], kinds: Mapping[str, str], wide: DataFrame, n_old: int) -> DataFrame:
    """One row: sizes of base and delta in thousands of rows and in rows, seconds of either run, and scores of both together."""
    spark, rows, more = base.sparkSession, base.count(), delta.count()
    before = timed(detect(base, dds, taus, kinds, wide))
    added = timed(detect_delta(base, delta, dds, taus, kinds, wide, n_old))
    row = evaluation.scores(before[0].union(added[0]).distinct(), evaluation.difference(base.unionByName(delta), clean)).first()
    for t, _ in (before, added):
        t.unpersist()
    return spark.createDataFrame([(rows // 1000, (rows + more) // 1000, rows, more, before[1], added[1], row.precision, row.recall, row.f1)], SUMMARY)
