"""Which physical plan a dependency's left side gets."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

from cellsift.plans.constraints import Atom, Dependency

#: Nothing can be within a negative distance; an equi-join; a join by neighbouring values; every pair.
EMPTY, EQUALITY, FUZZY, ALL = "empty", "equality", "fuzzy", "all"


def choose(left: Iterable[Atom]) -> tuple[str, Atom | None]:
    """The plan, and the atom that a fuzzy one begins with: the one of least threshold."""
    near = [a for a in left if a.near]
    if any(a.threshold < 0 for a in near):
        return EMPTY, None
    if any(a.equality for a in near):
        return EQUALITY, None
    if near:
        return FUZZY, min(near, key=lambda a: a.threshold)
    return ALL, None


def groups_suffice(dd: Dependency) -> bool:
    """Whether the dependency can be evaluated by group aggregates, without any pair."""
    return bool(dd.left) and all(a.near and a.equality for a in dd.left) and dd.right.equality


#: Where pairs of that many rows are spelt out, a task more; never more than MOST for each core.
ROWS, MOST = 10_000, 16


def tasks(spark: SparkSession, rows: int = 0) -> int:
    """Among how many tasks work is dealt whose input is small and whose output isn't: all pairs of that many rows, if given. As pairs grow
    faster than rows, few tasks would be long ones, and cores would be idle while the last of them end."""
    cores = spark.sparkContext.defaultParallelism
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * cores, min(MOST * cores, rows // ROWS))
