"""Ground truth from a clean copy, precision and recall, and whether every violating pair is covered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsift.functions.values import strip
from cellsift.sources.tables import IDX, attributes, long_cells


def difference(dirty: DataFrame, clean: DataFrame) -> DataFrame:
    """idx, attr of the cells whose stripped text differs; null, empty and blank are alike. Raises if row counts or columns don't match."""
    names = attributes(dirty)
    if missing := [n for n in names if n not in clean.columns]:
        raise ValueError(f"the clean table lacks {missing}")
    if dirty.count() != clean.count():
        raise ValueError("the tables have different numbers of rows")
    text = lambda c: F.coalesce(strip(F.col(c)), F.lit(""))
    left = long_cells(dirty, names)
    right = long_cells(clean, names).withColumnRenamed("value", "other")
    return left.join(right, [IDX, "attr"]).where(text("value") != text("other")).select(F.col(IDX).alias("idx"), "attr")


def null_cells(df: DataFrame) -> DataFrame:
    """attr, n: null cells of each attribute of a clean copy, where no error can be told from a missing value."""
    names = attributes(df)
    one = df.agg(*(F.count_if(F.col(f"`{n}`").isNull()).alias(n) for n in names))
    return one.unpivot([], names, "attr", "n")


def scores(errors: DataFrame, truth: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall, f1; 0 where a denominator is."""
    a = errors.select("idx", "attr").distinct().withColumn("e", F.lit(1))
    b = truth.select("idx", "attr").distinct().withColumn("t", F.lit(1))
    both = a.join(b, ["idx", "attr"], "full").agg(F.count_if(F.expr("e = 1 and t = 1")).alias("tp"), F.count_if(F.expr("e = 1 and t is null")).alias("fp"), F.count_if(F.expr("t = 1 and e is null")).alias("fn"))
    share = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    out = both.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def uncovered(pairs: DataFrame, errors: DataFrame) -> DataFrame:
    """i, j of the pairs neither of whose rows has an error cell."""
    rows = errors.select("idx").distinct()
    out = pairs.select("i", "j").distinct()
    for side in "ij":
        out = out.join(rows.withColumnRenamed("idx", side), side, "left_anti")
    return out.select("i", "j")


def coverage_message(missing: DataFrame, shown: int = 20) -> str:
    """What a report says about uncovered pairs; it names some."""
    some = [f"({r.i}, {r.j})" for r in missing.orderBy("i", "j").limit(shown + 1).collect()]
    if not some:
        return "All violating pairs are covered."
    return f"Pairs not covered: {', '.join(some[:shown])}{' and more' if len(some) > shown else ''}"
