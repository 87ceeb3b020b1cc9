"""Probability of a cell's value: given the row's other cells (naive Bayes), or by its frequency.

For a target T with m features and F distinct feature values in all, a class c with N_c of N rows has the log score
ln(N_c / N) - m ln(N_c m + F) + sum over features of ln(1 + n(c, a, x_a)), where n counts rows of class c with that
value: Laplace smoothing with 1, the prior as it is. Null is a value like any other. A cell's probability is its class's
share of the exponentials. Only classes that share a value with the row have a sum above 0, so the rest is one constant.

Features of few values would pair a row with nearly all classes; those are scored once for each combination of
their values that occurs (dense), the others by joins of counts (sparse). Exact either way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsift.sources.tables import IDX, attributes

DIGITS = 12


def _coded(df: DataFrame, columns: list[str]) -> DataFrame:
    """_idx and the columns as strings that tell null from any value."""
    return df.select(IDX, *(F.coalesce(F.concat(F.lit("v"), F.col(f"`{c}`").cast("string")), F.lit("n")).alias(c) for c in columns))


def _split(rows: DataFrame, target: str, features: list[str]) -> tuple[list[str], list[str]]:
    """Dense and sparse features, by the number of rows that a join on each would make."""
    def classes(a: str) -> DataFrame:
        per = rows.groupBy(a).agg(F.count(F.lit(1)).alias("f"), F.count_distinct(target).alias("c"))
        return per.agg(F.count(F.lit(1)).alias("values"), F.sum(F.col("f") * F.col("c")).alias("size")).select(F.lit(a).alias("attr"), "values", "size")

    sizes = {r.attr: (r["values"], r["size"] or 0) for r in reduce(DataFrame.union, map(classes, features)).collect()}
    n, total = rows.select(F.count(F.lit(1)), F.count_distinct(target)).first()
    dense, combos = [], 1
    for a in sorted(features, key=lambda x: sizes[x][0]):
        values, size = sizes[a]
        if size > 2 * n and min(combos * values, n) * total < size:
            dense.append(a)
            combos = min(combos * values, n)
    return dense, [a for a in features if a not in dense]


def joint_probability(df: DataFrame, target: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """_idx, p: probability of each row's value of the target given its other cells."""
    features = [a for a in attributes(df) if a != target and a not in exclude]
    if not features:
        raise ValueError(f"{target}: no other column to score it by")
    rows = _coded(df, [target, *features]).withColumnRenamed(target, "__c")
    m = len(features)
    dense, sparse = _split(rows, "__c", features)
    values = rows.select(F.sum(F.lit(0)), *(F.count_distinct(F.col(f"`{a}`")).alias(a) for a in features)).select(reduce(lambda x, y: x + y, (F.col(f"`{a}`") for a in features)).cast("double").alias("F"))
    per = rows.groupBy("__c").agg(F.count(F.lit(1)).cast("double").alias("nc"))
    total = per.agg(F.sum("nc").alias("N"))
    base = per.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(values)).select("__c", (F.ln(F.col("nc") / F.col("N")) - m * F.ln(F.col("nc") * m + F.col("F"))).alias("b"))

    def counts(names: list[str]) -> DataFrame:
        return rows.select("__c", *(F.col(f"`{a}`") for a in names)).unpivot("__c", names, "a", "v").groupBy("__c", "a", "v").agg(F.ln(F.count(F.lit(1)) + 1.0).alias("w"))

    d_key = F.array(*(F.col(f"`{a}`") for a in dense)) if dense else F.array(F.lit(""))
    keyed = rows.withColumn("__d", d_key)
    combos = keyed.select("__d").distinct()
    scored = combos.crossJoin(base)
    if dense:
        each = combos.select("__d", F.explode(F.arrays_zip(F.array(*(F.lit(a) for a in dense)).alias("a"), F.col("__d").alias("v"))).alias("z")).select("__d", "z.a", "z.v")
        gained = each.join(counts(dense), ["a", "v"]).groupBy("__d", "__c").agg(F.sum("w").alias("w"))
        scored = scored.join(gained, ["__d", "__c"], "left").select("__d", "__c", (F.col("b") + F.coalesce("w", F.lit(0.0))).alias("b"))
    # Log of the sum over all classes, for each combination.
    # Without dense features there is one combination; it is never a key to join on.
    of_all = (lambda a, b: a.join(b, "__d")) if dense else (lambda a, b: a.crossJoin(F.broadcast(b.drop("__d"))))
    rest = of_all(scored, scored.groupBy("__d").agg(F.max("b").alias("t"))).groupBy("__d").agg((F.max("t") + F.ln(F.sum(F.exp(F.col("b") - F.col("t"))))).alias("z"))
    own = keyed.select(IDX, "__d", F.col("__c").alias("own"))
    if not sparse:
        out = own.join(scored, (own["__d"] == scored["__d"]) & (own["own"] == scored["__c"])).select(IDX, own["__d"], "b")
        return of_all(out, rest).select(IDX, F.round(F.exp(F.col("b") - F.col("z")), DIGITS).alias("p"))
    cells = keyed.select(IDX, "__d", F.col("__c").alias("own"), *(F.col(f"`{a}`") for a in sparse)).unpivot([IDX, "__d", "own"], sparse, "a", "v")
    met = cells.join(counts(sparse), ["a", "v"]).groupBy(IDX, "__d", "own", "__c").agg(F.sum("w").alias("s"))
    terms = met.join(scored, ["__d", "__c"]).withColumn("t", F.col("b") + F.col("s"))
    per_row = terms.groupBy(IDX, "__d").agg(F.max("t").alias("most"), F.max(F.when(F.col("own") == F.col("__c"), F.col("t"))).alias("mine"), F.collect_list(F.struct("t", "s")).alias("all"))
    joined = of_all(per_row, rest).withColumn("r", F.greatest("most", "z"))
    more = F.aggregate("all", F.lit(0.0), lambda acc, x: acc - F.exp(x["t"] - F.col("r")) * F.expm1(-x["s"]))
    return joined.select(IDX, F.round(F.exp(F.col("mine") - F.col("r")) / (F.exp(F.col("z") - F.col("r")) + more), DIGITS).alias("p"))


def joint_probabilities(df: DataFrame, targets: list[str] | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """_idx and a column of probabilities for each target (all attributes unless given). Values are rounded, so that equal rows tie."""
    targets = targets or attributes(df)
    if len(attributes(df)) < 2:
        return df.select(IDX)
    parts = [joint_probability(df, t, exclude).withColumnRenamed("p", t) for t in targets]
    return reduce(lambda a, b: a.join(b, IDX), parts)


def frequencies(df: DataFrame, attr: str) -> DataFrame:
    """value, p: each value's share of the rows where the attribute isn't null."""
    per = df.where(F.col(f"`{attr}`").isNotNull()).groupBy(F.col(f"`{attr}`").cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = per.agg(F.sum("n").alias("total"))
    return per.crossJoin(F.broadcast(total)).select("value", (F.col("n") / F.col("total")).alias("p"))


def scaled(df: DataFrame, column: str) -> DataFrame:
    """df with the column stretched to 0 to 1; null where all its values are equal."""
    ends = df.agg(F.min(column).alias("__low"), F.max(column).alias("__high"))
    out = df.crossJoin(F.broadcast(ends)).withColumn(column, (F.col(column) - F.col("__low")) / F.nullif(F.col("__high") - F.col("__low"), F.lit(0.0)))
    return out.drop("__low", "__high")


def marginal_probability(df: DataFrame, attr: str) -> DataFrame:
    """_idx, p: the value's share, 0 for null, stretched to 0 to 1."""
    cell = df.select(IDX, F.col(f"`{attr}`").cast("string").alias("value"))
    return scaled(cell.join(frequencies(df, attr), "value", "left").select(IDX, F.coalesce("p", F.lit(0.0)).alias("p")), "p")


def marginal_probabilities(df: DataFrame, targets: list[str] | None = None) -> DataFrame:
    parts = [marginal_probability(df, t).withColumnRenamed("p", t) for t in targets or attributes(df)]
    return reduce(lambda a, b: a.join(b, IDX), parts)
