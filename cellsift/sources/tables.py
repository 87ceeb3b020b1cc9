"""Reading and writing tables of text cells."""

from __future__ import annotations

import tempfile
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IDX = "_idx"
# What counts as a missing value in a CSV file.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, the header's names, missing values as null."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return df.select(*(F.when(~F.col(f"`{c}`").isin(MISSING), F.col(f"`{c}`")).alias(c) for c in df.columns))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def with_index(df: DataFrame, by: str | None = None, start: int = 0) -> DataFrame:
    """df with _idx: a dense key column that is there already, or the rows' position in the input."""
    if by is not None:
        return df.withColumn(IDX, F.col(by).cast("bigint") + start)
    # Ids that Spark gives are a partition's number and the place within it; what other partitions hold before makes them dense.
    spread = df.withColumn(IDX, F.monotonically_increasing_id())
    if "AdaptiveSparkPlan" in (plan := spread._jdf.queryExecution().executedPlan().toString()) or "Exchange" in plan:
        spread = spread.persist()  # both jobs must see the same partitions, which a scan of files gives by itself
    part, place = F.shiftright(IDX, 33), F.col(IDX).bitwiseAND((1 << 33) - 1)
    counts = {r.part: r.n for r in spread.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a number for each partition
    first = dict(zip(sorted(counts), [start, *accumulate(counts[k] for k in sorted(counts))], strict=False)) if counts else {}
    before = [first.get(k, 0) + (start if k != min(counts) else 0) for k in range(max(counts, default=-1) + 1)] if counts else [start]
    return spread.withColumn(IDX, (F.element_at(F.lit(before), (part + 1).cast("int")) + place).cast("bigint"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, by the session's checkpoint setting. Only where all run on one machine may it be unset."""
    sc = spark.sparkContext
    there = sc._jsc.sc().getCheckpointDir()
    path = there.get() if there.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="cellsift-"))
    return sc._jsc.sc().getCheckpointDir().get()


def attributes(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != IDX]


def long_cells(df: DataFrame, attrs: list[str] | None = None) -> DataFrame:
    """_idx, attr, value (string): a row a cell."""
    attrs = attrs or attributes(df)
    return df.select(IDX, *(F.col(f"`{a}`").cast("string").alias(a) for a in attrs)).unpivot(IDX, attrs, "attr", "value")


def cell_id(idx: str = "idx", attr: str = "attr"):
    """The printed name of a cell."""
    return F.concat(F.lit("t"), F.col(idx).cast("string"), F.lit("."), F.col(attr))


def parse_cell_id(cell):
    """idx and attr of a printed name; attributes may hold points."""
    return F.struct(F.regexp_extract(cell, r"^t(\d+)\.", 1).cast("bigint").alias("idx"), F.regexp_extract(cell, r"^t\d+\.(.*)$", 1).alias("attr"))
