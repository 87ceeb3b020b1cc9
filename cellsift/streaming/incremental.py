"""Detection over a stream of appended rows: each micro-batch is a delta on what came before."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from cellsift.detection import detect_delta
from cellsift.plans.constraints import Dependency
from cellsift.sources.tables import IDX


class AppendOnly:
    """Use as writeStream.foreachBatch(AppendOnly(...)).

    Rows must carry _idx, greater than that of all earlier rows. Rows and errors go to Parquet folders, a sub-folder for each batch,
    overwritten if a batch is repeated after a failure. wide: probabilities by _idx, or a function of the rows so far and
    the batch that gives them; rows that they lack count as of unknown probability.
    """

    def __init__(self, rows: str, errors: str, dds: list[Dependency], taus: Mapping[str, float], kinds: Mapping[str, str], wide: DataFrame | Callable[[DataFrame, DataFrame], DataFrame]):
        self.rows, self.errors, self.dds, self.taus, self.kinds, self.wide = rows, errors, dds, taus, kinds, wide

    def before(self, spark: SparkSession, batch: DataFrame, batch_id: int) -> DataFrame:
        try:
            return spark.read.parquet(self.rows).where(f"batch < {batch_id}").select(*batch.columns)
        except Exception as e:  # the first batch finds no folder
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return batch.where("false")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        least = batch.agg({IDX: "min"}).first()[0]
        if least is not None:
            old = self.before(spark, batch, batch_id)
            wide = self.wide(old, batch) if callable(self.wide) else self.wide
            detect_delta(old, batch, self.dds, self.taus, self.kinds, wide, least).write.mode("overwrite").parquet(f"{self.errors}/batch={batch_id}")
            batch.write.mode("overwrite").parquet(f"{self.rows}/batch={batch_id}")
        batch.unpersist()
