"""Incremental ranking: candidate rows are ranked as their files arrive, a sample's rows in as many files as they come.

Rows are landed by sample and batch, and the samples that a batch touches are ranked anew over all their rows. A batch that runs twice lands the same
rows at the same place. Cohort-wide steps (sample networks) must be recomputed over all samples instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.tables import scope
from ..operators.borda import consensus
from ..operators.config import BordaConfig


def rank_arrivals(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, cfg: BordaConfig, once: bool = True) -> StreamingQuery:
    """Parquet files under ``source`` -> ranked Parquet under ``sink``, by sample_id; what has arrived is kept under ``checkpoint``/rows."""
    landed = f"{checkpoint}/rows"

    def batch(rows: DataFrame, number: int) -> None:
        put = rows.sparkSession
        rows.withColumn("_batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sample_id", "_batch").parquet(landed)
        every = put.read.schema(rows.schema.add("_batch", "long")).parquet(landed)
        touched = every.filter(F.col("_batch") == number).select("sample_id").distinct()  # by folders
        again = every.join(touched, "sample_id", "left_semi").drop("_batch")
        with scope(put):
            consensus(again, cfg).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sample_id").parquet(sink)

    w = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint}/state")
    return (w.trigger(availableNow=True) if once else w).start()
