"""Transactions as a stream. Row-level stages run on the stream itself; detection is not monotonic (a new credit can split or merge
candidates), so each micro-batch detects anew the analyses that it touches, from all their rows so far."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT_REGION, Config
from ..operators import features, validation
from ..plans.engine import Engine
from ..sources import payloads

BUCKETS = 256


def valid_rows(rows: DataFrame, event_time: str = "arrived", delay: str = "1 day") -> DataFrame:
    """Credits of a stream of rows (analysis_id, mode, pos, text fields, an arrival time) that pass every row check; a repeated id is
    dropped if it comes within the delay."""
    checked = validation.row_checked(rows).filter("fault is null")
    first = checked.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["analysis_id", "id"])
    return first.filter("way = 'credit'").withColumn("status", F.lit(None).cast("string"))


def featured(rows: DataFrame, config: Config | None = None) -> DataFrame:
    """Features of a stream's valid rows."""
    return features.extract(features.normalise(rows).withColumn("region", F.lit(DEFAULT_REGION)), config or Config())


class Detector:
    """Keeps rows and results as Parquet, by bucket of the analysis and batch; the last batch of an analysis counts. A batch that is
    run again writes the same files."""

    def __init__(self, engine: Engine, store: str, results: str):
        self.engine, self.store, self.results = engine, store, results

    @staticmethod
    def bucketed(df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64("analysis_id"), F.lit(BUCKETS)).cast("int"))

    def batch(self, rows: DataFrame, number: int) -> None:
        rows = self.bucketed(rows)
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.store}/batch={number}")
        touched = rows.select("bucket", "analysis_id").distinct()
        stored = self.engine.spark.read.option("basePath", self.store).parquet(f"{self.store}/batch=*").filter(F.col("batch") <= number)
        all_ = stored.join(touched, ["bucket", "analysis_id"], "left_semi")
        found = self.engine.detect(payloads.from_rows(all_))
        self.bucketed(found).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.results}/batch={number}")

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def latest(self) -> DataFrame:
        """The newest result of each analysis."""
        all_ = self.engine.spark.read.option("basePath", self.results).parquet(f"{self.results}/batch=*")
        newest = all_.groupBy("analysis_id").agg(F.max("batch").alias("batch"))
        return all_.join(newest, ["analysis_id", "batch"]).drop("bucket", "batch")
