"""Report files as a stream: the same scans and aggregations as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_bundles(spark: SparkSession, path: str, schema: str, max_files: int = 1000) -> DataFrame:
    """Runs that arrive as Parquet files, at most max_files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def failed_tests_stream(runs: DataFrame) -> DataFrame:
    """Latest failure and latest success of each test so far; state is one row per test.

    Needs output mode `update` or `complete`. A test counts as failing while `failing` holds:
    that can change as later successes arrive.
    """
    failed = F.col("status") == "FAILURE"
    state = runs.where(F.col("status").isin("FAILURE", "SUCCESS")).groupBy("bundle_id", "test_id").agg(
        F.max_by(F.when(failed, F.struct("seq", "time_ms")), F.when(failed, F.struct("time_ms", "seq"))).alias("failure"),
        F.max(F.when(F.col("status") == "SUCCESS", F.col("time_ms"))).alias("success_ms"),
    )
    failing = F.col("failure").isNotNull() & (F.col("success_ms").isNull() | (F.col("success_ms") <= F.col("failure.time_ms")))
    return state.select("bundle_id", "test_id", F.col("failure.seq").alias("seq"), F.col("failure.time_ms").alias("time_ms"), "success_ms", failing.alias("failing"))


def write_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of runs to Parquet, all that is there now."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
