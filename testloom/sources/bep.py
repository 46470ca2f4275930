"""Bazel build events as JSON, one event a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT = """
  id struct<testResult: struct<label: string, run: int, shard: int, attempt: int>, testSummary: struct<label: string>>,
  testResult struct<status: string, cachedLocally: boolean, testAttemptStart: timestamp, testAttemptDuration: string,
    testActionOutput: array<struct<name: string, uri: string>>, executionInfo: struct<cachedRemotely: boolean>>,
  testSummary struct<overallStatus: string, firstStartTime: timestamp, lastStopTime: timestamp>,
  _bad string
"""


def _seconds(c: Column) -> Column:
    return F.regexp_replace(c, "s$", "").try_cast("double")


def scan_bep(spark: SparkSession, path: str) -> DataFrame:
    """S3: test results and summaries of event files, a row per event and XML output.

    Columns bundle_id (of folders `bundle_id=..`, else the file), seq, kind, label, attempt, status, cached, start_time,
    end_time, uri, error. A file ends at its first bad line, which is a row of kind `error`.
    Pretty-printed files, where events follow each other as `}` and `{` lines, are cut first.
    """
    reader = spark.read
    if "bundle_id" in reader.text(path).columns:  # a folder a bundle; ids are texts
        reader = reader.schema("value string, bundle_id string")
    files = reader.text(path, wholetext=True).withColumn("file_path", F.col("_metadata.file_path"))
    files = files.select(F.col("bundle_id" if "bundle_id" in files.columns else "file_path").alias("bundle_id"), "value")
    text = F.when(F.col("value").rlike(r"\n\}\s*\n\{"), F.split("value", r"(?<=\n\})\s*\n(?=\{)")).otherwise(F.split("value", "\n"))
    lines = files.select("bundle_id", F.posexplode(text).alias("seq", "line")).where(F.length(F.trim("line")) > 0)
    parsed = lines.withColumn("e", F.from_json("line", EVENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("e").isNull() | F.col("e._bad").isNotNull()
    before = Window.partitionBy("bundle_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    kept = parsed.withColumn("bad", bad).withColumn("ended", F.coalesce(F.max("bad").over(before), F.lit(False))).where(~F.col("ended"))
    r, s = F.col("e.testResult"), F.col("e.testSummary")
    kind = F.when(F.col("bad"), F.lit("error")).when(r.isNotNull() & F.col("e.id.testResult").isNotNull(), F.lit("result")).when(s.isNotNull() & F.col("e.id.testSummary").isNotNull(), F.lit("summary"))
    start = F.coalesce(r["testAttemptStart"], s["firstStartTime"])
    end = F.coalesce(F.timestamp_micros(F.unix_micros(start) + F.round(_seconds(r["testAttemptDuration"]) * 1e6).cast("long")), s["lastStopTime"])
    uris = F.filter(r["testActionOutput"], lambda o: o["name"].endswith(".xml") & o["uri"].isNotNull())
    return (
        kept.withColumn("kind", kind).where("kind is not null")
        .select(
            "bundle_id", "seq", "kind", F.coalesce("e.id.testResult.label", "e.id.testSummary.label").alias("label"), F.coalesce("e.id.testResult.attempt", F.lit(0)).alias("attempt"),
            F.coalesce(r["status"], s["overallStatus"], F.lit("NO_STATUS")).alias("status"),
            (F.coalesce(r["cachedLocally"], F.lit(False)) | F.coalesce(r["executionInfo"]["cachedRemotely"], F.lit(False))).alias("cached"), start.alias("start_time"), end.alias("end_time"),
            F.explode_outer(F.transform(uris, lambda o: o["uri"])).alias("uri"), F.when(F.col("kind") == "error", F.concat(F.lit("Error parsing build event: "), F.col("line"))).alias("error"), "line",
        )
    )


def write_bep_events(events: DataFrame, path: str) -> None:
    """The test events alone, one JSON object a line, as they were read; a file in a folder for each bundle.

    Files appear when the job commits; a failed task leaves none.
    """
    lines = events.where("kind in ('result', 'summary')").select("bundle_id", "seq", "line").distinct()
    lines.repartition("bundle_id").sortWithinPartitions("bundle_id", "seq").select("bundle_id", F.col("line").alias("value")).write.partitionBy("bundle_id").text(path)
