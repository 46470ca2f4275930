"""Building test case runs from parsed cases. Each step is a whole-table projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from testloom.functions.ids import OWN_PREFIX, run_id
from testloom.functions.times import plus_seconds


def with_run_times(cases: DataFrame, case_ts: str = "case_ts", suite_ts: str = "suite_ts", case_time: str = "case_time", suite_time: str = "suite_time") -> DataFrame:
    """started_at of the case, else its suite; finished_at from the case's or suite's time.

    With a time but no start, both are counted from the epoch.
    """
    start, time = F.coalesce(case_ts, suite_ts), F.coalesce(case_time, suite_time)
    anchored = F.coalesce(start, F.when(time.isNotNull(), F.timestamp_micros(F.lit(0).cast("long"))))
    return cases.withColumn("started_at", anchored).withColumn("finished_at", F.when(time.isNotNull(), plus_seconds(anchored, time)))


def with_inherited_output(cases: DataFrame) -> DataFrame:
    """A failing case alone in its suite takes the suite's output where it has none."""
    alone = F.count("*").over(Window.partitionBy("bundle_id", "file_path", "suite_pos")) == 1
    takes = alone & (F.col("status") == "FAILURE")
    for c in ("system_out", "system_err"):
        cases = cases.withColumn(f"_{c}", F.when(takes, F.coalesce(F.col(c), F.col(f"suite_{c}"))).otherwise(F.col(c)))
    return cases.withColumn("system_out", F.col("_system_out")).withColumn("system_err", F.col("_system_err")).drop("_system_out", "_system_err")


def with_status_output(cases: DataFrame) -> DataFrame:
    """Legacy message (description, else message) and the output struct, if it has any part."""
    told = F.col("status") != "SUCCESS"
    parts = [F.col(c) for c in ("message", "description", "system_out", "system_err")]
    output = F.struct(*(F.coalesce(p, F.lit("")).alias(n) for p, n in zip(parts, ("message", "text", "system_out", "system_err"), strict=True)))
    return cases.withColumn("status_output_message", F.when(told, F.coalesce("description", "message", F.lit(""))).otherwise(F.lit(""))).withColumn(
        "test_output", F.when(told & F.coalesce(*parts).isNotNull(), output)
    )


def resolved_file(mode: str = "run", case_file: str = "case_file", case_filepath: str = "case_filepath", suite_file: str = "suite_file", suite_filepath: str = "suite_filepath") -> Column:
    """P5: `run`: case, then suite, `file` before `filepath`. `bindings`: the suite's values replace the case's."""
    if mode == "run":
        return F.coalesce(case_file, case_filepath, suite_file, suite_filepath)
    return F.coalesce(F.coalesce(F.col(suite_file), F.col(case_file)), F.coalesce(F.col(suite_filepath), F.col(case_filepath)))


def whole_number(c: Column) -> Column:
    """A 32-bit integer with optional sign and nothing around it, else null."""
    return F.when(c.rlike(r"^[+-]?\d+$"), c.try_cast("int"))


def with_line_attempt(cases: DataFrame) -> DataFrame:
    return cases.withColumn("line_number", whole_number(F.col("line"))).withColumn("attempt_index", whole_number(F.col("attempt_number")))


def bazel_package(label: Column) -> Column:
    """`//pkg/path:target` to `pkg/path`; the root package is null."""
    return F.nullif(F.regexp_replace(F.regexp_replace(label, r"^@?[^/]*//", ""), r":[^:]*$", ""), F.lit(""))


def owner_path(file: Column, label: Column | None = None, use_package: bool = False) -> Column:
    """The file, else the Bazel package where that is asked for."""
    own = F.nullif(file, F.lit(""))
    return F.coalesce(own, bazel_package(label)) if use_package and label is not None else own


def to_test_case_runs(cases: DataFrame, org: str, repo: Column, variant: str = "", quarantine: DataFrame | None = None, owners: DataFrame | None = None) -> DataFrame:
    """The fact table from cases.

    owners: bundle_id, path, owners. quarantine: bundle_id, test_id. Empty values of missing
    texts are kept as empty strings, as the report format has them.
    """
    rows = with_line_attempt(with_status_output(with_inherited_output(with_run_times(cases))))
    rows = rows.withColumn("file", F.coalesce(resolved_file(), F.lit("")))
    rows = rows.withColumn("test_id", run_id(F.lit(org), repo, F.col("file"), F.col("classname"), F.col("parent_name"), F.col("name"), F.col("raw_id"), F.lit(variant)))
    if quarantine is not None:
        q = quarantine.select("bundle_id", "test_id").distinct().withColumn("is_quarantined", F.lit(True))
        rows = rows.join(q, ["bundle_id", "test_id"], "left")
    else:
        rows = rows.withColumn("is_quarantined", F.lit(False))
    if owners is not None:
        o = owners.select("bundle_id", F.col("path").alias("_path"), F.col("owners").alias("_owners"))
        rows = rows.join(o, (rows.bundle_id == o.bundle_id) & (rows.file == o._path), "left").drop(o.bundle_id).drop("_path")
    else:
        rows = rows.withColumn("_owners", F.lit(None).cast("array<string>"))
    return rows.select(
        "bundle_id", "file_path", "seq", "suite_pos", "case_pos", "parent_name", "name", F.coalesce("classname", F.lit("")).alias("classname"), "file", "status", "started_at", "finished_at",
        F.coalesce("raw_id", F.lit("")).alias("raw_id"), "test_id", F.coalesce("is_quarantined", F.lit(False)).alias("is_quarantined"), "line_number", "attempt_index",
        "status_output_message", "test_output", F.coalesce("_owners", F.array().cast("array<string>")).alias("codeowners"),
    )


# Fixed value: escape sequences of terminals.
ANSI = r"\x1b(?:[@-Z\\\\-_]|\[[0-?]*[ -/]*[@-~])"


def normalize_rspec_runs(rows: DataFrame) -> DataFrame:
    """Rows of the Ruby adapter as runs.

    Takes id, location, description_generated, name, file, parent_name, status (passed,
    failed, pending), quarantined and message. The class comes from the file, an empty
    parent is `rspec`, terminal codes go, a quarantined pass is a failure, and only generated
    descriptions get a raw id.
    """
    by_file = F.regexp_replace(F.regexp_replace(F.regexp_replace("file", r"\.[^/.]+$", ""), "/", "."), r"^\.+|\.+$", "")
    quarantined = F.coalesce(F.col("quarantined"), F.lit(False))
    status = F.when(F.col("status") == "passed", F.when(quarantined, F.lit("FAILURE")).otherwise(F.lit("SUCCESS"))).when(F.col("status") == "failed", F.lit("FAILURE")).when(F.col("status") == "pending", F.lit("SKIPPED"))
    raw = F.when(F.col("description_generated"), F.concat(F.lit(OWN_PREFIX), F.col("id"), F.lit("-"), F.col("location")))
    return (
        rows.withColumn("classname", by_file).withColumn("parent_name", F.coalesce(F.nullif(F.col("parent_name"), F.lit("")), F.lit("rspec")))
        .withColumn("message", F.regexp_replace(F.coalesce("message", F.lit("")), ANSI, "")).withColumn("status", F.coalesce(status, F.lit("UNSPECIFIED"))).withColumn("raw_id", F.coalesce(raw, F.lit("")))
    )
