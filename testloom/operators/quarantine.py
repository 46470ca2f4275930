"""Failures after retries, and quarantine.

All take and return DataFrames of all uploads at once, keyed by bundle_id. Grouping is by
(bundle_id, test_id): partial aggregates go before the shuffle, and both sides of the
retry rule share it. Quarantine lists are dimension tables; they are joined by equality
and Spark broadcasts them where their size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("bundle_id", "test_id")


def runner_gate(files: DataFrame, status: str = "runner_status") -> DataFrame:
    """files without runner status or with FAILED; passed and flaky ones hold no failure."""
    return files.where(F.col(status).isNull() | (F.col(status) == "FAILED"))


def latest_failures(runs: DataFrame) -> DataFrame:
    """A4: per id the failure of the greatest time, ties to the later row."""
    failures = runs.where("status = 'FAILURE'")
    kept = [c for c in runs.columns if c not in KEYS]
    top = failures.groupBy(*KEYS).agg(F.max_by(F.struct(*kept), F.struct("time_ms", "seq")).alias("x"))
    return top.select(*KEYS, *(F.col("x")[c].alias(c) for c in kept))


def latest_successes(runs: DataFrame) -> DataFrame:
    """A5: greatest success time per id."""
    return runs.where("status = 'SUCCESS'").groupBy(*KEYS).agg(F.max("time_ms").alias("success_ms"))


def drop_recovered(failures: DataFrame, successes: DataFrame) -> DataFrame:
    """Failures without a strictly later success of the same id."""
    s = successes.select(*(F.col(k).alias(f"s_{k}") for k in KEYS), "success_ms")
    on = [failures[k] == s[f"s_{k}"] for k in KEYS] + [s.success_ms > failures.time_ms]
    return failures.join(s, on, "left_anti")


def failed_tests(runs: DataFrame) -> DataFrame:
    """What is left of failures after retries.

    One aggregation instead of a join of A4 and A5: both need the same keys, so a single
    shuffle of partial aggregates carries the latest failure and the latest success.
    """
    kept = [c for c in runs.columns if c not in KEYS]
    failed = F.col("status") == "FAILURE"
    both = runs.where(F.col("status").isin("FAILURE", "SUCCESS")).groupBy(*KEYS).agg(
        F.max_by(F.when(failed, F.struct(*kept)), F.when(failed, F.struct("time_ms", "seq"))).alias("x"),
        F.max(F.when(F.col("status") == "SUCCESS", F.col("time_ms"))).alias("success_ms"),
    )
    left = both.where(F.col("x").isNotNull() & (F.col("success_ms").isNull() | (F.col("success_ms") <= F.col("x.time_ms"))))
    return left.select(*KEYS, *(F.col("x")[c].alias(c) for c in kept))


def flag_quarantined(runs: DataFrame, quarantine: DataFrame, keys: tuple[str, ...] = ("bundle_id", "test_id")) -> DataFrame:
    """is_quarantined on every run."""
    q = quarantine.select(*keys).distinct().withColumn("_q", F.lit(True))
    return runs.join(q, list(keys), "left").withColumn("is_quarantined", F.coalesce("_q", F.lit(False))).drop("_q")


def flag_quarantined_as_of(runs: DataFrame, versions: DataFrame, keys: tuple[str, ...] = ("bundle_id",), time: str = "time_ms") -> DataFrame:
    """J5 for lists that change: runs with `list_ms`, the newest version at or before the run's time, and is_quarantined by it.

    versions: keys, list_ms, test_id, a row for each member of a version; a null test_id makes
    an empty version known. Before the first version, or without a time, nothing is
    quarantined. Versions of a list are one sorted array, so a run finds its own inside its
    row, and members are joined by equality: there is no range join, and no window that a
    list with many runs would fill.
    """
    lists = versions.groupBy(*keys).agg(F.sort_array(F.collect_set("list_ms")).alias("_versions"))
    at = F.try_element_at(F.filter("_versions", lambda v: v <= F.col(time)), F.lit(-1))
    rows = runs.join(lists, list(keys), "left").withColumn("list_ms", at).drop("_versions")
    members = versions.where("test_id is not null").select(*keys, "list_ms", "test_id").distinct().withColumn("_q", F.lit(True))
    return rows.join(members, [*keys, "list_ms", "test_id"], "left").withColumn("is_quarantined", F.coalesce("_q", F.lit(False))).drop("_q")


def split_quarantined(failures: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Failures with `quarantined`: listed, or flagged by the run itself."""
    flagged = F.coalesce(F.col("is_quarantined"), F.lit(False)) if "is_quarantined" in failures.columns else F.lit(False)
    q = quarantine.select(*KEYS).distinct().withColumn("_q", F.lit(True))
    return failures.join(q, list(KEYS), "left").withColumn("quarantined", F.coalesce("_q", F.lit(False)) | flagged).drop("_q")


def is_quarantined(requests: DataFrame, quarantine: DataFrame, repo_switch: DataFrame) -> DataFrame:
    """(listed, disabled, lookup_failed, effective) per request; a repo without row is a failed lookup."""
    q = quarantine.select("bundle_id", "test_id").distinct().withColumn("_q", F.lit(True))
    s = repo_switch.select("bundle_id", F.col("is_disabled").alias("_d"))
    out = requests.join(q, ["bundle_id", "test_id"], "left").join(s, "bundle_id", "left")
    out = out.withColumn("listed", F.coalesce("_q", F.lit(False))).withColumn("disabled", F.coalesce("_d", F.lit(False))).withColumn("lookup_failed", F.col("_d").isNull())
    return out.withColumn("effective", F.expr("listed and not disabled and not lookup_failed")).drop("_q", "_d")


def upload_summary(counts: DataFrame) -> DataFrame:
    """A10: passes and pass ratio of each upload from its total, failed and quarantined counts."""
    passed = F.greatest(F.lit(0), F.col("total") - F.col("quarantined") - F.col("failed"))
    ratio = F.when(F.col("total") > 0, F.concat(F.round(100.0 * passed / F.col("total"), 1).cast("decimal(20,1)").cast("string"), F.lit("%"))).otherwise(F.lit("N/A"))
    return counts.withColumn("passed", passed).withColumn("pass_ratio", ratio)


def quarantine_verdict(bundles: DataFrame, split: DataFrame) -> DataFrame:
    """Group verdict and exit code of each bundle.

    bundles: bundle_id, exit_code (of the command, null if not run), is_disabled, no_files.
    The group is quarantined if all failures are, so also if there are none; the exit code
    becomes 0 only if there are failures and all are quarantined. Disabled repos and bundles
    without files keep the command's code.
    """
    n = split.groupBy("bundle_id").agg(F.count("*").alias("total"), F.count_if("quarantined").alias("n_quarantined"))
    out = bundles.join(n, "bundle_id", "left").fillna(0, ["total", "n_quarantined"])
    off = F.col("no_files") | F.col("is_disabled")
    group = ~off & (F.col("total") == F.col("n_quarantined"))
    code = F.coalesce("exit_code", F.when(F.col("total") > 0, F.lit(1)).otherwise(F.lit(0)))
    return out.select(
        "bundle_id", "total", F.when(off, F.lit(0)).otherwise(F.col("n_quarantined")).alias("n_quarantined"), group.alias("group_is_quarantined"),
        F.when(off, F.coalesce("exit_code", F.lit(0))).when(group & (F.col("total") > 0), F.lit(0)).otherwise(code).alias("exit_code"),
    )


def query_result(disabled: Column, fetch: Column, cached: Column | None = None) -> Column:
    """Outcome of the quarantine query; fetch is FAILED, SKIPPED or SUCCEEDED, else unspecified."""
    out = F.when(disabled, F.lit("DISABLED"))
    out = out.when(cached, F.lit("CACHED")) if cached is not None else out
    return out.when(fetch == "FAILED", F.lit("FAILURE")).when(fetch == "SKIPPED", F.lit("SKIPPED")).when(fetch == "SUCCEEDED", F.lit("SUCCESS")).otherwise(F.lit("UNSPECIFIED"))


def failure_groups(failures: DataFrame, shown: int = 3) -> DataFrame:
    """L3: failures by file, else suite, else Other: the first `shown` of each and how many more there are."""
    group = F.coalesce(F.nullif(F.col("file"), F.lit("")), F.nullif(F.col("parent_name"), F.lit("")), F.lit("Other"))
    rows = failures.withColumn("failure_group", group)
    place = F.row_number().over(Window.partitionBy("bundle_id", "failure_group").orderBy("name", "seq"))
    rest = F.count("*").over(Window.partitionBy("bundle_id", "failure_group")) - shown
    return rows.withColumn("place", place).withColumn("more", F.greatest(rest, F.lit(0))).where(F.col("place") <= shown)
