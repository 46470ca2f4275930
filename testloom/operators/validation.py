"""Graded validation of reports, runners, CI facts, metadata and repos.

Every rule set yields issues in long form: the keys of its input, `level` (1 suboptimal,
2 invalid) and `error_message`. Rules are column expressions in one array that is
exploded once, so each table is read once whatever the number of rules.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from testloom.functions.text import BRANCH_BYTES, EMAIL_BYTES, FIELD_BYTES, SHA_BYTES, too_long, too_short
from testloom.functions.times import age, not_defaulted

SUBOPTIMAL, INVALID = 1, 2

# Messages. Fixed values.
NO_FILE = "test case file or filepath too short"
CASE_TIMES = {
    None: "test case or parent has no timestamp",
    "future": "test case or parent has future timestamp",
    "old": "test case or parent has old (> 24 hour(s)) timestamp",
    "stale": "test case or parent has stale (> 1 hour(s)) timestamp",
}
AFTER_RUNNER = "test case timestamp is after test runner report end time"
#: Case-level messages that become one message of the report.
LIFTED = {
    NO_FILE: "report has test cases with missing file or filepath",
    CASE_TIMES[None]: "report has test cases with missing timestamp",
    CASE_TIMES["future"]: "report has test cases with future timestamp",
    CASE_TIMES["old"]: "report has old (> 24 hour(s)) timestamps",
    CASE_TIMES["stale"]: "report has stale (> 1 hour(s)) timestamps",
}

Rule = tuple[Column, int, str]


def issues(df: DataFrame, keys: Iterable[str], rules: Iterable[Rule]) -> DataFrame:
    found = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(level).alias("level"), F.lit(text).alias("error_message"))) for test, level, text in rules)))
    return df.select(*keys, F.explode(found).alias("_x")).select(*keys, "_x.level", "_x.error_message")


def length_rules(column: str, what: str, limit: int, short: int | None = SUBOPTIMAL, missing: str | None = None, cut: bool = True) -> list[Rule]:
    rules = [(too_long(F.col(column), limit), SUBOPTIMAL, f"{what} too long, truncated to {limit}" if cut else f"{what} too long")]
    if short:
        rules.insert(0, (too_short(F.col(column)), short, missing or f"{what} too short"))
    return rules


def validate_suites(suites: DataFrame, keys: Iterable[str], name: str = "parent_name") -> DataFrame:
    """V1"""
    return issues(suites, keys, length_rules(name, "test suite name", FIELD_BYTES, INVALID, "test suite names are missing"))


def validate_cases(cases: DataFrame, keys: Iterable[str], times: tuple[str, ...] = ("case_time", "suite_time", "report_time")) -> DataFrame:
    """V2: name, file, classname and duration of cases."""
    no_time = F.coalesce(*(F.col(c) for c in times)).isNull()
    return issues(
        cases, keys,
        [*length_rules("name", "test case name", FIELD_BYTES, INVALID), *length_rules("file", "test case file or filepath", FIELD_BYTES, cut=False),
         *length_rules("classname", "test case classname", FIELD_BYTES), (no_time, SUBOPTIMAL, "test case or parent has no time duration")],
    )


def validate_case_times(cases: DataFrame, keys: Iterable[str], reference: str = "ref_ts", runner_start: str | None = None) -> DataFrame:
    """V3: the case's, suite's or report's time that isn't a default, shifted to the runner's start."""
    ref = F.col(reference)
    times = [not_defaulted(F.col(c), ref) for c in ("case_ts", "suite_ts", "report_ts")]
    own = F.coalesce(*times)
    start = F.col(runner_start) if runner_start else F.lit(None).cast("timestamp")
    shift = F.unix_micros(start) - F.unix_micros(F.coalesce(F.col("report_ts"), F.col("suite_ts"), own))
    shifted = F.timestamp_micros(F.unix_micros(own) + F.coalesce(shift, F.lit(0).cast("long")))
    cases = cases.withColumn("_t", shifted)
    state = age(F.col("_t"), ref)
    rules = [(F.col("_t").isNull(), SUBOPTIMAL, CASE_TIMES[None])] + [(state == k, SUBOPTIMAL, v) for k, v in CASE_TIMES.items() if k]
    if runner_start:  # the rule is named after the end time but compares with the start
        rules.append((F.col("_t") > start, SUBOPTIMAL, AFTER_RUNNER))
    return issues(cases, keys, rules)


def validate_runner_report(runners: DataFrame, keys: Iterable[str], reference: str = "ref_ts") -> DataFrame:
    """V4"""
    what = "test runner report"
    rules: list[Rule] = [(F.col("end_time") < F.col("start_time"), SUBOPTIMAL, f"{what} end time is before start time")]
    for c, name in (("start_time", "start time"), ("end_time", "end time")):
        state = age(F.col(c), F.col(reference))
        rules += [(state == "future", SUBOPTIMAL, f"{what} {name} has future timestamp"), (state == "old", SUBOPTIMAL, f"{what} {name} has old (> 24 hour(s)) timestamp"), (state == "stale", SUBOPTIMAL, f"{what} {name} has stale (> 1 hour(s)) timestamp")]
    return issues(runners, keys, rules)


#: Fields of CI facts: (column, name in messages, bytes).
ENV_FIELDS = (
    ("actor", "CI info actor", FIELD_BYTES), ("author_email", "CI info author email", EMAIL_BYTES), ("author_name", "CI info author name", FIELD_BYTES),
    ("branch", "CI info branch name", BRANCH_BYTES), ("commit_message", "CI info commit message", FIELD_BYTES), ("committer_email", "CI info committer email", EMAIL_BYTES),
    ("committer_name", "CI info committer name", FIELD_BYTES), ("job_url", "CI info job URL", FIELD_BYTES), ("title", "CI info title", FIELD_BYTES),
)
NO_PR_NUMBER = "CI info is classified as a PR, but has no PR number"
PR_NUMBER_CONFLICT = "CI info has a PR number, but branch is not classified as a PR"


def validate_env(ci: DataFrame, keys: Iterable[str]) -> DataFrame:
    """V5: lengths of nine fields, and PR number against branch class."""
    rules: list[Rule] = []
    for column, what, limit in ENV_FIELDS:
        rules += length_rules(column, what, limit)
    is_pr = F.coalesce(F.col("branch_class") == "PR", F.lit(False))
    other = F.coalesce(F.col("branch_class").isin("PB", "NONE"), F.lit(False))
    rules += [(is_pr & F.col("pr_number").isNull(), SUBOPTIMAL, NO_PR_NUMBER), (other & F.col("pr_number").isNotNull(), SUBOPTIMAL, PR_NUMBER_CONFLICT)]
    return issues(ci, keys, rules)


def validate_meta(env_issues: DataFrame) -> DataFrame:
    """V6: V5 for bundle metadata: a short branch and both PR rules are invalid, the title doesn't count."""
    worse = F.col("error_message").isin("CI info branch name too short", NO_PR_NUMBER, PR_NUMBER_CONFLICT)
    return env_issues.where(~F.col("error_message").startswith("CI info title")).withColumn("level", F.when(worse, F.lit(INVALID)).otherwise(F.col("level")))


def validate_repo(repos: DataFrame, keys: Iterable[str], now: str = "now") -> DataFrame:
    """V7: repo facts; `now` is a column, never the clock."""
    state = age(F.col("commit_ts"), F.col(now))
    rules = [
        *length_rules("author_email", "repo head commit author email", EMAIL_BYTES), *length_rules("author_name", "repo head commit author name", FIELD_BYTES),
        (too_short(F.col("branch")), SUBOPTIMAL, "repo branch name too short"), (too_long(F.col("branch"), BRANCH_BYTES), SUBOPTIMAL, f"repo head branch name too long, truncated to {BRANCH_BYTES}"),
        *length_rules("commit_message", "repo head commit message", FIELD_BYTES), *length_rules("sha", "repo sha", SHA_BYTES, INVALID),
        (state == "future", SUBOPTIMAL, "repo head commit has future timestamp"), (state == "old", SUBOPTIMAL, "repo head commit has old (> 24 hour(s)) timestamp"), (state == "stale", SUBOPTIMAL, "repo head commit has stale (> 1 hour(s)) timestamp"),
    ]
    return issues(repos, keys, rules)


def valid_subset(cases: DataFrame, case_issues: DataFrame, suite_issues: DataFrame, case_keys: list[str], suite_keys: list[str]) -> DataFrame:
    """cases without invalid issue in suites without invalid issue."""
    bad_cases, bad_suites = (d.where(F.col("level") == INVALID).select(*k).distinct() for d, k in ((case_issues, case_keys), (suite_issues, suite_keys)))
    return cases.join(bad_cases, case_keys, "left_anti").join(bad_suites, suite_keys, "left_anti")


def lift_report_issues(case_issues: DataFrame, file_keys: list[str]) -> DataFrame:
    """Five kinds of case issues become one report issue a file; the others stay."""
    lifted = F.create_map(*(F.lit(x) for kv in LIFTED.items() for x in kv))
    rows = case_issues.withColumn("_lift", F.try_element_at(lifted, F.col("error_message")))
    report = rows.where("_lift is not null").groupBy(*file_keys, F.col("_lift").alias("error_message")).agg(F.lit(SUBOPTIMAL).alias("level")).select(*file_keys, F.lit("report").alias("scope"), "level", "error_message")
    rest = rows.where("_lift is null").select(*file_keys, F.lit("case").alias("scope"), "level", "error_message")
    return report.unionByName(rest)


def issue_levels(found: DataFrame, file_keys: list[str]) -> DataFrame:
    """Per file: greatest level, greatest level of report issues, counts by level.

    An unreadable file's issue (level 3) counts as invalid.
    """
    report = F.coalesce(F.max(F.when(F.col("scope") == "report", F.col("level"))), F.lit(0))
    return found.groupBy(*file_keys).agg(F.max("level").alias("max_level"), report.alias("report_level"), F.count_if(F.col("level") >= INVALID).alias("num_invalid"), F.count_if(F.col("level") == SUBOPTIMAL).alias("num_suboptimal"))


def files_without_issues(files: DataFrame, found: DataFrame, file_keys: list[str]) -> DataFrame:
    """Listed files that have no issue."""
    return files.join(found.select(*file_keys).distinct(), file_keys, "left_anti")


def ordered_issues(found: DataFrame, file_keys: list[str]) -> DataFrame:
    """L1: place of every issue in its file: invalid first, then by message."""
    return found.withColumn("place", F.row_number().over(Window.partitionBy(*file_keys).orderBy(F.col("level").desc(), "error_message")))


def limit_report(found: DataFrame, run_keys: list[str], file: str, mode: str = "limited", most_files: int = 8, most_issues: int = 8) -> DataFrame:
    """L2: issues to show of each run, with the number of its files left out.

    `limited`: the run's first files by name, and of each file the first issues of each
    level. Files are ranked on one row a file, inside their run.
    """
    if mode == "none":
        return found.limit(0).withColumn("files_left_out", F.lit(0).cast("long"))
    if mode == "full":
        return found.withColumn("files_left_out", F.lit(0).cast("long"))
    names = found.select(*run_keys, file).distinct()
    total = names.groupBy(*run_keys).agg(F.greatest(F.count("*") - most_files, F.lit(0)).alias("files_left_out"))
    rank = F.row_number().over(Window.partitionBy(*run_keys).orderBy(file))
    shown = names.withColumn("rank", rank).where(F.col("rank") <= most_files).drop("rank").join(total, run_keys)
    place = F.row_number().over(Window.partitionBy(*run_keys, file, "level").orderBy("error_message"))
    return found.join(shown, [*run_keys, file]).withColumn("place", place).where(F.col("place") <= most_issues).drop("place")


def validation_summary(files: DataFrame, levels: DataFrame, run_keys: list[str], file_keys: list[str]) -> DataFrame:
    """Per run: valid, warning and error files, issue totals and exit code.

    A valid file has no issue of either level; a file with issues of both levels counts as warning and as error.
    """
    per_file = files.join(levels, file_keys, "left").fillna(0, ["num_invalid", "num_suboptimal"])
    out = per_file.groupBy(*run_keys).agg(
        F.count_if((F.col("num_invalid") == 0) & (F.col("num_suboptimal") == 0)).alias("num_valid_files"),
        F.count_if(F.col("num_suboptimal") > 0).alias("num_warning_files"), F.count_if(F.col("num_invalid") > 0).alias("num_error_files"),
        F.sum("num_invalid").alias("num_invalid"), F.sum("num_suboptimal").alias("num_suboptimal"),
    )
    return out.withColumn("exit_code", F.when(F.col("num_error_files") > 0, F.lit(1)).otherwise(F.lit(0)))


def write_issues(found: DataFrame, path: str) -> DataFrame:
    """Write issues as Parquet; one row with the run's totals, observed while they are written.

    Columns num_issues, max_level, num_invalid, num_suboptimal: the issues are computed once.
    """
    totals = Observation()
    level = F.col("level")
    found.observe(
        totals, F.count(F.lit(1)).alias("num_issues"), F.coalesce(F.max(level), F.lit(0)).alias("max_level"),
        F.count_if(level >= INVALID).alias("num_invalid"), F.count_if(level == SUBOPTIMAL).alias("num_suboptimal"),
    ).write.parquet(path)
    seen = totals.get
    return found.sparkSession.createDataFrame([tuple(seen[k] for k in ("num_issues", "max_level", "num_invalid", "num_suboptimal"))], "num_issues long, max_level int, num_invalid long, num_suboptimal long")


def owner_coverage_warning(cases: DataFrame, has_owners: Column, run_keys: list[str]) -> DataFrame:
    """Whether owners exist but some case has no file."""
    return cases.groupBy(*run_keys).agg(F.max(has_owners & (F.coalesce("file", F.lit("")) == "")).alias("owners_but_no_file"))
