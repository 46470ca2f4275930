"""Validation over `cases_t` and `ci`."""

from __future__ import annotations

from pyspark.sql import functions as F

from testloom.functions.steps import shared_folder
from testloom.functions.times import not_defaulted
from testloom.operators import validation as V
from testloom.plans.adapters import view
from testloom.plans.registry import query
from testloom.sources import junit

KEYS = ("bundle_id", "seq")
OLD, STALE = "(> 24 hour(s)) timestamp", "(> 1 hour(s)) timestamp"
LENGTH = "octet_length(encode(regexp_replace(coalesce({c}, ''), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')))"


def rule(test: str, level: int, message: str, source: str = "cases_t", keys: str = "bundle_id, seq") -> str:
    return f"select {keys}, {level} as level, '{message}' as error_message from {source} where {test}"


def n(c: str) -> str:
    return LENGTH.format(c=c)


V1 = " union all ".join([rule(f"{n('name')} = 0", 2, "test suite names are missing"), rule(f"{n('name')} > 1000", 1, "test suite name too long, truncated to 1000")])
V2 = " union all ".join([
    rule(f"{n('name')} = 0", 2, "test case name too short"), rule(f"{n('name')} > 1000", 1, "test case name too long, truncated to 1000"),
    rule(f"{n('file')} = 0", 1, "test case file or filepath too short"), rule(f"{n('file')} > 1000", 1, "test case file or filepath too long"),
    rule(f"{n('classname')} = 0", 1, "test case classname too short"), rule("case_time is null and suite_time is null and report_time is null", 1, "test case or parent has no time duration"),
])
TIMES = """tm as (select *, epoch_us(ref_ts) as r, case when case_ts > ref_ts - interval 30 day then epoch_us(case_ts) end as c, case when suite_ts > ref_ts - interval 30 day then epoch_us(suite_ts) end as s,
  case when report_ts > ref_ts - interval 30 day then epoch_us(report_ts) end as p, epoch_us(start_time) as b from cases_t),
ts as (select *, coalesce(c, s, p) as own from tm), tt as (select *, own + b - coalesce(epoch_us(report_ts), epoch_us(suite_ts), own) as t from ts), tv as (select *, (r - t) // 3600000000 as h from tt)"""
V3 = " union all ".join([
    rule("t is null", 1, "test case or parent has no timestamp", "tv"), rule("r < t", 1, "test case or parent has future timestamp", "tv"), rule("r >= t and h > 24", 1, f"test case or parent has old {OLD}", "tv"),
    rule("r >= t and h > 1 and h <= 24", 1, f"test case or parent has stale {STALE}", "tv"), rule("t > b", 1, "test case timestamp is after test runner report end time", "tv"),
])
ISSUES = f"{TIMES}, iss as materialized ({V2} union all {V3})"
LIFT = "case error_message " + " ".join(f"when '{k}' then '{v}'" for k, v in V.LIFTED.items()) + " end"
LIFTED = f"lf as (select bundle_id, {LIFT} as lifted, level, error_message from iss), al as materialized (select distinct bundle_id, 'report' as scope, 1 as level, lifted as error_message from lf where lifted is not null union all select bundle_id, 'case', level, error_message from lf where lifted is null)"


def cases(spark, sf_dir):
    return view(spark, sf_dir, "cases_t")


def case_issues(spark, sf_dir):
    c = cases(spark, sf_dir)
    return V.validate_cases(c, KEYS).unionByName(V.validate_case_times(c, KEYS, runner_start="start_time"))


def lifted(spark, sf_dir):
    return V.lift_report_issues(case_issues(spark, sf_dir), ["bundle_id"])


@query("V1_validate_suites", "cases_t", V1)
def suites(spark, sf_dir):
    return V.validate_suites(cases(spark, sf_dir), KEYS, "name")


@query("V2_validate_cases", "cases_t", V2)
def validate_cases(spark, sf_dir):
    return V.validate_cases(cases(spark, sf_dir), KEYS)


@query("V3_validate_case_times", "cases_t", f"with {TIMES} {V3}")
def case_times(spark, sf_dir):
    return V.validate_case_times(cases(spark, sf_dir), KEYS, runner_start="start_time")


def runner_sql(c: str, name: str) -> list[str]:
    h = f"(epoch_us(ref_ts) - epoch_us({c})) // 3600000000"
    return [rule(f"{c} > ref_ts", 1, f"test runner report {name} has future timestamp"), rule(f"{c} <= ref_ts and {h} > 24", 1, f"test runner report {name} has old {OLD}"), rule(f"{c} <= ref_ts and {h} > 1 and {h} <= 24", 1, f"test runner report {name} has stale {STALE}")]


@query("V4_validate_runner_report", "cases_t", " union all ".join([rule("end_time < start_time", 1, "test runner report end time is before start time"), *runner_sql("start_time", "start time"), *runner_sql("end_time", "end time")]))
def runner_report(spark, sf_dir):
    return V.validate_runner_report(cases(spark, sf_dir), KEYS)


@query("F4_discard_defaulted", "cases_t", "select seq, case when case_ts > ref_ts - interval 30 day then epoch_us(case_ts) end as kept_us from cases_t")
def defaulted(spark, sf_dir):
    return cases(spark, sf_dir).select("seq", F.unix_micros(not_defaulted(F.col("case_ts"), F.col("ref_ts"))).alias("kept_us"))


@query("F5_valid_subset", "cases_t", f"with iv as ({V2}), bad as (select distinct bundle_id, seq from iv where level = 2) select seq from cases_t where not exists (select 1 from bad where bad.seq = cases_t.seq) and parent_name <> 'click'")
def valid_subset(spark, sf_dir):
    c = cases(spark, sf_dir)
    bad_suites = c.where("parent_name = 'click'").select("bundle_id", "parent_name").distinct().withColumn("level", F.lit(2))
    return V.valid_subset(c, V.validate_cases(c, KEYS), bad_suites, list(KEYS), ["bundle_id", "parent_name"]).select("seq")


@query("A14_lift_report_issues", "cases_t", f"with {ISSUES}, {LIFTED} select * from al")
def lift(spark, sf_dir):
    return lifted(spark, sf_dir)


@query("A13_issue_levels", "cases_t", f"with {ISSUES}, {LIFTED} select bundle_id, max(level) as max_level, coalesce(max(case when scope = 'report' then level end), 0) as report_level, count_if(level = 2) as num_invalid, count_if(level = 1) as num_suboptimal from al group by 1")
def levels(spark, sf_dir):
    return V.issue_levels(lifted(spark, sf_dir), ["bundle_id"])


@query("A15_validation_summary", "cases_t", f"""with {ISSUES}, pf as (select c.bundle_id, c.parent_name, count_if(level = 2) as i, count_if(level = 1) as s from cases_t c left join iss using (bundle_id, seq) group by 1, 2)
  select bundle_id, count_if(i = 0 and s = 0) as num_valid_files, count_if(s > 0) as num_warning_files, count_if(i > 0) as num_error_files, cast(sum(i) as bigint) as num_invalid, cast(sum(s) as bigint) as num_suboptimal, cast(max(case when i > 0 then 1 else 0 end) as int) as exit_code from pf group by 1""")
def summary(spark, sf_dir):
    files = cases(spark, sf_dir).select("bundle_id", "parent_name").distinct()
    c = cases(spark, sf_dir)
    keys = ["bundle_id", "parent_name"]
    found = V.validate_cases(c, keys).unionByName(V.validate_case_times(c, keys, runner_start="start_time")).withColumn("scope", F.lit("case"))
    return V.validation_summary(files, V.issue_levels(found, keys), ["bundle_id"], keys)


@query("A15_totals_while_writing", "cases_t", f"with {ISSUES} select count(*) as num_issues, cast(max(level) as int) as max_level, count_if(level = 2) as num_invalid, count_if(level = 1) as num_suboptimal from iss")
def totals_while_writing(spark, sf_dir):
    return V.write_issues(case_issues(spark, sf_dir), shared_folder(spark))


#: Report files by kind, and what each is found to be: invalid and suboptimal issues.
PARSED = (("<testsuites><testsuite>", 0, 1), ("<testsuites></testsuite>", 1, 0), ("<testsuites/><testsuites/>", 1, 0), ("<testsuites><testsuite/></testsuites>", 0, 0), ("<a><failure/><testsuites/></a>", 1, 0))


@query("A15_parse_issues", "cases_t", f"""with f as (select distinct bundle_id, parent_name, (bundle_id + length(parent_name)) % {len(PARSED)} as k from cases_t), v(k, i, s) as (values {', '.join(f'({k}, {i}, {s})' for k, (_, i, s) in enumerate(PARSED))})
  select bundle_id, count_if(i = 0 and s = 0) as num_valid_files, count_if(s > 0) as num_warning_files, count_if(i > 0) as num_error_files, cast(sum(i) as bigint) as num_invalid, cast(sum(s) as bigint) as num_suboptimal, max(i) as exit_code from f join v using (k) group by 1""")
def parse_issues(spark, sf_dir):
    """A run's files with their parse issues: unreadable ones are errors."""
    path = shared_folder(spark)
    files = cases(spark, sf_dir).select("bundle_id", "parent_name").distinct()
    text = F.element_at(F.array(*(F.lit(t) for t, *_ in PARSED)), ((F.col("bundle_id") + F.length("parent_name")) % len(PARSED) + 1).cast("int"))
    files.withColumn("value", text).repartition(8, "bundle_id").write.partitionBy("bundle_id", "parent_name").text(path)
    found = junit.scan_junit_issues(spark, f"{path}/*/*").withColumns({"bundle_id": F.regexp_extract("file_path", r"bundle_id=(\d+)", 1).cast("long"), "parent_name": F.regexp_extract("file_path", "parent_name=([^/]+)", 1), "scope": F.lit("report")})
    keys = ["bundle_id", "parent_name"]
    return V.validation_summary(files, V.issue_levels(found, keys), ["bundle_id"], keys)


@query("A16_owner_coverage", "cases_t", "select bundle_id, max(case when file is null then 1 else 0 end) = 1 and bundle_id % 2 = 0 as owners_but_no_file from cases_t group by bundle_id")
def owner_coverage(spark, sf_dir):
    return V.owner_coverage_warning(cases(spark, sf_dir), F.col("bundle_id") % 2 == 0, ["bundle_id"])


@query("A19_U3_files_without_issues", "cases_t", f"with {ISSUES} select bundle_id, seq from cases_t where not exists (select 1 from iss where iss.seq = cases_t.seq)")
def clean_files(spark, sf_dir):
    return V.files_without_issues(cases(spark, sf_dir).select(*KEYS), case_issues(spark, sf_dir), list(KEYS))


@query("L1_ordered_issues", "cases_t", f"with {ISSUES} select *, row_number() over (partition by bundle_id, seq order by level desc, error_message) as place from iss")
def ordered(spark, sf_dir):
    return V.ordered_issues(case_issues(spark, sf_dir), list(KEYS))


@query("L2_limit_report", "cases_t", f"""with {ISSUES}, d as (select distinct bundle_id, seq from iss), f as (select *, row_number() over (partition by bundle_id order by seq) as r, greatest(count(*) over (partition by bundle_id) - 8, 0) as files_left_out from d),
  w as (select iss.*, files_left_out, row_number() over (partition by bundle_id, seq, level order by error_message) as place from iss join f using (bundle_id, seq) where r <= 8)
  select bundle_id, seq, level, error_message, files_left_out from w where place <= 8""")
def limited(spark, sf_dir):
    return V.limit_report(case_issues(spark, sf_dir), ["bundle_id"], "seq")


CI = """c as (select bundle_id, case when bundle_id % 6 = 4 then null else ref end as branch, try_cast(pr as bigint) as pr_number, nullif(author_email, '') as author_email, title, commit_ts,
  case bundle_id % 4 when 0 then 'PR' when 1 then 'NONE' when 2 then 'MERGE' else null end as branch_class from ci)"""


def env_sql() -> str:
    parts = []
    for column, what, limit in V.ENV_FIELDS:
        c = column if column in ("author_email", "branch", "title") else "null"
        c = "cast(null as varchar)" if c == "null" else c
        parts += [rule(f"{n(c)} = 0", 1, f"{what} too short", "c", "bundle_id"), rule(f"{n(c)} > {limit}", 1, f"{what} too long, truncated to {limit}", "c", "bundle_id")]
    parts += [rule("branch_class = 'PR' and pr_number is null", 1, V.NO_PR_NUMBER, "c", "bundle_id"), rule("branch_class in ('PB', 'NONE') and pr_number is not null", 1, V.PR_NUMBER_CONFLICT, "c", "bundle_id")]
    return " union all ".join(parts)


def ci(spark, sf_dir):
    b = F.col("bundle_id")
    c = view(spark, sf_dir, "ci").select(
        "bundle_id", F.when(b % 6 != 4, F.col("ref")).alias("branch"), F.col("pr").try_cast("long").alias("pr_number"), F.nullif(F.col("author_email"), F.lit("")).alias("author_email"), "title", "commit_ts",
        F.when(b % 4 == 0, F.lit("PR")).when(b % 4 == 1, F.lit("NONE")).when(b % 4 == 2, F.lit("MERGE")).alias("branch_class"),
    )
    for column, _, _ in V.ENV_FIELDS:
        c = c if column in c.columns else c.withColumn(column, F.lit(None).cast("string"))
    return c


@query("V5_validate_env", "ci", f"with {CI} {env_sql()}")
def env(spark, sf_dir):
    return V.validate_env(ci(spark, sf_dir), ["bundle_id"])


@query("V6_validate_meta", "ci", f"with {CI}, e as ({env_sql()}) select bundle_id, case when error_message in ('CI info branch name too short', '{V.NO_PR_NUMBER}', '{V.PR_NUMBER_CONFLICT}') then 2 else level end as level, error_message from e where error_message not like 'CI info title%'")
def meta(spark, sf_dir):
    return V.validate_meta(V.validate_env(ci(spark, sf_dir), ["bundle_id"]))


NOW = "timestamp '1998-01-01'"
AGE = f"(epoch_us({NOW}) - epoch_us(cast(commit_ts as timestamp))) // 3600000000"


@query("V7_validate_repo", "ci", " union all ".join([
    rule("coalesce(author_email, '') = ''", 1, "repo head commit author email too short", "ci", "bundle_id"), rule("title = ''", 1, "repo head commit author name too short", "ci", "bundle_id"), rule("ref = ''", 1, "repo branch name too short", "ci", "bundle_id"),
    rule("pr = ''", 1, "repo head commit message too short", "ci", "bundle_id"), rule("pr = ''", 2, "repo sha too short", "ci", "bundle_id"),
    rule(f"cast(commit_ts as timestamp) > {NOW}", 1, "repo head commit has future timestamp", "ci", "bundle_id"), rule(f"cast(commit_ts as timestamp) <= {NOW} and {AGE} > 24", 1, f"repo head commit has old {OLD}", "ci", "bundle_id"),
    rule(f"cast(commit_ts as timestamp) <= {NOW} and {AGE} > 1 and {AGE} <= 24", 1, f"repo head commit has stale {STALE}", "ci", "bundle_id"),
]))
def repo(spark, sf_dir):
    r = view(spark, sf_dir, "ci").select("bundle_id", "author_email", F.col("title").alias("author_name"), F.col("ref").alias("branch"), F.col("pr").alias("commit_message"), F.col("pr").alias("sha"), F.col("commit_ts").cast("timestamp").alias("commit_ts"), F.expr("timestamp '1998-01-01'").alias("now"))
    return V.validate_repo(r, ["bundle_id"])
