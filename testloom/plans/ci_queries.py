"""CI facts over `ci`, `urls` and `runs`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from testloom.functions import text as T
from testloom.functions.steps import shared_folder
from testloom.operators import ci as C
from testloom.plans.adapters import IDS, view
from testloom.plans.registry import query
from testloom.sources.uploads import bundle_meta_json, scan_bundle_meta

STABLE = ("main", "master")


def envs(spark, sf_dir):
    """Environment maps of the view `ci`, by platform."""
    ref, pr, mail, title = (F.col(c) for c in ("ref", "pr", "author_email", "title"))
    maps = {
        "GITHUB_ACTIONS": {"GITHUB_ACTIONS": F.lit("true"), "GITHUB_REF": ref, "GITHUB_ACTOR": mail, "PR_TITLE": title, "GITHUB_REPOSITORY": F.lit("o/r"), "GITHUB_RUN_ID": F.col("bundle_id").cast("string")},
        "GITLAB_CI": {"GITLAB_CI": F.lit("true"), "CI_COMMIT_REF_NAME": ref, "CI_MERGE_REQUEST_IID": pr, "CI_COMMIT_AUTHOR": F.concat(title, F.lit(" <"), mail, F.lit(">")), "CI_JOB_NAME": title},
        "BUILDKITE": {"BUILDKITE": F.lit("true"), "BUILDKITE_BRANCH": ref, "BUILDKITE_PULL_REQUEST": pr, "BUILDKITE_BUILD_AUTHOR_EMAIL": mail, "BUILDKITE_BUILD_URL": F.lit("https://b"), "BUILDKITE_JOB_ID": F.col("bundle_id").cast("string")},
        "CIRCLECI": {"CIRCLECI": F.lit("true"), "CIRCLE_BRANCH": ref, "CIRCLE_PULL_REQUEST": F.concat(F.lit("https://h/pull/"), pr), "CIRCLE_USERNAME": mail, "CIRCLE_BUILD_URL": F.lit("https://circleci.com/gh/o/r/7")},
    }
    value = None
    for platform, entries in maps.items():
        m = F.create_map(*(x for k, v in entries.items() for x in (F.lit(k), v)))
        value = F.when(F.col("platform_key") == platform, m) if value is None else value.when(F.col("platform_key") == platform, m)
    return view(spark, sf_dir, "ci").withColumn("envs", value)


def info(spark, sf_dir):
    return C.extract_ci_info(envs(spark, sf_dir).drop("author_email", "title").withColumn("platform", C.detect_platform(F.col("envs"))))


PARSED = """p as materialized (select bundle_id, platform_key as platform, nullif(ref, '') as branch0, use_uncloned_repo, author_email as mail0, title as title0, pr as pr0,
  case platform_key when 'GITHUB_ACTIONS' then case when ref like 'refs/pull/%' then try_cast(replace(replace(ref, 'refs/pull/', ''), '/merge', '') as bigint) end else case when pr <> '' and regexp_matches(pr, '^[0-9]+$') then cast(pr as bigint) end end as pr_number,
  case platform_key when 'GITLAB_CI' then title else nullif(author_email, '') end as actor,
  case platform_key when 'GITLAB_CI' then author_email when 'BUILDKITE' then nullif(author_email, '') end as author_email,
  case when platform_key = 'GITHUB_ACTIONS' then title end as title,
  case platform_key when 'BUILDKITE' then 'https://b#' || cast(bundle_id as varchar) when 'CIRCLECI' then 'https://circleci.com/gh/o/r/7' when 'GITHUB_ACTIONS' then 'https://github.com/o/r/actions/runs/' || cast(bundle_id as varchar)
    || case when ref like 'refs/pull/%' then '?pr=' || replace(replace(ref, 'refs/pull/', ''), '/merge', '') else '' end end as job_url,
  case when platform_key = 'GITLAB_CI' then title end as workflow from ci),
b as materialized (select *, replace(replace(replace(branch0, 'refs/heads/', ''), 'refs/', ''), 'origin/', '') as branch from p)"""
CLASS = "case when {b} is null then null when {b} like '%trunk-merge/%' or {b} like '%gh-readonly-queue/%' or {b} like '%/gtmq\\_%' escape '\\' or {b} like 'gtmq\\_%' escape '\\' then 'MERGE' when pr_number is not null or {b} like 'pull/%' or {b} like 'remotes/pull/%' then 'PR' when {b} in ('main', 'master') then 'PB' else 'NONE' end"


@query("P11_detect_ci_platform", "ci", "select bundle_id, case when bundle_id % 13 = 0 then 'CUSTOM' else platform_key end as platform from ci")
def platform(spark, sf_dir):
    with_custom = F.when(F.col("bundle_id") % 13 == 0, F.map_concat(F.col("envs"), F.create_map(F.lit("CUSTOM"), F.lit("1")))).otherwise(F.col("envs"))
    return envs(spark, sf_dir).select("bundle_id", C.detect_platform(with_custom).alias("platform"))


@query("P12_extract_ci_info", "ci", f"with {PARSED} select bundle_id, platform, branch0 as branch, pr_number, actor, author_email, title, job_url, workflow from p")
def ci_info(spark, sf_dir):
    return info(spark, sf_dir).select("bundle_id", "platform", "branch", "pr_number", "actor", "author_email", "title", "job_url", "workflow")


def other_envs(spark, sf_dir):
    """Environment maps of the platforms that the view `ci` lacks, dealt over its rows."""
    ref, pr, mail, title, b = (F.col(c) for c in ("ref", "pr", "author_email", "title", "bundle_id"))
    n, page = b.cast("string"), F.concat(F.lit("https://j/"), b.cast("string"))
    odd = F.when(b % 2 == 1, page).otherwise("")
    maps = (
        {"CUSTOM": F.lit("true"), "JOB_URL": page, "JOB_NAME": title, "AUTHOR_EMAIL": mail, "AUTHOR_NAME": ref, "COMMIT_BRANCH": ref, "COMMIT_MESSAGE": title, "PR_NUMBER": pr, "PR_TITLE": n},
        {"BUILD_ID": n, "BUILD_URL": page, "CHANGE_BRANCH": ref, "BRANCH_NAME": F.lit("b"), "CHANGE_ID": pr, "CHANGE_AUTHOR_EMAIL": mail, "CHANGE_AUTHOR_DISPLAY_NAME": title},
        {"SEMAPHORE": F.lit("true"), "SEMAPHORE_ORGANIZATION_URL": odd, "SEMAPHORE_PROJECT_ID": F.lit("p"), "SEMAPHORE_JOB_ID": n, "SEMAPHORE_GIT_PR_BRANCH": odd, "SEMAPHORE_GIT_BRANCH": ref, "SEMAPHORE_GIT_PR_NUMBER": pr,
         "SEMAPHORE_GIT_COMMIT_AUTHOR": mail, "SEMAPHORE_GIT_COMMITTER": title, "SEMAPHORE_PROJECT_NAME": title, "SEMAPHORE_JOB_NAME": n},
        {"DRONE": F.lit("true"), "DRONE_SOURCE_BRANCH": ref, "DRONE_PULL_REQUEST": pr, "DRONE_COMMIT_AUTHOR": mail, "DRONE_COMMIT_AUTHOR_NAME": title, "DRONE_COMMIT_AUTHOR_EMAIL": mail, "DRONE_PULL_REQUEST_TITLE": title, "DRONE_BUILD_LINK": odd},
        {"BITBUCKET_BUILD_NUMBER": n, "BITBUCKET_WORKSPACE": F.lit("w"), "BITBUCKET_REPO_SLUG": F.lit("r"), "BITBUCKET_STEP_UUID": F.when(b % 2 == 1, F.concat(F.lit("{"), n, F.lit("}"))).otherwise(""), "BITBUCKET_BRANCH": ref, "BITBUCKET_PR_ID": pr, "BITBUCKET_PIPELINE_UUID": title},
        {"bamboo_buildNumber": n, "bamboo_buildResultsUrl": odd, "bamboo_resultsUrl": n, "bamboo_planRepository_branch": odd, "bamboo_planRepository_branchName": ref, "bamboo_repository_pr_key": pr, "bamboo_planRepository_username": mail, "bamboo_planName": title, "bamboo_shortJobName": n},
        {"TRIGGER_NAME": title, "BUILD_ID": n, "PROJECT_ID": odd, "_HEAD_BRANCH": ref, "BRANCH_NAME": F.lit("b"), "_PR_NUMBER": pr},
    )
    one = F.element_at(F.array(*(F.create_map(*(x for k, v in m.items() for x in (F.lit(k), v))) for m in maps)), (b % len(maps) + 1).cast("int"))
    return view(spark, sf_dir, "ci").select("bundle_id", one.alias("envs"))


@query("P12_other_platforms", "ci", """with p as (select bundle_id, bundle_id % 7 as k, nullif(ref, '') as ref, nullif(author_email, '') as mail, nullif(title, '') as title, cast(bundle_id as varchar) as n,
    case when bundle_id % 2 = 1 then 'https://j/' || cast(bundle_id as varchar) end as odd, case when regexp_matches(pr, '^[0-9]+$') then cast(pr as bigint) end as pr_number from ci)
  select bundle_id, ['CUSTOM', 'BUILD_ID', 'SEMAPHORE', 'DRONE', 'BITBUCKET_BUILD_NUMBER', 'bamboo_buildNumber', 'TRIGGER_NAME'][k + 1] as platform, pr_number,
    case k when 0 then 'https://j/' || n when 1 then 'https://j/' || n when 2 then odd || '/projects/p/jobs/' || n when 3 then odd when 4 then 'https://bitbucket.org/w/r/pipelines/results/' || n || case when odd is null then '' else '/steps/%7B' || n || '%7D' end
      when 5 then coalesce(odd, n) else 'https://console.cloud.google.com/cloud-build/builds/' || n || '?project=' || odd end as job_url,
    case k when 1 then coalesce(ref, 'b') when 2 then coalesce(odd, ref) when 5 then coalesce(odd, ref) when 6 then coalesce(ref, 'b') else ref end as branch,
    case when k in (0, 1, 2, 3, 5) then mail end as actor, case k when 0 then ref when 1 then title when 2 then title when 3 then title end as committer_name, case when k in (0, 1, 3) then mail end as committer_email,
    case k when 0 then ref when 1 then title when 2 then mail when 3 then title end as author_name, case when k in (0, 1, 3) then mail end as author_email, case when k = 0 then title end as commit_message,
    case k when 0 then n when 3 then title end as title, case when k in (0, 2, 4, 5, 6) then title end as workflow, case k when 0 then title when 2 then n when 4 then case when odd is not null then '{' || n || '}' end when 5 then n when 6 then n end as job from p""")
def other_ci_info(spark, sf_dir):
    return C.extract_ci_info(other_envs(spark, sf_dir).withColumn("platform", C.detect_platform(F.col("envs")))).drop("envs")


@query("P13_classify_branches", "ci", f"with {PARSED} select bundle_id, branch, {CLASS.format(b='branch')} as branch_class from b")
def branches(spark, sf_dir):
    return C.classify_branches(info(spark, sf_dir), STABLE).select("bundle_id", "branch", "branch_class")


@query("P14_enrich_from_repo", "ci", f"""with {PARSED}, e as (select *, case when use_uncloned_repo or branch is null then 'main' else branch end as br from b)
  select bundle_id, br as branch, {CLASS.format(b='br')} as branch_class, case when use_uncloned_repo or actor is null then mail0 else actor end as actor, case when use_uncloned_repo or author_email is null then mail0 else author_email end as author_email,
  title0 as commit_message from e""")
def enrich(spark, sf_dir):
    repo = view(spark, sf_dir, "ci").select("bundle_id", "use_uncloned_repo", F.lit("refs/heads/main").alias("head_branch"), "author_email", F.lit("someone").alias("author_name"), F.col("title").alias("commit_message"))
    return C.enrich_from_repo(C.classify_branches(info(spark, sf_dir), STABLE).drop("use_uncloned_repo"), repo, STABLE).select("bundle_id", "branch", "branch_class", "actor", "author_email", "commit_message")


@query("P10_parse_repo_urls", "urls", """with m as (select id, url, regexp_extract(url, '^(ssh|git|http|https|ftp|ftps)://([^/]*?@)?([^/]*)/(.+)/([^/]+)', ['s', 'u', 'h', 'o', 'n']) as a, regexp_extract(url, '^([^/]*?@)([^/]*):(.+)/([^/]+)', ['u', 'h', 'o', 'n']) as b from urls),
  p as (select id, case when a.h <> '' then a.h else b.h end as h, case when a.h <> '' then a.o else b.o end as o, regexp_replace(case when a.h <> '' then a.n else b.n end, '(\\.git)+$', '') as n from m)
  select id, nullif(h, '') as host, nullif(o, '') as owner, nullif(n, '') as name, h = '' as invalid, case when h <> '' then h || '/' || o || '/' || n end as full_name from p""")
def repo_urls(spark, sf_dir):
    return C.parse_repo_urls(view(spark, sf_dir, "urls")).drop("url")


@query("P16_test_case_urls", "runs", f"with {IDS} select seq, 'https://app.example.com/org/flaky-tests/test/' || test_id || '?repo=o%2Fr' as url from ids")
def urls(spark, sf_dir):
    from testloom.plans.retry_queries import runs

    return runs(spark, sf_dir).select("seq", C.test_case_url("https://api.example.com", F.lit("org"), F.col("test_id"), F.lit("o"), F.lit("r")).alias("url"))


@query("P18_redact_command_lines", "runs", "select seq, 'run  ' || name || ' again' as line from runs")
def redact(spark, sf_dir):
    line = F.concat(F.lit("run --token=k"), F.col("classname"), F.lit(" "), F.col("name"), F.lit(" again k"), F.col("classname"))
    return view(spark, sf_dir, "runs").select("seq", T.redacted_command(line, F.concat(F.lit("k"), F.col("classname"))).alias("line"))


@query("P19_capture_envs", "ci", "select bundle_id, case when bundle_id % 2 = 0 then 1 else 0 end + case when platform_key = 'GITHUB_ACTIONS' then 2 else 0 end as num_envs, case when bundle_id % 2 = 0 then cast(bundle_id as varchar) end as pr_number from ci")
def capture(spark, sf_dir):
    allowed = F.array(F.lit("GITHUB_REF"), F.lit("GITHUB_ACTOR"))
    kept = C.capture_envs(F.col("envs"), allowed, F.when(F.col("bundle_id") % 2 == 0, F.col("bundle_id")))
    return envs(spark, sf_dir).select("bundle_id", F.size(kept).alias("num_envs"), F.try_element_at(kept, F.lit(C.PR_NUMBER_OVERRIDE)).alias("pr_number"))


@query("P20_truncate_variant", "runs", "select seq, left(repeat('é', cast(seq % 50 as int)) || name, case when seq % 50 >= 32 then 32 else cast(64 - seq % 50 as int) end) as variant from runs")
def variant(spark, sf_dir):
    return view(spark, sf_dir, "runs").select("seq", C.truncate_variant(F.concat(F.repeat(F.lit("é"), (F.col("seq") % 50).cast("int")), F.col("name"))).alias("variant"))


#: Fields that a version of bundle metadata must have; each version has those of the older ones too.
REQUIRED = (("0.5.34", ("num_files", "num_tests")), ("0.6.2", ("command_line",)), ("0.7.7", ("bundle_upload_id_v2",)), ("0.7.8", ("failed_tests",)))


@query("S4_bundle_meta_version", "ci", """select bundle_id, case bundle_id % 6 when 0 then '0.5.29' when 1 then '0.5.34' when 2 then '0.6.2' when 3 then '0.7.7' when 4 then '0.7.8' else '0.5.29' end as schema_version,
  case when bundle_id % 6 between 1 and 4 then bundle_id end as num_files, case when bundle_id % 6 in (2, 3, 4, 5) then title end as command_line, nullif(ref, '') as branch, case when bundle_id % 6 = 4 then 1 else 0 end as n_failed from ci""")
def meta_version(spark, sf_dir):
    """Metadata files of five versions, and of one without the number of files, written and scanned."""
    b = F.col("bundle_id")
    level = F.when(b % 6 < 5, b % 6).otherwise(F.lit(2))
    values = {"num_files": F.when(b % 6 < 5, b), "num_tests": b, "command_line": F.col("title"), "bundle_upload_id_v2": F.col("title"), "failed_tests": F.array(F.struct(F.col("title").alias("name")))}
    fields = [F.when(level > k, values[f]).alias(f) for k, (_, names) in enumerate(REQUIRED) for f in names]
    meta = F.to_json(F.struct(b.cast("string").alias("bundle_upload_id"), F.struct(F.nullif(F.col("ref"), F.lit("")).alias("repo_head_branch")).alias("repo"), *fields))
    files = view(spark, sf_dir, "ci").groupBy(F.floor(b / 1000)).agg(F.concat(F.lit("["), F.array_join(F.collect_list(meta), ","), F.lit("]")).alias("value"))
    path = shared_folder(spark)
    files.select("value").write.option("maxRecordsPerFile", 1).text(path)
    out = scan_bundle_meta(spark, path)
    return out.select(F.col("bundle_upload_id").cast("long").alias("bundle_id"), "schema_version", "num_files", "command_line", F.col("repo.repo_head_branch").alias("branch"), F.coalesce(F.size("failed_tests"), F.lit(0)).alias("n_failed"))


#: What a metadata file has beside its fields: kinds of unknown values, and fields that are null.
BESIDE = ('"x": 1.5', '"x": "1.5"', '"x": {"a": [1, null, "é"]}', '"num_tests": null', '"variant": null, "x": false', '"org": "o"')


@query("S4_meta_unknown_fields", "ci", f"""with k as (select bundle_id, cast(bundle_id % {len(BESIDE)} as int) as k from ci)
  select bundle_id, case when k in (3) then '0.5.29' else '0.7.7' end as schema_version, case k when 0 then '{{"x":1.5}}' when 1 then '{{"x":"1.5"}}' when 2 then '{{"x":{{"a":[1,null,"é"]}}}}' when 4 then '{{"x":false}}' end as unknown,
  case k when 3 then 'num_tests' when 4 then 'variant' else '' end as nulls, case when k = 5 then 'o' end as org from k""")
def meta_unknown_fields(spark, sf_dir):
    """Files scanned, written again and scanned again: unknown fields keep their types, null and absent stay apart."""
    b = F.col("bundle_id")
    beside = F.element_at(F.array(*map(F.lit, BESIDE)), (b % len(BESIDE) + 1).cast("int"))
    known = F.when(b % len(BESIDE) == 3, "").otherwise('"num_tests": 2, ')
    text = F.concat(F.lit('{"bundle_upload_id": "'), b.cast("string"), F.lit('", "num_files": 1, '), known, F.lit('"command_line": "c", "bundle_upload_id_v2": "v", '), beside, F.lit("}"))
    files = view(spark, sf_dir, "ci").groupBy(F.floor(b / 1000)).agg(F.concat(F.lit("["), F.array_join(F.collect_list(text), ","), F.lit("]")).alias("value"))
    path, again = shared_folder(spark), shared_folder(spark)
    files.select("value").write.option("maxRecordsPerFile", 1).text(path)
    written = scan_bundle_meta(spark, path).select(bundle_meta_json().alias("value"), F.floor(F.col("bundle_upload_id").cast("long") / 1000).alias("k"))
    written.groupBy("k").agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit("]")).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(again)
    out = scan_bundle_meta(spark, again)
    return out.select(F.col("bundle_upload_id").cast("long").alias("bundle_id"), "schema_version", "unknown", F.array_join("nulls", ",").alias("nulls"), "org")


@query("P22_as_meta_version", "ci", """with m as (select *, cast(bundle_id % 7 as int) as k, cast(bundle_id as varchar) as b from ci)
  select bundle_id, ['0.5.29', '0.5.34', '0.6.2', '0.6.3', '0.7.6', '0.7.7', '0.7.8'][k + 1] as version, case when k >= 1 then bundle_id end as num_files, case when k >= 2 then title end as command_line,
    case when k = 3 then coalesce(nullif(author_email, ''), b) when k > 3 then nullif(author_email, '') end as bundle_upload_id_v2, case when k >= 4 then ref end as variant, case when k >= 5 then pr end as internal_bundled_file, case when k >= 6 then title end as failed_tests from m""")
def old_meta(spark, sf_dir):
    """Each bundle as one of the seven versions has it."""
    b = F.col("bundle_id")
    m = view(spark, sf_dir, "ci").select(
        "bundle_id", b.cast("string").alias("bundle_upload_id"), F.nullif(F.col("author_email"), F.lit("")).alias("bundle_upload_id_v2"), b.alias("num_files"), F.col("title").alias("command_line"),
        F.col("ref").alias("variant"), F.col("pr").alias("internal_bundled_file"), F.col("title").alias("failed_tests"),
    )
    versions = [v for v, _ in reversed(C.META_VERSIONS)]
    rows = [C.as_meta_version(m.where(b % len(versions) == k), v) for k, v in enumerate(versions)]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), rows).drop("bundle_upload_id")


@query("P23_test_collection", "ci", "select bundle_id, case when ref <> '' and pr <> '' then ref end as ref, case when ref <> '' and pr <> '' then title end as title from ci")
def collection(spark, sf_dir):
    one = C.test_collection(F.nullif(F.col("ref"), F.lit("")), F.nullif(F.col("pr"), F.lit("")), F.col("title"), ("a", "b", "c"))
    return view(spark, sf_dir, "ci").select("bundle_id", one.alias("x")).select("bundle_id", F.col("x.a").alias("ref"), F.col("x.c").alias("title"))


@query("S15_upload_metrics", "ci", """select bundle_id, case when author_email = '' then 0 else 1 end as major, cast(bundle_id % 10 as int) as minor, 3 as patch, case when pr = '' then '' else pr end as suffix, 'h' as host, title as name,
  bundle_id % 9 = 0 as failed, case when bundle_id % 9 = 0 then title else '' end as failure_reason, commit_ts as upload_started_at, commit_ts + interval 3 second as upload_finished_at, case when ref <> '' then commit_ts - interval 1 day end as command_started_at from ci""")
def metrics(spark, sf_dir):
    b, at = F.col("bundle_id"), F.col("commit_ts")
    number = F.concat(F.when(F.col("author_email") == "", "client 0.").otherwise("client 1."), (b % 10).cast("string"), F.lit(".3"))
    rows = view(spark, sf_dir, "ci").select(
        "bundle_id", F.concat(number, F.when(F.col("pr") == "", "").otherwise(F.concat(F.lit("-"), "pr"))).alias("client_version"), F.lit("h").alias("host"), F.lit("o").alias("owner"), F.col("title").alias("name"),
        at.alias("upload_started_at"), (at + F.expr("interval 3 second")).alias("upload_finished_at"), F.when(F.col("ref") != "", at - F.expr("interval 1 day")).alias("command_started_at"),
        F.when(b % 9 == 0, F.lit(True)).alias("failed"), F.when(b % 9 == 0, F.col("title")).alias("failure_reason"), F.lit("SUCCESS").alias("quarantine_query"),
    )
    v = F.col("client_version")
    return C.upload_metrics(rows).select(
        "bundle_id", v["major"].alias("major"), v["minor"].alias("minor"), v["patch"].alias("patch"), v["suffix"].alias("suffix"), F.col("repo.host").alias("host"), F.col("repo.name").alias("name"),
        "failed", "failure_reason", "upload_started_at", "upload_finished_at", "command_started_at",
    )
