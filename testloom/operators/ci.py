"""CI facts: platform, fields by platform, branches, repos, command lines, bundle metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from testloom.functions.text import FIELD_BYTES, VARIANT_BYTES, percent_encoded_segment, truncated

# The environment key that tells each platform, in order of the platforms.
PLATFORM_KEYS = (
    "GITHUB_ACTIONS", "BUILD_ID", "CIRCLECI", "BUILDKITE", "SEMAPHORE", "TRAVIS", "WEBAPPIO", "CODEBUILD_BUILD_ID",
    "BITBUCKET_BUILD_NUMBER", "TF_BUILD", "GITLAB_CI", "DRONE", "bamboo_buildNumber", "TRIGGER_NAME", "CUSTOM",
)
PR_NUMBER_OVERRIDE = "TRUNK_PR_NUMBER"
MERGE_QUEUES = ("trunk-merge/", "gh-readonly-queue/", "/gtmq_")
CI_FIELDS = (
    "job_url", "branch", "pr_number", "actor", "committer_name", "committer_email", "author_name", "author_email", "commit_message", "title", "workflow", "job",
)


def detect_platform(envs: Column) -> Column:
    """CUSTOM first, Google Cloud Build before Jenkins, else the order of PLATFORM_KEYS."""
    first = ("CUSTOM", "TRIGGER_NAME")
    # Google Cloud Build only outranks Jenkins; other platforms keep their order
    order = ["CUSTOM", *(k for k in PLATFORM_KEYS if k not in (*first, "BUILD_ID")), "TRIGGER_NAME", "BUILD_ID"]
    return F.coalesce(*(F.when(F.map_contains_key(envs, k), F.lit(k)) for k in order), F.lit("UNKNOWN"))


def whole_count(c: Column) -> Column:
    """A count as digits with an optional plus, else null."""
    return F.when(c.rlike(r"^\+?\d+$"), c.try_cast("long"))


def extract_ci_info(df: DataFrame, envs: str = "envs", platform: str = "platform") -> DataFrame:
    """The fields of each platform from its environment; an empty value is absent."""
    override = whole_count(F.nullif(F.try_element_at(F.col(envs), F.lit(PR_NUMBER_OVERRIDE)), F.lit("")))

    def env(key: str) -> Column:
        return F.nullif(F.try_element_at(F.col(envs), F.lit(key)), F.lit(""))

    def pr(c: Column) -> Column:
        return F.coalesce(override, whole_count(c))

    def formed(pattern: str, *keys: str) -> Column:
        have = F.lit(True)
        for k in keys:
            have = have & env(k).isNotNull()
        return F.when(have, F.format_string(pattern, *(env(k) for k in keys)))

    ref = env("GITHUB_REF")
    gh_number = F.when(ref.startswith("refs/pull/"), pr(F.regexp_replace(F.regexp_replace(ref, "^[^/]*/[^/]*/", ""), "/merge$", "")))
    gh_run = formed("https://github.com/%s/actions/runs/%s", "GITHUB_REPOSITORY", "GITHUB_RUN_ID")
    gh_url = F.concat(gh_run, F.coalesce(F.concat(F.lit("?pr="), gh_number.cast("string")), F.lit("")))
    author = env("CI_COMMIT_AUTHOR")
    gl_name = F.when(author.contains("<"), F.trim(F.substring_index(author, "<", 1)))
    gl_mail = F.when(author.contains("<"), F.replace(F.regexp_replace(author, "^[^<]*<", ""), F.lit(">"), F.lit("")))
    bb_url = formed("https://bitbucket.org/%s/%s/pipelines/results/%s", "BITBUCKET_WORKSPACE", "BITBUCKET_REPO_SLUG", "BITBUCKET_BUILD_NUMBER")
    circle = env("CIRCLE_BUILD_URL")
    gh_parts = r"^https://circleci\.com/gh/+([^/?]+)/+([^/?]+)/+[^/?]+"
    new_url = formed("%s/workflows/%s/jobs/%s/parallel-runs/%s", "CIRCLE_PIPELINE_ID", "CIRCLE_WORKFLOW_ID", "CIRCLE_BUILD_NUM", "CIRCLE_NODE_INDEX")
    app_url = F.when(circle.rlike(gh_parts), F.concat(F.lit("https://app.circleci.com/pipelines/github/"), F.regexp_extract(circle, gh_parts, 1), F.lit("/"), F.regexp_extract(circle, gh_parts, 2), F.lit("/"), new_url))
    pull = F.element_at(F.split(env("CIRCLE_PULL_REQUEST"), "/"), -1)
    change_mail, change_name = env("CHANGE_AUTHOR_EMAIL"), env("CHANGE_AUTHOR_DISPLAY_NAME")
    kite_mail, kite_name = env("BUILDKITE_BUILD_AUTHOR_EMAIL"), env("BUILDKITE_BUILD_AUTHOR")
    by_platform: dict[str, dict[str, Column]] = {
        "CUSTOM": {
            "job_url": env("JOB_URL"), "workflow": env("JOB_NAME"), "job": env("JOB_NAME"), "actor": env("AUTHOR_EMAIL"), "committer_email": env("AUTHOR_EMAIL"), "author_email": env("AUTHOR_EMAIL"),
            "committer_name": env("AUTHOR_NAME"), "author_name": env("AUTHOR_NAME"), "branch": env("COMMIT_BRANCH"), "commit_message": env("COMMIT_MESSAGE"), "pr_number": pr(env("PR_NUMBER")), "title": env("PR_TITLE"),
        },
        "GITHUB_ACTIONS": {
            "branch": F.when(ref.isNotNull(), F.coalesce(env("GITHUB_HEAD_REF"), ref)), "pr_number": gh_number, "actor": env("GITHUB_ACTOR"), "title": env("PR_TITLE"),
            "job_url": F.coalesce(env("JOB_URL"), gh_url), "workflow": env("GITHUB_WORKFLOW"), "job": env("GITHUB_JOB"),
        },
        "BUILD_ID": {
            "job_url": env("BUILD_URL"), "branch": F.coalesce(env("CHANGE_BRANCH"), env("BRANCH_NAME")), "pr_number": pr(env("CHANGE_ID")), "actor": change_mail,
            "committer_name": change_name, "committer_email": change_mail, "author_name": change_name, "author_email": change_mail,
        },
        "BUILDKITE": {
            "job_url": formed("%s#%s", "BUILDKITE_BUILD_URL", "BUILDKITE_JOB_ID"), "branch": env("BUILDKITE_BRANCH"), "pr_number": pr(env("BUILDKITE_PULL_REQUEST")), "actor": kite_mail,
            "committer_name": kite_name, "committer_email": kite_mail, "author_name": kite_name, "author_email": kite_mail,
        },
        "SEMAPHORE": {
            "job_url": formed("%s/projects/%s/jobs/%s", "SEMAPHORE_ORGANIZATION_URL", "SEMAPHORE_PROJECT_ID", "SEMAPHORE_JOB_ID"),
            "branch": F.coalesce(env("SEMAPHORE_GIT_PR_BRANCH"), env("SEMAPHORE_GIT_WORKING_BRANCH"), env("SEMAPHORE_GIT_BRANCH")), "pr_number": pr(env("SEMAPHORE_GIT_PR_NUMBER")),
            "actor": env("SEMAPHORE_GIT_COMMIT_AUTHOR"), "committer_name": env("SEMAPHORE_GIT_COMMITTER"), "author_name": env("SEMAPHORE_GIT_COMMIT_AUTHOR"), "workflow": env("SEMAPHORE_PROJECT_NAME"), "job": env("SEMAPHORE_JOB_NAME"),
        },
        "GITLAB_CI": {
            "job_url": env("CI_JOB_URL"), "branch": F.regexp_replace(F.coalesce(env("CI_COMMIT_REF_NAME"), env("CI_COMMIT_BRANCH"), env("CI_MERGE_REQUEST_SOURCE_BRANCH_NAME")), "^remotes/", ""),
            "pr_number": pr(env("CI_MERGE_REQUEST_IID")), "actor": gl_name, "committer_name": gl_name, "committer_email": gl_mail, "author_name": gl_name, "author_email": gl_mail,
            "commit_message": env("CI_COMMIT_MESSAGE"), "title": env("CI_MERGE_REQUEST_TITLE"), "workflow": env("CI_JOB_NAME"), "job": env("CI_JOB_STAGE"),
        },
        "DRONE": {
            "branch": env("DRONE_SOURCE_BRANCH"), "pr_number": pr(env("DRONE_PULL_REQUEST")), "actor": env("DRONE_COMMIT_AUTHOR"), "committer_name": env("DRONE_COMMIT_AUTHOR_NAME"), "committer_email": env("DRONE_COMMIT_AUTHOR_EMAIL"),
            "author_name": env("DRONE_COMMIT_AUTHOR_NAME"), "author_email": env("DRONE_COMMIT_AUTHOR_EMAIL"), "title": env("DRONE_PULL_REQUEST_TITLE"), "job_url": env("DRONE_BUILD_LINK"),
        },
        "BITBUCKET_BUILD_NUMBER": {
            "job_url": F.concat(bb_url, F.coalesce(F.concat(F.lit("/steps/"), percent_encoded_segment(env("BITBUCKET_STEP_UUID"))), F.lit(""))), "branch": env("BITBUCKET_BRANCH"), "pr_number": pr(env("BITBUCKET_PR_ID")),
            "workflow": env("BITBUCKET_PIPELINE_UUID"), "job": env("BITBUCKET_STEP_UUID"),
        },
        "CIRCLECI": {
            "job_url": F.coalesce(app_url, circle), "branch": env("CIRCLE_BRANCH"), "pr_number": F.coalesce(pr(env("CIRCLE_PR_NUMBER")), whole_count(pull)), "actor": env("CIRCLE_USERNAME"), "job": env("CIRCLE_JOB"),
        },
        "bamboo_buildNumber": {
            "job_url": F.coalesce(env("bamboo_buildResultsUrl"), env("bamboo_resultsUrl")), "branch": F.coalesce(env("bamboo_planRepository_branch"), env("bamboo_planRepository_branchName")),
            "pr_number": pr(env("bamboo_repository_pr_key")), "actor": env("bamboo_planRepository_username"), "workflow": env("bamboo_planName"), "job": env("bamboo_shortJobName"),
        },
        "TRIGGER_NAME": {
            "branch": F.coalesce(env("_HEAD_BRANCH"), env("BRANCH_NAME")), "pr_number": pr(env("_PR_NUMBER")), "workflow": env("TRIGGER_NAME"),
            "job_url": formed("https://console.cloud.google.com/cloud-build/builds/%s?project=%s", "BUILD_ID", "PROJECT_ID"), "job": env("BUILD_ID"),
        },
    }
    info = None
    for key, fields in by_platform.items():
        kinds = {name: "long" if name == "pr_number" else "string" for name in CI_FIELDS}
        one = F.struct(*(fields.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in kinds.items()))
        info = F.when(F.col(platform) == key, one) if info is None else info.when(F.col(platform) == key, one)
    return df.withColumn("_info", info).select("*", "_info.*").drop("_info")


def clean_branch(branch: Column) -> Column:
    for part in ("refs/heads/", "refs/", "origin/"):
        branch = F.replace(branch, F.lit(part), F.lit(""))
    return truncated(branch, FIELD_BYTES)


def branch_class(branch: Column, pr_number: Column, merge_event: Column | None = None, stable: tuple[str, ...] = ()) -> Column:
    """MERGE, PR, PB or NONE of a clean branch; null without branch."""
    merge = branch.startswith("gtmq_")
    for part in MERGE_QUEUES:
        merge = merge | branch.contains(part)
    if merge_event is not None:
        merge = merge | F.coalesce(merge_event == "merge_train", F.lit(False))
    pull = pr_number.isNotNull() | branch.startswith("remotes/pull/") | branch.startswith("pull/")
    protected = branch.isin(*stable) if stable else F.lit(False)
    found = F.when(merge, F.lit("MERGE")).when(pull, F.lit("PR")).when(protected, F.lit("PB")).otherwise(F.lit("NONE"))
    return F.when(branch.isNotNull(), found)


def classify_branches(ci: DataFrame, stable: tuple[str, ...] = (), merge_event: str | None = None) -> DataFrame:
    clean = ci.withColumn("branch", clean_branch(F.col("branch")))
    return clean.withColumn("branch_class", branch_class(F.col("branch"), F.col("pr_number"), F.col(merge_event) if merge_event else None, stable))


def enrich_from_repo(ci: DataFrame, repo: DataFrame, stable: tuple[str, ...] = (), merge_event: str | None = None) -> DataFrame:
    """Fill missing facts from the repo, or all of them where the repo wasn't cloned.

    repo: bundle_id, use_uncloned_repo, head_branch, author_email, author_name, commit_message.
    """
    r = repo.select("bundle_id", *(F.col(c).alias(f"r_{c}") for c in ("use_uncloned_repo", "head_branch", "author_email", "author_name", "commit_message")), F.lit(True).alias("r_has"))
    out = ci.join(r, "bundle_id", "left")
    prefer = F.coalesce(F.col("r_use_uncloned_repo"), F.lit(False))

    def filled(own: str, theirs: Column) -> Column:
        return F.when(F.col("r_has") & (prefer | F.col(own).isNull()), theirs).otherwise(F.col(own))

    changed = F.coalesce(F.col("r_has"), F.lit(False)) & (prefer | F.col("branch").isNull())
    out = out.withColumn("_branch", filled("branch", clean_branch(F.col("r_head_branch"))))
    event = F.col(merge_event) if merge_event else None
    out = out.withColumn("branch_class", F.when(changed, branch_class(F.col("_branch"), F.col("pr_number"), event, stable)).otherwise(F.col("branch_class"))).withColumn("branch", F.col("_branch")).drop("_branch")
    for own, theirs in (("actor", "author_email"), ("committer_name", "author_name"), ("committer_email", "author_email"), ("author_name", "author_name"), ("author_email", "author_email"), ("commit_message", "commit_message")):
        out = out.withColumn(own, filled(own, F.col(f"r_{theirs}")))
    return out.drop(*(c for c in out.columns if c.startswith("r_")))


def parse_repo_urls(df: DataFrame, url: str = "url") -> DataFrame:
    """P10: host, owner, name and full name of a repo's remote; all null and `invalid` if it is none."""
    u = F.col(url)
    by_scheme = r"^(?:ssh|git|http|https|ftp|ftps)://(?:[^/]*?@)?([^/]*)/(.+)/([^/]+)"
    by_user = r"^[^/]*?@([^/]*):(.+)/([^/]+)"
    out = df
    for i, c in enumerate(("host", "owner", "name"), 1):
        part = F.when(u.rlike(by_scheme), F.regexp_extract(u, by_scheme, i)).when(u.rlike(by_user), F.regexp_extract(u, by_user, i))
        part = F.regexp_replace(F.regexp_replace(F.trim(part), "/+$", ""), r"(?:\.git)+$", "") if c == "name" else F.trim(part)
        out = out.withColumn(c, F.nullif(part, F.lit("")))
    valid = F.col("host").isNotNull() & F.col("owner").isNotNull() & F.col("name").isNotNull()
    out = out.withColumn("invalid", ~valid).withColumn("full_name", F.when(valid, F.concat_ws("/", "host", "owner", "name")))
    for c in ("host", "owner", "name"):
        out = out.withColumn(c, F.when(~F.col("invalid"), F.col(c)))
    return out


def test_case_url(api: str, org: Column, test_id: Column, owner: Column, name: Column) -> Column:
    """Link to a test's page: the API's host becomes the app's, `owner/name` is form-encoded."""
    app = api.replace("https://api.", "https://app.").rstrip("/")
    return F.concat(F.lit(f"{app}/"), org, F.lit("/flaky-tests/test/"), test_id, F.lit("?repo="), F.url_encode(F.concat_ws("/", owner, name)))


def capture_envs(envs: Column, allowed: Column, pr_number: Column | None = None) -> Column:
    """Environment entries whose key is allowed, with the PR-number override if there is one."""
    kept = F.map_filter(envs, lambda k, _: F.array_contains(allowed, k))
    if pr_number is None:
        return kept
    own = F.map_filter(kept, lambda k, _: k != PR_NUMBER_OVERRIDE)
    return F.when(pr_number.isNotNull(), F.map_concat(own, F.create_map(F.lit(PR_NUMBER_OVERRIDE), pr_number.cast("string")))).otherwise(kept)


def truncate_variant(variant: Column) -> Column:
    """P20: at most 64 bytes, at a character boundary."""
    return truncated(variant, VARIANT_BYTES)


#: Fields of bundle metadata that a version lacks, newest first: (version, fields it adds).
META_VERSIONS = (
    ("0.7.8", ("failed_tests",)), ("0.7.7", ("internal_bundled_file",)), ("0.7.6", ("variant",)), ("0.6.3", ("bundle_upload_id_v2",)),
    ("0.6.2", ("command_line",)), ("0.5.34", ("num_files", "num_tests")), ("0.5.29", ()),
)


def as_meta_version(bundles: DataFrame, version: str) -> DataFrame:
    """Bundles as an older version has them: later fields dropped; 0.6.3 takes its second id from the first."""
    order = [v for v, _ in META_VERSIONS]
    later = [f for v, added in META_VERSIONS[: order.index(version)] for f in added]
    out = bundles.drop(*(f for f in later if f in bundles.columns))
    if version == "0.6.3" and "bundle_upload_id_v2" in out.columns:
        out = out.withColumn("bundle_upload_id_v2", F.coalesce(F.nullif(F.col("bundle_upload_id_v2"), F.lit("")), F.col("bundle_upload_id")))
    return out.withColumn("version", F.lit(version))


def test_collection(a: Column, b: Column, c: Column, names: tuple[str, str, str]) -> Column:
    """The three fields of a test collection, only if all are there."""
    return F.when(a.isNotNull() & b.isNotNull() & c.isNotNull(), F.struct(*(x.alias(n) for x, n in zip((a, b, c), names, strict=True))))


def upload_metrics(bundles: DataFrame) -> DataFrame:
    """One telemetry row per upload: version parts, repo, times, outcome."""
    parts = F.split(F.regexp_replace("client_version", "^[^0-9]*", ""), r"[.\-+]")
    version = F.struct(*(F.coalesce(F.try_element_at(parts, F.lit(i)).try_cast("int"), F.lit(0)).alias(n) for i, n in ((1, "major"), (2, "minor"), (3, "patch"))), F.coalesce(F.try_element_at(parts, F.lit(4)), F.lit("")).alias("suffix"))
    return bundles.select(
        "bundle_id", version.alias("client_version"), F.struct("host", "owner", "name").alias("repo"), "upload_started_at", "upload_finished_at", "command_started_at",
        F.coalesce(F.col("failed"), F.lit(False)).alias("failed"), F.coalesce("failure_reason", F.lit("")).alias("failure_reason"), "quarantine_query",
    )
