"""Views that give the operators inputs of their own shape, derived from the given tables.

Each view is one SQL text that Spark and DuckDB read alike.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

ORG, REPO = "org", "github.com/org/repo"

VIEWS = {
    "ev": "select *, cast(substr(props, 7, length(props) - 7) as bigint) as k from events",
    "runs": """select event_id as seq, user_id % 20 as bundle_id, event_type as parent_name,
  concat('test_', cast(k % 12 as string)) as name, concat('C', cast(user_id % 5 as string)) as classname,
  case when k % 11 = 0 then null else concat('src/', event_type, '/m', cast(k % 8 as string), case when k % 3 = 0 then '.rb' else '.js' end) end as file,
  case when k % 17 = 0 then concat('trunk:', cast(k as string)) when k % 19 = 0 then '' else null end as raw_id,
  case when (event_id * 31 + k) % 10 < 3 then 'FAILURE' when (event_id * 31 + k) % 10 = 3 then 'SKIPPED'
       when (event_id * 31 + k) % 10 = 4 then 'UNSPECIFIED' else 'SUCCESS' end as status,
  date_trunc('hour', ts) as case_ts, case when event_id % 13 = 0 then null else value end as time_s,
  case when event_id % 4 = 0 then concat('boom ', cast(k as string)) else null end as message,
  cast(k % 90 as string) as line, case when k % 5 = 0 then 'x' else cast(event_id % 4 as string) end as attempt_number
from ev""",
    "cases_t": """select event_id as seq, user_id % 20 as bundle_id, event_type as parent_name,
  case when event_id % 5 = 0 then null when event_id % 7 = 0 then ts - interval '40' day else ts end as case_ts,
  case when event_id % 3 = 0 then null else ts - interval '5' hour end as suite_ts,
  case when event_id % 2 = 0 then null else ts - interval '26' hour end as report_ts,
  case when k % 9 = 0 then '  ' when k % 10 = 0 then repeat('é', 501) else concat('t', cast(k as string)) end as name,
  case when k % 8 = 0 then null when k % 6 = 0 then repeat('f', 1001) else 'a/b.js' end as file,
  case when k % 7 = 0 then '' else 'C' end as classname,
  case when event_id % 3 = 0 then null else value end as case_time, case when event_id % 9 = 0 then null else 1.5 end as suite_time, cast(null as double) as report_time,
  timestamp '2024-01-30 00:00:00' as ref_ts, ts - interval '1' hour as start_time, case when event_id % 4 = 0 then ts - interval '3' hour else ts end as end_time from ev""",
    "bep": """select event_id as seq, user_id % 20 as bundle_id, concat('//', event_type, '/p', cast(k % 6 as string), ':t') as label,
  case when event_id % 6 = 0 then 'summary' else 'result' end as kind, cast((event_id % 3) + 1 as int) as attempt, event_id % 5 = 0 as cached,
  case k % 10 when 0 then 'NO_STATUS' when 1 then 'FLAKY' when 2 then 'TIMEOUT' when 3 then 'FAILED' when 4 then 'INCOMPLETE' when 5 then 'REMOTE_FAILURE' when 6 then 'FAILED_TO_BUILD' else 'PASSED' end as status,
  ts as start_time, case when event_id % 8 = 0 then null else ts + interval '3' second end as end_time,
  concat('file:///out/', event_type, '/', cast(event_id as string), case when event_id % 4 = 0 then '.log' else '.xml' end) as uri from ev""",
    "ci": """select o_orderkey as bundle_id,
  case o_orderkey % 4 when 0 then 'GITHUB_ACTIONS' when 1 then 'GITLAB_CI' when 2 then 'BUILDKITE' else 'CIRCLECI' end as platform_key,
  case o_orderkey % 6 when 0 then concat('refs/pull/', cast(o_custkey as string), '/merge') when 1 then 'refs/heads/main' when 2 then 'origin/feature/x'
    when 3 then 'trunk-merge/pr-1' when 4 then '' else concat('gtmq_', cast(o_custkey as string)) end as ref,
  case when o_orderkey % 3 = 0 then cast(o_custkey as string) when o_orderkey % 3 = 1 then 'false' else '' end as pr,
  case when o_orderkey % 7 = 0 then '' else concat('u', cast(o_custkey as string), '@ex.com') end as author_email,
  o_orderpriority as title, o_orderkey % 5 = 0 as use_uncloned_repo, o_orderdate as commit_ts from orders""",
    "urls": """select c_custkey as id, case c_custkey % 6 when 0 then concat('https://github.com/org', cast(c_nationkey as string), '/r', cast(c_custkey as string), '.git')
  when 1 then concat('git@gitlab.com:grp/sub/r', cast(c_custkey as string), '.git') when 2 then concat('ssh://git@host:22/o/r', cast(c_custkey as string), '/')
  when 3 then 'not a url' when 4 then concat('http://u@h.io/o/r', cast(c_custkey as string)) else 'https://github.com/' end as url from customer""",
}

NEEDS = {"runs": ("ev",), "cases_t": ("ev",), "bep": ("ev",)}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the tables in sf_dir; a table's name gives the table."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sources = re.findall(r"\bfrom (\w+)", VIEWS[name])
    text = re.sub(r"\bfrom (\w+)", r"from {\1}", VIEWS[name])
    out = spark.sql(text, **{s: view(spark, sf_dir, s) for s in sources})
    stamps = {c: out[c].cast("timestamp") for c, kind in out.dtypes if kind == "timestamp_ntz"}
    return out.withColumns(stamps) if stamps else out


def with_views(names: str, sql: str) -> str:
    """DuckDB SQL that may use the views in names."""
    ordered: list[str] = []
    for n in names.split():
        for x in (*NEEDS.get(n, ()), n):
            if x not in ordered:
                ordered.append(x)
    ctes = ", ".join(f"{n} as ({VIEWS[n]})" for n in ordered)
    text = sql.strip()
    return f"with recursive {ctes}, {text[5:]}" if text.lower().startswith("with ") else f"with {ctes} {text}"


def duck_uuid5(name: str, namespace: str = "6ba7b8119dad11d180b400c04fd430c8") -> str:
    """DuckDB expression of a version-5 UUID."""
    h = f"sha1(from_hex('{namespace}') || encode({name}))"
    return f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || translate(substr({h}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({h}, 18, 3) || '-' || substr({h}, 21, 12))"


def duck_base(raw: str = "null") -> str:
    """DuckDB expression of the id of a run of the view `runs`."""
    base = duck_uuid5(f"concat_ws('#', '{ORG}', '{REPO}', coalesce(file, ''), classname, parent_name, name, 'JUNIT_TESTCASE')")
    return base if raw == "null" else f"case when {raw} like 'trunk:%' then {duck_uuid5(f"concat_ws('#', '{ORG}', '{REPO}', {raw})")} else {base} end"


#: `ids`: runs with the id of extracted failures and times in milliseconds.
IDS = f"ids as materialized (select *, coalesce(nullif(raw_id, ''), {duck_base()}) as test_id, cast(epoch_ms(case_ts) as bigint) as time_ms from runs)"
#: Ids of a quarantine list: those of the view whose hash starts with 0 to 3.
QUARANTINE = "quarantine as (select distinct bundle_id, test_id from ids where substr(md5(test_id), 1, 1) in ('0', '1', '2', '3'))"
