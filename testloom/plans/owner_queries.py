"""Code owners of the paths in `runs`, under two literal rule files and under files made of the paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from testloom.functions.ids import NAMESPACE_OID
from testloom.operators import owners as O
from testloom.plans.adapters import duck_uuid5, view
from testloom.plans.registry import query
from testloom.sources import codeowners as S

GITHUB = "# owners\n* @all\n*.js @js nobody\n/src/click/ @click\n/src/view/* @view dev@example.com\nm7.rb\n"
GITLAB = "* @all\n[Docs] @docs\n*.js\n/src/click/ @click me@example.com\n^[Tests]\n/src/view/* @view\n[docs]\n*.js @again\n"


def files(spark, sf_dir):
    """One file of rules a dialect and bundle group, and its content."""
    r = view(spark, sf_dir, "runs").select((F.col("bundle_id") % 2).alias("g")).distinct()
    return r.select(F.when(F.col("g") == 0, F.lit("gh")).otherwise(F.lit("gl")).alias("codeowners_id"), F.when(F.col("g") == 0, F.lit(GITHUB)).otherwise(F.lit(GITLAB)).alias("content"))


def paths(spark, sf_dir):
    return view(spark, sf_dir, "runs").select("seq", F.when(F.col("bundle_id") % 2 == 0, F.lit("gh")).when(F.col("bundle_id") % 5 != 0, F.lit("gl")).alias("codeowners_id"), F.col("file").alias("path"))


def github(spark, sf_dir):
    return S.scan_codeowners_github(files(spark, sf_dir).where("codeowners_id = 'gh'"))


def gitlab(spark, sf_dir):
    return S.scan_codeowners_gitlab(files(spark, sf_dir).where("codeowners_id = 'gl'"))


GH = "case when regexp_matches(file, 'm7\\.rb$') then '' when regexp_matches(file, '^src/view/[^/]*$') then '@view,dev@example.com' when file like 'src/click/%' then '@click' when file like '%.js' then '@js' else '@all' end"
GL = "'@all' || case when file like 'src/click/%' then ',me@example.com,@click' when file like '%.js' then ',@again' else '' end || case when regexp_matches(file, '^src/view/[^/]*$') then ',@view' else '' end"
# in the section Docs the pattern *.js keeps its first place, before /src/click/, but takes its last owners


@query("J7_owners_github", "runs", f"select distinct file as path, {GH} as owners from runs where file is not null and bundle_id % 2 = 0")
def owners_github(spark, sf_dir):
    return O.owners_github(paths(spark, sf_dir).where("codeowners_id = 'gh'"), github(spark, sf_dir)).select("path", F.array_join("owners", ",").alias("owners"))


@query("J8_owners_gitlab", "runs", f"select distinct file as path, {GL} as owners from runs where file is not null and bundle_id % 2 = 1 and bundle_id % 5 <> 0")
def owners_gitlab(spark, sf_dir):
    return O.owners_gitlab(paths(spark, sf_dir).where("codeowners_id = 'gl'"), gitlab(spark, sf_dir)).select("path", F.array_join("owners", ",").alias("owners"))


@query("J9_associate_owners", "runs", f"select seq, case when file is null then '' when bundle_id % 2 = 0 then {GH} when bundle_id % 5 <> 0 then {GL} else '' end as owners from runs")
def associate(spark, sf_dir):
    return O.associate_owners(paths(spark, sf_dir), github(spark, sf_dir), gitlab(spark, sf_dir)).select("seq", F.array_join("owners", ",").alias("owners"))


@query("U2_owner_references", sql="""with m as (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^@\\s]{1,100}@[^@\\s]*[a-zA-Z0-9_]')) as x from documents)
  select d.doc_id, cast(coalesce(n, 0) as int) as num_emails, coalesce(emails, '') as emails from documents d
  left join (select doc_id, count(distinct x) as n, string_agg(distinct x, ',' order by x) as emails from m group by doc_id) using (doc_id)""")
def references(spark, sf_dir):
    emails = view(spark, sf_dir, "documents").select("doc_id", O.owner_emails(F.coalesce("text", F.lit(""))).alias("emails"))
    return emails.select("doc_id", F.size("emails").alias("num_emails"), F.array_join("emails", ",").alias("emails"))


def rule_files(spark, sf_dir):
    """A file in either dialect for each bundle, of the folders of its runs: gh<bundle> and gl<bundle>.

    GitHub: a line for each folder. GitLab: a section for each folder, of two rules, the
    second of which is repeated with another owner.
    """
    r = view(spark, sf_dir, "runs").select("bundle_id", F.col("parent_name").alias("d")).distinct()
    b = F.col("bundle_id").cast("string")
    line = F.concat(F.lit("/src/"), "d", F.lit("/ @team"), b, F.lit(" nobody "), "d", F.lit("@ex.com"))
    section = F.concat(F.lit("["), "d", F.lit("] @head"), b, F.lit("\n/src/"), "d", F.lit("/\n*.js @js\n*.js @again"), b)
    files = r.groupBy("bundle_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("gh"), F.array_join(F.array_sort(F.collect_list(section)), "\n").alias("gl"))
    return files.select("bundle_id", F.explode(F.create_map(F.lit("gh"), "gh", F.lit("gl"), "gl")).alias("kind", "content")).select("bundle_id", "kind", F.concat("kind", b).alias("codeowners_id"), "content")


PLACES = "p as (select bundle_id, d, row_number() over (partition by bundle_id order by d) - 1 as i from (select distinct bundle_id, parent_name as d from runs))"


@query("J9_own_rule_files", "runs", f"""with {PLACES}, n as (select bundle_id, count(*) as dirs from p group by 1)
  select seq, case when bundle_id % 2 = 0 then '@team' || bundle_id || ',' || parent_name || '@ex.com' when seq % 3 = 0 then rtrim(repeat('@again' || bundle_id || ',', cast(dirs as int)), ',') else '@head' || bundle_id end as owners from runs join n using (bundle_id)""")
def own_rule_files(spark, sf_dir):
    """Every run's path under its own bundle's file of rules, of either dialect."""
    kind = F.when(F.col("bundle_id") % 2 == 0, F.lit("gh")).otherwise(F.lit("gl"))
    path = F.concat(F.lit("src/"), "parent_name", F.lit("/t"), F.col("seq").cast("string"), F.when(F.col("seq") % 3 == 0, F.lit(".js")).otherwise(F.lit(".py")))
    paths = view(spark, sf_dir, "runs").select("seq", F.concat(kind, F.col("bundle_id").cast("string")).alias("codeowners_id"), path.alias("path"))
    files = rule_files(spark, sf_dir).where((F.col("kind") == "gh") == (F.col("bundle_id") % 2 == 0))
    found = O.associate_owners(paths, S.scan_codeowners_github(files.where("kind = 'gh'")), S.scan_codeowners_gitlab(files.where("kind = 'gl'")))
    return found.select("seq", F.array_join("owners", ",").alias("owners"))


@query("S6_scan_github", "runs", f"with {PLACES} select 'gh' || bundle_id as codeowners_id, cast(i as int) as rule_pos, '/src/' || d || '/' as pattern, '@team' || bundle_id || ',' || d || '@ex.com' as owners from p")
def scan_github(spark, sf_dir):
    out = S.scan_codeowners_github(rule_files(spark, sf_dir).where("kind = 'gh'"))
    return out.select("codeowners_id", "rule_pos", "pattern", F.array_join("owners", ",").alias("owners"))


@query("S7_scan_gitlab", "runs", f"""with {PLACES} select 'gl' || bundle_id as codeowners_id, d as section, cast(4 * i + 1 as int) as rule_pos, '/src/' || d || '/**/*' as pattern, '@head' || bundle_id as owners from p
  union all select 'gl' || bundle_id, d, cast(4 * i + 2 as int), '/**/*.js', '@again' || bundle_id from p""")
def scan_gitlab(spark, sf_dir):
    out = S.scan_codeowners_gitlab(rule_files(spark, sf_dir).where("kind = 'gl'"))
    return out.select("codeowners_id", "section", "rule_pos", "pattern", F.array_join("owners", ",").alias("owners"))


@query("A17_A18_section_stats", "runs", f"with {PLACES} select 'gl' || bundle_id as codeowners_id, d as section, cast(2 as bigint) as num_rules, false as is_optional from p")
def sections(spark, sf_dir):
    return O.section_stats(S.scan_codeowners_gitlab(rule_files(spark, sf_dir).where("kind = 'gl'"))).drop("section_pos")


@query("S8_S9_resolve_codeowners", "runs", f"""with t as (select bundle_id, string_agg('/src/' || d || '/ @team' || bundle_id || ' nobody ' || d || '@ex.com', chr(10) order by '/src/' || d || '/ @team') as gh,
    string_agg('[' || d || '] @head' || bundle_id || chr(10) || '/src/' || d || '/' || chr(10) || '*.js @js' || chr(10) || '*.js @again' || bundle_id, chr(10) order by d) as gl from (select distinct bundle_id, parent_name as d from runs) group by bundle_id),
  c as (select bundle_id, case when bundle_id % 2 = 0 then '[] @x' || chr(10) || gh else gl end as content from t)
  select bundle_id as repo, case when bundle_id % 3 = 0 then 'docs/CODEOWNERS' else 'CODEOWNERS' end as path, case when bundle_id % 2 = 0 then 'github' else 'gitlab' end as dialect, {duck_uuid5("content", NAMESPACE_OID)} as codeowners_id from c""")
def resolve(spark, sf_dir):
    files = rule_files(spark, sf_dir).where((F.col("kind") == "gh") == (F.col("bundle_id") % 2 == 0))
    b = files.select(F.col("bundle_id").alias("repo"), F.when(F.col("kind") == "gh", F.concat(F.lit("[] @x\n"), "content")).otherwise(F.col("content")).alias("content"))
    rows = b.select("repo", F.lit("docs/CODEOWNERS").alias("path"), "content").unionByName(b.where("repo % 3 <> 0").select("repo", F.lit("CODEOWNERS").alias("path"), "content"))
    return S.resolve_codeowners(rows).select("repo", "path", "dialect", "codeowners_id")


@query("U2_owner_references_of_runs", "runs", """select seq, case when bundle_id % 3 = 0 then '@' || parent_name || '/a' || bundle_id else '@' || classname || ',@g/' || parent_name || ',' || parent_name || '@ex.com' end as refs from runs""")
def references_of_runs(spark, sf_dir):
    r = view(spark, sf_dir, "runs")
    name = F.concat(F.lit("@"), "parent_name", F.lit("/a"), F.col("bundle_id").cast("string"))
    several = F.concat("parent_name", F.lit("@ex.com x @g/"), "parent_name", F.lit(" @"), "classname", F.lit(", "), "parent_name", F.lit("@ex.com nobody"))
    text = F.when(F.col("bundle_id") % 3 == 0, F.concat(name, F.lit(" "), name)).otherwise(several)
    return r.select("seq", F.array_join(F.array_sort(O.owner_references(text)), ",").alias("refs"))


@query("S8_codeowners_errors", "runs", f"""with {PLACES}, e as (select bundle_id, d, i, i % 6 as kind from p)
  select 'e' || bundle_id as codeowners_id, cast(2 * i + nth as int) as line_number, error, error not in ('invalid entry owner format', 'missing entry owner') as fatal from (
    select bundle_id, i, 0 as nth, 'missing section name' as error from e where kind = 0
    union all select bundle_id, i, 0, 'invalid approval requirement' from e where kind = 1
    union all select bundle_id, i, 0, 'invalid section owner format' from e where kind = 2
    union all select bundle_id, i, 0, 'invalid section format' from e where kind = 3
    union all select bundle_id, i, 0, 'invalid entry owner format' from e where kind = 3
    union all select bundle_id, i, 1, 'invalid entry owner format' from e where kind = 4
    union all select bundle_id, i, 1, 'missing entry owner' from e where kind = 5)""")
def codeowners_errors(spark, sf_dir):
    """A file for each bundle with two lines for each folder of its runs: by turns each error of the dialect."""
    r = view(spark, sf_dir, "runs").select("bundle_id", F.col("parent_name").alias("d")).distinct()
    dirs = r.groupBy("bundle_id").agg(F.array_sort(F.collect_list("d")).alias("dirs"))

    def lines(d, i):
        sound = F.concat(F.lit("\n/"), d, F.lit("/ @own"))
        texts = [F.concat(F.lit("[] @x"), sound), F.concat(F.lit("^["), d, F.lit("][2] @x"), sound), F.concat(F.lit("["), d, F.lit("] nobody"), sound),
                 F.concat(F.lit("["), d, F.lit(" nobody"), sound), F.concat(F.lit("["), d, F.lit("] @x\n/"), d, F.lit(" nobody")), F.concat(F.lit("["), d, F.lit("]\n/"), d)]
        return F.coalesce(*(F.when(i % 6 == k, t) for k, t in enumerate(texts)))

    files = dirs.select(F.concat(F.lit("e"), F.col("bundle_id").cast("string")).alias("codeowners_id"), F.array_join(F.transform("dirs", lines), "\n").alias("content"))
    return S.codeowners_errors(files).select("codeowners_id", "line_number", "error", "fatal")
