"""CODEOWNERS files in the GitHub and GitLab dialects.

Input: codeowners_id, content (text), and where files are to be chosen, repo and path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from testloom.functions.ids import uuid5_of_bytes
from testloom.functions.text import trimmed
from testloom.operators.owners import dedupe_rules, github_rule, gitlab_pattern, gitlab_regex, is_github_glob, owner_emails, owner_names, owner_references

# The places of the file in order, the section of rules before any header, errors.
LOCATIONS = (".github", ".bitbucket", ".", "docs", ".gitlab")
DEFAULT_SECTION = "codeowners"
HEADER = r"^(\^)?\[(.*?)\](?:\[(\d*?)\])?(\s+[@\w.\-/\s+]*)?"
INVALID_HEADER = r"^(?:\^)?\[[^\]]+?$"
GITHUB_OWNER = r"^(?:@\S+|\S+@\S+)"
FATAL = ("invalid section owner format", "missing section name", "invalid approval requirement", "invalid section format")


def _lines(files: DataFrame) -> DataFrame:
    return files.select("codeowners_id", F.posexplode(F.split("content", "\r?\n")).alias("line_number", "line"))


def scan_codeowners_github(files: DataFrame) -> DataFrame:
    """Ordered rules; words that aren't owners are dropped, a rule without owners stays. A file with a pattern
    that isn't a sound glob has no rules."""

    def unsound(line: Column) -> Column:
        return ~line.startswith("#") & ~is_github_glob(F.regexp_extract(line, r"^\s*(\S*)", 1))

    sound = files.where(~F.exists(F.split("content", "\r?\n"), unsound))
    lines = _lines(sound).where("line != '' and not startswith(line, '#')")
    words = F.filter(F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " "), lambda w: w != "")
    rows = lines.withColumn("words", words).where(F.size("words") > 0).withColumn("pattern", F.element_at("words", 1)).withColumn("rule", github_rule(F.col("pattern")))
    owners = F.filter(F.slice("words", 2, 1 << 30), lambda w: w.rlike(GITHUB_OWNER))
    return rows.select("codeowners_id", F.lit("github").alias("dialect"), F.col("line_number").alias("rule_pos"), "pattern", "rule.regex", "rule.direct", owners.alias("owners"))


def _gitlab_lines(files: DataFrame) -> DataFrame:
    """Lines with the section they stand in; header lines are `is_header`."""
    lines = _lines(files).withColumn("line", trimmed(F.col("line"))).where("line != '' and not startswith(line, '#')")
    is_header = F.col("line").rlike(HEADER)
    header = F.struct(
        F.regexp_extract("line", HEADER, 2).alias("name"), (F.regexp_extract("line", HEADER, 1) == "^").alias("optional"),
        F.coalesce(F.regexp_extract("line", HEADER, 3).try_cast("int"), F.lit(0)).alias("approvals"), F.trim(F.regexp_extract("line", HEADER, 4)).alias("default_owners"), F.col("line_number").alias("at"),
    )
    w = Window.partitionBy("codeowners_id").orderBy("line_number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.withColumn("is_header", is_header).withColumn("h", F.last(F.when(is_header, header), ignorenulls=True).over(w))
    name = F.coalesce("h.name", F.lit(DEFAULT_SECTION))
    same = Window.partitionBy("codeowners_id", "key")
    rows = rows.withColumn("key", F.lower(name)).withColumn("at", F.coalesce("h.at", F.lit(-1)))
    rows = rows.withColumn("section_pos", F.when(F.col("key") == DEFAULT_SECTION, F.lit(-1)).otherwise(F.min("at").over(same)))
    spelled = F.first(name).over(same.orderBy("at", "line_number").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("section", F.when(F.col("key") == DEFAULT_SECTION, F.lit(DEFAULT_SECTION)).otherwise(spelled))
    cut = r"^((?:\\\s|\S)*?)(?<!\\)\s+(.*)$"
    has_owners = F.col("line").rlike(cut)
    return rows.withColumn("pattern_text", F.when(has_owners, F.regexp_extract("line", cut, 1)).otherwise(F.col("line"))).withColumn("own", F.when(has_owners, F.regexp_extract("line", cut, 2)).otherwise(F.lit("")))


def scan_codeowners_gitlab(files: DataFrame) -> DataFrame:
    """Rules with their section; a header's owners stand in for rules without owners. A pattern that isn't a
    sound glob keeps its rule, without a regex: it matches nothing."""
    rows = _gitlab_lines(files).where("not is_header")
    text = F.when(F.col("own") != "", F.col("own")).otherwise(F.coalesce("h.default_owners", F.lit("")))
    full = gitlab_pattern(F.col("pattern_text"))
    rules = rows.select(
        "codeowners_id", F.lit("gitlab").alias("dialect"), "section", "section_pos", F.col("line_number").alias("rule_pos"), full.alias("pattern"), gitlab_regex(full).alias("regex"),
        F.concat(owner_emails(text), owner_names(text)).alias("owners"), text.alias("owner_text"), F.coalesce("h.optional", F.lit(False)).alias("optional"), F.coalesce("h.approvals", F.lit(0)).alias("approvals_required"),
    )
    return dedupe_rules(rules)


def codeowners_errors(files: DataFrame) -> DataFrame:
    """Syntax errors of the GitLab dialect: codeowners_id, line_number, error, fatal."""
    rows = _gitlab_lines(files)
    h, header = F.col("h"), F.col("is_header")
    text = F.when(F.col("own") != "", F.col("own")).otherwise(F.coalesce("h.default_owners", F.lit("")))

    def unreferenced(c):
        return (c != "") & (F.size(owner_references(c)) == 0)

    rules = [
        (header & (h["name"] == ""), "missing section name"), (header & h["optional"] & (h["approvals"] > 0), "invalid approval requirement"),
        (header & unreferenced(F.coalesce(h["default_owners"], F.lit(""))), "invalid section owner format"), (~header & F.col("line").rlike(INVALID_HEADER), "invalid section format"),
        (~header & unreferenced(F.col("own")), "invalid entry owner format"), (~header & (text == ""), "missing entry owner"),
    ]
    found = F.array_compact(F.array(*(F.when(t, F.lit(m)) for t, m in rules)))
    out = rows.select("codeowners_id", "line_number", F.explode(found).alias("error"))
    return out.withColumn("fatal", F.col("error").isin(*FATAL))


def resolve_codeowners(files: DataFrame, explicit_path: str | None = None) -> DataFrame:
    """One file per repo, by place, with its id and dialect.

    files: repo, path, content, and dialect if it is given. Without one, GitLab unless the
    file has fatal errors as such. The id is the hash of the content.
    """
    order = [explicit_path] if explicit_path else []
    places = [*(f"{p}/CODEOWNERS" if p != "." else "CODEOWNERS" for p in LOCATIONS)]
    rank = F.coalesce(*(F.when(F.col("path") == p, F.lit(i)) for i, p in enumerate([*order, *places])))
    kept = [c for c in files.columns if c != "repo"]
    one = files.withColumn("_rank", rank).where("_rank is not null").groupBy("repo").agg(F.min_by(F.struct(*kept), "_rank").alias("x")).select("repo", "x.*")
    one = one.withColumn("codeowners_id", uuid5_of_bytes(F.encode("content", "UTF-8")))
    given = F.col("dialect") if "dialect" in files.columns else F.lit(None).cast("string")
    broken = codeowners_errors(one.select("codeowners_id", "content").dropDuplicates(["codeowners_id"])).where("fatal").select("codeowners_id").distinct().withColumn("_fatal", F.lit(True))
    out = one.join(broken, "codeowners_id", "left")
    return out.withColumn("dialect", F.coalesce(given, F.when(F.col("_fatal"), F.lit("github")).otherwise(F.lit("gitlab")))).drop("_fatal")
