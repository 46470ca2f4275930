"""Code owners: patterns as regexes, and the owners of paths.

Rules are indexed by what their patterns say literally: a prefix, a part of a path or an
extension, of which each rule takes the rarest in its file. A distinct path meets only the
rules under its own keys, by an equality join, and those without any literal; the regex
decides. So the work of a path grows with the rules that are near it, not with its file.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What an owner looks like.
EMAIL = r"[^@\s]{1,100}@[^@\s]{1,255}(?<!\W)"
_NAMESPACE = r"(?:[a-zA-Z0-9_.][a-zA-Z0-9_\-.]{0,254}[a-zA-Z0-9_\-]|[a-zA-Z0-9_])(?<!\.git|\.atom)"
NAME = rf"(?<!\w)@(?:{_NAMESPACE}/){{0,20}}{_NAMESPACE}"


#: A class of characters in a glob; its first character may be a closing bracket.
CLASS = r"(?s)\[(?:!.|[^!])[^\]]*\]"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once and isn't repeated in the plan."""
    return F.element_at(F.transform(F.array(value), body), 1)


def is_glob(pattern: Column) -> Column:
    """Whether a glob is sound: classes are closed, and `**` is a whole component."""
    return _let(F.regexp_replace(pattern, CLASS, "\u0005"), lambda p: ~p.contains("[") & ~p.rlike(r"(?s)\*{3}|[^/]\*\*|\*\*[^/]"))


def _class_regex(text: Column, separator_literal: Column) -> Column:
    """A glob's class as a regex: single characters and ranges, of which a falling one holds nothing."""
    negated = text.startswith("[!")
    items = F.regexp_extract_all(F.regexp_replace(text, r"(?s)^\[!?|\]$", ""), F.lit("(?s).-.|."), F.lit(0))
    rising = F.filter(items, lambda i: (F.length(i) < 3) | (F.ascii(i) <= F.ascii(F.substring(i, 3, 1))))

    def escaped(c: Column) -> Column:
        return F.regexp_replace(c, r"([\[\]\\^&-])", r"\\$1")

    held = F.array_join(F.transform(rising, lambda i: F.when(F.length(i) < 3, escaped(i)).otherwise(F.concat(escaped(F.substring(i, 1, 1)), F.lit("-"), escaped(F.substring(i, 3, 1))))), "")
    one = _let(held, lambda h: F.when(h != "", F.concat(F.when(negated, F.lit("[^")).otherwise(F.lit("[")), h, F.lit("]"))).when(negated, F.lit(".")).otherwise(F.lit("(?!)")))
    return F.concat(F.when(separator_literal, F.lit("(?!/)")).otherwise(F.lit("")), one)


def glob_regex(pattern: Column, separator_literal: Column) -> Column:
    """A sound glob as an unanchored regex; `**` as a whole component crosses directories, other
    wildcards and classes do so only where separators aren't literal."""
    p = F.regexp_replace(F.regexp_replace(pattern, CLASS, "\u0005"), r"([.+^$(){}|\[\]\\])", r"\\$1")
    p = F.regexp_replace(p, r"(?<=^|/)\*\*$", "\u0001")
    p = F.regexp_replace(p, r"(?<=^|/)\*\*/", "\u0002")
    p = F.regexp_replace(p, r"\*+", "\u0003")
    p = F.regexp_replace(p, r"\?", "\u0004")
    p = F.replace(F.replace(p, F.lit("\u0001"), F.lit(".*")), F.lit("\u0002"), F.lit("(?:.*/)?"))
    p = F.replace(p, F.lit("\u0003"), F.when(separator_literal, F.lit("[^/]*")).otherwise(F.lit(".*")))
    p = F.replace(p, F.lit("\u0004"), F.when(separator_literal, F.lit("[^/]")).otherwise(F.lit(".")))
    classes = F.transform(F.regexp_extract_all(pattern, F.lit(CLASS), F.lit(0)), lambda c: _class_regex(c, separator_literal))
    return _let(classes, lambda known: F.array_join(F.transform(F.split(p, "\u0005"), lambda x, i: F.concat(x, F.coalesce(F.get(known, i), F.lit("")))), ""))


def _github_base(path: Column) -> Column:
    """(base, starred): a GitHub pattern from the root, and whether it ends in `**` after other text, of which one `*` is left."""
    anywhere = F.when(path.startswith("*") | path.startswith("/"), path).otherwise(F.concat(F.lit("**/"), path))
    base = F.regexp_replace(F.regexp_replace(anywhere, "^/+", ""), "/$", "/**")
    return _let(base, lambda b: F.struct(F.regexp_replace(b, r"(?s)^(.*[^/])\*\*$", "$1*").alias("base"), b.rlike(r"(?s)[^/]\*\*$").alias("starred")))


def is_github_glob(path: Column) -> Column:
    """Whether a GitHub pattern is sound."""
    return is_glob(_github_base(path)["base"])


def github_rule(path: Column) -> Column:
    """(regex, direct) of a sound GitHub pattern; direct: it owns a directory's files, not what is below."""

    def fallback(b: Column) -> Column:
        # a last part without wildcard or extension may be a directory
        last = F.regexp_extract(b["base"], "[^/]*$", 0)
        plain = _let(last, lambda x: ~x.contains("*") & ~F.substring(x, 2, 1 << 30).contains(".") & (x != "") & (x != "."))
        return F.when(b["starred"] | plain, F.concat(b["base"], F.lit("/**")))

    def rule(b: Column) -> Column:
        base, other = b["base"], b["other"]
        literal = base.contains("/") | other.isNotNull()
        either = F.concat(glob_regex(base, literal), F.coalesce(F.concat(F.lit("|"), glob_regex(other, literal)), F.lit("")))
        return F.struct(F.concat(F.lit("(?is)^(?:"), either, F.lit(")$")).alias("regex"), (other.isNull() & base.endswith("/*")).alias("direct"))

    return _let(_let(_github_base(path), lambda b: F.struct(b["base"].alias("base"), fallback(b).alias("other"))), rule)


def gitlab_pattern(pattern: Column) -> Column:
    """A GitLab pattern in full: from the root, with escapes resolved."""
    p = F.regexp_replace(F.regexp_replace(pattern, r"^\\#", "#"), r"\\\s+", " ")
    p = F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/**/"), p))
    p = F.when(p.endswith("/"), F.concat(p, F.lit("**/*"))).otherwise(p)
    return F.when(pattern == "*", F.lit("/**/*")).otherwise(p)


def gitlab_regex(full_pattern: Column) -> Column:
    """The regex of a full pattern; null, which matches nothing, where it isn't sound."""
    return _let(full_pattern, lambda p: F.when(is_glob(p), F.concat(F.lit("(?s)^"), glob_regex(p, F.lit(True)), F.lit("$"))))


def owner_emails(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0))))


def owner_names(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(NAME), F.lit(0))))


def owner_references(text: Column) -> Column:
    """Emails and names in a text, distinct and sorted."""
    return F.array_sort(F.array_union(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)), F.regexp_extract_all(text, F.lit(NAME), F.lit(0))))


def dedupe_rules(rules: DataFrame) -> DataFrame:
    """A pattern repeated in a section keeps its first place and its last value."""
    keys = ["codeowners_id", "section", "pattern"]
    kept = [c for c in rules.columns if c not in (*keys, "rule_pos")]
    one = rules.groupBy(*keys).agg(F.min("rule_pos").alias("_first"), F.max_by(F.struct(*kept), "rule_pos").alias("x"))
    return one.select(*keys, F.col("_first").alias("rule_pos"), "x.*")


def section_stats(rules: DataFrame) -> DataFrame:
    """Sections of a file in order: rules, and whether all are optional."""
    return rules.groupBy("codeowners_id", "section").agg(F.min("section_pos").alias("section_pos"), F.count("pattern").alias("num_rules"), F.coalesce(F.bool_and("optional"), F.lit(True)).alias("is_optional"))


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _needle(rules: DataFrame) -> Column:
    """The longest part of a pattern that every path it matches must hold, in lower case; empty without a pattern."""
    if "pattern" not in rules.columns:
        return F.lit("").alias("needle")
    parts = F.split(F.regexp_replace("pattern", CLASS, "*"), r"[*?/\\\s\[\]]+")
    longest = F.array_max(F.transform(parts, lambda p: F.struct(F.length(p).alias("n"), _lower(p).alias("p"))))
    return F.coalesce(longest["p"], F.lit("")).alias("needle")


#: Leading parts of a path that make keys; longer prefixes aren't needed, as the regex decides.
PREFIX_PARTS = 8


def _plain(text: Column) -> Column:
    """Lower case, and without line ends at the end of a part, before which a regex may end too."""
    return F.regexp_replace(_lower(text), "[\\n\\r\u0085\u2028\u2029]+(?=/|\\z)", "")


def _prefixes(text: Column) -> Column:
    """Keys of the first 1 to PREFIX_PARTS parts of a text."""

    def of_parts(parts: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(PREFIX_PARTS))), lambda n: F.concat(F.lit("p"), F.array_join(F.slice(parts, F.lit(1), n), "/")))

    return _let(F.split(F.ltrim(text, F.lit("/")), "/"), of_parts)


def _path_keys(path: Column) -> Column:
    """What a path can be found by: its parts, their extensions, its prefixes, and the empty key."""

    def of_parts(parts: Column) -> Column:
        names = F.transform(parts, lambda p: F.concat(F.lit("n"), p))
        kinds = F.transform(F.filter(parts, lambda p: p.contains(".")), lambda p: F.concat(F.lit("x."), F.substring_index(p, ".", -1)))
        return F.concat(F.array(F.lit("")), names, kinds)

    def keys(plain: Column) -> Column:
        below = F.when(plain.startswith("./"), _prefixes(F.substring(plain, 3, 1 << 30))).otherwise(F.array().cast("array<string>"))
        return F.array_distinct(F.concat(_let(F.split(plain, "/"), of_parts), _prefixes(plain), below))

    return _let(_plain(path), keys)


def _rule_keys(pattern: Column) -> Column:
    """Keys that every path which a pattern matches has; a class and what follows it count as a wildcard."""
    plain = F.regexp_replace(_plain(pattern), r"(?s)\[.*", "*")
    parts = F.filter(F.split(plain, "/"), lambda p: p != "")
    names = F.transform(F.filter(parts, lambda p: ~p.rlike(r"[*?\]]")), lambda p: F.concat(F.lit("n"), p))
    kinds = F.filter(F.transform(parts, lambda p: F.concat(F.lit("x"), F.regexp_extract(p, r"\.[^.*?\]]+$", 0))), lambda k: k != "x")
    stem = F.regexp_replace(F.regexp_extract(F.concat(F.regexp_replace(plain, "^/+", ""), F.lit("/")), r"(?s)^([^*?\]]*)/", 1), "/+$", "")
    prefix = F.when(plain.startswith("/") & (stem != ""), F.slice(_prefixes(stem), -1, 1)).otherwise(F.array().cast("array<string>"))
    return F.array_union(F.array(F.lit("")), F.concat(prefix, names, kinds))


def _index(rules: DataFrame, *fields: str) -> DataFrame:
    """Rules of a file by key: codeowners_id, key, rules (fields and needle). A rule stands under the one of its
    keys that the fewest rules of its file have; the empty key is there for each file."""
    keys = _rule_keys(F.coalesce("pattern", F.lit(""))) if "pattern" in rules.columns else F.array(F.lit(""))
    # one shuffle, by file, serves the window and both aggregations
    rows = rules.where("codeowners_id is not null").repartition("codeowners_id").select("codeowners_id", F.struct(*fields, _needle(rules)).alias("rule"), F.explode(keys).alias("key"))
    n = F.count("*").over(Window.partitionBy("codeowners_id", "key"))
    rank = F.struct((F.col("key") == "").alias("last"), n.alias("n"), (-F.length("key")).alias("short"), "key")
    chosen = rows.select("codeowners_id", "rule", rank.alias("rank")).groupBy("codeowners_id", "rule").agg(F.min("rank").alias("rank"))
    # a key a rule, and the empty key without a rule
    places = chosen.select("codeowners_id", "rule", F.explode(F.array_distinct(F.array(F.lit(""), "rank.key"))).alias("key"), F.col("rank.key").alias("own"))
    return places.groupBy("codeowners_id", "key").agg(F.collect_list(F.when(F.col("key") == F.col("own"), F.col("rule"))).alias("rules"))


def _candidates(files: DataFrame, index: DataFrame) -> DataFrame:
    """Distinct paths with the rules under each of their keys: codeowners_id, path, rules; a row for each key a path shares
    with its file of rules, the empty one included."""
    one = files.select("codeowners_id", "path").where("codeowners_id is not null and path is not null").distinct()
    # dealt over all tasks: paths are few bytes but much work, so they aren't merged by their size
    dealt = one.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("codeowners_id", "path"))
    return dealt.select("codeowners_id", "path", F.explode(_path_keys(F.col("path"))).alias("key")).join(index, ["codeowners_id", "key"]).select("codeowners_id", "path", "rules")


def owners_github(files: DataFrame, rules: DataFrame) -> DataFrame:
    """codeowners_id, path, owners of each distinct path that a rule matches; the last rule wins.

    A path matches as it is, without a leading `./`, or by one of its parent directories
    unless the rule is for direct children. rules: codeowners_id, rule_pos, regex, direct, owners,
    and pattern, without which every rule is tried for every path.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    own = F.array_compact(F.array(F.col("path"), F.when(F.col("path").startswith("./"), F.substring("path", 3, 1 << 30))))
    rows = _candidates(files, _index(rules, "rule_pos", "regex", "direct", "owners")).withColumn("own", own).withColumn("above", above).withColumn("low", _lower(F.col("path")))

    def matches(r: Column) -> Column:
        met = F.exists("own", lambda p: F.regexp_like(p, r["regex"])) | (~r["direct"] & F.exists("above", lambda p: F.regexp_like(p, r["regex"])))
        return F.col("low").contains(r["needle"]) & met

    found = rows.select("codeowners_id", "path", F.explode(F.filter("rules", matches)).alias("r")).select("codeowners_id", "path", F.struct("r.rule_pos", "r.owners").alias("r"))
    return found.groupBy("codeowners_id", "path").agg(F.max("r").alias("r")).select("codeowners_id", "path", "r.owners").where("owners is not null")


def owners_gitlab(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Owners of the last matching rule of each section, sections in order; empty where no rule matches.

    rules: codeowners_id, section, section_pos, rule_pos, regex, owners, and pattern, without
    which every rule is tried for every path.
    """
    rooted = F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat(F.lit("/"), F.regexp_replace("path", r"^\./", "")))
    rows = _candidates(files, _index(rules, "section_pos", "rule_pos", "regex", "owners")).withColumn("rooted", rooted).withColumn("low", _lower(F.col("path")))
    met = F.filter("rules", lambda r: F.col("low").contains(r["needle"]) & F.regexp_like(F.col("rooted"), r["regex"]))
    rows = rows.select("codeowners_id", "path", F.explode_outer(met).alias("r"))
    place = F.when(F.col("r").isNotNull(), F.struct("r.section_pos", "r.rule_pos", "r.owners"))
    found = rows.groupBy("codeowners_id", "path").agg(F.sort_array(F.collect_list(place)).alias("met"))

    def is_last(r: Column, at: Column) -> Column:
        following = F.try_element_at("met", at + 2)
        return following.isNull() | (following["section_pos"] != r["section_pos"])

    last = F.transform(F.filter("met", is_last), lambda r: F.coalesce(r["owners"], F.array().cast("array<string>")))
    return found.select("codeowners_id", "path", F.flatten(last).alias("owners"))


def associate_owners(files: DataFrame, github: DataFrame, gitlab: DataFrame) -> DataFrame:
    """Every input row with its owners; without file or matcher the list is empty."""
    found = owners_github(files, github).unionByName(owners_gitlab(files, gitlab))
    return files.join(found, ["codeowners_id", "path"], "left").withColumn("owners", F.coalesce("owners", F.array().cast("array<string>")))
