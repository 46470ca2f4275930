"""Benchmark decontamination with n-grams of words, native DataFrame code only.

Every window of 13 consecutive words of a benchmark item is in a broadcast set. A
document that holds a window also holds each shorter gram inside it, so the scan looks
up only grams of 6 words at every 8th word: one of them lies inside any 13 words. The
few documents with such a gram are then verified window by window against the set of
whole windows, and the words of every occurrence are hit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from testloom.llm.common import ascii_lower, broadcast_if, materialize, text_key

WINDOW = 13
#: What stands between words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The set of windows is broadcast up to this many; beyond, Spark may choose the join.
BROADCAST_WINDOWS = 2_000_000
#: Texts whose hashes or keys are broadcast, up to this many.
BROADCAST_TEXTS = 1_000_000
NO_ITEMS = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # SHA-256 of nothing


def words(text: Column) -> Column:
    # cut at what lies between: much faster than to extract each word
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), BETWEEN), ""), F.array().cast("array<string>"))


def _grams(words_col: str, length: int, step: int) -> Column:
    """Hashes of `length` words at every `step`-th word."""
    w = F.col(words_col)
    starts = F.when(F.size(w) >= length, F.sequence(F.lit(1), F.size(w) - length + 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, length)))


def _windows(words_col: str, length: int) -> Column:
    """(start, words) of every window of `length` words."""
    w = F.col(words_col)
    starts = F.when(F.size(w) >= length, F.sequence(F.lit(1), F.size(w) - length + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(length).alias("length"), F.array_join(F.slice(w, i, length), " ").alias("window")))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, length, window: whole windows of an item, or the item itself if it is shorter."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("w") - n + 1)
    return items.select("item", n.alias("length"), F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, n), " "))).alias("window")).distinct()


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated, spans, key.

    Null or empty texts and texts without words have no hit. Equal texts share one
    verification, wherever they are: one row of each text is scanned for windows. An item
    without id is looked for but never listed; repeated items count once. Empty
    benchmark: nothing is hit. Extra columns are ignored. spans and key (a digest of the
    text) are null for documents that hold no gram of any window.

    Broadcast: the windows, only while their counted number is at most BROADCAST_WINDOWS,
    and hashes of texts that hold a gram, only while these are at most BROADCAST_TEXTS;
    beyond, Spark chooses the join.
    """
    return _marked(documents, benchmark, window, id_col, text_col).drop("h")


def _marked(documents: DataFrame, benchmark: DataFrame, window: int, id_col: str, text_col: str, how: str = "left") -> DataFrame:
    """contamination and h, the texts' hash; how "inner": only of documents that hold a gram of a window."""
    windows = materialize(benchmark_windows(benchmark, window))
    sizes = windows.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most `window` rows
    known = broadcast_if(sum(r.n for r in sizes) <= BROADCAST_WINDOWS)
    text, lengths = F.col(text_col), sorted(r.length for r in sizes)
    texts = documents.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))
    n_words = F.size(words(F.col("text"))).cast("long").alias("n_words")
    none = F.lit(None)
    if not lengths:
        clean = texts.select("id", n_words, "h")
        return _result(clean.select("*", none.cast("binary").alias("key"), *(none.cast(kind).alias(c) for c, kind in HITS.items())), id_col)
    gram = {n: max(1, n // 2) for n in lengths}
    seed = reduce(DataFrame.union, (windows.where(F.col("length") == n).select(F.split("window", " ").alias("w")).select(F.explode(_grams("w", gram[n], 1)).alias("gram")) for n in lengths))
    scanned = texts.select("h", words(F.col("text")).alias("w"))
    scanned = scanned.select("h", F.explode(F.flatten(F.array(*(_grams("w", gram[n], n - gram[n] + 1) for n in lengths)))).alias("gram"))
    suspects = materialize(scanned.join(known(seed.distinct()), "gram", "left_semi").select("h").distinct())
    few = broadcast_if(suspects.count() <= BROADCAST_TEXTS)
    # small rows for all, and the texts of the few that may be hit
    marked = texts.join(few(suspects.withColumn("suspect", F.lit(True))), "h", how).withColumn("held", F.when(F.col("suspect"), F.coalesce("text", F.lit(""))))
    marked = materialize(marked.select("id", n_words, "h", F.when(F.col("suspect"), text_key(F.col("held"))).alias("key"), "held"))
    found = marked.where("key is not null").select("key", "held").dropDuplicates(["key"]).select("key", words(F.col("held")).alias("w"))
    found = found.select("key", F.explode(F.flatten(F.array(*(_windows("w", n) for n in lengths)))).alias("x")).select("key", "x.*")
    found = found.join(known(windows), ["length", "window"])
    hits = found.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit")),
        lambda acc, s: F.struct(F.greatest(acc["end"], s["start"] + s["length"] - 1).alias("end"), (acc["hit"] + F.greatest(F.lit(0), s["start"] + s["length"] - 1 - F.greatest(acc["end"], s["start"] - 1))).alias("hit")),
        lambda acc: acc["hit"],
    )
    hits = hits.select("key", covered.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"), "spans")
    hit = marked.where("key is not null").select("id", "n_words", "h", "key").join(hits, "key", "left")
    clean = marked.where("key is null").select("id", "n_words", "h", "key", *(none.cast(kind).alias(c) for c, kind in HITS.items()))
    return _result(hit.unionByName(clean), id_col)


#: What is known of a document that is hit.
HITS = {"n_hit": "long", "n_items": "long", "items_sha256": "string", "spans": "array<struct<start: int, length: int>>"}


def _result(rows: DataFrame, id_col: str) -> DataFrame:
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.lit(NO_ITEMS)).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), "spans", "key", "h",
    )


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """documents without those that are contaminated; all columns stay as they are, whatever their names."""
    bad = materialize(_marked(documents, benchmark, WINDOW, id_col, text_col, "inner").where("contaminated").select("h", "key").distinct())
    few = broadcast_if(bad.count() <= BROADCAST_TEXTS)
    text = F.col(text_col)
    hashed = documents.select(F.struct("*").alias("row"), text.alias("text"), F.xxhash64(text).alias("own_h"))
    # only texts with the hash of a contaminated one need their key
    hashed = hashed.join(few(bad.select("h").distinct()), F.col("own_h") == F.col("h"), "left")
    keyed = hashed.select("row", F.when(F.col("h").isNotNull(), text_key(F.coalesce("text", F.lit("")))).alias("own"))
    return keyed.join(few(bad.select("key")), F.col("own") == F.col("key"), "left_anti").select("row.*")


ORACLE_SQL = r"""
with dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
bw as (select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bn as (select item, w, least(len(w), 13) as n from bw where len(w) > 0),
bx as (select distinct item, n, array_to_string(w[i:i + n - 1], ' ') as win from (select item, w, n, unnest(range(1, len(w) - n + 2)) as i from bn)),
ln as (select distinct n from bx),
dx as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as win from (select doc_id, w, n, unnest(range(1, greatest(1, len(w) - n + 2))) as i from dw, ln)),
h as (select doc_id, i, dx.n, item from dx join bx on dx.n = bx.n and dx.win = bx.win),
p as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(i, i + n)) as pos from (select distinct doc_id, i, n from h)) group by doc_id),
q as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from h where item is not null group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from dw left join p using (doc_id) left join q using (doc_id)
"""
