"""Mixing sources to target weights by weighted fair queueing.

Within its source every document gets a place in a shuffled order and the number of
words before it; divided by the words its source is to give, this is its virtual start
and finish time. A source may be served `epochs` times over: a repeat of a document
enters the queue again, one pass of its source later. The queue of all sources is
range-sorted by virtual finish time, added up, and truncated where the total budget is
spent; what stands before the cut is taken.

A document that would still be in service at virtual time 1, when every source has had
its share, enters the queue in PIECES pieces, so that a source misses its target by a
small part of one document.

Native DataFrame code only. Running sums are taken in buckets of bounded size and then
over bucket totals, so neither a source nor the queue passes through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from testloom.llm.common import materialize, word_count

#: Times a source may be repeated.
EPOCHS = 3
#: Rows that share a running sum, on average, and such buckets that share the next one.
BUCKET_ROWS = 2000
COARSE = 1000
#: Entries of a document that is in service when all shares are reached.
PIECES = 256


def source_targets(sizes: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """source, source_rows, source_size, weight, target of each source.

    Sources by code point, null last, weigh 1, 2, 3, repeating. The level v solves
    sum(min(epochs * size, weight * v)) = sum(size): sources sorted by epochs * size /
    weight, full ones first. One row a source, so this works on the few source totals.
    """
    totals = sizes.groupBy("source").agg(F.count("*").alias("source_rows"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    totals = totals.withColumn("weight", (F.pmod(rank - 1, F.lit(3)) + 1).cast("long"))
    by_level = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    full = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * epochs
    budget = F.sum("source_size").over(Window.partitionBy())
    level = (budget - full) / F.sum("weight").over(after)
    levels = totals.withColumn("level", level)
    # the level rises while sources must be full and falls once more than these are
    found = F.max("level").over(Window.partitionBy())
    return levels.withColumn("found", found).select(
        "source", "source_rows", "source_size", "weight", F.least((F.col("source_size") * epochs).cast("double"), F.col("weight") * F.coalesce("found", F.lit(0.0))).alias("target")
    )


def shuffle_key(id_: Column, tie: Column) -> Column:
    """Place of a document in the shuffled order: 128 bits, the same in every run."""
    return F.md5(F.encode(F.concat(F.lit("mix:"), F.coalesce(id_.cast("string"), F.concat(F.lit("-"), tie.cast("string")))), "UTF-8"))


def sums_before(totals: DataFrame, keys: list[str], bucket: str, value: str) -> DataFrame:
    """totals plus `before`: the sum of value over smaller buckets of the same keys.

    Two levels: over COARSE buckets in a row, and over the totals of those.
    """
    rows = totals.withColumn("coarse", F.floor(F.col(bucket) / COARSE))
    earlier = Window.unboundedPreceding, -1
    upper = rows.groupBy(*keys, "coarse").agg(F.sum(value).alias("total"))
    upper = upper.select(*(F.col(k).alias(f"k_{k}") for k in keys), F.col("coarse").alias("c"), F.coalesce(F.sum("total").over(Window.partitionBy(*keys).orderBy("coarse").rowsBetween(*earlier)), F.lit(0)).alias("above"))
    within = F.coalesce(F.sum(value).over(Window.partitionBy(*keys, "coarse").orderBy(bucket).rowsBetween(*earlier)), F.lit(0))
    same = F.col("coarse") == F.col("c")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"k_{k}"))
    return rows.withColumn("within", within).join(upper, same).withColumn("before", F.col("above") + F.col("within")).select(*totals.columns, "before")


def with_queue_entries(rows: DataFrame, epochs: int) -> DataFrame:
    """rows plus entries: (finish, words) of every pass of the document that starts before time 1."""
    def entries(k: int) -> Column:
        start = F.col("source_size") * k + F.col("upto") - F.col("size")
        time = lambda words: (start + words).cast("double") / F.col("target")
        step = F.ceil(F.col("size") / PIECES)
        upto = lambda j: F.least(j * step, F.col("size"))
        entry = lambda finish, words: F.struct(finish.alias("finish"), words.cast("long").alias("words"))
        pieces = F.transform(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("size") / step)), lambda j: entry(time(upto(j)), upto(j) - upto(j - 1)))
        return F.when(time(F.lit(0)) >= 1, F.array().cast("array<struct<finish: double, words: bigint>>")).when(time(F.col("size")) <= 1, F.array(entry(time(F.col("size")), F.col("size")))).otherwise(pieces)

    served = (F.col("size") > 0) & (F.col("target") > 0)
    return rows.withColumn("entries", F.when(served, F.concat(*(entries(k) for k in range(epochs)))))


def cut_of(queue: DataFrame, budget: int) -> tuple[int, int, float]:
    """(n_buckets, bucket, finish) of the cut of a queue (finish, words): entries of earlier
    buckets, and of this one up to this finish time, are the longest part of the sorted queue
    that the budget pays for; entries that finish together go together."""
    n_buckets = max(1, queue.count() // BUCKET_ROWS)
    rows = queue.withColumn("bucket", queue_bucket(F.col("finish"), n_buckets))
    totals = sums_before(rows.groupBy("bucket").agg(F.sum("words").alias("words")), [], "bucket", "words")
    over = totals.where(F.col("before") + F.col("words") > budget).agg(F.min(F.struct("bucket", "before")).alias("x")).select("x.*").first()
    if over is None or over.bucket is None:
        return n_buckets, n_buckets + 1, 0.0
    inside = rows.where(F.col("bucket") == over.bucket).withColumn("upto", over.before + F.sum("words").over(Window.partitionBy("bucket").orderBy("finish")))
    last = inside.where(F.col("upto") <= budget).agg(F.max("finish").alias("finish")).first().finish
    return n_buckets, over.bucket, -1.0 if last is None else last


def queue_bucket(finish: Column, n_buckets: int) -> Column:
    """Range of virtual time an entry falls into; what finishes after time 1 comes last."""
    return F.least(F.floor(finish * n_buckets), F.lit(n_buckets))


def mix_sources(documents: DataFrame, epochs: int = EPOCHS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", with_tie: bool = False) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, finish_time, in order of finish_time.

    size: words of the text, null has none. taken: words the mix takes of it, repeats
    counted: those of its queue entries before the cut. finish_time: virtual finish time of
    its first pass, null where its source gives nothing. All sources together take the words
    of the corpus, short of at most one piece; a source misses its target by at most a piece
    of the document in service at the end (a PIECES-th of it). Documents of size 0 take
    nothing. Ties of the shuffled order go by size and text hash; rows that agree in these
    too are interchangeable. with_tie adds that hash as `tie`. Empty table: no rows. Extra columns are ignored.
    """
    text = F.col(text_col)
    rows = documents.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("tie"))
    rows = materialize(rows.withColumn("place", shuffle_key(F.col("id"), F.col("tie"))))
    targets = source_targets(rows.select("source", "size"), epochs)
    rows = rows.alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select("r.*", "source_rows", "source_size", "target")
    share = F.conv(F.substring("place", 1, 8), 16, 10).cast("double") / float(1 << 32)
    rows = rows.withColumn("bucket", F.floor(share * F.ceil(F.col("source_rows") / BUCKET_ROWS)))
    totals = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    offsets = sums_before(totals, ["source"], "bucket", "bucket_size").select(F.col("source").alias("o_source"), F.col("bucket").alias("o_bucket"), F.col("before").alias("offset"))
    within = Window.partitionBy("source", "bucket").orderBy("place", "size", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("upto", F.sum("size").over(within))
    placed = placed.join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("bucket") == F.col("o_bucket")))
    placed = materialize(placed.select("id", "tie", "size", "source_size", "target", (F.col("offset") + F.col("upto")).alias("upto")))
    queued = with_queue_entries(placed, epochs)
    budget = placed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    n_buckets, bucket, finish = cut_of(queued.select(F.inline("entries")), budget)

    def before_cut(e: Column) -> Column:
        at = queue_bucket(e["finish"], n_buckets)
        return (at < bucket) | ((at == bucket) & (e["finish"] <= finish))

    taken = F.aggregate(F.filter("entries", before_cut), F.lit(0).cast("long"), lambda acc, e: acc + e["words"])
    first = F.when(F.col("target") > 0, F.col("upto") / F.col("target"))
    out = queued.select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce(taken, F.lit(0).cast("long")).alias("taken"), first.alias("finish_time"), *(["tie"] if with_tie else []))
    return out.orderBy("finish_time", id_col)


ORACLE_SQL = """
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size,
    md5('mix:' || cast(doc_id as varchar)) as place
  from documents),
s as (select source, sum(size) as source_size, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight from d group by source),
l as (select *, cast((sum(source_size) over () - 3 * coalesce(sum(source_size) over (order by source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0)) as double)
    / cast(sum(weight) over (order by source_size / weight, source nulls last rows between current row and unbounded following) as double) as level from s),
t as (select source, source_size, weight, least(cast(3 * source_size as double), weight * coalesce(max(level) over (), 0)) as target from l),
p as (select d.*, t.source_size, t.target, sum(size) over (partition by d.source order by place, size rows unbounded preceding) as upto
  from d join t on d.source is not distinct from t.source),
e as (select doc_id, size, target, k * source_size + upto - size as before, cast(ceil(size / 256.0) as bigint) as step from p, (values (0), (1), (2)) v(k) where size > 0 and target > 0),
f as (select *, cast(before + size as double) / target as finish from e where cast(before as double) / target < 1),
j as (select *, unnest(range(1, cast(ceil(size / cast(step as double)) as bigint) + 1)) as i from f where finish > 1),
q as (select doc_id, finish, size as words from f where finish <= 1 union all
  select doc_id, cast(before + least(i * step, size) as double) / target, least(i * step, size) - least((i - 1) * step, size) from j),
r as (select doc_id, words, sum(words) over (order by finish range unbounded preceding) as total from q),
x as (select doc_id, sum(words) as taken from r where total <= (select sum(size) from d) group by doc_id)
select p.doc_id, cast(size as bigint) as size, cast(source_size as bigint) as source_size, target, cast(coalesce(taken, 0) as bigint) as taken,
  case when target > 0 then cast(upto as double) / target end as finish_time
from p left join x using (doc_id)
"""
