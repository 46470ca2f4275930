"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of any 50 consecutive words, the least hash of their grams
of 25 words; equal stretches of 50 words choose equal seeds at equal places. A join on
seeds leaves, of each document, only the stretches around seeds that another document
has too.

The occurrences of a seed form a node. Its leader is the occurrence in the smallest id;
every other occurrence is matched against it, extended to the left and to the right word
by word as far as the words agree. Stretches of 50 words inside that match are settled:
the smallest id has them. The union of such matches is every maximal repeat of 50 words
or more. Stretches that leave the match go on to a smaller node, with the words that part
them from the leader; occurrences that share such a stretch go to the same node, so none
is missed. Every round settles at least one word more, so there are at most 51 of them,
and what is left shrinks fast.

Extending against a leader, not against each other document, makes a passage that n
documents share cost n rows a round, not n * n pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from testloom.llm.common import WordBlock, blocks, materialize, release, sliding

LENGTH = 50
SEED = 25


def normalised(raw: bytes | None) -> bytes:
    """The words of a text joined by one blank; bytes.split() knows just the rule's white space."""
    return b" ".join((raw or b"").split())


class Seeds:
    """Least hash of the grams in every stretch of `length` words of a block of documents."""

    def __init__(self, docs: list[bytes], length: int, seed: int):
        self.words = WordBlock(docs)
        self.grams = self.words.grams(seed)
        self.least = sliding(self.grams, length - seed + 1, np.minimum)
        #: first and last stretch of each document
        self.ranges = [(a, max(a, b - length + 1)) for a, b in zip(self.words.first[:-1].tolist(), self.words.first[1:].tolist(), strict=True)]

    def places(self, starts: np.ndarray) -> np.ndarray:
        """The first word of each stretch's seed; of equal grams in a stretch the first counts."""
        values, number = np.unique(self.grams, return_inverse=True)
        size = len(self.grams) + 1
        sorted_ = np.sort(number * size + np.arange(len(self.grams)))
        return sorted_[np.searchsorted(sorted_, np.searchsorted(values, self.least[starts]) * size + starts)] % size


def _scan(length: int, seed: int):
    """Key, number of words and distinct seeds of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [normalised(x.as_py()) for x in batch.column(2)]
            seeds: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
            for block in blocks((i, t) for i, t in enumerate(texts) if t):
                s = Seeds([t for _, t in block], length, seed)
                for (i, _), (a, b) in zip(block, s.ranges, strict=True):
                    seeds[i] = np.unique(s.least[a:b]).view(np.int64)
            keys = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            counts = pa.array([t.count(b" ") + bool(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), keys, counts, pa.array(seeds, pa.list_(pa.int64()))], ["id", "tie", "key", "n_words", "seeds"])

    return run


def _occurrences(length: int, seed: int):
    """Every occurrence of a shared seed: its place, how many words before it stretches may
    begin (least and most), and the words before it and from it on that these reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = batch.column(2)
            for block in blocks((i, normalised(x.as_py())) for i, x in enumerate(batch.column(1))):
                s = Seeds([v for _, v in block], length, seed)
                data, starts, ends = s.words.buf.tobytes(), s.words.starts.tolist(), s.words.ends.tolist()
                own = [a + np.flatnonzero(np.isin(s.least[a:b].view(np.int64), shared[i].values.to_numpy())) for (i, _), (a, b) in zip(block, s.ranges, strict=True)]
                at = np.concatenate(own)
                if not len(at):
                    continue
                row, zero = (np.repeat([x[k] for x in pairs], [len(x) for x in own]) for k, pairs in ((0, block), (0, s.ranges)))
                place = s.places(at)
                new = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1))))
                first, last, place, row, zero = at[new], at[np.append(new[1:], len(at)) - 1], place[new], row[new], zero[new]
                spans = list(zip(first.tolist(), last.tolist(), place.tolist(), strict=True))
                left = [data[starts[f] : ends[p - 1]] if p > f else b"" for f, _, p in spans]
                right = [data[starts[p] : ends[z + length - 1]] for _, z, p in spans]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array(s.grams[place].view(np.int64)), *(pa.array(x.astype(np.int32)) for x in (place - zero, place - last, place - first)), *(pa.array(x, pa.binary()).cast(pa.string()) for x in (left, right))],
                    ["key", "node", "place", "least", "most", "left", "right"],
                )

    return run


def _common(a: Column, b: Column) -> Column:
    """Number of words that two arrays have in common from the first on."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    differ = F.array_position(same, F.lit(False))
    return F.when(differ == 0, F.size(same)).otherwise(differ - 1).cast("int")


def _extended(occurrences: DataFrame, leaders: DataFrame, length: int) -> DataFrame:
    """Occurrences matched against their leaders: rows with node null are settled stretches
    (those that a smaller id has), from word `least` to word `most`; the others go on."""
    before, after = F.reverse(F.split("left", " ")), F.split("right", " ")
    rows = occurrences.join(leaders, "node").withColumns({"b": before, "a": after})
    rows = rows.withColumns({"l": _common(F.col("b"), F.reverse(F.split("leader.left", " "))), "r": _common(F.col("a"), F.split("leader.right", " "))})
    here = [F.col(c).alias(c) for c in ("key", "id", "place", "left", "right")]
    none = F.lit("").alias("left"), F.lit("").alias("right")
    x, y = F.greatest("least", length - F.col("r")), F.least("most", "l")
    settled = F.struct(*here[:3], *none, F.lit(None).cast("long").alias("node"), (F.col("place") - y).alias("least"), (F.col("place") - x).alias("most"))

    def part(side: str, words: str, have: str, low: Column, high: Column) -> Column:
        node = F.xxhash64("node", F.lit(side), F.col(have), F.get(words, F.col(have)))
        return F.when(low <= high, F.struct(*here, node.alias("node"), low.alias("least"), high.alias("most")))

    further_left = part("left", "b", "l", F.greatest(F.col("least"), F.col("l") + 1), F.col("most"))
    further_right = part("right", "a", "r", F.col("least"), F.least("most", "l", length - 1 - F.col("r")))
    found = F.array(F.when((x <= y) & (F.col("id") > F.col("leader.id")), settled), further_left, further_right)
    return rows.select(F.explode(F.array_compact(found)).alias("x")).select("x.*")


def repeated_stretches(documents: DataFrame, length: int = LENGTH, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts, removals).

    texts: id, key, n_words, first_id of every row; key stands for the sequence of words and
    first_id is the smallest id with it. removals: key, n_removed, kept (UTF-8) for word
    sequences of which the first document loses words.
    """
    kind = documents.schema[id_col].dataType.simpleString()
    texts = documents.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tie"), F.encode(text_col, "UTF-8").alias("raw"))
    # one pass over the texts: small rows that all later steps start from
    rows = materialize(texts.mapInArrow(_scan(length, seed), f"id {kind}, tie long, key binary, n_words long, seeds array<long>"))
    named = rows.where("id is not null")
    firsts = named.groupBy("key").agg(F.min(F.struct("id", "tie")).alias("x")).select("key", F.col("x.id").alias("first_id"), F.col("x.tie").alias("tie"))
    scanned = named.select("key", F.explode("seeds").alias("seed"))
    several = scanned.groupBy("seed").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least != most").select("seed")
    # seeds that several word sequences share, by word sequence
    shared = materialize(scanned.join(several, "seed").groupBy("key").agg(F.collect_set("seed").alias("seeds")).join(firsts, "key").withColumnRenamed("first_id", "id"))
    held = materialize(texts.join(shared, ["id", "tie"]).dropDuplicates(["key"]).select(F.struct("key", "id").alias("key"), "raw", "seeds"))
    open_ = materialize(held.mapInArrow(_occurrences(length, seed), f"key struct<key: binary, id: {kind}>, node long, place int, least int, most int, left string, right string").select("key.*", "node", "place", "least", "most", "left", "right"))
    rounds: list[DataFrame] = []
    while True:
        leaders = open_.groupBy("node").agg(F.min(F.struct("id", "key", "place", "left", "right")).alias("leader"), F.max("id").alias("last")).where("leader.id < last")
        leaders = materialize(leaders.select("node", F.struct("leader.id", "leader.left", "leader.right").alias("leader")))
        if leaders.isEmpty():
            release(leaders)
            break
        found = materialize(_extended(open_, leaders, length))
        release(leaders, *([] if rounds else [open_]))
        rounds.append(found)
        open_ = found.where("node is not null")
    settled = [x.where("node is null").select("key", F.struct(F.col("least").alias("first"), F.col("most").alias("last")).alias("x")) for x in rounds]
    if not settled:
        settled = [open_.limit(0).select("key", F.struct(F.col("least").alias("first"), F.col("most").alias("last")).alias("x"))]
    gone = reduce(DataFrame.unionByName, settled).groupBy("key").agg(F.collect_list("x").alias("x"))
    gone = gone.select("key", F.col("x.first").alias("first"), F.col("x.last").alias("last"))
    removals = held.select("key.key", "raw").join(gone, "key").mapInArrow(_remove(length), "key binary, n_removed long, kept binary")
    return rows.select("id", "key", "n_words").join(firsts.select("key", "first_id"), "key", "left"), removals


def _remove(length: int):
    """Texts without the words of the settled stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for text, first, last in zip(*batch.columns[1:], strict=True):
                words = text.as_py().split()
                steps = np.zeros(len(words) + 1, np.int64)
                np.add.at(steps, first.values.to_numpy(), 1)
                np.add.at(steps, last.values.to_numpy() + length, -1)
                gone = np.cumsum(steps[:-1]) > 0
                removed.append(int(gone.sum()))
                kept.append(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], ["key", "n_removed", "kept"])

    return run


def substring_dedup(documents: DataFrame, length: int = LENGTH, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_text (null where nothing is removed), kept_sha256.

    Words are runs without white space, unchanged. A word goes if it lies in `length` words
    that also start in a document with a smaller id; this is judged on the input. Of equal
    word sequences the smallest id is scanned, the others lose all words if they have
    `length` or more. A null text has no words. Rows without id are never changed and never
    a reason for a change. Rows that repeat an id are the same document. Extra columns are
    ignored, an empty table gives no rows.
    """
    rows, removals = repeated_stretches(documents, length, seed, id_col, text_col)
    copy = F.coalesce((F.col("id") > F.col("first_id")) & (F.col("n_words") >= length), F.lit(False))
    first = F.coalesce(F.col("id") == F.col("first_id"), F.lit(False))
    out = rows.join(removals, "key", "left")
    n_removed = F.when(copy, F.col("n_words")).when(first, F.coalesce("n_removed", F.lit(0))).otherwise(F.lit(0)).cast("long")
    kept = F.when(copy, F.encode(F.lit(""), "UTF-8")).when(first, F.col("kept"))
    digest = F.coalesce(F.sha2(kept, 256), F.lower(F.hex("key")))
    return out.select(F.col("id").alias(id_col), "n_words", n_removed.alias("n_removed"), F.decode(kept, "UTF-8").alias("kept_text"), digest.alias("kept_sha256"))


ORACLE_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
x as (select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as h from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 48))) as i from d)),
m as (select h, min(doc_id) as least from x group by h having count(distinct doc_id) > 1),
g as (select distinct doc_id, unnest(range(i, i + 50)) as pos from x join m using (h) where doc_id > least),
r as (select doc_id, count(*) as n from g group by doc_id),
p as (select doc_id, unnest(range(1, len(w) + 1)) as pos, unnest(w) as word from d),
k as (select doc_id, string_agg(word, ' ' order by pos) as kept from p where not exists (select 1 from g where g.doc_id = p.doc_id and g.pos = p.pos) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(r.n, 0) as bigint) as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
from d left join r using (doc_id) left join k using (doc_id)
"""
