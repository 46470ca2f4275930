"""Ranked lexical search by NRA (no random access).

1. One pass over the documents writes an index: a row a document with its length and, for the
   terms that any query asks for, their numbers and occurrences. Nothing is shuffled.
2. Counts over the index give the statistics of the corpus and of every term, and with them
   each term's weight.
3. Each task turns its rows into blocks of impact-sorted lists, one a term. For every query
   the lists of its terms are read side by side from the top, in steps that double. A
   document's lower bound is what has been read of it; its upper bound adds, for the lists
   in which it hasn't been met, the last impact read there. Reading ends when no document
   that could still reach the k-th lower bound has an open interval and an unseen one can't
   reach it either; so membership, ties and scores are final.
4. A task keeps k documents a query over all its blocks, whose k-th score bounds later
   blocks from the start; the tasks' documents are ranked together.

Queries are dealt into blocks of a bounded size, one broadcast each, so their number isn't
bounded by the driver's memory.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from testloom.llm.common import materialize

TOP = 10
#: Bytes of query texts that are broadcast at once.
QUERY_BYTES = 16 << 20
#: Documents and index entries of a block of lists, and entries read of each list at first.
BLOCK_DOCS = 8192
BLOCK_ENTRIES = 1 << 20
READ = 32
#: Every byte that isn't part of a term is a blank, and A-Z are lower-cased.
_TERM_BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))


def terms(text: str | None) -> list[bytes]:
    """Terms of a whole text, with repeats; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _index(vocabulary):
    """A row per document: id, n, the numbers of the asked terms it holds, their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        for batch in batches:
            n, found, times = [], [], []
            for text in batch.column(1):
                words = terms(text.as_py())
                n.append(len(words))
                counts = Counter(map(number.get, words))
                counts.pop(None, None)
                found.append(np.fromiter(counts.keys(), np.int32, len(counts)).tobytes())
                times.append(np.fromiter(counts.values(), np.int32, len(counts)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(found, pa.binary()), pa.array(times, pa.binary())], ["id", "n", "terms", "times"])

    return run


def _frequencies(n_terms: int):
    """Rows (term, df) of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32), minlength=n_terms)
        own = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(df[own])], ["term", "df"])

    return run


class Lists:
    """Impact-sorted lists of a block of documents."""

    def __init__(self, ids: pa.Array, n: np.ndarray, terms: list[bytes], times: list[bytes], weights: np.ndarray, n_docs: int, n_words: int):
        self.ids = ids
        tf = np.frombuffer(b"".join(times), np.int32).astype(np.int64)
        term = np.frombuffer(b"".join(terms), np.int32)
        doc = np.repeat(np.arange(len(n)), [len(t) // 4 for t in terms])
        m = 10 + (90 * n * n_docs) // max(1, n_words)
        impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        order = np.lexsort((-impact, term))
        self.doc, self.impact = doc[order], impact[order]
        self.ends = np.searchsorted(term[order], np.arange(len(weights) + 1))

    def best(self, query: list[int], k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of this block whose scores are among its k highest and at least `floor`, ties included, and the scores."""
        lists = [(a, b) for a, b in zip(self.ends[query].tolist(), self.ends[np.asarray(query) + 1].tolist(), strict=True) if a < b and self.impact[a] > 0]
        bottom = np.array([self.impact[a] for a, _ in lists], np.int64)
        size = len(self.ids)
        low, met = np.zeros(size, np.int64), np.zeros((size, len(lists)), bool)
        read, step = 0, READ
        while int(bottom.sum()) >= max(floor, 1) or read:
            for i, (a, b) in enumerate(lists):
                x, y = min(a + read, b), min(a + read + step, b)
                if x < y:
                    low[self.doc[x:y]] += self.impact[x:y]  # a document is in a list once
                    met[self.doc[x:y], i] = True
                bottom[i] = self.impact[y - 1] if y < b else 0
            read, step = read + step, step * 2
            if np.count_nonzero(low) >= k:
                floor = max(floor, int(np.partition(low, size - k)[size - k]))
            unseen = int(bottom.sum())
            if unseen >= max(floor, 1):
                continue
            seen = np.flatnonzero(low)
            high = low[seen] + unseen - met[seen] @ bottom
            if not ((high >= floor) & (high != low[seen])).any():
                break
        at = np.flatnonzero((low > 0) & (low >= floor))
        return at, low[at]


def _merged(ids: list, scores: list[int], k: int) -> list[tuple[int, object]]:
    """The k highest scores, of equal ones those of the smallest ids, null last."""
    return sorted(zip(scores, ids, strict=True), key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))[:k]


def _search(queries, k: int, n_docs: int, n_words: int):
    """Rows (query, id, score): the best documents of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weights = queries.value
        best: list[list[tuple[int, object]]] = [[] for _ in wanted]
        kind = None

        def read(held: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(held)
            lists = Lists(table.column(0).combine_chunks(), table.column(1).to_numpy(), table.column(2).to_pylist(), table.column(3).to_pylist(), weights, n_docs, n_words)
            for q, numbers in enumerate(wanted):
                own = best[q]
                at, scores = lists.best(numbers, k, own[-1][0] if len(own) == k else 1)
                if len(at):
                    ids = lists.ids.take(pa.array(at)).to_pylist()
                    best[q] = _merged(ids + [x[1] for x in own], scores.tolist() + [x[0] for x in own], k)

        held, docs, entries = [], 0, 0
        for batch in batches:
            kind = batch.schema.field(0).type
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                size = sum(map(len, part.column(2).to_pylist())) // 4
                if held and (docs + part.num_rows > BLOCK_DOCS or entries + size > BLOCK_ENTRIES):
                    read(held)
                    held, docs, entries = [], 0, 0
                held, docs, entries = [*held, part], docs + part.num_rows, entries + size
        if held:
            read(held)
        rows = [(q, i, s) for q, own in enumerate(best) for s, i in own]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.int64())], ["query", "id", "score"])

    return run


def _one_block(documents: DataFrame, asked: list, k: int, item_kind: str) -> DataFrame:
    """Results of the queries in `asked`, rows (item, text)."""
    spark = documents.sparkSession
    per_item = [sorted(set(terms(r.text))) for r in asked]
    names = sorted({t for ts in per_item for t in ts})
    number = {t: i for i, t in enumerate(names)}
    kind = documents.schema["id"].dataType.simpleString()
    index = materialize(documents.mapInArrow(_index(spark.sparkContext.broadcast(number)), f"id {kind}, n long, terms binary, times binary"))
    totals = index.agg(F.count_if(F.col("n") > 0).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    df = {r.term: r.df for r in index.select("terms").mapInArrow(_frequencies(len(names)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}  # a row a term of these queries
    weights = np.array([weight(totals.n, df.get(i, 0)) for i in range(len(names))], np.int64)
    wanted = [np.array([number[t] for t in ts], np.int64) for ts in per_item]
    found = index.mapInArrow(_search(spark.sparkContext.broadcast((wanted, weights)), k, totals.n, totals.words), f"query int, id {kind}, score long")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    items = spark.createDataFrame([(q, r.item) for q, r in enumerate(asked)], f"query int, item {item_kind}")
    # no more rows than queries in a block
    return ranked.join(F.broadcast(items), "query").select("item", "rank", "id", "score")


def search(documents: DataFrame, queries: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """Rows item, rank, id, score: each query's k highest-scoring documents with a score above 0.

    Terms are runs of ASCII letters, digits and other than ASCII characters, A-Z lower-cased;
    null has none. Equal scores are ranked by ascending id, null last. A query counts each of
    its terms once; one without terms that occur has no rows. Every row of `queries` is a query
    of its own, also where rows repeat an id or lack one; documents likewise. Statistics cover
    all documents. Empty tables give no rows; only the named columns are read.
    """
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    asked = queries.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    item_kind = asked.schema["item"].dataType.simpleString()
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n_blocks = 1 + size // query_bytes
    out = None
    for b in range(n_blocks):
        block = asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == b).collect()  # query_bytes on average
        one = _one_block(docs, block, k, item_kind)
        out = one if out is None else out.unionByName(one)
    return out.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


_TERMS = r"""regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
ORACLE_SQL = f"""
with t as materialized (select doc_id, {_TERMS.format('text')} as w from documents),
s as (select count(*) filter (where len(w) > 0) as n_docs, cast(sum(len(w)) as bigint) as n_words from t),
q as materialized (select item_id, unnest(list_distinct({_TERMS.format('text')})) as term from benchmark),
v as (select distinct term from q),
p as materialized (select doc_id, term, n, count(*) as tf from (select doc_id, len(w) as n, unnest(w) as term from t) join v using (term) group by all),
f as (select term, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) as bigint) as w from p, s group by term, n_docs),
r as (select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_words)))) as bigint) as score from q join p using (term) join f using (term), s group by 1, 2)
select item_id, cast(place as int) as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as place from r where score > 0) where place <= {TOP}
"""
