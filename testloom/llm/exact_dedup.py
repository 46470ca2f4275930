"""Exact dedup by composable polynomial fingerprints.

A normalised text is the polynomial sum(byte[i] * base**i) modulo two primes. Equal
chunks are hashed at once as rows of a matrix; the fingerprint of the whole combines
them by length-shifted arithmetic: H(AB) = H(A) + base**len(A) * H(B). Texts whose
length and fingerprints agree are then compared with the text that stays, chunk by
chunk, so a collision can't remove a document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from testloom.llm.common import BROADCAST_ROWS, ascii_lower, broadcast_if, materialize, without

PRIMES = (2147483647, 2147483629)
BASE = 263
#: Bytes of a chunk; a sum of 2**14 products below 2**39 fits 64 bits.
CHUNK = 1 << 14
#: Bytes of a chunk of the final comparison, and of a piece of a huge text: whole CHUNKs.
COMPARED = 1 << 20
#: Bytes from which a text is hashed in pieces by several tasks.
HUGE = 1 << 23


def _powers(prime: int) -> np.ndarray:
    out = np.empty(CHUNK, np.int64)
    out[0] = 1
    for i in range(1, CHUNK):
        out[i] = out[i - 1] * BASE % prime
    return out


class Fingerprints:
    def __init__(self):
        self.powers = [_powers(p) for p in PRIMES]
        self.shift = [pow(BASE, CHUNK, p) for p in PRIMES]

    def combine(self, parts: np.ndarray, which: int) -> int:
        """Fingerprint of texts in a row, each of CHUNK bytes but the last."""
        prime, shift, out = PRIMES[which], self.shift[which], 0
        for part in parts[::-1].tolist():
            out = (part + shift * out) % prime
        return out

    def of(self, text: bytes) -> tuple[int, int]:
        data = np.frombuffer(text, np.uint8)
        if len(data) <= CHUNK:
            return tuple(int((data * p[: len(data)]).sum() % prime) for p, prime in zip(self.powers, PRIMES, strict=True))
        whole = len(data) // CHUNK * CHUNK
        out = []
        for k, (p, prime) in enumerate(zip(self.powers, PRIMES, strict=True)):
            parts = [int((data[at : at + CHUNK] * p).sum() % prime) for at in range(0, whole, CHUNK)]
            parts.append(int((data[whole:] * p[: len(data) - whole]).sum() % prime))
            out.append(self.combine(np.array(parts, np.int64), k))
        return tuple(out)


def with_fingerprints(documents: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, n_bytes, fp (the two fingerprints in one long) and text_sha256 of each normalised text, h (hash) of the text as it is.

    Texts of more than HUGE bytes are dealt over tasks in pieces; the pieces' fingerprints
    are combined by a small aggregate, once for all copies of a text.
    """

    def whole_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprints()
        for batch in batches:
            texts = [t.as_py().lower() for t in batch.column(2)]  # of bytes: A-Z only
            found = np.array([prints.of(t) for t in texts], np.int64).reshape(-1, 2)
            digests = [hashlib.sha256(t).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(found[:, 0]), pa.array(found[:, 1])], ["id", "h", "text_sha256", "n_bytes", "a", "b"])

    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprints()
        for batch in batches:
            found = np.array([prints.of(t.as_buffer()) for t in batch.column(2)], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found[:, 0]), pa.array(found[:, 1])], ["id", "text_sha256", "a", "b"])

    size = F.coalesce(F.octet_length(text_col), F.lit(0))  # lower-casing A-Z keeps it
    texts = documents.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"), size.alias("n"))
    kind = texts.schema["id"].dataType.simpleString()
    fp = (F.shiftleft(F.col("a"), 31) + F.col("b")).alias("fp")
    small = texts.where(F.col("n") <= HUGE).select("id", "h", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw"))
    small = small.mapInArrow(whole_texts, f"id {kind}, h long, text_sha256 string, n_bytes long, a long, b long").select("id", "n_bytes", fp, "text_sha256", "h")
    huge = texts.where(F.col("n") > HUGE).select("id", "h", "n", normalised("text").alias("raw")).withColumn("text_sha256", F.sha2("raw", 256))
    pieces = chunks(huge.withColumnRenamed("text_sha256", "sha"), "sha").groupBy("sha", "at").agg(F.min("chunk").alias("chunk"))
    hashed = pieces.select("at", "sha", "chunk").mapInArrow(fingerprint, "id int, text_sha256 string, a long, b long")
    ordered = hashed.groupBy("text_sha256").agg(F.reverse(F.array_sort(F.collect_list(F.struct("id", "a", "b")))).alias("parts"))

    def combined(part: str, prime: int) -> Column:
        shift = pow(BASE, COMPARED, prime)
        return F.aggregate("parts", F.lit(0).cast("long"), lambda acc, x: (x[part] + acc * shift) % prime).alias(part)

    whole = ordered.select("text_sha256", combined("a", PRIMES[0]), combined("b", PRIMES[1])).select("text_sha256", fp)
    return small.unionByName(huge.select("id", F.col("n").cast("long").alias("n_bytes"), "text_sha256", "h").join(whole, "text_sha256"))


def normalised(text_col: str) -> Column:
    return F.encode(F.coalesce(ascii_lower(F.col(text_col)), F.lit("")), "UTF-8")


def chunks(texts: DataFrame, *keys: str) -> DataFrame:
    """Rows (keys, at, chunk) of the column raw, COMPARED bytes each; one empty chunk if empty."""
    last = F.greatest(F.lit(0), F.floor((F.octet_length("raw") - 1) / COMPARED)).cast("int")
    pieces = texts.select(*keys, "raw", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    return pieces.select(*keys, "at", F.substring("raw", F.col("at") * COMPARED + 1, F.lit(COMPARED)).alias("chunk"))


def exact_dedup(documents: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Equal: the same after lower-casing A-Z; null counts as empty. The largest id of a
    group stays; null ids are the smallest. group_size counts rows. Rows that repeat
    the id that stays are that same document and are all marked kept. Empty table: no
    rows. Extra columns are ignored.

    Only small rows are shuffled for the grouping, and only texts that agree in length
    and fingerprint with others are compared: every such row, with or without id, with one
    text of its group, chunk by chunk, so a group of n copies costs n comparisons. That one
    text is small beside its copies, so Spark splits a large group over tasks.
    """
    # small rows that four steps read: written once, so texts are hashed once
    rows = materialize(with_fingerprints(documents, text_col, id_col))
    one = rows.groupBy("fp", "n_bytes").agg(F.min("text_sha256").alias("model"), F.count("*").alias("n")).where("n > 1").drop("n")
    # pre-aggregated: copies of a text are one row here
    members = materialize(rows.select("fp", "n_bytes", "text_sha256", "h").distinct().join(one, ["fp", "n_bytes"]).select("fp", F.col("text_sha256").alias("sha"), "model", "h"))
    few = broadcast_if(members.count() <= BROADCAST_ROWS)
    # texts that may be in a group are told by their hash, so the others aren't lower-cased, digested or moved
    texts = documents.select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h")).join(few(members.select("h").distinct()), "h", "left_semi")
    texts = materialize(texts.select(normalised("text").alias("raw")).withColumn("sha", F.sha2("raw", 256)))
    left = chunks(texts.join(members.select("fp", "sha", "model").distinct(), "sha"), "fp", "model")
    right = chunks(texts.join(one.select(F.col("model").alias("sha")).distinct(), "sha"), "sha").groupBy("sha", "at").agg(F.min("chunk").alias("other"))
    unequal = left.join(right, (F.col("model") == F.col("sha")) & (left.at == right.at)).where(~F.col("chunk").eqNullSafe(F.col("other"))).select("fp").distinct()
    # a fingerprint under which texts differ is refined by the digest of the whole text
    refined = rows.join(unequal.withColumn("clash", F.lit(True)), "fp", "left").withColumn("part", F.when(F.col("clash"), F.col("text_sha256")).otherwise(F.lit("")))
    final = refined.groupBy("fp", "n_bytes", "part").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    return refined.join(final, ["fp", "n_bytes", "part"]).select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_one(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """documents without the copies; columns stay, whatever their names. Rows that repeat an id and its text collapse to one."""
    groups = materialize(exact_dedup(documents, text_col, id_col).select(F.col(id_col).alias("id"), "kept", "text_sha256"))
    # ids of dropped rows and ids that repeat; all other rows stay as they are
    odd = materialize(groups.groupBy("id").agg(F.count("*").alias("times"), F.count_if("kept").alias("kept")).where("times > 1 or kept = 0"))
    once = without(documents, odd.select("id"), id_col)
    repeated = odd.where("kept > 0").select("id")
    if repeated.isEmpty():
        return once
    kept = without(groups.where("kept"), repeated, "id", "left_semi").select("id", "text_sha256").distinct()
    rows = without(documents, repeated, id_col, "left_semi").select(F.struct("*").alias("row"), F.col(id_col).alias("own_id"), F.sha2(normalised(text_col), 256).alias("sha"))
    rows = rows.join(kept, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("sha") == F.col("text_sha256"))).select("row", "own_id", "sha")
    return once.unionByName(rows.dropDuplicates(["own_id", "sha"]).select("row.*"))


ORACLE_SQL = """
with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, sha256(t) as text_sha256 from d join g using (t)
"""
