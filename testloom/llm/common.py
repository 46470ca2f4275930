"""Helpers shared by the training-data operators.

Hashing works on one byte buffer that holds a block of documents. Words are hashed
eight bytes at a time; the hash of k words in a row is built by doubling from the
hashes of 1, 2, 4, ... words, each pair of which is mixed without any algebra that
repetitive texts could cancel. So n-gram hashes of a block are plain numpy expressions
without a Python loop over words.
"""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a Python task.
BLOCK_BYTES = 1 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: White space of the word rule `[^\x20\x09-\x0D]+`.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, which all executors share.

    Where that is unset, a folder of this machine will only do if all tasks run in it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "testloom-checkpoints")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


#: Lets Spark drop a query's shuffle files when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Small rows that are broadcast, up to this many; beyond, Spark chooses the join.
BROADCAST_ROWS = 1_000_000


def broadcast_if(small: bool) -> Callable[[DataFrame], DataFrame]:
    return F.broadcast if small else lambda df: df


def without(documents: DataFrame, ids: DataFrame, id_col: str, how: str = "left_anti") -> DataFrame:
    """documents but those whose id (or null) is in the written table ids (id); columns stay, whatever their names.

    No text is shuffled while the counted ids are few. how: "left_semi" gives those documents instead.
    """
    few = broadcast_if(ids.count() <= BROADCAST_ROWS)
    return documents.alias("d").join(few(ids).alias("k"), F.col(f"d.{id_col}").eqNullSafe(F.col("k.id")), how)


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there.

    Later steps read the written table, so the shuffle files that made it are let go as
    soon as it is whole; while it is being written, lost ones are made again as usual.
    """
    spark = df.sparkSession
    path = shared_path(spark)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete tables that materialize wrote and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(c, UPPER, UPPER.lower())


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in text; null counts as no words."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def joined_words(text: Column) -> Column:
    """The words of text joined by one blank; null gives the empty string."""
    return F.coalesce(F.regexp_replace(F.regexp_replace(text, BLANKS, " "), "^ | $", ""), F.lit(""))


def text_key(text: Column) -> Column:
    """256-bit key of a text, for joins on whole texts without moving them."""
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


# --- hashing inside Python tasks -------------------------------------------------

_U = np.uint64
#: Odd multipliers of the two hashes; any would do.
_LEFT = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))
_RIGHT = (_U(0xD6E8FEB86659FD93), _U(0xFF51AFD7ED558CCD))
#: Words of more bytes are hashed one by one.
LONG_WORD = 512
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes, so that order and low bits look random."""
    x = x ^ (x >> _U(32))
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def chained(a: np.ndarray, b: np.ndarray, kind: int = 0) -> np.ndarray:
    """Hash of two strings in a row from their hashes; kind 0 and 1 are independent."""
    return mix(a * _LEFT[kind] + (b ^ (b >> _U(29))) * _RIGHT[kind] + _U(kind + 1))


def windows(items: np.ndarray, k: int, kind: int = 0, stride: int = 1) -> np.ndarray:
    """Hash of the k items from each item on, `stride` places apart, of hashes of items."""
    if len(items) <= (k - 1) * stride:
        return items[:0]
    out, have, step, size = None, 0, items, 1
    while True:
        if k & size:
            out = step if out is None else chained(out[: len(step) - have * stride], step[have * stride :], kind)
            have += size
        if have == k:
            return out
        step = chained(step[: -size * stride], step[size * stride :], kind)
        size *= 2


def eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as one number; zeros follow the last byte."""
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    return np.ndarray((len(buf),), "<u8", padded, strides=(1,)).astype(np.uint64)


def byte_hashes(buf: np.ndarray, length: int, kind: int = 0) -> np.ndarray:
    """Hash of the `length` bytes from each byte on."""
    if length < 8:
        return windows(mix(buf.astype(np.uint64) + _LEFT[kind]), length, kind)
    if len(buf) < length:
        return np.zeros(0, np.uint64)
    items = mix(eights(buf)[: len(buf) - 7] + _LEFT[kind])
    out = windows(items, length // 8, kind, 8)
    return chained(out[: len(buf) - length + 1], items[length - 8 :], kind) if length % 8 else out


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word buf[starts[i]:ends[i]]."""
    eight, sizes = eights(buf), ends - starts
    out = mix(sizes.astype(np.uint64) + _LEFT[0])
    at, active = 0, np.flatnonzero((sizes > 0) & (sizes <= LONG_WORD))
    while len(active):
        left = sizes[active] - at
        out[active] = chained(out[active], mix((eight[starts[active] + at] & _MASK[np.minimum(left, 8)]) + _RIGHT[1]))
        at += 8
        active = active[left > 8]
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def sliding(values: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over values[i:i+width] for every i with a whole window."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = op(out[:-step], out[step:]) if step < len(out) else out[:0]
        have += step
    return out


def blocks(rows: Iterator[tuple[int, bytes]], limit: int = BLOCK_BYTES) -> Iterator[list[tuple[int, bytes]]]:
    """Group (index, bytes) rows into lists of about `limit` bytes."""
    out: list[tuple[int, bytes]] = []
    size = 0
    for row in rows:
        if out and size + len(row[1]) > limit:
            yield out
            out, size = [], 0
        out.append(row)
        size += len(row[1])
    if out:
        yield out


class WordBlock:
    """Words `[^\\x20\\x09-\\x0D]+` of some documents in one buffer."""

    def __init__(self, docs: list[bytes]):
        self.buf = np.frombuffer(b" ".join(docs) + b" ", np.uint8)
        blank = SPACE[self.buf]
        before = np.concatenate(([True], blank[:-1]))
        self.starts, self.ends = np.flatnonzero(before & ~blank), np.flatnonzero(blank & ~before)
        offsets = np.cumsum([0, *(len(d) + 1 for d in docs)])
        #: first word of every document, and the number of all words
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = word_hashes(self.buf, self.starts, self.ends)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; those that leave a document are no use."""
        return windows(self.hashes, k)
