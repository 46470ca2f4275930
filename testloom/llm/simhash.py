"""SimHash near-duplicates with a hierarchical index in Gray order.

1. One pass over the texts gives each document's fingerprint; equal fingerprints are one
   class from there on.
2. The fingerprint's bits are cut into pieces. Two fingerprints that differ in d bits agree
   on all but d pieces, so each is listed once for every choice of pieces that must agree;
   more classes are cut into more pieces, so that lists keep their length.
3. Inside a list fingerprints are sorted by Gray rank, and groups of neighbours become nodes:
   a node holds the bits that all below it share (its mask) and their values. Its children
   share these and more, so going down a pair of nodes accumulates differences bit by bit; a
   pair that differs in more than d of the bits that both masks have is pruned with all
   that lies below it, and so is a pair whose fingerprints are connected already.
4. A task returns one edge for each fingerprint that it connects, never all pairs. A list
   that is too long for a task is cut; see _long_lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from testloom.llm.common import materialize
from testloom.llm.ngram_join import connected

SHINGLE = 4
DIFFERENCE = 4
BITS = 64
SEED = 42
#: Shingles hashed together.
BLOCK_SHINGLES = 1 << 15
#: Classes that share a list on average, from which on fingerprints are cut into more pieces.
LIST_MEAN = 64
#: Entries that share a task on average, and entries of one list that a task takes.
TASK_ENTRIES = 100_000
LIST_ENTRIES = 200_000
#: Fingerprints or nodes below a node, and pairs of nodes expanded together.
FANOUT = 8
STRIP = 1 << 13


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bits that more than half of the shingles' hashes have; no words: zero."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()  # of bytes: A-Z only
    words = raw.split()  # at 0x20 and 0x09 to 0x0D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n].tolist(), ends[-n:].tolist()
    digest, counts = xxhash.xxh64_digest, np.zeros(BITS, np.int64)
    for a in range(0, n, BLOCK_SHINGLES):
        hashes = b"".join([digest(joined[x:y], SEED) for x, y in zip(starts[a : a + BLOCK_SHINGLES], ends[a : a + BLOCK_SHINGLES], strict=True)])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    return run


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray sequence, where neighbours differ in one bit."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


class Index:
    """Nodes over fingerprints that are sorted by list and Gray rank, level by level from the leaves."""

    def __init__(self, lists: np.ndarray, fps: np.ndarray, side: np.ndarray):
        order = np.lexsort((gray_rank(fps), lists))
        self.order, self.side = order, side[order]
        fps = fps[order]
        sizes = np.diff(np.flatnonzero(np.diff(lists[order], prepend=-1, append=-1)))
        ones = np.zeros(len(fps), np.uint64)
        #: of each level: bits shared below, their values, and first node of each list
        self.mask, self.bits, self.first = [~ones], [fps], [np.concatenate(([0], np.cumsum(sizes)))]
        low, high = fps, fps
        #: of each level above the leaves: first child, and one past the last
        self.child, self.end = [None], [None]
        while (sizes > 1).any():
            above = -(-sizes // FANOUT)
            starts = np.repeat(self.first[-1][:-1], above) + FANOUT * (np.arange(above.sum()) - np.repeat(np.cumsum(above) - above, above))
            low, high = np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts)
            self.child.append(starts)
            self.end.append(np.append(starts[1:], len(self.mask[-1])))
            self.mask.append(~(low ^ high))
            self.bits.append(low)
            self.first.append(np.concatenate(([0], np.cumsum(above))))
            sizes = above
        self.root = np.arange(len(fps))

    def _connect(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up

    def _wholes(self) -> list[np.ndarray]:
        """The component of each node that lies in one component, else -1."""
        low = high = self.root
        out = [low]
        for starts in self.child[1:]:
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            out.append(np.where(low == high, low, -1))
        return out

    def _below(self, level: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of children of each pair of nodes, each once."""
        x = self.child[level][i][:, None] + np.arange(FANOUT)
        y = self.child[level][j][:, None] + np.arange(FANOUT)
        ok = (x < self.end[level][i][:, None])[:, :, None] & (y < self.end[level][j][:, None])[:, None]
        ok &= (i != j)[:, None, None] | (x[:, :, None] <= y[:, None])
        p, a, b = np.nonzero(ok)
        return x[p, a], y[p, b]

    def join(self, most: int) -> None:
        """Connect all fingerprints of a list, of both sides where it has two, that differ in `most` bits or fewer."""
        top = len(self.mask) - 1
        if not top:
            return
        # within the lowest nodes first: it makes many nodes whole
        leaves = np.arange(len(self.mask[1]))
        todo = [(1, leaves[a : a + STRIP], leaves[a : a + STRIP]) for a in range(0, len(leaves), STRIP)]
        whole, n_root = self._wholes(), len(self.root)
        roots = np.arange(len(self.mask[top]))
        todo = [(top, roots[a : a + STRIP], roots[a : a + STRIP]) for a in range(0, len(roots), STRIP)] + todo
        while todo:
            level, i, j = todo.pop()
            i, j = self._below(level, i, j)
            level -= 1
            if not level:
                inner = i != j
                i, j = i[inner], j[inner]
            both = self.mask[level][i] & self.mask[level][j]
            near = np.bitwise_count((self.bits[level][i] ^ self.bits[level][j]) & both) <= most
            near &= (whole[level][i] != whole[level][j]) | (whole[level][i] < 0)
            i, j = i[near], j[near]
            if not level:
                meet = (self.side[i] != self.side[j]) | (self.side[i] == ANY)
                self._connect(i[meet], j[meet])
                left = len(np.unique(self.root))
                if left < n_root:
                    whole, n_root = self._wholes(), left
            else:
                todo += [(level, i[a : a + STRIP], j[a : a + STRIP]) for a in range(0, len(i), STRIP)]


#: Side of an entry that meets all others of its part of a list.
ANY = 2


def _edges(most: int):
    """Edges (a, b) that connect what is near inside the lists of a task."""

    def run(_key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        fps = table.column("fp").to_numpy().view(np.uint64)
        _, lists = np.unique(np.column_stack([table.column(c).to_numpy() for c in ("choice", "agreed", "part")]), axis=0, return_inverse=True)
        index = Index(lists.ravel(), fps, table.column("side").to_numpy())
        index.join(most)
        own = fps[index.order]
        linked = np.flatnonzero(index.root != np.arange(len(own)))
        return pa.table({"a": own[linked].view(np.int64), "b": own[index.root[linked]].view(np.int64)})

    return run


def pieces(n_classes: int, most: int) -> int:
    """Number of pieces of which `most` may differ: the lists' mean length stays below LIST_MEAN."""
    p = most + 1
    while p < 2 * most and n_classes > LIST_MEAN * 2.0 ** (BITS * (p - most) / p):
        p += 1
    return p


def choices(n: int, most: int) -> list[int]:
    """Masks, as signed numbers, of the bits that must agree for each choice of pieces."""
    cuts = np.array_split(np.arange(BITS), n)
    masks = [sum(1 << int(b) for k in chosen for b in cuts[k]) for chosen in combinations(range(n), n - most)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def _joined(entries: DataFrame, n_entries: int, most: int) -> DataFrame:
    """Edges of entries (fp, choice, agreed, part, side)."""
    bucket = F.pmod(F.xxhash64("choice", "agreed", "part"), F.lit(max(8, n_entries // TASK_ENTRIES)))
    return entries.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(_edges(most), "a long, b long")


def _long_lists(entries: DataFrame, long: DataFrame, most: int) -> DataFrame:
    """Edges of lists that are too long for a task.

    First a list is dealt over parts by chance, which connects most of what is near. Its
    largest group needs no more comparison with itself; the rest of the list, in parts,
    meets itself and, part by part, the largest group. So every pair that isn't connected
    yet meets once.
    """
    ours = materialize(entries.join(long, ["choice", "agreed"]))
    dealt = ours.withColumn("part", F.pmod(F.xxhash64("fp"), F.ceil(F.col("d") / LIST_ENTRIES))).withColumn("side", F.lit(ANY))
    n = ours.count()
    near = materialize(_joined(dealt, n, most))
    groups = connected(near)
    named = materialize(ours.join(groups, ours.fp == groups.node, "left").select("fp", "choice", "agreed", "d", F.coalesce("root", "fp").alias("grp")))
    sizes = named.groupBy("choice", "agreed", "grp").agg(F.count("*").alias("c")).groupBy("choice", "agreed").agg(F.max(F.struct("c", "grp")).alias("top"))
    cut = named.join(sizes, ["choice", "agreed"]).withColumn("in_mass", F.col("grp") == F.col("top.grp"))
    half = max(1, LIST_ENTRIES // 2)
    n_mass, n_rest = F.ceil(F.col("top.c") / half), F.ceil((F.col("d") - F.col("top.c")) / half)
    k = F.pmod(F.xxhash64("fp"), F.when(F.col("in_mass"), n_mass).otherwise(n_rest))

    def place(kind: int, low: Column, high: Column, side: Column) -> Column:
        return F.struct((F.lit(kind << 50) + F.shiftleft(low, 25) + high).alias("part"), side.alias("side"))

    def up_to(n: Column) -> Column:
        return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))

    among = F.transform(up_to(n_rest), lambda j: place(1, F.least(k, j), F.greatest(k, j), F.when(j == k, ANY).otherwise((k > j).cast("int"))))
    across = F.transform(up_to(n_mass), lambda j: place(2, k, j, F.lit(0)))
    places = F.when(F.col("in_mass"), F.transform(up_to(n_rest), lambda j: place(2, j, k, F.lit(1)))).otherwise(F.concat(among, across))
    rest = cut.withColumn("x", F.explode(places)).select("fp", "choice", "agreed", F.col("x.part").alias("part"), F.col("x.side").alias("side"))
    return near.union(_joined(rest, n, most))


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, difference: int = DIFFERENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id, n_same (documents of that fingerprint).

    A-Z are lower-cased; shingles of `shingle` words, repeats included, are hashed by XXH64
    with seed 42; fewer words are one shingle, no words (null, empty, blank) give zero, which
    is linked like any other. Documents link at `difference` or fewer differing bits;
    component_id is the smallest id reachable, the document's own included; rows without id
    take part and get their component's smallest id, null if there is none. Rows that repeat
    an id are documents of their own. Only the two named columns are read; an empty table
    gives no rows.
    """
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    docs = materialize(rows.mapInArrow(_fingerprints(shingle), f"id {kind}, fp long"))
    classes = materialize(docs.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n_same")))
    n = classes.count()
    masks = choices(pieces(n, difference), difference)
    lists = F.explode(F.array(*(F.struct(F.lit(c).cast("long").alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("agreed")) for c, m in enumerate(masks))))
    entries = classes.select("fp", lists.alias("x")).select("fp", "x.choice", "x.agreed")
    plain = {"part": F.lit(0).cast("long"), "side": F.lit(ANY)}
    if n <= LIST_ENTRIES:
        edges = _joined(entries.withColumns(plain), n * len(masks), difference)
    else:
        lengths = materialize(entries.groupBy("choice", "agreed").agg(F.count("*").alias("d")).where(f"d > {LIST_ENTRIES}"))
        edges = _joined(entries.join(lengths, ["choice", "agreed"], "left_anti").withColumns(plain), n * len(masks), difference)
        if not lengths.isEmpty():
            edges = edges.union(_long_lists(entries, lengths, difference))
    groups = connected(edges)
    named = classes.join(groups, classes.fp == groups.node, "left").select("fp", "least", "n_same", F.coalesce("root", "fp").alias("grp"))
    smallest = named.groupBy("grp").agg(F.min("least").alias("component_id"))
    final = named.join(smallest, "grp").select("fp", "component_id", "n_same")
    return docs.join(final, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_same")


def keep_one(documents: DataFrame, shingle: int = SHINGLE, difference: int = DIFFERENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """documents with the rows of one id of each group, the smallest; columns stay."""
    groups = near_duplicates(documents, shingle, difference, id_col, text_col)
    kept = groups.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col)).distinct()
    return documents.alias("d").join(kept.alias("k"), F.col(f"d.{id_col}").eqNullSafe(F.col(f"k.{id_col}")), "left_semi")
