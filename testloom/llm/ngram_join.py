"""N-gram Jaccard join with set relations.

Exact self-join of shingle sets under a Jaccard threshold, as connected groups.

1. Equal sets become one class. Only classes go on.
2. Shingles are ordered rare first by their document frequency over all documents. By the
   prefix filter two similar sets share a shingle among the first n - ceil(t * n) + 1 of
   either; shingles of one class only can't be shared, so few sets have any entry in the
   index, and shared boilerplate comes last in the order.
3. Index lists are cut into blocks by set size; a set meets only its own block and the
   next. Inside a block pairs are skipped by size, by the positions of the shared shingle,
   which bound the intersection, and by sketches, which bound the difference.
4. Answers are derived from similar sets: every entry of a list is first checked against the
   two entries before it that its sketch is nearest to. Groups found so far are merged;
   later pairs inside a group are never looked at, and for pairs between groups the
   intersection of their leaders, corrected by the known differences to the leaders,
   accepts or rejects most without another look at the sets. Only the rest is intersected.

No pair inside a group of near copies has to be enumerated once the group is connected. A
list of more than LIST_ENTRIES is dealt over tasks: for the first look by chance, twice;
then pairs of parts of the list meet, without those inside its largest group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from testloom.llm.common import BROADCAST_ROWS, WordBlock, blocks, broadcast_if, materialize, release, windows, without

SHINGLE = 4
THRESHOLD = 85  # per cent
#: Shingles that share one bucket of the frequency count, on average.
BUCKET_SHINGLES = 1 << 19
#: Shingles that are dealt to the buckets at once, a chunk; the rows grow with buckets times
#: these. Sets of a chunk: their numbers take two bytes.
POSTED = 1 << 20
CHUNK_SETS = 1 << 16
#: Bits of a set's sketch, partners each entry of a list is first checked against, and pairs
#: of a list that are looked at together.
SKETCH_BITS = 512
NEAREST = 2
STRIP_PAIRS = 1 << 18
#: Index entries that share one bucket of lists, on average.
BUCKET_ENTRIES = 20_000
#: Entries of a list that one task pairs; a longer list is dealt over several.
LIST_ENTRIES = 10_000
#: A shingle in this share of all documents, or more, is common: at most (mean set size /
#: COMMON_SHARE) shingles are, so the list of common ones is broadcast.
COMMON_SHARE = 0.005
COMMON_LEAST = 50
COMMON_DF = 2**31 - 1
#: Columns of the row that tells of its chunk, null in the others.
CHUNK = "sigs binary, sizes binary, total long"


def _least_overlap(n, m, t):
    """Shared shingles that sets of n and m need for 100 * intersection >= t * union."""
    return -((-t * (n + m)) // (100 + t))


def prefix_size(n, t):
    return n + ((-t * n) // 100) + 1


class Sets:
    """Sorted shingle hashes of a block of texts; a short text is one shingle."""

    def __init__(self, texts: list[bytes], shingle: int):
        self.sets = [np.zeros(0, np.uint64)] * len(texts)
        w = WordBlock([t.lower() for t in texts])
        grams = w.grams(shingle)
        for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
            if b - a >= shingle:
                self.sets[i] = np.unique(grams[a : b - shingle + 1])
            elif a < b:
                self.sets[i] = windows(w.hashes[a:b], b - a, 1)


def codes(values: np.ndarray) -> np.ndarray:
    """48 bits of shingle hashes: enough for the index, whose candidates are verified on whole sets."""
    return values >> np.uint64(16)


def packed(values: np.ndarray) -> bytes:
    """48-bit codes in six bytes each."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def signature(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _each(batch: pa.RecordBatch, column: int, shingle: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    for block in blocks((i, x.as_py() or b"") for i, x in enumerate(batch.column(column))):
        yield [i for i, _ in block], Sets([t for _, t in block], shingle).sets


def _classes(shingle: int):
    """A row per document (id, n, sig), and rows (shingle, count) that are frequent in a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, sets in _each(batch, 1, shingle):
                sigs = [signature(s) for s in sets]
                own = {g: s for g, s in zip(sigs, sets, strict=True)}
                values, counts = np.unique(codes(np.concatenate(list(own.values()))), return_counts=True)
                common = counts >= max(2, COMMON_SHARE * len(own))
                v, c = values[common].view(np.int64), counts[common].astype(np.int64)
                k, m = len(rows), len(v)
                ids = pa.concat_arrays([batch.column(0).take(pa.array(rows)), pa.nulls(m, batch.column(0).type)])
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([len(s) for s in sets] + [None] * m, pa.int64()), pa.array(sigs + [None] * m, pa.binary()), pa.array(np.concatenate((np.zeros(k, np.int64), v))), pa.array(np.concatenate((np.zeros(k, np.int64), c)))],
                    ["id", "n", "sig", "shingle", "times"],
                )

    return run


def _gathered(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[dict[bytes, np.ndarray]]:
    """Different sets by signature, in chunks of as many blocks as hold POSTED shingles: their rows are one a bucket."""
    own, size = {}, 0
    for batch in batches:
        for _, sets in _each(batch, 0, shingle):
            for s in sets:
                if len(s) and own.setdefault(signature(s), s) is s:
                    size += len(s)
                    if len(own) == CHUNK_SETS:
                        yield own
                        own, size = {}, 0
            if size >= POSTED:
                yield own
                own, size = {}, 0
    yield own


def _postings(shingle: int, n_buckets: int, common):
    """Codes of every class's shingles by bucket, packed: of each its set's number in the chunk.

    Two bytes name a set, however few of its shingles a bucket gets. The signatures and sizes
    of a chunk's sets, and the number of its shingles, go with one of its rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare_last = common.value
        for own in _gathered(batches, shingle):
            if own:
                sigs, sizes = b"".join(own), np.fromiter(map(len, own.values()), np.uint32, len(own))
                chunk = int.from_bytes(hashlib.blake2b(sigs, digest_size=8).digest(), "little", signed=True)
                values = codes(np.concatenate(list(own.values())))
                own.clear()
                part = (values % np.uint64(n_buckets)).astype(np.min_scalar_type(n_buckets))
                if len(rare_last):  # common shingles only pass through, in one row
                    part[rare_last[np.minimum(np.searchsorted(rare_last, values), len(rare_last) - 1)] == values] = n_buckets
                order = np.argsort(part, kind="stable")
                values, part = values[order], part[order]
                owner = np.repeat(np.arange(len(sizes), dtype="<u2"), sizes)[order]
                cuts = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)])).tolist()
                buckets = part[cuts[:-1]].astype(np.int64)
                named = chunk % len(buckets)
                names = [None] * len(buckets)
                columns = [
                    pa.array(np.where(buckets < n_buckets, buckets, chunk % n_buckets)), pa.array(np.full(len(buckets), chunk)), pa.array(buckets == n_buckets),
                    *(pa.array([f(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()) for f in (lambda a, b: packed(values[a:b]), lambda a, b: owner[a:b].tobytes())),
                    *(pa.array([*names[:named], x, *names[named + 1 :]], kind) for x, kind in ((sigs, pa.binary()), (sizes.astype("<u4").tobytes(), pa.binary()), (len(values), pa.int64()))),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "chunk", "common", "shingles", "owners", "sigs", "sizes", "total"])

    return run


def _flat(column: pa.ChunkedArray) -> tuple[bytes, np.ndarray]:
    """All binary values of a column in a row, and the bytes of each."""
    return b"".join(x.as_py() or b"" for x in column), np.array([len(x.as_py() or b"") for x in column], np.int64)


def _frequencies(_key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The rows of a bucket with those shingles only that two sets share, their df, and how many there were."""
    data, lengths = _flat(table.column("shingles"))
    values, seen = unpacked(data), lengths // 6
    owners = np.frombuffer(_flat(table.column("owners"))[0], "<u2")
    row = np.repeat(np.arange(len(seen), dtype=np.int32), seen)
    common = table.column("common").to_numpy()
    df = np.full(len(values), COMMON_DF, np.int32)
    at = np.flatnonzero(~common[row])
    at = at[np.argsort(values[at], kind="stable")]
    # one row a chunk by now, its sets in order: a code that a set has twice stands in a row
    again = np.zeros(len(at), bool)
    again[1:] = (values[at][1:] == values[at][:-1]) & (owners[at][1:] == owners[at][:-1]) & (row[at][1:] == row[at][:-1])
    df[at[again]] = 0
    at = at[~again]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(at)), bool), values[at][1:] != values[at][:-1])))
    times = np.diff(np.append(first, len(at)))
    df[at] = np.repeat(times, times)
    keep = df > 1
    ends = np.concatenate(([0], np.cumsum(np.bincount(row[keep], minlength=len(seen))))).tolist()
    values, owners, df = values[keep], owners[keep], df[keep]
    columns = {k: pa.array([f(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()) for k, f in (("shingles", lambda a, b: packed(values[a:b])), ("owners", lambda a, b: owners[a:b].tobytes()), ("dfs", lambda a, b: df[a:b].astype("<i4").tobytes()))}
    return pa.table({"chunk": table.column("chunk"), **columns, "seen": pa.array(seen), **{k: table.column(k) for k in ("sigs", "sizes", "total")}})


def _prefixes(t: int):
    """(sig, n, shingle, at) of a chunk's sets: the first shared shingles of each, rare ones first."""

    def run(_key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = sum(x or 0 for x in table.column("total").to_pylist())
        if total != sum(table.column("seen").to_pylist()):
            raise ValueError("rows of a chunk are missing: documents came in another order when a task ran again")
        names = table.column("sigs").drop_null()[0].as_py()
        sizes = np.frombuffer(table.column("sizes").drop_null()[0].as_py(), "<u4").astype(np.int64)
        values, owners, df = unpacked(_flat(table.column("shingles"))[0]).view(np.int64), np.frombuffer(_flat(table.column("owners"))[0], "<u2"), np.frombuffer(_flat(table.column("dfs"))[0], "<i4")
        order = np.lexsort((values, df, owners))
        values, owners = values[order], owners[order].astype(np.int64)
        if len(values):  # equal chunks stand here together
            once = np.concatenate(([True], (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])))
            values, owners = values[once], owners[once]
        shared = np.bincount(owners, minlength=len(sizes))
        alone = sizes - shared
        pos = np.arange(len(owners)) - np.repeat(np.cumsum(shared) - shared, shared)
        # one entry more than the prefix filter asks for: two shingles of a set may share a code
        keep = pos < (prefix_size(sizes, t) + 1 - alone)[owners]
        owners = owners[keep]
        sigs = np.frombuffer(names, np.uint8).reshape(-1, 16)[owners]
        flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(owners), [None, pa.py_buffer(np.ascontiguousarray(sigs).tobytes())])
        return pa.table({"sig": flat.cast(pa.binary()), "n": sizes[owners], "shingle": values[keep], "at": alone[owners] + pos[keep]})

    return run


def size_block(n: np.ndarray, t: int) -> np.ndarray:
    """Number of the block of set sizes: similar sets lie in the same block or the next."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(100 / t) + 1e-9).astype(np.int64)


def parity(values: np.ndarray) -> bytes:
    """SKETCH_BITS parities of a set: two sets differ in at least as many shingles as bits."""
    return np.packbits((np.bincount((values % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1).astype(bool)).tobytes()


#: Side of an entry that meets all others of its part of a list.
ANY = 2


def list_pairs(n: np.ndarray, at: np.ndarray, group: np.ndarray, home: np.ndarray, bits: np.ndarray, side: np.ndarray, t: int, nearest: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of one block of one index list, as two index arrays.

    Pairs of different groups that neither size, position nor sketch excludes; with `nearest`,
    of each entry only those with the entries before it that differ least by the sketch.
    home: whether an entry belongs to this block or visits from the one below. side: 0 or 1
    where only pairs of both sides are asked for, else ANY. Entries are
    in order of size, and rows of the pair matrix are made a strip at a time.
    """
    order = np.lexsort((at, n))
    n, at, group, home, bits, side = n[order], at[order], group[order], home[order], bits[order], side[order]
    left, right = [order[:0]], [order[:0]]
    strip = max(1, STRIP_PAIRS // len(n))
    for a in range(0, len(n), strip):
        j = np.arange(a, min(len(n), a + strip))
        low = int(np.searchsorted(n, -((-t * n[a]) // 100)))  # sets below are too small for all of the strip
        i = np.arange(low, j[-1] + 1)
        need = _least_overlap(n[i][None], n[j][:, None], t)
        # the intersection is at most the shared shingle and what follows it in either set
        ok = np.minimum((n[i] - at[i])[None], (n[j] - at[j])[:, None]) >= need
        ok &= (i[None] < j[:, None]) & (home[i][None] | home[j][:, None]) & (group[i][None] != group[j][:, None])
        ok &= (side[i][None] != side[j][:, None]) | (side[j] == ANY)[:, None]
        y, x = np.nonzero(ok)
        differ = np.bitwise_count(bits[i[x]] ^ bits[j[y]]).sum(1, dtype=np.int64)
        close = differ <= n[i[x]] + n[j[y]] - 2 * need[y, x]
        x, y, differ = x[close], y[close], differ[close]
        if nearest and len(x):
            by = np.lexsort((differ, y))
            x, y = x[by], y[by]
            first = np.concatenate(([True], y[1:] != y[:-1]))
            rank = np.arange(len(y)) - np.maximum.accumulate(np.where(first, np.arange(len(y)), 0))
            x, y = x[rank < nearest], y[rank < nearest]
        left.append(i[x])
        right.append(j[y])
    return order[np.concatenate(left)], order[np.concatenate(right)]


def _candidates(t: int, nearest: int):
    """Pairs of all blocks in one bucket of the index, each pair once."""

    def run(_key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        n, at, home = table.column("n").to_numpy(), table.column("at").to_numpy(), table.column("home").to_numpy(zero_copy_only=False)
        sigs = table.column("sig").combine_chunks().dictionary_encode()
        who, names = sigs.indices.to_numpy(zero_copy_only=False).astype(np.int64), sigs.dictionary
        group = table.column("grp").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(len(n), -1)
        side = table.column("side").to_numpy()
        _, key = np.unique(np.column_stack([table.column(c).to_numpy() for c in ("shingle", "block", "part")]), axis=0, return_inverse=True)
        order = np.argsort(key, kind="stable")
        ends = np.flatnonzero(np.diff(key[order], append=-1)) + 1
        found = []
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            part = order[a:b]
            if b - a > 1 and (group[part] != group[part[0]]).any():
                x, y = list_pairs(n[part], at[part], group[part], home[part], bits[part], side[part], t, nearest)
                found.append((part[x], part[y]))
        i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        pairs = np.unique(np.sort(np.column_stack((who[i], who[j])), axis=1), axis=0)
        a, b = names.take(pa.array(pairs[:, 0])), names.take(pa.array(pairs[:, 1]))
        less = pa.compute.less(a, b)
        return pa.table({"a": pa.compute.if_else(less, a, b), "b": pa.compute.if_else(less, b, a)})

    return run


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of the graph of edges (a, b); root is the smallest node of the component.

    Large-star and small-star rounds in turn: each hangs nodes on smaller neighbours, keeps
    at most one edge a node and neighbour, and needs rounds in the logarithm of the longest
    path. Every round is written to the shared folder.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    trace = _trace(edges)
    while True:
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lower).where("u != v").distinct()
        new = materialize(small)
        release(edges)
        edges, last, trace = new, trace, _trace(new)
        if trace == last:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _trace(edges: DataFrame) -> Row:
    """Number of edges and sums of two hashes of them: tells whether a round changed anything."""
    return edges.agg(F.count("*"), *(F.sum(F.xxhash64(*c).cast("decimal(38,0)")) for c in (("u", "v"), ("v", "u")))).first()


def jaccard_groups(documents: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id, sig.

    Sets: distinct shingles of `shingle` words after lower-casing A-Z; fewer words are one
    shingle; no word (or null) is the empty set, linked with nothing. Documents link when
    100 * intersection >= threshold * union; component_id is the smallest id reachable, the
    document's own included. Equal sets are linked. Rows without id take part and get the
    smallest id of their component, null if there is none. Rows that repeat an id are nodes
    of their own. Extra columns are ignored, an empty table gives no rows.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(id_col).alias("id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("raw"))
    kind = rows.schema["id"].dataType.simpleString()
    scan = materialize(rows.mapInArrow(_classes(shingle), f"id {kind}, n long, sig binary, shingle long, times long"))
    docs = scan.where("sig is not null").select("id", "n", "sig")
    n_docs = docs.count()
    often = scan.where("sig is null").groupBy("shingle").agg(F.sum("times").alias("times")).where(F.col("times") >= max(COMMON_LEAST, COMMON_SHARE * n_docs))
    common = spark.sparkContext.broadcast(np.sort(np.array([r.shingle for r in often.select("shingle").collect()], np.int64).view(np.uint64)))
    classes = docs.groupBy("sig").agg(F.min("id").alias("least"), F.first("n").alias("n"))
    n_buckets = max(8, (classes.agg(F.sum("n")).first()[0] or 0) // BUCKET_SHINGLES)
    # another row of a class only makes its shingles look shared, so copies may stay where they are too many to be sent
    copies = docs.join(classes.select("sig", "least"), "sig").groupBy("id").agg(F.max(F.col("id").eqNullSafe(F.col("least"))).alias("kept")).where("not kept and id is not null").select("id")
    copies = materialize(copies)
    few = copies.count() <= BROADCAST_ROWS
    posted = rows.join(F.broadcast(copies), "id", "left_anti") if few else rows
    dealt = posted.select("raw").mapInArrow(_postings(shingle, n_buckets, common), f"bucket long, chunk long, common boolean, shingles binary, owners binary, {CHUNK}")
    shared = dealt.groupBy("bucket").applyInArrow(_frequencies, f"chunk long, shingles binary, owners binary, dfs binary, seen long, {CHUNK}")
    entries = shared.groupBy("chunk").applyInArrow(_prefixes(threshold), "sig binary, n long, shingle long, at long")
    index = materialize(entries if few else entries.dropDuplicates(["sig", "shingle"]))
    alive = index.groupBy("shingle").agg(F.count("*").alias("d")).where("d > 1").select("shingle")
    every, index = index, materialize(index.join(alive, "shingle"))
    release(every)
    sets = _survivors(rows, docs, index.select("sig").distinct(), shingle, kind)

    n_lists = max(8, index.count() // BUCKET_ENTRIES)
    index = index.join(sets.select("sig", "bits"), "sig")
    pairs = _pairs(index.withColumn("grp", F.col("sig")), threshold, NEAREST, n_lists)
    first = materialize(_measured(pairs, sets))
    linked = materialize(_linked(first, threshold))
    groups = connected(linked)
    # what the leaders leave: pairs between different groups
    named = index.join(groups, index.sig == groups.node, "left").withColumn("grp", F.coalesce("root", "sig")).drop("node", "root")
    rest = materialize(_pairs(named, threshold, 0, n_lists).join(first.select("a", "b"), ["a", "b"], "left_anti"))
    leaders = _leaders(linked)
    later = _derived(rest, leaders, sets, threshold)
    groups = connected(linked.select("a", "b").union(later))
    named = classes.join(groups, classes.sig == groups.node, "left").select("sig", "least", F.coalesce("root", "sig").alias("grp"))
    smallest = named.groupBy("grp").agg(F.min("least").alias("component_id"))
    final = named.join(smallest, "grp").select("sig", "component_id")
    # the empty set is one class but links with nothing
    return docs.join(final, "sig", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), "sig")


def _survivors(rows: DataFrame, docs: DataFrame, sigs: DataFrame, shingle: int, kind: str) -> DataFrame:
    """(sig, n, shingles, bits) of the classes in the index, from one document of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, sets in _each(batch, 0, shingle):
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(at)), pa.array([signature(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([parity(s) for s in sets], pa.binary())], ["want", "sig", "n", "shingles", "bits"])

    one = materialize(docs.join(sigs, "sig").groupBy("sig").agg(F.min("id").alias("id")))
    few = broadcast_if(one.count() <= BROADCAST_ROWS)  # no text is shuffled then
    found = rows.join(few(one), "id").select("raw", F.col("sig").alias("want"))
    nameless = docs.join(sigs, "sig").groupBy("sig").agg(F.max("id").alias("id")).where("id is null").select(F.col("sig").alias("want"))
    if not nameless.isEmpty():  # classes whose rows all lack an id: found by their set
        every = rows.where("id is null").select("raw", F.lit(None).cast("binary").alias("want")).mapInArrow(run, "want binary, sig binary, n long, shingles array<long>, bits binary")
        extra = every.join(nameless.withColumnRenamed("want", "sig"), "sig").select("sig", "n", "shingles", "bits")
        own = found.mapInArrow(run, "want binary, sig binary, n long, shingles array<long>, bits binary").where("want = sig").select("sig", "n", "shingles", "bits")
        return materialize(own.union(extra).dropDuplicates(["sig"]))
    return materialize(found.mapInArrow(run, "want binary, sig binary, n long, shingles array<long>, bits binary").where("want = sig").select("sig", "n", "shingles", "bits").dropDuplicates(["sig"]))


def _pairs(index: DataFrame, t: int, nearest: int, n_buckets: int) -> DataFrame:
    """Candidate pairs (a, b) of an index (sig, n, shingle, at, grp, bits)."""
    block = F.expr(f"cast(floor(ln(greatest(n, 1)) / ln(100.0D / {t}) + 1e-9) as long)")
    cut = index.withColumn("block", block)
    cut = cut.withColumn("home", F.lit(True)).union(cut.withColumn("block", F.col("block") + 1).withColumn("home", F.lit(False)))
    # a list of one entry or group has nothing to find, a list without a home entry neither
    open_ = cut.groupBy("shingle", "block").agg(F.min("grp").alias("g0"), F.max("grp").alias("g1"), F.max("home").alias("own"), F.count("*").alias("d")).where("g0 != g1 and own")
    open_ = materialize(open_.select("shingle", "block", "d"))
    whole = cut.join(open_.where(F.col("d") <= LIST_ENTRIES).drop("d"), ["shingle", "block"])
    whole = whole.withColumn("part", F.lit(0).cast("long")).withColumn("side", F.lit(ANY)).withColumn("bucket", F.pmod(F.xxhash64("shingle", "block"), F.lit(n_buckets)))
    long = open_.where(F.col("d") > LIST_ENTRIES)
    if not long.isEmpty():
        dealt = (_by_chance if nearest else _by_parts)(cut, long).select(*cut.columns, "part", "side")
        whole = whole.unionByName(dealt.withColumn("bucket", F.xxhash64("shingle", "block", "part")))
    cut = whole
    return cut.groupBy("bucket").applyInArrow(_candidates(t, nearest), "a binary, b binary").distinct()


def _by_chance(cut: DataFrame, long: DataFrame) -> DataFrame:
    """Entries of long lists, each dealt by chance to two parts of its list."""
    dealt = cut.join(F.broadcast(long), ["shingle", "block"]).withColumn("round", F.explode(F.array(F.lit(1), F.lit(2))))
    part = F.pmod(F.xxhash64("sig", "shingle", "round"), F.ceil(F.col("d") / LIST_ENTRIES))
    return dealt.withColumn("part", F.shiftleft(F.col("round").cast("long"), 40) + part).withColumn("side", F.lit(ANY))


def _by_parts(cut: DataFrame, long: DataFrame) -> DataFrame:
    """Entries of long lists, dealt so that any two meet in one part if they aren't both of the list's largest group.

    The largest group of a list and the rest of it are cut separately; every part of the
    rest meets every other and itself, and every part of the largest group.
    """
    ours = cut.join(F.broadcast(long), ["shingle", "block"])
    groups = ours.groupBy("shingle", "block", "grp").agg(F.count("*").alias("c"))
    sizes = groups.groupBy("shingle", "block").agg(F.max(F.struct("c", "grp")).alias("top"), F.sum("c").alias("d"))
    sizes = materialize(sizes.select("shingle", "block", F.col("top.grp").alias("mass"), F.ceil(F.col("top.c") / LIST_ENTRIES).alias("n_mass"), F.ceil((F.col("d") - F.col("top.c")) / LIST_ENTRIES).alias("n_rest")))
    ours = cut.join(F.broadcast(sizes), ["shingle", "block"]).withColumn("in_mass", F.col("grp") == F.col("mass"))
    ours = ours.withColumn("k", F.pmod(F.xxhash64("sig", "shingle"), F.when(F.col("in_mass"), F.col("n_mass")).otherwise(F.col("n_rest"))))
    k = F.col("k")

    def place(kind: int, low: Column, high: Column, side: Column) -> Column:
        return F.struct((F.lit(kind << 50) + F.shiftleft(low, 25) + high).alias("part"), side.alias("side"))

    rest, mass = F.sequence(F.lit(0).cast("long"), F.col("n_rest") - 1), F.sequence(F.lit(0).cast("long"), F.col("n_mass") - 1)
    among = F.transform(rest, lambda j: place(1, F.least(k, j), F.greatest(k, j), F.when(j == k, ANY).otherwise((k > j).cast("int"))))
    across = F.transform(mass, lambda j: place(2, k, j, F.lit(0)))
    places = F.when(F.col("in_mass"), F.transform(rest, lambda j: place(2, j, k, F.lit(1)))).otherwise(F.concat(among, across))
    return ours.withColumn("x", F.explode(places)).withColumns({"part": F.col("x.part"), "side": F.col("x.side")})


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, n, m, both): set sizes and intersection of each pair."""
    x = sets.select(F.col("sig").alias("a"), F.col("n"), F.col("shingles").alias("x"))
    y = sets.select(F.col("sig").alias("b"), F.col("n").alias("m"), F.col("shingles").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "n", "m", F.size(F.array_intersect("x", "y")).cast("long").alias("both"))


def _linked(measured: DataFrame, t: int) -> DataFrame:
    return measured.where(100 * F.col("both") >= t * (F.col("n") + F.col("m") - F.col("both"))).select("a", "b", "n", "m", "both")


def _leaders(linked: DataFrame) -> DataFrame:
    """(sig, leader, lost, gained): for linked sets the partner they share most with."""
    ends = linked.select(F.col("b").alias("sig"), F.col("a").alias("leader"), (F.col("m") - F.col("both")).alias("gained"), (F.col("n") - F.col("both")).alias("lost"))
    return ends.groupBy("sig").agg(F.min(F.struct("leader", "lost", "gained")).alias("x")).select("sig", "x.*")


def _derived(rest: DataFrame, leaders: DataFrame, sets: DataFrame, t: int) -> DataFrame:
    """Linked pairs of rest, by the leaders' intersections where these decide."""
    sizes = sets.select("sig", "n")
    own = sizes.join(leaders, "sig", "left").select("sig", "n", F.coalesce("leader", "sig").alias("leader"), F.coalesce("lost", F.lit(0)).alias("lost"), F.coalesce("gained", F.lit(0)).alias("gained"))
    p = rest.join(own.select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("leader").alias("la"), F.col("lost").alias("lost_a"), F.col("gained").alias("gained_a")), "a")
    p = p.join(own.select(F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("leader").alias("lb"), F.col("lost").alias("lost_b"), F.col("gained").alias("gained_b")), "b")
    p = p.withColumn("l1", F.least("la", "lb")).withColumn("l2", F.greatest("la", "lb"))
    between = _measured(p.select(F.col("l1").alias("a"), F.col("l2").alias("b")).distinct(), sets).select(F.col("a").alias("l1"), F.col("b").alias("l2"), "both")
    p = p.join(between, ["l1", "l2"])
    need = F.ceil(t * (F.col("na") + F.col("nb")) / (100.0 + t) - 1e-9)
    low = F.col("both") - F.col("lost_a") - F.col("lost_b")
    high = F.col("both") + F.col("gained_a") + F.col("gained_b")
    decided = materialize(p.where(high >= need).select("a", "b", (low >= need).alias("sure")))
    checked = _linked(_measured(decided.where("not sure").select("a", "b"), sets), t).select("a", "b")
    return decided.where("sure").select("a", "b").union(checked)


def keep_one(documents: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """documents with one row of each group, that of the smallest id; columns stay."""
    groups = jaccard_groups(documents, shingle, threshold, id_col, text_col)
    first = F.col(id_col).eqNullSafe(F.col("component_id"))
    dropped = groups.groupBy(F.col(id_col).alias("id")).agg(F.max(first).alias("kept")).where("not kept").select("id")
    return without(documents, materialize(dropped), id_col)


ORACLE_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
x as (select distinct doc_id, hash(array_to_string(w[i:i + 3], ' ')) as s from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from x group by doc_id),
r as (select s from x group by s having count(*) > 1),
y as (select doc_id, s from x join r using (s)),
p as (select a.doc_id as a, b.doc_id as b, count(*) as inter from y a join y b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * inter >= 85 * (na.n + nb.n - inter)),
e as (select a, b from l union all select b, a from l),
c(doc_id, other) as (select doc_id, doc_id from documents union select c.doc_id, e.b from c join e on c.other = e.a)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, m.component_id
from documents d left join n using (doc_id) join (select doc_id, min(other) as component_id from c group by doc_id) m using (doc_id)
"""
