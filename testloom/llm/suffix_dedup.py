"""Substring dedup over bytes with suffix arrays.

A string of 200 bytes that starts twice is removed at both places. Candidate search:
of any 200 bytes the least hash of its grams of 32 bytes is its anchor, so equal strings
have equal anchors and only stretches around an anchor that stands in two places can
repeat. These stretches are dealt out by anchor; equal ones are counted, and of the
different ones of a shard a suffix array is made by Larsson-Sadakane refinement. Kasai's
common prefixes of neighbours then tell which strings of 200 bytes start twice. A shard
larger than SHARD_BYTES is cut into several suffix arrays, which are merged by binary
search of each one's strings in the others. Stretches of an anchor with more bytes than
that are dealt over several tasks, whose strings are merged by a shuffle of their hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from testloom.llm.common import byte_hashes, eights, materialize, mix, sliding

LENGTH = 200
GRAM = 32
#: Bytes of stretches that share one suffix array.
SHARD_BYTES = 4 << 20
#: Stretches of a shard, on average; the number of shards follows the input.
SHARD_ROWS = 4000


# --- suffix arrays ---------------------------------------------------------------


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of data sorted by their first `depth` bytes or more, and the rank of each.

    Larsson-Sadakane: suffixes sorted by h bytes are sorted by 2h by the ranks h further
    on, and only groups that are still equal are sorted again.
    """
    n = len(data)
    padded = np.concatenate((data.astype(np.uint64) + np.uint64(1), np.zeros(7, np.uint64)))
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = key << np.uint64(9) | padded[k : k + n]
    order = np.argsort(key, kind="stable")
    new = np.concatenate(([True], key[order][1:] != key[order][:-1])) if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1] if n else 0
    h = 7
    while h < depth:
        edges = np.concatenate((new, [True]))
        open_ = np.flatnonzero(~(edges[:-1] & edges[1:]))
        if not len(open_):
            break
        at = order[open_]
        nxt = np.where(at + h < n, rank[np.minimum(at + h, n - 1)] + 1, 0)
        group = rank[at]
        by = np.lexsort((nxt, group))
        at, nxt, group = at[by], nxt[by], group[by]
        order[open_] = at
        fresh = np.concatenate(([True], (group[1:] != group[:-1]) | (nxt[1:] != nxt[:-1])))
        new[open_] = fresh
        rank[at] = open_[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        h *= 2
    return order, rank


def common_prefixes(data: np.ndarray, order: np.ndarray, rank: np.ndarray, limit: int) -> np.ndarray:
    """lcp[i]: bytes that suffixes order[i - 1] and order[i] have in common, up to `limit`.

    Kasai's bound, that going one byte on loses at most one common byte, holds for whole
    runs: where the pair (p - 1, q - 1) are neighbours too and begin with one byte, the
    prefix is one less than theirs. Only the heads of such runs are compared.
    """
    n = len(data)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    head = np.ones(n, bool)
    head[1:] = (before[1:] <= 0) | (before[:-1] < 0) | (before[:-1] + 1 != before[1:]) | (data[:-1] != data[before[:-1]])
    head &= before >= 0
    heads = np.flatnonzero(head)
    ends = np.append(heads[1:], n)
    reach = np.zeros(len(heads), np.int64)
    # how far the head's run is equal: compare the two stretches until they differ
    p, q = heads.copy(), before[heads].copy()
    room = np.minimum(n - p, n - q)
    most = np.minimum(room, ends - heads + limit)
    active = np.flatnonzero(most > 0)
    while len(active):
        at = reach[active]
        same = data[p[active] + at] == data[q[active] + at]
        reach[active] += same
        active = active[same & (reach[active] < most[active])]
    value = np.zeros(n, np.int64)
    owner = np.repeat(np.arange(len(heads)), ends - heads)
    inside = np.arange(n)[heads[0] :] if len(heads) else np.zeros(0, np.int64)
    value[inside] = np.maximum(0, reach[owner] - (inside - heads[owner]))
    lcp[rank_order(order)] = np.where(before >= 0, np.minimum(value, limit), 0)
    return lcp


def rank_order(order: np.ndarray) -> np.ndarray:
    """Place of every suffix in order."""
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def same_bytes(x: np.ndarray, at: np.ndarray, y: np.ndarray, there: np.ndarray, length: int) -> np.ndarray:
    """Whether `length` bytes of x and y from the given places on are the same."""
    same = np.ones(len(at), bool)
    if length < 8:
        for k in range(length):
            same &= x[at + k] == y[there + k]
        return same
    x8, y8 = eights(x), eights(y)
    for k in (*range(0, length - 8, 8), length - 8):
        same &= x8[at + k] == y8[there + k]
    return same


class Shard:
    """Suffix array of some stretches; each is ended by its number of rows, never matched."""

    def __init__(self, stretches: list[bytes], length: int):
        self.n_stretches = len(stretches)
        self.data = np.frombuffer(b"".join(stretches), np.uint8)
        sizes = np.fromiter(map(len, stretches), np.int64, len(stretches))
        ends = np.cumsum(sizes)
        self.owner = np.repeat(np.arange(len(stretches)), sizes)
        self.offset = np.arange(len(self.data)) - (ends - sizes)[self.owner]
        whole = ends[self.owner] - np.arange(len(self.data)) >= length
        order, rank = suffix_array(self.data, length)
        lcp = common_prefixes(self.data, order, rank, length)
        # groups of equal strings of `length` bytes, among suffixes that have as many in their stretch
        valid = whole[order]
        group = np.cumsum(lcp < length)
        at, group = order[valid], group[valid]
        _, self.group, sizes = np.unique(group, return_inverse=True, return_counts=True)
        self.at, self.repeated, self.length = at, sizes[self.group] > 1, length

    def keys(self, kind: int = 0) -> np.ndarray:
        """Hashes of the strings, in the order of the suffix array."""
        return byte_hashes(self.data, self.length, kind)[self.at]

    def meet(self, other: Shard) -> None:
        """Merge with another shard: mark strings that both hold, by binary search in sorted keys.

        A string counts as found only if its bytes are those of the string that was found.
        """
        keys = self.keys(), other.keys()
        if not len(keys[0]) or not len(keys[1]):
            return
        for a, own, b, theirs in ((self, keys[0], other, keys[1]), (other, keys[1], self, keys[0])):
            order = np.argsort(theirs)
            place = order[np.minimum(np.searchsorted(theirs, own, sorter=order), len(order) - 1)]
            hit = np.flatnonzero(theirs[place] == own)
            a.repeated[hit[same_bytes(a.data, a.at[hit], b.data, b.at[place[hit]], a.length)]] = True


def shards(stretches: list[bytes], length: int) -> list[Shard]:
    """Merged shards of SHARD_BYTES each, of the stretches in order."""
    lists: list[list[bytes]] = [[]]
    size = 0
    for s in stretches:
        if size + len(s) > SHARD_BYTES and lists[-1]:
            lists.append([])
            size = 0
        lists[-1].append(s)
        size += len(s)
    made = [Shard(x, length) for x in lists]
    for i, a in enumerate(made):
        for b in made[:i]:
            a.meet(b)
    return made


def repeats(stretches: list[bytes], length: int) -> list[np.ndarray]:
    """For every stretch, offsets at which a string starts that starts elsewhere too."""
    out: list[np.ndarray] = []
    for shard in shards(stretches, length):
        at = np.sort(shard.at[shard.repeated])
        cuts = np.searchsorted(shard.owner[at], np.arange(shard.n_stretches + 1))
        out += [shard.offset[at[a:b]] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return out


# --- candidates ------------------------------------------------------------------


def _anchors(buf: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each gram, least hash of each string, whether each gram is an anchor)."""
    n, width = len(buf), length - gram + 1
    eight = eights(buf)[: n - 7]  # a gram has eight bytes or more; its hash only chooses the anchor
    h = eight[: n - gram + 1]
    for k in (*range(8, gram - 8, 8), gram - 8) if gram > 8 else ():
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + eight[k : k + n - gram + 1]
    h = mix(h)
    least = sliding(h, width, np.minimum)
    padded = np.concatenate((np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)))
    return h, least, sliding(padded, width, np.maximum) == h


def _scan(length: int, gram: int):
    """Key, size and anchors of every text, with the times each stands in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, np.int64), np.zeros(0, np.int32))
        for batch in batches:
            keys, sizes, anchors, times = [], [], [], []
            for x in batch.column(2):
                raw = x.as_py() or b""
                v, n = none
                if len(raw) >= length:
                    h, _, chosen = _anchors(np.frombuffer(raw, np.uint8), length, gram)
                    v, n = np.unique(h[chosen], return_counts=True)
                keys.append(hashlib.sha256(raw).digest())
                sizes.append(len(raw))
                anchors.append(v.view(np.int64))
                times.append(n.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(anchors, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32()))], ["id", "tie", "key", "n_bytes", "anchors", "times"]
            )

    return run


def _stretches(length: int, gram: int):
    """Every run of strings with one shared anchor: anchor, start of the run, its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, anchors, starts, parts = [], [], [], []
            for i, (x, shared) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
                raw = x.as_py()
                _, least, _ = _anchors(np.frombuffer(raw, np.uint8), length, gram)
                least = least.view(np.int64)
                edge = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
                ends = np.append(edge[1:], len(least))
                own = np.isin(least[edge], shared.values.to_numpy())
                for a, b in zip(edge[own].tolist(), ends[own].tolist(), strict=True):
                    rows.append(i)
                    anchors.append(int(least[a]))
                    starts.append(a)
                    parts.append(raw[a : b + length - 1])
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(anchors, pa.int64()), pa.array(starts, pa.int64()), pa.array(parts, pa.binary())], ["key", "anchor", "start", "part"])

    return run


def _repeats(length: int):
    def run(_key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        parts = [x.as_py() for x in table.column("part").combine_chunks()]
        times = table.column("times").to_numpy()
        _, anchor, stretches = np.unique(table.column("anchor").to_numpy(), return_inverse=True, return_counts=True)
        # equal strings have one anchor: a stretch that stands twice and is the only one of its
        # anchor repeats as a whole and can't meet any other
        lone = (times > 1) & (stretches[anchor] == 1)
        found = iter(repeats([p for p, x in zip(parts, lone.tolist(), strict=True) if not x], length))
        offsets = []
        for p, n, x in zip(parts, times.tolist(), lone.tolist(), strict=True):
            own = None if x else next(found)
            offsets.append(np.arange(len(p) - length + 1) if n > 1 else own)
        return pa.table({"part_key": table.column("part_key"), "offsets": pa.array([_runs(o) for o in offsets], pa.list_(pa.int64()))})

    return run


def distinct(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of 128-bit hashes in order, and the place of each row among them."""
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    rows = pairs[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(1)
    of = np.empty(len(rows), np.int64)
    of[order] = np.cumsum(new) - 1
    return rows[new], of


def _strings(length: int):
    """128-bit hashes of the different strings of a shard, by bucket, and whether each starts twice in it."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        parts = [x.as_py() for x in table.column("part")]
        twice = table.column("times").to_numpy() > 1
        hashes, again, first = [], [], 0
        for shard in shards(parts, length):
            hashes.append(np.column_stack((shard.keys(), shard.keys(1))))
            again.append(shard.repeated | twice[first + shard.owner[shard.at]])
            first += shard.n_stretches
        values, of = distinct(np.concatenate(hashes))
        again = np.bincount(of, np.concatenate(again)) > 0
        bucket = (values[:, 0] % np.uint64(table.column("cuts")[0].as_py())).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        values, again, bucket = values[order], again[order], bucket[order]
        edge = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)])).tolist()
        pieces = list(zip(edge[:-1], edge[1:], strict=True))
        n = len(pieces)
        return pa.table({
            "anchor": pa.array([key[0].as_py()] * n, pa.int64()), "shard": pa.array([key[1].as_py()] * n, pa.int64()), "bucket": pa.array(bucket[edge[:-1]], pa.int64()),
            "hashes": pa.array([values[a:b].tobytes() for a, b in pieces], pa.binary()), "again": pa.array([again[a:b].tobytes() for a, b in pieces], pa.binary()),
        })

    return run


def _merged(_key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Of each shard's hashes in a bucket those that start twice, in it or in two shards."""
    lists = [np.frombuffer(x.as_py(), np.uint64).reshape(-1, 2) for x in table.column("hashes")]
    again = np.frombuffer(b"".join(x.as_py() for x in table.column("again")), bool)
    _, of = distinct(np.concatenate(lists))
    keep = np.split(again | (np.bincount(of)[of] > 1), np.cumsum([len(x) for x in lists])[:-1])
    return pa.table({"anchor": table.column("anchor"), "shard": table.column("shard"), "hashes": pa.array([x[k].tobytes() for x, k in zip(lists, keep, strict=True)], pa.binary())})


def _placed(length: int):
    """Offsets of a shard's stretches at which one of its repeated strings starts."""

    def run(own: pa.Table, merged: pa.Table) -> pa.Table:
        parts = [x.as_py() for x in own.column("part")]
        known = np.frombuffer(b"".join(x.as_py() for x in merged.column("hashes")), np.uint64).reshape(-1, 2)
        data = np.frombuffer(b"".join(parts), np.uint8)
        sizes = np.array([len(p) for p in parts])
        counts = sizes - length + 1
        offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        start = np.repeat(np.cumsum(sizes) - sizes, counts) + offset
        strings = np.column_stack([byte_hashes(data, length, kind)[start] for kind in (0, 1)])
        _, of = distinct(np.concatenate((known, strings)))
        hit = np.isin(of[len(known) :], of[: len(known)])
        found = [_runs(np.flatnonzero(x)) for x in np.split(hit, np.cumsum(counts)[:-1])]
        return pa.table({"part_key": own.column("part_key"), "offsets": pa.array(found, pa.list_(pa.int64()))})

    return run


def _repeats_of_heavy(pieces: DataFrame, heavy: DataFrame, length: int) -> DataFrame:
    """(part_key, offsets) for stretches of anchors too large for one task, dealt over `cuts` shards each."""
    different = pieces.join(F.broadcast(heavy), "anchor").groupBy("anchor", "cuts", "part_key", "part").agg(F.count("*").alias("times"))
    dealt = materialize(different.withColumn("shard", F.pmod(F.xxhash64("part_key"), "cuts")))
    strings = dealt.groupBy("anchor", "shard").applyInArrow(_strings(length), "anchor long, shard long, bucket long, hashes binary, again binary")
    merged = strings.groupBy("anchor", "bucket").applyInArrow(_merged, "anchor long, shard long, hashes binary")
    return dealt.groupBy("anchor", "shard").cogroup(merged.groupBy("anchor", "shard")).applyInArrow(_placed(length), "part_key binary, offsets array<long>")


def _runs(starts: np.ndarray) -> np.ndarray:
    """Sorted starts as first, last, first, last, ... of runs without gap."""
    if not len(starts):
        return starts.astype(np.int64)
    cut = np.flatnonzero(np.diff(starts) > 1)
    return np.column_stack((starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)])).ravel().astype(np.int64)


def _remove(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, kept = [], [], []
            for x, runs in zip(batch.column(1), batch.column(2), strict=True):
                raw = x.as_py()
                steps = np.zeros(len(raw) + 1, np.int64)
                for r in runs.values:
                    pairs = r.values.to_numpy().reshape(-1, 2)
                    np.add.at(steps, pairs[:, 0], 1)
                    np.add.at(steps, pairs[:, 1] + length, -1)
                gone = np.cumsum(steps[:-1]) > 0
                removed.append(int(gone.sum()))
                spans.append(int((gone & ~np.concatenate(([False], gone[:-1]))).sum()))
                kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["key", "n_removed", "n_spans", "kept"])

    return run


def suffix_dedup(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept (null where nothing is removed), kept_sha256.

    Texts are UTF-8 bytes, null is empty; `kept` may cut characters, so it is binary. Every
    byte covered by `length` bytes that also start anywhere else goes, in every occurrence.
    Of equal texts one is scanned; if there are several and they have `length` bytes, all of
    them lose everything. Rows need no id: repeated rows are copies like any other. Extra
    columns are ignored, an empty table gives no rows.
    """
    kind = documents.schema[id_col].dataType.simpleString()
    texts = documents.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tie"), F.encode(text_col, "UTF-8").alias("raw"))
    # one pass over the texts: small rows that all later steps start from
    rows = materialize(texts.mapInArrow(_scan(length, gram), f"id {kind}, tie long, key binary, n_bytes long, anchors array<long>, times array<int>"))
    copies = rows.groupBy("key").agg(F.count("*").alias("copies"), F.min(F.struct("id", "tie")).alias("one"))
    scanned = rows.select("key", F.explode(F.arrays_zip("anchors", "times")).alias("x")).select("key", F.col("x.anchors").alias("anchor"), F.col("x.times").alias("times"))
    twice = scanned.groupBy("anchor").agg(F.min("key").alias("least"), F.max("key").alias("most"), F.max("times").alias("times")).where("least != most or times > 1").select("anchor")
    shared = scanned.join(twice, "anchor").groupBy("key").agg(F.collect_set("anchor").alias("anchors")).join(copies, "key")
    shared = materialize(shared.select("key", "anchors", F.col("one.id").alias("one_id"), F.col("one.tie").alias("one_tie")))
    held = texts.join(shared, texts.id.eqNullSafe(shared.one_id) & (texts.tie == shared.one_tie))
    held = materialize(held.select("key", "raw", "anchors").dropDuplicates(["key"]))
    pieces = held.mapInArrow(_stretches(length, gram), "key binary, anchor long, start long, part binary")
    pieces = materialize(pieces.withColumn("part_key", F.unhex(F.sha2(F.concat(F.encode(F.col("anchor").cast("string"), "UTF-8"), F.lit(b":"), F.col("part")), 256))))
    # anchors with more bytes than a shard: at most as many as there are shards
    weights = pieces.groupBy("anchor").agg(F.sum(F.length("part")).alias("bytes"))
    heavy = materialize(weights.where(F.col("bytes") > SHARD_BYTES).select("anchor", F.ceil(2 * F.col("bytes") / SHARD_BYTES).alias("cuts")))
    any_heavy = not heavy.isEmpty()
    light = pieces.join(F.broadcast(heavy), "anchor", "left_anti") if any_heavy else pieces
    n_rows, n_bytes = pieces.agg(F.count("*"), F.coalesce(F.sum(F.length("part")), F.lit(0))).first()
    # half full on average, so that chance overfills few
    n_shards = max(1, -(-n_rows // SHARD_ROWS), -(-2 * n_bytes // SHARD_BYTES))
    different = light.groupBy("anchor", "part_key", "part").agg(F.count("*").alias("times")).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(n_shards)))
    found = different.groupBy("shard").applyInArrow(_repeats(length), "part_key binary, offsets array<long>")
    if any_heavy:
        found = found.union(_repeats_of_heavy(pieces, heavy, length))
    found = found.where(F.size("offsets") > 0)
    runs = pieces.select("key", "start", "part_key").join(found, "part_key").select("key", F.transform("offsets", lambda o: o + F.col("start")).alias("runs"))
    gone = runs.groupBy("key").agg(F.collect_list("runs").alias("runs"))
    removals = held.select("key", "raw").join(gone, "key").mapInArrow(_remove(length), "key binary, n_removed long, n_spans long, kept binary")
    out = rows.select("id", "key", "n_bytes").join(copies.select("key", "copies"), "key").join(removals, "key", "left")
    all_gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    kept = F.when(all_gone, F.encode(F.lit(""), "UTF-8")).otherwise(F.col("kept"))
    zero = F.lit(0).cast("long")
    return out.select(
        F.col("id").alias(id_col), "n_bytes", F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(all_gone, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"), kept.alias("kept"), F.coalesce(F.sha2(kept, 256), F.lower(F.hex("key"))).alias("kept_sha256"),
    )
