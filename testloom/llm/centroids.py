"""Centroid clustering with a progressive Walsh-Hadamard search.

Vectors and centroids are integers, and so are their Walsh-Hadamard coefficients: the
squared distance of two vectors is the sum of the squared differences of their
coefficients, divided by the dimension, without any rounding. Coefficients are in order of
sign changes, coarse ones first. For each vector

1. the coarsest coefficients are held against all centroids,
2. the centroid that is nearest so far is finished: its distance is an upper bound,
3. finer coefficients are added step by step; a centroid whose sum is above the bound is
   strictly worse and goes,
4. those that stay are finished over all coefficients; ties go to the smaller number.

The vectors are written once as integers. A round is one pass over them that sends a row a
task and centroid to the sums; only the centroids themselves pass through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from testloom.llm.common import materialize

DIMENSION = 64
SCALE = 64
CENTROIDS = 16
ROUNDS = 3
#: Coefficients after which centroids are compared with the bound.
STEPS = (4, 8, 16, 32, 64)
#: Vectors searched together, and the largest component that leaves 64-bit sums exact; beyond
#: it Python's integers take over.
BLOCK = 4096
PLAIN = 1 << 24
MOST = (1 << 63) - 1


def _walsh(dimension: int) -> np.ndarray:
    """Places of the Hadamard coefficients in order of sign changes."""
    rows = np.array([[bin(i & j).count("1") & 1 for j in range(dimension)] for i in range(dimension)])
    return np.argsort((rows[:, 1:] != rows[:, :-1]).sum(1))


_ORDER = {DIMENSION: _walsh(DIMENSION)}


def coefficients(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row, coarse coefficients first; exact for integers."""
    n, d = x.shape
    order = _ORDER.get(d)
    if order is None:
        order = _ORDER[d] = _walsh(d)
    half = 1
    while half < d:
        pairs = x.reshape(n, d // (2 * half), 2, half)
        a, b = pairs[:, :, 0], pairs[:, :, 1]
        x = np.stack((a + b, a - b), axis=2).reshape(n, d)
        half *= 2
    return x[:, order]


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest centroid, both given by coefficients."""
    d = x.shape[1]
    steps = sorted({*(s for s in STEPS if s < d), d})
    diff = x[:, None, : steps[0]] - centroids[None, :, : steps[0]]
    sums = (diff * diff).sum(2)
    first = x - centroids[sums.argmin(1)]
    bound = (first * first).sum(1)
    row, number = np.nonzero(sums <= bound[:, None])
    sums = sums[row, number]
    for a, b in zip(steps[:-1], steps[1:], strict=True):
        diff = x[row, a:b] - centroids[number, a:b]
        sums = sums + (diff * diff).sum(1)
        left = (sums <= bound[row]).astype(bool)
        row, number, sums = row[left], number[left], sums[left]
    # every row has its first centroid left; rows and numbers ascend, so the first of equal sums counts
    least = np.minimum.reduceat(sums, np.flatnonzero(np.diff(row, prepend=-1)))
    best = np.flatnonzero((sums == least[row]).astype(bool))
    _, at = np.unique(row[best], return_index=True)
    return number[best[at]], least // d


def _integers(dimension: int, scale: int):
    """Kept vectors as integers floor(scale * component)."""

    def whole(x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            return np.floor(x * scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(sizes == dimension)
            values = column.take(pa.array(at)).flatten()
            x = values.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), dimension)  # null is NaN
            x = whole(x)
            ok = (np.abs(x) < 2.0**63).all(1)
            kept = x[ok].astype(np.int64)
            offsets = np.arange(len(kept) + 1, dtype=np.int32) * dimension
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at[ok])), pa.ListArray.from_arrays(offsets, kept.ravel())], ["id", "v"])

    return run


def _blocks(batch: pa.RecordBatch, dimension: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for a in range(0, batch.num_rows, BLOCK):
        part = batch.slice(a, BLOCK)
        yield part.column(0), part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dimension)


class Search:
    """Centroids, ready for vectors of any size."""

    def __init__(self, centroids: list[list[int]]):
        wide = np.array(centroids, object)
        self.wide = coefficients(wide)
        self.plain = self.wide.astype(np.int64) if np.abs(wide).max() <= PLAIN else None

    def __call__(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cluster and squared distance of each vector; distances are objects where they may be large."""
        small = (v <= PLAIN).all(1) & (v >= -PLAIN).all(1) if self.plain is not None else np.zeros(len(v), bool)
        if small.all():
            return nearest(coefficients(v), self.plain)
        number, distance = np.zeros(len(v), np.int64), np.zeros(len(v), object)
        for rows, centroids, kind in ((small, self.plain, np.int64), (~small, self.wide, object)):
            if rows.any():
                number[rows], distance[rows] = nearest(coefficients(v[rows].astype(kind)), centroids)
        return number, distance


def _sums(centroids: list[list[int]], dimension: int):
    """A row for each centroid that has vectors in this task: number, count, component sums."""
    kind = pa.decimal128(38, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, k = Search(centroids), len(centroids)
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dimension), object)
        for batch in batches:
            for _, v in _blocks(batch, dimension):
                number, _ = search(v)
                counts += np.bincount(number, minlength=k)
                exact = v if np.abs(v.astype(np.float64)).max(initial=0) < 2.0**50 else v.astype(object)
                for c in np.unique(number).tolist():
                    sums[c] += exact[number == c].sum(0).astype(object)
        own = np.flatnonzero(counts)
        columns = [pa.array([Decimal(int(s)) for s in sums[own, i]], kind) for i in range(dimension)]
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(counts[own]), *columns], ["c", "n", *(f"s{i}" for i in range(dimension))])

    return run


def _assigned(centroids: list[list[int]], dimension: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        for batch in batches:
            for ids, v in _blocks(batch, dimension):
                number, distance = search(v)
                yield pa.RecordBatch.from_arrays([ids, pa.array(number.astype(np.int32)), pa.array(np.minimum(distance, MOST).astype(np.int64))], ["id", "cluster", "distance"])

    return run


def _moved(vectors: DataFrame, centroids: list[list[int]], dimension: int) -> list[list[int]]:
    """Each centroid replaced by the floor of the mean of its vectors; one without vectors stays."""
    names = [f"s{i}" for i in range(dimension)]
    parts = vectors.mapInArrow(_sums(centroids, dimension), ", ".join(["c long", "n long", *(f"{s} decimal(38,0)" for s in names)]))
    totals = parts.groupBy("c").agg(F.sum("n").alias("n"), *(F.sum(s).alias(s) for s in names)).collect()  # a row a centroid
    out = list(centroids)
    for r in totals:
        out[r.c] = [int(r[s]) // r.n for s in names]
    return out


def cluster(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, dimension: int = DIMENSION, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row per kept vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of `dimension` (a power of two) components, none of them null or
    non-finite; a component whose integer floor(scale * x) has more than 63 bits counts as
    non-finite. The k kept vectors whose ids have the smallest sha256 of `1:<id>` are the
    first centroids (ids of null never; of equal ids the smaller vector comes first); with
    fewer vectors there are fewer centroids. Each round moves every centroid to the exact
    floor of its vectors' mean. Squared distances and their sums above 2**63 - 1 are given as
    that. Rows that repeat an id are vectors of their own; no kept vector, no rows. Only the
    two named columns are read, so others may have any name.
    """
    spark = embeddings.sparkSession
    if dimension & (dimension - 1):
        raise ValueError("dimension must be a power of two")
    rows = embeddings.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    kind = rows.schema["id"].dataType.simpleString()
    vectors = materialize(rows.mapInArrow(_integers(dimension, scale), f"id {kind}, v array<long>"))
    named = vectors.where("id is not null").withColumn("h", F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256))
    centroids = [list(r.v) for r in named.orderBy("h", "v").limit(k).collect()]
    if not centroids:
        empty = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], f"id {kind}, {empty}").withColumnRenamed("id", id_col)
    for _ in range(rounds):
        centroids = _moved(vectors, centroids, dimension)
    found = materialize(vectors.mapInArrow(_assigned(centroids, dimension), f"id {kind}, cluster int, distance long"))
    sums = {r.cluster: int(r.d) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    total = min(sum(sums.values()), MOST)
    told = [Row(cluster=c, cluster_inertia=min(d, MOST), inertia=total, centroid_sha256=hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, d in sums.items()]
    by_cluster = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string") if told else spark.createDataFrame([], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # at most k rows
    return found.join(F.broadcast(by_cluster), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round_sql(r: int) -> str:
    return f"""a{r} as materialized (select i, c from (select k.i, c.c, row_number() over (partition by k.i order by list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c.c) as place from k, c{r} c) where place = 1),
s{r} as (select c, j, sum(k.v[j]) as s, count(*) as n from a{r} join k using (i), range(1, {DIMENSION + 1}) t(j) group by c, j),
m{r} as (select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by j) as v from s{r} group by c),
c{r + 1} as materialized (select c{r}.c, coalesce(m{r}.v, c{r}.v) as v from c{r} left join m{r} using (c)),
"""


ORACLE_SQL = f"""
with k as materialized (select row_number() over () as i, vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as v from embeddings
  where len(embedding) = {DIMENSION} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as materialized (select row_number() over (order by h, v) - 1 as c, v from (select sha256('1:' || vec_id) as h, v from k where vec_id is not null order by h, v limit {CENTROIDS})),
{''.join(_round_sql(r) for r in range(ROUNDS))}
d as materialized (select i, vec_id, c, d from (select k.i, k.vec_id, c.c, x.d, row_number() over (partition by k.i order by x.d, c.c) as place from k, c{ROUNDS} c, lateral (select list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as d) x) where place = 1)
select vec_id, cast(c as int) as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by c) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia,
  sha256(array_to_string(c{ROUNDS}.v, ',')) as centroid_sha256 from d join c{ROUNDS} using (c)
"""
