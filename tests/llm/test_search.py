"""SimHash near-duplicates, ranked search and centroid clustering against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from testloom.llm import centroids, queries, ranked_search, simhash
from tests.llm.test_llm import LOWER, frame, odd_texts, words
from tests.oracle import SF, connection, duck_rows, spark_rows

# --- SimHash


def plain_fingerprint(text):
    w = words((text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, ids, most=4):
    """Smallest id reachable, by a search over all pairs."""
    out = [None] * len(fps)
    for i in range(len(fps)):
        if out[i] is not None:
            continue
        found, todo = {i}, [i]
        while todo:
            x = todo.pop()
            near = [j for j in range(len(fps)) if j not in found and (fps[x] ^ fps[j]).bit_count() <= most]
            found.update(near)
            todo += near
        named = [ids[j] for j in found if ids[j] is not None]
        for j in found:
            out[j] = (min(named) if named else None,)
    return [x[0] for x in out]


def near_texts():
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    texts = list(odd_texts())
    for _ in range(6):
        base = [rng.choice(vocab) for _ in range(rng.randint(60, 400))]
        for k in range(9):
            x = base.copy()
            for _ in range(k % 4):
                x[rng.randrange(len(x))] = rng.choice(vocab)
            texts.append(" ".join(x))
    return texts + ["One", "one two", "one two three", "One Two Three four", "a\x0bb c d e", "Ü " * 5]


@pytest.mark.parametrize("ids", ["given", "lost"])
def test_simhash_by_brute_force(spark, ids):
    texts = near_texts()
    own = list(range(len(texts))) if ids == "given" else [None if i % 3 == 0 else i // 2 for i in range(len(texts))]
    fps = [plain_fingerprint(t) for t in texts]
    want = Counter(zip(own, (f"{f:016x}" for f in fps), plain_components(fps, own), strict=True))
    rows = simhash.near_duplicates(frame(spark, texts, own)).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in rows) == want
    same = Counter(fps)
    assert all(r.n_same == same[int(r.fingerprint, 16)] for r in rows)


def dense(rng, n, center, spread):
    out = set()
    while len(out) < n:
        x = center
        for _ in range(rng.randint(0, spread)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return list(out)


@pytest.mark.parametrize("limit", [None, 40])
def test_simhash_index_on_dense_fingerprints(spark, monkeypatch, limit):
    """Chains and balls of fingerprints, also with lists that are cut."""
    rng = random.Random(11)
    fps = [rng.getrandbits(64) for _ in range(60)] + dense(rng, 150, rng.getrandbits(64), 9) + dense(rng, 60, 0, 3) + dense(rng, 60, (1 << 64) - 1, 12) + [0, (1 << 64) - 1]
    chain = rng.getrandbits(64)
    for _ in range(40):
        for _ in range(4):
            chain ^= 1 << rng.randrange(64)
        fps.append(chain)
    fps = sorted(set(fps))
    if limit:
        monkeypatch.setattr(simhash, "LIST_ENTRIES", limit)
    monkeypatch.setattr(simhash, "_fingerprints", lambda shingle: given)

    def given(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array([int(t.as_py(), 16) for t in b.column(1)], np.uint64).view(np.int64))], ["id", "fp"])

    rows = simhash.near_duplicates(frame(spark, [f"{f:x}" for f in fps])).collect()
    want = dict(enumerate(plain_components(fps, list(range(len(fps))))))
    assert {r.doc_id: r.component_id for r in rows} == want
    assert len(set(want.values())) > 20


def test_simhash_pieces():
    assert simhash.pieces(1000, 4) == 5 and simhash.pieces(10**7, 4) == 6 and simhash.pieces(10**12, 4) == 8
    for p in (5, 6, 7, 8):
        masks = [m % (1 << 64) for m in simhash.choices(p, 4)]
        assert len(masks) == math.comb(p, 4)
        rng = random.Random(p)
        for _ in range(300):
            flips = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not flips & m for m in masks)


def test_simhash_gray_rank():
    codes = np.array([i ^ (i >> 1) for i in range(1000)], np.uint64)
    assert (simhash.gray_rank(codes) == np.arange(1000)).all()


def test_simhash_keep_one(spark):
    text = "a b c d e f g " * 20
    docs = frame(spark, [text, text + "h", None, "", "else " * 30])
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted({r.component_id for r in simhash.near_duplicates(docs).collect()})


# --- ranked search


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain_search(docs, items, k=10):
    n = {i: len(plain_terms(t)) for i, (_, t) in enumerate(docs)}
    tf = {i: Counter(plain_terms(t)) for i, (_, t) in enumerate(docs)}
    total, n_docs = sum(n.values()), sum(1 for x in n.values() if x)
    df = Counter(t for c in tf.values() for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, (doc, _) in enumerate(docs):
            s = 0
            for t in set(plain_terms(text)) & tf[i].keys():
                m = 10 + 90 * n[i] * n_docs // total
                s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[i][t] // (1000 * tf[i][t] + 8 * m))
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


def searched(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], "doc_id long, text string, item string, n long, score int")
    q = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, rank int")
    return Counter((r.item_id, r.rank, r.doc_id, r.score) for r in ranked_search.search(d, q, **more).collect())


@pytest.mark.parametrize("blocks", ["one", "many"])
def test_search_by_brute_force(spark, monkeypatch, blocks):
    rng = random.Random(8)
    vocab = [f"w{int(rng.paretovariate(0.5)) % 400}" for _ in range(800)] + ["Été", "naïve", "x1"]
    docs = list(enumerate([None, "", "!!", "one_two One", "w1"] + [" ".join(rng.choice(vocab) for _ in range(rng.choice((1, 5, 60, 400)))) for _ in range(180)], 3))
    docs += [(900 + i, docs[20][1]) for i in range(15)] + [(None, docs[20][1]), (7, docs[30][1])]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 30)))) for i in range(25)] + [(50, None), (51, "..."), (52, "never-there"), (53, docs[20][1]), (53, "w1 W1"), (None, "ONE two")]
    if blocks == "many":
        monkeypatch.setattr(ranked_search, "BLOCK_DOCS", 16)
        monkeypatch.setattr(ranked_search, "READ", 2)
    assert searched(spark, docs, items, **({"query_bytes": 400} if blocks == "many" else {})) == plain_search(docs, items)
    assert searched(spark, docs, items, k=1) == plain_search(docs, items, 1)


def test_search_empty_tables(spark):
    assert not searched(spark, [], [(1, "a")]) and not searched(spark, [(1, "a")], []) and not searched(spark, [(1, None)], [(1, "a")])


def test_search_stops_before_the_end_of_lists():
    """The upper bounds rule out what hasn't been read."""
    n = 5000
    ids = ranked_search.pa.array(range(n))
    times = [np.array([1000 if i == 77 else 1 + i % 3, 1], np.int32).tobytes() for i in range(n)]
    lists = ranked_search.Lists(ids, np.full(n, 50), [np.array([0, 1], np.int32).tobytes()] * n, times, np.array([5000, 1]), n, 50 * n)
    touched = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                touched.append(key.stop - key.start)
            return np.asarray(super().__getitem__(key))

    lists.doc = lists.doc.view(Counted)
    at, scores = lists.best([0], 1, 1)
    assert at.tolist() == [77] and sum(touched) < n


# --- centroid clustering


def plain_clusters(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None))[:k]
    c = [v for _, v in first]
    if not c:
        return Counter()

    def place(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), n) for n, x in enumerate(c))

    for _ in range(rounds):
        own = [place(v)[1] for _, v in kept]
        for n in range(len(c)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == n]
            if mine:
                c[n] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    last = [(i, *place(v)) for i, v in kept]
    cap = (1 << 63) - 1
    each = Counter()
    for _, d, n in last:
        each[n] += min(d, cap)
    total = min(sum(each.values()), cap)
    return Counter((i, n, min(d, cap), min(each[n], cap), total, hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for i, d, n in last)


def clustered(spark, rows, kind="array<float>"):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], f"vec_id long, embedding {kind}, cluster int, v string")
    return Counter(tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in centroids.cluster(df).collect())


@pytest.mark.parametrize("kind", ["small", "ties", "large", "few"])
def test_clusters_by_brute_force(spark, kind):
    rng = random.Random(4)
    scale = {"small": 0.3, "ties": 0.02, "large": 1e9, "few": 1.0}[kind]
    rows = [(i, [float(np.float32(rng.gauss(0, scale))) for _ in range(64)]) for i in range(5 if kind == "few" else 150)]
    if kind == "ties":
        rows = [(i, [round(x * 32) / 64 for x in v]) for i, v in rows] + [(200 + i, rows[3][1]) for i in range(60)]
    odd = [(None, rows[0][1]), (3, rows[1][1]), (400, None), (401, []), (402, [0.5] * 63), (403, [None] + [0.5] * 63), (404, [float("nan")] + [0.5] * 63), (405, [float("inf")] * 64), (406, [0.5] * 65)]
    for column in ("array<float>", "array<double>"):
        assert clustered(spark, rows + odd, column) == plain_clusters(rows + odd)


def test_clusters_of_nothing(spark):
    assert not clustered(spark, []) and not clustered(spark, [(1, None), (2, [1.0])])


def test_clusters_progressive_search_is_exact():
    rng = np.random.default_rng(2)
    for bound in (1, 3, 1000, 1 << 24):
        x, c = rng.integers(-bound, bound, (300, 64)), rng.integers(-bound, bound, (16, 64))
        c[5] = c[11]
        number, distance = centroids.nearest(centroids.coefficients(x), centroids.coefficients(c))
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (number == d.argmin(1)).all() and (distance == d.min(1)).all()


@pytest.mark.parametrize("name", ["op12_ranked_search", "op13_centroids"])
def test_new_queries_equal_sql(spark, name):
    df = queries.queries()[name](spark, SF)
    want, names = duck_rows(connection(), queries.oracle_sql()[name])
    assert sorted(df.columns) == names and want
    assert spark_rows(df) == want
