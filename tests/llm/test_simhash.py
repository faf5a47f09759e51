import random

import numpy as np
import xxhash

from terrashelf.llm import simhash
from tests.conftest import rows
from tests.llm.data import LONG, ODD, docs


def print_of(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [b" ".join(words)]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def classes(prints, limit=4):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    prints = np.array(prints, dtype=np.uint64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= limit) + i + 1:
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def expected(data):
    prints = [print_of(t) for _, t in data]
    roots = classes(prints)
    least = {}
    for (doc_id, _), root in zip(data, roots):
        if doc_id is not None:
            least[root] = min(doc_id, least.get(root, doc_id))
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    return sorted(((i, signed(f), least.get(r)) for (i, _), f, r in zip(data, prints, roots)), key=repr)


def test_odd_rows(spark):
    found = simhash.components(simhash.fingerprints(docs(spark, ODD).drop("fp")))
    assert rows(found.select("doc_id", "fp", "component_id")) == expected(ODD)


def test_near_copies(spark):
    random.seed(5)
    words = [f"w{i}" for i in range(900)]
    data = []
    for g in range(6):
        base = [random.choice(words) for _ in range(700)]
        for c in range(12):
            copy = list(base)
            for _ in range(c // 3):
                copy[random.randrange(700)] = "edit"
            data.append((g * 100 + c, " ".join(copy)))
    found = simhash.components(simhash.fingerprints(docs(spark, data).drop("fp")))
    assert rows(found.select("doc_id", "fp", "component_id")) == expected(data)


def linked(spark, fps):
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long").distinct()
    roots = {r.node: r.root for r in simhash.connect(simhash.links(df)).collect()}
    return [roots.get(int(np.uint64(f).astype(np.int64)), int(np.uint64(f).astype(np.int64))) for f in fps]


def cluster(n, spread, seed):
    rng = random.Random(seed)
    found = set()
    centre = rng.getrandbits(64)
    while len(found) < n:
        flips = 0
        for _ in range(rng.randrange(spread)):
            flips |= 1 << rng.randrange(64)
        found.add(centre ^ flips)
    return sorted(found)


def same(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_dense_and_hot_clusters(spark, monkeypatch):
    fps = cluster(400, 9, 1) + cluster(60, 14, 2) + [random.Random(4).getrandbits(64) for _ in range(200)]
    want = classes(fps)
    assert same(linked(spark, fps), want)
    monkeypatch.setattr(simhash, "HOT", 5)
    assert same(linked(spark, fps), want)


def test_table_never_discards_a_link():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, 3000, dtype=np.int64).astype(np.uint64)
    other = fps.copy()
    for _ in range(4):
        other ^= np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)
    tables = [np.bitwise_count(f[:, None] ^ simhash.PIVOTS).astype(np.int8) for f in (fps, other)]
    assert (simhash._far(*tables) <= 4).all()


def test_long_text_and_chain(spark):
    assert simhash.fingerprint(LONG.encode().split()) == print_of(LONG)
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r.root for r in simhash.connect(edges).collect()} == {0}


def test_empty(spark):
    assert simhash.components(simhash.fingerprints(docs(spark, []).drop("fp"))).count() == 0
