import random
from collections import Counter

import numpy as np
import pytest

from terrashelf.llm import minhash
from terrashelf.llm.common import table
from terrashelf.session import cut
from tests.conftest import rows
from tests.llm.data import LONG, ODD, docs

SF = "/root/testdata/sf0.001"


def set_of(text, width=4):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def expected(data):
    """All pairs, compared in full: shingles that only one text has cannot be in an intersection."""
    sets = [set_of(t) for _, t in data]
    parent = list(range(len(data)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    times = Counter(x for s in sets for x in s)
    place = {x: i for i, x in enumerate(x for x, n in times.items() if n > 1)}
    held = np.zeros((len(data), max(1, len(place))), dtype=np.float32)
    for i, s in enumerate(sets):
        held[i, [place[x] for x in s if x in place]] = 1
    both = np.rint(held @ held.T).astype(int)
    size = np.array([len(s) for s in sets], dtype=int)
    linked = (both > 0) & (100 * both >= 80 * (size[:, None] + size[None, :] - both))
    for i, j in zip(*np.nonzero(np.triu(linked, 1))):
        a, b = find(int(i)), find(int(j))
        parent[max(a, b)] = min(a, b)
    least = {}
    for i, (doc_id, _) in enumerate(data):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    named = [least.get(find(i)) if sets[i] else doc_id for i, (doc_id, _) in enumerate(data)]
    return sorted(((d, len(s), c, d == c) for (d, _), s, c in zip(data, sets, named)), key=repr)


def run(spark, data):
    return rows(minhash.near_copies(cut(docs(spark, data))))


def edited(rng, base, share):
    words = list(base)
    for i in range(len(words)):
        if rng.random() < share:
            words[i] = f"e{rng.randrange(10**9)}"
    return " ".join(words)


def test_odd_rows(spark):
    data = ODD + [(20, "a b c d e"), (21, "A b c d e"), (22, "a b c d e f"), (23, "x"), (24, "X"), (25, LONG + "end of it")]
    assert run(spark, data) == expected(data)


def test_edited_copies_of_all_sizes(spark):
    rng, data = random.Random(6), []
    for group, size in enumerate([5, 6, 8, 12, 20, 40, 80, 150, 320, 700, 1000, 1300, 3000] * 3):
        base = [f"w{rng.randrange(5000)}" for _ in range(size)]
        for copy in range(8):
            data.append((group * 100 + copy, edited(rng, base, rng.choice([0, 0.01, 0.03, 0.05]) if size > 30 else 0.5 * rng.random() / size)))
    assert run(spark, data) == expected(data)


def test_large_groups_give_few_candidates(spark, monkeypatch):
    """2,000 near copies of one text, of a similarity of 0.85 to it: not linked with each other, but through it."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(400)]
    data = [(5000, " ".join(base))]
    for i in range(1, 2000):
        words = list(base)
        for block in rng.sample(range(1, 49), 8):
            words[block * 8 + rng.randrange(4)] = f"e{i}"
        data.append((i, " ".join(words)))
    asked, verified = [], minhash.verified
    monkeypatch.setattr(minhash, "verified", lambda pairs, *more: asked.append(pairs.count()) or verified(pairs, *more))
    assert run(spark, data) == expected(data)
    assert sum(asked) <= 10 * len(data)


def test_large_group_around_the_limit(spark):
    rng = random.Random(10)
    base = [f"w{i}" for i in range(400)]
    data = [(i, edited(rng, base, 0.025)) for i in range(600)] + [(900, " ".join(base))]
    want = expected(data)
    assert len({r[2] for r in want}) > 50 and run(spark, data) == want


def test_cells_of_a_large_bucket(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(300)]
    data = [(i, edited(rng, base, 0.03)) for i in range(150)]
    want = expected(data)
    monkeypatch.setattr(minhash, "CELL", 16)
    monkeypatch.setattr(minhash, "first_pairs", lambda met: met.sparkSession.createDataFrame([], "node_a long, node_b long"))
    assert run(spark, data) == want


def test_query_against_brute_force(spark):
    data = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    assert rows(minhash.op13_hyperminhash(spark, SF)) == expected(data)


@pytest.mark.parametrize("n", [1, 2, 5, 100, 819, 820, 1024, 5000])
def test_levels_meet(n):
    found = minhash.levels(n)
    assert len(found) <= 2 and found == list(range(found[0], found[-1] + 1))
    for m in range(max(1, n * 8 // 10), n * 10 // 8 + 1):
        if min(m, n) * 100 >= max(m, n) * 80:
            assert set(found) & set(minhash.levels(m))


def test_estimate_is_near_the_similarity():
    rng = np.random.default_rng(5)
    for n, share in ((5, 0.8), (30, 0.8), (400, 0.9), (4000, 0.5), (4000, 0.0)):
        errors = []
        for _ in range(60):
            pool = rng.integers(0, 1 << 63, 3 * n, dtype=np.uint64)
            both = round(share * 2 * n / (1 + share))
            a, b = pool[:n], np.concatenate([pool[:both], pool[n : 2 * n - both]])
            true = both / (2 * n - both)
            depth = minhash.level(n)
            sizes = np.array([n])
            errors.append(minhash.estimated(minhash.registers(a, depth)[None], minhash.registers(b, depth)[None], sizes, sizes)[0] - true)
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_registers_hold_zeros_and_mantissa():
    found = minhash.registers(np.arange(1, 3000, dtype=np.uint64), 0)
    assert found.dtype == np.dtype("<u2") and (found > 0).all() and len(set(found.tolist())) > 100


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, ""), (None, " ")]) == [(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, True)]
