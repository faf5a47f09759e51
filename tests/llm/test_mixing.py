import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from terrashelf.llm import mixing
from terrashelf.session import cut
from tests.llm.data import ODD, docs


def fill(sizes, weights=mixing.WEIGHTS):
    """Targets by the rule as it is told: share by weight, stop at the limit, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left = {s: 0.0 for s in names}, 1.5 * sum(sizes.values())
    while left > 1e-9:
        open_ = [s for s in names if target[s] < 2 * sizes[s] - 1e-9]
        if not open_:
            break
        total, left_now, left = sum(weight[s] for s in open_), left, 0.0
        for s in open_:
            target[s] += left_now * weight[s] / total
            if target[s] > 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
    return target


def mixed(spark, data):
    sized = cut(docs(spark, data).withColumn("size", mixing.word_count(F.col("text"))))
    plan = mixing.plan_mix(sized, "source", "doc_id", "size")
    return mixing.apply_mix(sized, plan, "source", "doc_id", "size")


def check(found, data):
    sizes, taken, seen = defaultdict(int), defaultdict(int), {}
    for _, text, source in data:
        sizes[source] += len([w for w in (text or "").split() if w])
    want = fill(sizes)
    for r in found:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-6)
        taken[r.source] += r.taken
        seen[r.source] = seen.get(r.source, 0) + (r.taken != r.copies * r.size)
    for source in sizes:
        assert abs(taken[source] - want[source]) <= 1 + seen[source]
        assert seen[source] <= 2
    assert len(found) == len(data)


def test_targets_are_met(spark):
    random.seed(3)
    data = []
    for i in range(600):
        source = random.choice(["a", "b", "b", "b", "c", "d", None, "é"])
        data.append((i, "w " * int(random.lognormvariate(3, 1.2)), source))
    found = mixed(spark, data).collect()
    check(found, data)
    again = {r.doc_id: r.taken for r in mixed(spark, data[::-1]).collect()}
    assert again == {r.doc_id: r.taken for r in found}


def test_odd_rows(spark):
    data = [(i, t, ["a", None, "b"][n % 3]) for n, (i, t) in enumerate(ODD)] + [(90, "", "no words"), (91, None, "no words")]
    found = mixed(spark, data)
    assert "lang" in found.columns
    assert all(0 <= r.taken <= 2 * r.size for r in found.collect())
    assert found.count() == len(data)


def test_one_source_and_empty(spark):
    data = [(i, "x y z " * (i + 1), "only") for i in range(40)]
    check(mixed(spark, data).collect(), data)
    assert mixed(spark, []).count() == 0
    assert {r.taken for r in mixed(spark, [(1, None, "a"), (2, " ", None)]).collect()} == {0}


def test_rates_tilt_with_size(spark):
    data = [(i, "w " * (10 + i), s) for i in range(200) for s in ("a", "b")]
    found = [r for r in mixed(spark, data).collect() if r.source == "b"]
    rates = [r.rate for r in sorted(found, key=lambda r: r.size)]
    assert all((a - b) * (rates[0] - rates[-1]) >= -1e-12 for a, b in zip(rates, rates[1:]))
