import hashlib
from collections import defaultdict

from terrashelf.llm import exactdedup
from tests.conftest import rows
from tests.llm.data import ODD, docs


def expected(data, best=max):
    groups = defaultdict(list)
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    for doc_id, text in data:
        groups[low(text)].append(doc_id)
    found = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, sha = best(known) if known else None, hashlib.sha256(text.encode()).hexdigest()
        stays = keep
        for i in ids:
            found.append((i, keep, len(ids), i == stays, sha))
            stays = object() if i == stays else stays
    return sorted(found, key=repr)


def normal(found):
    return rows(found)


def test_odd_rows(spark):
    assert normal(exactdedup.exact_groups(docs(spark, ODD))) == expected(ODD)
    assert normal(exactdedup.exact_groups(docs(spark, ODD), keep="min")) == expected(ODD, min)


def test_group_over_many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        data = [(i, "hot") for i in range(300)] + [(1000 + i, f"t{i % 40}") for i in range(100)]
        found = exactdedup.exact_groups(docs(spark, data)).cache()
        assert normal(found) == expected(data)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty(spark):
    assert exactdedup.exact_groups(docs(spark, [])).count() == 0
