import hashlib
import re

import pytest

from terrashelf.llm import decontaminate
from tests.conftest import rows
from tests.llm.data import LONG, ODD, docs

ITEMS = [
    (1, "One two three four five six seven eight nine ten eleven twelve"),
    (2, "six seven eight nine ten eleven twelve thirteen fourteen FIFTEEN"),
    (3, "short item"), (4, "lone"), (5, ""), (6, None), (7, "!!!"), (10, "short item"), (None, "nobody knows"),
    (8, "a a a a a a a a a a a"), (9, "größe-42 é x"),
]
TEXTS = [
    "x one two three four five six seven eight nine ten y", "one two three four five six seven eight nine",
    "One, two; three\nFOUR five six seven eight nine ten eleven twelve thirteen fourteen fifteen.",
    "short items, short item and lone wolf", "a a a a a a a a a", "a " * 30, "nobody knows", "GRÖßE 42 é x größe 42 é x",
    "z " * 500 + "six seven eight nine ten eleven twelve thirteen fourteen fifteen " * 3, "item short", None, "", "!?",
]


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def expected(data, items, window=10):
    found = []
    for doc_id, text in data:
        ws, hit, names = words(text), set(), set()
        for item, item_text in items:
            iw = words(item_text)
            n = min(window, len(iw))
            grams = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
            for i in range(len(ws) - n + 1):
                if tuple(ws[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    if item is not None:
                        names.add(str(item))
        found.append((doc_id, len(ws), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(found, key=repr)


def items_of(spark, items=ITEMS):
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("limit", [1000, 12])
def test_against_brute_force(spark, limit):
    data = list(enumerate(TEXTS)) + ODD[:6] + [(1, TEXTS[0])]
    found = decontaminate.find_hits(docs(spark, data), items_of(spark), keep=["doc_id"], limit=limit)
    assert rows(decontaminate.digests(found).drop("longest")) == expected(data, ITEMS)


def test_longest_match(spark):
    found = decontaminate.find_hits(docs(spark, list(enumerate(TEXTS))), items_of(spark), keep=["doc_id"])
    longest = {r.doc_id: r.longest for r in found.collect()}
    assert longest[0] == 10 and longest[1] == 0 and longest[2] == 12 and longest[10] == 0


def test_spans_are_cut_and_covered_documents_go(spark):
    clean = "Nothing, here.\nAt all"
    data = [(1, f"Start (of it): {ITEMS[0][1]}! End of {'the ' * 40}"), (2, TEXTS[2]), (3, clean), (4, None), (5, LONG)]
    kept = decontaminate.decontaminate(docs(spark, data), items_of(spark), max_coverage=0.5)
    got = {r.doc_id: r.text for r in kept.collect()}
    assert got == {1: f"Start (of it): ! End of {'the ' * 40}", 3: clean, 4: None, 5: LONG}
    assert kept.columns == docs(spark, []).columns
    none = decontaminate.decontaminate(docs(spark, data), items_of(spark), max_coverage=0.0)
    assert {r.doc_id for r in none.collect()} == {3, 4, 5}


def test_empty_tables(spark):
    assert decontaminate.find_hits(docs(spark, []), items_of(spark)).count() == 0
    found = decontaminate.find_hits(docs(spark, ODD), items_of(spark, []))
    assert {len(r.hit_runs) for r in found.collect()} == {0}


def test_automaton_against_all_substrings():
    import random

    rng = random.Random(2)
    items = [(i, [b"%d" % rng.randrange(3) for _ in range(rng.randrange(1, 14))]) for i in range(30)]
    automaton = decontaminate.Automaton(items, window=4)
    for _ in range(300):
        ws = [b"%d" % rng.randrange(4) for _ in range(rng.randrange(0, 25))]
        want, names = set(), set()
        for name, iw in items:
            n = min(4, len(iw))
            grams = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)}
            for i in range(len(ws) - n + 1):
                if tuple(ws[i : i + n]) in grams:
                    want |= set(range(i, i + n))
                    names.add(name)
        hit, _, found = automaton.hits(ws)
        assert set(hit.nonzero()[0].tolist()) == want and found == names


def test_slices_fold_equal_items_and_cut_long_ones(spark):
    same = [(i, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda") for i in range(500)]
    long = (900, " ".join(f"w{i}" for i in range(1000)))
    table, slices = decontaminate.item_slices(items_of(spark, [*same, long]), limit=100)
    sizes = [sum(len(r.words) for r in table.where(table.bin.isin(bins)).collect()) for bins in slices]
    assert all(sizes) and sum(len(r.ids) == 500 for r in table.collect()) == 1 and len(slices) <= 12
    data = [(1, same[0][1]), (2, long[1]), (3, " ".join(f"w{i}" for i in range(95, 105)))]
    found = decontaminate.find_hits(docs(spark, data), items_of(spark, [*same, long]), keep=["doc_id"], limit=100)
    assert rows(decontaminate.digests(found).drop("longest")) == expected(data, [*same, long])


def test_length_limit_and_short_items(spark):
    items = items_of(spark, [(1, "the"), (2, " ".join(f"w{i}" for i in range(20)))])
    data = [
        (1, "Of the one the other " + "word " * 50), (2, "so " * 200 + " ".join(f"w{i}" for i in range(20))),
        (3, "so " * 200 + " ".join(f"w{i}" for i in range(3, 14)) + " end"), (4, "the the the"), (5, None),
    ]
    kept = decontaminate.decontaminate(docs(spark, data), items, max_length=13)
    assert {r.doc_id: (r.text or "").split() for r in kept.collect()} == {
        1: ["Of", "one", "other"] + ["word"] * 50, 3: ["so"] * 200 + ["end"], 4: [], 5: []}
