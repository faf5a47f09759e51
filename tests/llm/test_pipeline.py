from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from terrashelf.llm import quality, simhash, stages
from terrashelf.llm.common import table
from terrashelf.session import cut
from tests.llm.data import ODD, docs
from tests.llm.test_decontaminate import expected as hits
from tests.llm.test_mixing import fill
from tests.llm.test_records import expected as written
from tests.llm.test_simhash import classes, print_of

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark):
    found = [table(spark, SF, "documents")]
    for _, stage in corpus_pipeline.STAGES:
        found.append(cut(stage(spark, found[-1], SF)))
    return [(df.columns, df.collect()) for df in found]


def test_columns_and_names(steps):
    assert [name for name, _ in corpus_pipeline.STAGES][1] == "SimHash near-dedup"
    assert all(columns == COLUMNS for columns, _ in steps[:5])
    assert steps[5][0] == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_quality_stage(spark, steps):
    score = {r.doc_id: r.score for r in quality.op9_quality(spark, SF).collect()}
    assert sorted(r.doc_id for r in steps[1][1]) == sorted(i for i, s in score.items() if s >= 0.5)


def test_near_duplicate_stage(steps):
    before = [(r.doc_id, r.text) for r in steps[1][1]]
    roots = classes([print_of(t, stages.STAGE_SHINGLE) for _, t in before])
    least = defaultdict(lambda: 1 << 60)
    for (doc_id, _), root in zip(before, roots):
        least[root] = min(doc_id, least[root])
    assert sorted(r.doc_id for r in steps[2][1]) == sorted(least.values())


def test_decontamination_stage(spark, steps):
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    bad = {row[0] for row in hits([(r.doc_id, r.text) for r in steps[2][1]], items) if row[5]}
    assert bad and sorted(r.doc_id for r in steps[3][1]) == sorted({r.doc_id for r in steps[2][1]} - bad)


def test_mixing_stage(steps):
    size = lambda r: len(r.text.split())
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in steps[3][1]:
        sizes[r.source] += size(r)
        largest[r.source] = max(largest[r.source], size(r))
    for r in steps[4][1]:
        taken[r.source] += size(r)
    assert max(Counter(r.doc_id for r in steps[4][1]).values()) <= 2
    for source, target in fill(dict(sizes)).items():
        assert abs(taken[source] - target) <= largest[source]


def test_records_stage(steps):
    assert sorted(tuple(r) for r in steps[5][1]) == sorted(written([(r.doc_id, r.text) for r in steps[4][1]]))


def test_run_gives_the_last_stage(spark, steps):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, steps[5][1]))


def test_odd_rows(spark):
    data = docs(spark, ODD)
    found = cut(data)
    for _, stage in corpus_pipeline.STAGES[1:4]:
        found = cut(stage(spark, found, SF))
        assert found.columns == data.columns
    assert stages.records_stage(spark, found, SF).count() == found.count()
    kept = cut(stages.near_duplicate_stage(spark, cut(data), SF)).collect()
    prints = [(i, simhash.fingerprint((t or "").encode().lower().split(), stages.STAGE_SHINGLE)) for i, t in ODD]
    assert len(kept) == len(set(classes([f for _, f in prints])))


def test_rows_keep_their_values(spark):
    """Columns named like those of the stages come out with their own values."""
    names = ["doc_id", "text", "lang", "source", "n_chars", "target", "items", "n_words", "hit_runs", "longest", "_file",
             "_row", "_at", "_score", "_text", "_size", "_hit", "_rest", "_id", "fp", "root", "first", "size", "taken", "rate", "label"]
    given = [(i, f"text of its own {i} " * 30, "en", f"s{i % 2}", 1, *[f"{n}{i}" for n in names[5:]]) for i in range(20)]
    found = cut(spark.createDataFrame(given, names).repartition(2))
    for _, stage in corpus_pipeline.STAGES[:4]:
        found = cut(stage(spark, found, SF))
        assert found.columns == names and {tuple(r) for r in found.collect()} <= set(given)
    assert len({r.doc_id for r in found.collect()}) == 20


def test_large_group_of_near_copies(spark):
    base = [f"w{i}" for i in range(400)]
    data = [(i, " ".join(base[:i % 397] + ["edit"] + base[i % 397 + 1 :])) for i in range(600)]
    kept = stages.near_duplicate_stage(spark, cut(docs(spark, data)), SF).collect()
    prints = [print_of(t) for _, t in data]
    assert sorted(r.doc_id for r in kept) == sorted(set(classes(prints)))


def test_empty(spark):
    found = cut(docs(spark, []))
    for _, stage in corpus_pipeline.STAGES:
        found = cut(stage(spark, found, SF))
        assert found.count() == 0
