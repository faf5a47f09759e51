import zlib

import numpy as np

from terrashelf.llm import quality
from terrashelf.llm.common import table
from tests.llm.data import ODD, docs

SF = "/root/testdata/sf0.01"


def test_held_out_rows(spark):
    found = quality.op9_quality(spark, SF)
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    got = found.collect()
    assert len(got) == table(spark, SF, "documents").count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert len(held) > 80 and np.mean([a == b for a, b in held]) > 0.95


def test_runs_agree(spark):
    one, two = ({r.doc_id: r.score for r in quality.op9_quality(spark, "/root/testdata/sf0.001").collect()} for _ in range(2))
    assert one.keys() == two.keys() and all(abs(one[i] - two[i]) < 1e-6 for i in one)


def test_held_out_labels_do_not_matter(spark):
    sf = "/root/testdata/sf0.001"
    pages, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS string) AS binary)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality")
    a, b = (quality.train(pages, x)[1] for x in (labels, turned))
    assert np.allclose(a.first, b.first) and a.temperature == b.temperature


def test_odd_rows_and_labels(spark):
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, None), (5, 1), (None, 1)], "doc_id long, quality int")
    model = quality.train(docs(spark, ODD), labels)
    found = quality.scored(docs(spark, ODD), model).collect()
    assert len(found) == len(ODD) and all(0 <= r._score <= 1 for r in found)
    assert "target" in quality.scored(docs(spark, ODD), model).columns
    none = quality.train(docs(spark, ODD), labels.where("false"))
    assert {r._score for r in quality.scored(docs(spark, ODD), none).collect()} == {0.5}
    assert quality.scored(docs(spark, []), quality.train(docs(spark, []), labels)).count() == 0


def test_contexts_add_up_over_tasks(spark):
    texts = [(i, f"the cat {i % 5} sat on the mat, the cat") for i in range(60)]
    one = quality.word_vectors(docs(spark, texts).coalesce(1))
    many = quality.word_vectors(docs(spark, texts).repartition(7))
    assert np.allclose(one, many, atol=1e-5)


def test_temperature_calibrates():
    rng = np.random.default_rng(1)
    logits = rng.normal(0, 1, 20000)
    y = (rng.random(20000) < 1 / (1 + np.exp(-logits))).astype(float)
    assert abs(quality._temperature(3 * logits, y) - 3) < 0.3


def test_bounded_sample(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(500)], "doc_id long, quality int")
    data = docs(spark, [(i, "good text" if i % 2 else "### bad ###") for i in range(500)])
    model = quality.train(data, labels, max_rows=100)
    scores = {r.doc_id: r._score for r in quality.scored(data, model).collect()}
    assert all((scores[i] > 0.5) == bool(i % 2) for i in scores)


def test_rows_of_one_identifier_are_bounded(spark, monkeypatch):
    fitted = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, y: fitted.append(len(y)) or fit(x, y))
    one = next(i for i in range(9) if zlib.crc32(str(i).encode()) % 3 != 1)
    data = [(one, f"text{i} number of one") for i in range(300)] + [(one, "copy")] * 300
    labels = spark.createDataFrame([(one, 1)], "doc_id long, quality int")
    quality.train(docs(spark, data), labels, max_rows=2)
    quality.train(docs(spark, data), labels)
    assert fitted == [2, 301]


def test_vectors_against_a_plain_version(spark):
    """Context sums of every occurrence, scaled, plus the own index vector; a document is the mean over words and shapes."""
    texts = ["the Cat sat on 12 mats.", "the the cat ran", "", None, "x"]
    found = quality.word_vectors(docs(spark, list(enumerate(texts))))
    where, signs = quality.index_vectors()
    index = np.zeros((quality.WORDS + quality.SHAPES, quality.SIZE))
    np.put_along_axis(index, where, signs, axis=1)
    sums = np.zeros_like(index)
    for text in texts:
        for tokens in quality.places((text or "").encode()):
            for i, a in enumerate(tokens):
                for j in range(max(0, i - quality.REACH), min(len(tokens), i + quality.REACH + 1)):
                    if i != j:
                        sums[a] += index[tokens[j]]
    length = np.linalg.norm(sums, axis=1, keepdims=True)
    assert np.allclose(found, sums / np.maximum(length, 1) + index / np.sqrt(quality.ENTRIES), atol=1e-5)
    words, shapes = quality.places(texts[0].encode())
    assert np.allclose(quality.pooled(texts[0].encode(), found), np.concatenate([found[words].mean(axis=0), found[shapes].mean(axis=0)]), atol=1e-5)
