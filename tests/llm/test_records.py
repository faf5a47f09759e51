import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from terrashelf.llm import records
from terrashelf.session import scratch_path
from tests.llm.data import ODD, docs

TOKENIZER = Tokenizer.from_file(records.tokenizer_path())


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, records.END_ID]


def expected(data):
    start, found = 0, []
    for doc_id, text in sorted(data, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = ids_of(text)
        found.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return found


def test_round_trip(spark):
    data = [(2 * i, f"Text number {i}, {'word ' * (i % 9)}") for i in range(300)] + [(1, None), (3, ""), (5, " \n"), (7, "<|endoftext|> a \x01")]
    data += [(601, t) for _, t in ODD[6:7]]
    found = records.written(docs(spark, data)).collect()
    assert sorted(tuple(r) for r in found) == expected(data)


def test_repeated_and_missing_identifiers(spark):
    data = [(4, "same"), (4, "same"), (None, "none"), (1, "one")]
    found = sorted((tuple(r) for r in records.written(docs(spark, data)).collect()), key=lambda r: r[1])
    assert found == expected(data)


def test_index_points_at_records(spark):
    data = [(i, f"text {i} {'more ' * (i % 7)}") for i in range(200)]
    path = scratch_path(spark, "records-test")
    records.write_records(docs(spark, data), path)
    index = records.read_index(spark, path).collect()
    files = {r.path: bytes(r.content) for r in spark.read.format("binaryFile").load(f"{path}/records/part-*").collect()}
    by_shard = {int(p.rsplit("part-")[-1].split("-")[0]): c for p, c in files.items()}
    for r in random.Random(1).sample(index, 50):
        piece = by_shard[r.shard][r.offset : r.offset + r.bytes]
        (offset, size, payload), = records.frames_in(piece)
        doc_id, tokens = records.parsed(payload)
        assert (offset, size, doc_id) == (0, len(piece), r.doc_id) and tokens.tolist() == ids_of(dict(data)[r.doc_id])


@pytest.mark.parametrize("at", [0, 9, 14, 30, -3])
def test_damage_is_found(at):
    frame = bytearray(records.framed(records.payload_of(5, bytes(range(40)), 2)) + b"\n")
    assert len(list(records.frames_in(bytes(frame)))) == 1
    frame[at] ^= 4
    with pytest.raises(ValueError):
        list(records.frames_in(bytes(frame)))
    with pytest.raises(ValueError):
        list(records.frames_in(bytes(frame[:-1])))


def test_words_are_encoded_as_in_their_text():
    encoder = records.Encoder(records.tokenizer_path())
    signs = ["a", "B", "É", "é", "́", " ", "\n", "\x0b", "\x1c", " ", "'s", "'S", "don't", "<|endoftext|>", "<|", "<", "12", "İ",
             "ß", "Σ", "漢", "-", "$$", "\x00", "\x01", ",", "é.", "'", "_", "'ll", "²", "ৎ", "̸", "‍"]
    rng = random.Random(3)
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(14))) for _ in range(3000)]
    for i in range(0, len(texts), 100):
        got = encoder.encode([t.encode() for t in texts[i : i + 100]])
        assert [np.frombuffer(g, "<u2").tolist() for g in got] == [ids_of(t)[:-1] for t in texts[i : i + 100]]


def test_hot_identifiers_spread_over_shards(spark, monkeypatch):
    """A third of the rows have no identifier, a third are copies of one row."""
    data = [(None, f"null {i}") for i in range(400)] + [(7, "copy")] * 400 + [(1000 + i, f"text {i}") for i in range(400)]
    merge = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merge, "false")
    try:
        for size, least in ((records.SHARD_BYTES, 6), (400, 20)):
            monkeypatch.setattr(records, "SHARD_BYTES", size)
            path = scratch_path(spark, "records-test")
            records.write_records(docs(spark, data), path)
            index = records.read_index(spark, path).orderBy("shard", "place").collect()
            shards = [r.shard for r in index]
            assert len(set(shards)) >= least and max(map(shards.count, set(shards))) <= len(data) / 4
            assert [r.doc_id for r in index] == sorted((i for i, _ in data), key=lambda i: (i is None, i or 0))
            ends = [r.start + r.n_tokens for r in index]
            assert [r.start for r in index] == [0, *ends[:-1]] and ends[-1] == sum(len(ids_of(t)) for _, t in data)
    finally:
        spark.conf.unset(merge)


def test_empty(spark):
    assert records.written(docs(spark, [])).count() == 0


def test_long_neighbours_spread_over_files(spark, monkeypatch):
    monkeypatch.setattr(records, "PIECE_BYTES", 2000)
    monkeypatch.setattr(records, "PIECES", 2)
    data = [(i, f"long text {i} " * (900 if 20 <= i < 60 else 3)) for i in range(90)] + [(None, "end")]
    path = scratch_path(spark, "records-long")
    records.write_records(docs(spark, data).coalesce(1), path)
    files = spark.read.format("binaryFile").load(f"{path}/records/part-*").select("length").collect()
    assert len(files) >= 20 and max(r.length for r in files) < 20_000
    found = sorted((tuple(r) for r in records.written(docs(spark, data)).collect()), key=lambda r: r[1])
    assert found == expected(data)


def test_files_of_one_task_are_told_apart_whatever_the_writes_name(spark):
    name = "file:/x/records/part-00002-7f3e1a52-c149-4a0b-8f00-c23a4b5c6d7e-c{:03d}.txt"
    paths = spark.createDataFrame([(name.format(i),) for i in range(3)], "path string")
    assert [r.shard for r in paths.select("path", records._shard()).orderBy("path").collect()] == [2 + records.FILES * i for i in range(3)]


def test_words_of_letters_as_the_file_has_them():
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéèêñçœæøåšžřőű"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 14))) for _ in range(5000)]
    words += ["Straße", "ÉCOLE", "İstanbul", "ŉ", "\u212a", "\u212b", "ſo", "Ǆ", "ΣΑΣ", "été", "x" * 900, "naïve", "i"]
    encoder = records.Encoder.of(records.tokenizer_path())
    got = encoder.encode([w.encode() for w in words])
    assert [np.frombuffer(g, encoder.kind).tolist() for g in got] == [ids_of(w)[:-1] for w in words]
