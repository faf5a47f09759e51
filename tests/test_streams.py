"""Arrivals as streams over small files."""

import datetime

import pytest

from terrashelf.operators import ranking
from terrashelf.streaming import arrivals
from tests.conftest import rows

DAY = datetime.datetime(2024, 1, 1)


def start(spark, path):
    known = [(5, "known@x.org", DAY, False, False)]
    spark.createDataFrame(known, "cust_id long, email string, signature_date timestamp_ntz, is_valid boolean, confirmed boolean") \
        .write.parquet(f"{path}/run=start/batch=-1")


def send(spark, path, emails):
    data = [(e, DAY + datetime.timedelta(minutes=i)) for i, e in enumerate(emails)]
    spark.createDataFrame(data, "email string, signature_date timestamp_ntz").coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp_path, reads):
    table, sent = f"{tmp_path}/table", f"{tmp_path}/sent"
    stream = spark.readStream.schema("email string, signature_date timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(sent)

    def read():
        reads.append(1)
        return spark.read.parquet(table)

    writer = arrivals.subscriber_writer(stream, read, table, run="r", parts=4)
    writer.option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    return rows(spark.read.parquet(table).select("cust_id", "email"))


def test_late_and_repeated_arrivals_and_a_restart(spark, tmp_path):
    start(spark, f"{tmp_path}/table")
    reads = []
    send(spark, f"{tmp_path}/sent", ["A@x.org ", "a@x.org", "known@x.org", "b@x.org", "no"])
    send(spark, f"{tmp_path}/sent", ["b@x.org", "c@x.org"])
    got = run(spark, tmp_path, reads)
    assert [e for _, e in got] == ["known@x.org", "a@x.org", "b@x.org", "c@x.org"] and [i for i, _ in got] == [5, 6, 7, 8]
    # Two batches, but the table was read once.
    assert len(reads) == 1
    # A batch whose commit was lost is repeated: it gives the same rows once more.
    commits = tmp_path / "check" / "commits"
    last = max(int(p.name) for p in commits.glob("[0-9]*"))
    (commits / str(last)).unlink(), (commits / f".{last}.crc").unlink()
    assert run(spark, tmp_path, reads) == got and len(reads) == 2
    send(spark, f"{tmp_path}/sent", ["a@x.org", "late@x.org"])
    assert run(spark, tmp_path, reads) == [*got, (9, "late@x.org")]


def test_a_batch_reads_only_the_partitions_it_hits(spark, tmp_path):
    known = arrivals.KnownKeys(f"{tmp_path}/t", [["a"], ["b"]], parts=16)
    spark.createDataFrame([(f"a{i}", f"b{i}", "s", -1) for i in range(300)], "a string, b string, run string, batch long").write.parquet(f"{tmp_path}/rows")
    known.store(spark.read.parquet(f"{tmp_path}/rows"))
    batch = spark.createDataFrame([("a1", "new")], "a string, b string")
    stored = known.read(known.sent(batch))
    assert stored.select("_part").distinct().count() <= 2
    files = lambda: set(r.path for r in spark.read.format("binaryFile").load(known.path).select("path").collect())
    before = files()
    known.add(stored, batch, "r", 0)
    assert len(before - files()) <= 2
    again = known.read(known.sent(batch))
    assert again.where("run = 'r'").count() == 2
    known.add(again, batch, "r", 0)
    assert known.read(known.sent(batch)).where("run = 'r'").count() == 2


@pytest.mark.parametrize("hot_rows", [10**6, 20])
def test_origins_are_written_once_and_their_keys_as_digests(spark, tmp_path, monkeypatch, hot_rows):
    """Known, repeated, hot and missing keys; the batch is not written beside the table, nor are the keys' texts."""
    monkeypatch.setattr(ranking, "HOT_ROWS", hot_rows)
    table, sent = f"{tmp_path}/table", f"{tmp_path}/sent"
    schema = "fhash string, fname string"
    spark.createDataFrame([("h1", "known")], schema).write.parquet(f"{table}/run=start/batch=-1")
    data = [("h1", "late"), ("h2", "first"), ("h2", "second"), (None, "a"), (None, "b")] + [("hot", f"f{i:02}") for i in range(50)]
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(sent)
    written = []
    monkeypatch.setattr(arrivals, "cut", lambda df: written.append(1) or df)
    arrivals.origin_writer(
        spark.readStream.schema(schema).parquet(sent), lambda: spark.read.parquet(table), table, [["fhash"]], run="r", parts=4,
    ).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.read.parquet(table).select("fhash", "fname")) == sorted(
        [("h1", "known"), ("h2", "first"), (None, "a"), (None, "b"), ("hot", "f00")], key=repr)
    assert not written
    assert dict(spark.read.parquet(f"{table}/_known_keys").dtypes)["v"] == "binary"


def test_digests_tell_parts_apart(spark):
    from terrashelf.operators.audit import key_digests

    data = [("a|", "b"), ("a", "|b"), ("1:a", ""), ("", "1:a"), ("a", None)]
    found = spark.createDataFrame(data, "x string, y string").selectExpr("x", "y").select(key_digests([["x", "y"]]).alias("d")).collect()
    values = [bytes(r.d[0].v) for r in found if r.d]
    assert len(set(values)) == len(values) == 4
