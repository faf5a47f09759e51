import base64
import hashlib

import pytest

from terrashelf.llm import warc
from terrashelf.session import scratch_path
from tests.conftest import rows

PAGES = [
    (1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (3, None, None), (4, "u\r\nX: y", ""), (5, "http://é", "é\r\n\r\nz"),
    (5, "http://é", "é\r\n\r\nz"), (None, "n", "<p>x</p>"), (6, "l", "long " * 30000),
]


@pytest.fixture(scope="module")
def archive(spark):
    path = scratch_path(spark, "warc-test")
    warc.write_archive(spark.createDataFrame(PAGES, "page_id long, url string, html string"), path)
    return path


def test_index(spark, archive):
    facts = lambda t: (len(t.encode()), base64.b32encode(hashlib.sha1(t.encode()).digest()).decode())
    want = [
        (1, *facts("<p>x</p>"), "revisit", 2), (2, *facts("<p>x</p>"), "response", None), (3, *facts(""), "revisit", 4),
        (4, *facts(""), "response", None), (5, *facts("é\r\n\r\nz"), "response", None), (5, *facts("é\r\n\r\nz"), "revisit", 5),
        (None, *facts("<p>x</p>"), "revisit", 2), (6, *facts("long " * 30000), "response", None),
    ]
    assert rows(warc.read_index(spark, archive).drop("target_uri")) == sorted(want, key=repr)


def test_payloads_are_stored_once(spark, archive):
    assert spark.read.parquet(f"{archive}/payloads").count() == 4


def test_records_and_pages_are_whole(spark, archive):
    for r in warc.records(spark, archive).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and rest.endswith(b"\r\n\r\n")
        assert len(rest) - 4 == int(fields[b"Content-Length"])
    found = sorted(r.payload for r in warc.pages_of(spark, archive).collect())
    assert found == sorted(html or "" for _, _, html in PAGES)


def test_export(spark, archive, tmp_path):
    warc.export_warc(spark, archive, str(tmp_path / "out"))
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    whole = [bytes(r.record) for r in warc.records(spark, archive).collect()]
    assert len(data) == sum(map(len, whole)) and all(w in data for w in whole)


def test_changed_payload_is_an_error(spark, archive):
    path = scratch_path(spark, "warc-bad")
    spark.read.parquet(f"{archive}/headers").write.parquet(f"{path}/headers")
    spark.read.parquet(f"{archive}/payloads").selectExpr("address", "payload || '!' AS payload").write.parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="payload is not what"):
        warc.read_index(spark, path).collect()


def test_small_payloads_are_all_responses_and_empty(spark):
    path = scratch_path(spark, "warc-small")
    warc.write_archive(spark.createDataFrame(PAGES, "page_id long, url string, html string"), path, least_bytes=1)
    assert {r.record_type for r in warc.read_index(spark, path).where("payload_bytes = 0").collect()} == {"response"}
    path = scratch_path(spark, "warc-empty")
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_index(spark, path).count() == 0
