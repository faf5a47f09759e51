"""Sources and sinks over small files."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from terrashelf import schemas
from terrashelf.plans import refresh
from terrashelf.sinks import writers
from terrashelf.sources import csvfiles, files, geojson, tableexport
from tests.conftest import rows
from workload import files as workload_files


def test_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"Via", Nome ,NUM\n1,2,3\n')
    (tmp_path / "b.csv").write_text("NUM,VIA\n1,2\n")
    (tmp_path / "c.csv").write_text('"x,y",via\n')
    found = csvfiles.csv_headers(spark, str(tmp_path), lower=True).withColumn("file", F.regexp_extract("file", r"([a-z])\.csv$", 1))
    assert rows(found) == [
        ("a", "nome", 1), ("a", "num", 2), ("a", "via", 0), ("b", "num", 0), ("b", "via", 1), ("c", "via", 2), ("c", "x", 0), ("c", "y", 1),
    ]
    assert rows(csvfiles.header_positions(found, ["num", "via"])) == [("a", [2, 0]), ("b", [0, 1]), ("c", [None, 2])]
    assert ("via", 3, 0, 2) in rows(csvfiles.header_drift(found))
    one_based = csvfiles.csv_headers(spark, str(tmp_path / "b.csv"), zero_based=False)
    assert rows(one_based.select("column", "position")) == [("NUM", 1), ("VIA", 2)]


def test_load_csv(spark, tmp_path):
    path = tmp_path / "br-donor.csv"
    path.write_text(
        "id,escopo,shortName,vat_id,legalName,wikidata_id,url\n1,BR,A,v,\"N, m\",5,u\nx,BR,B,v,M,,\n2,BR,C\n"
    )
    loaded = csvfiles.load_csv(spark, str(path), schemas.DONOR_FILE)
    good = csvfiles.good_rows(loaded)
    assert rows(good.select("id", "legalName", "wikidata_id")) == [(1, "N, m", 5)]
    # A line is judged by all its fields, whatever a query reads.
    assert good.count() == 1
    assert loaded.where("_bad_record IS NOT NULL").count() == 2
    wrong = tmp_path / "wrong.csv"
    wrong.write_text("id,scope\n1,BR\n")
    with pytest.raises(Exception):
        csvfiles.load_csv(spark, str(wrong), schemas.DONOR_FILE).collect()


def test_quoted_line_breaks(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id,t,u\n1,"two\nlines",x\n2,plain,\n3,"say ""hi""",y\n4,short\n5,a,b,c\n')
    whole = csvfiles.load_csv(spark, str(path), "id INT, t STRING, u STRING")
    assert rows(csvfiles.good_rows(whole)) == [(1, "two\nlines", "x"), (2, "plain", None), (3, 'say "hi"', "y")]
    lines = csvfiles.load_csv(spark, str(path), "id INT, t STRING, u STRING", multi_line=False)
    assert rows(csvfiles.good_rows(lines)) == [(2, "plain", None), (3, 'say "hi"', "y")]
    bad = {r[0] for r in lines.where("_bad_record IS NOT NULL").select("_bad_record").collect()}
    assert bad == {'1,"two', 'lines",x', "4,short", "5,a,b,c"}
    with pytest.raises(ValueError):
        csvfiles.load_csv(spark, str(path), "id INT, t STRING", multi_line=False)


def test_wide_header(spark, tmp_path):
    names = [f"column_number_{i}" for i in range(1000)]
    (tmp_path / "w.csv").write_text(",".join(names) + "\n" + ",".join("1" for _ in names) + "\n")
    found = csvfiles.csv_headers(spark, str(tmp_path / "w.csv")).orderBy("position")
    assert [r.column for r in found.collect()] == names


def test_manifest_and_documents(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"a": 1}')
    (tmp_path / "bad.json").write_text("{a")
    (tmp_path / "empty.json").write_text("")
    found = files.file_manifest(spark, f"{tmp_path}/*.json", "md5")
    assert sorted(r["size"] for r in found.collect()) == [0, 2, 8]
    times = {r["path"].rsplit("/")[-1]: r["modification"].timestamp() for r in found.collect()}
    assert all(abs(times[n] - (tmp_path / n).stat().st_mtime) < 0.01 for n in ("good.json", "bad.json", "empty.json"))
    docs = files.json_documents(spark, f"{tmp_path}/*.json")
    assert docs.where("large_text IS NOT NULL").count() == 0
    shown = docs.select(F.regexp_extract("path", r"(\w+)\.json$", 1), F.to_json("document"), "error")
    assert rows(shown) == [("bad", None, "not JSON"), ("empty", None, "not JSON"), ("good", '{"a":1}', None)]
    with pytest.raises(Exception):
        files.json_documents(spark, f"{tmp_path}/none.json").collect()
    both = [f"{tmp_path}/none.json", f"{tmp_path}/good.json"]
    assert files.json_documents(spark, both, missing_ok=True).count() == 1
    assert files.json_documents(spark, f"{tmp_path}/none.json", missing_ok=True).count() == 0


def test_geojson(spark, tmp_path):
    point = {"type": "Point", "coordinates": [1, 2]}
    features = [
        {"type": "Feature", "name": "out", "properties": {"name": "in"}, "geometry": point},
        {"type": "Feature", "name": "out", "properties": {"x": 1}, "geometry": point},
        {"type": "Feature", "properties": {"x": 2}, "geometry": None},
    ]
    crs = {"type": "name"}
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "crs": crs, "features": features}, indent=1))
    found = geojson.geojson_features(spark, str(tmp_path / "a.geojson")).orderBy("feature_id").collect()
    assert [r.feature_id for r in found] == [1, 2, 3]
    assert [json.loads(r.properties) for r in found] == [{"name": "in"}, {"name": "out", "x": 1}, {"name": None, "x": 2}]
    assert json.loads(found[0].geometry) == {"crs": crs, **point} and found[2].geometry is None
    header = geojson.geojson_headers(spark, str(tmp_path / "a.geojson")).first()
    assert json.loads(header.header) == {"type": "FeatureCollection", "crs": crs}
    ids = spark.createDataFrame([(str(tmp_path / "a.geojson"), 42)], "path string, file_id int")
    by_id = geojson.geojson_features_jgeom(spark, str(tmp_path), ids).orderBy("feature_id").collect()
    assert [(r.file_id, r.feature_id, json.loads(r.properties)) for r in by_id] == [
        (42, 1, {"name": "in"}), (42, 2, {"x": 1}), (42, 3, {"x": 2})
    ]
    (tmp_path / "b.geojsonl").write_text("\n".join(json.dumps(f) for f in features))
    lines = geojson.geojson_lines(spark, str(tmp_path / "b.geojsonl"))
    assert rows(lines.select("feature_id", "properties")) == [(1, '{"name":"in"}'), (2, '{"name":"out","x":1}'), (3, '{"name":null,"x":2}')]


def test_geojson_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "a.geojson").write_text('{"type": "FeatureCollection", "features": [')
    (tmp_path / "b.geojson").write_text('{"type": "FeatureCollection", "features": [], "n": 1.10}')
    (tmp_path / "c.geojson").write_text('{"type": "FeatureCollection", "features": [{"type": "Feature"}, 7]}')
    (tmp_path / "d.geojson").write_text('{"type": "Topology"}')
    name = F.regexp_extract("file", r"(\w)\.geojson$", 1).alias("name")
    found = geojson.geojson_features(spark, f"{tmp_path}/*.geojson").select(name, "feature_id", "error")
    assert rows(found) == [
        ("a", None, "not a JSON object"), ("c", 1, None), ("c", 2, "feature is no JSON object"), ("d", None, "no list of features"),
    ]
    heads = geojson.geojson_headers(spark, f"{tmp_path}/*.geojson").select(name, "header", "error")
    assert rows(heads)[:2] == [("a", None, "not a JSON object"), ("b", '{"type":"FeatureCollection","n":1.1}', None)]


def test_table_export(spark, tmp_path):
    point = "0101000020E6100000000000000000F03F0000000000000040"
    plain = "0101000000000000000000F03F0000000000000040"
    (tmp_path / "t.tsv").write_text(
        f"CO-A\tC\t8U\t\\N\tt\t{point}\nCO-B\t\\N\t\"9\t{{H,\"G\"}}\tf\t{plain}\n".replace('"G"', "G").replace('"9', "9")
    )
    got = tableexport.crosswalk_rows(tableexport.load_tsv_export(spark, str(tmp_path / "t.tsv"), schemas.CROSSWALK))
    assert rows(got.select("isolabel_ext", "subprefix", "prefix", "subcells", "is_subdiv_default", "srid", F.hex("wkb"))) == [
        ("CO-A", "C", "8U", None, True, 4326, plain), ("CO-B", None, "9", ["H", "G"], False, None, plain),
    ]


def test_export_names():
    assert writers.export_path("donor", "/io/") == "/io/donor.csv"
    assert writers.export_path("donor.txt", "/io") == "/io/donor.txt"
    assert writers.export_path("/a/b", "/io") == "/a/b.csv"


@pytest.mark.parametrize("properties, fid, name, title, want", [
    ('{"x":1}', "7", "n", "t", {"properties": {"x": 1}, "id": 7, "name": "n", "title": "t"}),
    ("[1]", None, None, None, {}),
    (None, "7", 'say "x"', None, {"id": 7, "name": 'say "x"'}),
])
def test_geojson_feature(spark, properties, fid, name, title, want):
    geometry = '{"type":"LineString","coordinates":[[1.00000049,2],[-3.9999996,0.1234565]]}'
    text = lambda v: F.lit(v).cast("string")
    made = spark.range(1).select(
        writers.geojson_feature(F.lit(geometry), text(properties), text(fid), text(name), text(title), id_as_int=True)
    ).first()[0]
    assert json.loads(made) == {"type": "LineString", "coordinates": [[1, 2], [-4, 0.123457]], **want}
    as_text = spark.range(1).select(
        writers.geojson_feature(F.lit(geometry), text(None), text("7"), text(None), text(None))
    ).first()[0]
    assert json.loads(as_text)["id"] == "7"


def test_refresh(spark, tmp_path):
    def empty(ddl):
        return spark.createDataFrame([], ddl)

    (tmp_path / "j").mkdir(), (tmp_path / "d").mkdir(), (tmp_path / "p").mkdir()
    (tmp_path / "j" / "a.csv").write_text(
        "osm_id,jurisd_base_id,jurisd_local_id,parent_id,admin_level,name,parent_abbrev,abbrev,wikidata_id,lexlabel,isolabel_ext,ddd,info\n"
        "1,76,0,,2,brasil,INT,BR,155,brasil,BR,,\n2,76,35,1,4,sp,BR,SP,174,sp,BR-SP,11,\n3,76,36,1,4,sp,BR,XX,175,sq,BR-XX,,\n"
    )
    (tmp_path / "d" / "a.csv").write_text("id,escopo,shortName,vat_id,legalName,wikidata_id,url\n1,BR,A,CNPJ:1-2,Name,5,u\n")
    (tmp_path / "p" / "a.csv").write_text(
        "pack_id,donor_id,donor_label,user_resp,accepted_date,escopo,about,author,contentReferenceTime,license_is_explicit,license,"
        "uri_objType,uri,isAt_UrbiGIS\n5,1,A,maria,2022-01-05,BR,about,me,2021,No,CC0,zip,u,\n"
    )
    now = {
        "jurisdiction": empty(schemas.JURISDICTION), "donor": empty(schemas.DONOR), "donatedPack": empty(schemas.PACK),
    }
    sent = {"jurisdiction": str(tmp_path / "j"), "donor": str(tmp_path / "d"), "donatedPack": str(tmp_path / "p")}
    new = refresh.refresh(spark, now, sent)
    assert rows(refresh.outcome_table(new)) == [("donatedPack", "inserted", 1), ("donor", "inserted", 1), ("jurisdiction", "inserted", 2)]
    assert new["donor"].first().kx_vat_id == "cnpj:12"
    info = json.loads(new["donatedPack"].first().info)
    assert info["license_is_explicit"] is False and info["isAt_UrbiGIS"] is None and info["author"] == "me"
    assert refresh.key_conflicts(new).count() == 0
    again = refresh.refresh(spark, {k: v.drop("action") for k, v in new.items()}, sent, do_update=True)
    assert rows(refresh.outcome_table(again)) == [("donatedPack", "updated", 1), ("donor", "updated", 1), ("jurisdiction", "kept", 2)]


def test_headers_read_no_further_than_they_go(spark, tmp_path, monkeypatch):
    (tmp_path / "a b.csv").write_bytes(b"\xef\xbb\xbfx,y\r\n" + b"1,2\r\n" * 1000)
    (tmp_path / "c.csv").write_text("only,header")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "z.csv.gz").write_bytes(gzip.compress(b"packed,second\n1,2\n"))
    read = lambda: rows(csvfiles.csv_headers(spark, str(tmp_path)).select("column", "position"))
    want = [("header", 1), ("only", 0), ("packed", 0), ("second", 1), ("x", 0), ("y", 1)]
    assert read() == want
    monkeypatch.setattr(csvfiles, "is_mounted", lambda *_: False)
    assert read() == want


def test_small_files_are_written_by_many_tasks(spark):
    grouped = spark.range(400).groupBy((F.col("id") % 40).alias("bucket")).agg(F.max("id").cast("string").alias("value"))
    path = workload_files._write_texts(grouped, "spread", "value")
    written = spark.read.text(path).select("value", "bucket", F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).alias("task")).collect()
    assert sorted((int(r["value"]), r["bucket"]) for r in written) == [(360 + i, i) for i in range(40)]
    assert len({r["task"] for r in written}) >= 4


def _small_texts(spark):
    data = [(i % 30, f"line {i} é\r" if i % 7 else None) for i in range(300)] + [(None, "no bucket"), (5, "two\nlines")]
    return spark.createDataFrame(data, "bucket long, value string").repartition(3, "bucket").sortWithinPartitions("bucket", "value")


def test_texts_are_written_by_the_tasks(spark, tmp_path, monkeypatch):
    df, read = _small_texts(spark), lambda at: {p.parent.name: p.read_bytes() for p in (tmp_path / at).glob("bucket=*/part-*.txt")}
    writers.write_texts(df, str(tmp_path / "own"))
    df.write.partitionBy("bucket").text(str(tmp_path / "spark"))
    assert read("own") == read("spark") and len(read("own")) == 31
    # Spark's writer leaves a checksum beside each file; here nothing but the files is left.
    assert len([p for p in (tmp_path / "own").rglob("*") if p.is_file()]) == 31
    monkeypatch.setattr(writers, "mount_point", lambda *_: None)
    writers.write_texts(df, str(tmp_path / "store"))
    assert read("store") == read("spark")


def test_files_are_listed_by_few_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "LISTING_TASKS", 1)
    writers.write_texts(_small_texts(spark), str(tmp_path / "texts"))
    tracker, group = spark.sparkContext.statusTracker(), str(tmp_path)
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.threshold", 2)
    spark.sparkContext.setJobGroup(group, "listing")
    try:
        found = files.file_manifest(spark, f"{tmp_path}/texts/bucket=*/*.txt", "md5")
    finally:
        spark.conf.unset("spark.sql.sources.parallelPartitionDiscovery.threshold")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    assert tasks and max(tasks) <= spark.sparkContext.defaultParallelism < 31
    assert found.count() == 31 and spark.conf.get(files._LISTING, None) is None
