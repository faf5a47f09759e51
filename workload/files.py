"""File sources and sinks: deliveries written from the tables into the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrashelf import schemas
from terrashelf.plans import catalogue
from terrashelf.session import scratch_path
from terrashelf.sinks import writers
from terrashelf.sources import csvfiles, files, geojson, jsonparts, tableexport
from workload import reports, tables
from workload.tables import read, with_tables

PER_FILE = 50


def _text(name: str):
    return F.col(name).cast("string")


def _write_texts(df, label: str, order: str, spread: bool = True) -> str:
    """One file per bucket of at most fifty rows, lines in ``order``; gives the folder.

    Small files cost far more than their bytes. ``spread`` gives the number of tasks, as adaptive execution counts bytes and
    would leave all files to one or two; and deals by a hash of the bucket, as rows grouped by bucket would not be dealt again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(tasks, F.xxhash64("bucket")) if spread else df.repartition("bucket")
    writers.write_texts(dealt.sortWithinPartitions("bucket", order), path)
    return path


def _bucket_of(path: str = "path"):
    return F.regexp_extract(path, r"/bucket=([0-9]+)/", 1).cast("long").alias("bucket")


def _pack_delivery(spark, sf_dir) -> str:
    """Packs as a CSV delivery; every 97th line has a pack number that is none."""
    i = F.col("o_orderkey")
    path = scratch_path(spark, "packs")
    null = F.lit(None).cast("string")
    read(spark, sf_dir, "orders").select(
        F.when(i % 97 == 5, F.concat(F.lit("x"), _text("o_orderkey"))).otherwise(_text("o_orderkey")).alias("pack_id"),
        F.col("o_custkey").alias("donor_id"), F.concat(F.lit('Say "'), _text("o_custkey"), F.lit('",\ntwice')).alias("donor_label"),
        F.col("o_orderpriority").alias("user_resp"), F.col("o_orderdate").cast("date").alias("accepted_date"),
        F.col("o_orderstatus").alias("escopo"), null.alias("about"), null.alias("author"),
        F.lit("2022").alias("contentReferenceTime"), F.lit("yes").alias("license_is_explicit"), F.lit("CC0").alias("license"),
        F.lit("zip").alias("uri_objType"), null.alias("uri"), F.lit("no").alias("isAt_UrbiGIS"),
    ).write.option("header", True).option("escape", '"').csv(path)
    return path


def load_declared_csv(spark, sf_dir):
    loaded = csvfiles.load_csv(spark, _pack_delivery(spark, sf_dir), schemas.PACK_FILE)
    return csvfiles.good_rows(loaded).select(
        "pack_id", "donor_id", "donor_label", "user_resp", "accepted_date", "escopo", "about", "license_is_explicit"
    )


def bad_csv_records(spark, sf_dir):
    loaded = csvfiles.load_csv(spark, _pack_delivery(spark, sf_dir), schemas.PACK_FILE)
    bad = loaded.where(F.col(csvfiles.BAD).isNotNull())
    return bad.select("donor_id", "donor_label", F.col("pack_id").isNull().alias("no_pack_id"))


def _header_delivery(spark, sf_dir) -> str:
    """Customers in files of a hundred; headers of odd files are quoted, upper case, turned and one shorter."""
    rows = read(spark, sf_dir, "customer").withColumn("bucket", F.floor(F.col("c_custkey") / 100)).repartition("bucket")
    path = scratch_path(spark, "headers")
    rows.where("bucket % 2 = 0").select("bucket", "c_custkey", "c_name", "c_mktsegment").write.partitionBy("bucket").option(
        "header", True
    ).csv(path)
    rows.where("bucket % 2 = 1").select(
        "bucket", F.col("c_mktsegment").alias(" C_MKTSEGMENT "), F.col("c_custkey").alias("C_CUSTKEY")
    ).write.mode("append").partitionBy("bucket").option("header", True).option("quoteAll", True).csv(path)
    return path


def _headers(spark, sf_dir):
    found = csvfiles.csv_headers(spark, f"{_header_delivery(spark, sf_dir)}/bucket=*/*.csv", lower=True)
    return found.withColumn("file", F.regexp_extract("file", r"/(bucket=[0-9]+)/", 1))


def csv_header_inventory(spark, sf_dir):
    return _headers(spark, sf_dir)


def csv_header_drift(spark, sf_dir):
    return csvfiles.header_drift(_headers(spark, sf_dir))


def csv_header_positions(spark, sf_dir):
    found = csvfiles.header_positions(_headers(spark, sf_dir), ["c_name", "c_mktsegment", "c_custkey", "c_phone"])
    return found.select("file", F.array_join("positions", ",", "null").alias("positions"))


def file_manifest(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(
        F.floor(F.col("doc_id") / PER_FILE).alias("bucket"), "doc_id", F.col("text").alias("value")
    )
    path = _write_texts(docs, "manifest", "doc_id", spread=False)
    return files.file_manifest(spark, f"{path}/bucket=*/*.txt", "md5").select(_bucket_of(), "size", "hash")


def _json_delivery(spark, sf_dir) -> str:
    """One JSON document per fifty customers; every fifth is cut short."""
    docs = read(spark, sf_dir, "customer").groupBy(F.floor(F.col("c_custkey") / PER_FILE).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("first")
    )
    text = F.concat(F.lit('{"first":'), _text("first"), F.lit(',"n":'), _text("n"))
    whole = F.when(F.col("bucket") % 5 == 4, text).otherwise(F.concat(text, F.lit(',"tags":[1,null]}')))
    return _write_texts(docs.select("bucket", "first", whole.alias("value")), "json", "first")


def json_documents(spark, sf_dir):
    found = files.json_documents(spark, f"{_json_delivery(spark, sf_dir)}/bucket=*/*.txt", "sha256")
    return found.select(
        _bucket_of(), "size", "hash", F.to_json("document").alias("document"), "error"
    )


def _geojson_delivery(spark, sf_dir) -> str:
    """Customers as point features in collections of fifty: names inside, outside, both or missing."""
    i = F.col("c_custkey")
    inner = F.when(i % 4 >= 2, F.concat(F.lit(',"name":"in '), _text("c_custkey"), F.lit('"'))).otherwise("")
    outer = F.when(i % 2 == 1, F.concat(F.lit(',"name":"out '), _text("c_custkey"), F.lit('"'))).otherwise("")
    feature = F.concat(
        F.lit('{"type":"Feature"'), outer, F.lit(',"properties":{"segment":"'), F.col("c_mktsegment"), F.lit('"'), inner,
        F.lit('},"geometry":{"type":"Point","coordinates":['), _text("c_nationkey"), F.lit(","), (i % 90).cast("string"), F.lit("]}}"),
    )
    bucket = F.floor(i / PER_FILE)
    crs = F.when(F.col("bucket") % 2 == 0, '"crs":{"type":"name","properties":{"name":"EPSG:4326"}},').otherwise("")
    docs = read(spark, sf_dir, "customer").select(bucket.alias("bucket"), "c_custkey", feature.alias("f")).groupBy("bucket").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "f"))), lambda x: x["f"]), ",\n").alias("fs")
    )
    value = F.concat(F.lit('{"type":"FeatureCollection","name":"part '), _text("bucket"), F.lit('",'), crs, F.lit('"features":['), "fs", F.lit("]}"))
    return _write_texts(docs.select("bucket", value.alias("value")), "geojson", "value")


def geojson_headers(spark, sf_dir):
    found = geojson.geojson_headers(spark, f"{_geojson_delivery(spark, sf_dir)}/bucket=*/*.txt")
    return found.select(_bucket_of("file"), "header")


def geojson_features(spark, sf_dir):
    found = geojson.geojson_features(spark, f"{_geojson_delivery(spark, sf_dir)}/bucket=*/*.txt")
    return found.select(_bucket_of("file"), "feature_id", "geojson_type", "feature_type", "properties", "geometry")


def geojson_features_by_file_id(spark, sf_dir):
    path = f"{_geojson_delivery(spark, sf_dir)}/bucket=*/*.txt"
    listed = files.file_manifest(spark, path).select("path", (_bucket_of() * 10 + 7).alias("file_id"))
    found = geojson.geojson_features_jgeom(spark, path, listed)
    return found.select("file_id", "feature_id", "feature_type", "properties", "jgeom")


def json_values(spark, sf_dir):
    """The same collections as large documents: a row a member, or an element of a member that is an array."""
    found = jsonparts.json_values(spark, f"{_geojson_delivery(spark, sf_dir)}/bucket=*/*.txt")
    part = lambda path: F.expr(f"try_variant_get(value, '{path}', 'string')")
    shown = F.coalesce(part("$.properties.segment"), part("$.properties.name"), part("$"))
    return found.select(_bucket_of("file"), "name", "position", shown.alias("shown"), "error")


def geojson_lines(spark, sf_dir):
    """Customers as features, one a line; every 60th line is cut short."""
    i = F.col("c_custkey")
    feature = F.concat(
        F.lit('{"type":"Feature","name":"n'), _text("c_custkey"), F.lit('","properties":{"segment":"'), F.col("c_mktsegment"),
        F.lit('"},"geometry":{"type":"Point","coordinates":[1.10,'), (i % 90).cast("string"), F.lit("]}"),
    )
    rows = read(spark, sf_dir, "customer").select(
        F.floor(i / PER_FILE).alias("bucket"), "c_custkey", F.when(i % 60 == 7, feature).otherwise(F.concat(feature, F.lit("}"))).alias("value")
    )
    found = geojson.geojson_lines(spark, f"{_write_texts(rows, 'lines', 'c_custkey')}/bucket=*/*.txt")
    return found.select(_bucket_of("file"), "feature_id", "feature_type", "properties", "error")


def table_export_rows(spark, sf_dir):
    """A crosswalk of suppliers as a tab-separated export with arrays, flags and geometry, read again."""
    i = F.col("s_suppkey")
    point = F.when(i % 3 == 0, F.concat(F.lit("0101000000"), F.upper(F.md5("s_name")))).otherwise(
        F.concat(F.lit("0101000020E6100000"), F.upper(F.md5("s_name")))
    )
    line = F.concat_ws(
        "\t", F.concat(F.lit("CO-ANT-Town"), _text("s_suppkey")), F.when(i % 4 == 0, "\\N").otherwise("C"),
        F.substring(F.md5("s_name"), 1, 3),
        F.when(i % 2 == 0, "\\N").when(i % 5 == 0, "{}").otherwise(F.concat(F.lit("{H,"), (i % 10).cast("string"), F.lit("}"))),
        F.when(i % 3 == 1, "t").otherwise("f"), point,
    )
    path = scratch_path(spark, "export")
    read(spark, sf_dir, "supplier").select(line.alias("value")).write.text(path)
    rows = tableexport.crosswalk_rows(tableexport.load_tsv_export(spark, path, schemas.CROSSWALK))
    return rows.select(
        "isolabel_ext", "subprefix", "prefix", F.array_join("subcells", ";").alias("subcells"), "is_subdiv_default",
        F.coalesce("srid", F.lit(0)).alias("srid"), F.hex("wkb").alias("wkb"),
    )


def csv_export(spark, sf_dir):
    """The donor table through the CSV export and back."""
    donor = tables.donor(spark, sf_dir).select("id", "scope", "shortname", "vat_id", "legalname", "wikidata_id", "url", "info", "kx_vat_id")
    path = writers.export_csv(donor, "donor", scratch_path(spark, "csv"))
    back = csvfiles.good_rows(csvfiles.load_csv(spark, path, schemas.DONOR))
    return back.drop("info")


def geojson_feature_export(spark, sf_dir):
    i = F.col("c_custkey")
    geometry = F.concat(
        F.lit('{"type":"Point","coordinates":['), _text("c_nationkey"), F.lit(".12345678,-"), (i % 90).cast("string"), F.lit(".5]}")
    )
    properties = F.when(i % 4 == 0, F.concat(F.lit('{"segment":"'), F.col("c_mktsegment"), F.lit('"}'))).when(i % 4 == 1, "[1]")
    identity = F.when(i % 3 != 0, _text("c_custkey"))
    name = F.when(i % 5 != 0, F.concat(F.lit('the "'), F.col("c_name"), F.lit('"')))
    title = F.when(i % 7 == 0, F.col("c_name"))
    rows = read(spark, sf_dir, "customer").select(
        "c_custkey", writers.geojson_feature(geometry, properties, identity, name, title, id_as_int=True).alias("value")
    )
    path = scratch_path(spark, "features")
    rows.select("value").write.text(path)
    return spark.read.text(path).select(F.col("value").alias("feature"))


def answer_formats(spark, sf_dir):
    """The donors with their totals as JSON and as CSV, read back from both."""
    totals = catalogue.donors_with_totals(tables.donor(spark, sf_dir), reports._base(spark, sf_dir)).select("id", "legalname", "kx")
    as_json, as_csv = scratch_path(spark, "json"), scratch_path(spark, "csv")
    writers.write_answer(totals, as_json, "json")
    writers.write_answer(totals, as_csv, "csv")
    from_json = spark.read.schema(totals.schema).json(as_json).select(
        F.lit("json").alias("format"), "id", "legalname", F.to_json("kx").alias("kx")
    )
    from_csv = csvfiles.good_rows(csvfiles.load_csv(spark, as_csv, "id BIGINT, legalname STRING, kx STRING"))
    return from_json.unionByName(from_csv.select(F.lit("csv").alias("format"), "id", "legalname", "kx"))


QUERIES = {
    f.__name__: f
    for f in (
        load_declared_csv, bad_csv_records, csv_header_inventory, csv_header_drift, csv_header_positions, file_manifest,
        json_documents, json_values, geojson_headers, geojson_features, geojson_lines,
        geojson_features_by_file_id, table_export_rows, csv_export,
        geojson_feature_export, answer_formats,
    )
}

_HEADS = """
    SELECT file, column_ AS "column", CAST(position_ AS INTEGER) AS "position" FROM (
        SELECT DISTINCT 'bucket=' || c_custkey // 100 AS file, c_custkey // 100 % 2 = 1 AS odd FROM customer) f
    JOIN (VALUES (FALSE, 'c_custkey', 0), (FALSE, 'c_name', 1), (FALSE, 'c_mktsegment', 2), (TRUE, 'c_mktsegment', 0),
                 (TRUE, 'c_custkey', 1)) AS h(odd_, column_, position_) ON odd = odd_"""
_NAME = """CASE WHEN c_custkey % 4 >= 2 THEN '"in ' || c_custkey || '"' WHEN c_custkey % 2 = 1 THEN '"out ' || c_custkey || '"'
    ELSE 'null' END"""
_POINT = """'"coordinates":[' || c_nationkey || ',' || c_custkey % 90 || '],"type":"Point"}'"""
_CRS = """CASE WHEN c_custkey // 50 % 2 = 0 THEN '{"properties":{"name":"EPSG:4326"},"type":"name"}' ELSE 'null' END"""
_NTH = "CAST(row_number() OVER (PARTITION BY c_custkey // 50 ORDER BY c_custkey) AS INTEGER)"

ORACLE = {
    "load_declared_csv": """
        SELECT o_orderkey AS pack_id, o_custkey AS donor_id, 'Say "' || o_custkey || '",' || chr(10) || 'twice' AS donor_label,
               o_orderpriority AS user_resp, CAST(o_orderdate AS DATE) AS accepted_date, o_orderstatus AS escopo,
               CAST(NULL AS VARCHAR) AS about, 'yes' AS license_is_explicit
        FROM orders WHERE o_orderkey % 97 <> 5""",
    "bad_csv_records": """
        SELECT o_custkey AS donor_id, 'Say "' || o_custkey || '",' || chr(10) || 'twice' AS donor_label, TRUE AS no_pack_id FROM orders
        WHERE o_orderkey % 97 = 5""",
    "csv_header_inventory": _HEADS,
    "csv_header_drift": f"""
        SELECT "column", count(DISTINCT file) AS n_files, min("position") AS min_position, max("position") AS max_position
        FROM ({_HEADS}) GROUP BY 1""",
    "csv_header_positions": """
        SELECT DISTINCT 'bucket=' || c_custkey // 100 AS file, CASE c_custkey // 100 % 2 WHEN 0 THEN '1,2,0,null' ELSE 'null,0,1,null'
            END AS positions FROM customer""",
    "file_manifest": """
        SELECT doc_id // 50 AS bucket, CAST(sum(strlen(text) + 1) AS BIGINT) AS size,
               md5(string_agg(text || chr(10), '' ORDER BY doc_id)) AS hash
        FROM documents GROUP BY 1""",
    "json_documents": """
        SELECT bucket, CAST(strlen(t) + 1 AS BIGINT) AS size, sha256(t || chr(10)) AS hash, CASE WHEN bucket % 5 <> 4 THEN t END AS document,
               CASE WHEN bucket % 5 = 4 THEN 'not JSON' END AS error
        FROM (SELECT c_custkey // 50 AS bucket, '{"first":' || min(c_custkey) || ',"n":' || count(*)
                     || CASE WHEN c_custkey // 50 % 5 = 4 THEN '' ELSE ',"tags":[1,null]}' END AS t
              FROM customer GROUP BY c_custkey // 50)""",
    "json_values": f"""
        SELECT c_custkey // 50 AS bucket, 'features' AS name, {_NTH} AS position, c_mktsegment AS shown, NULL AS error FROM customer
        UNION ALL SELECT DISTINCT c_custkey // 50, unnest(['type', 'name']), NULL,
               unnest(['FeatureCollection', 'part ' || c_custkey // 50]), NULL FROM customer
        UNION ALL SELECT DISTINCT c_custkey // 50, 'crs', NULL, 'EPSG:4326', NULL FROM customer WHERE c_custkey // 50 % 2 = 0""",
    "geojson_headers": """
        SELECT bucket, '{"type":"FeatureCollection","name":"part ' || bucket || '"' || CASE WHEN bucket % 2 = 0
                   THEN ',"crs":{"properties":{"name":"EPSG:4326"},"type":"name"}' ELSE '' END || '}' AS header
        FROM (SELECT DISTINCT c_custkey // 50 AS bucket FROM customer)""",
    "geojson_features": f"""
        SELECT c_custkey // 50 AS bucket, {_NTH} AS feature_id, 'FeatureCollection' AS geojson_type, 'Feature' AS feature_type,
               CASE WHEN c_custkey % 4 >= 2 THEN '{{"name":' || {_NAME} || ',"segment":"' || c_mktsegment || '"}}'
                    ELSE '{{"name":' || {_NAME} || ',"segment":"' || c_mktsegment || '"}}' END AS properties,
               '{{"crs":' || {_CRS} || ',' || {_POINT} AS geometry
        FROM customer""",
    "geojson_lines": f"""
        SELECT c_custkey // 50 AS bucket, {_NTH} AS feature_id, CASE WHEN c_custkey % 60 <> 7 THEN 'Feature' END AS feature_type,
               CASE WHEN c_custkey % 60 <> 7 THEN '{{"name":"n' || c_custkey || '","segment":"' || c_mktsegment || '"}}' END AS properties,
               CASE WHEN c_custkey % 60 = 7 THEN 'feature is no JSON object' END AS error
        FROM customer""",
    "geojson_features_by_file_id": f"""
        SELECT c_custkey // 50 * 10 + 7 AS file_id, {_NTH} AS feature_id, 'Feature' AS feature_type,
               '{{' || CASE WHEN c_custkey % 4 >= 2 THEN '"name":' || {_NAME} || ',' ELSE '' END
               || '"segment":"' || c_mktsegment || '"}}' AS properties,
               '{{"crs":' || {_CRS} || ',' || {_POINT} AS jgeom
        FROM customer""",
    "table_export_rows": """
        SELECT 'CO-ANT-Town' || s_suppkey AS isolabel_ext, CASE WHEN s_suppkey % 4 <> 0 THEN 'C' END AS subprefix,
               left(md5(s_name), 3) AS prefix,
               CASE WHEN s_suppkey % 2 = 0 THEN NULL WHEN s_suppkey % 5 = 0 THEN '' ELSE 'H;' || s_suppkey % 10 END AS subcells,
               s_suppkey % 3 = 1 AS is_subdiv_default, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 4326 END AS srid,
               '0101000000' || upper(md5(s_name)) AS wkb
        FROM supplier""",
    "csv_export": with_tables("donor", """
        SELECT id, scope, shortname, vat_id, legalname, wikidata_id, url, kx_vat_id FROM donor"""),
    "geojson_feature_export": """
        SELECT '{"type":"Point","coordinates":[' || c_nationkey || '.123457,-' || c_custkey % 90 || '.5]'
               || CASE WHEN c_custkey % 4 = 0 THEN ',"properties":{"segment":"' || c_mktsegment || '"}' ELSE '' END
               || CASE WHEN c_custkey % 3 <> 0 THEN ',"id":' || c_custkey ELSE '' END
               || CASE WHEN c_custkey % 5 <> 0 THEN ',"name":"the \\"' || c_name || '\\""' ELSE '' END
               || CASE WHEN c_custkey % 7 = 0 THEN ',"title":"' || c_name || '"' ELSE '' END || '}' AS feature
        FROM customer""",
    "answer_formats": with_tables("star", """, t AS (
            SELECT id, legalname, CASE WHEN n_packs IS NOT NULL THEN '{"n_packs":' || n_packs || ',"n_files":' || n_files
                       || ',"tot_bytes":' || tot_bytes || '}' END AS kx
            FROM donor LEFT JOIN (SELECT donor_id, count(DISTINCT pack_id) AS n_packs, count(*) AS n_files, sum(size) AS tot_bytes
                                  FROM star GROUP BY donor_id) k ON k.donor_id = donor.id)
        SELECT 'json' AS format, * FROM t UNION ALL SELECT 'csv', * FROM t"""),
}
