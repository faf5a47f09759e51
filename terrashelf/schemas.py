"""Table schemas and the fixed rows every catalogue starts with.

Pack and donor ids are 64-bit: a catalogue of this size outgrows 32.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


FILE_META = "STRUCT<size: BIGINT, fpath: STRING, creation: STRING, modification: STRING>"

JURISDICTION = (
    "osm_id BIGINT, jurisd_base_id INT, jurisd_local_id INT, parent_id BIGINT, admin_level SMALLINT, "
    "name STRING, parent_abbrev STRING, abbrev STRING, wikidata_id BIGINT, lexlabel STRING, "
    "isolabel_ext STRING, ddd INT, info STRING"
)
DONOR = (
    "id BIGINT, scope STRING, shortname STRING, vat_id STRING, legalname STRING, wikidata_id BIGINT, "
    "url STRING, info STRING, kx_vat_id STRING"
)
AUTH_USER = ("username STRING, info STRING")
PACK = (
    "pack_id BIGINT, donor_id BIGINT, user_resp STRING, accepted_date DATE, escopo STRING, about STRING, "
    "config_commom STRING, info STRING"
)
PACK_COMMON = ("pack_id BIGINT, makemodel_id INT, makefile STRING, makefile_resp STRING, readme STRING")
ORIGIN = (
    "id BIGINT, jurisd_osm_id BIGINT, ctype STRING, pack_id BIGINT, fhash STRING, fname STRING, "
    "fversion SMALLINT, kx_cmds ARRAY<STRING>, is_valid BOOLEAN, is_open BOOLEAN, "
    f"fmeta {FILE_META}, config STRING, ingest_instant TIMESTAMP_NTZ"
)
SUBSCRIBER = (
    "cust_id BIGINT, email STRING, signature_date TIMESTAMP_NTZ, is_valid BOOLEAN, confirmed BOOLEAN"
)
CROSSWALK = (
    "isolabel_ext STRING, subprefix STRING, prefix STRING, subcells STRING, is_subdiv_default STRING, geom STRING"
)

# Delivery files: column order of the CSV headers.
DONOR_FILE = (
    "id BIGINT, escopo STRING, shortName STRING, vat_id STRING, legalName STRING, wikidata_id BIGINT, url STRING"
)
PACK_FILE = (
    "pack_id BIGINT, donor_id BIGINT, donor_label STRING, user_resp STRING, accepted_date DATE, escopo STRING, "
    "about STRING, author STRING, contentReferenceTime STRING, license_is_explicit STRING, license STRING, "
    "uri_objType STRING, uri STRING, isAt_UrbiGIS STRING"
)

# Unique keys; a null in any column of a key never clashes.
JURISDICTION_KEYS = [
    ["osm_id"],
    ["isolabel_ext"],
    ["wikidata_id"],
    ["jurisd_base_id", "jurisd_local_id"],
    ["jurisd_base_id", "parent_abbrev", "name"],
    ["jurisd_base_id", "parent_abbrev", "lexlabel"],
    ["jurisd_base_id", "parent_abbrev", "abbrev"],
]
DONOR_KEYS = [["id"], ["vat_id"], ["kx_vat_id"], ["scope", "legalname"]]
PACK_KEYS = [["pack_id"], ["donor_id", "accepted_date", "escopo"]]
ORIGIN_KEYS = [["id"], ["fhash"], ["jurisd_osm_id", "fname", "fversion", "ctype"]]

# Result templates of the published jobs.
NAME_CHECK = ("is_valid BOOLEAN, name STRING, invalid_explain STRING")
PACK_DIRECTORY = (
    "username STRING, jurisdiction_label STRING, jurisdiction_osmid BIGINT, pack_path STRING, "
    "pack_id BIGINT, packinfo STRING"
)
CITY_FILE = (
    "pack_id BIGINT, ctype STRING, fid INT, fname STRING, is_valid BOOLEAN, fmeta STRING"
)
CITY_FILE_HASHED = (
    "pack_id BIGINT, ctype STRING, fid INT, fname STRING, is_valid BOOLEAN, fmeta STRING, hash STRING, err_msg STRING"
)
FILE_HASH = ("hash STRING, hashtype STRING, fname STRING, refpath STRING")

# Content types (id, label, geometry model, separate table, useful, score).
CONTENT_TYPES = [
    (1, "PL1", "Point Lot via_name housenumber", "", True, "perfect"),
    (2, "PL1s", "Point Lot id", "id via_name housenumber", True, "perfect"),
    (3, "P1", "Point via_name housenumber", "", True, "perfect"),
    (4, "P2", "Point housenumber", "", True, "good"),
    (5, "P1s", "Point id ", "id via_name housenumber", True, "perfect"),
    (6, "P2s", "Point id", "id housenumber", True, "good"),
    (7, "P3e", "Point", "", False, "bad"),
    (8, "L1", "Lot via_name housenumber", "", True, "perfect"),
    (9, "L2", "Lot housenumber", "", True, "good"),
    (10, "L2s", "Lot id", "id housenumber", True, "good"),
    (11, "L1s", "Lot id", "id via_name housenumber", True, "perfect"),
    (12, "L3", "Lot", "", False, "bad"),
    (13, "N1s", "(null)", "via_name housenumber region", False, "bad"),
    (14, "V1", "Via name", "", True, "perfect"),
    (15, "V1s", "Via id", "id name", True, "good"),
    (101, "edificacoes", "?", "?", None, "bad"),
    (102, "lotes", "?", "?", None, "bad"),
    (103, "ruas", "?", "?", None, "bad"),
    (104, "eixos", "?", "?", None, "bad"),
]

# Codes and messages of requests that cannot be answered.
REQUEST_ERRORS = {-1: "empty endpoint", -2: "incomplete endpoint", -3: "endpoint not found"}


def sql_literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def values_clause(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(sql_literal(v) for v in row) + ")" for row in rows)


def content_types(spark: SparkSession) -> DataFrame:
    """The 19 seed rows as an inline relation, so its size is known when a join is planned."""
    return spark.sql(
        f"SELECT * FROM VALUES {values_clause(CONTENT_TYPES)} "
        "AS t(id, label, model_geo, model_septable, is_useful, score)"
    )
