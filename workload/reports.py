"""Catalogue reports, the joined view, published tables, exports of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrashelf.plans import catalogue
from terrashelf.operators import audit
from workload import tables
from workload.tables import with_tables


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.report_base(tables.origin(spark, sf_dir), **tables.catalogue(spark, sf_dir))


def star_view(spark, sf_dir):
    joined = catalogue.star(tables.origin(spark, sf_dir), **tables.catalogue(spark, sf_dir))
    return joined.select(
        "id", "fhash", "fname", F.col("fmeta.size").alias("size"), "is_open", "pack_id", "jurisd_osm_id", "ctype", "ctype_id",
        "ctype_model_geo", "jurisd_name", "jurisd_state", "jurisd_abbrev3", "jurisd_isolabel_ext",
        "jurisd_base_id", "jurisd_parent_id", "jurisd_admin_level", "donor_id", "donor_shortname", "donor_legalname",
        "donor_vat_id", "donor_url", "user_resp", "accepted_date",
    )


def country_report(spark, sf_dir):
    return catalogue.country_report(_base(spark, sf_dir)).orderBy("country")


def state_report(spark, sf_dir):
    return catalogue.state_report(_base(spark, sf_dir)).orderBy("jurisd_base_id", "jurisd_admin_level", "jurisd_state")


def donor_report(spark, sf_dir):
    return catalogue.donor_report(_base(spark, sf_dir)).orderBy("donor_shortname")


def donors_with_totals(spark, sf_dir):
    df = catalogue.donors_with_totals(tables.donor(spark, sf_dir), _base(spark, sf_dir))
    return df.select(
        "id", "scope", "shortname", "vat_id", "legalname", "wikidata_id", "url",
        F.col("kx").isNotNull().alias("has_kx"),
        *[F.col(f"kx.{c}").cast("string").alias(c) for c in ("n_packs", "n_files", "tot_bytes")],
    )


def source_list(spark, sf_dir):
    cat = tables.catalogue(spark, sf_dir)
    starred = catalogue.star(tables.origin(spark, sf_dir), **cat)
    return catalogue.source_list(starred, cat["pack"])


def public_dump(spark, sf_dir):
    return catalogue.public_dump(tables.origin_by_id(spark, sf_dir)).select(
        "id", "jurisd_osm_id", "ctype", "pack_id", "fhash", "fname", "fversion", "is_valid",
        F.to_json("fmeta").alias("fmeta"), "ingest_instant",
    )


def published_tables(spark, sf_dir):
    cat = tables.catalogue(spark, sf_dir)
    catalogue.publish({
        "jurisdiction": cat["jurisdiction"], "donor": cat["donor"], "donatedPack": cat["pack"],
        "origin": tables.origin(spark, sf_dir), "origin_content_type": cat["content_type"],
        "auth_user": tables.auth_user(spark, sf_dir),
    })
    counts = " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n_rows FROM {n}" for n in catalogue.PUBLISHED)
    return spark.sql(counts)


def jurisdiction_ancestors(spark, sf_dir):
    return catalogue.ancestors(tables.jurisdiction(spark, sf_dir))


def mean_sizes(spark, sf_dir):
    rows = tables.origin(spark, sf_dir).select("ctype", "is_open", F.col("fmeta.size").alias("size"))
    return catalogue.rounded_means(rows, ["ctype", "is_open"], "size", 2)


_NEXT_ORDER = ["ingest_instant", "fhash", "id", "l_suppkey", "size"]


def _versioned_files(spark, sf_dir):
    return tables.origin(spark, sf_dir).select(
        "id", "jurisd_osm_id", "fname", "ctype", "fhash", "ingest_instant", "l_suppkey",
        F.col("fmeta.size").alias("size"),
    )


def next_file_version(spark, sf_dir):
    # Part and type name the file here; suppliers make the keys of the catalogue nearly unique.
    rows = _versioned_files(spark, sf_dir).drop("jurisd_osm_id")
    df = audit.next_versions(rows, ["fname", "ctype"], _NEXT_ORDER)
    return df.select("id", "fname", "ctype", "fhash", "ingest_instant", "next_version")


def first_file_per_key(spark, sf_dir):
    df = audit.first_per_key(_versioned_files(spark, sf_dir), ["jurisd_osm_id", "ctype"], _NEXT_ORDER)
    return df.select("jurisd_osm_id", "ctype", "id", "fname", "fhash", "ingest_instant")


QUERIES = {
    f.__name__: f
    for f in (
        star_view, country_report, state_report, donor_report, donors_with_totals, source_list, public_dump,
        published_tables, jurisdiction_ancestors, mean_sizes, next_file_version, first_file_per_key,
    )
}

ORACLE = {
    "star_view": with_tables("star", """
        SELECT id, fhash, fname, size, is_open, pack_id, jurisd_osm_id, ctype, ctype_id, ctype_model_geo, jurisd_name,
               jurisd_state, jurisd_abbrev3, jurisd_isolabel_ext, jurisd_base_id, jurisd_parent_id,
               jurisd_admin_level, donor_id, donor_shortname, donor_legalname, donor_vat_id, donor_url, user_resp,
               accepted_date FROM star"""),
    "country_report": with_tables("star", """
        SELECT jurisd_base_id, substr(jurisd_isolabel_ext, 1, 2) AS country, count(*) AS orig_n_files,
               count(DISTINCT pack_id) AS orig_n_packs, count(*) AS n_files, count(DISTINCT pack_id) AS n_packs,
               count(DISTINCT jurisd_osm_id) AS n_jurisds,
               CAST((sum(size) + 500000) // 1000000 AS BIGINT) AS orig_mb
        FROM star GROUP BY 1, 2 ORDER BY 2"""),
    "state_report": with_tables("star", """
        SELECT jurisd_base_id, jurisd_state, jurisd_admin_level, count(*) AS n_files,
               count(DISTINCT pack_id) AS n_packs, count(DISTINCT donor_id) AS n_donors,
               count(DISTINCT jurisd_osm_id) AS n_jurisds, CAST(sum(size) AS BIGINT) AS bytes
        FROM star GROUP BY 1, 2, 3 ORDER BY 1, 3, 2"""),
    "donor_report": with_tables("star", """
        SELECT donor_id, donor_shortname, donor_legalname, count(*) AS n_files, count(DISTINCT pack_id) AS n_packs,
               count(DISTINCT jurisd_osm_id) AS n_jurisds, CAST(sum(size) AS BIGINT) AS bytes
        FROM star GROUP BY 1, 2, 3 ORDER BY 2"""),
    "donors_with_totals": with_tables("star", """
        SELECT id, scope, shortname, vat_id, legalname, wikidata_id, url, n_packs IS NOT NULL AS has_kx,
               CAST(n_packs AS VARCHAR) AS n_packs, CAST(n_files AS VARCHAR) AS n_files,
               CAST(tot_bytes AS VARCHAR) AS tot_bytes
        FROM donor LEFT JOIN (
            SELECT donor_id, count(DISTINCT pack_id) AS n_packs, count(*) AS n_files,
                   CAST(sum(size) AS BIGINT) AS tot_bytes
            FROM star GROUP BY donor_id) t ON t.donor_id = donor.id"""),
    "source_list": with_tables("star", """
        SELECT id, pack_id, donor_id, user_resp, accepted_date, jurisd_isolabel_ext FROM star
        UNION
        SELECT -pack_id, pack_id, donor_id, user_resp, accepted_date, escopo FROM pack"""),
    "public_dump": with_tables("origin_by_id", """
        SELECT id, jurisd_osm_id, ctype, pack_id, fhash, fname, fversion, is_valid,
               '{"size":' || size || '}' AS fmeta, ingest_instant FROM origin_by_id ORDER BY id"""),
    "published_tables": with_tables("jurisdiction donor pack origin content_type", """
        SELECT 'jurisdiction' AS name, count(*) AS n_rows FROM jurisdiction
        UNION ALL SELECT 'donor', count(*) FROM donor
        UNION ALL SELECT 'donatedPack', count(*) FROM pack
        UNION ALL SELECT 'origin', count(*) FROM origin
        UNION ALL SELECT 'origin_content_type', count(*) FROM content_type
        UNION ALL SELECT 'auth_user', count(DISTINCT o_orderpriority) FROM orders"""),
    "jurisdiction_ancestors": with_tables("jurisdiction", """, chain AS (
            SELECT j.osm_id, [j.admin_level, p.admin_level, g.admin_level] AS levels,
                   [j.isolabel_ext, p.isolabel_ext, g.isolabel_ext] AS labels
            FROM jurisdiction j LEFT JOIN jurisdiction p ON j.parent_id = p.osm_id
                 LEFT JOIN jurisdiction g ON p.parent_id = g.osm_id)
        SELECT osm_id, labels[list_position(levels, 2)] AS country, labels[list_position(levels, 4)] AS state,
               labels[list_position(levels, 8)] AS municipality FROM chain"""),
    "mean_sizes": with_tables("origin", """
        SELECT ctype, is_open, count(size) AS n, CAST(sum(size) AS BIGINT) AS total,
               CAST((sum(size) * 200 + count(size)) // (2 * count(size)) AS DOUBLE) / 100 AS mean
        FROM origin GROUP BY 1, 2"""),
    "next_file_version": with_tables("origin", """
        SELECT id, fname, ctype, fhash, ingest_instant, row_number() OVER (
            PARTITION BY fname, ctype ORDER BY ingest_instant, fhash, id, l_suppkey, size) AS next_version
        FROM origin"""),
    "first_file_per_key": with_tables("origin", """
        SELECT jurisd_osm_id, ctype, id, fname, fhash, ingest_instant FROM origin QUALIFY row_number() OVER (
            PARTITION BY jurisd_osm_id, ctype ORDER BY ingest_instant, fhash, id, l_suppkey, size) = 1"""),
}
