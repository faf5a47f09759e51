"""Audits, insert-ignore, upserts and subscriber inserts over the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrashelf import schemas
from terrashelf.operators import audit, upsert
from terrashelf.plans import refresh
from terrashelf.session import scratch_path
from workload import tables
from workload.tables import read, with_tables


def _text(name: str):
    return F.col(name).cast("string")


def row_checks(spark, sf_dir):
    """Towns with every rule broken somewhere: long names, odd levels, short and missing abbreviations."""
    i = F.col("osm_id")
    spoiled = tables.jurisdiction(spark, sf_dir).withColumns({
        "name": F.when(i % 5 == 0, F.rpad("name", 60, "x")).otherwise(F.col("name")),
        "admin_level": F.when(i % 7 == 0, F.lit(0)).when(i % 11 == 0, F.lit(100)).otherwise(F.col("admin_level")),
        "abbrev": F.when(i % 6 == 0, "A").when(i % 13 == 0, None).otherwise(F.col("abbrev")),
        "lexlabel": F.when(i % 9 == 0, None).otherwise(F.col("lexlabel")),
    })
    return audit.row_checks(spoiled, F.col("osm_id"), audit.jurisdiction_checks())


def table_row_checks(spark, sf_dir):
    """Donors, packs and files with required values taken away."""
    gone = lambda by, k, c: F.when(by % k == 0, None).otherwise(F.col(c))
    i, p, f = F.col("id"), F.col("pack_id"), F.col("pack_id") + F.col("jurisd_osm_id")
    donor = tables.donor(spark, sf_dir).withColumn("legalname", gone(i, 7, "legalname"))
    pack = tables.pack(spark, sf_dir).withColumns({"user_resp": gone(p, 11, "user_resp"), "escopo": gone(p, 13, "escopo")})
    origin = tables.origin(spark, sf_dir).withColumns({"fname": gone(f, 17, "fname"), "is_open": gone(f, 19, "is_open")})
    checks = (
        ("donor", donor, "id", audit.DONOR_REQUIRED), ("donatedPack", pack, "pack_id", audit.PACK_REQUIRED),
        ("origin", origin, "id", audit.ORIGIN_REQUIRED),
    )
    found = [
        audit.row_checks(df, F.col(key), audit.not_null_checks(columns)).withColumn("table", F.lit(name))
        for name, df, key, columns in checks
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])


def _refresh(spark, sf_dir):
    """An ingest run: towns by sevens as new places with the countries again, donors by threes, packs by fives, some lines bad.

    The tables hold the places above the towns, every second donor and every second pack.
    """
    number = lambda c, bad: F.when(bad, F.concat(F.lit("x"), _text(c))).otherwise(_text(c)).alias(c)
    j, d, p = (getattr(tables, n)(spark, sf_dir) for n in ("jurisdiction", "donor", "pack"))
    town, i, k = F.col("osm_id") - 100000, F.col("id"), F.col("pack_id")
    places = j.where((F.col("admin_level") == 2) | ((F.col("admin_level") == 8) & (town % 7 == 0)))
    donors = d.where(i % 3 == 0).select(
        number("id", i % 30 == 0), F.col("scope").alias("escopo"), F.lit("two\nlines").alias("shortName"), "vat_id",
        F.col("legalname").alias("legalName"), "wikidata_id", "url",
    )
    null = F.lit(None).cast("string")
    packs = p.where(k % 5 == 0).select(
        number("pack_id", k % 50 == 0), "donor_id", null.alias("donor_label"), "user_resp",
        F.trunc("accepted_date", "year").alias("accepted_date"), F.lit("BR").alias("escopo"),
        F.concat(F.lit("about "), _text("pack_id")).alias("about"), null.alias("author"), null.alias("contentReferenceTime"),
        F.lit("no").alias("license_is_explicit"), null.alias("license"), null.alias("uri_objType"), null.alias("uri"),
        null.alias("isAt_UrbiGIS"),
    )
    rows = places.select(number("osm_id", town % 70 == 0), *[c for c in j.columns if c != "osm_id"])
    sent = {}
    for name, df in (("jurisdiction", rows), ("donor", donors), ("donatedPack", packs)):
        sent[name] = scratch_path(spark, name)
        df.write.option("header", True).option("escape", '"').csv(sent[name])
    now = {"jurisdiction": j.where("admin_level < 8"), "donor": d.where(i % 2 == 0), "donatedPack": p.where(k % 2 == 0)}
    return refresh.refresh(spark, now, sent, do_update=True), refresh.rejected_lines(spark, sent)


def refresh_outcomes(spark, sf_dir):
    new, rejected = _refresh(spark, sf_dir)
    return refresh.outcome_table(new).unionByName(rejected)


def refresh_conflicts(spark, sf_dir):
    """Unique keys that the run's tables would break: delivered packs of one donor share scope and, by year, their day."""
    return refresh.key_conflicts(_refresh(spark, sf_dir)[0])


def duplicate_keys(spark, sf_dir):
    origins = tables.origin(spark, sf_dir)
    return audit.duplicate_keys(origins, schemas.ORIGIN_KEYS)


def broken_references(spark, sf_dir):
    """The declared references, with some packs and donors taken away to leave orphans."""
    cat = tables.catalogue(spark, sf_dir)
    return refresh.broken_references({
        "jurisdiction": cat["jurisdiction"].where(F.col("osm_id") % 10 != 3),
        "donor": cat["donor"].where(F.col("id") % 10 != 1),
        "donatedPack": cat["pack"].where(F.col("pack_id") % 100 != 7),
        "auth_user": tables.auth_user(spark, sf_dir).where("username <> '5-LOW'"),
        "origin": tables.origin(spark, sf_dir),
        "origin_content_type": cat["content_type"].where("label <> 'P3e'"),
    })


def _documents_as_files(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(
        F.sha2("text", 256).alias("fhash"), F.concat(F.lit("doc"), _text("doc_id"), F.lit(".txt")).alias("fname")
    )


def same_content(spark, sf_dir):
    return audit.same_content(_documents_as_files(spark, sf_dir))


def same_content_names(spark, sf_dir):
    return audit.same_content_names(_documents_as_files(spark, sf_dir))


_J_COLUMNS = ["osm_id", "isolabel_ext", "wikidata_id", "jurisd_base_id", "jurisd_local_id", "parent_abbrev", "name", "lexlabel", "abbrev"]


def insert_ignore_jurisdictions(spark, sf_dir):
    """Offers made from suppliers that clash with the table, with each other, or not at all."""
    existing = tables.jurisdiction(spark, sf_dir)
    i = F.col("s_suppkey")
    offered = read(spark, sf_dir, "supplier").select(
        i.alias("nth"),
        F.when(i % 5 == 0, 100000 + i).otherwise(500000 + i - i % 3).alias("osm_id"),
        F.concat(F.lit("XX-YY-New"), (i - i % 2).cast("string")).alias("isolabel_ext"),
        F.when(i % 4 != 0, 2000000 + i).alias("wikidata_id"),
        F.lit(80).alias("jurisd_base_id"),
        i.cast("int").alias("jurisd_local_id"),
        F.lit("YY").alias("parent_abbrev"),
        F.concat(F.lit("new "), _text("s_suppkey")).alias("name"),
        F.concat(F.lit("new."), _text("s_suppkey")).alias("lexlabel"),
        F.when(i % 7 == 0, "NEW").alias("abbrev"),
    )
    return upsert.insert_ignore(existing.select(*_J_COLUMNS), offered, schemas.JURISDICTION_KEYS, "nth").select(
        "nth", "osm_id", "isolabel_ext"
    )


def insert_ignore_files(spark, sf_dir):
    """Files offered in id order against an empty catalogue; one unique key, so the result is exact in SQL."""
    offered = tables.origin_by_id(spark, sf_dir).select("id", "jurisd_osm_id", "ctype", "fname", "fhash")
    known = offered.where(F.col("id") % 5 == 0)
    fresh = offered.where(F.col("id") % 5 != 0)
    return upsert.insert_ignore(known, fresh, [["jurisd_osm_id", "ctype"]], "id")


def _delivered_donors(spark, sf_dir):
    """Two thirds of the donors with new names, and as many new ones."""
    i = F.col("c_custkey")
    return read(spark, sf_dir, "customer").where(i % 3 != 0).select(
        F.when(i % 3 == 1, i).otherwise(i + 10_000_000_000).alias("id"),
        F.lit("BR").alias("escopo"),
        F.concat(F.lit("S"), _text("c_custkey")).alias("shortName"),
        F.concat(F.lit("cnpj:9"), _text("c_custkey")).alias("vat_id"),
        F.concat(F.lit("New "), F.col("c_name")).alias("legalName"),
        i.alias("wikidata_id"),
        F.lit("https://new.example.org").alias("url"),
    )


def _upserted_donors(spark, sf_dir, do_update):
    df = upsert.upsert_donors(tables.donor(spark, sf_dir), _delivered_donors(spark, sf_dir), do_update)
    return df.select("id", "scope", "shortname", "vat_id", "legalname", "wikidata_id", "url", "kx_vat_id", "action")


def upsert_donors(spark, sf_dir):
    return _upserted_donors(spark, sf_dir, True)


def upsert_donors_insert_only(spark, sf_dir):
    return _upserted_donors(spark, sf_dir, False)


def upsert_packs(spark, sf_dir):
    """Packs with odd numbers are delivered again, and as many new ones."""
    i = F.col("o_orderkey")
    delivered = read(spark, sf_dir, "orders").where(i % 2 == 1).select(
        F.when(i % 4 == 1, i).otherwise(i + 10_000_000_000).alias("pack_id"),
        F.col("o_custkey").alias("donor_id"),
        F.lit("label").alias("donor_label"),
        F.lit("maria").alias("user_resp"),
        F.col("o_orderdate").cast("date").alias("accepted_date"),
        F.lit("BR").alias("escopo"),
        F.concat(F.lit("about "), _text("o_orderkey")).alias("about"),
        F.lit(None).cast("string").alias("author"),
        F.lit("2022").alias("contentReferenceTime"),
        F.when(i % 3 == 0, "No").when(i % 3 == 1, "yes").alias("license_is_explicit"),
        F.lit("CC0").alias("license"),
        F.lit("zip").alias("uri_objType"),
        F.lit("https://example.org").alias("uri"),
        F.lit("empty").alias("isAt_UrbiGIS"),
    )
    df = upsert.upsert_packs(tables.pack(spark, sf_dir), delivered, True)
    return df.select("pack_id", "donor_id", "user_resp", "accepted_date", "escopo", "about", "info", "action")


def donor_search_key(spark, sf_dir):
    return upsert.with_search_key(tables.donor(spark, sf_dir).drop("kx_vat_id")).select("id", "vat_id", "kx_vat_id")


def subscribers(spark, sf_dir):
    """Addresses known before: those of every third user."""
    return read(spark, sf_dir, "events").where(F.col("user_id") % 3 == 0).groupBy(
        F.concat(F.lit("u"), _text("user_id"), F.lit("@x.org")).alias("email")
    ).agg(F.min("ts").alias("signature_date"), F.min("user_id").alias("cust_id"))


def email_arrivals(spark, sf_dir):
    """Every event as an arrival, with capitals and blanks; some addresses are not valid."""
    i = F.col("event_id")
    address = F.when(i % 10 == 3, F.concat(F.lit("@U"), _text("user_id"))).when(i % 10 == 4, "a@").otherwise(
        F.concat(F.lit("U"), _text("user_id"), F.lit("@x.org "))
    )
    return read(spark, sf_dir, "events").select(address.alias("email"), F.col("ts").alias("signature_date"))


def new_subscribers(spark, sf_dir):
    return upsert.new_subscribers(subscribers(spark, sf_dir), email_arrivals(spark, sf_dir))


def rejected_emails(spark, sf_dir):
    df = upsert.rejected_emails(email_arrivals(spark, sf_dir))
    return df.groupBy("is_valid", "name", "invalid_explain").agg(F.count(F.lit(1)).alias("n_rows"))


QUERIES = {
    f.__name__: f
    for f in (
        row_checks, table_row_checks, refresh_outcomes, refresh_conflicts, duplicate_keys, broken_references, same_content, same_content_names, insert_ignore_jurisdictions,
        insert_ignore_files, upsert_donors, upsert_donors_insert_only, upsert_packs, donor_search_key, new_subscribers,
        rejected_emails,
    )
}

_FILES = "SELECT sha256(text) AS digest, 'doc' || doc_id || '.txt' AS name FROM documents"
_DELIVERED = """
    SELECT CASE WHEN c_custkey % 3 = 1 THEN c_custkey ELSE c_custkey + 10000000000 END AS id, 'BR' AS scope,
           'S' || c_custkey AS shortname, 'cnpj:9' || c_custkey AS vat_id, 'New ' || c_name AS legalname,
           c_custkey AS wikidata_id, 'https://new.example.org' AS url, 'cnpj:9' || c_custkey AS kx_vat_id
    FROM customer WHERE c_custkey % 3 <> 0"""
_DONOR_COLUMNS = ["scope", "shortname", "vat_id", "legalname", "wikidata_id", "url", "kx_vat_id"]


def _donor_upsert_sql(do_update: bool) -> str:
    first, second = ("n", "o") if do_update else ("o", "n")
    columns = ", ".join(f"CASE WHEN {first}.id IS NOT NULL THEN {first}.{c} ELSE {second}.{c} END AS {c}" for c in _DONOR_COLUMNS)
    return with_tables("donor", f"""
        SELECT coalesce(o.id, n.id) AS id, {columns},
               CASE WHEN o.id IS NULL THEN 'inserted' WHEN n.id IS NOT NULL AND {do_update} THEN 'updated' ELSE 'kept' END
               AS action
        FROM donor o FULL JOIN delivered n ON o.id = n.id""", delivered=_DELIVERED)


def _violations(rules: dict[str, str], name: str, source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT FALSE AS is_valid, CAST({name} AS VARCHAR) AS name, '{text}' AS invalid_explain FROM {source} WHERE NOT ({rule})"
        for text, rule in rules.items()
    )


_ARRIVALS = """
    SELECT trim(lower(CASE WHEN event_id % 10 = 3 THEN '@U' || user_id WHEN event_id % 10 = 4 THEN 'a@'
           ELSE 'U' || user_id || '@x.org ' END)) AS email, ts FROM events"""

ORACLE = {
    "row_checks": with_tables("jurisdiction", _violations(
        {
            "lexlabel is null": "lexlabel IS NOT NULL",
            "admin_level out of 1..99": "admin_level BETWEEN 1 AND 99",
            "name of 60 or more signs": "length(name) < 60",
            "abbrev not of 2..5 signs": "length(abbrev) BETWEEN 2 AND 5",
        }, "osm_id", "spoiled"), spoiled="""
            SELECT osm_id, CASE WHEN osm_id % 5 = 0 THEN rpad(name, 60, 'x') ELSE name END AS name,
                   CASE WHEN osm_id % 7 = 0 THEN 0 WHEN osm_id % 11 = 0 THEN 100 ELSE admin_level END AS admin_level,
                   CASE WHEN osm_id % 6 = 0 THEN 'A' WHEN osm_id % 13 = 0 THEN NULL ELSE abbrev END AS abbrev,
                   CASE WHEN osm_id % 9 = 0 THEN NULL ELSE lexlabel END AS lexlabel
            FROM jurisdiction"""),
    "table_row_checks": with_tables("donor pack origin", """
        SELECT FALSE AS is_valid, CAST(id AS VARCHAR) AS name, 'legalname is null' AS invalid_explain, 'donor' AS "table"
        FROM donor WHERE id % 7 = 0
        UNION ALL SELECT FALSE, CAST(pack_id AS VARCHAR), 'user_resp is null', 'donatedPack' FROM pack WHERE pack_id % 11 = 0
        UNION ALL SELECT FALSE, CAST(pack_id AS VARCHAR), 'escopo is null', 'donatedPack' FROM pack WHERE pack_id % 13 = 0
        UNION ALL SELECT FALSE, CAST(id AS VARCHAR), 'fname is null', 'origin' FROM origin WHERE (pack_id + jurisd_osm_id) % 17 = 0
        UNION ALL SELECT FALSE, CAST(id AS VARCHAR), 'is_open is null', 'origin' FROM origin
        WHERE (pack_id + jurisd_osm_id) % 19 = 0"""),
    "refresh_outcomes": with_tables("jurisdiction donor pack", """
        SELECT * FROM (
            SELECT 'jurisdiction' AS "table", 'kept' AS action, count(*) AS n_rows FROM jurisdiction WHERE admin_level < 8
            UNION ALL SELECT 'jurisdiction', 'inserted', count(*) FROM jurisdiction
            WHERE admin_level = 8 AND (osm_id - 100000) % 7 = 0 AND (osm_id - 100000) % 70 <> 0
            UNION ALL SELECT 'donor', CASE WHEN id % 2 <> 0 THEN 'inserted' WHEN id % 3 = 0 AND id % 30 <> 0 THEN 'updated' ELSE 'kept' END,
                   count(*) FROM donor WHERE id % 2 = 0 OR (id % 3 = 0 AND id % 30 <> 0) GROUP BY 2
            UNION ALL SELECT 'donatedPack', CASE WHEN pack_id % 2 <> 0 THEN 'inserted'
                   WHEN pack_id % 5 = 0 AND pack_id % 50 <> 0 THEN 'updated' ELSE 'kept' END, count(*)
            FROM pack WHERE pack_id % 2 = 0 OR (pack_id % 5 = 0 AND pack_id % 50 <> 0) GROUP BY 2) WHERE n_rows > 0
        UNION ALL SELECT 'jurisdiction', 'rejected', count(*) FROM jurisdiction WHERE admin_level = 8 AND (osm_id - 100000) % 70 = 0
        UNION ALL SELECT 'donor', 'rejected', count(*) FROM donor WHERE id % 30 = 0
        UNION ALL SELECT 'donatedPack', 'rejected', count(*) FROM pack WHERE pack_id % 50 = 0"""),
    "refresh_conflicts": with_tables("pack", """
        SELECT 'donor_id,accepted_date,escopo' AS unique_key, concat_ws('|', donor_id, day, scope) AS value,
               count(*) AS n_rows, 'donatedPack' AS "table"
        FROM (SELECT donor_id, CASE WHEN pack_id % 5 = 0 AND pack_id % 50 <> 0 THEN CAST(date_trunc('year', accepted_date) AS DATE)
                     ELSE accepted_date END AS day, CASE WHEN pack_id % 5 = 0 AND pack_id % 50 <> 0 THEN 'BR' ELSE escopo END AS scope
              FROM pack WHERE pack_id % 2 = 0 OR (pack_id % 5 = 0 AND pack_id % 50 <> 0))
        GROUP BY donor_id, day, scope HAVING count(*) > 1"""),
    "duplicate_keys": with_tables("origin", """
        SELECT 'id' AS unique_key, CAST(id AS VARCHAR) AS value, count(*) AS n_rows FROM origin GROUP BY id HAVING count(*) > 1
        UNION ALL
        SELECT 'fhash', fhash, count(*) FROM origin GROUP BY fhash HAVING count(*) > 1
        UNION ALL
        SELECT 'jurisd_osm_id,fname,fversion,ctype', concat_ws('|', jurisd_osm_id, fname, fversion, ctype), count(*)
        FROM origin GROUP BY jurisd_osm_id, fname, fversion, ctype HAVING count(*) > 1"""),
    "broken_references": with_tables("jurisdiction donor pack origin content_type", """
        SELECT 'parent_id' AS reference, CAST(parent_id AS VARCHAR) AS value, count(*) AS n_rows FROM jurisdiction
        WHERE osm_id % 10 <> 3 AND parent_id % 10 = 3 GROUP BY parent_id
        UNION ALL SELECT 'donor_id', CAST(donor_id AS VARCHAR), count(*) FROM pack
        WHERE pack_id % 100 <> 7 AND donor_id % 10 = 1 GROUP BY donor_id
        UNION ALL SELECT 'user_resp', user_resp, count(*) FROM pack
        WHERE pack_id % 100 <> 7 AND user_resp = '5-LOW' GROUP BY user_resp
        UNION ALL SELECT 'jurisd_osm_id', CAST(jurisd_osm_id AS VARCHAR), count(*) FROM origin
        WHERE jurisd_osm_id NOT IN (SELECT osm_id FROM jurisdiction WHERE osm_id % 10 <> 3) GROUP BY jurisd_osm_id
        UNION ALL SELECT 'ctype', ctype, count(*) FROM origin WHERE ctype = 'P3e' GROUP BY ctype
        UNION ALL SELECT 'pack_id', CAST(pack_id AS VARCHAR), count(*) FROM origin
        WHERE pack_id NOT IN (SELECT pack_id FROM pack WHERE pack_id % 100 <> 7) GROUP BY pack_id"""),
    "same_content": f"""
        SELECT digest, count(DISTINCT name) AS n_names, count(*) AS n_files, min(name) AS first_name, max(name) AS last_name
        FROM ({_FILES}) GROUP BY digest HAVING count(DISTINCT name) > 1""",
    "same_content_names": f"""
        SELECT DISTINCT digest, name FROM ({_FILES}) QUALIFY count(*) OVER (PARTITION BY digest) > 1""",
    "insert_ignore_jurisdictions": with_tables("jurisdiction", """, offers AS (
            SELECT s_suppkey AS nth,
                   CASE WHEN s_suppkey % 5 = 0 THEN 100000 + s_suppkey ELSE 500000 + s_suppkey - s_suppkey % 3 END AS osm_id,
                   'XX-YY-New' || (s_suppkey - s_suppkey % 2) AS isolabel_ext,
                   CASE WHEN s_suppkey % 4 <> 0 THEN 2000000 + s_suppkey END AS wikidata_id, 80 AS jurisd_base_id,
                   s_suppkey AS jurisd_local_id, 'YY' AS parent_abbrev, 'new ' || s_suppkey AS name,
                   'new.' || s_suppkey AS lexlabel, CASE WHEN s_suppkey % 7 = 0 THEN 'NEW' END AS abbrev
            FROM supplier),
        every AS (SELECT CAST(NULL AS BIGINT) AS nth, osm_id, isolabel_ext, wikidata_id, jurisd_base_id, jurisd_local_id, parent_abbrev, name,
                         lexlabel, abbrev FROM jurisdiction UNION ALL SELECT * FROM offers),
        keyed AS (SELECT nth, osm_id, isolabel_ext, list_filter([
                'o' || osm_id, 'i' || isolabel_ext, 'w' || wikidata_id, 'l' || jurisd_base_id || '/' || jurisd_local_id,
                'n' || jurisd_base_id || '/' || parent_abbrev || '/' || name,
                'x' || jurisd_base_id || '/' || parent_abbrev || '/' || lexlabel,
                'a' || jurisd_base_id || '/' || parent_abbrev || '/' || abbrev], lambda k: k IS NOT NULL) AS keys FROM every),
        walk AS (
            SELECT CAST(-1 AS BIGINT) AS nth, flatten(list(keys)) AS taken, FALSE AS ok FROM keyed WHERE nth IS NULL
            UNION ALL
            SELECT k.nth, CASE WHEN list_has_any(w.taken, k.keys) THEN w.taken ELSE list_concat(w.taken, k.keys) END,
                   NOT list_has_any(w.taken, k.keys)
            FROM walk w JOIN keyed k ON k.nth = w.nth + 1)
        SELECT nth, osm_id, isolabel_ext FROM walk JOIN offers USING (nth) WHERE ok""").replace("WITH geo", "WITH RECURSIVE geo", 1),
    "insert_ignore_files": with_tables("origin_by_id", """
        SELECT id, jurisd_osm_id, ctype, fname, fhash FROM origin_by_id o
        WHERE id % 5 <> 0 AND NOT EXISTS (
            SELECT 1 FROM origin_by_id k WHERE k.id % 5 = 0 AND k.jurisd_osm_id = o.jurisd_osm_id AND k.ctype = o.ctype)
        QUALIFY row_number() OVER (PARTITION BY jurisd_osm_id, ctype ORDER BY id) = 1"""),
    "upsert_donors": _donor_upsert_sql(True),
    "upsert_donors_insert_only": _donor_upsert_sql(False),
    "upsert_packs": with_tables("pack", """
        SELECT coalesce(o.pack_id, n.pack_id) AS pack_id, coalesce(n.donor_id, o.donor_id) AS donor_id,
               coalesce(n.user_resp, o.user_resp) AS user_resp, coalesce(n.accepted_date, o.accepted_date) AS accepted_date,
               coalesce(n.escopo, o.escopo) AS escopo, n.about, n.info,
               CASE WHEN o.pack_id IS NULL THEN 'inserted' WHEN n.pack_id IS NULL THEN 'kept' ELSE 'updated' END AS action
        FROM pack o FULL JOIN delivered n ON o.pack_id = n.pack_id""", delivered="""
            SELECT CASE WHEN o_orderkey % 4 = 1 THEN o_orderkey ELSE o_orderkey + 10000000000 END AS pack_id,
                   o_custkey AS donor_id, 'maria' AS user_resp, CAST(o_orderdate AS DATE) AS accepted_date, 'BR' AS escopo,
                   'about ' || o_orderkey AS about,
                   '{"author":null,"contentReferenceTime":"2022","license_is_explicit":' || CASE o_orderkey % 3
                   WHEN 0 THEN 'false' WHEN 1 THEN 'true' ELSE 'null' END
                   || ',"license":"CC0","uri_objType":"zip","uri":"https://example.org","isAt_UrbiGIS":null}' AS info
            FROM orders WHERE o_orderkey % 2 = 1"""),
    "donor_search_key": with_tables("donor", """
        SELECT id, vat_id, lower(regexp_replace(vat_id, '[,\\.;/\\-\\+\\*~]+', '', 'g')) AS kx_vat_id FROM donor"""),
    "new_subscribers": f"""
        WITH known AS (SELECT DISTINCT user_id AS cust_id, 'u' || user_id || '@x.org' AS email FROM events WHERE user_id % 3 = 0),
        firsts AS (SELECT email, min(ts) AS signature_date FROM ({_ARRIVALS})
                   WHERE length(email) > 3 AND position('@' IN email) > 1 GROUP BY email)
        SELECT coalesce((SELECT max(cust_id) FROM known), 0) + row_number() OVER (ORDER BY signature_date, email) AS cust_id, email, signature_date,
               FALSE AS is_valid, FALSE AS confirmed
        FROM firsts WHERE email NOT IN (SELECT email FROM known)""",
    "rejected_emails": f"""
        WITH a AS ({_ARRIVALS}) SELECT is_valid, name, invalid_explain, count(*) AS n_rows FROM (""" + _violations(
        {
            "email of 3 or fewer signs": "length(email) > 3",
            "email without @ after its first sign": "position('@' IN email) > 1",
        }, "email", "a") + ") GROUP BY 1, 2, 3",
}
