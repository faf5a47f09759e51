"""Lookup requests derived from the tables, and the jobs that answer them."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrashelf import schemas
from terrashelf.plans import catalogue, lookup
from terrashelf.session import cut, scratch_path
from workload import reports, tables
from workload.tables import read, with_tables


def _by_number(number, cases: list, otherwise):
    out = None
    for i, value in enumerate(cases):
        hit = number % (len(cases) + 1) == i
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(otherwise)


def _text(name: str):
    return F.col(name).cast("string")


def jurisdiction_requests(spark, sf_dir):
    """Twelve kinds of request in turn, one per jurisdiction; some with capitals and outer slashes."""
    j = tables.jurisdiction(spark, sf_dir)
    lit = F.lit
    uri = _by_number(F.col("osm_id"), [
        F.concat(lit("/isolabel_ext.lk."), F.expr("left(isolabel_ext, 9)")),
        F.concat(lit("parent_abbrev.lk."), F.col("parent_abbrev")),
        F.concat(lit("parent_abbrev.eq."), F.lower("parent_abbrev")),
        F.concat(F.expr("left(isolabel_ext, 6)"), F.lower("abbrev")),
        F.concat(F.translate(F.expr("left(isolabel_ext, 6)"), "-", ";"), F.col("lexlabel")),
        F.concat(lit("Q"), _text("wikidata_id")),
        F.concat(lit("/"), _text("osm_id"), lit("/")),
        F.concat_ws("/", _text("jurisd_base_id"), _text("jurisd_local_id")),
        F.col("isolabel_ext"),
        F.concat(F.expr("left(isolabel_ext, 2)"), lit("/"), _text("jurisd_local_id")),
        F.concat(lit("no-such-place-"), _text("osm_id")),
    ], F.lit("/"))
    return j.select(F.col("osm_id").alias("request_id"), uri.alias("uri"))


_J_REQUESTS = """
    SELECT osm_id AS request_id, CASE osm_id % 12
        WHEN 0 THEN '/isolabel_ext.lk.' || left(isolabel_ext, 9)
        WHEN 1 THEN 'parent_abbrev.lk.' || parent_abbrev
        WHEN 2 THEN 'parent_abbrev.eq.' || lower(parent_abbrev)
        WHEN 3 THEN left(isolabel_ext, 6) || lower(abbrev)
        WHEN 4 THEN replace(left(isolabel_ext, 6), '-', ';') || lexlabel
        WHEN 5 THEN 'Q' || wikidata_id
        WHEN 6 THEN '/' || osm_id || '/'
        WHEN 7 THEN jurisd_base_id || '/' || jurisd_local_id
        WHEN 8 THEN isolabel_ext
        WHEN 9 THEN left(isolabel_ext, 2) || '/' || jurisd_local_id
        WHEN 10 THEN 'no-such-place-' || osm_id
        ELSE '/' END AS uri
    FROM jurisdiction"""


def donor_requests(spark, sf_dir):
    """Ten kinds of request in turn, one per donor."""
    d = tables.donor(spark, sf_dir)
    lit, key = F.lit, _text("id")
    uri = _by_number(F.col("id"), [
        F.concat(lit("/"), key),
        F.concat(lit("q"), _text("wikidata_id")),
        F.concat(lit("scope.lk."), F.expr("left(scope, 4)")),
        F.concat(lit("legalname.lk."), F.expr("right(legalname, 5)")),
        F.concat(lit("url.lk.NOR"), key, lit(".ex")),
        F.concat(lit("shortname.lk."), F.expr("left(shortname, 3)")),
        F.concat(lit("cnpj:"), key, lit("0001-9")),
        F.lower("shortname"),
        F.concat(lit("nobody "), key),
    ], F.lit(""))
    return d.select(F.col("id").alias("request_id"), uri.alias("uri"))


_D_REQUESTS = """
    SELECT id AS request_id, CASE id % 10
        WHEN 0 THEN '/' || id
        WHEN 1 THEN 'q' || wikidata_id
        WHEN 2 THEN 'scope.lk.' || left(scope, 4)
        WHEN 3 THEN 'legalname.lk.' || right(legalname, 5)
        WHEN 4 THEN 'url.lk.NOR' || id || '.ex'
        WHEN 5 THEN 'shortname.lk.' || left(shortname, 3)
        WHEN 6 THEN 'cnpj:' || id || '0001-9'
        WHEN 7 THEN lower(shortname)
        WHEN 8 THEN 'nobody ' || id
        ELSE '' END AS uri
    FROM donor"""


def origin_requests(spark, sf_dir):
    """Eight kinds of request in turn, one per donor: ids, labels, hashes of the files to be found."""
    d = tables.donor(spark, sf_dir)
    lit, key = F.lit, _text("id")
    digest = F.sha2(F.concat_ws("-", key, lit("1"), key), 256)
    uri = _by_number(F.col("id"), [
        F.concat(lit("jurisd_osm_id.eq."), (F.col("id") % 40 + 100000).cast("string")),
        F.concat(lit("jurisd_isolabel_ext.eq."), F.col("scope"), lit("-Town"), (F.col("id") % 100).cast("string")),
        F.concat(lit("donor_id.eq."), key),
        F.concat(lit("jurisd_state.eq."), F.expr("right(scope, 2)")),
        F.concat(lit("/"), (F.col("id") * 100 + 3).cast("string")),
        F.concat(lit("sha256:"), F.substring(digest, 1, 5)),
        F.concat(lit("donor_shortname.eq."), F.lower("legalname")),
    ], F.concat(lit("nothing."), key))
    return d.select(F.col("id").alias("request_id"), uri.alias("uri"))


_O_REQUESTS = """
    SELECT id AS request_id, CASE id % 8
        WHEN 0 THEN 'jurisd_osm_id.eq.' || (id % 40 + 100000)
        WHEN 1 THEN 'jurisd_isolabel_ext.eq.' || scope || '-Town' || id % 100
        WHEN 2 THEN 'donor_id.eq.' || id
        WHEN 3 THEN 'jurisd_state.eq.' || right(scope, 2)
        WHEN 4 THEN '/' || (id * 100 + 3)
        WHEN 5 THEN 'sha256:' || left(sha256(id || '-1-' || id), 5)
        WHEN 6 THEN 'donor_shortname.eq.' || lower(legalname)
        ELSE 'nothing.' || id END AS uri
    FROM donor"""


def jurisdiction_lookup(spark, sf_dir):
    found = lookup.jurisdictions(jurisdiction_requests(spark, sf_dir), tables.jurisdiction(spark, sf_dir))
    return found.select("uri", "n_requests", "osm_id", "isolabel_ext", "name", "admin_level")


def donor_lookup(spark, sf_dir):
    """The published answer: donors with their totals, names and URLs found by the stored index of pieces."""
    donor = tables.donor(spark, sf_dir)
    index = scratch_path(spark, "donor-index")
    lookup.store_donor_index(donor, index)
    totals = catalogue.donors_with_totals(donor, reports._base(spark, sf_dir)).select("id", "kx")
    found = lookup.donors(donor_requests(spark, sf_dir), donor.join(cut(totals), "id"), index)
    return found.select(
        "uri", "n_requests", "id", "scope", "shortname", "legalname", "kx_vat_id", "kx.n_packs", "kx.n_files", "kx.tot_bytes"
    )


def _origins(spark, sf_dir):
    cat = tables.catalogue(spark, sf_dir)
    return lookup.origins(origin_requests(spark, sf_dir), tables.origin_by_id(spark, sf_dir), **cat)


def origin_lookup(spark, sf_dir):
    return _origins(spark, sf_dir).select(
        "uri", "n_requests", "id", "jurisd_osm_id", "ctype", "pack_id", "fhash", "fname",
        F.col("kx.donor.id").alias("donor_id"), F.col("kx.jurisd.isolabel_ext").alias("label"),
        F.col("kx.pack.accepted_date").alias("accepted_date"),
    )


def origin_answer_counts(spark, sf_dir):
    return lookup.answer_counts(origin_requests(spark, sf_dir), _origins(spark, sf_dir))


def hash_prefix_lookup(spark, sf_dir):
    """Files by the first four to eleven digits of a hash, asked once per part."""
    key = F.col("p_partkey")
    uri = F.concat(
        F.lit("SHA256:"),
        F.expr("left(sha2(concat_ws('-', cast(p_partkey as string), '1', cast(p_partkey as string)), 256), "
               "cast(4 + p_partkey % 8 as int))"),
    )
    requests = read(spark, sf_dir, "part").select(key.alias("request_id"), uri.alias("uri"))
    found = lookup.origins(requests, tables.origin_by_id(spark, sf_dir), **tables.catalogue(spark, sf_dir))
    return found.select("uri", "n_requests", "id", "fhash", "fname")


def request_errors(spark, sf_dir):
    requests = jurisdiction_requests(spark, sf_dir).unionByName(
        read(spark, sf_dir, "region").select((-F.col("r_regionkey").cast("long")).alias("request_id"), F.lit("a/b/c").alias("uri"))
    )
    answers = lookup.jurisdictions(requests, tables.jurisdiction(spark, sf_dir))
    return lookup.unanswered(requests, answers, schemas.REQUEST_ERRORS)


def split_requests(spark, sf_dir):
    urls = read(spark, sf_dir, "pages").select(
        "page_id", F.regexp_replace("url", "^https?://[^/]+", "/Intake/Check/").alias("uri")
    )
    df = lookup.split_requests(urls, ["intake", "check"])
    return df.select("page_id", "uri", F.array_join("parts", "|").alias("parts"), F.size("parts").alias("n_parts"))


def _api_urls(spark, sf_dir):
    """Calls to the published endpoints, made from page addresses."""
    i, lang = F.col("page_id"), F.regexp_extract("url", r"//[^/]+/([a-z]+)/", 1)
    number = F.regexp_extract("url", r"/([0-9]+)", 1)
    ext = F.element_at(F.array(F.lit(""), F.lit(".json"), F.lit(".csv"), F.lit(".xml")), (i % 4 + 1).cast("int"))
    tail = F.when(i % 5 == 0, "").when(i % 5 == 1, "/").otherwise(F.concat(F.lit("/"), number, F.lit("?limit=5")))
    return read(spark, sf_dir, "pages").select(
        "page_id", F.concat(F.lit("/v1"), ext, F.lit("/vw_"), lang, F.lit("/origin"), tail).alias("url")
    )


_API_URLS = """
    SELECT page_id, '/v1' || ['', '.json', '.csv', '.xml'][page_id % 4 + 1] || '/vw_'
           || regexp_extract(url, '//[^/]+/([a-z]+)/', 1) || '/origin' || CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN '/'
           ELSE '/' || regexp_extract(url, '/([0-9]+)', 1) || '?limit=5' END AS url
    FROM pages"""


def routed_requests(spark, sf_dir):
    return lookup.routed(_api_urls(spark, sf_dir))


def endpoint_counts(spark, sf_dir):
    return lookup.endpoint_counts(lookup.routed(_api_urls(spark, sf_dir), strict=False))


def same_vat_donors(spark, sf_dir):
    """Every tenth donor is listed again with another spelling of its VAT id."""
    donors = tables.donor(spark, sf_dir)
    again = donors.where(F.col("id") % 10 == 0).select(
        (F.col("id") + 10_000_000_000).alias("id"),
        F.concat(F.lit("cnpj:"), _text("id"), F.lit(".0001*9~")).alias("vat_id"),
    )
    return lookup.same_vat_groups(donors.select("id", "vat_id").unionByName(again))


QUERIES = {
    f.__name__: f
    for f in (
        jurisdiction_lookup, donor_lookup, origin_lookup, origin_answer_counts, hash_prefix_lookup, request_errors,
        split_requests, routed_requests, endpoint_counts, same_vat_donors,
    )
}

_ASKED = """asked AS (
        SELECT trim(lower(uri), '/') AS uri, count(*) AS n_requests, split_part(trim(lower(uri), '/'), '/', 1) AS p1,
               nullif(split_part(trim(lower(uri), '/'), '/', 2), '') AS p2
        FROM requests GROUP BY 1, 3, 4)"""
# A request is either field.operator.value or a plain code.
_TERMS = r"""terms AS (
        SELECT *, regexp_extract(p1, '^(isolabel_ext|parent_abbrev|scope|legalname|url|shortname)[.](lk|eq)[.](.+)$', 1) AS field,
               regexp_extract(p1, '^[a-z_]+[.](lk|eq)[.](.+)$', 1) AS op, regexp_extract(p1, '^[a-z_]+[.](lk|eq)[.](.+)$', 2) AS val,
               TRY_CAST(CASE WHEN regexp_matches(p1, '^[0-9]+$') THEN p1 END AS BIGINT) AS num,
               TRY_CAST(CASE WHEN regexp_matches(p2, '^[0-9]+$') THEN p2 END AS INTEGER) AS num2,
               TRY_CAST(regexp_extract(p1, '^q([0-9]+)$', 1) AS BIGINT) AS wiki,
               CASE WHEN length(p1) = 9 AND left(p1, 3) = 'br-' AND p1[6] = '-' THEN 'abbrev'
                    WHEN left(p1, 3) = 'br;' AND p1[6] = ';' THEN 'name' END AS form
        FROM asked),
    plain AS (SELECT * FROM terms WHERE field = '' AND wiki IS NULL AND form IS NULL AND num IS NULL AND p1 <> '')"""
_J_FOUND = f"""{_TERMS}, answered AS (
    SELECT uri, n_requests, j.* FROM terms, jurisdiction j WHERE p1 = ''
    UNION ALL SELECT uri, n_requests, j.* FROM terms, jurisdiction j
    WHERE field = 'isolabel_ext' AND op = 'lk' AND starts_with(upper(isolabel_ext), upper(val))
    UNION ALL SELECT uri, n_requests, j.* FROM terms, jurisdiction j
    WHERE field = 'parent_abbrev' AND parent_abbrev = upper(val) AND (op = 'eq' OR starts_with(isolabel_ext, upper(val)))
    UNION ALL SELECT uri, n_requests, j.* FROM terms, jurisdiction j
    WHERE form = 'abbrev' AND left(isolabel_ext, 6) || abbrev = upper(p1)
    UNION ALL SELECT uri, n_requests, j.* FROM terms, jurisdiction j
    WHERE form = 'name' AND lower(replace(left(isolabel_ext, 6), '-', ';')) || lexlabel = p1
    UNION ALL SELECT uri, n_requests, j.* FROM terms JOIN jurisdiction j ON wikidata_id = wiki
    UNION ALL SELECT uri, n_requests, j.* FROM terms JOIN jurisdiction j ON osm_id = num WHERE p2 IS NULL
    UNION ALL SELECT uri, n_requests, j.* FROM terms JOIN jurisdiction j ON jurisd_base_id = num AND jurisd_local_id = num2
    UNION ALL SELECT uri, n_requests, j.* FROM plain JOIN jurisdiction j ON upper(isolabel_ext) = upper(p1) WHERE p2 IS NULL
    UNION ALL SELECT uri, n_requests, j.* FROM plain JOIN jurisdiction c ON c.isolabel_ext = upper(p1)
    JOIN jurisdiction j ON j.jurisd_base_id = c.jurisd_base_id AND j.jurisd_local_id = num2)"""
_D_FOUND = f"""{_TERMS}, answered AS (
    SELECT uri, n_requests, d.* FROM terms, donor d WHERE p1 = ''
    UNION ALL SELECT uri, n_requests, d.* FROM terms JOIN donor d ON id = num
    UNION ALL SELECT uri, n_requests, d.* FROM terms JOIN donor d ON wikidata_id = wiki
    UNION ALL SELECT uri, n_requests, d.* FROM terms, donor d WHERE field = 'scope' AND starts_with(scope, upper(val))
    UNION ALL SELECT uri, n_requests, d.* FROM terms, donor d WHERE field = 'shortname' AND starts_with(shortname, upper(val))
    UNION ALL SELECT uri, n_requests, d.* FROM terms, donor d WHERE field = 'legalname' AND contains(upper(legalname), upper(val))
    UNION ALL SELECT uri, n_requests, d.* FROM terms, donor d WHERE field = 'url' AND contains(url, val)
    UNION ALL SELECT uri, n_requests, d.* FROM plain JOIN donor d ON kx_vat_id = translate(p1, ',.;/-+*~', '')
    WHERE regexp_matches(p1, '^[a-z]+:')
    UNION ALL SELECT uri, n_requests, d.* FROM plain JOIN donor d ON shortname = upper(p1)
    WHERE NOT regexp_matches(p1, '^[a-z]+:'))"""
# Every row of the joined view under all names it can be asked by; requests name a field and a value, or are a number or a hash.
_O_FOUND = r"""
    SELECT uri, n_requests, s.* FROM star s JOIN (
        SELECT id, unnest([
                {'field': 'jurisd_osm_id', 'val': CAST(jurisd_osm_id AS VARCHAR)}, {'field': 'donor_id', 'val': CAST(donor_id AS VARCHAR)},
                {'field': 'jurisd_isolabel_ext', 'val': upper(jurisd_isolabel_ext)}, {'field': 'donor_shortname', 'val': donor_shortname},
                {'field': 'jurisd_state', 'val': CASE WHEN starts_with(jurisd_isolabel_ext[4:], jurisd_state) THEN jurisd_state END},
                {'field': 'id', 'val': CAST(id AS VARCHAR)}], recursive := true)
        FROM star) USING (id) JOIN (
        SELECT uri, n_requests, CASE WHEN word = '' THEN 'id' ELSE word END AS field,
               CASE WHEN word IN ('', 'jurisd_osm_id', 'donor_id') THEN CAST(TRY_CAST(val AS BIGINT) AS VARCHAR) ELSE upper(val) END AS val
        FROM (SELECT *, regexp_extract(p1, '^([a-z_]+)[.]eq[.].+$', 1) AS word,
                     regexp_extract(p1, '^([a-z_]+[.]eq[.])?(.+)$', 2) AS val FROM asked)
        WHERE word <> '' OR regexp_matches(p1, '^[0-9]+$')) USING (field, val)
    UNION ALL
    SELECT uri, n_requests, s.* FROM (
        SELECT *, regexp_extract(p1, '^sha256:([0-9a-f]{4}.*)$', 1) AS digits FROM asked) JOIN star s
    ON digits <> '' AND left(fhash, 4) = left(digits, 4) AND starts_with(fhash, digits)"""


def _star_by_id(query: str, requests: str) -> str:
    """The joined view over rows with unique ids, then the requests and their answers."""
    body = tables.COMMON["star"].replace("FROM origin o", "FROM origin_by_id o")
    head = with_tables("origin_by_id jurisdiction content_type pack donor", "")
    return f"{head}, star AS ({body}), requests AS ({requests}), {_ASKED}, found AS ({_O_FOUND}) {query}"


ORACLE = {
    "jurisdiction_lookup": with_tables("jurisdiction", f""", {_ASKED}
        , {_J_FOUND} SELECT uri, n_requests, osm_id, isolabel_ext, name, admin_level FROM answered""", requests=_J_REQUESTS),
    "donor_lookup": with_tables("star donor", f""", {_ASKED}
        , totals AS (SELECT donor_id, count(DISTINCT pack_id) AS n_packs, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS tot_bytes
                     FROM star GROUP BY donor_id)
        , {_D_FOUND} SELECT uri, n_requests, id, scope, shortname, legalname, kx_vat_id, n_packs, n_files, tot_bytes
        FROM answered LEFT JOIN totals ON donor_id = id""", requests=_D_REQUESTS),
    "origin_lookup": _star_by_id("""
        SELECT uri, n_requests, id, jurisd_osm_id, ctype, pack_id, fhash, fname, donor_id, jurisd_isolabel_ext AS label,
               accepted_date FROM found""", _O_REQUESTS),
    "origin_answer_counts": _star_by_id("""
        SELECT a.uri, a.n_requests, count(f.uri) AS n_rows FROM asked a LEFT JOIN found f ON a.uri = f.uri
        GROUP BY 1, 2""", _O_REQUESTS),
    "hash_prefix_lookup": _star_by_id("SELECT uri, n_requests, id, fhash, fname FROM found", """
        SELECT 'SHA256:' || left(sha256(p_partkey || '-1-' || p_partkey), 4 + p_partkey % 8) AS uri FROM part"""),
    "request_errors": with_tables("jurisdiction", f""", requests AS (
            SELECT * FROM j_requests UNION ALL SELECT -r_regionkey, 'a/b/c' FROM region), {_ASKED},
        {_J_FOUND}, found AS (SELECT DISTINCT uri FROM answered)
        SELECT uri, n_requests, CASE WHEN uri = '' THEN -1 WHEN p2 IS NULL THEN -2 ELSE -3 END AS errcod,
               CASE WHEN uri = '' THEN 'empty endpoint' WHEN p2 IS NULL THEN 'incomplete endpoint'
                    ELSE 'endpoint not found' END AS errmsg
        FROM asked WHERE uri NOT IN (SELECT uri FROM found)""", j_requests=_J_REQUESTS),
    "split_requests": """
        SELECT page_id, uri, array_to_string(p[3:], '|') AS parts, len(p[3:]) AS n_parts FROM (
            SELECT *, string_split(trim(lower(uri), '/'), '/') AS p FROM (
                SELECT page_id, regexp_replace(url, '^https?://[^/]+', '/Intake/Check/') AS uri FROM pages))""",
    "routed_requests": f"""
        WITH u AS ({_API_URLS}), f AS (
            SELECT *, split_part(url, '?', 1) AS path,
                   CASE WHEN regexp_matches(split_part(url, '?', 1), '/v1(\\.json)?/[a-z_][a-z0-9_]*/[a-z_][a-z0-9_]*/.+') THEN 'json'
                        WHEN regexp_matches(split_part(url, '?', 1), '/v1\\.csv/[a-z_][a-z0-9_]*/[a-z_][a-z0-9_]*/.+') THEN 'csv'
                   END AS format FROM u)
        SELECT page_id, url, format, CASE WHEN format IS NOT NULL THEN split_part(path, '/', 3) END AS module,
               CASE WHEN format IS NOT NULL THEN split_part(path, '/', 4) END AS function,
               CASE WHEN format IS NOT NULL THEN split_part(path, '/', 5) END AS param
        FROM f""",
    "endpoint_counts": f"""
        WITH u AS ({_API_URLS}), f AS (
            SELECT *, split_part(url, '?', 1) AS path,
                   CASE WHEN regexp_matches(url, '/v1(\\.json)?/[a-z_][a-z0-9_]*/[a-z_][a-z0-9_]*') THEN 'json'
                        WHEN regexp_matches(url, '/v1\\.csv/[a-z_][a-z0-9_]*/[a-z_][a-z0-9_]*') THEN 'csv' END AS format FROM u)
        SELECT format, CASE WHEN format IS NOT NULL THEN split_part(path, '/', 3) END AS module,
               CASE WHEN format IS NOT NULL THEN split_part(path, '/', 4) END AS function, count(*) AS n_requests,
               count(DISTINCT CASE WHEN format IS NOT NULL THEN split_part(path, '/', 5) END) AS n_params
        FROM f GROUP BY 1, 2, 3""",
    "same_vat_donors": with_tables("donor", """, every AS (
            SELECT id, vat_id FROM donor
            UNION ALL SELECT id + 10000000000, 'cnpj:' || id || '.0001*9~' FROM donor WHERE id % 10 = 0),
        keyed AS (SELECT *, lower(regexp_replace(vat_id, '[,\\.;/\\-\\+\\*~]+', '', 'g')) AS kx_vat_id FROM every)
        SELECT id, vat_id, kx_vat_id, count(*) OVER w AS n_donors, min(id) OVER w AS first_id FROM keyed
        WINDOW w AS (PARTITION BY kx_vat_id) QUALIFY count(*) OVER w > 1"""),
}
