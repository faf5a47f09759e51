"""Hand cases for the lookups, the router and the joined catalogue."""

from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrashelf import schemas
from terrashelf.plans import catalogue, lookup
from tests.conftest import rows
from workload import tables


@pytest.fixture(scope="module")
def jurisdiction(spark):
    data = [
        (1, 76, 0, None, 2, "brasil", "INT", "BR", 155, "brasil", "BR"),
        (2, 76, 35, 1, 4, "sao paulo", "BR", "SP", 174, "sao.paulo", "BR-SP"),
        (3, 76, 3550308, 2, 8, "sao paulo", "SP", "SPA", 8678, "sao.paulo", "BR-SP-SaoPaulo"),
        (4, 76, 3509502, 2, 8, "campinas", "SP", "CAM", 171800, "campinas", "BR-SP-Campinas"),
        (5, 170, 0, None, 2, "colombia", "INT", "CO", 739, "colombia", "CO"),
        (6, 170, 5, 5, 4, "antioquia", "CO", "ANT", None, "antioquia", "CO-ANT"),
    ]
    return spark.createDataFrame(
        data,
        "osm_id long, jurisd_base_id int, jurisd_local_id int, parent_id long, admin_level int, name string, "
        "parent_abbrev string, abbrev string, wikidata_id long, lexlabel string, isolabel_ext string",
    )


@pytest.fixture(scope="module")
def donor(spark):
    data = [
        (1, "BR-SP", "PMSP", "CNPJ:12.345/0001-9", "Prefeitura de Sao Paulo", 174, "https://sp.example.org", None, "cnpj:1234500019"),
        (2, "BR-SP", "PMC", None, "Prefeitura de Campinas", None, "https://campinas.example.org/x", None, None),
        (3, "CO", "DANE", "nit:8", "Departamento 100% _ nacional", 5, None, None, "nit:8"),
    ]
    return spark.createDataFrame(
        data,
        "id long, scope string, shortname string, vat_id string, legalname string, wikidata_id long, url string, "
        "info string, kx_vat_id string",
    )


def asked(spark, *uris):
    return spark.createDataFrame([(i, u) for i, u in enumerate(uris)], "request_id int, uri string")


@pytest.mark.parametrize("uri, ids", [
    ("", [1, 2, 3, 4, 5, 6]),
    ("///", [1, 2, 3, 4, 5, 6]),
    ("isolabel_ext.lk.br-sp", [2, 3, 4]),
    ("/isolabel_ext.lk.BR-SP-c/", [4]),
    ("parent_abbrev.lk.br", [2]),
    ("parent_abbrev.lk.sp", []),
    ("parent_abbrev.eq.sp", [3, 4]),
    ("br-sp-spa", [3]),
    ("BR;SP;sao.paulo", [3]),
    ("q8678", [3]),
    ("3", [3]),
    ("76/35", [2]),
    ("76/x", []),
    ("br-sp-campinas", [4]),
    ("br/3509502", [4]),
    ("br/x", []),
    ("isolabel_ext.lk.", []),
    ("99999999999999999999", []),
    ("isolabel_ext.lk.b_", []),
])
def test_jurisdictions(spark, jurisdiction, uri, ids):
    got = lookup.jurisdictions(asked(spark, uri), jurisdiction)
    assert sorted(r.osm_id for r in got.collect()) == ids


@pytest.mark.parametrize("uri, ids", [
    ("", [1, 2, 3]),
    ("3", [3]),
    ("Q174", [1]),
    ("scope.lk.br", [1, 2]),
    ("legalname.lk.PREFEITURA", [1, 2]),
    ("legalname.lk.s", [1, 2]),
    ("legalname.lk.0% _", [3]),
    ("legalname.lk.%", [3]),
    ("url.lk.campinas", [2]),
    ("shortname.lk.pm", [1, 2]),
    ("shortname.lk.p_", []),
    ("CNPJ:12.345.0001-9", [1]),
    ("nit:8", [3]),
    ("dane", [3]),
    ("nobody", []),
])
def test_donors(spark, donor, uri, ids):
    got = lookup.donors(asked(spark, uri), donor)
    assert sorted(r.id for r in got.collect()) == ids


@pytest.fixture(scope="module")
def origins(spark, jurisdiction, donor):
    pack = spark.createDataFrame(
        [(10, 1, "maria", "BR-SP", None), (11, 1, "joao", "BR", None), (12, 3, "maria", "CO", None)],
        "pack_id long, donor_id long, user_resp string, escopo string, config_commom string",
    ).withColumn("accepted_date", F.lit("2022-01-01").cast("date"))
    data = [
        (1, 3, "PL1", 10, "abcd11", "a.zip", 1500000), (2, 4, "PL1", 10, "abcd22", "b.zip", 1000000),
        (3, 6, "L1", 12, "ffff00", "c.zip", 3000000000), (4, 3, "none", 11, "abcd33", "d.zip", 1),
    ]
    origin = spark.createDataFrame(
        data, "id long, jurisd_osm_id long, ctype string, pack_id long, fhash string, fname string, size long"
    ).select("id", "jurisd_osm_id", "ctype", "pack_id", "fhash", "fname", F.struct("size").alias("fmeta"))
    return {
        "origin": origin, "jurisdiction": jurisdiction, "content_type": schemas.content_types(spark), "pack": pack,
        "donor": donor,
    }


@pytest.mark.parametrize("uri, ids", [
    ("jurisd_osm_id.eq.3", [1]),
    ("jurisd_osm_id.eq.x", []),
    ("jurisd_isolabel_ext.eq.br-sp-campinas", [2]),
    ("donor_id.eq.1", [1, 2]),
    ("donor_shortname.eq.dane", [3]),
    ("jurisd_state.eq.sp", [1, 2]),
    ("jurisd_state.eq.co", []),
    ("2", [2]),
    ("4", []),
    ("sha256:ABCD", [1, 2]),
    ("sha256:abcd2", [2]),
    ("sha256:abc", []),
    ("sha256:abcd.*", []),
    ("", []),
    ("donor_id.eq.", []),
])
def test_origins(spark, origins, uri, ids):
    got = lookup.origins(asked(spark, uri), **origins)
    assert sorted(r.id for r in got.collect()) == ids


@pytest.mark.parametrize("most", [-1, 1 << 30])
def test_origins_by_many_and_by_few_keys(spark, origins, monkeypatch, most):
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", most)
    monkeypatch.setattr(lookup, "JURISDICTION_BYTES", most)
    uris = ["jurisd_osm_id.eq.3", "jurisd_state.eq.sp", "donor_id.eq.1", "donor_id.eq.01", "2", "002", "9", "sha256:abcd", "sha256:abcd22", "sha256:ffff0"]
    got = lookup.origins(asked(spark, *uris, "2"), **origins).select("uri", "n_requests", "kind", "id")
    assert rows(got) == sorted([
        ("jurisd_osm_id.eq.3", 1, "jurisdiction", 1), ("jurisd_state.eq.sp", 1, "state", 1), ("jurisd_state.eq.sp", 1, "state", 2),
        ("donor_id.eq.1", 1, "donor", 1), ("donor_id.eq.1", 1, "donor", 2), ("donor_id.eq.01", 1, "donor", 1), ("donor_id.eq.01", 1, "donor", 2),
        ("2", 2, "id", 2), ("002", 1, "id", 2), ("sha256:abcd", 1, "hash", 1), ("sha256:abcd", 1, "hash", 2),
        ("sha256:abcd22", 1, "hash", 2), ("sha256:ffff0", 1, "hash", 3)], key=repr)


def test_one_row_per_id_lies_where_ids_are_joined(spark, tmp_path):
    """The files are dealt once, by id: before, once by their keys and once more, with all their texts, by id."""
    spark.sql("""SELECT CAST(id DIV 2 AS BIGINT) AS l_orderkey, 1 AS l_linenumber, id AS l_partkey, id AS l_suppkey, 1.0D AS l_extendedprice,
        'O' AS l_linestatus, TIMESTAMP_NTZ '2022-01-01 00:00:00' AS l_shipdate FROM range(20)""").write.parquet(f"{tmp_path}/lineitem.parquet")
    origin = tables.origin_by_id(spark, str(tmp_path))
    found = origin.join(spark.range(300).hint("merge"), "id")
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    assert rows(found.select("id", "fname")) == [(1, "f0.zip"), (101, "f2.zip"), (201, "f4.zip")]


def test_answers_are_counted_per_distinct_uri(spark, origins):
    requests = asked(spark, "donor_id.eq.1", "/DONOR_ID.eq.1/", "donor_id.eq.9", "", "a/b")
    answers = lookup.origins(requests, **origins)
    assert rows(lookup.answer_counts(requests, answers)) == [
        ("", 1, 0), ("a/b", 1, 0), ("donor_id.eq.1", 2, 2), ("donor_id.eq.9", 1, 0)
    ]
    lost = lookup.unanswered(requests, answers, schemas.REQUEST_ERRORS)
    assert rows(lost.select("uri", "errcod")) == [("", -1), ("a/b", -3), ("donor_id.eq.9", -2)]


def test_reports(spark, origins):
    base = catalogue.report_base(**origins)
    assert rows(catalogue.country_report(base)) == [(170, "CO", 1, 1, 1, 1, 1, 3000), (76, "BR", 2, 1, 2, 1, 2, 3)]
    assert rows(catalogue.donor_report(base)) == [
        (1, "PMSP", "Prefeitura de Sao Paulo", 2, 1, 2, 2500000),
        (3, "DANE", "Departamento 100% _ nacional", 1, 1, 1, 3000000000),
    ]
    totals = catalogue.donors_with_totals(origins["donor"], base)
    assert totals.where("kx IS NULL").select("id").collect() == [(2,)]
    starred = catalogue.star(**origins)
    listed = rows(catalogue.source_list(starred, origins["pack"]).select("id", "pack_id", "jurisd_isolabel_ext"))
    assert listed == sorted(
        [(1, 10, "BR-SP-SaoPaulo"), (2, 10, "BR-SP-Campinas"), (3, 12, "CO-ANT"), (-10, 10, "BR-SP"), (-11, 11, "BR"), (-12, 12, "CO")],
        key=repr,
    )


def test_reports_deal_packs_by_the_number_of_files(spark, origins, monkeypatch):
    """Tasks hold a bounded number of files, and packs are counted where they lie: before, each was sent on once per group."""
    many = {**origins, "origin": reduce(DataFrame.unionByName, [origins["origin"]] * 20)}
    want = [rows(report(catalogue.report_base(**many))) for report in (catalogue.state_report, catalogue.donor_report, catalogue.country_report)]
    assert {r[:5] for r in want[1]} == {(1, "PMSP", "Prefeitura de Sao Paulo", 40, 1), (3, "DANE", "Departamento 100% _ nacional", 20, 1)}
    monkeypatch.setattr(catalogue, "TASK_FILES", 2)
    base = catalogue.report_base(**many)
    assert "REPARTITION_BY_NUM" in base._jdf.queryExecution().executedPlan().toString()
    assert [rows(report(base)) for report in (catalogue.state_report, catalogue.donor_report, catalogue.country_report)] == want


def test_packs_are_counted_once_per_group(spark):
    data = [("x", 1, 7, 1, 1), ("x", 1, 8, 1, 1), ("x", 2, 7, 1, 1), (None, 1, 7, 1, 1), (None, None, 7, 1, 1), ("y", None, 9, 2, 5)]
    base = spark.createDataFrame(data, "jurisd_state string, pack_id long, jurisd_osm_id long, n_files long, bytes long").select(
        "*", F.lit(76).alias("jurisd_base_id"), F.lit(4).alias("jurisd_admin_level"), F.lit(1).alias("donor_id"))
    found = catalogue.state_report(base)
    assert {r.jurisd_state: (r.n_files, r.n_packs, r.n_donors, r.n_jurisds) for r in found.collect()} == {
        "x": (3, 2, 1, 2), None: (2, 1, 1, 1), "y": (2, 0, 1, 1)}
    assert "Window" in found._jdf.queryExecution().optimizedPlan().toString()


def test_ancestors(spark, jurisdiction):
    got = {r.osm_id: (r.country, r.state, r.municipality) for r in catalogue.ancestors(jurisdiction).collect()}
    assert got[1] == ("BR", None, None)
    assert got[2] == ("BR", "BR-SP", None)
    assert got[4] == ("BR", "BR-SP", "BR-SP-Campinas")


def test_ancestors_of_any_depth(spark):
    schema = "osm_id long, parent_id long, admin_level int, isolabel_ext string"
    chain = [(1, None, 2, "BR"), (2, 1, 4, "BR-SP"), (3, 2, 5, "X"), (4, 3, 8, "BR-SP-C"), (5, 99, 8, "lost")]
    deep = [(100 + i, 99 + i if i else 4, 10 + i, f"d{i}") for i in range(40)]
    cycle = [(200, 202, 4, "a"), (201, 200, 6, "b"), (202, 201, 2, "c"), (203, 200, 8, "d"), (204, 204, 8, "self")]
    df = spark.createDataFrame(chain + deep + cycle, schema)
    got = {r.osm_id: (r.country, r.state, r.municipality) for r in catalogue.ancestors(df).collect()}
    assert len(got) == len(chain + deep + cycle)
    assert got[4] == ("BR", "BR-SP", "BR-SP-C") and got[3] == ("BR", "BR-SP", None) and got[5] == (None, None, "lost")
    assert all(got[100 + i] == ("BR", "BR-SP", "BR-SP-C") for i in range(40))
    assert got[203] == ("c", "a", "d")
    assert {r.name for r in catalogue.ancestor_cycles(df).collect()} == {"200", "201", "202", "203", "204"}
    assert catalogue.ancestor_cycles(spark.createDataFrame(chain, schema)).count() == 0


@pytest.mark.parametrize("url, strict, loose", [
    ("/v1/vw_core/donor/3", ("json", "vw_core", "donor", "3"), ("json", "vw_core", "donor", "3")),
    ("/v1.json/vw_core/donor/3?x=1", ("json", "vw_core", "donor", "3"), ("json", "vw_core", "donor", "3")),
    ("/v1.csv/vw_core/donor/a/b", ("csv", "vw_core", "donor", "a/b"), ("csv", "vw_core", "donor", "a/b")),
    ("/v1.csv/vw_core/donor", (None, None, None, None), ("csv", "vw_core", "donor", "")),
    ("/v1/vw_core/donor/", (None, None, None, None), ("json", "vw_core", "donor", "")),
    ("/v1.xml/vw_core/donor/3", (None, None, None, None), (None, None, None, None)),
    ("/v1/VW/donor/3", (None, None, None, None), (None, None, None, None)),
])
def test_routes(spark, url, strict, loose):
    urls = spark.createDataFrame([(url,)], "url string")
    for flag, want in ((True, strict), (False, loose)):
        assert tuple(lookup.routed(urls, strict=flag).first())[1:] == want


def test_equal_vat_ids(spark):
    df = spark.createDataFrame([(1, "CNPJ:1.2"), (2, "cnpj:12"), (3, "x"), (4, None)], "id long, vat_id string")
    assert rows(lookup.same_vat_groups(df)) == [("cnpj:12", 1, "CNPJ:1.2", 2, 1), ("cnpj:12", 2, "cnpj:12", 2, 1)]


def test_files_of_the_star_are_dealt_out_once(spark):
    """Files meet packs first, and no text of a jurisdiction goes through an exchange with them."""
    origin = spark.createDataFrame([(1, 5, "P1", 7), (2, 6, "L1", 7)], "id long, jurisd_osm_id long, ctype string, pack_id long")
    place = spark.createDataFrame(
        [(5, "n", "p", "a", "l", 1, 2, 8)],
        "osm_id long, name string, parent_abbrev string, abbrev string, isolabel_ext string, jurisd_base_id int, parent_id long, admin_level int")
    kind = spark.createDataFrame([(1, "P1", "m"), (2, "L1", "m")], "id int, label string, model_geo string")
    pack = spark.createDataFrame([(7, 3, "u", None, None)], "pack_id long, donor_id long, user_resp string, accepted_date date, config_commom string")
    giver = spark.createDataFrame([(3, "v", "s", "l", "u")], "id long, vat_id string, shortname string, legalname string, url string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        starred = catalogue.star(origin, place, kind, pack, giver)
        plan = starred._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(jurisd_osm_id" not in plan and "hashpartitioning(ctype" not in plan
        assert plan.count("hashpartitioning(pack_id") == 2
        assert [(r.id, r.jurisd_name, r.ctype_id, r.donor_id) for r in starred.collect()] == [(1, "n", 1, 3)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hash_keys_of_many_lengths_share_few_heads(spark):
    keys = [(f"{n:04x}" + "abcdef0"[:n % 8],) for n in range(300)] + [("beef" + f"{n:03x}",) for n in range(40)] + [("beef0",)]
    found = {r["key"]: r["head"] for r in lookup._heads(spark.createDataFrame(keys, "key string")).collect()}
    assert found.keys() == {k for k, in keys}
    assert all(k.startswith(h) for k, h in found.items())
    # Only the crowd under one beginning is listed deeper, and not deeper than it must.
    assert {len(h) for k, h in found.items() if not k.startswith("beef")} == {4}
    assert {h for k, h in found.items() if k.startswith("beef")} == {"beef0", "beef02", *[f"beef{n:03x}" for n in range(32)]}
