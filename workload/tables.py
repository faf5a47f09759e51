"""The catalogue's tables as projections of the driver tables, in Spark and as SQL common tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrashelf import schemas
from terrashelf.functions.text import vat_key


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def content_type(spark: SparkSession) -> DataFrame:
    return schemas.content_types(spark)


def _country(name: str):
    return F.when(F.col(name) == "AMERICA", "BR").otherwise(F.upper(F.substring(name, 1, 2)))


def _state():
    key = F.col("n_nationkey")
    return F.concat(F.chr((65 + F.floor(key / 5)).cast("int")), F.chr((65 + key % 5).cast("int")))


def _abbrev3():
    key = F.col("s_suppkey")
    letter = lambda step: F.chr((65 + F.floor(key / step) % 26).cast("int"))
    return F.concat(letter(676), letter(26), letter(1))


def jurisdiction(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation, supplier = (read(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    nation = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    town = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    country = _country("r_name")

    def shaped(df, osm_id, local_id, parent_id, level, name, parent, abbrev, wikidata, lexlabel, label):
        return df.select(
            osm_id.cast("long").alias("osm_id"),
            (70 + F.col("r_regionkey")).cast("int").alias("jurisd_base_id"),
            local_id.cast("int").alias("jurisd_local_id"),
            parent_id.cast("long").alias("parent_id"),
            F.lit(level).cast("short").alias("admin_level"),
            name.alias("name"),
            parent.alias("parent_abbrev"),
            abbrev.alias("abbrev"),
            wikidata.cast("long").alias("wikidata_id"),
            lexlabel.alias("lexlabel"),
            label.alias("isolabel_ext"),
            F.lit(None).cast("int").alias("ddd"),
            F.lit(None).cast("string").alias("info"),
        )

    countries = shaped(
        region, 1000 + F.col("r_regionkey"), F.lit(0), F.lit(None), 2, F.lower("r_name"), F.lit("INT"), country,
        900000 + F.col("r_regionkey"), F.translate(F.lower("r_name"), " ", "."), country,
    )
    states = shaped(
        nation, 2000 + F.col("n_nationkey"), 1 + F.col("n_nationkey"), 1000 + F.col("r_regionkey"), 4,
        F.lower("n_name"), country, _state(), 910000 + F.col("n_nationkey"),
        F.translate(F.lower("n_name"), "_", "."), F.concat(country, F.lit("-"), _state()),
    )
    number = F.col("s_suppkey").cast("string")
    towns = shaped(
        town, 100000 + F.col("s_suppkey"), 1000 + F.col("s_suppkey"), 2000 + F.col("n_nationkey"), 8,
        F.concat(F.lit("town "), number), _state(), _abbrev3(), 1000000 + F.col("s_suppkey"),
        F.concat(F.lit("town."), number), F.concat(country, F.lit("-"), _state(), F.lit("-Town"), number),
    )
    return countries.unionByName(states).unionByName(towns)


def donor(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation").join(
        read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    key = F.col("c_custkey").cast("string")
    vat = F.concat(F.lit("CNPJ:"), key, F.lit("/0001-9"))
    return read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("id"),
        F.concat(_country("r_name"), F.lit("-"), _state()).alias("scope"),
        F.upper("c_mktsegment").alias("shortname"),
        vat.alias("vat_id"),
        F.col("c_name").alias("legalname"),
        (F.col("c_custkey") + 100000).alias("wikidata_id"),
        F.concat(F.lit("https://donor"), key, F.lit(".example.org")).alias("url"),
        F.lit(None).cast("string").alias("info"),
        vat_key(vat).alias("kx_vat_id"),
    )


def pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("pack_id"),
        F.col("o_custkey").alias("donor_id"),
        F.col("o_orderpriority").alias("user_resp"),
        F.col("o_orderdate").cast("date").alias("accepted_date"),
        F.col("o_orderstatus").alias("escopo"),
        F.lit(None).cast("string").alias("about"),
        F.lit(None).cast("string").alias("config_commom"),
        F.lit(None).cast("string").alias("info"),
    )


def auth_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("username"), F.lit(None).cast("string").alias("info")
    ).distinct()


def origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per lineitem; ids repeat where the source repeats (l_orderkey, l_linenumber)."""
    return _as_origins(read(spark, sf_dir, "lineitem"))


def _origin_id():
    return F.col("l_orderkey") * 100 + F.col("l_linenumber")


def _as_origins(lineitem: DataFrame, number=None) -> DataFrame:
    labels = F.array(*[F.lit(label) for _, label, *_ in schemas.CONTENT_TYPES[:15]])
    text = lambda c: F.col(c).cast("string")
    fname = F.concat(F.lit("f"), text("l_partkey"), F.lit(".zip"))
    return lineitem.select(
        (_origin_id() if number is None else number).alias("id"),
        (F.col("l_suppkey") + 100000).alias("jurisd_osm_id"),
        F.element_at(labels, F.col("l_linenumber") + 1).alias("ctype"),
        F.col("l_orderkey").alias("pack_id"),
        F.sha2(F.concat_ws("-", text("l_orderkey"), text("l_linenumber"), text("l_partkey")), 256).alias("fhash"),
        fname.alias("fname"),
        F.lit(1).cast("short").alias("fversion"),
        F.lit(None).cast("array<string>").alias("kx_cmds"),
        F.lit(True).alias("is_valid"),
        (F.col("l_linestatus") == "O").alias("is_open"),
        F.struct(
            F.col("l_extendedprice").cast("long").alias("size"),
            F.concat(F.lit("/in/"), fname).alias("fpath"),
            F.lit(None).cast("string").alias("creation"),
            F.lit(None).cast("string").alias("modification"),
        ).alias("fmeta"),
        F.lit(None).cast("string").alias("config"),
        F.col("l_shipdate").alias("ingest_instant"),
        "l_partkey",
        "l_suppkey",
    )


def origin_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per id: of repeated ids the row with the smallest part, then supplier and price.

    Rows are dealt by id before they are grouped, so that what is joined on id finds them where they lie.
    """
    order = F.struct("l_partkey", "l_suppkey", "l_extendedprice", "l_linestatus", "l_shipdate")
    dealt = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", _origin_id().alias("id"), order.alias("r")).repartition("id")
    kept = dealt.groupBy("id", "l_orderkey", "l_linenumber").agg(F.min("r").alias("r"))
    return _as_origins(kept.select("l_orderkey", "l_linenumber", "id", "r.*"), F.col("id")).drop("l_partkey", "l_suppkey")


def catalogue(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "jurisdiction": jurisdiction(spark, sf_dir),
        "content_type": content_type(spark),
        "pack": pack(spark, sf_dir),
        "donor": donor(spark, sf_dir),
    }


# The same tables for the SQL side.
_COUNTRY = "CASE WHEN r_name = 'AMERICA' THEN 'BR' ELSE upper(left(r_name, 2)) END"
_STATE = "chr(CAST(65 + n_nationkey // 5 AS INTEGER)) || chr(CAST(65 + n_nationkey % 5 AS INTEGER))"
_ABBREV3 = (
    "chr(CAST(65 + (s_suppkey // 676) % 26 AS INTEGER)) || chr(CAST(65 + (s_suppkey // 26) % 26 AS INTEGER)) "
    "|| chr(CAST(65 + s_suppkey % 26 AS INTEGER))"
)
_LABELS = "[" + ", ".join(schemas.sql_literal(r[1]) for r in schemas.CONTENT_TYPES[:15]) + "]"

COMMON = {
    "geo": f"""
        SELECT n_nationkey, n_name, r_regionkey, r_name, {_COUNTRY} AS country, {_STATE} AS state
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "jurisdiction": f"""
        SELECT CAST(1000 + r_regionkey AS BIGINT) AS osm_id, 70 + r_regionkey AS jurisd_base_id, 0 AS jurisd_local_id,
               CAST(NULL AS BIGINT) AS parent_id, 2 AS admin_level, lower(r_name) AS name, 'INT' AS parent_abbrev,
               {_COUNTRY} AS abbrev, CAST(900000 + r_regionkey AS BIGINT) AS wikidata_id,
               replace(lower(r_name), ' ', '.') AS lexlabel, {_COUNTRY} AS isolabel_ext
        FROM region
        UNION ALL
        SELECT 2000 + n_nationkey, 70 + r_regionkey, 1 + n_nationkey, 1000 + r_regionkey, 4, lower(n_name), country,
               state, 910000 + n_nationkey, replace(lower(n_name), '_', '.'), country || '-' || state
        FROM geo
        UNION ALL
        SELECT 100000 + s_suppkey, 70 + r_regionkey, CAST(1000 + s_suppkey AS INTEGER), 2000 + n_nationkey, 8,
               'town ' || s_suppkey, state, {_ABBREV3}, 1000000 + s_suppkey, 'town.' || s_suppkey,
               country || '-' || state || '-Town' || s_suppkey
        FROM supplier JOIN geo ON s_nationkey = n_nationkey""",
    "content_type": f"""
        SELECT * FROM (VALUES {schemas.values_clause(schemas.CONTENT_TYPES)})
            AS t(id, label, model_geo, model_septable, is_useful, score)""",
    "donor": """
        SELECT c_custkey AS id, country || '-' || state AS scope, upper(c_mktsegment) AS shortname,
               'CNPJ:' || c_custkey || '/0001-9' AS vat_id, c_name AS legalname, c_custkey + 100000 AS wikidata_id,
               'https://donor' || c_custkey || '.example.org' AS url,
               'cnpj:' || c_custkey || '00019' AS kx_vat_id
        FROM customer JOIN geo ON c_nationkey = n_nationkey""",
    "pack": """
        SELECT o_orderkey AS pack_id, o_custkey AS donor_id,
               o_orderpriority AS user_resp, CAST(o_orderdate AS DATE) AS accepted_date, o_orderstatus AS escopo
        FROM orders""",
    "origin": f"""
        SELECT l_orderkey * 100 + l_linenumber AS id, l_suppkey + 100000 AS jurisd_osm_id,
               ({_LABELS})[l_linenumber + 1] AS ctype, l_orderkey AS pack_id,
               sha256(l_orderkey || '-' || l_linenumber || '-' || l_partkey) AS fhash,
               'f' || l_partkey || '.zip' AS fname, 1 AS fversion, TRUE AS is_valid, l_linestatus = 'O' AS is_open,
               CAST(trunc(l_extendedprice) AS BIGINT) AS size, l_extendedprice AS price, l_shipdate AS ingest_instant, l_partkey, l_suppkey
        FROM lineitem""",
    "origin_by_id": """
        SELECT * FROM origin QUALIFY row_number() OVER (
            PARTITION BY id ORDER BY l_partkey, l_suppkey, price, is_open, ingest_instant) = 1""",
    "star": """
        SELECT o.*, j.name AS jurisd_name, j.parent_abbrev AS jurisd_state, j.abbrev AS jurisd_abbrev3,
               j.isolabel_ext AS jurisd_isolabel_ext, j.jurisd_base_id, j.parent_id AS jurisd_parent_id,
               j.admin_level AS jurisd_admin_level, p.donor_id, p.user_resp, d.vat_id AS donor_vat_id,
               d.shortname AS donor_shortname, d.legalname AS donor_legalname, d.url AS donor_url, p.accepted_date,
               ct.id AS ctype_id, ct.model_geo AS ctype_model_geo
        FROM origin o JOIN jurisdiction j ON o.jurisd_osm_id = j.osm_id JOIN content_type ct ON o.ctype = ct.label
             JOIN pack p ON o.pack_id = p.pack_id JOIN donor d ON p.donor_id = d.id""",
}
_NEEDS = {
    "geo": [],
    "jurisdiction": ["geo"],
    "content_type": [],
    "donor": ["geo"],
    "pack": [],
    "origin": [],
    "origin_by_id": ["origin"],
    "star": ["origin", "jurisdiction", "content_type", "pack", "donor"],
}


def with_tables(names: str, query: str, **extra: str) -> str:
    """``query`` under the common tables it names (and theirs), then ``extra`` ones in order."""
    wanted: list[str] = []

    def need(name: str) -> None:
        for other in _NEEDS[name]:
            need(other)
        if name not in wanted:
            wanted.append(name)

    for name in names.split():
        need(name)
    tables = {**{n: COMMON[n] for n in wanted}, **extra}
    return "WITH " + ",\n".join(f"{n} AS ({body})" for n, body in tables.items()) + "\n" + query
