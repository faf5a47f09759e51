"""The ingest run: load deliveries, audit them, write the tables' next versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrashelf import schemas
from terrashelf.operators import audit
from terrashelf.operators.upsert import insert_ignore, upsert_donors, upsert_packs
from terrashelf.session import cut
from terrashelf.sources.csvfiles import BAD, good_rows, load_csv


def refresh(
    spark: SparkSession, current: dict[str, DataFrame], deliveries: dict[str, str], do_update: bool = False
) -> dict[str, DataFrame]:
    """Next versions of jurisdiction, donor and donatedPack from CSV folders, each written to a new path.

    Jurisdictions are insert-ignore over all their unique keys; donors and packs are upserted by id.
    ``action`` says what became of each row. Packs refer to users and donors, so those come first. Lines that cannot be
    read stay out; ``rejected_lines`` counts them.
    """
    sent = good_rows(load_csv(spark, deliveries["jurisdiction"], schemas.JURISDICTION))
    ordered = cut(sent.withColumn("_order", F.monotonically_increasing_id()))
    added = insert_ignore(current["jurisdiction"], ordered, schemas.JURISDICTION_KEYS, "_order").drop("_order")
    jurisdiction = current["jurisdiction"].withColumn("action", F.lit("kept")).unionByName(
        added.withColumn("action", F.lit("inserted"))
    )
    donor = upsert_donors(current["donor"], good_rows(load_csv(spark, deliveries["donor"], schemas.DONOR_FILE)), do_update)
    pack = upsert_packs(
        current["donatedPack"], good_rows(load_csv(spark, deliveries["donatedPack"], schemas.PACK_FILE)), do_update
    )
    return {
        name: cut(df)
        for name, df in (("jurisdiction", jurisdiction), ("donor", donor), ("donatedPack", pack))
    }


FILE_SCHEMAS = {
    "jurisdiction": schemas.JURISDICTION, "donor": schemas.DONOR_FILE, "donatedPack": schemas.PACK_FILE,
}


def rejected_lines(spark: SparkSession, deliveries: dict[str, str]) -> DataFrame:
    """Lines of each delivery that do not fit its declared columns, in the form of ``outcome_table``; zero included."""
    counted = [
        load_csv(spark, deliveries[name], schema).agg(F.count_if(F.col(BAD).isNotNull()).alias("n_rows"))
        .select(F.lit(name).alias("table"), F.lit("rejected").alias("action"), "n_rows")
        for name, schema in FILE_SCHEMAS.items()
    ]
    return reduce(DataFrame.unionByName, counted)


def outcome_table(versions: dict[str, DataFrame]) -> DataFrame:
    """Rows per table and action."""
    counted = [
        df.groupBy(F.lit(name).alias("table"), "action").agg(F.count(F.lit(1)).alias("n_rows"))
        for name, df in versions.items()
    ]
    out = counted[0]
    for other in counted[1:]:
        out = out.unionByName(other)
    return out


def key_conflicts(versions: dict[str, DataFrame]) -> DataFrame:
    """Unique keys that the next versions would break; must be empty before they are published."""
    keys = {
        "jurisdiction": schemas.JURISDICTION_KEYS, "donor": schemas.DONOR_KEYS, "donatedPack": schemas.PACK_KEYS,
    }
    out = None
    for name, df in versions.items():
        found = audit.duplicate_keys(df, keys[name]).withColumn("table", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out


def broken_references(tables: dict[str, DataFrame]) -> DataFrame:
    """Orphans over all declared references."""
    j, d, p, o = (tables[n] for n in ("jurisdiction", "donor", "donatedPack", "origin"))
    checks = [
        audit.orphans(j, "parent_id", j, "osm_id"),
        audit.orphans(p, "donor_id", d, "id"),
        audit.orphans(p, "user_resp", tables["auth_user"], "username"),
        audit.orphans(o, "jurisd_osm_id", j, "osm_id"),
        audit.orphans(o, "ctype", tables["origin_content_type"], "label"),
        audit.orphans(o, "pack_id", p, "pack_id"),
    ]
    out = checks[0]
    for other in checks[1:]:
        out = out.unionByName(other)
    return out
