"""New versions of tables: insert-ignore and conditional updates as joins, since parquet has no MERGE."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrashelf.functions.text import clean_flag, vat_key
from terrashelf.operators.audit import email_checks, key_digests, key_entries, row_checks
from terrashelf.operators.components import connect
from terrashelf.operators.ranking import bucket, hot_buckets, numbered
from terrashelf.session import cut, scratch_path, ship


#: Rounds over all rows before what is left is taken apart into components.
EAGER_ROUNDS = 3
#: Entries of a component that one task scans; larger components go on in rounds.
COMPONENT_ENTRIES = 1_000_000


def _round(undecided: DataFrame, path: str) -> DataFrame:
    """Write the rows that are first in all their key groups below ``path``; gives those that clash with none of them."""
    heads = undecided.groupBy("k", "v").agg(F.min("_row").alias("_first"))
    marked = cut(undecided.join(heads, ["k", "v"]))
    winners = marked.groupBy("_row").agg(F.bool_and(F.col("_first") == F.col("_row")).alias("_take")).where("_take").select("_row")
    winners.write.mode("append").parquet(path)
    # A row clashes with a winner exactly when a winner heads one of its keys.
    settled = marked.join(winners.withColumnRenamed("_row", "_first"), "_first", "left_semi").select("_row").distinct()
    return cut(marked.join(settled, "_row", "left_anti").select("_row", "k", "v"))


def _scanned(schema: T.StructType):
    """A function that scans the entries of one component in order and keeps the rows that clash with none kept before."""

    def run(entries: pa.Table) -> pa.Table:
        ordered = entries.sort_by("_row")
        taken, kept = set(), []
        rows = zip(*(ordered.column(c).to_pylist() for c in ("_row", "k", "v")))
        for row, group in groupby(rows, key=lambda r: r[0]):
            values = [(k, tuple(v)) for _, k, v in group]
            if taken.isdisjoint(values):
                taken.update(values)
                kept.append(row)
        return pa.table([pa.array(kept, ordered.schema.field("_row").type)], names=[schema.fieldNames()[0]])

    return run


def _by_component(undecided: DataFrame, path: str, tell: Callable[[int], None]) -> DataFrame:
    """Scan every component of clashing rows in a task of its own; gives the entries of those too large for that."""
    heads = undecided.groupBy("k", "v").agg(F.min("_row").alias("_first"))
    clashes = undecided.join(heads, ["k", "v"]).select(F.col("_row").alias("a"), F.col("_first").alias("b"))
    roots = cut(connect(clashes, tell).withColumnRenamed("node", "_row"))
    rooted = cut(undecided.join(roots, "_row", "left").withColumn("root", F.coalesce("root", "_row")))
    ship(undecided.sparkSession)
    small = rooted.groupBy("root").count().where(F.col("count") <= COMPONENT_ENTRIES).select("root")
    taken = undecided.select("_row").schema
    rooted.join(small, "root").groupBy("root").applyInArrow(_scanned(taken), taken).write.mode("append").parquet(path)
    return cut(rooted.join(small, "root", "left_anti").drop("root"))


def insert_ignore(
    existing: DataFrame, incoming: DataFrame, keys: list[list[str]], order: str, report: Callable[[int], None] | None = None
) -> DataFrame:
    """Incoming rows that may be inserted when any of several unique keys must not clash.

    Gives what a scan in ``order`` (unique) gives that skips rows clashing with the table or with a
    row it took. All keys are handled in one long table of (row, key, value) without the payload.
    A round takes the rows that are first in all their key groups and drops those that clash with them. What
    ``EAGER_ROUNDS`` of them leave, chains in which each decision rests on the one before, is taken apart into
    components of clashing rows, and each is scanned in order by one task. Only components of more than
    ``COMPONENT_ENTRIES`` go on in rounds. ``report`` is told the number of rounds, those that find components included.
    """
    return insert_ignore_entries(existing.select(F.inline(key_entries(keys))), incoming, keys, order, report)


def insert_ignore_entries(
    known: DataFrame, incoming: DataFrame, keys: list[list[str]], order: str, report: Callable[[int], None] | None = None,
    listed: Callable[[list[list[str]]], Column] = key_entries,
) -> DataFrame:
    """``insert_ignore`` against the table's key entries ``known(k, v)``, as ``listed`` makes them, instead of its rows."""
    entries = incoming.select(F.col(order).alias("_row"), listed(keys).alias("_keys"))
    keyless = entries.where(F.size("_keys") == 0).select("_row")
    # Copies that agree in all keys: only the first can ever be taken.
    firsts = entries.where(F.size("_keys") > 0).groupBy("_keys").agg(F.min("_row").alias("_row"))
    offered = firsts.select("_row", F.inline("_keys"))
    clashing = offered.join(known, ["k", "v"], "left_semi").select("_row").distinct()
    undecided = offered.join(clashing, "_row", "left_anti")
    told: list[int] = []
    if len(keys) == 1:
        taken = keyless.unionByName(undecided.groupBy("k", "v").agg(F.min("_row").alias("_row")).select("_row"))
    else:
        path = scratch_path(incoming.sparkSession, "taken")
        keyless.write.parquet(path)
        while True:
            undecided = _round(undecided, path)
            told.append(1)
            if undecided.isEmpty():
                break
            if len(told) == EAGER_ROUNDS:
                undecided = _by_component(undecided, path, told.append)
                if undecided.isEmpty():
                    break
        taken = incoming.sparkSession.read.schema(keyless.schema).parquet(path)
    if report is not None:
        report(sum(told))
    return incoming.join(taken.withColumnRenamed("_row", order), order, "left_semi").select(*incoming.columns)


def insert_ignore_digests(known: DataFrame, incoming: DataFrame, keys: list[list[str]], order: str) -> DataFrame:
    """``insert_ignore`` against the table's ``key_digests`` as ``known(k, v)``.

    Under a single key whole rows are dealt out by it, once, beside the known ones, and the first of each key stays. Only keys
    that may be hot by a count of buckets, and tables with several keys, take the way through narrow entries.
    """
    if len(keys) > 1:
        return insert_ignore_entries(known, incoming, keys, order, listed=key_digests)
    v = F.get(key_digests(keys), F.lit(0))["v"]
    hot = hot_buckets(incoming.where(v.isNotNull()), v)
    is_hot = F.coalesce(bucket(v).isin(hot) & v.isNotNull(), F.lit(False))
    # A row without a key never clashes: it gets a place of its own.
    alone = F.concat(F.lit("row "), F.col(order).cast("string")).cast("binary")
    rows = incoming.where(~is_hot) if hot else incoming
    unknown = rows.withColumn("_v", F.coalesce(v, alone)).join(known.select(F.col("v").alias("_v")), "_v", "left_anti")
    first = F.row_number().over(Window.partitionBy("_v").orderBy(order))
    taken = unknown.withColumn("_nth", first).where("_nth = 1").select(*incoming.columns)
    if not hot:
        return taken
    return taken.unionByName(insert_ignore_entries(known, cut(incoming.where(is_hot)), keys, order, listed=key_digests))


def _single(incoming: DataFrame, key: str) -> DataFrame:
    """One row per key; a key that comes twice in one load is an error, as in an ON CONFLICT insert."""
    rest = [c for c in incoming.columns if c != key]
    checked = incoming.groupBy(key).agg(F.first(F.struct(*rest)).alias("_r"), F.count(F.lit(1)).alias("_n"))
    clash = F.raise_error(F.concat(F.lit(f"{key} occurs twice in one load: "), F.col(key).cast("string")))
    return checked.select(key, F.when(F.col("_n") > 1, clash.cast("void")).otherwise(F.lit(None)).alias("_check"), "_r.*") \
        .where("_check IS NULL").drop("_check")


def upsert(
    current: DataFrame, incoming: DataFrame, key: str, updated: list[str], do_update: bool
) -> DataFrame:
    """The table's next version with ``action``: inserted, updated or kept.

    On a known key the ``updated`` columns are taken over when ``do_update`` is set; the other
    columns keep their old values. Keys are unique on both sides, so the full join has no hot key.
    """
    old = current.select(F.col(key), F.struct(*current.columns).alias("_old"))
    new = _single(incoming, key).select(F.col(key), F.struct(*current.columns).alias("_new"))
    both = old.join(new, key, "full")
    known, sent = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    change = known & sent & F.lit(do_update)

    def column(c: str) -> Column:
        if c == key:
            return F.col(key)
        takes_new = ~known | (change if c in updated else F.lit(False))
        return F.when(takes_new, F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c)

    action = F.when(~known, "inserted").when(change, "updated").otherwise("kept")
    return both.select(*[column(c) for c in current.columns], action.alias("action"))


#: The column a stored table is partitioned by.
PART = "_part"


def _part(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def store(table: DataFrame, path: str, key: str, parts: int) -> None:
    """Write a table in ``parts`` partitions by the hash of its key, as ``upsert_stored`` takes it."""
    table.withColumn(PART, _part(key, parts)).repartition(PART).write.partitionBy(PART).parquet(path)


def upsert_stored(
    spark: SparkSession, path: str, incoming: DataFrame, key: str, updated: list[str], do_update: bool, parts: int
) -> DataFrame:
    """``upsert`` into the table that ``store`` wrote at ``path`` with as many ``parts``; gives key and action of the rows read.

    Only partitions that hold a key of ``incoming`` are read and written anew; the files of all others stay as they are. The
    new partitions are complete in the shared folder before the first old one is replaced.
    """
    sent = cut(incoming.withColumn(PART, _part(key, parts)))
    # At most ``parts`` numbers.
    hit = [r[0] for r in sent.select(PART).distinct().collect()]
    current = spark.read.parquet(path).where(F.col(PART).isin(hit)).drop(PART)
    new = cut(upsert(current, sent.drop(PART), key, updated, do_update))
    changed = new.drop("action").withColumn(PART, _part(key, parts)).repartition(PART)
    changed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)
    return new.select(key, "action")


DONOR_UPDATED = ["scope", "shortname", "vat_id", "legalname", "wikidata_id", "url", "kx_vat_id"]
PACK_UPDATED = ["donor_id", "user_resp", "accepted_date", "escopo", "about", "config_commom", "info"]


def upsert_donors(current: DataFrame, delivered: DataFrame, do_update: bool = False) -> DataFrame:
    """Donors by id. The search column follows vat_id; info is kept. Audit the result for key clashes."""
    rows = delivered.select(
        "id", F.col("escopo").alias("scope"), F.col("shortName").alias("shortname"), "vat_id",
        F.col("legalName").alias("legalname"), "wikidata_id", "url",
        F.lit(None).cast("string").alias("info"), vat_key(F.col("vat_id")).alias("kx_vat_id"),
    )
    return upsert(current, rows, "id", DONOR_UPDATED, do_update)


def pack_info() -> Column:
    """A pack's info object from its delivery columns, flags cleaned; nulls stay as JSON nulls."""
    return F.to_json(
        F.struct(
            "author", "contentReferenceTime", clean_flag(F.col("license_is_explicit")).alias("license_is_explicit"),
            "license", "uri_objType", "uri", clean_flag(F.col("isAt_UrbiGIS")).alias("isAt_UrbiGIS"),
        ),
        {"ignoreNullFields": "false"},
    )


def upsert_packs(current: DataFrame, delivered: DataFrame, do_update: bool = False) -> DataFrame:
    """Packs by id; info is built from the delivery, config is emptied on update."""
    rows = delivered.select(
        "pack_id", "donor_id", "user_resp", "accepted_date", "escopo", "about",
        F.lit(None).cast("string").alias("config_commom"), pack_info().alias("info"),
    )
    return upsert(current, rows, "pack_id", PACK_UPDATED, do_update)


def outcome_counts(table: DataFrame) -> DataFrame:
    return table.groupBy("action").agg(F.count(F.lit(1)).alias("n_rows"))


def with_search_key(donor: DataFrame) -> DataFrame:
    """Donors with their derived search column brought in step."""
    return donor.withColumn("kx_vat_id", vat_key(F.col("vat_id")))


def normal_emails(arrivals: DataFrame) -> DataFrame:
    return arrivals.withColumn("email", F.trim(F.lower(F.col("email"))))


def rejected_emails(arrivals: DataFrame) -> DataFrame:
    """Arrivals that the table's checks refuse, one row per broken rule."""
    cleaned = normal_emails(arrivals)
    return row_checks(cleaned, F.col("email"), email_checks())


def new_subscribers(existing: DataFrame, arrivals: DataFrame, highest: Column | None = None) -> DataFrame:
    """Rows to append for addresses not yet known, with ids that go on from the highest one.

    Ids follow first arrival, then address. ``arrivals`` has email and signature_date. Where ``highest`` is given,
    ``existing`` need only hold the addresses that may come.
    """
    rules = reduce(lambda a, b: a & b, email_checks().values())
    firsts = normal_emails(arrivals).where(rules).groupBy("email").agg(F.min("signature_date").alias("signature_date"))
    unknown = firsts.join(existing.select("email"), "email", "left_anti")
    if highest is None:
        highest = existing.agg(F.coalesce(F.max("cust_id"), F.lit(0).cast("long"))).scalar()
    return (
        numbered(unknown, [], ["signature_date", "email"], "_nth")
        .withColumn("_highest", highest)
        .select(
            (F.col("_highest") + F.col("_nth")).alias("cust_id"), "email", "signature_date",
            F.lit(False).alias("is_valid"), F.lit(False).alias("confirmed"),
        )
    )
