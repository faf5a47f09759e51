"""The joined catalogue and the reports over it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrashelf.session import cut, hinted


def pack_donors(pack: DataFrame, donor: DataFrame) -> DataFrame:
    """Packs with their donor's columns, one row per pack.

    Joined before the fact table is touched, so that files are matched once, on pack_id, and never
    shuffled on donor_id, where one donor may own a third of them.
    """
    d = donor.select(
        F.col("id").alias("donor_id"),
        F.col("vat_id").alias("donor_vat_id"),
        F.col("shortname").alias("donor_shortname"),
        F.col("legalname").alias("donor_legalname"),
        F.col("url").alias("donor_url"),
    )
    return pack.select("pack_id", "donor_id", "user_resp", "accepted_date", "config_commom").join(d, "donor_id")


#: The most bytes, counted as JSON with all names, of the jurisdictions that are sent to every task.
JURISDICTION_BYTES = 128 * 1024 * 1024


def star(
    origin: DataFrame, jurisdiction: DataFrame, content_type: DataFrame, pack: DataFrame, donor: DataFrame
) -> DataFrame:
    """Every origin row with its jurisdiction, content type, pack and donor; unmatched rows drop out.

    The packs come first, so that files are shuffled once and without the texts of the other tables; jurisdictions, content
    types join where the rows then lie.
    """
    j = jurisdiction.select(
        F.col("osm_id").alias("jurisd_osm_id"),
        F.col("name").alias("jurisd_name"),
        F.col("parent_abbrev").alias("jurisd_state"),
        F.col("abbrev").alias("jurisd_abbrev3"),
        F.col("isolabel_ext").alias("jurisd_isolabel_ext"),
        "jurisd_base_id",
        F.col("parent_id").alias("jurisd_parent_id"),
        F.col("admin_level").alias("jurisd_admin_level"),
    )
    ct = content_type.select(
        F.col("label").alias("ctype"), F.col("id").alias("ctype_id"), F.col("model_geo").alias("ctype_model_geo")
    )
    packs = pack_donors(pack, donor)
    joined = origin.join(packs, "pack_id").join(hinted(j, JURISDICTION_BYTES), "jurisd_osm_id").join(F.broadcast(ct), "ctype")
    named = ["pack_id", "jurisd_osm_id", "ctype"]
    return joined.select(*named, *[c for df in (origin, ct, j, packs) for c in df.columns if c not in named])


def file_totals(origin: DataFrame) -> DataFrame:
    """Files and bytes per (pack, jurisdiction, content type): the only fact columns the reports need.

    The partial aggregate runs before the first shuffle, so a hot pack reaches the joins as at most
    jurisdictions x content types rows.
    """
    return origin.groupBy("pack_id", "jurisd_osm_id", "ctype").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("fmeta.size").alias("bytes")
    )


#: Files that one task of a report joins and counts, so that its memory does not grow with the table.
TASK_FILES = 400_000


def report_base(origin, jurisdiction, content_type, pack, donor) -> DataFrame:
    """The joined view over ``file_totals``, dealt by pack to as many tasks as the files need."""
    tasks = max(origin.sparkSession.sparkContext.defaultParallelism, origin.count() // TASK_FILES + 1)
    return star(file_totals(origin).repartition(tasks, "pack_id"), jurisdiction, content_type, pack, donor)


def _with_pack_once(base: DataFrame, keys: list) -> DataFrame:
    """``base`` with ``_pack``, which is 1 in one row per group and pack and 0 in the others: its sum counts distinct packs.

    Rows of a pack lie in one task, so this is no further exchange, where a distinct count sends each pack of each group on.
    """
    rows = Window.partitionBy(*keys, "pack_id").orderBy("pack_id")
    return base.withColumn("_pack", ((F.row_number().over(rows) == 1) & F.col("pack_id").isNotNull()).cast("long"))


def country_report(base: DataFrame) -> DataFrame:
    """Files, packs, jurisdictions and megabytes per base id and country."""
    keys = ["jurisd_base_id", "country"]
    return (
        _with_pack_once(base.withColumn("country", F.substring("jurisd_isolabel_ext", 1, 2)), keys)
        .groupBy(*keys)
        .agg(
            F.sum("n_files").alias("n_files"),
            F.sum("_pack").alias("n_packs"),
            F.count_distinct("jurisd_osm_id").alias("n_jurisds"),
            F.sum("bytes").alias("_bytes"),
        )
        .select(
            "jurisd_base_id",
            "country",
            F.col("n_files").alias("orig_n_files"),
            F.col("n_packs").alias("orig_n_packs"),
            "n_files",
            "n_packs",
            "n_jurisds",
            F.round(F.col("_bytes").cast("decimal(30,0)") / F.lit(1000000).cast("decimal(7,0)"), 0)
            .cast("long")
            .alias("orig_mb"),
        )
    )


def state_report(base: DataFrame) -> DataFrame:
    """Files, packs, donors, jurisdictions and bytes per base id, state and level."""
    keys = ["jurisd_base_id", "jurisd_state", "jurisd_admin_level"]
    return _with_pack_once(base, keys).groupBy(*keys).agg(
        F.sum("n_files").alias("n_files"),
        F.sum("_pack").alias("n_packs"),
        F.count_distinct("donor_id").alias("n_donors"),
        F.count_distinct("jurisd_osm_id").alias("n_jurisds"),
        F.sum("bytes").alias("bytes"),
    )


def donor_report(base: DataFrame) -> DataFrame:
    """Files, packs, jurisdictions and bytes per donor."""
    keys = ["donor_id", "donor_shortname", "donor_legalname"]
    return _with_pack_once(base, keys).groupBy(*keys).agg(
        F.sum("n_files").alias("n_files"),
        F.sum("_pack").alias("n_packs"),
        F.count_distinct("jurisd_osm_id").alias("n_jurisds"),
        F.sum("bytes").alias("bytes"),
    )


def donors_with_totals(donor: DataFrame, base: DataFrame) -> DataFrame:
    """All donors; ``kx`` holds pack, file and byte totals and is null for a donor without packs."""
    totals = _with_pack_once(base, ["donor_id"]).groupBy(F.col("donor_id").alias("id")).agg(
        F.sum("_pack").alias("n_packs"),
        F.sum("n_files").alias("n_files"),
        F.sum("bytes").alias("tot_bytes"),
    )
    kx = F.when(F.col("n_packs").isNotNull(), F.struct("n_packs", "n_files", "tot_bytes"))
    return donor.drop("kx_vat_id").join(totals, "id", "left").select(
        *[c for c in donor.columns if c != "kx_vat_id"], kx.alias("kx")
    )


def rounded_means(df: DataFrame, keys: list[str], value: str, digits: int) -> DataFrame:
    """Sum and mean of ``value`` per group, the mean rounded half away from zero."""
    total = F.sum(F.col(value).cast("decimal(28,0)"))
    mean = F.round(total.cast("decimal(28,0)") / F.count(value).cast("decimal(10,0)"), digits)
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"), total.cast("long").alias("total"), mean.cast("double").alias("mean")
    )


def source_list(starred: DataFrame, pack: DataFrame) -> DataFrame:
    """Origins and packs in one list; packs carry their negative id, equal rows fold into one."""
    columns = ["id", "pack_id", "donor_id", "user_resp", "accepted_date", "jurisd_isolabel_ext"]
    packs = pack.select(
        (-F.col("pack_id")).cast("long").alias("id"),
        "pack_id",
        "donor_id",
        "user_resp",
        "accepted_date",
        F.col("escopo").alias("jurisd_isolabel_ext"),
    )
    return starred.select(*columns).unionByName(packs).distinct()


def public_dump(origin: DataFrame) -> DataFrame:
    """Origin rows fit for publication: no local paths or file dates, sorted by id over ranges."""
    return (
        origin.select(
            "id", "jurisd_osm_id", "ctype", "pack_id", "fhash", "fname", "fversion", "is_valid",
            F.col("fmeta").dropFields("fpath", "creation", "modification").alias("fmeta"),
            "config", "ingest_instant",
        )
        .repartitionByRange("id")
        .sortWithinPartitions("id")
    )


PUBLISHED = ["jurisdiction", "donor", "donatedPack", "origin", "origin_content_type", "auth_user"]


def publish(tables: dict[str, DataFrame]) -> None:
    """Register the six published tables as read-only views."""
    missing = [name for name in PUBLISHED if name not in tables]
    if missing:
        raise ValueError(f"tables missing: {missing}")
    for name in PUBLISHED:
        tables[name].createOrReplaceTempView(name)


#: The administrative levels of a country, a state and a municipality.
LEVELS = {"country": 2, "state": 4, "municipality": 8}


def _climbed(jurisdiction: DataFrame) -> DataFrame:
    """osm_id with the label of its nearest ancestor, itself included, at each of ``LEVELS``, and ``up``: null at a chain's end.

    Each round doubles how far a row has looked: it takes over what the row it has reached knows, and where that one has
    got to. A chain of n rows needs about log2(n) rounds; after as many as the whole table could need, a row that still
    goes up leads into a cycle.
    """
    at = lambda level: F.when(F.col("admin_level") == level, F.col("isolabel_ext"))
    rows = cut(jurisdiction.select("osm_id", F.col("parent_id").alias("up"), *[at(n).alias(name) for name, n in LEVELS.items()]))
    done = []
    for _ in range(rows.count().bit_length() + 1):
        reached = rows.select(
            F.col("osm_id").alias("up"), F.col("up").alias("_next"), *[F.col(name).alias(f"_{name}") for name in LEVELS])
        for ended in done:
            reached = reached.unionByName(ended.select(
                F.col("osm_id").alias("up"), F.col("up").alias("_next"), *[F.col(name).alias(f"_{name}") for name in LEVELS]))
        climbed = cut(rows.where("up IS NOT NULL").join(reached, "up", "left").select(
            "osm_id", F.col("_next").alias("up"), *[F.coalesce(name, f"_{name}").alias(name) for name in LEVELS]))
        done.append(rows.where("up IS NULL"))
        rows = climbed
        if rows.where("up IS NOT NULL").isEmpty():
            break
    return reduce(DataFrame.unionByName, done, rows)


def ancestors(jurisdiction: DataFrame) -> DataFrame:
    """Country, state and municipality columns for every jurisdiction, whatever its own level and however deep it lies.

    Of several ancestors of one level the nearest counts; a level that the row's chain lacks is null. A parent that is
    not in the table ends the chain. Rows that lead into a cycle get what lies on it (see ``ancestor_cycles``).
    """
    return _climbed(jurisdiction).select("osm_id", *LEVELS)


def ancestor_cycles(jurisdiction: DataFrame) -> DataFrame:
    """Audit rows for the jurisdictions whose chain of parents never ends."""
    return _climbed(jurisdiction).where("up IS NOT NULL").select(
        F.lit(False).alias("is_valid"), F.col("osm_id").cast("string").alias("name"), F.lit("parents form a cycle").alias("invalid_explain"))
