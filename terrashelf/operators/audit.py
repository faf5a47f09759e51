"""Checks that report violations as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_checks(df: DataFrame, name: Column, checks: dict[str, Column]) -> DataFrame:
    """One row per violated rule. A rule that yields null passes, as a SQL CHECK does."""
    failed = F.array_compact(F.array(*[F.when(~rule, F.lit(text)) for text, rule in checks.items()]))
    return df.select(
        F.lit(False).alias("is_valid"), name.cast("string").alias("name"), F.explode(failed).alias("invalid_explain")
    )


def not_null_checks(columns: list[str]) -> dict[str, Column]:
    return {f"{c} is null": F.col(c).isNotNull() for c in columns}


# Columns that may not be null.
DONOR_REQUIRED = ["id", "legalname"]
PACK_REQUIRED = ["pack_id", "donor_id", "user_resp", "accepted_date", "escopo"]
ORIGIN_REQUIRED = ["id", "jurisd_osm_id", "ctype", "pack_id", "fhash", "fname", "fversion", "is_valid", "is_open"]


def jurisdiction_checks() -> dict[str, Column]:
    required = ["osm_id", "jurisd_base_id", "jurisd_local_id", "admin_level", "name", "parent_abbrev", "lexlabel", "isolabel_ext"]
    return {
        **not_null_checks(required),
        "admin_level out of 1..99": F.col("admin_level").between(1, 99),
        "name of 60 or more signs": F.length("name") < 60,
        "abbrev not of 2..5 signs": F.length("abbrev").between(2, 5),
    }


def email_checks(email: str = "email") -> dict[str, Column]:
    c = F.col(email)
    return {
        "email is null": c.isNotNull(),
        "email not trimmed lower case": c == F.trim(F.lower(c)),
        "email of 3 or fewer signs": F.length(c) > 3,
        "email without @ after its first sign": F.instr(c, "@") > 1,
    }


def key_entries(keys: list[list[str]]) -> Column:
    """A row's complete unique keys as (number of the key, its values); keys with a null are left out."""
    entries = [
        F.when(
            reduce(lambda x, y: x & y, (F.col(c).isNotNull() for c in key)),
            F.struct(F.lit(i).alias("k"), F.array(*[F.col(c).cast("string") for c in key]).alias("v")),
        )
        for i, key in enumerate(keys)
    ]
    return F.array_compact(F.array(*entries))


def key_digests(keys: list[list[str]]) -> Column:
    """``key_entries`` with sixteen bytes of a SHA-256 in place of the values, for tables that only ask whether keys are equal."""
    entries = []
    for i, key in enumerate(keys):
        # Null if any part is; the lengths tell parts apart.
        values = F.concat(*[x for c in key for x in (F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string"))])
        entries.append(F.when(values.isNotNull(), F.struct(F.lit(i).alias("k"), F.unhex(F.substring(F.sha2(values, 256), 1, 32)).alias("v"))))
    return F.array_compact(F.array(*entries))


#: Keys that one task counts, so that its table of them stays in memory however many there are.
TASK_KEYS = 500_000
#: The share of rows that is looked at first, to learn how many keys there are and which values are hot; it decides no count.
LOOKED_AT = 0.001
#: Rows of a hot value, which would make its task the longest.
HOT_ROWS = 1_000_000


def _key_counts(df: DataFrame, keys: list[list[str]]) -> DataFrame:
    """Rows per (number of the key, its values).

    Nearly every key is different, so adding them up before the exchange fills memory and spills without making them fewer: they are
    dealt out as they are, to as many tasks as they need. Only rows of hot values are added up first.
    """
    entries = df.select(F.inline(key_entries(keys)))
    looked = df.sample(LOOKED_AT, seed=0).select(F.inline(key_entries(keys))).groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    hot = F.when(F.col("n") >= HOT_ROWS * LOOKED_AT, F.struct("k", "v"))
    found = looked.agg(F.sum("n").alias("n"), F.collect_list(hot).alias("hot")).first()
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int((found["n"] or 0) / LOOKED_AT / TASK_KEYS) + 1)
    total = F.count(F.lit(1)).alias("n_rows")
    if not found["hot"]:
        return entries.repartition(tasks, "k", "v").groupBy("k", "v").agg(total)
    values = F.broadcast(spark.createDataFrame(found["hot"], entries.schema))
    cold = entries.join(values, ["k", "v"], "left_anti").repartition(tasks, "k", "v").groupBy("k", "v").agg(total)
    return cold.unionByName(entries.join(values, ["k", "v"], "left_semi").groupBy("k", "v").agg(total))


def duplicate_keys(df: DataFrame, keys: list[list[str]]) -> DataFrame:
    """Key values that occur more than once, per unique key; rows with a null in the key never clash.

    All keys are counted in one pass over the table, each row listed under every key it has; a table with hot values, which
    a look at a thousandth of the rows shows, is read once more for those.
    """
    names = F.array(*[F.lit(",".join(key)) for key in keys])
    return _key_counts(df, keys).where("n_rows > 1").select(
        names[F.col("k")].alias("unique_key"), F.array_join("v", "|").alias("value"), "n_rows")


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Values of ``column`` that no parent has, with the number of child rows; nulls refer to nothing."""
    used = child.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )
    return used.join(parent.select(F.col(key).alias("value")), "value", "left_anti").select(
        F.lit(column).alias("reference"), F.col("value").cast("string").alias("value"), "n_rows"
    )


def same_content(files: DataFrame, digest: str = "fhash", name: str = "fname") -> DataFrame:
    """Contents found under more than one name: names, files, first and last name per digest."""
    named = files.groupBy(F.col(digest).alias("digest"), F.col(name).alias("name")).agg(
        F.count(F.lit(1)).alias("n_files")
    )
    return named.groupBy("digest").agg(
        F.count(F.lit(1)).alias("n_names"),
        F.sum("n_files").alias("n_files"),
        F.min("name").alias("first_name"),
        F.max("name").alias("last_name"),
    ).where("n_names > 1")


def same_content_names(files: DataFrame, digest: str = "fhash", name: str = "fname") -> DataFrame:
    """The names behind ``same_content``, one row each, so that a content with countless copies stays rows."""
    groups = same_content(files, digest, name).select("digest")
    return files.select(F.col(digest).alias("digest"), F.col(name).alias("name")).distinct().join(groups, "digest", "left_semi")


def next_versions(files: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """File version counted per key in arrival order, hot keys included."""
    from terrashelf.operators.ranking import numbered

    return numbered(files, keys, order, "next_version")


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row by ``order`` of each key, by a partial aggregate instead of a window."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")
