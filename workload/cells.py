"""Distributions over grid cells, prefix joins, crosswalk, pack ids, JSON profiles and time grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrashelf.operators import crosswalk, distribution, jsonstats, packs, prefix, slots
from workload import tables
from workload.tables import read, with_tables


def _texts(df, *columns):
    """Decimals and numbers with nulls as text, so that both engines show them alike."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def cells(spark, sf_dir):
    """Files per hashed cell: five datasets, keys of five signs."""
    return read(spark, sf_dir, "lineitem").groupBy(
        (F.col("l_suppkey") % 5).alias("dataset"),
        F.substring(F.md5(F.col("l_orderkey").cast("string")), 1, 5).alias("key"),
    ).agg(F.count(F.lit(1)).alias("n"))


def mixed_cells(spark, sf_dir):
    """The same with keys of three to five signs, so that merged keys can meet kept ones."""
    return read(spark, sf_dir, "lineitem").groupBy(
        (F.col("l_suppkey") % 5).alias("dataset"),
        F.expr("left(md5(cast(l_orderkey as string)), cast(3 + l_orderkey % 3 as int))").alias("key"),
    ).agg(F.count(F.lit(1)).alias("n"))


_CELLS = """
    SELECT l_suppkey % 5 AS dataset, left(md5(CAST(l_orderkey AS VARCHAR)), 5) AS key, count(*) AS n
    FROM lineitem GROUP BY 1, 2"""
_MIXED = """
    SELECT l_suppkey % 5 AS dataset, left(md5(CAST(l_orderkey AS VARCHAR)), CAST(3 + l_orderkey % 3 AS BIGINT)) AS key,
           count(*) AS n
    FROM lineitem GROUP BY 1, 2"""


def _rollup_sql(source: str, size: int, max_cells: int, percentile: float, floor: int | None) -> str:
    """The roll-up's rounds written out as common tables."""
    parts = [f"c0 AS (SELECT dataset, key, CAST(n AS BIGINT) AS n, {size} AS size, FALSE AS done FROM ({source}))"]
    for r in range(size):
        light = "TRUE" if floor is None else f"sum(CASE WHEN small THEN n END) OVER (PARTITION BY dataset, pre, small) < {floor}"
        parts.append(f"""
            p{r} AS (SELECT dataset, max(size) - CAST(max(size) >= max(length(key)) AS INTEGER) AS cut_at, count(*) AS keys,
                            quantile_disc(n, {percentile}) AS pct
                     FROM c{r} WHERE NOT done GROUP BY dataset),
            m{r} AS (SELECT c.dataset, c.key, c.n, p.cut_at, p.cut_at IS NULL OR p.cut_at < 1 OR {max_cells} < 2
                            OR p.keys <= {max_cells} AS stop, p.pct, left(c.key, greatest(coalesce(p.cut_at, 0), 0)) AS pre,
                            c.n < p.pct AND NOT (p.cut_at < 1 OR {max_cells} < 2 OR p.keys <= {max_cells}) AS small
                     FROM c{r} c LEFT JOIN p{r} p ON c.dataset = p.dataset AND NOT c.done),
            l{r} AS (SELECT *, {light} AS light FROM m{r}),
            c{r + 1} AS (SELECT dataset, CASE WHEN small AND light THEN pre ELSE key END AS key, CAST(sum(n) AS BIGINT) AS n,
                                max(cut_at) - 1 AS size, bool_or(stop) AS done FROM l{r} GROUP BY 1, 2)""")
    return "WITH " + ",".join(parts) + f" SELECT dataset, key, n FROM c{size}"


def cell_statistics(spark, sf_dir):
    return distribution.statistics(cells(spark, sf_dir))


def cell_shares(spark, sf_dir):
    rolled = distribution.rollup(cells(spark, sf_dir), size=4)
    return distribution.shares(rolled).select("dataset", "key", "n", "total", "share")


def share_text(spark, sf_dir):
    return distribution.share_text(cells(spark, sf_dir), part_cells=1000)


def count_text_with_links(spark, sf_dir):
    df = mixed_cells(spark, sf_dir)
    return distribution.share_text(df, percent=False, link="https://example.org/via_", separator="; ", part_cells=500)


def rollup(spark, sf_dir):
    return distribution.rollup(cells(spark, sf_dir), size=6)


def rollup_mixed_keys(spark, sf_dir):
    return distribution.rollup(mixed_cells(spark, sf_dir), size=4, max_cells=20)


def rollup_with_floor(spark, sf_dir):
    return distribution.rollup(cells(spark, sf_dir), size=4, max_cells=50, floor=20)


def longest_prefix(spark, sf_dir):
    keys = read(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("cell"))
    listed = read(spark, sf_dir, "benchmark").select(
        F.expr("left(md5(text), cast(1 + item_id % 3 as int))").alias("prefix")
    )
    return prefix.longest_prefix(keys, "cell", listed, "prefix")


_SUBCELLS = ["0", "1", "2", "3", "4", "5", "6", "7"]


def _crosswalk(spark, sf_dir):
    """Places with listed prefixes; every other one only takes cells that go on with 0 to 7."""
    subcells = F.array(*[F.lit(s) for s in _SUBCELLS])
    return read(spark, sf_dir, "supplier").select(
        F.concat(F.lit("CO-ANT-Town"), F.col("s_suppkey").cast("string")).alias("isolabel_ext"),
        F.upper(F.substring(F.md5(F.col("s_name")), 32, 1)).alias("subprefix"),
        F.expr("left(md5(s_name), cast(1 + s_suppkey % 3 as int))").alias("prefix"),
        F.when(F.col("s_suppkey") % 2 == 1, subcells).alias("subcells"),
    )


_CROSSWALK = """
    SELECT 'CO-ANT-Town' || s_suppkey AS isolabel_ext, upper(substr(md5(s_name), 32, 1)) AS subprefix,
           left(md5(s_name), CAST(1 + s_suppkey % 3 AS BIGINT)) AS prefix, s_suppkey % 2 = 1 AS restricted
    FROM supplier"""
_COVERS = """
    SELECT isolabel_ext, subprefix, prefix, prefix AS covers FROM crosswalk WHERE NOT restricted
    UNION ALL
    SELECT isolabel_ext, subprefix, prefix, prefix || s FROM crosswalk, (SELECT unnest(['0','1','2','3','4','5','6','7']) AS s)
    WHERE restricted"""


def crosswalk_cells(spark, sf_dir):
    codes = read(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("cell"))
    return crosswalk.cells_to_places(codes, "cell", _crosswalk(spark, sf_dir))


def crosswalk_overlaps(spark, sf_dir):
    return crosswalk.overlapping_prefixes(_crosswalk(spark, sf_dir))


def _json_docs(spark, sf_dir):
    """Event properties, some of them null, empty or nested, by event number."""
    i = F.col("event_id")
    return read(spark, sf_dir, "events").select(
        "event_id",
        F.when(i % 7 == 0, '{"k":null}')
        .when(i % 11 == 0, "{}")
        .when(i % 13 == 0, F.concat(F.lit('{"k":'), i.cast("string"), F.lit(',"note":null,"tag":"x"}')))
        .otherwise(F.col("props")).alias("props"),
    )


_DOCS = """
    SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '{"k":null}' WHEN event_id % 11 = 0 THEN '{}'
        WHEN event_id % 13 = 0 THEN '{"k":' || event_id || ',"note":null,"tag":"x"}' ELSE props END AS props
    FROM events"""


def json_key_profile(spark, sf_dir):
    return jsonstats.key_profile(_json_docs(spark, sf_dir), "props")


def json_object_sizes(spark, sf_dir):
    return _texts(jsonstats.object_sizes(_json_docs(spark, sf_dir), "props"), "n_keys", "longest_key")


def json_without_nulls(spark, sf_dir):
    docs = _json_docs(spark, sf_dir).withColumn(
        "props",
        F.when(F.col("event_id") % 17 == 0, F.concat(F.lit('{"a":{"b":null,"c":[null,{"d":null}]},"e":'),
               F.col("event_id").cast("string"), F.lit("}"))).otherwise(F.col("props")),
    )
    return jsonstats.stripped(docs, "props", keep_empty=False)


def dropped_json_keys(spark, sf_dir):
    return jsonstats.dropped_keys(_json_docs(spark, sf_dir), "props")


def json_member(spark, sf_dir):
    return jsonstats.one_member(_json_docs(spark, sf_dir), "event_id", "props", "k", "value")


def _json_arrays(spark, sf_dir):
    i = F.col("event_id")
    return read(spark, sf_dir, "events").select(
        "event_id",
        F.when(i % 9 == 0, None).when(i % 8 == 0, "[]").otherwise(
            F.concat(F.lit('["'), F.col("event_type"), F.lit('","u'), F.col("user_id").cast("string"), F.lit('"]'))
        ).alias("tags"),
    )


_ARRAYS = """
    SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 8 = 0 THEN '[]'
        ELSE '["' || event_type || '","u' || user_id || '"]' END AS tags, event_type, user_id FROM events"""


def json_array_elements(spark, sf_dir):
    return _texts(jsonstats.array_elements(_json_arrays(spark, sf_dir), "event_id", "tags"), "pos")


def json_element_counts(spark, sf_dir):
    return jsonstats.element_counts(_json_arrays(spark, sf_dir), "tags")


def flag_outcomes(spark, sf_dir):
    raw = F.element_at(
        F.array(F.lit(None), F.lit(""), F.lit("No"), F.lit("0"), F.lit("yes"), F.lit(" no")),
        (F.col("event_id") % 6 + 1).cast("int"),
    )
    return _texts(jsonstats.flag_outcomes(read(spark, sf_dir, "events").select(raw.alias("flag")), "flag"), "outcome")


def slot_counts(spark, sf_dir):
    return slots.slot_counts(read(spark, sf_dir, "events"), "ts", 5, ["event_type"])


def slot_counts_text(spark, sf_dir):
    return slots.slot_counts(read(spark, sf_dir, "events"), "ts", 15, [], "HH:mm")


def _written_packs(spark, sf_dir):
    """Pack ids in three ways of writing, chosen by order number."""
    from terrashelf.functions import packid

    i, version = F.col("o_orderkey"), (F.col("o_custkey") % 1003 - 1).cast("int")
    orders = read(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_orderkey") % 500).cast("int").alias("no"), version.alias("version")
    )
    texts = F.concat_ws("_", F.col("no").cast("string"), F.col("version").cast("string"))
    form = F.when(i % 3 == 0, "text").when(i % 3 == 1, "pair").otherwise("decimal")
    written = F.when(i % 3 == 0, texts).when(i % 3 == 1, F.concat_ws(",", "no", "version")).otherwise(
        F.concat(F.col("no").cast("string"), F.lit("."), F.lpad(F.abs("version").cast("string"), 3, "0"))
    )
    value = F.when(i % 3 == 1, packid.from_parts(F.col("no"), F.col("version"))).otherwise(
        packid.from_text(written)
    )
    return orders.select("o_orderkey", written.alias("written"), form.alias("_form"), value.alias("_value"))


def pack_id_audit(spark, sf_dir):
    df = packs.audited(_written_packs(spark, sf_dir), F.col("_form"), F.col("_value"))
    return _texts(df.drop("_form", "_value"), "pack_id", "next_pack_id", "pack", "version")


def pack_id_collisions(spark, sf_dir):
    audit = packs.audited(_written_packs(spark, sf_dir), F.col("_form"), F.col("_value"))
    return _texts(packs.colliding_forms(audit, "written"), "pack_id")


def _pack_rows(spark, sf_dir):
    from terrashelf.functions import packid

    return read(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("user_resp"),
        packid.from_parts(F.col("o_orderkey"), (F.col("o_custkey") % 900).cast("int")).alias("pack_id"),
    )


def highest_pack(spark, sf_dir):
    return _texts(packs.highest(_pack_rows(spark, sf_dir), ["user_resp"]), "max_pack_id", "next_pack_id")


def highest_pack_of_table(spark, sf_dir):
    return _texts(packs.highest(_pack_rows(spark, sf_dir), []), "max_pack_id", "next_pack_id")


QUERIES = {
    f.__name__: f
    for f in (
        cell_statistics, cell_shares, share_text, count_text_with_links, rollup, rollup_mixed_keys, rollup_with_floor,
        longest_prefix, crosswalk_cells, crosswalk_overlaps, json_key_profile, json_object_sizes, json_without_nulls,
        dropped_json_keys, json_member, json_array_elements, json_element_counts, flag_outcomes, slot_counts,
        slot_counts_text, pack_id_audit, pack_id_collisions, highest_pack, highest_pack_of_table,
    )
}


def _slot_sql(minutes: int) -> str:
    return (
        f"date_trunc('hour', ts) + to_minutes(CAST({minutes} * round_even((minute(ts) + "
        f"(second(ts) + (microsecond(ts) % 1000000) / 1e6) / 60) / {minutes}.0, 0) AS BIGINT))"
    )


_WRITTEN = """
    SELECT o_orderkey, no, version,
           CASE o_orderkey % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'pair' ELSE 'decimal' END AS form,
           CASE o_orderkey % 3 WHEN 0 THEN no || '_' || version WHEN 1 THEN no || ',' || version
                ELSE no || '.' || lpad(CAST(abs(version) AS VARCHAR), 3, '0') END AS written,
           CASE o_orderkey % 3
                WHEN 0 THEN TRY_CAST(replace(no || '_' || version, '_', '.') AS DECIMAL(13,3))
                WHEN 1 THEN CAST(no + CAST(CASE WHEN version <= 0 THEN 1 ELSE version END AS DECIMAL(13,3)) / 1000 AS DECIMAL(13,3))
                ELSE CAST(no || '.' || lpad(CAST(abs(version) AS VARCHAR), 3, '0') AS DECIMAL(13,3)) END AS pack_id
    FROM (SELECT o_orderkey, o_orderkey % 500 AS no, o_custkey % 1003 - 1 AS version FROM orders)"""
_AUDIT = """
    SELECT *, CAST(trunc(pack_id) AS BIGINT) AS pack,
           CAST(round((pack_id - trunc(pack_id)) * 1000, 0) AS BIGINT) AS ver
    FROM written"""
_THREE = "format('{:03d}', pack)"

ORACLE = {
    "cell_statistics": f"""
        SELECT dataset, count(*) AS keys, CAST(sum(n) AS BIGINT) AS n_tot, CAST(round(avg(n)) AS BIGINT) AS n_avg,
               CAST(round(stddev_pop(n)) AS BIGINT) AS n_dev, CAST(quantile_disc(n, 0.5) AS BIGINT) AS n_median,
               min(n) AS n_min, max(n) AS n_max
        FROM ({_CELLS}) GROUP BY dataset""",
    "cell_shares": f"""
        WITH r AS ({_rollup_sql(_CELLS, 4, 10, 0.75, None)})
        SELECT dataset, key, n, CAST(sum(n) OVER w AS BIGINT) AS total,
               CAST((n * 200 + sum(n) OVER w) // (2 * sum(n) OVER w) AS BIGINT) AS share
        FROM r WINDOW w AS (PARTITION BY dataset)""",
    "share_text": f"""
        WITH s AS (SELECT dataset, key, CAST((n * 200 + sum(n) OVER w) // (2 * sum(n) OVER w) AS BIGINT) AS share,
                          (row_number() OVER (PARTITION BY dataset ORDER BY key) - 1) // 1000 AS part
                   FROM ({_CELLS}) WINDOW w AS (PARTITION BY dataset))
        SELECT dataset, part, count(*) AS cells,
               string_agg('<code>' || key || '</code>: ' || share || '%', ', ' ORDER BY key) AS text
        FROM s GROUP BY 1, 2""",
    "count_text_with_links": f"""
        WITH s AS (SELECT *, (row_number() OVER (PARTITION BY dataset ORDER BY key) - 1) // 500 AS part FROM ({_MIXED}))
        SELECT dataset, part, count(*) AS cells,
               string_agg('<a href="https://example.org/via_' || key || '.geojson"><code>' || key || '</code></a>: ' || n
                          || '%', '; ' ORDER BY key) AS text
        FROM s GROUP BY 1, 2""",
    "rollup": _rollup_sql(_CELLS, 6, 10, 0.75, None),
    "rollup_mixed_keys": _rollup_sql(_MIXED, 4, 20, 0.75, None),
    "rollup_with_floor": _rollup_sql(_CELLS, 4, 50, 0.75, 20),
    "longest_prefix": """
        SELECT doc_id, md5(text) AS cell, (
            SELECT arg_max(prefix, length(prefix)) FROM (
                SELECT DISTINCT left(md5(b.text), 1 + item_id % 3) AS prefix FROM benchmark b)
            WHERE starts_with(md5(d.text), prefix)) AS matched_prefix
        FROM documents d""",
    "crosswalk_cells": f"""
        WITH crosswalk AS ({_CROSSWALK}), covers AS ({_COVERS}),
        cells AS (SELECT doc_id, md5(text) AS cell FROM documents),
        best AS (SELECT doc_id, cell, max(length(covers)) AS n FROM cells JOIN covers ON starts_with(cell, covers) GROUP BY 1, 2)
        SELECT c.doc_id, c.cell, v.isolabel_ext, v.subprefix, v.prefix, substr(c.cell, length(v.prefix) + 1) AS rest
        FROM cells c LEFT JOIN best b ON c.doc_id = b.doc_id LEFT JOIN covers v ON left(c.cell, b.n) = v.covers""",
    "crosswalk_overlaps": f"""
        WITH crosswalk AS ({_CROSSWALK}), covers AS ({_COVERS})
        SELECT covers, count(*) AS n_rows, count(DISTINCT isolabel_ext) AS n_places FROM covers
        GROUP BY covers HAVING count(*) > 1""",
    "json_key_profile": f"""
        SELECT key, count(*) AS n_docs, count(*) FILTER (WHERE json_type(props, '$.' || key) = 'NULL') AS n_null,
               max(length(key)) AS key_length
        FROM (SELECT props, unnest(json_keys(props)) AS key FROM ({_DOCS})) GROUP BY key""",
    "json_object_sizes": f"""
        SELECT CAST(len(json_keys(props)) AS VARCHAR) AS n_keys,
               CAST(list_max(list_transform(json_keys(props), lambda k: length(k))) AS VARCHAR) AS longest_key,
               count(*) AS n_docs
        FROM ({_DOCS}) GROUP BY 1, 2""",
    "json_without_nulls": f"""
        SELECT event_id, CASE WHEN event_id % 17 = 0 THEN '{{"a":{{"c":[null,{{}}]}},"e":' || event_id || '}}'
            WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN NULL
            WHEN event_id % 13 = 0 THEN '{{"k":' || event_id || ',"tag":"x"}}'
            ELSE replace(props, ' ', '') END AS props FROM ({_DOCS})""",
    "dropped_json_keys": f"""
        SELECT key, count(*) AS n_dropped FROM (SELECT props, unnest(json_keys(props)) AS key FROM ({_DOCS}))
        WHERE json_type(props, '$.' || key) = 'NULL' GROUP BY key""",
    "json_member": f"""
        SELECT event_id, '{{"value":' || coalesce(CAST(json_extract(props, '$.k') AS VARCHAR), 'null') || '}}' AS slice,
               coalesce(list_contains(json_keys(props), 'k'), FALSE) AS present
        FROM ({_DOCS})""",
    "json_array_elements": f"""
        SELECT event_id, tags IS NULL AS is_null, CAST(p AS VARCHAR) AS pos, e AS element FROM ({_ARRAYS}) LEFT JOIN LATERAL (
            SELECT unnest([0, 1]) AS p, unnest([event_type, 'u' || user_id]) AS e) ON tags IS NOT NULL AND tags <> '[]'""",
    "json_element_counts": f"""
        SELECT e AS element, count(*) AS n FROM (
            SELECT unnest([event_type, 'u' || user_id]) AS e FROM ({_ARRAYS}) WHERE tags IS NOT NULL AND tags <> '[]')
        GROUP BY e""",
    "flag_outcomes": """
        SELECT raw, CASE WHEN raw IS NULL OR lower(raw) IN ('', 'null', 'empty') THEN NULL
                         WHEN lower(raw) IN ('0', 'false', 'no', 'not') THEN 'false' ELSE 'true' END AS outcome,
               count(*) AS n_rows
        FROM (SELECT CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'No' WHEN 3 THEN '0'
                     WHEN 4 THEN 'yes' ELSE ' no' END AS raw FROM events) GROUP BY 1, 2""",
    "slot_counts": f"""
        SELECT {_slot_sql(5)} AS slot, event_type, count(*) AS n FROM events GROUP BY 1, 2""",
    "slot_counts_text": f"""
        SELECT strftime({_slot_sql(15)}, '%H:%M') AS slot, count(*) AS n FROM events GROUP BY 1""",
    "pack_id_audit": f"""
        WITH written AS ({_WRITTEN}), audit AS ({_AUDIT})
        SELECT o_orderkey, written, form, CAST(pack_id AS VARCHAR) AS pack_id, CAST(pack AS VARCHAR) AS pack,
               CAST(ver AS VARCHAR) AS version,
               coalesce(pack <> 0 AND ver > 0, FALSE) AS is_valid,
               CASE WHEN pack_id IS NOT NULL THEN {_THREE} || '.' || format('{{:03d}}', ver) END AS text_point,
               CASE WHEN pack_id IS NOT NULL THEN {_THREE} || '_' || format('{{:03d}}', ver) END AS text_underscore,
               CASE WHEN pack_id IS NOT NULL THEN {_THREE} END AS text_pack,
               CAST(CAST(pack + CAST(ver + 1 AS DECIMAL(13,3)) / 1000 AS DECIMAL(13,3)) AS VARCHAR) AS next_pack_id
        FROM audit""",
    "pack_id_collisions": f"""
        WITH written AS ({_WRITTEN})
        SELECT CAST(pack_id AS VARCHAR) AS pack_id, count(*) AS n_spellings, CAST(sum(n) AS BIGINT) AS n_rows FROM (
            SELECT pack_id, form, written, count(*) AS n FROM written WHERE pack_id IS NOT NULL GROUP BY 1, 2, 3)
        GROUP BY 1 HAVING count(*) > 1""",
    "highest_pack": """
        SELECT user_resp, CAST(CAST(p AS DECIMAL(13,3)) + CAST(v AS DECIMAL(13,3)) / 1000 AS DECIMAL(13,3))::VARCHAR AS max_pack_id,
               CAST(CAST(p AS DECIMAL(13,3)) + CAST(v + 1 AS DECIMAL(13,3)) / 1000 AS DECIMAL(13,3))::VARCHAR AS next_pack_id
        FROM (SELECT o_orderpriority AS user_resp, max(o_orderkey) AS p,
                     arg_max(CASE WHEN o_custkey % 900 <= 0 THEN 1 ELSE o_custkey % 900 END, o_orderkey) AS v
              FROM orders GROUP BY 1)""",
    "highest_pack_of_table": """
        SELECT CAST(CAST(p AS DECIMAL(13,3)) + CAST(v AS DECIMAL(13,3)) / 1000 AS DECIMAL(13,3))::VARCHAR AS max_pack_id,
               CAST(CAST(p AS DECIMAL(13,3)) + CAST(v + 1 AS DECIMAL(13,3)) / 1000 AS DECIMAL(13,3))::VARCHAR AS next_pack_id
        FROM (SELECT max(o_orderkey) AS p,
                     arg_max(CASE WHEN o_custkey % 900 <= 0 THEN 1 ELSE o_custkey % 900 END, o_orderkey) AS v
              FROM orders)""",
}
