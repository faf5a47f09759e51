"""The batch jobs run over file streams until the input is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrashelf.session import COMPRESSION, scratch_path
from terrashelf.streaming import arrivals, slotstream
from workload import maintenance, tables
from workload.tables import read, with_tables


def _stream(spark, sf_dir, name):
    """A table's file as a stream."""
    return spark.readStream.schema(read(spark, sf_dir, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _finish(writer, spark) -> str:
    """Run the stream over all of its input; gives its checkpoint."""
    checkpoint = scratch_path(spark, "stream")
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return checkpoint


def slot_stream(spark, sf_dir):
    """Ten-minute counts per event type; slots within the delay of the last event are marked as still open."""
    counts = slotstream.slot_stream(_stream(spark, sf_dir, "events"), "ts", 10, ["event_type"], "30 minutes")
    path = scratch_path(spark, "slots")
    checkpoint = _finish(counts.writeStream.format("parquet").option("path", path).outputMode("append"), spark)
    closed = spark.read.schema(counts.schema).parquet(path).withColumn("is_open", F.lit(False))
    still = slotstream.open_slots(spark, checkpoint, ["event_type"]).withColumn("is_open", F.lit(True))
    return closed.unionByName(still)


def subscriber_stream(spark, sf_dir):
    """Arrivals as a stream of several files, the latest first, on top of the known subscribers; the table afterwards."""
    path = scratch_path(spark, "subscribers")
    known = maintenance.subscribers(spark, sf_dir).select(
        "cust_id", "email", "signature_date", F.lit(False).alias("is_valid"), F.lit(False).alias("confirmed")
    )
    known.write.parquet(f"{path}/run=start/batch=-1")
    i = F.col("event_id")
    sent = scratch_path(spark, "events")
    rows = read(spark, sf_dir, "events").select(
        F.when(i % 10 == 4, "a@").otherwise(F.concat(F.lit("U"), F.col("user_id").cast("string"), F.lit("@x.org "))).alias("email"),
        F.col("ts").alias("signature_date"),
    )
    rows.repartitionByRange(4, F.desc("signature_date")).write.parquet(sent)
    events = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(sent)
    _finish(arrivals.subscriber_writer(events, lambda: spark.read.parquet(path), path), spark)
    table = spark.read.parquet(path)
    return table.select("email", "is_valid", (F.col("batch") >= 0).alias("is_new"))


def origin_stream(spark, sf_dir):
    """Files arriving as a stream: the first per hash goes in, hashes already in the table stay out."""
    path = scratch_path(spark, "origins")
    columns = ["fhash", "fname", "ingest_instant"]
    rows = tables.origin(spark, sf_dir)
    rows.where(F.col("l_suppkey") % 4 == 0).groupBy("fhash").agg(
        F.min("fname").alias("fname"), F.min("ingest_instant").alias("ingest_instant")
    ).select(*columns).write.parquet(f"{path}/run=start/batch=-1", compression=COMPRESSION)
    streamed = _stream(spark, sf_dir, "lineitem").select(
        F.sha2(F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")]), 256).alias("fhash"),
        F.concat(F.lit("f"), F.col("l_partkey").cast("string"), F.lit(".zip")).alias("fname"),
        F.col("l_shipdate").alias("ingest_instant"),
    )
    writer = arrivals.origin_writer(streamed, lambda: spark.read.parquet(path), path, [["fhash"]])
    _finish(writer, spark)
    return spark.read.parquet(path).select("fhash", "fname", (F.col("batch") >= 0).alias("is_new"))


QUERIES = {f.__name__: f for f in (slot_stream, subscriber_stream, origin_stream)}

_SLOT = (
    "date_trunc('hour', ts) + to_minutes(CAST(10 * round_even((minute(ts) + "
    "(second(ts) + (microsecond(ts) % 1000000) / 1e6) / 60) / 10.0, 0) AS BIGINT))"
)
ORACLE = {
    "slot_stream": f"""
        WITH s AS (SELECT {_SLOT} AS slot, event_type FROM events)
        SELECT slot, event_type, count(*) AS n,
               slot + INTERVAL 10 MINUTE > (SELECT max(slot) FROM s) - INTERVAL 30 MINUTE AS is_open
        FROM s GROUP BY 1, 2""",
    "subscriber_stream": """
        WITH known AS (SELECT DISTINCT user_id FROM events WHERE user_id % 3 = 0)
        SELECT 'u' || user_id || '@x.org' AS email, FALSE AS is_valid, user_id % 3 <> 0 AS is_new FROM (
            SELECT DISTINCT user_id FROM events WHERE event_id % 10 <> 4 OR user_id % 3 = 0)""",
    "origin_stream": with_tables("origin", """
        SELECT fhash, min(fname) AS fname, count(*) FILTER (WHERE l_suppkey % 4 = 0) = 0 AS is_new FROM origin GROUP BY fhash"""),
}
