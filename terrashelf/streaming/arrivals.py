"""Arrivals as a stream: subscribers and origins inserted once, batch by batch.

Nothing is kept in the stream's state: a batch is compared with the keys of the table, which holds all that came before, so
rows are taken however late they come. The keys are stored beside the table as digests, partitioned by their hash, and a batch reads
and writes anew only the partitions its own keys fall into, each of which is one set of files however many batches there were.
The table itself is read once by every start, which stores its keys anew, so whatever a writer left unfinished is taken as it
stands in the table. Every writer puts its batches below a run of its own, so a stream that starts anew with an empty checkpoint
never writes over what an earlier one left.

A batch that is repeated finds its own keys marked with its run and number, takes them as unknown and writes the same rows
again. One writer at a time may append to a table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from terrashelf.operators.audit import key_digests
from terrashelf.operators.upsert import insert_ignore_digests, new_subscribers
from terrashelf.session import COMPRESSION, cut

#: Partitions of the stored keys.
KEY_PARTS = 64
_KEYS = "k int, v binary, run string, batch long, _part int"


def _part(parts: int):
    return F.pmod(F.xxhash64("k", "v"), F.lit(parts)).cast("int")


class KnownKeys:
    """The unique keys of the table at ``path``, stored below it where readers of the table do not look."""

    def __init__(self, path: str, keys: list[list[str]], parts: int = KEY_PARTS):
        self.path, self.keys, self.parts = f"{path}/_known_keys", keys, parts

    def store(self, table: DataFrame) -> None:
        """Store the keys of the whole table, which tells ``run`` and ``batch`` of its rows."""
        known = table.select(F.inline(key_digests(self.keys)), "run", "batch").withColumn("_part", _part(self.parts))
        known.repartition("_part").write.mode("overwrite").partitionBy("_part").parquet(self.path, compression=COMPRESSION)

    def sent(self, rows: DataFrame) -> DataFrame:
        """The keys of ``rows`` with their partition."""
        return rows.select(F.inline(key_digests(self.keys))).withColumn("_part", _part(self.parts))

    def read(self, sent: DataFrame) -> DataFrame:
        """The stored keys of all partitions that ``sent`` falls into."""
        # At most ``parts`` numbers.
        hit = [r[0] for r in sent.select("_part").distinct().collect()]
        return sent.sparkSession.read.schema(_KEYS).parquet(self.path).where(F.col("_part").isin(hit))

    def add(self, stored: DataFrame, added: DataFrame, run: str, batch: int) -> None:
        """Write the partitions that ``stored`` was read from anew, with the keys of the rows that were added."""
        own = self.sent(added).select("k", "v", F.lit(run).alias("run"), F.lit(batch).cast("long").alias("batch"), "_part")
        # Files are replaced only when all new ones are complete; what a failure in between leaves is stored anew by the next start.
        whole = stored.where(~_own(run, batch)).unionByName(own).repartition("_part")
        whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part").parquet(
            self.path, compression=COMPRESSION)


def _own(run: str, batch: int):
    return (F.col("run") == run) & (F.col("batch") == batch)


def _appended(arrivals: DataFrame, start: Callable[[int], None], append: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A writer that calls ``start()`` before the first batch and after a failure, ``append(batch, number)`` for every batch."""
    ready: list[bool] = []

    def each(batch: DataFrame, batch_id: int) -> None:
        if not ready:
            start(batch_id)
        ready.clear()
        append(batch, batch_id)
        ready.append(True)

    return arrivals.writeStream.foreachBatch(each)


def subscriber_writer(
    arrivals: DataFrame, read_table: Callable[[], DataFrame], path: str, run: str | None = None, parts: int = KEY_PARTS
) -> DataStreamWriter:
    """Append new addresses to the table at ``path``, which is partitioned by run and batch.

    Repeats within a batch are folded, known addresses dropped by the anti-join against the stored keys. A batch that is
    repeated overwrites its own folder.
    """
    name, known = run or uuid.uuid4().hex, KnownKeys(path, [["email"]], parts)
    highest = [0]

    def start(batch_id: int) -> None:
        table = read_table()
        known.store(table)
        highest[0] = table.where(~_own(name, batch_id)).agg(F.max("cust_id")).first()[0] or 0

    def append(batch: DataFrame, batch_id: int) -> None:
        rows = cut(batch.select(F.trim(F.lower("email")).alias("email"), "signature_date"))
        stored = known.read(known.sent(rows))
        digest = F.get(key_digests([["email"]]), F.lit(0))["v"]
        taken = rows.select("email", digest.alias("v")).join(stored.where(~_own(name, batch_id)), "v", "left_semi").select("email").distinct()
        new = cut(new_subscribers(taken, rows, F.lit(highest[0]).cast("long")))
        new.write.mode("overwrite").parquet(f"{path}/run={name}/batch={batch_id}")
        known.add(stored, new, name, batch_id)
        highest[0] = new.agg(F.max("cust_id")).first()[0] or highest[0]

    return _appended(arrivals, start, append)


def origin_writer(
    arrivals: DataFrame, read_table: Callable[[], DataFrame], path: str, keys: list[list[str]], run: str | None = None,
    parts: int = KEY_PARTS,
) -> DataStreamWriter:
    """Append origins whose unique keys are free, batch by batch, first come first served."""
    name, known = run or uuid.uuid4().hex, KnownKeys(path, keys, parts)

    def append(batch: DataFrame, batch_id: int) -> None:
        arrived = batch.withColumn("_order", F.monotonically_increasing_id())
        if len(keys) > 1:
            # Written once, so that every step sees the same numbers.
            arrived = cut(arrived)
        stored = known.read(known.sent(batch))
        taken = stored.where(~_own(name, batch_id)).select("k", "v")
        folder = f"{path}/run={name}/batch={batch_id}"
        insert_ignore_digests(taken, arrived, keys, "_order").drop("_order").write.mode("overwrite").parquet(folder, compression=COMPRESSION)
        known.add(stored, batch.sparkSession.read.schema(batch.schema).parquet(folder), name, batch_id)

    return _appended(arrivals, lambda _: known.store(read_table()), append)
