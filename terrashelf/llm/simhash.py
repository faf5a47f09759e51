"""SimHash near duplicates by pivot distance tables.

Fingerprints are compared once per distinct value. Rows meet where they agree on two of six blocks of bits: a pair that
differs in at most ``MAX_BITS`` = 4 bits agrees on at least two, so no pair is lost. Within such a bucket a table of
Hamming distances to many reference fingerprints (pivots) is computed per fingerprint; for two fingerprints no
coordinate differs by more than their own distance, so a pair whose largest coordinate difference is above the limit is
discarded, and only survivors are compared bit by bit. A large bucket is searched by expanding from one member to all
that are left, so a cluster is emptied by its first members and gives one link a member, never all pairs. Buckets of
more than ``HOT`` members are dealt anew on five blocks of the bits that are left, of which a linked pair shares one.

Links are joined to components by alternating star contractions on the link table; no links or fingerprints of the corpus
reach the driver.

Cases: a null text has no words. A text without words has fingerprint zero, which is linked like any other; one with fewer
words than a shingle is one shingle. Rows that repeat an identifier are rows of their own with one component. Null
identifiers take part, but never name a component unless all of its rows lack one. Further columns are not carried by
``components``. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrashelf.llm.common import claim, fitted, small_batches, table
from terrashelf.operators.components import connect
from terrashelf.session import cut

SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: Six blocks of bits; rows meet on every pair of them.
BLOCKS = (11, 11, 11, 11, 10, 10)
AGREE = 2
#: Members of a bucket above which it is dealt anew.
HOT = 4096
#: Reference fingerprints of the distance table.
PIVOTS = np.array([xxhash.xxh64_intdigest(b"pivot %d" % i, 1) for i in range(16)], dtype=np.uint64)
#: Buckets up to this size are compared pair by pair, all of a batch at once.
SMALL = 16
_CHUNK = 1 << 15


def shingle_hashes(words: list[bytes], width: int) -> Iterator[np.ndarray]:
    """The hashes of all shingles, repeats included, some at a time; nothing without words."""
    if not words:
        return
    n = max(1, len(words) - width + 1)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    ends = ends[-n:].tolist()
    for at in range(0, n, _CHUNK):
        pieces = [joined[a:b] for a, b in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK])]
        yield np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, len(pieces))


def fingerprint_of(pieces: Iterable[np.ndarray]) -> int:
    """The bits that are set in more than half of the hashes."""
    counts, n = np.zeros(64, dtype=np.int64), 0
    for hashes in pieces:
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(words: list[bytes], width: int = SHINGLE) -> int:
    """The bits that are set in more than half of the hashes of all shingles, repeats included."""
    return fingerprint_of(shingle_hashes(words, width))


def _printer(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("simhash")
        for batch in batches:
            texts = pc.cast(batch.column("_text"), pa.binary())
            found = np.fromiter(
                (fingerprint((t.as_py() or b"").lower().split(), width) for t in texts), np.uint64, len(texts)
            )
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(found.view(np.int64))], names=[*batch.schema.names[:-1], "fp"]
            )

    return run


def fingerprints(docs: DataFrame, text: str = "text", width: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` and fp: the 64 bits as a signed long."""
    small_batches(docs.sparkSession)
    kept = docs.select(*(keep or ["doc_id"]), F.col(text).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(_printer(width), f"{fields}, fp long")


def _mask(at: int, width: int) -> int:
    return ((1 << width) - 1) << at


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _masks() -> list[tuple[int, list[int]]]:
    """For every pair of blocks the bits both have, and those with each of five parts of the other bits added."""
    starts = [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]
    blocks = [_mask(a, w) for a, w in zip(starts, BLOCKS)]
    found = []
    for pair in combinations(blocks, AGREE):
        shared = reduce(int.__or__, pair)
        free = [b for b in range(64) if not shared >> b & 1]
        parts = [free[i :: MAX_BITS + 1] for i in range(MAX_BITS + 1)]
        found.append((shared, [shared | sum(1 << b for b in part) for part in parts]))
    return found


def _rows(masks: list[int], first: int = 0) -> Column:
    fp = F.col("fp")
    return F.inline(F.array(*[
        F.struct(F.lit(first + i).alias("kind"), fp.bitwiseAND(F.lit(_signed(m)).cast("long")).alias("key"))
        for i, m in enumerate(masks)
    ]))


def _far(table_a: np.ndarray, table_b: np.ndarray) -> np.ndarray:
    """The largest coordinate difference of rows of two distance tables."""
    return np.abs(table_a - table_b).max(axis=-1)


def _linked(fps: np.ndarray, distances: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs ``a``, ``b`` survive the table and then differ in few enough bits."""
    near = np.flatnonzero(_far(distances[a], distances[b]) <= MAX_BITS)
    good = np.bitwise_count(fps[a[near]] ^ fps[b[near]]) <= MAX_BITS
    return near[good]


def _spread(fps: np.ndarray, distances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members of one bucket and the smallest of their component, by expanding from member to member."""
    left = np.arange(len(fps))
    root = np.arange(len(fps))
    while len(left):
        seed, left, waiting = left[0], left[1:], [left[0]]
        while waiting and len(left):
            x = waiting.pop()
            near = np.flatnonzero(_far(distances[left], distances[x]) <= MAX_BITS)
            near = near[np.bitwise_count(fps[left[near]] ^ fps[x]) <= MAX_BITS]
            if len(near):
                new = left[near]
                root[new] = seed
                waiting.extend(new.tolist())
                left = np.delete(left, near)
    linked = np.flatnonzero(root != np.arange(len(fps)))
    return fps[linked], fps[root[linked]]


def _search(fps: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within buckets; ``starts`` holds where each begins, ``fps`` are sorted by bucket."""
    sizes = np.diff(np.append(starts, len(fps)))
    many = sizes[np.repeat(np.arange(len(sizes)), sizes)] > 1
    bucket = np.repeat(np.arange(len(sizes)), sizes)[many]
    fps = fps[many]
    if not len(fps):
        return
    distances = np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    begins = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    sizes = np.diff(np.append(begins, len(fps)))
    small = np.repeat(sizes <= SMALL, sizes)
    for step in range(1, SMALL):
        a = np.flatnonzero(small[:-step] & (bucket[:-step] == bucket[step:])) if step < len(fps) else np.array([], int)
        if not len(a):
            break
        good = a[_linked(fps, distances, a, a + step)]
        yield fps[good], fps[good + step]
    for at, size in zip(begins[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        yield _spread(fps[at : at + size], distances[at : at + size])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of some batches at a time, as searches over many rows cost less."""
    waiting, size = [], 0
    for batch in batches:
        waiting.append([batch.column(c).to_numpy() for c in ("kind", "key", "fp")])
        size += batch.num_rows
        if size >= _CHUNK:
            yield [np.concatenate(parts) for parts in zip(*waiting)]
            waiting, size = [], 0
    if size:
        yield [np.concatenate(parts) for parts in zip(*waiting)]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, key, fp) sorted by bucket to links (a, b) with a < b; a bucket may go on in the next batch."""
    held = None
    for rows in _gathered(batches):
        if held is not None:
            rows = [np.concatenate(pair) for pair in zip(held, rows)]
        new = np.append(True, (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]))
        starts = np.flatnonzero(new)
        held = [r[starts[-1] :] for r in rows]
        yield from _found(rows[2][: starts[-1]], starts[:-1])
    if held is not None:
        yield from _found(held[2], np.array([0]))


def _found(fps: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for a, b in _search(fps.view(np.uint64), starts):
        if len(a):
            a, b = a.view(np.int64), b.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"]
            )


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``distinct(fp)`` as all links within the limit do."""
    masks = _masks()
    keys = distinct.select("fp", _rows([shared for shared, _ in masks]))
    hot = fitted(keys.groupBy("kind", "key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).drop("n"))
    anew = [
        keys.where(F.col("kind") == i).join(hot, ["kind", "key"], "left_semi")
        .select("fp", _rows(parts, len(masks) + i * len(parts)))
        for i, (_, parts) in enumerate(masks)
    ] if hot.limit(1).count() else []
    calm = keys.join(hot, ["kind", "key"], "left_anti") if anew else keys
    dealt = reduce(DataFrame.unionByName, anew, calm).select("kind", "key", "fp")
    placed = dealt.repartition("kind", "key").sortWithinPartitions("kind", "key")
    return placed.mapInArrow(_links, "a long, b long").distinct()


def grouped(prints: DataFrame) -> DataFrame:
    """``prints(..., fp)`` with root: the smallest fingerprint (as a signed number) linked to the row's own."""
    prints = cut(prints)
    roots = cut(connect(links(cut(prints.select("fp").distinct()))))
    return prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def components(prints: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``prints(..., fp)`` with component_id: the smallest identifier of those linked to a row, itself included."""
    found = cut(grouped(prints))
    named = cut(found.groupBy("root").agg(F.min(doc_id).alias("component_id")))
    return found.join(named, "root").drop("root")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(fingerprints(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op5_simhash": op5_simhash}
ORACLE: dict[str, str] = {}
