"""MinHash near duplicates with HyperMinHash registers.

A document's set are the hashes of its distinct shingles. Every element is put into one of ``REGISTERS`` buckets by its hash, and a
bucket keeps of its smallest hash the number of leading zeros and the ``MANTISSA`` bits after them. So that small sets fill
their buckets, too, an element stands for 1, 2, 4 ... virtual elements, as many as a set of that size needs (its level);
a set whose similar partners may be of another level has registers for both, so two sets that can be linked always share
a level.

Registers are banded: sets meet where the ``ROWS`` registers of one of ``BANDS`` bands agree. Two sets of similarity 0.8 share no band
with a probability of 5e-8. Candidates must have sizes within the limit and an estimated similarity, corrected for
registers that agree by chance, of ``LEAST``; a pair of 0.8 falls below that with a probability of 1e-7. Every candidate is
then verified on the whole sets, and only verified pairs are links.

Candidates are not all pairs of a bucket. First every member is paired with the one member of its bucket that meets most others,
so a group of near copies gives about one candidate a member. Links found are connected, and buckets whose members are
then connected need nothing more. In the others every member outside the largest component is held against all members of
other components, so no candidate between two components goes untried. Large buckets are dealt into cells of ``CELL``
members a side for this, and the whole sets of members that have candidates are compared within their cells: no row is
made per pair, only one per link that joins a member to a component.

Equal sets are one node. Components come from the link table by star contractions; nothing of the corpus reaches the driver.

Cases: a null text and one without words have an empty set and no links. One with fewer words than a shingle is one shingle.
Repeated shingles count once. Rows that repeat an identifier are rows of their own with one component. Null identifiers
take part, but name a component only if all of its rows lack one; ``kept`` compares nulls as equal. Further columns are not
carried. An empty table gives an empty result. Rows are found again by their place in the files they are read from, so
``docs`` must be a table that is read from files.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrashelf.llm.common import claim, fitted, small_batches, table
from terrashelf.llm.simhash import shingle_hashes
from terrashelf.operators.components import connect
from terrashelf.session import cut

SHINGLE = 4
#: Least similarity of a link, in hundredths: 100 * intersection >= 80 * union.
SIMILAR = 80
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
#: Bits of a register after its leading zeros.
MANTISSA = 10
#: Virtual elements of a set, at least; that leaves a bucket empty with a probability of 0.0003.
FILL = 8 * REGISTERS
#: Least estimated similarity of a candidate.
LEAST = 0.6
#: Members on each side of a cell of a large bucket.
CELL = 512
CELL_KEY = ["kind", "key", "i", "j"]
#: Candidates of a member that are verified at a time.
_TRIED = 64
_BUCKET_BITS = REGISTERS.bit_length() - 1
_WIDTH = 2 * REGISTERS


def _constants(n: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(b"element %d" % i, 1) for i in range(n)], dtype=np.uint64)


_SALTS = _constants(FILL)
_FACTORS = _constants(2) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits spread over the whole word by two rounds of shift and product."""
    for factor in _FACTORS:
        x = (x ^ x >> np.uint64(32)) * factor
    return x ^ x >> np.uint64(29)


def level(n: int) -> int:
    """Doublings of a set of ``n`` elements that give ``FILL`` virtual ones."""
    return max(0, (-(-FILL // max(n, 1)) - 1).bit_length())


def levels(n: int) -> list[int]:
    """The levels of all sizes that a similar set may have, at most two that follow each other."""
    return sorted({level(-(-n * SIMILAR // 100)), level(n), level(n * 100 // SIMILAR)})


def registers(hashes: np.ndarray, depth: int) -> np.ndarray:
    """Leading zeros and mantissa of the smallest hash in every bucket; zero for an empty bucket."""
    virtual = np.sort(mixed(hashes[:, None] ^ _SALTS[None, : 1 << depth]), axis=None)
    bucket = np.arange(REGISTERS, dtype=np.uint64)
    at = np.minimum(np.searchsorted(virtual, bucket << np.uint64(64 - _BUCKET_BITS)), len(virtual) - 1)
    least, full = virtual[at], virtual[at] >> np.uint64(64 - _BUCKET_BITS) == bucket
    # A float holds just that: its exponent falls with the leading zeros, and the mantissa begins after them.
    kept = ((least << np.uint64(_BUCKET_BITS)) | np.uint64(1)).astype(np.float64).view(np.uint64) >> np.uint64(52 - MANTISSA)
    return np.where(full, kept - np.uint64(1023 << MANTISSA), 0).astype("<u2")


def estimated(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Similarity of sets from rows of registers, less what agrees by chance.

    Two independent buckets agree with a probability of about 0.72 / 2 ** MANTISSA * ab / (a + b) ** 2 for a and b elements.
    """
    full = ((a > 0) | (b > 0)).sum(axis=-1)
    share = ((a == b) & (a > 0)).sum(axis=-1) / np.maximum(full, 1)
    chance = 0.7213 / (1 << MANTISSA) * size_a * size_b / (size_a + size_b).astype(np.float64) ** 2
    return (share - chance) / (1 - chance)


def _close(size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    return np.minimum(size_a, size_b) * 100 >= np.maximum(size_a, size_b) * SIMILAR


def _set_of(text: bytes | None, width: int) -> np.ndarray:
    pieces = list(shingle_hashes((text or b"").lower().split(), width))
    return np.unique(np.concatenate(pieces)) if pieces else np.array([], dtype=np.uint64)


def _sketcher(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("minhash")
        for batch in batches:
            sizes, names, firsts, found = [], [], [], []
            for text in pc.cast(batch.column("_text"), pa.binary()):
                members = _set_of(text.as_py(), width)
                depths = levels(len(members)) if len(members) else []
                sizes.append(len(members))
                names.append(xxhash.xxh128_digest(members.tobytes()) if depths else None)
                firsts.append(depths[0] if depths else None)
                found.append(b"".join(registers(members, d).tobytes() for d in depths) if depths else None)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(firsts, pa.int32()),
                 pa.array(found, pa.binary())],
                names=[*batch.schema.names[:-1], "n", "set", "depth", "regs"])

    return run


def sketches(docs: DataFrame, text: str, width: int, keep: list[Column]) -> DataFrame:
    """``keep``, the size n of the set, its digest, the first of its levels and its registers (null without words)."""
    small_batches(docs.sparkSession)
    kept = docs.select(*keep, F.col(text).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(_sketcher(width), f"{fields}, n long, `set` binary, depth int, regs binary")


def _bands(sets: DataFrame) -> DataFrame:
    """node, kind and key of every band of every level."""
    size = 2 * ROWS
    part = lambda at, band: F.when(
        F.octet_length("regs") > at * _WIDTH,
        F.struct(((F.col("depth") + at) * BANDS + band).alias("kind"), F.xxhash64(F.substring("regs", at * _WIDTH + band * size + 1, size)).alias("key")))
    every = F.array_compact(F.array(*[part(at, band) for at in range(2) for band in range(BANDS)]))
    return sets.select("node", F.inline(every))


def _side(sets: DataFrame, name: str) -> DataFrame:
    return sets.select(*[F.col(c).alias(f"{c}_{name}") for c in ("node", "n", "depth", "regs")])


def _rows_of(column: pa.Array) -> np.ndarray:
    """Registers as rows, those of a second level after those of the first; a row without them is zero there."""
    found = np.zeros((len(column), 2 * _WIDTH), dtype=np.uint8)
    for i, data in enumerate(column):
        data = data.as_buffer()
        found[i, : len(data)] = np.frombuffer(data, np.uint8)
    return found.view("<u2")


def _shared(regs: np.ndarray, depth: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The registers of level ``at`` of each row."""
    second = (at > depth).astype(np.int64)
    return regs.reshape(len(regs), 2, REGISTERS)[np.arange(len(regs)), second]


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with both sides' registers to those whose sizes and estimate allow a link."""
    for batch in batches:
        n_a, n_b, depth_a, depth_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b", "depth_a", "depth_b"))
        at = np.maximum(depth_a, depth_b)
        a = _shared(_rows_of(batch.column("regs_a")), depth_a, at)
        b = _shared(_rows_of(batch.column("regs_b")), depth_b, at)
        good = pa.array(_close(n_a, n_b) & (estimated(a, b, n_a, n_b) >= LEAST))
        yield batch.select(["node_a", "node_b"]).filter(good)


def likely(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of ``pairs(node_a, node_b)`` those that may be links."""
    small = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * SIMILAR
    both = pairs.join(_side(sets, "a"), "node_a").join(_side(sets, "b"), "node_b").where(small)
    return both.mapInArrow(_likely, "node_a long, node_b long")


def _lister(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("minhash")
        for batch in batches:
            for i, text in enumerate(pc.cast(batch.column("_text"), pa.binary())):
                members = np.sort(_set_of(text.as_py(), width).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), pa.ListArray.from_arrays(pa.array([0, len(members)], pa.int32()), pa.array(members))],
                    names=["node", "hashes"])

    return run


def _whole_sets(nodes: DataFrame, sets: DataFrame, placed: DataFrame, width: int) -> DataFrame:
    """node and hashes, the sorted set, of ``nodes(node)``; only their texts are read again."""
    places = sets.join(nodes, "node").select("node", "at.*")
    texts = placed.join(fitted(places), ["_file", "_at"]).select("node", "_text")
    return cut(texts.mapInArrow(_lister(width), "node long, hashes array<long>"))


def verified(pairs: DataFrame, sets: DataFrame, placed: DataFrame, width: int) -> DataFrame:
    """Of ``pairs(node_a, node_b)`` those whose whole sets are similar enough, as links (a, b)."""
    whole = _whole_sets(pairs.select(F.explode(F.array("node_a", "node_b")).alias("node")).distinct(), sets, placed, width)
    side = lambda name: whole.select(F.col("node").alias(f"node_{name}"), F.col("hashes").alias(f"hashes_{name}"))
    both = F.size(F.array_intersect("hashes_a", "hashes_b"))
    enough = both * 100 >= (F.size("hashes_a") + F.size("hashes_b") - both) * SIMILAR
    close = pairs.join(side("a"), "node_a").join(side("b"), "node_b").where(enough)
    return close.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("node_a"), F.greatest(a, b).alias("node_b")]


def first_pairs(met: DataFrame) -> DataFrame:
    """Every member of a bucket with the one that meets most others, in all buckets; ``met`` has kind, key, node, many."""
    score = met.groupBy("node").agg(F.sum("many").alias("score"))
    lead = F.max(F.struct("score", (-F.col("node")).alias("less"))).alias("lead")
    leads = met.join(score, "node").groupBy("kind", "key").agg(lead)
    leads = leads.select("kind", "key", (-F.col("lead.less")).alias("leader"))
    pairs = met.join(leads, ["kind", "key"]).where("node <> leader")
    return pairs.select(*_ordered(F.col("node"), F.col("leader"))).distinct()


def _cells(rest: DataFrame) -> DataFrame:
    """Rows of open buckets dealt into cells: i numbers slices of the members outside the main component, j of all."""
    slice_of = lambda n: F.pmod(F.xxhash64("node"), F.greatest(F.ceil(n / CELL), F.lit(1))).cast("int")
    slices = lambda n: F.sequence(F.lit(0), F.greatest(F.ceil(F.col(n) / CELL), F.lit(1)).cast("int") - 1)
    every = rest.select("*", F.lit(False).alias("asks"), F.explode(slices("others")).alias("i"), slice_of(F.col("many")).alias("j"))
    asking = rest.where("root <> main").select(
        "*", F.lit(True).alias("asks"), slice_of(F.col("others")).alias("i"), F.explode(slices("many")).alias("j"))
    return every.unionByName(asking).drop("main", "many", "others")


def _by_cell(batches: Iterator[pa.RecordBatch], more: list[str]) -> Iterator[tuple[list, dict[str, np.ndarray], list]]:
    """Rows sorted by cell: the cell, its columns as arrays, and the columns ``more`` as Arrow values.

    Of a row's registers those of the bucket's level are given; a cell may go on in the next batch.
    """
    names = ["node", "root", "n", "asks"]

    def cells(rows: pa.Table) -> Iterator[tuple[list, dict[str, np.ndarray], list]]:
        where = [rows.column(c).to_numpy() for c in CELL_KEY]
        new = reduce(np.logical_or, [w[1:] != w[:-1] for w in where])
        starts = np.append(0, np.flatnonzero(new) + 1).tolist()
        depth, regs = rows.column("depth").to_numpy(), _rows_of(rows.column("regs").combine_chunks())
        found = {c: rows.column(c).to_numpy() for c in names} | {"regs": _shared(regs, depth, where[0] // BANDS)}
        extra = [rows.column(c).combine_chunks() for c in more]
        for start, stop in zip(starts, [*starts[1:], rows.num_rows]):
            yield [w[start] for w in where], {c: v[start:stop] for c, v in found.items()}, [e.slice(start, stop - start) for e in extra]

    held: list[pa.RecordBatch] = []
    for batch in (b for b in batches if b.num_rows):
        last = tuple(batch.column(c)[-1].as_py() for c in CELL_KEY)
        if held and last == tuple(held[0].column(c)[0].as_py() for c in CELL_KEY):
            held.append(batch)
            continue
        # All cells but the last one have ended.
        same = reduce(np.logical_and, [batch.column(c).to_numpy() == v for c, v in zip(CELL_KEY, last)])
        at = int(np.flatnonzero(same)[0])
        ended = pa.Table.from_batches([*held, batch.slice(0, at)])
        if ended.num_rows:
            yield from cells(ended)
        held = [batch.slice(at)]
    if held:
        yield from cells(pa.Table.from_batches(held))


def _asked(kind: int, cell: dict[str, np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """Each asking member with its candidates of other components, the likeliest first.

    A pair that meets in several bands of a level is a candidate in the first of them alone.
    """
    node, root, n, regs = (cell[c] for c in ("node", "root", "n", "regs"))
    y = np.flatnonzero(~cell["asks"])
    for one in np.flatnonzero(cell["asks"]):
        able = y[(root[y] != root[one]) & _close(n[y], n[one])]
        if not len(able):
            continue
        found = estimated(regs[able], regs[one], n[able], n[one])
        same = (regs[able] == regs[one]).reshape(-1, BANDS, ROWS).all(axis=-1)
        good = (found >= LEAST) & (same.argmax(axis=1) == kind % BANDS)
        if good.any():
            yield one, able[good][np.argsort(-found[good], kind="stable")]


def _partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every cell the members that have a candidate or are one."""
    for where, cell, _ in _by_cell(batches, []):
        met = np.zeros(len(cell["node"]), dtype=bool)
        for one, others in _asked(where[0], cell):
            met[one] = True
            met[others] = True
        at = np.flatnonzero(met)
        if len(at):
            columns = [pa.array(np.full(len(at), w)) for w in where] + [pa.array(cell["asks"][at]), pa.array(cell["node"][at])]
            yield pa.RecordBatch.from_arrays(columns, names=[*CELL_KEY, "asks", "node"])


def _similar(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of the sorted sets are similar enough to ``one``."""
    sizes = np.array([len(o) for o in others])
    every = np.concatenate(others)
    hit = one[np.minimum(np.searchsorted(one, every), len(one) - 1)] == every
    both = np.add.reduceat(hit.astype(np.int64), np.append(0, np.cumsum(sizes)[:-1]))
    return both * 100 >= (len(one) + sizes - both) * SIMILAR


def _linked_in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the members of every cell, verified on their whole sets: one from a member to each component it is linked with."""
    for where, cell, (hashes,) in _by_cell(batches, ["hashes"]):
        sets = [h.values.to_numpy() for h in hashes]
        a, b = [], []
        for one, others in _asked(where[0], cell):
            done: set[int] = set()
            for at in range(0, len(others), _TRIED):
                some = [o for o in others[at : at + _TRIED].tolist() if cell["root"][o] not in done]
                if not some:
                    continue
                for o in np.array(some)[_similar(sets[one], [sets[o] for o in some])].tolist():
                    if cell["root"][o] not in done:
                        done.add(cell["root"][o])
                        a.append(cell["node"][one])
                        b.append(cell["node"][o])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def links_in_open_buckets(met: DataFrame, sets: DataFrame, links: DataFrame, placed: DataFrame, width: int) -> DataFrame:
    """Links between the components that ``links`` leave, from the buckets that still hold several."""
    roots = cut(connect(links))
    rooted = cut(met.join(roots, "node", "left").select("kind", "key", "node", "many", F.coalesce("root", "node").alias("root")))
    counts = rooted.groupBy("kind", "key", "root").agg(F.count("*").alias("c"))
    main = F.max(F.struct("c", "root")).alias("m")
    open_ = counts.groupBy("kind", "key").agg(F.count("*").alias("parts"), F.sum("c").alias("all"), main).where("parts > 1")
    open_ = open_.select("kind", "key", F.col("m.root").alias("main"), (F.col("all") - F.col("m.c")).alias("others"))
    known = sets.select("node", "n", "depth", "regs")
    rest = rooted.join(open_, ["kind", "key"]).join(known, "node")
    placed_in = lambda rows: rows.repartition(*CELL_KEY).sortWithinPartitions(*CELL_KEY)
    partners = cut(placed_in(_cells(rest)).mapInArrow(_partners, "kind int, key long, i int, j int, asks boolean, node long"))
    whole = _whole_sets(partners.select("node").distinct(), sets, placed, width)
    rows = partners.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(known, "node").join(whole, "node")
    return placed_in(rows).mapInArrow(_linked_in_cells, "a long, b long").distinct()


def linked(sets: DataFrame, placed: DataFrame, width: int) -> DataFrame:
    """Links (a, b) that connect the nodes of ``sets`` as all pairs that are similar enough do."""
    bands = _bands(sets)
    many = bands.groupBy("kind", "key").agg(F.count("*").alias("many")).where("many > 1")
    met = cut(bands.join(many, ["kind", "key"]))
    links = cut(verified(cut(likely(first_pairs(met), sets)), sets, placed, width))
    return cut(links.unionByName(links_in_open_buckets(met, sets, links, placed, width)))


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest identifier of those connected to the row) and kept, of every row."""
    place = [F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at")]
    identifier = F.col(doc_id).alias("doc_id")
    prints = cut(sketches(docs, text, width, [identifier, *place]))
    groups = prints.where(F.col("set").isNotNull()).groupBy("set").agg(
        F.min("doc_id").alias("least"), F.min(F.struct("_file", "_at")).alias("at"), F.first("n").alias("n"),
        F.first("depth").alias("depth"), F.first("regs").alias("regs"))
    # Numbered as it is written, so a node keeps its number however often the table is read.
    sets = cut(groups.withColumn("node", F.monotonically_increasing_id()))
    placed = docs.select(*place, F.col(text).alias("_text"))
    roots = connect(linked(sets, placed, width))
    named = cut(sets.join(roots, "node", "left").select("set", "least", F.coalesce("root", "node").alias("root")))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    found = cut(named.join(least, "root").select("set", "component_id"))
    rows = prints.select("doc_id", "n", "set").join(found, "set", "left")
    of = F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), of.alias("component_id"), F.col("doc_id").eqNullSafe(of).alias("kept"))


def op13_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))


QUERIES = {"op13_hyperminhash": op13_hyperminhash}
ORACLE: dict[str, str] = {}
