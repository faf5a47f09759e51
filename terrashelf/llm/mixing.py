"""Mixing sources to target weights by entropy balancing.

Every source has a token target. Among all document rates between 0 and ``MOST`` that meet the targets, the ones that
stay closest to "each document once" (in bounded relative entropy) tilt exponentially with the document's share of the
constraint: rate = MOST / (1 + exp(-lambda * size / mean size)). The dual is convex with one multiplier a source. Newton
steps solve it; each step is one distributed aggregate over the counts of (source, size), on which the rates depend
alone. Starting at lambda = 0 the steps approach the root from one side, so they never overshoot.

Rates are rounded into copies: the whole part, and one more where a hash of the identifier falls below a source's
threshold. The threshold starts at the fractional part of the rate and is moved, by two refining histograms, to where
the taken words meet the target; only the rows of the last, narrow bin are cut to a part of a copy.

Targets: sources in code point order, null last, have ``weights`` in turn and share ``share`` of all words; no target
exceeds ``MOST`` times its source, and the excess goes to the others by weight. There is one row a source in the table
of targets, and that table is sorted in one task; nothing with a row a document is.

Cases: a null text has no words and takes none, like an empty one; a source without words has target 0. Null
identifiers and rows that repeat an identifier are treated alike within their source. Further columns are kept. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrashelf.llm.common import BROADCAST_BYTES, WORD, table
from terrashelf.session import cut

#: Fixed values of the query.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
#: The most copies of a document.
MOST = 2.0
#: Newton steps end when every source is this close to its target; the rounding closes what is left.
CLOSE = 1e-6
MAX_STEPS = 100
#: Bins of each of the two histograms that place a source's threshold.
BINS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _keyed(docs: DataFrame, source: str) -> DataFrame:
    """``docs`` with a source key that is never null, so that rows without a source form one of their own."""
    return docs.withColumn("_none", F.col(source).isNull()).withColumn("_key", F.coalesce(source, F.lit("")))


KEY = ["_none", "_key"]


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """``sources(_none, _key, source_size, n_docs)`` with weight and target.

    A source is at its limit if the level it would get, with every source of a lower limit per weight at its own limit,
    is no less than its own; the first that is not sets the level of all others.
    """
    everything = Window.partitionBy(F.lit(1))
    place = F.row_number().over(Window.orderBy("_none", "_key")) - 1
    listed = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sources.withColumn("weight", F.element_at(listed, (place % len(weights) + 1).cast("int")))
    most = MOST * F.col("source_size")
    by_limit = Window.orderBy("_limit", "_none", "_key").rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        weighed.withColumn("_most", most).withColumn("_limit", F.col("_most") / F.col("weight"))
        .withColumn("_total", F.sum("source_size").over(everything) * share)
        .withColumn("_weights", F.sum("weight").over(everything))
        .withColumn("_used", F.coalesce(F.sum("_most").over(by_limit), F.lit(0.0)))
        .withColumn("_gone", F.coalesce(F.sum("weight").over(by_limit), F.lit(0.0)))
        .withColumn("_level", (F.col("_total") - F.col("_used")) / (F.col("_weights") - F.col("_gone")))
        .withColumn("_open", F.when(F.col("_level") < F.col("_limit"), F.struct("_limit", "_none", "_key", "_level")))
        .withColumn("_level", F.min("_open").over(everything)["_level"])
    )
    target = F.least(F.col("_most"), F.coalesce(F.col("_level") * F.col("weight"), F.col("_most")))
    return filled.select(*KEY, "source_size", "n_docs", "weight", target.alias("target"))


def _rate(size: Column) -> Column:
    """The tilted rate of a document; a source at its limit has no multiplier and takes everything ``MOST`` times."""
    tilt = F.col("lambda") * size * F.col("n_docs") / F.greatest("source_size", F.lit(1))
    return F.when(F.col("lambda").isNull(), MOST).otherwise(MOST / (1 + F.exp(-tilt)))


def _written(df: DataFrame, *more: Column) -> tuple[DataFrame, object]:
    """A table with a row a source, written; broadcast by its measured bytes, and the values of ``more`` over it."""
    done = cut(df)
    size = F.sum(F.octet_length("_key") + 8 * len(df.columns))
    seen = done.agg(F.coalesce(size, F.lit(0)).alias("bytes"), *more).first()
    return (F.broadcast(done) if seen["bytes"] <= BROADCAST_BYTES else done), seen


def solve(counts: DataFrame, goals: DataFrame) -> DataFrame:
    """``goals`` with the multiplier of each source: Newton's steps on the dual over ``counts(_none, _key, size, n)``."""
    reached = F.col("target") >= MOST * F.col("source_size") * (1 - 1e-9)
    state, _ = _written(goals.withColumn("lambda", F.when(reached, None).otherwise(F.lit(0.0))))
    fields = [c for c in state.columns if c not in (*KEY, "lambda")]
    size, rate = F.col("size"), _rate(F.col("size"))
    for _ in range(MAX_STEPS):
        scaled = size * F.col("n_docs") / F.greatest("source_size", F.lit(1))
        summed = counts.join(state, KEY).groupBy(*KEY, *fields, "lambda").agg(
            F.sum(F.col("n") * size * rate).alias("got"),
            F.sum(F.col("n") * size * scaled * rate * (1 - rate / MOST)).alias("slope"),
        )
        miss = F.col("got") - F.col("target")
        far = F.col("lambda").isNotNull() & (F.abs(miss) > CLOSE * F.col("target")) & (F.col("slope") > 0)
        step = F.when(far, F.col("lambda") - miss / F.col("slope")).otherwise(F.col("lambda"))
        state, seen = _written(
            summed.withColumn("_far", far).withColumn("lambda", step).select(*KEY, *fields, "lambda", "_far"),
            F.max("_far").alias("far"),
        )
        if not seen["far"]:
            break
    return state.select(*KEY, *fields, "lambda")


def _copies(size: Column, doc_id: str) -> list[Column]:
    """Whole copies, and where the row stands between -1 and 1: below the threshold it gets one more."""
    rate = _rate(size)
    whole = F.floor(rate).cast("long")
    chance = F.shiftrightunsigned(F.xxhash64(doc_id), 11) / F.lit(float(1 << 53))
    stand = F.when((whole < MOST) & (size > 0), chance - (rate - whole))
    return [whole.alias("_whole"), stand.alias("_stand")]


def _bin(depth: int) -> Column:
    """The bin of the row's stand: of all bins at depth 1, of those within a bin at depth 2."""
    scaled = (F.col("_stand") + 1) / 2 * BINS**depth
    return F.pmod(F.floor(scaled).cast("long"), F.lit(BINS)).cast("int")


def _threshold(bins: DataFrame, left: str, bin_name: str) -> DataFrame:
    """Per source the bin in which its open words end, the words still open there, and the words of that bin.

    ``bins`` has at most ``BINS`` rows a source.
    """
    upto = Window.partitionBy(*KEY).orderBy(bin_name)
    ran = bins.withColumn("_upto", F.sum("words").over(upto)).where(F.col("_upto") > F.col(left))
    first = F.min(F.struct(bin_name, (F.col(left) - F.col("_upto") + F.col("words")).alias("open"), "words")).alias("f")
    return ran.groupBy(*KEY).agg(first).select(*KEY, *[F.col(f"f.{c}") for c in (bin_name, "open", "words")])


def plan_mix(docs: DataFrame, source: str, doc_id: str, size: str, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """One row a source: target, multiplier and threshold. ``docs`` is read several times, so it should be a table."""
    keyed = _keyed(docs.select(doc_id, source, F.col(size).alias("size")), source)
    counts = cut(keyed.groupBy(*KEY, "size").agg(F.count("*").alias("n")))
    sources = counts.groupBy(*KEY).agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs")
    )
    solved = solve(counts, targets(sources, weights, share))
    stands = keyed.join(solved, KEY).select(*KEY, "size", "target", *_copies(F.col("size"), doc_id))
    by_bin = stands.groupBy(*KEY, "target", _bin(1).alias("bin1")).agg(
        F.sum("size").alias("words"), F.sum(F.col("_whole") * F.col("size")).alias("whole")
    )
    by_bin = cut(by_bin)
    left = by_bin.groupBy(*KEY).agg(
        F.greatest(F.floor(F.first("target") + 1e-9) - F.sum("whole"), F.lit(0)).alias("left")
    )
    open_bins = by_bin.where(F.col("bin1").isNotNull()).select(*KEY, "bin1", "words")
    first = _threshold(open_bins.join(left, KEY), "left", "bin1").drop("words").withColumnRenamed("open", "left")
    inside, _ = _written(solved.join(first, KEY))
    second = (
        keyed.join(inside, KEY).select(*KEY, "size", "bin1", "left", *_copies(F.col("size"), doc_id))
        .where(_bin(1) == F.col("bin1"))
        .groupBy(*KEY, "left", _bin(2).alias("bin2")).agg(F.sum("size").alias("words"))
    )
    second = _threshold(second, "left", "bin2")
    whole, _ = _written(solved.join(first.select(*KEY, "bin1"), KEY, "left").join(second, KEY, "left"))
    return whole


def apply_mix(docs: DataFrame, plan: DataFrame, source: str, doc_id: str, size: str) -> DataFrame:
    """``docs`` with source_size, target, rate, copies (whole ones) and taken (words)."""
    # The row travels as one column, so none of its names meets one of the plan's.
    rows = docs.select(
        F.struct(*docs.columns).alias("_doc"), F.col(doc_id).alias("_id"), F.col(source).alias("_source"),
        F.col(size).alias("_words"),
    )
    words = F.col("_words")
    whole, stand = _copies(words, "_id")
    joined = _keyed(rows, "_source").join(plan, KEY).withColumns({"_rate": _rate(words), "_whole": whole, "_stand": stand})
    below = (F.col("bin1").isNull() | (_bin(1) < F.col("bin1"))) | (
        (_bin(1) == F.col("bin1")) & (F.col("bin2").isNull() | (_bin(2) < F.col("bin2")))
    )
    at_edge = (_bin(1) == F.col("bin1")) & (_bin(2) == F.col("bin2"))
    part = F.floor(F.col("open") * words / F.col("words")).cast("long")
    more = F.when(F.col("_stand").isNull(), F.lit(0)).when(below, words).when(at_edge, part).otherwise(F.lit(0))
    copies = F.col("_whole") + F.when(F.col("_stand").isNotNull() & below, 1).otherwise(0)
    kept = [c for c in docs.columns if c not in ("source_size", "target", "rate", "copies", "taken")]
    return joined.select(
        *[F.col(f"_doc.{c}") for c in kept], "source_size", "target", F.col("_rate").alias("rate"),
        copies.alias("copies"), (F.col("_whole") * words + more).cast("long").alias("taken"),
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    plan = plan_mix(sized, "source", "doc_id", "size")
    mixed = apply_mix(sized, plan, "source", "doc_id", "size")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


QUERIES = {"op4_mixing": op4_mixing}
ORACLE: dict[str, str] = {}
