"""Secret scans with Spark expressions only: three fixed kinds of spans, and tokens that pass tests of randomness.

Fixed kinds (leftmost, not overlapping within a kind): ``assign``, ``access`` and ``hex``. The method adds kind
``random``: runs of 20 and more letters, digits, ``+ / - _`` with letters and digits in them that overlap no span of a fixed
kind. The encoding of a run is inferred from its signs, and under the hypothesis that its symbols are drawn evenly from
that alphabet three tests give p-values: chi-squared of the symbol counts, runs above and below the middle of the
alphabet, and serial correlation of neighbours. The run's p is the smallest of the three, times three.

Random runs have even p-values, ordinary ones (words, paths, names) crowd near zero. So among all runs of the corpus of the
same encoding and length class, those with p above one half tell how many random ones there are; a run is reported if
its p is above the lowest bound at which, by that count, at most ``RATE`` of the reported runs are ordinary. Short runs
tell little and crowd less, so each length class has a bound of its own; runs of under ``LEAST_BITS`` bits are left out.
A class with few runs would say nothing by itself, so every class starts with the same small number of imagined runs, half of them
random and half ordinary: a lone secret is reported unless its p is within the lowest bin.

The bounds are read off a histogram of fixed size; nothing else is gathered from the corpus.

Cases: a null text is empty and has no spans. Texts are scanned whole. Rows that repeat are scanned alike, and each counts
in the histogram. Further columns are not carried. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrashelf.llm.common import bound_to, running, table
from terrashelf.session import cut

#: Fixed values of the query: kind, pattern, group whose length counts, least length.
KINDS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]
#: A pattern that every text with a span of the kind matches; the others are not taken apart.
LIKELY = {"assign": r"(?i)passw(or)?d|secret|token|api_?key", "access": "AKIA[A-Z0-9]{16}", "hex": "[0-9a-f]{24}"}
#: Patterns that find the same spans as the kind's own and its least length, without the short ones.
LONG_ENOUGH = {"access": "AKIA[A-Z0-9]{16,}", "hex": "[0-9a-f]{24,}"}
RUN = r"[A-Za-z0-9+/_-]{20,}"
RANDOM = "random"
_DIGITS, _LARGE, _SMALL = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encodings in the order they are tried: name, signs, alphabet in order.
ENCODINGS = [
    ("hex", "0-9a-f", _DIGITS + "abcdef"),
    ("HEX", "0-9A-F", _DIGITS + "ABCDEF"),
    ("base32", "A-Z2-7", _LARGE + "234567"),
    ("base36", "0-9a-z", _DIGITS + _SMALL),
    ("BASE36", "0-9A-Z", _DIGITS + _LARGE),
    ("base62", "0-9A-Za-z", _DIGITS + _LARGE + _SMALL),
    ("base64", "0-9A-Za-z+/", _LARGE + _SMALL + _DIGITS + "+/"),
    ("base64url", "0-9A-Za-z_-", _LARGE + _SMALL + _DIGITS + "-_"),
]
RATE = 0.05
#: Runs of either sort that a class counts before any is seen, so that one to five secrets of a rare format are judged by them.
PRIOR = 20
LEAST_BITS = 80
BINS = 50
#: Length classes go by powers of two up to this one, which holds all longer runs.
TOP_CLASS = 12
_SPANS = "array<struct<start:long,kind:int,end:long>>"


def _places(text: Column, pattern: str, group: int) -> Column:
    """Every match of ``pattern`` as (start, end, size of the group), in code points.

    The text is split at the matches; what stands between them and the matches themselves add up to their places.
    """
    between, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = hits if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.slice(F.transform(between, lambda x: F.length(x)), F.lit(1), F.size(hits))
    zipped = F.arrays_zip(
        gaps.alias("gap"), F.transform(hits, lambda x: F.length(x)).alias("long"),
        F.transform(groups, lambda x: F.length(x)).alias("size"),
    )
    placed = lambda found: F.transform(
        F.arrays_zip(found.alias("hit"), running(F.transform(found, lambda h: h["gap"] + h["long"])).alias("at")),
        lambda p: F.struct(
            (p["at"] + p["hit"]["gap"]).alias("start"), (p["at"] + p["hit"]["gap"] + p["hit"]["long"]).alias("end"),
            p["hit"]["size"].alias("size")))
    return bound_to(zipped, placed)


def _fixed(text: Column) -> Column:
    """The spans of the fixed kinds by start, then kind."""

    def of(number: int, kind: str, pattern: str, group: int, least: int) -> Column:
        long = F.filter(_places(text, LONG_ENOUGH.get(kind, pattern), group), lambda p: p["size"] >= least)
        spans = F.transform(long, lambda p: F.struct(p["start"], F.lit(number).alias("kind"), p["end"]))
        return F.when(F.rlike(text, F.lit(LIKELY[kind])), spans).otherwise(F.array()).cast(_SPANS)

    return F.sort_array(F.concat(*[of(number, *kind) for number, kind in enumerate(KINDS)]))


def two_sided(z: Column) -> Column:
    """Twice the upper tail of the normal distribution, by a logistic curve that is within 0.0002 of it."""
    z = F.least(F.abs(z), F.lit(40.0))
    return F.least(F.lit(1.0), 2 / (1 + F.exp(1.5976 * z + 0.070566 * z * z * z)))


def _scores(run: Column, alphabet: Column) -> Column:
    """The smallest p of the three tests times three."""
    n, k = F.length(run).cast("double"), F.length(alphabet).cast("double")
    signs = F.filter(F.split(run, ""), lambda c: c != "")
    squares = F.aggregate(
        F.array_distinct(signs), F.lit(0.0),
        lambda a, c: a + F.pow(n - F.length(F.replace(run, c)), F.lit(2.0)),
    )
    spread = (squares * k / n - n) / (k - 1)
    even = F.lit(2.0) / (9 * (k - 1))
    uniform = (F.cbrt(spread) - (1 - even)) / F.sqrt(even)

    start = F.struct(F.lit(None).cast("double").alias("last"), F.lit(1.0).alias("runs"), F.lit(0.0).alias("products"))
    middle = (k - 1) / 2

    def step(state: Column, sign: Column) -> Column:
        value = F.instr(alphabet, sign).cast("double") - 1 - middle
        last = state["last"]
        changed = last.isNotNull() & ((last > 0) != (value > 0))
        return F.struct(
            value.alias("last"), (state["runs"] + F.when(changed, 1.0).otherwise(0.0)).alias("runs"),
            (state["products"] + F.coalesce(last * value, F.lit(0.0))).alias("products"),
        )

    walked = F.aggregate(signs, start, step)
    runs = (walked["runs"] - (n + 1) / 2) / (F.sqrt(n - 1) / 2)
    serial = walked["products"] / ((k * k - 1) / 12 * F.sqrt(n - 1))
    return F.least(F.lit(1.0), 3 * F.least(two_sided(uniform), two_sided(runs), two_sided(serial)))


def _choose(run: Column, value) -> Column:
    """``value(encoding)`` of the first encoding whose signs make up the run; null if none does."""
    chosen = None
    for place, encoding in enumerate(ENCODINGS):
        fits = F.rlike(run, F.lit(f"^[{encoding[1]}]+$"))
        chosen = (F if chosen is None else chosen).when(fits, F.lit(value(place, encoding)))
    return chosen


def _candidates(text: Column, fixed: Column) -> Column:
    """Runs that may be random, as (start, end, encoding, class, p), without those that touch a fixed span."""
    runs = F.regexp_extract_all(text, F.lit(RUN), F.lit(0))
    zipped = F.arrays_zip(_places(text, RUN, 0).alias("p"), runs.alias("run"))
    mixed = lambda c: F.rlike(c["run"], F.lit("[0-9]")) & F.rlike(c["run"], F.lit("[A-Za-z]"))
    free = lambda c: ~F.exists(fixed, lambda s: (s["start"] < c["p"]["end"]) & (c["p"]["start"] < s["end"]))
    chosen = F.filter(zipped, lambda c: mixed(c) & free(c))
    coded = F.transform(chosen, lambda c: F.struct(
        c["p"]["start"].alias("start"), c["p"]["end"].alias("end"), c["run"].alias("run"),
        _choose(c["run"], lambda place, e: place).alias("encoding"), _choose(c["run"], lambda place, e: e[2]).alias("alphabet"),
    ))
    enough = F.filter(coded, lambda c: c["encoding"].isNotNull() & (
        F.length(c["run"]) * F.log2(F.length(c["alphabet"]).cast("double")) >= LEAST_BITS))
    scored = F.transform(enough, lambda c: F.struct(
        c["start"].alias("start"), c["end"].alias("end"), c["encoding"].alias("encoding"),
        F.least(F.floor(F.log2(F.length(c["run"]).cast("double"))), F.lit(TOP_CLASS)).cast("int").alias("class"),
        _scores(c["run"], c["alphabet"]).alias("p"),
    ))
    kind = "array<struct<start:long,end:long,encoding:int,class:int,p:double>>"
    return F.when(F.rlike(text, F.lit(RUN)), scored).otherwise(F.array()).cast(kind)


def bounds(found: DataFrame) -> dict[tuple[int, int], int]:
    """Per encoding and length class the lowest bin of p whose runs, with all above, are reported; absent if there is none.

    Every class that occurs counts ``PRIOR`` random runs, even over the bins, and as many ordinary ones in the lowest bin besides
    its own. At most one row for each of the encodings, classes and bins.
    """
    listed = found.select(F.explode("candidates").alias("c")).select("c.encoding", "c.class", "c.p")
    bins = listed.groupBy("encoding", "class", F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"))
    seen = cut(bins.agg(F.count("*").alias("seen")))
    every = seen.select("encoding", "class").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))))
    prior = F.lit(PRIOR / BINS) + F.when(F.col("bin") == 0, float(PRIOR)).otherwise(0.0)
    full = every.join(seen, ["encoding", "class", "bin"], "left").withColumn("n", F.coalesce("seen", F.lit(0)) + prior)
    group = Window.partitionBy("encoding", "class")
    above = group.orderBy(F.desc("bin"))
    high = F.sum(F.when(F.col("bin") >= BINS // 2, F.col("n")).otherwise(0.0)).over(group)
    even = 2.0 * high * (1 - F.col("bin") / F.lit(float(BINS)))
    rate = 1 - even / F.sum("n").over(above)
    # The lowest bin, where ordinary runs crowd, is never reported, so that many secrets do not let ordinary runs in.
    kept = full.withColumn("rate", rate).where((F.col("rate") <= RATE) & (F.col("bin") > 0))
    return {(r[0], r[1]): r[2] for r in kept.groupBy("encoding", "class").agg(F.min("bin")).collect()}


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with base and spans: arrays of (start, kind, end) by start, then kind; kind 3 is ``random``."""
    names = keep or ["doc_id"]
    whole = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(*names, whole.alias("_text")).select(*names, "_text", _fixed(F.col("_text")).alias("base"))
    found = cut(found.select(*names, "base", _candidates(F.col("_text"), F.col("base")).alias("candidates")))
    limits = bounds(found)

    def passes(c: Column) -> Column:
        found = F.lit(False)
        for (encoding, length_class), first in sorted(limits.items()):
            same = (c["encoding"] == encoding) & (c["class"] == length_class)
            found = found | (same & (F.floor(c["p"] * BINS) >= first))
        return found

    more = F.transform(
        F.filter("candidates", passes), lambda c: F.struct(c["start"], F.lit(len(KINDS)).alias("kind"), c["end"])
    )
    return found.select(*names, "base", F.sort_array(F.concat("base", more.cast(_SPANS))).alias("spans"))


def _shown(spans: str) -> Column:
    names = F.array(*[F.lit(kind) for kind, *_ in KINDS], F.lit(RANDOM))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda number: F.size(F.filter("base", lambda s: s["kind"] == number)).cast("long")
    return found.select(
        "doc_id", *[count(i).alias(f"n_{kind}") for i, (kind, *_) in enumerate(KINDS)],
        F.sha2(_shown("base"), 256).alias("base_sha256"), _shown("spans").alias("spans"),
    )


QUERIES = {"op6_secret_scan": op6_secret_scan}
ORACLE: dict[str, str] = {}
