"""Benchmark decontamination by a generalised suffix automaton of the test items.

The items' words become numbers and all items go into one suffix automaton. Every document is streamed through it word by
word, which gives at each word the length of the longest match that ends there. A window is ``WINDOW`` consecutive item
words (a shorter item is one window); where the match is at least that long, the window's words are hit and the
automaton's state names the items it occurs in. Only stretches of words in which every neighbouring pair also occurs in an
item are streamed, since no window can lie across any other pair; a table of the items' pairs finds them.

Items are dealt into slices of at most ``SLICE_WORDS`` words by measured size: equal texts are one item with several ids, and
a text that is longer comes in overlapping parts. The words of a slice are broadcast, and every Python process builds its
automaton once. Documents are streamed through one slice after the other, each pass adding its hits to the row and
written before the next. One slice is the usual case and writes nothing. The ids of equal items travel with their text.

Cases: null texts have no words, and a document or item without words is never hit. Items that repeat hit alike, each
under its own id; a null item id is left out of the ids. Rows that repeat are judged alike. Further columns are kept. Empty
tables give no hits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrashelf.llm.common import UPPER, claim, column_at, lowered, small_batches, table
from terrashelf.session import cut

WINDOW = 10
#: Words of the items in one automaton; its size, and that of the broadcast, is a fixed multiple.
SLICE_WORDS = 200_000
#: A word after A-Z is lower-cased: ASCII digits and letters and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Per byte of UTF-8 what it is in a word, or a blank.
_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())
_WORDS = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_BYTES).split()


class Automaton:
    """Generalised suffix automaton over word numbers, with the items that each window occurs in."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.shorter: set[int] = set()
        self.items: dict[tuple[int, int], set] = {}
        coded = [(name, [self.words.setdefault(w, len(self.words)) for w in words]) for name, words in items if words]
        for _, word_ids in coded:
            last = 0
            for word in word_ids:
                last = self._extend(last, word)
        for name, word_ids in coded:
            size = min(window, len(word_ids))
            if size < window:
                self.shorter.add(size)
            for _, state, _ in self._ends(word_ids, size):
                self.items.setdefault((state, size), set()).add(name)
        pairs = {a * len(self.words) + b for _, ids in coded for a, b in zip(ids, ids[1:])}
        self.pairs = np.array(sorted(pairs), dtype=np.int64)
        self.lengths = sorted({*self.shorter, window}, reverse=True)

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._clone(last, known, word)
        new = self._state(self.length[last] + 1, {}, 0)
        while last != -1 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last != -1:
            known = self.next[last][word]
            fits = self.length[known] == self.length[last] + 1
            self.link[new] = known if fits else self._clone(last, known, word)
        return new

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _clone(self, last: int, known: int, word: int) -> int:
        copy = self._state(self.length[last] + 1, dict(self.next[known]), self.link[known])
        self.link[known] = copy
        while last != -1 and self.next[last].get(word) == known:
            self.next[last][word] = copy
            last = self.link[last]
        return copy

    def matches(self, word_ids: list[int]) -> Iterator[tuple[int, int, int]]:
        """For each word that ends a match: its place, the state and the length of the longest match there."""
        state = length = 0
        for place, word in enumerate(word_ids):
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            state = self.next[state].get(word, 0)
            length = length + 1 if state else 0
            yield place, state, length

    def _ends(self, word_ids: list[int], size: int) -> Iterator[tuple[int, int, int]]:
        """Places where a match of ``size`` ends, with the state of exactly that length's suffix."""
        for place, state, length in self.matches(word_ids):
            if length >= size:
                while self.length[self.link[state]] >= size:
                    state = self.link[state]
                yield place, state, size

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, int, set]:
        """Which words lie in a window, the longest match that holds a window, and the items of all windows."""
        hit, longest, items = np.zeros(len(words), dtype=bool), 0, set()
        if not words or not self.words:
            return hit, longest, items
        ids = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
        known = ids >= 0
        joined = known[:-1] & known[1:]
        if joined.any() and len(self.pairs):
            code = ids[:-1] * len(self.words) + ids[1:]
            at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            joined &= self.pairs[at] == code
        else:
            joined[:] = False
        # A stretch is a run of known words that are joined pair by pair; a lone word is one, too.
        begins = np.flatnonzero(known & ~np.append(False, joined))
        ends = np.flatnonzero(known & ~np.append(joined, False)) + 1
        long = ends - begins >= self.lengths[-1]
        for begin, end in zip(begins[long].tolist(), ends[long].tolist()):
            for place, state, length in self.matches(ids[begin:end].tolist()):
                for size in self.lengths:
                    if length < size:
                        continue
                    while self.length[self.link[state]] >= size:
                        state = self.link[state]
                    names = self.items.get((state, size))
                    if names is not None:
                        stop = begin + place + 1
                        hit[stop - size : stop] = True
                        longest = max(longest, length)
                        items |= names
        return hit, longest, items


def _runs(hit: np.ndarray) -> list[int]:
    """Starts and ends of the hit words, one after the other."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return edges.tolist()


def item_slices(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW,
                limit: int = SLICE_WORDS) -> tuple[DataFrame, list[list[int]]]:
    """A table (bin, words, ids) of the distinct item texts, and the bins of each slice.

    Equal texts are one row. A text of more than ``limit`` words comes in parts that overlap by a window less a word, so every
    window lies in one. Bins are taken by hash, about four a slice, and joined while their words stay within ``limit``.
    """
    norm = F.regexp_replace(lowered(F.coalesce(F.col(text), F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    named = items.select(F.col(item_id).cast("string").alias("id"), F.trim(norm).alias("norm")).where("norm <> ''")
    texts = named.groupBy("norm").agg(F.sort_array(F.collect_set("id")).alias("ids")).withColumn("all", F.split("norm", " "))
    starts = F.sequence(F.lit(0), F.greatest(F.size("all") - window, F.lit(0)), F.lit(limit))
    parts = texts.select("ids", "all", F.explode(starts).alias("at")).select(
        "ids", F.slice("all", F.col("at") + 1, limit + window - 1).alias("words"))
    parts = cut(parts.withColumn("n", F.size("words").cast("long")))
    total = parts.agg(F.sum("n")).first()[0] or 0
    dealt = parts.withColumn("bin", F.pmod(F.xxhash64("words"), F.lit(4 * -(-total // limit) or 1)).cast("int"))
    slices, room = [], 0
    for r in dealt.groupBy("bin").agg(F.sum("n").alias("n")).orderBy("bin").collect():
        if r.n > room:
            slices.append([])
            room = limit
        slices[-1].append(r.bin)
        room -= r.n
    return dealt.select("bin", "words", "ids"), slices or [[]]


_built: dict[int, Automaton] = {}


def _automaton(shared, window: int) -> Automaton:
    """The automaton of a slice, built once in every Python process that meets it."""
    claim("decontaminate", _built.clear)
    key = id(shared.value)
    if key not in _built:
        _built.clear()
        _built[key] = Automaton(shared.value, window)
    return _built[key]


_FOUND = {"n_words": pa.int64(), "hit_runs": pa.list_(pa.int64()), "longest": pa.int64(), "items": pa.list_(pa.string())}
_FOUND_TYPE = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("hit_runs", T.ArrayType(T.LongType())),
    T.StructField("longest", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
])


def _without(text: str, runs: list[int]) -> str:
    """``text`` without the words of the runs and what stands between them."""
    places = [m.span() for m in _WORDS.finditer(text)]
    kept, at = [], 0
    for start, stop in zip(runs[::2], runs[1::2]):
        kept.append(text[at : places[start][0]])
        at = places[stop - 1][1]
    return "".join([*kept, text[at:]])


def _judge(shared, window: int, text: str, rest: bool):
    """Rows with the hits of one slice added to what is found so far; ``text`` names the column that is read.

    With ``rest`` the column _rest holds the text without its hit spans, null where there are none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(shared, window)
        for batch in batches:
            before = batch.select(list(_FOUND)).to_pylist() if "n_words" in batch.schema.names else repeat(None)
            rows, left = [], []
            for value, known in zip(pc.cast(column_at(batch, text), pa.binary()), before):
                data = value.as_py() or b""
                words = words_of(data)
                hit, longest, items = automaton.hits(words)
                names = {i for ids in items for i in ids}
                if known is not None:
                    for start, stop in zip(known["hit_runs"][::2], known["hit_runs"][1::2]):
                        hit[start:stop] = True
                    longest, names = max(longest, known["longest"]), names | set(known["items"])
                runs = _runs(hit)
                rows.append((len(words), runs, longest, sorted(names)))
                left.append(_without(data.decode(), runs) if rest and runs else None)
            columns = {n: batch.column(n) for n in batch.schema.names if n not in _FOUND}
            for place, (name, kind) in enumerate(_FOUND.items()):
                columns[name] = pa.array([r[place] for r in rows], kind)
            yield pa.RecordBatch.from_pydict({**columns, "_rest": pa.array(left, pa.string())} if rest else columns)

    return run


def find_hits(docs: DataFrame, items: DataFrame, text: str = "text", keep: list[str] | None = None,
              window: int = WINDOW, limit: int = SLICE_WORDS, rest: bool = False) -> DataFrame:
    """The columns ``keep`` (all by default) with n_words, hit_runs (starts and ends of hit words), longest and items.

    ``text`` may name a field of a kept struct; with ``rest`` the column _rest has the text without its hit spans.
    """
    small_batches(docs.sparkSession)
    names = [c for c in keep or docs.columns if c not in _FOUND]
    column = text if text.split(".")[0] in names else "_text"
    rows = docs.select(*names) if column == text else docs.select(*names, F.col(text).alias("_text"))
    kept, share = rows.schema, docs.sparkSession.sparkContext.broadcast
    texts, slices = item_slices(items, window=window, limit=limit)
    for number, bins in enumerate(slices):
        last = rest and number == len(slices) - 1
        # At most ``limit`` words, or the bin of a hash that more of them met.
        listed = [(tuple(r.ids), [w.encode() for w in r.words]) for r in texts.where(F.col("bin").isin(bins)).collect()]
        schema = T.StructType([*kept.fields, *_FOUND_TYPE.fields])
        judge = _judge(share(listed), window, column, last)
        rows = (rows if number == 0 else cut(rows)).mapInArrow(judge, schema.add("_rest", "string") if last else schema)
    return rows.drop("_text")


def hit_words(runs: Column) -> Column:
    """The number of words in ``hit_runs``."""
    signed = F.transform(runs, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))
    return F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x)


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", max_coverage: float = 0.5,
                  max_length: int | None = None, window: int = WINDOW) -> DataFrame:
    """``docs`` without benchmark passages, under the columns of ``docs``; only ``text`` may change.

    A document of whose words more than ``max_coverage`` are hit goes, and so does one with a match of ``max_length`` words or
    more; of the others the hit spans are cut out of the text. Items shorter than a window are only ever cut out:
    a document without a match of ``window`` words stays. With ``max_coverage`` 0 every text that is kept for want of
    hits stays as it is.
    """
    # The row travels as one column, so none of its names meets one of the hits'.
    rows, left = docs.select(F.struct("*").alias("_row")), F.col("_rest")
    found = find_hits(rows, items, f"_row.{text}", ["_row"], window, rest=True).withColumn("_hit", hit_words(F.col("hit_runs")))
    beyond = F.col("_hit") > max_coverage * F.col("n_words")
    if max_length is not None:
        beyond |= F.col("longest") >= max_length
    kept = found.where(~(beyond & (F.col("longest") >= window)))
    return kept.select(F.when(left.isNull(), F.col("_row")).otherwise(F.col("_row").withField(text, left)).alias("_row")).select("_row.*")


def digests(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", hit_words(F.col("hit_runs")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("hit_runs") > 0).alias("contaminated"), "longest",
    )


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return digests(found).drop("longest")


_SQL_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{WORD}')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g
    FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
          FROM (SELECT *, least({WINDOW}, len(w)) AS n FROM b WHERE len(w) > 0))),
placed AS (
    SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
    FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i
          FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS (SELECT r, n, i, item_id FROM placed JOIN windows USING (n, g)),
hits AS (
    SELECT r, count(DISTINCT p) AS n_hit
    FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM found)) GROUP BY r),
items AS (
    SELECT r, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
    FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS name FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)"""

QUERIES = {"op7_decontaminate": op7_decontaminate}
ORACLE = {"op7_decontaminate": SQL}
