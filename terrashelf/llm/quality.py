"""Quality scores: random-indexing word vectors pooled per document, then a small network with a calibrated temperature.

Every token has a sparse random index vector. A token's vector is the sum of the index vectors around each of its
occurrences in all documents, scaled to length one, plus its own index vector. Tokens are hashed into a fixed number of
places, so the table has a fixed size however large the corpus is; tasks sum their part of it and the parts are added
up by range of places. A word gives two tokens: itself in lower case, and its shape (runs of capitals, small letters,
digits, other signs; a word that repeats the one before it has a shape of its own). A document is the mean of its words'
vectors and the mean of its shapes' vectors.

The network (two layers, numpy) is fitted on the driver to at most ``MAX_ROWS`` labelled documents, those with the smallest
hash of their identifier; a tenth of them sets the temperature that divides the logit. Corpus statistics cover every text.

Cases: a null text is empty; a text without words has the zero vector and gets a score like any other. Labels that are
null are left out, of repeated ones the mean counts. Without labels of both classes, or with fewer than ``LEAST_ROWS`` labelled
rows, all scores are the mean label, or one half without any. Rows of one identifier with equal vectors train once. A row without identifier is not held out and never trains. Rows that repeat are scored alike. Further
columns are kept by ``scored``. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrashelf.llm.common import claim, column_at, small_batches, table

#: Places of words and of shapes, and length of their vectors.
WORDS, SHAPES, SIZE = 1 << 14, 1 << 10, 48
#: Entries of an index vector that are not zero, and how far its context reaches.
ENTRIES, REACH = 4, 2
#: Most labelled documents that the network is fitted to.
MAX_ROWS = 20_000
#: Labelled rows below which no network is fitted.
LEAST_ROWS = 20
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 256, 3e-3, 1e-4
#: Folds by crc32 of the identifier: this remainder of division by FOLDS is held out.
FOLDS, HELD_OUT = 3, 1
#: Places of the table that are summed together.
RANGE = 272
#: Tokens that a Python process keeps the places of; at more it starts afresh.
KEPT_TOKENS = 200_000
_SPAN = 1 << 19
_CLASSES = bytes(
    ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57 else b
    for b in range(256)
)
_REPEATED = zlib.crc32(b"repeated") % SHAPES
_places: dict[bytes, int] = {}


def _place(word: bytes) -> int:
    """Of a word and of its shape, in one number."""
    shape = bytearray()
    for sign in word.translate(_CLASSES):
        if not shape or shape[-1] != sign:
            shape.append(sign)
    found = zlib.crc32(word.lower()) % WORDS * SHAPES + zlib.crc32(bytes(shape)) % SHAPES
    _places[word] = found
    return found


def places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words and of the shapes of a text; shapes come after all words in the table."""
    if len(_places) > KEPT_TOKENS:
        _places.clear()
    words, get = text.split(), _places.get
    both = np.fromiter((get(w) or _place(w) for w in words), np.int64, len(words))
    shapes = both % SHAPES
    shapes[1:][both[1:] == both[:-1]] = _REPEATED
    return both // SHAPES, shapes + WORDS


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Per place the entries that are not zero, and their signs."""
    rng = np.random.default_rng(20240101)
    where = np.argsort(rng.random((WORDS + SHAPES, SIZE)), axis=1)[:, :ENTRIES]
    return where, rng.choice(np.array([-1.0, 1.0]), size=where.shape)


def _texts(batch: pa.RecordBatch, column: str = "_text") -> Iterator[bytes]:
    claim("quality", _places.clear)
    return (t.as_py() or b"" for t in pc.cast(column_at(batch, column), pa.binary()))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to the task's part of the table of context sums, a row a range of places."""
    where, signs = index_vectors()
    sums = np.zeros((WORDS + SHAPES) * SIZE)

    def add(centre: np.ndarray, around: np.ndarray) -> None:
        for entry in range(ENTRIES):
            at = centre * SIZE + where[around, entry]
            np.add(sums, np.bincount(at, weights=signs[around, entry], minlength=len(sums)), out=sums)

    def flush(held: list) -> None:
        words, shapes = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        doc = np.repeat(np.arange(len(held)), [len(h[0]) for h in held])
        for step in range(1, REACH + 1):
            same = np.flatnonzero(doc[step:] == doc[:-step])
            for a, b in ((same, same + step), (same + step, same)):
                add(words[a], words[b])
                add(shapes[a], shapes[b])

    held, n = [], 0
    for batch in batches:
        for text in _texts(batch):
            held.append(places(text))
            n += len(held[-1][0])
            if n >= _SPAN:
                flush(held)
                held, n = [], 0
    if n:
        flush(held)
    yield from _ranges(sums)


def _ranges(sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    parts = sums.reshape(-1, RANGE * SIZE)
    used = np.flatnonzero(parts.any(axis=1))
    data = [parts[i].astype("<f4").tobytes() for i in used]
    yield pa.RecordBatch.from_arrays(
        [pa.array(used.astype(np.int32)), pa.array(data, pa.binary())], names=["range", "sums"]
    )


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the same range added up; a task holds its ranges of the table and no more."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for number, data in zip(batch.column("range").to_pylist(), batch.column("sums")):
            part = np.frombuffer(data.as_buffer(), "<f4").astype(np.float64)
            total[number] = total[number] + part if number in total else part
    found = sorted(total)
    data = [total[i].astype("<f4").tobytes() for i in found]
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(data, pa.binary())], names=["range", "sums"])


_TABLE = "range int, sums binary"


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The table of vectors of all places, (WORDS + SHAPES) x SIZE; its size does not depend on the corpus."""
    small_batches(docs.sparkSession)
    parts = docs.select(F.col(text).alias("_text")).mapInArrow(_contexts, _TABLE)
    rows = parts.repartition("range").mapInArrow(_added, _TABLE).collect()
    sums = np.zeros((WORDS + SHAPES, SIZE))
    for row in rows:
        sums[row["range"] * RANGE : (row["range"] + 1) * RANGE] = np.frombuffer(row["sums"], "<f4").reshape(-1, SIZE)
    where, signs = index_vectors()
    own = np.zeros_like(sums)
    np.put_along_axis(own, where, signs / np.sqrt(ENTRIES), axis=1)
    return (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1.0) + own).astype(np.float32)


def pooled(text: bytes, vectors: np.ndarray) -> np.ndarray:
    """Mean vector of the words, then of the shapes; zero without words."""
    found = np.zeros(2 * SIZE, dtype=np.float32)
    words, shapes = places(text)
    if len(words):
        for part, at in ((words, 0), (shapes, SIZE)):
            total = np.zeros(SIZE)
            for begin in range(0, len(part), 1 << 14):
                total += vectors[part[begin : begin + (1 << 14)]].sum(axis=0, dtype=np.float64)
            found[at : at + SIZE] = total / len(part)
    return found


@dataclass
class Network:
    """Two layers on standardised input; ``temperature`` divides the logit."""

    mean: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: np.ndarray
    temperature: float = 1.0

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.first + self.first_bias)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return (self.hidden(x) @ self.second + self.second_bias)[:, 0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def _constant(width: int, share: float) -> Network:
    share = min(max(share, 1e-3), 1 - 1e-3)
    zero = np.zeros((width, 1))
    return Network(np.zeros(width), np.ones(width), zero, np.zeros(1), np.zeros((1, 1)), np.array([np.log(share / (1 - share))]))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
    """The network fitted with Adam to nine tenths of the rows, its temperature to the rest."""
    if len(set(y.tolist())) < 2 or len(y) < LEAST_ROWS:
        return _constant(x.shape[1], float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 10], order[len(y) // 10 :]
    net = Network(
        x[used].mean(axis=0), x[used].std(axis=0) + 1e-4,
        rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
        rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 1)), np.zeros(1),
    )
    weights = [net.first, net.first_bias, net.second, net.second_bias]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    step = 0
    for _ in range(EPOCHS):
        rng.shuffle(used)
        for at in range(0, len(used), BATCH):
            rows = used[at : at + BATCH]
            hidden = net.hidden(x[rows])
            miss = ((1 / (1 + np.exp(-np.clip(hidden @ net.second + net.second_bias, -40, 40))))[:, 0] - y[rows])[:, None] / len(rows)
            back = miss @ net.second.T * (1 - hidden**2)
            inputs = (x[rows] - net.mean) / net.scale
            slopes = [inputs.T @ back + DECAY * net.first, back.sum(axis=0), hidden.T @ miss + DECAY * net.second, miss.sum(axis=0)]
            step += 1
            for weight, slope, (mean, square) in zip(weights, slopes, moments):
                mean += 0.1 * (slope - mean)
                square += 0.001 * (slope**2 - square)
                weight -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    net.temperature = _temperature(net.logits(x[held]), y[held])
    return net


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, from a grid between one half and ten."""
    grid = np.exp(np.linspace(np.log(0.5), np.log(10), 61))
    loss = [np.mean(np.logaddexp(0, -np.where(y == 1, 1, -1) * logits / t)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _pool(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = shared.value
        for batch in batches:
            data = [pooled(t, vectors).tobytes() for t in _texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array(data, pa.binary())],
                names=["doc_id", "label", "pooled"],
            )

    return run


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, Network]:
    """Vectors from all of ``docs(doc_id, text)``, and a network fitted to ``labels(doc_id, quality)`` outside the held-out fold."""
    vectors = word_vectors(docs)
    usable = labels.where(F.col("quality").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT))
    sample = (
        usable.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    # The sample has at most ``max_rows`` short rows, so its broadcast is bounded.
    rows = docs.select("doc_id", F.col("text").alias("_text")).join(F.broadcast(sample), "doc_id")
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    pools = rows.select("doc_id", "label", "_text").mapInArrow(_pool(shared), "doc_id long, label double, pooled binary").distinct()
    # Rows may repeat an identifier, so the bound is set once more on what goes to the driver.
    found = pools.orderBy(F.xxhash64("doc_id"), "doc_id", "pooled").limit(max_rows).collect()
    found.sort(key=lambda r: (r.doc_id, bytes(r.pooled)))
    x = np.array([np.frombuffer(r.pooled, np.float32) for r in found], dtype=np.float64).reshape(-1, 2 * SIZE)
    return vectors, fit(x, np.array([r.label for r in found]))


def _scorer(shared, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = shared.value
        for batch in batches:
            x = np.array([pooled(t, vectors) for t in _texts(batch, column)], dtype=np.float64).reshape(-1, 2 * SIZE)
            columns = {n: batch.column(n) for n in batch.schema.names if n != "_text"}
            yield pa.RecordBatch.from_pydict({**columns, "_score": pa.array(net.probability(x))})

    return run


def scored(docs: DataFrame, model: tuple[np.ndarray, Network], keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) and _score, the probability of label 1.

    ``text`` may name a field of a kept struct, which then goes to Python only once.
    """
    small_batches(docs.sparkSession)
    names = keep or docs.columns
    column = text if text.split(".")[0] in names else "_text"
    rows = docs.select(*names) if column == text else docs.select(*names, F.col(text).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = T.StructType([f for f in rows.schema.fields if f.name != "_text"])
    return rows.mapInArrow(_scorer(shared, column), kept.add("_score", "double"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return scored(docs, model, ["doc_id"]).select(
        "doc_id", held.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted")
    )


QUERIES = {"op9_quality": op9_quality}
ORACLE: dict[str, str] = {}
