"""Tokens of two tokenizers aligned on the bytes of the text, each distinct text once.

Documents are shuffled by their full text, with a partial count before, so a text that many documents share is tokenised and
aligned once and its pairs count as often as it occurs. What a text gives (sizes, digest, its linked id pairs) is written
beside the SHA-256 of the text; measures are joined to the documents on that digest, never on gathered identifiers.

A is a byte-level BPE, run by ``tiktoken`` over the vocabulary of the tokenizer file: it merges the same pairs in the same order.
B is a sentencepiece model. Offsets in bytes where a token of A and one of B both end cut the text into groups, and the two
tokens that end a group are linked. Long texts are encoded in parts cut at a blank between two ASCII letters, across which
neither tokenizer joins anything.

Counting: each task adds up its links by id pair, the sums are added by pair. Of two linked tokens the shorter one's bytes end
the longer one's, so the number of pairs is bounded by the two vocabularies (``most_pairs``), not by the corpus; their
counts are broadcast to the pass that measures the texts.

Cases: texts that are null or empty, or whose tokens' bytes differ from a blank and the text, have no tokens: zeros and an
empty digest. Strings of special tokens inside texts are plain text. Rows that repeat an identifier or a text are measured
alike. Further columns are not carried. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrashelf.llm.common import byte_signs, claim, small_batches, table
from terrashelf.session import cut

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: What a piece writes a blank as.
BLANK = "▁"
#: Signs of text that are encoded at a time, and bytes of text that are aligned at a time.
PART, SPAN_BYTES = 1 << 20, 1 << 20
#: Distinct pairs a task adds up before it goes on with their sums.
HELD = 1 << 21
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
_CUT = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Aligner:
    """Both tokenizers with their tokens' bytes; kept by a Python process over all of its tasks."""

    _open: dict[tuple[str, str], "Aligner"] = {}

    def __init__(self, a_path: str, b_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as file:
            given = json.load(file)
        signs, special = byte_signs(), {t["content"] for t in given["added_tokens"]}
        ranks = {bytes(map(signs.__getitem__, t)): i for t, i in given["model"]["vocab"].items() if t not in special}
        self.encoding = tiktoken.Encoding("aligned", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for data, i in ranks.items():
            self.a_bytes[i] = data
        self.b_bytes = [self._of_piece(i) for i in range(self.pieces.get_piece_size())]
        self.a_size, self.b_size = (np.array(list(map(len, t)), dtype=np.int64) for t in (self.a_bytes, self.b_bytes))
        ids = lambda n, end: [b"%d%s" % (i, end) for i in range(n)]
        na, nb = len(self.a_bytes), len(self.b_bytes)
        #: Ids as they are written within a group and at the end of its half, for A and then for B.
        self.written = [*ids(na, b","), *ids(na, b"|"), *ids(nb, b","), *ids(nb, b";")]

    def _of_piece(self, i: int) -> bytes:
        piece = self.pieces.id_to_piece(i)
        if self.pieces.is_byte(i):
            return bytes([int(_BYTE.fullmatch(piece)[1], 16)])
        return piece.replace(BLANK, " ").encode()

    @classmethod
    def of(cls, paths: tuple[str, str]) -> "Aligner":
        claim("aligntokens", cls._open.clear)
        if paths not in cls._open:
            cls._open[paths] = cls(*paths)
        return cls._open[paths]

    def encode(self, text: str) -> tuple[list[int], list[int]] | None:
        """The ids of both, or None where their bytes differ from a blank and the text."""
        a, b = [], []
        for part in _parts(text):
            data = b" " + part.encode()
            more = self.encoding.encode_ordinary(" " + part), self.pieces.encode(part)
            if any(b"".join(map(t.__getitem__, ids)) != data for t, ids in zip((self.a_bytes, self.b_bytes), more)):
                return None
            a += more[0]
            b += more[1]
        return a, b

    def most_pairs(self) -> int:
        """How many id pairs can be linked at all: the bytes of one end those of the other."""
        a, b = {}, {}
        for of, names in ((a, self.a_bytes), (b, self.b_bytes)):
            for data in names:
                of[data] = of.get(data, 0) + bool(data)
        ends = lambda data, first: [data[i:] for i in range(first, len(data))]
        return sum(n * b.get(e, 0) for d, n in a.items() for e in ends(d, 0)) + sum(
            n * a.get(e, 0) for d, n in b.items() for e in ends(d, 1))


def _parts(text: str) -> Iterator[str]:
    """The text in parts of about ``PART`` signs that, joined by blanks, give it again."""
    at = 0
    while len(text) - at > PART and (found := _CUT.search(text, at + PART)):
        yield text[at : found.start()]
        at = found.end()
    yield text[at:]


def aligned(a: np.ndarray, b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens of ``a`` and of ``b`` that end together; both cover the same bytes."""
    a_end, b_end = np.cumsum(a_size[a]), np.cumsum(b_size[b])
    marks = np.zeros((2, int(a_end[-1]) + 1 if len(a_end) else 1), dtype=bool)
    marks[0, a_end], marks[1, b_end] = True, True
    return np.flatnonzero(marks[1, a_end]), np.flatnonzero(marks[0, b_end])


def _written(aligner: Aligner, a: np.ndarray, b: np.ndarray, ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
    """Places in ``aligner.written`` of all tokens in the order of their groups."""
    last_a, last_b = (np.zeros(len(t), dtype=bool) for t in (a, b))
    last_a[ia], last_b[ib] = True, True
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    na, nb = len(aligner.a_bytes), len(aligner.b_bytes)
    found = np.empty(len(a) + len(b), dtype=np.int64)
    found[np.arange(len(a)) + np.append(0, ib + 1)[group_a]] = a + na * last_a
    found[np.arange(len(b)) + (ia + 1)[group_b]] = 2 * na + b + nb * last_b
    return found


def _digest(aligner: Aligner, places: np.ndarray) -> str:
    found, get = hashlib.sha256(), aligner.written.__getitem__
    for at in range(0, len(places), PART):
        data = b"".join(map(get, places[at : at + PART].tolist()))
        found.update(data if at + PART < len(places) else data[:-1])
    return found.hexdigest()


_MEASURED = "key binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def _measured(aligner: Aligner, texts: list[str]) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
    """Sizes and digests of the texts, and their distinct pairs: where each text's begin, the pairs and how often each is linked."""
    both = [aligner.encode(t) for t in texts]
    codes = lambda which: [np.array(e[which] if e else [], dtype=np.int64) for e in both]
    a_of, b_of = codes(0), codes(1)
    a, b = np.concatenate(a_of), np.concatenate(b_of)
    ia, ib = aligned(a, b, aligner.a_size, aligner.b_size)
    places = _written(aligner, a, b, ia, ib)
    a_stop, b_stop = (np.cumsum([len(t) for t in of]) for of in (a_of, b_of))
    # Every text ends a group, so links never lie across two.
    stop = np.searchsorted(ia, a_stop, side="left")
    rows = []
    for i in range(len(texts)):
        first_a, first_b, first = (s[i - 1] if i else 0 for s in (a_stop, b_stop, stop))
        n_a, n_b, n = int(a_stop[i] - first_a), int(b_stop[i] - first_b), int(stop[i] - first)
        rows.append((n_a, n_b, n, n, _digest(aligner, places[first_a + first_b : a_stop[i] + b_stop[i]]) if n else ""))
    text = np.repeat(np.arange(len(texts)), np.diff(stop, prepend=0))
    code = a[ia] * len(aligner.b_bytes) + b[ib]
    key, times = np.unique(text << 31 | code, return_counts=True)
    starts = np.searchsorted(key >> 31, np.arange(len(texts) + 1))
    return rows, starts, key & (1 << 31) - 1, times


def _spans(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    """The texts of a batch in spans of about ``SPAN_BYTES``, with the place of the first."""
    held, size, first = [], 0, 0
    for i, text in enumerate(batch.column("_text")):
        held.append(text.as_py())
        size += len(held[-1])
        if size >= SPAN_BYTES:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def _lists(starts: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, pa.int64()))


def _align(paths_of: Callable[[], tuple[str, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = None
        for batch in batches:
            aligner = aligner or Aligner.of(paths_of())
            for first, texts in _spans(batch):
                rows, starts, pairs, times = _measured(aligner, texts)
                kept = [batch.column(c).slice(first, len(texts)) for c in ("key", "copies")]
                columns = [pa.array(c, pa.string() if i == 4 else pa.int64()) for i, c in enumerate(zip(*rows))]
                yield pa.RecordBatch.from_arrays(
                    [*kept, *columns, _lists(starts, pairs), _lists(starts, times)],
                    names=[c.split()[0] for c in _MEASURED.split(", ")])

    return run


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all pairs of the batch: row, pair and how often it is linked."""
    sizes = pc.list_value_length(batch.column("pairs")).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(batch.num_rows), sizes)
    return row, batch.column("pairs").flatten().to_numpy(), batch.column("times").flatten().to_numpy()


def _added(pairs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of ``n`` by pair."""
    distinct, place = np.unique(pairs, return_inverse=True)
    sums = np.zeros(len(distinct), dtype=np.int64)
    np.add.at(sums, place, n)
    return distinct, sums


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task adds up: a row a pair."""
    held, size = [], 0
    for batch in batches:
        row, pairs, times = _flat(batch)
        held.append((pairs, times * batch.column("copies").to_numpy()[row]))
        size += len(pairs)
        if size >= HELD:
            held = [_added(*map(np.concatenate, zip(*held)))]
            size = len(held[0][0]) // 2
    if held:
        pairs, n = _added(*map(np.concatenate, zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], names=["pair", "n"])


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch in batches:
            row, pairs, times = _flat(batch)
            at = np.searchsorted(pair, pairs)
            top, total = (np.zeros(batch.num_rows, dtype=np.int64) for _ in range(2))
            np.add.at(top, row, times * best[at])
            np.add.at(total, row, times * n[at])
            kept = [c for c in batch.schema.names if c not in ("pairs", "times")]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(top), pa.array(total)], names=[*kept, "n_best", "count_sum"])

    return run


def paths() -> tuple[str, str]:
    return tokenizer_path(A_FILE), tokenizer_path(B_FILE)


def distinct_texts(docs: DataFrame, text: str = "text", paths_of: Callable[[], tuple[str, str]] = paths) -> DataFrame:
    """A row a distinct text that is not empty: key (SHA-256), copies, sizes, digest of the groups, pairs and times."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(text).alias("_text")).where("_text <> ''").groupBy("_text").agg(F.count("*").alias("copies"))
    keyed = texts.select(F.unhex(F.sha2("_text", 256)).alias("key"), "copies", "_text")
    return keyed.mapInArrow(_align(paths_of), _MEASURED)


def pair_counts(texts: DataFrame) -> DataFrame:
    """pair (id of A times the size of B, and id of B) and n, the links of all documents that hold it."""
    parts = texts.select("copies", "pairs", "times").mapInArrow(_counted, "pair long, n long")
    return parts.groupBy("pair").agg(F.sum("n").alias("n"))


def measures(docs: DataFrame, keep: list[str], text: str = "text",
             paths_of: Callable[[], tuple[str, str]] = paths) -> DataFrame:
    """The columns ``keep`` and n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    share = docs.sparkSession.sparkContext.broadcast
    texts = cut(distinct_texts(docs, text, paths_of))
    # At most ``Aligner.most_pairs`` rows, whatever the corpus.
    counts = pair_counts(texts).toArrow().sort_by("pair")
    pair, n = (counts.column(c).to_numpy() for c in ("pair", "n"))
    b_size = len(Aligner.of(paths_of()).b_bytes)
    most = np.zeros(b_size, dtype=np.int64)
    np.maximum.at(most, pair % b_size, n)
    sizes = ["n_a", "n_b", "n_groups", "n_links"]
    scored = texts.select("key", *sizes, "groups_sha256", "pairs", "times").mapInArrow(
        _scored(share((pair, n, n == most[pair % b_size]))),
        "key binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    # Names of its own, so that none meets one of the kept.
    found = scored.select(F.col("key").alias("_key"), F.struct(*[c for c in scored.columns if c != "key"]).alias("_m"))
    rows = docs.select(F.struct(*keep).alias("_row"), F.unhex(F.sha2(text, 256)).alias("_key"))
    number = lambda c: F.coalesce(F.col(f"_m.{c}"), F.lit(0).cast("long")).alias(c)
    return rows.join(cut(found), "_key", "left").select(
        "_row.*", *map(number, [*sizes, "n_best", "count_sum"]), F.coalesce("_m.groups_sha256", F.lit("")).alias("groups_sha256"))


def op11_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures(table(spark, sf_dir, "documents"), ["doc_id"])


QUERIES = {"op11_align_tokens": op11_align_tokens}
ORACLE: dict[str, str] = {}
