"""Token identifiers as length-delimited binary records with a separate offset index.

A file holds the records of one range of documents in ascending order. A record is framed as

    length of the payload    8 bytes, little endian
    masked checksum of those 8 bytes    4 bytes
    payload
    masked checksum of the payload    4 bytes
    line end    1 byte

and the payload is one byte of flags (1: the identifier is there; 2 or 4 in the upper half: bytes per token), the identifier
in 8 bytes, and the tokens, little endian. The checksum is CRC-32, rotated right by 15 bits with a constant added, so
that checksums of data which itself holds checksums stay good. The closing line end lets Spark's text writer put the
frames into files on any file system it knows; readers go by the lengths.

The index is a table beside the files: shard, place, offset, bytes, doc_id, n_tokens, start. A shuffled reader takes any
rows of it and reads those byte ranges.

Tokens are those of the whole text. The tokenizer lower-cases, cuts text into runs of letters, single digits and runs of other
signs, and merges each piece on its own. Text of Latin letters and ASCII is cut in the same way and its pieces are merged by
``tiktoken``, which holds the same merges in the same order; words with other signs, and texts with the start of a special
token, go through the tokenizer file.

Cases: a null text is empty and has only the end token. Null identifiers come last and are read back as null. Rows that
repeat an identifier each have a record. Further columns are not carried. An empty table gives no records.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrashelf.llm.common import byte_signs, claim, fitted, small_batches, table
from terrashelf.session import cut, scratch_path

#: Fixed values of the format.
MASK = 0xA282EAD8
HEAD = struct.Struct("<QI")
FRONT = struct.Struct("<Bq")
TAIL = struct.Struct("<I")
HAS_ID = 1
#: Put after every document.
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Bytes of text that are taken apart at a time.
SPAN_BYTES = 2_000_000
#: Bytes of text of a range on average, at most.
SHARD_BYTES = 128 * 1024 * 1024
#: Bytes of frames that are written as one piece, and pieces of a file: neighbours of 100 MB each still stay below 2 GB.
PIECE_BYTES, PIECES = 8 * 1024 * 1024, 16
#: More than a write has tasks.
FILES = 1 << 32
#: What a token that ends a word is written with.
WORD_END = "</w>"
#: Stands between words that are encoded together.
MARK = "\x01"
#: Letters that stay as they are when the tokenizer normalises lower-case text.
_LETTERS = "a-z\xdf-\xf6\xf8-\u012f\u0131-\u0148\u014b-\u017f"
#: Lower-case text of such letters and of ASCII, but for other control signs than blanks.
PLAIN = re.compile(f"[\t-\r -~{_LETTERS}]*")
BLANKS = re.compile("[\t-\r ]+")
#: What the tokenizer cuts text into, for these signs.
CUTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\s0-9{_LETTERS}]+")


def masked(data: bytes) -> int:
    """CRC-32 of ``data``, rotated right by 15 bits, with the constant added."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + TAIL.pack(masked(length)) + payload + TAIL.pack(masked(payload))


def payload_of(doc_id: int | None, tokens: bytes, width: int) -> bytes:
    return FRONT.pack(width << 4 | (HAS_ID if doc_id is not None else 0), doc_id or 0) + tokens


class Encoder:
    """Encodes texts with a tokenizer file; kept by a Python process over all of its tasks."""

    _open: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.mark, = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words, self.ids = self._word_encoding(path)

    def _word_encoding(self, path: str):
        """The vocabulary as an encoding of pieces that each end in ``MARK``, and its ids.

        A piece's last byte and the mark are merged before anything else, then pairs merge in the file's order.
        """
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        signs, mark = byte_signs(), MARK.encode()
        ended = lambda t: bytes(map(signs.__getitem__, t.removesuffix(WORD_END))) + mark * t.endswith(WORD_END)
        one = [bytes([b]) for b in range(256)]
        ranks = {data: i for i, data in enumerate([*one, *(b + mark for b in one)])}
        for merge in model["merges"]:
            pair = merge.split(" ") if isinstance(merge, str) else merge
            ranks.setdefault(b"".join(map(ended, pair)), len(ranks))
        special = set(self.special)
        ids = {ended(t): i for t, i in model["vocab"].items() if t not in special}
        encoding = tiktoken.Encoding("words", pat_str=f"[^{MARK}]+{MARK}", mergeable_ranks=ranks, special_tokens={})
        known = np.array([ids.get(data, 0) for data in ranks], dtype=self.kind)
        return encoding, known

    @classmethod
    def of(cls, path: str) -> "Encoder":
        claim("records", cls._open.clear)
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def _pieces(self, low: str) -> bytes:
        """The tokens of a lower-case text of plain signs: cut into the tokenizer's pieces, each of which it merges on its own."""
        places = self.words.encode_ordinary(MARK.join([*CUTS.findall(low), ""]))
        return self.ids[np.array(places, dtype=np.int64)].tobytes()

    def _by_word(self, text: str) -> bytes:
        """The tokens of a text in which some words have other signs; those go through the file's tokenizer together."""
        words = [w for w in BLANKS.split(text) if w]
        plain = [PLAIN.fullmatch(w.lower()) for w in words]
        others = iter(self._together([w for w, p in zip(words, plain) if not p]))
        return b"".join(self._pieces(p[0]) if p else next(others) for p in plain)

    def _together(self, texts: list[str]) -> list[bytes]:
        """The tokens of each of ``texts``, encoded in one go with a sign that is a token of its own between them."""
        between = f" {MARK} "
        ids = np.array(self.tokenizer.encode(between.join(texts), add_special_tokens=False).ids, dtype=self.kind)
        data = ids.tobytes()
        cuts = (np.flatnonzero(ids == self.mark) * self.width).tolist()
        return [data[a:b] for a, b in zip([0, *(c + self.width for c in cuts)], [*cuts, len(data)])]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The tokens of each text, little endian."""
        found = []
        for data in texts:
            text = data.decode()
            low = text.lower()
            if MARK in text or any(s[:2].lower() in low for s in self.special):
                found.append(self._whole(text))
            else:
                found.append(self._pieces(low) if PLAIN.fullmatch(low) else self._by_word(text))
        return found


def _spans(batch: pa.RecordBatch) -> Iterator[tuple[list, list[bytes]]]:
    """The rows of a batch in spans of about ``SPAN_BYTES`` of text, so that only so much is in words at a time."""
    ids, texts, size = [], [], 0
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), pc.cast(batch.column("text"), pa.binary())):
        ids.append(doc_id)
        texts.append(text.as_py() or b"")
        size += len(texts[-1])
        if size >= SPAN_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _framer(path_of, end_id: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, held, size = None, [], 0
        for batch in batches:
            encoder = encoder or Encoder.of(path_of())
            end = int(end_id).to_bytes(encoder.width, "little")
            for ids, texts in _spans(batch):
                for doc_id, tokens in zip(ids, encoder.encode(texts)):
                    held.append(framed(payload_of(doc_id, tokens + end, encoder.width)))
                    size += len(held[-1])
                    if size >= most:
                        yield row(held)
                        held, size = [], 0
        if held:
            yield row(held)

    def row(frames: list[bytes]) -> pa.RecordBatch:
        """Frames as one row of text: the line end after the last is the writer's."""
        return pa.RecordBatch.from_arrays([pa.array([b"\n".join(frames)], pa.binary())], names=["frames"])

    return run


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def write_records(docs: DataFrame, path: str, path_of=tokenizer_path, end_id: int = END_ID) -> None:
    """Write ``docs(doc_id, text)`` as record files below ``path/records`` and their index to ``path/index``.

    Rows are dealt by identifier, then by the text's hash, then by row, so equal and null identifiers, and copies of one row,
    spread over shards. There are as many ranges as keep their text at ``SHARD_BYTES`` on average; a task writes its range in
    pieces of ``PIECE_BYTES`` or one longer record, and begins a new file after ``PIECES`` of them.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text"),
        F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"),
    )
    order = [F.asc_nulls_last("doc_id"), F.asc("hash"), F.asc("row")]
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = -(-size // SHARD_BYTES)
    # Spark merges small partitions only if it is left to choose their number.
    more = [shards] if shards > int(spark.conf.get("spark.sql.shuffle.partitions")) else []
    placed = rows.repartitionByRange(*more, *order).sortWithinPartitions(*order).select("doc_id", "text")
    frames = placed.mapInArrow(_framer(path_of, end_id, PIECE_BYTES), "frames binary").select(F.col("frames").cast("string").alias("value"))
    frames.write.option("lineSep", "\n").option("maxRecordsPerFile", PIECES).text(f"{path}/records")
    # Written before the totals are taken, so that the files are walked once.
    index = cut(scan(docs.sparkSession, path, payloads=False))
    shards = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy(F.col("shard") % FILES, "shard").rowsBetween(Window.unboundedPreceding, -1)
    first = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    index.join(fitted(first), "shard").select(
        "shard", "place", "offset", "bytes", "doc_id", "n_tokens", (F.col("first") + F.col("start")).alias("start")
    ).write.parquet(f"{path}/index")


def frames_in(content, payloads: bool = True) -> Iterator[tuple[int, int, memoryview]]:
    """Offset, bytes and payload of every record of a file; a frame that is broken or cut off is an error.

    Without ``payloads`` only lengths are checked, for walks that read no more than where records begin.
    """
    data, at = memoryview(content), 0
    while at < len(data):
        if at + HEAD.size > len(data):
            raise ValueError(f"record cut off at byte {at}")
        size, check = HEAD.unpack_from(data, at)
        if masked(bytes(data[at : at + 8])) != check:
            raise ValueError(f"wrong length at byte {at}")
        begin, end = at + HEAD.size, at + HEAD.size + size
        if end + TAIL.size + 1 > len(data):
            raise ValueError(f"record cut off at byte {at}")
        if payloads and masked(data[begin:end]) != TAIL.unpack_from(data, end)[0]:
            raise ValueError(f"wrong payload at byte {at}")
        after = end + TAIL.size + 1
        yield at, after - at, data[begin:end]
        at = after


def parsed(payload: memoryview) -> tuple[int | None, np.ndarray]:
    """Identifier and tokens of a payload."""
    flags, doc_id = FRONT.unpack_from(payload, 0)
    tokens = np.frombuffer(payload[FRONT.size :], dtype=f"<u{flags >> 4}")
    return (doc_id if flags & HAS_ID else None), tokens


_SCAN = "shard long, place long, offset long, bytes long, doc_id long, n_tokens long, start long"


def _scanner(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content")):
                rows, start = [], 0
                for place, (offset, size, payload) in enumerate(frames_in(content.as_buffer(), payloads)):
                    doc_id, tokens = parsed(payload)
                    row = (shard, place, offset, size, doc_id, len(tokens), start)
                    rows.append((*row, zlib.crc32(tokens.astype("<u4").tobytes())) if payloads else row)
                    start += len(tokens)
                names = [c.split()[0] for c in _SCAN.split(", ")] + ["ids_crc32"] * payloads
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64()) for _ in names]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _shard() -> Column:
    """The number of the task that wrote a file, plus ``FILES`` for each file of that task before it."""
    number = lambda pattern: F.regexp_extract(F.col("path"), pattern, 1).cast("long")
    # The count of files stands last: the write's random name before it may hold a "-c" and digits, too.
    return (number(r"/part-(\d+)-[^/]*$") + FILES * number(r"-c(\d+)[^/-]*$")).alias("shard")


def scan(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The record files below ``path`` read back and checked, one row a record; with ``payloads`` the tokens' CRC-32.

    A file is one row of its reader, which Spark takes up to 2 GB; files hold at most ``PIECES`` pieces. ``start`` counts from
    the start of the file.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/records")
    return files.select(_shard(), "content").mapInArrow(
        _scanner(payloads), _SCAN + (", ids_crc32 long" if payloads else ""))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_SCAN).parquet(f"{path}/index")


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(table(spark, sf_dir, "documents"))


def written(docs: DataFrame) -> DataFrame:
    """``docs`` written as records and read back: doc_id, start (tokens of all before), n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = scratch_path(spark, "records")
    write_records(docs, path)
    firsts = read_index(spark, path).where("place = 0").select("shard", F.col("start").alias("first"))
    return scan(spark, path).join(fitted(firsts), "shard").select(
        "doc_id", (F.col("first") + F.col("start")).alias("start"), "n_tokens", "ids_crc32"
    )


QUERIES = {"op8_token_records": op8_token_records}
ORACLE: dict[str, str] = {}
