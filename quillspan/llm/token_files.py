"""Token ids in binary shards with a shared zstandard dictionary.

Each document's ids (with the end id) are laid out as little-endian 16- or 32-bit integers and compressed on their own
against one dictionary trained on a bounded sample of such arrays, so a short document can be read alone.  A shard is

    magic "QSTK", version u8, bytes per id u8, hash of the dictionary (sha256, 32 bytes), documents u32,
    (documents + 1) offsets u64 into the frames, documents id counts u32, the frames

all little-endian.  Shards are written as rows (part, seq, n_docs, n_tokens, doc_ids, dictionary_hash, shard) of a Parquet table
through Spark's committer, so a lost executor's tasks are redone and any store that Spark writes to will do; the
dictionary is a one-row table beside it.  Shards are in ascending doc_id order (null first): part, then seq.

Defined results: a null text counts as empty and holds the end id alone; repeated ids stay next to each other, each
with its own entry; an empty table gives empty tables; other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe_automaton import byte_letters
from .common import durable, fresh_path, sampled, small

MAGIC = b"QSTK"
_HEAD = struct.Struct("<4sBB32sI")


class _Words(dict):
    """Ids of words as bytes, by the library's model; made when a word is first asked for, and kept up to a number."""

    def __init__(self, model, dtype: str, room: int):
        super().__init__()
        self.model, self.dtype, self.room = model, dtype, room
        self.code = "H" if dtype == "<u2" else "I"
        self.letters = {b: c for c, b in byte_letters().items()}

    def __missing__(self, word: str) -> bytes:
        # printable ASCII stands for itself in byte-level vocabularies
        spelled = word if word.isascii() and word.isalpha() else "".join([self.letters[b] for b in word.encode()])
        ids = [t.id for t in self.model.tokenize(spelled)]
        out = array(self.code, ids).tobytes() if sys.byteorder == "little" else np.array(ids, self.dtype).tobytes()
        if len(word) < 60:
            if len(self) >= self.room:
                self.clear()
            self[word] = out
        return out


class ChunkEncoder(dict):
    """Ids of a text as bytes, with the public tokenizers library; a dict of the stretches without white space met so far.

    Right for vocabularies whose tokens never cross white space and drop it (see ``crosses_no_blank``).  Of a text in
    Latin-1, for the one pattern of words that is known here, the words go to the library's model; any other text goes
    to the whole library, stretch by stretch.
    """

    def __init__(self, vocabulary: str, dtype: str, room: int = 60_000_000, words: int = 500_000):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words = _Words(self.tokenizer.model, dtype, words)
        self.simple = plain_pattern(vocabulary) == _KNOWN
        self.special = [t["content"] for t in json.loads(vocabulary)["added_tokens"]]
        self.dtype, self.room, self.used = dtype, room, 0

    def __missing__(self, chunk: str) -> bytes:
        ids = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, self.dtype).tobytes()
        if (size := 180 + len(chunk) + len(ids)) < 2000:
            self.used += size
            if self.used > self.room:
                self.clear()
                self.used = size
            self[chunk] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.simple and _latin(text) and not any(x in text for x in self.special):
            return b"".join(map(self.words.__getitem__, _PIECES(text.lower())))
        chunks = text.split() if not _CONTROL.search(text) else [c for c in _BLANK.split(text) if c]
        return b"".join(map(self.__getitem__, chunks))


def _latin(text: str) -> bool:
    """Whether all characters are in Latin-1: normalising leaves them, and str.lower() works on each alone."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


#: Fixed: the pattern of words that is known, and what it finds in lower-case Latin-1 text.
_KNOWN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PIECES = re.compile("[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|'(?:s|t|re|ve|m|ll|d)|[^\t-\r \x85\xa00-9a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff\xb2\xb3\xb9\xbc-\xbe]+").findall


def plain_pattern(vocabulary: str) -> str | None:
    """The pattern that splits words, where normalising is NFC, blanks and lower case, and a byte-level model follows."""
    j = json.loads(vocabulary)
    norm, pre = j.get("normalizer") or {}, j.get("pre_tokenizer") or {}
    steps, parts = [n["type"] for n in norm.get("normalizers", [])], pre.get("pretokenizers", [])
    known = steps == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in parts] == ["Split", "ByteLevel"] and j["model"]["type"] == "BPE"
    if not known or parts[1].get("add_prefix_space") or parts[1].get("use_regex") or j["model"].get("dropout"):
        return None
    return parts[0]["pattern"].get("Regex")


#: str.split() also splits at these, the library does not.
_CONTROL = re.compile("[\x1c-\x1f]")
_BLANK = re.compile("[\t-\r \x85\xa0  -     　]+")
_ENCODERS: dict[str, ChunkEncoder] = {}


def crosses_no_blank(vocabulary: str) -> bool:
    """Whether the tokenizer drops white space and so encodes the stretches between it one by one."""
    j = json.loads(vocabulary)
    text = json.dumps(j.get("pre_tokenizer"))
    dropped = '"Removed"' in text and '"invert": true' in text and " ?" not in text
    free = not any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in j["added_tokens"])
    return dropped and free


def chunk_encoder(vocabulary: str, dtype: str) -> ChunkEncoder:
    key = hashlib.md5((vocabulary + dtype).encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(vocabulary, dtype)
        gc.collect()
        gc.freeze()
    return _ENCODERS[key]


def pack(frames: list[bytes], counts: list[int], width: int, digest: bytes) -> bytes:
    """One shard."""
    offsets = np.zeros(len(frames) + 1, "<u8")
    np.cumsum([len(x) for x in frames], out=offsets[1:])
    return _HEAD.pack(MAGIC, 1, width, digest, len(frames)) + offsets.tobytes() + np.array(counts, "<u4").tobytes() + b"".join(frames)


class Shard:
    """Reads a shard; ``ids(k)`` touches the frame of document k alone."""

    def __init__(self, data: bytes, dictionary: bytes):
        magic, version, self.width, digest, self.n = _HEAD.unpack_from(data)
        if magic != MAGIC or version != 1:
            raise ValueError("not a shard of token ids")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the shard was written with another dictionary")
        at = _HEAD.size
        self.offsets = np.frombuffer(data, "<u8", self.n + 1, at)
        self.counts = np.frombuffer(data, "<u4", self.n, at + 8 * (self.n + 1))
        self.start, self.data = at + 12 * self.n + 8, data
        self.decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()

    def ids(self, k: int) -> np.ndarray:
        a, b = int(self.offsets[k]), int(self.offsets[k + 1])
        raw = self.decompressor.decompress(self.data[self.start + a : self.start + b], max_output_size=int(self.counts[k]) * self.width)
        ids = np.frombuffer(raw, f"<u{self.width}").astype("<u4")
        if len(ids) != self.counts[k]:
            raise ValueError("a frame holds another number of ids than its index says")
        return ids


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary, or none (empty) where the samples are too few to train one."""
    if len(samples) < 16 or sum(map(len, samples)) < 20 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 8), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write(
    docs: DataFrame, vocabulary: str, path: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text",
    shard_bytes: int = 4 << 20, sample_rows: int = 1000, dictionary_bytes: int = 64 << 10, partitions: int | None = None,
) -> None:
    """Write the shards of ``docs`` and their dictionary below ``path``.

    The dictionary is trained on the whole id arrays of the ``sample_rows`` distinct texts with the smallest hashes (a bound
    of the model).  Every document is encoded and written; texts are not shuffled, their compressed ids are once.
    """
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        body = f.read()
    if not crosses_no_blank(body):
        raise ValueError("this writer needs a tokenizer that drops white space")
    j = json.loads(body)
    largest = max(end_id, *j["model"]["vocab"].values(), *(t["id"] for t in j["added_tokens"]))
    width = 2 if largest < 1 << 16 else 4
    dtype = f"<u{width}"
    shared = spark.sparkContext.broadcast(body)
    end = np.array([end_id], dtype).tobytes()
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))

    picked = sampled(rows, sample_rows, salt="dictionary").select("text")

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = chunk_encoder(shared.value, dtype)
        for batch in small(batches):
            yield pa.RecordBatch.from_arrays([pa.array([e.encode(t.as_py()) + end for t in batch.column(0)], pa.binary())], ["ids"])

    dictionary = train_dictionary([bytes(r[0]) for r in picked.mapInArrow(sample, "ids binary").collect()], dictionary_bytes)
    digest = hashlib.sha256(dictionary).digest()
    trained = spark.sparkContext.broadcast(dictionary)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = chunk_encoder(shared.value, dtype)
        options = {"dict_data": zstandard.ZstdCompressionDict(trained.value)} if trained.value else {}
        c = zstandard.ZstdCompressor(level=3, write_content_size=True, write_dict_id=False, **options)
        for batch in small(batches):
            n, frames = [], []
            for t in batch.column(1):
                ids = e.encode(t.as_py()) + end
                n.append(len(ids) // width)
                frames.append(c.compress(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(frames, pa.binary())], ["id", "n", "frame"])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        counts: list[int] = []
        frames: list[bytes] = []
        held = 0

        def out() -> pa.RecordBatch:
            known = [i for i in ids if i is not None]
            ends = [min(known, default=None)], [max(known, default=None)]
            columns = [[part], [seq], [start], [len(ids)], [sum(counts)], *ends, [ids], [digest.hex()], [pack(frames, counts, width, digest)]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for i, n, frame in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids.append(i.as_py())
                counts.append(n)
                frames.append(frame.as_py())
                held += len(frames[-1])
                if held >= shard_bytes or len(ids) >= 65_536:
                    yield out()
                    start += sum(counts)
                    seq, held = seq + 1, 0
                    ids, counts, frames = [], [], []
        if ids:
            yield out()

    kind = docs.schema[doc_id].dataType
    schema = f"part int, seq int, start bigint, n_docs bigint, n_tokens bigint, first_id {kind.simpleString()}, last_id {kind.simpleString()}, doc_ids array<{kind.simpleString()}>, dictionary_hash string, shard binary"
    from pyspark.sql.pandas.types import to_arrow_type

    fields = [("part", pa.int32()), ("seq", pa.int32()), ("start", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]
    fields += [("first_id", to_arrow_type(kind)), ("last_id", to_arrow_type(kind))]
    arrow = pa.schema([*fields, ("doc_ids", pa.list_(to_arrow_type(kind))), ("dictionary_hash", pa.string()), ("shard", pa.binary())])
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written once: the range partitioner reads its input twice, to find the ranges and to deal it out
    frames = durable(rows.mapInArrow(compress, f"id {kind.simpleString()}, n bigint, frame binary"), "frames")
    # behind the id, so that rows of one id, or of none, are many ranges and have one order
    order = ["id", "n", F.xxhash64("frame")]
    ranged = frames.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged.mapInArrow(shards, schema).write.parquet(f"{path}/shards")
    spark.createDataFrame([(digest.hex(), bytearray(dictionary))], "dictionary_hash string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")


def read(spark: SparkSession, path: str, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, start, ids (array<int>) of every document, from the files below ``path``."""
    return _read(spark, path, doc_id, "ids array<bigint>", lambda ids: pa.array([x.astype("i8") for x in ids], pa.list_(pa.int64())))


def digests(spark: SparkSession, path: str, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files below ``path``."""
    return _read(spark, path, doc_id, "ids_crc32 bigint", lambda ids: pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()))


def lookup(spark: SparkSession, path: str, wanted: list, doc_id: str = "doc_id") -> DataFrame:
    """doc_id and ids (array<int>) of the documents whose id is ``wanted`` (nulls are none).

    Shards are chosen by their first and last ids, which the scan filters on, then by their lists of ids; only then are
    frames read, those of the chosen shards.
    """
    wanted = [i for i in dict.fromkeys(wanted) if i is not None]
    dictionary = spark.sparkContext.broadcast(bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"]))
    every = spark.read.parquet(f"{path}/shards")
    kind = every.schema["doc_ids"].dataType.elementType.simpleString()
    between = [(F.col("first_id") <= F.lit(i)) & (F.col("last_id") >= F.lit(i)) for i in wanted[:100]]
    ends = reduce(or_, between) if 0 < len(wanted) <= 100 else (F.col("first_id") <= F.lit(max(wanted, default=None))) & (F.col("last_id") >= F.lit(min(wanted, default=None)))
    near = every.filter(ends)  # of the frames' column nothing is read yet
    places = [tuple(r) for r in near.filter(F.exists("doc_ids", lambda x: x.isin(wanted))).select("part", "seq").collect()] if wanted else []
    chosen = near.filter(F.struct("part", "seq").isin([F.struct(F.lit(p), F.lit(q)) for p, q in places])) if places else near.limit(0)
    mine = F.filter(F.transform("doc_ids", lambda x, i: F.struct(x.alias("id"), i.alias("at"))), lambda x: x["id"].isin(wanted))
    rows = chosen.select(mine.alias("mine"), "shard").select(F.col("mine.id").alias("ids"), F.col("mine.at").alias("at"), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, at, data in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2), strict=True):
                s = Shard(data.as_py(), dictionary.value)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array([s.ids(k).astype("i4") for k in at], pa.list_(pa.int32()))], [doc_id, "ids"])

    return rows.mapInArrow(run, f"`{doc_id}` {kind}, ids array<int>")


def _read(spark: SparkSession, path: str, doc_id: str, column: str, of) -> DataFrame:
    dictionary = spark.sparkContext.broadcast(bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"]))
    shards = spark.read.parquet(f"{path}/shards")
    # one row for each part of the writer, so the running sum is over as many rows as there were write tasks
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rows = shards.join(firsts, "part").select((F.col("first") + F.col("start")).alias("start"), "doc_ids", "shard")
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, doc_ids, data in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                s = Shard(data.as_py(), dictionary.value)
                counts = s.counts.astype("i8")
                starts = start.as_py() + np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("i8")
                for k in range(0, s.n, 4096):
                    part = range(k, min(s.n, k + 4096))
                    yield pa.RecordBatch.from_arrays(
                        [doc_ids.values[k : part.stop], pa.array(starts[k : part.stop]), pa.array(counts[k : part.stop]), of([s.ids(x) for x in part])],
                        [doc_id, "start", "n_tokens", column.split(" ")[0]],
                    )

    return rows.mapInArrow(run, f"`{doc_id}` {kind}, start bigint, n_tokens bigint, {column}")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ``docs`` to a new place in the shared folder and read the digests back."""
    path = fresh_path(docs.sparkSession, "tokens")
    write(docs, vocabulary, path, end_id, doc_id, text)
    return digests(docs.sparkSession, path, doc_id)
