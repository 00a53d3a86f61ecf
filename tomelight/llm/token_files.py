"""Binary token files: one id array a file, with Elias-Fano coded document boundaries (operator 7).

File format (all integers little-endian):

    magic "TLEF1\\0\\0\\0" | header of 6 unsigned 64-bit numbers: documents, ids, bytes an id, null doc_ids,
    length of the boundary part, length of the doc_id part | boundary part | doc_id part | ids

Both parts are Elias-Fano sequences. A non-decreasing sequence of n numbers below u keeps the low
``l = floor(log2(u / n))`` bits of each number packed, and the rest as a unary bit vector of ``n + (u >> l)`` bits,
so a boundary takes about ``2 + l`` bits instead of 64. A directory holds the number of set bits before each block
of 512 bits (32 bits an entry, about 6 % on top); ``select`` finds a number's block there and then counts inside
the block. Files are cut at a byte limit, so the 32-bit counts never overflow.

Defined results: a null or empty text is one document with the end id alone; null doc_ids come first; repeated rows
stay separate documents, and rows with equal doc_id are in the order of their texts' hashes; an empty table gives no files and no rows; columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import materialize, partitions, scratch, small_batches, text_or_empty
from ._files import read_whole, write_whole
from ._tokens import default_vocabulary, encoder

MAGIC = b"TLEF1\0\0\0"
BLOCK = 512


class EliasFano:
    """A non-decreasing sequence of non-negative integers below 2**63."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, before: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.before = n, low_bits, low, high, before

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        if n == 0:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(1, "<u4"))
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1)
        bits = (values[:, None] >> np.arange(low_bits)) & 1
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        places = (values >> low_bits) + np.arange(n)
        size = -(-(int(places[-1]) + 1) // BLOCK) * BLOCK
        unary = np.zeros(size, np.uint8)
        unary[places] = 1
        before = np.concatenate([[0], np.cumsum(unary.reshape(-1, BLOCK).sum(1, dtype=np.int64))]).astype("<u4")
        return cls(n, low_bits, low, np.packbits(unary, bitorder="little"), before)

    def select(self, index: np.ndarray) -> np.ndarray:
        """The numbers at these indexes, by the directory; only the blocks that hold them are read."""
        index = np.asarray(index, np.int64)
        if len(index) == 0:
            return np.zeros(0, np.int64)
        block = np.searchsorted(self.before, index, side="right") - 1
        blocks, back = np.unique(block, return_inverse=True)
        bits = np.unpackbits(self.high.reshape(-1, BLOCK // 8)[blocks], axis=1, bitorder="little")
        row, column = np.nonzero(bits)
        first = np.concatenate([[0], np.cumsum(bits.sum(1, dtype=np.int64))])
        place = block * BLOCK + column[first[back] + index - self.before[block]]
        values = (place - index) << self.low_bits
        if self.low_bits:
            at = index[:, None] * self.low_bits + np.arange(self.low_bits)
            values |= (((self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.int64) << np.arange(self.low_bits)).sum(1)
        return values

    def pack(self) -> bytes:
        head = struct.pack("<4Q", self.n, self.low_bits, len(self.low), len(self.high))
        return head + self.before.tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> EliasFano:
        n, low_bits, low, high = struct.unpack_from("<4Q", data)
        count, at = high * 8 // BLOCK + 1, 32
        before = np.frombuffer(data, "<u4", count, at)
        at += 4 * count
        return cls(n, low_bits, np.frombuffer(data, np.uint8, low, at), np.frombuffer(data, np.uint8, high, at + low), before)


def pack_file(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    """One file's bytes; doc_ids ascend, nulls first; ids: each document's ids, ``width`` bytes an id."""
    nulls = sum(x is None for x in doc_ids)
    given = np.array(doc_ids[nulls:], np.int64)
    base = int(given[0]) if len(given) else 0
    bounds = EliasFano.of(np.concatenate([[0], np.cumsum([len(x) // width for x in ids])])).pack()
    # a span of 2**63 or more does not fit the sequence: then the ids follow as they are
    wide = len(given) and int(given[-1]) - base >= 1 << 62
    names = b"\1" + given.astype("<i8").tobytes() if wide else b"\0" + struct.pack("<q", base) + EliasFano.of(given - base).pack()
    body = b"".join(ids)
    head = struct.pack("<6Q", len(ids), len(body) // width, width, nulls, len(bounds), len(names))
    return MAGIC + head + bounds + names + body


class TokenFile:
    """Reads what ``pack_file`` made; any document is found through ``select``."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        self.documents, self.ids, width, self.nulls, bounds, names = struct.unpack_from("<6Q", data, 8)
        at = 56
        self.bounds = EliasFano.unpack(data[at : at + bounds])
        self._names = data[at + bounds : at + bounds + names]
        self.tokens = np.frombuffer(data, "<u2" if width == 2 else "<u4", self.ids, at + bounds + names)

    def doc_ids(self) -> list[int | None]:
        n = self.documents - self.nulls
        if self._names[0] == 1:
            given = np.frombuffer(self._names, "<i8", n, 1)
        else:
            given = EliasFano.unpack(self._names[9:]).select(np.arange(n)) + struct.unpack_from("<q", self._names, 1)[0]
        return [None] * self.nulls + given.tolist()

    def document(self, index: int) -> np.ndarray:
        start, end = self.bounds.select(np.array([index, index + 1]))
        return self.tokens[start:end]


def write_token_files(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = 0, file_bytes: int = 8 << 20) -> DataFrame:
    """Encode ``docs`` (doc_id, text) in ascending doc_id order into files in ``folder``; one row a file comes back.

    A range exchange orders the texts; each task then streams its range and holds one file (``file_bytes`` of ids)
    at most. Rows: file, partition, number, documents, ids. They are written before they are used, so that a
    recomputed range never disagrees with files that exist.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = vocabulary or default_vocabulary()

    def write(batches):
        encode, part = encoder(path), TaskContext.get().partitionId()
        names, bodies, size, number = [], [], 0, 0

        def flush():
            nonlocal names, bodies, size, number
            file = f"{folder}/ids-{part:07d}-{number:05d}.tlef"
            data = pack_file(names, bodies, encode.dtype.itemsize)
            write_whole(file, data)
            row = {"file": [file], "part": [part], "number": [number], "documents": [len(names)], "ids": [size // encode.dtype.itemsize]}
            names, bodies, size, number = [], [], 0, number + 1
            return pa.RecordBatch.from_pydict(row, pa.schema([("file", pa.string()), ("part", pa.int64()), ("number", pa.int64()), ("documents", pa.int64()), ("ids", pa.int64())]))

        for batch in batches:
            ids, bounds = encode.batch(batch[1], end_id)
            for doc_id, a, b in zip(batch[0].to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                names.append(doc_id)
                bodies.append(ids[a:b].tobytes())
                size += len(bodies[-1])
                if size >= file_bytes:
                    yield flush()
        if names:
            yield flush()

    # a group of rows with one doc_id, or none, is spread by its texts' hash, and by a number of the row within equal texts
    order = ["doc_id", "hash", "copy"]
    text = text_or_empty()
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("copy"))
    ordered = ordered.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")
    return materialize(ordered.mapInArrow(write, "file string, part long, number long, documents long, ids long"))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row a document, from the files: doc_id, start, n_tokens, ids_crc32."""
    # one row a file: a running sum over parts, and over the few files of a part
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("total"))
    parts = parts.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("earlier"))
    inside = F.sum("ids").over(Window.partitionBy("part").orderBy("number")) - F.col("ids")
    files = manifest.select("part", "file", inside.alias("inside")).join(parts, "part").select("file", (F.col("earlier") + F.col("inside")).alias("base"))

    def read(batches):
        for batch in batches:
            for file, base in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                found = TokenFile(read_whole(file))
                bounds = found.bounds.select(np.arange(found.documents + 1))
                raw = memoryview(found.tokens.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                columns = [pa.array(found.doc_ids(), pa.int64()), pa.array(bounds[:-1] + base), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = files.repartition(partitions(manifest.sparkSession), "file")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    """All documents, encoded, written and read back: doc_id, start, n_tokens, ids_crc32."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_files(write_token_files(docs, scratch(spark)))
