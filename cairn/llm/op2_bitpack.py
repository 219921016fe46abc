"""Token ids packed into the minimum bits of their vocabulary.

A block is a few documents' ids: `MAGIC`, the width in bits, the numbers of documents and ids, where each document's ids
begin, then the ids, eight to a group of `width` bytes. As each group starts on a byte, ids a to b are read by unpacking the
groups a // 8 to b // 8 only. Blocks are rows of a Parquet table in ascending doc_id order (Spark's committer and readers
make it safe to lose an executor and to use any store); beside the block each row has its documents' ids, and how many
ids its partition holds before it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import batches, documents, scratch, slices, texts
from cairn.llm.tokens import encoder

MAGIC, HEAD = b"FWP1", struct.Struct("<4sBxxxII")
FILE = "part int, part_start long, doc_ids array<long>, n_ids long, block binary"
#: Ids after which a block is closed; a longer document has a block of its own.
BLOCK_IDS = 65_536


def width_of(vocabulary: int) -> int:
    """Bits that tell ids 0 to vocabulary - 1 apart."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids in groups of eight, `width` bytes each, least significant bit first."""
    ids = np.asarray(ids, np.uint64)
    if ids.size and int(ids.max()) >> width:
        raise ValueError(f"an id needs more than {width} bits")
    if width in (8, 16, 32):
        return np.pad(ids, (0, -ids.size % 8)).astype(f"<u{width // 8}").tobytes()
    lanes = np.pad(ids, (0, -ids.size % 8)).reshape(-1, 8)
    out = np.zeros((len(lanes), width + 8), np.uint8)
    for lane in range(8):
        first, shift = divmod(lane * width, 8)
        shifted = lanes[:, lane] << np.uint64(shift)
        for byte in range((shift + width + 7) // 8):
            out[:, first + byte] |= (shifted >> np.uint64(8 * byte)).astype(np.uint8)
    return out[:, :width].tobytes()


def unpack(data: bytes, width: int, start: int, stop: int) -> np.ndarray:
    """Ids start to stop - 1, reading only the groups that hold them."""
    first, last = start // 8, -(-stop // 8)
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", stop - start, start * (width // 8)).astype("<u4")
    raw = np.frombuffer(data, np.uint8, (last - first) * width, first * width).reshape(-1, width)
    raw = np.pad(raw, ((0, 0), (0, 8)))
    lanes = np.zeros((len(raw), 8), np.uint64)
    for lane in range(8):
        byte, shift = divmod(lane * width, 8)
        for k in range((shift + width + 7) // 8):
            lanes[:, lane] |= raw[:, byte + k].astype(np.uint64) << np.uint64(8 * k)
        lanes[:, lane] >>= np.uint64(shift)
    lanes &= np.uint64((1 << width) - 1)
    return lanes.reshape(-1)[start - 8 * first : stop - 8 * first].astype("<u4")


def write_block(ids: list[bytes], width: int) -> bytes:
    """A block of documents, each given as little-endian unsigned 32-bit ids."""
    ends = np.cumsum([0] + [len(x) // 4 for x in ids])
    return HEAD.pack(MAGIC, width, len(ids), int(ends[-1])) + ends.astype("<u4").tobytes() + pack(np.frombuffer(b"".join(ids), "<u4"), width)


def read_block(block: bytes, document: int | None = None) -> list[np.ndarray]:
    """The ids of each document of a block, or of one of them alone."""
    magic, width, n_docs, n_ids = HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block of packed ids")
    ends = np.frombuffer(block, "<u4", n_docs + 1, HEAD.size)
    data = memoryview(block)[HEAD.size + 4 * (n_docs + 1) :]
    if document is not None:
        return [unpack(data, width, int(ends[document]), int(ends[document + 1]))]
    return np.split(unpack(data, width, 0, n_ids), ends[1:-1]) if n_docs else []


def write_packed(docs: DataFrame, path: str, tokenizer: str, end_id: int, vocabulary: int | None = None) -> None:
    """Encodes `docs` (doc_id, text; null text: empty; equal doc_ids: by text; null doc_id: first) and writes them at `path`.

    Texts are encoded whole; a document longer than BLOCK_IDS is a block of its own. Repeated rows have ids each; other columns
    are ignored; an empty table gives a folder without rows."""
    width = width_of(max(vocabulary or encoder(tokenizer).tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1))
    end = struct.pack("<I", end_id)

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before, ids, keys, size = TaskContext.get().partitionId(), 0, [], [], 0

        def row() -> pa.RecordBatch:
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([size], pa.int64()), pa.array([write_block(ids, width)], pa.binary())], names=["part", "part_start", "doc_ids", "n_ids", "block"])

        for whole in it:
            for batch in slices(whole, 16 << 20):
                for key, got in zip(batch.column(0).to_pylist(), encoder(tokenizer).encode(batch.column(1)), strict=True):
                    ids.append(got + end)
                    keys.append(key)
                    size += len(got) // 4 + 1
                    if size >= BLOCK_IDS:
                        yield row()
                        before, ids, keys, size = before + size, [], [], 0
        if ids:
            yield row()

    ordered = texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    batches(ordered, encode, FILE, 4000).write.option("compression", "none").parquet(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids before it in the whole table), ids (little-endian unsigned 32-bit) of what write_packed wrote, a row
    for each document; none for an empty table.

    The driver gets one number for each partition that was written, and nothing else."""
    files = spark.read.schema(FILE).parquet(path)
    total, starts = 0, {}
    for part, n in sorted(files.groupBy("part").agg(F.sum("n_ids")).collect()):
        starts[part], total = total, total + n

    def decode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for row in batch.to_pylist():
                ids, at = read_block(row["block"]), starts[row["part"]] + row["part_start"]
                ends = at + np.cumsum([0] + [len(x) for x in ids])
                yield pa.record_batch([pa.array(row["doc_ids"], pa.int64()), pa.array(ends[:-1], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], names=["doc_id", "start", "ids"])

    return batches(files, decode, "doc_id long, start long, ids binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: all documents written packed and read back; per document where its ids start, how many, and their crc32."""
    import public_tokenizers

    path, tokenizer = scratch(spark, "packed"), public_tokenizers.path("byte_bpe_50k.json")
    write_packed(documents(spark, sf_dir), path, tokenizer, end_id=2)

    ids = F.col("ids")
    return read_packed(spark, path).select("doc_id", "start", (F.length(ids) / 4).cast("long").alias("n_tokens"), F.crc32(ids).alias("ids_crc32"))


QUERIES = {"op2_bitpack": query}
