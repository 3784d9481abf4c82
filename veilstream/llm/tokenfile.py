"""Token files with fixed-width bit packing.

Each id takes the fewest bits that hold the vocabulary. A file is

    "VSBP" | blocks of packed ids | footer | trailer

A block holds BLOCK_IDS ids, little-endian in bits and bytes. The footer lists the byte offset of every
block, and id and end of every document, as int64; the trailer has the counts and widths. Any run of
ids is read from its blocks alone and unpacked by numpy.

Files are named by partition and attempt. A manifest, itself written by Spark, names those that count;
a task that runs twice leaves a file that no manifest names.

Defined results: null and empty texts hold the end id alone; documents with the same id follow each
other by the hash of their text; a null id comes first; an empty table gives an empty manifest.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstream.llm.tokens import encoder, word_table_path
from veilstream.session import materialise, scratch_path, ship_package

MAGIC = b"VSBP"
BLOCK_IDS = 1 << 15
END_ID = 2
#: Ids that a reader takes at once.
READ_IDS = 1 << 20
TRAILER = struct.Struct("<qqqqii4s")
MANIFEST = "shard int, path string, n_docs long, n_ids long, n_bytes long"


def id_bits(vocab_size: int) -> int:
    """The fewest bits that hold every id below vocab_size."""
    return max(1, (vocab_size - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids one after another, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(packed: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(packed, dtype=f"<u{bits // 8}", count=n).astype(np.uint32)
    planes = np.unpackbits(np.frombuffer(packed, dtype=np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (planes.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class TokenFileWriter:
    """Appends documents; only the open block and the document index are held."""

    def __init__(self, out, bits: int):
        self.out, self.bits, self.held, self.n_held = out, bits, [], 0
        self.n_ids, self.at = 0, len(MAGIC)
        self.blocks, self.docs, self.nulls, self.ends = [], [], [], []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.ends.append(self.n_ids)
        if self.n_held >= BLOCK_IDS:
            ids = np.concatenate(self.held)
            whole = len(ids) // BLOCK_IDS * BLOCK_IDS
            for k in range(0, whole, BLOCK_IDS):
                self._block(ids[k : k + BLOCK_IDS])
            self.held, self.n_held = [ids[whole:]], len(ids) - whole

    def _block(self, ids: np.ndarray) -> None:
        packed = pack_bits(ids, self.bits)
        self.blocks.append(self.at)
        self.out.write(packed)
        self.at += len(packed)

    def close(self) -> int:
        if self.n_held:
            self._block(np.concatenate(self.held))
        footer = self.at
        body = b"".join(np.asarray(x, dtype="<i8").tobytes() for x in ([*self.blocks, footer], self.docs, self.nulls, self.ends))
        tail = TRAILER.pack(len(self.docs), self.n_ids, len(self.blocks), footer, self.bits, BLOCK_IDS, MAGIC)
        self.out.write(body + tail)
        self.out.close()
        return footer + len(body) + len(tail)


class TokenFileReader:
    """Random access to a token file through read_at(n, offset)."""

    def __init__(self, source):
        self.source, size = source, source.size()
        n_docs, self.n_ids, n_blocks, footer, self.bits, self.block_ids, magic = TRAILER.unpack(source.read_at(TRAILER.size, size - TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        index = np.frombuffer(source.read_at(size - TRAILER.size - footer, footer), dtype="<i8")
        self.blocks, self.docs, self.nulls, self.ends = np.split(index, np.cumsum([n_blocks + 1, n_docs, n_docs]))

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop, from the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, dtype=np.uint32)
        a, b = start // self.block_ids, -(-stop // self.block_ids)
        raw = self.source.read_at(int(self.blocks[b] - self.blocks[a]), int(self.blocks[a]))
        n = min(b * self.block_ids, self.n_ids) - a * self.block_ids
        if self.block_ids * self.bits % 8:
            raise ValueError("blocks must end on a byte")
        return unpack_bits(raw, n, self.bits)[start - a * self.block_ids : stop - a * self.block_ids]

    def documents(self):
        """(doc_id, start, ids) of every document, read in runs."""
        k = 0
        while k < len(self.docs):
            start = int(self.ends[k - 1]) if k else 0
            stop = max(k + 1, int(np.searchsorted(self.ends, start + READ_IDS, side="right")))
            ids, base = self.ids(start, int(self.ends[stop - 1])), start
            for i in range(k, stop):
                end = int(self.ends[i])
                yield None if self.nulls[i] else int(self.docs[i]), start, ids[start - base : end - base]
                start = end
            k = stop


def write_token_files(
    docs: DataFrame,
    folder: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_path: str | None = None,
    end_id: int = END_ID,
) -> DataFrame:
    """Encode every text, in ascending order of ids, into one file for each range of ids; returns the manifest.

    The manifest has shard, path, n_docs, n_ids, n_bytes; shards ascend with the ids.
    """
    spark = docs.sparkSession
    ship_package(spark)
    path, folder = tokenizer_path or word_table_path(), folder or scratch_path(spark, "tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ordered = ordered.select("doc_id", F.col("text").cast("binary").alias("text"))

    def write(batches):
        from pyspark import TaskContext

        enc, shard, writer = encoder(path), TaskContext.get().partitionId(), None
        end = np.asarray([end_id], dtype=np.uint32)
        for batch in batches:
            if writer is None:
                store, inner = _filesystem(folder)
                store.create_dir(inner, recursive=True)
                name = f"shard-{shard:08d}-{uuid.uuid4().hex}.bin"
                writer = TokenFileWriter(store.open_output_stream(f"{inner}/{name}"), id_bits(enc.vocab_size))
            for key, ids in zip(batch.column(0).to_pylist(), enc.encode_many(batch.column(1).to_pylist())):
                writer.add(key, np.concatenate((np.frombuffer(ids, dtype="<u4"), end)))
        if writer is not None:
            size = writer.close()
            yield pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int32()), "path": [f"{folder}/{name}"], "n_docs": [len(writer.docs)], "n_ids": [writer.n_ids], "n_bytes": [size]}
            )

    return materialise(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), ids (uint32 LE).

    The manifest has one small row for each file; its counts are summed on the driver.
    """
    ship_package(spark)
    files, start = [], 0
    for shard, path, n in manifest.select("shard", "path", "n_ids").orderBy("shard").collect():
        files.append((path, start))
        start += n
    listed = spark.createDataFrame(files, "path string, start long")

    def read(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, inner = _filesystem(path)
                with store.open_input_file(inner) as source:
                    out, held = [], 0
                    for key, at, ids in TokenFileReader(source).documents():
                        out.append((key, first + at, ids.astype("<u4").tobytes()))
                        held += len(ids)
                        if held >= READ_IDS:
                            yield _batch(out, schema)
                            out, held = [], 0
                    if out:
                        yield _batch(out, schema)

    if files:
        listed = listed.repartitionByRange(len(files), "start")
    return listed.mapInArrow(read, "doc_id long, start long, ids binary")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def token_digest(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "start", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
