"""Packing by power-of-two decomposition.

A document of n ids is cut into floor(n / 4096) pieces of 4096 ids and one piece for every binary
digit of the rest, longest first. Each piece is a sequence of its own whose length is a power of
two: no sequence crosses documents and none needs padding. Sequences of one length share a bucket,
so batches are drawn from equal lengths.

One pass over the input, without a shuffle; a worker holds one Arrow batch.

Defined results: null and empty texts give the end id alone (one piece of length 1); repeated rows are
packed once each; an empty table gives no rows; texts are encoded whole, one at a time; columns other than those named are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstream.llm.tokens import encoder, word_table_path
from veilstream.session import ship_package

SEQUENCE_TOKENS = 4096
END_ID = 2
#: Ids in one Arrow batch that goes back to Spark, about.
FLUSH_IDS = 1 << 20
#: A sequence id is bucket * 2^57 + Spark's increasing id, which has the partition above bit 33.
BUCKET_SHIFT = 57


def piece_lengths(n: int, longest: int = SEQUENCE_TOKENS) -> list[int]:
    """Powers of two, longest first, with the sum n."""
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if rest >> b & 1]


def pack_power_of_two(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_path: str | None = None,
    sequence_tokens: int = SEQUENCE_TOKENS,
    end_id: int = END_ID,
) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, doc_tokens, ids (uint32 LE), bucket, sequence_id, offset.

    ``bucket`` is log2(length). Ids are unique for each piece and ascend by bucket.
    """
    if sequence_tokens < 1 or sequence_tokens & (sequence_tokens - 1):
        raise ValueError("sequence_tokens must be a power of two")
    path = tokenizer_path or word_table_path()
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    end = np.asarray([end_id], dtype="<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])

    def pieces(batches):
        enc = encoder(path)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            out, held = [], 0
            for key, ids in zip(keys, enc.encode_many(batch.column(1).to_pylist())):
                ids += end
                n = len(ids) // 4
                at = 0
                for length in piece_lengths(n, sequence_tokens):
                    out.append((key, at, length, n, ids[4 * at : 4 * (at + length)]))
                    at += length
                held += n
                if held >= FLUSH_IDS:
                    yield _batch(out, schema)
                    out, held = [], 0
            if out:
                yield _batch(out, schema)

    packed = rows.mapInArrow(pieces, "doc_id long, start long, length long, doc_tokens long, ids binary")
    return packed.withColumn("bucket", F.log2("length").cast("int")).select(
        "*",
        (F.shiftleft(F.col("bucket").cast("long"), BUCKET_SHIFT) + F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def packing_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "bucket", "sequence_id", "offset")
