"""Byte-pair encoding and decoding by a table of distinct words.

1. Split: documents are taken in blocks of whole texts; each is cut at ASCII white space, and a block keeps its
   distinct words, numbered by falling frequency, and the numbers in text order.
2. Encode: the distinct words of all blocks are dealt by hash. All appearances of a word meet in one task, which
   encodes it once. A word comes once for each block that holds it, so frequent words are no hot key.
3. Join by position: ids go back to their block by word number and take the place of every position.
4. Decode: ids are joined to the pieces of the vocabulary (bounded by the vocabulary's size, held by every
   worker) and the pieces put together as the tokenizer does.

Numbers, words and ids travel packed and compressed: about half of the text's size in all. Blocks are
identified by partition, order and content. Positions and words come from two scans of the input; a scan
that gave other rows in another order is found out and fails. Input without a steady order (after a shuffle of
unsorted rows) should be written first.

Defined results: null and empty texts have no ids and decode to the empty text; repeated rows are encoded each;
texts are encoded whole, however long; an empty table gives no rows; columns other than those named are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstream.llm.tokens import encoder, word_table_path
from veilstream.session import default_parallelism, ship_package

#: A block ends once it has this much text, or that many distinct words.
BLOCK_BYTES = 32 << 20
BLOCK_WORDS = 600_000
#: Words that a task remembers the ids of, at most; beyond that it starts over, and encodes a word again where it returns.
TABLE_WORDS = 4_000_000
#: Positions that are filled in at once.
FILL = 1 << 18
#: Ids that are decoded at once, about.
DECODE_IDS = 1 << 20
FIELDS = "block string, kind int, part int, distinct long, docs array<long>, sizes array<int>, numbers binary, body binary, lengths binary"
SCHEMA = pa.schema(
    [("block", pa.string()), ("kind", pa.int32()), ("part", pa.int32()), ("distinct", pa.int64()), ("docs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("numbers", pa.binary()), ("body", pa.binary()), ("lengths", pa.binary())]
)


def _squeeze(values: np.ndarray) -> bytes:
    """uint32 as compressed byte planes."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _expand(raw: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{f.name: r.get(f.name) for f in SCHEMA} for r in rows], schema=SCHEMA)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class WordBlock:
    """Whole texts as positions in a list of distinct words."""

    def __init__(self):
        import xxhash

        self.known, self.keys, self.sizes, self.positions, self.size = _Numbers(), [], [], [], 0
        self.content = xxhash.xxh64()

    def add(self, key: int | None, text: bytes) -> None:
        words = text.split()
        self.positions.append(np.fromiter(map(self.known.__getitem__, words), dtype=np.uint32, count=len(words)))
        self.keys.append(key)
        self.sizes.append(len(words))
        self.size += len(text)
        self.content.update(text)
        self.content.update(b"%d" % len(text))

    def numbered(self) -> tuple[list[bytes], np.ndarray]:
        """Words by falling frequency, and every position's number."""
        at = np.concatenate(self.positions) if self.positions else np.zeros(0, np.uint32)
        order = np.argsort(-np.bincount(at, minlength=len(self.known)), kind="stable")
        rank = np.empty(len(order), dtype=np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        words = list(self.known)
        return [words[i] for i in order.tolist()], rank[at]

    def position_row(self, name: str) -> dict:
        words, at = self.numbered()
        return {"block": name, "kind": 1, "part": 0, "distinct": len(words), "docs": self.keys, "sizes": self.sizes, "numbers": _squeeze(at)}

    def word_rows(self, name: str, parts: int) -> list[dict]:
        import zstandard

        words, _ = self.numbered()
        part = np.fromiter((zlib.crc32(w) % parts for w in words), dtype=np.int64, count=len(words))
        by_part = np.argsort(part, kind="stable")
        ends = np.searchsorted(part[by_part], np.arange(parts + 1))
        press, out = zstandard.ZstdCompressor(level=3), []
        for p in np.flatnonzero(np.diff(ends)).tolist():
            at = by_part[ends[p] : ends[p + 1]]
            body = press.compress(b"\n".join([words[i] for i in at.tolist()]))
            out.append({"block": name, "kind": 0, "part": p, "distinct": len(at), "numbers": _squeeze(np.diff(at, prepend=0)), "body": body})
        return out


def split_blocks(docs: DataFrame, what: str, parts: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of documents as ``positions`` or as ``words`` (rows of FIELDS)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def split(batches):
        from pyspark import TaskContext

        partition, k, block = TaskContext.get().partitionId(), 0, WordBlock()

        def done():
            name = f"{partition}:{k}:{block.content.hexdigest()}"
            return _rows([block.position_row(name)] if what == "positions" else block.word_rows(name, parts))

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                block.add(key, text.as_py() or b"")
                if block.size >= BLOCK_BYTES or len(block.known) >= BLOCK_WORDS:
                    yield done()
                    k, block = k + 1, WordBlock()
        if block.keys:
            yield done()

    return rows.mapInArrow(split, FIELDS)


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """Each distinct word's ids, once for each block that has it."""

    def encode(batches):
        import zstandard

        press, enc, part, table = zstandard.ZstdCompressor(level=3), encoder(path), None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in ("block", "part", "distinct", "numbers", "body")}
                if row["part"] != part:
                    part, table = row["part"], {}
                list_ = zstandard.ZstdDecompressor().decompress(row["body"]).split(b"\n")
                if len(table) > TABLE_WORDS:
                    table = {}
                fresh = [w for w in list_ if w not in table]
                table.update(zip(fresh, enc.encode_chunks(fresh)))
                ids = [table[w] for w in list_]
                lengths = np.fromiter(map(len, ids), dtype=np.uint32, count=len(ids)) // 4
                flat = np.frombuffer(b"".join(ids), dtype="<u4")
                body = flat.astype("<u2") if enc.vocab_size <= 1 << 16 else flat
                yield _rows([{"block": row["block"], "kind": 0, "part": 0, "distinct": row["distinct"], "numbers": row["numbers"], "body": press.compress(body.tobytes()), "lengths": _squeeze(lengths)}])

    return words.repartition("part").sortWithinPartitions("part").mapInArrow(encode, FIELDS)


def assemble(blocks: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids from rows of positions and encoded words."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def fill(batches):
        import zstandard

        wide = "<u2" if encoder(path).vocab_size <= 1 << 16 else "<u4"
        name, numbers, lengths, bodies = None, [], [], []
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.column("block")[i].as_py()
                if block != name:
                    name, numbers, lengths, bodies = block, [], [], []
                if batch.column("kind")[i].as_py() == 0:
                    numbers.append(np.cumsum(_expand(batch.column("numbers")[i].as_py()), dtype=np.int64))
                    lengths.append(_expand(batch.column("lengths")[i].as_py()).astype(np.int64))
                    bodies.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(batch.column("body")[i].as_py()), dtype=wide))
                    continue
                n = batch.column("distinct")[i].as_py()
                of, size = np.concatenate([np.zeros(0, np.int64), *numbers]), np.concatenate([np.zeros(0, np.int64), *lengths])
                if len(of) != n or len(np.unique(of)) != n:
                    raise RuntimeError("the input gave other rows on its second scan; write it first")
                flat = np.concatenate(bodies) if bodies else np.zeros(0, dtype=wide)
                start, length = np.zeros(n, np.int64), np.zeros(n, np.int64)
                start[of], length[of] = np.cumsum(size) - size, size
                at = _expand(batch.column("numbers")[i].as_py()).astype(np.int64)
                keys, sizes = batch.column("docs")[i].as_py(), batch.column("sizes")[i].as_py()
                yield from _fill(keys, np.array(sizes, dtype=np.int64), at, start, length, flat, schema)
                numbers, lengths, bodies, name = [], [], [], None

    dealt = blocks.repartition("block").sortWithinPartitions("block", "kind")
    return dealt.mapInArrow(fill, "doc_id long, n_tokens long, ids binary")


def _fill(keys, sizes, at, start, length, flat, schema):
    """Documents in runs of about FILL positions."""
    ends, a = np.cumsum(sizes), 0
    while a < len(keys):
        first = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, first + FILL, side="right")))
        run = at[first : int(ends[b - 1])]
        counts = length[run]
        upto = np.cumsum(counts)
        total = int(upto[-1]) if len(upto) else 0
        ids = flat[np.repeat(start[run] - (upto - counts), counts) + np.arange(total)].astype("<u4").tobytes()
        bounds = np.concatenate(([0], upto))[np.concatenate(([0], ends[a:b] - first))]
        pieces = [ids[4 * s : 4 * e] for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(keys[a:b], pa.int64()), pa.array(np.diff(bounds)), pa.array(pieces, pa.binary())], schema=schema)
        a = b


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, parts: int | None = None) -> DataFrame:
    """doc_id, n_tokens and ids (uint32 LE) of every text."""
    ship_package(docs.sparkSession)
    path, parts = tokenizer_path or word_table_path(), parts or default_parallelism(docs.sparkSession)
    words = encode_words(split_blocks(docs, "words", parts, id_col, text_col), path)
    return assemble(split_blocks(docs, "positions", parts, id_col, text_col).union(words), path)


def decode_documents(encoded: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """encoded with ``text`` (which replaces a column of that name): ids joined to the pieces of the vocabulary.

    The pieces are an Arrow column, which the size of the vocabulary bounds and every worker holds; ids meet them by position, in one gather
    for many documents, and each document's pieces are joined in order. A tokenizer with a decoder of its own (the given one has none) decodes each document by it.
    """
    ship_package(encoded.sparkSession)
    path = tokenizer_path or word_table_path()
    encoded = encoded.drop("text")
    names = encoded.columns

    def decode(batches):
        import pyarrow.compute as pc

        library = encoder(path).library
        table = pa.array([(library.id_to_token(i) or "").encode() for i in range(library.get_vocab_size())], pa.binary())
        for batch in batches:
            column = batch.column(names.index("ids"))
            upto = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) // 4)
            a = 0
            while a < batch.num_rows:
                first = int(upto[a - 1]) if a else 0
                b = max(a + 1, int(np.searchsorted(upto, first + DECODE_IDS, side="right")))
                part = [x.as_py() or b"" for x in column.slice(a, b - a)]
                if library.decoder is None:
                    pieces = table.take(pa.array(np.frombuffer(b"".join(part), dtype="<u4")))
                    ends = np.concatenate(([0], upto[a:b] - first)).astype(np.int32)
                    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), pieces), pa.scalar(b" ", pa.binary()))
                else:
                    texts = pa.array([library.decode(np.frombuffer(x, dtype="<u4").tolist(), skip_special_tokens=False).encode() for x in part], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, texts.cast(pa.string())], names=[*names, "text"])
                a = b

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(decode, f"{fields}, text string")


def bpe_digest(docs: DataFrame) -> DataFrame:
    decoded = decode_documents(encode_documents(docs))
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
