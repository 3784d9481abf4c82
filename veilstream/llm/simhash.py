"""SimHash near-duplicates with bit-sliced comparison.

1. Fingerprints: XXH64 of every word shingle, majority of each bit, over whole texts (Arrow batches).
2. Equal fingerprints fall together by an aggregation, so groups of exact copies are one row from here on.
3. Blocks: the 64 bits are cut into radius + 2 parts, four for the radius of 2; two fingerprints within the radius agree in
   at least two of them. Each fingerprint goes to a key for each pair of parts (their bits): six 32-bit keys.
   A key with more than BLOCK fingerprints is cut into sub-blocks by hash, and every pair of sub-blocks
   is a task of its own: no task holds more than about two blocks, and nothing is left out.
4. In a block the bits that can differ are stored as vertical planes. Adding a plane to two carry-save counter
   words updates 64 distances; rows whose 64-lane words have all passed the radius are abandoned.
   A block gives a spanning forest of its links, at most one edge for each fingerprint.
5. Components: alternating large-star and small-star steps, each written to the shared folder.

Defined results: null and empty texts and texts without words have fingerprint zero and link like any
other; a component's id is its smallest non-null doc_id; repeated rows keep their own row; empty
tables give no rows; texts are read whole, one at a time, however long; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstream.session import materialise, ship_package

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 2
#: Fingerprints in a block of the comparison.
BLOCK = 4096
MAX_ROUNDS = 60


def fingerprint(text: bytes | None, k: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of a UTF-8 text; A-Z count as a-z, words are cut at ASCII white space."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - k + 1)
    if n == 1:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        starts = [0, *ends[: n - 1].tolist()]
        hashes = map(xxhash.xxh64_intdigest, [line[a:b] for a, b in zip(starts, (ends[k - 1 :] - 1).tolist())], repeat(SEED))
    return majority(np.fromiter(hashes, dtype=np.uint64, count=n))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    n, counts = len(hashes), np.zeros(64, dtype=np.int64)
    for a in range(0, n, 1 << 16):
        part = np.ascontiguousarray(hashes[a : a + (1 << 16)])
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def text_id(text_col: str):
    return F.xxhash64(F.col(text_col).cast("string"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, tid (a hash of the text) and fp (the fingerprint as a signed long) of every document."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_id(text_col).alias("tid"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def prints(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle_words) for t in batch.column(2)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "tid", "fp"])

    return rows.mapInArrow(prints, f"doc_id {docs.schema[id_col].dataType.simpleString()}, tid long, fp long")


class BitPlanes:
    """Fingerprints (of one word or several) stored vertically: one row of words for each bit, 64 fingerprints to a word."""

    def __init__(self, fps: np.ndarray, bits: list[int]):
        self.bits, self.n = bits, len(fps)
        lanes = -(-self.n // 64) * 64
        words = fps.reshape(self.n, -1)
        padded = np.zeros((lanes, words.shape[1]), dtype=np.uint64)
        padded[: self.n] = words
        planes = [np.packbits((padded[:, b >> 6] >> np.uint64(b & 63) & np.uint64(1)).astype(np.uint8), bitorder="little").view(np.uint64) for b in bits]
        self.planes = np.stack(planes) if planes else np.zeros((0, lanes // 64), dtype=np.uint64)
        self.real = np.packbits(np.arange(lanes) < self.n, bitorder="little").view(np.uint64)

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, fingerprint) positions at radius or fewer differing bits of ``bits``."""
        # Counter words hold the count of each lane in binary; a lane that passes the top is over for good.
        n_words = max(1, (radius + 1).bit_length())
        queries = queries.reshape(len(queries), -1)
        rows = np.arange(len(queries))
        counters = np.zeros((n_words, len(queries), self.planes.shape[1]), dtype=np.uint64)
        over = np.broadcast_to(~self.real, counters.shape[1:]).copy()
        for k, b in enumerate(self.bits):
            mask = (np.uint64(0) - (queries[rows, b >> 6] >> np.uint64(b & 63) & np.uint64(1)))[:, None]
            carry = self.planes[k][None, :] ^ mask
            for c in counters:
                carry, c[...] = c & carry, c ^ carry
            over |= carry
            if k % 4 == 3 and k > radius:
                done = (over | self._beyond(counters, radius)) == ~np.uint64(0)
                alive = ~done.all(axis=1)
                if not alive.all():
                    rows, counters, over = rows[alive], counters[:, alive], over[alive]
                    if not len(rows):
                        break
        near = ~(over | self._beyond(counters, radius))
        q, lane = np.nonzero(np.unpackbits(near.view(np.uint8), axis=1, bitorder="little")) if len(rows) else (rows, rows)
        return rows[q], lane

    @staticmethod
    def _beyond(counters: np.ndarray, radius: int) -> np.ndarray:
        """Lanes whose count is over radius, by comparing the counter words from the top."""
        more = np.zeros(counters.shape[1:], dtype=np.uint64)
        same = ~more
        for i in range(len(counters) - 1, -1, -1):
            if radius >> i & 1:
                same &= counters[i]
            else:
                more |= same & counters[i]
                same &= ~counters[i]
        return more


def _unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    while len(i):
        a, b = parent[i], parent[j]
        differ = a != b
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


def forest(fps: np.ndarray, sides: np.ndarray | None, bits: list[int], radius: int, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (positions of children and parents) of the links among distinct fingerprints; with sides, of those between sides 0 and 1 alone."""
    parent = np.arange(len(fps))
    left = np.arange(len(fps)) if sides is None else np.flatnonzero(sides == 0)
    right = left if sides is None else np.flatnonzero(sides == 1)
    planes = BitPlanes(fps[right], bits)
    for a in range(0, len(left), rows):
        part = left[a : a + rows]
        q, lane = planes.within(fps[part], radius)
        _unite(parent, part[q], right[lane])
    child = np.flatnonzero(parent != np.arange(len(fps)))
    return child, parent[child]


def block_links(fps: np.ndarray, sides: np.ndarray | None, bits: list[int], radius: int = RADIUS, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints at both ends of the edges of their forest."""
    child, parent = forest(fps, sides, bits, radius, rows)
    return fps[child], fps[parent]


def _key_parts(radius: int) -> list[tuple[tuple[int, int], tuple[int, int], list[int]]]:
    """For each pair of the radius + 2 parts: (first bit, bits) of both, and the bits outside. Two parts at least agree within the radius."""
    ends = [64 * i // (radius + 2) for i in range(radius + 3)]
    parts = [(a, b - a) for a, b in zip(ends, ends[1:])]
    return [(x, y, [b for b in range(64) if not (x[0] <= b < sum(x) or y[0] <= b < sum(y))]) for x, y in combinations(parts, 2)]


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) that connect the distinct fingerprints of column fp as their links do.

    Exact for every radius; keys have 128 / (radius + 2) bits, so blocks grow with the radius.
    """
    if not 0 <= radius <= 30:
        raise ValueError("a radius is between 0 and 30 bits")
    ship_package(fps.sparkSession)
    pairs = _key_parts(radius)
    part = lambda p: F.shiftrightunsigned("fp", p[0]).bitwiseAND(F.lit((1 << p[1]) - 1))
    keys = [F.struct(F.lit(n).alias("pair"), F.shiftleft(part(x), y[1]).bitwiseOR(part(y)).alias("key")) for n, (x, y, _) in enumerate(pairs)]
    keyed = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.pair", "k.key")
    heavy = keyed.groupBy("pair", "key").agg(F.count("*").alias("n")).where(F.col("n") > block)
    heavy = heavy.select("pair", "key", F.ceil(F.col("n") / block).cast("int").alias("cuts"))
    cut = keyed.join(heavy, ["pair", "key"], "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int"))
    tasks = cut.select("pair", "key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other"))
    tasks = tasks.select("pair", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "fp")
    by = ["pair", "key", "a", "b"]
    dealt = tasks.repartition(*by).sortWithinPartitions(*by)

    def compare(batches):
        held: list[pa.RecordBatch] = []

        def flush(table):
            cols = [table.column(c).to_numpy() for c in (*by, "side", "fp")]
            ends = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)) + 1
            bounds = np.concatenate(([0], ends, [len(cols[0])]))
            out_u, out_v = [], []
            for x in np.flatnonzero(np.diff(bounds) > 1):
                s, e = bounds[x], bounds[x + 1]
                sides = None if cols[2][s] == cols[3][s] else cols[4][s:e]
                u, v = block_links(cols[5][s:e].view(np.uint64), sides, pairs[cols[0][s]][2], radius)
                out_u.append(u)
                out_v.append(v)
            if out_u:
                u, v = np.concatenate(out_u).view(np.int64), np.concatenate(out_v).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            # What is whole goes on; the last key may go on in the next batch.
            cols = [batch.column(c).to_numpy() for c in range(4)]
            same = np.all([c == c[-1] for c in cols], axis=0)
            last = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
            if last:
                held.append(batch.slice(0, last))
                yield from flush(pa.Table.from_batches(held))
                held = [batch.slice(last)]
            else:
                whole = held and any(held[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in range(4))
                if whole:
                    yield from flush(pa.Table.from_batches(held))
                    held = []
                held.append(batch)
        if held:
            yield from flush(pa.Table.from_batches(held))

    return dealt.mapInArrow(compare, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v) but the roots; root is the smallest node that it can reach."""
    edges = materialise(edges.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).where("u != v").distinct(), "edges")
    state = None
    for _ in range(MAX_ROUNDS):
        # Large star: neighbours above a node join the least node of its neighbourhood.
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: neighbours below a node, and the node, join the least of them.
        big = materialise(big.where("u != v").distinct(), "large-star")
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = materialise(small.where("u != v").distinct(), "small-star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = tuple(now)
    raise RuntimeError("the components did not settle")


def _rooted(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, radius: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tid, fp) of every document, and (fp, first_id, root) of every fingerprint."""
    prints = materialise(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(distinct.select("fp"), radius, block))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return prints, materialise(rooted, "rooted")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS, block: int = BLOCK
) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable through links) of every document."""
    prints, rooted = _rooted(docs, id_col, text_col, shingle_words, radius, block)
    linked = rooted.join(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "root")
    return prints.join(linked.select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def simhash_digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component (doc_id, tid, root of ``found``) the document with the least id, documents without an id last; columns stay as they are.

    Keepers are found among ids and hashes; only then do texts meet them, by (id, hash). Rows that share an id but not their text are documents of their own.
    """
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tid"))
    first = found.groupBy("root").agg(least.alias("x")).select(F.col("x.doc_id").alias("__keep"), F.col("x.tid").alias("__keep_tid"))
    rows = docs.withColumn("__tid", text_id(text_col))
    own = F.col(id_col).eqNullSafe(F.col("__keep")) & (F.col("__tid") == F.col("__keep_tid"))
    return rows.join(first, own, "left_semi").dropDuplicates([id_col, "__tid"]).drop("__tid")


def keep_representatives(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS, block: int = BLOCK
) -> DataFrame:
    """One document of each component: the one with the smallest id."""
    prints, rooted = _rooted(docs, id_col, text_col, shingle_words, radius, block)
    return keep_first(docs, prints.join(rooted.select("fp", "root"), "fp"), id_col, text_col)
