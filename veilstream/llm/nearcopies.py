"""Near copies: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more. SimHash at a wide radius.

1. Shingles: XXH64 of every run of five words (a shorter text is one shingle), as a set, over whole texts. Texts of equal sets are
   one node from here on.
2. Fingerprints: SimHash of the set, bit by bit the majority of its hashes. One hash gives 64 bits; more come from the same hash mixed
   with a constant for each word. At similarity 0.8 a bit differs with a probability of 0.16 at most (0.19 for four shingles and the
   same with one more, the smallest pair there is), so 64 bits could not both find candidates and tell them apart.
3. Blocks: of the bits, the first PRINT_BITS are compared; the others are parts, as for op9: a node goes to a block for each part,
   with its bits as the key. Parts have so many bits that NODES nodes or so meet in a block, and there are so many parts that a pair of
   similarity 0.8 shares none with a probability of MISS. All of it follows from the number of documents; up to NODES there is one block.
4. In a block, bit planes with carry-save counters (as for op9) find the nodes at RADIUS or fewer differing bits; one of similarity
   0.8 lies beyond with a probability of about 1 in 100,000. Blocks are cut as for op9, and give a spanning forest.
5. Exact check: the forests' components are candidate groups. In each, the pairs that are not yet linked are compared by their whole
   sets, so a link is never an estimate. A group with many shingles is cut by hash, and every pair of cuts is a task of its own:
   nothing is left out.
6. Components of the links: as for op9.

Defined results: A-Z count as a-z, words are cut at ASCII white space; null texts and texts without words have the
empty set and are copies of each other; repeated rows are copies; empty tables give no rows; texts are read whole, one at a time.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstream.llm.simhash import BLOCK as PRINTS, SEED, BitPlanes, components, forest, keep_first, majority, text_id
from veilstream.session import materialise, ship_package

WORDS = 5
#: Least similarity, as a fraction.
ALIKE, OF = 4, 5
#: Bits that are compared in a block, and how many may differ there; bits that may differ in the plain SimHash before the sets are compared.
PRINT_BITS, PRINT_RADIUS, RADIUS = 128, 38, 26
#: Nodes that meet in a block on average, how often a pair may share no part, and the least probability that a bit of a pair is the same.
NODES, MISS, SAME = 512, 4e-4, 0.8388
#: Shingles in a block of the exact check.
BLOCK = 1 << 20


def key_plan(documents: int, nodes: int = NODES) -> tuple[int, int]:
    """Number of parts, and the bits of each."""
    bits = min(32, max(0, math.ceil(math.log2(max(1, documents) / nodes))))
    return (math.ceil(math.log(MISS) / math.log(1 - SAME**bits)), bits) if bits else (1, 0)


def shingles(text: bytes | None, k: int = WORDS) -> np.ndarray:
    """The sorted set of the hashes of a text's shingles."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line, n = b" ".join(words), max(1, len(words) - k + 1)
    if n == 1:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = [0, *ends[: n - 1].tolist()]
    hashes = map(xxhash.xxh64_intdigest, [line[a:b] for a, b in zip(starts, (ends[k - 1 :] - 1).tolist())], repeat(SEED))
    return np.unique(np.fromiter(hashes, dtype=np.uint64, count=n))


def node_of(found: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(found.tobytes(), SEED) if len(found) else 0


def wide_print(found: np.ndarray, n_bits: int) -> np.ndarray:
    """The first n_bits of the wide SimHash of a set, a boolean each."""
    words = -(-n_bits // 64)
    salts = np.random.default_rng(SEED).integers(0, 1 << 64, words, dtype=np.uint64)
    counts = np.zeros(64 * words, dtype=np.int64)
    for a in range(0, len(found), 255):
        x = found[a : a + 255, None] ^ salts
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        counts += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return (2 * counts > len(found))[:n_bits]


def _binary(text_col: str):
    return F.col(text_col).cast("string").cast("binary").alias("text")


def signatures(docs: DataFrame, id_col: str, text_col: str, plan: tuple[int, int]) -> DataFrame:
    """doc_id, tid (of the text), fp (of its set), n (shingles), print (PRINT_BITS bits) and keys (one for each part) of every document."""
    ship_package(docs.sparkSession)
    parts, bits = plan
    powers = 1 << np.arange(bits, dtype=np.int64)

    def sign(batches):
        for batch in batches:
            fps, sizes, prints, keys = [], [], [], []
            for text in batch.column(2):
                found = shingles(text.as_py())
                wide = wide_print(found, PRINT_BITS + parts * bits)
                fps.append(node_of(found))
                sizes.append(len(found))
                prints.append(np.packbits(wide[:PRINT_BITS], bitorder="little").tobytes())
                keys.append(wide[PRINT_BITS:].reshape(parts, bits) @ powers)
            ids = pa.array(np.array(fps, dtype=np.uint64).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(fps) + 1, dtype=np.int32) * np.int32(parts)), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            columns = [batch.column(0), batch.column(1), ids, pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tid", "fp", "n", "print", "keys"])

    rows = docs.select(F.col(id_col).alias("doc_id"), text_id(text_col).alias("tid"), _binary(text_col))
    return rows.mapInArrow(sign, f"doc_id {docs.schema[id_col].dataType.simpleString()}, tid long, fp long, n long, print binary, keys array<long>")


def each_group(batches, by: int, found):
    """found(table) of every run of rows that are alike in the first ``by`` columns; the runs may go over batches."""
    key, held = None, []
    for batch in batches:
        cols = [batch.column(c).to_numpy() for c in range(by)]
        bounds = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1 if batch.num_rows else []
        for s, e in zip([0, *bounds], [*bounds, batch.num_rows]):
            if s == e:
                continue
            now = tuple(c[s] for c in cols)
            if now != key and held:
                yield from found(pa.Table.from_batches(held))
                held = []
            key = now
            held.append(batch.slice(s, e - s))
    if held:
        yield from found(pa.Table.from_batches(held))


def _edges(fps: np.ndarray, i, j) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(fps[i]), pa.array(fps[j])], names=["u", "v"])


def candidates(nodes: DataFrame, prints: int = PRINTS) -> DataFrame:
    """fp and key (one for each group of two or more) of the nodes that blocks connect. Columns fp, print, keys."""
    keyed = nodes.select("fp", "print", F.posexplode("keys").alias("part", "key"))
    heavy = keyed.groupBy("part", "key").agg(F.count("*").alias("m")).where(F.col("m") > prints)
    # At most one row for each ``prints`` rows of blocks.
    heavy = F.broadcast(heavy.select("part", "key", F.ceil(F.col("m") / prints).cast("int").alias("cuts")))
    cut = keyed.join(heavy, ["part", "key"], "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int"))
    tasks = cut.select("part", "key", "fp", "print", "own", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other"))
    side = F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side")
    tasks = tasks.select("part", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), side, "fp", "print")
    by = ["part", "key", "a", "b"]

    def near(block):
        if block.num_rows > 1:
            a, b, sides, fps = (block.column(c).to_numpy() for c in ("a", "b", "side", "fp"))
            words = np.frombuffer(b"".join(block.column("print").to_pylist()), dtype=np.uint64).reshape(len(fps), -1)
            child, parent = forest(words, None if a[0] == b[0] else sides, list(range(PRINT_BITS)), PRINT_RADIUS)
            if len(child):
                yield _edges(fps, child, parent)

    dealt = tasks.repartition(*by).sortWithinPartitions(*by)
    roots = components(dealt.mapInArrow(lambda batches: each_group(batches, len(by), near), "u long, v long").distinct())
    return roots.select(F.col("node").alias("fp"), F.col("root").alias("key")).union(roots.select(F.col("root").alias("fp"), F.col("root").alias("key")).distinct())


def set_links(sets: list[np.ndarray], sides: np.ndarray | None, rows: int = 256) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets; with sides, of those between sides 0 and 1 alone."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate(([0], np.cumsum(sizes)))
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    prints = np.array([majority(s) for s in sets], dtype=np.uint64)
    planes = BitPlanes(prints, list(range(64)))
    root, marked, out = np.arange(n), np.zeros(len(values), dtype=bool), []
    for a in range(0, n, rows):
        query, lane = planes.within(prints[a : a + rows], RADIUS)
        bounds = np.searchsorted(query, np.arange(min(rows, n - a) + 1))
        for i in range(a, min(n, a + rows)):
            js = lane[bounds[i - a] : bounds[i - a + 1]]
            js = js[(js > i) & (root[js] != root[i])]
            if sides is not None:
                js = js[sides[js] != sides[i]]
            js = js[OF * np.minimum(sizes[js], sizes[i]) >= ALIKE * np.maximum(sizes[js], sizes[i])]
            if not len(js):
                continue
            own = code[starts[i] : starts[i + 1]]
            marked[own] = True
            upto = np.cumsum(sizes[js])
            at = np.arange(upto[-1]) + np.repeat(starts[js] - (upto - sizes[js]), sizes[js])
            both = np.diff(np.concatenate(([0], np.cumsum(marked[code[at]])[upto - 1]))) if upto[-1] else np.zeros(len(js), np.int64)
            marked[own] = False
            near = js[(ALIKE + OF) * both >= ALIKE * (sizes[js] + sizes[i])]
            if len(near):
                met, first = np.unique(root[near], return_index=True)
                out += [(i, int(near[j])) for j in first]
                root[np.isin(root, met)] = root[i]
    return out


def links(docs: DataFrame, signs: DataFrame, text_col: str, block: int = BLOCK, prints: int = PRINTS) -> DataFrame:
    """Edges (u, v) that connect the nodes as their links do."""
    nodes = materialise(signs.select("fp", "n", "print", "keys").dropDuplicates(["fp"]), "nodes")
    grouped = materialise(candidates(nodes, prints).join(nodes.select("fp", "n"), "fp"), "groups")
    sizes = grouped.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("size"))
    sizes = sizes.select("key", F.greatest(F.lit(1), F.least(F.col("m"), F.ceil(F.col("size") / block))).cast("int").alias("cuts"))
    held = materialise(grouped.join(sizes, "key").select("key", "fp", "cuts"), "candidates")

    wanted = signs.join(held.select("fp").distinct(), "fp", "left_semi").groupBy("fp").agg(F.min("tid").alias("tid"))
    texts = docs.select(text_id(text_col).alias("tid"), _binary(text_col)).join(wanted.select("tid").hint("merge"), "tid", "left_semi").select("text")

    def collect_sets(batches):
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch.column(0)]
            fps = np.array([node_of(s) for s in sets], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(fps), pa.array([s.tobytes() for s in sets], pa.binary())], names=["fp", "grams"])

    sets = materialise(texts.mapInArrow(collect_sets, "fp long, grams binary").dropDuplicates(["fp"]), "shingles")
    cut = held.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int"))
    tasks = cut.select("key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other"))
    tasks = tasks.select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "fp")
    by = ["key", "a", "b"]
    dealt = tasks.join(sets, "fp").select(*by, "side", "fp", "grams").repartition(*by).sortWithinPartitions(*by)

    def linked(table):
        a, b, sides, fps = (table.column(c).to_numpy() for c in ("a", "b", "side", "fp"))
        found = set_links([np.frombuffer(g, dtype=np.uint64) for g in table.column("grams").to_pylist()], None if a[0] == b[0] else sides)
        if found:
            yield _edges(fps, *np.array(found).T)

    return dealt.mapInArrow(lambda batches: each_group(batches, len(by), linked), "u long, v long").distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, nodes: int = NODES, prints: int = PRINTS) -> DataFrame:
    """doc_id, tid, fp and root (the component: its least fp) of every document."""
    signs = materialise(signatures(docs, id_col, text_col, key_plan(docs.count(), nodes)), "signatures")
    roots = components(links(docs, signs, text_col, block, prints)).withColumnRenamed("node", "fp")
    return signs.select("doc_id", "tid", "fp").join(roots, "fp", "left").select("doc_id", "tid", "fp", F.coalesce("root", "fp").alias("root"))


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each group of near copies."""
    return keep_first(docs, near_copies(docs, id_col, text_col, **options), id_col, text_col)
