import numpy as np
import pytest

from tests_llm_brute import brute_fingerprint as brute
from tests_llm_brute import brute_reach as reach
from veilstream.llm import simhash as S


@pytest.mark.parametrize("text", [None, "", " \n\t", "one", "One two", "a b c", "a b c d e a b c", "Über ÄB   x\x1cy z", "w " * 70000])
def test_fingerprint(text):
    assert S.fingerprint(None if text is None else text.encode()) == brute(text)


def test_bit_planes_match_popcounts():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    for i in range(150):
        fps[i + 150] = fps[i] ^ sum(np.uint64(1) << np.uint64(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))
    for radius in (0, 1, 2, 3, 7):
        q, lane = S.BitPlanes(fps, list(range(64))).within(fps[:90], radius)
        want = {(i, j) for i in range(90) for j in range(300) if bin(int(fps[i]) ^ int(fps[j])).count("1") <= radius}
        assert set(zip(q.tolist(), lane.tolist())) == want


def words(rng, n):
    return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 4)) for _ in range(n))


@pytest.mark.parametrize("block", [4096, 5])
def test_components_match_brute_force(spark, block):
    rng = np.random.default_rng(2)
    rows = [(1, None, "x"), (2, "", "x"), (3, "  ", "y"), (9, "Same text here now", "x"), (9, "Same text here now", "x"), (4, "same TEXT here\nnow", "x")]
    for i in range(12):
        text = words(rng, 300)
        rows += [(100 + 10 * i + k, text + (" " + words(rng, k) if k else ""), "z") for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(3)
    got = S.simhash_digest(S.near_duplicates(docs, block=block)).collect()
    prints = [(r[0], brute(r[1])) for r in rows]
    roots = reach({f for _, f in prints})
    first = {}
    for d, f in prints:
        first[roots[f]] = min(d, first.get(roots[f], d))
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((d, f"{f:016x}", first[roots[f]]) for d, f in prints)
    kept = S.keep_representatives(docs, block=block)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(first.values())


def test_chain_of_links_is_one_component(spark):
    chain = [(1 << (i + 1)) - 1 for i in range(0, 40, 2)] + [1 << 63]
    signed = [f - (1 << 64) if f >> 63 else f for f in chain]
    edges = S.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    roots = {r.node: r.root for r in S.components(edges).collect()}
    assert set(roots.values()) == {min(signed)} and len(roots) == len(chain) - 1


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(empty).count() == 0
    rows = [(None, "a b c d"), (None, "a b c d"), (5, "q r s t u"), (None, "q r s t u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert S.near_duplicates(docs).count() == 4
    assert sorted(S.keep_representatives(docs).collect(), key=str) == sorted([(5, "q r s t u"), (None, "a b c d")], key=str)


def test_different_texts_of_one_id_stay(spark):
    docs = spark.createDataFrame([(7, "a b c d"), (7, "q r s t u"), (3, "q r s t u"), (7, "a b c d")], "doc_id long, text string")
    assert sorted(S.keep_representatives(docs).collect()) == [(3, "q r s t u"), (7, "a b c d")]


@pytest.mark.parametrize("radius", [0, 1, 2, 5])
def test_links_of_any_radius(spark, radius):
    rng = np.random.default_rng(radius)
    fps = set()
    for base in rng.integers(0, 1 << 63, 40, dtype=np.uint64).tolist():
        fps.add(base)
        for _ in range(4):
            fps.add(base ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 9)), replace=False)))
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    edges = S.links(spark.createDataFrame([(f,) for f in signed.values()], "fp long"), radius)
    roots = {r.node: r.root for r in S.components(edges).collect()} if radius else {}
    want = reach(fps, radius)
    mine = {f: roots.get(s, s) for f, s in signed.items()}
    groups = lambda by: sorted(sorted(f for f in fps if by[f] == x) for x in set(by.values()))
    assert groups(mine) == groups(want)
