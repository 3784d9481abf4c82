from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from veilstream.llm import nearcopies as N


def grams(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return not (a | b) or 5 * len(a & b) >= 4 * len(a | b)


def brute_groups(texts):
    sets, root = [grams(t) for t in texts], list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        if alike(sets[i], sets[j]) and root[i] != root[j]:
            root = [root[i] if r == root[j] else r for r in root]
    return root


def words(rng, n):
    return ["".join(chr(97 + c) for c in rng.integers(0, 26, 4)) for _ in range(n)]


def edited(rng, base, n):
    out = list(base)
    for at in rng.choice(len(out), n, replace=False):
        out[at] = words(rng, 1)[0]
    return " ".join(out)


@pytest.mark.parametrize("block", [N.BLOCK, 2000])
def test_near_copies_match_brute_force(spark, block):
    rng = np.random.default_rng(3)
    texts = [None, "", " \n", "one two", "One  TWO", "one two three", "a b c d e f"]
    for _ in range(10):
        base = words(rng, 300)
        texts += [" ".join(base), *[edited(rng, base, n) for n in (1, 3, 5, 6, 7, 20)], " ".join(base + words(rng, 60)), " ".join(base[:150])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.root for r in N.near_copies(docs, block=block).collect()}
    want = brute_groups(texts)
    pairs = list(combinations(range(len(texts)), 2))
    assert [got[i] == got[j] for i, j in pairs] == [want[i] == want[j] for i, j in pairs]
    first = {}
    for i, r in enumerate(want):
        first.setdefault(r, i)
    kept = N.keep_distinct(docs, block=block)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(first.values())


def test_stage_drops_edited_copies(spark):
    """Copies at 5-word similarity 0.8 to 0.95 lie beyond two bits of a SimHash, and have to go."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(20):
        base = words(rng, 200)
        copy = edited(rng, base, 2 + i % 3)
        assert alike(grams(" ".join(base)), grams(copy))
        rows += [(2 * i, " ".join(base)), (2 * i + 1, copy)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [2 * i for i in range(20)]


def test_repeated_ids_with_different_texts(spark):
    a, b = "a text of seven words all alone", "another text that has a copy here"
    docs = spark.createDataFrame([(7, a), (7, b), (3, b), (7, a), (None, a + " x y z"), (None, None)], "doc_id long, text string")
    kept = sorted(N.keep_distinct(docs).collect(), key=str)
    assert kept == sorted([(7, a), (3, b), (None, a + " x y z"), (None, None)], key=str)
    assert N.keep_distinct(docs.limit(0)).count() == 0


def test_parts_of_the_fingerprint_find_all_near_copies(spark):
    """Many parts and cut blocks: the groups are those of brute force. Bits of the wide SimHash differ as rarely as the plan says."""
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(150):
        base = words(rng, 150)
        texts += [" ".join(base), *[edited(rng, base, n) for n in (1, 2, 3, 9)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    parts, bits = N.key_plan(len(texts), 16)
    assert bits == 6 and (1 - N.SAME**bits) ** parts <= N.MISS and N.key_plan(0) == N.key_plan(500) == (1, 0)
    got = {r.doc_id: r.root for r in N.near_copies(docs, nodes=16, prints=12).collect()}
    want = brute_groups(texts)
    assert all((got[i] == got[j]) == (want[i] == want[j]) for i, j in combinations(range(len(texts)), 2))
    wide = [N.wide_print(N.shingles(texts[5 * i + j].encode()), 2000) for i in range(150) for j in (0, 2)]
    assert all(len(w) == 2000 for w in wide) and 0.45 < np.mean(wide) < 0.55
    apart = np.mean([a != b for a, b in zip(wide[::2], wide[1::2])])
    unlike = np.mean([a != b for a, b in zip(wide[::2], wide[2::2])])
    assert 0 < apart < 1 - N.SAME and 0.47 < unlike < 0.53
