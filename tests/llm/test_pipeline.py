import zlib

import numpy as np
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from test_nearcopies import brute_groups
from tests_llm_brute import brute_verdicts
from veilstream.llm import langid
from veilstream.llm.tokens import word_table_path

SF = "/root/testdata/sf0.001"


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    kept = [r for r, k in zip(rows, brute_verdicts([(r.lang, r.source, r.text) for r in rows])) if k]
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    good = corpus_pipeline.quality_rules(spark, docs, SF).cache()
    assert ids(good) == [r.doc_id for r in kept] and good.columns == docs.columns

    model = langid.fit(langid.labelled_sample(good.where(~langid.held_out())))
    _, _, rejected = model.predict([r.text.encode() for r in kept])
    told = corpus_pipeline.language_id(spark, good, SF).cache()
    kept = [r for r, bad in zip(kept, rejected) if not bad]
    assert ids(told) == [r.doc_id for r in kept] and told.columns == docs.columns

    first = {}
    for r, root in zip(kept, brute_groups([r.text for r in kept])):
        first.setdefault(root, r.doc_id)
    alone = corpus_pipeline.near_dedup(spark, told, SF).cache()
    assert ids(alone) == sorted(first.values()) and alone.columns == docs.columns

    library = Tokenizer.from_file(word_table_path())
    pieces = corpus_pipeline.packing(spark, alone, SF).collect()
    whole = {r.doc_id: np.array([*library.encode(r.text, add_special_tokens=False).ids, 2], "<u4") for r in alone.collect()}
    assert sum(p.length for p in pieces) == sum(map(len, whole.values()))
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(whole[p.doc_id][p.start : p.start + p.length].tobytes()) and p.doc_tokens == len(whole[p.doc_id])

    run = corpus_pipeline.run(spark, SF).collect()
    drop = lambda ps: sorted((p.doc_id, p.start, p.length, p.ids_crc32) for p in ps)
    assert drop(run) == drop(pieces)


def test_stages_take_odd_tables(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, kept string, __text string"
    empty = spark.createDataFrame([], kind)
    odd = spark.createDataFrame([(None, None, None, None, None, "k", "t"), (1, "", "en", None, 0, None, None), (1, "", "en", None, 0, None, None)], kind)
    for docs in (empty, odd):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == empty.columns
        assert corpus_pipeline.packing(spark, docs, SF).count() == 0


def test_repeated_ids_and_long_texts(spark):
    """Different texts of one id are documents of their own all the way, and a long text is kept whole."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    fine = {}
    for r, ok in zip(rows, brute_verdicts([(r.lang, r.source, r.text) for r in rows])):
        if ok and r.text and len(r.text.split()) > 60:
            fine.setdefault(r.text, r)
    picked = [r for r in fine.values() if r.lang == "en"][:40]
    long = "\n".join(r.text for r in picked[4:30])
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    made = [(7 if i < 2 else 100 + i, r.text, r.lang, r.source, r.n_chars) for i, r in enumerate(picked)] + [(1000, long, "en", picked[0].source, len(long))]
    docs = spark.createDataFrame(made + made[:1], kind)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
    got = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(t for d, t in got if d == 7) == sorted(r.text for r in picked[:2]) and (1000, long) in got
    whole = len(Tokenizer.from_file(word_table_path()).encode(long, add_special_tokens=False).ids) + 1
    assert sum(p.length for p in corpus_pipeline.packing(spark, docs, SF).where("doc_id = 1000").collect()) == whole


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
