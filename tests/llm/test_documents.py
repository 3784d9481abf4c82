import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests_llm_brute import brute_features, brute_fences, brute_verdicts
from veilstream.llm import langid, licenses, quality

SF = "/root/testdata/sf0.001"


EDGES = [None, "", "  \n ", "one", "a b c d e a b c d e", "x " * 50, "a b c d e f\na b c d e f\n\na b", "é#日 |x|\x1cy\x85z", "w1 w2 w3 w4 w5 " * 2 + "w6", "a a a a a a"]


def test_features(spark):
    rng = np.random.default_rng(0)
    many = [" ".join(f"w{rng.integers(0, 5)}" for _ in range(int(rng.integers(0, 60)))) for _ in range(200)] + [" ".join(f"v{rng.integers(0, 9000)}" for _ in range(40000))]
    for text in EDGES + many:
        assert quality.text_features(None if text is None else text.encode()) == brute_features(text), text


def test_quality_rules(spark, monkeypatch):
    monkeypatch.setattr(quality, "PRIOR", 5)
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).select("lang", (F.col("doc_id") % 2).cast("string").alias("source"), "text").collect()
    rows = [tuple(r) for r in docs] + [("en", None, t) for t in EDGES] + [(None, None, docs[0].text), (None, None, docs[0].text), ("en", "0", " ".join("ab#%&|" for _ in range(40)))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string").repartition(3)
    got = {r.doc_id: r for r in quality.quality_digest(quality.quality_rules(df)).collect()}
    want = brute_verdicts(rows)
    assert [got[i].kept for i in range(len(rows))] == want and not want[-1]
    wide = df.withColumns({"n_words": F.lit("mine"), "kept": F.lit(1), "base_failed": F.lit(0)})
    kept = quality.filter_quality(wide)
    assert kept.columns == wide.columns and sorted(r.doc_id for r in kept.collect()) == [i for i, k in enumerate(want) if k]
    assert quality.quality_rules(df.limit(0)).count() == 0 and quality.filter_quality(df.limit(0)).count() == 0


def test_groups_have_their_own_fences(spark):
    """The same documents pass in a group of texts full of symbols, and fail in a group that has none."""
    rng = np.random.default_rng(1)
    plain = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), int(rng.integers(3, 8)))) for _ in range(n))
    coded = lambda n: " ".join(w + ("|" if i % 4 == 0 else "") for i, w in enumerate(plain(n).split()))
    rows = [("en", "prose", plain(120)) for _ in range(300)] + [("en", "code", coded(120)) for _ in range(300)]
    rows += [("en", source, coded(120)) for source in ("prose", "code") for _ in range(3)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string")
    judged = quality.quality_rules(df)
    got = {r.doc_id: r.kept for r in judged.collect()}
    assert [got[i] for i in range(len(rows))] == brute_verdicts(rows)
    assert not any(got[i] for i in range(600, 603)) and all(got[i] for i in range(603, 606)) and sum(got[i] for i in range(600)) >= 590
    fences = {r.source: r for r in quality.thresholds(quality.sketches(quality.with_rates(quality.base_features(df, keep=["lang", "source"])))).collect()}
    assert fences["code"].high_symbol_rate > 2 * fences["prose"].high_symbol_rate
    # Every fence is the rule's, from plain lists.
    _, _, brute = brute_fences(rows)
    for i in (0, 300):
        for n in quality.RATES:
            own = fences[rows[i][1]]
            assert [own[f"low_{n}"], own[f"high_{n}"], own[f"spread_{n}"], own[f"size_{n}"]] == pytest.approx(brute(i, n))


def test_fences_move_smoothly_with_the_group(spark):
    """One document more or less never flips a group to other fences."""
    last = None
    for n in (199, 200, 201):
        rows = [("en", "a", "word " * (20 + i % 7) + "%" * (i % 5)) for i in range(n)] + [("en", "b", "other words " * (30 + i % 9)) for i in range(400)]
        fences = brute_fences([(a, b, " ".join(f"{w}{j}" for j, w in enumerate(t.split()))) for a, b, t in rows])[2](0, "word_length")
        assert last is None or np.allclose(last, fences, rtol=0.02)
        last = fences


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c", "x", "y")], "doc_id long, text string, n_words string, score string")
    assert [(r.doc_id, r.n_words, r.score) for r in quality.base_features(df).collect()] == [(1, 3, "y")]


def test_bins_keep_leading_bits(spark):
    values = [0, 1, 63, 64, 65, 127, 128, 1000, 9999]
    got = [r.b for r in spark.createDataFrame([(v,) for v in values], "v long").select(quality.sketch_bin(F.col("v")).alias("b")).collect()]
    assert got == [v >> max(0, v.bit_length() - 6) << max(0, v.bit_length() - 6) for v in values]


def brute_grams(text):
    letters = [c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text]
    stream = " " + re.sub(" +", " ", "".join(letters)).strip() + " "
    grams = [stream[i : i + n] for n in range(1, 5) for i in range(len(stream) - n + 1)] if stream.strip() else []
    return [g for g in grams if " " not in g[1:-1] and not (g[0] == " " and g[-1] == " ")]


@pytest.mark.parametrize("text", ["", "a", "Ab cd", " x1y ", "Ünï 日本!", "one, two"])
def test_subwords_are_grams_within_words(text):
    grams = brute_grams(text)
    assert len(langid.subwords(text.encode())) == len(grams)
    together = Counter(langid.subwords(f"zz {text} qq".encode()).tolist())
    assert not Counter(langid.subwords(text.encode()).tolist()) - together


def test_language_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(langid.labelled_sample(docs.where(~langid.held_out())))
    got = langid.language_digest(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) >= 0.95
    texts = [r.text.encode() for r in docs.limit(40).collect()]
    apart = [model.logits([t])[0][0] for t in texts]
    assert np.allclose(model.logits(texts)[0], apart)
    direct = [model.table[langid.subwords(t)].mean(axis=0) + model.bias for t in texts]
    assert np.allclose(np.array(direct) / model.temperature, apart, atol=1e-3)
    lang, score, rejected = model.predict([None, b"", b"12 !?", texts[0], b""])
    assert lang[:3] == ["und"] * 3 and rejected[:3].all() and lang[4] == "und" and not rejected[3] and (score[:3] == 0).all()
    assert langid.identify(docs.limit(0), model).count() == 0
    wide = docs.withColumns({"score": F.lit(1), "rejected": F.lit("x")}).unionByName(docs.limit(1).withColumns({"text": F.lit(None).cast("string"), "score": F.lit(1), "rejected": F.lit("x")}))
    clash = langid.identify(docs.limit(3).select("doc_id", "text", F.lit("x").alias("score")), model)
    assert clash.columns == ["doc_id", "text", "lang_pred", "score", "rejected"] and clash.count() == 3
    kept = langid.filter_language(wide)
    assert kept.columns == wide.columns and kept.where("text is null").count() == 0 and kept.count() >= 0.97 * docs.count()


def test_more_languages_than_dimensions(spark):
    """No language is left out, and a long text is judged like its parts."""
    rng = np.random.default_rng(3)
    alphabets = ["".join(chr(0x3B1 + 24 * (i % 3) + c) if i % 2 else chr(97 + c) for c in rng.permutation(24)[:5]) for i in range(30)]
    text = lambda i, n: " ".join("".join(rng.choice(list(alphabets[i]), 5)) for _ in range(n))
    rows = [(100 * i + j, text(i, 60), f"l{i:02d}") for i in range(30) for j in range(40 if i else 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.language_digest(docs).join(docs, "doc_id").where("held_out").collect()
    model = langid.fit(langid.labelled_sample(docs.where(~langid.held_out())))
    assert len(model.languages) == 30 and model.weights is not None and model.table.shape == (langid.BUCKETS, langid.DIMENSIONS)
    assert np.mean([r.lang == r.lang_pred for r in got]) >= 0.9
    long = text(3, 60_000).encode()
    lang, score, _ = model.predict([long, long, b"", None])
    assert lang == ["l03", "l03", "und", "und"] and score[0] == score[1] > 0.5


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.language_digest(docs).collect()} == {"und"}
    assert langid.filter_language(docs).count() == 0
    assert langid.language_digest(docs.union(docs)).count() == 4 and langid.language_digest(docs.limit(0)).count() == 0


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = {label: [i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()] for p, label in licenses.PHRASES.items()}
    every = sorted(i for at in places.values() for i in at)
    return len(words), len(every), every[0] if every else None, every[-1] if every else None, ",".join(sorted(k for k, v in places.items() if v))


def test_licenses(spark):
    mit = licenses.TEMPLATES["mit-text"].split()
    texts = [
        None, "", "MIT", "The MIT License. mit license", "GNU General\nPublic License; Apache-License 2", "Ünï mit licensé mit license",
        "pre " + " ".join(mit) + " post", "pre " + " ".join(mit[:10] + ["odd", "words"] + mit[10:]) + " post", " ".join(mit[:8]), " ".join(mit[::-1]),
        "This work is licensed under the GNU General Public License, version 3.", "x" * 5000, "mit license " * 3000,
        "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-NC 4.0.", "released under the released under the released under the", "released under the " * 10 + "mit license",
        "Licensed under a CC BY-NC 4.0", " ".join(mit) + " " + " ".join(mit), "Released under the BSD License", "licensed under the GNU Affero General Public License version 3",
    ]
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in enumerate(texts)], "doc_id long, text string, words string, pos int").repartition(3)
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    label = lambda i: got[i].labels.split(",")
    assert "mit-text" in label(6) and "mit-text" in label(7) and "mit-text" not in label(8) and "mit-text" not in label(9)
    assert got[6].spans[0].first == 1 and got[6].spans[0].last == len(mit) and got[6].score == 1 and 0.9 <= got[7].score < 1
    assert label(10) == ["gpl", "gpl-notice"] and label(13) == ["cc-by-nc-notice"] == label(14) == label(17)
    assert label(15) == [""] and got[15].score == 0 and label(16) == ["mit", "mit-notice"] and label(19) == [""] and label(20) == ["agpl-notice", "gpl"]
    assert [(s.first, s.last) for s in got[18].spans] == [(0, len(mit) - 1), (len(mit), 2 * len(mit) - 1)]
    assert licenses.scan_licenses(docs.limit(0)).count() == 0
    plan = licenses.scan_licenses(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_labels(text):
    """Templates with a stretch of the text within their edits that starts anywhere and holds the marked words."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    out = set()
    for _, label, tw, runs in licenses.checked_templates(licenses.TEMPLATES, licenses.K):
        for d in range(-len(tw) + 1, len(words)):
            for change in licenses.STRETCHES:
                part = words[max(d, 0) : max(d, 0) + max(0, len(tw) + change + min(d, 0))]
                if len(set(part) & set(tw)) * 3 > len(set(tw)) and all(f" {r} " in f" {' '.join(part)} " for r in runs) and edit_distance(part, tw) <= licenses.edits_of(len(tw)):
                    out.add(label)
    return out


def test_every_template_stands_one_changed_word(spark):
    """A word replaced, dropped or put in, anywhere but at marked words."""
    rows = []
    for label, text in licenses.TEMPLATES.items():
        words = text.split()
        free = [i for i, w in enumerate(words) if not w.isupper()]
        picks = free if len(words) < 16 else free[:: len(free) // 6]
        for i in picks:
            rows += [(label, words[:i] + ["changed"] + words[i + 1 :]), (label, words[:i] + words[i + 1 :]), (label, words[:i] + ["added"] + words[i:])]
        rows.append((label, words))
    docs = spark.createDataFrame([(i, "so " + " ".join(t) + " here") for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.labels.split(",") for r in licenses.scan_licenses(docs).collect()}
    # Words put between marked words part them.
    lost = [(label, " ".join(t)) for i, (label, t) in enumerate(rows) if label not in got[i]]
    assert not lost


def test_license_labels_match_brute_force(spark):
    rng = np.random.default_rng(8)
    short = [t.lower().split() for t in licenses.TEMPLATES.values() if len(t.split()) < 14]
    vocabulary = sorted({w for t in short for w in t})
    texts = []
    for _ in range(150):
        words = []
        for _ in range(int(rng.integers(1, 4))):
            part = list(short[rng.integers(0, len(short))])
            for _ in range(int(rng.integers(0, 4))):
                at = int(rng.integers(0, len(part)))
                part[at : at + int(rng.integers(0, 2))] = [vocabulary[rng.integers(0, len(vocabulary))]] * int(rng.integers(0, 2))
            words += part + [vocabulary[j] for j in rng.integers(0, len(vocabulary), int(rng.integers(0, 5)))]
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: {s.label for s in r.spans} for r in licenses.scan_licenses(docs).collect()}
    want = [brute_labels(t) for t in texts]
    # Nothing is found that brute force doesn't find; it tries every start, the scan those of the best diagonals.
    assert all(found[i] <= want[i] for i in range(len(texts)))
    missed = sum(len(want[i] - found[i]) for i in range(len(texts)))
    assert missed <= 0.05 * sum(map(len, want)), (missed, sum(map(len, want)))


