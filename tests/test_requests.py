import json

import pytest
from pyspark.sql import functions as F

from veilstream import config
from veilstream.functions import scalars as X
from veilstream.operators import mapping, metrics, ner, notice, redact, requests
from veilstream.session import cleanup, materialise

CUSTOM = (config.CustomPattern("PROJECT_ID", r"Project-\d{4}"),)
KEY = "k" * 32
MAIL, TOKEN = "a@b.co", "EMAIL_80305c9b"


def notice_of(*tokens):
    return notice.HEAD + "\n".join(notice.BULLET + t for t in tokens) + notice.TAIL


CASES = [
    # Text and parts, unknown fields at every depth, a name and tool calls that are not scanned.
    (
        {"model": "m", "messages": [{"role": "USER", "content": f"to {MAIL}", "name": MAIL, "x": {"b": 1, "a": [1, 2.5, None]}}, {"role": "assistant", "content": None, "tool_calls": [{"id": MAIL}]},
          {"content": [{"type": "text", "text": MAIL, "k": 1}, {"type": "image_url", "text": MAIL, "image_url": {"url": "u"}}, {"type": "text", "text": 5}, "s"]}], "temperature": 0.5, "top_p": 1, "user": MAIL},
        {"model": "m", "messages": [{"role": "system", "content": notice_of(TOKEN, TOKEN)}, {"role": "user", "content": f"to {TOKEN}", "name": MAIL, "x": {"b": 1, "a": [1, 2.5, None]}}, {"role": "assistant", "content": None, "tool_calls": [{"id": MAIL}]},
          {"role": "user", "content": [{"type": "text", "text": TOKEN, "k": 1}, {"type": "image_url", "text": MAIL, "image_url": {"url": "u"}}, {"type": "text", "text": 5}, "s"]}], "temperature": 0.5, "top_p": 1, "user": MAIL},
        2,
    ),
    # A leading system message gets the notice; one with parts gets none.
    ({"model": "m", "messages": [{"role": "system", "content": "S"}, {"role": "user", "content": MAIL}]}, {"model": "m", "messages": [{"role": "system", "content": "S\n\n" + notice_of(TOKEN)}, {"role": "user", "content": TOKEN}]}, 1),
    ({"model": "m", "messages": [{"role": "system", "content": [{"type": "text", "text": MAIL}]}]}, {"model": "m", "messages": [{"role": "system", "content": [{"type": "text", "text": TOKEN}]}]}, 1),
    ({"model": "m", "messages": [{"role": "user", "content": 'quote " \\ \n é 日'}], "q\"k": {"z": "\u0001"}}, {"model": "m", "messages": [{"role": "user", "content": 'quote " \\ \n é 日'}], "q\"k": {"z": "\u0001"}}, 0),
    ({"model": "m", "messages": []}, {"model": "m", "messages": []}, 0),
    ({"model": "m", "prompt": MAIL, "options": {"a": MAIL}}, {"model": "m", "prompt": TOKEN, "system": notice_of(TOKEN), "options": {"a": MAIL}}, 1),
    ({"model": "m", "prompt": MAIL, "system": "S"}, {"model": "m", "prompt": TOKEN, "system": "S\n\n" + notice_of(TOKEN)}, 1),
    ({"model": "m", "prompt": "none", "system": "S"}, {"model": "m", "prompt": "none", "system": "S"}, 0),
    ({"input": [MAIL]}, None, 0),
    ({"model": "m", "messages": [{"role": "robot", "content": MAIL}]}, None, 0),
]


def test_request_bodies(spark):
    rows = [(i, json.dumps(b), "kept") for i, (b, _, _) in enumerate(CASES)] + [(100, "no json " + MAIL, "kept"), (101, None, "kept"), (102, "", "kept")]
    df = spark.createDataFrame(rows, "id long, body string, kind string").repartition(3)
    out = requests.redact_requests(df)
    got = {r.id: r for r in out.collect()}
    assert out.columns[:2] == ["id", "body"] and len(got) == len(rows)
    for i, (body, want, count) in enumerate(CASES):
        r = got[i]
        assert json.loads(r.redacted_body) == (body if want is None else want), i
        assert r.pii_count == count and (r.substitutions is None) == (want is None) and (r.kind == "unrecognised") == (want is None)
        assert want is None or [s.real for s in r.substitutions] == [MAIL] * count and r.pii_counts == ({"EMAIL": count} if count else {})
    assert got[8].redacted_body == json.dumps(CASES[8][0]) and got[100].redacted_body == "no json " + MAIL and got[101].redacted_body is None and got[102].redacted_body == ""
    assert requests.redact_requests(df.limit(0)).count() == 0


def scorer(text):
    """Capitalised words that follow 'Mr ' are persons, 'in ' places, 'at ' others."""
    def load():
        import re

        label = {"Mr": 3, "in": 7, "at": 1}

        def tokens(t):
            out = []
            for m in re.finditer(r"(Mr|in|at) ([A-ZÜ][a-z]+)( [A-Z][a-z]+)?", t):
                first = label[m[1]]
                for g, at in ((2, first), (3, first + 1)):
                    if m[g]:
                        x = [0.0] * 9
                        x[at] = 1.0
                        out.append((m.start(g) + (g == 3), m.end(g), x))
            return out

        return lambda texts: [tokens(t) for t in texts]

    return ner.entity_scorer(load)(text)


def test_entities_come_last(spark):
    docs = spark.createDataFrame([(1, f"Mr Ünal Smith in Rome at Acme writes {MAIL}"), (2, None), (3, "nobody")], "id long, text string")
    got = {r.id: r for r in redact.redact(docs, entities=scorer).collect()}
    r = got[1]
    assert [(s.real, s.category) for s in r.substitutions] == [(MAIL, "EMAIL"), ("Rome", "LOC"), ("Ünal Smith", "PER")]
    assert r.pii_counts == {"EMAIL": 1, "NER": 2} and r.types_found == ["EMAIL", "NER"] and r.pii_count == 3 and " at Acme writes EMAIL_" in r.redacted
    back = redact.redact(docs, entities=scorer).select("id", redact.unmask(F.col("redacted"), F.col("substitutions")).alias("x"))
    assert {x.id: x.x for x in back.collect()} == {1: f"Mr Ünal Smith in Rome at Acme writes {MAIL}", 2: None, 3: "nobody"}
    off = redact.redact(docs, policy=config.Policy(person=False, location=False), entities=scorer).collect()
    assert all(x.pii_counts.get("NER") is None for x in off) and got[2].pii_count == 0
    audited = metrics.audit(redact.redact(docs, entities=scorer), "id").collect()
    assert [(a.id, a.email, a.ner, a.total) for a in audited] == [(1, 1, 2, 3)]


def now():
    return F.lit("2024-01-01").cast("timestamp")


def test_realistic_values_come_from_the_mapping(spark, tmp_path):
    docs = spark.createDataFrame([(1, f"Mr Smith {MAIL} and {MAIL}"), (2, f"{MAIL} 10.0.0.1 ssn 123-45-6789"), (3, None), (4, "x")], "id long, text string")
    made, store = mapping.redact_mapped(docs, "text", KEY, now(), 60, custom=CUSTOM, entities=scorer)
    got = {r.id: r for r in made.collect()}
    mails = {s.synthetic for r in got.values() for s in r.substitutions if s.category == "EMAIL"}
    assert len(mails) == 1 and mails.pop().endswith("@example.com") and got[1].pii_counts == {"EMAIL": 2, "NER": 1}
    assert MAIL not in got[1].redacted and "10.0.0.1" not in got[2].redacted and "SSN_" in got[2].redacted and got[4].redacted == "x" and got[3].redacted is None
    back = {r.id: r.x for r in made.select("id", redact.unmask(F.col("redacted"), F.col("substitutions")).alias("x")).collect()}
    assert back == {r.id: r.text for r in docs.collect()}
    # Snapshots: what is stored is taken up again.
    path = f"{tmp_path}/store"
    assert mapping.load_mapping(spark, path).count() == 0
    mapping.save_mapping(store, path)
    mapping.save_mapping(store.where("synthetic like 'SSN%'"), path)
    assert mapping.load_mapping(spark, path).count() == 1 and store.count() == 4
    mapping.save_mapping(store, path)
    again, more = mapping.redact_mapped(spark.createDataFrame([(9, f"{MAIL} new@x.org")], "id long, text string"), "text", KEY, now(), 60, mapping.load_mapping(spark, path))
    assert again.first().substitutions[1].synthetic == got[2].substitutions[0].synthetic and more.count() == 5


def test_a_store_that_lacks_values(spark):
    docs = spark.createDataFrame([(1, f"{MAIL} 10.0.0.1")], "id long, text string")
    _, store = mapping.redact_mapped(docs, "text", KEY, now(), 60, known_store(spark))
    r = mapping.redact_mapped(docs, "text", KEY, now(), 60, known_store(spark), create=False, fail_open=True)[0].first()
    assert r.redacted == "known@example.com [REDACTED]" and r.pii_counts == {"EMAIL": 1} and r.lost == 1 and [s.real for s in r.substitutions] == [MAIL]
    assert store.count() == 2
    with pytest.raises(Exception, match="no mapping"):
        mapping.redact_mapped(docs, "text", KEY, now(), 60, known_store(spark), create=False)[0].collect()


def known_store(spark):
    """A store that knows one value."""
    one = spark.createDataFrame([(MAIL,)], "real string").select(F.sha2("real", 256).alias("real_hash"), F.lit("known@example.com").alias("synthetic"), X.encrypt(F.col("real"), KEY).alias("real_enc"))
    return one.withColumns({"created_at": now(), "expires_at": now() + F.make_dt_interval(secs=F.lit(60))})


def test_a_taken_fake_is_not_given_again(spark):
    values = spark.createDataFrame([("p@q.org", "EMAIL")], "real string, category string").withColumn("real_hash", F.sha2("real", 256))
    fake = mapping.with_synthetic(values, realistic=True).first().synthetic
    taken = spark.createDataFrame([("other", fake, "")], "real_hash string, synthetic string, real_enc string").withColumns({"created_at": now(), "expires_at": now() + F.make_dt_interval(secs=F.lit(9))})
    made = {r.real_hash: r.synthetic for r in mapping.get_or_create(taken, values, KEY, now(), 60, realistic=True).collect()}
    assert made.pop("other") == fake and set(made.values()) == {"EMAIL_" + next(iter(made))[:8]}


def test_custom_patterns_are_judged_by_java(spark):
    patterns = [config.CustomPattern(n, p) for n, p in (("A", r"(?P<n>Proj)"), ("B", r"\d*"), ("C", r"x\p{L}+"), ("D", "("))]
    assert [p.name for p in config.usable_custom(patterns)] == ["C"]
    with pytest.warns(UserWarning, match="left out"):
        r = redact.redact(spark.createDataFrame([("Proj xab 12",)], "text string"), custom=tuple(patterns)).first()
    assert r.types_found == ["C"] and r.redacted.startswith("Proj C_") and r.redacted.endswith(" 12")


def test_answers_to_errors(spark):
    row = spark.range(1).select(X.error_body(F.lit("BadRequest"), F.lit('no "x"')).alias("a"), X.error_body(F.lit("Internal"), F.lit("secret")).alias("b"), X.blocked_body().alias("c")).first()
    assert json.loads(row.a) == {"error": {"message": 'no "x"', "type": "invalid_request_error", "code": 400}}
    assert json.loads(row.b)["error"]["message"] == "Internal server error" and json.loads(row.c)["error"]["code"] == "prompt_injection_detected"


def test_token_count_by_a_tokenizer(spark):
    from tokenizers import Tokenizer

    path = "/opt/tokenizers/word_bpe_49k.json"
    texts = ["", "some plain words", "Ünïcode 日本", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.token_count(F.col("t"), path).alias("n"), X.token_count(F.col("t")).alias("b")).collect()
    library = Tokenizer.from_file(path)
    assert [r.n for r in got] == [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts] and [r.b for r in got] == [len((t or "").encode()) // 4 for t in texts]


def test_counters_and_latency(spark):
    rows = [("blocklist", True, 0, 0, "/a", "GET"), ("token_limit", True, 0, 0, "/a", "GET"), (None, False, 3, 1, "/b", "POST"), ("ml_error", True, 0, 0, "/a", "GET")]
    df = spark.createDataFrame(rows, "reason string, allowed boolean, pii_count long, lost long, path string, method string")
    got = {(r.counter, r.label): r.n for r in metrics.named_counters(df).collect()}
    assert got == {
        (metrics.BLOCKED, "blocklist"): 1, (metrics.BLOCKED, "ml_error"): 1, (metrics.TOO_LONG, ""): 1, (metrics.LIMITED, ""): 1, (metrics.DETECTED, ""): 3, (metrics.FAIL_OPEN, ""): 1,
        (metrics.REQUESTS, "GET /a"): 3, (metrics.REQUESTS, "POST /b"): 1,
    }
    values = spark.range(10_001).select((F.col("id") * 1.0).alias("v"), F.lit(200).alias("status"))
    s = metrics.latency_summary(values, "v", "status").first()
    assert (s.n, s.least, s.most) == (10_001, 0.0, 10_000.0) and abs(s.p95 - 9500) <= 2
    assert [(r.le, r.n) for r in metrics.latency_histogram(values, "v", [10, 1], "status").collect()] == [(1.0, 2), (10.0, 11), (None, 10_001)]


def test_written_folders_are_deleted_by_name(spark):
    cleanup(spark)
    df = materialise(spark.range(3), "probe")
    path = df.inputFiles()[0]
    assert cleanup(spark) == 1 and cleanup(spark) == 0
    with pytest.raises(Exception, match="(?i)not.*exist|not_found"):
        spark.read.parquet(path).count()


def test_public_names():
    import veilstream

    assert all(callable(getattr(veilstream, n)) for n in veilstream.__all__)
