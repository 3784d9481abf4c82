"""Restoring texts whose later stages matched over the tokens of earlier ones, and values whose tokens are the same."""

import pytest
from pyspark.sql import functions as F

from veilstream.functions import scalars as X
from veilstream.operators import mapping, redact

KEY = "an-example-key-of-more-than-32-bytes"
# The address's token ends in 93, which the phone number's match takes along.
CUT = "of.92@mail6.example.com 5755695738806562 Of onshin the thnd."


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, CUT), (2, f"{CUT} then {CUT} 123-45-6789"), (3, None), (4, "a@b.co")], "id long, text string")


def test_tokens_cut_by_later_stages_are_restored(spark, docs):
    made = redact.redact(docs)
    assert "EMAIL_b2b93a93" not in made.where("id = 1").first().redacted
    assert all(r.x == r.text for r in made.select("text", redact.unmask(F.col("redacted"), F.col("substitutions")).alias("x")).collect())


def test_values_cut_by_later_stages_are_protected(spark, docs):
    answer = F.concat("redacted", F.lit(" new@x.org"))
    got = redact.redact(docs).select("text", redact.egress_protected(answer, F.col("substitutions")).alias("x")).collect()
    assert all(r.x == (r.text and f"{r.text} [REDACTED]") for r in got)


def test_realistic_values_cut_by_later_stages_are_restored(spark, docs):
    made, _ = mapping.redact_mapped(docs, "text", KEY, F.lit("2024-01-01").cast("timestamp"), 60)
    got = made.select("text", "substitutions", redact.unmask(F.col("redacted"), F.col("substitutions")).alias("x")).collect()
    assert all(r.x == r.text for r in got) and any(s.synthetic.endswith("@example.com") for r in got for s in r.substitutions)


def test_a_value_that_begins_another(spark):
    row = spark.createDataFrame([("at 10.1.2.34, 10.1.2.3", [("10.1.2.3", "a"), ("10.1.2.34", "b")])], "t string, s array<struct<synthetic:string,real:string>>")
    assert row.select(redact.unmask(F.col("t"), F.col("s")).alias("x")).first().x == "at b, a"


def test_a_token_of_two_values(spark):
    """Two names with the token PER_042ed623: each owner reads its own, and nobody gets another's."""
    names = spark.createDataFrame([(1, "Customer#000561719"), (2, "Customer#000845103"), (2, "Customer#000845103"), (3, "x"), (4, "x"), (5, None)], "owner long, real string")
    names = names.select("owner", "real", F.lit("PER").alias("category"), F.sha2("real", 256).alias("real_hash"), X.synthetic_id("PER", F.col("real")).alias("synthetic"))
    now = F.lit("2024-01-01").cast("timestamp")
    own = mapping.build_mapping(names.where("owner <> 4").drop("synthetic"), KEY, now, 60, scope=("owner",))
    read = lambda *a, **k: sorted((r.real for r in mapping.read_mapping(*a, **k).collect()), key=str)
    assert read(own, names, KEY, scope=("owner",)) == ["Customer#000561719", "Customer#000845103", "Customer#000845103", None, None, "x"]
    assert read(own, names, KEY) == [None, None, None, None, "x", "x"]
