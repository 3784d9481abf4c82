"""Counts and summaries for audits and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Categories that an audit row itemises; all others count in the total alone.
AUDITED = ["EMAIL", "CC", "IP", "SSN", "APIKEY", "PHONE", "NER"]


def category_counts(redacted: DataFrame) -> DataFrame:
    """category, n_texts, n over all texts."""
    # An outer explode computes the map once; an inner one would test its size first.
    long = redacted.select(F.explode_outer("pii_counts").alias("category", "n")).where("category is not null")
    return long.groupBy("category").agg(F.count("*").alias("n_texts"), F.sum("n").alias("n"))


def merged_counts(redacted: DataFrame, key: str) -> DataFrame:
    """Counts of the texts of one key, added up by category."""
    return redacted.select(key, F.explode_outer("pii_counts").alias("category", "n")).where("category is not null").groupBy(key, "category").agg(F.sum("n").alias("n"))


def audit(redacted: DataFrame, key: str) -> DataFrame:
    """One row for every key with personal data: a column for each audited category, and the total."""
    count = lambda c: F.sum(F.coalesce(F.try_element_at("pii_counts", F.lit(c)), F.lit(0))).cast("long").alias(c.lower())
    # A filter on the texts would go below their projections and run every stage twice.
    return redacted.groupBy(key).agg(*[count(c) for c in AUDITED], F.sum("pii_count").alias("total")).where("total > 0")


def counters(df: DataFrame, *labels: str) -> DataFrame:
    return df.groupBy(*labels).agg(F.count("*").alias("n"))


#: Counters and what they count.
BLOCKED, TOO_LONG, LIMITED, DETECTED, FAIL_OPEN, REQUESTS = "shield_blocked_total", "token_limit_exceeded_total", "rate_limited_total", "pii_detections_total", "fail_open_events_total", "http_requests_total"


def named_counters(requests: DataFrame) -> DataFrame:
    """counter, label, n of requests (reason of the preflight verdict, allowed by the limiter, pii_count, lost by failing open, path, method); columns that are absent count nothing."""
    have, one = set(requests.columns), F.lit(1).cast("long")
    event = lambda counter, label, n: F.struct(F.lit(counter).alias("counter"), label.alias("label"), n.cast("long").alias("n"))
    events = []
    if "reason" in have:
        events += [F.when(F.col("reason").isin("blocklist", "ml", "ml_error"), event(BLOCKED, F.col("reason"), one)), F.when(F.col("reason") == "token_limit", event(TOO_LONG, F.lit(""), one))]
    if "allowed" in have:
        events.append(F.when(~F.col("allowed"), event(LIMITED, F.lit(""), one)))
    for column, counter in (("pii_count", DETECTED), ("lost", FAIL_OPEN)):
        if column in have:
            events.append(event(counter, F.lit(""), F.col(column)))
    if {"path", "method"} <= have:
        events.append(event(REQUESTS, F.concat_ws(" ", "method", "path"), one))
    # No filter on the texts: it would go below their projections and run every stage twice.
    return requests.select(F.explode_outer(F.array(*events)).alias("e")).groupBy("e.counter", "e.label").agg(F.sum("e.n").alias("n")).where("n > 0")


def latency_summary(df: DataFrame, value: str, *labels: str) -> DataFrame:
    """n, total, least, most and p95 (by a mergeable sketch, within one part in ten thousand of the rank)."""
    v = F.col(value)
    return df.groupBy(*labels).agg(F.count(v).alias("n"), F.round(F.sum(v), 4).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"), F.percentile_approx(v, 0.95, 10_000).alias("p95"))


def latency_histogram(df: DataFrame, value: str, edges: list[float], *labels: str) -> DataFrame:
    """labels, le, n: how many values are at most each edge (le), and at last all of them (le null), as histograms are exported."""
    v = F.col(value)
    upto = [F.struct(F.lit(float(e)).alias("le"), F.sum((v <= e).cast("long")).alias("n")) for e in sorted(edges)] + [F.struct(F.lit(None).cast("double").alias("le"), F.count(v).alias("n"))]
    return df.groupBy(*labels).agg(F.array(*upto).alias("b")).select(*labels, F.inline("b"))
