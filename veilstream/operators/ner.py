"""Decoding of token labels into entities."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Label order of the model's outputs.
LABELS = ["O", "B-MISC", "I-MISC", "B-PER", "I-PER", "B-ORG", "I-ORG", "B-LOC", "I-LOC"]


def argmax(logits: Column) -> Column:
    """Position, from 0, of the first greatest value."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("long")


def label_of(logits: Column) -> Column:
    return F.try_element_at(F.array(*map(F.lit, LABELS)), (argmax(logits) + 1).cast("int"))


def bio_spans(tokens: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """Entities (doc, label, start, end, n_tokens) of labelled tokens (doc, pos, label, start, end).

    ``B-`` starts an entity, ``I-`` of the same type goes on with it and starts one otherwise, ``O`` ends it. Labelled tokens of no width are
    passed over and end nothing. Islands are found by a running sum of starts over the tokens of a document.
    """
    shown = tokens.where((F.col("label") == "O") | (F.col("start") != F.col("end")))
    kind = F.when(F.col("label") == "O", "").otherwise(F.substring("label", 3, 100))
    inside = F.col("label").startswith("I-")
    order = Window.partitionBy(doc_col).orderBy("pos")
    typed = shown.withColumn("kind", kind).withColumn("before", F.coalesce(F.lag("kind").over(order), F.lit("")))
    fresh = typed.withColumn("fresh", F.when(inside & (F.col("before") == F.col("kind")), 0).otherwise(1))
    islands = fresh.withColumn("island", F.sum("fresh").over(order)).where("kind <> ''")
    out = islands.groupBy(doc_col, "island").agg(F.first("kind").alias("label"), F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_tokens"))
    return out.select(doc_col, "label", "start", "end", "n_tokens")


def entity_scorer(load: Callable[[], Callable[[list[str]], list[list[tuple[int, int, list[float]]]]]]) -> Callable[[Column], Column]:
    """A scorer for ``redact``: ``load`` runs once in each task and gives a function from texts to their tokens (start, end, logits).

    Labels are the first greatest logits, and tokens become entities as in bio_spans; offsets are in characters.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            texts = ["" if t is None else t for t in batch]
            yield pd.Series([spans_of([(a, b, LABELS[max(range(len(x)), key=x.__getitem__)]) for a, b, x in tokens]) for tokens in model(texts)])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<struct<start:int,end:int,label:string>>")


def spans_of(tokens: list[tuple[int, int, str]]) -> list[dict]:
    """Entities of one text's labelled tokens (start, end, label), in order."""
    out, open_ = [], None
    for start, end, label in tokens:
        if label == "O":
            open_ = None
        elif start == end:
            continue
        elif label.startswith("I-") and open_ is not None and open_["label"] == label[2:]:
            open_["end"] = end
        else:
            open_ = {"start": start, "end": end, "label": label[2:]}
            out.append(open_)
    return out


def allowed_entities(entities: DataFrame, labels: list[str], length: Column | None = None) -> DataFrame:
    """Entities of the labels that the policy names, that lie within their text."""
    kept = entities.where(F.col("label").isin(labels))
    return kept if length is None else kept.where(F.col("end") <= length)


def replace_entities(text: Column, entities: Column) -> Column:
    """text with entities (start, end, synthetic) replaced right to left; offsets in characters."""
    ordered = F.reverse(F.array_sort(entities, lambda a, b: a["start"] - b["start"]))
    return F.aggregate(ordered, text, lambda acc, e: F.concat(F.substring(acc, 1, e["start"]), e["synthetic"], F.substring(acc, e["end"] + 1, F.length(acc))))
