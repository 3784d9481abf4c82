"""Handing texts to Arrow functions without a second copy."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_text(docs: DataFrame, text_col: str, keep: list[str]):
    """(rows, text_of): the columns of keep, and a function from an Arrow batch of them to its texts as bytes.

    A string column that is kept, or a string field ``struct.field`` of a kept struct, is read where it is; any other
    text becomes a column at the end.
    """
    kept = [F.col(f"`{c}`") for c in keep]
    holder, _, inner = text_col.partition(".")
    if inner and holder in keep and docs.select(F.col(f"{holder}.`{inner}`")).dtypes[0][1] == "string":
        at = keep.index(holder)
        return docs.select(*kept), lambda batch: batch.column(at).field(inner).cast(pa.binary())
    if not inner and text_col in keep and dict(docs.dtypes)[text_col] == "string":
        at = keep.index(text_col)
        return docs.select(*kept), lambda batch: batch.column(at).cast(pa.binary())
    text = F.col(f"{holder}.`{inner}`") if inner else F.col(text_col)
    return docs.select(*kept, text.cast("string").cast("binary").alias("__text")), lambda batch: batch.column(len(keep))
