"""Prompt screening: blocked phrases, token limit, pluggable injection score."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from veilstream.functions.scalars import token_count

#: Phrases that block a prompt, in order of precedence.
PHRASES = [
    "ignore previous instructions",
    "ignore all previous instructions",
    "ignore the above instructions",
    "ignore your instructions",
    "ignore all prior instructions",
    "disregard previous instructions",
    "disregard all previous instructions",
    "disregard your instructions",
    "forget previous instructions",
    "forget all previous instructions",
    "forget your instructions",
    "override instructions",
    "override your instructions",
    "new instructions:",
    "updated instructions:",
    "replace your instructions",
    "your new task is",
    "from now on you will",
    "stop being an ai",
    "act as if you have no restrictions",
    "pretend you have no restrictions",
    "pretend you are not an ai",
    "you are now in developer mode",
    "enter developer mode",
    "enable developer mode",
    "act as an unrestricted ai",
    "jailbreak",
    "dan mode",
    "do anything now",
    "you are now jailbroken",
    "bypass your filters",
    "bypass content filter",
    "bypass safety",
    "output your system instructions",
    "reveal your instructions",
    "show your system prompt",
    "print your system prompt",
    "repeat your system prompt",
    "what is your system prompt",
    "display your instructions",
    "system prompt:",
    "reveal your rules",
    "what are your rules",
    "output your initial prompt",
    "base64 decode",
    "decode the following",
    "translate from hex",
    "rot13",
]
#: Invisible characters that are dropped.
ZERO_WIDTH = "\u200b\u200c\u200d\u200e\u200f\ufeff\u2060\u00ad"


def normalise(text: Column, nfkc: bool = True) -> Column:
    """Without invisible characters, in NFKC, in lower case. NFKC is an Arrow function: Spark has none built in."""
    stripped = F.translate(text, ZERO_WIDTH, "")
    if not nfkc:
        return F.lower(stripped)

    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        import unicodedata

        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return F.lower(fold(stripped))


def blocked_phrase(normalised: Column) -> Column:
    """The first phrase of the list that the text contains."""
    out = F.when(F.contains(normalised, F.lit(PHRASES[0])), PHRASES[0])
    for p in PHRASES[1:]:
        out = out.when(F.contains(normalised, F.lit(p)), p)
    return out


def injection(logits: Column) -> Column:
    """Whether the second of two logits is greater; false for any other shape."""
    return F.coalesce((F.size(logits) == 2) & (logits[1] > logits[0]), F.lit(False))


def preflight(phrase: Column, injected: Column, text: Column, max_tokens: int, failed: Column | None = None, fail_open: bool = False) -> dict[str, Column]:
    """verdict and reason: empty texts pass; then blocked phrase, injection score, token limit (0: none)."""
    over = (token_count(text) > max_tokens) if max_tokens else F.lit(False)
    failed = F.lit(False) if failed is None else failed
    reason = F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(None).cast("string")).when(phrase.isNotNull(), "blocklist")
    reason = reason if fail_open else reason.when(failed, "ml_error")
    reason = reason.when(injected, "ml").when(over, "token_limit")
    return {"verdict": F.when(reason.isNull(), "pass").otherwise("block"), "reason": reason}


def score_with(texts: Column, load: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Column:
    """Logits of a scorer; ``load`` runs once in each task."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = load()
        for batch in batches:
            yield pd.Series(scorer(["" if t is None else t for t in batch]))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<float>")(texts)
