"""Quality rules with thresholds from mergeable quantile sketches per language and source.

Every document gives base features and from them four rates. Rates, and the sizes that they are shares of, go into
sketches: counts of bins that keep the six leading bits of a value (values below 64 are exact, others are within
1/32). Bins of partial sketches add up, so a group of any size is one row per bin before the shuffle.

Sketches are kept for (language, source), for the language, and for everything. A group's quartiles are shrunk towards those
of its language, and these towards those of everything, as if PRIOR documents of the larger group had been added: a
small group follows its language, a large one itself, and nothing flips at any size.

A rate fails when it lies more than WIDTH spreads above the group's upper quartile; word lengths also fail as far below the lower
one. The spread is the distance of the quartiles, but at least what a single occurrence (a symbol, a line,
two windows) makes in a document of the group's median size: a rate can't be told more finely. For the same reason a document's
own rate is taken less one occurrence, and the spread grows for documents smaller than the median, by the root of the size. There
are no other limits: every fence comes from the sketches.

Defined results: a null text has no words and fails the base rule; null language and null source are groups of
their own; repeated rows count each; an empty table gives no rows; texts of any length are read whole, one at a time, in
time proportional to n log n of their words; input columns stay as they are (in ``base_features`` one with the name of a
feature is replaced by it).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstream.llm.texts import with_text
from veilstream.session import materialise, ship_package

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Documents of the larger group that a group's quartiles are shrunk with.
PRIOR = 20
UPPER = 0.75
MIDDLE = 0.5
LOWER = 0.25
WIDTH = 4
#: Rate: (numerator, denominator, parts of a whole, the numerator of one occurrence, whether low values fail too).
RATES = {
    "symbol_rate": ("n_symbols", "word_chars", 10_000, 1, False),
    "dup_line_rate": ("n_dup_lines", "n_lines", 10_000, 1, False),
    "repeat_rate": ("n_repeat_words", "n_words", 10_000, 2 * WINDOW, False),
    "word_length": ("word_chars", "n_words", 100, 0, True),
}
SIZES = sorted({x[1] for x in RATES.values()})
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long"
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\v\f\r"


def repeated_words(words: list[bytes], k: int = WINDOW) -> int:
    """Words that lie in k-word windows found twice or more."""
    n = len(words)
    if n < k + 1:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(number) == n:
        return 0
    code = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=n)
    bits = max(1, (len(number) - 1).bit_length())
    window, width, held = code[: n - k + 1].copy(), bits, 1
    while held < k:
        if width + bits > 62:  # rank what there is: codes stay exact
            window = np.unique(window, return_inverse=True)[1].astype(np.int64)
            width = max(1, int(window.max()).bit_length())
        window = window << bits | code[held : n - k + 1 + held]
        width, held = width + bits, held + 1
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(window), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(n + 1, dtype=np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + k, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def text_features(text: bytes | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_lines (lines with a word), n_repeat_words."""
    text = text or b""
    words = text.split()
    solid = text.translate(None, SPACE)
    chars = len(solid) if solid.isascii() else len(solid.decode("utf-8", "replace"))
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return len(words), chars, symbols, len(lines) - len(set(lines)), len(lines), repeated_words(words)


def base_features(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of ``keep`` (default: all but those with the name of a feature) and the base features of every document."""
    ship_package(docs.sparkSession)
    names = [f.split()[0] for f in FEATURES.split(", ")]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    rows, text_of = with_text(docs, text_col, keep)

    def features(batches):
        for batch in batches:
            found = np.array([text_features(t.as_py()) for t in text_of(batch)], dtype=np.int64).reshape(-1, len(names))
            arrays = [*batch.columns[: len(keep)]] + [pa.array(found[:, i].copy()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *names])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[F.col(f"`{c}`") for c in keep]).schema)
    return rows.mapInArrow(features, f"{kept}, {FEATURES}" if kept else FEATURES)


def with_rates(features: DataFrame) -> DataFrame:
    rate = lambda a, b, parts: F.when(F.col(b) > 0, F.expr(f"{a} * {parts} div {b}")).otherwise(F.lit(0).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return features.withColumns({"base_failed": failed} | {n: rate(*x[:3]) for n, x in RATES.items()})


def sketch_bin(value):
    """The least value of the bin: its six leading bits."""
    shift = F.greatest(F.lit(0), F.length(F.bin(value)) - 6)
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(rated: DataFrame) -> DataFrame:
    """lang, source, rate, bin, n: the mergeable sketch of each group; documents that fail the base rule have no part."""
    long = F.explode(F.array(*[F.struct(F.lit(n).alias("rate"), sketch_bin(F.col(n)).alias("bin")) for n in [*RATES, *SIZES]])).alias("x")
    return rated.where(~F.col("base_failed")).select("lang", "source", long).groupBy("lang", "source", "x.rate", "x.bin").agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Documents, lower quartile, median and upper quartile (bins) of each rate and size, for each group of ``by``."""
    from pyspark.sql import Window

    bins = sketch.groupBy(*by, "rate", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "rate")
    run = bins.select(*by, "rate", "bin", F.sum("n").over(group.orderBy("bin")).alias("upto"), F.sum("n").over(group).alias("n"))
    at = lambda q: F.min(F.when(F.col("upto") * 100 >= F.col("n") * round(100 * q), F.col("bin"))).cast("double")
    return run.groupBy(*by, "rate").agg(F.max("n").cast("double").alias("n"), at(LOWER).alias("low"), at(MIDDLE).alias("mid"), at(UPPER).alias("high"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row for each (lang, source) with low_, high_, spread_ and size_ of every rate.

    Sizes: groups times bins, never documents.
    """
    stats = ["low", "mid", "high"]
    named = lambda df, p: df.select(*[F.col(c).alias(c if c in ("lang", "source", "rate") and p == "f" else f"{p}_{c}") for c in df.columns])
    f, c, w = named(quantiles(sketch, ["lang", "source"]), "f"), named(quantiles(sketch, ["lang"]), "c"), named(quantiles(sketch, []), "w")
    joined = f.join(c, F.col("lang").eqNullSafe(F.col("c_lang")) & (F.col("rate") == F.col("c_rate"))).join(w, F.col("rate") == F.col("w_rate"))
    shrunk = lambda n, own, wider: (n * own + PRIOR * wider) / (n + PRIOR)
    coarse = lambda s: shrunk(F.col("c_n"), F.col(f"c_{s}"), F.col(f"w_{s}"))
    picked = joined.select("lang", "source", "rate", *[shrunk(F.col("f_n"), F.col(f"f_{s}"), coarse(s)).alias(s) for s in stats])
    of = lambda name, s: F.max(F.when(F.col("rate") == name, F.col(s)))
    wide = picked.groupBy("lang", "source").agg(
        *[of(n, s).alias(f"{s}_{n}") for n in RATES for s in ("low", "high")], *[of(x[1], "mid").alias(f"size_{n}") for n, x in RATES.items()]
    )
    least = lambda n, x: F.greatest(F.lit(1.0), F.lit(float(x[3] * x[2])) / F.greatest(F.lit(1.0), F.col(f"size_{n}")))
    return wide.withColumns({f"spread_{n}": F.greatest(F.col(f"high_{n}") - F.col(f"low_{n}"), least(n, x)) for n, x in RATES.items()})


def judge(rated: DataFrame, fences: DataFrame) -> DataFrame:
    """rated with ``kept``: false if base_failed, else whether every rate lies within the fences of its group.

    Skewed groups: the join is left to adaptive execution, which splits a hot group or broadcasts fences that are
    found to be small.
    """
    limits = fences.withColumnsRenamed({"lang": "__lang", "source": "__source"})
    own = F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source"))
    bad = F.lit(False)
    for n, (num, den, parts, one, both) in RATES.items():
        size = F.greatest(F.lit(1.0), F.col(den).cast("double"))
        value = F.greatest(F.lit(0.0), (F.col(num) - one).cast("double")) * float(parts) / size
        room = F.lit(float(WIDTH)) * F.col(f"spread_{n}") * F.sqrt(F.greatest(F.lit(1.0), F.col(f"size_{n}") / size))
        out = value > F.col(f"high_{n}") + room
        bad = bad | F.coalesce(out | (value < F.col(f"low_{n}") - room) if both else out, F.lit(False))
    joined = rated.join(limits, own, "left").withColumn("kept", ~(F.col("base_failed") | bad))
    return joined.drop(*limits.columns)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, features, rates, base_failed and kept of every document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    rated = materialise(with_rates(base_features(rows, keep=["doc_id", "lang", "source"])), "features")
    return judge(rated, materialise(thresholds(sketches(rated)), "fences"))


def quality_digest(judged: DataFrame) -> DataFrame:
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def filter_quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The documents that the rules keep, with their columns as they are.

    Texts are read twice and never shuffled unless the fences are too many to broadcast.
    """
    lean = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    fences = materialise(thresholds(sketches(with_rates(base_features(lean, keep=["lang", "source"])))), "fences")
    names = docs.columns
    shut = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__doc"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"))
    judged = judge(with_rates(base_features(shut, text_col=f"__doc.{text_col}", keep=["__doc", "lang", "source"])), fences)
    return judged.where("kept").select(*[F.col(f"__doc.`{c}`").alias(c) for c in names])


def quality_sql() -> str:
    """The same in DuckDB SQL."""
    rates = {n: f"CASE WHEN {b} > 0 THEN {a} * {parts} // {b} ELSE 0 END" for n, (a, b, parts, *_) in RATES.items()}
    long = " UNION ALL ".join(f"SELECT lang, source, '{n}' AS rate, {n} AS v FROM r WHERE NOT base_failed" for n in [*RATES, *SIZES])

    def stats(name: str, by: str) -> str:
        keys = f"{by}, " if by else ""
        at = lambda q: f"CAST(min(CASE WHEN upto * 100 >= n * {round(100 * q)} THEN bin END) AS DOUBLE)"
        return f"""{name} AS (SELECT {keys}rate, CAST(max(n) AS DOUBLE) AS n, {at(LOWER)} AS low, {at(MIDDLE)} AS mid, {at(UPPER)} AS high FROM (
    SELECT {keys}rate, bin, sum(c) OVER (PARTITION BY {keys}rate ORDER BY bin) AS upto, sum(c) OVER (PARTITION BY {keys}rate) AS n
    FROM (SELECT {keys}rate, bin, count(*) AS c FROM b GROUP BY ALL)) GROUP BY ALL)"""

    shrunk = lambda n, own, wider: f"(({n} * {own} + {PRIOR} * {wider}) / ({n} + {PRIOR}))"
    picked = ", ".join(f"{shrunk('fine.n', f'fine.{s}', shrunk('coarse.n', f'coarse.{s}', f'whole.{s}'))} AS {s}" for s in ("low", "mid", "high"))
    of = lambda name, s: f"max(CASE WHEN rate = '{name}' THEN {s} END)"
    wide = ", ".join([f"{of(n, s)} AS {s}_{n}" for n in RATES for s in ("low", "high")] + [f"{of(x[1], 'mid')} AS size_{n}" for n, x in RATES.items()])
    spread = ", ".join(f"greatest(high_{n} - low_{n}, greatest(CAST(1 AS DOUBLE), CAST({x[3] * x[2]} AS DOUBLE) / greatest(CAST(1 AS DOUBLE), size_{n}))) AS spread_{n}" for n, x in RATES.items())
    tests = []
    for n, (num, den, parts, one, both) in RATES.items():
        size = f"greatest(CAST(1 AS DOUBLE), CAST({den} AS DOUBLE))"
        value = f"greatest(CAST(0 AS DOUBLE), CAST({num} - {one} AS DOUBLE)) * CAST({parts} AS DOUBLE) / {size}"
        room = f"CAST({WIDTH} AS DOUBLE) * spread_{n} * sqrt(greatest(CAST(1 AS DOUBLE), size_{n} / {size}))"
        tests.append(f"coalesce({value} > high_{n} + {room}, false)")
        if both:
            tests.append(f"coalesce({value} < low_{n} - {room}, false)")
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
g AS (SELECT rid, i, array_to_string(words[i : i + {WINDOW - 1}], ' ') AS gram FROM (SELECT rid, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) > {WINDOW})),
d AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
c AS (SELECT rid, count(DISTINCT i + k) AS n FROM d, range({WINDOW}) AS o(k) GROUP BY rid),
f AS (SELECT w.rid, doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
    FROM w LEFT JOIN c ON c.rid = w.rid),
r AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, {', '.join(f'{x} AS {n}' for n, x in rates.items())} FROM f),
b AS (SELECT lang, source, rate, (v >> greatest(0, length(bin(v)) - 6)) << greatest(0, length(bin(v)) - 6) AS bin FROM ({long})),
{stats('fine', 'lang, source')},
{stats('coarse', 'lang')},
{stats('whole', '')},
p AS (SELECT fine.lang, fine.source, fine.rate, {picked}
    FROM fine JOIN coarse ON coarse.lang IS NOT DISTINCT FROM fine.lang AND coarse.rate = fine.rate JOIN whole ON whole.rate = fine.rate),
q AS (SELECT lang, source, {wide} FROM p GROUP BY lang, source),
l AS (SELECT *, {spread} FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({' OR '.join(tests)}) AS kept
FROM r LEFT JOIN l ON l.lang IS NOT DISTINCT FROM r.lang AND l.source IS NOT DISTINCT FROM r.source"""
