"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is its letters, lower-cased, other characters counting as one gap. Its subwords are all 1- to 4-grams of
letters within words, with a gap at one end at most, hashed into BUCKETS rows of an embedding
table. The mean of the rows goes through a linear softmax. Table and weights are trained together by
stochastic gradient descent in numpy.

The fit takes at most SAMPLE_ROWS labelled rows (or ROWS_EACH for each language, if that is more), dealt evenly over languages and
drawn by a hash of id and text, whole texts each; for every row it also learns from one short stretch, so that short
texts are judged as well. Workers count the subwords; the driver gets counts, at most BUCKETS of them a row, and no texts. A fifth of the rows is held back to calibrate: a temperature that makes the
probabilities fit, and a rejection bound that at most REJECT_RATE of the rightly named texts fall
below.

Prediction covers every whole text, in Arrow batches, by numpy, in runs of CHUNK characters. As averaging is linear, the product of table and
weights does for few languages; with more than DIMENSIONS the two stay apart, so a model has at most
(BUCKETS + languages) x DIMENSIONS floats.

Defined results: null and letterless texts are ``und`` with score 0 and rejected; ties go to the first
language in order; repeated rows are judged each; without labelled rows every text is ``und``;
input columns stay as they are.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstream.llm.texts import with_text
from veilstream.session import ship_package

#: Most labelled rows that a fit takes, over all languages.
SAMPLE_ROWS = 2400
ROWS_EACH = 20
BUCKETS = 1 << 15
DIMENSIONS = 16
MAX_N = 4
EPOCHS = 4
RATE = 0.5
REJECT_RATE = 0.001
UNKNOWN = "und"
#: Characters that are taken together.
CHUNK = 1 << 19
SEED = 7

_tables: dict = {}


def _letters() -> np.ndarray:
    """Lower-case letter of every code point, 0 for what is no letter."""
    if "letters" not in _tables:
        low = np.zeros(0x110000, dtype=np.uint32)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                small = c.lower()
                low[cp] = ord(small) if len(small) == 1 else cp
        _tables["letters"] = low
    return _tables["letters"]


def _stream(text: bytes) -> np.ndarray:
    """Letters of a UTF-8 text with one 0 for every gap and at both ends."""
    cps = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    low = _letters()[cps]
    keep = low != 0
    keep[1:] |= keep[:-1]
    low = low[keep]
    return np.concatenate(([0], low, [0])) if len(low) and low[-1] else np.concatenate(([0], low))


def _grams(stream: np.ndarray):
    """(bucket, position) of all subwords: a gap stands only at the ends of one."""
    gap = stream == 0
    code = stream.astype(np.uint64) + np.uint64(1)
    h = np.zeros(len(stream), dtype=np.uint64)
    inner = np.zeros(len(stream), dtype=bool)
    for n in range(1, MAX_N + 1):
        m = len(stream) - n + 1
        if m <= 0:
            break
        if n > 2:
            inner = inner[:m] | gap[n - 2 : n - 2 + m]
        h = (h[:m] ^ code[n - 1 : n - 1 + m]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        fit = ~inner[:m] & ~(gap[:m] if n == 1 else gap[:m] & gap[n - 1 : n - 1 + m])
        at = np.flatnonzero(fit)
        yield (h[at] >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), at


def subwords(text: bytes) -> np.ndarray:
    stream = _stream(text)
    return np.concatenate([b for b, _ in _grams(stream)]) if stream.any() else np.zeros(0, dtype=np.int64)


class LanguageModel:
    """Embedding table (buckets x dimensions) and weights (dimensions x languages; None if the table is their product), bias, temperature and rejection bound."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, weights: np.ndarray | None = None, temperature: float = 1.0, bound: float = 0.0):
        self.languages, self.table, self.weights, self.bias, self.temperature, self.bound = languages, table, weights, bias, temperature, bound

    def outputs(self, means: np.ndarray) -> np.ndarray:
        """Logits, before the temperature, of averaged rows of the table."""
        return (means if self.weights is None else means @ self.weights) + self.bias

    def logits(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Logits of every text, and how many subwords it has."""
        sums, counts = np.zeros((len(texts), self.table.shape[1])), np.zeros(len(texts), dtype=np.int64)
        k = 0
        while k < len(texts):
            streams, size, first = [], 0, k
            while k < len(texts) and size < CHUNK:
                streams.append(_stream(texts[k] or b""))
                size += len(streams[-1])
                k += 1
            # Every text starts with a gap, so no subword runs from one into the next but through that gap.
            both = np.concatenate(streams)
            starts = np.concatenate(([0], np.cumsum([len(s) for s in streams])))
            for buckets, at in _grams(both):
                cut = np.searchsorted(at, starts)
                rows = np.flatnonzero(np.diff(cut))
                if len(rows):
                    sums[first + rows] += np.add.reduceat(self.table[buckets], cut[rows], axis=0, dtype=np.float64)
                    counts[first + rows] += np.diff(cut)[rows]
        return self.outputs(sums / np.maximum(counts, 1)[:, None]) / self.temperature, counts

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is rejected, for every text."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        logits, counts = self.logits(texts)
        p = _softmax(logits)
        best, known = p.argmax(axis=1), counts > 0
        score = np.where(known, p[np.arange(len(texts)), best], 0.0)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)], score, ~known | (score < self.bound)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def examples_of(text: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, their shares) of a whole text and of one short stretch of it, drawn by the text itself."""
    rng, out = np.random.default_rng(zlib.crc32(text)), []
    a = int(rng.integers(0, max(1, len(text) - 30)))
    for part in (text, text[a : a + int(rng.integers(20, 240))]):
        grams = subwords(part)
        if len(grams):
            b, n = np.unique(grams, return_counts=True)
            out.append((b, (n / n.sum()).astype(np.float32)))
    return out


def labelled_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS) -> list[tuple[str, list]]:
    """(language, examples) of at most about ``rows`` labelled texts, as many of each language as far as there are, by a hash of id and text."""
    spark = docs.sparkSession
    ship_package(spark)
    named = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = named.groupBy(F.col(lang_col).cast("string").alias("lang")).count().collect()
    if not counts:
        return []
    each = max(rows / len(counts), ROWS_EACH)
    shares = spark.createDataFrame([(r["lang"], min(1.0, each / r["count"])) for r in counts], "lang string, share double")
    # One row for each language; the id takes part in the draw, so that a large group of copies is thinned like other rows.
    lean = named.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("draw"))
    drawn = lean.join(F.broadcast(shares), "lang").where(F.pmod("draw", F.lit(1 << 20)) < F.col("share") * (1 << 20))

    def count(batches):
        for batch in batches:
            for lang, draw, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                for i, (b, share) in enumerate(examples_of(text.as_py())):
                    yield pa.RecordBatch.from_pylist([{"lang": lang, "draw": draw, "part": i, "buckets": b.astype("<u4").tobytes(), "shares": share.astype("<f4").tobytes()}])

    got = drawn.select("lang", "draw", F.col("text").cast("binary")).mapInArrow(count, "lang string, draw long, part long, buckets binary, shares binary").collect()
    out: dict[tuple, list] = {}
    for r in sorted(got, key=lambda r: (r["lang"], r["draw"], r["part"], bytes(r["buckets"]), bytes(r["shares"]))):
        out.setdefault((r["lang"], r["draw"]), []).append((np.frombuffer(r["buckets"], "<u4").astype(np.int64), np.frombuffer(r["shares"], "<f4")))
    return [(lang, parts) for (lang, _), parts in out.items()]


def fit(sample: list[tuple[str, list]], seed: int = SEED) -> LanguageModel:
    """Train on labelled examples; the same sample gives the same model."""
    languages = sorted({lang for lang, _ in sample})
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    rng = np.random.default_rng(seed)
    number = {lang: i for i, lang in enumerate(languages)}
    examples = [(b, share, number[sample[i][0]]) for i in rng.permutation(len(sample)) for b, share in sample[i][1]]
    held, train = examples[: len(examples) // 5], examples[len(examples) // 5 :]
    table = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights, bias = np.zeros((DIMENSIONS, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    steps, step = EPOCHS * len(train), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(train)):
            b, share, y = train[i]
            rate = RATE * (1 - step / steps)
            step += 1
            mean = share @ table[b]
            error = _softmax(mean @ weights + bias)
            error[y] -= 1
            back = weights @ error
            weights -= rate * np.outer(mean, error)
            bias -= rate * 0.1 * error
            # A row moves by its share; the factor makes up for the many rows of a text.
            table[b] -= (rate * len(b) ** 0.5) * share[:, None] * back[None, :]
    few = len(languages) <= DIMENSIONS
    model = LanguageModel(languages, (table @ weights).astype(np.float32) if few else table, bias.astype(np.float64), None if few else weights)
    _calibrate(model, held or train)
    return model


def _calibrate(model: LanguageModel, held: list) -> None:
    if not held:
        return
    logits = np.array([model.outputs((share @ model.table[b])[None, :])[0] for b, share, _ in held], dtype=np.float64)
    y = np.array([e[2] for e in held])
    grid = np.geomspace(0.5, 20, 61)
    loss = [-np.log(_softmax(logits / t)[np.arange(len(y)), y] + 1e-300).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = _softmax(logits / model.temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == y]
    # Never above one half: what is more likely right than wrong stays.
    model.bound = float(min(0.5, np.quantile(right, REJECT_RATE))) if len(right) else 0.0


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of ``keep`` (default: all) with lang_pred, score and rejected, which replace columns of these names."""
    spark = docs.sparkSession
    ship_package(spark)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score", "rejected")]
    shared = spark.sparkContext.broadcast(model)
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    rows, text_of = with_text(docs, text_col, keep)

    def judge(batches):
        for batch in batches:
            lang, score, rejected = shared.value.predict(text_of(batch).to_pylist())
            arrays = [*batch.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "lang_pred", "score", "rejected"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema)
    return rows.mapInArrow(judge, f"{schema}lang_pred string, score double, rejected boolean")


def held_out(id_col: str = "doc_id"):
    """Rows that no fit may see: crc32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_digest(docs: DataFrame) -> DataFrame:
    model = fit(labelled_sample(docs.where(~held_out())))
    marked = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify(marked, model, keep=["doc_id", "held_out"])


def filter_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents whose language is told with confidence, with their columns as they are."""
    model = fit(labelled_sample(docs.where(~held_out(id_col)), id_col, text_col, lang_col))
    names = docs.columns
    shut = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__doc"))
    judged = identify(shut, model, text_col=f"__doc.{text_col}", keep=["__doc"])
    return judged.where("not rejected").select(*[F.col(f"__doc.`{c}`").alias(c) for c in names])
