"""The mapping between real and synthetic values: a keyed table with expiry, built set-wise.

The key is the hash of the real value, over all texts: the first category that sees a value decides its synthetic value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from veilstream.config import CustomPattern, Policy
from veilstream.functions.scalars import decrypt, encrypt, synthetic_id
from veilstream.operators.redact import NER, REDACTED, SUBS, redact, unmask
from veilstream.session import materialise

ENTRY = "real_hash string, synthetic string, real_enc string, created_at timestamp, expires_at timestamp"
ENTITY_LABELS = ["PER", "LOC", "ORG"]

#: Categories that get realistic fakes in realistic mode.
REALISTIC = ["EMAIL", "PER", "IP", "PHONE"]
GIVEN = ["Alice", "Bruno", "Carla", "David", "Elena", "Felix", "Greta", "Hugo", "Irene", "Jonas", "Klara", "Louis", "Maria", "Nora", "Oscar", "Paula"]
FAMILY = ["Adler", "Berger", "Costa", "Dupont", "Evans", "Fischer", "Garcia", "Hansen", "Ivanov", "Jensen", "Keller", "Lopez", "Moreau", "Novak", "Olsen", "Peters"]


def distinct_values(redacted: DataFrame, order_col: str, subs_col: str = "substitutions") -> DataFrame:
    """real, real_hash, category: each value once, with the category of its first appearance (order_col, then place)."""
    found = redacted.select(F.col(order_col).alias("__order"), F.posexplode_outer(subs_col).alias("__at", "s")).where("s is not null")
    first = found.groupBy(F.col("s.real").alias("real")).agg(F.min_by("s.category", F.struct("__order", "__at")).alias("category"))
    return first.withColumn("real_hash", F.sha2("real", 256))


def fake_value(category: Column, real_hash: Column, ordinal: Column) -> Column:
    """A realistic value made from the hash; ordinal tells apart values whose hashes give the same fake."""
    n = lambda a, size: F.conv(F.substring(real_hash, a, size), 16, 10).cast("long")
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at % len(names) + 1).cast("int"))
    suffix = F.when(ordinal > 0, ordinal.cast("string")).otherwise("")
    number = lambda x, width: F.lpad(x.cast("string"), width, "0")
    email = F.concat(F.lower(pick(GIVEN, n(1, 4))), F.lit("."), F.lower(pick(FAMILY, n(5, 4))), F.substring(real_hash, 9, 6), suffix, F.lit("@example.com"))
    ip = F.concat(F.lit("10."), (n(1, 2)).cast("string"), F.lit("."), n(3, 2).cast("string"), F.lit("."), ((n(5, 2) + ordinal) % 256).cast("string"))
    phone = F.concat(F.lit("+1-555-"), number(n(1, 6) % 1000, 3), F.lit("-"), number((n(7, 6) + ordinal) % 10000, 4))
    person = F.concat(pick(GIVEN, n(1, 4)), F.lit(" "), pick(FAMILY, n(5, 4)), F.when(ordinal > 0, F.concat(F.lit(" "), ordinal.cast("string"))).otherwise(""))
    return F.when(category == "EMAIL", email).when(category == "IP", ip).when(category == "PHONE", phone).when(category == "PER", person)


def with_synthetic(values: DataFrame, realistic: bool = False) -> DataFrame:
    """values with column synthetic. Realistic fakes of one category never coincide."""
    token = synthetic_id(F.col("category"), F.col("real"))
    if not realistic:
        return values.withColumn("synthetic", token)
    from pyspark.sql import Window

    base = fake_value(F.col("category"), F.col("real_hash"), F.lit(0))
    same = Window.partitionBy("category", "__base").orderBy("real_hash")
    ranked = values.withColumn("__base", base).withColumn("__ordinal", F.when(F.col("__base").isNotNull(), F.row_number().over(same) - 1))
    # What clashes falls back to the token, which is never the fake of another value.
    return ranked.withColumn("synthetic", F.when(F.col("__ordinal") == 0, F.col("__base")).otherwise(token)).drop("__base", "__ordinal")


def build_mapping(values: DataFrame, key: str, created_at: Column, ttl_seconds: int, realistic: bool = False, scope: tuple[str, ...] = ()) -> DataFrame:
    """real_hash, synthetic, real_enc, created_at, expires_at. ``scope`` names columns of values (such as a request) that go along: a
    token's eight digits tell few values apart, not all values of all texts."""
    return _entries(with_synthetic(values, realistic), key, created_at, ttl_seconds, scope)


def _entries(made: DataFrame, key: str, created_at: Column, ttl_seconds: int, scope: tuple[str, ...] = ()) -> DataFrame:
    expires = (created_at + F.make_dt_interval(secs=F.lit(ttl_seconds))).alias("expires_at")
    return made.select(*scope, "real_hash", "synthetic", encrypt(F.col("real"), key).alias("real_enc"), created_at.alias("created_at"), expires)


def live(mapping: DataFrame, now: Column) -> DataFrame:
    """Entries that have not expired; reading one does not prolong it."""
    return mapping.where(F.col("expires_at") > now)


def get_or_create(mapping: DataFrame, values: DataFrame, key: str, now: Column, ttl_seconds: int, realistic: bool = False) -> DataFrame:
    """The mapping with entries for all values (real, real_hash, category): what is there and live stays, the rest is made.

    A fake that the mapping has for another value is not given again: the value gets its token.
    """
    have = live(mapping, now)
    fresh = with_synthetic(values.join(have.select("real_hash"), "real_hash", "left_anti"), realistic)
    if realistic:
        taken = have.select("synthetic", F.lit(True).alias("__taken")).dropDuplicates(["synthetic"])
        fresh = fresh.join(taken, "synthetic", "left").withColumn("synthetic", F.when(F.col("__taken"), synthetic_id(F.col("category"), F.col("real"))).otherwise(F.col("synthetic")))
    return have.unionByName(_entries(fresh, key, now, ttl_seconds))


def load_mapping(spark: SparkSession, path: str) -> DataFrame:
    """The last snapshot of a mapping's folder; empty where there is none."""
    kept = spark.createDataFrame([], f"{ENTRY}, snapshot int")
    try:
        kept = spark.read.schema(kept.schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    last = kept.agg(F.max("snapshot")).first()[0]
    return kept.where(F.col("snapshot") == (last or 0)).drop("snapshot")


def save_mapping(mapping: DataFrame, path: str) -> None:
    """A new snapshot beside the others, which stay for readers that hold them. One writer at a time."""
    spark = mapping.sparkSession
    try:
        last = spark.read.schema(f"{ENTRY}, snapshot int").parquet(path).agg(F.max("snapshot")).first()[0]
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        last = None
    mapping.select(*[f.split()[0] for f in ENTRY.split(", ")]).write.parquet(f"{path.rstrip('/')}/snapshot={(last or 0) + 1}")


def apply_mapping(values: DataFrame, mapping: DataFrame, fail_open: bool = False) -> DataFrame:
    """values with their synthetic value; a value without an entry becomes [REDACTED] (fail open) or fails the job."""
    joined = values.join(mapping.select("real_hash", F.col("synthetic").alias("mapped")), "real_hash", "left")
    lost = F.lit("[REDACTED]") if fail_open else F.raise_error("a value has no mapping").cast("string")
    return joined.withColumn("synthetic", F.coalesce("mapped", lost)).drop("mapped")


def read_mapping(mapping: DataFrame, synthetics: DataFrame, key: str, scope: tuple[str, ...] = ()) -> DataFrame:
    """synthetic and real, one row for each requested synthetic value; what can't be decrypted is a miss.

    With ``scope`` (columns of both sides) entries of the same scope count alone. A synthetic value that stands for different
    values there is a miss too: it can't be told whose it is.
    """
    by = [*scope, "synthetic"]
    entries = mapping.groupBy(*by).agg(F.when(F.min("real_hash") == F.max("real_hash"), F.min("real_enc")).alias("real_enc"))
    return synthetics.select(*by).join(entries, by, "left").select("synthetic", decrypt(F.col("real_enc"), key).alias("real"))


def redact_mapped(
    df: DataFrame,
    text_col: str,
    key: str,
    now: Column,
    ttl_seconds: int,
    mapping: DataFrame | None = None,
    realistic: bool = True,
    create: bool = True,
    fail_open: bool = False,
    policy: Policy = Policy(),
    custom: tuple[CustomPattern, ...] = (),
    entities: Callable[[Column], Column] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(df redacted as by ``redact`` but with the mapping's synthetic values, the mapping with all values).

    Texts are redacted with tokens and written; their distinct values go through ``get_or_create``; then each text's tokens are
    replaced by what the mapping has. Without ``create`` (a store that can't be written) values that it lacks fail the job, or become
    [REDACTED] if ``fail_open``: no count, no substitution, and one more in column ``lost``.
    """
    made = materialise(redact(df, text_col, policy, custom, entities=entities).withColumn("__row", F.monotonically_increasing_id()), "redacted")
    have = df.sparkSession.createDataFrame([], ENTRY) if mapping is None else mapping
    store = get_or_create(have, distinct_values(made, "__row"), key, now, ttl_seconds, realistic) if create else live(have, now)
    store = materialise(store, "mapping")
    found = made.select("__row", F.posexplode("substitutions").alias("__at", "s")).withColumn("real_hash", F.sha2("s.real", 256))
    met = found.join(store.select("real_hash", F.col("synthetic").alias("__new")), "real_hash", "left")
    lost = F.lit(REDACTED) if fail_open else F.raise_error("a value has no mapping").cast("string")
    pair = F.struct("__at", F.col("s.synthetic").alias("token"), F.coalesce("__new", lost).alias("synthetic"), F.col("s.real").alias("real"), F.col("s.category").alias("category"), F.col("__new").isNull().alias("lost"))
    # A text's substitutions, which its length bounds.
    pairs = met.groupBy("__row").agg(F.array_sort(F.collect_list(pair)).alias("__pairs"))
    out = made.join(pairs, "__row", "left").withColumn("__pairs", F.coalesce("__pairs", F.array().cast("array<struct<__at:int,token:string,synthetic:string,real:string,category:string,lost:boolean>>")))
    kept = F.filter("__pairs", lambda p: ~p["lost"])
    group = lambda p: F.when(p["category"].isin(ENTITY_LABELS), NER).otherwise(p["category"])
    n = lambda c: F.size(F.filter(kept, lambda p: group(p) == c)).cast("long")
    counts = F.transform(F.array_distinct(F.transform(kept, group)), lambda c: F.struct(c.alias("key"), n(c).alias("value")))
    tokens = F.transform("__pairs", lambda p: F.struct(p["token"].alias("synthetic"), p["synthetic"].alias("real")))
    out = out.withColumns(
        {
            "redacted": unmask(F.col("redacted"), tokens, strip=False),
            "substitutions": F.transform(kept, lambda p: F.struct(p["synthetic"], p["real"], p["category"])).cast(SUBS),
            "pii_counts": F.map_from_entries(counts),
            "pii_count": F.size(kept).cast("long"),
            "pii_found": F.size(kept) > 0,
            "types_found": F.array_sort(F.transform(counts, lambda c: c["key"])),
            "lost": F.size(F.filter("__pairs", lambda p: p["lost"])).cast("long"),
        }
    )
    return out.drop("__pairs", "__row"), store
