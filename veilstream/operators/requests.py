"""Redaction of whole request bodies: every text of a chat or generate request, the notice, and all other fields as they came.

A body is taken apart into texts (one row each), these go through the stages of ``redact``, and the body is put together again from its
own JSON values, so fields that nobody knows stay. Only the texts of one request meet in a row, and a request is as large as its body.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstream.config import CustomPattern, Policy
from veilstream.functions.patterns import INGRESS
from veilstream.operators.messages import kind_of, parse_requests
from veilstream.operators.notice import build_notice
from veilstream.operators.redact import NER, SUBS, redact
from veilstream.session import materialise

#: Place of a text: its message and, in a list content, its part; WHOLE where there is none.
WHOLE = -1


def quoted(text: Column) -> Column:
    """text as a JSON string."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _fields(v: Column) -> Column:
    return F.map_entries(F.variant_get(v, "$", "map<string,variant>"))


def _object(fields: Column) -> Column:
    """JSON of fields (array of structs name, json)."""
    return F.concat(F.lit("{"), F.array_join(F.transform(fields, lambda f: F.concat(quoted(f["name"]), F.lit(":"), f["json"])), ","), F.lit("}"))


def _field(name: str | Column, json: Column) -> Column:
    return F.struct((F.lit(name) if isinstance(name, str) else name).alias("name"), json.alias("json"))


def _texts(parsed: DataFrame) -> DataFrame:
    """__row, __message, __part, __text of everything that is scanned: text contents, text parts, prompts. All else is not."""
    string = lambda v: F.when(kind_of(v) == "STRING", F.variant_get(v, "$", "string"))
    place = lambda part, text: F.struct(part.alias("__part"), text.alias("__text"))
    chat = parsed.where("kind = 'chat'").select("__row", F.posexplode(F.variant_get("__json", "$.messages", "array<variant>")).alias("__message", "m"))
    chat = chat.withColumn("c", F.try_variant_get("m", "$.content", "variant"))
    one = F.array(place(F.lit(WHOLE), string(F.col("c"))))
    text_part = lambda p: F.when(string(F.try_variant_get(p, "$.type", "variant")) == "text", string(F.try_variant_get(p, "$.text", "variant")))
    parts = F.transform(F.variant_get("c", "$", "array<variant>"), lambda p, i: place(i, text_part(p)))
    found = F.when(kind_of(F.col("c")) == "STRING", one).when(kind_of(F.col("c")) == "ARRAY", parts)
    chat = chat.select("__row", "__message", F.inline(F.filter(found, lambda x: x["__text"].isNotNull())))
    prompts = parsed.where("kind = 'generate'").select("__row", F.lit(WHOLE).alias("__message"), F.lit(WHOLE).alias("__part"), F.col("prompt").alias("__text"))
    return chat.unionByName(prompts)


def redact_requests(
    df: DataFrame, body_col: str = "body", policy: Policy = Policy(), custom: tuple[CustomPattern, ...] = (), entities: Callable[[Column], Column] | None = None
) -> DataFrame:
    """df with kind, redacted_body, substitutions (message by message, part by part), pii_counts, pii_count and pii_found.

    Null and unrecognised bodies stay as they are, with null substitutions. A body without hits is put together from its own values:
    the same JSON, with roles in lower case and keys in order. Columns of these names are replaced.
    """
    ours = ["kind", "redacted_body", "substitutions", "pii_counts", "pii_count", "pii_found"]
    rows = df.drop(*ours).withColumn("__row", F.monotonically_increasing_id())
    bodies = materialise(rows.withColumn("__body", F.col(f"`{body_col}`").cast("string")), "bodies")
    parsed = parse_requests(bodies.select("__row", "__body"), "__body").withColumn("__json", F.try_parse_json("__body"))
    made = redact(_texts(parsed), "__text", policy, custom, entities=entities)
    keys = [c for c in INGRESS if policy.allows(c)] + [c.name for c in custom] + ([NER] if entities else [])
    place = F.concat_ws("/", "__message", "__part")
    told = F.array_sort(F.collect_list(F.struct("__message", "__part", place.alias("place"), "redacted", "substitutions"))).alias("told")
    counts = [F.sum(F.coalesce(F.try_element_at("pii_counts", F.lit(c)), F.lit(0))).cast("long").alias(f"n{i}") for i, c in enumerate(keys)]
    folded = made.groupBy("__row").agg(told, *counts)
    listed = F.array(*[F.struct(F.lit(c).alias("key"), F.col(f"n{i}").alias("value")) for i, c in enumerate(keys)])
    folded = folded.select(
        "__row", F.map_from_entries(F.transform("told", lambda t: F.struct(t["place"], t["redacted"]))).alias("__new"),
        F.flatten(F.transform("told", lambda t: t["substitutions"])).alias("__subs"), F.map_from_entries(F.filter(listed, lambda c: c["value"] > 0)).alias("__counts"),
    )
    kinds = parsed.select("__row", "kind", "system", "__json")
    out = bodies.join(kinds, "__row").join(folded, "__row", "left")
    known = F.col("kind") != "unrecognised"
    subs = F.when(known, F.coalesce("__subs", F.array().cast(SUBS)))
    out = out.withColumns({"__subs": subs, "__counts": F.when(known, F.coalesce("__counts", F.create_map().cast("map<string,bigint>")))})
    total = F.aggregate(F.map_values("__counts"), F.lit(0).cast("long"), lambda acc, n: acc + n)
    out = out.withColumn("__total", F.coalesce(total, F.lit(0).cast("long"))).withColumn("__notice", F.when(F.col("__total") > 0, build_notice(F.transform("__subs", lambda s: s["synthetic"]))))
    body = F.when(F.col("kind") == "chat", _chat_body()).when(F.col("kind") == "generate", _generate_body()).otherwise(F.col("__body"))
    out = out.withColumns({"redacted_body": body, "substitutions": F.col("__subs"), "pii_counts": F.col("__counts"), "pii_count": F.col("__total"), "pii_found": F.col("__total") > 0})
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in ours], *ours)


def _rewritten(place: Column, old: Column) -> Column:
    return F.coalesce(quoted(F.try_element_at("__new", place)), F.to_json(old))


def _part(part: Column, message: Column, i: Column) -> Column:
    place = F.concat_ws("/", message, i)
    fields = F.transform(_fields(part), lambda f: _field(f["key"], F.when(f["key"] == "text", _rewritten(place, f["value"])).otherwise(F.to_json(f["value"]))))
    return F.when(F.map_contains_key("__new", place), _object(fields)).otherwise(F.to_json(part))


def _chat_body() -> Column:
    notice = F.col("__notice")

    def message(m, i):
        content = F.try_variant_get(m, "$.content", "variant")
        role = F.lower(F.coalesce(F.try_variant_get(m, "$.role", "string"), F.lit("user")))
        place = F.concat_ws("/", i, F.lit(WHOLE))
        text = F.coalesce(F.try_element_at("__new", place), F.try_variant_get(m, "$.content", "string"))
        noted = F.when((i == 0) & (role == "system") & notice.isNotNull(), F.concat(text, F.lit("\n\n"), notice)).otherwise(text)
        parts = F.transform(F.variant_get(content, "$", "array<variant>"), lambda p, j: _part(p, i, j))
        told = F.when(kind_of(content) == "STRING", quoted(noted)).when(kind_of(content) == "ARRAY", F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))).when(kind_of(content) == "VOID", F.lit("null"))
        rest = F.transform(F.filter(_fields(m), lambda f: ~f["key"].isin("role", "content")), lambda f: _field(f["key"], F.to_json(f["value"])))
        first = F.filter(F.array(_field("role", quoted(role)), _field("content", told)), lambda f: f["json"].isNotNull())
        return _object(F.concat(first, rest))

    def body(ms):
        lead = F.lower(F.coalesce(F.try_variant_get(F.get(ms, F.lit(0)), "$.role", "string"), F.lit("user")))
        front = F.when(notice.isNotNull() & (lead != "system"), F.array(_object(F.array(_field("role", F.lit('"system"')), _field("content", quoted(notice)))))).otherwise(F.array().cast("array<string>"))
        listed = F.concat(F.lit("["), F.array_join(F.concat(front, F.transform(ms, message)), ","), F.lit("]"))
        return _object(F.transform(_fields(F.col("__json")), lambda f: _field(f["key"], F.when(f["key"] == "messages", listed).otherwise(F.to_json(f["value"])))))

    return F.get(F.transform(F.array(F.variant_get("__json", "$.messages", "array<variant>")), body), F.lit(0))


def _generate_body() -> Column:
    noted = F.when(F.col("__notice").isNotNull(), F.when(F.col("system").isNull(), F.col("__notice")).otherwise(F.concat("system", F.lit("\n\n"), "__notice")))
    place = F.concat_ws("/", F.lit(WHOLE), F.lit(WHOLE))
    value = lambda f: F.when(f["key"] == "prompt", _rewritten(place, f["value"])).when((f["key"] == "system") & noted.isNotNull(), quoted(noted)).otherwise(F.to_json(f["value"]))
    fields = F.transform(_fields(F.col("__json")), lambda f: _field(f["key"], value(f)))
    extra = F.when(noted.isNotNull() & ~F.exists(fields, lambda f: f["name"] == "system"), F.array(_field("system", quoted(noted)))).otherwise(F.array().cast("array<struct<name:string,json:string>>"))
    return _object(F.concat(fields, extra))
