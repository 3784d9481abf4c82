"""Chat and generate requests, and the message formats of other providers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Roles (any case in, lower case out), and the default answer length of the block format.
ROLES = ["system", "user", "assistant", "tool"]
DEFAULT_MAX_TOKENS = 4096

BODY = "model variant, messages array<struct<role:string,content:variant,name:string>>, prompt variant, system string, temperature float, stream boolean"
MESSAGES = "array<struct<role:string,content:string,name:string,parts:array<struct<type:string,text:string>>>>"


def kind_of(v: Column) -> Column:
    """The JSON kind of a variant, in capitals."""
    return F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)


def parse_requests(df: DataFrame, body_col: str = "body") -> DataFrame:
    """df with kind (chat, generate, unrecognised), model, messages (text content, or text parts), prompt, stream and extra (JSON of every other field).

    A chat request needs a model and messages whose roles are known and whose contents are text, lists or absent; else it is
    tried as a generate request (model and prompt); all else passes unrecognised.
    """
    out = df.withColumn("__b", F.from_json(body_col, BODY))
    b = F.col("__b")
    text = lambda v: F.when(kind_of(v) == "STRING", F.variant_get(v, "$", "string"))
    known = lambda m: F.lower(F.coalesce(m["role"], F.lit("user"))).isin(ROLES) & F.coalesce(kind_of(m["content"]).isin("STRING", "ARRAY", "VOID"), F.lit(True))
    named = F.coalesce(kind_of(b["model"]) == "STRING", F.lit(False))
    chat = named & b["messages"].isNotNull() & F.coalesce(F.forall(b["messages"], known), F.lit(False))
    generate = named & F.coalesce(kind_of(b["prompt"]) == "STRING", F.lit(False))
    part = "array<struct<type:string,text:string>>"
    message = lambda m: F.struct(
        F.lower(F.coalesce(m["role"], F.lit("user"))).alias("role"),
        text(m["content"]).alias("content"),
        m["name"].alias("name"),
        F.when(kind_of(m["content"]) == "ARRAY", F.from_json(F.to_json(m["content"]), part)).alias("parts"),
    )
    fields = F.variant_get(F.try_parse_json(body_col), "$", "map<string,variant>")
    rest = lambda *known: F.transform_values(F.map_filter(fields, lambda k, v: ~k.isin(*known)), lambda k, v: F.to_json(v))
    kind = F.when(chat, "chat").when(generate, "generate").otherwise("unrecognised")
    return out.withColumns(
        {
            "kind": kind,
            "model": F.when(chat | generate, text(b["model"])),
            "messages": F.when(chat, F.transform(b["messages"], message)).cast(MESSAGES),
            "prompt": F.when(~chat & generate, text(b["prompt"])),
            "system": F.when(~chat & generate, b["system"]),
            "temperature": F.when(chat, b["temperature"]),
            "stream": b["stream"],
            "extra": F.when(chat, rest("model", "messages", "temperature", "stream")).when(generate, rest("model", "prompt", "system", "stream")),
        }
    ).drop("__b")


def text_parts(parts: Column) -> Column:
    return F.transform(F.filter(parts, lambda p: (p["type"] == "text") & p["text"].isNotNull()), lambda p: p["text"])


def stream_default(stream: Column, local: bool) -> Column:
    """Whether to stream where the request doesn't say: the local formats do, the chat format doesn't."""
    return F.coalesce(stream, F.lit(local))


def to_gemini(messages: Column, temperature: Column) -> Column:
    """contents (role, parts) and generationConfig; assistants are ``model``, all others ``user``."""
    flat = lambda m: F.coalesce(m["content"], F.array_join(F.transform(text_parts(m["parts"]), lambda t: F.concat(t, F.lit("\n"))), ""), F.lit(""))
    contents = F.transform(messages, lambda m: F.struct(F.when(m["role"] == "assistant", "model").otherwise("user").alias("role"), F.array(F.struct(flat(m).alias("text"))).alias("parts")))
    return F.struct(contents.alias("contents"), F.when(temperature.isNotNull(), F.struct(temperature.alias("temperature"))).alias("generationConfig"))


def chat_response(response_id: Column, created: Column, model: Column, choices: Column, usage: Column | None = None) -> Column:
    """The envelope of an answer: id, object, created (seconds), model, choices and, if given, usage."""
    fields = [F.concat(F.lit("chatcmpl-"), response_id).alias("id"), F.lit("chat.completion").alias("object"), created.cast("long").alias("created"), model.alias("model"), choices.alias("choices")]
    return F.struct(*fields, *([] if usage is None else [usage.alias("usage")]))


def from_gemini(candidates: Column, error: Column | None = None) -> Column:
    """choices (index, role, content, finish_reason) for chat_response; null where the response is an error."""
    choice = lambda c, i: F.struct(
        i.cast("long").alias("index"),
        F.when(c["content"]["role"] == "model", "assistant").otherwise("user").alias("role"),
        F.coalesce(F.try_element_at(c["content"]["parts"], F.lit(1))["text"], F.lit("")).alias("content"),
        F.coalesce(c["finishReason"], F.lit("stop")).alias("finish_reason"),
    )
    out = F.transform(F.coalesce(candidates, F.array().cast("array<struct<content:struct<role:string,parts:array<struct<text:string>>>,finishReason:string>>")), choice)
    return out if error is None else F.when(error.isNull(), out)


def to_anthropic(messages: Column, max_tokens: Column | None = None) -> Column:
    """system (first system message's text), messages without system ones, max_tokens."""
    system = F.filter(messages, lambda m: m["role"] == "system")
    first = F.when(F.size(system) > 0, F.coalesce(F.try_element_at(system, F.lit(1))["content"], F.lit("")))
    rest = F.filter(messages, lambda m: m["role"] != "system")
    blocks = lambda m: F.when(m["parts"].isNotNull(), F.transform(text_parts(m["parts"]), lambda t: F.struct(F.lit("text").alias("type"), t.alias("text"))))
    told = F.transform(rest, lambda m: F.struct(m["role"].alias("role"), F.when(m["parts"].isNull(), F.coalesce(m["content"], F.lit(""))).alias("text"), blocks(m).alias("blocks")))
    most = F.lit(DEFAULT_MAX_TOKENS) if max_tokens is None else F.coalesce(max_tokens, F.lit(DEFAULT_MAX_TOKENS))
    return F.struct(first.alias("system"), told.alias("messages"), most.cast("long").alias("max_tokens"))


def from_anthropic(response_id: Column, content: Column, stop_reason: Column, tokens_in: Column, tokens_out: Column, created: Column, model: Column) -> Column:
    """The answer's envelope with one choice (text blocks joined) and, where both token counts are known, usage."""
    choice = F.struct(
        F.lit(0).cast("long").alias("index"), F.lit("assistant").alias("role"), F.array_join(text_parts(content), "").alias("content"), F.coalesce(stop_reason, F.lit("stop")).alias("finish_reason")
    )
    usage = F.struct(tokens_in.cast("long").alias("prompt_tokens"), tokens_out.cast("long").alias("completion_tokens"), (tokens_in + tokens_out).cast("long").alias("total_tokens"))
    return chat_response(response_id, created, model, F.array(choice), F.when(tokens_in.isNotNull() & tokens_out.isNotNull(), usage))
