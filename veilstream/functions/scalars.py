"""Scalar functions on columns: checksums, ids, encryption, routing, small text helpers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from veilstream.functions.patterns import LUHN_LENGTHS, SYNTHETIC_ID

#: Model prefixes and where they go; other models go to the local server.
ROUTES = {
    "gemini": ["gemini"],
    "anthropic": ["claude"],
    "openai": ["gpt-", "gpt4", "text-embedding", "dall-e", "whisper", "tts", "o1-", "o3-", "o4-", "chatgpt-"],
}
LOCAL_ROUTE = "ollama"
#: Error variant, HTTP status, error type, what its message begins with (or all of it, where no detail follows).
ERRORS = [
    ("Config", 500, "server_error", "Config error: "),
    ("Redis", 503, "service_unavailable", "Redis unavailable: "),
    ("Io", 500, "server_error", "IO error: "),
    ("Network", 502, "upstream_error", "Upstream error: "),
    ("Serialization", 400, "invalid_request_error", "Serialization error: "),
    ("Unknown", 500, "server_error", "Unknown error: "),
    ("Axum", 500, "server_error", "Axum error: "),
    ("Nlp", 500, "server_error", "NLP error: "),
    ("Internal", 500, "server_error", "Internal server error"),
    ("BadRequest", 400, "invalid_request_error", ""),
]
NO_DETAIL = ["Internal"]
#: The answer to a blocked request, whatever the reason.
BLOCKED_STATUS, BLOCKED_TYPE, BLOCKED_CODE = 400, "invalid_request_error", "prompt_injection_detected"
BLOCKED_MESSAGE = "Request blocked: adversarial phrase detected."
#: Fixed value: bearer tokens that go to the public service.
PUBLIC_KEY = "Bearer sk-"


def luhn(number: Column) -> Column:
    """Whether the ASCII digits of a text number 13 to 19 and pass the Luhn checksum."""
    digits = F.regexp_replace(number, "[^0-9]", "")
    return F.length(digits).between(*LUHN_LENGTHS) & F.call_function("luhn_check", digits)


def synthetic_id(prefix: str | Column, real: Column) -> Column:
    """PREFIX_ and the first eight hex digits of the value's SHA-256."""
    return F.concat(F.lit(prefix) if isinstance(prefix, str) else prefix, F.lit("_"), F.substring(F.sha2(real, 256), 1, 8))


def encrypt(plain: Column, key: str) -> Column:
    """Lower-case hex of nonce, ciphertext and tag (AES-256-GCM under the key's SHA-256). A new nonce for every row."""
    return F.lower(F.hex(F.aes_encrypt(plain.cast("binary"), F.unhex(F.sha2(F.lit(key), 256)), F.lit("GCM"))))


def decrypt(text: Column, key: str) -> Column:
    """The plain text, or null for short, malformed or forged input."""
    plain = F.try_aes_decrypt(F.unhex(text), F.unhex(F.sha2(F.lit(key), 256)), F.lit("GCM"))
    return F.when((F.length(text) >= 24) & text.rlike("^[0-9a-fA-F]*$"), plain.cast("string"))


def route_model(model: Column) -> Column:
    out = None
    for target, prefixes in ROUTES.items():
        for p in prefixes:
            out = F.when(model.startswith(p), target) if out is None else out.when(model.startswith(p), target)
    return out.otherwise(LOCAL_ROUTE)


def token_count(text: Column, tokenizer_path: str | None = None) -> Column:
    """Tokens without special ones by the tokenizer file, read once by each worker; without a file bytes by four."""
    if tokenizer_path is None:
        return F.floor(F.octet_length(F.coalesce(text, F.lit(""))) / 4).cast("long")

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        for batch in batches:
            found = tokenizer.encode_batch(["" if t is None else t for t in batch], add_special_tokens=False)
            yield pd.Series([len(e.ids) for e in found], dtype="int64")

    count.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(count, "long")(text)


def synthetic_ids(text: Column) -> Column:
    """All tokens of the built-in categories in a text."""
    return F.regexp_extract_all(text, F.lit(SYNTHETIC_ID), F.lit(0))


def sse_event(chunk: Column) -> Column:
    """A chunk as a server-sent event: a data line for each of its lines, and a blank line."""
    return F.concat(F.lit("data: "), F.regexp_replace(chunk, "\r\n|\r|\n", "\ndata: "), F.lit("\n\n"))


def strip_bearer(header: Column) -> Column:
    return F.regexp_replace(header, "^Bearer ", "")


def mask_url(url: Column) -> Column:
    """The url without its credentials."""
    return F.regexp_replace(url, "(?s)^([a-z+]+://)[^/]*@", "$1***@")


def client_ip(forwarded: Column, real: Column, peer: Column, trust_proxy: Column | bool) -> Column:
    """First forwarded address, then X-Real-IP (both only if proxies are trusted), then the peer, then localhost."""
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    valid = lambda c: F.when(c.rlike(rf"^(?:{octet}\.){{3}}{octet}$") | c.rlike("^[0-9a-fA-F:]*:[0-9a-fA-F:.]*$"), c)
    trusted = F.lit(trust_proxy) if isinstance(trust_proxy, bool) else trust_proxy
    first = F.trim(F.element_at(F.split(forwarded, ","), 1))
    return F.coalesce(F.when(trusted, F.coalesce(valid(first), valid(real))), peer, F.lit("127.0.0.1"))


def error_columns(variant: Column, detail: Column | None = None) -> dict[str, Column]:
    """status, type, code and message of an error variant."""
    status = kind = message = None
    for name, code, what, text in ERRORS:
        told = F.lit(text) if name in NO_DETAIL or detail is None else F.concat(F.lit(text), F.coalesce(detail, F.lit("")))
        hit = variant == name
        status = F.when(hit, code) if status is None else status.when(hit, code)
        kind = F.when(hit, what) if kind is None else kind.when(hit, what)
        message = F.when(hit, told) if message is None else message.when(hit, told)
    return {"status": status, "type": kind, "code": status, "message": message}


def error_body(variant: Column, detail: Column | None = None) -> Column:
    """The JSON answer for an error variant."""
    c = error_columns(variant, detail)
    return F.to_json(F.struct(F.struct(c["message"].alias("message"), c["type"].alias("type"), c["code"].alias("code")).alias("error")))


def blocked_body() -> Column:
    """The JSON answer to a blocked request."""
    return F.to_json(F.struct(F.struct(F.lit(BLOCKED_MESSAGE).alias("message"), F.lit(BLOCKED_TYPE).alias("type"), F.lit(BLOCKED_CODE).alias("code")).alias("error")))


def models_route(authorization: Column) -> dict[str, Column]:
    """Where a listing of models goes, and whether the header goes along: a public key to the public service, all else to the local server."""
    public = F.coalesce(authorization.startswith(PUBLIC_KEY), F.lit(False))
    return {"route": F.when(public, "openai").otherwise(LOCAL_ROUTE), "forwards": public}


def within_body_limit(body: Column, limit: int) -> Column:
    return F.octet_length(F.coalesce(body, F.lit(""))) <= limit
