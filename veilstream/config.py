"""Settings as frozen dataclasses, read from TOML and overridden by environment variables."""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import dataclass, field

#: Default settings.
TTL_SECONDS = 3600
REQUESTS_PER_SECOND = 20
BURST = 10
MAX_BODY_BYTES = 10 * 1024 * 1024
MIN_KEY_BYTES = 32
DEFAULT_KEY = "change-me-to-32-char-secret-!!!!"


@dataclass(frozen=True)
class Policy:
    """Which stages run; a stage that is off is left out of the plan."""

    email: bool = True
    cc: bool = True
    ip: bool = True
    apikey: bool = True
    phone: bool = True
    ssn: bool = True
    person: bool = True
    location: bool = True
    org: bool = True

    def allows(self, category: str) -> bool:
        return getattr(self, category.lower(), True)

    def labels(self) -> list[str]:
        return [label for label, on in (("PER", self.person), ("LOC", self.location), ("ORG", self.org)) if on]


@dataclass(frozen=True)
class CustomPattern:
    name: str
    regex: str


@dataclass(frozen=True)
class Settings:
    policy: Policy = field(default_factory=Policy)
    custom: tuple[CustomPattern, ...] = (CustomPattern("PROJECT_ID", r"Project-\d{4}"),)
    ttl_seconds: int = TTL_SECONDS
    requests_per_second: int = REQUESTS_PER_SECOND
    burst: int = BURST
    trust_proxy: bool = False
    fail_open: bool = False
    max_prompt_tokens: int = 0
    encryption_key: str = DEFAULT_KEY


def usable_custom(patterns) -> tuple[CustomPattern, ...]:
    """Patterns that compile and don't match the empty text; others are left out. With a session Java judges, which runs them; without one
    Python does, and ``redact`` asks Java once more."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if spark is not None:
        from veilstream.operators.redact import usable_pattern

        return tuple(p for p in patterns if usable_pattern(spark, p.regex))
    out = []
    for p in patterns:
        try:
            if re.compile(p.regex).search("") is None:
                out.append(p)
        except re.error:
            continue
    return tuple(out)


def check_key(key: str) -> str:
    """The key, if it is neither the documented default nor too short."""
    if key == DEFAULT_KEY or len(key.encode()) < MIN_KEY_BYTES:
        raise ValueError(f"set an encryption key of at least {MIN_KEY_BYTES} bytes of your own")
    return key


def load_settings(paths: list[str], environ: dict[str, str] | None = None) -> Settings:
    """The first file that exists, then SECTION__NAME variables over it."""
    raw: dict = {}
    for path in paths:
        if os.path.exists(path):
            with open(path, "rb") as f:
                raw = tomllib.load(f)
            break
    for name, value in (os.environ if environ is None else environ).items():
        section, found, key = name.lower().partition("__")
        if found and isinstance(raw.get(section, {}), dict):
            raw.setdefault(section, {})[key] = value
    get = lambda section, key, default: type(default)(raw.get(section, {}).get(key, default)) if not isinstance(default, bool) else str(raw.get(section, {}).get(key, default)).lower() == "true"
    flag = lambda key: get("policy", key, True)
    policy = Policy(*[flag(f"redact_{c}") for c in ("email", "cc", "ip", "apikey", "phone", "ssn", "ner_person", "ner_location", "ner_org")])
    custom = usable_custom(CustomPattern(c["name"], c["regex"]) for c in raw.get("custom", []))
    return Settings(
        policy, custom, get("redis", "ttl_seconds", TTL_SECONDS), max(1, get("rate_limit", "requests_per_second", REQUESTS_PER_SECOND)), max(1, get("rate_limit", "burst_size", BURST)),
        get("rate_limit", "trust_proxy", False), get("security", "fail_open", False), get("limits", "max_prompt_tokens", 0), get("security", "encryption_key", DEFAULT_KEY),
    )
