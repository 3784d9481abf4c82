"""veilstream: a Spark-native engine for PII redaction and prompt safety.

One function for each capability; modules are loaded when a name is first used, so workers load only what they run.
"""

from importlib import import_module

_HOMES = {
    "veilstream.config": ["CustomPattern", "Policy", "Settings", "check_key", "load_settings"],
    "veilstream.operators.redact": ["redact", "egress", "egress_protected", "unmask", "unmask_exact_column", "find"],
    "veilstream.operators.requests": ["redact_requests"],
    "veilstream.operators.mapping": ["redact_mapped", "build_mapping", "get_or_create", "apply_mapping", "read_mapping", "load_mapping", "save_mapping", "live"],
    "veilstream.operators.messages": ["parse_requests", "to_gemini", "from_gemini", "to_anthropic", "from_anthropic", "chat_response"],
    "veilstream.operators.notice": ["build_notice", "inject_notice", "inject_prompt_notice", "strip_notice"],
    "veilstream.operators.shield": ["normalise", "blocked_phrase", "injection", "preflight", "score_with"],
    "veilstream.operators.ner": ["bio_spans", "entity_scorer", "label_of"],
    "veilstream.operators.limits": ["rate_limit"],
    "veilstream.operators.metrics": ["audit", "category_counts", "merged_counts", "named_counters", "latency_summary", "latency_histogram"],
    "veilstream.functions.scalars": ["route_model", "models_route", "token_count", "client_ip", "encrypt", "decrypt", "error_body", "blocked_body", "mask_url", "strip_bearer", "within_body_limit"],
    "veilstream.streaming.unredact": ["unredact_batch", "unredact_stream"],
    "veilstream.streaming.limits": ["rate_limit_stream"],
    "veilstream.streaming.mapping": ["mapping_stream"],
    "veilstream.session": ["cleanup"],
}
_HOME = {name: home for home, names in _HOMES.items() for name in names}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(name)
    return getattr(import_module(_HOME[name]), name)
