"""DuckDB twins of the redaction stages, for the oracle."""

from __future__ import annotations

from veilstream.functions.patterns import EGRESS, INGRESS, LUHN_LENGTHS, re2


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def luhn(h: str) -> str:
    d = f"regexp_replace({h}, '[^0-9]', '', 'g')"
    digit = f"CAST({d}[length({d}) - i] AS INT)"
    total = f"list_sum(list_transform(range(0, length({d})), lambda i: CASE WHEN i % 2 = 0 THEN {digit} WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END))"
    return f"(length({d}) BETWEEN {LUHN_LENGTHS[0]} AND {LUHN_LENGTHS[1]} AND {total} % 10 = 0)"


def synthetic(category: str, h: str) -> str:
    return f"('{category}_' || substr(sha256({h}), 1, 8))"


def hits(category: str, text: str) -> str:
    found = f"regexp_extract_all({text}, {quoted(re2(category))})"
    return f"list_filter({found}, lambda h: {luhn('h')})" if category == "CC" else found


def stages(source: str, key: str, text: str, custom: dict[str, str] | None = None, name: str = "z") -> str:
    """Common tables z0 ... zN; the last has key, txt (redacted) and hits0 ... of every stage."""
    plan = [(c, re2(c), c == "CC") for c in INGRESS] + [(n, p, False) for n, p in (custom or {}).items()]
    out = [f"{name}0 AS (SELECT {key}, {text} AS txt FROM {source})"]
    for i, (category, pattern, checked) in enumerate(plan):
        put = f"CASE WHEN {luhn('found[k]')} THEN {synthetic(category, 'found[k]')} ELSE found[k] END" if checked else synthetic(category, "found[k]")
        kept = f"list_filter(found, lambda h: {luhn('h')})" if checked else "found"
        out.append(f"{name}{i}f AS (SELECT *, regexp_extract_all(txt, {quoted(pattern)}) AS found, string_split_regex(txt, {quoted(pattern)}) AS gaps FROM {name}{i})")
        joined = f"CASE WHEN len(found) = 0 THEN txt ELSE array_to_string(list_transform(range(1, len(gaps) + 1), lambda k: gaps[k] || coalesce({put}, '')), '') END"
        out.append(f"{name}{i + 1} AS (SELECT * EXCLUDE (txt, found, gaps), {joined} AS txt, {kept} AS hits{i} FROM {name}{i}f)")
    return ",\n".join(out)


def stage_names(custom: dict[str, str] | None = None) -> list[str]:
    return [*INGRESS, *(custom or {})]


def last(custom: dict[str, str] | None = None, name: str = "z") -> str:
    return f"{name}{len(stage_names(custom))}"


def subs_list(custom: dict[str, str] | None = None) -> str:
    """List of synthetic=real in substitution order."""
    return " || ".join(f"list_transform(list_reverse(coalesce(hits{i}, [])), lambda h: {synthetic(c, 'h')} || '=' || h)" for i, c in enumerate(stage_names(custom)))


def total(custom: dict[str, str] | None = None) -> str:
    return " + ".join(f"coalesce(len(hits{i}), 0)" for i in range(len(stage_names(custom))))


def types(custom: dict[str, str] | None = None) -> str:
    named = ", ".join(f"CASE WHEN len(hits{i}) > 0 THEN '{c}' END" for i, c in enumerate(stage_names(custom)))
    return f"array_to_string(list_sort(list_filter([{named}], lambda x: x IS NOT NULL)), ',')"


def egress(text: str) -> str:
    """All but card numbers as one expression, card numbers around it."""
    for c in EGRESS:
        if c != "CC":
            text = f"regexp_replace({text}, {quoted(re2(c))}, '[REDACTED]', 'g')"
    return text


def egress_tables(source: str, key: str, text: str) -> str:
    put = f"CASE WHEN {luhn('found[k]')} THEN '[REDACTED]' ELSE found[k] END"
    return f"""e0 AS (SELECT {key}, {egress(text)} AS txt FROM {source}),
e1 AS (SELECT *, regexp_extract_all(txt, {quoted(re2("CC"))}) AS found, string_split_regex(txt, {quoted(re2("CC"))}) AS gaps FROM e0),
e2 AS (SELECT {key}, CASE WHEN len(found) = 0 THEN txt ELSE array_to_string(list_transform(range(1, len(gaps) + 1), lambda k: gaps[k] || coalesce({put}, '')), '') END AS txt FROM e1)"""
