"""Detection patterns. The text form is shared; Spark gets Java's Unicode flag, DuckDB takes them as they are."""

from __future__ import annotations

#: What each category looks like, in the order of the ingress stages.
EMAIL = r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"
CC = r"\b(?:\d[ -]*?){13,16}\b"
IP = r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"
APIKEYS = [
    r"sk-[a-zA-Z0-9]{20,}",
    r"sk-proj-[a-zA-Z0-9_-]{20,}",
    r"AKIA[0-9A-Z]{16}",
    r"ghp_[a-zA-Z0-9]{36}",
    r"gho_[a-zA-Z0-9]{36}",
    r"ghs_[a-zA-Z0-9]{36}",
    r"ghr_[a-zA-Z0-9]{36}",
    r"github_pat_[a-zA-Z0-9_]{22,}",
    r"glpat-[a-zA-Z0-9_-]{20,}",
    r"[spr]k_(?:live|test)_[a-zA-Z0-9]{10,}",
    r"xox[bpsar]-[a-zA-Z0-9-]{10,}",
    r"AIza[0-9A-Za-z_-]{35}",
    r"SK[0-9a-fA-F]{32}",
    r"SG\.[a-zA-Z0-9_-]{22,}\.[a-zA-Z0-9_-]{22,}",
    r"key-[a-zA-Z0-9]{32}",
    r"npm_[a-zA-Z0-9]{36}",
    r"pypi-[a-zA-Z0-9_-]{16,}",
]
#: Every key holds one of these.
KEY_PREFIXES = ["sk-", "AKIA", "ghp_", "gho_", "ghs_", "ghr_", "github_pat_", "glpat-", "k_live_", "k_test_", "xox", "AIza", "SK", "SG.", "key-", "npm_", "pypi-"]
PHONE = r"(?:\+?\d{1,3}[-.\s]?\(?\d{2,3}\)?[-.\s]?\d{3,4}[-.\s]?\d{4}|\(\d{3}\)\s?\d{3}[-.\s]?\d{4})"
SSN = r"(?:\b\d{3}-\d{2}-\d{4}\b|\b\d{9}\b|\b[A-CEGHJ-PR-TW-Z]{2}\d{6}[A-D]\b)"
SYNTHETIC_ID = r"(EMAIL|CC|IP|SSN|APIKEY)_[a-f0-9]{8}"
LUHN_LENGTHS = (13, 19)

APIKEY = "(?:" + "|".join(APIKEYS) + ")"
INGRESS = ["EMAIL", "CC", "IP", "APIKEY", "PHONE", "SSN"]
EGRESS = ["EMAIL", "IP", "APIKEY", "PHONE", "SSN", "CC"]
PATTERNS = {"EMAIL": EMAIL, "CC": CC, "IP": IP, "APIKEY": APIKEY, "PHONE": PHONE, "SSN": SSN}


#: What every hit starts with: a test of one character before the costly ones (word boundaries, seventeen alternatives).
FIRST = {"CC": r"(?=\d)", "IP": r"(?=\d)", "APIKEY": "(?=[sAgrpxSkn])", "PHONE": r"(?=[+(\d])", "SSN": r"(?=[\dA-Z])"}


def java(category: str) -> str:
    """The pattern for Spark: the same hits, found faster. An address starts where its run of characters does (or the last hit ended)."""
    if category == "EMAIL":
        local, domain = EMAIL.split("+@")
        return rf"(?iu)(?:\G|(?<!{local})){local}++@{domain}"
    return "(?U)" + FIRST[category] + PATTERNS[category]


def re2(category: str) -> str:
    return ("(?i)" if category == "EMAIL" else "") + PATTERNS[category]
