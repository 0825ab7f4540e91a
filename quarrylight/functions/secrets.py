"""Secret detection and redaction as expressions.

A secret is a private key block, or a value given to a name that ends in api_key, secret, token or
password (any case, with or without quotes) of six characters or more without white space that isn't a call, a
placeholder or a plain reference. Only the value is replaced, so that lines and quotes stay.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REDACTED = "[REDACTED]"

# What counts as a secret.
_NAME = r"(?i)\b((?:[a-z0-9]+[_-])*(?:api[_-]?key|secret|token|password|private[_-]?key)(?:[_-][a-z0-9]+)*[\"']?\s*[:=]\s*)"
_QUOTED = _NAME + r"([\"'])([^\"'\s\[\]]{6,})([\"'])"
_BARE = _NAME + r"((?:sk|pk|ghp|gho|xox[abp]|AKIA)[-_A-Za-z0-9]{6,}|[A-Za-z0-9+/_-]*[0-9][A-Za-z0-9+/_-]{7,})"
_PEM = r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)([^-]*)(-----END [A-Z ]*PRIVATE KEY-----)"
_PATTERNS = ((_QUOTED, f"$1$2{REDACTED}$4"), (_BARE, f"$1{REDACTED}"))


def has_secret(text: Column) -> Column:
    return text.rlike(_QUOTED) | text.rlike(_BARE) | text.rlike(_PEM)


def redact(text: Column) -> Column:
    """The text with secret values replaced; lines of a key block stay as empty lines after the mark."""
    out = F.regexp_replace(text, _PEM, f"$1{REDACTED}$3")
    for pattern, new in _PATTERNS:
        out = F.regexp_replace(out, pattern, new)
    return out
