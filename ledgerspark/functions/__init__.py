"""Column expressions (JVM-side, codegen'd) used by every operator."""

from .amounts import parse_amount, signed_amount
from .dates import tolerant_date
from .text import (
    client_key,
    contains_like,
    is_blank,
    like_needle,
    normalise_name,
    prefixed,
    row_text,
    safe_name,
)

__all__ = [
    "client_key",
    "contains_like",
    "is_blank",
    "like_needle",
    "normalise_name",
    "parse_amount",
    "prefixed",
    "row_text",
    "safe_name",
    "signed_amount",
    "tolerant_date",
]
