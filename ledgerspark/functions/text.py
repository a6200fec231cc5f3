"""Text Column expressions: blanks, prefixes, keys, names, LIKE needles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CLIENT_KEY_HEX, CLIENT_KEY_PREFIX, DEFAULT_DATASET_NAME


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_text(c: Column | str) -> Column:
    return as_col(c).cast("string")


def is_blank(c: Column | str) -> Column:
    """NULL, or empty after trimming spaces (tabs are not blank)."""
    c = as_col(c)
    return c.isNull() | (F.trim(c) == F.lit(""))


def prefixed(c: Column | str, prefix: str | None) -> Column:
    """Prefix rule: blank -> NULL, else prefix || trim(v). Without a rule the
    value passes through untouched (no trim)."""
    c = as_text(c)
    if not prefix:
        return c
    return F.when(is_blank(c), F.lit(None).cast("string")).otherwise(F.concat(F.lit(prefix), F.trim(c)))


def strip_unicode(c: Column | str) -> Column:
    """Remove leading/trailing Unicode whitespace (like Python's str.strip())."""
    return F.regexp_replace(as_text(c), r"(?U)^\s+|\s+$", "")


def client_key(name: Column | str) -> Column:
    """Partition key of a client: prefix + first hex digits of SHA-1(strip(name))."""
    digest = F.sha1(F.encode(strip_unicode(name), "UTF-8"))
    return F.concat(F.lit(CLIENT_KEY_PREFIX), F.substring(digest, 1, CLIENT_KEY_HEX))


def safe_name(c: Column | str, default: str = DEFAULT_DATASET_NAME) -> Column:
    """Letters, digits, '-' and '_' kept; everything else -> '_'; outer '_'
    stripped; empty -> default."""
    kept = F.regexp_replace(as_text(c), r"[^\p{L}\p{N}_-]", "_")
    stripped = F.regexp_replace(kept, r"^_+|_+$", "")
    return F.when(stripped == "", F.lit(default)).otherwise(stripped)


def like_needle(text: str) -> str:
    """Pattern for 'contains text' where '%' and '_' in text stay wildcards and
    a backslash is an ordinary character."""
    return "%" + text.replace("\\", "\\\\") + "%"


def contains_like(c: Column | str, text: str) -> Column:
    return as_col(c).like(like_needle(text))


def normalise_name(c: Column | str) -> Column:
    """Header-name key: stripped, lower case, without space, '_' or U+3000."""
    return F.regexp_replace(F.lower(strip_unicode(c)), "[ _\u3000]", "")


def row_text(cols: list[Column | str]) -> Column:
    """All values of a row as text, NULL -> '', joined by one space."""
    return F.concat_ws(" ", *[F.coalesce(as_text(c), F.lit("")) for c in cols])
