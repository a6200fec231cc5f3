"""Secret scans: fixed patterns, and a token-efficiency test for the rest.

A run of key characters that a tiktoken vocabulary spells with few characters
a token is random; words, however rare, take more.  Where a run as a whole is
not, its parts between '=', '/', '_' and '-' are tested (neighbours that are
low together), and windows of the least length within a part: a secret behind
a readable prefix is reported as the part that holds it.  Known digests (hex of
a digest's length), UUIDs, numbers and identifiers whose names are word-like by
their own ratio are left out.  Spans of the fixed patterns stay whatever the
test says.

Defined cases: a null text counts as empty and has no span; spans are code
points of the whole text, end exclusive; a run that meets a fixed span is tested
without it; repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import public_tokenizers
from pyspark.sql import DataFrame

from ..session import reach_package
from .docs import map_slices, with_bytes

# The three base patterns and their least lengths.
ASSIGN = re.compile(
    rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")  # as [0-9a-f]+ of 24 or more: a match is a whole run
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "random")

VOCABULARY = "byte_bpe_50k.tiktoken"
MAX_RATIO = 1.9  # characters a token; random base64 has about 1.5, prose over 2.0
LEAST_CHARS = 16
_RUN = re.compile(rb"[A-Za-z0-9+/_=-]{%d,}" % LEAST_CHARS)
_HEX_ONLY = re.compile(rb"[0-9a-f]+\Z|[0-9A-F]+\Z")
_DIGEST_CHARS = {32, 40, 56, 64, 96, 128}  # MD5, SHA-1 and the SHA-2 lengths in hex
_UUID = re.compile(rb"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
# parts of a run between '=', '/', '_' and '-'; a UUID is one part
_SPLIT = re.compile(rb"(?<![0-9A-Za-z])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9A-Za-z])|[^=/_-]+")
_NUMBER = re.compile(rb"[0-9+/_=-]+\Z")
_NAME = re.compile(rb"(?:[A-Za-z]?[a-z]{2,}|[A-Z]{2,})[0-9]{0,4}\Z")


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _fixed(run: bytes) -> bool:
    """A digest, UUID or number."""
    return bool(_NUMBER.match(run) or _UUID.match(run) or (len(run) in _DIGEST_CHARS and _HEX_ONLY.match(run)))


def _named(run: bytes, path: str, max_ratio: float) -> bool:
    """An identifier: names, with a few digits behind, and numbers; the names
    are word-like by their own characters a token."""
    pieces = [p for p in re.split(rb"[_/=+-]+", run) if p]
    if not all(_NAME.match(p) or p.isdigit() for p in pieces):
        return False
    names = [x for x in (p.rstrip(b"0123456789") for p in pieces) if x]
    return sum(map(len, names)) > max_ratio * sum(len(_tokens(x, path)) for x in names)


def _tokens(part: bytes, path: str) -> list[int]:
    return _encoding(path).encode_ordinary(part.decode("ascii"))


def _low(part: bytes, path: str, max_ratio: float) -> bool:
    return len(part) <= max_ratio * len(_tokens(part, path))


def _low_window(part: bytes, path: str, max_ratio: float) -> bool:
    """Whether some tokens in a row, of LEAST_CHARS characters or just over,
    have a low ratio: a secret that nothing parts from a word."""
    size = [len(_encoding(path).decode_single_token_bytes(t)) for t in _tokens(part, path)]
    first = chars = 0
    for i, n in enumerate(size):
        chars += n
        while chars - size[first] >= LEAST_CHARS:
            chars -= size[first]
            first += 1
        if chars >= LEAST_CHARS and chars <= max_ratio * (i + 1 - first):
            return True
    return False


def _random(run: bytes, path: str, max_ratio: float) -> list[tuple[int, int]]:
    """Begins and ends of what is random in a run: the whole run, or parts of
    it next to each other; what these leave is tested again as a run."""
    if len(run) < LEAST_CHARS or _fixed(run):
        return []
    if not _named(run, path, max_ratio) and _low(run, path, max_ratio):
        return [(0, len(run))]
    groups, last = [], None  # parts in a row that are low by themselves
    for m in _SPLIT.finditer(run):
        part = m.group()
        if _fixed(part) or _named(part, path, max_ratio):
            continue
        low = _low(part, path, max_ratio)
        if low and last is not None and m.start() == last + 1:
            groups[-1][1] = m.end()
        elif low or (len(part) >= LEAST_CHARS and _low_window(part, path, max_ratio)):
            groups.append([m.start(), m.end()])
        last = m.end() if low else None
    out, seen = [], 0
    for a, b in groups:
        if b - a >= LEAST_CHARS:
            out += [(seen + x, seen + y) for x, y in _random(run[seen:a], path, max_ratio)] + [(a, b)]
            seen = b
    return out + [(seen + x, seen + y) for x, y in _random(run[seen:], path, max_ratio)] if out else []


def find_spans(text: bytes, path: str, max_ratio: float = MAX_RATIO) -> list[tuple[int, str, int]]:
    """(start, kind, end) in bytes, by start and then by kind as listed."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    more = []
    for m in _RUN.finditer(text):
        a, b = m.span()
        # what the fixed spans leave of the run
        for s, _, e in sorted(x for x in found if a < x[2] and x[0] < b):
            if s > a:
                more += [(a + x, 3, a + y) for x, y in _random(text[a:s], path, max_ratio)]
            a = max(a, e)
        if a < b:
            more += [(a + x, 3, a + y) for x, y in _random(text[a:b], path, max_ratio)]
    return [(s, KINDS[k], e) for s, k, e in sorted(found + more)]


def to_code_points(text: bytes, spans: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    if not spans or text.isascii():
        return spans
    at = {}
    seen = n = 0
    for x in sorted({x for s, _, e in spans for x in (s, e)}):
        n += len(text[seen:x].decode("utf-8", "replace"))
        seen, at[x] = x, n
    return [(at[s], k, at[e]) for s, k, e in spans]


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, vocabulary: str | None = None, max_ratio: float = MAX_RATIO) -> DataFrame:
    """One row per document: counts by fixed kind, the digest of the fixed
    spans, all spans."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(cols, texts):
        out = {n: [] for n in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")}
        for text in texts:
            spans = to_code_points(text, find_spans(text, path, max_ratio))
            kinds = [k for _, k, _ in spans]
            for k in KINDS:
                out[f"n_{k}"].append(kinds.count(k))
            base = _joined(x for x in spans if x[1] != "random")
            out["base_sha256"].append(hashlib.sha256(base.encode()).hexdigest())
            out["spans"].append(_joined(spans))
        return {"doc_id": cols["doc_id"], **out}

    return map_slices(
        with_bytes(docs, "doc_id"),
        run,
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long",
    )


def redact(docs: DataFrame, vocabulary: str | None = None, mask: str = "[secret]") -> DataFrame:
    """docs with every span replaced by ``mask``; n_chars follows the text.
    Texts without a span, null texts included, are returned as they are."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    schema = docs.schema
    names = docs.columns
    reach_package(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            sizes = {}
            for i, text in enumerate(texts):
                raw = (text or "").encode()
                spans = find_spans(raw, path)
                if not spans:
                    continue
                parts, seen = [], 0
                for s, _, e in spans:
                    if s >= seen:
                        parts += [raw[seen:s], mask.encode()]
                    seen = max(seen, e)
                texts[i] = b"".join([*parts, raw[seen:]]).decode("utf-8", "replace")
                sizes[i] = len(texts[i])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, type=batch.schema.field(at).type)
            if sizes and "n_chars" in batch.schema.names:
                j = batch.schema.get_field_index("n_chars")
                n = columns[j].to_pylist()
                columns[j] = pa.array([sizes.get(i, x) for i, x in enumerate(n)], type=batch.schema.field(j).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.select(*names).mapInArrow(run, schema)
