"""Secret scans: fixed patterns, and strings that a public vocabulary compresses badly.

A byte-pair vocabulary learnt on ordinary text spends few tokens on ordinary words and many on random strings, so
characters per token fall to about two or less on keys and passwords. Every run of at least MIN_CHARS key characters with
a letter, wherever it stands (after = as well), is a candidate; known digests (hexadecimal of a digest's length) and
identifiers (UUIDs) are excluded; what is left with at most MAX_RATIO characters per token, or LETTERS_RATIO where it
has no digit (long words in few letters' languages come near two), is a span of kind `opaque`, unless a span of the
fixed patterns covers it already.

Defined cases: a null text counts as empty and has no spans; spans that begin together go by kind; repeated rows each give
a row; an empty table gives an empty result; other columns of the input play no part. Texts are scanned whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame

from .common import by_rows, rewritten

# Kinds in order, and their patterns.
KINDS = ("assign", "access", "hex", "opaque")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
LEAST = {"assign": 6, "access": 20, "hex": 24}

MIN_CHARS = 16
MAX_RATIO, LETTERS_RATIO = 2.2, 1.7
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{MIN_CHARS},}}={{0,2}}")
DIGIT, LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
DIGEST_LENGTHS = (32, 40, 48, 56, 64, 96, 128)
DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")

COLUMNS = "doc_id long, n_assign long, n_access long, n_hex long, n_opaque long, base_sha256 string, spans string, min_ratio double"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_opaque", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("min_ratio", pa.float64())])


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the fixed patterns, in that order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def known(string: str) -> bool:
    """A digest or an identifier, by form."""
    return bool(len(string) in DIGEST_LENGTHS and DIGEST.fullmatch(string) or UUID.fullmatch(string))


def opaque_spans(text: str, vocabulary: str) -> list[tuple[int, int, float]]:
    """(start, end, characters per token) of candidate strings with a low ratio."""
    found = []
    for m in CANDIDATE.finditer(text):
        string = m[0]
        if LETTER.search(string) and not known(string):
            ratio = len(string) / len(encoding(vocabulary).encode_ordinary(string))
            if ratio <= (MAX_RATIO if DIGIT.search(string) else LETTERS_RATIO):
                found.append((m.start(), m.end(), ratio))
    return found


def scan_text(text: str | None, vocabulary: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], float | None]:
    """Base spans, all spans, and the lowest ratio among the opaque ones."""
    text = text or ""
    base = base_spans(text)
    starts, furthest = [x[0] for x in base], list(accumulate((x[2] for x in base), max))
    covered = lambda start, end: (i := bisect_right(starts, start)) > 0 and furthest[i - 1] >= end
    more = [x for x in opaque_spans(text, vocabulary) if not covered(x[0], x[1])]
    return base, sorted([*base, *((start, 3, end) for start, end, _ in more)]), min((x[2] for x in more), default=None)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan_secrets(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """A row for each row of docs (doc_id, text): counts, the digest of the base spans, all spans, the lowest ratio."""
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def make(columns: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {f.name: [] for f in ARROW}
        out["doc_id"] = columns["doc_id"]
        for text in columns["text"]:
            base, spans, ratio = scan_text(text, vocabulary)
            for kind, name in enumerate(KINDS):
                out[f"n_{name}"].append(sum(x[1] == kind for x in spans))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(spans))
            out["min_ratio"].append(ratio)
        return out

    return docs.select("doc_id", "text").mapInArrow(by_rows(make, ARROW), COLUMNS)


def redact_secrets(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """docs with [KIND] in place of every span (overlapping spans become one, named by the first); other columns and n_chars follow the text."""
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def clean(text: str) -> str:
        parts, at = [], 0
        for start, kind, end in scan_text(text, vocabulary)[1]:
            if start >= at:
                parts += [text[at:start], f"[{KINDS[kind].upper()}]"]
            at = max(at, end)
        return "".join(parts) + text[at:] if parts else text

    return rewritten(docs, clean)
