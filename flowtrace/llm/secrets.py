"""Secret scans with a token-efficiency test (operator 4).

Three base patterns find assignments, access keys and hexadecimal strings.  The
method adds kind ``random``: runs of 20 or more key characters that a tokenizer
vocabulary cuts into very short pieces.  Ordinary words and identifiers are made
of known pieces (many characters to a token); random strings are not.  Known
digests (hexadecimal strings of a digest's length), UUIDs, plain numbers, runs of
one class of characters are left out.  A run is cut at the base spans, and each
rest of 20 or more characters is tested.

Places count code points, ends are exclusive.  Defined results: null and empty
texts have no spans; rows are scanned one by one.
"""

from __future__ import annotations

import base64
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtrace.llm.common import id_and_text, map_batches, small_batches

KINDS = ("assign", "access", "hex", "random")
# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the same spans as runs of any length of which the short ones are dropped
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

RUN_CHARS = 20
RUN = re.compile(f"[A-Za-z0-9+/_=-]{{{RUN_CHARS},}}")
#: A run with fewer characters to a token is taken for random.
CHARS_PER_TOKEN = 2.0
DIGEST = re.compile(r"[0-9a-fA-F]+")
DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")

_VOCABULARY: dict[str, object] = {}


def vocabulary(path: str):
    """The tiktoken encoding of a rank file, loaded once in each worker."""
    if path not in _VOCABULARY:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _VOCABULARY[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _VOCABULARY[path]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the base patterns."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def looks_random(run: str, path: str) -> bool:
    """Is this run neither a digest nor an identifier, and cut into short tokens?"""
    if (DIGEST.fullmatch(run) and len(run) in DIGEST_LENGTHS) or UUID.fullmatch(run):
        return False
    classes = (any(map(str.isdigit, run)), any(map(str.islower, run)), any(map(str.isupper, run[1:])))
    if sum(classes) < 2:
        return False
    return len(run) < CHARS_PER_TOKEN * len(vocabulary(path).encode_ordinary(run))


def spans_of(text: str, path: str) -> list[tuple[int, int, int]]:
    """All spans as (start, number of the kind, end), by start, then kind."""
    found = base_spans(text)
    extra = [(a, 3, b) for m in RUN.finditer(text) for a, b in _rests(m.start(), m.end(), found) if looks_random(text[a:b], path)]
    return sorted(found + extra)


def _rests(start: int, end: int, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What the spans leave of a run, in parts that are runs themselves."""
    parts, at = [], start
    for a, _, b in sorted(s for s in spans if s[0] < end and s[2] > start):
        parts.append((at, a))
        at = max(at, b)
    return [(a, b) for a, b in [*parts, (at, end)] if b - a >= RUN_CHARS]


def find_secrets(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``spans`` (array of kind, start, end; by start, then kind) of every row's whole text."""
    small_batches(df.sparkSession)

    def scan(batch: pa.RecordBatch) -> dict[str, object]:
        rows = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans_of(t, path)]
                for t in batch.column("text").to_pylist()]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return {"spans": pa.array(rows, kind)}

    return map_batches(id_and_text(df, id_col, text_col), scan, "spans array<struct<kind: string, start: bigint, end: bigint>>").drop("text")


def of_kinds(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
