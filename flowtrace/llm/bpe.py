"""BPE encoding and decoding with a public byte-level vocabulary (operator 1).

Encoding finds, for every prefix of a pre-token, the one token that the merges
would leave last in it.  An Aho-Corasick automaton over the vocabulary lists the
tokens that end at a position; one of them is the last token exactly if it may
follow the last token of the prefix before it, that is if the merges, run over
the two tokens' bytes, leave this pair.  Following the last tokens back from the
end gives the ids.

Defined results: null text counts as empty and gives no ids; ids outside the
vocabulary are an error when decoding; null ids decode to the empty text.  The
text of the special token becomes its id, as in the tokenizers library.
"""

from __future__ import annotations

import hashlib
import json
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from flowtrace.llm.common import id_and_text, map_batches, small_batches

# Fixed value: the pattern of the byte-level pre-tokenizer.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Fixed value: Unicode white space, what \\s stands for above.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: No pre-token goes on behind a chunk: a run of other characters with the blank before it, or white space.
CHUNK = re.compile(f" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")

#: Bytes of chunks with their ids that a worker keeps, what an entry takes beside its characters, and the longest chunk that is kept.
CACHE_BYTES, ENTRY_BYTES, CACHE_CHARS = 160 << 20, 200, 64
#: Pairs of tokens whose compatibility is kept by a worker (about 120 bytes each).
PAIR_CACHE_SIZE, PAIR_BASE = 1 << 20, 1 << 24


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in printable}
    for b in range(256):
        letters.setdefault(b, chr(256 + len(letters) - len(printable)))
    return [letters[b] for b in range(256)]


def _spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


class Pieces:
    """The bytes of every token: all that decoding needs."""

    def __init__(self, spec: dict) -> None:
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes: list[bytes | None] = [None] * (max([*spec["model"]["vocab"].values(), *special.values()]) + 1)
        for text, token in spec["model"]["vocab"].items():
            self.token_bytes[token] = bytes(byte_of[c] for c in text)
        for text, token in special.items():
            self.token_bytes[token] = text.encode()

    def decode(self, ids: list[int]) -> str:
        pieces = self.token_bytes
        return b"".join([pieces[i] for i in ids]).decode("utf-8", errors="replace")


class Bpe(Pieces):
    """A byte-level BPE vocabulary with its encoder and decoder."""

    def __init__(self, spec: dict) -> None:
        super().__init__(spec)
        vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.pattern = regex.compile(PRE_TOKEN)
        # in merge order: rank of a merge, the two parts of a token, the token that a pair of ids makes
        self.rank, self.parts, self.joined = {}, {}, {}
        for order, (a, b) in enumerate(merges):
            made = vocab[a + b]
            self.joined.setdefault((vocab[a], vocab[b]), (order, made))
            if made not in self.parts:
                self.rank[made], self.parts[made] = order, (vocab[a], vocab[b])
        self.automaton = ahocorasick.Automaton()
        for text, token in vocab.items():
            # a token that its own merges do not leave whole is never the last one
            if token not in self.parts or self._whole(token):
                self.automaton.add_word(text, (token, len(text)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.cached = 0

    def _whole(self, token: int) -> bool:
        """Do the merges make this token of its own bytes?  True if its two parts may meet up to its own merge."""
        left, right = self.parts[token]
        return self._meets(left, right, self.rank[token])

    def _meets(self, left: int, right: int, bound: float = float("inf")) -> bool:
        """Does nothing merge across the border of the two tokens before merge number ``bound``?

        Undo the merges inside both tokens, latest first.  At every stage the two
        pieces at the border must not have a merge that comes before the stage's own.
        """
        limit, from_left = bound, False
        while True:
            across = self.joined.get((left, right))
            # at equal rank the leftmost pair goes first, which is the one in the left token
            if across is not None and (across[0] < limit or (across[0] == limit and not from_left and limit != bound)):
                return False
            l_rank, r_rank = self.rank.get(left, -1), self.rank.get(right, -1)
            if l_rank < 0 and r_rank < 0:
                return True
            if l_rank > r_rank:  # of two equal merges the right one is the later
                limit, left, from_left = l_rank, self.parts[left][1], True
            else:
                limit, right, from_left = r_rank, self.parts[right][0], False

    def _compatible(self, key: int) -> bool:
        if len(self.pairs) >= PAIR_CACHE_SIZE:
            self.pairs.clear()
        known = self.pairs[key] = self._meets(*divmod(key, PAIR_BASE))
        return known

    def _last_tokens(self, word: str) -> list[int]:
        """Ids of a pre-token given in byte letters."""
        n = len(word)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        known, compatible = self.pairs.get, self._compatible
        for end, (token, length) in self.automaton.iter(word):  # at each end the longest match first
            end += 1
            if last[end] >= 0:
                continue
            if end == length:
                last[end], size[end] = token, length
            elif (before := last[end - length]) >= 0:
                ok = known(key := before * PAIR_BASE + token)
                if ok or (ok is None and compatible(key)):
                    last[end], size[end] = token, length
        ids = []
        while n:
            ids.append(last[n])
            n -= size[n]
        return ids[::-1]

    def _chunk(self, chunk: str) -> bytes:
        letters, ids = self.letters, []
        for word in self.pattern.findall(chunk):
            ids += self._last_tokens("".join([letters[b] for b in word.encode()]))
        packed = np.array(ids, "<u4").tobytes()
        if len(chunk) <= CACHE_CHARS:
            self.cached += len(chunk) + len(packed) + ENTRY_BYTES
            if self.cached > CACHE_BYTES:
                self.cache.clear()
                self.cached = 0
            self.cache[chunk] = packed
        return packed

    def _plain(self, text: str) -> bytes:
        get, chunk = self.cache.get, self._chunk
        return b"".join([get(c) or chunk(c) for c in CHUNK.findall(text)])

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not self.special_pattern or not any(s in text for s in self.special):
            return self._plain(text)
        out, at = [], 0
        for m in self.special_pattern.finditer(text):
            out += [self._plain(text[at:m.start()]), np.array([self.special[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])


_LOADED: dict[tuple[type, str], Pieces] = {}


def load(path: str, kind: type = Bpe) -> Pieces:
    """The vocabulary, read once in each worker; ``Pieces`` for workers that only decode."""
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(_spec(path))
    return _LOADED[kind, path]


def _lists(parts: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(p) // 4 for p in parts)], dtype="i4")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), "<i4")))


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``ids`` (array<int>) of every row's whole text, one row per row."""
    small_batches(df.sparkSession)

    def ids(batch: pa.RecordBatch) -> dict[str, object]:
        bpe = load(path)
        return {"ids": _lists([bpe.encode(t) for t in batch.column("text").to_pylist()])}

    return map_batches(id_and_text(df, id_col, text_col), ids, "ids array<int>").drop("text")


def decode(df: DataFrame, path: str) -> DataFrame:
    """``df`` (``doc_id``, ``ids``) with ``decoded``, the text that the ids stand for."""
    small_batches(df.sparkSession)

    def texts(batch: pa.RecordBatch) -> dict[str, object]:
        bpe, lists = load(path, Pieces), batch.column("ids").fill_null([])
        ends, ids = lists.offsets.to_pylist(), lists.values.to_numpy(zero_copy_only=False).tolist()
        return {"decoded": pa.array([bpe.decode(ids[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())}

    return map_batches(df, texts, "decoded string")


def digest_ids(df: DataFrame) -> DataFrame:
    """``df`` (with ``ids``) with ``n_tokens`` and ``ids_sha256``."""

    def digest(batch: pa.RecordBatch) -> dict[str, object]:
        lists = batch.column("ids").fill_null([])
        ends = lists.offsets.to_numpy()
        raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<u4")).cast("B")
        return {"n_tokens": pa.array(np.diff(ends).astype("i8")),
                "ids_sha256": pa.array([hashlib.sha256(raw[4 * a:4 * b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())}

    return map_batches(df, digest, "n_tokens bigint, ids_sha256 string")


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids``, ``ids_sha256`` and ``decoded_sha256`` (digest of the text that the ids decode to).

    Encoding, decoding and both digests in one pass, so that a task has one worker.
    """
    small_batches(df.sparkSession)

    def made(batch: pa.RecordBatch) -> dict[str, object]:
        bpe = load(path)
        packed = [bpe.encode(t) for t in batch.column("text").to_pylist()]
        decoded = [hashlib.sha256(bpe.decode(np.frombuffer(p, "<u4").tolist()).encode()).hexdigest() for p in packed]
        return {"n_tokens": pa.array([len(p) // 4 for p in packed], pa.int64()), "ids": _lists(packed),
                "ids_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                "decoded_sha256": pa.array(decoded, pa.string())}

    return map_batches(id_and_text(df, id_col, text_col), made,
                       "n_tokens bigint, ids array<int>, ids_sha256 string, decoded_sha256 string").drop("text")
