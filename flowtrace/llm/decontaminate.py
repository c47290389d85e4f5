"""Benchmark decontamination by SimHash of item-sized windows (operator 9).

Benchmark items are taken in blocks of a bounded number of words; every block
goes to the workers once and meets all documents.  For each length of an item the
windows of as many words are fingerprinted (running sums of the shingles' bit
votes).  A multi-index finds the items near a window: the 64 bits are cut into
8 blocks, and two fingerprints within radius 23 differ by at most 2 bits in one
block, so tables of the values within 2 bits of each block's value miss none.
Exact weighted similarity of the 5-word shingles (each weighs as often as it
occurs) then verifies: least weights over greatest weights, 0.8 or more.  A text
shorter than an item is one window, if it has 0.8 of the item's shingles or more.

A window without a shingle of an item has similarity zero to it, so only windows
that touch a shingle of an item of their length are fingerprinted.

Words are runs of letters, digits and underscores in lower case.  Items shorter
than a shingle are one shingle.  Defined results: null and empty texts and items
match nothing; repeated rows and items are matched one by one; null ids stay null.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from flowtrace.llm.common import small_batches

SHINGLE_WORDS, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 23, 8
#: Words of benchmark items that one pass takes to the workers, at most (one longer item makes a pass of its own).
PASS_WORDS = 2_000_000

WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def _shingle(words: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(words).encode())


def _votes(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each hash."""
    bits = np.unpackbits(hashes.astype("<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype("i4") * 2 - 1


def _prints(sums: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of vote sums."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel()


class Items:
    """One block of benchmark items with their fingerprints and the multi-index, all of one length of words."""

    def __init__(self, n_words: int, items: list[tuple[int, list[str]]]) -> None:
        self.n, self.k = n_words, min(SHINGLE_WORDS, n_words)
        self.numbers = [i for i, _ in items]
        self.weights = [Counter(_shingle(w[a:a + self.k]) for a in range(self.n - self.k + 1)) for _, w in items]
        self.prints = np.concatenate([
            _prints(_votes(np.array(list(c.elements()), "u8")).sum(axis=0, keepdims=True)) for c in self.weights])
        values = np.arange(256, dtype="u1")
        near = RADIUS // BLOCKS
        blocks = self.prints.astype("<u8").view("u1").reshape(-1, BLOCKS)
        self.tables = [np.bitwise_count(values[:, None] ^ blocks[None, :, b]) <= near for b in range(BLOCKS)]

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) with fingerprints within the radius."""
        blocks = prints.astype("<u8").view("u1").reshape(-1, BLOCKS)
        found = np.zeros((len(prints), len(self.prints)), bool)
        for b, table in enumerate(self.tables):
            found |= table[blocks[:, b]]
        window, item = np.nonzero(found)
        close = np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS
        return window[close], item[close]


class Index:
    """All items of one pass."""

    def __init__(self, items: list[tuple[int, list[str]]]) -> None:
        by_length: dict[int, list] = defaultdict(list)
        for number, words in items:
            if words:
                by_length[len(words)].append((number, words))
        self.lengths = [Items(n, group) for n, group in sorted(by_length.items())]
        self.vocabulary = {w for _, words in items for w in words}
        self.owners: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for at, group in enumerate(self.lengths):
            for weights in group.weights:
                for h in weights:
                    self.owners[group.k][h].add(at)
        self.owners = {k: dict(v) for k, v in self.owners.items()}

    def matches(self, text: str) -> list[tuple[int, int, int, float]]:
        """(item number, first word, words, similarity) of the best window for each item that the text holds."""
        words = words_of(text)
        if not words:
            return []
        known = np.fromiter(map(self.vocabulary.__contains__, words), bool, len(words))
        best: dict[int, tuple[float, int, int]] = {}
        for k, owners in self.owners.items():
            if len(words) < k:
                continue
            run = np.concatenate([[0], np.cumsum(known)])
            hits: dict[int, list[int]] = defaultdict(list)
            for a in np.flatnonzero(run[k:] - run[:-k] == k).tolist():
                for at in owners.get(_shingle(words[a:a + k]), ()):
                    hits[at].append(a)
            for at, places in hits.items():
                self._windows(words, self.lengths[at], places, best)
        return [(number, start, n, s) for number, (s, start, n) in best.items()]

    @staticmethod
    def _windows(words: list[str], group: Items, places: list[int], best: dict) -> None:
        """Fingerprint the windows that touch a place; verify those near an item."""
        n, k = min(group.n, len(words)), group.k
        size, wanted = n - k + 1, group.n - k + 1
        if size / wanted < SIMILARITY:  # a text too short to be that similar
            return
        starts = sorted({s for a in places for s in range(max(0, a - n + k), min(a, len(words) - n) + 1)})
        for run in np.split(np.array(starts), np.flatnonzero(np.diff(starts) > 1) + 1) if starts else []:
            for part in range(0, len(run), 1 << 14):
                some = run[part:part + (1 << 14)]
                first, last = int(some[0]), int(some[-1])
                hashes = np.array([_shingle(words[a:a + k]) for a in range(first, last + n - k + 1)], "u8")
                sums = np.concatenate([np.zeros((1, 64), "i4"), np.cumsum(_votes(hashes), axis=0, dtype="i4")])
                window, item = group.near(_prints(sums[size:] - sums[:-size]))
                for w, i in zip(window.tolist(), item.tolist(), strict=True):
                    have, want = Counter(hashes[w:w + size].tolist()), group.weights[i]
                    both = sum((have & want).values())
                    s = both / (size + wanted - both)
                    key = group.numbers[i]
                    if s >= SIMILARITY and (key not in best or s > best[key][0]):
                        best[key] = (s, first + w, n)


def _passes(items: DataFrame) -> Iterator[list]:
    """The items in blocks of at most PASS_WORDS words, read one block at a time."""
    block, size = [], 0
    for r in items.toLocalIterator():
        words = words_of(r.text)
        if block and size + len(words) > PASS_WORDS:
            yield block
            block, size = [], 0
        block.append((r.item_id, words))
        size += len(words)
    yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id``, ``item_id``, ``first_word``, ``n_words``, ``similarity``: one row for each item in each row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    schema = T.StructType([source.schema["doc_id"], T.StructField("item_id", items.schema["item_id"].dataType),
                           *T.StructType.fromDDL("first_word bigint, n_words bigint, similarity double")])
    found = None
    for block in _passes(items):
        shared = spark.sparkContext.broadcast(block)
        part = source.mapInArrow(_matcher(shared, [f.name for f in schema], to_arrow_type(schema["item_id"].dataType)), schema)
        found = part if found is None else found.union(part)
    return found


def _matcher(shared, names: list[str], id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        index = Index([(number, words) for number, (_, words) in enumerate(block)])
        for batch in batches:
            ids, rows = batch.column("doc_id"), []
            for at, text in enumerate(batch.column("text").to_pylist()):
                rows += [(at, *m) for m in index.matches(text)]
            if rows:
                at, number, first, n, s = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(at)), pa.array([block[i][0] for i in number], id_type),
                    pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array(s, pa.float64())], names=names)

    return run


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item, with the columns of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    columns = list(docs.columns)
    kept = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    items = benchmark.select("item_id", "text")
    for block in _passes(items):
        shared = spark.sparkContext.broadcast(block)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index([(number, words) for number, (_, words) in enumerate(shared.value)])
            for batch in batches:
                yield batch.filter(pa.array([not index.matches(t) for t in batch.column("text").to_pylist()], pa.bool_()))

        kept = kept.mapInArrow(clean, kept.schema)
    return kept.select("row.*")
