"""Language-model scoring with a log-frequency Bloom filter (operator 8).

Counts of words and word pairs of the training texts are quantised to powers of
two: an n-gram of level q is put into the filter q times, as (n-gram, 1) to
(n-gram, q).  Probing (n-gram, 1), (n-gram, 2), ... until one is missing gives the
level back, with a small chance of a level too many.  The probability of a word
after another is the pair's count, smoothed with the word's own:
(c(vw) + A p(w)) / (c(v) + A).

The filter is cut into segments by the n-gram's hash.  One pass over the training
texts counts words and pairs together; one shuffle brings the pre-summed counts of
a segment together, packed as one row for each task and segment, where its bits
are set and the exact counts of its words are summed up.  A segment has
BITS_PER_ITEM bits for each item, whatever the corpus.  While all segments have
MAX_BYTES at most, they are joined on the driver and broadcast.  Beyond it they
stay a table: the texts to score are taken in chunks, the different n-grams of a
chunk go to their segments by a shuffle, and the levels that are found come back
to the chunk by another.  Either way gives the same score.

The base score needs exact counts.  The HOT_WORDS most frequent words go to the
workers with their counts; occurrences of other words are joined with the table
of counts.

Words are what ASCII white space separates, A-Z in lower case; every text ends
with one end token, which is also the context of its first word.  Defined
results: null and empty texts are one end token; without training texts every
word has probability 1 by the given formula; rows are scored one by one.
"""

from __future__ import annotations

import ctypes
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from flowtrace.llm.common import TEXT_BATCH_ROWS, fold, small_batches, stored

END = b"\n"  # no word holds a line feed
BITS_PER_ITEM, PROBES = 8, 4
#: Bytes of a filter that is broadcast, at most; a larger one stays a table.  The driver holds it twice for a moment.
MAX_BYTES = 128 << 20
#: Bytes of text whose n-grams are looked up together in a filter that stays a table.
CHUNK_BYTES = 16 << 20
#: Bits of a segment that ``_slots`` can tell apart.
MOST_BITS = 1 << 32
#: Words whose counts are broadcast.
HOT_WORDS = 200_000
#: Tokens whose n-grams a task sums up before it hands them on, and different words that it numbers at most.
PENDING_TOKENS, NUMBERED_WORDS = 1 << 22, 1 << 19
#: Different words that a scoring task keeps what it has looked up of; it holds the filter as well.
SCORED_WORDS = 1 << 17
#: Bytes of training text to a segment of the filter, about; segments are powers of two.
SEGMENT_BYTES, LEAST_SEGMENTS = 8 << 20, 64
#: Weight of a word's own probability, in pair counts.
SMOOTHING = 2.0


def _give_back() -> None:
    """Return freed memory to the system.  Workers are used again, with all that an earlier stage has left them."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return df.select(F.col(id_col).alias("doc_id"), text.alias("text"))


class Numbers(dict):
    """Numbers words in the order they come, from 0 for the end token; ``words`` has them in that order."""

    def __init__(self) -> None:
        super().__init__({END: 0})
        self.words = [END]

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.words)
        self.words.append(word)
        return number

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), "i4", len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w, 8) for w in words], "u8")


def _pair_hashes(numbers: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Hashes of the pairs that the words end.  Texts follow one another, so the first word of each follows an end token."""
    own = hashes[numbers]
    before = np.concatenate([hashes[:1], own[:-1]])
    return _mix(before * np.uint64(0x9E3779B97F4A7C15) + own)


def _shift(segments: int) -> np.uint64:
    return np.uint64(64 - segments.bit_length() + 1)


def _by_segment(h: np.ndarray, shift: np.uint64) -> dict[int, slice]:
    """Where the sorted hashes of each segment lie, for segments that have any."""
    found, starts = np.unique(h >> shift, return_index=True)
    return {s: slice(a, b) for s, a, b in zip(found.tolist(), starts.tolist(), [*starts[1:].tolist(), len(h)], strict=True)}


def _ngram_counts(texts: DataFrame, segments: int) -> DataFrame:
    """Counts of n-grams, summed up within tasks: a row for each segment.

    ``h`` and ``n`` pack hashes and counts; the first of them belong to the words in ``tokens``.
    """
    shift, none = _shift(segments), slice(0, 0)

    def packed(numbered: Numbers, pending: list[np.ndarray]) -> pa.RecordBatch:
        numbers, hashes = np.concatenate(pending), _word_hashes(numbered.words)
        pairs, n_pairs = np.unique(_pair_hashes(numbers, hashes), return_counts=True)
        n_words = np.bincount(numbers, minlength=len(hashes))
        words = _mix(hashes)
        order = np.argsort(words)
        order = order[n_words[order] > 0]
        words, n_words = words[order], n_words[order]
        tokens_ = [numbered.words[i] for i in order.tolist()]
        at_word, at_pair, rows = _by_segment(words, shift), _by_segment(pairs, shift), []
        for s in sorted(at_word.keys() | at_pair.keys()):
            w, p = at_word.get(s, none), at_pair.get(s, none)
            rows.append((s, words[w].tobytes() + pairs[p].tobytes(),
                         n_words[w].astype("u4").tobytes() + n_pairs[p].astype("u4").tobytes(), tokens_[w]))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.binary())), strict=True)],
            names=["segment", "h", "n", "tokens"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbered, pending, size = Numbers(), [], 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                pending.append(numbered.of(tokens(text)))
                size += len(pending[-1])
                if size >= PENDING_TOKENS or len(numbered) >= NUMBERED_WORDS:
                    yield packed(numbered, pending)
                    numbered, pending, size = Numbers(), [], 0
        if pending:
            yield packed(numbered, pending)
        del numbered, pending
        _give_back()

    return texts.select("text").mapInArrow(count, "segment int, h binary, n binary, tokens array<binary>")


def _items(h: np.ndarray, level: int) -> np.ndarray:
    """The hash of each n-gram's item of a level."""
    return _mix(h + np.uint64(level * 0xD1B54A32D192ED03 % 2**64))


def _slots(items: np.ndarray, probe: int, sizes: np.ndarray | np.uint64) -> np.ndarray:
    """The bit of each item for one probe, within its segment of ``sizes`` bits."""
    low = np.uint64(0xFFFFFFFF)
    at = ((items >> np.uint64(32)) + np.uint64(probe) * (items & low | np.uint64(1))) & low
    return (at * sizes) >> np.uint64(32)


def _levels(counts: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(counts)).astype("i8") + 1


def _middles(level: np.ndarray) -> np.ndarray:
    """Counts for levels: the middle of the level's range."""
    return np.where(level == 0, 0.0, np.where(level == 1, 1.0, 1.5 * 2.0 ** (level - 1)))


def _segment_bits(most: int):
    """Sum up the counts of a segment: a row with its bits, and a row for each of its words.

    A segment that would need more than ``most`` bits is an error.
    """

    def build(rows: pa.Table) -> pa.Table:
        _give_back()
        hs = [np.frombuffer(x, "u8") for x in rows.column("h").to_pylist()]
        ns = [np.frombuffer(x, "u4") for x in rows.column("n").to_pylist()]
        lists = rows.column("tokens").to_pylist()
        words = pa.table({"token": pa.array([t for some in lists for t in some], pa.binary()),
                          "n": np.concatenate([n[:len(some)] for n, some in zip(ns, lists, strict=True)]).astype("i8")})
        words = words.group_by("token").aggregate([("n", "sum")])
        h, inverse = np.unique(np.concatenate(hs), return_inverse=True)
        levels = _levels(np.bincount(inverse, np.concatenate(ns)))
        size = max(64, int(levels.sum()) * BITS_PER_ITEM // 64 * 64)
        if size > most:
            raise ValueError(f"a segment of {size} bits, more than {most}")
        bits = np.zeros(size, bool)
        for level in range(1, int(levels.max()) + 1):
            items = _items(h[levels >= level], level)
            for probe in range(PROBES):
                bits[_slots(items, probe, np.uint64(size))] = True
        made, segment = np.packbits(bits, bitorder="little").tobytes(), rows.column("segment")[0].as_py()
        return pa.table({
            "segment": pa.array([segment] * (1 + len(words)), pa.int32()),
            "bits": pa.array([made] + [None] * len(words), pa.binary()),
            "token": pa.array([None] + words.column("token").to_pylist(), pa.binary()),
            "n": pa.array([None] + words.column("n_sum").to_pylist(), pa.int64())})

    return build


class Filter:
    """The log-frequency Bloom filter."""

    def __init__(self, sizes: np.ndarray, held: np.ndarray, shift: np.uint64 | None) -> None:
        """``sizes``: bytes of each segment; ``held``: their bits, one after another; no ``shift``: one segment for all."""
        self.shift, self.sizes = shift, sizes.astype("u8") * np.uint64(8)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype("u8")
        self.bytes = held

    @classmethod
    def whole(cls, bits: DataFrame, segments: int) -> Filter:
        """The filter of all segments (``segment``, ``bits``), taken to the driver segment by segment."""
        sizes = np.zeros(segments, "i8")
        for r in bits.select("segment", F.octet_length("bits").alias("n")).collect():
            sizes[r.segment] = r.n
        ends, held = np.cumsum(sizes), np.zeros(int(sizes.sum()), "u1")
        for r in bits.toLocalIterator():
            held[ends[r.segment] - sizes[r.segment]:ends[r.segment]] = np.frombuffer(r.bits, "u1")
        return cls(sizes, held, _shift(segments))

    @classmethod
    def one(cls, bits: bytes) -> Filter:
        return cls(np.array([len(bits)]), np.frombuffer(bits, "u1"), None)

    def levels(self, h: np.ndarray) -> np.ndarray:
        """Levels of n-grams as the filter has them, 0 if absent."""
        level = np.zeros(len(h), "i8")
        segment = np.zeros(len(h), "i8") if self.shift is None else (h >> self.shift).astype("i8")
        alive = np.flatnonzero(self.sizes[segment] > 0)
        at = 1
        while len(alive):
            items = _items(h[alive], at)
            for probe in range(PROBES):
                own = segment[alive]
                slot = self.starts[own] + _slots(items, probe, self.sizes[own])
                there = (self.bytes[(slot >> np.uint64(3)).astype("i8")] >> (slot & np.uint64(7)).astype("u1")) & 1 == 1
                alive, items = alive[there], items[there]
            level[alive] = at
            at += 1
            if at > 62:
                break
        return level

    def counts(self, h: np.ndarray) -> np.ndarray:
        return _middles(self.levels(h))


class Found:
    """The levels of a chunk's n-grams that the filter has."""

    def __init__(self, h: np.ndarray, levels: np.ndarray) -> None:
        order = np.argsort(h)
        self.h, self.levels = h[order], levels[order]

    def counts(self, h: np.ndarray) -> np.ndarray:
        if not len(self.h):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return _middles(np.where(self.h[at] == h, self.levels[at], 0).astype("i8"))


def _text_bytes(texts: DataFrame) -> int:
    return texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def learn_counts(texts: DataFrame) -> tuple[DataFrame, int, DataFrame]:
    """The filter (``segment``, ``bits``), the number of its segments, and ``token`` (binary) and ``n`` of every word."""
    n_bytes, segments = _text_bytes(texts), LEAST_SEGMENTS
    while segments * SEGMENT_BYTES < n_bytes:
        segments *= 2
    made = stored(_ngram_counts(texts, segments).groupBy("segment").applyInArrow(
        _segment_bits(MOST_BITS), "segment int, bits binary, token binary, n bigint"))
    return made.filter("bits is not null").select("segment", "bits"), segments, made.filter("token is not null").select("token", "n")


def score(df: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` of every row's whole text.

    ``training`` holds the rows to learn from, with the same columns.
    """
    spark = df.sparkSession
    small_batches(spark)
    bits, segments, counts = learn_counts(_texts(training, id_col, text_col))
    total, different = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    below = total + 0.5 * (different + 1)
    most = counts.orderBy(F.desc("n"), "token").limit(HOT_WORDS).toArrow()  # rows as objects would take ten times the memory
    hot = dict(zip(most.column("token").to_pylist(), [math.log10((n + 0.5) / below) for n in most.column("n").to_pylist()], strict=True))
    rows = _texts(df, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    kind = rows.schema["doc_id"].dataType.simpleString()
    made = f"doc_id {kind}, row bigint, n_tokens bigint, n_hot bigint, hot_score double, score double, rest array<binary>"
    size = bits.agg(F.coalesce(F.sum(F.octet_length("bits").cast("bigint")), F.lit(0))).first()[0]
    bloom = Filter.whole(bits, segments) if size <= MAX_BYTES else None
    shared = spark.sparkContext.broadcast((bloom, hot))
    del bloom, hot, most  # the workers have them
    _give_back()
    whole = rows.mapInArrow(_scorer(shared, below), made) if size <= MAX_BYTES else _score_chunks(rows, bits, segments, shared, below, made)
    scored = stored(whole)
    shared.destroy()
    rest = scored.select("row", F.explode("rest").alias("token"))
    # words are counted before the join, within the row that has them
    rest = rest.join(counts, "token", "left").groupBy("row").agg(
        F.count("n").alias("n_rest"), F.sum(F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(below))).alias("rest_score"))
    return scored.drop("rest").join(rest, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_hot") + F.coalesce("n_rest", F.lit(0))).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("hot_score") + F.coalesce("rest_score", F.lit(0.0))).alias("base_score"), "score")


def _score_chunks(rows: DataFrame, bits: DataFrame, segments: int, shared, below: float, made: str) -> DataFrame:
    """What ``_scorer`` makes of ``rows``, with a filter that is too large for a broadcast."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    # a chunk's rows, and the n-grams that it asks each segment for
    asked = stored(rows.mapInArrow(_asker(segments, CHUNK_BYTES), f"chunk bigint, doc_id {kind}, row bigint, text binary, segment int, h binary"))
    # a segment's n-grams are cut into parts if there is more to score than was learnt
    parts = 1 + _text_bytes(rows) // (segments * SEGMENT_BYTES)
    probes = asked.filter("h is not null").select("segment", F.pmod(F.xxhash64("chunk"), F.lit(parts)).alias("part"), "chunk", "h")
    held = bits.select("segment", F.explode(F.sequence(F.lit(0), F.lit(parts - 1).cast("bigint"))).alias("part"), "bits")
    levels = probes.groupBy("segment", "part").cogroup(held.groupBy("segment", "part")).applyInArrow(
        _answer, "chunk bigint, h binary, level binary")
    texts = asked.filter("text is not null").select("chunk", "doc_id", "row", "text")

    def run(texts: pa.Table, levels: pa.Table) -> pa.Table:
        h, level = (np.frombuffer(b"".join(levels.column(c).to_pylist()), t) for c, t in (("h", "u8"), ("level", "u1")))
        score_rows = _scorer(shared, below, Found(h, level))
        batches = list(score_rows(texts.select(["doc_id", "row", "text"]).to_batches(max_chunksize=TEXT_BATCH_ROWS)))
        return pa.Table.from_batches(batches) if batches else none

    none = pa.table({n: pa.array([], t) for n, t in (
        ("doc_id", to_arrow_type(rows.schema["doc_id"].dataType)), ("row", pa.int64()), ("n_tokens", pa.int64()), ("n_hot", pa.int64()),
        ("hot_score", pa.float64()), ("score", pa.float64()), ("rest", pa.list_(pa.binary())))})
    return texts.groupBy("chunk").cogroup(levels.groupBy("chunk")).applyInArrow(run, made)


def _asker(segments: int, chunk_bytes: int):
    """Cut rows into chunks, named after their first row: the rows themselves, and the different n-grams for each segment."""
    shift = _shift(segments)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size, numbered, pending, kind = None, 0, Numbers(), [], None

        def asked() -> pa.RecordBatch:
            hashes = _word_hashes(numbered.words)
            h = np.unique(np.concatenate([_mix(hashes), _pair_hashes(np.concatenate(pending), hashes)]))
            at = _by_segment(h, shift)
            n = len(at)
            return pa.RecordBatch.from_arrays(
                [pa.array([chunk] * n, pa.int64()), pa.nulls(n, kind), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()),
                 pa.array(list(at), pa.int32()), pa.array([h[part].tobytes() for part in at.values()], pa.binary())], names=names)

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            texts, row, chunks = batch.column("text").to_pylist(), batch.column("row").to_pylist(), []
            full = []
            for text, at in zip(texts, row, strict=True):
                if chunk is None:
                    chunk = at
                chunks.append(chunk)
                pending.append(numbered.of(tokens(text)))
                size += len(text)
                if size >= chunk_bytes:
                    full.append(asked())
                    chunk, size, numbered, pending = None, 0, Numbers(), []
            n = len(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(chunks, pa.int64()), batch.column("doc_id"), batch.column("row"), pa.array(texts, pa.binary()),
                 pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
            yield from full
        if pending:
            yield asked()

    names = ["chunk", "doc_id", "row", "text", "segment", "h"]
    return run


def _answer(probes: pa.Table, held: pa.Table) -> pa.Table:
    """The n-grams of each chunk that a segment has, with their levels."""
    chunks, hs, levels = [], [], []
    if held.num_rows and probes.num_rows:
        bloom = Filter.one(held.column("bits")[0].as_py())
        for chunk, h in zip(probes.column("chunk").to_pylist(), probes.column("h").to_pylist(), strict=True):
            h = np.frombuffer(h, "u8")
            level = bloom.levels(h)
            chunks.append(chunk)
            hs.append(h[level > 0].tobytes())
            levels.append(level[level > 0].astype("u1").tobytes())
    return pa.table({"chunk": pa.array(chunks, pa.int64()), "h": pa.array(hs, pa.binary()), "level": pa.array(levels, pa.binary())})


def _scorer(shared, below: float, found: Found | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _give_back()
        bloom, hot = shared.value
        bloom = found or bloom
        numbered, hashes = Numbers(), np.zeros(0, "u8")
        for batch in batches:
            if not batch.num_rows:
                continue
            if len(numbered) >= SCORED_WORDS:
                numbered, hashes = Numbers(), hashes[:0]
            words, n_tokens = [], []
            for text in batch.column("text").to_pylist():
                own = tokens(text)
                words += own
                n_tokens.append(len(own))
            numbers = numbered.of(words)
            if not len(hashes):
                logs = single = np.zeros(0)
            new = numbered.words[len(hashes):]  # what is known of a word is looked up once
            fresh = _word_hashes(new)
            hashes = np.concatenate([hashes, fresh])
            single = np.concatenate([single, bloom.counts(_mix(fresh))])
            logs = np.concatenate([logs, [hot.get(w, math.nan) for w in new]])

            first = np.concatenate([[0], np.cumsum(n_tokens)[:-1]])
            base = logs[numbers]
            is_rest = np.isnan(base)
            n_rest = np.add.reduceat(is_rest.astype("i8"), first)
            rest = pa.array([words[i] for i in np.flatnonzero(is_rest).tolist()], pa.binary())
            offsets = pa.array(np.concatenate([[0], np.cumsum(n_rest)]).astype("i4"))
            pair = bloom.counts(_pair_hashes(numbers, hashes))
            own = single[numbers]
            before = np.concatenate([single[:1], own[:-1]])
            alone = (own + 0.5) / below
            p = (np.minimum(pair, before) + SMOOTHING * alone) / (before + SMOOTHING)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(n_tokens, pa.int64()), pa.array(np.array(n_tokens) - n_rest, pa.int64()),
                 pa.array(np.add.reduceat(np.where(is_rest, 0.0, base), first)),
                 pa.array(np.add.reduceat(np.log10(np.minimum(1.0, p)), first)), pa.ListArray.from_arrays(offsets, rest)],
                names=["doc_id", "row", "n_tokens", "n_hot", "hot_score", "score", "rest"])

    return run


def score_held_out(docs: DataFrame) -> DataFrame:
    """Learn from the rows outside the held-out fold, then score all rows."""
    made = score(docs, docs.filter(fold(F.col("doc_id"), 5) != 1))
    return made.select("doc_id", (fold(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
