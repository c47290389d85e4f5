"""Ranked lexical search with geometric blocks in every posting list (operator 12).

Documents are vectors over the items' terms; a coordinate is the part of a term's
score that depends on the document alone.  Documents are put in order of their
similarity (the nearest two of a few sampled vectors, then the closeness to the
nearest), and that order cuts every term's posting list into blocks of similar
documents.  The index stores for each block its documents and a summary: the
greatest value of every coordinate among them.

For an item, each block of each of its terms has a bound: the summary's product
with the item's weights.  No document of the block scores higher, so a block is
skipped only if its bound is below the score that ten documents are known to reach
(found exactly on a hash sample of the documents).  A document stands in the lists
of all its terms; the list of its rarest term answers for it, so the bound of a
block counts the block's own term and more frequent ones alone.  Documents of the
blocks that are left are scored exactly, and the ten best of each item stay.

A summary holds the coordinates that an item of the pass has together with the
block's term, up to CO_TERMS after it an item; what an item has beyond these counts
with the greatest value that any coordinate can have.  So a skipped block is always
one that can't matter.

All scores are whole numbers below 2**53 in each product, so double products are
exact.  Items are taken in passes of a bounded number of terms; every pass meets
all documents.

Defined results: null or empty texts and items match nothing; items are ranked row
by row, repeated ones each on their own; equal scores are in order of doc_id, null
ids last, and of the row's place where ids are equal.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtrace.llm.common import small_batches, stored
from flowtrace.operators.ordered import slice_count

TOP = 10
#: Different terms of the items of one pass, counted item by item (one larger item makes a pass of its own).
PASS_TERMS = 100_000
#: Documents in a block of a posting list, coordinates of a summary for each item, and cells of a chunk's matrix.
BLOCK_DOCS, CO_TERMS, CHUNK_CELLS, CHUNK_DOCS = 32, 128, 1 << 23, 2048
#: Sampled vectors that documents are compared with, and the length that vectors are folded to for that.
CENTRES, FOLDED = 64, 4096
#: One document in THRESHOLD_SAMPLE is scored beforehand, for a score that ten documents reach.
THRESHOLD_SAMPLE = 16
#: No coordinate is greater: 10**9 * tf // (1000 * tf + 8 * m) < 10**6.
MOST = 1_000_000

# Terms are runs of ASCII letters and digits and of all bytes of other characters; A-Z in lower case.
_PLAIN = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return text.translate(_PLAIN).split()


class Items:
    """The items of a pass: their ids and term counts, and a number for every term."""

    def __init__(self, rows: list[tuple[object, dict[bytes, int]]]) -> None:
        self.ids = [i for i, _ in rows]
        self.counts = [c for _, c in rows]
        self.vocab = {t: n for n, t in enumerate(sorted(set().union(*self.counts)))}


def passes(items: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    held, size = [], 0
    for r in items.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).toLocalIterator():
        counts = Counter(terms_of((r.t or "").encode()))
        if held and size + len(counts) > PASS_TERMS:
            yield Items(held)
            held, size = [], 0
        held.append((r.i, counts))
        size += len(counts)
    if size:
        yield Items(held)


class Weights:
    """What the corpus says of a pass's terms: weights and order, and who asks for which coordinates."""

    def __init__(self, items: Items, n_docs: int, n_terms: int, frequency: np.ndarray) -> None:
        self.n_docs, self.n_terms = n_docs, n_terms
        # the same double arithmetic for every term, done once on the driver
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(f) + 1))) for f in frequency], "i8")
        self.items: list[tuple[np.ndarray, np.ndarray]] = []  # term numbers, rarest first; weight times repeats
        for counts in items.counts:
            terms = sorted((items.vocab[t] for t in counts), key=lambda t: (frequency[t], t))
            repeats = {items.vocab[t]: c for t, c in counts.items()}
            self.items.append((np.array(terms, "i8"), np.array([int(self.weight[t]) * repeats[t] for t in terms], "i8")))
        together: dict[int, set[int]] = {}
        asking: dict[int, list[tuple[int, int]]] = {}
        for q, (terms, _) in enumerate(self.items):
            for at, t in enumerate(terms.tolist()):
                together.setdefault(t, set()).update(terms[at:at + CO_TERMS].tolist())
                asking.setdefault(t, []).append((q, at))
        #: for each term the coordinates of its summaries
        self.co = {t: np.array(sorted(s), "i8") for t, s in together.items()}
        #: for each term the items that have it, their weights over the summary's coordinates, and what lies beyond
        self.asks: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for t, who in asking.items():
            matrix, beyond = np.zeros((len(who), len(self.co[t]))), np.zeros(len(who))
            for row, (q, at) in enumerate(who):
                terms, value = self.items[q]
                matrix[row, np.searchsorted(self.co[t], terms[at:at + CO_TERMS])] = value[at:at + CO_TERMS]
                beyond[row] = float(value[at + CO_TERMS:].sum()) * MOST
            self.asks[t] = (np.array([q for q, _ in who]), matrix, beyond)
        self.size = len(items.vocab)

    def coordinates(self, n: int, counts: np.ndarray) -> np.ndarray:
        """The document's part of the score for each of its term counts."""
        m = 25 + 75 * n * self.n_docs // self.n_terms
        counts = counts.astype("i8")
        return 1_000_000_000 * counts // (1000 * counts + 8 * m)

    def scores(self, terms: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Scores of a document for all items."""
        whole = np.zeros(len(self.items), "i8")
        for t, v in zip(terms.tolist(), values.tolist(), strict=True):
            who, value = self._of_term(t)
            whole[who] += value * v
        return whole

    def _of_term(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Items that have a term, and the weight of the term in each."""
        if not hasattr(self, "_by_term"):
            self._by_term: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        if t not in self._by_term:
            who = self.asks[t][0]
            value = [int(self.items[q][1][np.flatnonzero(self.items[q][0] == t)[0]]) for q in who.tolist()]
            self._by_term[t] = (who, np.array(value, "i8"))
        return self._by_term[t]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ends and values of a list column, from the first row of the batch on."""
    ends = column.offsets.to_numpy()
    return ends - ends[0], column.flatten().to_numpy(zero_copy_only=False)


def _list_array(parts: list[np.ndarray], dtype: str) -> pa.Array:
    ends = np.cumsum([0, *(len(p) for p in parts)], dtype="i4")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.zeros(0, dtype)]).astype(dtype)))


def vectors(docs: DataFrame, vocab: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """``row`` (a number of its own), ``doc_id``, ``n`` and the counts of the items' terms, of every text with a term."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    schema = T.StructType([source.schema["doc_id"], *T.StructType.fromDDL("n bigint, terms array<int>, counts array<int>")])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, sizes, terms, counts = [], [], [], []
            for at, text in enumerate(batch.column("text").to_pylist()):
                words = terms_of(text)
                if not words:
                    continue
                found = sorted((vocab[w], c) for w, c in Counter(words).items() if w in vocab)
                pairs = np.array(found, "i4").reshape(-1, 2)
                keep.append(at)
                sizes.append(len(words))
                terms.append(pairs[:, 0])
                counts.append(pairs[:, 1])
            if keep:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(keep)), pa.array(sizes, pa.int64()), _list_array(terms, "i4"), _list_array(counts, "i4")],
                    names=schema.names)

    return stored(source.mapInArrow(made, schema).withColumn("row", F.monotonically_increasing_id()))


def _folded(terms: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A vector of length one, its coordinates added up to FOLDED of them."""
    v = np.bincount(terms % FOLDED, weights=values, minlength=FOLDED)
    return v / max(float(np.sqrt(v @ v)), 1e-300)


def by_similarity(rows: DataFrame, weights: Weights) -> DataFrame:
    """``rows`` in slices of similar documents, in order: by the nearest two centres, then by closeness."""
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(CENTRES).select("terms", "counts", "n").collect()
    centre = [(np.array(r.terms, "i8"), weights.coordinates(r.n, np.array(r.counts, "i8"))) for r in sample]
    centres = np.array([_folded(t, weights.weight[t] * v) for t, v in centre]).reshape(-1, FOLDED).T.copy()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, terms = _lists(batch.column("terms"))
            _, counts = _lists(batch.column("counts"))
            cells, near = np.zeros(batch.num_rows, "i4"), np.zeros(batch.num_rows)
            for at, n in enumerate(batch.column("n").to_pylist()):
                mine = terms[ends[at]:ends[at + 1]]
                value = weights.weight[mine] * weights.coordinates(n, counts[ends[at]:ends[at + 1]])
                alike = (value @ centres[mine % FOLDED]) / max(float(np.sqrt((value * value.astype("f8")).sum())), 1e-300)
                best = np.argsort(-alike, kind="stable")[:2]
                cells[at], near[at] = best[0] * CENTRES + best[-1], -alike[best[0]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells), pa.array(near)], names=[*batch.schema.names, "cell", "near"])

    there = rows.select("row", "n", "terms", "counts")
    schema = T.StructType([*there.schema, *T.StructType.fromDDL("cell int, near double")])
    order = ["cell", "near", "row"]
    return there.mapInArrow(placed, schema).repartitionByRange(slice_count(rows), *order).sortWithinPartitions(*order)


def block_index(rows: DataFrame, weights: Weights) -> DataFrame:
    """The posting lists in blocks: ``term``, ``docs`` (rows of the block) and ``most``, its summary over the term's coordinates."""
    chunk_docs = max(64, min(CHUNK_DOCS, CHUNK_CELLS // max(weights.size, 1)))

    def blocks(docs: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        row = np.array([r for r, _, _ in docs], "i8")
        doc = np.repeat(np.arange(len(docs)), [len(t) for _, t, _ in docs])
        terms = np.concatenate([t for _, t, _ in docs]).astype("i8")
        there, local = np.unique(terms, return_inverse=True)
        matrix = np.zeros((len(docs), len(there) + 1), "i4")  # the last column stands for terms that no document has
        matrix[doc, local] = np.concatenate([v for _, _, v in docs])
        by_term = np.argsort(local, kind="stable")  # documents stay in order of similarity
        lists = np.split(doc[by_term], np.cumsum(np.bincount(local, minlength=len(there)))[:-1])
        made_term, made_docs, made_most = [], [], []
        for t, members in zip(there.tolist(), lists, strict=True):
            co = weights.co[t]
            at = np.minimum(np.searchsorted(there, co), len(there) - 1)
            columns = np.where(there[at] == co, at, len(there))
            starts = np.arange(0, len(members), BLOCK_DOCS)
            most = np.maximum.reduceat(matrix[np.ix_(members, columns)], starts, axis=0)
            made_term += [t] * len(starts)
            made_docs += np.split(row[members], starts[1:])
            made_most += list(most)
        return pa.RecordBatch.from_arrays(
            [pa.array(made_term, pa.int32()), _list_array(made_docs, "i8"), _list_array(made_most, "i4")], names=["term", "docs", "most"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            ends, terms = _lists(batch.column("terms"))
            _, counts = _lists(batch.column("counts"))
            for at, (r, n) in enumerate(zip(batch.column("row").to_pylist(), batch.column("n").to_pylist(), strict=True)):
                a, b = ends[at], ends[at + 1]
                if a < b:
                    held.append((r, terms[a:b], weights.coordinates(n, counts[a:b])))
                if len(held) >= chunk_docs:
                    yield blocks(held)
                    held = []
        if held:
            yield blocks(held)

    return stored(by_similarity(rows, weights).mapInArrow(cut, "term int, docs array<bigint>, most array<int>"))


def known_scores(rows: DataFrame, weights: Weights) -> np.ndarray:
    """For each item a score that TOP documents reach (1 if that isn't known), from the sampled documents."""
    some = rows.filter((F.pmod(F.xxhash64("row"), F.lit(THRESHOLD_SAMPLE)) == 0) & (F.size("terms") > 0))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.zeros((TOP, len(weights.items)), "i8")
        for batch in batches:
            ends, terms = _lists(batch.column("terms"))
            _, counts = _lists(batch.column("counts"))
            made = [weights.scores(terms[a:b], weights.coordinates(n, counts[a:b]))
                    for a, b, n in zip(ends[:-1].tolist(), ends[1:].tolist(), batch.column("n").to_pylist(), strict=True)]
            top = np.sort(np.vstack([top, *made]), axis=0)[-TOP:]
        rank, item = np.nonzero(top)
        yield pa.RecordBatch.from_arrays([pa.array(item.astype("i4")), pa.array(top[rank, item])], names=["item", "score"])

    found = some.select("n", "terms", "counts").mapInArrow(best, "item int, score bigint")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc()))
    reach = np.ones(len(weights.items), "i8")
    for r in found.withColumn("place", place).filter(F.col("place") == TOP).select("item", "score").collect():
        reach[r.item] = r.score
    return reach


def candidates(index: DataFrame, weights: Weights, reach: np.ndarray) -> DataFrame:
    """``row`` and ``items`` (those for which a block of the row can't be skipped)."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, most = _lists(batch.column("most"))
            cuts, docs = _lists(batch.column("docs"))
            items, rows = [], []
            for at, t in enumerate(batch.column("term").to_pylist()):
                who, matrix, beyond = weights.asks[t]
                bound = matrix @ most[ends[at]:ends[at + 1]] + beyond
                left = who[bound >= reach[who]]
                mine = docs[cuts[at]:cuts[at + 1]]
                items.append(np.repeat(left, len(mine)))
                rows.append(np.tile(mine, len(left)))
            pairs = np.unique(np.stack([np.concatenate(rows), np.concatenate(items)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1].astype("i4"))], names=["row", "item"])

    met = index.mapInArrow(kept, "row bigint, item int")
    return met.groupBy("row").agg(F.collect_set("item").alias("items"))  # an item is there once: as many as a pass has


def scored(found: DataFrame, rows: DataFrame, weights: Weights) -> DataFrame:
    """``item``, ``doc_id``, ``row`` and ``score`` of the candidates; scores of zero are left out."""
    both = rows.join(found, "row").select("doc_id", "row", "n", "terms", "counts", "items")
    schema = T.StructType([T.StructField("item", T.IntegerType()), both.schema["doc_id"], *T.StructType.fromDDL("row bigint, score bigint")])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ends, terms = _lists(batch.column("terms"))
            _, counts = _lists(batch.column("counts"))
            cuts, items = _lists(batch.column("items"))
            made = [weights.scores(terms[a:b], weights.coordinates(n, counts[a:b]))[items[c:d]] for a, b, c, d, n in zip(
                ends[:-1].tolist(), ends[1:].tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), batch.column("n").to_pylist(), strict=True)]
            score, at = np.concatenate(made), np.repeat(np.arange(batch.num_rows), np.diff(cuts))
            good = score > 0
            at = pa.array(at[good])
            yield pa.RecordBatch.from_arrays(
                [pa.array(items[good].astype("i4")), batch.column("doc_id").take(at), batch.column("row").take(at), pa.array(score[good])],
                names=schema.names)

    return both.mapInArrow(exact, schema)


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id",
           item_text: str = "text", top: int = TOP) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id`` and ``score`` of each item's ``top`` (TOP at most) best documents."""
    if top > TOP:
        raise ValueError(f"the threshold is that of {TOP} documents")
    spark, found = docs.sparkSession, []
    id_field = items.select(F.col(item_id).alias("item_id")).schema[0]
    for held in passes(items, item_id, item_text):
        rows = vectors(docs, held.vocab, doc_id, doc_text)
        n_docs, n_terms = rows.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            continue
        frequency = np.zeros(len(held.vocab), "i8")  # a number for each term of the pass
        for r in rows.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
            frequency[r.t] = r["count"]
        weights = Weights(held, n_docs, n_terms, frequency)
        index = block_index(rows, weights)
        hits = scored(candidates(index, weights, known_scores(rows, weights)), rows, weights)
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "row")
        best = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        names = spark.createDataFrame(list(enumerate(held.ids)), T.StructType([T.StructField("item", T.IntegerType()), id_field]))
        found.append(best.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    if not found:
        doc_field = docs.select(F.col(doc_id).alias("doc_id")).schema[0]
        return spark.createDataFrame([], T.StructType([id_field, T.StructField("rank", T.IntegerType()), doc_field, T.StructField("score", T.LongType())]))
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole
