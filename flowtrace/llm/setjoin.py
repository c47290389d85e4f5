"""N-gram Jaccard join with skipping by set relations (operator 13).

A document is the set of its word shingles, hashed to 64 bits.  Equal sets are one
set from the start (a 128-bit digest names it).  All shingles have one order,
rarest first, by counts in a table of a fixed number of cells that all documents
are counted into; any order gives the same links, a good one keeps lists short.
Two linked sets share COMMON shingles among the first few of each, so only these
are indexed, with the size of the set and the shingle's position in it.

Index lists are skipped by position: a list is cut into blocks of sets of similar
size, and a block is passed over if its sizes and least position leave too few
shingles behind for a link.  Sets that every block of their list passes over leave
the list.  Lists are then cut into ranges of size, two overlapping covers of them,
so that any two sets of similar size are in one range together; sets that are left
in fewer lists of a range than linked sets share leave all of these.

The sets left in a list are held against one of them, the list's centre, and only
against it are whole sets compared.  The answers of the others follow from that:
with D(x) the shingles in which x differs from the centre, sets x and y differ in
|D(x)| + |D(y)| - 2 |D(x) & D(y)| shingles.  If D(x) and D(y) are small enough a
link follows at once, else their common part decides, which is counted along the
lists of the few differing shingles.  Sets with one centre form a group; a group is
dealt to blocks of a bounded number of sets, with the centre in each.  Sets that
reach the centre inside their blocks are one component, so across blocks only the
others are held against all.

A group hands on a spanning forest of its links, and components of these are found
by :mod:`flowtrace.llm.components`.

Defined results: null or empty texts and texts without a word have an empty set
and are linked with nothing, not even with one another; texts of fewer words than
a shingle are one shingle; repeated rows get one result each; a row without an id
is in the component of the least id that its set reaches, null if none.  Other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from flowtrace.llm.common import materialise, small_batches, stored
from flowtrace.llm.components import components
from flowtrace.operators.ordered import slice_count

SHINGLE_WORDS = 4
#: Links need SIMILAR_PARTS / OF_PARTS of the union in common.
SIMILAR_PARTS, OF_PARTS = 85, 100
#: Shingles that two linked sets share among their first, as far as the sets are large enough.
COMMON = 8
#: Rounds in which sets of too few lists leave all their lists.
LEAVING_ROUNDS = 1
#: Cells that shingles are counted in, as a power of two.
CELL_BITS = 18
#: Entries in a block of an index list; sets in a block of a group.
LIST_BLOCK, GROUP_BLOCK = 64, 512
#: Entries that a task looks through together, and of one list that it holds at once.
CUT_ROWS, LIST_PART = 1 << 16, 1 << 18
#: Lists of differing shingles up to this length are counted side by side.
SHORT_LIST = 12
#: Rows that are broadcast at most (about 60 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 1 << 20


def shingles(text: bytes) -> np.ndarray:
    """Sorted different shingle hashes of a text in UTF-8."""
    words = text.lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return np.zeros(0, "u8")
    if len(words) < SHINGLE_WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), len(words))], "u8")
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), "u8", len(words))
    last = len(h) - SHINGLE_WORDS + 1
    made = np.zeros(last, "u8")
    for i in range(SHINGLE_WORDS):  # a word's hash counts by its place
        made = made * np.uint64(0x9E3779B97F4A7C15) + h[i:i + last]
    for _ in range(2):
        made = (made ^ (made >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(made ^ (made >> np.uint64(32)))


def digest(made: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(made.tobytes())


def least_common(total: np.ndarray | int) -> np.ndarray | int:
    """Shingles that two linked sets of ``total`` shingles together have in common at least."""
    return -(-SIMILAR_PARTS * total // (OF_PARTS + SIMILAR_PARTS))


def first_shingles(n: int) -> int:
    """How many of a set's first shingles are indexed: sets with ``m`` in common share ``k`` among the first n - m + k of each."""
    least = -(-SIMILAR_PARTS * n // OF_PARTS)
    return n - least + min(COMMON, least) if n else 0


def shared_lists(n: F.Column) -> F.Column:
    """Lists that a set of ``n`` shingles shares with any set it is linked to, at least (that set may be smaller)."""
    smaller = F.ceil(F.ceil(n * SIMILAR_PARTS / OF_PARTS) * SIMILAR_PARTS / OF_PARTS)
    return F.least(F.lit(COMMON), smaller)


def linked(total: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Are sets of ``total`` shingles together that differ in ``apart`` of them linked?"""
    return OF_PARTS * (total - apart) >= SIMILAR_PARTS * (total + apart)


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))


def _cells(made: np.ndarray) -> np.ndarray:
    return (made >> np.uint64(64 - CELL_BITS)).astype("i8")


def set_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, np.ndarray]:
    """``doc_id``, ``text_hash``, ``n`` and ``key`` (digest of the set) of every row, and the counts of all shingles."""
    small_batches(df.sparkSession)
    docs = _texts(df, id_col, text_col)
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("text_hash bigint, n bigint, key binary, cell int, weight bigint")])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << CELL_BITS, "i8")
        for batch in batches:
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            if not sets:
                continue
            counts += np.bincount(_cells(np.concatenate(sets)), minlength=1 << CELL_BITS)
            none = pa.nulls(len(sets))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([digest(s) for s in sets], pa.binary()), none.cast(pa.int32()), none.cast(pa.int64())], names=schema.names)
        used = np.flatnonzero(counts)
        if len(used):  # the task's counts follow its rows
            none = pa.nulls(len(used))
            kinds = [pa.nulls(len(used), docs_type), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*kinds, pa.array(used.astype("i4")), pa.array(counts[used])], names=schema.names)

    docs_type = to_arrow_type(docs.schema["doc_id"].dataType)
    both = stored(docs.mapInArrow(made, schema))
    order = np.zeros(1 << CELL_BITS, "i8")  # of a fixed size
    for r in both.filter("cell is not null").groupBy("cell").agg(F.sum("weight").alias("weight")).toLocalIterator():
        order[r.cell] = r.weight
    return both.filter("key is not null").select("doc_id", "text_hash", "n", "key"), order


def index_entries(df: DataFrame, order: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """``token``, ``n``, ``key``, ``at``: the first shingles of every set, in the common order, with their position."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, at, size, key = [], [], [], []
            for text in batch.column("text").to_pylist():
                mine = shingles(text)
                n = len(mine)
                first = first_shingles(n)
                token.append(mine[np.lexsort((mine, order[_cells(mine)]))[:first]])
                at.append(np.arange(first))
                size.append(np.full(first, n))
                key += [digest(mine)] * first
            if key:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(token).view("i8")), pa.array(np.concatenate(size).astype("i4")), pa.array(key, pa.binary()),
                     pa.array(np.concatenate(at).astype("i4"))], names=["token", "n", "key", "at"])

    return _texts(df, id_col, text_col).select("text").mapInArrow(made, "token bigint, n int, key binary, at int")


def may_link(n: np.ndarray, at: np.ndarray, other_n: np.ndarray, other_at: np.ndarray) -> np.ndarray:
    """Can sets of these sizes be linked, the list's shingle being one of the first COMMON that they share?"""
    behind = np.minimum(n - at, other_n - other_at) + COMMON - 1
    return np.minimum(behind, np.minimum(n, other_n)) >= least_common(n + other_n)


def _stay(n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which entries of a list, in order of size, have a block that isn't passed over."""
    stay = np.zeros(len(n), bool)
    starts = np.arange(0, len(n), LIST_BLOCK)
    for a in starts:  # the own block entry by entry
        b = a + LIST_BLOCK
        meets = may_link(n[a:b, None], at[a:b, None], n[None, a:b], at[None, a:b])
        np.fill_diagonal(meets, False)
        stay[a:b] = meets.any(axis=1)
    if len(starts) > 1 and not stay.all():
        low, high, first = n[starts], n[np.append(starts[1:], len(n)) - 1], np.minimum.reduceat(at, starts)
        for block, (least, most, position) in enumerate(zip(low.tolist(), high.tolist(), first.tolist(), strict=True)):
            a = int(np.searchsorted(n, least * SIMILAR_PARTS // OF_PARTS, "left"))
            b = int(np.searchsorted(n, most * OF_PARTS // SIMILAR_PARTS + 1, "right"))
            rest = a + np.flatnonzero(~stay[a:b])
            rest = rest[rest // LIST_BLOCK != block]
            # the block's least size and position: the weakest condition for any of its sets
            stay[rest] = np.minimum(n[rest] - at[rest], most - position) + COMMON - 1 >= least_common(n[rest] + least)
    return stay


def skipped_lists(entries: DataFrame) -> DataFrame:
    """``token``, ``n`` and ``key`` of the entries that may have a partner in their list.

    Lists come in slices of the range of (token, size); a list may go on in the next
    slice, so the entries of a slice's first and last list all stay.
    """
    columns = ["token", "n", "key", "at"]

    def cut(rows: pa.Table, edge: bool) -> pa.RecordBatch | None:
        token, n = rows.column("token").to_numpy(), rows.column("n").to_numpy().astype("i8")
        at, key = rows.column("at").to_numpy().astype("i8"), rows.column("key").combine_chunks()
        names = np.array(key.to_pylist(), "S16")
        new = np.append(True, (token[1:] != token[:-1]) | (names[1:] != names[:-1]))  # copies stand next to one another
        where = np.flatnonzero(new)
        starts = np.flatnonzero(np.append(True, token[where][1:] != token[where][:-1]))
        sizes = np.diff(np.append(starts, len(where)))
        keep = [where[starts[0]:starts[0] + sizes[0]]] if edge else []
        for a, k in zip(starts[1 if edge else 0:].tolist(), sizes[1 if edge else 0:].tolist(), strict=True):
            if k > 1:
                mine = where[a:a + k]
                keep.append(mine[_stay(n[mine], at[mine])])
        chosen = np.concatenate([*keep, np.zeros(0, "i8")]).astype("i8")
        if not len(chosen):
            return None
        return pa.RecordBatch.from_arrays([pa.array(token[chosen]), pa.array(n[chosen].astype("i4")), key.take(pa.array(chosen))], names=["token", "n", "key"])

    def plain(rows: pa.Table) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([rows.column(c).combine_chunks() for c in ("token", "n", "key")], names=["token", "n", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, edge = [], 0, True  # edge: the first list of the held rows may have begun before them
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < CUT_ROWS:
                continue
            if held[0].column("token")[0] == batch.column("token")[-1]:
                if size >= LIST_PART:  # one list of very many entries is handed on in parts
                    yield plain(pa.Table.from_batches(held))
                    held, size, edge = [], 0, True
                continue
            whole = pa.Table.from_batches(held)
            token = whole.column("token").to_numpy()
            last = int(np.searchsorted(token, token[-1], "left"))  # the last list may go on in the next batch
            made = cut(whole.slice(0, last), edge)
            if made is not None:
                yield made
            held, edge = whole.slice(last).to_batches(), False
            size = whole.num_rows - last
        if held:
            whole = pa.Table.from_batches(held)
            token = whole.column("token").to_numpy()
            last = int(np.searchsorted(token, token[-1], "left"))
            made = cut(whole.slice(0, last), edge) if last else None
            if made is not None:
                yield made
            yield plain(whole.slice(last))

    sliced = entries.repartitionByRange(slice_count(entries), *columns).sortWithinPartitions(*columns)
    return sliced.mapInArrow(run, "token bigint, n int, key binary").distinct()


def size_ranges(n: F.Column) -> F.Column:
    """Two ranges of size that a set of ``n`` shingles is in; linked sets have one in common.

    Steps are a little wider than the sizes of two linked sets can differ, so these
    are in the same step or in neighbouring ones, and each pair of neighbours makes
    a range of one of the covers.
    """
    step = F.floor(F.log(n) / F.lit(-math.log(SIMILAR_PARTS / OF_PARTS - 0.01))).cast("int")
    return F.array(F.shiftright(step, 1) * 2, F.shiftright(step + 1, 1) * 2 + 1)


def leave_lists(lists: DataFrame) -> DataFrame:
    """``lists`` by ``range``, without lists of one set, and without sets of fewer lists than they share with a set they are linked to."""
    lists = lists.select("token", "n", "key", F.explode(size_ranges(F.col("n"))).alias("range"))
    for _ in range(LEAVING_ROUNDS):
        many = lists.groupBy("token", "range").agg(F.count("*").alias("k")).filter("k > 1").select("token", "range")
        lists = stored(lists.join(many, ["token", "range"], "left_semi"))
        enough = lists.groupBy("key", "range", "n").agg(F.count("*").alias("m")).filter(F.col("m") >= shared_lists(F.col("n")))
        lists = stored(lists.join(enough.select("key", "range"), ["key", "range"], "left_semi"))
    return lists


def centre_pairs(lists: DataFrame) -> DataFrame:
    """``centre`` and ``key``: each set with the centre of each of its lists, the centre itself included."""
    centre = lists.groupBy("token", "range").agg(F.count("*").alias("k"), F.min_by("key", F.struct(F.xxhash64("key"), "key")).alias("centre"))
    return lists.join(centre.filter("k > 1").drop("k"), ["token", "range"]).select("centre", "key").distinct()


def _bounded(df: DataFrame) -> DataFrame:
    """A stored table, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _contents(df: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``wanted`` (text_hash, key, ...) with ``tokens``, all shingles of the set."""
    docs = _texts(df, id_col, text_col).select("text_hash", "text")
    met = docs.join(_bounded(wanted.select("text_hash").distinct()), "text_hash", "left_semi")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            if sets:
                ends = np.cumsum([0, *map(len, sets)], dtype="i4")
                tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view("i8")))
                yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.binary()), tokens], names=["key", "tokens"])

    return met.mapInArrow(made, "key binary, tokens array<bigint>").dropDuplicates(["key"])


def differences(df: DataFrame, pairs: DataFrame, sets: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``centre``, ``key``, ``n`` and ``apart`` (shingles that are in one of the two sets) of all ``pairs``."""
    held = stored(sets.join(pairs.select("key").distinct(), "key", "left_semi").select("key", "text_hash", "n"))
    tokens = stored(_contents(df, held, id_col, text_col))
    mine = pairs.join(tokens, "key").select("centre", "key", F.col("tokens").alias("mine"))
    its = tokens.join(pairs.select(F.col("centre").alias("key")).distinct(), "key", "left_semi").select(F.col("key").alias("centre"), F.col("tokens").alias("its"))
    both = mine.join(its, "centre")
    return both.select("centre", "key", F.size("mine").cast("bigint").alias("n"),
                       F.concat(F.array_except("mine", "its"), F.array_except("its", "mine")).alias("apart"))


def _holders(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owners of all shingles, shingle by shingle (owners ascending), and where the lists of two owners or more start and end."""
    token = np.concatenate([*parts, np.zeros(0, "i8")])
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    starts = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, "i8")
    ends = np.append(starts[1:], len(token))
    several = ends - starts > 1
    return owner, starts[several], ends[several]


def _common(parts: list[np.ndarray]) -> np.ndarray:
    """|a & b| for any two of ``parts``, along the lists of the shingles; the diagonal has the sizes."""
    owner, starts, ends = _holders(parts)
    common = np.zeros((len(parts), len(parts)), "i4")
    length = ends - starts
    for m in np.unique(length).tolist():
        if m <= SHORT_LIST:  # all lists of this length at once, one pair of places after the other
            who = owner[starts[length == m][:, None] + np.arange(m)]
            for i in range(m):
                for j in range(i + 1, m):
                    np.add.at(common, (who[:, i], who[:, j]), 1)
        else:
            for a in starts[length == m].tolist():
                who = owner[a:a + m]
                common[who[:, None], who] += np.triu(np.ones((m, m), "i4"), 1)
    common += common.T
    common[np.diag_indices(len(parts))] = [len(p) for p in parts]
    return common


def _common_between(parts: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """|a & b| for each a of ``parts`` and b of ``others``."""
    owner, starts, ends = _holders([*parts, *others])
    common = np.zeros((len(parts), len(others)), "i4")
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        who = owner[a:b]
        cut = int(np.searchsorted(who, len(parts)))
        if 0 < cut < len(who):
            common[who[:cut, None], who[cut:] - len(parts)] += 1
    return common


def _roots(meets: np.ndarray) -> np.ndarray:
    """The first member of each member's component."""
    root = np.full(len(meets), -1)
    for i in range(len(meets)):
        if root[i] < 0:
            root[i], todo = i, np.array([i])
            while len(todo):
                todo = np.flatnonzero(meets[todo].any(axis=0) & (root < 0))
                root[todo] = i
    return root


def _columns(rows: pa.Table) -> tuple[np.ndarray, pa.Array, list[np.ndarray], np.ndarray]:
    lists = rows.column("apart").combine_chunks()
    values, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    parts = np.split(values, (ends - ends[0])[1:-1])
    return rows.column("n").to_numpy(), rows.column("key").combine_chunks(), parts, np.array([len(p) for p in parts])


def _inside(rows: pa.Table) -> pa.Table:
    """A spanning forest of the links in a block of a group; the centre is the root of its own component."""
    is_centre = np.array([k == c for k, c in zip(rows.column("key").to_pylist(), rows.column("centre").to_pylist(), strict=True)])
    rows = rows.take(pa.array(np.argsort(~is_centre, kind="stable")))
    n, key, parts, size = _columns(rows)
    apart = size[:, None] + size[None, :] - 2 * _common(parts)
    root = _roots(linked(n[:, None] + n[None, :], apart))
    which = np.flatnonzero(root != np.arange(len(root)))
    return pa.table({"centre": rows.column("centre").combine_chunks().take(pa.array(which)),
                     "u": key.take(pa.array(which)), "v": key.take(pa.array(root[which]))})


def _between(rows: pa.Table) -> pa.Table:
    """Links between the few (``few``) and the others of a pair of blocks, one for each two components."""
    few = rows.column("few").to_numpy(zero_copy_only=False)
    sides = [rows.filter(pa.array(few)), rows.filter(pa.array(~few))]
    (n, key, parts, size), (its_n, its_key, its_parts, its_size) = map(_columns, sides)
    if not len(n) or not len(its_n):
        return pa.table({"u": pa.array([], pa.binary()), "v": pa.array([], pa.binary())})
    apart = size[:, None] + its_size[None, :] - 2 * _common_between(parts, its_parts)
    root, its_root = (np.array(s.column("root").to_pylist(), "S16") for s in sides)
    meets = linked(n[:, None] + its_n[None, :], apart) & (root[:, None] != its_root[None, :])
    a, b = np.nonzero(meets)
    _, one = np.unique(np.stack([root[a], its_root[b]]), axis=1, return_index=True) if len(a) else (None, np.zeros(0, "i8"))
    return pa.table({"u": key.take(pa.array(a[one])), "v": its_key.take(pa.array(b[one]))})


LINK = "u binary, v binary"


def set_links(apart: DataFrame) -> DataFrame:
    """Links ``u``, ``v`` that join all linked sets of the groups of ``apart`` (centre, key, n, apart)."""
    size = apart.groupBy("centre").agg(F.count("*").alias("k"))
    blocks = F.ceil(F.col("k") / GROUP_BLOCK).cast("int")
    block = lambda n: F.pmod(F.xxhash64("key"), n).cast("int")
    member = stored(apart.join(size, "centre"))
    # a group of one pair needs no lists
    pair = member.filter("k = 2 and key <> centre").join(member.filter("key = centre").select("centre", F.col("n").alias("its")), "centre")
    total, differ = F.col("n") + F.col("its"), F.size("apart")
    direct = pair.filter(OF_PARTS * (total - differ) >= SIMILAR_PARTS * (total + differ)).select(F.col("key").alias("u"), F.col("centre").alias("v"))
    # the centre is in every block of its group, so what reaches it in some block is one component
    dealt = member.filter("k > 2").withColumn("block", F.explode(
        F.when(F.col("key") == F.col("centre"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(block(blocks)))))
    inside = stored(dealt.groupBy("centre", "block").applyInArrow(_inside, "centre binary, u binary, v binary"))
    links = direct.union(inside.select("u", "v"))
    large = member.filter((F.col("k") > GROUP_BLOCK) & (F.col("key") != F.col("centre")))
    if large.isEmpty():
        return links
    root = inside.select("centre", F.col("u").alias("key"), F.col("v").alias("root"))
    known = stored(large.join(root, ["centre", "key"], "left").withColumn("root", F.coalesce("root", "key")))
    few_k = known.filter("root <> centre").groupBy("centre").agg(F.count("*").alias("few_k"))
    of = known.join(few_k, "centre")
    side = F.ceil(F.col("few_k") / GROUP_BLOCK).cast("int")
    every = of.select("centre", block(blocks).alias("block"), F.explode(F.sequence(F.lit(0), side - 1)).alias("other"),
                      F.lit(False).alias("few"), "key", "n", "apart", "root")
    few = of.filter("root <> centre").select(
        "centre", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), block(side).alias("other"),
        F.lit(True).alias("few"), "key", "n", "apart", "root")
    return links.union(every.union(few).groupBy("centre", "block", "other").applyInArrow(_between, LINK))


def join_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` (least id reachable over links) of every row."""
    rows, order = set_table(df, id_col, text_col)
    sets = materialise(rows.filter("n > 0").groupBy("key").agg(
        F.min("doc_id").alias("least"), F.min("text_hash").alias("text_hash"), F.first("n").alias("n")))
    lists = leave_lists(stored(skipped_lists(stored(index_entries(df, order, id_col, text_col)))))
    pairs = stored(centre_pairs(lists))
    roots = components(set_links(differences(df, pairs, sets, id_col, text_col))).withColumnRenamed("vertex", "key")
    of = sets.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = of.join(roots.select("root").distinct(), "root", "left_semi").groupBy("root").agg(F.min("least").alias("joined"))
    known = of.join(least, "root", "left").select("key", F.coalesce("joined", "least").alias("component_id"))
    made = rows.join(known, "key", "left")
    return made.select("doc_id", F.col("n").alias("n_shingles"),
                       F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
