"""Fuzzy line dedup by MinHash, with built-in functions only (operator 6).

Lines are compared by their sets of character shingles.  Each shingle is hashed
once to 64 bits; xor-ed with a fixed random number, the least value over a line is
a MinHash value (the shingle nearest to a random point, so equal for two lines
with the chance of their Jaccard similarity).  Every line signs with all its
shingles.  Bands of four values make candidates, the exact Jaccard similarity
verifies them, and connected components of the links decide: of each component the
first line stays, by document and place.

Candidates are not all pairs of a band's bucket.  First each line is held against
the centre of its buckets only, the line that meets most others.  Where a centre
then has lines of different components, these are held against one another, by the
shingles that part each of them from the centre; the sizes of the sets, the
triangle inequality and then the exact similarity decide inside the join, so it
gives out links only.  Pairs inside one component would change nothing.

A line is what stands between line feeds; lines without any character other than
ASCII white space always stay.  Equal lines are one vertex from the start.
Defined results: null text stays null; a document that loses all its lines stays
with what is left; rows with the same id and the same text are one document, and
each of them gets the same text.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from flowtrace.llm.common import ASCII_SPACE, stored
from flowtrace.llm.components import components

SHINGLE_CHARS, BANDS, BAND_ROWS = 9, 8, 4
#: Shingles of a line that go to its minima as one row: their least values first, so that a
#: row of 32 minima is found and written once for all of them.
STEP = 8
#: Lines of one centre that a task holds against all its lines.
CELL_LINES = 1024
#: Links need a Jaccard similarity of SIMILAR_PARTS / OF_PARTS.
SIMILAR_PARTS, OF_PARTS = 4, 5
#: Rows that are broadcast at most (16 bytes each); larger sides are joined by shuffle.
BROADCAST_ROWS = 1 << 21


def _masks(n: int) -> list[int]:
    rng = random.Random(20)
    return [rng.getrandbits(64) - (1 << 63) for _ in range(n)]


def _text_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).filter("t is not null")
    return text.withColumn("text_hash", F.xxhash64("t"))


def _explode_lines(texts: DataFrame) -> DataFrame:
    """``id``, ``text_hash``, ``place``, ``line`` of every line that holds a character."""
    rows = texts.select("id", "text_hash", F.posexplode(F.split("t", "\n")).alias("place", "line"))
    return rows.filter(F.length(F.btrim("line", F.lit(ASCII_SPACE))) > 0)


def _all_hashes(line: str) -> Column:
    """Hashes of all shingles of ``line``.

    The line's characters, four bytes each so that no cut walks the line, are a
    variable of the outer function: made once, and not again for every shingle.
    """
    def of(wide: Column) -> Column:
        last = F.greatest(F.octet_length(wide) - 4 * SHINGLE_CHARS, F.lit(0)) + 1
        return F.transform(F.sequence(F.lit(1), last, F.lit(4)), lambda byte: _shingle_hash(wide, byte))

    return F.get(F.transform(F.array(F.encode(line, "UTF-32")), of), F.lit(0))


def _shingle_hash(wide: Column, byte: Column) -> Column:
    """Hash of the shingle that begins at a byte of ``wide``, counted from 1."""
    return F.xxhash64(F.substring(wide, byte, F.lit(4 * SHINGLE_CHARS)))


def line_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``text_hash``, ``place`` and ``line_id`` (64-bit hash) of every line."""
    return _explode_lines(_text_rows(df, id_col, text_col)).withColumn("line_id", F.xxhash64("line")).drop("line")


def _min_hashes(lines: DataFrame) -> DataFrame:
    """``line_id`` and m0, m1, ..., the MinHash values of all shingles of a line."""
    wide = lines.select("line_id", F.encode("line", "UTF-32").alias("wide"))
    last = F.greatest(F.expr("octet_length(wide) div 4") - SHINGLE_CHARS, F.lit(0)).cast("int").alias("last")
    at = wide.select("line_id", "wide", last).withColumn("at", F.explode(F.sequence(F.lit(0), "last", F.lit(STEP))))
    # behind the last shingle stands the last one again, which changes no minimum
    hashes = at.select("line_id", *(_shingle_hash(F.col("wide"), F.least(F.col("at") + j, "last") * 4 + 1).alias(f"h{j}") for j in range(STEP)))
    return hashes.groupBy("line_id").agg(
        *(F.min(F.least(*(F.col(f"h{j}").bitwiseXOR(F.lit(m)) for j in range(STEP)))).alias(f"m{i}")
          for i, m in enumerate(_masks(BANDS * BAND_ROWS))))


def band_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``bucket`` and ``line_id``: a row for each band of each different line."""
    rows = _explode_lines(_text_rows(df, id_col, text_col))
    least = _min_hashes(rows.select(F.xxhash64("line").alias("line_id"), "line"))
    bands = F.array(*(F.xxhash64(F.lit(b), *(f"m{i}" for i in range(b * BAND_ROWS, (b + 1) * BAND_ROWS))) for b in range(BANDS)))
    return least.select("line_id", F.explode(bands).alias("bucket"))


def _small(df: DataFrame) -> DataFrame:
    """A stored table, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _meetings(bands: DataFrame) -> DataFrame:
    """``bucket``, ``line_id`` and ``centre`` of the buckets that hold different lines.

    A bucket's centre is the line that meets most others in all its buckets: of
    near copies mostly the one that the others come from, or near to it.
    """
    met = stored(bands.withColumn("size", F.count("*").over(Window.partitionBy("bucket"))).filter("size > 1"))
    most = met.groupBy("line_id").agg(F.sum("size").alias("meets"))
    met = met.join(most, "line_id")
    centres = met.groupBy("bucket").agg(F.max(F.struct("meets", "line_id")).alias("c")).select("bucket", F.col("c.line_id").alias("centre"))
    return stored(met.select("bucket", "line_id").join(centres, "bucket"))


def _line_texts(df: DataFrame, lines: DataFrame, met: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``line_id`` and ``line`` of the lines that meet others, from one document each."""
    wanted = met.select("line_id").distinct()
    at = lines.join(wanted, "line_id", "left_semi").groupBy("line_id").agg(F.min(F.struct("id", "text_hash", "place")).alias("at"))
    at = stored(at.select("line_id", F.col("at.id").alias("id"), F.col("at.text_hash").alias("text_hash"), "at.place"))
    holders = stored(at.select("text_hash").distinct())
    texts = _text_rows(df, id_col, text_col).join(_small(holders), "text_hash", "left_semi")
    rows = _explode_lines(texts).withColumn("line_id", F.xxhash64("line"))
    return stored(rows.join(_small(stored(wanted)), "line_id", "left_semi").select("line_id", "line").dropDuplicates(["line_id"]))


def _apart(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` (centre, line_id) with ``n_centre``, ``n`` (shingles of each) and ``apart`` (the shingles that only one of them has)."""
    both = (pairs.join(texts.select("line_id", "line"), "line_id")
            .join(texts.select(F.col("line_id").alias("centre"), F.col("line").alias("centre_line")), "centre"))
    both = both.select("centre", "line_id", F.array_distinct(_all_hashes("centre_line")).alias("x"), F.array_distinct(_all_hashes("line")).alias("y"))
    return both.select("centre", "line_id", F.size("x").alias("n_centre"), F.size("y").alias("n"),
                       F.concat(F.array_except("x", "y"), F.array_except("y", "x")).alias("apart"))


#: In whole numbers: a Jaccard similarity of SIMILAR_PARTS / OF_PARTS; of n_a + n_b shingles (n_a + n_b - apart) / 2 are in both.
LINKED = f"{OF_PARTS + SIMILAR_PARTS} * size(apart) <= {OF_PARTS - SIMILAR_PARTS} * (n_centre + n)"


def line_groups(df: DataFrame, lines: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``line_id`` and ``root`` for every line that is linked to a different line."""
    met = _meetings(band_table(df, id_col, text_col))
    texts = _line_texts(df, lines, met, id_col, text_col)
    stars = stored(_apart(met.filter("line_id <> centre").select("centre", "line_id").distinct(), texts))
    roots = stored(components(stars.filter(LINKED).select(F.col("centre").alias("u"), F.col("line_id").alias("v"))))
    further = components(_across(_mixed_members(stars, roots))).select(F.col("vertex").alias("root"), F.col("root").alias("to"))
    own = roots.select(F.col("vertex").alias("line_id"), "root").union(
        further.join(roots, further.root == roots.vertex, "left_anti").select(F.col("root").alias("line_id"), "root"))
    return own.join(further, "root", "left").select("line_id", F.coalesce("to", "root").alias("root"))


def _mixed_members(stars: DataFrame, roots: DataFrame) -> DataFrame:
    """``stars`` with ``root`` and ``cells`` for the centres whose lines are of more than one component."""
    member = (stars.join(roots.select(F.col("vertex").alias("line_id"), "root"), "line_id", "left")
              .withColumn("root", F.coalesce("root", "line_id")))
    mixed = (member.groupBy("centre").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size"))
             .filter("lo <> hi").select("centre", F.ceil(F.col("size") / CELL_LINES).alias("cells")))
    return stored(member.join(mixed, "centre").select("centre", "line_id", "root", "n", "apart", "cells"))


def _across(members: DataFrame) -> DataFrame:
    """``u``, ``v``: roots of linked lines of one centre that lie in different components.

    With the shingles that part each line from the centre, lines a and b have
    |apart(a)| + |apart(b)| - 2 |apart(a) and apart(b)| different shingles, so the
    test is exact and needs no text.  The lines of a large centre are dealt to cells,
    each of which meets all lines: no task has all pairs.
    """
    a = members.withColumn("cell", F.pmod(F.xxhash64("line_id"), "cells")).alias("a")
    b = members.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cells") - 1))).alias("b")
    n, d = F.col("a.n") + F.col("b.n"), OF_PARTS + SIMILAR_PARTS
    most = n * (OF_PARTS - SIMILAR_PARTS)
    # the sizes alone rule most links out, by the triangle inequality; rows are compared by their sets only then
    found = a.join(b, (F.col("a.centre") == F.col("b.centre")) & (F.col("a.cell") == F.col("b.cell"))
                   & (F.col("a.line_id") < F.col("b.line_id")) & (F.col("a.root") != F.col("b.root"))
                   & (F.least("a.n", "b.n") * OF_PARTS >= F.greatest("a.n", "b.n") * SIMILAR_PARTS)
                   & (F.abs(F.size("a.apart") - F.size("b.apart")) * d <= most)
                   & ((F.size("a.apart") + F.size("b.apart") - 2 * F.size(F.array_intersect("a.apart", "b.apart"))) * d <= most))
    return found.select(F.col("a.root").alias("u"), F.col("b.root").alias("v"))


def dropped_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``text_hash`` and ``dropped`` (sorted places) of the documents that lose a line."""
    lines = stored(line_table(df, id_col, text_col))
    at = lines.select("id", "text_hash", "place", "line_id")
    roots = line_groups(df, lines, id_col, text_col)
    first = at.groupBy("line_id").agg(F.min(F.struct("id", "text_hash", "place")).alias("first"), F.count("*").alias("n"))
    vertex = first.join(roots, "line_id", "left").withColumn("root", F.coalesce("root", "line_id"))
    kept = vertex.groupBy("root").agg(F.min("first").alias("kept"), F.sum("n").alias("n")).filter("n > 1")
    decided = vertex.join(kept.drop("n"), "root").select("line_id", "kept")
    gone = at.join(decided, "line_id").filter(~F.struct("id", "text_hash", "place").eqNullSafe(F.col("kept")))
    return gone.groupBy("id", "text_hash").agg(F.sort_array(F.collect_set("place")).alias("dropped"))


def dedup_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row`` (a struct with the columns of ``df``, its text less the dropped lines) and ``dropped`` (the places of these lines)."""
    gone = stored(dropped_lines(df, id_col, text_col))
    if gone.agg(F.coalesce(F.sum(F.size("dropped") + 8), F.lit(0))).first()[0] <= 4 * BROADCAST_ROWS:
        gone = F.broadcast(gone)
    row, text = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(f"`{text_col}`").cast("string")
    keyed = df.select(row, F.col(f"`{id_col}`").alias("doc"), text.alias("t"), F.xxhash64(text).alias("h"))
    both = keyed.join(gone, F.col("doc").eqNullSafe(gone.id) & (F.col("h") == gone.text_hash), "left")
    made = both.withColumn("parts", F.when(F.col("dropped").isNotNull(), F.split("t", "\n")))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("dropped")), lambda i: F.get(F.col("parts"), i))
    made = made.withColumn("left", F.when(F.col("dropped").isNull(), F.col(f"row.`{text_col}`")).otherwise(F.array_join(left, "\n")))
    whole = F.struct(*((F.col("left") if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in df.columns))
    return made.select(whole.alias("row"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with its text less the dropped lines, and ``_dropped`` (the places of these lines).

    A column of ``df`` that is named ``_dropped`` is replaced; :func:`dedup_rows` keeps any.
    """
    made = dedup_rows(df, id_col, text_col)
    return made.select(*(F.col(f"row.`{c}`") for c in df.columns if c != "_dropped"), F.col("dropped").alias("_dropped"))
