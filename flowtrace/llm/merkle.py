"""Content-addressed Merkle manifest of a dataset, with proofs by descent (operator 11).

Every row is a leaf: the digest of its fields.  Per source, the leaves stand in
order of their id; every 16 consecutive nodes become a node of the next level
until one is left, the source's subroot, and the subroots become the root in the
same way.  The manifest holds one record for each different inner node: its
digest and its children's digests.

A leaf is asked for by its rank, written in digits of base 16: first the digits
of its source among the sources, then its own among the source's leaves.  Requests
descend from the root, one digit a level: the record of the digest reached is
looked up, the child that the digit names is the next digest, and the children
that it doesn't name are the proof's segment of this level.  Requests with common
first digits descend as one row, so a level has as many rows as the tree has nodes
there, and no node is asked for twice.  Reversed, the segments lead from the leaf
to the root.

Built-in functions only.  A group is 16 nodes at most; ranks come from sliced
running counts, so a source that holds most rows is no hot group.

Defined results: a null field is ``-`` in the leaf's digest; rows of a null source
come first; a null id stands before all others, is written ``-`` and never
tampered with; equal ids stand in order of their leaf digest, so repeated rows get
one result each, and the same leaf.  An empty table gives no rows; a single leaf
is subroot and root, and its proof is the digest of nothing.  Other columns than
the five are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtrace.llm.common import stored
from flowtrace.operators.ordered import global_prefix

#: Children of a node; a power of two, so that a rank's digits are hexadecimal digits.
FAN_OUT, DIGIT_BITS, DIGEST_BYTES = 16, 4, 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A field as it enters the digest: byte count, colon, value; ``-`` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    """Digest (32 bytes) of a row whose text is ``text``."""
    return F.unhex(F.sha2(F.concat(*(field(text if c == "text" else F.col(c)) for c in FIELDS)), 256))


def text_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked_leaves(rows: DataFrame) -> DataFrame:
    """``rows`` (row columns, source, id, leaf) with ``place``, the leaf's rank in its source, from 0."""
    keyed = rows.withColumn("has_source", F.col("source").isNotNull())  # groups are joined, which a null wouldn't be
    keyed = keyed.withColumn("group", F.coalesce("source", F.lit(""))).drop("source")
    ranked = global_prefix(keyed, ["doc_id", "leaf"], group=["has_source", "group"])
    return (ranked.withColumn("place", F.col("rank") - 1).drop("rank")
            .withColumn("source", F.when(F.col("has_source"), F.col("group"))).drop("has_source", "group"))


def _digits(number: Column, count: Column | int) -> Column:
    """``number`` in ``count`` hexadecimal digits; none if that is zero."""
    return F.lower(F.lpad(F.hex(number), count, "0"))


def _depth(nodes: Column) -> Column:
    """Levels above ``nodes`` consecutive nodes: as many as the last one's place has digits."""
    return F.when(nodes > 1, F.length(F.hex(nodes - 1))).otherwise(0)


def _without(children: Column, digit: Column) -> Column:
    return F.concat(F.substring(children, F.lit(1), digit * DIGEST_BYTES),
                    F.substring(children, (digit + 1) * DIGEST_BYTES + 1, F.lit(FAN_OUT * DIGEST_BYTES)))


def _digit(path: Column, at: Column) -> Column:
    return F.conv(F.substring(path, at, F.lit(1)), 16, 10).cast("int")


def _build(nodes: DataFrame, most: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Reduce ``nodes`` (tree, place, n, digest; ``n`` nodes in the tree, ``most`` at most) level by level.

    Returns the records (digest, children) of every level, and the last nodes (tree, digest).
    """
    records, tops = [], []
    while True:
        tops.append(nodes.filter("n = 1").select("tree", "digest"))
        if most <= 1:
            return records, tops
        runs = nodes.filter("n > 1").groupBy("tree", F.shiftright("place", DIGIT_BITS).alias("place"), "n").agg(
            F.sort_array(F.collect_list(F.struct("place", text_of(F.col("digest")).alias("digest")))).alias("run"))
        joined = runs.withColumn("children", F.array_join(F.col("run.digest"), ""))
        level = stored(joined.select("tree", "place", F.ceil(F.col("n") / FAN_OUT).cast("long").alias("n"),
                                     F.unhex(F.sha2("children", 256)).alias("digest"), F.unhex("children").alias("children")))
        records.append(level.select("digest", "children"))
        nodes, most = level.drop("children"), -(-most // FAN_OUT)


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


class Manifest:
    """``records`` (digest, children), ``root`` (32 bytes; None without leaves), and ``leaves``: the rows with their
    ``path`` (digits from the root) and ``subroot``."""

    def __init__(self, records: DataFrame | None, root: bytes | None, leaves: DataFrame) -> None:
        self.records, self.root, self.leaves = records, root, leaves


def build(rows: DataFrame) -> Manifest:
    """The manifest of ``rows``: source, doc_id, leaf (the digest) and any other columns."""
    ranked = stored(ranked_leaves(rows))
    sources = ranked.groupBy("source").agg(F.count("*").alias("n"))
    # the distinct sources are ranked by sliced running counts too: there may be very many of them
    sources = stored(global_prefix(sources.withColumn("known", F.col("source").isNotNull()), ["known", "source"])
                     .select("source", "n", (F.col("rank") - 1).alias("tree")))
    count, most = sources.agg(F.count("*"), F.max("n")).first()
    if not count:
        return Manifest(None, None, ranked.select("*", F.lit("").alias("path"), F.col("leaf").alias("subroot")))
    size = sources.withColumnRenamed("source", "its")
    nodes = stored(ranked.join(size, F.col("source").eqNullSafe(F.col("its"))).drop("its"))
    records, tops = _build(nodes.select("tree", "place", "n", F.col("leaf").alias("digest")), most)
    subroots = stored(_union(tops))
    upper, last = _build(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"),
                                         F.lit(count).cast("long").alias("n"), "digest"), count)
    root = bytes(_union(last).first().digest)
    top_digits = len(f"{count - 1:x}") if count > 1 else 0
    path = F.concat(_digits(F.col("tree"), top_digits), _digits(F.col("place"), _depth(F.col("n"))))
    leaves = nodes.join(subroots.withColumnRenamed("digest", "subroot"), "tree").withColumn("path", path).drop("tree", "place", "n")
    every = _union([*records, *upper]).dropDuplicates(["digest"]) if records or upper else None
    return Manifest(stored(every) if every is not None else None, root, stored(leaves))


def descend(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """``requests`` (rows of ``manifest.leaves``) with ``segments``: the siblings on every level, from leaf to root."""
    steps = F.length("path")
    asked = requests.withColumn("above", F.when(steps > 0, F.left("path", steps - 1)))
    if manifest.records is None:  # a lone leaf is the root
        return requests.withColumn("segments", F.array().cast("array<binary>"))
    above = stored(asked.select("above").filter("above is not null").distinct())
    deepest = above.agg(F.max(F.length("above"))).first()[0]
    at = requests.sparkSession.createDataFrame([("", bytearray(manifest.root))], "prefix string, digest binary")
    at, reached = at.withColumn("segments", F.array().cast("array<binary>")), []
    for depth in range((deepest or 0) + 1 if deepest is not None else 0):
        found = stored(at.join(manifest.records, "digest").select("prefix", "children", "segments"))
        reached.append(found)
        wanted = above.filter(F.length("above") > depth).select(F.substring("above", 1, depth + 1).alias("next")).distinct()
        digit = _digit(F.col("next"), F.lit(depth + 1))
        at = found.join(wanted.withColumn("prefix", F.substring("next", 1, depth) if depth else F.lit("")), "prefix").select(
            F.col("next").alias("prefix"), F.substring("children", digit * DIGEST_BYTES + 1, F.lit(DIGEST_BYTES)).alias("digest"),
            F.concat("segments", F.array(_without(F.col("children"), digit))).alias("segments"))
    if not reached:
        return requests.withColumn("segments", F.array().cast("array<binary>"))
    nodes = _union(reached).withColumnRenamed("prefix", "above")
    own = _without(F.col("children"), _digit(F.col("path"), F.length("path")))
    made = asked.join(nodes, "above", "left").withColumn(
        "segments", F.when(F.col("children").isNull(), F.array().cast("array<binary>"))
        .otherwise(F.reverse(F.concat("segments", F.array(own)))))
    return made.drop("above", "children")


def proof_digest(segments: Column) -> Column:
    """Digest of the siblings, level by level from leaf to root."""
    return F.sha2(F.array_join(F.transform(segments, text_of), ""), 256)


def fold(leaf: Column, segments: Column, path: Column) -> Column:
    """The root (as text) that ``leaf`` (32 bytes) and its siblings make."""
    steps = F.transform(segments, lambda s, i: F.struct(text_of(s).alias("s"), (_digit(path, F.length(path) - i) * 2 * DIGEST_BYTES).alias("cut")))

    def up(node: Column, step: Column) -> Column:
        rest = F.substring(step["s"], step["cut"] + 1, F.lit(FAN_OUT * 2 * DIGEST_BYTES))
        return F.sha2(F.concat(F.substring(step["s"], F.lit(1), step["cut"]), node, rest), 256)

    return F.aggregate(steps, text_of(leaf), up)


def audit(df: DataFrame, tampered: Column) -> DataFrame:
    """Every row's leaf, subroot, root and proof, and the root that its proof makes of the row as found.

    Rows for which ``tampered`` is true are found with their text's A-Z in lower case.
    """
    changed = F.coalesce(tampered, F.lit(False))
    rows = df.select("doc_id", "source", leaf_digest(F.col("text")).alias("leaf"),
                     F.when(changed, leaf_digest(lower_ascii(F.col("text")))).alias("found"))
    manifest = build(stored(rows))
    if manifest.root is None:
        root = F.lit(None).cast("string")
    else:
        root = F.lit(manifest.root.hex())
    proofs = descend(manifest, manifest.leaves)
    return proofs.select(
        "doc_id", text_of(F.col("leaf")).alias("leaf"), text_of(F.col("subroot")).alias("subroot"), root.alias("root"),
        proof_digest(F.col("segments")).alias("proof_sha256"),
        fold(F.coalesce("found", "leaf"), F.col("segments"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
