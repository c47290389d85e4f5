"""The Merkle manifest against a recursive version in plain Python."""

import hashlib
import zlib

from pyspark.sql import functions as F

from flowtrace.llm import merkle

LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, path string, children string"


def _hash(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(row, text):
    fields = (row.doc_id, row.source, row.lang, row.n_chars, text)
    return _hash("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def _levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([_hash("".join(levels[-1][i:i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def _siblings(levels, i):
    for nodes in levels[:-1]:
        first = i // 16 * 16
        yield nodes[first:i], nodes[i + 1:first + 16]
        i //= 16


def brute(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of every row."""
    by_source = {}
    for r in rows:
        by_source.setdefault(r.source, []).append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by_source[s].sort(key=lambda r: (r.doc_id is not None, r.doc_id, _leaf(r, r.text)))
    trees = [_levels([_leaf(r, r.text) for r in by_source[s]]) for s in order]
    top = _levels([t[-1][0] for t in trees])
    out = []
    for at, s in enumerate(order):
        for i, r in enumerate(by_source[s]):
            path = [*_siblings(trees[at], i), *_siblings(top, at)]
            tampered = r.doc_id is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
            node = _leaf(r, r.text.translate(LOWER) if tampered else r.text)
            for left, right in path:
                node = _hash("".join([*left, node, *right]))
            proof = _hash("".join("".join(a + b) for a, b in path))
            out.append((r.doc_id, trees[at][0][i], trees[at][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return out


def _audit(df):
    made = merkle.audit(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    return sorted((tuple(r) for r in made.collect()), key=repr)


def test_manifest_by_brute_force(spark):
    rows = [(i, f"s{i % 20}" if i % 3 else "hot", "en" if i % 7 else None, i, f"Text {i} With Ünïcode" if i % 11 else None, "x", "y")
            for i in range(700)]
    rows += [(5000, None, None, None, None, None, None), (5001, None, "en", 1, "", "x", "x"), (5002, "alone", "en", 2, "A " * 50_000, "x", "x"),
             (7, "hot", "en", 3, "Another Text of id 7", "x", "x"), (None, "hot", "en", 1, "No Id", "x", "x"), (None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = _audit(df)
    assert got == sorted(brute(df.collect()), key=repr)
    assert 0 < sum(r[-1] for r in got) < len(got)


def test_repeated_rows_share_a_leaf_and_have_proofs_of_their_own(spark):
    df = spark.createDataFrame([(1, "a", "en", 3, "One", "", "")] * 40 + [(2, "b", "en", 3, "Two", "", "")], SCHEMA)
    got = _audit(df)
    assert got == sorted(brute(df.collect()), key=repr) and len(got) == 41


def test_small_tables(spark):
    for n in (0, 1, 2, 16, 17):
        df = spark.createDataFrame([(i, "a", "en", 3, f"T{i}", "", "") for i in range(n)], SCHEMA)
        assert _audit(df) == sorted(brute(df.collect()), key=repr)


def test_requests_of_some_leaves(spark):
    rows = [(i, f"s{i % 3}", "en", 3, f"Text {i}", "", "") for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    leaves = df.select("doc_id", "source", merkle.leaf_digest(F.col("text")).alias("leaf"))
    manifest = merkle.build(leaves)
    some = merkle.descend(manifest, manifest.leaves.filter("doc_id % 97 = 5"))
    want = {r[0]: r[4] for r in brute(df.collect())}
    got = {r.doc_id: r.p for r in some.select("doc_id", merkle.proof_digest(F.col("segments")).alias("p")).collect()}
    assert got == {i: want[i] for i in (5, 102, 199, 296)}
    assert merkle.descend(manifest, manifest.leaves.filter("false")).count() == 0
