"""The n-gram Jaccard join against all pairs of sets."""

import random
from itertools import combinations

import numpy as np
import pytest

from flowtrace.llm import setjoin

SCHEMA = "doc_id bigint, text string, key string, n int, root string"


def _set(text):
    raw = (text or "").encode().lower().split()
    words = [w.decode() for w in raw]
    if 0 < len(words) < 4:
        return {" ".join(words)}
    return {" ".join(words[i:i + 4]) for i in range(len(words) - 3)}


def brute(rows):
    sets = [_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((doc, len(s), least.get(find(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def _joined(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in setjoin.join_components(df).collect()), key=repr)


def _rows(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    draw = lambda n: [rng.choice(words) for _ in range(n)]
    passage, base = draw(40), draw(150)
    texts = [draw(rng.randint(1, 120)) for _ in range(40)]
    texts += [[*draw(rng.randint(0, 60)), *passage, *draw(rng.randint(0, 60))] for _ in range(60)]  # one passage in many texts
    for _ in range(90):  # a large group of near copies, of which many pairs are no links
        near = list(base)
        for at in rng.sample(range(150), rng.randint(0, 5)):
            near[at] = rng.choice(words)
        texts.append(near)
    texts += [list(texts[i % 100]) for i in range(30)] + [["x"], ["X"], ["x", "y", "z"], ["a"] * 30, ["a"] * 50]
    rows = [(1000 - i, rng.choice([" ", "\n", "\t "]).join(t).title()) for i, t in enumerate(texts)]
    return [*rows, (1, None), (2, ""), (3, " \n"), (4, None), (None, " ".join(base)), (None, "no id and no link"), (1000, rows[0][1]),
            (5, " ".join(texts[0])), (6, " ".join(draw(20_000)))]


@pytest.mark.parametrize("block", [1024, 8])
def test_join_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(setjoin, "GROUP_BLOCK", block)
    rows = _rows(9)
    got = _joined(spark, rows)
    assert got == brute(rows)
    assert len({c for _, _, c in got}) < len(rows) - 80


def test_small_tables(spark):
    assert _joined(spark, []) == []
    assert _joined(spark, [(1, None), (2, "")]) == [(1, 0, 1), (2, 0, 2)]
    assert _joined(spark, [(2, "One two"), (1, "one two")]) == [(1, 1, 1), (2, 1, 1)]


def test_blocks_are_passed_over_only_without_partners(monkeypatch):
    rng = np.random.default_rng(2)
    for block in (2, 4, 64):
        monkeypatch.setattr(setjoin, "LIST_BLOCK", block)
        for _ in range(60):
            n = np.sort(rng.integers(5, 60, rng.integers(2, 40)))
            at = rng.integers(0, n // 6 + 1)
            meets = setjoin.may_link(n[:, None], at[:, None], n[None, :], at[None, :])
            np.fill_diagonal(meets, False)
            stay = setjoin._stay(n, at)
            assert not (meets.any(axis=1) & ~stay).any()
            if block == 64:
                assert (stay == meets.any(axis=1)).all()


def test_answers_that_follow_from_the_centre():
    rng = np.random.default_rng(3)
    whole = [np.unique(rng.integers(0, 60, rng.integers(1, 60))) for _ in range(30)]
    parts = [np.setxor1d(s, whole[0]) for s in whole]
    size = np.array([len(p) for p in parts])
    apart = size[:, None] + size[None, :] - 2 * setjoin._common(parts)
    assert (setjoin._common_between(parts[:9], parts[9:]) == setjoin._common(parts)[:9, 9:]).all()
    for i, j in combinations(range(30), 2):
        assert apart[i, j] == len(np.setxor1d(whole[i], whole[j]))
        total = len(whole[i]) + len(whole[j])
        both, union = len(np.intersect1d(whole[i], whole[j])), len(np.union1d(whole[i], whole[j]))
        assert bool(setjoin.linked(np.int64(total), apart[i, j])) == (100 * both >= 85 * union)
        assert (both >= setjoin.least_common(total)) == (100 * both >= 85 * union)


def test_shingles_are_counted_once():
    assert len(setjoin.shingles(b"a a a a a a")) == 1 and len(setjoin.shingles(b" ")) == 0
    assert len(setjoin.shingles("Ä ä b c d".encode())) == 2 and (setjoin.shingles(b"A B c D") == setjoin.shingles(b"a b\x0bC d")).all()
    assert len(np.intersect1d(setjoin.shingles(b"a b c d"), setjoin.shingles(b"d c b a"))) == 0


def test_linked_sets_share_lists_and_a_range_of_size(spark):
    """What the filters rest on, for sets of all sizes: shared first shingles, and the ranges of any two linked sizes."""
    rng = np.random.default_rng(7)
    for _ in range(400):
        both = rng.integers(0, 1 << 62, rng.integers(1, 120))
        x, y = (np.unique(np.concatenate([both, rng.integers(0, 1 << 62, rng.integers(0, 1 + len(both) // 6))])) for _ in range(2))
        common = len(np.intersect1d(x, y))
        if OF * common < PARTS * len(np.union1d(x, y)):
            continue
        first = [s[:setjoin.first_shingles(len(s))] for s in (x, y)]
        shared = len(np.intersect1d(*first))
        least = [min(setjoin.COMMON, -(-PARTS * -(-PARTS * len(s) // OF) // OF)) for s in (x, y)]
        assert shared >= max(least)
        at = [np.searchsorted(s, np.intersect1d(*first)[:setjoin.COMMON]) for s in (x, y)]
        assert setjoin.may_link(len(x), at[0], len(y), at[1]).all()
    from pyspark.sql import functions as F
    sizes = spark.range(1, 3000).select(F.col("id").alias("n"), setjoin.size_ranges(F.col("id")).alias("r"), setjoin.shared_lists(F.col("id")).alias("s"))
    ranges = {r.n: set(r.r) for r in sizes.collect()}
    for n, mine in ranges.items():
        for other in {-(-PARTS * n // OF), n - 1, (n + -(-PARTS * n // OF)) // 2} - {0}:
            assert other < -(-PARTS * n // OF) or mine & ranges[other], (n, other)


PARTS, OF = setjoin.SIMILAR_PARTS, setjoin.OF_PARTS
