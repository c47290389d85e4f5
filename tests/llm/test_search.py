"""Lexical search against a plain reading of the scoring rule."""

import math
import random
import re
from collections import Counter

import pytest

from flowtrace.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def _terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=10):
    """Sorted (item_id, rank, doc_id, score) for lists of (id, text)."""
    counts = [(i, Counter(_terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    total = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        asked, hits = Counter(_terms(text)), []
        for i, c in counts:
            m = 25 + 75 * sum(c.values()) * len(counts) // total
            score = sum(k * math.floor(1000 * math.log((2 * len(counts) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                        for t, k in asked.items() if t in c)
            if score > 0:
                hits.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -score) for rank, (score, none, i) in enumerate(sorted(hits)[:top], 1)]
    return sorted(out, key=repr)


def _found(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _tables(spark, docs, items):
    return (spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id bigint, text string, terms string, row int"),
            spark.createDataFrame([(*i, "x") for i in items], "item_id int, text string, score string"))


def _rows(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(150)] + ["Straße", "ÉTÉ", "été", "naïve"]
    draw = lambda k: " ".join(rng.choice(words[:rng.choice([10, 60, 154])]) for _ in range(k))
    docs = [(i, draw(rng.randint(1, 60)) + rng.choice([".", " A-B_c", ""])) for i in range(n)]
    docs += [(n + i, docs[i % 7][1]) for i in range(40)] + [(3, docs[3][1]), (None, docs[3][1]), (9000, None), (9001, ""), (9002, " .,- ")]
    docs += [(9003, draw(20_000))]
    items = [(i, draw(rng.randint(1, 25))) for i in range(30)] + [(2, docs[5][1]), (50, None), (51, ""), (52, "nowhere at all"), (None, docs[8][1])]
    return docs, items


@pytest.mark.parametrize(("blocks", "near", "pass_terms", "sample"), [(32, 128, 100_000, 16), (2, 3, 40, 2)])
def test_search_by_brute_force(spark, monkeypatch, blocks, near, pass_terms, sample):
    for name, value in (("BLOCK_DOCS", blocks), ("CO_TERMS", near), ("PASS_TERMS", pass_terms), ("THRESHOLD_SAMPLE", sample)):
        monkeypatch.setattr(search, name, value)
    docs, items = _rows(4, 120)
    assert _found(search.search(*_tables(spark, docs, items))) == brute(docs, items)


def test_blocks_are_skipped_only_below_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_DOCS", 4)
    monkeypatch.setattr(search, "THRESHOLD_SAMPLE", 1)  # a sixteenth of these few rows says nothing
    docs, items = _rows(5, 200)
    df, asked = _tables(spark, docs, items)
    held = next(search.passes(asked, "item_id", "text"))
    rows = search.vectors(df, held.vocab, "doc_id", "text")
    n_docs, n_terms = len([t for _, t in docs if _terms(t)]), sum(len(_terms(t)) for _, t in docs)
    df_of = Counter(t for _, text in docs for t in set(_terms(text)))
    weights = search.Weights(held, n_docs, n_terms, search.np.array([df_of[t.decode()] for t in held.vocab]))
    reach = search.known_scores(rows, weights)
    kept = {(r.row, i) for r in search.candidates(search.block_index(rows, weights), weights, reach).collect() for i in r["items"]}
    scores = {(r.row, i): int(s) for r in rows.collect()
              for i, s in enumerate(weights.scores(search.np.array(r.terms, "i8"), weights.coordinates(r.n, search.np.array(r.counts))))}
    needed = {(row, i) for (row, i), s in scores.items() if s > 0 and s >= reach[i]}
    assert needed <= kept and len(kept) < sum(s > 0 for s in scores.values())


def test_empty_tables(spark):
    docs, items = _tables(spark, *_rows(6, 9))
    assert _found(search.search(docs.filter("false"), items)) == _found(search.search(docs, items.filter("false"))) == []
    assert _found(search.search(docs.filter("text is null"), items)) == []
