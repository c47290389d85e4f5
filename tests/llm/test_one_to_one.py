"""Operators that judge rows one by one, against the libraries and plain Python."""

import hashlib
import random
import re

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from flowtrace.llm import bpe, langid, lm, quality, queries, rules, secrets, viterbi
from tests.conftest import SF001

BPE, PIECES, RANKS = (P.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"))


def _random_texts(n, letters, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_bpe_ids_equal_the_library():
    mine, theirs = bpe.load(BPE), Tokenizer.from_file(BPE)
    texts = _random_texts(3000, "aeinrst  \n\t'sé中😀1 9　\x85!?", 1) + ["<|endoftext|>", "a<|endoftext|> b", "a" * 5000, ""]
    for t in texts:
        want = theirs.encode(t, add_special_tokens=False).ids
        got = np.frombuffer(mine.encode(t), "<u4").tolist()
        assert got == want, t
        assert mine.decode(got) == theirs.decode(want, skip_special_tokens=False) == t


def test_bpe_operator_edge_rows(docs, no_docs):
    both = bpe.digest_ids(bpe.decode(bpe.encode(docs, BPE), BPE))
    rows = both.collect()
    assert len(rows) == 8 and both.columns == ["doc_id", "ids", "decoded", "n_tokens", "ids_sha256"]
    texts = [r.text or "" for r in docs.collect()]
    assert [r.decoded for r in rows] == texts
    assert all(r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() for r in rows)
    assert bpe.decode(bpe.encode(no_docs, BPE), BPE).count() == 0


def test_bpe_round_trip_in_one_pass(docs, no_docs):
    made = bpe.round_trip(docs, BPE)
    assert made.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and bpe.round_trip(no_docs, BPE).count() == 0
    steps = bpe.digest_ids(bpe.decode(bpe.encode(docs, BPE), BPE)).withColumn("decoded_sha256", F.sha2("decoded", 256)).select(made.columns)
    assert sorted(map(tuple, made.collect()), key=repr) == sorted(map(tuple, steps.collect()), key=repr)


def test_bpe_cache_is_bounded_and_changes_nothing(monkeypatch):
    texts = _random_texts(300, "abcd éß  ", 3)
    want = [bpe.load(BPE).encode(t) for t in texts]
    monkeypatch.setattr(bpe, "CACHE_BYTES", 2000)
    small = bpe.Bpe(bpe._spec(BPE))
    assert [small.encode(t) for t in texts] == want and small.cached <= 2000 and len(small.cache) < 10
    assert bpe.load(BPE, bpe.Pieces).decode(np.frombuffer(want[0], "<u4").tolist()) == texts[0]


def test_viterbi_counts_equal_the_library(docs, no_docs):
    model = viterbi.load(PIECES)
    pieces = [("<unk>", 0.0), *model.scores.items(), *((f"<0x{i:02X}>", 0.0) for i in range(256))]
    theirs = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    for t in _random_texts(3000, "abcdefgh  \n\té中梦😀ß", 2):
        want = len(theirs.encode("▁" + t.replace(" ", "▁")).ids) if t else 0
        assert model.count(t) == want == (model.pieces("▁" + t.replace(" ", "▁")) if t else 0), t
    got = {r.doc_id: r.n_tokens for r in viterbi.count_tokens(docs, PIECES).collect()}
    assert got[2] == got[3] == 0 and got[7] > 0 and viterbi.count_tokens(no_docs, PIECES).count() == 0


def test_rules_match_sql_and_edges(spark, docs, no_docs):
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    names = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
    want = sorted(con.sql(f"SELECT {', '.join(names)} FROM ({queries.SQL['op5_quality_rules']})").fetchall(), key=repr)
    got = sorted((tuple(None if v is None else v for v in r) for r in rules.judge(docs).select(*names).collect()), key=repr)
    assert [g[1:] for g in got] == [w[1:] for w in want]
    assert rules.judge(no_docs).count() == 0 and rules.keep_good(docs).columns == docs.columns


def test_repeated_windows_by_brute_force(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 25))) for _ in range(200)]

    def brute(text):
        w = text.split()
        win = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        return len({i + k for i, x in enumerate(win) if win.count(x) > 1 for k in range(3)})

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in rules.judge(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("text, kinds", [
    ("PassWord = 'abcdefgh1'", ["assign"]), ("token: short", []), ("secret=token: abcdefgh12", []),
    ("ſecret=abcdefgh12", []), ("AKIAABCDEFGH1234 x", ["access"]), ("AKIA1234", []), ("0123456789abcdef" * 2, ["hex"]),
    ("é 550e8400-e29b-41d4-a716-446655440000", []), ("key Zq8xK2vB9pLw4TnR7yUj", ["random"]),
    ("internationalization_of_applications", []), ("A" * 40, []), ("", [])])
def test_secret_kinds(text, kinds):
    assert [secrets.KINDS[k] for _, k, _ in secrets.spans_of(text, RANKS)] == kinds


def test_secret_operator(docs, no_docs):
    assert secrets.find_secrets(docs, RANKS).count() == 8 and secrets.find_secrets(no_docs, RANKS).count() == 0
    hexes = re.findall(r"[0-9a-f]+", "ff" * 20 + " 12")
    assert [x for x in hexes if len(x) >= 32] == secrets.HEX.findall("ff" * 20 + " 12")


def test_language_id_is_right_on_held_out_rows(spark, docs, no_docs):
    found = queries.QUERIES["op2_language_id"](spark, SF001)
    truth = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "lang")
    held = found.join(truth, "doc_id").filter("held_out and lang is not null")
    right, n = held.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right / n > 0.9
    one = langid.train(docs.select("doc_id", "text", "lang"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, one).collect()}
    assert got[2] == got[3] == ("und", 0.0) and got[1][0] == "en"
    assert langid.identify(docs, langid.train(no_docs.select("doc_id", "text", "lang"))).filter("lang_pred <> 'und'").count() == 0


def test_quality_classifier_on_held_out_rows(spark, docs, no_docs):
    found = queries.QUERIES["op3_quality_classifier"](spark, SF001)
    assert found.count() == spark.read.parquet(f"{SF001}/documents.parquet").count()
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    held = found.join(labels, "doc_id").filter("held_out")
    right, n = held.agg(F.sum((F.col("quality") == F.col("predicted")).cast("int")), F.count("*")).first()
    assert right / n > 0.85
    none = quality.classify_held_out(docs, labels.filter("false"))
    assert none.filter("score <> 0.5 or predicted <> 1").count() == 0 and quality.classify_held_out(no_docs, labels).count() == 0


def test_language_model_base_score_by_brute_force(spark, docs, no_docs, monkeypatch):
    monkeypatch.setattr(lm, "HOT_WORDS", 3)  # both ways of looking a count up
    import math
    from collections import Counter
    rows = docs.select("doc_id", "text").collect()
    train = docs.filter("doc_id is null or doc_id <> 6")
    counts = Counter(t for r in train.collect() for t in lm.tokens((r.text or "").encode()))
    n, v = sum(counts.values()), len(counts)
    want = sorted((sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in lm.tokens((r.text or "").encode())),
                   len(lm.tokens((r.text or "").encode()))) for r in rows)
    got = lm.score(docs, train)
    assert [(round(a, 6), b) for a, b in want] == sorted((round(r.base_score, 6), r.n_tokens) for r in got.collect())
    assert all(r.train_tokens == n and r.score <= 0 for r in got.collect())
    assert lm.score(docs, no_docs).filter("n_known > 0").count() == 0 and lm.score(no_docs, docs).count() == 0


def test_bloom_filter_never_undercounts():
    h = lm._mix(np.arange(1, 5000, dtype="u8"))
    n = np.arange(1, 5000) % 40 + 1
    import pyarrow as pa
    shift = np.uint64(64 - 6)
    parts = {}
    for s in range(64):
        own = (h >> shift) == s
        if own.any():
            # two tasks, each with some of the counts; the first n-gram of each is a word
            cuts = [n[own] // 2, n[own] - n[own] // 2]
            t = pa.table({"segment": pa.array([s, s], pa.int32()), "h": [h[own].tobytes()] * 2,
                          "n": [c.astype("u4").tobytes() for c in cuts], "tokens": [[b"w"], [b"w"]]})
            made = lm._segment_bits(1 << 30)(t)
            parts[s] = made.column("bits")[0].as_py()
            assert made.column("token").to_pylist() == [None, b"w"] and made.column("n")[1].as_py() == n[own][0]
    sizes = np.array([len(parts.get(s, b"")) for s in range(64)])
    found = lm.Filter(sizes, np.frombuffer(b"".join(parts[s] for s in sorted(parts)), "u1"), lm._shift(64)).counts(h)
    for s in parts:  # a segment of its own has the same answers
        own = (h >> shift) == s
        assert (lm.Filter.one(parts[s]).counts(h[own]) == found[own]).all()
    level = np.floor(np.log2(n))
    assert (found >= 2.0 ** level).all() and (found > 3 * 2.0 ** level).mean() < 0.1


def test_language_model_score_without_a_broadcast_filter(spark, docs, monkeypatch):
    """A filter over the broadcast bound has the same bits for an item, so the score is the same."""
    table = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").union(docs.select("doc_id", "text"))
    found = []
    for most in (lm.MAX_BYTES, 0):
        monkeypatch.setattr(lm, "MAX_BYTES", most)
        monkeypatch.setattr(lm, "CHUNK_BYTES", 1 << 14, raising=False)
        rows = lm.score(table, table.filter("doc_id % 3 > 0")).collect()
        found.append(sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in rows))
    assert found[0] == found[1] and len(found[0]) == table.count()


def test_runs_are_cut_at_base_spans():
    digest, random_ = "0123456789abcdef" * 2, "q7Zk2Xw9Lr4Tn8Vb3Ym6"
    alone = [(a, b) for a, k, b in secrets.spans_of(random_, RANKS) if k == 3]
    assert alone == [(0, 20)]
    text = f"{digest}/{random_}/more"
    spans = secrets.spans_of(text, RANKS)
    assert (0, 2, 32) in spans and [s for s in spans if s[1] == 3 and s[0] == 32]
    assert all(b <= 32 or a >= 32 for a, k, b in spans)  # nothing overlaps the base span
    assert secrets._rests(0, 60, [(10, 0, 15), (12, 1, 30)]) == [(30, 60)] and secrets._rests(0, 19, []) == []
    assert secrets._rests(5, 50, [(0, 2, 8), (48, 2, 90)]) == [(8, 48)]


def test_scores_do_not_depend_on_the_words_a_task_keeps(spark, monkeypatch):
    """Scoring forgets what it has looked up beyond a bound of its own, and gives freed memory back."""
    rows = [(i, " ".join(f"w{(i * 7 + j * j) % 50}" for j in range(30))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    given = []
    give_back = lm._give_back
    monkeypatch.setattr(lm, "_give_back", lambda: given.append(give_back()))
    want = sorted(map(tuple, lm.score_held_out(df).collect()))
    monkeypatch.setattr(lm, "SCORED_WORDS", 5)
    monkeypatch.setattr(lm, "TEXT_BATCH_ROWS", 1)
    assert sorted(map(tuple, lm.score_held_out(df).collect())) == want
    assert len(given) == 2
