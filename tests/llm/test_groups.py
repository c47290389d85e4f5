"""Operators on groups and pairs, against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowtrace.llm import components, decontaminate, lines, simhash
from tests.conftest import SF001


def _roots(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components_by_brute_force(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(150, 190)]
    want = _roots(200, pairs)
    df = spark.createDataFrame([*pairs, (None, 3)], "u long, v long")
    got = {r.vertex: r.root for r in components.components(df).collect()}
    assert got == {x: want[x] for p in pairs for x in p if p[0] != p[1]}
    assert components.components(df.filter("false")).count() == 0


def test_tree_finds_every_close_pair(monkeypatch):
    monkeypatch.setattr(simhash, "LEAF_POINTS", 4)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60, dtype="u8")
    flips = [np.uint64(1) << rng.integers(0, 64, dtype="u8") for _ in range(240)]
    points = np.unique(np.concatenate([base, rng.choice(base, 240) ^ np.array(flips, "u8")]))
    want = {(i, j) for i, j in combinations(range(len(points)), 2) if int(points[i] ^ points[j]).bit_count() <= 2}
    got = {(min(a, b), max(a, b)) for p, q in simhash.close_pairs(points, points, 2) for a, b in zip(p.tolist(), q.tolist(), strict=True) if a != b}
    assert got == want
    for top in (simhash.TopTree(points, 3), simhash.TopTree(points[:40], 6), simhash.TopTree(points[:0], 2)):  # the last two go below the fitted levels
        which, shard = top.deal(points, 2)
        sees = {i: set() for i in range(len(points))}
        for w, x in zip(which.tolist(), shard.tolist(), strict=True):
            assert x not in sees[w]  # once in a shard
            sees[w].add(x)
        assert all(sees.values()) and all(sees[a] & sees[b] for a, b in want)


def test_few_copies_in_deep_trees():
    """Points are dealt to a few shards each, also below the fitted levels, and no close pair is parted."""
    rng = np.random.default_rng(11)
    base = rng.integers(0, 2**63, 20_000, dtype="u8")
    flip = lambda: np.uint64(1) << rng.integers(0, 64, 20_000, dtype="u8")
    other = base ^ flip() ^ flip()
    top = simhash.TopTree(base[:500], 10)
    (a, sa), (b, sb) = top.deal(base, 2), top.deal(other, 2)
    assert len(a) < 8 * len(base)
    shared = set(zip(a.tolist(), sa.tolist(), strict=True)) & set(zip(b.tolist(), sb.tolist(), strict=True))
    assert {i for i, _ in shared} == set(range(len(base)))


def test_near_duplicates_by_brute_force(spark, docs, no_docs, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_POINTS", 16)
    table = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = sorted(table.select("doc_id", "text").collect())
    prints = [simhash.fingerprint(r.text.encode()) for r in rows]
    close = [(i, j) for i, j in combinations(range(len(rows)), 2) if (prints[i] ^ prints[j]).bit_count() <= 2]
    want = {rows[i].doc_id: (f"{prints[i]:016x}", rows[r].doc_id) for i, r in enumerate(_roots(len(rows), close))}
    found = simhash.near_duplicates(table)
    got = {r.doc_id: (r.hex, r.component_id) for r in found.withColumn("hex", simhash.hex_fingerprint(found.fp)).collect()}
    assert got == want
    kept = simhash.keep_one(table)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})
    edge = simhash.near_duplicates(docs)
    assert edge.count() == 8 and {r.component_id for r in edge.filter("doc_id in (2, 3)").collect()} == {2}
    assert simhash.keep_one(docs).filter("doc_id = 7").count() == 1 and simhash.near_duplicates(no_docs).count() == 0


def test_groups_that_share_an_id_each_keep_a_row(spark):
    one, other = " ".join(f"a{i}" for i in range(80)), " ".join(f"b{i}" for i in range(80))
    rows = [(1, one), (1, other), (2, one), (3, other)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, one), (1, other)]


def _line_brute(rows):
    first = {}
    for doc, text in rows:
        for i, x in enumerate((text or "").split("\n")):
            if x.strip(" \t\n\x0b\f\r"):
                first.setdefault(x, (doc, i))
    different = list(first)
    k = lines.SHINGLE_CHARS
    sets = [{x[i:i + k] for i in range(max(1, len(x) - k + 1))} for x in different]
    near = [(i, j) for i, j in combinations(range(len(sets)), 2) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    kept = {}
    for x, r in zip(different, _roots(len(sets), near), strict=True):
        kept[r] = min(kept.get(r, first[x]), first[x])
    stay = set(kept.values())
    return {doc: "\n".join(x for i, x in enumerate(text.split("\n")) if not x.strip(" \t\n\x0b\f\r") or (doc, i) in stay)
            for doc, text in rows if text is not None}


def test_line_dedup_by_brute_force(spark, docs, no_docs):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    made = []
    for doc in range(60):
        text = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(4)]
        if made:
            old = rng.choice(rng.choice(made)[1].split("\n")).split(" ")
            old[rng.randrange(len(old))] = rng.choice(words)  # a near copy of an earlier line
            text.append(" ".join(old))
        made.append((doc, "\n".join([*text, "", " "])))
    df = spark.createDataFrame(made, "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.dedup_lines(df).collect()}
    want = _line_brute(made)
    assert sum(got[d] != want[d] for d in want) <= 1  # banding may miss a link of little over 0.8
    edge = {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()}
    assert edge[2] is None and edge[3] == "" and edge[6] == "one line\nand more\n" and edge[7] == "tie tie tie"
    assert lines.dedup_lines(docs).columns == [*docs.columns, "_dropped"] and lines.dedup_lines(no_docs).count() == 0


def test_lines_of_one_large_group(spark):
    """Near copies of one line, of which many have no link to the bucket's least line."""
    rng = random.Random(8)
    base = [rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(300)]
    rows = []
    for doc in range(120):
        text = list(base)
        for at in rng.sample(range(300), 1 if doc % 8 == 0 else 2):  # two lines with two changes each are mostly no link
            text[at] = rng.choice("0123456789")
        rows.append((doc, "".join(text)))
    want = _line_brute(rows)
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and sum(map(bool, want.values())) < 10


def test_pairs_of_a_group_are_links_only(spark, monkeypatch):
    """Near copies around the least similarity: the join gives out links between components, not pairs to be verified."""
    rng = random.Random(12)
    base = [rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(300)]
    rows = []
    for doc in range(160):
        text = list(base)
        for at in rng.sample(range(300), rng.randint(2, 7)):
            text[at] = rng.choice("0123456789")
        rows.append((doc, "".join(text)))
    made, across = [], lines._across

    def counted(members):
        pairs = across(members).persist()
        made.append((members.count(), pairs.count()))
        return pairs

    monkeypatch.setattr(lines, "_across", counted)
    monkeypatch.setattr(lines, "CELL_LINES", 8)  # lines of a centre are dealt to many cells
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _line_brute(rows)
    k = lines.SHINGLE_CHARS
    sets = [{x[i:i + k] for i in range(len(x) - k + 1)} for _, x in rows]
    links = sum(5 * len(x & y) >= 4 * len(x | y) for x, y in combinations(sets, 2))
    members, pairs = made[0]
    assert members > 20 and pairs <= 8 * links  # a link at most once for each centre


def test_line_dedup_of_rulers_and_repeated_phrases(spark):
    """Long lines of few different shingles; their length says nothing about their similarity."""
    marks = "*_#+=-~"
    repeat = lambda phrase, n: (phrase * n)[:n]
    made = [repeat(m, n) for m in marks for n in (20, 100, 170, 180, 200, 400)]
    made += [repeat(f"phrase {c} again, ", n) for c in marks for n in (120, 180, 300)]
    rows = [(doc, f"{x}\nonly here: {doc * 7919}") for doc, x in enumerate(made)]
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _line_brute(rows)


def test_leaks_by_brute_force(spark, docs, no_docs):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    draw = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, draw(rng.randint(3, 40))) for i in range(25)]
    rows, want = [], set()
    for doc in range(80):
        text = draw(60)
        if doc % 2:
            number, item = rng.choice(items)
            item = list(item)
            if doc % 4 == 3 and len(item) > 30:
                item[-1] = "changed"
            text[20:20] = item
            want.add((doc, number))
        rows.append((doc, " ".join(text).upper().replace(" ", ", ", 3)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(90, None), (91, "")], "item_id long, text string")
    found = decontaminate.find_leaks(df, bench)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want
    kept = decontaminate.keep_clean(df, bench)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in want} and kept.columns == df.columns
    assert decontaminate.find_leaks(docs, bench).count() == 0 and decontaminate.find_leaks(no_docs, bench).count() == 0
    assert decontaminate.keep_clean(docs, bench.filter("false")).count() == 8


def test_leaks_of_shortened_items_that_make_up_a_document():
    words = [f"w{i}" for i in range(60)]
    index = decontaminate.Index([(0, words)])
    assert index.matches(" ".join(words[:57])) == [(0, 0, 57, 53 / 56)]
    assert index.matches(" ".join(words[3:])) == [(0, 0, 57, 53 / 56)]
    assert index.matches(" ".join(words)) == [(0, 0, 60, 1.0)]
    assert [len(index.matches(" ".join(words[:n]))) for n in (50, 49, 48, 4)] == [1, 1, 0, 0]  # 45 of 56 shingles are the least


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_the_columns(spark, docs, stage):
    assert corpus_pipeline.STAGES[stage][1](spark, docs, SF001).columns == docs.columns


def test_pipeline_rows(spark):
    docs = corpus_pipeline.table(spark, SF001, "documents")
    got = corpus_pipeline.run(spark, SF001)
    ids = {r.doc_id for r in got.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF001).persist()
    assert ids == {r.doc_id for r in docs.collect()} and 0 < len(ids)


def test_leaks_keep_the_type_of_the_item_id(spark):
    words = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"before {words} after")], "doc_id int, text string")
    for kind in ("int", "smallint", "bigint", "string", "decimal(9,2)"):
        bench = spark.createDataFrame([("7", words)], "item_id string, text string").selectExpr(f"cast(item_id as {kind}) as item_id", "text")
        found = decontaminate.find_leaks(docs, bench)
        assert found.schema["item_id"].dataType.simpleString() == kind and [int(r.item_id) for r in found.collect()] == [7]


def test_line_dedup_keeps_columns_with_the_names_of_its_own(spark):
    names = ["dropped", "parts", "left", "row", "h", "t", "doc", "_text_hash", "id", "text_hash"]
    made = [(i, "the same line of text\n" + f"only here {i * 7919}", *[f"{n}{i}" for n in names]) for i in range(3)]
    df = spark.createDataFrame(made, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = sorted(map(tuple, lines.dedup_rows(df).select("row.*").collect()))
    assert got == [(i, made[i][1] if i == 0 else f"only here {i * 7919}", *made[i][2:]) for i in range(3)]
    assert corpus_pipeline.line_dedup(spark, df, SF001).columns == df.columns


def test_minima_are_those_of_all_shingles(spark):
    """Lines of every length around the steps in which shingles are taken together."""
    rng = random.Random(15)
    made = [(n, "".join(rng.choice("abcé𝄞 ") for _ in range(n))) for n in range(1, 3 * lines.STEP + lines.SHINGLE_CHARS + 2)]
    df = spark.createDataFrame(made, "line_id long, line string")
    single = df.select("line_id", F.explode(lines._all_hashes("line")).alias("h")).groupBy("line_id").agg(F.collect_list("h").alias("hs"))
    want = {r.line_id: tuple(min(h ^ m for h in r.hs) for m in lines._masks(32)) for r in single.collect()}
    assert {r[0]: tuple(r[1:]) for r in lines._min_hashes(df).collect()} == want


@pytest.mark.parametrize("links, rounds", [([(900, i) for i in range(50)] + [(i, 900) for i in range(20)], 1), ([(i, 5) for i in range(6, 60)], 0),
                                           ([(i, i + 1) for i in range(60)] + [(99, 99), (None, 3)], None), ([], 0)])
def test_components_stop_at_stars(spark, monkeypatch, links, rounds):
    """No round is spent on links that are stars already, and few links stay in one partition."""
    seen, star = [], components._star
    monkeypatch.setattr(components, "_star", lambda now: seen.append(now.rdd.getNumPartitions()) or star(now))
    got = components.components(spark.createDataFrame(links, "u long, v long")).collect()
    real = [e for e in links if None not in e and e[0] != e[1]]
    names = sorted({x for e in real for x in e})
    roots = _roots(len(names), [(names.index(a), names.index(b)) for a, b in real])
    assert len(got) == len(names) and {r.vertex: r.root for r in got} == {x: names[r] for x, r in zip(names, roots, strict=True)}
    assert set(seen) <= {1} and (rounds is None or len(seen) == rounds)


def test_line_tables_are_stored_as_parquet(spark, monkeypatch):
    """Rows of the line tables are not written one object at a time; only the rounds of components are checkpoints."""
    made, checkpoint = [], type(spark.range(1)).checkpoint

    def watched(df, *args, **kwargs):
        made.append(df.columns)
        return checkpoint(df, *args, **kwargs)

    monkeypatch.setattr(type(spark.range(1)), "checkpoint", watched)
    text = "a line that many documents hold with a change in one place only, number "
    rows = [(d, f"{text}{d}\nonly in {d * 7919}") for d in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in lines.dedup_lines(df).collect()} == _line_brute(rows)
    assert made and all(columns == ["u", "v"] for columns in made)
