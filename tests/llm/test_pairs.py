import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablecheck.llm import ngram_join, packing, topk
from tests.conftest import SF01
from tests.llm.helpers import empty_documents, odd_documents, prose

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


# near copies


def brute_links(rows, threshold=0.8):
    """class and number of links of each doc_id."""
    import re

    nodes, grams = defaultdict(list), {}
    for i, t in rows:
        w = tuple(re.findall(r"\w+", (t or "").lower()))
        nodes[w if w and i is not None else ("alone", i, len(nodes))].append(i)
    for w in nodes:
        if w[0] != "alone":
            grams[w] = {w[k : k + 5] for k in range(len(w) - 4)} if len(w) >= 5 else {w}
    keys, links, parent = list(grams), defaultdict(int), {w: w for w in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(keys)):
        for b in range(a + 1, len(keys)):
            x, y = grams[keys[a]], grams[keys[b]]
            if len(x & y) >= threshold * len(x | y) - 1e-9:
                links[keys[a]] += 1
                links[keys[b]] += 1
                parent[find(keys[a])] = find(keys[b])
    least = defaultdict(lambda: None)
    for w, ids in nodes.items():
        r = find(w)
        known = [x for x in [*ids, least[r]] if x is not None]
        least[r] = min(known) if known else None
    return {i: (least[find(w)], links[w], len(ids)) for w, ids in nodes.items() for i in ids}


def near_rows(groups, size, seed=1, n=120, edits=2):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = prose(rng, "en", n).split()
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = "edit" + str(rng.randrange(999))
            rows.append((len(rows), " ".join(w)))
    return rows


def test_near_copies_by_brute_force(spark):
    rows = near_rows(8, 6) + near_rows(1, 3, 7, 4) + [(1000, "one two three"), (1001, "One, two three!"), (1002, "one two")]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_links(rows)


def test_large_groups_go_to_a_grid(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SCREEN_BLOCK", 16)
    monkeypatch.setattr(ngram_join, "VERIFY_BLOCK", 8)
    rows = near_rows(2, 60, 5, 100, 3)
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_links(rows)


def test_near_copies_of_documents(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").where("doc_id < 350")
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in ngram_join.join(docs).collect()}
    assert got == brute_links([(r.doc_id, r.text) for r in docs.collect()])


def test_one_of_each(spark):
    rows = near_rows(5, 4)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows] + [(None, "no id", "x"), (50, "twice the same row here", "x"), (50, "twice the same row here", "x")], "doc_id long, text string, class_id string")
    kept = sorted((r.doc_id for r in ngram_join.one_of_each(df).collect()), key=lambda x: (x is not None, x))
    want = {c for c, _, _ in brute_links(rows).values()}
    assert kept == [None, *sorted(want), 50] and ngram_join.one_of_each(df).columns == df.columns


def test_depth_meets_the_target():
    assert ngram_join.recall(0.8, 24, ngram_join.first_depth(0.8, 24, 0.999, 8)) >= 0.999
    assert ngram_join.first_depth(0.99, 24, 0.9, 8) == 8 and ngram_join.first_depth(0.1, 2, 0.999, 8) == 1


def test_one_row_for_each_text_of_marks_or_numerals(spark):
    rows = [(1, "\u2764\ufe0f"), (2, "\U0001f468\u200d\U0001f469"), (3, "\u0301"), (4, "\u203f"), (5, "\u00bd"), (6, "\u00b2"), (7, "\u00bd"), (8, "..."), (None, "\u00bd"), (None, "\ufe0f"), (1, "\u2764\ufe0f")]
    got = sorted((r.doc_id or 0, r.class_id or 0, r.n_links, r.n_copies) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0, 0, 1), (0, 0, 0, 1), (1, 1, 0, 1), (1, 1, 0, 1), (2, 2, 0, 1), (3, 3, 0, 1), (4, 4, 0, 1), (5, 5, 0, 2), (6, 6, 0, 1), (7, 5, 0, 2), (8, 8, 0, 1)]


def test_words_and_grams_by_plain_code(monkeypatch):
    import re

    monkeypatch.setattr(ngram_join, "STRETCH", 50)
    rng = random.Random(3)
    texts = ["", " ", "a", "one two three four five", "One, two three FOUR five six", "x " * 200, "y" * 300 + " z", "ß É_x 1½ 😀z İ", *(prose(rng, "de", 30) for _ in range(20))]
    shingler = ngram_join.Shingler()
    (hashes, n, nodes), (grams, k, _) = shingler.words(texts), shingler.grams(texts)
    words = [re.findall(r"\w+", t.lower()) for t in texts]
    want = [[tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else [] for w in words]
    assert n.tolist() == [len(w) for w in words] and k.tolist() == [len(g) for g in want]
    for values, names in ((hashes, sum(words, [])), (grams, sum(want, []))):
        assert len({*zip(values.tolist(), names, strict=True)}) == len(set(values.tolist())) == len(set(names))
    assert [x is None for x in nodes] == [not w for w in words] and len({x for x in nodes if x}) == len({tuple(w) for w in words if w})


def test_estimate_by_capture():
    counts = lambda *rows: np.array(rows, float)
    assert ngram_join.enough(counts((9, 9, 9), (0, 0, 0), (0, 0, 0)), 0.999) is None
    assert ngram_join.enough(counts((990, 990, 981), (0, 0, 0), (5000, 5000, 5000)), 0.999)
    assert not ngram_join.enough(counts((700, 700, 490), (0, 0, 0), (9000, 9000, 9000)), 0.999)  # one bin lacks links
    assert ngram_join.missed(700, 700, 490) == (910, 90) and ngram_join.missed(5, 0, 0) == (5, 5)
    told = ngram_join.captures(np.array([[3, 0, 2, 8], [0, 1, 0, 0]]), np.array([0.8, 0.99]), 8, 0.8, 2.0)
    assert told[0].tolist() == [[2, 2, 2], [0, 0, 0], [2, 0, 0]] and told[2].tolist() == [[2, 2, 2], [0, 0, 0], [0, 0, 0]] and told[7].sum() == 2


@pytest.mark.parametrize("few_links", [True, False])
def test_prefixes_are_shortened_until_links_are_found(spark, monkeypatch, few_links):
    """Links just above the threshold: few trees miss them at long prefixes, and the estimate tells."""
    rng, rows = random.Random(8), []
    for g in range(150):
        base = [f"w{rng.randrange(10**6)}" for _ in range(104)]
        other = base[:95] + [f"v{rng.randrange(10**6)}" for _ in range(9)]  # 91 of 109 grams: 0.83
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(other))]
    seen, real = [], ngram_join.enough
    monkeypatch.setattr(ngram_join, "enough", lambda counts, target: seen.append(real(counts, target)) or seen[-1])
    monkeypatch.setattr(ngram_join, "BIN_LINKS", 10_000 if few_links else 50)
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), trees=8, depth=8, target=0.99).collect()
    linked = sum(r.n_links == 1 for r in got)
    assert linked >= 0.97 * len(rows) and all(r.class_id == r.doc_id // 2 * 2 for r in got if r.n_links)
    assert (seen == [None, None]) if few_links else (seen[0] is False and len(seen) > 2)


def test_all_links_of_two_thousand_documents(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text")
    near = near_rows(60, 12, 11, 90, 4) + near_rows(250, 2, 12, 60, 1)
    docs = docs.union(spark.createDataFrame([(10_000 + i, t) for i, (_, t) in enumerate(near)], "doc_id long, text string"))
    assert docs.count() > 2000
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in ngram_join.join(docs).collect()}
    want = brute_links([(r.doc_id, r.text) for r in docs.collect()])
    lost = sum(want[i][1] - got[i][1] for i in want)
    assert set(got) == set(want) and 0 <= lost <= 0.001 * sum(w[1] for w in want.values()) and all(got[i][2] == want[i][2] for i in want)


def test_one_of_each_decides_by_text(spark):
    a, b, c = (prose(random.Random(i), "en", 50) for i in range(3))
    rows = [(1, a, "x"), (5, a + " more", "x"), (5, b, "x"), (6, b + " tail", "x"), (7, None, "x"), (7, c, "x"), (8, c, "x"), (None, a, "x"), (9, "...", "x"), (9, "...", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _node string").selectExpr("*", "1 as doc", "2 as node", "3 as other")
    kept = ngram_join.one_of_each(df)
    got = sorted(((r.doc_id or 0, r.text or "") for r in kept.collect()))
    assert kept.columns == df.columns and got == sorted([(0, a), (1, a), (5, b), (7, ""), (7, c), (9, "..."), (9, "...")])


def test_near_copies_odd_rows(spark):
    rows = ngram_join.join(odd_documents(spark)).collect()
    assert len(rows) == 14 and {(r.class_id, r.n_copies) for r in rows if r.doc_id == 9} == {(9, 2)}
    assert all(r.class_id == r.doc_id and r.n_links == 0 for r in rows if r.doc_id in (2, 3, 4, None))
    assert ngram_join.join(empty_documents(spark)).count() == 0


# top-k


def brute_top(vectors, k=5):
    x = {i: np.floor(256 * np.array(v, np.float64)) for i, v in vectors if v is not None and all(c is not None and np.isfinite(c) for c in v)}
    out = []
    for q in x:
        if q % 50 == 0:
            best = sorted(((-int(x[q] @ x[c]), c) for c in x if c != q))[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [None, (3, 40)])
def test_topk_by_brute_force(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(topk, "QUERY_BLOCK", blocks[0])
        monkeypatch.setattr(topk, "CANDIDATE_BLOCK", blocks[1])
        monkeypatch.setattr(topk, "STEP", 8)
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(0, 0.2, 8)]) for i in range(400)]
    rows += [(400 + i, rows[i][1]) for i in range(30)] + [(700, None), (750, [0.1] * 7 + [float("nan")]), (800, [None] + [0.1] * 7), (850, [float("inf")] + [0.0] * 7), (900, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as score", "2 as rank", "3 as x")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(df, F.col("vec_id") % 50 == 0).collect())
    assert got == brute_top(rows)


def test_repeated_ids_each_take_part(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.5, 0.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [0.0, 1.0])]
    got = sorted(map(tuple, topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()))
    full, half = [(0, 128 * 256), (7, 256 * 256), (7, 256 * 256), (8, 0)], [(0, 128 * 256), (7, 128 * 256), (7, 128 * 256), (8, 0)]
    order = lambda found: [(0, r + 1, i, s) for r, (i, s) in enumerate(sorted(found, key=lambda x: (-x[1], x[0])))]
    assert got == sorted(order(full) + order(half))


def test_large_values_are_exact_and_lengths_must_agree(spark):
    rows = [(0, [2.0**26, 1.0 / 256]), (1, [2.0**26, 3.0 / 256]), (2, [2.0**26, 2.0 / 256])]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 2**68 % 2**64 + 3), (2, 2**68 % 2**64 + 2)] or [(r.vec_id, r.score - got[1].score) for r in got] == [(1, 1), (2, 0)]
    with pytest.raises(ValueError):
        topk.search(spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<float>"), F.col("vec_id") == 0)


def test_bounds_cut_work(spark, monkeypatch):
    monkeypatch.setattr(topk, "STEP", 32)
    rng = np.random.default_rng(2)
    centre = rng.normal(0, 1, (20, 16))
    x = centre[rng.integers(20, size=3000)] + rng.normal(0, 0.02, (3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = topk.search(df, F.col("vec_id") % 50 == 0, counts=True).first()
    assert got.pairs == 60 * 2999 and 0 < got.evaluated < 0.1 * got.pairs
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(df, F.col("vec_id") % 50 == 0).collect()) == brute_top(rows)


def test_topk_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.0, 1.0]), (None, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.search(df, F.col("vec_id") % 50 == 0).collect())) == [(0, 1, 50, 0), (50, 1, 0, 0)]
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# packing


def check_packing(rows, docs):
    """Gapless pieces that hold every id of every document once."""
    tokenizer = Tokenizer.from_file(VOCABULARY)
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in docs.items()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    assert set(by_doc) == set(ids) and all(sum(n for _, n in v) == len(ids[k]) for k, v in by_doc.items())
    for parts in [*by_doc.values(), *by_sequence.values()]:
        at = 0
        for start, n in sorted(parts):
            assert start == at and n > 0
            at += n
    assert all(sum(n for _, n in v) <= 2048 for v in by_sequence.values())
    return len(by_sequence), sum(map(len, ids.values()))


def test_packing_round_trip(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").where("doc_id < 300")
    rows = packing.pack(docs, VOCABULARY, 3).collect()
    n, total = check_packing(rows, {r.doc_id: r.text for r in docs.collect()})
    assert n <= total / 2048 + 3


def test_padding_is_small_with_many_partitions(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        rows = packing.pack(docs, VOCABULARY).select("sequence_id", "length").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len({r.sequence_id for r in rows}) <= 1.01 * sum(r.length for r in rows) / 2048 + 1
    assert packing.n_ranges(0, 200) == 1 and packing.n_ranges(10**9, 200) == 200 and packing.n_ranges(10**13, 200) == -(-(10**13) // packing.RANGE_BYTES)


def test_copies_stand_apart(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, "en", 150)) for i in range(300)]
    copies = [(i, t) for i, t in rows for _ in range(1 + i % 4)]
    got = packing.pack(spark.createDataFrame(copies, "doc_id long, text string"), VOCABULARY, 2).collect()
    of = defaultdict(set)
    for r in got:
        of[r.doc_id, r.sequence_id].add(r.copy)
    assert sum(len(c) > 1 for c in of.values()) <= 0.03 * len(of)  # at the end of a range nothing else may be left
    assert all({r.copy for r in got if r.doc_id == i} == set(range(1, 2 + i % 4)) for i in range(0, 300, 37))
    for i, copy in {(r.doc_id, r.copy) for r in got}:
        parts = sorted((r.start, r.length) for r in got if (r.doc_id, r.copy) == (i, copy))
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False))


def test_turns_of_copies():
    def run(rows, apart, held=10**6):
        turn, out, at = packing.in_turn(iter(rows), apart, held), [], 0
        row = next(turn, None)
        while row is not None:
            out.append((row[0], row[2]))
            at += 1
            try:
                row = turn.send(at)
            except StopIteration:
                row = None
        return out

    rows = [("a", "x")] * 3 + [("b", "x")] * 2 + [(c, "x") for c in "cdefg"]
    got = run(rows, 2)
    assert sorted(got) == sorted([("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2), *((c, 1) for c in "cdefg")]) and all(x[0] != y[0] for x, y in zip(got, got[1:], strict=False))
    assert run([("a", "x")] * 3, 5) == [("a", 1), ("a", 2), ("a", 3)] and run([], 5) == [] and len(run([("a", "x" * 100)] * 5, 5, 10)) == 5


def test_odd_texts_are_packed_whole(spark):
    texts = {1: "", 2: None, 3: "İstanbul ﬁ é x <|endoftext|> ΑΣ", 4: "it's 🙂🙂 a b\x85c\x1cd 1234", 5: "x" * 9000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check_packing(packing.pack(df, VOCABULARY, 2).collect(), texts)
    assert packing.pack(empty_documents(spark), VOCABULARY).count() == 0
    assert packing.pack(odd_documents(spark), VOCABULARY, 2).where("start = 0").count() == 14


def test_hilbert_curve_is_one_path():
    order = 3
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    key = packing.hilbert(grid, order)
    assert sorted(key) == list(range(512))
    path = grid[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_neighbours_are_alike():
    rng = random.Random(1)
    project = packing.projection()
    key = lambda texts: packing.curve_keys(texts, project)
    base = [prose(rng, x, 200) for x in ("en", "de", "fr")]
    near = [t + " extra word" for t in base]
    a, b = key(base), key(near)
    order = np.argsort(np.concatenate([a, b]))
    assert all(abs(list(order).index(i) - list(order).index(i + 3)) == 1 for i in range(3))
    assert key(["", "a"]).tolist() == key([""]).tolist() * 2
