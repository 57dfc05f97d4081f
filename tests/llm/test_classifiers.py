import random
import tracemalloc
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from tablecheck.llm import common, cotraining, language, toxicity
from tests.conftest import SF01
from tests.llm.helpers import empty_documents, odd_documents, prose


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    got = language.apply(docs, language.fit(docs, 300)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(crc32(str(r.doc_id).encode()) % 4 == 2 for r in got) and len(got) > 200
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_code_switched_words():
    rng = random.Random(1)
    model = language.LanguageModel.train([(prose(rng, x, 80), x) for x in ("en", "de", "fr") for _ in range(30)])
    names, share, total, turns = language.Scorer(model)([prose(rng, "de", 60), prose(rng, "de", 40) + " " + prose(rng, "fr", 20), "12 34 !", ""])
    assert names == ["de", "de", "und", "und"] and share[1] < share[0] and turns[1] >= 1 and turns[0] == 0 and total[2] == 0


def test_long_words_count_whole():
    rng = random.Random(4)
    model = language.LanguageModel.train([(prose(rng, lang, 80), lang) for lang in ("en", "de", "fr") for _ in range(30)], sequences=300)
    joined = {lang: "".join(prose(rng, lang, 3000).split()) for lang in ("en", "de", "fr")}
    tokens = [joined["en"][:70] + joined["de"], joined["de"][:70] + joined["fr"], joined["fr"][:70] + joined["en"]]
    names, _, total, _ = language.Scorer(model)(tokens)
    assert names == ["de", "fr", "en"] and total.tolist() == [1, 1, 1]
    a, b = "x" * 100 + "a", "x" * 100 + "b"
    assert len(set(language.word_hashes([a, b]).tolist())) == 2
    words = [a, "the", "y" * 3_000_000, "ein", b]
    assert np.allclose(model.word_scores(words)[0], np.concatenate([model.word_scores([w])[0] for w in words]))


def test_rare_languages_are_learned(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, "en", 40), "en") for i in range(400)] + [(1000 + i, prose(rng, "fr", 40), "fr") for i in range(6)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_docs=20)
    assert model.langs == ["en", "fr"]
    assert language.Scorer(model)([prose(rng, "fr", 60), prose(rng, "en", 60)])[0] == ["fr", "en"]


def test_document_by_plain_code():
    """Features of a word one by one; posteriors of a document by sums over all label paths."""
    from itertools import product

    rng = random.Random(7)
    model = language.LanguageModel.train([(prose(rng, x, 60), x) for x in ("en", "de", "fr") for _ in range(10)], sequences=200)
    hashes = dict(zip(model.lexicon.tolist(), model.lexicon_lang.tolist(), strict=True))

    def mixed(x, kind):
        return (((x ^ (kind * 0x9E3779B97F4A7C15 % 2**64)) * 0xD6E8FEB86659FD93 % 2**64) >> 32) % (1 << language.BITS)

    def score(word):
        edged = [ord(c) for c in f"^{language.cleaned(word)}$"]
        step, base = int(language._STEP), int(language._BASE)
        roll = lambda codes: [h := 0, *[h := (h * step + c) % 2**64 for c in codes]][-1]
        whole = sum((c + 7) * pow(base, i + 1, 2**64) for i, c in enumerate(edged)) % 2**64
        ids = [mixed(whole, 1)]
        for k in (2, 3):
            ids += [mixed(roll(edged[i : i + k]), k) for i in range(len(edged) - k + 1)]
        for k in range(1, 5):
            if len(edged) - 2 >= k:
                ids += [mixed(roll(edged[1 : 1 + k]), 10 + k), mixed(roll(edged[len(edged) - 2 : len(edged) - 2 - k : -1]), 20 + k)]
        if whole in hashes:
            ids.append(mixed(hashes[whole], 30))
        return sum(model.weights[i] for i in ids)

    text = " ".join([*prose(rng, "de", 4).split(), "12", *prose(rng, "fr", 3).split()])
    words = text.split()
    em = [score(w) if language.has_letter(w) else np.zeros(3) for w in words]
    mass, total = np.zeros(3), 0.0
    for path in product(range(3), repeat=len(words)):
        z = np.exp(model.start[path[0]] + sum(em[i][x] for i, x in enumerate(path)) + sum(model.trans[a, b] for a, b in zip(path, path[1:], strict=False)))
        total += z
        for i, x in enumerate(path):
            mass[x] += z * language.has_letter(words[i])
    names, share, n, _ = language.Scorer(model)([text])
    mass /= total
    assert names == [model.langs[int(mass.argmax())]] and np.isclose(share[0], mass.max() / n[0], atol=1e-6)


def test_language_odd_rows(spark):
    docs = odd_documents(spark)
    rows = language.apply(docs, language.fit(docs)).collect()
    assert len(rows) == 14 and all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (2, 3, 4))
    assert language.apply(empty_documents(spark), language.fit(docs)).count() == 0
    assert {r.lang_pred for r in language.apply(docs, language.fit(empty_documents(spark))).collect()} == {"und"}


def toxic_rows(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang, bad = rng.choice(["en", "de"]), i % 4 == 0
        w = prose(rng, lang, 50).split()
        if bad:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice({"en": ["scumxx", "vilexx"], "de": ["uebelxx", "mistxx"]}[lang]))
        out.append((" ".join(w), lang, int(bad)))
    return out


def test_toxicity_learns():
    model = toxicity.ToxicModel.train(toxic_rows(400, 1), steps=200)
    test = toxic_rows(200, 2)
    got = toxicity.Scorer(model)([t for t, _, _ in test]) >= 0.5
    label = np.array([y == 1 for _, _, y in test])
    assert (got == label).mean() > 0.95 and got[label].mean() > 0.9
    alone = toxicity.Scorer(model)([test[0][0]])
    assert np.isclose(alone[0], toxicity.Scorer(model)([t for t, _, _ in test])[0])  # neighbours in a batch do not matter


def test_forward_pass_by_plain_loops():
    """Embeddings, filters, pooling and the logistic layer, word by word."""
    import re

    model = toxicity.ToxicModel.train(toxic_rows(80, 5), steps=30)
    texts = ["", "one", "scumxx vilexx two", *(t for t, _, _ in toxic_rows(6, 6))]
    got = toxicity.Scorer(model)(texts)
    for text, score in zip(texts, got, strict=True):
        words = re.findall(r"\w+", text.lower())
        vectors = [sum(share * model.emb[b] for share, b in zip(toxicity.SHARES, toxicity.buckets(w), strict=True)) for w in words]
        pooled = []
        for width in toxicity.WIDTHS:
            for f in range(toxicity.FILTERS):
                best = 0.0
                for at in range(len(words)):
                    z = float(model.bias[width][f])
                    for j in range(width):
                        if at + j < len(words):
                            z += float(vectors[at + j] @ model.conv[width][j, :, f])
                    best = max(best, z)
                pooled.append(best)
        logit = float(np.dot(pooled, model.out)) + float(model.out_bias[0])
        mass = [sum(float(model.lang_table[toxicity.buckets(w)[0], k]) for w in words) for k in range(len(model.langs))]
        assert np.isclose(score, 1 / (1 + np.exp(-(logit - model.threshold[int(np.argmax(mass))]))), atol=1e-4)


def test_contradicting_labels_teach_the_same_each_time(spark):
    rows = toxic_rows(60, 9)
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang, _) in enumerate(rows)] + [(0, "another text of that id", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, y) for i, (_, _, y) in enumerate(rows)] + [(1, 0), (1, 1), (2, None)], "doc_id long, toxic int")
    from tablecheck.llm.common import collected

    ids = labels.dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    first, again = (collected(d, ids, ["text", "lang"], 10**6) for d in (docs, docs.repartition(7, "text")))
    assert first == again and len(first) == 60 and first[0].text == min(rows[0][0], "another text of that id")
    few = collected(docs, ids, ["text", "lang"], 2000)
    assert 0 < len(few) < 60 and sum(len(r.text) for r in few) <= 2000


def test_toxicity_on_tables(spark):
    docs, labels = spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/labels.parquet")
    model = toxicity.fit(docs, labels)
    got = toxicity.apply(docs, model).join(labels, "doc_id").where("held_out").collect()
    hits, said, real = sum(r.predicted and r.toxic for r in got), sum(r.predicted for r in got), sum(r.toxic for r in got)
    assert all(r.predicted == (r.score >= 0.5) for r in got) and real >= 5 and hits >= 0.5 * real and hits >= 0.5 * said
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and 0.8 * docs.count() < kept.count() < docs.count()


def test_toxicity_odd_rows(spark):
    docs = odd_documents(spark)
    model = toxicity.ToxicModel.train(toxic_rows(100, 3), steps=20)
    rows = toxicity.apply(docs, model).collect()
    assert len(rows) == 14 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.apply(empty_documents(spark), model).count() == 0
    blank = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.apply(docs, blank).collect()} == {0.0} and toxicity.keep_clean(docs, blank).count() == 14


def test_toxicity_holds_little_at_once(spark):
    """30 MB of text in one task: neither the batches that come nor the words that are kept grow with it; every row is scored."""
    docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 1000) AS text")
    setting = common.BATCH_SETTING
    before = spark.conf.get(setting)
    try:
        spark.conf.set(setting, "64m")
        model = toxicity.ToxicModel(["en"])
        model.trained = True
        assert toxicity.apply(docs, model).count() == 3000 and toxicity.keep_clean(docs, model).count() <= 3000
        sizes = common.map_texts(docs, lambda part: {"n": [part.num_rows], "whole": [part.column("text").buffers()[2].size]}, "n long, whole long").collect()
        assert sum(r.n for r in sizes) == 3000 and max(r.whole for r in sizes) <= 2 * common.BATCH_BYTES
        spark.conf.set(setting, "1m")
        toxicity.apply(docs, model)
        assert spark.conf.get(setting) == "1m"  # a lower one stays
    finally:
        spark.conf.set(setting, before)
    score = toxicity.Scorer(model)
    tracemalloc.start()
    for i in range(60):
        assert len(score([" ".join(f"w{i}x{d}x{k}" for k in range(500)) for d in range(10)])) == 10
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 45_000_000


def test_cotraining(spark):
    docs, labels, pages = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels", "pages"))
    assert cotraining.with_pages(docs, pages).count() == docs.count()
    pair = cotraining.fit(docs, pages, labels.where("doc_id % 3 <> 0"))
    got = cotraining.apply(docs, pages, pair).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    assert sum(r.kept == bool(r.quality) for r in got) / len(got) > 0.9
    assert all(0 <= x <= 1 for r in got for x in (r.text_score, r.meta_score, r.score))


class Listed:
    """A pool in memory, as cotraining.Pool is of tables."""

    def __init__(self, rows):
        self.rows, self.taken, self.handed = rows, [set(), set()], 0

    def surest(self, pair, k, good, bad):
        logit = pair.logits(k, [r[1:5] if k else r[:1] for r in self.rows])
        order = sorted(range(len(logit)), key=lambda i: -logit[i])
        found = [i for i in order if logit[i] > cotraining.SURE and i not in self.taken[k]][:good], [i for i in reversed(order) if logit[i] < -cotraining.SURE and i not in self.taken[k]][:bad]
        self.taken[k].update(*found)
        self.handed += len(found[0]) + len(found[1])
        return [(cotraining.features(1 - k, self.rows[i][:1] if k else self.rows[i][1:5]), y) for y, part in ((1, found[0]), (0, found[1])) for i in part]


def crossed_rows():
    rng, rows = random.Random(5), []
    for i in range(300):
        good = i % 2 == 0
        text = prose(rng, "en", 40) if good else " | ".join(prose(rng, "en", 30).split())
        rows.append((text, f"{'clean' if good else 'junk'}{i % 6 // 2}", "en", 100, None, int(good)))
    return rows


def test_pseudo_labels_cross_views():
    rows = crossed_rows()
    known, pool = [r for r in rows[:60] if r[1][-1] == "0"], Listed(rows[60:])  # of other sources the metadata view learns from the text view alone
    pair, alone = cotraining.Pair.train(known, pool, handed=40), cotraining.Pair.train(known)
    want = np.array([r[5] == 1 for r in rows[60:]])
    right = lambda p: ((p.score(rows[60:])[1] >= 0.5) == want).mean()
    assert pool.handed > 60 and right(pair) > 0.95 and right(alone) < 0.9
    assert ((pair.score(rows[60:])[2] >= 0.5) == want).mean() > 0.95


def test_pool_of_tables_gives_what_the_list_gives(spark):
    rows = crossed_rows()
    docs = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(rows)] + [(None, "no id", "x", "en", 1)], "doc_id long, text string, source string, lang string, n_chars long")
    marked = spark.createDataFrame([(i,) for i in range(60)], "doc_id long")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    pool, listed = cotraining.Pool(docs, pages, marked, 10**7), Listed(rows[60:])
    pair = cotraining.Pair.train(rows[:60])
    for k in (0, 1):
        for _ in range(2):
            got, want = pool.surest(pair, k, 20, 20), listed.surest(pair, k, 20, 20)
            assert sorted(y for _, y in got) == sorted(y for _, y in want) and len(got) == 40
    assert len(set(pool.taken[0])) == len(pool.taken[0]) == 80 and min(pool.taken[0]) >= 60
    logit = {r.doc_id: r.logit for r in pool.scored(pair, 0).collect()}
    assert len(logit) > 200 and np.allclose([logit[i] for i in logit], pair.logits(0, [rows[i][:1] for i in logit]))


def test_views_by_plain_code():
    """Log-odds, calibration and combination, value by value."""
    rows = crossed_rows()
    pair = cotraining.Pair.train(rows[:80])
    for row, a, b, both in zip(rows[80:100], *pair.score(rows[80:100]), strict=True):
        z = []
        for k, view in enumerate(pair.views):
            dense, buckets = cotraining.features(k, row[1:5] if k else row[:1])
            x = sum(float(view.w[i]) for i in buckets) / np.sqrt(len(buckets)) + float(view.b[0])
            x += sum((float(d) - float(m)) / float(s) * float(w) for d, m, s, w in zip(dense, view.mean if len(dense) else [], view.spread if len(dense) else [], view.d, strict=True))
            z.append(view.slope * x + view.shift)
        total = pair.prior + pair.text.weight * (z[0] - pair.prior) + pair.meta.weight * (z[1] - pair.prior)
        sigmoid = lambda x: 1 / (1 + np.exp(-x))
        assert np.allclose([a, b, both], [sigmoid(np.clip(x, -40, 40)) for x in (z[0], z[1], total)])


def test_cotraining_odd_rows(spark):
    docs, pages = odd_documents(spark), spark.createDataFrame([(1, None, None), (2, "http://x.example/en/9", ""), (3, "http://y.example/en/9.html", None), (4, "nothing", None)], "page_id long, url string, html string")
    wide = cotraining.with_pages(docs, pages)
    assert wide.count() == 14 and {r.url for r in wide.where("doc_id = 9").collect()} == {"http://x.example/en/9"}
    assert len(cotraining.meta_features("a", None, -1, None)) == 6 and cotraining.meta_features(None, "b", None, "http://x").tolist() == cotraining.meta_features(None, "b", 0, "http://x").tolist()
    blank = cotraining.fit(docs, pages, spark.createDataFrame([], "doc_id long, quality int"))
    assert all(r.kept and r.score == 0.5 for r in cotraining.apply(docs, pages, blank).collect())
    pair = cotraining.fit(docs, pages, spark.createDataFrame([(1, 1), (5, 0), (6, 0), (8, 1), (9, 1), (7, 0)], "doc_id long, quality int"))
    assert cotraining.apply(docs, pages, pair).count() == 14
    assert cotraining.apply(empty_documents(spark), pages, pair).count() == 0
