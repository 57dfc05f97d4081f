import random

import numpy as np
import pytest

from tablecheck.llm import crf, quality_lines
from tests.llm.helpers import empty_documents, odd_documents, prose

SPACES = " \t\n\v\f\r"


def brute_base(text):
    import re

    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(found)
    windows = [tuple(found[i : i + 5]) for i in range(n - 4)]
    hit = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return n, sum(map(len, found)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit)


@pytest.fixture(scope="module")
def model():
    rng = random.Random(4)
    good = [(prose(rng, n=80), 1) for _ in range(40)]
    bad = [(" | ".join(prose(rng, n=40).split()), 0) for _ in range(20)]
    mixed = [(prose(rng, n=60) + "\nAll rights reserved.", 1) for _ in range(10)]
    return quality_lines.LineModel.train(good + bad + mixed)


def test_viterbi_and_posteriors_by_brute_force():
    import itertools

    rng = np.random.default_rng(0)
    lens = np.array([3, 0, 5, 1])
    em, trans, start = rng.normal(size=(9, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    labels, (post, logz, pairs) = crf.viterbi(em, lens, trans, start), crf.forward_backward(em, lens, trans, start)
    at, z, counts = 0, 0.0, np.zeros((3, 3))
    for n in lens:
        if not n:
            continue
        e = em[at : at + n]
        paths = list(itertools.product(range(3), repeat=int(n)))
        score = np.array([start[p[0]] + sum(e[i, k] for i, k in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:], strict=False)) for p in paths])
        assert tuple(labels[at : at + n]) == paths[int(score.argmax())]
        w = np.exp(score - score.max())
        z += np.log(w.sum()) + score.max()
        w /= w.sum()
        want = np.array([[sum(x for p, x in zip(paths, w, strict=True) if p[i] == k) for k in range(3)] for i in range(n)])
        assert np.allclose(post[at : at + n], want)
        for p, x in zip(paths, w, strict=True):
            for a, b in zip(p, p[1:], strict=False):
                counts[a, b] += x
        at += n
    assert np.isclose(z, logz) and np.allclose(counts, pairs)


def test_gradient_by_differences():
    rng = np.random.default_rng(1)
    lens, em, trans, start = np.array([4, 2]), rng.normal(size=(6, 2)), rng.normal(size=(2, 2)), rng.normal(size=2)
    gold = np.array([0, 1, 1, 0, 1, 0])
    value, d_em, d_trans, _ = crf.loss_and_gradient(em, lens, gold, trans, start)
    for array, grad in ((em, d_em), (trans, d_trans)):
        array[1, 0] += 1e-6
        assert np.isclose((crf.loss_and_gradient(em, lens, gold, trans, start)[0] - value) / 1e-6, grad[1, 0], atol=1e-4)
        array[1, 0] -= 1e-6


def test_base_counts_by_brute_force():
    rng = random.Random(3)
    texts = ["", " \n ", "a b c d e a b c d e f", "x\ny\nx\n\n\n x\nx", "# * 🙂 é é <|>", "a a a a a a a"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    for t in texts:
        assert quality_lines.base_counts(t) == brute_base(t), t


def test_content_and_boilerplate(spark, model):
    rng = random.Random(8)
    rows = [(1, prose(rng, n=80)), (2, " | ".join(prose(rng, n=60).split())), (3, prose(rng, n=50) + "\nAll rights reserved."), (4, "too short")]
    got = {r.doc_id: r for r in quality_lines.apply(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [got[i].kept for i in (1, 2, 3, 4)] == [True, False, True, False] and got[3].content_share < 1
    assert got[3].n_content_lines == got[3].n_lines - 1


def test_notices_of_any_language():
    rng = random.Random(5)
    docs = [f"{prose(rng, lang, 60)}\n{end}" for lang, end in (("de", "Alle Rechte vorbehalten."), ("fr", "Tous droits réservés.")) for _ in range(8)]
    docs += [prose(rng, "en", 60)] * 9  # exact copies
    near = prose(rng, "en", 100).split("\n")
    docs += ["\n".join([*near[:i], prose(rng, "en", 8), *near[i + 1 :]]) for i in range(len(near))]  # near copies
    middle = "the same line within many texts."
    docs += [f"{prose(rng, 'en', 20)}\n{middle}\n{prose(rng, 'en', 20)}" for _ in range(8)]
    found = quality_lines.notices([d.encode().split(b"\n") for d in docs])
    assert found == {"Alle Rechte vorbehalten.".encode(), "Tous droits réservés.".encode()}
    model = quality_lines.LineModel.train([(d, 1) for d in docs])
    lines = f"{prose(rng, 'fr', 60)}\nTous droits réservés.".encode().split(b"\n")
    labels = model.decode(np.array(quality_lines.line_features(lines)[0]), np.array([len(lines)]))
    assert labels[-1] == quality_lines.NOTICE and (labels[:-1] == quality_lines.CONTENT).all()


def test_odd_rows(spark, model):
    rows = quality_lines.apply(odd_documents(spark), model).collect()
    assert len(rows) == 14 and all(not r.kept and r.base_failed for r in rows if r.doc_id in (2, 3, 4))
    assert len({tuple(r) for r in rows if r.doc_id == 9}) == 1
    assert quality_lines.apply(empty_documents(spark), model).count() == 0
    nothing = quality_lines.fit(odd_documents(spark), spark.createDataFrame([], "doc_id long, quality int"))
    assert all(r.kept != r.base_failed or r.n_words == 0 for r in quality_lines.apply(odd_documents(spark), nothing).collect())
